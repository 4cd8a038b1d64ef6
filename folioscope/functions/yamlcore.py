"""Frontmatter values by YAML 1.2's core schema, and edits that leave the rest alone."""

from __future__ import annotations

import json
import re

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame

_BLOCK = re.compile(r"\A---[ \t]*\r?\n(.*?\n)?---[ \t]*(?:\r?\n|\Z)", re.S)


class _Loader(yaml.SafeLoader):
    """The core schema: dates, yes and on are strings; a key given twice is an error."""


_Loader.yaml_implicit_resolvers = {}
#: The core schema's tags and patterns.
for _tag, _pattern, _first in (
    ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")),
    ("int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", list("-+0123456789")),
    ("float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", list("-+.0123456789")),
):
    _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_pattern), _first)


def _mapping(loader, node, deep=True):
    keys = [loader.construct_object(k, deep=True) for k, _ in node.value]
    if len({json.dumps(k, default=str) for k in keys}) < len(keys):
        raise yaml.constructor.ConstructorError(None, None, "a key is given twice", node.start_mark)
    return dict(zip(keys, [loader.construct_object(v, deep=True) for _, v in node.value], strict=True))


def _int(loader, node):
    v = node.value
    return int(v, 0) if v.startswith(("0o", "0x")) else int(v)


_Loader.add_constructor("tag:yaml.org,2002:map", _mapping)
_Loader.add_constructor("tag:yaml.org,2002:int", _int)


def split(text: str) -> tuple[str | None, str]:
    """P-01: the block (null if there is none) and the body."""
    m = _BLOCK.match(text)
    return (m[1] or "", text[m.end() :]) if m else (None, text)


def values(text: str) -> dict:
    """P-02: the block's mapping; empty for none or for what is no mapping."""
    block, _ = split(text)
    found = yaml.load(block, _Loader) if block else None  # noqa: S506  a subclass of the safe loader
    return found if isinstance(found, dict) else {}


def _scalar(value) -> str:
    if isinstance(value, bool) or value is None or isinstance(value, int | float):
        return json.dumps(value)
    text = str(value)
    plain = re.fullmatch(r"[A-Za-z0-9_./][^\n]*", text) and not re.search(r": |:$| #|\s$", text)
    if plain and text.isprintable() and yaml.load(text, _Loader) == text:  # noqa: S506
        return text
    return '"' + "".join(_escaped(c) for c in text) + '"'


def _escaped(c: str) -> str:
    if c in '"\\':
        return "\\" + c
    if c == " " or c.isprintable() and c not in "\ufeff":
        return c
    return f"\\x{ord(c):02x}" if ord(c) < 256 else f"\\u{ord(c):04x}" if ord(c) < 65536 else f"\\U{ord(c):08x}"


def _entry(key: str, value) -> str:
    if isinstance(value, list):
        return f"{_scalar(key)}: []\n" if not value else f"{_scalar(key)}:\n" + "".join(f"  - {_scalar(v)}\n" for v in value)
    return f"{_scalar(key)}: {_scalar(value)}\n"


def set_key(text: str, key: str, value) -> str:
    """S-16: the text with the key's lines replaced, or with the key appended; everything
    else, the body above all, stays byte for byte."""
    block, body = split(text)
    entry = _entry(key, value)
    if block is None:
        return f"---\n{entry}---\n{text}"
    node = yaml.compose(block, _Loader) if block.strip() else None
    new = block + entry
    if isinstance(node, yaml.MappingNode):
        pairs = node.value
        lines = block.splitlines(keepends=True)
        for n, (k, _) in enumerate(pairs):
            if k.value == key:
                upto = pairs[n + 1][0].start_mark.line if n + 1 < len(pairs) else len(lines)
                new = "".join(lines[: k.start_mark.line]) + entry + "".join(lines[upto:])
    return f"---\n{new}---\n{body}"


def merge_key(text: str, key: str, new: list) -> str:
    """S-16, O-05: the key's list with values that it lacks appended."""
    old = values(text).get(key)
    merged = list(old) if isinstance(old, list) else []
    for v in new:
        if v not in merged:
            merged.append(v)
    return set_key(text, key, merged)


def with_frontmatter(pages: DataFrame) -> DataFrame:
    """P-02: (page_ref, text, json): the mapping as JSON; null where the YAML is invalid.

    A step of its own, that the optimizer neither copies nor moves into filters."""

    def of(t: str | None) -> str | None:
        try:
            return json.dumps(values(t or ""), ensure_ascii=False)
        except yaml.YAMLError:
            return None

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["page_ref"], b["text"], pa.array(map(of, b["text"].to_pylist()), pa.string())], names=["page_ref", "text", "json"])

    return pages.select("page_ref", "text").mapInArrow(run, "page_ref string, text string, json string")
