"""Markdown links: found with offsets outside code blocks, and spliced in place.

What needs offsets into a text can't be said with column functions; everything
else about links (resolving, encoding, joining) is in ``columns``.
"""

from __future__ import annotations

import posixpath
import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from .columns import ENCODED

LINK = StructType([StructField(n, t) for n, t in (("start", IntegerType()), ("end", IntegerType()), ("dest", StringType()), ("path", StringType()), ("anchor", StringType()), ("is_image", BooleanType()), ("line", IntegerType()))])
_DEPTH = 4
_TITLE = re.compile(r"""[ \t]+(?:"[^"]*"|'[^']*'|\([^)]*\))""")
_ESCAPE = re.compile(r"%([0-9a-fA-F]{2})")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")


class Link(NamedTuple):
    start: int
    end: int
    dest: str
    path: str
    anchor: str
    is_image: bool
    line: int


def percent_decode(text: str) -> str:
    """S-03: each valid escape becomes the character of that code; others stay."""
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)


def percent_encode(text: str) -> str:
    return "".join(ENCODED.get(c, c) for c in text)


def split_dest(dest: str) -> tuple[str, str]:
    """P-06: path and anchor, split before they are decoded."""
    path, _, anchor = dest.partition("#")
    return percent_decode(path), percent_decode(anchor)


def code_lines(text: str) -> set[int]:
    """Numbers of the lines in fenced or indented code.

    Indented lines are code where no paragraph is open: after a blank line, a
    heading, a fence, other code, or at the start."""
    found, fence, paragraph = set(), None, False
    for n, line in enumerate(text.split("\n")):
        mark = _FENCE.match(line)
        if fence:
            found.add(n)
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line[mark.end() :].strip():
                fence = None
        elif mark and not (mark[1][0] == "`" and "`" in line[mark.end() :]):
            found.add(n)
            fence, paragraph = mark[1], False
        elif not line.strip():
            paragraph = False
        elif not paragraph and (line.startswith("\t") or re.match(r" {0,3}\t| {4}", line)):
            found.add(n)
        else:
            paragraph = not re.match(r" {0,3}#{1,6}(\s|$)", line)
    return found


def _label_end(text: str, at: int) -> int:
    """The place of the bracket that closes the label opened at ``at``, -1 if none; a
    label may hold brackets one level deep."""
    k = at + 1
    while k < len(text):
        if text[k] == "]":
            return k
        if text[k] == "[":
            inner = re.compile(r"[^\[\]]*\]").match(text, k + 1)
            if not inner:
                return -1
            k = inner.end()
        else:
            k += 1
    return -1


def _bare_end(text: str, at: int, depth: int) -> int:
    """Where a destination without angle brackets ends: at white space or at a
    parenthesis that is not balanced within ``depth`` levels."""
    while at < len(text) and not text[at].isspace() and text[at] != ")":
        if text[at] == "(":
            inner = _bare_end(text, at + 1, depth - 1) if depth else at
            if not depth or inner >= len(text) or text[inner] != ")":
                return at
            at = inner
        at += 1
    return at


def _closed(text: str, at: int) -> int:
    """The end of a link whose destination ends at ``at``, title allowed; -1 if it isn't closed."""
    for begin in ([m.end()] if (m := _TITLE.match(text, at)) else []) + [at]:
        k = begin
        while k < len(text) and text[k] in " \t":
            k += 1
        if k < len(text) and text[k] == ")":
            return k + 1
    return -1


def scan_links(text: str) -> list[Link]:
    """P-05: every inline link and image, in order, those in code left out."""
    found, at = [], 0
    code = code_lines(text) if "[" in text else set()
    line, counted = 0, 0
    while (at := text.find("[", at)) >= 0:
        close = _label_end(text, at)
        if close < 0 or text[close + 1 : close + 2] != "(":
            at += 1
            continue
        k = close + 2
        while k < len(text) and text[k] in " \t":
            k += 1
        tries = []
        if angle := re.compile(r"<[^<>\n]*>").match(text, k):
            tries.append((k + 1, angle.end() - 1, angle.end()))
        bare = _bare_end(text, k, _DEPTH)
        tries.append((k, bare, bare))
        for start, end, after in tries:
            if (stop := _closed(text, after)) >= 0:
                line += text.count("\n", counted, start)
                counted = start
                if line not in code:
                    path, anchor = split_dest(text[start:end])
                    found.append(Link(start, end, text[start:end], path, anchor, text[at - 1 : at] == "!" and at > 0, line))
                at = stop
                break
        else:
            at += 1
    return found


def is_relative(path: str) -> bool:
    return path != "" and not path.startswith(("/", "#")) and "://" not in path


def resolved(path: str, folder: str) -> str:
    """P-08 for one path; a closing slash stays."""
    out = posixpath.normpath(posixpath.join(folder or ".", path.lstrip("/")))
    return out + "/" if path.endswith("/") and not out.endswith("/") else out


def relative(target: str, folder: str) -> str:
    """S-05 for one path, without regard to any working folder."""
    parts = lambda p: [x for x in posixpath.normpath(p).split("/") if x not in ("", ".")]
    t, b = parts(target), parts(folder)
    same = 0
    while same < min(len(t), len(b)) and t[same] == b[same]:
        same += 1
    return "/".join([".."] * (len(b) - same) + t[same:]) or "."


def spliced(text: str, edits: list[tuple[int, int, str]]) -> str:
    """The text with stretches replaced; all else stays byte for byte."""
    out, at = [], 0
    for start, end, new in sorted(edits):
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


def _encoded(path: str, anchor: str) -> str:
    return percent_encode(path) + (f"#{percent_encode(anchor)}" if anchor else "")


def normalized_links(text: str) -> str:
    """S-06: relative destinations encoded anew; doing it twice changes nothing."""
    edits = [(x.start, x.end, _encoded(x.path, x.anchor)) for x in scan_links(text) if is_relative(x.path)]
    return spliced(text, [e for e in edits if text[e[0] : e[1]] != e[2]])


def retargeted(text: str, page: str, old: str, new: str) -> str:
    """G-11 for one page: links to ``old`` follow it to ``new``; if the page itself moves,
    all its relative links are rebased."""
    moves = page == old
    here = posixpath.dirname(page)
    there = posixpath.dirname(new) if moves else here
    edits = []
    for x in scan_links(text):
        if is_relative(x.path):
            target = resolved(x.path, here)
            if moves or target == old:
                edits.append((x.start, x.end, _encoded(relative(new if target == old else target, there), x.anchor)))
    return spliced(text, [e for e in edits if text[e[0] : e[1]] != e[2]])


@F.pandas_udf(ArrayType(LINK))
def links_of(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [x._asdict() for x in scan_links(t or "")])


@F.pandas_udf(StringType())
def normalize_links(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else normalized_links(t))


@F.pandas_udf(StringType())
def decoded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else percent_decode(t))


def move(pages: DataFrame, old: str, new: str) -> DataFrame:
    """G-11 to G-13: (page_ref, text) after the move; only pages whose text has the moved
    file's name, or that move, are scanned.  A taken destination is an error."""
    if pages.where(F.col("page_ref") == new).take(1):
        raise ValueError(f"there is a page already: {new}")
    if old.startswith("wiki/") and not pages.where(F.col("page_ref") == old).take(1):
        raise ValueError(f"no such page: {old}")
    name = posixpath.basename(old)
    touched = (F.col("page_ref") == old) | F.col("text").contains(name) | F.col("text").contains(percent_encode(name)) | F.col("text").contains("%")

    @F.pandas_udf(StringType())
    def moved(page: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([retargeted(t, p, old, new) for p, t in zip(page, text, strict=True)], dtype=object)

    text: Column = F.when(touched, moved("page_ref", "text")).otherwise(F.col("text"))
    return pages.select(F.when(F.col("page_ref") == old, new).otherwise(F.col("page_ref")).alias("page_ref"), text.alias("text"))
