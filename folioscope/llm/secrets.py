"""Operator 5: secrets, and weak parts that only together are one.

Strong spans, assignments of secrets, access ids and long hex strings, stand by
themselves.  Weak parts, names of accounts, mixed-character strings and endpoints,
mean nothing alone; one is reported where a part of a complementary role starts
within ``reach`` characters in the same scope, a stretch of text between blank
lines.  The parts meet in an interval join: places are dealt to buckets of
``reach`` characters, the least and greatest place of each role and bucket are
gathered, and each weak part looks into its own bucket and the two beside it.  So
a scope with many parts gives rows in proportion to them, not to their pairs.

Defined results: a null text counts as empty and has no spans; equal rows each
have their spans; null ids are kept; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Names, cut, map_batches

REACH = 200
#: The strong kinds in the order of the result, their patterns and least lengths.
STRONG = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: The weak kinds, after the strong ones.
WEAK = ("account", "mixed", "endpoint")
_ACCOUNT = re.compile(r"""(?ai:\b(?:user|user_?name|login|account|client_?id|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})|\bAKIA[A-Z0-9]{8,15}(?![A-Z0-9])""")
#: Stretches that hold all hex spans and all mixed ones.
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_MIXED = re.compile(r"(?=[^0-9]*[0-9])(?=[^a-z]*[a-z])[^A-Z]*[A-Z]")
_ENDPOINT = re.compile(r"""\b(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\s"'<>]{3,}|(?ai:\b(?:host|endpoint|server))["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}""")
_BLANK = re.compile(r"\n[ \t\r]*\n")
#: Role of each kind, and the roles that complete a weak one.
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "account": "id", "mixed": "secret", "endpoint": "place"}
COMPLEMENTS = {"account": ("secret",), "mixed": ("id", "place"), "endpoint": ("secret",)}
SPAN = "struct<start: long, rank: int, end: long, kind: string>"
PART = "struct<scope: long, start: long, rank: int, end: long, kind: string>"


#: Small letters without which a pattern has no match; searching for them is faster.
_HINTS = {"assign": ("passw", "secret", "token", "api"), "account": ("user", "login", "account", "client", "access", "akia"), "endpoint": ("://", "host", "endpoint", "server")}


def _hinted(kind: str, lowered: str) -> bool:
    return any(h in lowered for h in _HINTS[kind])


def spans(text: str) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, int, int, str]]]:
    """(start, rank, end, kind) of the strong spans, in the order of the result, and of
    the weak parts that lie in no strong span."""
    lowered = text.lower()
    runs = list(_RUN.finditer(text))
    strong = [(m.start(), 0, m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if _hinted("assign", lowered) else []
    strong += [(m.start(), 1, m.end(), "access") for m in _ACCESS.finditer(text)]
    # What stands before a run is no hex digit, as it would be of the run.
    strong += [(m.start(), 2, m.end(), "hex") for r in runs for m in _HEX.finditer(text, r.start(), r.end())]
    strong.sort()
    weak = [(m.start(), 3, m.end(), "account") for m in _ACCOUNT.finditer(text)] if _hinted("account", lowered) else []
    weak += [(r.start(), 4, r.end(), "mixed") for r in runs if _MIXED.match(r[0])]
    weak += [(m.start(), 5, m.end(), "endpoint") for m in _ENDPOINT.finditer(text)] if _hinted("endpoint", lowered) else []
    out, at = [], 0
    for s in sorted(weak):
        while at < len(strong) and strong[at][2] <= s[0]:
            at += 1
        if not any(t[0] < s[2] and s[0] < t[2] for t in strong[at : at + 3]):
            out.append(s)
    return strong, out


def parts(text: str, strong: list[tuple[int, int, int, str]], weak: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, int, str]]:
    """(scope, start, rank, end, kind) of all spans of a text; none where nothing can be completed."""
    if not weak or len(strong) + len(weak) < 2:
        return []
    breaks, out, scope = [m.start() for m in _BLANK.finditer(text)], [], 0
    for s in sorted(strong + weak):
        while scope < len(breaks) and breaks[scope] < s[0]:
            scope += 1
        out.append((scope, *s))
    return out


def _joined(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)


def _structs(rows: list[list[tuple]], names: tuple[str, ...]) -> list[list[dict]]:
    return [[dict(zip(names, s, strict=True)) for s in x] for x in rows]


_SPAN, _PART = ("start", "rank", "end", "kind"), ("scope", "start", "rank", "end", "kind")


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, base, parts) of each row."""

    def make():
        def of(batch):
            cols = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "base", "parts")}
            for t in batch["text"].to_pylist():
                base, weak = spans(t)
                kinds = [s[3] for s in base]
                for c, v in zip(cols, (*(kinds.count(k) for k in STRONG), hashlib.sha256(_joined(base).encode()).hexdigest(), base, parts(t, base, weak)), strict=True):
                    cols[c].append(v)
            return {"doc_id": batch["doc_id"]} | cols | {"base": _structs(cols["base"], _SPAN), "parts": _structs(cols["parts"], _PART)}

        return of

    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    return map_batches(rows, make, f"doc_id {docs.schema[key].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, base array<{SPAN}>, parts array<{PART}>")


def linked(scanned: DataFrame, reach: int = REACH, row: str = "row", of: str = "parts") -> DataFrame:
    """(row, added): of each row with any, the weak spans that are completed."""
    parts = scanned.where(F.size(of) > 1).select(F.col(row).alias("row"), F.explode(of).alias("p")).select("row", "p.*")
    role = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    parts = parts.withColumns({"role": role[F.col("kind")], "bucket": F.floor(F.col("start") / reach)})
    there = parts.groupBy("row", "scope", "role", "bucket").agg(F.min("start").alias("least"), F.max("start").alias("most"))
    wanted = F.create_map(*[x for k, v in COMPLEMENTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    weak = parts.where(F.col("kind").isin(*WEAK)).withColumn("role", F.explode(wanted[F.col("kind")])).withColumn("bucket", F.explode(F.expr("array(bucket - 1, bucket, bucket + 1)")))
    met = weak.join(there, ["row", "scope", "role", "bucket"]).where((F.col("most") >= F.col("start") - reach) & (F.col("least") <= F.col("start") + reach))
    return met.groupBy("row").agg(F.array_sort(F.collect_set(F.struct(*_SPAN))).alias("added"))


def find(docs: DataFrame, text: str = "text", key: str = "doc_id", reach: int = REACH) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans_all) of each row."""
    # Written with the rows' numbers, which name them from here on.
    scanned = cut(scan(docs, text, key).withColumn("row", F.monotonically_increasing_id()))
    both = scanned.join(linked(scanned, reach), "row", "left")
    return both.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", _all("base", "added").alias("spans_all"))


def _all(base: str, added: str) -> Column:
    return F.array_sort(F.concat(base, F.coalesce(added, F.array().cast(f"array<{SPAN}>"))))


def redact(docs: DataFrame, text: str = "text", key: str = "doc_id", reach: int = REACH) -> DataFrame:
    """The rows with each span of the text replaced by its kind in brackets; spans that
    overlap are replaced as one, by the kind of the first.

    Texts without two parts that might complete each other are redacted where they are
    read, and never move.  The others are written once and meet their completed parts."""
    columns, n = docs.columns, Names(docs.columns)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def split(open_ones: bool):
        def make():
            def of(batch):
                told = [(t, *spans(t or "")) for t in batch[text].to_pylist()]
                linkable = [parts(t or "", *s) for t, *s in told]
                at = [k for k, p in enumerate(linkable) if bool(p) == open_ones]
                cols = {c: batch[c].take(pa.array(at, pa.int64())) for c in columns}
                if open_ones:
                    return cols | {n.base: _structs([told[k][1] for k in at], _SPAN), n.parts: _structs([linkable[k] for k in at], _PART)}
                return cols | {text: [replaced(told[k][0], told[k][1]) for k in at]}

            return of

        return make

    closed = map_batches(docs, split(False), schema)
    waiting = map_batches(docs, split(True), f"{schema}, `{n.base}` array<{SPAN}>, `{n.parts}` array<{PART}>")
    waiting = cut(waiting.withColumn(n.row, F.monotonically_increasing_id()))
    added = linked(waiting, reach, n.row, n.parts).withColumnsRenamed({"row": n.linked_row, "added": n.added})
    met = waiting.join(added, F.col(n.row) == F.col(n.linked_row), "left")
    met = met.select(*columns, _all(n.base, n.added).alias(n.spans))

    def redacted():
        def of(batch):
            each = zip(batch[text].to_pylist(), batch[n.spans].to_pylist(), strict=True)
            return {c: batch[c] for c in columns} | {text: [replaced(t, [tuple(s[c] for c in _SPAN) for s in found]) for t, found in each]}

        return of

    return closed.unionByName(map_batches(met, redacted, schema))


def replaced(text: str | None, found: list[tuple[int, int, int, str]]) -> str | None:
    """The text with its spans, in order, replaced."""
    if not found:
        return text
    out, at = [], 0
    for start, _, end, kind in found:
        if start < at:
            at = max(at, end)
            continue
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])
