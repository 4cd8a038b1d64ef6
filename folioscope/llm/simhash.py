"""Operator 6: near copies by SimHash and Golay-code keys.

A text's fingerprint has a bit set where over half of its shingles' hashes have
it.  Texts link when their fingerprints differ in few bits; groups are connected
components.  Equal fingerprints are one class, so copies cost one row.

Candidates.  The 64 bits are three segments of 22, 21 and 21 bits, taken as words
of the perfect Golay code (23, 12, 7), each of which lies within three bits of one
codeword.  A segment is filed under its codeword's index and looked up under the
indices of all words within one bit of it, of which there are one or six: so two
segments that differ in one bit at most always meet.  Of three or fewer differing
bits in three segments, either one segment has none and another has one at most,
or each has exactly one.  The first case is met by the whole of a segment with
the index of another (six choices); the second by the index of the first segment
with an unchanged half of each of the two others (four choices).  What meets is
verified on all 64 bits inside the join, so only true links leave it; a
fingerprint has no more of these than there are words within three bits of it.

Groups.  Alternating large-star and small-star steps on (node, node) rows, each
written to the shared folder, until no row changes.

Defined results: a null or word-less text has fingerprint zero, linked like any
other; a text with fewer words than a shingle is one shingle; rows with a null
``doc_id`` get their group's smallest non-null id (null if it has none); equal
rows stay, each with its group; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Names, cut, map_batches, release

_WORDS = re.compile(WORD)
#: Fixed value: the generator polynomial of the Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
_GENERATOR = 0b110001110101
#: Bits of the three segments, lowest first.
SEGMENTS = (22, 21, 21)
MAX_BITS = 3
_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of one text, unsigned."""
    words = _WORDS.findall((text or "").translate(_UPPER))
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [" ".join(words)]
    else:
        grams = list(map(" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)))
    h = np.fromiter((xxhash.xxh64_intdigest(g.encode("utf-8", "surrogatepass"), 42) for g in grams), np.uint64, len(grams))
    ones = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view("<u8")[0])


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables by byte of a word for its syndrome; by syndrome the error of weight
    three or less; by syndrome the errors to the codewords of words one bit away."""

    def syndrome(word: int) -> int:
        for b in range(22, 10, -1):
            if word >> b & 1:
                word ^= _GENERATOR << (b - 11)
        return word

    single = [syndrome(1 << b) for b in range(23)]
    by_byte = np.zeros((3, 256), np.int64)
    for k in range(3):
        for v in range(256):
            for b in range(8):
                if v >> b & 1 and 8 * k + b < 23:
                    by_byte[k, v] ^= single[8 * k + b]
    nearest = np.zeros(2048, np.int64)
    for i in range(23):
        nearest[single[i]] = 1 << i
        for j in range(i):
            nearest[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                nearest[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    around = np.full((2048, 6), -1, np.int64)
    for s in range(2048):
        errors = sorted({int(nearest[s])} | {int(nearest[s ^ single[b]]) ^ (1 << b) for b in range(23)})
        around[s, : len(errors)] = errors
    return by_byte, nearest, around


def _index(segment: np.ndarray) -> np.ndarray:
    """The codeword index of each segment: the twelve information bits of its codeword."""
    by_byte, nearest, _ = _golay()
    s = by_byte[0, segment & 255] ^ by_byte[1, segment >> 8 & 255] ^ by_byte[2, segment >> 16]
    return (segment ^ nearest[s]) >> 11


def _indices(segment: np.ndarray) -> np.ndarray:
    """The indices that words within one bit of each segment have: six columns, -1 for none."""
    by_byte, _, around = _golay()
    s = by_byte[0, segment & 255] ^ by_byte[1, segment >> 8 & 255] ^ by_byte[2, segment >> 16]
    errors = around[s]
    return np.where(errors < 0, -1, (segment[:, None] ^ errors) >> 11)


def keys(prints: np.ndarray, looked_up: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs of fingerprints as filed or as looked up.

    A key holds the number of its table, the whole or half segments, and an index."""
    x = prints.astype(np.uint64)
    parts, at = [], 0
    for bits in SEGMENTS:
        parts.append((x >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64))
        at += bits
    index = [_indices(p) if looked_up else _index(p)[:, None] for p in parts]
    halves = [(p & 2047, p >> 11) for p in parts]
    rows, out, table = [], [], 0

    def add(exact: np.ndarray, indices: np.ndarray):
        nonlocal table
        r, c = np.nonzero(indices >= 0)
        rows.append(r)
        out.append(np.int64(table) << 50 | exact[r] << 12 | indices[r, c])
        table += 1

    for a in range(3):
        for b in range(3):
            if a != b:
                add(parts[a], index[b])
    for one in halves[1]:
        for two in halves[2]:
            add(one << 11 | two, index[0])
    return np.concatenate(rows), np.concatenate(out)


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, th, fp): the fingerprint of every whole text, as a signed 64-bit
    number, and a hash of the text as it is."""

    def make():
        def of(batch):
            fp = np.array([fingerprint(t, shingle) for t in batch["text"].to_pylist()], np.uint64)
            return {"doc_id": batch["doc_id"], "th": batch["th"], "fp": fp.view(np.int64)}

        return of

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    return map_batches(rows, make, f"doc_id {docs.schema[key].dataType.simpleString()}, th long, fp long")


def links(prints: DataFrame) -> DataFrame:
    """(a, b): pairs of different fingerprints of ``prints`` (fp, each once) that link."""

    def keyed(looked_up: bool):
        def make():
            def of(batch):
                fp = batch["fp"].to_numpy()
                out = []
                for k in range(0, len(fp), 2000):
                    r, found = keys(fp[k : k + 2000].view(np.uint64), looked_up)
                    out.append({"key": found, "fp": fp[k : k + 2000][r]})
                return out

            return of

        return map_batches(prints.select("fp"), make, "key long, fp long")

    filed, asked = keyed(False).withColumnRenamed("fp", "b"), keyed(True).withColumnRenamed("fp", "a")
    near = F.expr(f"a <> b AND bit_count(a ^ b) <= {MAX_BITS}")
    met = asked.join(filed, (asked["key"] == filed["key"]) & near)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of the (a, b) rows with its component's smallest node."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        # Large star: each node's larger neighbours move to its smallest one.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each node and its smaller neighbours move to the smallest.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = cut(small.distinct())
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    """What tells one set of rows from another: their number and the sum of their hashes."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def near_copies(docs: DataFrame, shingle: int = 3, text: str = "text", key: str = "doc_id", alike: bool = False) -> DataFrame:
    """(doc_id, th, fp, component_id) of every row; with ``alike`` texts that share
    most five-word shingles link too, as in ``resemblance``."""
    from . import resemblance  # which imports this module

    prints = cut(resemblance.sketches(docs, shingle, text, key) if alike else fingerprints(docs, shingle, text, key))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    near = links(classes)
    if alike:
        near = cut(near.union(resemblance.links(docs, prints, text, key)))
        release(docs.sparkSession)
    found = components(near)
    # Fingerprints without a link are components of their own.
    rooted = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id", "root")
    return prints.join(named, "fp").select("doc_id", "th", "fp", "component_id", "root")


def keep_one(docs: DataFrame, shingle: int = 3, text: str = "text", key: str = "doc_id", alike: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest id (a row
    without id only where none has one); of several rows with that id the one whose text
    has the smaller hash; of rows equal in both the one whose other columns have it."""
    found = near_copies(docs, shingle, text, key, alike)
    each = found.groupBy("root", "doc_id", "th").agg(F.count("*").alias("n"))
    n = Names(docs.columns)
    stay = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th", "n")).alias("s"))
    stay = cut(stay.select(F.col("s.doc_id").alias(n.id), F.col("s.th").alias(n.hash), F.col("s.n").alias(n.rows)))
    hashed = docs.withColumn(n.text_hash, F.xxhash64(text))
    kept = hashed.join(stay, F.col(key).eqNullSafe(F.col(n.id)) & (F.col(n.text_hash) == F.col(n.hash)), "left_semi")
    if stay.where(F.col(n.rows) > 1).take(1):
        told = F.xxhash64(F.to_json(F.struct(*docs.columns)))
        kept = kept.withColumn(n.rank, F.row_number().over(Window.partitionBy(key, n.text_hash).orderBy(told))).where(F.col(n.rank) == 1)
    return kept.select(*docs.columns)
