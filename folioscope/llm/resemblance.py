"""Near copies by the share of five-word shingles, for the pipeline.

Texts are alike when their sets of shingles have a Jaccard similarity of ``ALIKE`` or
more.  Candidates share a key, of ``ROWS`` min-hashes; of ``BANDS`` keys, texts as
alike as that miss all with a chance of 7 in a million.  Every candidate is verified
on the whole sets.  Equal sets are one class, so copies cost one row.

First each class is compared with one class of each of its keys, so a large group
costs rows in proportion to it.  Where this left a key's classes apart, an exact filter
takes over: shingles are ordered from rare to common among these classes, and the first
one that two alike sets share stands so early in both that what follows suffices for the
similarity.  From a shingle's place follows the largest set it may share with, so classes
meet by shingle and size, and only where they are not yet connected.  No pair that shares a
key is lost, and copies that differ too much from their common text meet nobody by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, release
from .simhash import _UPPER, _WORDS, components, fingerprint

SHINGLE = 5
ALIKE = (4, 5)  # 0.8, as whole numbers
BANDS = 30
ROWS = 5
#: Ratio of the sizes of sets that are looked up together.
STEP = 1.02
#: Bits of the sieve, 8 MB.
SIEVE = 1 << 26
_RNG = np.random.default_rng(11)
_XOR, _TIMES = (_RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_MIX = _RNG.integers(0, 2**63, (BANDS, ROWS + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def grams(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; a text with fewer words is one."""
    words = _WORDS.findall((text or "").translate(_UPPER))
    if not words:
        return np.zeros(0, np.uint64)
    each = map(" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False)) if len(words) > SHINGLE else [" ".join(words)]
    return np.unique(np.array([xxhash.xxh64_intdigest(g.encode("utf-8", "surrogatepass"), 42) for g in each], np.uint64))


def least(h: np.ndarray) -> np.ndarray:
    """The min-hashes of a set, none of an empty one."""
    if not len(h):
        return np.zeros(0, np.uint64)
    return np.min([((h[k : k + 1000, None] ^ _XOR) * _TIMES).min(0) for k in range(0, len(h), 1000)], axis=0)


def keys(m: np.ndarray) -> np.ndarray:
    """One key a band of min-hashes."""
    if not len(m):
        return np.zeros(0, np.int64)
    return ((m.reshape(BANDS, ROWS) * _MIX[:, :ROWS]).sum(1, dtype=np.uint64) ^ _MIX[:, ROWS]).view(np.int64)


def sketches(docs: DataFrame, shingle: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, th, fp, sh, n, keys): simhash.fingerprints with a hash of the set of
    shingles, its size and its keys."""

    def make():
        def of(batch):
            cols: dict = {"fp": [], "sh": [], "n": [], "keys": []}
            for t in batch["text"].to_pylist():
                h = grams(t)
                cols["fp"].append(fingerprint(t, shingle))
                cols["sh"].append(xxhash.xxh64_intdigest(h.tobytes(), 7))
                cols["n"].append(len(h))
                cols["keys"].append(keys(least(h)))
            return {c: batch[c] for c in ("doc_id", "th")} | cols | {c: np.array(cols[c], np.uint64).view(np.int64) for c in ("fp", "sh")}

        return of

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    return map_batches(rows, make, f"doc_id {docs.schema[key].dataType.simpleString()}, th long, fp long, sh long, n int, keys array<long>")


def _sieve(hashes: DataFrame) -> np.ndarray:
    """SIEVE bits, set for each of the hashes (h): of fixed size whatever their number,
    so it may be sent to every task; a bit that another hash set only costs work."""
    bit = hashes.select(F.pmod("h", F.lit(SIEVE)).alias("b"))
    word = bit.groupBy(F.shiftright("b", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 AS int))")).alias("bits")).toPandas()
    out = np.zeros(SIEVE // 64, np.int64)
    out[word["at"].to_numpy(np.int64)] = word["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _sets(docs: DataFrame, classes: DataFrame, text: str, key: str) -> DataFrame:
    """(sh, grams) of the classes (sh, one), from one text of each.

    Texts don't move: a sieve tells where they are read which may be asked for, and their
    grams meet the classes, by row, exactly."""
    asked = cut(classes.select("sh", "one.*"))
    rows = docs.select(F.col(key).alias("i"), F.col(text).alias("text"), F.xxhash64(text).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("i", "t"))
    sieve = docs.sparkSession.sparkContext.broadcast(_sieve(asked.select(F.xxhash64("doc_id", "th").alias("h"))))

    def make():
        bits = sieve.value

        def of(batch):
            b = batch["h"].to_numpy() % SIEVE
            at = pa.array(np.flatnonzero(bits[b >> 6] >> (b & 63).astype(np.uint64) & np.uint64(1)))
            return {c: batch[c].take(at) for c in ("i", "t")} | {"grams": [grams(t).view(np.int64) for t in batch["text"].take(at).to_pylist()]}

        return of

    found = map_batches(rows, make, f"i {docs.schema[key].dataType.simpleString()}, t long, grams array<long>")
    met = found.join(asked, found["i"].eqNullSafe(asked["doc_id"]) & (found["t"] == asked["th"]))
    return cut(met.select("sh", "grams").dropDuplicates(["sh"]))


def _verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` that are alike."""
    met = pairs.join(sets.select(F.col("sh").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("sh").alias("b"), F.col("grams").alias("gb")), "b")
    both, (num, den) = F.size(F.array_intersect("ga", "gb")), ALIKE
    return cut(met.withColumn("both", both).where(f"both * {den} >= (size(ga) + size(gb) - both) * {num}").select("a", "b"))


def _filed(sets: DataFrame) -> DataFrame:
    """(sh, r, n, g, low, high): the shingles by which each of the sets (sh, grams, r) can be
    alike to another one of them, and the sizes of sets that it can be alike to by it.

    Alike sets of m and n shingles share num / (num + den) of m + n at least, and no more
    than stand in either from their first common shingle on.  A shingle of one set alone
    comes before all others and is only counted."""
    num, den = ALIKE
    each = sets.select("sh", F.explode("grams").alias("g"))
    held = each.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    shared = each.join(held, "g").groupBy("sh").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("shared"))
    rows = sets.select("sh", "r", F.size("grams").alias("n")).join(shared, "sh").withColumn("alone", F.expr("n - size(shared)"))
    # What is left from the last place on is num / den of the set.
    early = F.expr(f"slice(shared, 1, greatest(0, n - cast(ceil(n * {num} / {den}) AS int) + 1 - alone))")
    rows = rows.select("sh", "r", "n", "alone", F.posexplode(early).alias("at", "s"))
    rows = rows.select("sh", "r", "n", F.col("s.g").alias("g"), F.expr(f"cast(ceil(n * {num} / {den}) AS int)").alias("low"), F.expr(f"cast((n - alone - at) * {num + den} div {num} - n AS int)").alias("high"))
    rows = cut(rows.where("high >= low"))
    release(rows.sparkSession)
    return rows


def _apart(sets: DataFrame) -> DataFrame:
    """(a, b): pairs of the sets (sh, grams, r) of different r that may be alike, all that are."""
    filed = _filed(sets)
    # The root that most holders of a shingle have: its classes don't ask, they are met.
    roots = filed.groupBy("g", "r").agg(F.count("*").alias("many")).groupBy("g").agg(F.max(F.struct("many", "r")).alias("top"), F.count("*").alias("roots"))
    filed = cut(filed.join(roots.where("roots > 1").select("g", F.col("top.r").alias("top")), "g"))
    step = lambda n: f"cast(floor(ln({n}) / ln({STEP})) AS int)"
    asked = filed.where("r <> top").select("g", F.col("sh").alias("x"), F.col("n").alias("xn"), F.col("r").alias("xr"), F.col("low").alias("xlow"), F.col("high").alias("xhigh"), F.explode(F.expr(f"sequence({step('low')}, {step('high')})")).alias("step"))
    met = asked.join(filed.withColumn("step", F.expr(step("n"))), ["g", "step"]).where("r <> xr AND n BETWEEN xlow AND xhigh AND xn BETWEEN low AND high AND (r = top OR x < sh)")
    return met.select(F.least("x", "sh").alias("a"), F.greatest("x", "sh").alias("b")).distinct()


def links(docs: DataFrame, prints: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(a, b): fingerprints of ``prints`` (from sketches) that belong together, as texts
    with them are alike."""
    classes = cut(prints.groupBy("sh").agg(F.min("fp").alias("f"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.min(F.struct("doc_id", "th")).alias("one")))
    filed = classes.select("sh", "n", F.explode("keys").alias("key"))
    many = filed.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    filed = cut(filed.join(many, "key"))
    # The class that stands for a key is the one that meets most others over all its keys: of
    # copies of one text that differ from each other this is the text itself.
    weight = filed.groupBy("sh").agg(F.sum("many").alias("weight"))
    heads = filed.join(weight, "sh").groupBy("key").agg(F.max(F.struct("weight", F.xxhash64("sh").alias("o"), "sh", "n")).alias("head"))
    heads = cut(heads.select("key", F.col("head.sh").alias("head"), F.col("head.n").alias("hn")))
    num, den = ALIKE
    # Sets whose sizes differ too much cannot be alike.
    near = lambda x, y: f"least({x}, {y}) * {den} >= greatest({x}, {y}) * {num}"
    filed = cut(filed.drop("many").join(heads, "key"))
    first = cut(filed.where(f"sh <> head AND {near('n', 'hn')}").select(F.least("sh", "head").alias("a"), F.greatest("sh", "head").alias("b")).distinct())
    release(docs.sparkSession)
    sets = _sets(docs, classes.join(filed.select("sh").distinct(), "sh", "left_semi"), text, key)
    alike = _verified(sets, first)
    release(docs.sparkSession)
    # What the first round left apart from its key's head meets the others of such keys.
    roots = components(alike)
    filed = filed.join(roots.withColumnsRenamed({"node": "sh", "root": "r"}), "sh", "left").join(roots.select(F.col("node").alias("head"), F.col("root").alias("hr")), "head", "left")
    filed = cut(filed.select("key", "sh", F.coalesce("r", "sh").alias("r"), F.coalesce("hr", "head").alias("hr")))
    release(docs.sparkSession)
    left = filed.join(filed.where("r <> hr").select("key").distinct(), "key", "left_semi").select("sh", "r").distinct()
    rest = _apart(cut(sets.join(left, "sh"))).join(first, ["a", "b"], "left_anti")
    rest = cut(rest)
    release(docs.sparkSession)
    alike = alike.union(_verified(sets, rest))
    f = classes.select("sh", "f")
    named = alike.join(f.withColumnsRenamed({"sh": "a", "f": "fa"}), "a").join(f.withColumnsRenamed({"sh": "b", "f": "fb"}), "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    # Equal sets may have several fingerprints, as these count repeated shingles.
    equal = prints.select("fp", "sh").distinct().join(f, "sh").where("fp <> f").select(F.col("fp").alias("a"), F.col("f").alias("b"))
    return named.union(equal).where("a <> b").distinct()
