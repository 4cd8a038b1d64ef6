"""Operator 11: collocations, by multikey quicksort of routed suffixes.

A suffix is up to four words from a word on, within its piece of text; its first two
words route it to a bucket, so that all suffixes that begin alike meet.  There three-way
partitions by one word after the other sort pointers at them: the size of a partition of
equal words is how often these words stand in a row, and partitions of fewer than
``least`` are abandoned.

Before that the words alone are counted in the same way.  A sieve of the frequent ones
ends suffixes at a rare word, as no phrase of interest holds one.  Each batch of texts
sums up its equal suffixes, and sends one compressed block to each bucket.  Pairs of
words with more than a ``HOT``th of all suffixes, of which there are at most ``HOT``, are
routed by all their words; what is counted of their beginnings is then summed up.  So a
task holds a bucket at a time: ``ROUTED`` suffixes, or those of a pair that isn't hot.

Phrases, their parts and the longer ones they stand in then meet in joins.

Defined results: a null or word-less text adds nothing; a null lang is ``und``, and so
is one of that name; repeated rows count each time; rows without id count like others;
an empty table has no rows; other columns don't matter.  A batch of texts is worked on in
some 40 times its bytes.
"""

from __future__ import annotations

from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ARROW_SLICE, cut, map_batches
from .wordids import Splitter

LEAST, WORDS, TOP = 30, 4, 2000
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
#: A pair's share of all suffixes from which it is routed by all words.
HOT = 4096
#: Suffixes a bucket is meant to have, and buckets for each task that sorts.
ROUTED, BUCKETS = 400_000, 4
#: Bits of the sieve for each frequent word, and the most it may have: 16 MB.
BITS, SIEVE = 16, 1 << 27
#: Pointers below which partitions are sorted all together.
FEW = 2048
_ROWS = "bucket int, lines binary, counts binary"
_FOUND = "lang string, phrase string, words int, f long, h long"


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def _mixed(h: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """One hash of several, in their order."""
    with np.errstate(over="ignore"):
        for m in more:
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + m
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _token(lang: str) -> str:
    """A lang as a word of a line."""
    return "=" + quote(lang, safe="")


class _Texts:
    """A batch's words with their hashes, and a word for each text's lang."""

    def __init__(self, split: Splitter, batch: pa.RecordBatch):
        w = split(batch["text"])
        langs = batch["lang"].cast(pa.string()).fill_null("und").dictionary_encode()
        self.langs = pa.array([_token(x) for x in langs.dictionary.to_pylist()], pa.string())
        self.ids, self.dictionary, self.piece = w.ids, w.dictionary, w.piece
        self.lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(w.ends))
        self.hash, self.of_lang = _hashes(w.dictionary), _hashes(self.langs)

    def blocks(self, bucket: np.ndarray, columns: list[np.ndarray], langs: pa.Array) -> dict:
        """A row for each bucket of equal (lang, word, ...) summed up: lines and counts.  Of
        the columns the first are langs, the others words, -1 for none."""
        base = len(self.dictionary) + 1
        keys = [columns[0] * base + columns[1] + 1]
        for a, b in zip(columns[2::2], [*columns[3::2], None], strict=False):
            keys.append((a + 1) * base + (b + 1 if b is not None else 0))
        order = np.lexsort((*keys[::-1], bucket))
        bucket, keys, columns = bucket[order], [k[order] for k in keys], [c[order] for c in columns]
        fresh = np.ones(len(order), bool)
        fresh[1:] = bucket[1:] != bucket[:-1]
        for k in keys:
            fresh[1:] |= k[1:] != k[:-1]
        first = np.flatnonzero(fresh)
        count = np.diff(np.r_[first, len(order)]).astype("<u4")
        taken = [langs.take(pa.array(columns[0][first]))]
        taken += [self.dictionary.take(pa.array(c[first], mask=c[first] < 0)) for c in columns[1:]]
        lines = pc.binary_join_element_wise(*taken, " ", null_handling="skip")
        lines = pc.binary_join_element_wise(lines, "", "\n").cast(pa.large_string())
        _, offsets, data = lines.buffers()
        offsets, data = np.frombuffer(offsets, np.int64)[lines.offset :], memoryview(data) if data is not None else memoryview(b"")
        bucket = bucket[first]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
        stops = np.r_[starts[1:], len(bucket)][: len(starts)]
        pack = zstandard.ZstdCompressor(level=1).compress
        return {
            "bucket": bucket[starts],
            "lines": [pack(data[offsets[a] : offsets[b]]) for a, b in zip(starts, stops, strict=True)],
            "counts": [pack(count[a:b].tobytes()) for a, b in zip(starts, stops, strict=True)],
        }


def _words_routed(lower: bool, buckets: int):
    """Each word by itself; and each batch's own hot pairs, under langs with another sign."""
    split = Splitter(b"\x20\x09", BREAKS, lower)

    def of(batch):
        t = _Texts(split, batch)
        h = _mixed(t.of_lang[t.lang], t.hash[t.ids])
        n, marks = len(t.langs), pa.array(["~" + x[1:] for x in t.langs.to_pylist()], pa.string())
        at = np.flatnonzero(t.piece[1:] == t.piece[:-1])
        slot = _mixed(h[at], t.hash[t.ids[at + 1]]) & np.uint64(0xFFFF)
        often = np.bincount(slot.astype(np.int64), minlength=1 << 16) * (2 * HOT) >= max(1, len(at))
        at = at[often[slot.astype(np.int64)]]
        pairs = _mixed(h[at], t.hash[t.ids[at + 1]])
        lang = np.r_[t.lang, t.lang[at] + n]
        second = np.r_[np.full(len(t.ids), -1), t.ids[at + 1]]
        bucket = (np.r_[h, pairs] % np.uint64(buckets)).astype(np.int64)
        return t.blocks(bucket, [lang, np.r_[t.ids, t.ids[at]], second], pa.concat_arrays([t.langs, marks]))

    return of


def _suffixes_routed(lower: bool, buckets: int, words: int, sieve: np.ndarray, hot: np.ndarray):
    """Each suffix of two words or more, as far as its words may be frequent."""
    split = Splitter(b"\x20\x09", BREAKS, lower)

    def of(batch):
        t = _Texts(split, batch)
        h = _mixed(t.of_lang[t.lang], t.hash[t.ids])
        bit = h & np.uint64(len(sieve) * 64 - 1)
        known = (sieve[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
        n = len(t.ids)
        goes_on = np.zeros(n, bool)
        goes_on[:-1] = known[:-1] & known[1:] & (t.piece[1:] == t.piece[:-1])
        at = np.flatnonzero(goes_on)
        columns, on = [t.lang[at], t.ids[at], t.ids[at + 1]], np.ones(len(at), bool)
        for k in range(2, words):
            on = on & goes_on[np.minimum(at + k - 1, n - 1)]
            columns.append(np.where(on, t.ids[np.minimum(at + k, n - 1)], -1))
        route = _mixed(h[at], t.hash[t.ids[at + 1]])
        spread = np.isin(route, hot)
        whole = route
        for c in columns[3:]:
            whole = np.where(c >= 0, _mixed(whole, t.hash[np.maximum(c, 0)]), whole)
        bucket = np.where(spread, buckets + (whole % np.uint64(buckets)).astype(np.int64), (route % np.uint64(buckets)).astype(np.int64))
        return t.blocks(bucket, columns, t.langs)

    return of


def multikey(columns: list[np.ndarray], weight: np.ndarray, least: list[int]) -> list[tuple[int, int, int]]:
    """(pointer, depth, total) of each partition of rows that are equal in the columns up to
    ``depth`` and weigh ``least[depth]`` or more: pointers, partitioned three ways by a
    pivot, the equal ones by the next column.  -1 is no value; what weighs less than
    any depth from there on asks for is abandoned."""
    found: list[tuple[int, int, int]] = []
    bound = [min(least[d:]) for d in range(len(columns))]
    few: list[list[np.ndarray]] = [[] for _ in columns]
    todo = [(np.flatnonzero(columns[0] >= 0), 0)]
    while todo:
        pointers, d = todo.pop()
        if weight[pointers].sum() < bound[d] or not len(pointers):
            continue
        if len(pointers) <= FEW:
            few[d].append(pointers)
            continue
        keys = columns[d][pointers]
        pivot = np.median(keys[:: max(1, len(keys) // 9)]).astype(keys.dtype)
        todo += [(pointers[keys < pivot], d), (pointers[keys > pivot], d)]
        equal = pointers[keys == pivot]
        total = int(weight[equal].sum())
        if len(equal) and total >= least[d]:
            found.append((int(equal[0]), d, total))
        if d + 1 < len(columns):
            todo.append((equal[columns[d + 1][equal] >= 0], d + 1))
    # Small partitions of a depth are sorted by one call, each by itself.
    open_, part = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for d, column in enumerate(columns):
        own = np.repeat(np.arange(len(few[d])) + (part.max(initial=-1) + 1), [len(p) for p in few[d]])
        open_, part = np.concatenate([open_, *few[d]]), np.r_[part, own]
        there = column[open_] >= 0
        open_, part = open_[there], part[there]
        if not len(open_):
            continue
        order = np.lexsort((column[open_], part))
        open_, part = open_[order], part[order]
        keys = column[open_]
        first = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (keys[1:] != keys[:-1])])
        total = np.add.reduceat(weight[open_], first)
        found += [(int(open_[f]), d, int(t)) for f, t in zip(first[total >= least[d]], total[total >= least[d]], strict=True)]
        size = np.diff(np.r_[first, len(open_)])
        on = np.repeat(total >= (bound[d + 1] if d + 1 < len(columns) else total.max() + 1), size)
        part = np.repeat(np.arange(len(first)), size)[on]
        open_ = open_[on]
    return found


def _sorted(least: int, words: int, buckets: int):
    """What a bucket's blocks have often enough; of words alone also the sums by lang."""
    split = Splitter(b" ", b"\n")

    def of(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        raw = np.frombuffer(b"".join(unpack(b) for b in table["lines"].to_pylist()), np.uint8)
        weight = np.frombuffer(b"".join(unpack(b) for b in table["counts"].to_pylist()), "<u4").astype(np.int64)
        w = split.split(raw, np.array([0, len(raw)]))
        first = np.searchsorted(w.piece, np.arange(len(weight) + 1))
        columns = []
        for d in range(words + 1):
            there = first[:-1] + d < first[1:]
            columns.append(np.where(there, w.ids[np.minimum(first[:-1] + d, len(w.ids) - 1)], -1))
        spread = int(table["bucket"][0].as_py()) >= buckets
        if words == 2:  # words, their sums, and pairs that may be hot
            asked = [1, least, 1]
        else:
            asked = [2**62, 2**62, *[1 if spread and d < words else least for d in range(2, words + 1)]]
        found = multikey(columns, weight, asked)
        of_word, hashed = w.dictionary, None
        if words == 2:
            hashed = _hashes(of_word)
        out: dict[str, list] = {"lang": [], "phrase": [], "words": [], "f": [], "h": []}
        names: dict[int, tuple[bool, str]] = {}
        for p, d, total in found:
            at = int(columns[0][p])
            if at not in names:
                token = of_word[at].as_py()
                names[at] = token[0] == "=", unquote(token[1:])
            plain, lang = names[at]
            if words == 2 and plain != (d < 2):
                continue
            ids = [int(columns[k][p]) for k in range(1, d + 1)]
            out["lang"].append(lang)
            out["phrase"].append(" ".join(of_word[i].as_py() for i in ids) if d else None)
            out["words"].append(d)
            out["f"].append(total)
            h = 0
            if hashed is not None and d:
                own = np.array([xxhash.xxh64_intdigest(_token(lang), 42)], np.uint64)
                h = int(_mixed(own, hashed[ids[:1]])[0]) if d == 1 else int(_mixed(_mixed(own, hashed[ids[:1]]), hashed[ids[1:]])[0])
            out["h"].append(h - (1 << 64) if h >= 1 << 63 else h)
        kinds = {"lang": pa.string(), "phrase": pa.string(), "words": pa.int32(), "f": pa.int64(), "h": pa.int64()}
        return pa.table({c: pa.array(out[c], kinds[c]) for c in kinds})

    return of


def _sieve(words: DataFrame, n: int) -> np.ndarray:
    """Bits by the hashes of the frequent words, of at most SIEVE bits whatever their number; a
    bit that another word set only costs work."""
    bits = min(SIEVE, max(1 << 12, 1 << (n * BITS).bit_length()))
    at = words.select(F.expr(f"h & {bits - 1}L").alias("b")).groupBy(F.shiftright("b", 6).alias("at"))
    rows = at.agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 AS int))")).alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def counted(docs: DataFrame, least: int = LEAST, words: int = WORDS, lower: bool = True, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of up to ``words`` words that stand ``least`` times
    or more in the texts of a lang, and (lang, n), the number of its words."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def mined(routed, buckets: int, depth: int) -> DataFrame:
        blocks = map_batches(rows, routed, _ROWS, ARROW_SLICE)
        return blocks.groupBy("bucket").applyInArrow(_sorted(least, depth, buckets), _FOUND)

    few = tasks * BUCKETS
    single = cut(mined(lambda: _words_routed(lower, few), few, 2))
    sums = cut(single.where("words = 0").groupBy("lang").agg(F.sum("f").alias("n")))
    total = sums.agg(F.sum("n")).first()[0] or 0
    frequent = single.where("words = 1")
    # Suffixes are fewer than words; at most HOT pairs have that share.
    pairs = single.where("words = 2").groupBy("lang", "phrase", "h").agg(F.sum("f").alias("f")).where(F.col("f") * HOT >= total)
    hot = np.array([r.h for r in pairs.select("h").collect()], np.int64).view(np.uint64)
    sieve = spark.sparkContext.broadcast(_sieve(frequent, frequent.count()))
    buckets = max(tasks * BUCKETS, -(-total // ROUTED))
    found = mined(lambda: _suffixes_routed(lower, buckets, words, sieve.value, hot), buckets, words)
    found = found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return cut(frequent.select("lang", "phrase", "words", "f").unionByName(found)), sums


def mine(docs: DataFrame, top: int = TOP, least: int = LEAST, words: int = WORDS, share: int = 80, **how) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's best phrases of two words or more.

    A phrase's score is that of its lowest-scoring cut in two, twice a million times its
    count by those of both parts together.  One that stands in a longer phrase which has
    ``share`` per cent of its count or more is left out."""
    phrases, sums = counted(docs, least, words, **how)
    some = phrases.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = some.withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"))
    known = phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    cuts = cuts.join(known, ["lang", "left"]).join(known.withColumnsRenamed({"left": "right", "l": "r"}), ["lang", "right"])
    score = F.expr("cast(a AS decimal(20, 0)) * cast(2000000 AS decimal(7, 0)) div (cast(l AS decimal(20, 0)) + cast(r AS decimal(20, 0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    # Of each longer phrase the parts of two words or more that are shorter.
    spans = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), s -> array_join(slice(w, s, m), ' '))))")
    within = some.where("words > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = scored.join(within, ["lang", "phrase"], "left")
    kept = kept.where(f"most IS NULL OR cast(most AS decimal(20, 0)) * 100 < cast(a AS decimal(20, 0)) * {int(share)}")
    row = F.struct((-F.col("c.score")).alias("score"), (-F.col("a")).alias("a"), "phrase", F.col("c.l").alias("l"), F.col("c.r").alias("r"))
    best = kept.select("lang", row.alias("x"), F.pmod(F.xxhash64("phrase"), F.lit(4096)).alias("salt"))
    # The best of salted groups, in two rounds: no lang is one task.
    for salts in (4096, 64):
        best = best.withColumn("salt", F.col("salt") % salts)
        best = _first(best, top)
    ranked = best.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list("x")), 1, top).alias("xs")).select("lang", F.posexplode("xs").alias("rank", "x"))
    out = ranked.join(sums, "lang")
    return out.select("lang", (F.col("rank") + 1).cast("long").alias("rank"), "x.phrase", (-F.col("x.a")).alias("a"), F.col("x.l").alias("l"), F.col("x.r").alias("r"), "n", (-F.col("x.score")).alias("score"))


def _first(rows: DataFrame, top: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("lang", "salt").orderBy("x"))
    return rows.withColumn("place", place).where(F.col("place") <= top).drop("place")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
ws AS (SELECT lang, row_number() OVER () AS p, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
starts AS (
  SELECT lang, w1, lead(w1, 1) OVER x AS w2, lead(w1, 2) OVER x AS w3, lead(w1, 3) OVER x AS w4
  FROM (SELECT lang, p, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM ws) WINDOW x AS (PARTITION BY p ORDER BY i)),
grams AS (
  SELECT lang, 1 AS m, w1 AS phrase FROM starts
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM starts WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM starts WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM starts WHERE w4 IS NOT NULL),
f AS (SELECT lang, phrase, m, count(*) AS f FROM grams GROUP BY lang, phrase, m HAVING count(*) >= 30),
sums AS (SELECT lang, count(*) AS n FROM starts GROUP BY lang),
c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * a // (l.f::HUGEINT + r.f) AS BIGINT) AS score
  FROM c JOIN (VALUES (1), (2), (3)) t(k) ON k < c.m
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1 : k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1 : c.m], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT c.lang, array_to_string(w[s : s + n - 1], ' ') AS phrase, max(a) AS most
  FROM c, (VALUES (2), (3)) t(n), (VALUES (1), (2), (3)) u(s) WHERE n < m AND s + n - 1 <= m GROUP BY 1, 2),
kept AS (SELECT x.* FROM lowest x LEFT JOIN longer y ON x.lang = y.lang AND x.phrase = y.phrase WHERE y.most IS NULL OR 100::HUGEINT * y.most < 80::HUGEINT * x.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sums USING (lang) WHERE rank <= 2000
"""
