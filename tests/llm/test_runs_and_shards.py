"""Runs of repeated words against brute force, shards against SQL and a plain sort."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import periods, shards
from folioscope.llm.queries import QUERIES
from folioscope.llm.wordids import SPACES, Splitter


def runs(words, times=4, least=6):
    """(start, length, period) of all runs, period by period."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def repetitive(rng, n, words):
    d = [rng.randrange(words) for _ in range(n)]
    while n and rng.random() < 0.7:
        p, a, m = rng.randint(1, max(1, n // 5)), rng.randrange(n), rng.randint(1, n)
        for i in range(a, min(n, a + m)):
            d[i] = d[a + (i - a) % p]
    return d


@pytest.mark.parametrize("times", [3, 4, 6])
def test_runs_are_brute_force(times, monkeypatch):
    rng = random.Random(times)
    for trial in range(120):
        monkeypatch.setattr(periods, "AT_ONCE", rng.choice([1, 50, 1 << 19]))
        docs = [repetitive(rng, rng.choice([0, 1, 3, 7, 20, 60, 200, 500]), rng.choice([1, 2, 3, 6, 50])) for _ in range(rng.randint(0, 6))]
        ids, ends = np.array(sum(docs, []), np.int64), np.r_[0, np.cumsum([len(d) for d in docs])].astype(np.int64)
        text, *rest = periods.runs_of(ids, ends, times)
        for k, d in enumerate(docs):
            assert list(zip(*(x[text == k].tolist() for x in rest), strict=True)) == [(s, n, q) for s, n, q in sorted(runs(d, times), key=lambda r: (r[0], r[2]))]


def test_extensions_are_plain_comparisons():
    rng = random.Random(2)
    for _ in range(20):
        d = repetitive(rng, 400, rng.choice([2, 3, 20]))
        string = np.array([-1, *d, -2, *d[:50], -3], np.int64)
        g = periods.Grammar(string, np.array([400, 50]))
        assert len(g.top) < len(string)
        x, y = np.array([rng.randint(1, 440) for _ in range(300)]), np.array([rng.randint(1, 440) for _ in range(300)])
        some = (x != y) & (string[x] >= 0) & (string[y] >= 0)
        x, y = x[some], y[some]
        for way in (1, -1):
            for a, b, n in zip(x, y, g.extension(x, y, way), strict=True):
                k = 0
                while string[a + way * k] == string[b + way * k]:
                    k += 1
                assert n == k


def test_words_are_split_as_python_does():
    rng = random.Random(3)
    texts = [None, "", " ", *["".join(rng.choice(["a", "B", "é", "東", " ", "\t", "\n", "\x0b", "\r", "\x85", " ", "x y"]) for _ in range(rng.randint(0, 30))) for _ in range(300)]]
    w = Splitter()(pa.array(texts).slice(1))
    of = w.dictionary.to_pylist()
    for k, t in enumerate(texts[1:]):
        assert [of[i] for i in w.ids[w.ends[k] : w.ends[k + 1]]] == [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if x]
    assert SPACES == b" \t\n\x0b\x0c\r"


def made(doc_id, text):
    w = (text or "").translate({i: " " for i in range(9, 14)}).split(" ")
    w = [x for x in w if x]
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_query_is_brute_force(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    out = QUERIES["op13_periods"](spark, data).collect()
    assert len(out) == len(docs)
    for r in out:
        w = made(r.doc_id, docs[r.doc_id])
        found = sorted(runs(w), key=lambda x: (x[0], x[2]))
        best = min(((-n, s, q) for s, n, q in found), default=None)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4)
        fallen = {i for s, n, q in found for i in range(s + q, s + n)}
        assert r.n_runs == len(found) and r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in fallen).encode()).hexdigest()


def placed(rows, n_shards, seed=7):
    """(source, order) rows as (shard, slot), by one sort of exact fractions."""
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    by = {}
    for i, (key, source) in enumerate(rows):
        by.setdefault(source, []).append((md5(f"{seed}:{key}"), i))
    order = []
    for source, some in by.items():
        phase = int(md5(f"{seed}:" + ("" if source is None else "=" + source))[:4], 16)
        order += [(Fraction(r * 65536 + phase, len(some) * 65536), source is None, source or "", r, i) for r, (_, i) in enumerate(sorted(some))]
    out = {}
    for place, (*_, i) in enumerate(sorted(order)):
        s = place * n_shards // len(rows)
        out[i] = (s, place - -(-s * len(rows) // n_shards))
    return [out[i] for i in range(len(rows))]


@pytest.mark.parametrize("n,n_shards,stretches", [(3000, 40, 1024), (3000, 7, 16), (30, 40, 1024), (1, 5, 1024)])
def test_shards_are_a_plain_sort(spark, n, n_shards, stretches, monkeypatch):
    monkeypatch.setattr(shards, "STRETCHES", stretches)  # few: sources then bring counts
    rng = random.Random(n)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", None, f"s{rng.randrange(200)}"])) for i in range(n)]
    docs = spark.createDataFrame([(i, s, "t" * (i % 3)) for i, s in rows], "doc_id long, source string, text string")
    out = {r.doc_id: r for r in shards.assign(docs, n_shards).collect()}
    assert [(out[i].shard, out[i].slot) for i in range(n)] == placed(rows, n_shards)
    counts = Counter(r.shard for r in out.values())
    assert max(counts.values()) - min(counts.values() if len(counts) == n_shards else [0]) <= 1


def test_every_shard_has_every_source_in_its_share(spark):
    rows = [(i, ["hot", "hot", "hot", "b", None, "c"][i % 6 if i % 5 else 0]) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").withColumn("text", F.lit("t"))
    each = Counter((r.source, r.shard) for r in shards.assign(docs).collect())
    for source, n in Counter(s for _, s in rows).items():
        assert all(abs(each[source, k] - n / 40) <= 2 for k in range(40))


def test_shards_are_the_sql(spark, data):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = c.execute(shards.ORACLE)
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, QUERIES["op12_shards"](spark, data).select(names).collect())) == sorted(want.fetchall())


def test_odd_rows_get_places(spark):
    rows = [(1, "a", None), (None, "a", "x"), (None, None, "x"), (2, None, "y"), (2, None, "y"), (3, "", ""), (4, "a", "é" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit(c) for c in ("order", "bucket", "place", "n", "of", "b", "t", "start", "total", "rank", "phase", "slot")})
    out = shards.assign(docs, 3)
    assert [c for c in out.columns if c not in ("shard", "slot")] == [c for c in docs.columns if c not in ("shard", "slot")]
    got = out.collect()
    assert len(got) == len(rows) and sorted(Counter(r.shard for r in got).values()) == [2, 2, 3]
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(n)) for k, n in Counter(r.shard for r in got).items())
    assert shards.assign(docs.where("false"), 3).count() == 0
    sized = docs.select(shards.size("text").alias("s"), shards.checksum("text").alias("c")).collect()
    assert (sized[0].s, sized[0].c) == (16, 0) and (sized[6].s, sized[6].c) == (100_016, zlib.crc32(("é" * 50_000).encode()))


def test_shards_are_written(spark, tmp_path):
    docs = spark.createDataFrame([(i, "ab"[i % 2], f"t{i}") for i in range(300)], "doc_id long, source string, text string")
    shards.write(docs, str(tmp_path / "s"), parts=8, shards=4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(tuple, back.select("doc_id", "source", "text", "shard", "slot").collect())) == sorted(map(tuple, shards.assign(docs, 4).collect()))


def test_odd_texts_have_runs(spark):
    texts = [None, "", " \n", "a " * 100_000, "x" * 200_000, "one two " * 4, "One one " * 4, "a b"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, texts[5])], "doc_id long, text string").withColumns({c: F.lit(c) for c in ("__text", "__n", "c0", "n_words", "runs", "words")})
    out = periods.find(docs)
    assert out.columns == ["doc_id", "__text", "__n", "c0", "words", *periods.OWN]
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, []).append(r)
        assert (r["__text"], r.c0) == ("__text", "c0")
    assert [by[i][0].n_words for i in range(4)] == [0, 0, 0, 100_000]
    assert [tuple(x) for x in by[3][0].runs] == [(0, 100_000, 1)] and by[3][0].collapsed == "a"
    assert [tuple(x) for x in by[5][0].runs] == [(0, 8, 2)] and by[5][0].collapsed == "one two" and len(by[5]) == 2 and by[None][0].runs == by[5][0].runs
    assert not by[0][0].runs and by[0][0].collapsed == "" and not by[7][0].runs
    assert periods.find(docs.where("false")).count() == 0
    assert periods.made_periodic(docs).count() == docs.count()
