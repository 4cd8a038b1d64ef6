"""Collocations against SQL and brute force."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import collocations
from folioscope.llm.queries import QUERIES


def grams(texts, most=4):
    """(n by lang, f by (lang, words))"""
    n, f = Counter(), Counter()
    for lang, text in texts:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    return n, f


def mined(texts, least, top, share=80, most=4):
    n, f = grams(texts, most)
    some = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in some.items():
        longer = [b for (x, v), b in some.items() if x == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= share * a for b in longer):
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def texts(rng, n):
    words = ["New", "york", "City", "of", "the", "über", "Ünder", "x", "a", "b", "東京", "it's"]
    out = []
    for _ in range(n):
        t = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r\n"]) for _ in range(rng.randint(0, 60)))
        out.append((rng.choice(["en", "en", "en", None, "und", "x y=%", ""]), t))
    return [*out, ("en", None), (None, ""), ("en", "no yes " * 3000), ("en", "no yes " * 3000)]


@pytest.mark.parametrize("few,hot", [(2048, 4096), (1, 4096), (8, 20)])
def test_mining_is_brute_force(spark, few, hot, monkeypatch):
    monkeypatch.setattr(collocations, "HOT", hot)
    rows = texts(random.Random(few), 300)
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(c) for c in ("bucket", "lines", "counts", "phrase", "f", "n", "rank")}).repartition(3)
    want = mined(rows, 5, 25)
    got = collocations.mine(docs, top=25, least=5)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == want and len(want) > 40


def test_counts_are_whole(spark):
    rows = texts(random.Random(5), 150)
    n, f = grams(rows)
    phrases, sums = collocations.counted(spark.createDataFrame(rows, "lang string, text string"), least=10)
    assert {r.lang: r.n for r in sums.collect()} == dict(n)
    assert {(r.lang, r.phrase): (r.words, r.f) for r in phrases.collect()} == {(lang, " ".join(w)): (len(w), a) for (lang, w), a in f.items() if a >= 10}


def test_query_is_the_sql(spark, data):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = c.execute(collocations.ORACLE)
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, QUERIES["op11_collocations"](spark, data).select(names).collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("few", [1, 16, 10_000])
def test_partitions_are_counts(few, monkeypatch):
    monkeypatch.setattr(collocations, "FEW", few)
    rng = np.random.default_rng(few)
    for words in (2, 5, 40):
        columns = [rng.integers(0, words, 3000) for _ in range(4)]
        for k in range(1, 4):
            columns[k] = np.where((columns[k - 1] < 0) | (rng.random(3000) < 0.2), -1, columns[k])
        weight = rng.integers(1, 4, 3000)
        want = Counter()
        for i, row in enumerate(zip(*columns, strict=True)):
            for d in range(4):
                if row[d] >= 0:
                    want[row[: d + 1]] += int(weight[i])
        found = collocations.multikey(columns, weight, [9, 9, 9, 30])
        got = {tuple(int(columns[k][p]) for k in range(d + 1)): t for p, d, t in found}
        assert len(got) == len(found) and got == {k: t for k, t in want.items() if t >= [9, 9, 9, 30][len(k) - 1]}


def test_exact_beyond_64_bits(spark):
    """Counts whose products need more than 64 bits give whole quotients."""
    a, left, right = 4_000_000_000_000_000_000, 4_100_000_000_000_000_000, 4_200_000_000_000_000_000
    row = spark.sql(f"SELECT cast({a}L AS decimal(20, 0)) * cast(2000000 AS decimal(7, 0)) div (cast({left}L AS decimal(20, 0)) + cast({right}L AS decimal(20, 0)))").first()
    assert row[0] == 2_000_000 * a // (left + right)


def test_no_texts(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.mine(none).count() == 0
    assert collocations.mine(spark.createDataFrame([(None, None), ("en", " . ")], "lang string, text string")).count() == 0


def test_langs_are_words():
    for x in ("en", "", "x y=%", "\n", "é"):
        assert not set(collocations._token(x)) & set(" \t\n") and collocations.unquote(collocations._token(x)[1:]) == x
    assert collocations._hashes(pa.array(["a"]))[0] == np.uint64(collocations.xxhash.xxh64_intdigest("a", 42))
