"""Every operator and stage on odd rows: nulls, empty and very long texts, ties,
repeated rows, empty tables and columns with clashing names."""

import hashlib
import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm import ann, bpe, counts, mixing, quality, secrets, simhash, tokens_file, topk, toxicity
from folioscope.llm.common import Names, fold, scratch
from folioscope.llm.words import WordCache, plain

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
#: Names that the operators use for themselves, or once did.
CLASHES = ["k1", "__k1", "__spans", "spans", "base", "parts", "row", "added", "linked_row", "whole", "further", "__last", "last", "__source", "of", "__order", "order", "__bucket", "bucket", "before", "part", "time", "salt", "dealt", "size", "target", "taken", "__id", "id", "__th", "th", "__hash", "hash", "text_hash", "rows", "rank", "score", "predicted", "n_tokens", "ids", "key", "uid", "shard", "fp", "component_id", "root", "y", "h", "lang", "source_size", "n_chars"]
TEXTS = [None, "", " \n", "login: maria " + "aB3" * 50, "password = hunter2x", "one two three four five six seven", "one two three four five six seven", "word " * 60_000, "x" * 200_000, "東京" * 30_000, "<|endoftext|>"]


def table(spark, empty=False):
    own = [c for c in CLASHES if c != "lang"]
    rows = [(i, t, "ab"[i % 2] if i % 5 else None) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (None, "no id at all here", "a"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(f"mine {c}") for c in own})
    return docs.where("false") if empty else docs


def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(len(TEXTS))] + [(3, 0, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "quality": lambda d, x: quality.score(d, quality.fit(d, x, fold("doc_id", 4) != 2)),
    "toxicity": lambda d, x: toxicity.score(d, toxicity.fit(d, x, fold("doc_id", 3) != 1)),
    "bpe": lambda d, x: bpe.digests(d, BYTE),
    "encode": lambda d, x: bpe.encode(d, BYTE, carry=("source",)),
    "secrets": lambda d, x: secrets.find(d),
    "redact": lambda d, x: secrets.redact(d),
    "simhash": lambda d, x: simhash.near_copies(d),
    "mixing": lambda d, x: mixing.mix(d),
    "counts": lambda d, x: counts.count(d, WORD),
    "files": lambda d, x: tokens_file.round_trip(d, BYTE),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_take_odd_rows(spark, name):
    docs = table(spark)
    out = OPERATORS[name](docs, labels(spark)).collect()
    assert len(out) == docs.count()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect())
    equal = [r.asDict() for r in out if r.doc_id == 5]
    for r in equal:  # repeated rows have equal results, but for their places
        assert {k: v for k, v in r.items() if k not in ("start", "taken")} == {k: v for k, v in equal[0].items() if k not in ("start", "taken")}
    assert OPERATORS[name](table(spark, empty=True), labels(spark)).count() == 0
    assert OPERATORS[name](docs, labels(spark).where("false")).count() == len(out)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, name, tmp_path):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    docs, stage = table(spark), dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, str(tmp_path))
    if name == "tokens":
        assert out.columns == ["doc_id", "source", "ids", "n_tokens"]
    else:
        assert out.columns == docs.columns
        mine = [c for c in CLASHES if c not in ("lang", "n_chars") and c in out.columns]
        for r in out.collect():
            assert all(r[c] == f"mine {c}" for c in mine)
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in out.select("doc_id").collect())
    if name in ("secrets", "tokens"):
        assert len(kept) == docs.count()
    if name == "near_copies":  # 1 and 2 are word-less as 0, and 5 is three times there beside 6
        assert kept == [(False, i) for i in (0, 3, 4, 5, 7, 8, 9, 10)] + [(True, 0)]
    if name == "mixing":
        assert not {0, 1, 2} & {i for known, i in kept if not known}
    assert stage(spark, table(spark, empty=True), str(tmp_path)).count() == 0
    out.write.parquet(scratch(spark, "odd"))


def test_equal_rows_leave_the_one_with_the_smallest_hash_of_the_others(spark):
    rows = [(1, "same words here", x) for x in ("b", "a", "c", "a")]
    kept = {tuple(map(tuple, simhash.keep_one(spark.createDataFrame(order, "doc_id long, text string, note string").repartition(n)).collect())) for order in (rows, rows[::-1]) for n in (1, 3)}
    assert len(kept) == 1 and len(next(iter(kept))) == 1


def test_a_long_mixed_string_is_a_part(spark):
    text = "login: maria " + "aB3" * 5000
    r = secrets.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s.kind, s.start, s.end) for s in r.spans_all] == [("account", 0, 12), ("mixed", 13, len(text))]


def test_patterns_are_found_by_their_hints():
    """The quick search for hints and runs loses nothing that the patterns alone find."""
    rng = random.Random(8)
    some = ["PassWord", "SECRET", "apikey", "user_name", "CLIENTID", "AKIA" + "Z" * 10, "AKIA" + "9" * 18, "0f" * 14, "aB3_" * 6, "https://x.example/y", "HOST", ":", "=", " ", "\n\n", "é", "ſecret", "'", "x"]
    for _ in range(3000):
        t = "".join(rng.choice(some) for _ in range(rng.randint(1, 12)))
        strong, weak = secrets.spans(t)
        want = [(m.start(), 0, m.end(), "assign") for m in secrets._ASSIGN.finditer(t) if m.end(2) - m.start(2) >= 6] + [(m.start(), 1, m.end(), "access") for m in secrets._ACCESS.finditer(t)] + [(m.start(), 2, m.end(), "hex") for m in secrets._HEX.finditer(t)]
        assert strong == sorted(want)
        for k, p in ((3, secrets._ACCOUNT), (5, secrets._ENDPOINT)):
            found = {(m.start(), m.end()) for m in p.finditer(t) if not any(s[0] < m.end() and m.start() < s[2] for s in strong)}
            assert {(s[0], s[2]) for s in weak if s[1] == k} == found


def test_the_word_cache_stays_within_its_bytes():
    seen = []

    def encode(words):
        seen.append(len(words))
        return np.array([len(w) for w in words], np.uint32), np.ones(len(words), np.int64)

    cache = WordCache(encode, limit=1 << 20)
    for k in range(40):
        texts = ["é" * 20_000 + str(k), " ".join(f"w{k}x{j}" for j in range(2000)), "a  b \n c", None, ""]
        ids, _ = cache(pa.array(texts, pa.string()))
        assert ids.sum() == sum(len(t or "") for t in texts)
        assert cache.bytes < (1 << 20) + 2002 * 300 and not any(len(w) > 64 for w in [*cache.spaced, *cache.whole])
    before = len(seen)
    cache(pa.array(["w39x0 w39x1", "w39x0 w39x2"]))
    assert len(seen) == before  # all of it was known


def test_plain_words():
    words = [" abc", " é,", " a×b", " ÷", "abc", " ", " a1", " x.", " ,", " 東京", " Ūx", " it's", " ab!", ""]
    raw, at, pieces = plain(words)
    assert [words[k] for k in at] == [" abc", " é,", " x.", " ab!"] and pieces.tolist() == [1, 2, 2, 2]
    assert raw == "\n abc\n é\n,\n x\n.\n ab\n!".encode()


def test_cached_words_are_the_library():
    rng = random.Random(6)
    alphabet = ["a", "É", "ü", "×", "Ā", "ß", " ", "  ", "\n", ".", ",", "'s", "1", "東", "ﬁ", "́", "\x85", "​", "<|endoftext|>", "Σ", "İ", "ǅ"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    t, w = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    for cache in (tokens_file.Encoder(BYTE).cache, bpe._cache(BYTE)):
        for _ in range(2):
            ids, n = cache(pa.array(texts))
            for x, e in zip(np.split(ids, np.cumsum(n)[:-1]), t.encode_batch(texts, add_special_tokens=False), strict=True):
                assert x.tolist() == e.ids
    each, n = counts._lengths(WORD)(pa.array(texts))
    assert [int(x.sum()) for x in np.split(each, np.cumsum(n)[:-1])] == [len(e.ids) for e in w.encode_batch(texts, add_special_tokens=False)]


def test_names_are_new():
    n = Names(["a", "_A", "b"])
    assert (n.a, n.B, n.c) == ("__a", "_B", "c")


@pytest.mark.parametrize("which,label", [(quality, "quality"), (toxicity, "toxic")])
def test_scores_are_recomputed_plainly(spark, which, label):
    """Sizes by whole frames of a fresh compressor, and the logistic function by hand."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["good", "fine", "well"] if i % 2 else ["vilest", "nastier", "wretched"]) + rng.choice(["", "ly", "er"]) for _ in range(80))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)], f"doc_id long, {label} int")
    model = which.fit(docs, marks, fold("doc_id", 4) != 2)
    got = {r.doc_id: r.score for r in which.score(docs, model).collect()}
    for i, text in rows[:40]:
        if which is quality:
            good, bad = quality._compressors(model.good, model.bad, model.params.level)
            raw = text.encode()
            g, b = (sum(len(c.compress(raw[k : k + model.params.window])) for k in range(0, len(raw), model.params.window)) for c in (good, bad))
            d = (b - g) / (b + g)
            f = [d, d * np.log1p(len(raw)) / 8, max(-8.0, min(8.0, (b - g) / 16))]
        else:
            t, o = toxicity._compressor(model.toxic), toxicity._compressor(model.ordinary)
            raw = (" " + " ".join(text.lower().split()) + " ").encode()
            saved, k = [], 0
            while not saved or k < len(raw) - (model.params.window - model.params.step):
                saved.append(len(o.compress(raw[k : k + model.params.window])) - len(t.compress(raw[k : k + model.params.window])))
                k += model.params.step
            over = sum(max(0, s - 1) for s in saved)
            f = [min(max(saved), 12), np.log1p(over), over / len(saved), np.log(len(saved)), np.log1p(sum(max(0, s - 2) for s in saved))]
        c = model.calibrated
        z = c.beta[0] + sum(w * (v - m) / s for w, v, m, s in zip(c.beta[1:], f, c.mean, c.scale, strict=True))
        assert abs(got[i] - 1 / (1 + np.exp(-min(30, max(-30, z))))) < 1e-9


def brute(rows, factor=None):
    x = np.array([v for _, v in rows], float)
    return np.floor(factor * x) if factor else x


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_ann_recall_on_the_given_vectors(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding is not None and all(v is not None and np.isfinite(v) for v in r.embedding) and any(r.embedding)]
    ids, x = np.array([i for i, _ in rows]), brute(rows)
    got: dict = {}
    for r in ann.search(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[ids == ids[k]] = -np.inf
        recall.append(len(got[ids[k]] & set(ids[np.argsort(-s, kind="stable")[:20]])) / 20)
    assert np.mean(recall) >= 0.9


def test_searches_with_an_id_on_two_rows(spark):
    """The lists of a query id that several rows have are one: the best over all of them."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id, r.score) for r in topk.search(df, k=2).orderBy("rank").collect()] == [(1, 2, 3 * 65536), (2, 1, 2 * 65536)]
    assert [(r.rank, r.vec_id, r.score) for r in ann.search(df, k=2).orderBy("rank").collect()] == [(1, 2, 3.0), (2, 1, 2.0)]


def test_large_components_are_summed_whole():
    big = np.array([[2**31 - 1, -(2**31), 3], [2**31 - 1, -(2**31), 4], [1, 2, 5]], np.int64)
    import pandas as pd

    def index(x):
        out = [(0, -1, np.arange(len(x)), np.zeros(0, np.int64), x.ravel(), np.zeros(0, np.int64))]
        for c in range(x.shape[1]):
            order = np.argsort(-x[:, c], kind="stable")
            out.append((0, c, np.zeros(0, np.int64), order, x[order, c], np.array([len(x)])))
        return pd.DataFrame(out, columns=["block", "part", "ids", "slots", "held", "bounds"])

    block = topk.Block(index(big))
    q = np.array([2**30, -(2**30), 1], np.int64)
    assert block.top(q, -1, 2) == [(int(sum(int(a) * int(b) for a, b in zip(big[1], q, strict=True))), 1), (int(sum(int(a) * int(b) for a, b in zip(big[0], q, strict=True))), 0)]


def test_the_mix_is_the_same_by_a_shuffle(spark, monkeypatch):
    """The plan of many sources meets the documents in a shuffle, that of few is sent to them."""
    rng = random.Random(12)
    rows = [(i, rng.choice(["hot", "hot", "b", None, f"s{rng.randrange(30)}"]), "w " * rng.randint(0, 30)) for i in range(600)]
    docs = spark.createDataFrame([*rows, (5, "hot", "w w"), (None, "b", None)], "doc_id long, source string, text string")
    got = {}
    for small, salts in ((50_000, 64), (0, 64), (0, 3)):
        monkeypatch.setattr(mixing, "SMALL", small)
        monkeypatch.setattr(mixing, "SALTS", salts)
        got[small, salts] = sorted(map(str, mixing.mix(docs).collect()))
    assert len(got[0, 3]) == 602 and got[0, 3] == got[0, 64] == got[50_000, 64]


@pytest.mark.parametrize("which", [topk, ann])
def test_searches_take_odd_rows(spark, which):
    """Null, short, long, zero and non-finite vectors, repeated ones and clashing names."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist(), 1) for i in range(120)]
    rows += [(200, None, 1), (201, [1.0, None] + [0.0] * 6, 1), (202, [float("nan")] * 8, 1), (203, [1.0] * 7, 1), (204, rows[7][1], 1), (205, rows[7][1], 1), (206, [0.0] * 8, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(c) for c in ("rank", "score", "query_id", "block", "bin", "list", "part", "term")})
    out = which.search(vectors).collect()
    left_out = {200, 201, 202, 203} | ({206} if which is ann else set())
    assert out and not left_out & ({r.query_id for r in out} | {r.vec_id for r in out})
    by = {}
    for r in out:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q, found in by.items():
        found.sort()
        assert [k for k, _, _ in found] == list(range(1, len(found) + 1)) and q not in {v for _, v, _ in found}
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
    assert which.search(vectors.where("false")).count() == 0
