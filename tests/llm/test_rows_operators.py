"""Operators 4, 6, 7, 8 and the pipeline against brute force."""

import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm import ann, mixing, simhash, topk
from folioscope.llm.queries import ORACLES, QUERIES

VECTORS = "vec_id long, embedding array<float>, label int, id long, v string, rank int"


def vectors(spark, n=700, d=16, seed=0, ties=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    if ties:
        x[n // 2 :: 7] = x[3]
    rows = [(i, v.tolist(), 1, 5, "v", 9) for i, v in enumerate(x)]
    odd = [(100_000, None, 1, 1, "", 1), (100_050, [None] * d, 1, 1, "", 1), (100_100, [float("nan")] * d, 1, 1, "", 1), (100_150, [float("inf")] * d, 1, 1, "", 1), (100_200, [1.0], 1, 1, "", 1), (None, [0.5] * d, 1, 1, "", 1), (100_250, [], 1, 1, "", 1)]
    return x, spark.createDataFrame(rows + odd, VECTORS)


@pytest.mark.parametrize("block,sheet", [(8192, 4096), (90, 5)])
def test_topk_is_exact(spark, monkeypatch, block, sheet):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", sheet)
    x, df = vectors(spark)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.search(df, k=5, every=50).collect()}
    y = np.floor(256 * x.astype(float)).astype(int)
    want = {}
    for q in range(0, len(y), 50):
        s = y @ y[q]
        order = [i for i in np.lexsort((np.arange(len(y)), -s)) if i != q][:5]
        want |= {(q, k + 1): (i, s[i]) for k, i in enumerate(order)}
    assert got == want
    assert topk.search(df.where("false")).count() == 0
    assert topk.search(df.where("vec_id = 50")).count() == 0
    assert topk.search(df.where("vec_id IN (50, 51)")).count() == 1


def test_ann_recall_and_scores(spark):
    x, df = vectors(spark, n=3000, ties=False)
    df = df.unionByName(spark.createDataFrame([(100_300, [0.0] * 16, 1, 1, "", 1)], VECTORS))
    got = ann.search(df, k=20, every=20).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(by) == list(range(0, 3000, 20))
    y, recall = x.astype(float), []
    for q, found in by.items():
        s = y @ y[q]
        s[q] = -np.inf
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert np.allclose([f[2] for f in found], s[[f[1] for f in found]], atol=1e-12)
        assert [f[1:] for f in found] == sorted([f[1:] for f in found], key=lambda f: (-f[1], f[0]))
        recall.append(len({f[1] for f in found} & set(np.argsort(-s)[:20])) / 20)
    assert np.mean(recall) >= 0.9
    assert ann.search(df.where("false")).count() == 0
    assert ann.search(df.where("vec_id IN (20, 21)")).count() == 1


def test_ann_splits_a_hot_list(spark):
    x, df = vectors(spark, n=1500)
    hot = ann.Params(part=50, sheet=7, bins=2)
    same = lambda p: sorted(map(tuple, ann.search(df, params=p).collect()))
    a, b = same(hot), same(ann.Params(shortlist=2000, bins=2))
    assert len(a) == len(b) and sum(u == v for u, v in zip(a, b, strict=True)) / len(a) > 0.9


def test_ann_finds_neighbours_of_queries_unlike_the_rows(spark):
    """Rows in tight clusters, queries from all over: what the rows tell of themselves is too little."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 32))[rng.integers(150, size=6000)] + 0.05 * rng.normal(size=(6000, 32))
    x[::20] = rng.normal(size=(300, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.search(df.repartition(4), k=20, every=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for q in range(0, 6000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        assert len(got[q]) == 20
        recall.append(len(got[q] & set(np.argsort(-s)[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.9


def test_ann_keeps_the_smallest_ids_of_equal_vectors(spark):
    """A third of the rows equal, one id repeated: ties go to the smaller ids."""
    x, _ = vectors(spark, n=3000, ties=False)
    x[0::3] = x[0]
    rows = [(i, v.tolist(), 1, 5, "v", 9) for i, v in enumerate(x)] + [(9, x[9].tolist(), 1, 5, "v", 9)] * 30
    got: dict = {}
    for r in ann.search(spark.createDataFrame(rows, VECTORS).repartition(3), k=20, every=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    ids, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    recall = []
    for q in range(0, 3000, 20):
        other = ids != q
        s = (y[other] * y[ids == q][0]).sum(1)
        want = ids[other][np.lexsort((ids[other], -s))[:20]]
        found = [i for _, i in sorted(got[q])]
        assert len(found) == 20
        if q % 3 == 0:  # one of the equal rows: the others come first
            assert found == list(want)
        recall.append(sum(min(found.count(i), list(want).count(i)) for i in set(found)) / 20)
    assert np.mean(recall) >= 0.9


DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, root long, target double"


def plain_print(text, n=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    grams = [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def copies(seed=1):
    """Texts with exact and near copies, long enough that few bits differ."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(400)]
        texts += [" ".join(base), " ".join(base).upper(), " ".join(base)]
        for _ in range(6):
            near = list(base)
            near[rng.randrange(400)] = word()
            texts.append("\t".join(near))
    return texts + ["", None, " \n ", "one", "one", "one two", "ONE two", "é x y z"]


def test_golay_keys_meet_within_three_bits():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 2000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 2000).astype(np.uint64)
    b = a.copy()
    for i in range(len(a)):
        for bit in rng.choice(64, i % 4, replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    filed, asked = ({} for _ in range(2))
    for into, (rows, keys) in ((filed, simhash.keys(a, False)), (asked, simhash.keys(b, True))):
        for r, k in zip(rows, keys, strict=True):
            into.setdefault(r, set()).add(k)
    assert all(filed[i] & asked[i] for i in range(len(a)))


def test_near_copies_are_brute_force(spark):
    texts = copies()
    rows = [(i * 3, t, None, None, None, 1, 1, 0.5) for i, t in enumerate(texts)] + [(None, texts[0], None, None, None, 1, 1, 0.5), (None, "lonely and without id", None, None, None, 1, 1, 0.5), (0, texts[0], None, None, None, 1, 1, 0.5)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    prints = [plain_print(r[1]) for r in rows]
    roots = grouped(prints)
    assert sum((prints[i] ^ prints[j]).bit_count() in (1, 2, 3) for i in range(len(prints)) for j in range(i)) > 20
    least: dict = {}
    for g, r in zip(roots, rows, strict=True):
        if r[0] is not None:
            least[g] = min(r[0], least.get(g, r[0]))
    want = sorted((r[0] if r[0] is not None else -1, f"{p:016x}", least.get(g, -1)) for r, p, g in zip(rows, prints, roots, strict=True))
    got = simhash.near_copies(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "component_id").collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.f, r.component_id if r.component_id is not None else -1) for r in got) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(least.values()) and ids.count(None) == 1
    assert simhash.near_copies(docs.where("false")).count() == 0 and simhash.keep_one(docs.where("false")).count() == 0


def five(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def alike(texts):
    """The pairs (i, j) with a Jaccard similarity of 0.8 or more, i < j, of those that share a shingle."""
    sets, holders, pairs = [five(t or "") for t in texts], {}, set()
    for j, b in enumerate(sets):
        near = {i for g in b for i in holders.get(g, ())}
        pairs |= {(i, j) for i in near if 5 * len(sets[i] & b) >= 4 * len(sets[i] | b)}
        for g in b:
            holders.setdefault(g, []).append(j)
    return pairs


def test_pipeline_drops_alike_texts(spark):
    """Texts that share 80 % of five-word shingles go, though their fingerprints are far apart."""
    import corpus_pipeline

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for changed in (1, 3, 5, 6, 9, 14):  # words of 200
        base = [word() for _ in range(200)]
        texts.append(" ".join(base))
        for _ in range(6):
            near = list(base)
            for k in rng.sample(range(200), changed):
                near[k] = word()
            texts.append(" ".join(near))
    root = list(range(len(texts)))
    prints = [plain_print(t) for t in texts]
    pairs = alike(texts)
    assert sum((prints[i] ^ prints[j]).bit_count() > 3 for i, j in pairs) > 10
    for i, j in sorted(pairs | {(i, j) for j in range(len(texts)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 3}):
        one, two = root[i], root[j]
        root = [min(one, two) if r in (one, two) else r for r in root]
    docs = spark.createDataFrame([(i, t, None, None, 1, 1, 1, 0.5) for i, t in enumerate(texts)], DOCS).repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, "").collect()) == sorted(set(root))
    assert corpus_pipeline.drop_copies(spark, docs.where("false"), "").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_sets_left_apart_meet_all_that_are_alike(spark, seed):
    """Pairs of sets of different roots: all that are alike, and few of a large group that aren't."""
    from folioscope.llm import resemblance as r

    rng = np.random.default_rng(seed)
    new = lambda n: rng.integers(-(2**63), 2**63, n, dtype=np.int64)
    sets = []
    for n in (1, 2, 5, 56, 56, 300):
        base = new(n)
        for k in range(60):
            cut = rng.integers(0, max(1, n // 3) + 1)  # shingles that it lacks, and others that it has instead
            have = np.r_[rng.permutation(base)[cut:], new(rng.integers(0, cut + 1))]
            sets.append(np.unique(have if len(have) else base))
            if k % 7 == 0:  # close to the one before
                sets.append(np.unique(np.r_[sets[-1][len(sets[-1]) // 10 :], new(len(sets[-1]) // 12)]))
    roots = [int(x) for x in rng.choice([0, 0, 0, 1, 2, 3], len(sets))]
    rows = [(i, s.tolist(), roots[i]) for i, s in enumerate(sets)]
    found = r._apart(spark.createDataFrame(rows, "sh long, grams array<long>, r long").repartition(3))
    pairs = sorted((p.a, p.b) for p in found.collect())
    holds = [set(s.tolist()) for s in sets]
    near = lambda i, j: 5 * len(holds[i] & holds[j]) >= 4 * len(holds[i] | holds[j])
    differ = [(i, j) for j in range(len(sets)) for i in range(j) if roots[i] != roots[j]]
    want = {p for p in differ if near(*p)}
    assert want and want <= set(pairs) <= set(differ) and len(pairs) == len(set(pairs))
    assert sorted((p.a, p.b) for p in r._verified(spark.createDataFrame(rows, "sh long, grams array<long>, r long"), found).collect()) == sorted(want)


def test_copies_too_far_from_their_text_meet_nobody(spark):
    """Of a group whose members each differ from one text by shingles of their own, none asks."""
    from folioscope.llm import resemblance as r

    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**62, 90, dtype=np.int64)
    rows = [(i, np.unique(np.r_[base[12:], rng.integers(0, 2**62, 12, dtype=np.int64)]).tolist(), i) for i in range(300)]
    assert r._apart(spark.createDataFrame(rows, "sh long, grams array<long>, r long")).count() == 0
    assert r._apart(spark.createDataFrame([], "sh long, grams array<long>, r long")).count() == 0


def test_a_long_path_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}


def mixed_rows(seed=0):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), None, rng.choice(["a", "b", "hot", "hot", "hot", None, "é"]), 1, 1, 1, 0.5) for i in range(500)]
    return rows + [(1000, "x " * 20_000, None, "b", 1, 1, 1, 0.5), (1001, None, None, "b", 1, 1, 1, 0.5), (1002, "", None, "empty", 1, 1, 1, 0.5), (None, "no id", None, "a", 1, 1, 1, 0.5)]


def test_mixing_fills_to_the_targets(spark):
    docs = spark.createDataFrame(mixed_rows(), DOCS)
    got = mixing.mix(docs).collect()
    assert len(got) == 504 and mixing.mix(docs).columns == [c for c in docs.columns if c != "target"] + ["size", "source_size", "target", "taken"]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    total: dict = {}
    for r in got:
        assert r.size == len((r.text or "").split()) and 0 <= r.taken <= 2 * r.size
        t = total.setdefault(r.source, [0, 0, r.target, r.source_size])
        t[0] += r.size
        t[1] += r.taken
    assert all(t[0] == t[3] and t[1] == int(t[2]) and t[2] <= 2 * t[3] for t in total.values())
    assert abs(sum(t[2] for t in total.values()) - 1.5 * sum(t[0] for t in total.values())) < 1e-6
    rows = mixing.repeated(docs.drop("target"))
    assert rows.columns == docs.drop("target").columns
    assert rows.agg(F.sum(mixing.words("text"))).first()[0] == sum(r.taken for r in got)
    assert mixing.mix(docs.where("false")).count() == 0 and mixing.mix(docs.where("source = 'empty'")).first().taken == 0


def test_queries_with_sql(spark, data):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name, sql in ORACLES.items():
        want, got = c.execute(sql).df(), QUERIES[name](spark, data).toPandas()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        assert sorted(got[cols].itertuples(index=False, name=None)) == sorted(want[cols].itertuples(index=False, name=None))


def test_pipeline(spark, data):
    """Each stage on what the one before it kept, against plain checks of its effect."""
    data = data.replace("sf0.001", "sf0.01")  # the smallest table has too few labels to learn from
    import corpus_pipeline
    from folioscope.llm import secrets
    from folioscope.llm.common import scratch

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "secrets", "mixing", "tokens"] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        to = scratch(spark, "test")
        stage(spark, docs, data).write.parquet(to)
        docs = spark.read.parquet(to)
        seen.append(docs.toPandas())
        if name != "tokens":
            assert docs.columns == columns
    quality, copies, clean, mixed, tokens = seen
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    kept = set(quality.doc_id)
    assert sum(i in kept for i, q in good.items() if q) / sum(good.values()) > 0.9
    root = list(grouped([plain_print(t) for t in quality.text]))
    for i, j in sorted(alike(list(quality.text))):
        one, two = root[i], root[j]
        root = [one if r == two else r for r in root]
    groups: dict = {}
    for g, i in zip(root, quality.doc_id, strict=True):
        groups.setdefault(g, []).append(i)
    assert sorted(copies.doc_id) == sorted(min(g) for g in groups.values())
    assert sorted(clean.doc_id) == sorted(copies.doc_id) and not any(secrets.spans(t)[0] for t in clean.text)
    assert (mixed.n_chars == mixed.text.str.len()).all() and (clean.n_chars == clean.text.str.len()).all()
    size = clean.text.str.split().str.len().sum()
    assert abs(mixed.text.str.split().str.len().sum() - 1.5 * size) < 25
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((i, e.ids) for i, e in zip(mixed.doc_id, t.encode_batch(list(mixed.text), add_special_tokens=False), strict=True))
    assert sorted((i, list(x)) for i, x in zip(tokens.doc_id, tokens.ids, strict=True)) == want
    assert corpus_pipeline.run(spark, data).count() == len(tokens)
