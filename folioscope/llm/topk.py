"""Operator 4: exact top-k by an impact-ordered index, a score at a time.

Candidates are dealt to blocks of bounded size.  The index has, for each block and
component, posting segments: the rows whose component falls in one quantisation
level, with the exact values.  A query's segments of all components are taken by
descending impact, that is by the largest product they can hold, a sixteenth of the
postings a round.  After a round a candidate's score can be at most what it has
gathered plus, for each component not yet seen, the largest impact that is left.  The
k-th best exact score of the most promising candidates is the bar; when those that
can still reach it are few, this proves the rest out, and they are rescored exactly.
A query's first proof comes a round before the one at which the block's last query
stopped.  The blocks' lists are merged by rank.

Blocks and blocks of queries meet pairwise, so no task holds more than one of
each; this is the stated query set against all rows.

Defined results: vectors that are null, or hold null or non-finite components, or
whose length differs from that of most, take no part, neither do null ids; an
empty table has no rows; ties go to the smaller id and repeated rows each count;
a row is no candidate of a query of the same id; the lists of several rows with a
query's id are one; scores are longs, as Spark's sums are; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BLOCK = 8192  # candidates in a block
QUERIES = 4096  # queries that meet a block at once
LEVELS = 16  # quantisation levels of a component


def valid(table: DataFrame, vector: str, key: str) -> DataFrame:
    """(id, v): rows with an id and whole, finite vectors of the usual length."""
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.where(F.expr("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))"))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").select("d").first()
    return rows.where(F.size("v") == (usual.d if usual else 0))


def quantised(rows: DataFrame, factor: int) -> DataFrame:
    """Each component x as floor(factor * x)."""
    return rows.select("id", F.transform("v", lambda x: F.floor(F.lit(float(factor)) * x).cast("long")).alias("v"))


def segments(rows: DataFrame, blocks: int, levels: int = LEVELS) -> DataFrame:
    """(block, part, ids, slots, held, bounds): per block and component its posting segments.

    One row holds a component's segments one after the other, ``bounds`` their ends,
    by descending value; ``part`` -1 holds the block's ids and vectors for rescoring."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        x, ids = np.array(pdf["v"].tolist(), np.int64), pdf["id"].to_numpy(np.int64)
        block = int(pdf["block"].iloc[0])
        out = [(block, -1, ids, np.zeros(0, np.int64), x.ravel(), np.zeros(0, np.int64))]
        for c in range(x.shape[1]):
            order = np.argsort(-x[:, c], kind="stable")
            ranked = x[order, c]
            low, high = ranked[-1], ranked[0]
            level = (ranked - low) * levels // (high - low + 1)
            out.append((block, c, np.zeros(0, np.int64), order, ranked, np.flatnonzero(np.diff(level, append=-1)) + 1))
        return pd.DataFrame(out, columns=["block", "part", "ids", "slots", "held", "bounds"])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInPandas(build, "block int, part int, ids array<long>, slots array<long>, held array<long>, bounds array<long>")


class Block:
    """The index of one block of candidates.

    A component's segments by descending impact are its postings from one end or the
    other, by the sign of the query's component; so both orders have their tables of
    impacts and places, a row a component, filled up with segments of no impact."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values("part")
        head = rows.iloc[0]
        self.ids = np.array(head["ids"], np.int64)
        n = len(self.ids)
        self.x = np.array(head["held"], np.int64).reshape(n, -1)
        self.most = np.abs(self.x).max(0).astype(np.float64)
        self.slots, self.values = [], []
        d, wide = self.x.shape[1], max(map(len, rows["bounds"]))
        #: By sign of the query's component: the value with the largest impact of each segment, and the postings up to its end.
        self.edge = np.full((2, d, wide), -np.inf), np.full((2, d, wide + 1), n)
        self.edge[0][1] = np.inf
        for c, r in enumerate(rows.iloc[1:].itertuples()):
            v, ends = np.array(r.held, np.float64), np.array(r.bounds, np.int64)
            begins = np.concatenate([[0], ends[:-1]])
            self.slots.append(np.array(r.slots, np.intp))
            self.values.append(v)
            self.edge[0][0, c, : len(ends)], self.edge[1][0, c, : len(ends) + 1] = v[begins], [0, *ends]
            self.edge[0][1, c, : len(ends)], self.edge[1][1, c, : len(ends) + 1] = v[ends - 1][::-1], [0, *(n - begins[::-1])]
        self.begin = 4  # sixteenths of the postings that a query reads before the first proof

    def top(self, q: np.ndarray, own: int, k: int, few: float = 0.25) -> list[tuple[int, int]]:
        """(score, id) of the k best candidates, best first, ties to smaller ids.

        A round takes a sixteenth of the postings; the rest is left out as soon as no more
        than the share ``few`` of the candidates can still be among the best."""
        q = q.astype(np.int64)
        allowed = self.ids != own
        k = min(k, int(allowed.sum()))
        if not k:
            return []
        n = len(self.ids)
        live = np.flatnonzero(allowed)
        used = np.flatnonzero(q)
        if len(used) and n > 8 * k:
            live = self._live(q[used].astype(np.float64), used, allowed, live, k, few)
        exact = self._exact(live, q)
        best = np.lexsort((self.ids[live], -exact))[:k]
        return [(int(exact[b]), int(self.ids[live[b]])) for b in best]

    def _exact(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        if (np.abs(q) * self.most).sum() < 2**53:  # whole in a double
            return (self.x[rows].astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
        return (self.x[rows] * q).sum(1)

    def _live(self, q: np.ndarray, used: np.ndarray, allowed: np.ndarray, live: np.ndarray, k: int, few: float) -> np.ndarray:
        """The rows that may be among the best, the ``few`` share of the block or, if all
        postings tell no better, more."""
        n, d, sign = len(self.ids), len(used), (q < 0).astype(int)
        impact = q[:, None] * self.edge[0][sign, used]
        upto = self.edge[1][sign, used]
        order = np.argsort(-impact, axis=None)
        postings = np.cumsum(np.diff(upto, axis=1).ravel()[order])
        slack = 1e-12 * d * (np.abs(q) * self.most[used]).sum()  # more than rounding can hide
        gathered, seen, read = np.zeros(n), np.zeros(n, np.int64), np.zeros(d, np.int64)
        each = np.arange(d)
        query = np.zeros(self.x.shape[1], np.int64)
        query[used] = q
        for part in range(self.begin, 17):
            at = min(int(np.searchsorted(postings, postings[-1] * part / 16)), len(order) - 1)
            least = impact.ravel()[order[at]]
            segments = (impact >= least).sum(1)
            to = upto[each, segments]
            slots, products = [], []
            for c, (j, s, a, b) in enumerate(zip(used.tolist(), sign.tolist(), read.tolist(), to.tolist(), strict=True)):
                if a < b:
                    slots.append(self.slots[j][n - b : n - a] if s else self.slots[j][a:b])
                    products.append((self.values[j][n - b : n - a] if s else self.values[j][a:b]) * q[c])
            read = to
            if slots:
                slots = np.concatenate(slots)
                gathered += np.bincount(slots, weights=np.concatenate(products), minlength=n)
                seen += np.bincount(slots, minlength=n)
            left = impact[segments < impact.shape[1], segments[segments < impact.shape[1]]]
            left = left[left > -np.inf]
            # What is not seen of a row has the largest impact that is left, at most.
            most = gathered + (d - seen) * (left.max() if len(left) else 0.0) + slack
            most[~allowed] = -np.inf
            promising = np.argpartition(-most, 8 * k)[: 8 * k]
            promising = promising[allowed[promising]]
            bar = np.partition(self._exact(promising, query), len(promising) - k)[len(promising) - k]  # the k-th best is no less
            live = np.flatnonzero(most >= bar)
            if len(live) <= max(4 * k, few * n):
                break
        self.begin = max(1, part - 1)
        return live


def search(table: DataFrame, k: int = 5, every: int = 50, factor: int = 256, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``
    the k highest integer inner products with all other rows."""
    rows = cut(quantised(valid(table, vector, key), factor))
    blocks = max(1, -(-rows.count() // BLOCK))
    asked = rows.where(F.col("id") % every == 0)
    sheets = max(1, -(-asked.count() // QUERIES))
    index = segments(rows, blocks)
    # Each block meets each sheet of queries once.
    left = index.withColumn("sheet", F.explode(F.sequence(F.lit(0), F.lit(sheets - 1))))
    right = asked.withColumn("sheet", F.pmod(F.xxhash64(F.lit("sheet"), "id"), F.lit(sheets)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index) and len(queries):
            block = Block(index)
            for q, v in zip(queries["id"], queries["v"], strict=True):
                out += [(q, i, s) for s, i in block.top(np.array(v, np.int64), q, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = left.groupBy("block", "sheet").cogroup(right.groupBy("block", "sheet")).applyInPandas(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
