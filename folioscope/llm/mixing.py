"""Operator 7: mixing sources to target weights by capped water-filling.

The words to take are shared among sources by weight; a source is clamped at
``most`` epochs, and what it can't take is shared among the others by weight until
no source is above its cap.  A source's target becomes whole repetitions of each
of its documents and, in a seeded order, one further repetition of as many
documents as fit, the last of them in part.  All of it is DataFrame operations.

The order is a hash of seed and id, of seed and text where there is no id.  Its first three hex digits deal a source's
documents to 4,096 buckets, of which only sums are gathered; a single bucket of
each source holds the place where the further repetitions end, and only its rows
are ranked.  Documents therefore never move, and no source is one task.

Defined results: a null or empty text has size 0 and is taken 0 times; a null
source is a source, last in order; sources without words have target 0; equal ids
are ordered by size; an empty table has no rows; other columns pass through, but
for those named like the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL, WORD, Names, cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 7
#: Groups that a source's documents are dealt to where they are shuffled.
SALTS = 64
OWN = ("size", "source_size", "target", "taken")


def words(text: str | Column) -> Column:
    """The number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row each."""
    if share > most:
        raise ValueError("the sources can't hold that many words within their caps")
    # Ranked among sources only; their documents are summed up by now.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = cut(sizes.withColumn("w", weight.cast("double")).withColumn("cap", (F.col("source_size") * most).cast("double")))
    every = rows.agg(F.sum("source_size").alias("n"), F.sum("w").alias("w")).first()
    wanted, clamped, left = share * float(every.n or 0), 0.0, float(every.w or 1)
    while True:
        over = F.col("cap") < F.lit(wanted - clamped) * F.col("w") / F.lit(left)
        got = rows.agg(F.sum(F.when(over, F.col("cap"))).alias("c"), F.sum(F.when(~over, F.col("w"))).alias("w")).first()
        now = float(got.c or 0), float(got.w or 0)
        if not now[1] or now == (clamped, left):
            break
        clamped, left = now
    fair = F.lit(wanted - clamped) * F.col("w") / F.lit(left)
    return rows.select("source", "source_size", F.when(over, F.col("cap")).otherwise(fair).alias("target"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = SEED, own: tuple[str, ...] = OWN, **how) -> DataFrame:
    """The rows with size, source_size, target and taken, the words the mix takes, by
    the names ``own``; columns of the input with these names go."""
    docs = docs.drop(*own)
    size, source_size, target, taken = own
    n = Names([*docs.columns, *own])
    # Rows without id are told apart by their texts.
    named = F.coalesce(F.col(key).cast("string"), F.concat(F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    order = F.md5(F.concat(F.lit(f"{seed}:"), named))
    rows = docs.withColumns({size: words(text), n.order: order}).withColumn(n.bucket, F.substring(n.order, 1, 3))
    sums = cut(rows.groupBy(F.col(source).alias("source"), F.col(n.bucket).alias("bucket")).agg(F.sum(size).alias("n")))
    shared = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), **how)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    shared = shared.withColumn("whole", whole).withColumn("further", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    # The bucket in which the further repetitions end, and what the buckets before it hold.
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
    ends = sums.withColumn("upto", upto).withColumnRenamed("source", "s").join(shared, F.col("s").eqNullSafe(F.col("source")))
    ends = ends.where("upto > further").groupBy("s").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("end"))
    plan = shared.join(ends, F.col("source").eqNullSafe(F.col("s")), "left")
    plan = plan.select(F.col("source").alias(n.of), F.col("source_size").alias(source_size), F.col("target").alias(target), F.col("whole").alias(n.whole), F.col("further").alias(n.further), F.col("end.bucket").alias(n.last), F.col("end.before").alias(n.before))
    plan = cut(plan)
    there = F.col(source).eqNullSafe(F.col(n.of))
    # A row a source, of a few numbers: few are sent to the documents.  Many meet them in a
    # shuffle, in which a source's documents are dealt to SALTS groups.
    if plan.count() <= SMALL:
        met = rows.join(F.broadcast(plan), there)
    else:
        plan = plan.withColumn(n.salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn(n.dealt, F.pmod(F.xxhash64(n.order), F.lit(SALTS)).cast("int"))
        met = rows.join(plan, there & (F.col(n.dealt) == F.col(n.salt))).drop(n.salt, n.dealt)
    ranked = Window.partitionBy(n.of).orderBy(n.order, F.col(key), size).rowsBetween(Window.unboundedPreceding, -1)
    last = met.where(F.col(n.bucket) == F.col(n.last))
    room = F.col(n.further) - F.col(n.before) - F.coalesce(F.sum(size).over(ranked), F.lit(0))
    last = last.withColumn(n.part, F.greatest(F.lit(0), F.least(F.col(size), room)))
    rest = met.where(~F.coalesce(F.col(n.bucket) == F.col(n.last), F.lit(False)))
    rest = rest.withColumn(n.part, F.when(F.col(n.last).isNull() | (F.col(n.bucket) < F.col(n.last)), F.col(size)).otherwise(0))
    took = (F.col(n.whole) * F.col(size) + F.col(n.part)).cast("long")
    return last.unionByName(rest).withColumn(taken, took).select(*docs.columns, *own)


def repeated(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as it is
    taken whole, and the first words of one that is taken in part."""
    n = Names(docs.columns)
    own = n.size, n.source_size, n.target, n.taken
    size, taken = F.col(own[0]), F.col(own[3])
    mixed = mix(docs, text=text, own=own, **how).where(taken > 0)
    times = mixed.withColumn(n.time, F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(taken / size))))
    start = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), (taken % size).cast("int")), "")
    out = times.withColumn(text, F.when(F.col(n.time) * size > taken, start).otherwise(F.col(text)))
    return out.select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), ':' || md5(coalesce(text, '')))) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(2 * sum(size) AS DOUBLE) AS cap,
         CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, 1.5 * CAST(sum(source_size) OVER () AS DOUBLE) AS wanted,
         coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clamped,
         sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM s),
l AS (SELECT wanted - clamped AS num, rest AS den FROM o WHERE cap >= (wanted - clamped) * w / rest ORDER BY cap / w, source NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN cap < num * w / den THEN cap ELSE num * w / den END AS target FROM s, l),
p AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM t),
c AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, CAST(floor(p.target - p.whole * p.source_size) AS BIGINT) AS further,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, further - before)) AS BIGINT) AS taken FROM c
"""
