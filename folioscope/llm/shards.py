"""Operator 12: shards by proportional stratified interleaving.

The rows of each source are shuffled by a seeded hash and ranked.  Row r of a source with
n rows has the fractional rank (r + phase) / n, where the source's phase is a seeded
fraction; all rows in the order of their fractional ranks, cut into stretches of equal
counts, give shards of which each has every source in its share of the whole.  The
phases keep sources of a few rows from meeting at one place.  All of it is DataFrame
operations.

No sort is of all rows, and no source is one task: ranks are counted within 4,096 buckets
of each source's hashes, of which sums alone are gathered, and places within stretches
of the fractional rank.  How many rows such a stretch has follows from the counts of the
sources, without another look at the rows.

The law is ``rows``: the shards' counts are at most one apart.  Equal texts are rows like
others: a group of copies may be larger than a shard.

Defined results: a null text has size 16 and the checksum of an empty one; a null source
is a source, last in order; rows without id are ordered by their text; equal rows stand
next to each other in their source; an empty table has no rows; other columns pass
through, but for those named like the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Names, cut

SHARDS = 40
SEED = 7
#: Parts of a source's phase, and stretches of the fractional rank: products of both with a
#: source's rows must fit 64 bits.
PARTS, STRETCHES = 1 << 16, 1 << 10
#: Bytes that a row counts beside its text.
ROW = 16
OWN = ("shard", "slot")


def size(text: str) -> Column:
    """Bytes of a text in UTF-8 and of its row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW).cast("long")


def checksum(text: str) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def _stretches(each: DataFrame) -> DataFrame:
    """(t, start): the rows before each stretch of the fractional rank, from the sources' (n,
    phase).  A source of many rows brings a count for each stretch, one of a few its rows'
    own stretches, so there are never more than rows."""
    many = F.col("n") > STRETCHES
    ranks = each.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.when(many, STRETCHES).otherwise(F.col("n")) - 1)))
    # Rows r with (r * PARTS + phase) * STRETCHES < t * n * PARTS, for t = k and k + 1.
    below = "greatest(0, least(n, ({t} * n * {p} - {s} * phase + {s} * {p} - 1) div ({s} * {p})))"
    upto, before = (F.expr(below.format(t=t, p=PARTS, s=STRETCHES)) for t in ("(k + 1)", "k"))
    own = F.expr(f"(k * {PARTS} + phase) * {STRETCHES} div (n * {PARTS})")
    counts = ranks.select(F.when(many, F.col("k")).otherwise(own).alias("t"), F.when(many, upto - before).otherwise(1).alias("c")).groupBy("t").agg(F.sum("c").alias("c"))
    # One row for each stretch.
    return counts.select("t", (F.sum("c").over(Window.orderBy("t")) - F.col("c")).alias("start"), F.sum("c").over(Window.partitionBy()).alias("total"))


def assign(docs: DataFrame, shards: int = SHARDS, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = SEED, own: tuple[str, str] = OWN) -> DataFrame:
    """The rows with shard and slot, their place in the shard, by the names ``own``; columns
    of the input with these names go."""
    docs = docs.drop(*own)
    n = Names([*docs.columns, *own])
    # Rows without id are told apart by their texts.
    named = F.coalesce(F.col(key).cast("string"), F.concat(F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    rows = docs.withColumns({n.order: F.md5(F.concat(F.lit(f"{seed}:"), named)), n.same: F.md5(F.coalesce(text, F.lit("")))})
    rows = rows.withColumn(n.bucket, F.substring(n.order, 1, 3))
    sums = cut(rows.groupBy(F.col(source).alias("s"), F.col(n.bucket).alias("b")).agg(F.count("*").alias("c")))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), "s"), F.lit("")))
    phase = F.conv(F.substring(F.md5(name), 1, 4), 16, 10).cast("long")
    each = sums.groupBy("s").agg(F.sum("c").alias("n")).withColumn("phase", phase)
    # Of each source's bucket the rows before it, with the source's count and phase.
    of = Window.partitionBy("s")
    plan = sums.select("s", "b", (F.sum("c").over(of.orderBy("b")) - F.col("c")).alias("before"), F.sum("c").over(of).alias("n"), phase.alias("phase"))
    plan = plan.toDF(n.of, n.b, n.before, n.n, n.phase)
    met = rows.join(plan, F.col(source).eqNullSafe(F.col(n.of)) & (F.col(n.bucket) == F.col(n.b)))
    shuffled = Window.partitionBy(n.of, n.b).orderBy(n.order, F.col(key), n.same)
    met = met.withColumn(n.rank, F.row_number().over(shuffled) - 1 + F.col(n.before))
    # The fractional rank: its stretch by whole numbers, its order within by doubles.
    above, below = F.col(n.rank) * PARTS + F.col(n.phase), F.col(n.n) * PARTS
    stretch = F.expr(f"(`{n.rank}` * {PARTS} + `{n.phase}`) * {STRETCHES} div (`{n.n}` * {PARTS})")
    met = met.withColumns({n.stretch: stretch, n.fraction: above.cast("double") / below.cast("double")})
    # At most STRETCHES rows of three numbers.
    starts = F.broadcast(_stretches(each).toDF(n.t, n.start, n.total))
    placed = met.join(starts, F.col(n.stretch) == F.col(n.t))
    within = Window.partitionBy(n.stretch).orderBy(n.fraction, F.col(n.of).asc_nulls_last(), n.rank)
    placed = placed.withColumn(n.place, F.row_number().over(within) - 1 + F.col(n.start))
    shard, slot = own
    # Shard s has the places from ceil(s * total / shards) on.
    numbered = placed.withColumn(shard, F.expr(f"cast(`{n.place}` * {shards} div `{n.total}` as int)"))
    numbered = numbered.withColumn(slot, F.col(n.place) - F.expr(f"(`{shard}` * `{n.total}` + {shards} - 1) div {shards}"))
    return numbered.select(*docs.columns, shard, slot)


def write(docs: DataFrame, path: str, parts: int, shards: int = SHARDS, **how) -> None:
    """A folder ``shard=<number>`` of Parquet files for each shard, rows by slot; each file has
    a stretch of slots, so that no shard is one task.  ``parts``: tasks that write."""
    names = how.get("own", OWN)
    placed = assign(docs, shards, **how)
    placed.repartitionByRange(parts, *names).sortWithinPartitions(*names).write.partitionBy(names[0]).parquet(path)


#: DuckDB has no crc32: a byte at a time by the table of its polynomial, made here from that.
ORACLE = r"""
WITH RECURSIVE polynomial(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM polynomial WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS crc FROM polynomial WHERE k = 8),
bytes AS (
  SELECT doc_id, source, text, hex(encode(coalesce(text, ''))) AS hex FROM documents),
d AS (
  SELECT doc_id, source, CAST(length(hex) // 2 + 16 AS BIGINT) AS size,
         CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(hex) // 2), lambda i: CAST('0x' || substr(hex, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))),
                              lambda c, b: xor(c >> 8, crc[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) AS BIGINT) AS text_crc32,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), ':' || md5(coalesce(text, '')))) AS h, md5(coalesce(text, '')) AS t
  FROM bytes, crcs),
r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, t) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n,
         CAST('0x' || substr(md5('7:' || coalesce('=' || source, '')), 1, 4) AS BIGINT) AS phase
  FROM d),
p AS (
  SELECT *, row_number() OVER (ORDER BY (rank * 65536 + phase) * 1024 // (n * 65536), CAST(rank * 65536 + phase AS DOUBLE) / CAST(n * 65536 AS DOUBLE), source NULLS LAST, rank) - 1 AS place, count(*) OVER () AS total
  FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 40 // total AS INTEGER) AS shard,
       CAST(place - ((place * 40 // total) * total + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p
"""
