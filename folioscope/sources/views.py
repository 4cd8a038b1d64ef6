"""The page view over the given tables, by the same rules as its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import FOLDERS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_ref(doc_id: Column) -> Column:
    folder = F.element_at(F.array(*[F.lit(f) for f in FOLDERS.values()]), (doc_id % 4 + 1).cast("int"))
    return F.concat(F.lit("wiki/"), folder, F.lit("/"), F.lpad(doc_id.cast("string"), 8, "0"), F.lit(".md"))


def _texts() -> list[Column]:
    title = F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 60)
    return [page_ref(F.col("doc_id")).alias("page_ref"), title.alias("title"), F.substring("text", 61, 120).alias("summary"), F.col("text").alias("body")]


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_ref, title, summary, body) of the page view: one scan, without what needs other rows."""
    return table(spark, sf_dir, "documents").select(*_texts())


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as pages (see pages_sql for the rules)."""
    d = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    i = F.col("doc_id")
    same = Window.partitionBy("h").orderBy("doc_id")
    folder_kind = F.element_at(F.array(*[F.lit(k) for k in FOLDERS]), (i % 4 + 1).cast("int"))
    # Texts stay where they are: only ids and hashes are ordered, and only copies come back.
    copies = d.select("doc_id", F.sha2("text", 256).alias("h")).withColumns({"prev": F.lag("doc_id").over(same), "next": F.lead("doc_id").over(same)})
    copies = copies.where("prev IS NOT NULL OR next IS NOT NULL").select("doc_id", "prev", "next")
    base = d.join(copies, "doc_id", "left").join(labels, "doc_id", "left")
    quality = F.when(F.col("quality").isNotNull(), F.concat(F.lit("q"), F.col("quality").cast("string")))
    day = lambda start, n: F.date_format(F.date_add(F.to_date(F.lit(start)), (i % n).cast("int")), "yyyy-MM-dd")
    return base.select(
        "doc_id",
        *_texts(),
        folder_kind.alias("kind"),
        F.sort_array(F.array_distinct(F.array_compact(F.array("lang", "source", quality)))).alias("tags"),
        F.when(i % 17 == 0, "").otherwise(day("2024-01-01", 365)).alias("source_date"),
        F.when(i % 13 != 0, day("2024-06-01", 180)).alias("git_date"),
        F.element_at(F.array(*map(F.lit, ("stable", "evolving", "volatile"))), (i % 3 + 1).cast("int")).alias("volatility"),
        page_ref(F.col("prev")).alias("supersedes"),
        page_ref(F.col("next")).alias("superseded_by"),
        F.when(i % 5 == 0, F.concat(F.lit("raw/"), F.col("source"), F.lit("/"), i.cast("string"), F.lit(".txt"))).alias("raw_source"),
    )


def edges(view: DataFrame) -> DataFrame:
    """D-05: (src, key, ord, dst): supersedes, raw_source, and a source edge from each page to
    the source page two ids up or down."""
    i = F.col("doc_id")
    keys = F.array(
        F.struct(F.lit("raw_source").alias("key"), F.lit(0).alias("ord"), F.col("raw_source").alias("dst")),
        F.struct(F.lit("supersedes").alias("key"), F.lit(0).alias("ord"), F.col("supersedes").alias("dst")),
        F.struct(F.lit("source").alias("key"), F.lit(0).alias("ord"), F.when(i % 4 == 0, page_ref(i + 2)).alias("dst")),
        F.struct(F.lit("related").alias("key"), F.lit(0).alias("ord"), F.when(i % 3 == 0, page_ref(i + 1)).alias("dst")),
        F.struct(F.lit("refines").alias("key"), F.lit(0).alias("ord"), F.when(i % 7 == 0, page_ref(i + 3)).alias("dst")),
        F.struct(F.lit("contradicts").alias("key"), F.lit(0).alias("ord"), F.when(i % 11 == 0, page_ref(i + 4)).alias("dst")),
        F.struct(F.lit("example-of").alias("key"), F.lit(0).alias("ord"), F.when(i % 13 == 0, page_ref(i + 5)).alias("dst")),
    )
    each = view.select(F.col("page_ref").alias("src"), F.explode(keys).alias("e")).select("src", "e.*")
    return each.where("dst IS NOT NULL")


PAGES_SQL = r"""
base AS (
  SELECT d.*, l.quality, lag(d.doc_id) OVER (PARTITION BY text ORDER BY d.doc_id) AS prev, lead(d.doc_id) OVER (PARTITION BY text ORDER BY d.doc_id) AS nxt
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
pages AS (
  SELECT doc_id, ref(doc_id) AS page_ref, left(split_part(text, chr(10), 1), 60) AS title, substr(text, 61, 120) AS summary, text AS body,
         CASE doc_id % 4 WHEN 0 THEN 'concept' WHEN 1 THEN 'entity' WHEN 2 THEN 'source' ELSE 'synthesis' END AS kind,
         list_sort(list_distinct(list_filter([lang, source, 'q' || CAST(quality AS VARCHAR)], lambda x: x IS NOT NULL))) AS tags,
         CASE WHEN doc_id % 17 = 0 THEN '' ELSE strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') END AS source_date,
         CASE WHEN doc_id % 13 <> 0 THEN strftime(DATE '2024-06-01' + CAST(doc_id % 180 AS INTEGER), '%Y-%m-%d') END AS git_date,
         CASE doc_id % 3 WHEN 0 THEN 'stable' WHEN 1 THEN 'evolving' ELSE 'volatile' END AS volatility,
         CASE WHEN prev IS NOT NULL THEN ref(prev) END AS supersedes, CASE WHEN nxt IS NOT NULL THEN ref(nxt) END AS superseded_by,
         CASE WHEN doc_id % 5 = 0 THEN 'raw/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' END AS raw_source
  FROM base),
edges AS (
  SELECT page_ref AS src, 'raw_source' AS key, raw_source AS dst FROM pages WHERE raw_source IS NOT NULL
  UNION ALL SELECT page_ref, 'supersedes', supersedes FROM pages WHERE supersedes IS NOT NULL
  UNION ALL SELECT page_ref, 'source', ref(doc_id + 2) FROM pages WHERE doc_id % 4 = 0
  UNION ALL SELECT page_ref, 'related', ref(doc_id + 1) FROM pages WHERE doc_id % 3 = 0
  UNION ALL SELECT page_ref, 'refines', ref(doc_id + 3) FROM pages WHERE doc_id % 7 = 0
  UNION ALL SELECT page_ref, 'contradicts', ref(doc_id + 4) FROM pages WHERE doc_id % 11 = 0
  UNION ALL SELECT page_ref, 'example-of', ref(doc_id + 5) FROM pages WHERE doc_id % 13 = 0)
"""


def sql_ref(x: str) -> str:
    """A page ref in SQL."""
    return f"('wiki/' || CASE ({x}) % 4 WHEN 0 THEN 'concepts' WHEN 1 THEN 'entities' WHEN 2 THEN 'sources' ELSE 'synthesis' END || '/' || lpad(CAST({x} AS VARCHAR), 8, '0') || '.md')"


def pages_sql() -> str:
    """The CTEs base, pages and edges in DuckDB's SQL."""
    out = PAGES_SQL
    for x in ("doc_id + 5", "doc_id + 4", "doc_id + 3", "doc_id + 2", "doc_id + 1", "doc_id", "prev", "nxt"):
        out = out.replace(f"ref({x})", sql_ref(x))
    return out
