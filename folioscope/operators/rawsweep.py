"""The sweep of raw files: which are to be ingested, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import glob_pattern, strictly_newer

#: Files that are never candidates.
SKIPPED = ("INGESTION.md", ".ingestignore")


def scoped(raw: DataFrame, folder: str = "") -> DataFrame:
    """R-04, F-16: files of a folder, ``raw/x`` the same as ``x``; all for none."""
    folder = folder.strip("/").removeprefix("raw/").removeprefix("raw")
    named = raw.where(~F.element_at(F.split("raw_rel", "/"), -1).isin(*SKIPPED))
    return named.where(F.col("raw_rel").startswith(f"raw/{folder}/")) if folder else named


def ignored(raw: DataFrame, rules: DataFrame) -> DataFrame:
    """J-08: files that a pattern of their own folder's policy (folder, pattern) matches.

    The folder is the join key; patterns are compared within it only."""
    folder = F.regexp_extract("raw_rel", r"^(.*)/[^/]*$", 1)
    name = F.element_at(F.split("raw_rel", "/"), -1)
    r = rules.select(F.col("folder").alias("f"), glob_pattern("pattern").alias("g"))
    files = raw.select("raw_rel", folder.alias("folder"), name.alias("name"))
    return files.join(r, (files["folder"] == r["f"]) & F.expr("name RLIKE g"), "left_semi").select("raw_rel")


def back_pointers(edges: DataFrame) -> DataFrame:
    """J-05, A-09: (raw_rel, page_ref) from raw_source edges."""
    return edges.where("key = 'raw_source'").select(F.col("dst").alias("raw_rel"), F.col("src").alias("page_ref"))


def never_ingested(raw: DataFrame, pointers: DataFrame) -> DataFrame:
    """J-06: files that no page points back to."""
    return raw.join(pointers, "raw_rel", "left_anti")


def sweep(raw: DataFrame, rules: DataFrame, pointers: DataFrame, pages: DataFrame) -> DataFrame:
    """I-10: (raw_rel, reason, back_pointers) of files to ingest.

    ``raw``: raw_rel, last_commit_date ("" if none), dirty.  Ignored files go first;
    then a file is never_ingested, dirty, or changed since a page that came of it
    (J-07: any one with an older date), in this order."""
    left = raw.join(ignored(raw, rules), "raw_rel", "left_anti")
    dated = pointers.join(pages.select("page_ref", F.coalesce("git_date", F.lit("")).alias("page_date")), "page_ref", "left")
    met = left.join(dated, "raw_rel", "left")
    newer = strictly_newer(F.col("last_commit_date"), F.coalesce("page_date", F.lit("")))
    grouped = met.groupBy("raw_rel").agg(F.max("dirty").alias("dirty"), F.bool_or(F.col("page_ref").isNotNull() & newer).alias("newer"), F.sort_array(F.collect_set("page_ref")).alias("back_pointers"))
    reason = F.when(F.size("back_pointers") == 0, "never_ingested").when(F.col("dirty"), "dirty").when(F.col("newer"), "changed")
    return grouped.select("raw_rel", reason.alias("reason"), "back_pointers").where("reason IS NOT NULL")
