"""Pages, raw files, logs, queues and policies read from files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ignore_pattern, is_page_ref
from ..functions.yamlcore import with_frontmatter
from ..operators.rawsweep import SKIPPED


def _below(root: str, path: Column) -> Column:
    """A file's path below the root."""
    return F.regexp_replace(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), rf"^.*?\Q{root.rstrip('/').split('://')[-1].lstrip('/')}\E/", "")


def disk_pages(spark: SparkSession, root: str) -> DataFrame:
    """R-01 to R-03: (page_ref, text) of ``wiki/<folder>/<file>.md`` below a root."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(f"{root}/wiki", wholetext=True)
    return files.select(_below(root, F.col("_metadata.file_path")).alias("page_ref"), F.col("value").alias("text")).where(is_page_ref("page_ref"))


def raw_files(spark: SparkSession, root: str) -> DataFrame:
    """R-04: (raw_rel, length, modified) of files below ``raw``; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/raw")
    named = files.select(_below(root, F.col("path")).alias("raw_rel"), "length", F.col("modificationTime").alias("modified"))
    return named.where(~F.element_at(F.split("raw_rel", "/"), -1).isin(*SKIPPED))


def policies(spark: SparkSession, root: str) -> DataFrame:
    """R-17, F-10: (folder, pattern) of the policy files below ``raw``.

    Spark's file sources leave out names that start with a dot, so these few small
    files are read where the plan is made."""
    found = []
    for folder, _, names in os.walk(os.path.join(root, "raw")):
        if ".ingestignore" in names:
            with open(os.path.join(folder, ".ingestignore"), encoding="utf-8") as f:
                found += [(os.path.relpath(folder, root).replace(os.sep, "/"), line) for line in f.read().splitlines()]
    each = spark.createDataFrame(found, "folder string, line string")
    return each.select("folder", ignore_pattern("line").alias("pattern")).where("pattern IS NOT NULL")


def json_log(spark: SparkSession, path: str) -> DataFrame:
    """R-11, D-18: the tool log of JSON lines; blank and malformed lines are left out."""
    schema = "tool string, tool_use_id string, prompt_id string, agent_id string, agent_type string, duration_ms double"
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq"), F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"), "value")
    return lines.where("trim(value) <> '' AND r IS NOT NULL AND r._bad IS NULL").select("file", "seq", "r.tool", "r.tool_use_id", "r.prompt_id", "r.agent_id", "r.agent_type", "r.duration_ms")


def records(pages: DataFrame, mode: str = "DROPMALFORMED") -> DataFrame:
    """P-02, P-03, P-10, P-12: (page_ref, frontmatter as JSON, body, bad) of (page_ref, text).

    DROPMALFORMED leaves out pages whose YAML is invalid; FAILFAST stops at one."""
    from ..functions.columns import body, kind_of, tolerant_date

    parsed = with_frontmatter(pages)
    if mode == "FAILFAST":
        parsed = parsed.withColumn("json", F.when(F.col("json").isNull(), F.raise_error(F.concat(F.lit("invalid frontmatter: "), "page_ref"))).otherwise(F.col("json")))
    good = parsed.where("json IS NOT NULL")
    scalar = lambda k: F.coalesce(F.get_json_object("json", f"$.{k}"), F.lit(""))
    strings = lambda k: F.coalesce(F.from_json(F.get_json_object("json", f"$['{k}']"), "array<string>"), F.array().cast("array<string>"))
    return good.select(
        "page_ref",
        kind_of("page_ref").alias("kind"),
        scalar("title").alias("title"),
        scalar("summary").alias("summary"),
        strings("tags").alias("tags"),
        tolerant_date(scalar("source_date")).alias("source_date"),
        scalar("volatility").alias("volatility"),
        F.col("json").alias("frontmatter"),
        body("text").alias("body"),
    )


def record_edges(parsed: DataFrame) -> DataFrame:
    """P-04, P-07: (src, key, ord, dst) of the typed edges in records' frontmatter.

    raw_source is one link, other keys are lists of links; what is no link is an error."""
    from ..functions.columns import resolve_path
    from ..functions.links import links_of
    from ..operators.graph import EDGE_KEYS

    def listed(k: str):
        j = F.get_json_object("frontmatter", f"$['{k}']")
        return F.when(j.isNotNull(), F.array(j) if k == "raw_source" else F.from_json(j, "array<string>"))

    each = parsed.select(F.col("page_ref").alias("src"), F.explode(F.array(*[F.struct(F.lit(k).alias("key"), listed(k).alias("links")) for k in EDGE_KEYS])).alias("e"))
    each = each.select("src", "e.key", F.posexplode("e.links").alias("ord", "link")).withColumn("found", links_of("link"))
    dest = F.when(F.size("found") == 0, F.raise_error(F.concat(F.lit("not a link: "), "link"))).otherwise(F.get("found", F.lit(0))["path"])
    return each.select("src", "key", "ord", resolve_path(dest, F.regexp_extract("src", r"^(.*)/[^/]*$", 1)).alias("dst"))
