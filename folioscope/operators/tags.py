"""Tag vocabulary and index figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_tags(pages: DataFrame) -> DataFrame:
    """O-07: (page_ref, tag), each once."""
    return pages.select("page_ref", F.explode(F.array_distinct("tags")).alias("tag"))


def vocabulary(tags: DataFrame) -> DataFrame:
    """A-01: (tag, n), most frequent first; superseded pages count too."""
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def containing(vocab: DataFrame, parts: list[str]) -> DataFrame:
    """F-14: tags that hold any of the parts, in either case, in the vocabulary's order."""
    hit = F.exists(F.array(*[F.lit(p.lower()) for p in parts]), lambda p: F.contains(F.lower("tag"), p)) if parts else F.lit(False)
    return vocab.where(hit).orderBy(F.desc("n"), "tag")


def exact_counts(vocab: DataFrame, wanted: DataFrame) -> DataFrame:
    """F-15: (ord, tag, n) of the tags in ``wanted`` (ord, tag); 0 for those without pages."""
    return wanted.join(vocab, "tag", "left").select("ord", "tag", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def status(pages: DataFrame, on_disk: DataFrame) -> DataFrame:
    """A-02, A-04: pages indexed, pages on disk, and how many the index lacks at least."""
    a = pages.agg(F.count("*").alias("pages"))
    b = on_disk.agg(F.count("*").alias("on_disk"))
    return a.crossJoin(b).select("pages", "on_disk", F.greatest(F.col("on_disk") - F.col("pages"), F.lit(0)).alias("behind"))  # two single rows
