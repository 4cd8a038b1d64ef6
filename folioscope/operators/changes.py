"""Change feeds and versioned snapshots: what was added, changed and removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_commits(commits: DataFrame, merges: bool = False) -> DataFrame:
    """A-08, R-08: (path, git_date) from (sha, parents, author_ts, path): the greatest time,
    of merges too where asked for; the date is that of UTC."""
    some = commits if merges else commits.where(F.size("parents") <= 1)
    return some.groupBy("path").agg(F.date_format(F.max("author_ts"), "yyyy-MM-dd").alias("git_date"))


def changed_paths(commits: DataFrame, since: DataFrame) -> DataFrame:
    """R-06, R-07, O-09: distinct paths of commits that the ancestors ``since`` (sha) lack."""
    return commits.join(since.select("sha"), "sha", "left_anti").select("path").distinct()


def classified(before: DataFrame, after: DataFrame, key: str = "page_ref", value: str = "text") -> DataFrame:
    """K-06, K-02: (key, change) with change inserted, updated or removed; equal rows are left out."""
    a = before.select(F.col(key), F.sha2(value, 256).alias("old"), F.lit(True).alias("was"))
    b = after.select(F.col(key), F.sha2(value, 256).alias("new"), F.lit(True).alias("is"))
    change = F.when(F.col("was").isNull(), "inserted").when(F.col("is").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "updated")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change IS NOT NULL")


def apply_delta(snapshot: DataFrame, delta: DataFrame, key: str = "page_ref") -> DataFrame:
    """K-03, K-04: the snapshot after a delta, rows of the same columns and ``deleted``.

    A page that the delta has is dropped and, unless it is deleted, added as it is there."""
    kept = snapshot.join(delta.select(key).distinct(), key, "left_anti")
    return kept.unionByName(delta.where("NOT deleted").select(*snapshot.columns))


def apply_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """A-03: (inserted, updated, removed, pages) of one apply."""
    c = classified(before, after)
    n = lambda what: F.count(F.when(F.col("change") == what, 1)).alias(what)
    return c.agg(n("inserted"), n("updated"), n("removed")).crossJoin(after.agg(F.count("*").alias("pages")))  # two single rows


def dirty(head: DataFrame, worktree: DataFrame) -> DataFrame:
    """R-09: (path) that differs from what is committed, or is on one side only; line ends
    of text (no NUL byte) don't count."""
    normal = lambda c: F.when(F.instr(F.decode(c, "ISO-8859-1"), "\x00") > 0, F.sha2(c, 256)).otherwise(F.sha2(F.replace(F.decode(c, "ISO-8859-1"), F.lit("\r\n"), F.lit("\n")), 256))
    a = head.select("path", normal(F.col("content")).alias("h"))
    b = worktree.select("path", normal(F.col("content")).alias("w"))
    return a.join(b, "path", "full").where("NOT (h <=> w)").select("path")
