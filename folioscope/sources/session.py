"""What the session must give: checkpoints in the folder that it names, Arrow batches of bounded size."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage, so that iterations neither recompute rows nor lose them.

    The folder is that of ``spark.checkpoint.dir``; a temporary one serves only where all
    is on this machine."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="folioscope-"))
    return df.checkpoint(eager=True)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB where Spark's default of 64 MB stands, for the session, as executors
    must have room for a batch in both processes; a user's other setting stays."""
    if spark.conf.get(_BATCH).rstrip("b") == str(64 << 20):
        spark.conf.set(_BATCH, "8m")
