"""Streams: debounced file events, eligible sweeps, and the incremental index."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.stored import StoredIndex


def debounce(events: DataFrame, gap: str = "30 seconds", late: str = "30 seconds") -> DataFrame:
    """W-02: (rel, started, last_event, events) once a key has been quiet for the gap.

    Session windows in event time: an event exactly a gap after the one before still
    belongs to its session."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "rel").agg(F.max("ts").alias("last_event"), F.count("*").alias("events"))
    return s.select("rel", F.col("session_window.start").alias("started"), "last_event", "events")


def watch(settled: DataFrame, sweep: Callable[[], DataFrame], queue: str, checkpoint: str, interval: str = "5 seconds", once: bool = False) -> StreamingQuery:
    """W-03, W-04, W-06, W-09: each batch of settled files that the sweep finds eligible is
    appended to the queue, files that are there already left out.  A sweep that fails is
    reported and the stream goes on."""

    def of(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            found = batch.select("rel").distinct().join(sweep().select(F.col("raw_rel").alias("rel")), "rel", "left_semi")
            if _exists(spark, queue):
                found = found.join(pending(spark, queue), "rel", "left_anti")
            _enter(found, False, queue)
        except Exception as e:  # noqa: BLE001  the contract is to go on
            print(json.dumps({"batch": number, "sweep_failed": str(e)[:500]}))

    w = settled.writeStream.foreachBatch(of).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=interval)).start()


def _enter(rows: DataFrame, done: bool, queue: str) -> None:
    """Entries in a folder of their own, so that writers don't meet."""
    rows.select("rel", F.lit(done).alias("done"), F.lit(time.time_ns()).alias("at")).write.parquet(f"{queue}/{uuid.uuid4().hex}")


def pending(spark: SparkSession, queue: str) -> DataFrame:
    """R-16: (rel) of the files in the queue, each once."""
    last = spark.read.schema("rel string, done boolean, at long").option("recursiveFileLookup", "true").parquet(queue).where("rel <> ''").groupBy("rel").agg(F.max_by("done", F.struct("at", "done")).alias("done"))
    return last.where("NOT done").select("rel")


def remove(spark: SparkSession, queue: str, done: DataFrame) -> None:
    """K-09: take the files done, all occurrences, out of the queue.

    The queue is a log of what came and what is done, of which a file's last entry counts:
    taking out is one entry more, so no moment is without a queue, a run that breaks off leaves
    it as it was, and a watch may append meanwhile."""
    _enter(done.select("rel").distinct(), True, queue)


def file_changes(spark: SparkSession, listed: Callable[[], DataFrame], state: str, number: int) -> DataFrame:
    """W-01: (rel, change, ts): what was created, changed or gone since the listing before.

    ``listed`` gives (raw_rel, length, modified).  Listings are kept below ``state`` by number: one
    that is there already is taken as it is, so a run that is repeated finds the same, and
    the first one finds nothing.  Two listings before are removed."""
    here = f"{state}/listings/{number}"
    if not _exists(spark, f"{here}/_SUCCESS"):
        listed().select(F.col("raw_rel").alias("rel"), "length", "modified").write.mode("overwrite").parquet(here)
    now = spark.read.parquet(here)
    fs, p = _fs(spark, f"{state}/listings")
    earlier = sorted(int(n) for n in (s.getPath().getName() for s in fs.listStatus(p)) if int(n) < number and _exists(spark, f"{state}/listings/{n}/_SUCCESS"))
    for n in earlier[:-2]:
        fs.delete(_fs(spark, f"{state}/listings/{n}")[1], True)
    before = spark.read.parquet(f"{state}/listings/{earlier[-1]}") if earlier else now
    old = before.select(F.col("rel").alias("r"), F.col("length").alias("l"), F.col("modified").alias("m"))
    met = now.join(old, F.col("rel") == F.col("r"), "full")
    change = F.when(F.col("r").isNull(), "created").when(F.col("rel").isNull(), "gone").when((F.col("length") != F.col("l")) | (F.col("modified") != F.col("m")), "changed")
    return met.select(F.coalesce("rel", "r").alias("rel"), change.alias("change"), F.current_timestamp().alias("ts")).where("change IS NOT NULL")


def list_changes(spark: SparkSession, listed: Callable[[], DataFrame], state: str, interval: str = "2 seconds") -> StreamingQuery:
    """W-01: a listing each interval, with what it shows as files of ``state``/events, once."""

    def of(batch: DataFrame, number: int) -> None:
        to = f"{state}/events/{number}"
        if not _exists(batch.sparkSession, f"{to}/_SUCCESS"):
            file_changes(batch.sparkSession, listed, state, number).write.mode("overwrite").parquet(to)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(of).option("checkpointLocation", f"{state}/checkpoint").trigger(processingTime=interval).start()


def change_stream(spark: SparkSession, state: str) -> DataFrame:
    """The stream of (rel, change, ts) that list_changes writes."""
    fs, p = _fs(spark, f"{state}/events")
    fs.mkdirs(p)
    return spark.readStream.schema("rel string, change string, ts timestamp").option("recursiveFileLookup", "true").parquet(f"{state}/events")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def indexed(feed: DataFrame, index: StoredIndex, parse: Callable[[DataFrame], DataFrame], checkpoint: str, name: str = "feed", once: bool = True, interval: str = "5 seconds") -> StreamingQuery:
    """W-07, K-06: each batch of (page_ref, date, content, deleted) as a segment of a stored
    index, exactly once: the version that names it has the batch's number.

    ``parse`` gives records of (page_ref, text, git_date); a page that it leaves out is taken
    out, as one that is deleted.  What is written goes with the batch."""

    def of(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("page_ref").agg(F.max_by(F.struct("content", "date", "deleted"), F.struct("date", ~F.col("deleted"))).alias("c")).select("page_ref", "c.*")
        parsed = parse(last.where("NOT deleted").select("page_ref", F.col("content").alias("text"), F.when(F.col("date") != "", F.col("date")).alias("git_date")))
        changed = last.select("page_ref").join(parsed.withColumn("there", F.lit(True)), "page_ref", "left")
        index.apply(changed.withColumn("deleted", F.col("there").isNull()).drop("there"), name, number)

    w = feed.writeStream.foreachBatch(of).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=interval)).start()
