"""Helpers that the operators share: reading, checkpointing, Arrow batches, calibration."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: A word: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Folds of the labelled rows that classifiers are fitted on.
FOLDS = 4
#: Rows of a few numbers that a side may have to be sent to every executor; beyond, both sides are shuffled.
SMALL = 50_000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch that a task turns into Python objects at once.
SLICE = 2_000_000
#: The same where the work is on Arrow's and numpy's arrays.
ARROW_SLICE = 8_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by a path that only Spark needs to reach."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Names:
    """Names for columns beside those of a table: ``Names(df.columns).size`` is ``size``,
    with as many underscores before it as make it new."""

    def __init__(self, taken: list[str]):
        self._taken = {c.lower() for c in taken}

    def __getattr__(self, name: str) -> str:
        if name.startswith("_"):
            raise AttributeError(name)
        while name.lower() in self._taken:
            name = "_" + name
        return name


_TEMPORARY: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver share, by ``spark.checkpoint.dir``; where
    none is set and all is on this machine, one temporary folder for the application."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _TEMPORARY:
        _TEMPORARY[app] = tempfile.mkdtemp(prefix="folioscope-")
    return _TEMPORARY[app]


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that later steps neither
    recompute the rows nor lose them with an executor."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have the driver collect what nothing refers to any more, upon which Spark removes the
    shuffle files of lineages that were cut; by itself it may not get to that for half an hour."""
    spark.sparkContext._jvm.System.gc()


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder for a table or a set of files."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | list]], schema: str, size: int = SLICE) -> DataFrame:
    """mapInArrow with one state per task: ``make()`` gives the function that turns
    a batch, of about ``size`` bytes or less, into a dict of columns (or a list of such
    dicts, one per output batch)."""
    struct = _parse_datatype_string(schema)
    assert isinstance(struct, StructType)
    # Executors must have room for a batch in both processes: 8 MB where Spark's default of
    # 64 MB stands, for the session; a user's other setting stays.
    if df.sparkSession.conf.get(_BATCH).rstrip("b") == str(64 << 20):
        df.sparkSession.conf.set(_BATCH, "8m")
    arrow = to_arrow_schema(struct)

    def run(batches):
        fn = make()
        for batch in batches:
            # Python's objects take many times the room of Arrow's: a few MB at a time.
            step = max(1, batch.num_rows * size // max(1, batch.nbytes))
            for k in range(0, batch.num_rows, step):
                out = fn(batch.slice(k, step))
                for cols in out if isinstance(out, list) else [out]:
                    yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def fold(doc_id: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id has fold null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % by


def label_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int) -> DataFrame:
    """(doc_id, text, y, part) of at most ``per_class`` labelled training rows of each class.

    The rows are those with the smallest hash of the id, so the choice neither
    depends on the order nor on the number of partitions.  Of several labels of a
    document the greater counts, of several texts the smaller.  Only the chosen ids,
    2 * per_class at most, are broadcast.  ``part`` deals them to ``FOLDS`` folds by
    another hash: what a fold's rows are calibrated on is learnt from the others.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).where(train).groupBy("doc_id").agg(F.max("y").alias("y"))
    order = [F.xxhash64(F.lit(label), "doc_id"), F.col("doc_id")]
    ids = rows.where("y = 0").orderBy(*order).limit(per_class).unionAll(rows.where("y = 1").orderBy(*order).limit(per_class))
    ids = ids.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(FOLDS)).cast("int"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return texts.groupBy("doc_id", "y", "part").agg(F.min("text").alias("text"))


_WORDS = re.compile(WORD)


def _sketched():
    """Two min-hashes of a text's five-word shingles: near copies mostly share one."""

    def of(batch):
        one, two = [], []
        for t in batch["text"].to_pylist():
            w = _WORDS.findall(t.lower())
            s = {" ".join(w[i : i + 5]).encode("utf-8", "surrogatepass") for i in range(max(1, len(w) - 4))}
            one.append(min(xxhash.xxh64_intdigest(x, 1) for x in s) >> 1)
            two.append(min(xxhash.xxh64_intdigest(x, 2) for x in s) >> 1)
        return {c: batch[c] for c in ("y", "part", "text")} | {"one": one, "two": two}

    return of


def distinct_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int) -> DataFrame:
    """(y, part, text) of label_sample with most copies left out: a text that many rows
    have, in several folds, would make what is learnt of it look more telling than it is."""
    rows = cut(label_sample(docs, labels, label, train, per_class))
    sketched = map_batches(rows.select("y", "part", "text"), _sketched, "y int, part int, text string, one long, two long")
    return cut(sketched.dropDuplicates(["y", "one"]).dropDuplicates(["y", "two"]).select("y", "part", "text"))


class Logistic:
    """Ridge logistic regression on a few standardised features: the calibration
    that turns differences of compressed sizes into a probability."""

    def __init__(self, x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 1e-2):
        x, y = np.asarray(x, float), np.asarray(y, float)
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        a = np.c_[np.ones(len(x)), (x - self.mean) / self.scale]
        share, self.prior = (y.mean() if len(y) else 0.0), prior
        # The classes are sampled apart; weights bring them back to their shares.
        weight = np.where(y == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9)) if 0 < share < 1 else np.ones(len(y))
        self.beta = np.zeros(a.shape[1])
        self.beta[0] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
        if 0 < share < 1:
            penalty = ridge * len(y) + 3  # a few rows must not move the weights far
            for _ in range(60):
                p = 1 / (1 + np.exp(-np.clip(a @ self.beta, -30, 30)))
                g = a.T @ (weight * (y - p)) - penalty * np.r_[0, self.beta[1:]]
                h = (a * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ a + penalty * np.diag(np.r_[1e-9, np.ones(a.shape[1] - 1)])
                step = np.linalg.solve(h, g)
                self.beta += np.clip(step, -4, 4)
                if np.abs(step).max() < 1e-8:
                    break

    def set_threshold(self, x: np.ndarray, y: np.ndarray, threshold: float) -> None:
        """Shift the scores so that ``threshold`` is where precision and recall of label 1
        are best together on these rows."""
        if not 0 < y.sum() < len(y):
            return
        z = self(x)
        share = y.mean()
        weight = np.where(y == 1, self.prior / share, (1 - self.prior) / (1 - share))
        order = np.argsort(-z, kind="stable")
        hits, said = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
        both = np.where(hits >= 0.7 * said, 2 * hits / (said + (weight * y).sum()), 0)
        best = int(np.argmax(both))
        if not both[best]:
            return  # nothing is told with a precision of 0.7: the scores stay as they are
        at = np.clip((z[order[best]] + z[order[min(best + 1, len(z) - 1)]]) / 2, 1e-6, 1 - 1e-6)
        self.beta[0] += np.log(threshold / (1 - threshold)) - np.log(at / (1 - at))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = self.beta[0] + ((np.asarray(x, float) - self.mean) / self.scale) @ self.beta[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
