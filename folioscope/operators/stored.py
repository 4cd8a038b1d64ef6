"""A stored index that follows a collection's history by deltas.

A folder holds segments and versions.  A segment has the pages that one change brought, with
their tokens, their postings (sorted by term) and the refs that it touched; a version is one
small file that names the commit it stands for and its segments in order.  A page is read
from the last segment that touched it.

Segments have names of their own, and a version's number is taken by creating its file,
which fails if another writer has it: that one then starts from the version it finds.  So
no writer undoes another's work, and files that a version names never change.  Segments of
like sizes are merged, ``FAN`` at a time, so each page is written again a few times only, a
logarithm of the collection; what no version of the last ``keep`` names goes by ``clean``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import tokens
from .search import WEIGHTS, Index, _grouped, corpus_of, write_postings

#: The layout of the folder; one of another number is built anew.
SCHEMA = 2
#: Segments of like sizes that are merged, and the bytes up to which sizes are alike.
FAN, SMALL = 4, 1 << 20
PARTS = ("pages", "postings")


@dataclass(frozen=True)
class Version:
    number: int
    head: str
    segments: tuple[str, ...]
    bytes: tuple[int, ...] = ()
    batches: dict = field(default_factory=dict)  # of each stream its last batch
    schema: int = SCHEMA


class StoredIndex:
    def __init__(self, spark: SparkSession, path: str, analyzer=tokens):
        self.spark, self.path, self.analyzer = spark, path.rstrip("/"), analyzer

    # -- files

    def _file(self, name: str = ""):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._file(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _size(self, name: str = "") -> int:
        fs, p = self._file(name)
        return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0

    def bytes(self) -> int:
        """The size of all files of the folder."""
        return self._size()

    # -- versions

    def _version(self, name: str) -> Version | None:
        """A version's file, None while it is being written."""
        rows = self.spark.read.text(f"{self.path}/versions/{name}", wholetext=True).collect()
        try:
            found = json.loads(rows[0].value) if rows else {}
        except ValueError:
            return None
        if found.get("schema") != SCHEMA:
            return Version(int(name.split(".")[0]), "", (), schema=0) if found else None
        return Version(**found | {k: tuple(found[k]) for k in ("segments", "bytes")})

    def versions(self) -> list[str]:
        return [n for n in self._names("versions") if n.endswith(".json")]

    def version(self) -> Version | None:
        """The last version, unless it is of another layout."""
        for name in reversed(self.versions()):
            if (v := self._version(name)) is not None:
                return v if v.schema == SCHEMA else None
        return None

    def _publish(self, v: Version) -> bool:
        """Take the version's number; False if another writer has it."""
        fs, p = self._file(f"versions/{v.number:012d}.json")
        try:
            out = fs.create(p, False)  # fails if the file is there
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception) or fs.exists(p):
                return False
            raise
        out.write(bytearray(json.dumps(asdict(v)).encode()))
        out.close()
        return True

    # -- reading

    def _part(self, segments: tuple[str, ...], part: str) -> DataFrame:
        """A part over segments, rows of pages that a later one touched left out."""
        out, later = None, None
        for s in reversed(segments):
            here = self.spark.read.parquet(f"{self.path}/{s}/{part}")
            touched = self.spark.read.parquet(f"{self.path}/{s}/touched")
            if later is not None:
                here = here.join(later, "page_ref", "left_anti")
            later = touched if later is None else later.unionByName(touched)
            out = here if out is None else out.unionByName(here)
        return out

    def pages(self, v: Version) -> DataFrame:
        """Records with ``superseded_by``, which is found from their own columns."""
        rows = self._part(v.segments, "pages")
        links = rows.select(F.col("page_ref").alias("src"), F.explode("supersedes").alias("dst")).where("src <> dst")
        successors = links.groupBy(F.col("dst").alias("page_ref")).agg(F.min("src").alias("superseded_by"))
        return rows.drop("dl", "tokens").join(successors, "page_ref", "left")

    def index(self, v: Version) -> Index:
        return Index(self._part(v.segments, "postings"), corpus_of(self._part(v.segments, "pages").select("page_ref", "dl")), self.analyzer)

    # -- writing

    def sync(self, head: str, feed: Callable[[str], DataFrame], again: bool = False, full: bool = False) -> Version:
        """W-07, W-08: bring the folder up to ``head``.

        ``feed(since)`` gives (page_ref, deleted, and a record's columns with ``supersedes``,
        the refs that it supersedes; nulls where the page can't be parsed, which takes it
        out) of what changed since a commit, of all pages for "".  At the head nothing is
        done, unless ``again`` walks the range since the version before; ``full`` builds anew."""
        while True:
            now = None if full else self.version()
            if now is not None and now.head == head and not again:
                return now
            made = self._append(now, feed(now.head if now is not None else ""), head)
            if made is not None:
                return made

    def apply(self, changed: DataFrame, stream: str, batch: int, head: str = "") -> Version:
        """K-06: a batch of a stream as a segment, once: a batch that the stream's last
        version has is passed over, so one that is run again changes nothing."""
        while True:
            now = self.version()
            if now is not None and now.batches.get(stream, -1) >= batch:
                return now
            batches = (now.batches if now is not None else {}) | {stream: batch}
            made = self._append(now, changed, head or (now.head if now is not None else ""), batches)
            if made is not None:
                return made

    def _append(self, now: Version | None, changed: DataFrame, head: str, batches: dict | None = None) -> Version | None:
        """The version after ``now`` with a segment of what changed; None if its number was taken."""
        segment = self._write(changed)
        before = now if now is not None else Version(-1, "", ())
        numbers = [int(n.split(".")[0]) for n in self.versions()]
        number = before.number + 1 if now is not None else max([*numbers, -1]) + 1
        kept = before.batches if batches is None else batches
        v = self._merged(Version(number, head, (*before.segments, segment), (*before.bytes, self._size(segment)), kept))
        return v if self._publish(v) else None

    def _write(self, changed: DataFrame) -> str:
        name = f"s-{uuid.uuid4().hex}"
        to = f"{self.path}/{name}"
        # Written once: what comes after reads it from there, not from the history again.
        rows = changed.withColumns({"tokens": F.struct(*[self.analyzer(c).alias(c) for c in WEIGHTS])})
        rows = rows.withColumn("dl", sum((F.size(F.col("tokens")[c]) for c in WEIGHTS), F.lit(0)).cast("long"))
        rows.write.parquet(f"{to}/changed")
        rows = self.spark.read.parquet(f"{to}/changed")
        rows.select("page_ref").distinct().write.parquet(f"{to}/touched")
        live = rows.where("NOT deleted").drop("deleted")
        live.write.parquet(f"{to}/pages")
        words = self.spark.read.parquet(f"{to}/pages").select("page_ref", "dl", *[F.col("tokens")[c].alias(c) for c in WEIGHTS])
        write_postings(_grouped(words), f"{to}/postings")
        return name

    def _merged(self, v: Version) -> Version:
        """Of the last segments those of like sizes as one, as long as there are ``FAN``."""
        segments, sizes = list(v.segments), list(v.bytes)
        while True:
            run = 1
            while run < len(sizes) and sizes[-run - 1] <= max(SMALL, FAN * sum(sizes[-run:])):
                run += 1
            if run < FAN:
                return Version(v.number, v.head, tuple(segments), tuple(sizes), v.batches)
            old = tuple(segments[-run:])
            name = f"m-{uuid.uuid4().hex}"
            to = f"{self.path}/{name}"
            self._part(old, "pages").write.parquet(f"{to}/pages")
            write_postings(self._part(old, "postings").repartition("term"), f"{to}/postings")
            touched = self.spark.read.parquet(*[f"{self.path}/{s}/touched" for s in old])
            touched.distinct().write.parquet(f"{to}/touched")
            segments[-run:], sizes[-run:] = [name], [self._size(name)]

    def clean(self, keep: int = 2, older: float = 3600) -> list[str]:
        """Remove versions before the last ``keep``, and segments that none of these names and
        that are ``older`` seconds old: younger ones may be a writer's own.  Their names."""
        names = self.versions()
        kept = [v for n in names[-keep:] if (v := self._version(n)) is not None]
        named = {s for v in kept for s in v.segments}
        gone = []
        for n in names[:-keep] if keep else []:
            fs, p = self._file(f"versions/{n}")
            fs.delete(p, False)
            gone.append(n)
        for n in self._names(""):
            fs, p = self._file(n)
            if n != "versions" and n not in named and fs.getFileStatus(p).getModificationTime() / 1000 <= time.time() - older:
                fs.delete(p, True)
                gone.append(n)
        return gone
