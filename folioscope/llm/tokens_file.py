"""Operator 10: token ids in files of patched frame-of-reference blocks.

Documents are dealt to shards by ranges of ``doc_id``, encoded where they are
read, and only their ids are moved.  Each shard is one task's rows in ascending
order, written in segments of about ``segment`` ids: a Parquet row holds the
segment's place, its documents' ids and lengths, and one packed buffer.

Defined results: a null text counts as empty and has the end id alone; documents
with a null id come first, those with equal ids stand in the order of their ids'
bytes; other columns of the input are ignored; an empty table gives no segments.
"""

from __future__ import annotations

import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pfor
from .bpe import byte_signs, signed
from .common import ARROW_SLICE, map_batches, scratch
from .counts import _tokenizer
from .words import Encoded, WordCache, plain

SCHEMA = "shard int, segment int, n_tokens long, doc_ids array<long>, lengths array<long>, packed binary"


class Encoder:
    """Encodes pieces as the tokenizer does, many in one call.

    Plain words are one piece for its pre-tokenizer, so its model gets them straight, as
    what the pre-tokenizer would make of their bytes."""

    def __init__(self, path: str):
        self.tokenizer, self.model = _tokenizer(path), _tokenizer(path, bare=True)
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        #: Ids of two bytes where they all fit.
        self.type = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        # A byte-level token has a character for each of its bytes.
        self.lengths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(n)], np.int64)
        self.signs = byte_signs()
        self.cache = WordCache(self.pieces)

    def pieces(self, words: list[str]) -> Encoded:
        raw, at, pieces = plain(words)
        sizes = np.diff(np.flatnonzero(np.frombuffer(raw + b"\n", np.uint8) == 0x0A)) - 1
        upto = np.cumsum(np.add.reduceat(sizes, np.cumsum(pieces) - pieces)) if len(at) else np.zeros(0, np.int64)
        ids = [np.asarray(e.ids, np.uint32) for e in self.model.encode_batch_fast(signed(raw, self.signs), add_special_tokens=False)]
        first = np.concatenate([np.zeros(0, np.uint32), *ids])
        n = np.zeros(len(words), np.int64)
        n[at] = np.diff(np.searchsorted(np.cumsum(self.lengths[first]), upto, "right"), prepend=0)
        left = np.setdiff1d(np.arange(len(words)), at)
        rest = self._others([words[k] for k in left])
        n[left] = [len(x) for x in rest]
        out = np.zeros(int(n.sum()), np.uint32)
        of_plain = np.zeros(len(words), bool)
        of_plain[at] = True
        of_plain = np.repeat(of_plain, n)
        out[of_plain] = first
        out[~of_plain] = np.fromiter(chain.from_iterable(rest), np.uint32)
        return out, n

    def _others(self, words: list[str]) -> list[list[int]]:
        """Pieces begin with a space or stand alone, so the tokens of several joined are
        those of each; the bytes that tokens stand for tell them apart again."""
        spaced = [k for k, w in enumerate(words) if w[:1] == " " and w[-1] > " "]
        out: list[list[int]] = [[]] * len(words)
        for some in (spaced[k : k + 200] for k in range(0, len(spaced), 200)):
            ids = self.tokenizer.encode_batch_fast(["".join([words[k] for k in some])], add_special_tokens=False)[0].ids
            ends = np.cumsum(self.lengths[ids])
            upto = np.cumsum([len(words[k].encode()) for k in some])
            last = np.searchsorted(ends, upto)
            if ends[-1] != upto[-1] or (ends[last] != upto).any():
                raise ValueError("no byte-level tokenizer")
            bounds = [0, *(last + 1).tolist()]
            for k, a, b in zip(some, bounds, bounds[1:], strict=False):
                out[k] = ids[a:b]
        left = sorted(set(range(len(words))).difference(spaced))
        for k, e in zip(left, self.tokenizer.encode_batch_fast([words[k] for k in left], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def write(docs: DataFrame, tokenizer: str, to: str, end: int = 2, shards: int | None = None, segment: int = 1 << 18, text: str = "text", key: str = "doc_id") -> None:
    """Encode every text and write the ids, each document closed by ``end``."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    # Of the ids alone, so the texts are read and encoded once.
    bounds = rows.agg(F.percentile_approx("doc_id", [k / shards for k in range(1, shards)] or [0.5], 10_000)).first()[0] or []
    bounds = sorted(set(bounds)) if shards > 1 else []
    kind = Encoder(tokenizer).type.str

    def encoded():
        cache = _encoder(tokenizer).cache
        edges = np.array(bounds, np.int64)

        def of(batch):
            ids = batch["doc_id"].to_pylist()
            shard = [0 if i is None else int(np.searchsorted(edges, i, "right")) for i in ids]
            found, n = cache(batch["text"])
            ends = np.cumsum(n)
            closed = np.insert(found, ends, end).astype(kind)
            bounds = np.concatenate([[0], (ends + np.arange(1, len(n) + 1)) * closed.itemsize]).astype(np.int32)
            return {"shard": shard, "doc_id": batch["doc_id"], "ids": pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(bounds), pa.py_buffer(closed)])}

        return of

    dealt = map_batches(rows, encoded, "shard int, doc_id long, ids binary", ARROW_SLICE).repartitionById(len(bounds) + 1, "shard")
    dealt.sortWithinPartitions("shard", "doc_id", "ids").mapInArrow(_segments(segment, kind), SCHEMA).write.option("compression", "none").parquet(to)


def _segments(size: int, kind: str):
    width = np.dtype(kind).itemsize

    def run(batches):
        held: list[tuple[int | None, bytes]] = []
        tokens, shard, number = 0, None, 0

        def closed():
            buffer = np.frombuffer(b"".join(x for _, x in held), kind)
            cols = {"shard": [shard], "segment": [number], "n_tokens": [len(buffer)], "doc_ids": [[i for i, _ in held]], "lengths": [[len(x) // width for _, x in held]], "packed": [pfor.pack(buffer)]}
            types = {"shard": pa.int32(), "segment": pa.int32(), "n_tokens": pa.int64(), "doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()), "packed": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array(cols[c], type=t) for c, t in types.items()], names=list(types))

        for batch in batches:
            for s, i, ids in zip(*(batch[c].to_pylist() for c in ("shard", "doc_id", "ids")), strict=True):
                if held and (s != shard or tokens >= size):
                    yield closed()
                    number = number + 1 if s == shard else 0
                    held, tokens = [], 0
                shard = s
                held.append((i, ids))
                tokens += len(ids) // width
        if held:
            yield closed()

    return run


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    files = spark.read.schema(SCHEMA).parquet(path)
    sizes = files.select("shard", "segment", "n_tokens")
    before = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # One row for each shard, as many as there are files.
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("first"))
    starts = sizes.withColumn("before", before).join(shards, "shard").select("shard", "segment", (F.col("first") + F.col("before")).alias("base"))

    def unpacked():
        def of(batch):
            out = {c: [] for c in ("shard", "segment", "doc_id", "local", "n_tokens", "ids_crc32")}
            for shard, segment, ids, lengths, packed in zip(*(batch[c].to_pylist() for c in ("shard", "segment", "doc_ids", "lengths", "packed")), strict=True):
                raw = memoryview(pfor.unpack(packed).astype("<u4").tobytes())
                at = 0
                for i, n in zip(ids, lengths, strict=True):
                    for c, v in zip(out, (shard, segment, i, at, n, zlib.crc32(raw[4 * at : 4 * (at + n)])), strict=True):
                        out[c].append(v)
                    at += n
            return out

        return of

    docs = map_batches(files, unpacked, "shard int, segment int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of each document, from the files."""

    def unpacked():
        def of(batch):
            out = {"doc_id": [], "ids": []}
            for keys, lengths, packed in zip(*(batch[c].to_pylist() for c in ("doc_ids", "lengths", "packed")), strict=True):
                out["doc_id"] += keys
                out["ids"] += np.split(pfor.unpack(packed).astype(np.int64), np.cumsum(lengths)[:-1])
            return out

        return of

    return map_batches(spark.read.schema(SCHEMA).parquet(path), unpacked, "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """Write the ids to a new folder of the shared one and read them back."""
    to = scratch(docs.sparkSession, "token-ids")
    write(docs, tokenizer, to, end)
    return documents(docs.sparkSession, to)
