"""Operator 9: token counts, huge documents by overlapping chunks.

A text of more than ``huge`` characters is cut into chunks that overlap, each a
row of its own, so that one document is spread over many tasks.  Every chunk is
encoded with offsets.  Two neighbours are spliced at a place that both encodings
start a token at and that white space stands before: the normaliser and the
pre-tokenizer never look across white space and no special token holds any, so
what is right of it depends on nothing to the left, and the other way round.
Documents with an overlap that has no such place run again with a wider one, up
to the whole text.

Defined results: a null text counts as empty (0 bytes, 0 tokens); rows with equal
or null ids are counted one by one; other columns of the input are ignored.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_signs, signed
from .common import ARROW_SLICE, cut, map_batches
from .words import Encoded, WordCache, plain


@lru_cache(maxsize=4)
def _tokenizer(path: str, bare: bool = False):
    """The tokenizer of a file; ``bare``: its model alone, over pieces between white space."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import WhitespaceSplit

    t = Tokenizer.from_file(path)
    if bare:
        t = Tokenizer(t.model)
        t.pre_tokenizer = WhitespaceSplit()
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def _lengths(path: str) -> WordCache:
    """A cache whose single id of a piece is its number of tokens."""
    t, bare, signs = _tokenizer(path), _tokenizer(path, bare=True), byte_signs()
    # The last token of a piece tells so.
    last = np.array([str(t.id_to_token(i)).endswith(t.model.end_of_word_suffix) for i in range(t.get_vocab_size())])

    def of(words: list[str]) -> Encoded:
        n = np.zeros(len(words), np.uint32)
        # The normaliser makes small letters of plain words and changes nothing else.
        raw, at, pieces = plain([w.lower() for w in words])
        if len(at):
            found = bare.encode_batch_fast(signed(raw.replace(b"\n ", b"\n"), signs), add_special_tokens=False)
            each = np.diff(np.flatnonzero(last[np.concatenate([e.ids for e in found])]), prepend=-1)
            n[at] = np.add.reduceat(each, np.cumsum(pieces) - pieces)
        left = np.setdiff1d(np.arange(len(words)), at)
        # Joined by line ends, that belong to no token; offsets tell whose a token is.
        for some in (left[k : k + 200] for k in range(0, len(left), 200)):
            starts = np.array([a for a, _ in t.encode("\n".join([words[k] for k in some]), add_special_tokens=False).offsets], np.int64)
            upto = np.cumsum([len(words[k]) + 1 for k in some])
            n[some] = np.diff(np.searchsorted(starts, upto), prepend=0)
        return n, np.ones(len(words), np.int64)

    return WordCache(of)


def count(docs: DataFrame, path: str, limit: int = 2048, huge: int = 32768, step: int = 16384, overlap: int = 256, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every whole text.

    ``huge``: characters from which a text is cut; ``step``: characters from one
    chunk's start to the next one's; ``overlap``: characters shared at first.
    """
    if not 0 < overlap <= step:
        raise ValueError("the overlap must be positive and no more than the step")
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    is_huge = F.length("text") > huge

    def small():
        cache = _lengths(path)

        def of(batch):
            each, pieces = cache(batch["text"])
            n = np.diff(np.concatenate([[0], np.cumsum(each, dtype=np.int64)])[np.cumsum(pieces)], prepend=0)
            return {"key": batch["key"], "n_bytes": pc.binary_length(batch["text"]).cast("int64"), "n_tokens": n}

        return of

    whole = map_batches(rows.where(~is_huge), small, f"key {kind}, n_bytes long, n_tokens long", ARROW_SLICE)
    # Written once with their numbers, which name the documents across runs.
    large = cut(rows.where(is_huge).withColumn("uid", F.monotonically_increasing_id()))
    done: list[DataFrame] = []
    while True:
        found = cut(_spliced(large, path, step, overlap, kind))
        done.append(found.where("ok").select("key", "n_bytes", "n_tokens"))
        failed = found.where(~F.col("ok")).select("uid")
        if not failed.take(1):
            break
        large = large.join(failed, "uid", "left_semi")
        step, overlap = step * 4, overlap * 8
        step = max(step, overlap)
    out = whole
    for d in done:
        out = out.unionByName(d)
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _spliced(large: DataFrame, path: str, step: int, overlap: int, kind: str) -> DataFrame:
    """(uid, key, n_bytes, n_tokens, ok): counts from chunks; ok is false where two
    neighbours have no common stable boundary."""

    def chunks():
        def of(batch):
            out = []
            for uid, key, text in zip(batch["uid"].to_pylist(), batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True):
                starts = range(0, max(1, len(text) - overlap), step)
                parts = [text[s : s + step + overlap] for s in starts]
                out.append({"uid": [uid] * len(parts), "key": [key] * len(parts), "n_bytes": [len(text[s : s + step].encode()) for s in starts][:-1] + [len(text[starts[-1] :].encode())], "k": list(range(len(parts))), "last": [k == len(parts) - 1 for k in range(len(parts))], "part": parts})
            return out

        return of

    def encoded():
        t = _tokenizer(path)

        def of(batch):
            cols = {n: [] for n in ("total", "head", "tail")}
            ks, lasts = batch["k"].to_pylist(), batch["last"].to_pylist()
            for k, last, part in zip(ks, lasts, batch["part"].to_pylist(), strict=True):
                starts = np.array([a for a, _ in t.encode(part, add_special_tokens=False).offsets], np.int64)
                cols["total"].append(len(starts))
                places = [p for p in dict.fromkeys(starts.tolist()) if p and part[p - 1] in " \t\n\r"]
                before = dict(zip(places, np.searchsorted(starts, places).tolist(), strict=True))
                cols["head"].append([(k * step + p, n) for p, n in before.items() if k and p < overlap])
                cols["tail"].append([(k * step + p, n) for p, n in before.items() if not last and p >= step])
            return {n: batch[n] for n in ("uid", "key", "n_bytes", "k", "last")} | cols

        return of

    cut_up = map_batches(large.select("uid", "key", "text"), chunks, f"uid long, key {kind}, n_bytes long, k int, last boolean, part string")
    pairs = "array<struct<at: long, n: long>>"
    parts = map_batches(cut_up.repartition("uid", "k"), encoded, f"uid long, key {kind}, n_bytes long, k int, last boolean, total long, head {pairs}, tail {pairs}")
    w = Window.partitionBy("uid").orderBy("k")
    # The first place that the chunk and the one after it have in common.
    with_next = parts.withColumn("next", F.lead("head").over(w))
    at = F.expr("array_min(array_intersect(transform(tail, x -> x.at), transform(next, x -> x.at)))")
    told = with_next.withColumn("at", at)
    told = told.withColumn("upto", F.when(F.col("last"), F.col("total")).otherwise(F.expr("element_at(map_from_entries(tail), at)")))
    told = told.withColumn("since", F.when(F.col("last"), F.lit(0)).otherwise(F.expr("element_at(map_from_entries(next), at)")))
    ok = F.col("last") | F.col("at").isNotNull()
    # Tokens before each splice in the left chunk, less those before it in the right one.
    return told.groupBy("uid", "key").agg(F.sum("n_bytes").alias("n_bytes"), F.sum(F.col("upto") - F.col("since")).alias("n_tokens"), F.bool_and(ok).alias("ok"))
