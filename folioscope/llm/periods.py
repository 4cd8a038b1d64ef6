"""Operator 13: runs of repeated words, by recompression.

The words of a batch of texts become one string of numbers with a separator of its own
before each text.  Recompression turns it into a run-length grammar: in turn each block
of one repeated symbol and each pair of a left and a right symbol becomes a symbol of
the next level, the sides being dealt anew each time.  Equal stretches are cut alike but
at their ends, so the longest common extension of two places is found by climbing while
symbols agree and descending where they don't, with at most two comparisons a level.

A run of period q and at least four periods holds four places in a row of the grid of
multiples of q, three pairs of neighbours that have the same word; the grids of all
periods have n log n places.  Of each stretch of such pairs every third is a candidate,
and its extensions to both sides tell the run exactly.

Defined results: null, empty and word-less texts have no runs and an empty collapsed
text; equal rows have equal results; rows without id count like others; an empty table
stays empty; other columns pass through, but for those named like the results.  Texts
are worked on whole, in memory of some 150 bytes a word.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ARROW_SLICE, WORD, Names, map_batches
from .wordids import Splitter

#: A run has at least so many periods, and so many words.
TIMES, LEAST = 4, 6
OWN = ("n_words", "runs", "collapsed")
#: Symbols a text may have left at the top level, where they are compared one by one.
TOP = 12
#: Candidates whose extensions are looked up at once.
AT_ONCE = 1 << 19


class Grammar:
    """A run-length grammar of a string of numbers, of which the negative ones stand alone."""

    def __init__(self, string: np.ndarray, lengths: np.ndarray):
        # Of each level: its symbols; of each symbol its parent; of each parent its first
        # child, and the end; whether parents are blocks.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]] = []
        now, new, turn, longest = string.astype(np.int64), int(string.max(initial=0)) + 1, 0, int(lengths.max(initial=0))
        while longest > TOP and turn < 400:
            nxt, parent, first, new = self._blocks(now, new) if turn % 2 == 0 else self._pairs(now, new, turn)
            if len(nxt) < len(now):
                self.levels.append((now, parent, first, turn % 2 == 0))
                now = nxt
                longest = int(np.diff(np.flatnonzero(now < 0)).max(initial=1)) - 1
            turn += 1
        self.top = now

    @staticmethod
    def _parents(heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(heads) - 1, np.r_[np.flatnonzero(heads), len(heads)]

    def _blocks(self, now: np.ndarray, new: int):
        heads = np.r_[True, now[1:] != now[:-1]]
        parent, first = self._parents(heads)
        nxt, size = now[first[:-1]].copy(), np.diff(first)
        many = np.flatnonzero(size > 1)
        if len(many):
            code, known = pd.factorize((nxt[many] << 32) | size[many])
            nxt[many] = new + code
            new += len(known)
        return nxt, parent, first, new

    def _pairs(self, now: np.ndarray, new: int, turn: int):
        # The side of a symbol is a bit of its hash, another one each time.
        with np.errstate(over="ignore"):
            side = ((now.astype(np.uint64) + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) & np.uint64(1)
        left, right = (side == 0) & (now >= 0), (side == 1) & (now >= 0)
        at = np.flatnonzero(left[:-1] & right[1:])
        heads = np.ones(len(now), bool)
        heads[at + 1] = False
        parent, first = self._parents(heads)
        nxt = now[first[:-1]].copy()
        code, known = pd.factorize((now[at] << 32) | now[at + 1])
        nxt[parent[at]] = new + code
        return nxt, parent, first, new + len(known)

    def extension(self, x: np.ndarray, y: np.ndarray, way: int) -> np.ndarray:
        """How many symbols from places x and y on are equal: ``way`` 1 to the right, -1 to
        the left.  A separator between or beyond them ends it."""
        begin, x, y = x, x.copy(), y.copy()
        stopped = np.full(len(x), len(self.levels))

        def step(level, some):
            """Past what is equal there: one symbol, or what both have left of a block."""
            symbols, parent, first, blocks = level
            by = 1
            if blocks:
                px, py = parent[x[some]], parent[y[some]]
                by = np.minimum(first[px + 1] - x[some], first[py + 1] - y[some]) if way > 0 else np.minimum(x[some] - first[px], y[some] - first[py]) + 1
            x[some] += way * by
            y[some] += way * by

        def within(level, some):
            """Where a parent's children are only in part ahead."""
            _, parent, first, _ = level
            if way > 0:
                return (first[parent[x[some]]] != x[some]) | (first[parent[y[some]]] != y[some])
            return (first[parent[x[some]] + 1] - 1 != x[some]) | (first[parent[y[some]] + 1] - 1 != y[some])

        on = np.arange(len(x))
        for k, level in enumerate(self.levels):
            symbols, parent, _, _ = level
            inside = on[within(level, on)]
            same = symbols[x[inside]] == symbols[y[inside]]
            stopped[inside[~same]] = k
            inside = inside[same]
            step(level, inside)
            stopped[inside[within(level, inside)]] = k  # one block is longer: what follows differs
            on = on[stopped[on] == len(self.levels)]
            x[on], y[on] = parent[x[on]], parent[y[on]]
        same = on
        while len(same):
            same = same[self.top[x[same]] == self.top[y[same]]]
            x[same] += way
            y[same] += way
        for k in range(len(self.levels) - 1, -1, -1):
            symbols, _, first, _ = level = self.levels[k]
            some = np.flatnonzero(stopped > k)
            x[some], y[some] = (first[x[some]], first[y[some]]) if way > 0 else (first[x[some] + 1] - 1, first[y[some] + 1] - 1)
            step(level, some[symbols[x[some]] == symbols[y[some]]])
        return (x - begin) * way


def candidates(string: np.ndarray, base: np.ndarray, size: np.ndarray, times: int, least: int):
    """(place, period) where a run may be: of each period's grid the pairs of neighbours with
    one word, of stretches of ``times - 1`` or more every ``times - 1``th."""
    order = np.argsort(-size, kind="stable")
    base, size = base[order], size[order]
    deep = times - 1
    for q in range(1, int(size.max(initial=0)) // times + 1):
        docs = int(np.searchsorted(-size, -max(least, times * q), "right"))
        places = (size[:docs] - 1) // q + 1
        before = np.cumsum(places) - places
        at = np.arange(int(places.sum())) * q + np.repeat(base[:docs] - before * q, places)
        same = string[at[:-1]] == string[at[1:]]
        same[before[1:] - 1] = False
        pairs = np.flatnonzero(same)
        if len(pairs) < deep:
            continue
        # Stretches of neighbouring pairs, and the place of each pair in its own.
        fresh = np.r_[True, np.diff(pairs) != 1]
        place = np.arange(len(pairs)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        chosen = pairs[place % deep == deep - 1]
        if len(chosen):
            yield at[chosen], q


def runs_of(ids: np.ndarray, ends: np.ndarray, times: int = TIMES, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text, start and period: stretches of
    ``times`` periods and ``least`` words at least that no neighbour extends."""
    n = len(ends) - 1
    size = np.diff(ends)
    string = np.empty(len(ids) + n + 1, np.int64)
    base = ends[:-1] + np.arange(1, n + 1)
    marks = np.r_[base - 1, len(string) - 1]
    words = np.ones(len(string), bool)
    words[marks] = False
    string[words], string[marks] = ids, -1 - np.arange(n + 1)
    found, grammar, held = [], None, []

    def extend():
        place, q = np.concatenate([p for p, _ in held]), np.concatenate([np.full(len(p), q) for p, q in held])
        start = place - grammar.extension(place - 1, place + q - 1, -1)
        stop = place + q + grammar.extension(place, place + q, 1)
        some = stop - start >= np.maximum(least, times * q)
        found.append(np.stack([start[some], stop[some], q[some]]))
        held.clear()

    for one in candidates(string, base, size, times, least):
        grammar = grammar or Grammar(string, size)
        held.append(one)
        if sum(len(p) for p, _ in held) >= AT_ONCE:
            extend()
    if held:
        extend()
    start, stop, q = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    # Of equal stretches the smallest period counts: the others are its multiples.
    order = np.lexsort((q, stop, start))
    start, stop, q = start[order], stop[order], q[order]
    first = np.r_[True, (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])][: len(start)]
    start, stop, q = start[first], stop[first], q[first]
    order = np.lexsort((q, start))
    start, stop, q = start[order], stop[order], q[order]
    text = np.searchsorted(marks, start, "right") - 1
    return text, start - base[text] if n else start, stop - start, q


def _found(times: int, least: int):
    split = Splitter()

    def of(batch: pa.RecordBatch) -> dict:
        w = split(batch["__text"])
        text, start, length, period = runs_of(w.ids, w.ends, times, least)
        n = len(w.ends) - 1
        # What repeats goes: from the second period of each run on.
        fall = np.zeros(len(w.ids) + 1, np.int64)
        np.add.at(fall, w.ends[text] + start + period, 1)
        np.add.at(fall, w.ends[text] + start + length, -1)
        kept = np.flatnonzero(np.cumsum(fall)[:-1] == 0)
        offsets = np.searchsorted(kept, w.ends).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), w.dictionary.take(pa.array(w.ids[kept])))
        spans = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
        runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32)), spans)
        return {c: batch[c] for c in batch.schema.names if c != "__text"} | {"__n": np.diff(w.ends), "__runs": runs, "__kept": pc.binary_join(lists, " ")}

    return of


def find(docs: DataFrame, text: str = "text", times: int = TIMES, least: int = LEAST, own: tuple[str, ...] = OWN) -> DataFrame:
    """The rows with n_words, runs (array of start, length and period, by start, then period)
    and collapsed, the text with only the first period of each run, by the names ``own``;
    columns of the input with these names go, and so does the text."""
    if times < 3:
        raise ValueError("a run must have three periods at least")
    carried = [c for c in docs.columns if c not in (*own, text)]
    # Names of the input don't reach the task, so that none can clash.
    rows = docs.select(F.col(text).alias("__text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)])
    kept = "".join(f"c{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(carried))
    out = map_batches(rows, lambda: _found(times, least), kept + "__n long, __runs array<struct<start: long, length: long, period: long>>, __kept string", ARROW_SLICE)
    return out.toDF(*carried, *own)


def longest(runs: str | Column) -> Column:
    """The run with the greatest length, of these the first start, then the smallest period."""
    runs = F.col(runs) if isinstance(runs, str) else runs
    ranked = F.transform(runs, lambda r: F.struct(-r["length"], r["start"], r["period"]))
    best = F.array_min(ranked)
    return F.when(F.size(runs) > 0, F.struct(best["start"].alias("start"), (-best["col1"]).alias("length"), best["period"].alias("period")))


def made_periodic(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows, of which those whose id's crc32 is divisible by ten have, from some word on, a
    text that repeats: word i >= a is original word a + (i - a) mod p, where g = crc32 div 10,
    a = g mod n and p = 1 + (n - a) div (3 + g mod 8)."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    w = Names(docs.columns).words
    n = F.size(w).cast("long")
    a = (g % n).cast("int")
    rest = n - a
    p = (1 + F.floor(rest / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil(rest / p).cast("int")))
    made = F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(again, F.lit(1), rest.cast("int"))), " ")
    held = docs.withColumn(w, F.when((h % 10 == 0) & F.col(text).isNotNull(), words))
    return held.withColumn(text, F.when(n > 0, made).otherwise(F.col(text))).drop(w)
