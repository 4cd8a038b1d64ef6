"""Exact reuse of work on repeated words, for tokenizers that split text at spaces.

A text is cut before each single space between two characters that are not white
space.  There the byte-level pattern always starts a new match (no alternative
holds a space anywhere but at its start, and white space runs end there), and no
special token holds a space: so the tokens of the text are those of the pieces.

Arrow splits a batch and finds its distinct words; each of these is looked up once,
and numpy puts the ids of all pieces together.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space by any of the definitions in play, so that a cut is never unsafe.
_BLANK = frozenset(chr(c) for c in range(0x10000) if chr(c).isspace()) | frozenset("\x85᠎​‌‍⁠﻿")
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 0xC3, *range(0x80, 0xC0)]] = True
_MARK[[*b".,;:!?"]] = True

Encoded = tuple[np.ndarray, np.ndarray]  # ids one after the other, how many each piece has


def plain(words: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words that every pre-tokenizer here takes as one piece, the space before them
    included, and a mark after them as another: a space, then letters of ASCII or those
    of two bytes from C3 on, then one of . , ; : ! ? or nothing.

    Gives the words' bytes with a line end before each piece, the places of these words
    in the list, and how many pieces each is."""
    raw = np.frombuffer("".join(words).encode("utf-8", "surrogatepass"), np.uint8)
    size = np.fromiter((len(w) if w.isascii() else len(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words))
    if not len(raw):
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum(size)
    begins = ends - size
    wrong = ~_LETTER[raw]
    wrong[1:] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))  # no letters
    wrong[1:] |= (raw[1:] & 0xC0 == 0x80) & (raw[:-1] & 0xC0 == 0x80)  # of three bytes
    many = np.diff(np.concatenate([[0], np.cumsum(wrong)])[np.concatenate([[0], ends])])
    marked = (size > 0) & _MARK[raw[ends - 1]]
    good = (size - marked > 1) & (raw[np.minimum(begins, len(raw) - 1)] == 0x20) & (many == 1 + marked)
    at = np.flatnonzero(good)
    used = np.repeat(good, size)
    cuts = np.sort(np.concatenate([begins[at], ends[at[marked[at]]] - 1]))
    place = np.cumsum(used) - used  # of each byte among those of the words
    return np.insert(raw[used], place[cuts], 0x0A).tobytes(), at, 1 + marked[at]


class WordCache:
    """Encodes pieces once and keeps their ids, in ``limit`` bytes or little more.

    Full, it starts anew.  Pieces of more than ``longest`` characters aren't kept:
    such text, without spaces, hardly repeats."""

    def __init__(self, encode: Callable[[list[str]], Encoded], limit: int = 64 << 20, longest: int = 64):
        self.encode, self.limit, self.longest = encode, limit, longest
        self._clear()

    def _clear(self) -> None:
        self.bytes = 0
        self.spaced: dict[str, int] = {}  # entry of a piece that begins with a space, by the rest of it
        self.whole: dict[str, int] = {}  # entry of any other piece
        self.kept = 0  # entries that stay after this batch
        self.pool, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)

    def _add(self, words: list[str]) -> int:
        """Encode words into new entries; the number of the first."""
        ids, n = self.encode(words)
        at = self.kept
        start = int(self.ends[at - 1]) if at else 0
        self.pool = _room(self.pool, start + len(ids))
        self.pool[start : start + len(ids)] = ids
        self.ends = _room(self.ends, at + len(n))
        self.ends[at : at + len(n)] = start + np.cumsum(n)
        return at

    def _entries(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each piece, and how many pieces there are up to each text's end."""
        if self.bytes > self.limit:
            self._clear()
        parts = pc.split_pattern(texts, " ")
        bounds = parts.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        first = np.zeros(int(bounds[-1]), bool)
        first[bounds[:-1]] = True  # a text has one part at least
        coded = parts.flatten().dictionary_encode()
        code, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        entry = np.fromiter(map(self.spaced.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(entry < 0)
        # A cut is safe between characters that are not white space; kept words have none at their ends.
        blank_first, blank_last = np.zeros(len(words), bool), np.zeros(len(words), bool)
        some = [words[k] for k in unknown]
        blank_first[unknown] = [not w or w[0] in _BLANK for w in some]
        blank_last[unknown] = [not w or w[-1] in _BLANK for w in some]
        head = first.copy()
        head[1:] |= ~(blank_last[code[:-1]] | blank_first[code[1:]])
        begins = np.flatnonzero(head)
        size = np.diff(begins, append=len(code))
        lone = (size == 1) & ~first[begins]
        used = np.zeros(len(words), bool)
        used[code[begins[lone]]] = True
        # Others are looked up as they are: a text's beginning, and pieces with further spaces.
        others = [("" if first[b] else " ") + (words[code[b]] if s == 1 else " ".join([words[c] for c in code[b : b + s]])) for b, s in zip(begins[~lone].tolist(), size[~lone].tolist(), strict=True)]
        new = unknown[used[unknown]]
        short = np.array([len(words[k]) <= self.longest for k in new], bool)
        # Long ones aren't kept: they stand last, and the next batch writes over them.
        new = np.concatenate([new[short], new[~short]])
        n = int(short.sum())
        spaced = [words[k] for k in new]
        strange = sorted({p for p in others if p not in self.whole}, key=lambda p: len(p) > self.longest)
        m = sum(len(p) <= self.longest for p in strange)
        passing: dict[str, int] = {}
        if spaced or strange:
            at = self._add([" " + w for w in spaced[:n]] + strange[:m] + [" " + w for w in spaced[n:]] + strange[m:])
            entry[new] = np.concatenate([np.arange(at, at + n), np.arange(at + n + m, at + m + len(new))])
            self.spaced.update(zip(spaced[:n], range(at, at + n), strict=True))
            self.whole.update(zip(strange[:m], range(at + n, at + n + m), strict=True))
            passing = dict(zip(strange[m:], range(at + m + len(new), at + len(new) + len(strange)), strict=True))
            self.kept = at + n + m
            # A string, its slots and its ids.
            self.bytes += 200 * (n + m) + sum(map(len, spaced[:n])) + sum(map(len, strange[:m]))
            self.bytes += 4 * int(self.ends[self.kept - 1] - (self.ends[at - 1] if at else 0)) if n + m else 0
        out = np.empty(len(begins), np.int64)
        out[lone] = entry[code[begins[lone]]]
        whole = self.whole
        out[~lone] = [whole[p] if p in whole else passing[p] for p in others]
        return out, np.searchsorted(begins, bounds[1:])

    def __call__(self, texts: pa.Array) -> Encoded:
        """The ids of all texts one after the other, and how many each has; null is empty."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        entry, upto = self._entries(pc.fill_null(texts, ""))
        begin = np.where(entry > 0, self.ends[entry - 1], 0)
        n = self.ends[entry] - begin
        ends = np.cumsum(n)
        ids = self.pool[np.arange(ends[-1]) + np.repeat(begin - (ends - n), n)]
        return ids, np.diff(ends[upto - 1], prepend=0)


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """The array, or a copy with room for ``n``."""
    if n <= len(a):
        return a
    grown = np.zeros(max(n, 2 * len(a)), a.dtype)
    grown[: len(a)] = a
    return grown
