"""Operator 3: byte-pair encoding by backtracking, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary gives the longest token at each
place of a piece.  Tokens are taken from left to right; a token stands only if it
is compatible with the one before it, that is if the merges of the vocabulary
would keep the boundary between the two.  Else the next shorter token is tried,
and where none is left the token before is taken back and its end is marked as a
dead end.  Each end is given up once at most, so the time is linear, and the
result is that of the merges (ids of merges must stand in the order of merging).

Defined results: a null text counts as empty and has no tokens; special tokens in
the text become their ids, as the library does by default; equal texts get equal
rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import ARROW_SLICE, map_batches
from .words import Encoded, WordCache, plain

#: Fixed values of the byte-level scheme: the bytes that stand for themselves.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Fixed value of the scheme: the pattern that splits text before the merges.
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _alphabet() -> dict[str, int]:
    """The character that the file writes for each byte."""
    signs = {chr(b): b for b in _PLAIN}
    return signs | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}


def byte_signs() -> np.ndarray:
    """By byte the code of the character that the file writes for it, line ends as they are."""
    out = np.zeros(256, "<u4")
    for c, b in _alphabet().items():
        out[b] = ord(c)
    out[0x0A] = 0x0A
    return out


def signed(raw: bytes, signs: np.ndarray, size: int = 2000) -> list[str]:
    """The bytes as the file writes them, in strings of ``size`` or a few more, cut at line ends."""
    out, at = [], 0
    while at < len(raw):
        end = raw.find(b"\n", at + size)
        end = len(raw) if end < 0 else end
        out.append(signs[np.frombuffer(raw[at:end], np.uint8)].tobytes().decode("utf-32-le"))
        at = end
    return out


class Vocabulary:
    """The tables of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, sign = file["model"], _alphabet()
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        ids = {t: i for t, i in model["vocab"].items() if t not in self.special}
        raw = {i: bytes(sign[c] for c in t) for t, i in ids.items()}
        self.bytes = [raw.get(i, b"") for i in range(max([*raw, *self.special.values()]) + 1)]
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        last = -1
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            pair, i = (ids[a], ids[b]), ids[a + b]
            if i <= max(last, *pair):
                raise ValueError("ids of merges must stand in the order of merging")
            last = i
            self.merged.setdefault(pair, i)
            self.parts.setdefault(i, pair)
        known = {t: i for i, t in raw.items()}
        #: The longest token that a token begins with, -1 if there is none.
        self.shorter = {i: next((known[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in known), -1) for i, t in raw.items()}
        self.automaton = ahocorasick.Automaton()
        for i, t in raw.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()
        self.single = known
        self._fits: dict[int, bool] = {}  # by the pair as one number
        lengths = np.array([len(b) for b in self.bytes], np.int64)
        #: Decoding: the bytes of all tokens in one string, and where each starts.
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.lengths, self.offsets = lengths, np.concatenate([[0], np.cumsum(lengths)])
        self.digits = [str(i) for i in range(len(self.bytes))]
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both tokens keeps the boundary between them.

        Undoing the latest merge on either side again and again shows each pair
        that met at the boundary while both were built; a merge of such a pair that
        comes before the one undone would have crossed the boundary."""
        key = a << 32 | b
        found = self._fits.get(key)
        if found is None:
            if len(self._fits) > 300_000:
                self._fits = {}
            found = self._fits[key] = self._kept(a, b)
        return found

    def _kept(self, a: int, b: int) -> bool:
        undone = len(self.bytes) + 1  # the merge whose undoing led to this pair
        while True:
            if self.merged.get((a, b), undone) < undone:
                return False
            left, right = self.parts.get(a), self.parts.get(b)
            if left is None and right is None:
                return True
            # Of two equal tokens the left one was merged first, so the right one is undone first.
            if right is None or left is not None and a > b:
                undone, a = a, left[1]
            else:
                undone, b = b + 1, right[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """The tokens of one piece of the pattern."""
        whole = self.single.get(piece)
        if whole is not None:  # a token is what the merges make of its own bytes
            return [whole]
        n = len(piece)
        longest = [-1] * (n + 1)
        size = [0] * (n + 1)
        for end, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            start = end - length + 1
            if length > size[start]:
                size[start], longest[start] = length, token
        open_ends = [True] * (n + 1)
        tokens: list[int] = []
        spans, shorter, fits = self.bytes, self.shorter, self.fits
        at, token = 0, longest[0]
        while at < n:
            before = tokens[-1] if tokens else -1
            while token >= 0:
                end = at + len(spans[token])
                if open_ends[end] and (before < 0 or fits(before, token)):
                    break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                at, token = end, longest[end]
            else:
                open_ends[at] = False
                token = tokens.pop()
                at -= len(spans[token])
        return tokens

    def encode(self, text: str) -> list[int]:
        """The tokens of a text, special ones included."""
        out: list[int] = []
        for part in self.splitter.split(text) if any(t in text for t in self.special) else [text]:
            if part in self.special:
                out.append(self.special[part])
            else:
                for piece in _PATTERN.findall(part):
                    out += self.encode_piece(piece.encode())
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of the tokens; bytes that are no UTF-8 become U+FFFD."""
        if not len(ids):
            return ""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        places = np.arange(ends[-1]) + np.repeat(self.offsets[ids] - (ends - lengths), lengths)
        return self.blob[places].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per worker and file."""
    return Vocabulary(path)


@lru_cache(maxsize=2)
def _cache(path: str) -> WordCache:
    v = vocabulary(path)

    def of(words: list[str]) -> Encoded:
        found: list[list[int]] = [[]] * len(words)
        raw, at, pieces = plain(words)
        each = map(v.encode_piece, raw.split(b"\n")[1:])
        for k, n in zip(at.tolist(), pieces.tolist(), strict=True):
            found[k] = next(each) if n == 1 else next(each) + next(each)
        for k in np.setdiff1d(np.arange(len(words)), at).tolist():
            found[k] = v.encode(words[k])
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum())), n

    return WordCache(of)


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried columns, ids, n_tokens): the token ids of every whole text."""
    kept = (key, *(c for c in carry if c in docs.columns))

    def make():
        cache = _cache(path)

        def of(batch):
            ids, n = cache(batch[text])
            return {c: batch[c] for c in kept} | {"ids": pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), ids.astype(np.int32)), "n_tokens": n}

        return of

    columns = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return map_batches(docs.select(*kept, text), make, f"{columns}, ids array<int>, n_tokens long", ARROW_SLICE)


def decode(tokens: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, text): the text of each row of ids; null ids have a null text."""

    def make():
        v = vocabulary(path)

        def of(batch):
            return {key: batch[key], "text": [None if x is None else v.decode(np.array(x, np.int64)) for x in batch["ids"].to_pylist()]}

        return of

    return map_batches(tokens.select(key, "ids"), make, f"`{key}` {tokens.schema[key].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row n_tokens, ids_sha256 and decoded_sha256, in one pass: encoded, then
    decoded from the ids, without moving either between processes."""

    def make():
        v, cache = vocabulary(path), _cache(path)

        def of(batch):
            found, n = cache(batch[text])
            ids, back = [], []
            for a in np.split(found, np.cumsum(n)[:-1]):
                ids.append(hashlib.sha256(",".join(map(v.digits.__getitem__, a.tolist())).encode()).hexdigest())
                back.append(hashlib.sha256(v.decode(a.astype(np.int64)).encode()).hexdigest())
            return {key: batch[key], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": back}

        return of

    return map_batches(docs.select(key, text), make, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", ARROW_SLICE)
