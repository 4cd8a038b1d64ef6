"""Words of a batch of texts as numbers: by numpy on the bytes of an Arrow array.

Separators are ASCII bytes, which no other character of UTF-8 holds, so bytes are
enough to find words; nothing becomes a Python object.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


@dataclass
class Words:
    """The words of all texts one after the other."""

    ids: np.ndarray  # of each word its place in ``dictionary``
    dictionary: pa.Array  # the distinct words
    ends: np.ndarray  # the words before each text, and their number at last
    piece: np.ndarray  # of each word the number of its piece, new in each text


class Splitter:
    """Splits texts into words at the bytes ``spaces`` and, for pieces, at ``breaks``;
    ``lower``: A-Z become a-z."""

    def __init__(self, spaces: bytes = SPACES, breaks: bytes = b"", lower: bool = False):
        self.kind = np.zeros(256, np.uint8)
        self.kind[list(spaces)] = 1
        self.kind[list(breaks)] = 2
        self.case = None
        if lower:
            self.case = np.arange(256, dtype=np.uint8)
            self.case[65:91] += 32

    def __call__(self, texts: pa.Array) -> Words:
        """A null text has no words."""
        texts = texts.cast(pa.string()).fill_null("") if len(texts) else pa.array([], pa.string())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        return self.split(raw, at - at[0])

    def split(self, raw: np.ndarray, at: np.ndarray) -> Words:
        """The same for the bytes of texts that begin and end at ``at``."""
        kind = self.kind[raw]
        word = kind == 0
        # A text's first byte has none before it, its last none after it.
        full = at[:-1] < at[1:]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        first[at[:-1][full]] = word[at[:-1][full]]
        last[:-1] &= ~word[1:]
        last[at[1:][full] - 1] = word[at[1:][full] - 1]
        starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        ends = np.searchsorted(starts, at)
        piece = np.searchsorted(np.flatnonzero(kind == 2), starts) + np.repeat(np.arange(len(at) - 1), np.diff(ends))
        body = raw[word]
        if self.case is not None:
            body = self.case[body]
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(stops - starts, out=offsets[1:])
        words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])
        coded = words.dictionary_encode()
        return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, ends, piece)
