"""Patched frame-of-reference coding of token ids.

A buffer holds a header, an index of block starts, and blocks.  A block has the
minimum of its values; the values less that minimum, packed at the width that a
given share of them fits in; and the list of exceptions, each a place and the
whole difference.  Any block is read by itself through the index.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"FPF1"
_HEAD = struct.Struct("<4sIHI")  # magic, values, values in a block, blocks
_FIX = 6  # bytes of a block before the packed values: minimum, width, exceptions


def pack(values: np.ndarray, block: int = 128, share: float = 0.9) -> bytes:
    """The buffer of unsigned 32-bit values; ``block`` is a multiple of 8, 248 at most."""
    if block % 8 or not 0 < block < 256:
        raise ValueError("block must be a multiple of 8 below 256")
    v = np.ascontiguousarray(values, np.uint32)
    n, nb = len(v), -(-len(v) // block)
    if not nb:
        return _HEAD.pack(MAGIC, 0, block, 0) + np.zeros(1, "<u4").tobytes()
    v = np.concatenate([v, np.full(nb * block - n, v[-1], np.uint32)]).reshape(nb, block)
    low = v.min(1)
    d = v - low[:, None]
    bits = np.frexp(d.astype(np.float64))[1].astype(np.int8)  # bits that a value needs, 0 for 0
    at = min(block - 1, max(0, int(np.ceil(share * block)) - 1))
    width = np.partition(bits, at, axis=1)[:, at].astype(np.int64)
    out_of = bits > width[:, None]
    count = out_of.sum(1)
    packed = width * (block // 8)
    starts = np.concatenate([[0], np.cumsum(_FIX + packed + 5 * count)])
    body = np.zeros(starts[-1], np.uint8)
    s = starts[:-1]
    body[s[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    body[s + 4], body[s + 5] = width, count
    d_in = np.where(out_of, 0, d)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        size = 2 if w <= 16 else 4
        raw = d_in[rows].astype(f"<u{size}").view(np.uint8)
        if w < 8 * size:
            ones = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(rows), block, 8 * size)
            raw = np.packbits(ones[:, :, :w].reshape(len(rows), -1), axis=1, bitorder="little")
        body[s[rows][:, None] + _FIX + np.arange(w * block // 8)] = raw
    r, place = np.nonzero(out_of)
    if len(r):
        rank = np.arange(len(r)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        base = s[r] + _FIX + packed[r]
        body[base + rank] = place
        body[(base + count[r] + 4 * rank)[:, None] + np.arange(4)] = d[r, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return _HEAD.pack(MAGIC, n, block, nb) + starts.astype("<u4").tobytes() + body.tobytes()


def _parts(buffer: bytes) -> tuple[int, int, np.ndarray, np.ndarray]:
    magic, n, block, nb = _HEAD.unpack_from(buffer)
    if magic != MAGIC:
        raise ValueError("not a buffer of this format")
    starts = np.frombuffer(buffer, "<u4", nb + 1, _HEAD.size).astype(np.int64)
    return n, block, starts, np.frombuffer(buffer, np.uint8, starts[-1], _HEAD.size + 4 * (nb + 1))


def _blocks(body: np.ndarray, s: np.ndarray, block: int) -> np.ndarray:
    """Values of the blocks that start at ``s``, a row each."""
    low = body[s[:, None] + np.arange(4)].view("<u4").ravel()
    width, count = body[s + 4].astype(np.int64), body[s + 5].astype(np.int64)
    d = np.zeros((len(s), block), np.uint32)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        raw = body[s[rows][:, None] + _FIX + np.arange(w * block // 8)]
        size = 2 if w <= 16 else 4
        if w < 8 * size:
            wide = np.zeros((len(rows), block, 8 * size), np.uint8)
            wide[:, :, :w] = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(rows), block, w)
            raw = np.packbits(wide.reshape(len(rows), -1), axis=1, bitorder="little")
        d[rows] = raw.view(f"<u{size}")
    if count.any():
        r = np.repeat(np.arange(len(s)), count)
        rank = np.arange(len(r)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        base = s[r] + _FIX + width[r] * (block // 8)
        d[r, body[base + rank]] = body[(base + count[r] + 4 * rank)[:, None] + np.arange(4)].view("<u4").ravel()
    return d + low[:, None]


def unpack(buffer: bytes) -> np.ndarray:
    """All values of a buffer."""
    n, block, starts, body = _parts(buffer)
    return _blocks(body, starts[:-1], block).ravel()[:n] if n else np.zeros(0, np.uint32)


def block_at(buffer: bytes, number: int) -> np.ndarray:
    """The values of one block, through the index."""
    n, block, starts, body = _parts(buffer)
    return _blocks(body, starts[number : number + 1], block)[0][: n - number * block]
