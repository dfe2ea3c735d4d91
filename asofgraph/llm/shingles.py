"""Word shingles of whole texts as sorted 64-bit sets, computed column-wise over a batch's bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from asofgraph.llm.common import splitmix

_U = np.uint64
#: An odd multiplier and its inverse modulo 2**64, so that a word's hash doesn't depend on its place.
_M = 0x9E3779B97F4A7C15
_INVERSE = pow(_M, -1, 1 << 64)
_LETTER = splitmix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1B54A32D192ED03))
_LETTER[65:91] = _LETTER[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for name, base in (("up", _M), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (nulls empty) and its n + 1 offsets."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lowered, n + 1 offsets of each row's words)."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:]))
    up, down = _power_table(n)
    with np.errstate(over="ignore"):
        running = _LETTER[data]
        running *= up
        np.cumsum(running, out=running)
        hashes = running[ends]
        hashes -= np.where(starts > 0, running[starts - 1], _U(0))
        hashes *= down[starts]
        hashes = splitmix(hashes + (ends - starts + 1).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes row after row, n + 1 offsets).

    A row with fewer than ``width`` words has its whole word sequence as its one shingle; a row
    without words (or null) has none.
    """
    word, at = words(*text_bytes(column))
    counts = np.diff(at)
    sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_at = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(out_at[-1], np.uint64)
    with np.errstate(over="ignore"):
        if len(word) >= width:
            rolled = np.full(len(word) - width + 1, _U(width))
            for j in range(width):
                rolled = rolled * _U(_M) + word[j:len(word) - width + 1 + j]
            rolled = splitmix(rolled)
            row = np.repeat(np.arange(len(counts)), sizes)
            full = counts[row] >= width
            place = np.arange(len(out)) - out_at[row] + at[row]
            out[full] = rolled[place[full]]
        for k in range(1, width):
            short = np.flatnonzero(counts == k)
            value = np.full(len(short), _U(k))
            for j in range(k):
                value = value * _U(_M) + word[at[short] + j]
            out[out_at[short]] = splitmix(value)
    for a, b in zip(out_at[:-1].tolist(), out_at[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[out_at[:-1][sizes > 0]] = True
    return out[keep], np.concatenate(([0], np.cumsum(keep)))[out_at]
