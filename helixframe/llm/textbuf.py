"""Vector arithmetic over the bytes of many texts at once, for the repeat finders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}

#: ASCII white space, the only bytes that separate words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i < n."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, n.bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            f = np.full(size, base, U)
            f[0] = 1
            _powers[name] = np.cumprod(f)
    return _powers["up"][:n], _powers["down"][:n]


class RollingHash:
    """Hashes of ranges of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray):
        up, self.down = powers(len(symbols) + 1)
        self.sums = np.concatenate((np.zeros(1, U), np.cumsum(symbols * up[: len(symbols)])))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of [start, end), the same wherever the same symbols stand."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U) * U(0xA24BAED4963EE407))


def slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) for runs of whole texts of about ``limit`` bytes."""
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if not len(column):
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), len(column))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def grams(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one number; zeros follow the last byte."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    return np.ndarray(len(raw), "<u8", padded.data, 0, (1,)).copy()


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end bytes of all words; a word never crosses the texts' offsets."""
    inside = ~IS_SPACE[raw]
    before = np.concatenate(([False], inside[:-1]))
    before[offsets[:-1][offsets[:-1] < len(raw)]] = False
    after = np.concatenate((inside[1:], [False]))
    cut = offsets[1:] - 1
    after[cut[cut >= 0]] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit name of each word."""
    g = grams(raw)
    size = end - start
    h = size.astype(U) * U(0x9FB21C651E98DF25)
    left, idx, at = size, None, start
    while True:
        n = np.minimum(left, 8).astype(U)
        lane = g[at] & (U(0xFFFFFFFFFFFFFFFF) >> (U(64) - n * U(8)))
        part = mix((h if idx is None else h[idx]) ^ (lane * U(_BASE) + U(0x632BE59BD9B4E019)))
        if idx is None:
            h = part
        else:
            h[idx] = part
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h
        idx = more if idx is None else idx[more]
        left, at = left[more] - 8, at[more] + 8
