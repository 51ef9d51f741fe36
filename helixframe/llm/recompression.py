"""Substring dedup by recompression: repeats of 35 words and more.

In rounds, symbols are renamed over the whole corpus at once: runs of one symbol get a
name for (symbol, length), then a seeded coin splits all symbols into left and right ones
and each pair of a left and a right symbol gets a name.  Names are 64-bit hashes of what
they stand for, so equal words get equal names in every text with no exchange of names.
With each symbol goes its *context*: the words that decide that it was formed as it was.
A symbol whose context lies in a range of words is formed the same way wherever those
words stand.  So a range has one *cover*: of the highest level the symbols whose contexts
lie in it, then what these leave at either side, level by level down to words.  Equal
ranges have equal covers, in which long inner parts are a few high symbols, and the cover
is renamed once more, as one symbol: that symbol reveals repeats and verifies them.

A window's anchor is, of the highest level that has symbols for it, the one with the
smallest name.  The cover of the half window that begins or ends at the anchor, whichever
the window holds, is the key under which texts meet (see ``repeats``); spans and, where it
comes to that, windows are the same if their covers are, under 128 bits of names.

Defined cases: a null or empty text has no words; documents shorter than a window lose
nothing; runs and periodic texts are windows like any others; rows that repeat in full
repeat each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm import repeats
from helixframe.llm.textbuf import U, RollingHash, mix, slices, word_hashes, word_spans

WINDOW = 35
ROUNDS = 3
#: Rounds that name runs before pairs.
RUN_ROUNDS = (0, 2)


class Level:
    """Symbols of one round: names, first word, end word, context [lo, hi), first in its text."""

    def __init__(self, sym, start, end, lo, hi, head):
        self.sym, self.start, self.end, self.lo, self.hi, self.head = sym, start, end, lo, hi, head
        self.kept: dict[int, RollingHash] = {}

    def rolling(self, salt: int) -> RollingHash:
        """Names of runs of symbols; kept for each salt."""
        if salt not in self.kept:
            self.kept[salt] = RollingHash(mix(self.sym + U(salt)))
        return self.kept[salt]

    def runs(self, salt: int) -> Level:
        """Symbols equal to their right neighbour join it in a run, all but the run's last."""
        n = len(self.sym)
        member = np.zeros(n, bool)
        member[:-1] = (self.sym[1:] == self.sym[:-1]) & ~self.head[1:]
        # that a symbol is no member depends on its right neighbour
        hi = np.empty_like(self.hi)
        hi[:-1] = np.where(self.head[1:], self.end[:-1] + 1, self.hi[1:])
        hi[-1:] = self.end[-1:] + 1
        if not member.any():
            return Level(self.sym, self.start, self.end, self.lo, hi, self.head)
        keep = np.ones(n, bool)
        keep[1:] = ~(member[1:] & member[:-1] & ~self.head[1:])
        idx = np.flatnonzero(keep)
        last = np.append(idx[1:], n) - 1
        count = (last - idx + 1).astype(U)
        run = member[idx]
        sym = np.where(run, mix(self.sym[idx] + count * U(0x8EBC6AF09C88C6E3) + U(salt)), self.sym[idx])
        # where a run begins depends on its left neighbour
        left = np.where(self.head[idx], self.start[idx] - 1, self.lo[np.maximum(idx - 1, 0)])
        # where it ends, on what the symbol behind it depends on: that one is no member
        right = np.where(run, hi[np.minimum(last + 1, n - 1)], hi[last])
        return Level(sym, self.start[idx], self.end[last], np.where(run, left, self.lo[idx]), right, self.head[idx])

    def pairs(self, salt: int) -> Level:
        """Each left symbol followed by a right one becomes a pair."""
        n = len(self.sym)
        right = (mix(self.sym + U(salt)) & U(1)).astype(bool)
        joins = np.zeros(n, bool)
        joins[:-1] = ~right[:-1] & right[1:] & ~self.head[1:]
        joined = np.zeros(n, bool)
        joined[1:] = joins[:-1]
        idx = np.flatnonzero(~joined)
        pair = joins[idx]
        nxt = np.minimum(idx + 1, n - 1)
        sym = np.where(pair, mix(self.sym[idx] * U(3) + mix(self.sym[nxt] + U(salt)) + U(salt)), self.sym[idx])
        end = np.where(pair, self.end[nxt], self.end[idx])
        # a left symbol alone depends on the right neighbour, a right symbol alone on the left one
        tail = np.append(self.head[1:], True)[idx]
        after = np.where(tail, self.end[idx] + 1, self.hi[nxt])
        hi = np.where(pair, self.hi[nxt], np.where(right[idx], self.hi[idx], np.maximum(self.hi[idx], after)))
        before = np.where(self.head[idx], self.start[idx] - 1, self.lo[np.maximum(idx - 1, 0)])
        lo = np.where(~pair & right[idx], np.minimum(self.lo[idx], before), self.lo[idx])
        return Level(sym, self.start[idx], end, lo, hi, self.head[idx])


def parse(names: np.ndarray, head: np.ndarray, rounds: int = ROUNDS) -> list[Level]:
    """The levels of all rounds over the words of several texts; ``head`` marks first words."""
    if rounds < 1:
        raise ValueError("recompression takes one round at least")
    at = np.arange(len(names))
    levels = [Level(names, at, at + 1, at, at + 1, head)]
    for r in range(rounds):
        now = levels[-1]
        if r in RUN_ROUNDS:
            now = now.runs(0x51ED270B + r)
        levels.append(now.pairs(0x2545F491 + 977 * r))
    return levels


def anchors(levels: list[Level], starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(level, symbol) of the anchor of each window start."""
    level_of, of = np.full(len(starts), -1), np.zeros(len(starts), np.int64)
    todo = np.arange(len(starts))
    for depth in range(len(levels) - 1, -1, -1):
        v = levels[depth]
        fit = np.flatnonzero(v.hi - v.lo <= width)
        if not len(fit) or not len(todo):
            continue
        lo, hi, s = v.lo[fit], v.hi[fit], starts[todo]
        a = np.searchsorted(lo, s, side="left")
        b = np.searchsorted(hi, s + width, side="right")
        some = b > a
        a, b, idx = a[some], b[some], todo[some]
        # smallest name in [a, b) by a table of minima over powers of two
        table = [(v.sym[fit] & ~U(0xFFFFFFFF)) | np.arange(len(fit)).astype(U)]
        size = b - a
        k = np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)
        for p in range(int(k.max()) if len(k) else 0):
            t = table[-1]
            table.append(np.minimum(t[: len(t) - (1 << p)], t[1 << p :]))
        best = np.empty(len(a), U)
        for p in range(len(table)):
            m = np.flatnonzero(k == p)
            best[m] = np.minimum(table[p][a[m]], table[p][b[m] - (1 << p)])
        level_of[idx] = depth
        of[idx] = fit[(best & U(0xFFFFFFFF)).astype(np.int64)]
        todo = todo[~some]
    return level_of, of


def covers(levels: list[Level], first: np.ndarray, end: np.ndarray, salts: tuple[int, ...] = (0x5A17,)) -> list[np.ndarray]:
    """For each salt the name of the cover of each range [first, end) of words of one text.

    Contexts only grow with the levels, so what fits at one level lies within what fits below.
    """
    names = [np.full(len(first), salt, U) for salt in salts]
    left, right, held = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), np.zeros(len(first), bool)
    for v in reversed(levels):
        a, b = np.searchsorted(v.lo, first, side="left"), np.searchsorted(v.hi, end, side="right")
        fits = b > a
        a = np.where(fits, a, 0)
        b = np.where(fits, b, 0)
        # where nothing is covered yet, all that fits is new; else what lies before and behind
        j = np.where(held, np.searchsorted(v.start, left, side="left"), b)
        k = np.where(held, np.searchsorted(v.start, right, side="left"), b)
        for i, salt in enumerate(salts):
            r = v.rolling(salt)
            names[i] = np.where(fits, mix(names[i] * U(3) + r.of(a, j) * U(0xC2B2AE3D27D4EB4F) + r.of(k, b)), names[i])
        some = np.flatnonzero(fits)
        left[some], right[some] = v.start[a[some]], v.end[b[some] - 1]
        held |= fits
    return names


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names, text of each word, first word of each text, words of each text)."""
    start, end = word_spans(raw, offsets)
    text = np.searchsorted(offsets, start, side="right") - 1
    count = np.bincount(text, minlength=len(offsets) - 1)
    return word_hashes(raw, start, end) if len(start) else np.empty(0, U), text, np.concatenate(([0], np.cumsum(count)))[:-1], count


def find(raw: np.ndarray, offsets: np.ndarray, width: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    names, text, first, count = _words(raw, offsets)
    none = np.empty(0, np.int64)
    if len(names) < width:
        return none, none, none, none, none.astype(U), none.astype(U)
    head = np.zeros(len(names), bool)
    head[first[count > 0]] = True
    starts = np.flatnonzero(np.arange(len(names)) + width <= (first + count)[text])
    if not len(starts):
        return none, none, none, none, none.astype(U), none.astype(U)
    levels = parse(names, head, rounds)
    level, sym = anchors(levels, starts, width)
    place = np.empty(len(starts), np.int64)
    for depth, v in enumerate(levels):
        m = np.flatnonzero(level == depth)
        place[m] = v.start[sym[m]]
    # a window holds the words of its anchor's larger side: half a window names the anchor
    half = width // 2
    early = place - starts < width - half
    change = (np.diff(starts) != 1) | (np.diff(place) != 0) | (np.diff(early.view(np.int8)) != 0) | (np.diff(text[starts]) != 0)
    a = np.concatenate(([0], np.flatnonzero(change) + 1))
    b = np.concatenate((a[1:], [len(starts)])) - 1
    s1, s2, at, side = starts[a], starts[b], place[a], early[a]
    name = covers(levels, np.where(side, at, at - half), np.where(side, at + half, at))[0] ^ np.where(side, U(0), U(0xE7037ED1A0B428DB))
    t = text[s1]
    base = first[t]
    return t, s1 - base, s2 - base, at - base, name, covers(levels, s1, s2 + width)[0]


def _window_rows(width: int, rounds: int, spans: DataFrame, texts: DataFrame) -> DataFrame:
    """The windows of each span that is compared in detail, with 128 bits of names of their covers."""
    own = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("s1", "s2", F.least("n", F.lit(2)).cast("int").alias("n"))).alias("spans"))
    rows = texts.join(own, ["k1", "k2"]).select("k1", "k2", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for i, (_, _, raw, offsets) in enumerate(slices(batch.column(2).fill_null(b""), 0)):
                k1, k2 = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                names = _words(raw, offsets)[0]
                got = batch.column(3)[i].values
                s1, s2, n = (got.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                size = s2 - s1 + 1
                at = np.repeat(s1 - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                head = np.zeros(len(names), bool)
                head[:1] = True
                a, b = covers(parse(names, head, rounds), at, at + width, (0x5A17, 0x71D6))
                m = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, k1)), pa.array(np.full(m, k2)), pa.array(at.astype(np.int32)), pa.array(np.repeat(n, size).astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                    names=["k1", "k2", "s", "n", "a", "b"],
                )

    return rows.mapInArrow(run, "k1 long, k2 long, s int, n int, a long, b long")


def _compare(width: int, rounds: int, spans: DataFrame, texts: DataFrame) -> DataFrame:
    return repeats.windows_twice(repeats.materialize(_window_rows(width, rounds, spans, texts), "windows"))


def repeated_ranges(docs: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(k1, k2, s1, s2): first words of windows of ``width`` words that stand anywhere else too."""
    return repeats.repeated(docs, partial(find, width=width, rounds=rounds), partial(_compare, width, rounds), id_col, text_col)


def dedup(docs: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, the text left) of every row."""
    rows = repeats.with_ranges(docs, repeated_ranges(docs, width, id_col, text_col, rounds), id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_gone, digest, kept = [], [], [], []
            for raw, ranges in zip(batch.column(1), batch.column(2), strict=True):
                ws = (raw.as_py() or b"").split()
                if ranges.is_valid:
                    gone = repeats.covered(len(ws), ranges.values, width)
                    left = [w for w, g in zip(ws, gone.tolist(), strict=True) if not g]
                else:
                    left = ws
                text = b" ".join(left)
                n_words.append(len(ws))
                n_gone.append(len(ws) - len(left))
                digest.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    kept.append(text)
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.binary()).cast(pa.string())] if with_text else []), names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text)

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
