"""Substring dedup over a sparse suffix array: repeats of 200 bytes and more.

Every 200-byte window samples one suffix of its text: the one that begins with the
32-byte gram of the smallest hash in the window (leftmost of equals).  Equal windows
sample suffixes with the same surroundings; the half window that begins or ends at the
gram, whichever the window holds, is the shard, and a shard is sorted on its own (see
``repeats`` for what is sorted where).

A shard's suffixes are sorted by deep-shallow sorting: multikey quicksort orders them by
their next bytes to a shallow depth; groups that are still together, whose common prefix
is long, are ordered by a blind trie, which compares each string with one leaf only.  The
bytes before the gram, reversed, are sorted the same way.  Two suffixes with longest
common prefix r to the right and l to the left repeat l + r bytes; the pairs that matter
are found by merging the shard's groups from the deepest prefix up, each time looking at
the neighbours in the left order alone.

A shard of over ``SHARD_SPANS`` spans is split by more bytes: its windows are parted by where
the gram stands in them, and the bytes that all windows of a part share name a finer shard,
down to whole windows if need be.  No task gathers more, and the sort decides all the same.
Spans that are equal as a whole are combined, by two 64-bit hashes, before they are sorted.

Defined cases: a null or empty text is empty; texts shorter than a window lose nothing;
overlapping repeats count; rows that repeat in full repeat each other.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm import repeats
from helixframe.llm.textbuf import U, RollingHash, grams, mix
from helixframe.runtime import materialize

WINDOW = 200
GRAM = 32
#: Multikey quicksort looks at so many bytes; tries order what is equal up to there.
SHALLOW = 16
#: A shard of more spans is split by more bytes.
SHARD_SPANS = 4096


def _gram_hashes(g: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the 32 bytes from each of the first n positions."""
    h = g[:n] * U(0x9E3779B97F4A7C15)
    for k, c in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0x27D4EB2F165667C5)):
        h = (h ^ (h >> U(29))) + g[k : k + n] * U(c)
    return mix(h)


def find(raw: np.ndarray, offsets: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, ...]:
    none = np.empty(0, np.int64)
    size = np.diff(offsets)
    if len(raw) < width or not (size >= width).any():
        return none, none, none, none, none.astype(U), none.astype(U)
    g = grams(raw)
    n = len(raw) - GRAM + 1
    h = _gram_hashes(g, n)
    # the smallest hash in each run of w grams, with its place: doubling
    w = width - GRAM + 1
    low = (h & ~U(0xFFFFFFFF)) | np.arange(n).astype(U)
    span = 1
    while 2 * span <= w:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
    at = (low & U(0xFFFFFFFF)).astype(np.int64)
    good = np.zeros(len(at), bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            good[a : b - width + 1] = True
    starts = np.flatnonzero(good)
    at = at[starts]
    # a window holds the bytes of its gram's larger side: half a window names the suffix
    half = width // 2
    early = at - starts <= width - half
    new = np.flatnonzero((np.diff(at) != 0) | (np.diff(starts) != 1) | (np.diff(early.view(np.int8)) != 0)) + 1
    a = np.concatenate(([0], new))
    b = np.concatenate((new, [len(starts)])) - 1
    s1, s2, anchor, side = starts[a], starts[b], at[a], early[a]
    text = np.searchsorted(offsets, s1, side="right") - 1
    base = offsets[text]
    # spans are told apart by all their bytes: each position's 8-byte gram up to the last whole one
    rolling = RollingHash(mix(g + U(0x3C79AC492BA7B653)))
    name = rolling.of(np.where(side, anchor, anchor - half), np.where(side, anchor + half, anchor) - 7) ^ np.where(side, U(0), U(0xE7037ED1A0B428DB))
    return text, s1 - base, s2 - base, anchor - base, name, rolling.of(s1, s2 + width - 7)


def lcp(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the longest common prefix; the first ``known`` bytes are known to be equal."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def _trie_order(items: list[int], text: list[bytes], depth: int) -> list[int]:
    """Items in order of their texts, which share ``depth`` bytes, by a blind trie.

    A node is [depth, children by byte (-1 is the end)], a leaf the list of equal items.
    """
    root: list = [items[0]]
    leaf = {id(root): True}

    def is_leaf(x: list) -> bool:
        return id(x) in leaf

    def byte(s: bytes, k: int) -> int:
        return s[k] if k < len(s) else -1

    for i in items[1:]:
        s, at = text[i], root
        while not is_leaf(at):  # blind: skipped bytes are not looked at
            c = byte(s, at[0])
            at = at[1].get(c) or next(iter(at[1].values()))
        other = text[at[0]]
        k = lcp(s, other, depth)
        if k == len(s) == len(other):
            at.append(i)
            continue
        parent, c0, at = None, 0, root
        while not is_leaf(at) and at[0] < k:
            parent, c0 = at, byte(s, at[0])
            at = at[1][c0]
        if not is_leaf(at) and at[0] == k:
            new = [i]
            leaf[id(new)] = True
            at[1][byte(s, k)] = new
            continue
        new = [i]
        leaf[id(new)] = True
        node = [k, {byte(other, k): at, byte(s, k): new}]
        if parent is None:
            root = node
        else:
            parent[1][c0] = node
    out: list[int] = []
    stack = [root]
    while stack:
        at = stack.pop()
        if is_leaf(at):
            out += at
        else:
            stack += [at[1][c] for c in sorted(at[1], reverse=True)]
    return out


def deep_shallow(text: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Indices of ``text`` in order of the strings (equal ones by index)."""
    out: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(text))), 0)]
    while stack:
        items, depth = stack.pop()
        if len(items) < 2:
            out += items
        elif depth >= shallow:
            out += _trie_order(items, text, depth)
        else:
            keys = [text[i][depth] if depth < len(text[i]) else -1 for i in items]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            less = [i for i, c in zip(items, keys, strict=True) if c < pivot]
            same = [i for i, c in zip(items, keys, strict=True) if c == pivot]
            more = [i for i, c in zip(items, keys, strict=True) if c > pivot]
            stack.append((more, depth))
            if pivot < 0:  # strings that end here are equal, and nothing sorts before them
                out += same
            else:
                stack.append((same, depth + 1))
                stack.append((less, depth))
    return out


def matches(left: list[bytes], right: list[bytes], width: int) -> list[list[tuple[int, int]]]:
    """For each suffix the (l, r) with l + r >= width that it shares with some other: l bytes
    before its gram and r from it.  ``left`` is reversed."""
    m = len(right)
    got: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    if m == 2:
        l, r = lcp(*left), lcp(*right)  # noqa: E741
        if l + r >= width:
            got[0].append((l, r))
            got[1].append((l, r))
        return got
    order = deep_shallow(right)
    deep = [lcp(right[a], right[b]) for a, b in zip(order, order[1:], strict=False)]
    by_left = deep_shallow(left)
    rank = [0] * m
    for k, i in enumerate(by_left):
        rank[i] = k
    best = [-1] * m
    group = {k: [rank[i]] for k, i in enumerate(order)}
    owner = list(range(m))

    def top(k: int) -> int:
        while owner[k] != k:
            owner[k] = owner[owner[k]]
            k = owner[k]
        return k

    def look(a: int, b: int, depth: int) -> None:
        """Ranks a and b are neighbours in the left order of a group that shares ``depth``."""
        i, j = by_left[a], by_left[b]
        l = lcp(left[i], left[j])  # noqa: E741
        if l + depth >= width:
            for x in (i, j):
                if l > best[x]:
                    best[x] = l
                    got[x].append((l, depth))

    for k in sorted(range(m - 1), key=lambda k: -deep[k]):
        a, b = top(k), top(k + 1)
        big, small = (a, b) if len(group[a]) >= len(group[b]) else (b, a)
        held = group[big]
        for x in group.pop(small):
            p = bisect_left(held, x)
            if p:
                look(held[p - 1], x, deep[k])
            if p < len(held):
                look(x, held[p], deep[k])
            insort(held, x)
        owner[small] = big
    return got


def _cut_spans(width: int, spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Each span with its bytes before the gram and from it (hot names: without)."""
    own = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("s1", "s2", "at", "name", F.least("n", F.lit(2)).cast("int").alias("n"))).alias("spans"))
    rows = texts.join(own, ["k1", "k2"]).select("k1", "k2", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, out = set(), []
            for k1, k2, text, spans_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                raw = text.as_py() or b""
                for x in spans_.as_py():
                    out.append((x["name"], k1, k2, x["s1"], x["at"], x["n"], raw[x["s1"] : x["at"]][::-1], raw[x["at"] : x["s2"] + width]))
                    if len(out) >= 4096:
                        yield _batch(out)
                        out = []
            if out:
                yield _batch(out)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    names = ["name", "k1", "k2", "s1", "at", "n", "before", "after"]

    def _batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return rows.mapInArrow(run, "name long, k1 long, k2 long, s1 int, at int, n int, before binary, after binary")


def _sorted_shards(width: int, cut: DataFrame) -> DataFrame:
    """(k1, k2, s1, s2): window starts that the sort of each shard shows to repeat."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("s1", pa.int32()), ("s2", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def solve() -> None:
            if len(held) > 1:
                found = matches([x[6] for x in held], [x[7] for x in held], width)
                for x, got in zip(held, found, strict=True):
                    if x[5] == 1:
                        out.extend((x[1], x[2], x[4] - l, x[4] + r - width) for l, r in got)  # noqa: E741

        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != x[0]:
                    solve()
                    held = []
                    if len(out) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                        out = []
                held.append(x)
        solve()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return cut.repartition("name").sortWithinPartitions("name").mapInArrow(run, "k1 long, k2 long, s1 int, s2 int")


def _refine(width: int, size: int, spans: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splits the shards of ``spans`` by more bytes: (what repeats as a whole, the spans of the finer shards).

    The windows of a span are parted by where the gram stands in them, ``size`` places a part.
    All windows of a part hold width - size + 1 bytes in common, which name its shard; equal
    windows have their gram at the same place, so they meet again.  With parts of one place
    the name is the window, and nothing is left to sort.
    """
    own = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("s1", "s2", "at", "name", F.least("n", F.lit(2)).cast("int").alias("n"))).alias("spans"))
    rows = texts.join(own, ["k1", "k2"]).select("k1", "k2", "text", "spans")
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    names = ["k1", "k2", "s1", "s2", "at", "name", "span", "n"]

    def parts(raw: bytes, x: dict) -> Iterator[tuple]:
        for k in range((x["at"] - x["s2"]) // size, (x["at"] - x["s1"]) // size + 1):
            last = x["at"] - k * size  # the last window start of the part, if the text goes on so far
            first = last - size + 1
            common = raw[last : first + width]
            a, b = max(first, x["s1"]), min(last, x["s2"])
            name = xxhash.xxh64_intdigest(common, (x["name"] + k * 0x9E3779B97F4A7C15) % (1 << 64))
            yield a, b, x["at"], _signed(name), _signed(xxhash.xxh64_intdigest(raw[a : b + width], a - last)), x["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            seen, out = set(), []
            for k1, k2, text, own_spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                raw = text.as_py() or b""
                for x in own_spans.as_py():
                    out += ((k1, k2, *part) for part in parts(raw, x))
                    if len(out) >= 8192:
                        yield batch_of(out)
                        out = []
            if out:
                yield batch_of(out)

    cut = materialize(rows.mapInArrow(run, "k1 long, k2 long, s1 int, s2 int, at int, name long, span long, n int"), "parts")
    one = F.min(F.struct("k1", "k2", "s1", "s2", "at")).alias("one")
    groups = materialize(cut.groupBy("name", "span").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("n"), one), "part-kinds")
    whole = cut.where("n = 1").join(groups.where("members > 1").select("name", "span"), ["name", "span"], "left_semi").select("k1", "k2", "s1", "s2")
    still = groups.groupBy("name").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("kinds")).where("least = 1 AND kinds > 1").select("name", "kinds")
    return whole, materialize(groups.join(still, "name").select("one.*", "name", "span", "n", "kinds"), "part-spans")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _compare(width: int, shard_spans: int, spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Sorts every shard; one of over ``shard_spans`` spans is split by more bytes first, again and again."""
    found, size = None, 1 << (width.bit_length() - 2)
    while True:
        usual, hot = spans.where(F.col("kinds") <= shard_spans), spans.where(F.col("kinds") > shard_spans)
        now = _sorted_shards(width, _cut_spans(width, usual, texts))
        found = now if found is None else found.unionByName(now)
        if hot.isEmpty():
            return found
        whole, spans = _refine(width, size, hot, texts)
        found, size = found.unionByName(whole), max(1, size // 2)


def repeated_ranges(docs: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", shard_spans: int = SHARD_SPANS) -> DataFrame:
    """(k1, k2, s1, s2): first bytes of ``width``-byte strings that stand anywhere else too."""
    return repeats.repeated(docs, partial(find, width=width), partial(_compare, width, shard_spans), id_col, text_col)


def dedup(docs: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, shard_spans: int = SHARD_SPANS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left) of every row."""
    rows = repeats.with_ranges(docs, repeated_ranges(docs, width, id_col, text_col, shard_spans), id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_gone, n_spans, digest, kept = [], [], [], [], []
            for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_py() or b""
                left, runs = raw, 0
                if ranges.is_valid:
                    gone = repeats.covered(len(raw), ranges.values, width)
                    left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
                n_bytes.append(len(raw))
                n_gone.append(len(raw) - len(left))
                n_spans.append(runs)
                digest.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    kept.append(left)
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (n_bytes, n_gone, n_spans)), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.binary())] if with_text else []), names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
