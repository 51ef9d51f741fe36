"""SimHash near-duplicate groups with pigeonring filtering.

A text's fingerprint has a bit set where over half of its shingles' hashes have it set.
Two fingerprints within the radius r are found by segments on a ring: if the differences
of m segments add up to r at most, some chain of consecutive segments has, for each of
its prefixes of length l, at most l * r / m differences (the pigeonring principle, which
is stronger than the pigeonhole principle's single segment).  With r < m the first
segment of the chain is equal and the second differs in one bit at most, so cut into
parts it has all parts but one equal: that is the key under which chains meet.  In a
bucket, the rest of the chain prunes pairs before the full Hamming check.

Fingerprints are made distinct first, so groups of exact copies are one row.  A bucket's
links are reduced to a spanning forest where they are found; a bucket over ``BLOCK``
rows is split into pairs of blocks, so no task holds more than two blocks at a time.

For larger radii no chain of equal segments is selective; ``near_copies`` then lets texts
meet at the rarest of their shingles.  The pigeonring filter prunes what meets there, then
the full Hamming check of wide fingerprints, then the heads of the shingle sets; the sets
themselves decide.

Defined cases: a text without words has fingerprint zero and links like any other; fewer
words than a shingle: the whole sequence is the shingle; a null id is its own component
(null); repeated rows share a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import fresh, hash_sample, keyed, row_key
from helixframe.operators.graph import connected_components
from helixframe.runtime import discard, materialize

SEED = 42
SEGMENTS = 5
#: The second segment of a chain is cut into so many parts, all but one of which are equal.
PARTS = 4
BLOCK = 4096
#: Bits of 256 in which fingerprints of sets of similarity 0.8 can differ: 38.8 expected, standard
#: deviation 5.7; at worst (four of five shingles) 48 and 6.2.
RADIUS = 76
#: Texts that are sampled to tell rare shingles from common ones, and how many of them hold a common one.
SAMPLE, OFTEN = 2048, 4
#: So many of a text's rarest shingles go with it into a bucket (as 32 bits) and tell apart what is nearly alike.
HEAD = 256


def shingle_hashes(raw: bytes | None, n_words: int) -> np.ndarray:
    """XXH64 of each run of ``n_words`` words (A-Z lower-cased, joined by one space)."""
    ws = (raw or b"").lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    if len(ws) <= n_words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(ws), SEED)], np.uint64)
    text = b" ".join(ws)
    size = np.fromiter(map(len, ws), np.int64, len(ws))
    starts = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    ends = starts + size
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[a:b], SEED) for a, b in zip(starts[: len(ws) - n_words + 1].tolist(), ends[n_words - 1 :].tolist(), strict=True)], np.uint64)


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of each hash."""
    x = h + np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(h: np.ndarray, n_longs: int = 1) -> np.ndarray:
    """``n_longs`` 64-bit words; a bit is 1 if it is in over half of the hashes."""
    out = np.zeros(n_longs, np.uint64)
    for k in range(n_longs if len(h) else 0):
        x = _mix(h, k) if k else h
        ones = np.zeros(64, np.int64)
        for at in range(0, len(x), 1 << 16):
            ones += np.unpackbits(x[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, n_words: int, n_longs: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, k1, k2, f0..): the fingerprint of every row."""
    rows = keyed(docs, id_col, text_col).select("id", "k1", "k2", F.col("text").cast("binary").alias("text"))
    names = [f"f{k}" for k in range(n_longs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.zeros((batch.num_rows, n_longs), np.uint64)
            for i, raw in enumerate(batch.column(3)):
                prints[i] = fingerprint(shingle_hashes(raw.as_py(), n_words), n_longs)
            columns = [*batch.columns[:3], *(pa.array(prints[:, k].view(np.int64).copy()) for k in range(n_longs))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "k1", "k2", *names])

    schema = "id long, k1 long, k2 long, " + ", ".join(f"{n} long" for n in names)
    return rows.mapInArrow(run, schema)


def segment_bounds(bits: int = 64, m: int = SEGMENTS) -> list[tuple[int, int]]:
    """(first bit, size) of the ring's segments, as even as can be."""
    cuts = [round(i * bits / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def chain_keys(fp: str = "f0", m: int = SEGMENTS, parts: int = PARTS):
    """Array of bucket keys: segment i whole, and segment i+1 but for one of its parts."""
    out, seg = [], segment_bounds(64, m)
    take = lambda at, size: F.shiftrightunsigned(F.col(fp), at).bitwiseAND(F.lit((1 << size) - 1))
    for i in range(m):
        (a, sa), (b, sb) = seg[i], seg[(i + 1) % m]
        cut = [round(k * sb / parts) for k in range(parts + 1)]
        for p in range(parts):
            mask = ((1 << sb) - 1) & ~(((1 << cut[p + 1]) - 1) ^ ((1 << cut[p]) - 1))
            rest = take(b, sb).bitwiseAND(F.lit(mask))
            out.append(F.shiftleft(F.lit(i * parts + p).cast("long"), 40).bitwiseOR(F.shiftleft(take(a, sa), sb)).bitwiseOR(rest))
    return F.array(*out)


def _pairs(x: np.ndarray, y: np.ndarray, start: int, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices of linked rows of x and y: the chain from ``start`` first, then all bits."""
    seg = segment_bounds()
    m = len(seg)
    got_i, got_j = [], []
    step = max(1, (1 << 20) // max(1, len(y)))
    for at in range(0, len(x), step):
        d = x[at : at + step, None] ^ y[None, :]
        ok, total = np.ones(d.shape, bool), np.zeros(d.shape, np.uint8)
        for n in range(1, m):
            first, size = seg[(start + n) % m]
            total += np.bitwise_count(d & np.uint64(((1 << size) - 1) << first))
            ok &= total <= (n + 1) * radius // m
            if not ok.any():
                break
        i, j = np.nonzero(ok)
        if len(i):
            far = np.bitwise_count(d[i, j]) <= radius
            i, j = i[far] + at, j[far]
            if same:
                i, j = i[i < j], j[i < j]
            got_i.append(i)
            got_j.append(j)
    none = np.empty(0, np.int64)
    return (np.concatenate(got_i), np.concatenate(got_j)) if got_i else (none, none)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links (i, j)."""
    root = np.arange(n)
    while len(i):
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (root == before).all() and (root[i] == root[j]).all():
            break
    return root


def links(classes: DataFrame, radius: int) -> DataFrame:
    """(src, dst): a spanning forest, bucket by bucket, of all links between ``classes`` (f0, first)."""
    rows = classes.select("first", "f0", F.explode(chain_keys()).alias("key"))
    sizes = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes")
    met = rows.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("f0"), F.col("blocks")).cast("int")
    dealt = met.select("key", "first", "f0", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "f0", "first")
    order = ["key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

        def solve(t: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
            cut = np.flatnonzero((t[1:, :3] != t[:-1, :3]).any(axis=1)) + 1
            src, dst = [], []
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(t)], strict=True):
                if b - a < 2:
                    continue
                g = t[a:b]
                start = int(g[0, 0] >> 40) // PARTS
                x = g[:, 4].view(np.uint64)
                if g[0, 1] == g[0, 2]:
                    i, j = _pairs(x, x, start, radius, True)
                else:
                    p, q = np.flatnonzero(g[:, 3] == g[0, 1]), np.flatnonzero(g[:, 3] == g[0, 2])
                    i, j = _pairs(x[p], x[q], start, radius, False)
                    i, j = p[i], q[j]
                if len(i):
                    root = _forest(b - a, i, j)
                    moved = np.flatnonzero(root != np.arange(b - a))
                    src.append(g[moved, 5])
                    dst.append(g[root[moved], 5])
            return src, dst

        def emit(t: np.ndarray) -> Iterator[pa.RecordBatch]:
            src, dst = solve(t)
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], schema=schema)

        for batch in batches:
            t = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            if held and len(t):
                last = held[-1][-1, :3]
                if (t[0, :3] == last).all() and (t[-1, :3] == last).all():
                    held.append(t)
                    continue
                t = np.concatenate([*held, t])
                held = []
            if len(t):
                # the last group may go on in the next batch
                k = len(t) - 1
                same = np.flatnonzero((t[:, :3] != t[k, :3]).any(axis=1))
                at = int(same[-1]) + 1 if len(same) else 0
                yield from emit(t[:at])
                held = [t[at:]]
        if held:
            yield from emit(np.concatenate(held))

    found = dealt.repartition(*order).sortWithinPartitions(*order, "f0").mapInArrow(run, "src long, dst long")
    return found.distinct()


def components(docs: DataFrame, n_words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row, links at ``radius`` differing bits or fewer."""
    if not 0 <= radius < SEGMENTS:
        raise ValueError(f"the ring of {SEGMENTS} segments serves a radius of 0 to {SEGMENTS - 1}")
    prints = materialize(fingerprints(docs, n_words, 1, id_col, text_col).select("id", "f0"), "fingerprints")
    classes = materialize(prints.where("id IS NOT NULL").groupBy("f0").agg(F.min("id").alias("first")), "classes")
    found = connected_components(links(classes, radius))
    label = classes.join(found, classes["first"] == found["node"], "left").select("f0", F.coalesce("component", "first").alias("component"))
    label = materialize(label, "labels")
    out = prints.join(label, "f0", "left")
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))


def frequent_shingles(docs: DataFrame, n_words: int, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes, in order, that at least ``OFTEN`` of ``SAMPLE`` sampled texts hold, and how many do.

    They only order the shingles; any order gives the same groups.
    """
    texts = keyed(docs, id_col, text_col).select("id", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                h = np.unique(shingle_hashes(raw.as_py(), n_words))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    held = hash_sample(texts, F.col("id"), SAMPLE).select("text").mapInArrow(run, "h long").groupBy("h").count()
    rows = held.where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "h").limit(1 << 16).collect()
    h, n = np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def rarest_first(h: np.ndarray, often: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Distinct hashes in the order of all prefixes: by how many sampled texts hold them, then by value."""
    if not len(often):
        return h
    at = np.minimum(np.searchsorted(often, h), len(often) - 1)
    return h[np.lexsort((h, np.where(often[at] == h, held[at], 0)))]


def shingle_sets(docs: DataFrame, n_words: int, n_longs: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, k1, k2, c1, c2, n, f0.., prefix, head) of every row: its set of shingle hashes.

    (c1, c2) names the set, f0.. is the set's fingerprint.  Of two sets of similarity ``percent`` or
    more, the first n - ceil(percent n / 100) + 1 hashes of each in one order have one in common.
    """
    often, held = frequent_shingles(docs, n_words, id_col, text_col)
    rows = keyed(docs, id_col, text_col).select("id", "k1", "k2", F.col("text").cast("binary").alias("text"))
    names = ["id", "k1", "k2", "c1", "c2", "n", *(f"f{k}" for k in range(n_longs)), "prefix", "head"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, prints = np.zeros((batch.num_rows, 3), np.int64), np.zeros((batch.num_rows, n_longs), np.uint64)
            prefix, head = [], []
            for i, raw in enumerate(batch.column(3)):
                h = np.unique(shingle_hashes(raw.as_py(), n_words))
                c[i] = *np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64), len(h)
                prints[i] = fingerprint(h, n_longs)
                size = len(h) - -(-percent * len(h) // 100) + 1 if len(h) else 0
                h = rarest_first(h, often, held)
                prefix.append(h[:size].view(np.int64))
                head.append(h[:HEAD].astype(np.uint32).tobytes())
            columns = [*batch.columns[:3], *(pa.array(c[:, k].copy()) for k in range(3)), *(pa.array(prints[:, k].view(np.int64).copy()) for k in range(n_longs))]
            columns += [pa.array(prefix, pa.list_(pa.int64())), pa.array(head, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = {"prefix": "array<long>", "head": "binary"}
    return rows.mapInArrow(run, ", ".join(f"{x} {kinds.get(x, 'long')}" for x in names))


def _ring(d: np.ndarray, radius: int, m: int = 16) -> np.ndarray:
    """Pigeonring filter: which rows of differing bits (.., words) have a chain of segments within its budgets.

    The words' 16-bit lanes are ``m`` segments on a ring.  A row with ``radius`` differences or fewer has a
    segment from which every run of l segments differs in l * radius / m bits at most.
    """
    lanes = np.bitwise_count(np.ascontiguousarray(d).view(np.uint16)).astype(np.int32)
    cumulative, ok = lanes.copy(), m * lanes <= radius
    for n in range(1, m):
        if not ok.any():
            break
        cumulative += np.roll(lanes, -n, axis=-1)
        ok &= m * cumulative <= (n + 1) * radius
    return ok.any(axis=-1)


def _near(x: np.ndarray, y: np.ndarray, radius: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of rows of x and y (label, size, place of the bucket's shingle, fingerprint) that can be open links.

    Rarest first, two sets have nothing in common before the first shingle they share, and so at most
    that one and what follows it in either.
    """
    a, b = x[:, None], y[None, :]
    most = 1 + np.minimum(a[..., 1] - 1 - a[..., 2], b[..., 1] - 1 - b[..., 2])
    i, j = np.nonzero((a[..., 0] != b[..., 0]) & ((100 + percent) * most >= percent * (a[..., 1] + b[..., 1])))
    got = []
    for at in range(0, len(i), 1 << 17):
        p, q = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
        d = (x[p, 3:] ^ y[q, 3:]).view(np.uint64)
        chained = _ring(d, radius, 4 * d.shape[1])
        p, q, d = p[chained], q[chained], d[chained]
        close = np.bitwise_count(d).sum(axis=1, dtype=np.int32) <= radius
        got.append((p[close], q[close]))
    none = np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*got, strict=True)) if got else (none, none)


def _heads_meet(x: np.ndarray, y: np.ndarray, hx: np.ndarray, hy: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of rows x and y can have ``percent`` in common, by their heads (32-bit hashes, rarest first).

    All but c of a set of size n are common, so of its first h at least h - c, which are the first of the
    common ones in the other set as well.
    """
    need = -(-percent * (x[:, 1] + y[:, 1]) // (100 + percent))
    sizes = [np.fromiter(map(len, h), np.int64, len(h)) // 4 for h in (hx, hy)]
    least = np.minimum(sizes[0] - (x[:, 1] - need), sizes[1] - (y[:, 1] - need))
    ok = np.ones(len(x), bool)
    todo = np.flatnonzero(least > 0)
    for at in range(0, len(todo), 4096):
        k = todo[at : at + 4096]
        wide = int(max(sizes[0][k].max(), sizes[1][k].max()))
        both = np.empty((len(k), 2 * wide), np.int64)
        for side, (h, size) in enumerate(zip((hx, hy), sizes, strict=True)):
            own = both[:, side * wide : (side + 1) * wide]
            own[:] = np.arange(wide) + ((side + 1) << 32)  # beyond all hashes, and not the other side's
            own[np.arange(wide) < size[k, None]] = np.frombuffer(b"".join(h[k]), np.uint32)
        both.sort(axis=1)
        ok[k] = (both[:, 1:] == both[:, :-1]).sum(axis=1) >= least[k]
    return ok


def open_pairs(rows: DataFrame, radius: int, percent: int, n_longs: int) -> DataFrame:
    """(a, b): all pairs of a bucket (key) that lie within the radius and in different components (label).

    A bucket over ``BLOCK`` rows is dealt out as pairs of blocks, so no task holds more than two of them.
    """
    names = [f"f{k}" for k in range(n_longs)]
    met = rows.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = met.select("key", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "node", "label", "n", "pos", *names, "head")
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label", "n", "pos", *names, "head")
    order = ["key", "i", "j"]

    def solve(g: np.ndarray, heads: np.ndarray) -> Iterator[pa.RecordBatch]:
        same = g[0, 1] == g[0, 2]
        every = np.arange(len(g))
        p, q = (every, every) if same else (np.flatnonzero(g[:, 3] == g[0, 1]), np.flatnonzero(g[:, 3] == g[0, 2]))
        step = max(1, (1 << 20) // max(1, len(q)))
        for at in range(0, len(p), step):
            i, j = _near(g[p[at : at + step], 5:], g[q, 5:], radius, percent)
            i, j = p[i + at], q[j]
            if same:
                i, j = i[i < j], j[i < j]
            ok = _heads_meet(g[i, 5:], g[j, 5:], heads[i], heads[j], percent)
            a, b = g[i[ok], 4], g[j[ok], 4]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:-1]])
            h = np.array([*batch.columns[-1].to_pylist(), None], object)[:-1]
            if held is not None:
                t, h = np.concatenate([held[0], t]), np.concatenate([held[1], h])
            if not len(t):
                continue
            cut = np.flatnonzero((t[1:, :3] != t[:-1, :3]).any(axis=1)) + 1
            at = [0, *cut.tolist()]
            for x, y in zip(at, at[1:], strict=False):
                yield from solve(t[x:y], h[x:y])
            held = t[at[-1] :], h[at[-1] :]  # the last group may go on in the next batch
        if held is not None and len(held[0]):
            yield from solve(*held)

    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long").distinct()


def alike(pairs: DataFrame, classes: DataFrame, texts: DataFrame, n_words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ``classes`` whose shingle sets have ``percent`` of their union in common.

    The sets of the texts in ``pairs`` alone are made again and written.
    """
    need = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    need = classes.select("node", "k1", "k2").join(need.hint("merge"), "node", "left_semi")
    rows = texts.where("id IS NOT NULL").select("k1", "k2", F.col("text").cast("binary").alias("text")).join(need.hint("merge"), ["k1", "k2"])
    rows = rows.groupBy("k1", "k2").agg(F.first("node").alias("node"), F.first("text").alias("text")).select("node", "text")  # rows that repeat in full

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [np.unique(shingle_hashes(raw.as_py(), n_words)).tobytes() for raw in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.binary())], names=["node", "grams"])

    sets = materialize(rows.mapInArrow(sets_of, "node long, grams binary"), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")).hint("merge"), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")).hint("merge"), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok))

    out = materialize(both.mapInArrow(run, "a long, b long"), "links")
    discard(sets)
    return out


def near_copies(docs: DataFrame, n_words: int = 5, radius: int = RADIUS, n_longs: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, id, component, copies, kept): groups of texts with shingle sets of similarity ``percent`` or more.

    Two such texts share a shingle among the rarest of each, and so meet in its bucket.  First
    every text is held against one pivot, that which it meets most often; in buckets that are not yet
    one component, all pairs of different components follow.  There the pigeonring filter prunes by
    chains of 16-bit segments before the full Hamming check, and pairs whose wide fingerprints differ
    in over ``radius`` bits are passed over.  ``component`` is the group's smallest id.
    """
    names, texts = [f"f{k}" for k in range(n_longs)], keyed(docs, id_col, text_col)
    prints = materialize(shingle_sets(docs, n_words, n_longs, percent, id_col, text_col), "fingerprints")
    first = lambda x: F.first(x).alias(x)
    classes = prints.where("id IS NOT NULL").groupBy("c1", "c2").agg(F.min(F.struct("id", "k1", "k2")).alias("one"), *map(first, ["n", *names, "prefix", "head"]))
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "c1", "c2", "one.*", "n", *names, "prefix", "head")
    classes = materialize(classes, "classes")  # from here on a node has one number
    wide, prints = prints, materialize(prints.select("id", "k1", "k2", "c1", "c2"), "rows")
    discard(wide)

    keys = classes.select("node", F.posexplode("prefix").alias("pos", "key"))
    one = F.min(F.struct("node", "pos")).alias("one")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m"), one, F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    # buckets of the same texts are one, that of the shingle which comes first in all of them
    sizes = sizes.where("m > 1").select("key", "m", F.col("one.node").alias("pivot"), F.col("one.pos").alias("pos"), "x", "y")
    buckets = materialize(sizes.groupBy("m", "pivot", "x", "y").agg(F.min_by("key", "pos").alias("key")), "buckets")
    met = materialize(keys.join(buckets.select("key", "m", "pivot").hint("merge"), "key"), "members")
    wide, classes = classes, materialize(classes.drop("prefix"), "classes")
    discard(wide)

    # a text's pivot is the one it meets in most buckets: one row for each text, however crowded they are
    meets = met.where("node <> pivot").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("times"))
    star = meets.groupBy("node").agg(F.max_by("pivot", F.struct("times", -F.col("pivot"))).alias("a")).select("a", F.col("node").alias("b"))
    look = classes.select("node", F.struct("n", *names).alias("z"))
    star = star.join(look.select(F.col("node").alias("a"), F.col("z").alias("p")).hint("merge"), "a").join(look.select(F.col("node").alias("b"), F.col("z").alias("q")).hint("merge"), "b")
    star = star.where(100 * F.least("p.n", "q.n") >= percent * F.greatest("p.n", "q.n")).select("a", "b")
    linked = alike(materialize(star, "stars"), classes, texts, n_words, percent)
    found = materialize(connected_components(linked, "a", "b"), "found")

    rows = met.select("key", "node", "pos", "m").join(found.hint("merge"), "node", "left").select("key", "node", "pos", "m", F.coalesce("component", "node").alias("label"))
    rows = materialize(rows, "labelled")
    mixed = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    rows = rows.join(mixed.hint("merge"), "key", "left_semi").join(classes.select("node", "n", *names, "head").hint("merge"), "node")
    more = materialize(open_pairs(rows, radius, percent, n_longs), "open")
    if not more.isEmpty():
        found = materialize(connected_components(linked.unionByName(alike(more, classes, texts, n_words, percent)), "a", "b"), "found")

    label = classes.select("node", "c1", "c2", "id", "k1", "k2").join(found.hint("merge"), "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
    label = materialize(label, "labels")
    stays = label.groupBy("root").agg(F.min(F.struct("id", "k1", "k2")).alias("best"))
    label = label.select("c1", "c2", "root").join(stays.hint("merge"), "root").select("c1", "c2", "best")
    out = prints.select("id", "k1", "k2", "c1", "c2").join(label.hint("merge"), ["c1", "c2"], "left")
    kept = F.col("id").isNull() | ((F.col("id") == F.col("best.id")) & (F.col("k1") == F.col("best.k1")) & (F.col("k2") == F.col("best.k2")))
    out = out.select("id", "k1", "k2", F.when(F.col("id").isNotNull(), F.col("best.id")).alias("component"), kept.alias("kept"))
    return out.groupBy("k1", "k2").agg(F.first("id").alias("id"), F.first("component").alias("component"), F.count(F.lit(1)).alias("copies"), F.first("kept").alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the near copies: of each group the smallest id stays, once; all rows without id stay."""
    groups = near_copies(docs, id_col=id_col, text_col=text_col, **how)
    keep = materialize(groups.where("kept").select("k1", "k2", "copies"), "keep")
    k1, k2, own = fresh(docs, "hx_k1", "hx_k2", "hx_own")
    ident = F.col(f"`{id_col}`").cast("long")
    rows = docs.withColumns(dict(zip((k1, k2), row_key(ident, F.col(f"`{text_col}`")), strict=True)))
    # what is kept grows with the corpus: it is never broadcast, at any size
    out = rows.join(keep.select(F.col("k1").alias(k1), F.col("k2").alias(k2)).hint("merge"), [k1, k2], "left_semi")
    if not keep.where("copies > 1").isEmpty():
        out = out.withColumn(own, F.when(ident.isNull(), F.monotonically_increasing_id())).dropDuplicates([k1, k2, own]).drop(own)
    return out.drop(k1, k2)
