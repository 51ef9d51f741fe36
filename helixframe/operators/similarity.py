"""Set similarities of records by the features they share.

Records and features form an inverted index; blocks of records that share a feature are
compared by counting.  A high lower bound on the score prunes before: a pair that reaches it
must share one of the rarest features of either side (prefix filtering), so frequent features
are joined only for pairs that already have one rare feature in common.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.runtime import barrier, discard, materialize, small

#: From this bound on, rare features decide; below it nearly all features would be rare enough.
PREFIX_FROM = 0.3
#: A feature that one record in so many holds is common, from so many records on.
COMMON, MIN_COMMON = 8, 512
#: Records of a block: at most, and at least where there are that many.
BLOCK, MIN_BLOCK = 1024, 128
#: So many pairs of places are made at once.
PAIRS_AT_ONCE = 1 << 21
METRICS = ("jaccard", "max_containment", "min_containment")


def _score(metric: str) -> Column:
    """From n_i, n_j and shared: over the union, the smaller set or the larger set."""
    below = {"jaccard": F.col("n_i") + F.col("n_j") - F.col("shared"), "max_containment": F.least("n_i", "n_j"), "min_containment": F.greatest("n_i", "n_j")}[metric]
    return F.col("shared") / below


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (f, b, k) sorted by f and b: for each two blocks that hold a feature (x, y, p, q), the places that hold it."""
    rest: pa.Table | None = None

    def pairs_of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        f, b, k = t["f"].combine_chunks(), t["b"].to_numpy(), t["k"].to_numpy().astype(np.int16)
        fresh = np.r_[True, pc.not_equal(f[1:], f[:-1]).to_numpy(zero_copy_only=False)]
        starts = np.flatnonzero(fresh | np.r_[True, b[1:] != b[:-1]])
        lengths = np.diff(np.r_[starts, len(b)])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(b)].astype(np.int32)), pa.array(k))
        of = np.cumsum(fresh)[starts]
        # each run meets itself and the runs of its feature that follow
        last = np.searchsorted(of, of, "right")
        n = last - np.arange(len(of))
        at = 0
        while at < len(n):
            end = max(at + 1, int(np.searchsorted(np.cumsum(n[at:]), PAIRS_AT_ONCE, "right")) + at)
            u = np.repeat(np.arange(at, end), n[at:end])
            v = u + np.arange(len(u)) - np.repeat(np.cumsum(n[at:end]) - n[at:end], n[at:end])
            use = (u != v) | (lengths[u] > 1)
            u, v = u[use], v[use]
            yield pa.RecordBatch.from_arrays([pa.array(b[starts[u]]), pa.array(b[starts[v]]), lists.take(pa.array(u)), lists.take(pa.array(v))], ["x", "y", "p", "q"])
            at = end

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not len(t):
            continue
        # the last feature may go on in the next batch
        cut = pc.index(t["f"], t["f"][len(t) - 1]).as_py()
        if cut:
            yield from pairs_of(t.slice(0, cut))
        rest = t.slice(cut)
    if rest is not None and len(rest):
        yield from pairs_of(rest)


def _bitmap(words: int):
    """One row (b, bits) of (b, k, bit): the common features of a block's records, place after place."""

    def run(t: pa.Table) -> pa.Table:
        k = t["k"].to_numpy()
        held = np.zeros((int(k.max()) + 1, words * 8), bool)
        held[k, t["bit"].to_numpy()] = True
        return pa.table({"b": t["b"].slice(0, 1), "bits": pa.array([np.packbits(held, axis=1).tobytes()], pa.binary())})

    return run


def _add_common(acc: np.ndarray, p: bytes | None, q: bytes | None, words: int) -> None:
    if p is None or q is None:
        return
    left, right = (np.frombuffer(x, np.uint8).reshape(-1, words) for x in (p, q))
    for at in range(0, words, 512):  # counts below 2^24 are exact
        u, v = (np.unpackbits(x[:, at : at + 512], axis=1).astype(np.float32) for x in (left, right))
        acc[: len(u), : len(v)] += (u @ v.T).astype(np.int32)


def _add_lists(acc: np.ndarray, p: pa.Array, q: pa.Array) -> None:
    """Every place of a list in p with every place of the list beside it."""
    a, b = (x.value_lengths().to_numpy().astype(np.int64) for x in (p, q))
    pv, qv = (x.flatten().to_numpy().astype(np.int64) for x in (p, q))
    # each entry of p with the whole list beside it
    reps, begin = np.repeat(b, a), np.repeat(np.cumsum(b) - b, a)
    ends, at = np.cumsum(reps), 0
    flat = acc.reshape(-1)
    while at < len(reps):
        done = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, "right")))
        r = reps[at:end]
        other = np.arange(r.sum()) - np.repeat(np.cumsum(r) - r - begin[at:end], r)
        flat += np.bincount(np.repeat(pv[at:end] * acc.shape[1], r) + qv[other], minlength=len(flat)).astype(np.int32)
        at = end


def _scored(weights: list[float], metric: str, lower: float, words: list[int]):
    """Scores of the records of two blocks, from the lists (part, p, q) and the blocks (r, n and bitmaps on both sides)."""

    def run(key: tuple, lists: pa.Table, blocks: pa.Table) -> pa.Table:
        side = {s: blocks[f"r_{s}"].combine_chunks()[0].values for s in "xy"}
        shape = len(side["x"]), len(side["y"])
        part, total, any_ = lists["part"].to_numpy(), np.zeros(shape), np.zeros(shape, bool)
        for k, weight in enumerate(weights):
            acc = np.zeros(shape, np.int32)
            mine = lists.filter(pa.array(part == k)) if len(weights) > 1 else lists
            for p, q in ((c["p"], c["q"]) for c in mine.to_batches()):
                _add_lists(acc, p, q)
            if words[k]:
                _add_common(acc, blocks[f"bits{k}_x"][0].as_py(), blocks[f"bits{k}_y"][0].as_py(), words[k])
            n_i, n_j = (np.asarray(blocks[f"n{k}_{s}"].combine_chunks()[0].values) for s in "xy")
            n_i, n_j = n_i[:, None], n_j[None, :]
            below = {"jaccard": lambda: n_i + n_j - acc, "max_containment": lambda: np.minimum(n_i, n_j), "min_containment": lambda: np.maximum(n_i, n_j)}[metric]()
            has = acc > 0
            total += np.divide(acc, below, out=np.zeros(shape), where=has) * weight
            any_ |= has
        any_ &= total > lower
        x, y = key[0].as_py(), key[1].as_py()
        i, j = np.nonzero(np.triu(any_, 1) if x == y else any_)
        return pa.table({"i": side["x"].take(pa.array(i)), "j": side["y"].take(pa.array(j)), "score": pa.array(total[i, j])})

    return run


def _blockwise(parts: list[tuple[float, DataFrame]], metric: str, lower: float) -> DataFrame:
    """(i, j, score) for i < j of weighted parts (r, f) without nulls or repeats; scores over ``lower``.

    Records are put into blocks in their order, and two blocks that share a feature are compared by
    one task, which counts in a table of both: a pair of records is never a row before it has its
    score.  A rare feature is sent to the pairs of blocks that hold it.  A common one, which an
    eighth of the records hold, would go to all of them: it is one bit of each record.
    """
    parts = [(w, materialize(rows, "features", free=False)) for w, rows in parts]
    spark, kind = parts[0][1].sparkSession, parts[0][1].schema["r"].dataType.simpleString()
    zero = F.lit(0).cast("long")
    sizes = reduce(DataFrame.unionByName, [rows.groupBy("r").agg(*[F.count(F.lit(1)).alias(f"n{m}") if m == k else F.first(zero).alias(f"n{m}") for m in range(len(parts))]) for k, (_, rows) in enumerate(parts)])
    sizes = materialize(sizes.groupBy("r").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(parts))]), "record-sizes", free=False)
    n = sizes.count()
    count = max(1, -(-n // max(MIN_BLOCK, min(BLOCK, -(-n // 4)))))
    order = sizes.repartitionByRange(count, "r").sortWithinPartitions("r").withColumn("at", F.monotonically_increasing_id())
    order = materialize(order.select("*", F.shiftright("at", 33).cast("int").alias("b"), F.col("at").bitwiseAND((1 << 33) - 1).cast("int").alias("k")).drop("at"), "record-order")
    index = small(order.select("r", "b", "k"), n)
    blocks = order.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("k", "r", *[f"n{k}" for k in range(len(parts))]))).alias("e"))
    blocks = blocks.select("b", F.col("e.r").alias("r"), *[F.col(f"e.n{k}").alias(f"n{k}") for k in range(len(parts))])
    lists, words = [], []
    for k, (_, rows) in enumerate(parts):
        often = rows.groupBy("f").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") * COMMON >= max(n, MIN_COMMON))
        # at most COMMON times the mean number of a record's features
        bits = materialize(often.select("f", (F.row_number().over(Window.orderBy("f")) - 1).alias("bit")), "common-features", free=False)
        width = bits.count()
        words.append(-(-width // 8))
        rare = rows
        if width:
            rare = rows.join(small(bits, width), "f", "left_anti")
            held = rows.join(small(bits, width), "f").join(index, "r").select("b", "k", "bit")
            blocks = blocks.join(held.groupBy("b").applyInArrow(_bitmap(words[k]), "b int, bits binary").withColumnRenamed("bits", f"bits{k}"), "b", "left")
        placed = rare.join(index, "r").select("f", "b", "k").repartition("f").sortWithinPartitions("f", "b")
        lists.append(placed.mapInArrow(_lists, "x int, y int, p array<short>, q array<short>").withColumn("part", F.lit(k)))
    blocks = materialize(blocks, "blocks", free=False)
    lists = materialize(reduce(DataFrame.unionByName, lists), "shared-features")
    discard(*[rows for _, rows in parts], sizes, order)
    if any(words):
        met = blocks.select(F.col("b").alias("x")).join(blocks.select(F.col("b").alias("y")), F.expr("x <= y"))
    else:
        met = lists.select("x", "y").distinct()
    met = materialize(met, "met-blocks", free=False)
    tasks = max(1, met.count())
    tasks = tasks if tasks <= 64 else tasks // 4
    named = lambda s: blocks.select(*[F.col(c).alias(s if c == "b" else f"{c}_{s}") for c in blocks.columns])
    both = met.join(named("x"), "x").join(named("y"), "y").repartition(tasks, "x", "y")
    out = lists.repartition(tasks, "x", "y").groupBy("x", "y").cogroup(both.groupBy("x", "y"))
    return out.applyInArrow(_scored([w for w, _ in parts], metric, lower, words), f"i {kind}, j {kind}, score double")


def pairs(features: DataFrame, record: str = "record", feature: str = "feature", metric: str = "jaccard", lower: float = 0.0) -> DataFrame:
    """(i, j, score) for i < j with a score over 0 and over ``lower``."""
    rows = _distinct(features, record, feature)
    if lower < PREFIX_FROM or metric == "max_containment":
        return _blockwise([(1.0, rows)], metric, lower)
    sizes = rows.groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    often = rows.groupBy("f").agg(F.count(F.lit(1)).alias("df"))
    ranked = rows.join(often, "f").join(sizes, "r").withColumn("k", F.row_number().over(Window.partitionBy("r").orderBy("df", "f")))
    # a partner above the bound shares over lower * n features, so one of the first n - lower * n + 1 is among them
    head = ranked.where(F.col("k") <= F.col("n") - F.ceil(F.lit(lower) * F.col("n")) + 1).select("r", "f")
    a, b = head.select(F.col("r").alias("i"), "f"), head.select(F.col("r").alias("j"), "f")
    met = a.join(b, "f").where("i < j").select("i", "j").distinct()
    left = met.join(rows.select(F.col("r").alias("i"), "f"), "i")
    shared = left.join(rows.select(F.col("r").alias("j"), "f"), ["j", "f"]).groupBy("i", "j").agg(F.count(F.lit(1)).alias("shared"))
    out = shared.join(sizes.select(F.col("r").alias("i"), F.col("n").alias("n_i")), "i").join(sizes.select(F.col("r").alias("j"), F.col("n").alias("n_j")), "j")
    return out.select("i", "j", _score(metric).alias("score")).where(F.col("score") > lower)


def _distinct(features: DataFrame, record: str, feature: str) -> DataFrame:
    return features.select(F.col(record).alias("r"), F.col(feature).alias("f")).where("r IS NOT NULL AND f IS NOT NULL").distinct()


def weighted_pairs(parts: list[tuple[float, DataFrame]], lower: float = 0.0, metric: str = "jaccard", record: str = "record", feature: str = "feature") -> DataFrame:
    """``weighted`` over the ``pairs`` of feature tables, without a row for a pair in each of them."""
    total = sum(w for w, _ in parts)
    if total <= 0:
        raise ValueError("all weights are zero")
    return _blockwise([(w / total, _distinct(rows, record, feature)) for w, rows in parts if w], metric, lower)


def both_ways(edges: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Edges i < j to the full matrix: both directions, and 1.0 on the diagonal of ``records`` (id)."""
    # one pass over the edges: a union with their own flip would make them twice
    out = edges.select(F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("e"), "score").select("e.*", "score")
    if records is not None:
        out = out.unionByName(records.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("score")))
    return out


def top_k(matrix: DataFrame, k: int) -> DataFrame:
    """The k largest cells of each row; ties by column."""
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), "j"))
    return matrix.withColumn("hx_k", rank).where(F.col("hx_k") <= k).drop("hx_k")


def weighted(parts: list[tuple[float, DataFrame]], lower: float = 0.0) -> DataFrame:
    """Sum of weighted edge tables (i, j, score), weights made to sum to 1; cells over ``lower``."""
    total = sum(w for w, _ in parts)
    if total <= 0:
        raise ValueError("all weights are zero")
    rows = reduce(DataFrame.unionByName, [e.select("i", "j", (F.col("score") * F.lit(w / total)).alias("score")) for w, e in parts if w])
    return rows.groupBy("i", "j").agg(F.sum("score").alias("score")).where(F.col("score") > lower)


def kmer_size(kind: str = "protein", k: int | None = None) -> int:
    """The length of k-mers: what is asked for, else 5 residues or 15 bases."""
    if k is not None and k < 1:
        raise ValueError("k must be at least 1")
    return k if k is not None else 15 if kind == "dna" else 5


def kmers(rows: DataFrame, record: str, seq: str, k: int, kind: str = "protein") -> DataFrame:
    """Distinct (record, feature) k-mers.

    Characters that are neither letters nor digits are removed first; a k-mer with a letter
    outside the alphabet does not count.  Nucleotide k-mers are the smaller of both strands.
    """
    from helixframe.functions.sequences import reverse_complement

    clean = F.upper(F.regexp_replace(F.coalesce(F.col(seq), F.lit("")), "[^0-9A-Za-z]", ""))
    good = "^[ACDEFGHIKLMNPQRSTVWY]+$"
    if kind == "dna":
        clean, good = F.translate(clean, "U", "T"), "^[ACGTRYSWKMBDHVN]+$"
    base = rows.select(F.col(record).alias("record"), clean.alias("s")).where(F.char_length("s") >= k)
    letters = barrier(base, {"hx_c": F.filter(F.split("s", ""), lambda c: c != "")})
    slices = F.transform(F.sequence(F.lit(1), F.size("hx_c") - (k - 1)), lambda i: F.array_join(F.slice("hx_c", i, k), ""))
    mer = letters.select("record", F.explode(slices).alias("feature")).where(F.col("feature").rlike(good))
    if kind == "dna":
        mer = mer.select("record", F.least("feature", reverse_complement(F.col("feature"))).alias("feature"))
    return mer.distinct()
