"""Approximate nearest neighbours: a small-world graph per shard, results merged.

Vectors are dealt by their length into shards of bounded size: vectors of one shard are about
equally long, which is what makes a graph for inner products easy to walk.  Each shard builds
a hierarchical navigable small-world graph over its distinct vectors and keeps it as flat
arrays: neighbour lists of fixed width, padded with -1, for each layer.  Queries go to the
shards: a task reads a shard once, and the queries that come after it walk its graph in step,
some hundreds at a time.  The shards' best rows are merged and ranked by exact scores.

Inner products are searched as distances: one more coordinate makes all vectors of a
shard equally long (and is zero for queries), so that the largest inner product is the
smallest distance.  The beam widens with the square root of the shard.

Defined cases: vectors that are null, empty or zero, or hold a null or a component that
is not finite, take no part; vectors of different length live in different shards and
never meet; equal vectors are one node that carries all their ids; rows with the query's
id are not its neighbours; fewer candidates than k: all of them; ties go to the smaller id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.runtime import materialize

#: Links of a node in upper layers (twice that in layer 0), and beam widths.
LINKS = 16
BUILD_BEAM = 80
SEARCH_BEAM = 140
#: There are at least MIN_SHARDS shards, and none of more than about SHARD_ROWS vectors.  A
#: search costs the logarithm of a shard's size but grows with their number, so shards are
#: as large as a task can hold.
SHARD_ROWS = 65536
MIN_SHARDS = 8
#: Vectors of one shard differ in length by this factor at most.
BAND = 1.15
#: A shard of so many vectors is searched with the plain beam; a larger one with a wider beam.
BEAM_ROWS = 4096
#: Queries that one task takes through a shard, and how many of them walk in step.
QUERY_BLOCK = 1 << 18
IN_STEP = 512


def beam_for(nodes: int, beam: int) -> int:
    return int(beam * max(1.0, np.sqrt(nodes / BEAM_ROWS)))


class Graph:
    """A layered small-world graph over the rows of ``x`` (unit geometry: all rows equally long)."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray], level: np.ndarray, entry: int):
        self.x, self.layers, self.level, self.entry = x, layers, level, entry

    @classmethod
    def build(cls, x: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, batch: int = 256) -> Graph:
        n = len(x)
        rng = np.random.default_rng(7)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(links)).astype(np.int64), 6)
        level[0] = level.max() if n else 0
        layers = [np.full((n, 2 * links if k == 0 else links), -1, np.int32) for k in range(int(level.max()) + 1 if n else 1)]
        g = cls(x, layers, level, 0)
        done = 1
        while done < n:
            new = np.arange(done, min(n, done + min(batch, done)))
            g._insert(new, links, beam)
            done = int(new[-1]) + 1
        return g

    def _insert(self, new: np.ndarray, links: int, beam: int) -> None:
        """Links a batch of nodes, each to near nodes of the graph and of the batch."""
        q = self.x[new]
        at = np.full((len(new), 1), self.entry)
        top = len(self.layers) - 1
        for layer in range(top, -1, -1):
            take = np.flatnonzero(self.level[new] >= layer)
            width = beam if len(take) else 1
            got, sims = self._walk(q, at, layer, width)
            at = got[:, : max(1, min(8, got.shape[1]))]
            if not len(take):
                continue
            mine = new[take]
            # earlier nodes of the batch are candidates too
            peers = q[take] @ q[take].T
            peers[np.triu_indices(len(take))] = -np.inf
            k = min(links, len(take))
            near = np.argpartition(-peers, k - 1, axis=1)[:, :k]
            ids = np.concatenate([got[take], np.where(np.isfinite(np.take_along_axis(peers, near, 1)), mine[near], -1)], axis=1)
            s = np.concatenate([sims[take], np.take_along_axis(peers, near, 1)], axis=1)
            s[ids < 0] = -np.inf
            chosen = self._diverse(ids, s, links)
            cap = self.layers[layer].shape[1]
            self.layers[layer][mine, :links] = chosen
            back: dict[int, list[int]] = {}
            for node, row in zip(mine.tolist(), chosen.tolist(), strict=True):
                for other in row:
                    if other >= 0:
                        back.setdefault(other, []).append(node)
            over_ids, over = [], []
            for other, more in back.items():
                row = self.layers[layer][other]
                have = row[row >= 0].tolist()
                have = list(dict.fromkeys([*have, *more]))
                if len(have) <= cap:
                    row[: len(have)] = have
                else:
                    over_ids.append(other)
                    over.append(have)
            if over:
                width = max(map(len, over))
                ids = np.array([h + [-1] * (width - len(h)) for h in over])
                s = np.einsum("qd,qkd->qk", self.x[over_ids], self.x[ids])
                s[ids < 0] = -np.inf
                self.layers[layer][over_ids] = self._diverse(ids, s, cap)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
        """Of each row's candidates, nearest first, those not nearer to one chosen before; then the nearest others."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        width = min(ids.shape[1], 3 * keep)
        ids, sims = ids[:, :width], sims[:, :width]
        v = self.x[ids]
        among = np.einsum("qad,qbd->qab", v, v)
        chosen = np.zeros(ids.shape, bool)
        for c in range(width):
            blocked = (chosen & (among[:, c, :] > sims[:, c : c + 1])).any(axis=1)
            chosen[:, c] = ~blocked & np.isfinite(sims[:, c]) & (chosen.sum(axis=1) < keep)
        rank = np.where(chosen, 0, 1) + 2 * ~np.isfinite(sims)
        best = np.argsort(rank, axis=1, kind="stable")[:, :keep]
        out = np.where(np.isfinite(np.take_along_axis(sims, best, 1)), np.take_along_axis(ids, best, 1), -1)
        if out.shape[1] < keep:
            out = np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)
        return out.astype(np.int32)

    def _walk(self, q: np.ndarray, start: np.ndarray, layer: int, beam: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries in step: (ids, similarities), nearest first, padded with -1."""
        nq, table = len(q), self.layers[layer]
        rows = np.arange(nq)[:, None]
        seen = np.zeros((nq, len(self.x)), bool)
        start = np.where(start < 0, self.entry, start)
        sims = np.einsum("qd,qkd->qk", q, self.x[start])
        first = np.ones(start.shape, bool)
        for c in range(1, start.shape[1]):
            first[:, c] = ~(start[:, :c] == start[:, c : c + 1]).any(axis=1)
        ids = np.where(first, start, -1)
        sims = np.where(first, sims, -np.inf)
        seen[rows, start] = True
        opened = np.zeros(ids.shape, bool)
        while True:
            todo = np.where(opened | (ids < 0), -np.inf, sims)
            k = min(step, todo.shape[1])
            pick = np.argpartition(-todo, k - 1, axis=1)[:, :k] if todo.shape[1] > k else np.broadcast_to(np.arange(k), (nq, k))
            live = np.isfinite(np.take_along_axis(todo, pick, 1))
            going = np.flatnonzero(live.any(axis=1))
            if not len(going):
                break
            p, lv = pick[going], live[going]
            mark = opened[going]
            np.put_along_axis(mark, p, np.take_along_axis(mark, p, 1) | lv, 1)
            opened[going] = mark
            near = np.where(lv[:, :, None], table[np.maximum(np.take_along_axis(ids[going], p, 1), 0)], -1).reshape(len(going), -1)
            fresh = (near >= 0) & ~seen[going[:, None], np.maximum(near, 0)]
            # a node that two opened nodes share counts once
            order = np.argsort(near, axis=1, kind="stable")
            ranked = np.take_along_axis(near, order, 1)
            twice = np.zeros(near.shape, bool)
            np.put_along_axis(twice, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
            fresh &= ~twice
            keep = int(fresh.sum(axis=1).max())
            if not keep:
                continue
            cols = np.argsort(~fresh, axis=1, kind="stable")[:, :keep]
            near = np.where(np.take_along_axis(fresh, cols, 1), np.take_along_axis(near, cols, 1), -1)
            ok = near >= 0
            seen[np.broadcast_to(going[:, None], near.shape)[ok], near[ok]] = True
            s = np.where(ok, np.einsum("qd,qkd->qk", q[going], self.x[np.maximum(near, 0)]), -np.inf)
            size = min(beam, ids.shape[1] + keep)
            all_ids = np.full((nq, size), -1, ids.dtype)
            all_s, all_o = np.full((nq, size), -np.inf, sims.dtype), np.zeros((nq, size), bool)
            all_ids[:, : min(size, ids.shape[1])] = ids[:, :size]
            all_s[:, : min(size, ids.shape[1])] = sims[:, :size]
            all_o[:, : min(size, ids.shape[1])] = opened[:, :size]
            m_ids = np.concatenate([ids[going], near], axis=1)
            m_s = np.concatenate([sims[going], s], axis=1)
            m_o = np.concatenate([opened[going], np.zeros(near.shape, bool)], axis=1)
            best = np.argpartition(-m_s, size - 1, axis=1)[:, :size] if m_s.shape[1] > size else np.broadcast_to(np.arange(size), (len(going), size))
            all_ids[going], all_s[going], all_o[going] = (np.take_along_axis(m, best, 1) for m in (m_ids, m_s, m_o))
            ids, sims, opened = all_ids, all_s, all_o
        order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, q: np.ndarray, beam: int = SEARCH_BEAM) -> np.ndarray:
        """Ids of the nodes near each query, nearest first, padded with -1."""
        out = np.full((len(q), beam), -1)
        for a in range(0, len(q), IN_STEP):
            part = q[a : a + IN_STEP]
            at = np.full((len(part), 1), self.entry)
            for layer in range(len(self.layers) - 1, 0, -1):
                at = self._walk(part, at, layer, 1)[0]
            got = self._walk(part, at, 0, beam)[0]
            out[a : a + IN_STEP, : got.shape[1]] = got
        return out


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _stack(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


INDEX = "dim int, shard int, ids array<long>, at array<int>, vectors binary, level binary, layers array<binary>"


def index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each shard of ``vectors`` (id, v): ids by node, distinct vectors, flat neighbour arrays."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    band = F.floor(F.log(length) / F.lit(np.log(BAND)) + 0.5).cast("int")
    banded = vectors.withColumn("dim", F.size("v")).withColumn("band", band)
    # a row for each dimension and band: a double's range has some ten thousand bands
    sizes = [(r["dim"], r["band"], r["n"]) for r in banded.groupBy("dim", "band").agg(F.count(F.lit(1)).alias("n")).collect()]
    if not sizes:
        return vectors.sparkSession.createDataFrame([], INDEX)
    total, plan, next_shard = Counter(), [], Counter()
    for dim, _, n in sizes:
        total[dim] += n
    for dim, at, n in sorted(sizes):
        many = max(-(-n // shard_rows), -(-MIN_SHARDS * n // total[dim]))
        plan.append((dim, at, next_shard[dim], many))
        next_shard[dim] += many
    plan = vectors.sparkSession.createDataFrame(plan, "dim int, band int, first int, many int")
    dealt = banded.join(F.broadcast(plan), ["dim", "band"]).withColumn("shard", F.col("first") + F.pmod(F.xxhash64("id"), F.col("many")).cast("int"))

    def run(t: pa.Table) -> pa.Table:
        dim, shard = t.column("dim")[0].as_py(), t.column("shard")[0].as_py()
        t = t.sort_by("id")
        v = _stack(t.column("v"))
        nodes, inverse = np.unique(v, axis=0, return_inverse=True)
        inverse = inverse.ravel()
        order = np.argsort(inverse, kind="stable")  # by node, and within it by id
        ids = t.column("id").to_numpy()[order]
        at = np.concatenate(([0], np.cumsum(np.bincount(inverse, minlength=len(nodes))))).astype(np.int32)
        g = Graph.build(_lift(nodes))
        row = {"dim": [dim], "shard": [shard], "ids": [ids], "at": [at], "vectors": [nodes.tobytes()], "level": [g.level.tobytes()], "layers": [[x.tobytes() for x in g.layers]]}
        kinds = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("ids", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("vectors", pa.binary()), ("level", pa.binary()), ("layers", pa.list_(pa.binary()))])
        return pa.table(row, schema=kinds)

    return dealt.select("dim", "shard", "id", "v").groupBy("dim", "shard").applyInArrow(run, INDEX)


def _lift(nodes: np.ndarray) -> np.ndarray:
    """One more coordinate, so that all rows have the length of the longest."""
    size = (nodes**2).sum(axis=1)
    scale = np.sqrt(size.max())
    return np.column_stack([nodes / scale, np.sqrt(np.maximum(0, 1 - size / size.max()))]).astype(np.float32)


def search(queries: DataFrame, shards: DataFrame, k: int, block: int = QUERY_BLOCK, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each of ``queries`` (id, v) over all shards."""
    spark = queries.sparkSession
    shards = shards.select("*", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("qid"), F.lit(None).cast("array<double>").alias("q"))
    here = {r["dim"]: r["shards"] for r in shards.groupBy("dim").agg(F.sort_array(F.collect_set("shard")).alias("shards")).collect()}
    if not here:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks = max(1, -(-queries.count() // block))
    rows = queries.withColumn("dim", F.size("v")).where(F.col("dim").isin(list(here)))
    named = F.create_map(*[x for dim, ids in here.items() for x in (F.lit(dim), F.array(*map(F.lit, ids)))])
    asked = rows.select("dim", F.explode(F.element_at(named, F.col("dim"))).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("kind"), F.col("id").alias("qid"), F.col("v").alias("q"))
    held = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<int>")))
    keys = ["dim", "shard", "block"]
    both = held.unionByName(asked, allowMissingColumns=True).repartition(sum(map(len, here.values())) * blocks, *keys).sortWithinPartitions(*keys, "kind")
    columns = both.columns
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            kind = batch.column(columns.index("kind")).to_numpy()
            cut = np.flatnonzero(kind == 0)
            # queries of the shard that was read last come first, then each shard with its own
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
                if a < b and kind[a] == 0:
                    shard = Shard({name: batch.column(i)[a] for i, name in enumerate(columns)})
                    a += 1
                for at in range(a, b, IN_STEP):
                    part = batch.slice(at, min(IN_STEP, b - at))
                    found = shard.best(part.column(columns.index("qid")).to_numpy(), _stack(part.column(columns.index("q"))), k, beam)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], schema=schema)

    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Shard:
    """A row of the index, ready to be searched."""

    def __init__(self, row: dict):
        dim = row["dim"].as_py()
        self.nodes = np.frombuffer(row["vectors"].as_py(), np.float64).reshape(-1, dim)
        self.ids, self.at = np.asarray(row["ids"].values.to_numpy()), np.asarray(row["at"].values.to_numpy())
        layers = [np.frombuffer(x, np.int32).reshape(len(self.nodes), -1) for x in row["layers"].as_py()]
        self.graph = Graph(_lift(self.nodes), layers, np.frombuffer(row["level"].as_py(), np.int64), 0)

    def best(self, qids: np.ndarray, q: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, exact score) of the k best of each query."""
        lifted = np.column_stack([q / np.sqrt((q**2).sum(axis=1, keepdims=True)), np.zeros(len(q))]).astype(np.float32)
        got = self.graph.search(lifted, beam_for(len(self.nodes), max(beam, k + 1)))
        out_q, out_v, out_s = [], [], []
        for i in range(len(q)):
            found = got[i][got[i] >= 0]
            score = (self.nodes[found] * q[i]).sum(axis=1)
            # of equal vectors only the k + 1 smallest ids can matter
            part = [self.ids[self.at[f] : min(self.at[f + 1], self.at[f] + k + 1)] for f in found]
            vec = np.concatenate(part)
            s = np.repeat(score, [len(p) for p in part])
            other = vec != qids[i]
            vec, s = vec[other], s[other]
            best = np.lexsort((vec, -s))[:k]
            out_q.append(np.full(len(best), qids[i]))
            out_v.append(vec[best])
            out_s.append(s[best])
        return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k nearest rows, by inner product, of each row whose id is divisible by ``every``."""
    v = F.col(f"`{vector_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.cast("array<double>").alias("v")).where("id IS NOT NULL").where(usable(F.col("v")))
    shards = materialize(index(rows, shard_rows), "shards")
    return search(rows.where(F.col("id") % every == 0), shards, k)
