"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.runtime import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200) -> DataFrame:
    """(node, component): every node of an edge with the smallest node it can reach.

    Alternating large-star and small-star rounds; each is written to a scratch table, so
    the plan stays flat and a lost executor costs one round's tasks at most.  Nothing is
    gathered on the driver but one checksum of 128 bits a round, and rounds end when a round
    changes no edge; ``max_rounds`` rounds without an end are an error.  Edges with a null end
    are ignored; a self-loop makes its node a component.
    """
    raw = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    e = materialize(raw.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc", free=False)
    loops = e.where("u = v").select(F.col("u").alias("node"))
    first, now, seen = e, e.where("u <> v"), None
    for _ in range(max_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the minima are written first: then both sides of the join are plain shuffles, which Spark can split at a hub
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "cc-min", free=False)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "cc-large", free=False)
        low2 = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-min", free=False)
        small = large.join(low2, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("x"))
        small = materialize(small.select("x.u", "x.v").where("u <> v").distinct(), "cc", free=False)
        mark = small.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(1), "v", "u"))).first()
        discard(low, large, low2)
        if now is not first and hasattr(now, "_scratch_path"):
            discard(now)
        now = small
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components do not settle in {max_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(roots).unionByName(loops.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def cluster_labels(edges: DataFrame, nodes: DataFrame, lower: float) -> DataFrame:
    """(id, cluster): components over edges (i, j, score) above ``lower``, numbered from 1 by size.

    Clusters of equal size are numbered by their smallest node; nodes without edges are clusters.
    """
    found = connected_components(edges.where(F.col("score") > lower), "i", "j")
    full = nodes.select("id").distinct().join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))
    sizes = full.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    order = F.row_number().over(Window.orderBy(F.desc("size"), "component"))
    return full.join(sizes.select("component", order.cast("long").alias("cluster")), "component").select("id", "cluster")


def spanning_forest(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """The maximum spanning forest of edges (i, j, score), i < j, by rounds of Boruvka.

    In a round, every component takes its best edge to another one; ties are broken by
    (i, j), which makes the order total and the forest unique.  Edges inside a component
    are dropped, so the table shrinks with the rounds; components at least halve in each.
    """
    now = materialize(edges.where("i <> j AND score <> 0").select(F.col("i").alias("a"), F.col("j").alias("b"), "i", "j", "score"), "mst", free=False)
    out = None
    for _ in range(max_rounds):
        if now.isEmpty():
            break
        ends = now.select(F.col("a").alias("c"), "i", "j", "score").unionByName(now.select(F.col("b").alias("c"), "i", "j", "score"))
        best = ends.groupBy("c").agg(F.max_by(F.struct("i", "j", "score"), F.struct("score", -F.col("i"), -F.col("j"))).alias("e")).select("e.*").distinct()
        best = materialize(best, "mst-best", free=False)
        out = best if out is None else out.unionByName(best)
        joined = now.join(best, ["i", "j", "score"], "left_semi")
        label = materialize(connected_components(joined.select("a", "b"), "a", "b"), "mst-label", free=False)
        a = label.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        b = label.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        moved = now.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"), "i", "j", "score").where("a <> b")
        now = materialize(moved, "mst", free=False)
    else:
        raise RuntimeError(f"a forest is not complete after {max_rounds} rounds")
    if out is None:
        return edges.select("i", "j", "score").limit(0)
    return materialize(out.distinct(), "mst-edges", free=False)


def nearest_edges(edges: DataFrame, k: int) -> DataFrame:
    """Edges (i, j, score) that are among the k best of either end; ties by the other end."""
    ends = edges.select(F.col("i").alias("c"), F.col("j").alias("o"), "i", "j", "score").unionByName(edges.select(F.col("j").alias("c"), F.col("i").alias("o"), "i", "j", "score"))
    rank = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("score"), "o"))
    return ends.withColumn("k", rank).where(F.col("k") <= k).select("i", "j", "score").distinct()


def sparsify(edges: DataFrame, k: int) -> DataFrame:
    """Spanning forest and k nearest edges: what keeps a network connected and locally faithful."""
    return spanning_forest(edges).unionByName(nearest_edges(edges, k)).distinct()


def fold_edges(forest: DataFrame, more: DataFrame) -> DataFrame:
    """The forest of two edge sets from the forest of one: msf(a + b) = msf(msf(a) + b)."""
    return spanning_forest(forest.unionByName(more).groupBy("i", "j").agg(F.max("score").alias("score")))


def threshold_table(forest: DataFrame, edges: DataFrame, n_nodes: int) -> DataFrame:
    """(threshold, clusters, edges): clusters and network edges at or above each forest score."""
    steps = forest.groupBy("score").agg(F.count(F.lit(1)).alias("merges"))
    level = steps.select(F.col("score").alias("threshold"), (F.lit(n_nodes) - F.sum("merges").over(Window.orderBy(F.desc("score")))).alias("clusters"))
    counts = edges.groupBy("score").agg(F.count(F.lit(1)).alias("n")).select("score", F.lit(0).alias("kind"), "n", F.lit(None).cast("long").alias("clusters"))
    marks = level.select(F.col("threshold").alias("score"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("n"), "clusters")
    up = Window.orderBy(F.desc("score"), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.unionByName(marks).withColumn("edges", F.sum("n").over(up)).where("kind = 1").select(F.col("score").alias("threshold"), "clusters", "edges")


def hierarchy(forest: DataFrame, nodes: DataFrame, max_edges: int = 1_000_000) -> list[dict]:
    """Merges of the forest, best edge first: step, score, the two sizes, the largest component.

    A forest has fewer edges than nodes; the merge order is sequential, so the edges are
    gathered if there are at most ``max_edges``.
    """
    rows = forest.orderBy(F.desc("score"), "i", "j").limit(max_edges + 1).collect()
    if len(rows) > max_edges:
        raise ValueError(f"a hierarchy of more than {max_edges} merges")
    parent, size, node, out, largest = {}, {}, {}, [], 1

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for step, r in enumerate(rows):
        a, b = top(r["i"]), top(r["j"])
        sa, sb = size.get(a, 1), size.get(b, 1)
        parent[b], size[a] = a, sa + sb
        largest = max(largest, sa + sb)
        out.append({"step": step, "score": r["score"], "left": node.get(a, a), "right": node.get(b, b), "size": sa + sb, "impact": min(sa, sb), "largest": largest})
        node[a] = f"m{step}"
    return out


def merge_events(steps: list[dict], top: int = 25) -> list[dict]:
    """Merges of one score as one event; the strongest by impact, in order of score."""
    by: dict = {}
    for s in steps:
        e = by.setdefault(s["score"], {"score": s["score"], "merges": 0, "impact": 0, "largest": 0})
        e["merges"] += 1
        e["impact"] += s["impact"]
        e["largest"] = max(e["largest"], s["largest"])
    kept = sorted(by.values(), key=lambda e: (-e["impact"], -e["score"]))[:top]
    return sorted(kept, key=lambda e: -e["score"])
