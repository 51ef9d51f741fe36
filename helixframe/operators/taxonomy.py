"""Taxonomies: nodes (taxid, parent, rank), names, merged and deleted ids.

The closure (taxid, ancestor, depth) is built by doubling: each round joins paths of
length d with paths of length d, so a tree of depth 40 takes 6 rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import expressions
from helixframe.runtime import materialize

UNKNOWN = 32644


def closure(nodes: DataFrame, max_rounds: int = 24) -> DataFrame:
    """(taxid, ancestor, depth), each node its own ancestor at depth 0; the root is its own parent.

    A cycle of parents is an error.
    """
    reach = nodes.select("taxid", F.col("taxid").alias("ancestor"), F.lit(0).alias("depth"))
    step = nodes.where("taxid <> parent").select("taxid", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    paths = materialize(reach.unionByName(step), "closure", free=False)
    span = 1
    for _ in range(max_rounds):  # 2 ** max_rounds levels
        far = paths.where(F.col("depth") == span).select("taxid", F.col("ancestor").alias("mid"))
        if far.isEmpty():
            break
        more = far.join(paths.where("depth > 0").select(F.col("taxid").alias("mid"), "ancestor", F.col("depth").alias("d")), "mid")
        paths = materialize(paths.unionByName(more.select("taxid", "ancestor", (F.col("d") + span).alias("depth"))), "closure", free=False)
        span *= 2
    else:
        raise ValueError(f"a taxonomy deeper than {span}, or with a cycle")
    return paths


def lineage(paths: DataFrame) -> DataFrame:
    """(taxid, lineage): from the node to the root."""
    return paths.groupBy("taxid").agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "ancestor"))), lambda x: x["ancestor"]).alias("lineage"))


def normalise(rows: DataFrame, merged: DataFrame, deleted: DataFrame, taxid: str = "taxid") -> DataFrame:
    """Old ids become the new ones; deleted and null ids become the id for unknown."""
    new = merged.select(F.col("old").alias("hx_old"), F.col("new").alias("hx_new"))
    gone = deleted.select(F.col("taxid").alias("hx_gone")).distinct()
    out = rows.join(new, F.col(taxid) == F.col("hx_old"), "left").join(gone, F.col(taxid) == F.col("hx_gone"), "left")
    best = F.when(F.col("hx_gone").isNotNull() | F.col(taxid).isNull(), F.lit(UNKNOWN)).otherwise(F.coalesce("hx_new", F.col(taxid)))
    return out.withColumn(taxid, best.cast(rows.schema[taxid].dataType)).drop("hx_old", "hx_new", "hx_gone")


def allowed(paths: DataFrame, include: Sequence[int] = (), exclude: Sequence[int] = (), merged: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """Ids in a clade of ``include`` (all, if empty) and in none of ``exclude``.

    Merged ids get the verdict of their new id; deleted ids pass if nothing is included.
    """
    hit = lambda ids: F.bool_or(F.col("ancestor").isin(*ids)) if ids else F.lit(False)
    flags = paths.groupBy("taxid").agg((hit(include) if include else F.bool_or(F.lit(True))).alias("a"), (hit(exclude) if exclude else F.bool_or(F.lit(False))).alias("b"))
    good = flags.where("a AND NOT b").select("taxid")
    out = good
    if merged is not None:
        out = out.unionByName(merged.select("old", F.col("new").alias("taxid")).join(good, "taxid").select(F.col("old").alias("taxid")))
    if deleted is not None and not include:
        out = out.unionByName(deleted.select("taxid"))
    return out.distinct()


def allowed_by(paths: DataFrame, text: str) -> DataFrame:
    """Ids whose lineage satisfies a boolean expression of ids."""
    tree = expressions.parse(text)
    atoms = expressions.names(tree)
    flags = paths.groupBy("taxid").agg(*[F.bool_or(F.col("ancestor") == int(a)).alias(f"hx_{k}") for k, a in enumerate(atoms)])
    return flags.where(expressions.column(tree, lambda n: F.col(f"hx_{atoms.index(n)}"))).select("taxid")


def at_rank(paths: DataFrame, nodes: DataFrame, names: DataFrame, rank: str) -> DataFrame:
    """(taxid, rank_taxid, rank_name): the ancestor of a rank and its scientific name."""
    of = nodes.where(F.col("rank") == rank).select(F.col("taxid").alias("ancestor"))
    label = names.where("class = 'scientific name'").select(F.col("taxid").alias("ancestor"), "name")
    return paths.join(of, "ancestor").join(label, "ancestor", "left").select("taxid", F.col("ancestor").alias("rank_taxid"), F.col("name").alias("rank_name"))


def roll_up(counts: DataFrame, paths: DataFrame) -> DataFrame:
    """(ancestor, n): counts (taxid, n) of each node's whole subtree."""
    return counts.join(paths.select("taxid", "ancestor"), "taxid").groupBy("ancestor").agg(F.sum("n").alias("n"))


def counted(taxids: DataFrame, nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(taxid, name, rank, count): how often each taxid stands in ``taxids``, with its scientific name and rank."""
    n = taxids.groupBy("taxid").agg(F.count(F.lit(1)).alias("count"))
    named = names.where(F.col("class") == "scientific name").select("taxid", "name")
    return n.join(nodes.select("taxid", "rank"), "taxid", "left").join(named, "taxid", "left").select("taxid", "name", "rank", "count")
