"""Mixing sources to target weights by hierarchical budgeting.

The token budget flows down a domain - language - source tree in proportion to integer
weights.  A node's capacity is the tokens below it times ``max_epochs``.  A child that
cannot spend its share is filled, and what it leaves goes to its siblings; only what all
siblings together cannot spend is missing at their parent, whose own siblings get it.
Each leaf then takes whole epochs, and of the next epoch the documents that come first
in that epoch's seeded order, up to its budget.

All sums are integers, so results do not depend on the order of addition.

Defined cases: a null domain, language or source is the node ``none``; a node without a
weight in the tables has weight 1, one with weight 0 or less gets nothing; a document
counts its words plus one; the document that crosses the budget is the last one taken,
with all rows that tie with it (equal id); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import words
from helixframe.runtime import materialize

LEVELS = ("hx_domain", "hx_lang", "hx_source")
WIDE = "decimal(38,0)"


@dataclass(frozen=True)
class Mix:
    """Targets: weights by node name and level, the budget as a share of all tokens (in percent)."""

    domain: dict[str, int] = field(default_factory=lambda: {"d0": 40, "d1": 30, "d2": 20, "d3": 10})
    lang: dict[str, int] = field(default_factory=lambda: {"en": 50, "de": 20, "fr": 15, "es": 15})
    source: dict[str, int] = field(default_factory=dict)
    budget_percent: int = 90
    max_epochs: int = 2
    seed: str = "mix-1"
    bucket_rows: int = 4096


def domain_of(source: Column, groups: int = 4) -> Column:
    """The default domain: sources whose number has the same remainder; others are ``none``."""
    number = F.regexp_extract(source, r"([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (number.cast("int") % groups).cast("string"))).otherwise("none")


def _weight(name: str, table: dict[str, int]) -> Column:
    out = F.lit(1)
    if table:
        lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
        out = F.coalesce(F.element_at(lookup, F.col(name)), F.lit(1))
    return F.greatest(out, F.lit(0)).cast("long")


def _share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Gives each node (cap, w, and its parent's budget) its own ``budget``: water-filling.

    Siblings are ordered by cap / w; the first ones, which cannot spend their share of what
    those before them left, are filled.  The others divide the rest by weight, rounded down.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy("ratio", name)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    big = lambda c: F.col(c).cast(WIDE)
    rows = nodes.where("w > 0").withColumn("ratio", F.expr(f"CAST(cap AS {WIDE}) * 1000000 DIV w"))
    rows = rows.withColumns({"filled": F.coalesce(F.sum(big("cap")).over(before), F.lit(0).cast(WIDE)).cast(WIDE), "rest_w": F.sum("w").over(after).cast(WIDE)})
    rows = rows.withColumn("full", (F.expr(f"CAST(CAST(cap AS {WIDE}) * rest_w AS {WIDE}) <= CAST((CAST(total AS {WIDE}) - filled) * w AS {WIDE})")).cast("int"))
    rows = rows.withColumn("full", F.min("full").over(order))
    spent = F.coalesce(F.sum(F.when(F.col("full") == 1, big("cap"))).over(by), F.lit(0).cast(WIDE))
    open_w = F.sum(F.when(F.col("full") == 0, F.col("w"))).over(by)
    rows = rows.withColumns({"spent": spent.cast(WIDE), "open_w": open_w})
    part = F.expr(f"CAST((CAST(total AS {WIDE}) - spent) * w AS {WIDE}) DIV open_w")
    return rows.withColumn("budget", F.when(F.col("full") == 1, F.col("cap")).otherwise(F.least(part.cast("long"), F.col("cap")))).drop("ratio", "filled", "rest_w", "full", "spent", "open_w", "total")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(domain, lang, source, tokens) to the same with ``budget``, over the whole tree."""
    d, l, s = LEVELS  # noqa: E741
    leaves = leaves.withColumn("cap", F.col("tokens") * mix.max_epochs)
    weights = {d: mix.domain, l: mix.lang, s: mix.source}
    total = leaves.agg((F.sum("tokens").cast(WIDE) * mix.budget_percent).alias("t")).select(F.expr("CAST(t DIV 100 AS BIGINT)").alias("total"))
    up, at = total, []
    for name in LEVELS:
        path = [*at, name]
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("w", _weight(name, weights[name]))
        # one row above the root: no growing side
        nodes = nodes.join(up, at, "left") if at else nodes.join(F.broadcast(up), F.lit(True))
        shared = _share(nodes, at, name)
        up, at = shared.select(*path, F.col("budget").alias("total")), path
    return shared.select(*LEVELS, "tokens", "budget")


def _cutoffs(some: DataFrame, bucket_rows: int) -> DataFrame:
    """(leaf, cutoff): the last h, in order, before which the leaf's rows (h, n) do not fill ``rest``.

    The order's hexadecimal digits are searched two at a time: 256 sums for each leaf tell the
    bucket in which the budget ends, and only that bucket is searched by its next two digits,
    until no bucket has over ``bucket_rows`` rows.  No task sorts more of a leaf than that.
    """
    keys, digits = list(LEVELS), 2
    open_rows = some.withColumn("before", F.lit(0).cast("long"))
    order = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        sums = open_rows.groupBy(*keys, F.substring("h", 1, digits).alias("bucket")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.max("rest").alias("rest"), F.max("before").alias("before"))
        ends = sums.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(order), F.lit(0))).where("before < rest AND before + n >= rest")
        ends = materialize(ends.select(*keys, "bucket", "before", "rows"), "mix-ends", free=False)
        most = ends.agg(F.max("rows")).first()[0] or 0
        inside = some.withColumn("bucket", F.substring("h", 1, digits)).join(ends.drop("rows"), [*keys, "bucket"]).drop("bucket")
        if most <= bucket_rows or digits >= 32:
            break
        open_rows, digits = inside, digits + 2
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    inside = inside.withColumn("upto", F.col("before") + F.coalesce(upto, F.lit(0)))
    return inside.where("upto < rest").groupBy(*keys).agg(F.max("h").alias("cutoff"))


def mix_sources(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domain: Column | None = None) -> DataFrame:
    """The chosen rows of ``docs`` with hx_domain, hx_lang, hx_source, hx_tokens and hx_epoch (from 1)."""
    none = F.lit("none")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{id_col}`").cast("string").alias("ident"),
        F.coalesce(domain if domain is not None else domain_of(F.col(f"`{source_col}`")), none).alias(LEVELS[0]),
        F.coalesce(F.col(f"`{lang_col}`"), none).alias(LEVELS[1]),
        F.coalesce(F.col(f"`{source_col}`"), none).alias(LEVELS[2]),
        (F.size(words(F.col(f"`{text_col}`"))).cast("long") + 1).alias("n"),
    )
    small = materialize(rows.drop("row"), "mix-tokens")
    leaves = small.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"))
    plan = budgets(leaves, mix)
    # whole epochs, then a prefix of ``rest`` tokens of the next
    plan = materialize(plan.withColumns({"whole": F.expr("CAST(budget DIV tokens AS INT)"), "rest": F.expr("budget % tokens")}), "mix-plan")
    order = lambda ident, epoch: F.md5(F.concat_ws(":", F.lit(mix.seed), epoch.cast("string"), F.coalesce(ident, F.lit("null"))))
    some = small.join(plan.where("rest > 0"), list(LEVELS)).withColumn("h", order(F.col("ident"), F.col("whole") + 1))
    # rows that tie are one
    some = materialize(some.groupBy(*LEVELS, "h").agg(F.sum("n").alias("n"), F.max("rest").alias("rest")), "mix-order")
    cutoff = _cutoffs(some, mix.bucket_rows)
    leaf = plan.select(*LEVELS, "whole").join(cutoff, list(LEVELS), "left").where("whole > 0 OR cutoff IS NOT NULL")
    # a row for each leaf: written first, so that Spark knows its size and need not deal out the texts
    leaf = materialize(leaf.coalesce(1), "mix-leaves")
    got = rows.join(leaf, list(LEVELS)).withColumn("h", order(F.col("ident"), F.col("whole") + 1))
    times = F.col("whole") + F.coalesce((F.col("h") <= F.col("cutoff")).cast("int"), F.lit(0))
    got = got.where(times > 0).withColumn("hx_epoch", F.explode(F.sequence(F.lit(1), times)))
    return got.select("row.*", *LEVELS, F.col("n").alias("hx_tokens"), "hx_epoch")
