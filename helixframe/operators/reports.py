"""Reports: record-wise columns chosen by the user, and summaries of a collection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Report:
    """An ordered list of columns over records and their features; one row for each key.

    All feature columns come from a single aggregation, whatever their number.
    """

    def __init__(self, records: DataFrame, features: DataFrame, by: Sequence[str]):
        self.records, self.features, self.by = records, features, list(by)
        self.own: list[Column] = []
        self.aggregates: list[Column] = []
        self.order: list[str] = []
        self.fill: dict[str, object] = {}

    def column(self, name: str, value: Column) -> Report:
        self.own.append(value.alias(name))
        self.order.append(name)
        return self

    def constant(self, name: str, value) -> Report:
        return self.column(name, F.lit(value))

    def aggregate(self, name: str, value: Column, fill=None) -> Report:
        self.aggregates.append(value.alias(name))
        self.order.append(name)
        if fill is not None:
            self.fill[name] = fill
        return self

    def domains(self, name: str = "domains") -> Report:
        """Distinct names in order, joined by ``; ``."""
        return self.aggregate(name, F.array_join(F.sort_array(F.collect_set("name")), "; "), "")

    def architecture(self, name: str = "architecture", order: Sequence[str] = ("start", "end", "name")) -> Report:
        """All names in order of their place, joined by ``/``."""
        ordered = F.sort_array(F.collect_list(F.struct(*order, F.col("name").alias("hx_name"))))
        return self.aggregate(name, F.array_join(F.transform(ordered, lambda x: x["hx_name"]), "/"), "")

    def score_sum(self, name: str = "score_sum", of: str = "score") -> Report:
        return self.aggregate(name, F.round(F.sum(F.coalesce(of, F.lit(0.0))), 4), 0.0)

    def named_count(self, name: str, domain: str) -> Report:
        return self.aggregate(name, F.count(F.when(F.col("name") == domain, 1)), 0)

    def kind_count(self, name: str, column: str, value: str) -> Report:
        return self.aggregate(name, F.count(F.when(F.col(column) == value, 1)), 0)

    def count(self, name: str = "n_features") -> Report:
        return self.aggregate(name, F.count(F.lit(1)), 0)

    def run(self) -> DataFrame:
        base = self.records.select(*self.by, *self.own)
        if self.aggregates:
            base = base.join(self.features.groupBy(*self.by).agg(*self.aggregates), self.by, "left")
        return (base.fillna(self.fill) if self.fill else base).select(*self.by, *self.order)


def detailed_architecture(features: DataFrame, record: str, cds: str, order: Sequence[str] = ("start", "end", "name")) -> DataFrame:
    """(record, architecture): ``/`` within a coding region, ``; `` between them, in order."""
    first = features.groupBy(record, cds).agg(F.min(F.struct(*order)).alias("hx_at"), F.sort_array(F.collect_list(F.struct(*order, F.col("name").alias("hx_name")))).alias("hx_all"))
    text = first.select(record, "hx_at", cds, F.array_join(F.transform("hx_all", lambda x: x["hx_name"]), "/").alias("hx_text"))
    return text.groupBy(record).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("hx_at", cds, "hx_text"))), lambda x: x["hx_text"]), "; ").alias("architecture"))


def domain_table(features: DataFrame, record: str) -> DataFrame:
    """(name, n, n_records, mean_score): how often each domain stands, and where."""
    return features.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(record).alias("n_records"), F.avg("score").alias("mean_score"))


def co_occurrence(features: DataFrame, record: str, name: str = "name") -> DataFrame:
    """(a, b, n): records that hold both names; the diagonal counts records of a name."""
    sets = features.select(record, name).distinct()
    a, b = sets.select(record, F.col(name).alias("a")), sets.select(record, F.col(name).alias("b"))
    return a.join(b, record).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def co_occurrence_fraction(counts: DataFrame) -> DataFrame:
    """(a, b, fraction): of the records with ``a``, the share that holds ``b`` too."""
    own = counts.where("a = b").select("a", F.col("n").alias("own"))
    return counts.join(own, "a").select("a", "b", (F.col("n") / F.col("own")).alias("fraction"))


def nearest_distance(features: DataFrame, record: str, a: str, b: str) -> DataFrame:
    """(record, distance): the smallest unsigned gap between features named a and b."""
    from helixframe.operators.intervals import signed_distance

    x = features.where(F.col("name") == a).select(record, F.col("start").alias("s1"), F.col("end").alias("e1"))
    y = features.where(F.col("name") == b).select(record, F.col("start").alias("s2"), F.col("end").alias("e2"))
    d = x.join(y, record).select(record, F.abs(signed_distance("s1", "e1", "s2", "e2")).alias("d"))
    return d.groupBy(record).agg(F.min("d").alias("distance"))


def totals(records: DataFrame, n_cds: str, length: str) -> DataFrame:
    """Records, coding regions, bases and coding regions per 10 kb."""
    return records.agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(n_cds).cast("long").alias("cds"),
        F.sum(length).cast("long").alias("bases"),
        (F.sum(n_cds) / ((F.sum(length) + 0.01) / 10000)).alias("cds_per_10kb"),
    )


def length_histogram(records: DataFrame, length: str, bins: int = 50) -> DataFrame:
    """(bin, n) over equal bins from the least to the largest length."""
    ends = records.agg(F.min(length).alias("lo"), F.max(length).alias("hi"))
    both = records.select(length).join(F.broadcast(ends), F.lit(True))  # one row
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0)
    return both.groupBy(F.least(F.floor((F.col(length) - F.col("lo")) / width), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def left_metadata(nodes: DataFrame, key: str, *tables: DataFrame) -> DataFrame:
    """Nodes with the columns of each table (first row per key); absent rows are null."""
    out = nodes
    for t in tables:
        values = [c for c in t.columns if c != key]
        out = out.join(t.groupBy(key).agg(F.min(F.struct(*values)).alias("hx_v")).select(key, "hx_v.*"), key, "left")
    return out


def label_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Labels in one table only, with the side they are on."""
    return a.select(key).exceptAll(b.select(key)).distinct().withColumn("side", F.lit("left")).unionByName(b.select(key).exceptAll(a.select(key)).distinct().withColumn("side", F.lit("right")))


def first_hit(features: DataFrame, record: str, order: Sequence[str]) -> DataFrame:
    """The first best-hit feature of each record."""
    k = F.row_number().over(Window.partitionBy(record).orderBy(*order))
    return features.withColumn("hx_k", k).where("hx_k = 1").drop("hx_k")
