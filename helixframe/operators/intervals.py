"""Interval algebra: half-open [start, end) on linear and circular records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_size(s1, e1, s2, e2) -> Column:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.greatest(F.lit(0), F.least(c(e1), c(e2)) - F.greatest(c(s1), c(s2)))


def contains(s1: str, e1: str, s2: str, e2: str) -> Column:
    return (F.col(s1) <= F.col(s2)) & (F.col(e2) <= F.col(e1))


def touches(s1: str, e1: str, s2: str, e2: str) -> Column:
    """Overlap or adjacency."""
    return (F.col(s1) <= F.col(e2)) & (F.col(s2) <= F.col(e1))


def overlap_fraction(s1: str, e1: str, s2: str, e2: str) -> Column:
    """Overlap as a share of the second interval; an empty one inside the first counts 0.1."""
    size = F.col(e2) - F.col(s2)
    inside = (F.col(s1) <= F.col(s2)) & (F.col(s2) < F.col(e1))
    return F.when(size > 0, overlap_size(s1, e1, s2, e2) / size).otherwise(F.when(inside, 0.1).otherwise(0.0))


def signed_distance(s1: str, e1: str, s2: str, e2: str, strand: str | None = None) -> Column:
    """From the first to the second: gap between the nearest edges, 0 if they overlap, turned over on the minus strand."""
    d = F.when(F.col(s2) >= F.col(e1), F.col(s2) - F.col(e1)).when(F.col(s1) >= F.col(e2), F.col(e2) - F.col(s1)).otherwise(0)
    return F.when(F.col(strand) < 0, -d).otherwise(d) if strand else d


def merge(rows: DataFrame, by: Sequence[str], start: str = "start", end: str = "end", gap: int = 0) -> DataFrame:
    """Unions of intervals that overlap or touch (or are within ``gap``): gaps and islands."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col(start) <= reach + gap, 0).otherwise(1)
    island = rows.select(*by, start, end).withColumn("hx_new", new)
    island = island.withColumn("hx_island", F.sum("hx_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.groupBy(*by, "hx_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("hx_island")


def gaps(rows: DataFrame, by: Sequence[str], lengths: DataFrame, start: str = "start", end: str = "end", length: str = "length", at_least: int = 1) -> DataFrame:
    """The stretches of [0, length) that no interval covers; records without intervals are one gap."""
    edge = lengths.select(*by, F.col(length).alias(start), F.col(length).alias(end)).unionByName(lengths.select(*by, F.lit(0).alias(start), F.lit(0).alias(end)))
    both = merge(rows, by, start, end).unionByName(edge.select(*by, start, end))
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = both.select(*by, reach.alias("hx_from"), F.col(start).alias("hx_to")).where(F.col("hx_to") - F.col("hx_from") >= at_least)
    return out.select(*by, F.col("hx_from").alias(start), F.col("hx_to").alias(end))


def coverage(rows: DataFrame, by: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Positions covered by at least one interval."""
    return merge(rows, by, start, end).groupBy(*by).agg(F.sum(F.col(end) - F.col(start)).cast("long").alias("covered"))


def covers(outer: DataFrame, inner: DataFrame, by: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Keys of ``by`` whose inner intervals all lie in merged outer ones."""
    big = merge(outer, by, start, end).select(*by, F.col(start).alias("hx_s"), F.col(end).alias("hx_e"))
    inside = inner.select(*by, start, end).distinct()
    held = inside.join(big, list(by), "left").groupBy(*by, start, end).agg(F.bool_or((F.col("hx_s") <= F.col(start)) & (F.col(end) <= F.col("hx_e"))).alias("ok"))
    return held.groupBy(*by).agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok")).where("ok").select(*by)


def longest_cover(regions: DataFrame, sources: DataFrame, by: Sequence[str], key: Sequence[str], value: str, start: str = "start", end: str = "end") -> DataFrame:
    """The value of the longest source that covers each region (ties: the smaller value)."""
    s = sources.select(*by, F.col(start).alias("hx_s"), F.col(end).alias("hx_e"), value)
    held = regions.join(s, list(by)).where((F.col("hx_s") <= F.col(start)) & (F.col(end) <= F.col("hx_e")))
    return held.groupBy(*by, *key).agg(F.max_by(value, F.struct(F.col("hx_e") - F.col("hx_s"), -F.col(value))).alias(value))


def pad(start: str, end: str, up: int, down: int, length: str, strand: str | None = None) -> Column:
    """[start - up, end + down) clipped to a linear record; upstream is by strand."""
    minus = F.col(strand) < 0 if strand else F.lit(False)
    left, right = F.when(minus, down).otherwise(up), F.when(minus, up).otherwise(down)
    return F.struct(F.greatest(F.lit(0), F.col(start) - left).alias("start"), F.least(F.col(length), F.col(end) + right).alias("end"))


def pad_circular(start: str, end: str, up: int, down: int, length: str) -> Column:
    """Parts of the padded interval on a circle, cut at the origin; paddings that meet share what is left."""
    size, free = F.col(end) - F.col(start), F.col(length) - (F.col(end) - F.col(start))
    over = F.greatest(F.lit(0), F.lit(up + down) - free)
    left = up - F.ceil(over / 2)
    right = down - F.floor(over / 2)
    left, right = F.greatest(left, F.lit(0)), F.greatest(right, F.lit(0))
    a = F.pmod(F.col(start) - left, F.col(length)).cast("long")
    n = F.least(size + left + right, F.col(length)).cast("long")
    part = lambda s, e: F.struct(s.cast("long").alias("start"), e.cast("long").alias("end"))
    return F.when(a + n <= F.col(length), F.array(part(a, a + n))).otherwise(F.array(part(a, F.col(length)), part(F.lit(0), a + n - F.col(length))))


def circular_distance(start: str, end: str, length: str) -> Column:
    return F.when(F.col(end) < F.col(start), F.pmod(F.col(end) - F.col(start), F.col(length))).otherwise(F.col(end) - F.col(start))


def to_peptide(start: str, end: str) -> Column:
    return F.struct(F.floor(F.col(start) / 3).alias("start"), F.floor(F.col(end) / 3).alias("end"))


def human(start: str, end: str, strand: str) -> Column:
    """1-based first and last position in reading direction."""
    minus = F.col(strand) < 0
    return F.struct(F.when(minus, F.col(end)).otherwise(F.col(start) + 1).alias("first"), F.when(minus, F.col(start) + 1).otherwise(F.col(end)).alias("last"))


def extract(seq: str, parts: str) -> Column:
    """The parts' sequence, each part turned over on the minus strand (parts: start, end, strand)."""
    from helixframe.functions.sequences import reverse_complement

    def one(p: Column) -> Column:
        s = F.substring(F.col(seq), p["start"] + 1, p["end"] - p["start"])
        return F.when(p["strand"] < 0, reverse_complement(s)).otherwise(s)

    return F.array_join(F.transform(parts, one), "")
