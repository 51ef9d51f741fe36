"""Editing and dividing collections: dedup, names, partitions, clusters, colours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import sequences


def sequence_key(seq: Column, both_strands: bool = False) -> Column:
    """A hash that equal sequences share; with both strands, also with the other strand and reversals."""
    s = F.upper(F.replace(F.coalesce(seq, F.lit("")), F.lit("*"), F.lit("")))
    if not both_strands:
        return F.sha2(s, 256)
    c = sequences.complement(s)
    return F.least(F.sha2(s, 256), F.sha2(c, 256), F.sha2(F.reverse(s), 256), F.sha2(F.reverse(c), 256))


def dedup(records: DataFrame, seq: str, order: str, both_strands: bool = False) -> DataFrame:
    """(order, representative, n): every record's first equal record, and how many are equal.

    Grouped by hash with partial aggregation, then joined: a hot sequence is no hot task.
    """
    keyed = records.select(F.col(order), sequence_key(F.col(seq), both_strands).alias("hx_key"))
    groups = keyed.groupBy("hx_key").agg(F.min(order).alias("representative"), F.count(F.lit(1)).alias("n"))
    return keyed.join(groups, "hx_key").select(order, "representative", "n")


def representatives(records: DataFrame, seq: str, order: str, both_strands: bool = False) -> DataFrame:
    got = dedup(records, seq, order, both_strands)
    return got.where(F.col(order) == F.col("representative")).select(order, "n")


def clean_residues(seq: Column, kind: str = "protein") -> Column:
    """Upper case without characters outside the canonical alphabet."""
    letters = {"protein": "ACDEFGHIKLMNPQRSTVWY", "dna": "ACGT", "rna": "ACGU"}[kind]
    # other letters go first: some become plain ones in upper case
    return F.regexp_replace(F.upper(F.regexp_replace(seq, "[^A-Za-z]", "")), f"[^{letters}]", "")


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Repeated names get ``_1``, ``_2``, ... in order; the first keeps its name."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return rows.withColumn("unique_name", F.when(k > 0, F.concat(F.col(name), F.lit("_"), k.cast("string"))).otherwise(F.col(name)))


def chained_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Like ``unique_names``, but suffixes that are taken by other names are skipped."""
    first = unique_names(rows, name, order)
    taken = rows.select(F.col(name).alias("hx_taken")).distinct()
    clash = first.join(taken, F.col("unique_name") == F.col("hx_taken"), "left")
    again = F.col("hx_taken").isNotNull() & (F.col("unique_name") != F.col(name))
    return clash.withColumn("unique_name", F.when(again, F.concat("unique_name", F.lit("_"), F.col(order).cast("string"))).otherwise(F.col("unique_name"))).drop("hx_taken")


def shards(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Adds a balanced contiguous shard from 0, in the order given.

    Rows are dealt into ranges of the order; places within a range are added to the number
    of rows before it, so no row number runs over the whole table.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("hx_p", F.spark_partition_id())
    counts = ranged.groupBy("hx_p").agg(F.count(F.lit(1)).alias("hx_n"))
    base = counts.select("hx_p", F.coalesce(F.sum("hx_n").over(Window.orderBy("hx_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("hx_base"), F.sum("hx_n").over(Window.partitionBy(F.lit(0))).alias("hx_total"))
    inside = F.row_number().over(Window.partitionBy("hx_p").orderBy(*order)) - 1
    at = ranged.withColumn("hx_i", inside).join(base, "hx_p").withColumn("hx_i", F.col("hx_i") + F.col("hx_base"))
    small, extra = F.floor(F.col("hx_total") / n), F.col("hx_total") % n
    cut = extra * (small + 1)
    shard = F.when(F.col("hx_i") < cut, F.floor(F.col("hx_i") / (small + 1))).otherwise(extra + F.floor((F.col("hx_i") - cut) / F.greatest(small, F.lit(1))))
    return at.withColumn("shard", shard.cast("long")).drop("hx_p", "hx_i", "hx_base", "hx_total")


def greedy_partitions(rows: DataFrame, by: str, order: Sequence[str], weight: str, target: int) -> DataFrame:
    """Adds ``part``: within each ``by``, a new part starts once the running weight reaches the target; a null weight is 0."""
    import pyarrow as pa

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", part long"
    keys = [(o, "ascending") for o in order]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(keys)
        out, part, total = [], 0, 0
        for w in t.column(weight).to_pylist():
            out.append(part)
            total += w or 0
            if total >= target:
                part, total = part + 1, 0
        return t.append_column("part", pa.array(out, pa.int64()))

    return rows.groupBy(by).applyInArrow(run, schema)


def colours(features: DataFrame, record: str, table: DataFrame, default: str = "#888888") -> DataFrame:
    """(record, colour): of the best-scoring feature that the table (name, colour) knows."""
    known = features.join(table, "name").groupBy(record).agg(F.max_by("colour", F.struct("score", "name")).alias("colour"))
    return features.select(record).distinct().join(known, record, "left").select(record, F.coalesce("colour", F.lit(default)).alias("colour"))


def palette(features: DataFrame, order: str, size: int = 360) -> DataFrame:
    """(name, hue): hues from the order in which names first appear."""
    first = features.groupBy("name").agg(F.min(order).alias("hx_first"))
    k = F.row_number().over(Window.orderBy("hx_first", "name")) - 1
    return first.select("name", F.pmod(k * 137, F.lit(size)).cast("long").alias("hue"))
