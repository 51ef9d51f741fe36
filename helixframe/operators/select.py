"""Selection of records and features.

A table of features has a row for each annotation of a record: its record, name, database,
e-value, score and place.  Conditions on a record's set of names become one aggregation
with a flag for each name asked for: its width depends on the question, not on the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import expressions


def having(features: DataFrame, record: str, text: str, name: str = "name") -> DataFrame:
    """The records with features whose names satisfy a boolean expression."""
    tree = expressions.parse(text)
    atoms = expressions.names(tree)
    flags = [F.coalesce(F.bool_or(F.col(name) == a), F.lit(False)).alias(f"hx_{k}") for k, a in enumerate(atoms)]
    got = features.groupBy(record).agg(*flags)
    return got.where(expressions.column(tree, lambda n: F.col(f"hx_{atoms.index(n)}"))).select(record)


def with_any(features: DataFrame, record: str, names: Sequence[str], name: str = "name") -> DataFrame:
    """The records with a feature of one of these names."""
    return features.where(F.col(name).isin(*names)).select(record).distinct()


def unannotated(records: DataFrame, features: DataFrame, record: str) -> DataFrame:
    return records.join(features.select(record), record, "left_anti")


def any_of(records: DataFrame, record: str, conditions: Sequence[Column] = (), members: Sequence[DataFrame] = (), invert: bool = False, gates: Sequence[Column] = (), first: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Records that meet one of the conditions or are in one of the tables; then all gates.

    Without any condition all are chosen; ``invert`` turns the choice over before the gates.
    """
    rows, flags = records, [F.coalesce(c, F.lit(False)) for c in conditions]
    for k, table in enumerate(members):
        rows = rows.join(table.select(record).distinct().withColumn(f"hx_in{k}", F.lit(True)), record, "left")
        flags.append(F.coalesce(F.col(f"hx_in{k}"), F.lit(False)))
    chosen = reduce(lambda a, b: a | b, flags) if flags else F.lit(True)
    rows = rows.where(~chosen if invert else chosen)
    for gate in gates:
        rows = rows.where(gate)
    rows = rows.select(*[F.col(c) for c in records.columns])
    return rows.orderBy(*(order or [record])).limit(first) if first is not None else rows


def between(c: str, lower=None, upper=None) -> Column:
    """lower <= c <= upper, for the bounds that are given."""
    out = F.lit(True)
    if lower is not None:
        out = out & (F.col(c) >= lower)
    if upper is not None:
        out = out & (F.col(c) <= upper)
    return out


def counted(features: DataFrame, record: str, lower: int | None = None, upper: int | None = None) -> DataFrame:
    """Records by their number of features (1 at least)."""
    return features.groupBy(record).agg(F.count(F.lit(1)).alias("n_features")).where(between("n_features", lower, upper))


def filter_annotations(features: DataFrame, evalue: float | None = None, keep: Sequence[str] = (), only: Sequence[str] = (), names: Sequence[str] = ()) -> DataFrame:
    """Annotations of the databases in ``keep`` stay; of the others, those in ``only``, with one of ``names``, up to ``evalue``."""
    rest = F.lit(True)
    if only:
        # databases that are not filtered pass untouched
        rest = ~F.col("database").isin(*only)
    tests = F.lit(True)
    if names:
        tests = tests & F.col("name").isin(*names)
    if evalue is not None:
        tests = tests & (F.col("evalue") <= evalue)
    passed = (rest | tests) if only else tests
    return features.where((F.col("database").isin(*keep) | passed) if keep else passed)


def greedy_non_overlapping(features: DataFrame, by: Sequence[str], allowed: float, strict: bool = True, score: str = "score", start: str = "start", end: str = "end", tie: Sequence[str] = ()) -> DataFrame:
    """Best score first; drops a feature that overlaps a kept one by more than ``allowed`` of its length.

    ``strict`` False drops at equality too.  A fraction of 1 keeps all.  The fold runs for
    each group of ``by`` (a coding region), whose features are few.
    """
    import pyarrow as pa

    if allowed >= 1:
        return features
    keys, schema = [(score, "descending"), *[(t, "ascending") for t in tie]], features.schema

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(keys)
        s, e = t.column(start).to_pylist(), t.column(end).to_pylist()
        kept: list[int] = []
        for i in range(len(s)):
            size = e[i] - s[i]
            for k in kept:
                part = (min(e[i], e[k]) - max(s[i], s[k])) / size if size else (0.1 if s[k] <= s[i] < e[k] else 0.0)
                if part > allowed or (not strict and part == allowed and part > 0):
                    break
            else:
                kept.append(i)
        return t.take(pa.array(kept, pa.int64()))

    return features.groupBy(*by).applyInArrow(run, schema)


def best_per_key(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return top_per_key(rows, key, order, 1)


def top_per_key(rows: DataFrame, key: str | Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("hx_rank", rank).where(F.col("hx_rank") <= k).drop("hx_rank")


def exempt_unique(rows: DataFrame, key: str, order: Sequence[Column], exempt: Column) -> DataFrame:
    """The best row of each key, and all exempt rows."""
    return best_per_key(rows.where(~exempt), key, order).unionByName(rows.where(exempt))


def without(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the others' (decoys, excluded accessions)."""
    return rows.join(others.select(key), key, "left_anti")


def profiles(table: DataFrame, fields: Sequence[str], exact: Sequence[str] = (), contains: Sequence[str] = (), regex: Sequence[str] = (), case: bool = False) -> DataFrame:
    """Profiles of which one of the fields equals, contains or matches one of the queries."""
    tests = []
    for f in fields:
        c = F.col(f) if case else F.lower(f)
        low = (lambda x: x) if case else str.lower
        tests += [c == low(x) for x in exact] + [F.contains(c, F.lit(low(x))) for x in contains]
        tests += [F.col(f).rlike(x if case else f"(?i){x}") for x in regex]
    return table.where(reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])) if tests else table


def with_download(rows: DataFrame, path: str = "ftp_path") -> DataFrame:
    """Assemblies that name a place to fetch them from (not ``na``)."""
    return rows.where(F.trim(path) != "na")
