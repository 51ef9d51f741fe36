"""Line dedup over levelled sorted runs (native).

``LineRuns`` is a log-structured index of line keys.  ``ingest`` takes the next batch and
merge-joins its keys with the runs: the keys that no run holds (the anti-join) become a
sorted run of (key, documents, largest id) of their own, the others go to a log of
repeats.  When a level holds ``fanout`` runs they are compacted into one run of the next
level.  A key stands in one run only, so the count of a key is that of its run and of its
repeats, and only keys that are repeated, or frequent in their first batch, are summed.

Keys are 128 bits of the stripped, ASCII-lower-cased line.

Defined cases: a null or empty text is one empty line; lines with a short key stay; rows
that repeat in full are one document; rows that share an id but not the text are
documents of their own, and all of them keep a line if their id is the largest; a null
id is smaller than every other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import SPACE_CHARS, ascii_lower, fresh, keyed, row_key
from helixframe.runtime import discard, materialize

MIN_CHARS = 20
MIN_DOCS = 3
#: Batches that a table comes in, and runs of a level that are compacted.
BATCHES, FANOUT = 4, 2
KEY = ["h1", "h2"]


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(k1, k2, id, h1, h2, at): a row for each document and key; ``at`` are its line numbers."""
    rows = keyed(docs, id_col, text_col).select("k1", "k2", "id", F.posexplode(split_lines(F.col("text"))).alias("at", "line"))
    rows = rows.select("k1", "k2", "id", "at", F.trim("line", F.lit(SPACE_CHARS)).alias("key")).where(F.char_length("key") >= min_chars)
    rows = rows.select("k1", "k2", "id", "at", ascii_lower(F.col("key")).alias("key"))
    rows = rows.select("k1", "k2", "id", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    return rows.groupBy("k1", "k2", "id", *KEY).agg(F.collect_list("at").alias("at"))  # bounded by the document


class LineRuns:
    """Levelled sorted runs of line keys (h1, h2, docs, last), and the log of repeats, in scratch tables."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels, self.repeats, self.stale = spark, fanout, [], [], []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            # no key is in two runs: compaction only deals them out by key and sorts
            rows = reduce(DataFrame.unionByName, full).repartition(*KEY).sortWithinPartitions(*KEY)
            merged = materialize(rows, f"run-{level + 1}", free=False)
            self.stale += full  # the latest run may still be read
            self._put(merged, level + 1)

    def ingest(self, lines: DataFrame) -> DataFrame:
        """Adds the batch ``lines`` (id, h1, h2; a row for each document and key): returns its keys that were new."""
        discard(*self.stale)
        self.stale = []
        batch = lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("last"))
        runs = self.runs()
        if runs:
            held = reduce(DataFrame.unionByName, [run.select(*KEY) for run in runs])
            batch = materialize(batch, "batch", free=False)
            self.repeats.append(materialize(batch.join(held.hint("merge"), KEY, "left_semi"), "repeats", free=False))
            new = batch.join(held.hint("merge"), KEY, "left_anti")
        else:
            new = batch
        run = materialize(new.sortWithinPartitions(*KEY), "run-0", free=False)
        if runs:
            discard(batch)
        self._put(run, 0)
        return run

    def frequent(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """(h1, h2, last) of the keys that at least ``min_docs`` documents hold, over all runs and repeats."""
        if not self.runs():
            return self.spark.createDataFrame([], "h1 long, h2 long, last long")
        rows = reduce(DataFrame.unionByName, self.runs())
        alone = rows.where(F.col("docs") >= min_docs)
        if self.repeats:
            again = materialize(reduce(DataFrame.unionByName, self.repeats), "repeats", free=False)
            first = rows.join(again.select(*KEY).distinct().hint("merge"), KEY, "left_semi")
            rows = first.unionByName(alone.join(again.select(*KEY).hint("merge"), KEY, "left_anti")).unionByName(again)
        else:
            rows = alone
        total = rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))
        return total.where(F.col("docs") >= min_docs).select(*KEY, "last")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(k1, k2, drop): for each document that loses lines, their line numbers in order."""
    rows = line_keys(docs, id_col, text_col, min_chars).withColumn("batch", F.pmod(F.xxhash64("k1"), F.lit(batches)).cast("int"))
    lines = materialize(rows, "lines", by="batch")  # a folder for each batch, read once
    index = LineRuns(docs.sparkSession, fanout)
    for b in range(batches):
        index.ingest(lines.where(F.col("batch") == b))
    frequent = materialize(index.frequent(min_docs), "frequent")
    hits = lines.join(frequent, KEY).where(~F.col("id").eqNullSafe(F.col("last")))
    return hits.groupBy("k1", "k2").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("at")))).alias("drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with hx_kept (the text left), hx_lines (before) and hx_dropped (lines lost)."""
    kept, n, dropped, k1, k2, drop, ls = fresh(docs, "hx_kept", "hx_lines", "hx_dropped", "hx_k1", "hx_k2", "hx_drop", "hx_ls")
    ident, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    found = repeated_lines(docs, id_col, text_col, min_chars, min_docs).select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("drop").alias(drop))
    rows = docs.withColumns(dict(zip((k1, k2), row_key(ident, text), strict=True))).join(found, [k1, k2], "left")
    rows = rows.withColumn(ls, split_lines(text))
    # set difference of line numbers: linear also in texts of very many lines
    left = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(drop))
    some = F.array_join(F.transform(left, lambda i: F.get(F.col(ls), i)), "\n")
    return rows.withColumns(
        {
            kept: F.when(F.col(drop).isNull(), F.coalesce(text, F.lit(""))).otherwise(some),
            n: F.size(ls).cast("long"),
            dropped: F.coalesce(F.size(drop), F.lit(0)).cast("long"),
        }
    ).select(*[F.col(f"`{c}`") for c in docs.columns], F.col(kept).alias("hx_kept"), F.col(n).alias("hx_lines"), F.col(dropped).alias("hx_dropped"))
