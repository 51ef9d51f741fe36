"""The same operators on streams: what is stateless runs unchanged, state has a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators import graph
from helixframe.runtime import scratch_path


def timed(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """The stream with its watermark; times without a zone are in the session's zone."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def select(stream: DataFrame, *conditions: Column) -> DataFrame:
    """Row-wise selection; runs unchanged under ``readStream``."""
    for c in conditions:
        stream = stream.where(c)
    return stream


def dedup(stream: DataFrame, keys: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return timed(stream, time, delay).dropDuplicatesWithinWatermark(keys)


def counts(stream: DataFrame, time: str, window: str, by: list[str], delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Rows by tumbling (or sliding) window and keys."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return timed(stream, time, delay).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(stream: DataFrame, time: str, gap: str, by: str, delay: str = "10 minutes") -> DataFrame:
    """Sessions of a key: rows no further apart than ``gap``."""
    w = F.session_window(time, gap)
    return timed(stream, time, delay).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


class Forest:
    """A maximum spanning forest kept over batches of edges: ``foreachBatch(forest.fold)``."""

    def __init__(self):
        self.edges: DataFrame | None = None

    def fold(self, batch: DataFrame, _epoch: int = 0) -> None:
        rows = batch.select("i", "j", "score")
        new = graph.fold_edges(self.edges, rows) if self.edges is not None else graph.spanning_forest(rows.groupBy("i", "j").agg(F.max("score").alias("score")))
        path = scratch_path(batch.sparkSession, "forest")
        new.write.parquet(path)
        self.edges = batch.sparkSession.read.parquet(path)
