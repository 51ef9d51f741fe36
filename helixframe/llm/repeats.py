"""The distributed plan of both repeat finders.

A finder names, for every window of fixed length, an *anchor* inside it that depends on
the window's content alone.  Consecutive windows with one anchor are one row (a span), so
rows are about a tenth of the words or a hundredth of the bytes.  Windows can be equal
only if their anchors' names are, hence

1. names that stand once are dropped (a count with map-side combining);
2. where all spans of a name are equal, all their windows repeat;
3. elsewhere equal spans repeat as a whole, and one span of each distinct content is
   compared in detail, by the finder's own method.

Every join is between written tables, so that Spark can split the partitions of a hot
name.  Spans of a text are found by the row key (k1, k2) of the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import keyed
from helixframe.llm.textbuf import slices
from helixframe.runtime import discard, materialize

SPANS = "k1 long, k2 long, s1 int, s2 int, at int, name long, span long"
#: For a run of texts: (text, s1, s2, anchor, name, span) of each span, as arrays.
Finder = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]]
#: Bytes of text that are processed as one.
CHUNK = 1 << 18


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return keyed(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary"))


def spans(rows: DataFrame, find: Finder) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, _, raw, offsets in slices(batch.column(2).fill_null(b""), CHUNK):
                text, s1, s2, at, name, span = find(raw, offsets)
                if len(text):
                    text = text + first
                    columns = (k1[text], k2[text], s1.astype(np.int32), s2.astype(np.int32), at.astype(np.int32), name.view(np.int64), span.view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k1", "k2", "s1", "s2", "at", "name", "span"])

    return rows.select("k1", "k2", "text").mapInArrow(run, SPANS)


def repeated(docs: DataFrame, find: Finder, detail: Callable[[DataFrame, DataFrame], DataFrame], id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, s1, s2): runs of window starts of which every window stands anywhere else too.

    ``detail(spans, texts)`` returns such rows for spans (k1, k2, s1, s2, at, name, span, n,
    kinds) of names with several contents; it need not for those with n > 1.
    """
    rows = texts(docs, id_col, text_col)
    found = materialize(spans(rows, find), "spans")
    names = found.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("span").alias("lo"), F.max("span").alias("hi")).where("n > 1")
    names = materialize(names.select("name", (F.col("lo") == F.col("hi")).alias("alike")), "names")
    shared = materialize(found.join(names, "name"), "shared")
    discard(found, names)
    whole = shared.where("alike").select("k1", "k2", "s1", "s2")
    mixed = shared.where("NOT alike")
    one = F.min(F.struct("k1", "k2", "s1", "s2", "at")).alias("one")
    kinds = materialize(mixed.groupBy("name", "span").agg(F.count(F.lit(1)).alias("n"), one), "kinds")
    twice = mixed.join(kinds.where("n > 1").select("name", "span"), ["name", "span"], "left_semi").select("k1", "k2", "s1", "s2")
    # names whose contents are all repeated need no comparison
    open_names = materialize(kinds.groupBy("name").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("kinds")).where("least = 1").select("name", "kinds"), "open")
    single = kinds.join(open_names, "name").select("one.*", "name", "span", "n", "kinds")
    compared = materialize(detail(materialize(single, "single"), rows), "compared")
    return whole.unionByName(twice).unionByName(compared)


def windows_twice(windows: DataFrame) -> DataFrame:
    """(k1, k2, s1, s2) of the windows (k1, k2, s, n, a, b) whose hash (a, b) stands twice."""
    again = materialize(windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("a", "b"), "again")
    return windows.where("n = 1").join(again, ["a", "b"], "left_semi").select("k1", "k2", F.col("s").alias("s1"), F.col("s").alias("s2"))


def with_ranges(docs: DataFrame, ranges: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, ranges) of every document; the ranges are those of its own text only."""
    own = ranges.groupBy("k1", "k2").agg(F.collect_list(F.struct("s1", "s2")).alias("ranges"))
    return texts(docs, id_col, text_col).join(own, ["k1", "k2"], "left").select("id", "text", "ranges")


def covered(n: int, ranges, width: int) -> np.ndarray:
    """Mask of n units: those in a window of ``width`` that starts in one of the ranges."""
    edge = np.zeros(n + 1, np.int32)
    if ranges is not None and len(ranges):
        s1, s2 = (ranges.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        np.add.at(edge, s1, 1)
        np.add.at(edge, s2 + width, -1)
    return np.cumsum(edge[:n]) > 0
