"""Session and lineage helpers shared by every operator.

Iterative operators cut their lineage with *scratch tables*: Parquet written below
``spark.checkpoint.dir``, which the driver and all executors share.  A lost executor
then costs only the tasks it ran, never the rows that earlier phases produced.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "helixframe", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library expects (a cluster brings its own)."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=base | conf).getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for scratch tables: ``spark.checkpoint.dir``, or a fresh folder in local mode."""
    sc = spark.sparkContext
    if root := sc.getConf().get("spark.checkpoint.dir"):
        return root.rstrip("/")
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="helixframe-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the scratch root that is deleted when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/helixframe-scratch/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, label: str, free: bool = True, by: str | None = None) -> DataFrame:
    """Write ``df`` to a scratch table and read it back: the result has no lineage.

    The shuffle files behind ``df`` become garbage at once; with ``free`` they are released
    here, so that the peak of disk use is that of the largest phase and not of their sum.
    Rounds over tables that shrink do without.  ``by`` is a column that gets a folder for each value.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    if free:
        release(spark)
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the scratch tables that ``materialize`` returned; they must not be read again."""
    for df in frames:
        if path := getattr(df, "_scratch_path", None):
            jvm, jsc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files and broadcasts that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Tables of up to so many short rows are sent to every executor.
SMALL = 1_000_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, known to have ``rows`` short rows, broadcast in joins if they are few; a larger one is joined by sorting."""
    return F.broadcast(df) if rows <= SMALL else df.hint("merge")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, whatever the optimiser inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)


def barrier(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns``, which the optimiser neither inlines nor evaluates twice.

    A plain projection may be merged into its consumers, and filters on it are rewritten
    in terms of its inputs; inside a lambda that would recompute an array for each of its
    elements.  A one-row generator is a step that expressions do not cross.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
