"""What the corpus operators share: words, row keys and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, as a Java and RE2 class body.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The maximal runs of non-space characters; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; pure ASCII takes the fast path of ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_key(ident: Column, text: Column) -> tuple[Column, Column]:
    """The row key (k1, k2): 128 bits of the text for rows without id, the id and 64 bits for others."""
    return F.coalesce(ident, F.xxhash64(F.lit(1), text)), F.xxhash64(ident, text)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns id, text and the row key (k1, k2).

    The key tells apart the texts of rows that share an id, or have none; rows that repeat
    in full share the key, and so the decisions.
    """
    ident, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    k1, k2 = row_key(ident, text)
    return docs.select(ident.alias("id"), text.alias("text"), k1.alias("k1"), k2.alias("k2"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def hash_sample(rows: DataFrame, key: Column, n: int) -> DataFrame:
    """At most ``n`` rows, the first by hash of ``key``.

    A table with many more rows is thinned by the same hash before it is sorted, so what
    tasks send to the driver is bounded by ``n`` and does not grow with their number.
    """
    total = rows.count()
    thin = rows.withColumn("hx_order", F.xxhash64(key))
    if total > 8 * n:
        # expected rows left: 4 n; hashes are even over the signed 64-bit range
        thin = thin.where(F.col("hx_order") < F.lit(int(-(1 << 63) + (1 << 64) * 4 * n // total)))
    return thin.orderBy("hx_order").limit(n).drop("hx_order")
