"""The library's model over the test tables.

Records are suppliers, their features are line items: a feature's name is the part's
brand, its database the return flag, its score the extended price, its e-value the
discount, its coding region the order.  Places follow from the order of the lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def features(spark: SparkSession, d: str) -> DataFrame:
    """(record, cds, name, kind, database, score, evalue, line, part)."""
    li = read(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_discount", "l_returnflag", "l_quantity")
    part = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    return li.join(part, "l_partkey").select(
        F.col("l_suppkey").alias("record"), F.col("l_orderkey").alias("cds"), F.col("p_brand").alias("name"), F.col("p_type").alias("kind"), F.col("l_returnflag").alias("database"),
        F.col("l_extendedprice").alias("score"), F.col("l_discount").alias("evalue"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"),
    )


def small_features(spark: SparkSession, d: str) -> DataFrame:
    """One feature for each supplier and part type, with a place: the smallest case with all columns."""
    return features(spark, d).groupBy("record", F.col("kind").alias("name")).agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n"))


def placed(spark: SparkSession, d: str) -> DataFrame:
    """(record, start, end, name, id): events of a user as features on a time axis in seconds."""
    e = read(spark, d, "events").select(F.col("user_id").alias("record"), F.unix_timestamp("ts").cast("long").alias("start"), F.col("event_type").alias("name"), F.col("event_id").alias("id"))
    return e.select("record", "start", (F.col("start") + 600 + F.pmod("id", F.lit(7)) * 300).alias("end"), "name", "id")


def ordered(spark: SparkSession, d: str) -> DataFrame:
    """Events with their place in the user's order."""
    w = Window.partitionBy("record").orderBy("start", "id")
    return placed(spark, d).withColumn("idx", (F.row_number().over(w) - 1).cast("long"))


#: The same tables in SQL.
FEATURES_SQL = "f AS (SELECT l_suppkey AS record, l_orderkey AS cds, p_brand AS name, p_type AS kind, l_returnflag AS database, l_extendedprice AS score, l_discount AS evalue, l_linenumber AS line, l_partkey AS part, l_quantity AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey)"
PLACED_SQL = "e AS (SELECT user_id AS record, epoch_us(ts) // 1000000 AS start, epoch_us(ts) // 1000000 + 600 + (event_id % 7) * 300 AS \"end\", event_type AS name, event_id AS id FROM events)"
ORDERED_SQL = PLACED_SQL + ", o AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY start, id) - 1 AS idx FROM e)"


def tree(spark: SparkSession, d: str) -> DataFrame:
    """A taxonomy: root 1, regions from 100, nations from 1000, customers from 1000000."""
    r = read(spark, d, "region").select((F.col("r_regionkey").cast("long") + 100).alias("taxid"), F.lit(1).cast("long").alias("parent"), F.lit("region").alias("rank"), F.col("r_name").alias("name"))
    n = read(spark, d, "nation").select((F.col("n_nationkey").cast("long") + 1000).alias("taxid"), (F.col("n_regionkey").cast("long") + 100).alias("parent"), F.lit("nation").alias("rank"), F.col("n_name").alias("name"))
    c = read(spark, d, "customer").select((F.col("c_custkey").cast("long") + 1000000).alias("taxid"), (F.col("c_nationkey").cast("long") + 1000).alias("parent"), F.lit("customer").alias("rank"), F.col("c_name").alias("name"))
    root = spark.createDataFrame([(1, 1, "root", "root")], "taxid long, parent long, rank string, name string")
    return root.unionByName(r).unionByName(n).unionByName(c)


TREE_SQL = """t AS (SELECT 1::BIGINT AS taxid, 1::BIGINT AS parent, 'root' AS rank, 'root' AS name
 UNION ALL SELECT r_regionkey + 100, 1, 'region', r_name FROM region UNION ALL SELECT n_nationkey + 1000, n_regionkey + 100, 'nation', n_name FROM nation
 UNION ALL SELECT c_custkey + 1000000, c_nationkey + 1000, 'customer', c_name FROM customer),
c AS (SELECT taxid, taxid AS ancestor, 0 AS depth FROM t UNION ALL SELECT c.taxid, t.parent, c.depth + 1 FROM c JOIN t ON c.ancestor = t.taxid WHERE t.parent <> t.taxid)"""
