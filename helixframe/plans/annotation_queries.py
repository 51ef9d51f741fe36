"""Queries that clean, annotate, align and count records."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import matrix, taxonomy
from helixframe.operators import records as R
from helixframe.plans import tables as T
from helixframe.plans.graph_queries import FULL, TREE, full, r6, sets, suppliers
from helixframe.plans.nested_queries import _feature, _records
from helixframe.plans.record_queries import order_sequences
from helixframe.plans.registry import query
from helixframe.plans.sequence_queries import _CODONS, SEQ, _frame_sql
from helixframe.sources import writers


@query(f"WITH {SEQ}, m AS (SELECT MAP {{{_CODONS}}} AS t), b AS (SELECT id, seq, reverse(translate(seq, 'ACGT', 'TGCA')) AS back, t FROM s, m) SELECT CAST(id AS VARCHAR) AS record_id, CAST(1 AS INT) AS n_cds, CAST(1 AS INT) AS n_features, length(seq) || '_-1_1' AS cds_id, {_frame_sql('back', 0)} AS translation FROM b")
def clean_records(spark, d):
    """Each order's sequence as a coding region on the other strand, numbered and translated; its domain is removed."""
    n = F.char_length("seq")
    rows = order_sequences(spark, d).withColumn("f", F.array(_feature("CDS", F.lit(0), n, -1, note=F.col("id")), _feature("domain", F.lit(0), n, name=F.col("id"))))
    got = R.cleaned(_records(rows, "id", "seq", F.col("f")), annotations=True)
    first = F.get("features", F.lit(0))
    return got.select("record_id", "n_cds", F.size("features").alias("n_features"), R.qualifier(first, "cds_id").alias("cds_id"), R.qualifier(first, "translation").alias("translation"))


def tagged_lines(spark, d):
    """Orders as records; each line is a source by its part, unless it is the first, and a domain by its return flag."""
    li = T.read(spark, d, "lineitem").where("l_linenumber IS NOT NULL")
    at = F.col("l_linenumber").cast("int")
    kind = F.when(at == 1, F.lit("GeneID:")).otherwise(F.lit("taxon:"))
    source = _feature("source", at - 1, at, db_xref=F.concat(kind, F.col("l_partkey").cast("string")))
    domain = _feature("domain", at - 1, at, cds_id=F.col("l_suppkey"), database=F.col("l_linestatus"), name=F.col("l_returnflag"), description=F.lit("line"), evalue=F.col("l_linenumber"), score=F.col("l_partkey"))
    rows = li.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", source.alias("s"), domain.alias("m")).alias("x"))
    order = lambda x, y: F.when(x["l_linenumber"] != y["l_linenumber"], x["l_linenumber"] - y["l_linenumber"]).when(x["l_partkey"] != y["l_partkey"], x["l_partkey"] - y["l_partkey"]).otherwise(x["l_suppkey"] - y["l_suppkey"]).cast("int")
    rows = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x"), order).alias("x")).withColumn("seq", F.lit("ACGTACGT"))
    return _records(rows, "l_orderkey", "seq", F.concat(F.transform("x", lambda x: x["s"]), F.transform("x", lambda x: x["m"])))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS record_id, CAST(l_suppkey AS VARCHAR) AS cds_id, l_linestatus AS database, string_agg(l_returnflag || ' (line, ' || l_linenumber || ', ' || l_partkey || ')', ' & ' ORDER BY l_linenumber, l_partkey) AS notes FROM lineitem GROUP BY l_orderkey, l_suppkey, l_linestatus")
def domain_notes(spark, d):
    """The notes of each region and database of an order."""
    return R.notes(tagged_lines(spark, d)).withColumn("notes", F.array_join("notes", " & "))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS record_id, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (l_linenumber <> 1), '') AS taxons FROM lineitem GROUP BY l_orderkey")
def source_taxons(spark, d):
    """The taxa that an order's sources name."""
    got = tagged_lines(spark, d).select("record_id", R.source_taxons(F.col("features")).alias("t"))
    return got.select("record_id", F.array_join(F.transform("t", lambda x: x.cast("string")), ",").alias("taxons"))


@query(f"WITH {SEQ}, p AS (SELECT id, seq, strpos(seq || 'T', 'T') - 1 AS n FROM s), t AS (SELECT max(n) AS a, max(length(seq) - n) AS b FROM p) SELECT id, repeat('N', CAST(a - n AS BIGINT)) || seq || repeat('N', CAST(b - (length(seq) - n) AS BIGINT)) AS seq FROM p, t")
def align_records(spark, d):
    """Each order's sequence, padded so that the first T of all stands in one column (or the end, where there is none)."""
    rows = order_sequences(spark, d).withColumn("n", F.instr(F.concat("seq", F.lit("T")), "T") - 1)
    return R.aligned(rows, "n").select("id", "seq")


@query(f"WITH {FULL}, n2 AS (SELECT r AS id, n FROM n), g AS (SELECT i, j, score * 100 * log10(2) - log10(a.n) - log10(b.n) AS v FROM x JOIN n2 a ON a.id = i JOIN n2 b ON b.id = j), o AS (SELECT * FROM g WHERE v > 0), r AS (SELECT i, max(v) AS t FROM o GROUP BY 1), c AS (SELECT j, max(v) AS t FROM o GROUP BY 1), w AS (SELECT o.i, o.j, v / least(r.t, c.t) AS v FROM o JOIN r ON r.i = o.i JOIN c ON c.j = o.j) SELECT a.s_suppkey AS i, b.s_suppkey AS j, round(1 - coalesce(v, 0), 6) AS score FROM supplier a CROSS JOIN supplier b LEFT JOIN w ON w.i = a.s_suppkey AND w.j = b.s_suppkey")
def efi_score_dist(spark, d):
    """Distances of suppliers by length-corrected scores, on all cells."""
    s = sets(spark, d).distinct().groupBy(F.col("record").alias("id")).agg(F.count(F.lit(1)).alias("length"))
    return r6(matrix.efi_distance(full(spark, d).withColumn("score", F.col("score") * 100), s, suppliers(spark, d)))


@query(f"WITH RECURSIVE {TREE} SELECT taxid, name, rank, count(*) AS count FROM t JOIN (SELECT o_custkey + 1000000 AS taxid FROM orders UNION ALL SELECT s_nationkey + 1000 FROM supplier) USING (taxid) GROUP BY ALL")
def taxonomy_counts(spark, d):
    """Orders by customer and suppliers by nation, as a table of taxa."""
    nodes = T.tree(spark, d)
    seen = T.read(spark, d, "orders").select((F.col("o_custkey").cast("long") + 1000000).alias("taxid"))
    seen = seen.unionByName(T.read(spark, d, "supplier").select((F.col("s_nationkey").cast("long") + 1000).alias("taxid")))
    return taxonomy.counted(seen, nodes, nodes.select("taxid", "name", F.lit("scientific name").alias("class")))


@query("SELECT o_orderkey || chr(9) || o_orderstatus || chr(9) || printf('%.1f', CAST(o_totalprice AS DOUBLE)) AS line FROM orders")
def report_lines(spark, d):
    """Orders as lines of a typed report."""
    rows = T.read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return rows.select(writers.as_row(rows).alias("line"))
