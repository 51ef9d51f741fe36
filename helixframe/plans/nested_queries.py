"""Queries over records with nested features: documents with their lines, orders with their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators import records as R
from helixframe.plans import tables as T
from helixframe.plans.record_queries import order_sequences
from helixframe.plans.registry import query
from helixframe.plans.sequence_queries import _CODONS, SEQ, _frame_sql
from helixframe.sources.readers import FEATURES


def _feature(kind: str | Column, start: Column, end: Column, strand: int = 1, **qualifiers: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    part = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(strand).alias("strand"), F.lit(False).alias("before"), F.lit(False).alias("after"))
    held = F.create_map(*[x for k, v in qualifiers.items() for x in (F.lit(k), F.array(v.cast("string")))])
    return F.struct(kind.alias("type"), F.lit("").alias("operator"), F.array(part).alias("parts"), held.alias("qualifiers"))


def _records(rows: DataFrame, ident: str, seq: str, features: Column) -> DataFrame:
    return rows.select(F.col(ident).cast("string").alias("record_id"), F.lit("linear").alias("topology"), F.char_length(seq).alias("length"), F.col(seq).alias("seq"), features.cast(FEATURES).alias("features"))


def lined(spark, d) -> DataFrame:
    """Documents as records; each line that is not empty is a domain named by its number."""
    docs = T.read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line")).select("doc_id", "k", F.char_length("line").alias("n"))
    before = F.coalesce(F.sum(F.col("n") + 1).over(Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.withColumn("start", before).where("n > 0")
    made = placed.select("doc_id", "k", _feature("domain", F.col("start"), F.col("start") + F.col("n"), name=F.col("k"), evalue=F.col("k"), score=F.col("n")).alias("f"))
    held = made.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "f")), lambda x, y: x["k"] - y["k"]).alias("fs"))
    held = held.select("doc_id", F.transform("fs", lambda x: x["f"]).alias("fs"))
    return _records(docs.join(held, "doc_id"), "doc_id", "text", F.col("fs"))


LINES = """l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, text, k, length(line) AS n, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(line) - 1 AS start FROM l)"""


@query(f"WITH {LINES} SELECT CAST(doc_id AS VARCHAR) AS record_id, CAST(k AS VARCHAR) AS name, CAST(greatest(start, 20) - 20 AS INT) AS start, CAST(least(start + n, 200) - 20 AS INT) AS \"end\" FROM p WHERE least(start + n, 200) > greatest(start, 20)")
def slice_features(spark, d):
    """Documents cut to [20, 200): their lines in the slice's coordinates."""
    cut = R.sliced(lined(spark, d), R.location(20, 200)).select("record_id", F.explode("features").alias("f"))
    return cut.select("record_id", R.qualifier(F.col("f"), "name").alias("name"), F.col("f.parts")[0]["start"].alias("start"), F.col("f.parts")[0]["end"].alias("end"))


@query(f"WITH {LINES} SELECT doc_id || CASE WHEN n < length(text) THEN '_' || CAST(start + 1 AS BIGINT) || ':' || CAST(start + n AS BIGINT) ELSE '' END AS record_id, substring(text, CAST(start + 1 AS BIGINT), n) AS seq FROM p WHERE n > 0 AND k <= 2 AND n >= 10")
def extract_domains(spark, d):
    """The first three lines of each document, if they have ten letters, as records of their own."""
    return R.extract_domains(lined(spark, d), evalue=2, score=10).select("record_id", "seq")


def ordered_lines(spark, d) -> DataFrame:
    """Orders as records; a line is a coding region by its number, and a domain of it by its return flag."""
    li = T.read(spark, d, "lineitem").where("l_linenumber IS NOT NULL")
    at = F.col("l_linenumber").cast("int")
    cds = _feature("CDS", at - 1, at, cds_id=F.col("l_linenumber"), locus_tag=F.concat(F.lit("L"), F.col("l_linenumber").cast("string")))
    domain = _feature("domain", at - 1, at, cds_id=F.col("l_linenumber"), name=F.col("l_returnflag"), evalue=F.col("l_discount"), score=F.col("l_extendedprice"), identity=F.col("l_quantity"))
    rows = li.select("l_orderkey", cds.alias("c"), domain.alias("m"))
    rows = rows.groupBy("l_orderkey").agg(F.collect_list("c").alias("cs"), F.collect_list("m").alias("ms"))
    return _records(rows.withColumn("s", F.lit("ACGTACGT")), "l_orderkey", "s", F.concat("cs", "ms"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS record_id, CAST(l_linenumber AS VARCHAR) AS num, 'L' || l_linenumber AS name, CAST(count(*) FILTER (l_discount < 0.05) AS INT) AS n_domains, coalesce(string_agg(DISTINCT l_returnflag, ';' ORDER BY l_returnflag) FILTER (l_discount < 0.05), '') AS domains FROM lineitem GROUP BY l_orderkey, l_linenumber")
def cds_view(spark, d):
    """The coding regions of each order, their names and their domains below an e-value."""
    got = R.coding(ordered_lines(spark, d), evalue=0.05)
    return got.select("record_id", "num", "name", F.size("domains").alias("n_domains"), F.array_join(F.sort_array("domain_names"), ";").alias("domains"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS record_id, round(sum(l_quantity), 4) AS identities, CAST(count(*) AS INT) AS n_tags, string_agg(l_linenumber::VARCHAR, '; ' ORDER BY l_linenumber) AS numbers, 'A' AS first FROM lineitem GROUP BY l_orderkey")
def report_qualifiers(spark, d):
    """Report columns of each order: identities in sum, how many tags, the regions' numbers, the first letter."""
    f = F.col("features")
    return ordered_lines(spark, d).select("record_id", F.round(R.identity_sum(f), 4).alias("identities"), R.qualifier_count(f, "CDS", "locus_tag").alias("n_tags"), R.qualifier_list(f, "CDS", "cds_id").alias("numbers"), R.starts_with(F.col("seq")).alias("first"))


@query(f"WITH {SEQ}, m AS (SELECT MAP {{{_CODONS}}} AS t), b AS (SELECT id, reverse(translate(seq, 'ACGT', 'TGCA')) AS back, t FROM s, m) SELECT 'c' || id AS record_id, CAST(id AS VARCHAR) AS source_contig, {_frame_sql('back', 0)} AS seq FROM b")
def extract_peptides(spark, d):
    """The peptide of each order's sequence, read as one coding region on the other strand."""
    s = order_sequences(spark, d)
    cds = _feature("CDS", F.lit(0), F.char_length("seq"), -1, locus_tag=F.concat(F.lit("c"), F.col("id").cast("string")))
    return R.extract_peptides(_records(s.withColumn("f", F.array(cds)), "id", "seq", F.col("f")), every=True)


@query("SELECT CAST(doc_id AS VARCHAR) AS record_id, reverse(translate(substring(upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')), 1, 30), 'ACGT', 'TGCA')) AS seq FROM documents WHERE text IS NOT NULL")
def select_by_coord(spark, d):
    """The first thirty bases of each document's letters, from the other strand."""
    docs = T.read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.upper(F.regexp_replace("text", "[^ACGTacgt]", "")).alias("dna"))
    rows = _records(docs.withColumn("f", F.array().cast(FEATURES)), "doc_id", "dna", F.col("f"))
    places = docs.select(F.col("doc_id").cast("string").alias("record_id"), F.lit(0).alias("start"), F.lit(30).alias("end"), F.lit(-1).alias("strand"))
    return R.select_by_coord(rows, places).select("record_id", "seq")
