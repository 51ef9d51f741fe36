"""Queries over records and features: selection, windows, intervals, reports, editing."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import editing, intervals, reports, select, windows
from helixframe.plans import tables as T
from helixframe.plans.registry import query

FE, PL, OR = T.FEATURES_SQL, T.PLACED_SQL, T.ORDERED_SQL


def _records(spark, d):
    return T.read(spark, d, "supplier").select(F.col("s_suppkey").alias("record"), F.col("s_name").alias("title"), F.col("s_acctbal").alias("length"))


@query(f"WITH {FE} SELECT DISTINCT record FROM f WHERE name IN ('Brand#11', 'Brand#23') AND evalue <= 0.02")
def select_domains(spark, d):
    return select.with_any(T.features(spark, d).where("evalue <= 0.02"), "record", ["Brand#11", "Brand#23"])


@query(f"WITH {FE}, g AS (SELECT cds, bool_or(name='Brand#11') a, bool_or(name='Brand#12') b, bool_or(name='Brand#13') c, bool_or(name='Brand#21') x FROM f GROUP BY cds) SELECT cds FROM g WHERE (a OR b) AND NOT (c OR x)")
def select_expr(spark, d):
    return select.having(T.features(spark, d), "cds", "(Brand#11 | Brand#12) & ~(Brand#13 | Brand#21)")


@query("SELECT s_suppkey AS record, s_name AS title, s_acctbal AS length FROM supplier WHERE s_acctbal BETWEEN 1000 AND 5000")
def select_length(spark, d):
    return select.any_of(_records(spark, d), "record", gates=[select.between("length", 1000, 5000)])


@query("SELECT l_orderkey AS cds, CAST(count(*) AS BIGINT) AS n_features FROM lineitem GROUP BY 1 HAVING count(*) BETWEEN 3 AND 6")
def select_cds_count(spark, d):
    return select.counted(T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("cds")), "cds", 3, 6)


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '[A-Z][a-z]+tion') OR doc_id IN (1, 2, 3)")
def select_regex(spark, d):
    return select.any_of(T.read(spark, d, "documents").select("doc_id", "text"), "doc_id", [F.col("text").rlike("[A-Z][a-z]+tion"), F.col("doc_id").isin(1, 2, 3)]).select("doc_id")


@query(f"WITH {FE} SELECT o_orderkey AS cds FROM orders WHERE o_orderkey NOT IN (SELECT cds FROM f WHERE name = 'Brand#11')")
def select_unannotated(spark, d):
    return select.unannotated(T.read(spark, d, "orders").select(F.col("o_orderkey").alias("cds")), T.features(spark, d).where("name = 'Brand#11'"), "cds")


@query(f"WITH {FE}, h AS (SELECT DISTINCT record FROM f WHERE name = 'Brand#11' AND score > 90000) SELECT s_suppkey AS record, s_name AS title, s_acctbal AS length FROM supplier WHERE s_suppkey NOT IN (SELECT record FROM h) AND s_acctbal >= 0")
def select_invert(spark, d):
    hit = select.with_any(T.features(spark, d).where("score > 90000"), "record", ["Brand#11"])
    return select.any_of(_records(spark, d), "record", members=[hit], invert=True, gates=[select.between("length", 0)])


@query("SELECT s_suppkey AS record, s_name AS title, s_acctbal AS length FROM supplier WHERE s_acctbal > 500 ORDER BY s_suppkey LIMIT 10")
def select_first(spark, d):
    return select.any_of(_records(spark, d), "record", [F.col("length") > 500], first=10)


@query(f"WITH {FE} SELECT record, cds, name, database, part, line FROM f WHERE database = 'R' OR (NOT database IN ('A', 'N')) OR (name IN ('Brand#11', 'Brand#22', 'Brand#33') AND evalue <= 0.03)")
def filter_annotations(spark, d):
    got = select.filter_annotations(T.features(spark, d), evalue=0.03, keep=["R"], only=["A", "N"], names=["Brand#11", "Brand#22", "Brand#33"])
    return got.select("record", "cds", "name", "database", "part", "line")


#: One feature after the other, with the places that are kept so far.
_KEPT = """o AS (SELECT *, CAST(id * 7919 % 1000 AS DOUBLE) AS score FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY score DESC, id) AS rn FROM o),
r AS (SELECT record, rn, true AS ok, [{'s': start, 'e': "end"}] AS kept FROM k WHERE rn = 1
 UNION ALL SELECT record, rn, ok, CASE WHEN ok THEN list_append(kept, {'s': start, 'e': "end"}) ELSE kept END FROM (SELECT k.record, k.rn, k.start, k."end", r.kept, NOT coalesce(list_bool_or(list_transform(r.kept, lambda x: (least(k."end", x.e) - greatest(k.start, x.s)) / (k."end" - k.start) > 0.3)), false) AS ok FROM r JOIN k ON k.record = r.record AND k.rn = r.rn + 1))"""


@query(f'WITH RECURSIVE {PL}, {_KEPT} SELECT k.record, k.start, k."end", k.name, k.id, k.score FROM k JOIN r USING (record, rn) WHERE r.ok')
def nms_overlap(spark, d):
    return select.greedy_non_overlapping(T.placed(spark, d).withColumn("score", F.pmod(F.col("id") * 7919, F.lit(1000)).cast("double")), ["record"], 0.3, tie=["id"])


@query(f"WITH {FE}, r AS (SELECT record, name, score, part, cds, line, quantity, row_number() OVER (PARTITION BY record ORDER BY score DESC, part, cds, line, quantity, evalue) k FROM f) SELECT record, name, score FROM r WHERE k = 1")
def best_hit(spark, d):
    return select.best_per_key(T.features(spark, d), "record", [F.desc("score"), F.col("part"), F.col("cds"), F.col("line"), F.col("quantity"), F.col("evalue")]).select("record", "name", "score")


@query(f"WITH {FE}, r AS (SELECT record, name, sum(quantity) AS q FROM f GROUP BY ALL) SELECT record, name, q AS quantity FROM (SELECT *, row_number() OVER (PARTITION BY record ORDER BY q DESC, name) k FROM r) WHERE k <= 3")
def top_hits(spark, d):
    rows = T.features(spark, d).groupBy("record", "name").agg(F.sum("quantity").alias("quantity"))
    return select.top_per_key(rows, "record", [F.desc("quantity"), F.col("name")], 3)


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) k FROM customer WHERE c_mktsegment <> 'BUILDING') WHERE k = 1 UNION ALL SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def unique_per_taxid(spark, d):
    c = T.read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return select.exempt_unique(c, "c_nationkey", [F.desc("c_acctbal"), F.col("c_custkey")], F.col("c_mktsegment") == "BUILDING").drop("c_mktsegment")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def decoy_filter(spark, d):
    o = T.read(spark, d, "orders").select("o_orderkey", "o_custkey")
    return select.without(o, T.read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1998-01-01' AND CAST(o_orderdate AS DATE) > DATE '1995-06-30' AND o_orderstatus <> 'F'")
def assembly_filter(spark, d):
    day = F.col("o_orderdate").cast("date")
    return T.read(spark, d, "orders").where((day < F.lit("1998-01-01").cast("date")) & (day > F.lit("1995-06-30").cast("date")) & (F.col("o_orderstatus") != "F")).select("o_orderkey", "o_orderdate")


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_type) LIKE '%std%' OR lower(p_brand) = 'brand#11' OR regexp_matches(p_name, '(?i)1$')")
def profile_select(spark, d):
    p = T.read(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    a = select.profiles(p, ["p_type"], contains=["STD"]).unionByName(select.profiles(p, ["p_brand"], exact=["BRAND#11"])).unionByName(select.profiles(p, ["p_name"], regex=["1$"]))
    return a.distinct().select("p_partkey", "p_name")


@query(f"WITH {OR} SELECT a.record, a.idx AS focus_idx, b.idx - a.idx AS \"offset\", b.idx, b.id FROM o a JOIN o b ON a.record = b.record AND abs(b.idx - a.idx) <= 2 WHERE a.name = 'purchase'")
def neighborhood_rows(spark, d):
    focus = F.col("name") == "purchase"
    got = windows.neighbourhood_rows(T.ordered(spark, d), "record", focus, 2)
    return got.select("record", "focus_idx", F.col("offset").cast("long").alias("offset"), "idx", "id")


@query(f"WITH {OR}, z AS (SELECT record, count(*) AS size FROM o GROUP BY 1), n AS (SELECT a.record, a.idx AS focus_idx, size, unnest(range(-least(2, (size - 1) // 2), least(2, size - 1 - least(2, (size - 1) // 2)) + 1)) AS k FROM o a JOIN z USING (record) WHERE a.name = 'purchase') SELECT n.record, n.focus_idx, n.k AS \"offset\", b.id FROM n JOIN o b ON b.record = n.record AND b.idx = ((n.focus_idx + n.k) % size + size) % size")
def neighborhood_circular(spark, d):
    focus = F.col("name") == "purchase"
    got = windows.neighbourhood_rows(T.ordered(spark, d), "record", focus, 2, circular=True)
    return got.select("record", "focus_idx", F.col("offset").cast("long").alias("offset"), "id")


@query(f"WITH {OR} SELECT a.record, a.idx AS focus_idx, b.id FROM o a JOIN o b ON a.record = b.record AND b.start < a.\"end\" + 3600 AND b.\"end\" > a.start - 1800 WHERE a.name = 'purchase'")
def neighborhood_range(spark, d):
    focus = F.col("name") == "purchase"
    return windows.neighbourhood_range(T.ordered(spark, d), "record", focus, 1800, 3600).select("record", "focus_idx", "id")


@query(f"WITH {OR}, p AS (SELECT record, name AS current, lag(name) OVER (PARTITION BY record ORDER BY start, id) AS previous FROM o) SELECT DISTINCT record, current, previous FROM p WHERE previous IS NOT NULL")
def adjacency_pairs(spark, d):
    return windows.adjacency(T.ordered(spark, d), "record", ["start", "id"])


@query(f"WITH {OR}, s AS (SELECT record, min(idx) a, max(idx) b FROM o WHERE name NOT IN ('view', 'click') GROUP BY 1) SELECT o.record, o.id, o.idx FROM o JOIN s USING (record) WHERE idx BETWEEN a AND b")
def trim_ends(spark, d):
    return windows.trim_ends(T.ordered(spark, d), "record", ["start", "id"], F.col("name").isin("view", "click")).select("record", "id", "idx")


@query(f"WITH {OR}, z AS (SELECT record, count(*) n FROM o GROUP BY 1) SELECT o.record, o.id FROM o JOIN z USING (record) WHERE idx >= 3 AND idx < n - 3")
def trim_counts(spark, d):
    return windows.trim_counts(T.placed(spark, d), "record", ["start", "id"], 3).select("record", "id")


@query(f"WITH {FE} SELECT record, max(score) AS best_score FROM f WHERE name IN ('Brand#11', 'Brand#12') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def sort_contigs(spark, d):
    return windows.sort_records(T.features(spark, d), "record", names=["Brand#11", "Brand#12"], top=20)


#: One feature after the other, with the end of each lane; the first lane that has ended is taken.
_LANES = """k AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY start, "end", id) AS rn FROM e),
r AS (SELECT record, rn, 1 AS slot, ["end"] AS free FROM k WHERE rn = 1
 UNION ALL SELECT record, rn, slot, list_concat(list_slice(free, 1, slot - 1), ["end"], list_slice(free, slot + 1, len(free))) FROM (SELECT k.record, k.rn, k."end", r.free, CAST(coalesce(nullif(list_position(list_transform(r.free, lambda x: x <= k.start), true), 0), len(r.free) + 1) AS INT) AS slot FROM r JOIN k ON k.record = r.record AND k.rn = r.rn + 1))"""


@query(f'WITH RECURSIVE {PL}, {_LANES} SELECT k.record, k.start, k."end", k.name, k.id, CAST(r.slot - 1 AS INT) AS lane FROM k JOIN r USING (record, rn)')
def lane_assignment(spark, d):
    return windows.lanes(T.placed(spark, d), "record", tie=["id"])


@query(f"WITH {PL}, w AS (SELECT record, start, \"end\", max(\"end\") OVER (PARTITION BY record ORDER BY start, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) r FROM e), g AS (SELECT *, sum(CASE WHEN start <= r THEN 0 ELSE 1 END) OVER (PARTITION BY record ORDER BY start, \"end\" ROWS UNBOUNDED PRECEDING) k FROM w) SELECT record, min(start) AS start, max(\"end\") AS \"end\" FROM g GROUP BY record, k")
def interval_merge(spark, d):
    return intervals.merge(T.placed(spark, d), ["record"])


@query(f"WITH {PL}, w AS (SELECT record, \"end\" AS e0, lead(start) OVER (PARTITION BY record ORDER BY start) AS s1, max(\"end\") OVER (PARTITION BY record ORDER BY start ROWS UNBOUNDED PRECEDING) AS reach FROM e) SELECT record, reach AS start, s1 AS \"end\" FROM w WHERE s1 - reach >= 86400")
def unannotated_regions(spark, d):
    e = T.placed(spark, d)
    # lengths relative to the record's own span: only inner gaps count here
    inner = intervals.merge(e, ["record"])
    from pyspark.sql import Window

    nxt = F.lead("start").over(Window.partitionBy("record").orderBy("start"))
    return inner.select("record", F.col("end").alias("start"), nxt.alias("end")).where(F.col("end") - F.col("start") >= 86400)


@query("WITH x AS (SELECT l_orderkey AS record, CAST(l_linenumber * 10 AS BIGINT) AS s, CAST(l_linenumber * 10 + l_quantity AS BIGINT) AS e FROM lineitem), p AS (SELECT DISTINCT record, unnest(range(s, e)) AS p FROM x), q AS (SELECT record, p FROM p WHERE p < 150), r AS (SELECT l_orderkey AS record, 150 - (SELECT 0) AS n FROM lineitem GROUP BY 1) SELECT r.record, CAST(r.n - count(q.p) AS BIGINT) AS uncovered FROM r LEFT JOIN q USING (record) GROUP BY r.record, r.n")
def unannotated_length(spark, d):
    li = T.read(spark, d, "lineitem")
    x = li.select(F.col("l_orderkey").alias("record"), (F.col("l_linenumber") * 10).cast("long").alias("start"), (F.col("l_linenumber") * 10 + F.col("l_quantity")).cast("long").alias("end"))
    x = x.select("record", F.least("start", F.lit(150)).alias("start"), F.least("end", F.lit(150)).alias("end"))
    lengths = x.select("record").distinct().withColumn("length", F.lit(150).cast("long"))
    gaps = intervals.gaps(x, ["record"], lengths)
    got = gaps.groupBy("record").agg(F.sum(F.col("end") - F.col("start")).alias("uncovered"))
    return lengths.join(got, "record", "left").select("record", F.coalesce("uncovered", F.lit(0)).cast("long").alias("uncovered"))


@query(f"WITH {PL}, p AS (SELECT DISTINCT record, unnest(range(start // 300, (\"end\" + 299) // 300)) AS p FROM (SELECT record, start - start % 300 AS start, \"end\" - \"end\" % 300 AS \"end\" FROM e)) SELECT record, CAST(count(*) * 300 AS BIGINT) AS covered FROM p GROUP BY record")
def interval_coverage(spark, d):
    e = T.placed(spark, d).select("record", (F.col("start") - F.col("start") % 300).alias("start"), (F.col("end") - F.col("end") % 300).alias("end"))
    return intervals.coverage(e, ["record"])


@query(f"WITH {PL} SELECT a.record, a.id AS id_a, b.id AS id_b, least(a.\"end\", b.\"end\") - greatest(a.start, b.start) AS size, round((least(a.\"end\", b.\"end\") - greatest(a.start, b.start)) / (b.\"end\" - b.start), 6) AS part FROM e a JOIN e b ON a.record = b.record AND a.id < b.id AND a.start < b.\"end\" AND b.start < a.\"end\"")
def overlap_join(spark, d):
    e = T.placed(spark, d)
    cell = 3600
    cells = F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("end") - 1) / cell)))
    a = e.select("record", F.col("id").alias("id_a"), F.col("start").alias("s1"), F.col("end").alias("e1"), cells.alias("cell"))
    b = e.select("record", F.col("id").alias("id_b"), F.col("start").alias("s2"), F.col("end").alias("e2"), cells.alias("cell"))
    both = a.join(b, ["record", "cell"]).where("id_a < id_b AND s1 < e2 AND s2 < e1")
    both = both.where(F.col("cell") == F.floor(F.greatest("s1", "s2") / cell))
    return both.select("record", "id_a", "id_b", intervals.overlap_size("s1", "e1", "s2", "e2").alias("size"), F.round(intervals.overlap_fraction("s1", "e1", "s2", "e2"), 6).alias("part"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE WHEN l_returnflag = 'R' THEN greatest(0, CAST(l_quantity AS BIGINT) - 20) ELSE greatest(0, CAST(l_quantity AS BIGINT) - 10) END AS BIGINT) AS a, CAST(CASE WHEN l_returnflag = 'R' THEN least(60, CAST(l_quantity AS BIGINT) + 5 + 10) ELSE least(60, CAST(l_quantity AS BIGINT) + 5 + 20) END AS BIGINT) AS b FROM lineitem")
def pad_location(spark, d):
    li = T.read(spark, d, "lineitem")
    x = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("start"), (F.col("l_quantity").cast("long") + 5).alias("end"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("strand"), F.lit(60).cast("long").alias("length"))
    p = intervals.pad("start", "end", 10, 20, "length", "strand")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", p["start"].alias("a"), p["end"].alias("b"))


@query(f"WITH {OR}, p AS (SELECT record, start, \"end\", lead(start) OVER w AS s2, lead(\"end\") OVER w AS e2, id FROM o WINDOW w AS (PARTITION BY record ORDER BY start, id)) SELECT record, id, CAST(CASE WHEN s2 >= \"end\" THEN s2 - \"end\" WHEN start >= e2 THEN e2 - start ELSE 0 END AS BIGINT) AS distance FROM p WHERE s2 IS NOT NULL")
def domain_distance(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("record").orderBy("start", "id")
    p = T.placed(spark, d).withColumns({"s2": F.lead("start").over(w), "e2": F.lead("end").over(w)}).where("s2 IS NOT NULL")
    return p.select("record", "id", intervals.signed_distance("start", "end", "s2", "e2").cast("long").alias("distance"))


@query("WITH a AS (SELECT o_custkey AS record, o_orderkey AS id, o_totalprice AS size, o_orderstatus AS src FROM orders) SELECT record, arg_max(src, CAST(size * 100 AS BIGINT) * 1000000 + (1000000 - id % 1000000)) AS source FROM a GROUP BY record")
def location_taxid(spark, d):
    o = T.read(spark, d, "orders")
    rows = o.select(F.col("o_custkey").alias("record"), F.col("o_orderstatus").alias("src"), (F.round(F.col("o_totalprice") * 100).cast("long") * 1000000 + (1000000 - F.col("o_orderkey") % 1000000)).alias("rank"))
    return rows.groupBy("record").agg(F.max_by("src", "rank").alias("source"))


@query(f"WITH {FE}, a AS (SELECT record, count(*) AS n_features, string_agg(DISTINCT name, '; ' ORDER BY name) AS domains, round(sum(score), 2) AS score_sum, count(*) FILTER (name = 'Brand#11') AS brand11, count(*) FILTER (database = 'R') AS r_count FROM f GROUP BY 1) SELECT s_suppkey AS record, s_name AS title, 'x' AS tag, coalesce(n_features, 0) AS n_features, coalesce(domains, '') AS domains, coalesce(brand11, 0) AS brand11, coalesce(r_count, 0) AS r_count FROM supplier LEFT JOIN a ON record = s_suppkey")
def enum_contig(spark, d):
    r = reports.Report(_records(spark, d), T.features(spark, d), ["record"])
    r.column("title", F.col("title")).constant("tag", "x").count().domains().named_count("brand11", "Brand#11").kind_count("r_count", "database", "R")
    return r.run()


@query(f"WITH {FE} SELECT cds, CAST(count(*) AS BIGINT) AS n_features, CAST(count(DISTINCT name) AS BIGINT) AS n_names, max(score) AS best FROM f GROUP BY 1")
def enum_cds(spark, d):
    f = T.features(spark, d)
    r = reports.Report(f.select("cds").distinct(), f, ["cds"])
    return r.count().aggregate("n_names", F.countDistinct("name")).aggregate("best", F.max("score")).run()


@query(f"WITH {OR} SELECT record, string_agg(name, '/' ORDER BY start, id) AS architecture FROM o GROUP BY record")
def architecture(spark, d):
    o = T.ordered(spark, d)
    return reports.Report(o.select("record").distinct(), o, ["record"]).architecture(order=("start", "id")).run()


@query(f"WITH {OR}, c AS (SELECT record, id % 3 AS cds, string_agg(name, '/' ORDER BY start, id) AS txt, min(start * 1000000 + id) AS pos FROM o GROUP BY record, id % 3) SELECT record, string_agg(txt, '; ' ORDER BY pos) AS architecture FROM c GROUP BY record")
def architecture_detailed(spark, d):
    return reports.detailed_architecture(T.ordered(spark, d).withColumn("cds", F.col("id") % 3), "record", "cds", ("start", "id"))


@query(f"WITH {FE} SELECT name, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT record) AS BIGINT) AS n_records, round(avg(score), 4) AS mean_score FROM f GROUP BY 1")
def summary_domains(spark, d):
    return reports.domain_table(T.features(spark, d), "record").withColumn("mean_score", F.round("mean_score", 4))


@query(f"WITH {FE}, s AS (SELECT DISTINCT cds, kind FROM f) SELECT a.kind AS a, b.kind AS b, CAST(count(*) AS BIGINT) AS n FROM s a JOIN s b USING (cds) GROUP BY ALL")
def cooccurrence_count(spark, d):
    return reports.co_occurrence(T.features(spark, d), "cds", "kind")


@query(f"WITH {FE}, s AS (SELECT DISTINCT cds, kind FROM f), c AS (SELECT a.kind AS a, b.kind AS b, count(*) AS n FROM s a JOIN s b USING (cds) GROUP BY ALL) SELECT c.a, c.b, round(c.n / o.n, 6) AS fraction FROM c JOIN c o ON o.a = c.a AND o.b = c.a")
def cooccurrence_fraction(spark, d):
    return reports.co_occurrence_fraction(reports.co_occurrence(T.features(spark, d), "cds", "kind")).withColumn("fraction", F.round("fraction", 6))


@query("SELECT CAST(count(*) AS BIGINT) AS records, CAST(sum(n) AS BIGINT) AS cds, CAST(sum(len) AS BIGINT) AS bases, round(sum(n) / ((sum(len) + 0.01) / 10000), 6) AS cds_per_10kb FROM (SELECT doc_id, length(text) AS len, len(string_split(text, chr(10))) AS n FROM documents)")
def summary_totals(spark, d):
    x = T.read(spark, d, "documents").select("doc_id", F.char_length("text").alias("len"), F.size(F.split("text", "\n")).alias("n"))
    return reports.totals(x, "n", "len").withColumn("cds_per_10kb", F.round("cds_per_10kb", 6))


@query("WITH m AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents) SELECT CAST(least(floor((n_chars - lo) / ((hi - lo) / 50)), 49) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM documents, m GROUP BY 1")
def length_histogram(spark, d):
    return reports.length_histogram(T.read(spark, d, "documents"), "n_chars").withColumn("bin", F.col("bin").cast("long"))


@query("SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def metadata_left_join(spark, d):
    return reports.left_metadata(T.read(spark, d, "documents").select("doc_id", "source"), "doc_id", T.read(spark, d, "labels"))


@query("(SELECT doc_id, 'left' AS side FROM documents EXCEPT SELECT doc_id, 'left' FROM labels) UNION ALL (SELECT doc_id, 'right' FROM labels EXCEPT SELECT doc_id, 'right' FROM documents)")
def label_reconciliation(spark, d):
    return reports.label_difference(T.read(spark, d, "documents"), T.read(spark, d, "labels"), "doc_id")


@query("WITH k AS (SELECT doc_id, sha256(upper(replace(coalesce(text, ''), '*', ''))) AS h FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS representative, CAST(count(*) OVER (PARTITION BY h) AS BIGINT) AS n FROM k")
def dedup_exact(spark, d):
    return editing.dedup(T.read(spark, d, "documents"), "text", "doc_id")


@query("WITH s AS (SELECT l_orderkey AS id, string_agg(CASE WHEN l_returnflag = 'A' THEN 'A' WHEN l_returnflag = 'N' THEN 'C' ELSE 'T' END, '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq FROM lineitem GROUP BY 1), k AS (SELECT id, least(sha256(seq), sha256(translate(seq, 'ACGT', 'TGCA')), sha256(reverse(seq)), sha256(reverse(translate(seq, 'ACGT', 'TGCA')))) AS h FROM s) SELECT id, min(id) OVER (PARTITION BY h) AS representative, CAST(count(*) OVER (PARTITION BY h) AS BIGINT) AS n FROM k")
def dedup_both_strands(spark, d):
    return editing.dedup(order_sequences(spark, d), "seq", "id", both_strands=True)


def order_sequences(spark, d):
    """(id, seq): a DNA-like sequence for each order, from its lines' return flags."""
    li = T.read(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.translate("l_returnflag", "ANR", "ACT").alias("c")).alias("x"))
    return li.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["c"]), "").alias("seq"))


@query("SELECT doc_id, CASE WHEN k > 0 THEN source || '_' || k ELSE source END AS unique_name FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents)")
def unique_names(spark, d):
    return editing.unique_names(T.read(spark, d, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "unique_name")


@query("SELECT p_partkey, translate(p_name, ' ;:,()''\"', '________') AS name FROM part")
def clean_names(spark, d):
    from helixframe.functions import sequences

    return T.read(spark, d, "part").select("p_partkey", sequences.clean_name(F.col("p_name")).alias("name"))


@query("SELECT doc_id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS seq FROM documents")
def clean_residues(spark, d):
    return T.read(spark, d, "documents").select("doc_id", editing.clean_residues(F.col("text")).alias("seq"))


@query("SELECT doc_id, CAST(ntile(7) OVER (ORDER BY doc_id) - 1 AS BIGINT) AS shard FROM documents")
def shard_ntile(spark, d):
    return editing.shards(T.read(spark, d, "documents").select("doc_id"), ["doc_id"], 7).select("doc_id", "shard")


@query("""WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
r AS (SELECT *, 0 AS part, n_chars AS total FROM o WHERE rn = 1
 UNION ALL SELECT o.*, CASE WHEN total >= 10000 THEN part + 1 ELSE part END, CASE WHEN total >= 10000 THEN o.n_chars ELSE total + o.n_chars END FROM r JOIN o ON o.source = r.source AND o.rn = r.rn + 1)
SELECT source, doc_id, n_chars, CAST(part AS BIGINT) AS part FROM r""")
def partition_greedy(spark, d):
    return editing.greedy_partitions(T.read(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", ["doc_id"], "n_chars", 10000)


@query(f"WITH {FE}, c(name, colour) AS (VALUES ('Brand#11', '#FF0000'), ('Brand#12', '#00FF00'), ('Brand#13', '#0000FF')), k AS (SELECT cds, arg_max(colour, (score, f.name)) AS colour FROM f JOIN c ON c.name = f.name GROUP BY 1) SELECT DISTINCT f.cds, coalesce(k.colour, '#888888') AS colour FROM f LEFT JOIN k USING (cds)")
def color_best(spark, d):
    table = spark.createDataFrame([("Brand#11", "#FF0000"), ("Brand#12", "#00FF00"), ("Brand#13", "#0000FF")], "name string, colour string")
    return editing.colours(T.features(spark, d), "cds", table)


@query(f"WITH {FE}, m AS (SELECT name, min(part) AS a FROM f GROUP BY 1) SELECT name, CAST(((row_number() OVER (ORDER BY a, name) - 1) * 137) % 360 AS BIGINT) AS hue FROM m")
def color_auto(spark, d):
    return editing.palette(T.features(spark, d), "part")
