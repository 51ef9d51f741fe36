"""Queries over similarities, matrices, networks and taxonomies."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import graph, matrix, similarity, taxonomy
from helixframe.plans import tables as T
from helixframe.plans.registry import query
from helixframe.runtime import materialize

FE, TREE = T.FEATURES_SQL, T.TREE_SQL


def sets(spark, d):
    """Suppliers and the parts they deliver."""
    return T.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("record"), F.col("l_partkey").alias("feature"))


def suppliers(spark, d):
    return T.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))


PAIRS = """s AS (SELECT DISTINCT l_suppkey AS r, l_partkey AS f FROM lineitem), n AS (SELECT r, count(*) AS n FROM s GROUP BY 1),
h AS (SELECT a.r AS i, b.r AS j, count(*) AS shared FROM s a JOIN s b ON a.f = b.f AND a.r < b.r GROUP BY ALL),
m AS (SELECT i, j, shared / (a.n + b.n - shared) AS jac, shared / least(a.n, b.n) AS maxc, shared / greatest(a.n, b.n) AS minc FROM h JOIN n a ON a.r = i JOIN n b ON b.r = j)"""
#: The matrix of the network queries: Jaccard, both directions and the diagonal.
FULL = PAIRS + ", x AS (SELECT i, j, jac AS score FROM m UNION ALL SELECT j, i, jac FROM m UNION ALL SELECT s_suppkey, s_suppkey, 1.0 FROM supplier)"


def jaccard(spark, d):
    return similarity.pairs(sets(spark, d))


def full(spark, d):
    # written once: what is made of the matrix reads it more than once
    return similarity.both_ways(materialize(jaccard(spark, d), "edges"), suppliers(spark, d))


def r6(df, c="score"):
    """Six digits of what is not negative, halves up as SQL's ``round`` does it; Spark's own goes through decimals."""
    up = F.col(c) * 1e6
    low = F.floor(up)
    return df.withColumn(c, (low + (up - low >= 0.5).cast("int")) / 1e6)


@query(f"WITH {PAIRS}, x AS (SELECT i, j, jac AS score FROM m WHERE jac > 0.02 UNION ALL SELECT j, i, jac FROM m WHERE jac > 0.02), k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, j) AS k FROM x) SELECT i, j, round(score, 6) AS score FROM k WHERE k <= 5")
def jaccard_contigs(spark, d):
    return r6(similarity.top_k(similarity.both_ways(similarity.pairs(sets(spark, d), lower=0.02)), 5))


@query(f"WITH {PAIRS} SELECT i, j, round(maxc, 6) AS score FROM m WHERE maxc > 0.05")
def max_containment(spark, d):
    return r6(similarity.pairs(sets(spark, d), metric="max_containment", lower=0.05))


@query(f"WITH {PAIRS} SELECT i, j, round(minc, 6) AS score FROM m WHERE minc > 0.05")
def min_containment(spark, d):
    return r6(similarity.pairs(sets(spark, d), metric="min_containment", lower=0.05))


ADJ = "a AS (SELECT l_suppkey AS r, l_returnflag || l_linestatus || l_linenumber AS cur, lag(l_returnflag || l_linestatus || l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_shipdate) AS prev FROM lineitem)"


def adjacency_sets(spark, d):
    from helixframe.operators import windows

    li = T.read(spark, d, "lineitem").withColumn("name", F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")))
    pairs = windows.adjacency(li, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"])
    return pairs.select(F.col("l_suppkey").alias("record"), F.concat_ws(">", "current", "previous").alias("feature"))


_ADJ_PAIRS = f"""{ADJ}, s2 AS (SELECT DISTINCT r, cur || '>' || prev AS f FROM a WHERE prev IS NOT NULL), n2 AS (SELECT r, count(*) AS n FROM s2 GROUP BY 1),
h2 AS (SELECT x.r AS i, y.r AS j, count(*) AS shared FROM s2 x JOIN s2 y ON x.f = y.f AND x.r < y.r GROUP BY ALL),
m2 AS (SELECT i, j, shared / (a1.n + b1.n - shared) AS score FROM h2 JOIN n2 a1 ON a1.r = i JOIN n2 b1 ON b1.r = j)"""


@query(f"WITH {_ADJ_PAIRS} SELECT i, j, round(score, 6) AS score FROM m2")
def adjacency_contigs(spark, d):
    return r6(similarity.pairs(adjacency_sets(spark, d)))


@query(f"WITH {PAIRS}, {_ADJ_PAIRS}, w AS (SELECT i, j, sum(v) AS score FROM (SELECT i, j, jac * 0.5 AS v FROM m UNION ALL SELECT i, j, score * 0.5 FROM m2) GROUP BY ALL) SELECT i, j, round(score, 6) AS score FROM w WHERE score > 0.1")
def weighted_similarity(spark, d):
    return r6(similarity.weighted_pairs([(0.5, sets(spark, d)), (0.5, adjacency_sets(spark, d))], 0.1))


@query(f"WITH {FULL}, k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, j) AS k FROM x) SELECT i, j, round(score, 6) AS score FROM k WHERE k <= 4")
def topk_edges(spark, d):
    return r6(similarity.top_k(full(spark, d), 4))


@query("WITH p AS (SELECT n_nationkey AS id, upper(regexp_replace(n_name, '[^0-9A-Za-z]', '', 'g')) AS s FROM nation), k AS (SELECT DISTINCT id, substring(s, CAST(i AS BIGINT), 2) AS f FROM (SELECT id, s, unnest(range(1, length(s))) AS i FROM p)), g AS (SELECT * FROM k WHERE regexp_full_match(f, '[ACDEFGHIKLMNPQRSTVWY]+')), n AS (SELECT id, count(*) n FROM g GROUP BY 1), h AS (SELECT a.id AS i, b.id AS j, count(*) AS shared FROM g a JOIN g b ON a.f = b.f AND a.id < b.id GROUP BY ALL) SELECT i, j, round(shared / (a.n + b.n - shared), 6) AS score FROM h JOIN n a ON a.id = i JOIN n b ON b.id = j")
def kmer_jaccard(spark, d):
    return r6(similarity.pairs(similarity.kmers(T.read(spark, d, "nation"), "n_nationkey", "n_name", 2)))


@query(f"WITH {FULL}, r AS (SELECT i, max(score) AS top FROM x WHERE i <> j GROUP BY 1) SELECT x.i, x.j, round(x.score / r.top, 6) AS score FROM x JOIN r USING (i) WHERE x.i <> x.j")
def row_norm_score(spark, d):
    return r6(matrix.row_norm(full(spark, d).where("i <> j")))


@query(f"WITH {FULL}, o AS (SELECT * FROM x WHERE i <> j), r AS (SELECT i, max(score) AS t FROM o GROUP BY 1), c AS (SELECT j, max(score) AS t FROM o GROUP BY 1) SELECT o.i, o.j, round(score / least(r.t, c.t), 6) AS score FROM o JOIN r ON r.i = o.i JOIN c ON c.j = o.j")
def norm_score(spark, d):
    return r6(matrix.norm(full(spark, d).where("i <> j")))


@query(f"WITH {FULL}, n2 AS (SELECT r AS id, n FROM n) SELECT i, j, round(score * 100 * log10(2) - log10(a.n) - log10(b.n), 6) AS score FROM x JOIN n2 a ON a.id = i JOIN n2 b ON b.id = j WHERE score * 100 * log10(2) - log10(a.n) - log10(b.n) > 0")
def efi_score(spark, d):
    s = sets(spark, d).distinct().groupBy(F.col("record").alias("id")).agg(F.count(F.lit(1)).alias("length"))
    return r6(matrix.efi(full(spark, d).withColumn("score", F.col("score") * 100), s))


@query(f"WITH {FULL}, r AS (SELECT i, max(score) AS t FROM x GROUP BY 1), nn AS (SELECT x.i, x.j, score / least(r.t, c.t) AS v FROM x JOIN r ON r.i = x.i JOIN r c ON c.i = x.j) SELECT a.s_suppkey AS i, b.s_suppkey AS j, round(1 - coalesce(v, 0), 6) AS score FROM supplier a CROSS JOIN supplier b LEFT JOIN nn ON nn.i = a.s_suppkey AND nn.j = b.s_suppkey")
def score_dist(spark, d):
    return r6(matrix.distance(full(spark, d), suppliers(spark, d)))


@query(f"WITH {FULL} SELECT i, j, CAST(1 AS BIGINT) AS score FROM x WHERE score > 0.1")
def bool_matrix(spark, d):
    return matrix.boolean(full(spark, d), 0.1)


@query("SELECT o_orderkey AS i, o_custkey AS j, CAST(rank() OVER (ORDER BY o_totalprice) AS BIGINT) AS rank FROM orders")
def rank_transform(spark, d):
    return matrix.rank(T.read(spark, d, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("j"), F.col("o_totalprice").alias("score")))


PP = "z AS (SELECT l_suppkey AS i, l_partkey AS j, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL)"


def part_prices(spark, d):
    li = T.read(spark, d, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.max("l_extendedprice").alias("score"))


@query(f"WITH {PP} SELECT least(i, j) AS i, greatest(i, j) AS j, max(score) AS score FROM z WHERE i <> j GROUP BY ALL")
def symmetrize_edges(spark, d):
    return matrix.symmetric(part_prices(spark, d))


@query(f"WITH {PP} SELECT i, j, score FROM z WHERE i IN (SELECT r_regionkey * 3 FROM region) AND j IN (SELECT r_regionkey * 3 FROM region)")
def subset_matrix(spark, d):
    return matrix.subset(part_prices(spark, d), T.read(spark, d, "region").select((F.col("r_regionkey") * 3).cast("long").alias("id")))


@query(f"WITH {PAIRS} SELECT CAST(count(*) AS BIGINT) AS n, round(avg(jac), 6) AS mean, round(median(jac), 6) AS median, round(min(jac), 6) AS min, round(max(jac), 6) AS max FROM m")
def matrix_stats(spark, d):
    s = matrix.statistics(jaccard(spark, d))
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "min", "max")])


@query(f"WITH {PAIRS} SELECT CAST(least(floor((CAST(round(jac, 6) AS DOUBLE)) / 0.02), 49) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY 1")
def matrix_histogram(spark, d):
    return matrix.histogram(r6(jaccard(spark, d)), 0.0, 1.0, 50).withColumn("bin", F.col("bin").cast("long"))


@query(f"WITH {PP}, s AS (SELECT i AS k, score FROM z), b AS (SELECT min(i) lo, max(i) hi, min(j) lo2, max(j) hi2 FROM z) SELECT DISTINCT i, round((i - lo) / greatest(hi - lo, hi2 - lo2) * 100, 6) AS x, round((j - lo2) / greatest(hi - lo, hi2 - lo2) * 100, 6) AS y FROM z, b")
def center_scale(spark, d):
    p = part_prices(spark, d).select("i", F.col("i").alias("x"), F.col("j").alias("y"))
    return matrix.centre_scale(p, ["x", "y"], 100.0).select("i", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")).distinct()


@query(f"WITH {PAIRS}, e AS (SELECT i AS c, j AS o, i, j, jac FROM m UNION ALL SELECT j, i, i, j, jac FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY jac DESC, o) AS k FROM e) SELECT DISTINCT i, j, round(jac, 6) AS score FROM k WHERE k <= 3")
def knn_or_symmetric(spark, d):
    return r6(graph.nearest_edges(jaccard(spark, d), 3))


#: A sparse graph with several components: orders and customers by a price band.
NET = "g AS (SELECT c_custkey AS i, c_custkey + 1 + (c_custkey * 7) % 3 AS j, CAST(c_custkey * 31 % 97 AS DOUBLE) AS score FROM customer)"


def network(spark, d):
    c = T.read(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("i"), (F.col("c_custkey") + 1 + F.col("c_custkey") * 7 % 3).alias("j"), (F.col("c_custkey") * 31 % 97).cast("double").alias("score"))


_CC = NET + ", e AS (SELECT i AS a, j AS b FROM g WHERE score > 40 UNION SELECT j, i FROM g WHERE score > 40), r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)"


@query(f"WITH RECURSIVE {_CC} SELECT node, min(seen) AS component FROM r GROUP BY 1")
def components(spark, d):
    return graph.connected_components(network(spark, d).where("score > 40"), "i", "j")


@query(f"WITH RECURSIVE {_CC}, c AS (SELECT node, min(seen) AS component FROM r GROUP BY 1), a AS (SELECT c_custkey AS id, coalesce(component, c_custkey) AS component FROM customer LEFT JOIN c ON node = c_custkey), z AS (SELECT component, count(*) AS n FROM a GROUP BY 1), o AS (SELECT component, row_number() OVER (ORDER BY n DESC, component) AS cluster FROM z) SELECT id, CAST(cluster AS BIGINT) AS cluster FROM a JOIN o USING (component)")
def cluster_labels(spark, d):
    return graph.cluster_labels(network(spark, d), T.read(spark, d, "customer").select(F.col("c_custkey").alias("id")), 40)


@query()
def spanning_forest(spark, d):
    return graph.spanning_forest(network(spark, d))


@query()
def mst_knn(spark, d):
    return graph.sparsify(network(spark, d), 1)


@query()
def mst_cluster_counts(spark, d):
    g = network(spark, d)
    return graph.threshold_table(graph.spanning_forest(g), g, T.read(spark, d, "customer").count())


@query()
def merge_events(spark, d):
    steps = graph.merge_events(graph.hierarchy(graph.spanning_forest(network(spark, d)), suppliers(spark, d)))
    return spark.createDataFrame([(e["score"], e["merges"], e["impact"], e["largest"]) for e in steps], "score double, merges long, impact long, largest long")


@query(f"WITH RECURSIVE {TREE} SELECT taxid, list(ancestor ORDER BY depth) AS lineage FROM c GROUP BY taxid")
def taxonomy_lineage(spark, d):
    return taxonomy.lineage(taxonomy.closure(T.tree(spark, d).select("taxid", "parent")))


@query(f"WITH RECURSIVE {TREE} SELECT taxid FROM c GROUP BY taxid HAVING bool_or(ancestor IN (101, 1005)) AND NOT bool_or(ancestor = 1001)")
def taxonomy_include(spark, d):
    return taxonomy.allowed(taxonomy.closure(T.tree(spark, d).select("taxid", "parent")), [101, 1005], [1001])


@query(f"WITH RECURSIVE {TREE} SELECT taxid FROM c GROUP BY taxid HAVING NOT bool_or(ancestor = 102)")
def taxonomy_exclude(spark, d):
    return taxonomy.allowed(taxonomy.closure(T.tree(spark, d).select("taxid", "parent")), (), [102])


@query(f"WITH RECURSIVE {TREE} SELECT taxid FROM c GROUP BY taxid HAVING (bool_or(ancestor = 101) OR bool_or(ancestor = 102)) AND NOT bool_or(ancestor = 1002)")
def taxonomy_expr(spark, d):
    return taxonomy.allowed_by(taxonomy.closure(T.tree(spark, d).select("taxid", "parent")), "(101 | 102) & ~1002")


@query(f"WITH RECURSIVE {TREE}, n AS (SELECT o_custkey + 1000000 AS taxid, count(*) AS n FROM orders GROUP BY 1) SELECT ancestor, CAST(sum(n) AS BIGINT) AS n FROM n JOIN c USING (taxid) GROUP BY 1")
def taxonomy_rollup(spark, d):
    counts = T.read(spark, d, "orders").groupBy((F.col("o_custkey") + 1000000).alias("taxid")).agg(F.count(F.lit(1)).alias("n"))
    return taxonomy.roll_up(counts, taxonomy.closure(T.tree(spark, d).select("taxid", "parent")))


@query(f"WITH RECURSIVE {TREE} SELECT c.taxid, c.ancestor AS rank_taxid, t.name AS rank_name FROM c JOIN t ON t.taxid = c.ancestor WHERE t.rank = 'nation'")
def taxonomy_rank(spark, d):
    nodes = T.tree(spark, d)
    return taxonomy.at_rank(taxonomy.closure(nodes.select("taxid", "parent")), nodes, nodes.select("taxid", "name", F.lit("scientific name").alias("class")), "nation")


@query("SELECT c_custkey, CAST(CASE WHEN c_nationkey IN (3, 4) OR c_nationkey IS NULL THEN 32644 WHEN c_nationkey = 7 THEN 8 ELSE c_nationkey END AS INT) AS c_nationkey FROM customer")
def taxonomy_normalise(spark, d):
    merged = spark.createDataFrame([(7, 8)], "old int, new int")
    gone = spark.createDataFrame([(3,), (4,)], "taxid int")
    return taxonomy.normalise(T.read(spark, d, "customer").select("c_custkey", "c_nationkey"), merged, gone, "c_nationkey")
