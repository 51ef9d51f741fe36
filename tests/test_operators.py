"""Operators that SQL does not express, against plain Python."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.functions import expressions
from helixframe.functions import sequences as S
from helixframe.operators import graph, intervals, search, select, similarity, taxonomy, windows


def test_expression_grammar():
    tree = expressions.parse("(a b | (b&c)) & ~d")
    assert expressions.names(tree) == ["a b", "b", "c", "d"]
    for bad in ("", "a &", "(a", "a)", "& a", "a b ( c"):
        with pytest.raises(ValueError):
            expressions.parse(bad)


@settings(max_examples=60, deadline=None)
@given(st.text("abc&|~() ", max_size=12))
def test_expression_never_hangs(text):
    try:
        expressions.parse(text)
    except ValueError:
        pass


def test_prosite():
    assert S.prosite_regex("[ST]-x(2)-{P}-N(1,3)>") == "[ST].{2}[^P]N{1,3}$"
    with pytest.raises(ValueError):
        S.prosite_regex("[ST")


def test_translation(spark):
    df = spark.createDataFrame([("ATGGCCTAAGG",), ("augnnn",), ("",), (None,)], "s string")
    got = [tuple(r) for r in df.select(S.translate(F.col("s")), S.translate(F.col("s"), to_stop=True), S.reverse_complement(F.col("s"))).collect()]
    assert got == [("MA*", "MA", "CCTTAGGCCAT"), ("MX", "MX", "nnncat"), ("", "", ""), (None, None, None)]


def test_isoelectric_point_has_no_charge(spark):
    df = spark.createDataFrame([("MKRHDECY",), ("GGGG",)], "s string")
    for r in df.select(S.charge(F.col("s"), S.isoelectric_point(F.col("s"))).alias("c")).collect():
        assert abs(r.c) < 0.01


def test_non_overlapping(spark):
    random.seed(3)
    rows = [(i % 5, i, random.randrange(100), 0, float(random.randrange(50))) for i in range(200)]
    rows = [(r, i, s, s + random.randrange(1, 30), x) for r, i, s, _, x in rows]
    df = spark.createDataFrame(rows, "r long, id long, start long, end long, score double")
    got = {(x.r, x.id) for x in select.greedy_non_overlapping(df, ["r"], 0.25, tie=["id"]).collect()}
    want = set()
    for r in range(5):
        kept = []
        for x in sorted((x for x in rows if x[0] == r), key=lambda x: (-x[4], x[1])):
            if all((min(x[3], k[3]) - max(x[2], k[2])) / (x[3] - x[2]) <= 0.25 for k in kept):
                kept.append(x)
                want.add((r, x[1]))
    assert got == want


def test_lanes_do_not_overlap(spark):
    random.seed(4)
    rows = [(i % 3, i, s := random.randrange(100), s + random.randrange(1, 20)) for i in range(90)]
    got = windows.lanes(spark.createDataFrame(rows, "r long, id long, start long, end long"), "r", tie=["id"]).collect()
    for a in got:
        for b in got:
            if a.id < b.id and a.r == b.r and a.lane == b.lane:
                assert a.end <= b.start or b.end <= a.start


def test_padding_on_a_circle(spark):
    rows = [(s, e, 30) for s in range(30) for e in range(s + 1, 31, 4)]
    df = spark.createDataFrame(rows, "start long, end long, length long").select("*", intervals.pad_circular("start", "end", 4, 7, "length").alias("p"))
    for r in df.collect():
        places = [x for p in r.p for x in range(p.start, p.end)]
        assert len(places) == len(set(places)) == min(30, r.end - r.start + 11)
        assert set(range(r.start, r.end)) <= set(places)


def kruskal(edges):
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    out = set()
    for i, j, s in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        a, b = top(i), top(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.add((i, j, s))
    return out, {x: top(x) for x in parent}


def test_forest_and_components(spark):
    random.seed(5)
    edges = list({(i, j): (i, j, float(random.randrange(1, 9))) for i, j in (sorted(random.sample(range(60), 2)) for _ in range(70))}.values())
    df = spark.createDataFrame(edges, "i long, j long, score double")
    want, _ = kruskal(edges)
    assert {tuple(r) for r in graph.spanning_forest(df).collect()} == want
    got = {r.node: r.component for r in graph.connected_components(df, "i", "j").collect()}
    parts = kruskal(edges)[1]
    least = {}
    for x, p in parts.items():
        least[p] = min(least.get(p, x), x)
    assert got == {x: least[p] for x, p in parts.items()}


def test_components_of_nothing_and_loops(spark):
    empty = spark.createDataFrame([], "src long, dst long")
    assert graph.connected_components(empty).count() == 0
    df = spark.createDataFrame([(4, 4), (None, 3), (1, 2)], "src long, dst long")
    assert {(r.node, r.component) for r in graph.connected_components(df).collect()} == {(4, 4), (1, 1), (2, 1)}


def test_prefix_filter_loses_nothing(spark):
    random.seed(6)
    rows = [(r, random.randrange(12)) for r in range(30) for _ in range(random.randrange(1, 9))]
    df = spark.createDataFrame(rows, "record long, feature long")
    for metric in similarity.METRICS:
        full = {tuple(x) for x in similarity.pairs(df, metric=metric).collect() if x.score > 0.4}
        assert {tuple(x) for x in similarity.pairs(df, metric=metric, lower=0.4).collect()} == full


def test_known_kmer_scores(spark):
    df = spark.createDataFrame([(1, "ACDEF"), (2, "CDE"), (3, "CDEF")], "id long, s string")
    k = similarity.kmers(df, "id", "s", 2)
    got = {m: {(x.i, x.j): round(x.score, 4) for x in similarity.pairs(k, metric=m).collect()} for m in similarity.METRICS}
    assert got["jaccard"] == {(1, 2): 0.5, (1, 3): 0.75, (2, 3): 0.6667}
    assert got["max_containment"] == {(1, 2): 1.0, (1, 3): 1.0, (2, 3): 1.0}
    assert got["min_containment"] == {(1, 2): 0.5, (1, 3): 0.75, (2, 3): 0.6667}
    dna = spark.createDataFrame([(1, "ACGTTGCA"), (2, "TGCAACGT")], "id long, s string")
    assert [x.score for x in similarity.pairs(similarity.kmers(dna, "id", "s", 3, "dna")).collect()] == [1.0]


def test_deep_tree(spark):
    nodes = spark.createDataFrame([(1, 1), *[(k, k - 1) for k in range(2, 42)]], "taxid long, parent long")
    got = {r.taxid: r.lineage for r in taxonomy.lineage(taxonomy.closure(nodes)).collect()}
    assert got[41] == list(range(41, 0, -1)) and got[1] == [1]


def test_local_alignment():
    assert search.align("XXACGTYY", "ZACGTZ")[0] == 8.0
    assert search.align("XXACGTYY", "ZACGTZ")[1:] == (2, 6, 1, 5)
