"""Hits, orderings and projections against plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from helixframe.operators import hits, matrix


def test_normalised(spark):
    refs = spark.createDataFrame([("R", None, "A1", 50)], "ref string, description string, accession string, ref_len int")
    raw = spark.createDataFrame([(1, "R", 1e-5, 30.0, 11, 20, 1, 10, 5), (1, "R", 1e-3, 9.0, 1, 5, 1, 5, 5), (2, "R", 1e-9, 50.0, 21, 11, 1, 10, 10), (2, "R", 1e-9, 50.0, 500, 510, 1, 10, 10)], "record long, ref string, evalue double, score double, env_from int, env_to int, ref_from int, ref_to int, matches int")
    got = hits.protein_hits(raw, refs, "db", 1e-3).where("record = 1").collect()
    assert [(r.start, r.end, r.strand, r.identity, r.description, r.rstart, r.rend, r.ref_len) for r in got] == [(10, 20, 1, 50.0, "", 1, 10, 50)]
    lengths = spark.createDataFrame([(2, 100)], "record long, length int")
    got = hits.nucleotide_hits(raw, refs, lengths, "record", "db", 1e-3).orderBy("record").collect()
    assert [(r.record, r.start, r.end, r.strand) for r in got] == [(1, 10, 20, 1), (2, 10, 21, -1)]
    raw = spark.createDataFrame([(2, "R", 1e-5, 30.0, 20, 11, "-", 1, 10)], "record long, ref string, evalue double, score double, target_from int, target_to int, strand string, ref_from int, ref_to int")
    got = hits.covariance_hits(raw, refs, lengths, "record", "db", 1.0).first()
    assert (got.start, got.end, got.strand, got.identity) == (10, 20, -1, 0.0)
    raw = spark.createDataFrame([("T", "h", 44.0, 1, 9, 2, 10, 70, 1e-3, 12.5)], "target string, theader string, pident double, qstart int, qend int, tstart int, tend int, tlen int, evalue double, bits double")
    got = hits.structure_hits(raw, "db").first()
    assert (got.ref, got.start, got.end, got.rstart, got.rend, got.score, got.accession) == ("T", 0, 9, 2, 10, 12.5, "")


def test_annotate(spark):
    rows = [(1, "a", 1e-5, 30.0, 0, 10), (1, "b", 1e-4, 20.0, 5, 15), (1, "c", 1e-3, 10.0, 20, 30), (1, "d", 1e-2, 5.0, 40, 50)]
    df = spark.createDataFrame(rows, "cds long, ref string, evalue double, score double, start int, end int")
    got = {r.ref: r for r in hits.annotate(df, ["cds"], 3, 0.5, ("ref",)).collect()}
    assert set(got) == {"a", "c"} and got["a"].best and not got["c"].best and (got["a"].evalue_text, got["a"].score_text) == ("1.0e-05", "30.0")


def test_circular_dedup(spark):
    random.seed(5)
    lengths = {1: (100, True), 2: (100, False), 3: (7, True), 4: (90, None)}
    rows = []
    for i in range(400):
        record = random.randrange(1, 5)
        n = lengths[record][0]
        start = random.randrange(n)
        rows.append((record, random.choice("RS"), "db", "p", float(random.randrange(9)), start, start + random.randrange(1, n + 1), i))
    df = spark.createDataFrame(rows, "record long, ref string, database string, program string, score double, start int, end int, id int")
    records = spark.createDataFrame([(k, *v) for k, v in lengths.items()], "record long, length int, circular boolean")
    got = {r.id for r in hits.circular_dedup(df, records, "record", order=("id",)).collect()}
    want = set()
    parts = lambda r, n: [(r[5], n), (0, r[6] - n)] if r[6] > n else [(r[5], r[6])]
    for record, (n, ring) in lengths.items():
        kept = []
        for r in sorted((r for r in rows if r[0] == record), key=lambda r: (-r[4], r[7])):
            if ring and any(k[1] == r[1] and all(any(b[0] <= s[0] and b[1] >= s[1] for b in parts(k, n)) for s in parts(r, n)) for k in kept):
                continue
            kept.append(r)
        want |= {r[7] for r in kept}
    assert got == want and len(want) < 400


def test_taxon_and_labels(spark):
    rows = [("9", " OX=1 ", ["taxon:2"]), (None, "x OX=5 GN", None), (None, "x TaxID=77 R", []), (None, "", ["GI:4", "taxon:8", "taxon:9"]), (None, None, None), (None, "x", ["taxon:q"])]
    df = spark.createDataFrame(rows, "a string, d string, x array<string>")
    assert [r[0] for r in df.select(hits.taxon(F.col("a"), F.col("d"), F.col("x"))).collect()] == [9, 5, 77, 8, 32644, 32644]
    df = spark.createDataFrame([("iiHHHoohSS",), ("",), (None,)], "s string")
    got = [r[0] for r in df.select(hits.label_runs(F.col("s"), "HhS")).collect()]
    assert [tuple(x) for x in got[0]] == [("H", 2, 5), ("h", 7, 8), ("S", 8, 10)] and got[1] == [] and got[2] is None


def test_ward(spark):
    near = {(0, 1): 9.0, (2, 3): 8.0, (0, 4): 3.0, (1, 4): 3.0, (2, 4): 1.0}
    cells = [(i, i, 10.0) for i in range(5)] + [x for (i, j), s in near.items() for x in ((i, j, s), (j, i, s))]
    df = spark.createDataFrame(cells, "i long, j long, score double")
    assert matrix.ward_order(df) == [0, 1, 2, 3, 4]
    assert matrix.ward_order(df.where("i <> j").withColumn("score", F.lit(0.0))) == [0, 1, 2, 3, 4]


def test_projection(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(30, 3)) @ np.diag([9.0, 4.0, 1.0]) @ rng.normal(size=(3, 12)) * (rng.random((30, 12)) < 0.7)
    a[7] = 0
    df = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(30) for j in range(12) if a[i, j]], "i long, j long, score double")
    labels = spark.range(30)
    for centre in (True, False):
        b = a - a.mean(axis=0) if centre else a
        u, s, _ = np.linalg.svd(b, full_matrices=False)
        want = u[:, :2] * s[:2]
        want *= np.where((want**3).sum(axis=0) < 0, -1, 1)
        got = np.array([tuple(r) for r in matrix.project(df, labels, 2, centre).orderBy("id").collect()])[:, 1:]
        assert np.abs(got - want).max() < 1e-3 * s[0]
