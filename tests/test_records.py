"""Records with nested features: slices, coding regions and extraction on small records."""

import pytest
from pyspark.sql import functions as F

from helixframe.operators import records as R
from helixframe.sources.readers import FEATURES


def feature(kind, parts, **qualifiers):
    return (kind, "join" if len(parts) > 1 else "", [(a, b, s, False, False) for a, b, s in parts], {k: [v] for k, v in qualifiers.items()})


SEQ = "ATGAAACCCGGGTTTTAAATGCCCTTTAAA"


@pytest.fixture(scope="module")
def recs(spark):
    features = [
        feature("source", [(0, 30, 1)], organism="x"),
        feature("CDS", [(0, 18, 1)], locus_tag="one"),
        feature("CDS", [(18, 30, -1)], gene="two", pseudo=""),
        feature("CDS", [(18, 24, 1), (27, 30, 1)], cds_id="c3", translation="MPK"),
        feature("domain", [(3, 9, 1)], cds_id="1_1_18", name="D1", database="db", evalue="0.001", score="10", identity="50"),
        feature("domain", [(6, 15, 1)], cds_id="1_1_18", name="D2", database="db", evalue="0.1", score="5"),
        feature("best_hit", [(18, 24, 1)], cds_id="c3", name="Q", evalue="0", score="9"),
    ]
    rows = [("r1", "linear", len(SEQ), SEQ, features), ("r2", "linear", 4, "ACGT", []), ("r3", "linear", 4, "ACGT", None)]
    return spark.createDataFrame(rows, f"record_id string, topology string, length int, seq string, features {FEATURES}")


def parts_of(row):
    return [(f["type"], [(p["start"], p["end"], p["strand"]) for p in f["parts"]]) for f in row["features"]]


def test_slices(recs):
    cut = {r.record_id: r for r in R.sliced(recs, R.location(6, 20)).collect()}
    assert cut["r1"].seq == SEQ[6:20] and cut["r1"].length == 14 and cut["r2"].seq == ""
    assert parts_of(cut["r1"]) == [("source", [(0, 14, 1)]), ("CDS", [(0, 12, 1)]), ("CDS", [(12, 14, -1)]), ("CDS", [(12, 14, 1)]), ("domain", [(0, 3, 1)]), ("domain", [(0, 9, 1)]), ("best_hit", [(12, 14, 1)])]
    back = R.sliced(recs, R.location(3, 15, -1), truncate=False).where("record_id = 'r1'").first()
    assert back.seq == "AAACCCGGGTTT"[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert parts_of(back) == [("source", [(0, 12, -1)]), ("domain", [(6, 12, -1)]), ("domain", [(0, 9, -1)])]
    two = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(s).alias("strand")) for a, b, s in ((24, 30, 1), (0, 6, 1))])
    joined = R.sliced(recs, two).where("record_id = 'r1'").first()
    assert joined.seq == SEQ[24:] + SEQ[:6] and parts_of(joined)[1] == ("CDS", [(6, 12, 1)])


def test_coding_regions(recs):
    got = R.coding(recs, skip_pseudo=True).collect()
    assert [(r.idx, r.num, r.name, r.domain_names, r.best_hit is not None) for r in got] == [(1, "1_1_18", "one", ["D1", "D2"], False), (3, "c3", "c3", [], True)]
    assert [r.name for r in R.coding(recs).collect()] == ["one", "two", "c3"]
    assert R.coding(recs, evalue=0.01).first().domain_names == ["D1"]


def test_extraction(recs):
    got = {r.record_id: r.seq for r in R.extract_domains(recs, evalue=0.01, up=1).collect()}
    assert got == {"r1_3:9": SEQ[2:9]}
    assert [(r.record_id, r.seq) for r in R.extract_domains(recs, splice=True).collect()] == [("r1_4:15", SEQ[3:15])]
    assert sorted((r.record_id, r.source_contig, r.seq) for r in R.extract_peptides(recs, every=True).collect()) == [("c3", "r1", "MPK"), ("one", "r1", "MKPGF*")]
    assert [r.record_id for r in R.extract_peptides(recs, domains=["D2"]).collect()] == ["one"]
    assert [r.record_id for r in R.extract_peptides(recs, domains=["D2"], invert=True).collect()] == ["c3"]
    places = recs.sparkSession.createDataFrame([("r1", 0, 3, 1), ("r2", 1, 3, -1)], "record_id string, start int, end int, strand int")
    assert sorted((r.record_id, r.seq) for r in R.select_by_coord(recs, places).collect()) == [("r1", "ATG"), ("r2", "CG")]
    near = R.select_by_cds(recs, ["one"], cds_down=1).collect()
    assert [(r.record_id, r.focus, r.seq) for r in near] == [("r1", "one", SEQ)]


def test_report_columns(recs):
    f = F.col("features")
    got = recs.select(R.qualifier_list(f, "domain", "name"), R.qualifier_count(f, "domain", "identity"), R.identity_sum(f), R.starts_with(F.col("seq"))).first()
    assert tuple(got) == ("D1; D2", 1, 50.0, "A")


def test_locations_of_several_parts(spark):
    cases = [([(10, 20, 1), (30, 40, 1)], False, [(10, 40)]), ([(90, 100, 1), (0, 10, 1)], True, [(0, 10), (90, 100)]), ([(0, 10, -1), (90, 100, -1)], True, [(0, 10), (90, 100)]), ([(30, 40, -1), (10, 20, -1)], False, [(10, 40)]), ([(5, 9, 1)], False, [(5, 9)])]
    df = spark.createDataFrame([(k, p) for k, (p, _, _) in enumerate(cases)], "k int, parts array<struct<start:int,end:int,strand:int>>")
    for r in df.select("k", R.spans_origin(F.col("parts")).alias("over"), R.envelope(F.col("parts"), F.lit(100)).alias("e"), R.inverted(F.col("parts"), F.lit(100)).alias("i"), R.parts_overlap(F.col("parts"), R.location(0, 15)).alias("n")).collect():
        parts, over, envelope = cases[r.k]
        assert r.over == over and [(x["start"], x["end"]) for x in r.e] == envelope
        covered = {x for a, b, _ in parts for x in range(a, b)}
        assert {x for y in r.i for x in range(y["start"], y["end"])} == set(range(100)) - covered
        assert r.n == len(covered & set(range(15)))
