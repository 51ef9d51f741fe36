"""Cleaning, notes, alignment, offsets and reports on small tables."""

import pytest
from pyspark.sql import functions as F

from helixframe.operators import matrix, select, similarity
from helixframe.operators import records as R
from helixframe.sources import readers, writers
from helixframe.sources.readers import FEATURES
from tests.test_records import SEQ, feature


def test_cleaned_keeps_numbers_and_translations(spark):
    features = [
        feature("CDS", [(0, 18, 1)], locus_tag="one"),
        feature("CDS", [(18, 30, -1)], pseudo=""),
        feature("CDS", [(18, 24, 1), (27, 30, 1)], cds_id="c3", translation="MPK"),
        feature("CDS", [(18, 24, 1)], cds_id="c4", translation=""),
        feature("domain", [(3, 9, 1)], cds_id="c3", name="D1"),
        feature("best_hit", [(3, 9, 1)], cds_id="c3", name="Q"),
    ]
    rows = [("r1", len(SEQ), SEQ, features), ("r2", 0, "", []), ("r3", 4, "ACGT", None)]
    df = spark.createDataFrame(rows, f"record_id string, length int, seq string, features {FEATURES}")
    got = {r.record_id: r for r in R.cleaned(df, best_hits=True, annotations=True).collect()}
    held = [f["qualifiers"] for f in got["r1"].features]
    assert [q.get("cds_id") for q in held] == [["1_1_18"], None, ["c3"], ["c4"]]
    assert [q.get("translation") for q in held] == [["MKPGF*"], None, ["MPK"], ["MP"]]
    assert held[0]["locus_tag"] == ["one"] and got["r1"].n_cds == 3 and got["r2"].n_cds == 0 and got["r3"].features is None
    assert R.cleaned(df, cds=True).where("record_id = 'r1'").select(F.size("features")).first()[0] == 2
    assert R.cleaned(df, protein=True).where("record_id = 'r1'").first().features[0]["qualifiers"] == {"locus_tag": ["one"]}


def test_moved(spark):
    df = spark.createDataFrame([(feature("CDS", [(0, 18, 1)], gene="g"),)], f"f {FEATURES[len('array<'):-1]}")
    two = F.expr("transform(array(1, 2), k -> named_struct('start', k * 10, 'end', k * 10 + 5, 'strand', 1, 'before', false, 'after', false))")
    got = df.select(R.moved(F.col("f"), two).alias("f")).first().f
    assert got["operator"] == "join" and [p["end"] for p in got["parts"]] == [15, 25] and got["qualifiers"] == {"gene": ["g"]}


def test_aligned(spark):
    df = spark.createDataFrame([("ACG", 1), ("GGGGAC", 5), ("", 0)], "seq string, n int")
    assert sorted(r.seq for r in R.aligned(df, "n", "-").collect()) == sorted(["----ACG", "GGGGAC-", "-----" + "--"])
    assert R.aligned(df.limit(0), "n").count() == 0


def test_source_taxons(spark):
    f = [("source", "", [], {"db_xref": ["GeneID:1", "taxon:x", "taxon:9:7", "taxon:8"]}), ("source", "", [], {}), ("CDS", "", [], {"db_xref": ["taxon:5"]})]
    df = spark.createDataFrame([(f,), ([],)], f"features {FEATURES}")
    assert [r.t for r in df.select(R.source_taxons(F.col("features")).alias("t")).collect()] == [[7], []]


def brute_offsets(data: bytes, mark: bytes) -> list[int]:
    out, at = [], 0
    for line in data.splitlines(keepends=True):
        if line.startswith(mark):
            out.append(at)
        at += len(line)
    return out


def test_offsets(spark, tmp_path):
    records = "".join(f"LOCUS       X{i}   30 {unit}    DNA\n     CDS             1..3\n" + "     CDS             4..6\n" * (i % 3) + "                     /note=\"é\"\nORIGIN\n//\n" for i, unit in enumerate(["bp", "aa", "bp", "bp"] * 50))
    gb = tmp_path / "a.gb"
    gb.write_text("a preamble\n" + records)
    got = [tuple(r) for r in readers.offsets(spark, str(gb)).orderBy("offset").collect()]
    assert [a for a, _ in got] == brute_offsets(gb.read_bytes(), b"LOCUS ")
    assert [n for _, n in got] == [1 if i % 4 == 1 else 1 + i % 3 for i in range(200)]
    fa = tmp_path / "a.fasta"
    fa.write_text("".join(f">s{i} é\nACGT\nAC\n" for i in range(300)))
    assert [r.offset for r in readers.offsets(spark, str(fa)).orderBy("offset").collect()] == brute_offsets(fa.read_bytes(), b">")
    with pytest.raises(ValueError):
        readers.offsets(spark, "a.gb.gz")


def test_report(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb", 2.25, None), (2, 'q"x', 1234567.35, "z"), (None, None, None, None)], "k int, s string, x double, e string").coalesce(1)
    writers.report(df, str(tmp_path / "r"))
    lines = [x for p in (tmp_path / "r").glob("part-*") for x in p.read_text().split("\n") if x]
    assert lines == ["k\ts\tx\te", "1\ta b\t2.2\t", '2\tq"x\t1234567.4\tz', "\t\t\t"]
    one = df.select(writers.as_row(df).alias("value"))
    assert writers.projected_bytes(one) == sum(len(x) + 1 for x in lines[1:])
    assert writers.projected_bytes(one.limit(0)) == 0


def test_assemblies(spark, tmp_path):
    (tmp_path / "a.txt").write_text("#   See the README\n# assembly_accession\tasm_name\tftp_path\nGCA_1.2\tx \"y\tna\nGCA_2.1\tz\tftp://a\n")
    rows = readers.assembly_summary(spark, str(tmp_path / "a.txt"))
    assert [tuple(r) for r in rows.orderBy("asm_name").collect()] == [("GCA_1.2", 'x "y', "na", "GCA_1"), ("GCA_2.1", "z", "ftp://a", "GCA_2")]
    assert [r.asm_name for r in select.with_download(rows).collect()] == ["z"]


def test_sizes():
    assert [similarity.kmer_size(), similarity.kmer_size("dna"), similarity.kmer_size("dna", 4)] == [5, 15, 4]
    with pytest.raises(ValueError):
        similarity.kmer_size("dna", 0)
    assert matrix.text_bytes(2, 3, 10) == 2 * 3 * 9 + 15
