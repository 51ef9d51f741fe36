"""Readers and writers: exact round trips and small records with odd parts."""

import pytest
from pyspark.sql import functions as F

from helixframe.sources import readers, writers
from helixframe.streaming import streams
from tests.conftest import DATA

RECORD = """LOCUS       X1             30 bp    DNA     circular BCT 01-JAN-2020
DEFINITION  A small
            record.
VERSION     X1.1
FEATURES             Location/Qualifiers
     source          1..30
                     /db_xref="taxon:562"
     CDS             complement(join(1..6,<10..>15))
                     /gene="abc"
                     /note="two
                     lines"
                     /pseudo
     site            7^8
ORIGIN
        1 acgtacgtac gtacgtacgt acgtacgtac
//
"""


def test_genbank(spark, tmp_path):
    (tmp_path / "a.gb").write_text(RECORD + RECORD.replace("X1", "X2"))
    got = readers.genbank(spark, str(tmp_path / "a.gb")).orderBy("record_id").collect()
    assert [(r.record_id, r.topology, r.length, r.taxid, r.description) for r in got] == [("X1.1", "circular", 30, 562, "A small record"), ("X2.1", "circular", 30, 562, "A small record")]
    cds = got[0].features[1]
    assert [(p.start, p.end, p.strand, p.before, p.after) for p in cds.parts] == [(9, 15, -1, True, True), (0, 6, -1, False, False)]
    assert cds.qualifiers == {"gene": ["abc"], "note": ["two lines"], "pseudo": [""]}
    assert [(p.start, p.end) for p in got[0].features[2].parts] == [(7, 7)]
    writers.genbank(readers.genbank(spark, str(tmp_path / "a.gb")), str(tmp_path / "out"))
    again = readers.genbank(spark, str(tmp_path / "out")).orderBy("record_id").collect()
    assert [r.seq for r in again] == [r.seq for r in got]
    assert [[(p.start, p.end, p.strand) for p in f.parts] for f in again[0].features[:2]] == [[(p.start, p.end, p.strand) for p in f.parts] for f in got[0].features[:2]]
    assert readers.features_of(readers.genbank(spark, str(tmp_path / "a.gb"))).where("type = 'CDS'").select("start", "end", "strand").distinct().collect() == [(0, 15, -1)]


def test_fasta_round_trip(spark, tmp_path):
    rows = [("a", "first one", "ACGT" * 40), ("b", "", "M"), ("c", "x >y", "AC")]
    writers.fasta(spark.createDataFrame(rows, "record_id string, description string, seq string"), str(tmp_path / "f"))
    got = readers.fasta(spark, str(tmp_path / "f")).orderBy("record_id").collect()
    assert [(r.record_id, r.description, r.seq) for r in got] == rows


SWISS = """ID   CH_ONE              Reviewed;          12 AA.
AC   P00001; Q00002;
DT   01-JAN-2000, integrated into UniProtKB/Swiss-Prot.
DE   RecName: Full=A protein;
DE            Short=AP;
GN   Name=abc;
OS   Escherichia coli.
OC   Bacteria; Proteobacteria.
OX   NCBI_TaxID=562 {ECO:1};
DR   PDB; 1ABC; X-ray.
DR   Pfam; PF00001; Name; 1.
PE   1: Evidence at protein level;
KW   Kinase; Membrane.
SQ   SEQUENCE   12 AA;  1000 MW;  0 CRC64;
     MKTAYIAKQR
     QI
//
"""


def test_swissprot(spark, tmp_path):
    (tmp_path / "a.dat").write_text(SWISS + SWISS.replace("P00001", "P00009"))
    got = readers.swissprot(spark, str(tmp_path / "a.dat")).orderBy("record_id").collect()
    assert [r.record_id for r in got] == ["P00001", "P00009"]
    r = got[0]
    assert (r.name, r.accessions, r.organism, r.lineage, r.taxid, r.keywords, r.seq, r.length) == ("CH_ONE", ["P00001", "Q00002"], "Escherichia coli", ["Bacteria", "Proteobacteria"], 562, ["Kinase", "Membrane"], "MKTAYIAKQRQI", 12)
    assert r.dbxrefs == ["PDB:1ABC", "Pfam:PF00001"] and r.description == "RecName: Full=A protein; Short=AP;" and r.created == "01-JAN-2000" and r.existence == "1" and r.comments is None


def test_line_formats(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">a x y\nACGT\n>b\nGG\n")
    (tmp_path / "b.fa").write_text(">a\nAC\nGT\n")
    (tmp_path / "c.tab").write_text("a b\tACGT\n\nc\tG\n")
    assert [(r.record_id, r.description, r.seq) for r in readers.fasta_two_line(spark, str(tmp_path / "a.fa")).orderBy("record_id").collect()] == [("a", "x y", "ACGT"), ("b", "", "GG")]
    with pytest.raises(Exception, match="not two lines"):
        readers.fasta_two_line(spark, str(tmp_path / "b.fa")).collect()
    assert [(r.record_id, r.seq, r.length) for r in readers.tab(spark, str(tmp_path / "c.tab")).orderBy("record_id").collect()] == [("a b", "ACGT", 4), ("c", "G", 1)]


def test_unreadable_locations_are_left_out(spark, tmp_path):
    (tmp_path / "a.gb").write_text(RECORD.replace("7^8", "7..x"))
    assert [f.type for f in readers.genbank(spark, str(tmp_path / "a.gb")).first().features] == ["source", "CDS"]
    assert [tuple(r) for r in readers.genbank_problems(spark, str(tmp_path / "a.gb")).collect()] == [("X1.1", "site", "7..x")]


def test_bad_location():
    with pytest.raises(ValueError):
        readers.parse_location("1..x")


def test_kinds_and_limits():
    assert readers.file_kind("x/y.GBFF.gz") == "genbank" and readers.file_kind("a.txt") is None
    writers.check_size(10, 0)
    with pytest.raises(ValueError):
        writers.check_size(11, 10)


def test_profiles_matrix_taxonomy(spark, tmp_path):
    (tmp_path / "p.hmm").write_text("HMMER3/f\nNAME  one\nACC   P1\nLENG  12\nHMM\n//\nHMMER3/f\nNAME  two\nLENG  7\n//\n")
    assert [(r.database, r.name, r.acc, r.length) for r in readers.profiles(spark, str(tmp_path / "p.hmm")).orderBy("name").collect()] == [("p", "one", "P1", 12), ("p", "two", None, 7)]
    m = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.5)], "i string, j string, score double")
    writers.dense_text(m, str(tmp_path / "d"))
    assert {tuple(r) for r in readers.dense_matrix(spark, str(tmp_path / "d")).where("score <> 0").collect()} == {("a", "x", 1.0), ("b", "y", 2.5)}
    writers.triples(m, str(tmp_path / "t"))
    assert readers.sparse_matrix(spark, str(tmp_path / "t"), 1.5).count() == 1
    for name, text in {"nodes": "1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tdomain\t|\n", "names": "2\t|\tBacteria\t|\t\t|\tscientific name\t|\n", "merged": "17\t|\t2\t|\n", "delnodes": "9\t|\n"}.items():
        (tmp_path / f"{name}.dmp").write_text(text)
    t = readers.taxonomy_dump(spark, str(tmp_path))
    assert [tuple(t[k].first()) for k in ("names", "merged", "deleted")] == [(2, "Bacteria", "scientific name"), (17, 2), (9,)]
    assert {tuple(r) for r in t["nodes"].collect()} == {(1, 1, "no rank"), (2, 1, "domain")}


def test_stream_counts_match_batch(spark, tmp_path):
    batch = spark.read.parquet(str(DATA / "events.parquet"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = streams.counts(stream, "ts", "1 day", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("day_counts").start()
    try:
        q.processAllAvailable()
        got = {tuple(r) for r in spark.sql("SELECT start, event_type, n FROM day_counts").collect()}
    finally:
        q.stop()
    want = batch.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").count()
    assert got == {tuple(r) for r in want.collect()}


def test_forest_over_batches(spark):
    f = streams.Forest()
    a = spark.createDataFrame([(1, 2, 3.0), (2, 3, 1.0)], "i long, j long, score double")
    b = spark.createDataFrame([(1, 3, 2.0), (3, 4, 5.0)], "i long, j long, score double")
    f.fold(a)
    f.fold(b)
    assert {tuple(r) for r in f.edges.collect()} == {(1, 2, 3.0), (1, 3, 2.0), (3, 4, 5.0)}
