"""Search hits: from what search programs report to features on records.

Raw rows carry 1-based places; hits are 0-based and half-open.  All but ``circular_dedup``
and the overlap filter are built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.search import keep_hits
from helixframe.operators.select import greedy_non_overlapping

# fixed values: the taxon of records that name none
UNIDENTIFIED = 32644
PLACES = ("description", "accession", "ref_len")


def _known(raw: DataFrame, references: DataFrame, evalue: float, min_evalue: float) -> DataFrame:
    """``raw`` within the e-value bounds, with its reference's (ref, description, accession, ref_len)."""
    kept = keep_hits(raw.drop(*PLACES), evalue, min_evalue)
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in PLACES[:2]]
    return kept.join(references.select("ref", *text, "ref_len"), "ref")


def _identity() -> Column:
    size = F.col("ref_to") - F.col("ref_from") + 1
    return F.when(size > 0, 100.0 * F.col("matches") / size).otherwise(F.lit(0.0))


def _finish(rows: DataFrame, program: str, database: str, start: Column, end: Column, strand: Column, identity: Column) -> DataFrame:
    new = {"start": start, "end": end, "strand": strand, "identity": identity, "program": F.lit(program), "database": F.lit(database)}
    return rows.withColumns(new).drop("matches").withColumnsRenamed({"ref_from": "rstart", "ref_to": "rend"})


def protein_hits(raw: DataFrame, references: DataFrame, database: str, evalue: float, min_evalue: float = 0.0, program: str = "hmmsearch") -> DataFrame:
    """Raw (ref, evalue, score, env_from, env_to, ref_from, ref_to, matches, ...) of peptides."""
    rows = _known(raw, references, evalue, min_evalue)
    return _finish(rows, program, database, F.col("env_from") - 1, F.col("env_to"), F.lit(1), _identity()).drop("env_from", "env_to")


def nucleotide_hits(raw: DataFrame, references: DataFrame, lengths: DataFrame, record: str, database: str, evalue: float, min_evalue: float = 0.0, program: str = "nhmmer") -> DataFrame:
    """The same on contigs: places that run backwards are on the other strand; hits that start past the contig's end go."""
    rows = _known(raw, references, evalue, min_evalue)
    first, last = F.col("env_from") - 1, F.col("env_to")
    back = first > last
    hits = _finish(rows, program, database, F.when(back, last - 1).otherwise(first), F.when(back, first + 1).otherwise(last), F.when(back, -1).otherwise(1), _identity())
    return _within(hits.drop("env_from", "env_to"), lengths, record)


def covariance_hits(raw: DataFrame, references: DataFrame, lengths: DataFrame, record: str, database: str, evalue: float, min_evalue: float = 0.0, program: str = "infernal") -> DataFrame:
    """Raw (ref, evalue, score, target_from, target_to, strand, ref_from, ref_to, ...): identity 0."""
    rows = _known(raw, references, evalue, min_evalue)
    low, high = F.least("target_from", "target_to"), F.greatest("target_from", "target_to")
    hits = _finish(rows, program, database, low - 1, high, F.when(F.col("strand") == "-", -1).otherwise(1), F.lit(0.0))
    return _within(hits.drop("target_from", "target_to"), lengths, record)


def structure_hits(raw: DataFrame, database: str, program: str = "foldseek") -> DataFrame:
    """Raw columns of a tabular structure search: target, theader, pident, qstart, qend, tstart, tend, tlen, evalue, bits."""
    named = {"target": "ref", "theader": "description", "pident": "identity", "qend": "end", "tstart": "rstart", "tend": "rend", "tlen": "ref_len", "bits": "score"}
    new = {"start": F.col("qstart") - 1, "accession": F.lit(""), "strand": F.lit(1), "database": F.lit(database), "program": F.lit(program)}
    return raw.withColumns(new).drop("qstart").withColumnsRenamed(named)


def _within(hits: DataFrame, lengths: DataFrame, record: str) -> DataFrame:
    known = lengths.select(record, F.col("length").alias("hx_length"))
    return hits.join(known, record, "left").where("hx_length IS NULL OR start < hx_length").drop("hx_length")


def annotate(hits: DataFrame, by: list[str], max_hits: int | None, allowed: float, tie: tuple[str, ...] = ()) -> DataFrame:
    """The features that a search adds: the ``max_hits`` best of each ``by``, then without overlaps; ``best`` marks the first.

    The bound on the number of hits comes before the overlaps.  E-values and scores are also
    given as the texts that files carry.
    """
    order = [F.col("score").desc(), *[F.col(t) for t in tie]]
    placed = hits.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    if max_hits is not None:
        placed = placed.where(F.col("place") <= max_hits)
    kept = greedy_non_overlapping(placed, by, allowed, strict=False, tie=["place"])
    text = {"best": F.col("place") == 1, "evalue_text": F.format_string("%.1e", F.col("evalue").cast("double")), "score_text": F.format_string("%.1f", F.col("score").cast("double"))}
    return kept.withColumns(text).drop("place")


def wrapped(start: Column, end: Column, length: Column, circular: Column) -> Column:
    """The parts of a hit: cut at the origin of a circular record, or at the end of another one."""
    part = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    over = circular & (end > length)
    return F.when(over, F.array(part(start, length), part(F.lit(0), end - length))).otherwise(F.array(part(start, F.least(end, length))))


def circular_dedup(hits: DataFrame, records: DataFrame, record: str, keys: tuple[str, ...] = ("ref", "database", "program"), order: tuple[str, ...] = ("start", "end")) -> DataFrame:
    """On circular records, hits without those that lie in a better one of the same reference.

    ``records`` has (record, length, circular).  Containment is transitive, so a hit goes
    exactly if any better one holds all of its parts, kept or not: a semi-join, no fold.
    Equal scores are ranked by ``order``.  Parts are met by cells of the record that both
    touch at the hit's start (65 cells at most), so pairs arise only among hits of one
    reference at one place.
    """
    info = records.select(record, F.col("length").alias("hx_length"), F.coalesce("circular", F.lit(False)).alias("hx_circular"))
    rank = Window.partitionBy(record, *keys).orderBy(F.col("score").desc(), *order)
    every = hits.join(info, record, "left").withColumn("hx_rank", F.row_number().over(rank))
    parts = wrapped(F.col("start"), F.col("end"), F.col("hx_length"), F.col("hx_circular")).alias("parts")
    cell = F.greatest(F.floor(F.col("hx_length") / 64), F.lit(1))
    ring = every.where("hx_circular").select(record, *keys, "hx_rank", parts, cell.alias("cell"))
    place = lambda x: F.least(F.floor(x / F.col("cell")), F.lit(64))
    held = ring.select(record, *keys, F.col("hx_rank").alias("inner"), F.col("parts").alias("small"), place(F.col("parts")[0]["start"]).alias("at"))
    cells = F.array_distinct(F.flatten(F.transform("parts", lambda p: F.sequence(place(p["start"]), F.greatest(place(p["start"]), place(p["end"] - 1))))))
    holds = ring.select(record, *keys, F.col("hx_rank").alias("outer"), F.col("parts").alias("large"), F.explode(cells).alias("at"))
    inside = F.forall("small", lambda s: F.exists("large", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))
    # exploded rows are many more than their source's size suggests: never broadcast
    met = held.join(holds.hint("merge"), [record, *keys, "at"]).where((F.col("outer") < F.col("inner")) & inside)
    gone = met.select(record, *keys, F.col("inner").alias("hx_rank")).distinct()
    return every.join(gone, [record, *keys, "hx_rank"], "left_anti").select(*hits.columns)


def taxon(annotation: Column, description: Column, source_xrefs: Column) -> Column:
    """A record's taxon: its annotation, else `` OX=`` or `` TaxID=`` of its description, else the longest source's first ``taxon:`` reference, else unidentified."""
    named = F.coalesce(F.regexp_extract(description, r".* OX=(\d+)", 1), F.lit(""))
    other = F.coalesce(F.regexp_extract(description, r".* TaxID=(\d+)", 1), F.lit(""))
    xref = F.get(F.filter(source_xrefs, lambda x: x.rlike(r"^taxon:(?:.*:)?\d+$")), 0)
    return F.coalesce(
        annotation.cast("long"),
        F.when(named != "", named.cast("long")),
        F.when(other != "", other.cast("long")),
        F.regexp_extract(xref, r"(\d+)$", 1).try_cast("long"),
        F.lit(UNIDENTIFIED).cast("long"),
    )


def label_runs(labels: Column, kept: str) -> Column:
    """Runs of one letter as an array of (label, start, end), of the letters in ``kept``."""
    runs = F.regexp_extract_all(labels, F.lit(r"(?s)(.)\1*"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<label:string,start:int,end:int>>").alias("out"))

    def add(acc: Column, run: Column) -> Column:
        end = acc["at"] + F.char_length(run)
        one = F.struct(F.left(run, F.lit(1)).alias("label"), acc["at"].alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(runs, start, add, lambda acc: F.filter(acc["out"], lambda r: F.lit(kept).contains(r["label"])))
