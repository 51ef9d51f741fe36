"""Search: motifs, local alignment and profile-profile scores behind one interface.

A scorer is a function from a sequence (or profile) and the reference set to hits.  The
reference set is shipped to the workers with the function, so its size is checked; larger
sets are searched in blocks by joining.  External search programs plug in as scorers.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.sequences import prosite_regex

MAX_REFERENCES = 50_000


def motifs(rows: DataFrame, record: str, seq: str, patterns: dict[str, str]) -> DataFrame:
    """(record, motif, start, end, score) of matches that do not overlap, from 0, half open."""
    compiled = {name: prosite_regex(p) for name, p in patterns.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {name: re.compile(p) for name, p in compiled.items()}
        for batch in batches:
            out: list[tuple] = [
                (ident, name, m.start(), m.end(), 100.0)
                for ident, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for name, p in found.items()
                for m in p.finditer(s or "")
                if m.end() > m.start()
            ]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64()]
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["record", "motif", "start", "end", "score"])

    return rows.select(F.col(record).cast("long"), F.col(seq)).mapInArrow(run, "record long, motif string, start int, end int, score double")


def pseudo_evalue(score: Column) -> Column:
    return F.exp(-score)


def align(a: str, b: str, match: float = 2.0, mismatch: float = -1.0, gap: float = -2.0) -> tuple[float, int, int, int, int]:
    """Best local alignment: score and the half-open ranges in a and b (linear gaps)."""
    best = (0.0, 0, 0, 0, 0)
    before = [(0.0, 0, k) for k in range(len(b) + 1)]
    for i, x in enumerate(a):
        row = [(0.0, i + 1, 0)]
        for j, y in enumerate(b):
            d, u, left = before[j], before[j + 1], row[j]
            cell = max((d[0] + (match if x == y else mismatch), d[1], d[2]), (u[0] + gap, u[1], u[2]), (left[0] + gap, left[1], left[2]), key=lambda c: c[0])
            if cell[0] <= 0:
                cell = (0.0, i + 1, j + 1)
            row.append(cell)
            if cell[0] > best[0]:
                best = (cell[0], cell[1], i + 1, cell[2], j + 1)
        before = row
    return best


def smith_waterman(rows: DataFrame, references: Sequence, record: str, seq: str, min_score: float = 0.0) -> DataFrame:
    """(record, ref, score, start, end, rstart, rend) of each record against each of (ref, ref_seq)."""
    if len(references) > MAX_REFERENCES:
        raise ValueError(f"more than {MAX_REFERENCES} references; search them in blocks")
    refs = [(r["ref"], r["ref_seq"]) for r in references]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ident, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for name, r in refs:
                    score, a, b, ra, rb = align(s or "", r or "")
                    if score > min_score:
                        out.append((ident, name, score, a, b, ra, rb))
            kinds = [pa.int64(), pa.string(), pa.float64(), *[pa.int32()] * 4]
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["record", "ref", "score", "start", "end", "rstart", "rend"])

    return rows.select(F.col(record).cast("long"), F.col(seq)).mapInArrow(run, "record long, ref string, score double, start int, end int, rstart int, rend int")


def keep_hits(hits: DataFrame, evalue: float, min_evalue: float = 0.0) -> DataFrame:
    """min_evalue <= evalue of the hit < evalue."""
    return hits.where((F.col("evalue") >= min_evalue) & (F.col("evalue") < evalue))


def hits_to_features(hits: DataFrame, cds: DataFrame, on: str = "cds") -> DataFrame:
    """Protein hits on their coding region: three bases for each residue, by strand."""
    j = hits.join(cds.select(on, F.col("start").alias("hx_s"), F.col("end").alias("hx_e"), F.col("strand").alias("hx_strand")), on)
    plus = F.col("hx_strand") >= 0
    start = F.when(plus, F.col("hx_s") + 3 * F.col("start")).otherwise(F.col("hx_e") - 3 * F.col("end"))
    end = F.when(plus, F.col("hx_s") + 3 * F.col("end")).otherwise(F.col("hx_e") - 3 * F.col("start"))
    return j.withColumns({"start": start, "end": end, "strand": F.col("hx_strand")}).drop("hx_s", "hx_e", "hx_strand")


def profile_score(q: list[list[float]], r: list[list[float]], background: list[float], gap: float = -3.0) -> float:
    """Best local score of two profiles (rows of emission probabilities): sum of log odds of columns."""
    column = [[math.log(max(1e-12, sum(a * b / g for a, b, g in zip(x, y, background, strict=True)))) for y in r] for x in q]
    best, before = 0.0, [0.0] * (len(r) + 1)
    for i in range(len(q)):
        row = [0.0]
        for j in range(len(r)):
            row.append(max(0.0, before[j] + column[i][j], before[j + 1] + gap, row[j] + gap))
            best = max(best, row[-1])
        before = row
    return best
