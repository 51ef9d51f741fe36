"""Sequence chemistry against published worked examples and plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import chemistry as C
from helixframe.functions import sequences as S

OLIGO = "CGTTCCAAAGATGTGGGCATGAGCTTAC"


def one(spark, build, *values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return [r[0] for r in df.select(build(F.col("s"))).collect()]


@pytest.mark.parametrize(
    ("how", "want"),
    [
        ({}, 60.32), ({"table": "DNA 1986"}, 72.19), ({"table": "DNA 1996"}, 65.47), ({"table": "DNA 2004"}, None), ({"table": "RNA 1986"}, 73.35), ({"table": "RNA 1998"}, None), ({"table": "RNA 2012"}, None), ({"table": "RNA/DNA 1995"}, 58.45),
        ({"salt": 1}, 54.27), ({"salt": 2}, 54.02), ({"salt": 3}, 59.60), ({"salt": 4}, 60.64), ({"salt": 6}, 59.78), ({"salt": 7}, 59.78), ({"tris": 10.0}, 60.79), ({"tris": 10.0, "mg": 1.5}, 67.39),
        ({"tris": 10.0, "mg": 1.5, "salt": 7}, 66.81), ({"tris": 10.0, "mg": 1.5, "dntp": 0.6, "salt": 7}, 66.04),
    ],
)
def test_neighbours(spark, how, want):
    got = one(spark, lambda s: C.melting_neighbours(s, **how), OLIGO, OLIGO.lower(), "A", "ACGN", "", None)
    assert got[0] == got[1] and got[2:] == [None] * 4
    if how.get("table") != "RNA/DNA 1995" and how != {"salt": 7}:
        assert got[0] == pytest.approx(plain_tm(OLIGO, **how), abs=1e-9)
    if want:  # published examples
        assert got[0] == pytest.approx(want, abs=0.005)


def plain_tm(seq, table="DNA 1997", salt=5, na=50.0, tris=0.0, mg=0.0, dntp=0.0):
    values, pair = C.NEIGHBOURS[table], {"A": "T", "C": "G", "G": "C", "T": "A"}
    known = {}
    for stack, v in zip(C.STACKS, values["stacks"], strict=True):
        known[stack] = known[pair[stack[1]] + pair[stack[0]]] = v
    terms = [known[seq[i : i + 2]] for i in range(len(seq) - 1)] + [values.get("start", (0, 0)), values.get("any GC", (0, 0))]
    terms += [values.get("end AT" if e in "AT" else "end GC", (0, 0)) for e in (seq[0], seq[-1])]
    h, s = (sum(t[k] for t in terms) / 100 for k in (0, 1))
    gc, n, mono = sum(c in "GC" for c in seq) / len(seq), len(seq), (na + tris / 2) / 1000
    if salt == 5 and mg > dntp:
        mono += 0.12 * math.sqrt(mg - dntp)
    ln, rk = math.log(mono), 1.987 * math.log(12.5e-9)
    if salt == 5:
        return 1000 * h / (s + 0.368 * (n - 1) * ln + rk) - 273.15
    t = 1000 * h / (s + rk)
    if salt <= 4:
        return t - 273.15 + {1: 16.6 * math.log10(mono), 2: 16.6 * math.log10(mono / (1 + 0.7 * mono)), 3: 12.5 * math.log10(mono), 4: 11.7 * math.log10(mono)}[salt]
    if salt == 6:
        return 1 / (1 / t + (4.29 * gc - 3.95) * 1e-5 * ln + 9.4e-6 * ln**2) - 273.15
    free = mg * 1e-3
    if dntp:
        # the free ion x solves x + bound = total, bound = K x (nucleotides - bound)
        lo, hi = 0.0, free
        for _ in range(200):
            x = (lo + hi) / 2
            lo, hi = (x, hi) if x + 3e4 * x * dntp * 1e-3 / (1 + 3e4 * x) < free else (lo, x)
        free = lo
    assert 0.22 <= math.sqrt(free) / mono < 6
    a, d = 3.92 * (0.843 - 0.352 * math.sqrt(mono) * ln), 1.42 * (1.279 - 4.03e-3 * ln - 8.03e-3 * ln**2)
    g, lm = 8.31 * (0.486 - 0.258 * ln + 5.25e-3 * ln**3), math.log(free)
    return 1 / (1 / t + (a - 0.911 * lm + gc * (6.26 + d * lm) + (-48.2 + 52.5 * lm + g * lm**2) / (2 * (n - 1))) * 1e-5) - 273.15


def test_empirical(spark):
    assert one(spark, lambda s: C.melting_empirical(s, 2), "CTGCTGATXGCACGAGGTTATGG", "")[0] == pytest.approx(69.20, abs=0.005)
    tm = F.lit(70.0)
    assert one(spark, lambda s: C.solvent_correction(tm, dmso=3), "")[0] == pytest.approx(67.75)
    assert one(spark, lambda s: C.solvent_correction(tm, formamide=1.25, molar=True, gc_percent=F.lit(50.0)), "")[0] == pytest.approx(66.68, abs=0.005)
    with pytest.raises(ValueError):
        C.salt_term(1, F.lit(1), F.lit(0.5), na=0.0)


def test_composition(spark):
    got = one(spark, C.gc_by_position, "ACTGTN", "", None, "ACTGG", "g")
    assert tuple(got[0]) == (40.0, 50.0, 50.0, 0.0) and tuple(got[1]) == (0.0,) * 4 and got[2] is None
    assert tuple(got[3]) == (60.0, 50.0, 100.0, 0.0) and tuple(got[4]) == (100.0, 100.0, 0.0, 0.0)
    assert one(spark, lambda s: C.gc_of(s, "weighted"), "ACTGN", "SWBX", "", None) == pytest.approx([0.5, (1 + 2 / 3 + 0.5) / 4, 0.0, None])
    assert one(spark, lambda s: C.gc_skew_windows(s, 4), "GGGCAATTCC", "", None) == [[0.5, 0.0, -1.0], [], None]
    assert one(spark, lambda s: C.find_all(s, "CW"), "CACTCCA", "C", None) == [[0, 2, 5], [], None]
    assert one(spark, C.crc64, "ACGTACGTACGT", "acgtACGTacgt") == ["CRC-C4FBB762C4A87EBD", "CRC-DA4509DC64A87EBD"]
    got = one(spark, lambda s: C.complexity_windows(s, 4), "ACGTA", "ACG")
    assert got[0] == pytest.approx([1.0, 1.0]) and got[1] == []


def test_codons(spark):
    random.seed(1)
    rows = ["".join(random.choice("ACGT") for _ in range(3 * random.randrange(1, 40))) for _ in range(30)]
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    got = {r.codon: r for r in C.codon_adaptiveness(df, "s").collect()}
    assert len(got) == 64
    for codon, r in got.items():
        assert r.n == sum(x[i : i + 3] == codon for x in rows for i in range(0, len(x), 3))
    weights = {c: r.weight for c, r in got.items()}
    table = S.codon_table()
    assert all(math.isclose(max(weights[c] for c in table if table[c] == aa), 1.0) for aa in set(table.values()))
    for x, value in zip(rows, one(spark, lambda s: C.adaptation_index(s, weights), *rows), strict=True):
        used = [weights[x[i : i + 3]] for i in range(0, len(x), 3) if x[i : i + 3] not in ("ATG", "TGG")]
        assert value == pytest.approx(math.exp(sum(map(math.log, used)) / len(used)) if used else None)
    assert one(spark, lambda s: C.adaptation_index(s, weights), "ATGA", "ATG", "", None) == [None] * 4
    back = one(spark, lambda s: S.translate(C.optimise_codons(s, weights)), "MKLV*", "M1", None)
    assert back == ["MKLV*", None, None]
    assert one(spark, C.translate_cds, "ATGGCCTAA", "TTGGCCTAG", "ATGTAAGCCTAA", "ATGGCC", "", None) == ["MA", "MA", None, None, None, None]
    assert tuple(one(spark, C.six_frames, "ATGGCC")[0]) == ("MA", "W", "G", "GH", "A", "P")
    assert C.genetic_code(4).count("*") == 2 and C.genetic_code(1) == S.STANDARD_CODE


def test_protein_profiles(spark):
    aa = "MKTAYIAKQRQISFVKSHFSRQ"
    flex = []
    for i in range(len(aa) - 9):
        w = [C.FLEXIBILITY[c] for c in aa[i : i + 9]]
        flex.append((sum((w[j] + w[8 - j]) * C.FLEXIBILITY_WEIGHTS[j] for j in range(4)) + w[5]) / 5.25)
    got = one(spark, C.flexibility, aa, "MKTAYIAKQ", "", None)
    assert got[0] == pytest.approx(flex) and got[1:] == [[], [], None]
    hydro = []
    for i in range(len(aa) - 4):
        w = [S.HYDROPATHY[c] for c in aa[i : i + 5]]
        hydro.append((0.4 * (w[0] + w[4]) + 0.7 * (w[1] + w[3]) + w[2]) / 3.2)
    assert one(spark, lambda s: C.residue_scale(s, S.HYDROPATHY, 5, 0.4), aa)[0] == pytest.approx(hydro)
    weights = {a + b: float(i - j) for i, a in enumerate("ACDE") for j, b in enumerate("ACDE")}
    assert one(spark, lambda s: C.instability(s, weights), "ACDE", "A", "AX", "", None) == [-7.5, 0.0, None, None, None]
    assert one(spark, lambda s: S.molecular_weight(s, monoisotopic=True), "AG")[0] == pytest.approx(146.069141)
    assert one(spark, C.residue_counts, "AAC")[0]["A"] == 2
