"""Chemistry and codon statistics of sequences as Spark columns.

Like ``sequences``, everything is built from expressions that stay in the JVM.  Sums of
tabulated values are taken in whole hundredths, so no result depends on the order of
addition.  Null in gives null out; a sequence that a formula cannot serve gives null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.sequences import (
    AMBIGUOUS,
    BASES,
    STANDARD_CODE,
    _map,
    codon_table,
    complement,
    count,
    iupac_regex,
    reverse_complement,
    translate,
)
from helixframe.runtime import let

# fixed values: the ten stacks of a duplex (a dinucleotide stands for its reverse complement too)
STACKS = ("AA", "AT", "TA", "CA", "GT", "CT", "GA", "CG", "GC", "GG")
# fixed values: hundredths of (kcal/mol, cal/mol K) of each stack in the order of STACKS, then what a duplex starts with
NEIGHBOURS = {
    "DNA 1986": {
        "stacks": [(-910, -2400), (-860, -2390), (-600, -1690), (-580, -1290), (-650, -1730), (-780, -2080), (-560, -1350), (-1190, -2780), (-1110, -2670), (-1100, -2660)],
        "any GC": (0, -1680), "no GC": (0, -2010), "symmetry": (0, -130),
    },
    "DNA 1996": {
        "stacks": [(-800, -2190), (-560, -1520), (-660, -1840), (-820, -2100), (-940, -2550), (-660, -1640), (-880, -2350), (-1180, -2900), (-1050, -2640), (-1090, -2840)],
        "start": (60, -900), "symmetry": (0, -140),
    },
    "DNA 1997": {
        "stacks": [(-790, -2220), (-720, -2040), (-720, -2130), (-850, -2270), (-840, -2240), (-780, -2100), (-820, -2220), (-1060, -2720), (-980, -2440), (-800, -1990)],
        "end AT": (230, 410), "end GC": (10, -280), "symmetry": (0, -140),
    },
    "DNA 2004": {
        "stacks": [(-760, -2130), (-720, -2040), (-720, -2130), (-850, -2270), (-840, -2240), (-780, -2100), (-820, -2220), (-1060, -2720), (-980, -2440), (-800, -1990)],
        "start": (20, -570), "end AT": (220, 690), "symmetry": (0, -140),
    },
    "RNA 1986": {
        "stacks": [(-660, -1840), (-570, -1550), (-810, -2260), (-1050, -2780), (-1020, -2620), (-760, -1920), (-1330, -3550), (-800, -1940), (-1420, -3490), (-1220, -2970)],
        "start": (0, -1080), "symmetry": (0, -140),
    },
    "RNA 1998": {
        "stacks": [(-682, -1900), (-938, -2670), (-769, -2050), (-1044, -2690), (-1140, -2950), (-1048, -2710), (-1244, -3250), (-1064, -2670), (-1488, -3690), (-1339, -3270)],
        "start": (361, -150), "end AT": (372, 1050), "symmetry": (0, -140),
    },
    "RNA 2012": {
        "stacks": [(-709, -1980), (-911, -2580), (-850, -2290), (-1103, -2880), (-1198, -3130), (-1090, -2850), (-1321, -3490), (-1088, -2740), (-1604, -4060), (-1418, -3500)],
        "start": (640, 699), "end AT": (385, 1104), "symmetry": (0, -140),
    },
    "RNA/DNA 1995": {  # by the dinucleotide of the RNA strand
        "pairs": {
            "AA": (-780, -2190), "AC": (-590, -1230), "AG": (-910, -2350), "AT": (-830, -2390), "CA": (-900, -2610), "CC": (-930, -2320), "CG": (-1630, -4710), "CT": (-700, -1970),
            "GA": (-550, -1350), "GC": (-800, -1710), "GG": (-1280, -3190), "GT": (-780, -2160), "TA": (-780, -2320), "TC": (-860, -2290), "TG": (-1040, -2840), "TT": (-1150, -3640),
        },
        "start": (190, -390), "symmetry": (0, 0),
    },
}
GAS = 1.987
# fixed values: base, factor of %GC, divisor's numerator and salt method of the empirical formulas 1 to 8
EMPIRICAL = {
    1: (69.3, 0.41, 650, 0), 2: (81.5, 0.41, 675, 0), 3: (81.5, 0.41, 675, 1), 4: (81.5, 0.41, 500, 2),
    5: (78.0, 0.7, 500, 2), 6: (67.0, 0.8, 500, 2), 7: (81.5, 0.41, 600, 1), 8: (77.1, 0.41, 528, 4),
}
# fixed values: normalised flexibility of residues
FLEXIBILITY = {
    "A": 0.984, "C": 0.906, "D": 1.068, "E": 1.094, "F": 0.915, "G": 1.031, "H": 0.950, "I": 0.927, "K": 1.102, "L": 0.935,
    "M": 0.952, "N": 1.048, "P": 1.049, "Q": 1.037, "R": 1.008, "S": 1.046, "T": 0.997, "V": 0.931, "W": 0.904, "Y": 0.929,
}
FLEXIBILITY_WEIGHTS = (0.25, 0.4375, 0.625, 0.8125)
# fixed values: how genetic codes differ from the standard one, by their public numbers
CODE_CHANGES = {
    1: {}, 2: {"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"}, 3: {"ATA": "M", "CTA": "T", "CTC": "T", "CTG": "T", "CTT": "T", "TGA": "W"}, 4: {"TGA": "W"},
    5: {"AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"}, 6: {"TAA": "Q", "TAG": "Q"}, 9: {"AAA": "N", "AGA": "S", "AGG": "S", "TGA": "W"}, 10: {"TGA": "C"}, 11: {}, 12: {"CTG": "S"},
    13: {"AGA": "G", "AGG": "G", "ATA": "M", "TGA": "W"}, 14: {"AAA": "N", "AGA": "S", "AGG": "S", "TAA": "Y", "TGA": "W"}, 16: {"TAG": "L"},
    21: {"AAA": "N", "AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"}, 22: {"TCA": "*", "TAG": "L"}, 23: {"TTA": "*"}, 24: {"AGA": "S", "AGG": "K", "TGA": "W"}, 25: {"TGA": "G"},
}


def genetic_code(number: int) -> str:
    """The 64 amino acids of a numbered code, codons in TCAG order."""
    if number not in CODE_CHANGES:
        raise ValueError(f"unknown genetic code {number}")
    codons = [a + b + c for a in BASES for b in BASES for c in BASES]
    return "".join(CODE_CHANGES[number].get(codon, aa) for codon, aa in zip(codons, STANDARD_CODE, strict=True))


def gc_of(s: Column, ambiguous: str = "remove") -> Column:
    """GC fraction; ambiguous letters are left out ("remove"), count as no GC ("ignore") or in part ("weighted")."""
    u = F.upper(s)
    gc, n = count(u, "GCS").cast("double"), F.char_length(u)
    if ambiguous == "remove":
        n = count(u, "ACGTUSW")
    elif ambiguous == "weighted":
        for letter, bases in AMBIGUOUS.items():
            if letter not in "SW":
                gc = gc + count(u, letter) * F.lit(sum(b in "GC" for b in bases) / len(bases))
        gc = gc + count(u, "X") * F.lit(0.5)
    elif ambiguous != "ignore":
        raise ValueError("ambiguous is remove, ignore or weighted")
    return F.when(n > 0, gc / n).otherwise(F.when(s.isNotNull(), F.lit(0.0)))


def gc_by_position(s: Column) -> Column:
    """(all, first, second, third) percent of G and C among A, C, G, T at each place of the codons."""
    u = F.upper(s)
    # a codon that is cut short is filled up with blanks, so each place is one letter
    whole = F.concat(u, F.lit("  "))
    at = [F.regexp_replace(whole, f"(?s){k}(?:.{{0,2}}$)?", "$1") for k in ("(.)..", ".(.).", "..(.)")]
    share = lambda gc, n: F.when(n > 0, 100.0 * gc / n).otherwise(F.lit(0.0))
    total = share(count(u, "GC"), count(u, "ACGT"))
    return F.when(s.isNotNull(), F.struct(total.alias("all"), *[share(count(x, "GC"), count(x, "ACGT")).alias(name) for name, x in zip(("first", "second", "third"), at, strict=True)]))


def letters_of(s: Column) -> Column:
    """The letters of a sequence as an array: places in it are found at once, not by walking the text."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def _windows(s: Column, size: int, step: int, f, short: bool = False) -> Column:
    """``f`` of each window's text; the last ones may be shorter if ``short``."""

    def cut(letters: Column) -> Column:
        last = F.size(letters) - (1 if short else size)
        each = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step)), lambda i: let(F.array_join(F.slice(letters, i + 1, F.lit(size)), ""), f))
        return F.when(last >= 0, each).otherwise(F.array().cast("array<double>"))

    return F.when(s.isNotNull(), let(letters_of(s), cut))


def _scored(s: Column, table: dict[str, float], size: int, f) -> Column:
    """``f`` of each window of ``size`` residue values, given as a function from the place in the window."""
    # a place for each code from A on is found at once, a map is searched
    values = F.array(*[F.lit(table.get(chr(65 + k))).cast("double") for k in range(26)])

    def cut(v: Column) -> Column:
        last = F.size(v) - size
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: f(lambda j: F.get(v, i + j)))).otherwise(F.array().cast("array<double>"))

    return F.when(s.isNotNull(), let(F.transform(letters_of(s), lambda c: F.get(values, F.ascii(c) - 65)), cut))


def gc_skew_windows(s: Column, window: int = 100) -> Column:
    """(G - C) / (G + C) of consecutive windows; 0 for none."""

    def skew(w: Column) -> Column:
        g, c = count(w, "G"), count(w, "C")
        return F.when(g + c > 0, (g - c) / (g + c)).otherwise(F.lit(0.0))

    return _windows(F.upper(s), window, window, skew, short=True)


def complexity_windows(s: Column, size: int) -> Column:
    """Entropy of A, C, G, T to base 4 in each window of ``size``, one letter apart."""

    def entropy(w: Column) -> Column:
        total = F.lit(0.0)
        for letter in "ACGT":
            p = count(w, letter) / F.lit(float(size))
            total = total - F.when(p > 0, p * F.log(p) / F.lit(math.log(4.0))).otherwise(F.lit(0.0))
        return total

    return _windows(F.upper(s), size, 1, entropy)


def find_all(s: Column, pattern: str) -> Column:
    """0-based places at which an IUPAC subsequence starts, overlapping ones too."""
    n, form = len(pattern), f"^(?:{iupac_regex(pattern)})$"
    none = F.array().cast("array<int>")

    def places(letters: Column) -> Column:
        last = F.size(letters) - n
        return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(letters, i + 1, F.lit(n)), "").rlike(form))).otherwise(none)

    return F.when(s.isNotNull(), let(letters_of(F.upper(s)), places))


def six_frames(s: Column, code: str = STANDARD_CODE) -> Column:
    """Translations from the first three letters of the strand (f1 to f3) and of the other one (r1 to r3)."""
    shifted = lambda x, k: translate(F.substring(x, F.lit(k + 1), F.char_length(x)), code)
    back = reverse_complement(s)
    return F.struct(*[shifted(s, k).alias(f"f{k + 1}") for k in range(3)], *[shifted(back, k).alias(f"r{k + 1}") for k in range(3)])


def translate_cds(s: Column, code: str = STANDARD_CODE, starts: tuple[str, ...] = ("TTG", "CTG", "ATG")) -> Column:
    """A whole coding sequence: starts with a start codon, read as M, ends with its only stop; null if it is not one."""
    u = F.replace(F.upper(s), F.lit("U"), F.lit("T"))
    aa = translate(u, code)
    body = F.substring(aa, F.lit(2), F.char_length(aa) - 2)
    whole = (F.char_length(u) % 3 == 0) & F.substring(u, 1, 3).isin(*starts) & (F.char_length(aa) > 1) & aa.endswith("*") & ~body.contains("*")
    return F.when(whole, F.concat(F.lit("M"), body))


def codons(s: Column) -> Column:
    return F.regexp_extract_all(F.upper(s), F.lit("(?s).{1,3}"), F.lit(0))


def codon_adaptiveness(rows: DataFrame, seq: str, code: str = STANDARD_CODE) -> DataFrame:
    """(codon, amino, n, weight) of the 64 codons: use relative to the amino acid's most used codon.

    Codons are counted over all rows before anything is shuffled; one that never occurs counts as half a one.
    """
    spark = rows.sparkSession
    table = spark.createDataFrame(sorted(codon_table(code).items()), "codon string, amino string")
    used = rows.select(F.explode(codons(F.col(seq))).alias("codon")).groupBy("codon").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    every = table.join(used, "codon", "left").select("codon", "amino", n.alias("n"))
    counted = F.when(F.col("n") > 0, F.col("n").cast("double")).otherwise(F.lit(0.5))
    return every.withColumn("weight", counted / F.max(counted).over(Window.partitionBy("amino")))


def adaptation_index(s: Column, weights: dict[str, float]) -> Column:
    """Geometric mean of the codons' weights without ATG and TGG; null for letters that are no codon, or none left.

    ``weights`` has one entry for a codon: the collected result of ``codon_adaptiveness``.  Stops without a weight are passed over.
    """
    logs = _map({k: math.log(v) for k, v in weights.items()} or {"": 0.0})
    ends = [c for c in ("TGA", "TAA", "TAG") if c not in weights]

    def solve(parts: Column) -> Column:
        used = F.filter(parts, lambda c: ~c.isin("ATG", "TGG", *ends))
        values = F.transform(used, lambda c: F.element_at(logs, c))
        total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
        return F.when(F.size(used) > 0, F.exp(total / F.size(used)))

    return let(codons(s), solve)


def optimise_codons(protein: Column, weights: dict[str, float], code: str = STANDARD_CODE) -> Column:
    """Each residue (and stop) as its best codon; null if a letter has none."""
    best: dict[str, str] = {}
    for codon, amino in sorted(codon_table(code).items()):
        if codon in weights and (amino not in best or weights[codon] > weights[best[amino]]):
            best[amino] = codon
    table = _map(best or {"": ""})
    letters = F.filter(F.split(F.upper(protein), ""), lambda c: c != "")
    known = F.transform(letters, lambda c: F.element_at(table, c))
    return F.when(~F.exists(known, lambda c: c.isNull()), F.array_join(known, ""))


def _crc64_table() -> list[int]:
    out = []
    for byte in range(256):
        x = byte
        for _ in range(8):
            x = (x >> 1) ^ (0xD800000000000000 if x & 1 else 0)
        out.append(x - (1 << 64) if x >> 63 else x)
    return out


def crc64(s: Column) -> Column:
    """``CRC-`` and 16 hex digits: the reflected CRC-64 with polynomial x^64 + x^4 + x^3 + x + 1 from zero."""
    table = F.array(*[F.lit(x).cast("long") for x in _crc64_table()])
    step = lambda acc, c: F.shiftrightunsigned(acc, 8).bitwiseXOR(F.get(table, acc.bitwiseXOR(F.ascii(c)).bitwiseAND(F.lit(255)).cast("int")))
    letters = F.filter(F.split(s, ""), lambda c: c != "")
    return F.concat(F.lit("CRC-"), F.lpad(F.hex(F.aggregate(letters, F.lit(0).cast("long"), step)), 16, "0"))


def salt_term(method: int, n: Column, gc: Column, na: float = 50.0, k: float = 0.0, tris: float = 0.0, mg: float = 0.0, dntp: float = 0.0) -> Column:
    """What salt adds: to the temperature (1 to 4), to the entropy (5) or to 1 / temperature (6, 7); millimolar ions."""
    if not 0 <= method <= 7:
        raise ValueError("salt methods are 0 to 7")
    if method == 0:
        return F.lit(0.0)
    mono = na + k + tris / 2
    if method != 7 and mg > dntp:  # free magnesium as so much sodium
        mono += 120 * math.sqrt(mg - dntp)
    mono /= 1000
    if method < 7 and mono <= 0:
        raise ValueError("this salt method needs ions")
    if method <= 4:
        factor = {1: 16.6, 2: 16.6, 3: 12.5, 4: 11.7}[method]
        return F.lit(factor * math.log10(mono / (1 + 0.7 * mono) if method == 2 else mono))
    if method == 5:
        return 0.368 * (n - 1) * F.lit(math.log(mono))
    by_sodium = lambda: (4.29 * gc - 3.95) * F.lit(1e-5 * math.log(mono)) + F.lit(9.4e-6 * math.log(mono) ** 2)
    if method == 6:
        return by_sodium()
    free = mg / 1000
    if dntp > 0:  # what the nucleotides leave of it, by the constant of their complex
        bound = 3e4 * (dntp / 1000 - free) + 1
        free = (math.sqrt(bound * bound + 4 * 3e4 * free) - bound) / (2 * 3e4)
    a, d, g = 3.92, 1.42, 8.31
    if mono > 0:
        ratio, ln = math.sqrt(free) / mono, math.log(mono)
        if ratio < 0.22:
            return by_sodium()
        if ratio < 6:
            a *= 0.843 - 0.352 * math.sqrt(mono) * ln
            d *= 1.279 - 4.03e-3 * ln - 8.03e-3 * ln**2
            g *= 0.486 - 0.258 * ln + 5.25e-3 * ln**3
    if free <= 0:
        raise ValueError("this salt method needs ions")
    lm = math.log(free)
    return (F.lit(a - 0.911 * lm) + gc * F.lit(6.26 + d * lm) + F.lit(-48.2 + 52.5 * lm + g * lm**2) / (2.0 * (n - 1))) * 1e-5


def melting_empirical(s: Column, formula: int = 7, mismatches: bool = True, **ions: float) -> Column:
    """One of eight formulas of GC percent and length; X marks a mismatch."""
    a, b, c, method = EMPIRICAL[formula]
    u = F.upper(F.regexp_replace(s, r"\s", ""))
    n, gc = F.char_length(u), 100 * gc_of(u, "weighted")
    wrong = 100.0 * count(u, "X") / n if mismatches else F.lit(0.0)
    tm = a + b * (gc - wrong / 2) - c / n + salt_term(method, n, gc_of(u, "ignore"), **ions) - wrong
    return F.when(n > 0, tm)


def melting_neighbours(s: Column, table: str = "DNA 1997", high: float = 25.0, low: float = 25.0, self_complementary: bool = False, salt: int = 5, **ions: float) -> Column:
    """Nearest-neighbour melting temperature of a strand with its perfect complement; nanomolar strands.

    Null if the sequence is shorter than two letters or has other letters than A, C, G, T or U.
    """
    values = NEIGHBOURS[table]
    u = F.replace(F.upper(F.regexp_replace(s, r"\s", "")), F.lit("U"), F.lit("T"))
    n, gc = F.char_length(u), gc_of(u, "ignore")
    heat, disorder = F.lit(0).cast("long"), F.lit(0).cast("long")

    def add(times: Column, pair: tuple[int, int]) -> None:
        nonlocal heat, disorder
        heat, disorder = heat + times * F.lit(pair[0]).cast("long"), disorder + times * F.lit(pair[1]).cast("long")

    swap = str.maketrans("ACGT", "TGCA")
    alike = {x: {x, x.translate(swap)[::-1]} for x in STACKS} if "stacks" in values else {x: {x} for x in values["pairs"]}
    for both, pair in zip(alike.values(), values.get("stacks") or values["pairs"].values(), strict=True):
        add(F.regexp_count(u, F.lit("|".join(f"{x[0]}(?={x[1]})" for x in sorted(both)))), pair)
    ends = F.array(F.left(u, F.lit(1)), F.right(u, F.lit(1)))
    add(F.lit(1), values.get("start", (0, 0)))
    add(F.size(F.filter(ends, lambda e: e.isin("A", "T"))), values.get("end AT", (0, 0)))
    add(F.size(F.filter(ends, lambda e: e.isin("C", "G"))), values.get("end GC", (0, 0)))
    add((gc > 0).cast("int"), values.get("any GC", (0, 0)))
    add((gc == 0).cast("int"), values.get("no GC", (0, 0)))
    if self_complementary:
        add(F.lit(1), values["symmetry"])
    amount = high if self_complementary else high - low / 2
    if amount <= 0:
        raise ValueError("the strands need a concentration")
    term = salt_term(salt, n, gc, **ions)
    entropy = disorder / F.lit(100.0) + (term if salt == 5 else F.lit(0.0))
    kelvin = 10.0 * heat / (entropy + F.lit(GAS * math.log(amount * 1e-9)))
    if salt in (6, 7):
        kelvin = 1 / (1 / kelvin + term)
    tm = kelvin - 273.15 + (term if 1 <= salt <= 4 else F.lit(0.0))
    return F.when((n > 1) & (count(u, "ACGT") == n), tm)


def solvent_correction(tm: Column, dmso: float = 0.0, formamide: float = 0.0, dmso_factor: float = 0.75, formamide_factor: float = 0.65, molar: bool = False, gc_percent: Column | None = None) -> Column:
    """Lower ``tm`` by percent DMSO and by formamide, in percent or molar (then by GC percent)."""
    if not molar:
        return tm - dmso_factor * dmso - formamide_factor * formamide
    if gc_percent is None:
        raise ValueError("molar formamide needs the GC percent")
    return tm - dmso_factor * dmso + (0.453 * gc_percent / 100.0 - 2.88) * formamide


def residue_scale(s: Column, table: dict[str, float], window: int, edge: float = 1.0) -> Column:
    """Weighted mean of a residue scale in each window; weights fall evenly from 1 in the middle to ``edge``; unknown pairs count as 0."""
    half = window // 2
    step = 2 * (1 - edge) / (window - 1) if window > 1 else 0.0
    weights = [edge + step * j for j in range(half)]

    def score(at) -> Column:
        total = F.coalesce(at(half), F.lit(0.0))
        for j, weight in enumerate(weights):
            total = total + F.coalesce((at(j) + at(window - 1 - j)) * weight, F.lit(0.0))
        return total / (2 * sum(weights) + 1)

    return _scored(F.upper(s), table, window, score)


def flexibility(s: Column) -> Column:
    """Flexibility of each window of nine but the last; the letter after the middle counts as the middle."""
    u = F.upper(s)

    def score(at) -> Column:
        total = at(5)
        for j, weight in enumerate(FLEXIBILITY_WEIGHTS):
            total = total + (at(j) + at(8 - j)) * weight
        return total / 5.25

    return _scored(F.left(u, F.char_length(u) - 1), FLEXIBILITY, 9, score)


def instability(s: Column, weights: dict[str, float]) -> Column:
    """10 / length times the sum of the dipeptides' ``weights``; null if one is missing or the sequence is empty."""
    table = _map(weights)

    def solve(letters: Column) -> Column:
        n = F.size(letters)
        pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(letters, i, 2), ""))).otherwise(F.array().cast("array<string>"))
        return F.when(n > 0, 10.0 / n * F.aggregate(F.transform(pairs, lambda x: F.element_at(table, x)), F.lit(0.0), lambda a, x: a + x))

    return let(letters_of(F.upper(s)), solve)


def residue_counts(s: Column, letters: str = "ACDEFGHIKLMNPQRSTVWY") -> Column:
    """Map of each residue to how often it stands in the sequence."""
    u = F.upper(s)
    return F.when(s.isNotNull(), F.create_map(*[x for c in letters for x in (F.lit(c), count(u, c))]))


def duplex(s: Column) -> Column:
    """The strand and what it pairs with, place by place."""
    return F.struct(s.alias("strand"), complement(s).alias("paired"))
