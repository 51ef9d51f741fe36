"""Sequence functions as Spark columns: strands, translation, composition, chemistry.

Nothing here runs Python per row; all are built-in expressions, so they stay in Tungsten.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.runtime import let

# fixed values: IUPAC nucleotide codes and their complements, in the same order
IUPAC = "ACGTUMRWSYKVHDBNXacgtumrwsykvhdbnx"
COMPLEMENT = "TGCAAKYWSRMBDHVNXtgcaakywsrmbdhvnx"
COMPLEMENT_RNA = "UGCAAKYWSRMBDHVNXugcaakywsrmbdhvnx"
# fixed values: amino acids of the standard code, codons in TCAG order
BASES = "TCAG"
STANDARD_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
# fixed values: IUPAC codes and what they stand for
AMBIGUOUS = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
# fixed values: average masses of residues as free amino acids, and of nucleotides as monophosphates
PROTEIN_MASS = {
    "A": 89.0932, "C": 121.1582, "D": 133.1027, "E": 147.1293, "F": 165.1891, "G": 75.0666, "H": 155.1546, "I": 131.1729, "K": 146.1876, "L": 131.1729,
    "M": 149.2113, "N": 132.1179, "O": 255.3134, "P": 115.1305, "Q": 146.1445, "R": 174.201, "S": 105.0926, "T": 119.1192, "U": 168.0532, "V": 117.1463, "W": 204.2252, "Y": 181.1885,
}
DNA_MASS = {"A": 331.2218, "C": 307.1971, "G": 347.2212, "T": 322.2085}
RNA_MASS = {"A": 347.2212, "C": 323.1965, "G": 363.2206, "U": 324.1813}
WATER = 18.0153
# fixed values: the same masses of the lightest isotopes
PROTEIN_MASS_MONO = {
    "A": 89.047678, "C": 121.019749, "D": 133.037508, "E": 147.053158, "F": 165.078979, "G": 75.032028, "H": 155.069477, "I": 131.094629, "K": 146.105528, "L": 131.094629,
    "M": 149.051049, "N": 132.053492, "O": 255.158292, "P": 115.063329, "Q": 146.069142, "R": 174.111676, "S": 105.042593, "T": 119.058243, "U": 168.964203, "V": 117.078979, "W": 204.089878, "Y": 181.073893,
}
DNA_MASS_MONO = {"A": 331.06817, "C": 307.056936, "G": 347.063084, "T": 322.056602}
RNA_MASS_MONO = {"A": 347.063084, "C": 323.051851, "G": 363.057999, "U": 324.035867}
WATER_MONO = 18.010565
# fixed values: Kyte-Doolittle hydropathy
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
    "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}
# fixed values: side-chain and terminal pK for the charge of a protein
POSITIVE_PK = {"K": 10.0, "R": 12.0, "H": 5.98}
NEGATIVE_PK = {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
N_TERM, C_TERM = 7.5, 3.55
# fixed values: terminal pK of some first and last residues
N_TERM_OF = {"A": 7.59, "M": 7.0, "S": 6.93, "P": 8.36, "T": 6.82, "V": 7.44, "E": 7.7}
C_TERM_OF = {"D": 4.55, "E": 4.75}
THREE = {
    "A": "Ala", "B": "Asx", "C": "Cys", "D": "Asp", "E": "Glu", "F": "Phe", "G": "Gly", "H": "His", "I": "Ile", "K": "Lys", "L": "Leu", "M": "Met", "N": "Asn", "P": "Pro", "Q": "Gln", "R": "Arg",
    "S": "Ser", "T": "Thr", "V": "Val", "W": "Trp", "X": "Xaa", "Y": "Tyr", "Z": "Glx", "J": "Xle", "U": "Sec", "O": "Pyl", "*": "Ter",
}


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def count(s: Column, letters: str) -> Column:
    """How many characters of ``s`` are among ``letters``."""
    return (F.char_length(s) - F.char_length(F.translate(s, letters, ""))).cast("long")


def complement(s: Column) -> Column:
    return F.translate(s, IUPAC, COMPLEMENT)


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def complement_rna(s: Column) -> Column:
    return F.translate(s, IUPAC, COMPLEMENT_RNA)


def reverse_complement_rna(s: Column) -> Column:
    return F.reverse(complement_rna(s))


def transcribe(s: Column) -> Column:
    return F.translate(s, "Tt", "Uu")


def back_transcribe(s: Column) -> Column:
    return F.translate(s, "Uu", "Tt")


def ungap(s: Column, gap: str = "-") -> Column:
    return F.replace(s, F.lit(gap), F.lit(""))


def starts_with(s: Column, *subs: str, start: int = 0) -> Column:
    """Whether any of ``subs`` stands at place ``start``."""
    rest = F.substring(s, F.lit(start + 1), F.char_length(s))
    return F.greatest(*[F.startswith(rest, F.lit(x)) for x in subs], F.lit(False))


def ends_with(s: Column, *subs: str) -> Column:
    return F.greatest(*[F.endswith(s, F.lit(x)) for x in subs], F.lit(False))


def split(s: Column, sep: str | None = None, most: int = -1) -> Column:
    """Pieces between ``sep``, at most ``most`` cuts; without it between runs of white space, none of them empty."""
    import re

    if sep is None:
        return F.filter(F.split(F.trim(F.regexp_replace(s, r"\s+", " ")), " ", most + 1 if most >= 0 else -1), lambda x: x != "")
    return F.split(s, re.escape(sep), most + 1 if most >= 0 else -1)


def strip(s: Column, chars: str = " \t\n\r\x0b\x0c", side: str = "both") -> Column:
    cut = {"both": F.trim, "left": F.ltrim, "right": F.rtrim}[side]
    return cut(s, F.lit(chars))


def upper(s: Column) -> Column:
    return F.upper(s)


def lower(s: Column) -> Column:
    return F.lower(s)


def replace(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new))


def join(parts: Column, sep: str = "") -> Column:
    """An array of sequences as one."""
    return F.array_join(parts, sep)


def codon_table(code: str = STANDARD_CODE) -> dict[str, str]:
    return {a + b + c: code[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}


def translate(s: Column, code: str = STANDARD_CODE, to_stop: bool = False, stop: str = "*", unknown: str = "X") -> Column:
    """Codon by codon; codons with other letters are ``unknown``, a trailing part is ignored."""
    dna = F.upper(back_transcribe(s))
    table = _map({k: (stop if v == "*" else v) for k, v in codon_table(code).items()})
    # cut at once: a substring for each codon would walk a long sequence again and again
    codons = F.regexp_extract_all(dna, F.lit("(?s)..."), F.lit(0))
    whole = F.array_join(F.transform(codons, lambda c: F.coalesce(F.element_at(table, c), F.lit(unknown))), "")
    return F.substring_index(whole, stop, 1) if to_stop else whole


def find(s: Column, sub: str) -> Column:
    """First place of ``sub`` from 0, or -1."""
    return (F.instr(s, sub) - 1).cast("long")


def rfind(s: Column, sub: str) -> Column:
    at = F.instr(F.reverse(s), sub[::-1])
    return F.when(at > 0, F.char_length(s) - at - len(sub) + 1).otherwise(-1).cast("long")


def count_sub(s: Column, sub: str) -> Column:
    """Places of ``sub`` that do not overlap."""
    return F.expr("0L") + ((F.char_length(s) - F.char_length(F.replace(s, F.lit(sub), F.lit("")))) / len(sub)).cast("long")


def count_overlapping(s: Column, sub: str) -> Column:
    import re

    return F.regexp_count(s, F.lit(f"(?={re.escape(sub)})")).cast("long")


def gc_fraction(s: Column) -> Column:
    """G, C and S among A, C, G, T, U, S and W; 0 for none."""
    u = F.upper(s)
    gc, all_ = count(u, "GCS"), count(u, "ACGTUSW")
    return F.when(all_ > 0, gc / all_).otherwise(F.lit(0.0))


def gc_skew(s: Column) -> Column:
    u = F.upper(s)
    g, c = count(u, "G"), count(u, "C")
    return F.when(g + c > 0, (g - c) / (g + c)).otherwise(F.lit(0.0))


def _sum_of(s: Column, table: dict[str, float], parts: int = 10_000) -> Column:
    """The sum of the letters' values in whole 1 / ``parts``, so the order of addition is no matter."""
    total = F.lit(0).cast("long")
    for letter, value in table.items():
        total = total + count(s, letter) * F.lit(round(value * parts)).cast("long")
    return total


def molecular_weight(s: Column, kind: str = "protein", double: bool = False, circular: bool = False, monoisotopic: bool = False) -> Column:
    """Mass of the chain; null if a letter has no mass or the sequence is empty."""
    average = {"protein": PROTEIN_MASS, "DNA": DNA_MASS, "RNA": RNA_MASS}
    table = ({"protein": PROTEIN_MASS_MONO, "DNA": DNA_MASS_MONO, "RNA": RNA_MASS_MONO} if monoisotopic else average)[kind]
    parts, water = (1_000_000, WATER_MONO) if monoisotopic else (10_000, WATER)
    u = F.upper(s)
    n = F.char_length(u).cast("long")
    lost = (n if circular else n - 1) * round(water * parts)
    mass = _sum_of(u, table, parts) - lost
    if double:
        other = complement(u) if kind == "DNA" else complement_rna(u)
        mass = mass + _sum_of(other, table, parts) - lost
    known = count(u, "".join(table))
    return F.when((n > 0) & (known == n), mass / F.lit(float(parts)))


def gravy(s: Column) -> Column:
    """Mean hydropathy over the residues of the scale."""
    u = F.upper(s)
    n = count(u, "".join(HYDROPATHY))
    return F.when(n > 0, _sum_of(u, HYDROPATHY) / F.lit(10000.0) / n)


def aromaticity(s: Column) -> Column:
    u = F.upper(s)
    return F.when(F.char_length(u) > 0, count(u, "YWF") / F.char_length(u))


def fraction(s: Column, letters: str) -> Column:
    u = F.upper(s)
    return F.when(F.char_length(u) > 0, count(u, letters) / F.char_length(u))


def secondary_structure(s: Column) -> Column:
    """(helix, turn, sheet) fractions of residues that prefer each."""
    return F.struct(fraction(s, "EMALK").alias("helix"), fraction(s, "NPGSD").alias("turn"), fraction(s, "VIYFWLT").alias("sheet"))


def extinction(s: Column) -> Column:
    """(reduced, with cystines) molar extinction coefficients."""
    u = F.upper(s)
    base = count(u, "Y") * 1490 + count(u, "W") * 5500
    return F.struct(base.alias("reduced"), (base + F.floor(count(u, "C") / 2) * 125).alias("cystines"))


def charge(s: Column, ph: Column | float = 7.0) -> Column:
    """Net charge of a protein at a pH; the ends count with the pK of their residue if it has one."""
    u, x = F.upper(s), F.lit(float(ph)) if isinstance(ph, (int, float)) else ph
    pos = lambda pk: F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), x - pk))
    neg = lambda pk: F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), pk - x))
    n_end = F.coalesce(F.element_at(_map(N_TERM_OF), F.substring(u, 1, 1)), F.lit(N_TERM))
    c_end = F.coalesce(F.element_at(_map(C_TERM_OF), F.right(u, F.lit(1))), F.lit(C_TERM))
    total = pos(n_end) - neg(c_end)
    for letter, pk in POSITIVE_PK.items():
        total = total + count(u, letter) * pos(F.lit(pk))
    for letter, pk in NEGATIVE_PK.items():
        total = total - count(u, letter) * neg(F.lit(pk))
    return F.when(F.char_length(u) > 0, total)


def isoelectric_point(s: Column, steps: int = 18) -> Column:
    """The pH of no net charge in [4.05, 12], halving the range in the plan itself."""
    u = F.upper(s)
    n = {c: count(u, c) for c in (*POSITIVE_PK, *NEGATIVE_PK)}
    start = F.struct(F.lit(4.05).alias("lo"), F.lit(12.0).alias("hi"))
    ends = F.struct(
        *[n[c].alias(c) for c in n],
        F.coalesce(F.element_at(_map(N_TERM_OF), F.substring(u, 1, 1)), F.lit(N_TERM)).alias("nt"),
        F.coalesce(F.element_at(_map(C_TERM_OF), F.right(u, F.lit(1))), F.lit(C_TERM)).alias("ct"),
    )

    def solve(e: Column) -> Column:
        def at(x: Column) -> Column:
            pos = lambda pk: F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), x - pk))
            neg = lambda pk: F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), pk - x))
            total = pos(e["nt"]) - neg(e["ct"])
            for c, pk in POSITIVE_PK.items():
                total = total + e[c] * pos(F.lit(pk))
            for c, pk in NEGATIVE_PK.items():
                total = total - e[c] * neg(F.lit(pk))
            return total

        def half(acc: Column, _: Column) -> Column:
            mid = (acc["lo"] + acc["hi"]) / 2
            up = at(mid) > 0
            return F.struct(F.when(up, mid).otherwise(acc["lo"]).alias("lo"), F.when(up, acc["hi"]).otherwise(mid).alias("hi"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, half, lambda acc: (acc["lo"] + acc["hi"]) / 2)

    return F.when(F.char_length(u) > 0, let(ends, solve))


def complexity(s: Column) -> Column:
    """Entropy of A, C, G, T to base 4."""
    u = F.upper(s)
    n = F.char_length(u).cast("double")
    total = F.lit(0.0)
    for c in "ACGT":
        p = count(u, c) / n
        total = total - F.when(p > 0, p * F.log(p) / F.log(F.lit(4.0))).otherwise(F.lit(0.0))
    return F.when(n > 0, total).otherwise(F.lit(0.0))


def melting_wallace(s: Column) -> Column:
    """4 degrees for G, C and S, 2 for A, T and W."""
    u = F.upper(back_transcribe(s))
    return (4 * count(u, "GCS") + 2 * count(u, "ATW")).cast("double")


def melting_gc(s: Column, a: float = 81.5, b: float = 0.41, c: float = 500.0, mismatch: float = 0.0) -> Column:
    """a + b * %GC - c / length - mismatch."""
    u = F.upper(s)
    n = F.char_length(u)
    return F.when(n > 0, a + b * (100.0 * count(u, "GCS") / n) - F.lit(c) / n - mismatch)


def gcg_checksum(s: Column) -> Column:
    """Sum of character codes times their place modulo 57, modulo 10000."""
    codes = F.transform(_chars(F.upper(s)), lambda ch, i: (F.pmod(i, F.lit(57)) + 1) * F.ascii(ch))
    return F.pmod(F.aggregate(codes, F.lit(0).cast("long"), lambda acc, x: acc + x), F.lit(10000)).cast("long")


def seguid(s: Column) -> Column:
    """Base64 of the SHA-1 of the upper-cased sequence, without padding."""
    return F.rtrim(F.base64(F.unhex(F.sha1(F.upper(s)))), F.lit("="))


def seq3(s: Column, undefined: str = "Xaa") -> Column:
    return F.array_join(F.transform(_chars(F.upper(s)), lambda c: F.coalesce(F.element_at(_map(THREE), c), F.lit(undefined))), "")


def seq1(s: Column, undefined: str = "X") -> Column:
    table = _map({v.upper(): k for k, v in THREE.items()})
    return F.array_join(F.transform(F.regexp_extract_all(F.upper(s), F.lit("(?s)..."), F.lit(0)), lambda c: F.coalesce(F.element_at(table, c), F.lit(undefined))), "")


def repeat_runs(s: Column, n: int) -> Column:
    """Runs of one character of at least ``n``."""
    return F.regexp_count(s, F.lit(rf"(?s)(.)\1{{{n - 1},}}")).cast("long")


def prosite_regex(pattern: str) -> str:
    """A PROSITE pattern as a Java and RE2 regular expression."""
    import re

    body = pattern.strip().rstrip(".").replace(" ", "")
    head = body.startswith("<")
    tail = body.endswith(">")
    out = ""
    for element in body.strip("<>").split("-"):
        m = re.fullmatch(r"(x|[A-Z]|\[[A-Z<>]+\]|\{[A-Z]+\})(?:\((\d+)(?:,(\d+))?\))?", element, re.I)
        if not m:
            raise ValueError(f"not a PROSITE element: {element!r}")
        unit = m[1].upper()
        unit = "." if unit == "X" else f"[^{unit[1:-1]}]" if unit[0] == "{" else unit
        out += unit + (f"{{{m[2]},{m[3]}}}" if m[3] else f"{{{m[2]}}}" if m[2] else "")
    return ("^" if head else "") + out + ("$" if tail else "")


def iupac_regex(pattern: str) -> str:
    """An IUPAC subsequence as a regular expression."""
    return "".join(f"[{AMBIGUOUS[c]}]" if c in AMBIGUOUS else c for c in pattern.upper().replace("U", "T"))


def motif_count(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(prosite_regex(pattern))).cast("long")


def clean_name(s: Column) -> Column:
    """Names that are safe in Newick trees."""
    return F.translate(s, " ;:,()'\"", "________")


def sanitize(s: Column) -> Column:
    return F.regexp_replace(s, r"[^ \w\-.;:]", "_")


def color_hex(s: Column) -> Column:
    """``#RRGGBB`` in upper case, or null."""
    return F.when(s.rlike("^#?[0-9A-Fa-f]{6}$"), F.concat(F.lit("#"), F.upper(F.right(s, F.lit(6)))))
