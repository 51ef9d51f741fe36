"""Queries over sequence functions, k-mers and motifs."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import chemistry as C
from helixframe.functions import sequences as S
from helixframe.operators import editing, search, similarity
from helixframe.plans import tables as T
from helixframe.plans.record_queries import order_sequences
from helixframe.plans.registry import query

SEQ = "s AS (SELECT l_orderkey AS id, string_agg(CASE WHEN l_returnflag = 'A' THEN 'A' WHEN l_returnflag = 'N' THEN 'C' ELSE 'T' END, '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq FROM lineitem GROUP BY 1)"
#: A protein-like sequence: the letters of a document, upper case, in the amino alphabet.
AA = "p AS (SELECT doc_id AS id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS aa FROM documents)"


def proteins(spark, d):
    return T.read(spark, d, "documents").select(F.col("doc_id").alias("id"), editing.clean_residues(F.col("text")).alias("aa"))


@query(f"WITH {SEQ} SELECT id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc, translate(seq, 'ACGT', 'UGCA') AS crna, replace(seq, 'T', 'U') AS rna FROM s")
def revcomp(spark, d):
    s = order_sequences(spark, d)
    return s.select("id", S.reverse_complement(F.col("seq")).alias("rc"), S.complement_rna(F.col("seq")).alias("crna"), S.transcribe(F.col("seq")).alias("rna"))


_CODONS = ", ".join(f"'{k}': '{v}'" for k, v in S.codon_table().items())


@query(f"WITH {SEQ}, m AS (SELECT MAP {{{_CODONS}}} AS t) SELECT id, coalesce(array_to_string(list_transform(range(0, length(seq) // 3), lambda i: t[substring(seq, CAST(3 * i + 1 AS BIGINT), 3)]), ''), '') AS aa FROM s, m")
def translate_dna(spark, d):
    return order_sequences(spark, d).select("id", S.translate(F.col("seq")).alias("aa"))


@query(f"WITH {SEQ} SELECT id, round((length(seq) - length(replace(seq, 'C', ''))) / length(seq), 6) AS gc, round(-(length(seq) - length(replace(seq, 'C', ''))) / greatest(length(seq) - length(replace(seq, 'C', '')), 1), 6) AS skew FROM s")
def gc_fraction(spark, d):
    return order_sequences(spark, d).select("id", F.round(S.gc_fraction(F.col("seq")), 6).alias("gc"), F.round(S.gc_skew(F.col("seq")), 6).alias("skew"))


@query(f"WITH {SEQ} SELECT id, CAST(instr(seq, 'CT') - 1 AS BIGINT) AS first, CAST((length(seq) - length(replace(seq, 'CC', ''))) // 2 AS BIGINT) AS n_cc, CAST((SELECT count(*) FROM range(1, length(seq)) r(i) WHERE substring(seq, i, 2) = 'CC') AS BIGINT) AS n_over, starts_with(seq, 'C') AS head, ends_with(seq, 'T') AS tail FROM s")
def sequence_find(spark, d):
    q = F.col("seq")
    return order_sequences(spark, d).select("id", S.find(q, "CT").alias("first"), S.count_sub(q, "CC").alias("n_cc"), S.count_overlapping(q, "CC").alias("n_over"), q.startswith("C").alias("head"), q.endswith("T").alias("tail"))


@query(f"WITH {SEQ} SELECT id, CAST(4 * (length(seq) - length(replace(seq, 'C', ''))) + 2 * length(replace(seq, 'C', '')) AS DOUBLE) AS wallace, round(81.5 + 0.41 * (100.0 * (length(seq) - length(replace(seq, 'C', ''))) / length(seq)) - 500.0 / length(seq), 6) AS tm FROM s")
def melting_temperature(spark, d):
    return order_sequences(spark, d).select("id", S.melting_wallace(F.col("seq")).alias("wallace"), F.round(S.melting_gc(F.col("seq")), 6).alias("tm"))


_N = lambda c: f"(length(aa) - length(replace(aa, '{c}', '')))"
_MASS = " + ".join(f"{_N(c)} * {round(v * 10000)}" for c, v in S.PROTEIN_MASS.items())
_HYDRO = " + ".join(f"{_N(c)} * ({round(v * 10000)})" for c, v in S.HYDROPATHY.items())


@query(f"WITH {AA} SELECT id, (CASE WHEN length(aa) > 0 THEN ({_MASS} - (length(aa) - 1) * {round(S.WATER * 10000)}) / 10000.0::DOUBLE END) AS mass, (CASE WHEN length(aa) > 0 THEN ({_HYDRO}) / 10000.0::DOUBLE / length(aa) END) AS gravy FROM p")
def molecular_weight(spark, d):
    return proteins(spark, d).select("id", S.molecular_weight(F.col("aa")).alias("mass"), S.gravy(F.col("aa")).alias("gravy"))


def _charge_sql(ph: str) -> str:
    pos = lambda pk: f"1 / (1 + pow(10, {ph} - {pk}))"
    neg = lambda pk: f"1 / (1 + pow(10, {pk} - {ph}))"
    case = lambda t, x, e: f"(CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in t.items()) + f" ELSE {e} END)"
    terms = [pos(case(S.N_TERM_OF, "left(aa, 1)", S.N_TERM)), "-" + neg(case(S.C_TERM_OF, "right(aa, 1)", S.C_TERM))]
    terms += [f"{_N(c)} * {pos(v)}" for c, v in S.POSITIVE_PK.items()] + [f"-{_N(c)} * {neg(v)}" for c, v in S.NEGATIVE_PK.items()]
    return " + ".join(terms)


@query(f"WITH {AA} SELECT id, round(CASE WHEN length(aa) > 0 THEN {_charge_sql('7.0')} END, 6) AS charge, CAST({_N('Y')} * 1490 + {_N('W')} * 5500 AS BIGINT) AS reduced FROM p")
def net_charge(spark, d):
    return proteins(spark, d).select("id", F.round(S.charge(F.col("aa")), 6).alias("charge"), S.extinction(F.col("aa"))["reduced"].alias("reduced"))


@query(f"WITH RECURSIVE {AA}, r AS (SELECT id, aa, CAST(4.05 AS DOUBLE) AS lo, CAST(12 AS DOUBLE) AS hi, 0 AS k FROM p UNION ALL SELECT id, aa, CASE WHEN c > 0 THEN mid ELSE lo END, CASE WHEN c > 0 THEN hi ELSE mid END, k + 1 FROM (SELECT *, {_charge_sql('mid')} AS c FROM (SELECT *, (lo + hi) / 2 AS mid FROM r WHERE k < 18))) SELECT id, round(CASE WHEN length(aa) > 0 THEN (lo + hi) / 2 END, 3) AS pi FROM r WHERE k = 18")
def isoelectric_point(spark, d):
    return proteins(spark, d).select("id", F.round(S.isoelectric_point(F.col("aa")), 3).alias("pi"))


@query(f"WITH {AA} SELECT id, round(CASE WHEN length(aa) > 0 THEN ({_N('Y')} + {_N('W')} + {_N('F')}) / length(aa) END, 6) AS aromatic, round(CASE WHEN length(aa) > 0 THEN ({'+'.join(map(_N, 'EMALK'))}) / length(aa) END, 6) AS helix FROM p")
def protein_fractions(spark, d):
    return proteins(spark, d).select("id", F.round(S.aromaticity(F.col("aa")), 6).alias("aromatic"), F.round(S.secondary_structure(F.col("aa"))["helix"], 6).alias("helix"))


@query(f"WITH {AA} SELECT id, CAST(len(regexp_extract_all(aa, '{S.prosite_regex('[ST]-x-[RK]')}')) AS BIGINT) AS pkc, CAST(len(regexp_extract_all(aa, '{S.prosite_regex('N-{P}-[ST]-{P}')}')) AS BIGINT) AS asn FROM p")
def motif_count(spark, d):
    return proteins(spark, d).select("id", S.motif_count(F.col("aa"), "[ST]-x-[RK]").alias("pkc"), S.motif_count(F.col("aa"), "N-{P}-[ST]-{P}").alias("asn"))


_RUNS = "(" + " + ".join(f"len(regexp_extract_all(aa, '{c}{{2,}}'))" for c in "ACDEFGHIKLMNPQRSTVWY") + ")"


@query(f"WITH {AA} SELECT id, CAST({_RUNS} AS BIGINT) AS runs, left(aa, 1) AS first FROM p")
def repeat_count(spark, d):
    return proteins(spark, d).select("id", S.repeat_runs(F.col("aa"), 2).alias("runs"), F.left("aa", F.lit(1)).alias("first"))


@query(f"WITH {SEQ}, c AS (SELECT id, length(seq) AS n, (length(seq) - length(replace(seq, 'A', ''))) / length(seq) AS a, (length(seq) - length(replace(seq, 'C', ''))) / length(seq) AS c, (length(seq) - length(replace(seq, 'T', ''))) / length(seq) AS t FROM s) SELECT id, round(-(CASE WHEN a > 0 THEN a * ln(a) / ln(4) ELSE 0 END + CASE WHEN c > 0 THEN c * ln(c) / ln(4) ELSE 0 END + CASE WHEN t > 0 THEN t * ln(t) / ln(4) ELSE 0 END), 6) AS lcc FROM c")
def sequence_complexity(spark, d):
    return order_sequences(spark, d).select("id", F.round(S.complexity(F.col("seq")) + 0.0, 6).alias("lcc"))


@query(f"WITH {AA} SELECT id, rtrim(to_base64(unhex(sha1(aa))), '=') AS seguid, CAST(coalesce(list_sum(list_transform(range(0, length(aa)), lambda i: (i % 57 + 1) * ascii(substring(aa, CAST(i + 1 AS BIGINT), 1)))), 0) % 10000 AS BIGINT) AS gcg FROM p")
def sequence_checksums(spark, d):
    return proteins(spark, d).select("id", S.seguid(F.col("aa")).alias("seguid"), S.gcg_checksum(F.col("aa")).alias("gcg"))


_THREE = ", ".join(f"'{k}': '{v}'" for k, v in S.THREE.items())


@query(f"WITH {AA} SELECT id, CASE WHEN aa = '' THEN '' ELSE array_to_string(list_transform(string_split(aa, ''), lambda c: MAP {{{_THREE}}}[c]), '') END AS aa3, aa AS back FROM p")
def three_letter(spark, d):
    got = proteins(spark, d).select("id", S.seq3(F.col("aa")).alias("aa3"))
    return got.select("id", "aa3", S.seq1(F.col("aa3")).alias("back"))


@query("WITH p AS (SELECT p_partkey AS id, upper(regexp_replace(p_name || p_type, '[^0-9A-Za-z]', '', 'g')) AS s FROM part), k AS (SELECT DISTINCT id, substring(s, CAST(i AS BIGINT), 3) AS f FROM (SELECT id, s, unnest(range(1, length(s) - 1)) AS i FROM p)) SELECT f AS feature, CAST(count(*) AS BIGINT) AS n FROM k WHERE regexp_full_match(f, '[ACDEFGHIKLMNPQRSTVWY]+') GROUP BY 1")
def kmer_protein(spark, d):
    p = T.read(spark, d, "part").select("p_partkey", F.concat("p_name", "p_type").alias("s"))
    return similarity.kmers(p, "p_partkey", "s", 3).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SEQ}, k AS (SELECT DISTINCT id, substring(seq, CAST(i AS BIGINT), 3) AS f FROM (SELECT id, seq, unnest(range(1, length(seq) - 1)) AS i FROM s)) SELECT DISTINCT id AS record, least(f, reverse(translate(f, 'ACGT', 'TGCA'))) AS feature FROM k")
def kmer_dna(spark, d):
    return similarity.kmers(order_sequences(spark, d), "id", "seq", 3, "dna")


def _motif_sql(name: str, pattern: str) -> str:
    """Matches by their places: what lies between two matches, and the matches, by running length."""
    return f"""SELECT id, '{name}' AS motif, list_transform(regexp_extract_all(aa, '(?s)(.*?)({S.prosite_regex(pattern)})', 1), lambda x: length(x)) AS gaps,
list_transform(regexp_extract_all(aa, '(?s)(.*?)({S.prosite_regex(pattern)})', 2), lambda x: length(x)) AS sizes FROM p"""


_MOTIFS = f"""WITH {AA}, m AS ({_motif_sql('PKC', '[ST]-x-[RK]')} UNION ALL {_motif_sql('ASN', 'N-{P}-[ST]-{P}')}),
u AS (SELECT id, motif, unnest(gaps) AS gap, unnest(sizes) AS size, generate_subscripts(gaps, 1) AS k FROM m WHERE len(gaps) > 0),
r AS (SELECT *, sum(gap + size) OVER (PARTITION BY id, motif ORDER BY k) AS upto FROM u)
SELECT id AS record, motif, CAST(upto - size AS INT) AS start, CAST(upto AS INT) AS "end", 100.0::DOUBLE AS score FROM r"""


@query(_MOTIFS)
def motif_search(spark, d):
    return search.motifs(proteins(spark, d), "id", "aa", {"PKC": "[ST]-x-[RK]", "ASN": "N-{P}-[ST]-{P}"})


@query()
def local_alignment(spark, d):
    """Each part's name against the names of regions: the reference set is small and fixed."""
    items = T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("seq"))
    refs = T.read(spark, d, "region").select(F.col("r_name").alias("ref"), F.upper("r_name").alias("ref_seq"))
    return search.smith_waterman(items, refs.collect(), "id", "seq")


_COUNT = lambda s, c: f"(length({s}) - length(replace({s}, '{c}', '')))"


def _tm_sql(table: str, high: float, low: float, na: float) -> str:
    """The nearest-neighbour temperature of ``seq`` (letters A, C, T) in SQL, with the salt term on the entropy."""
    values, swap = C.NEIGHBOURS[table], str.maketrans("ACGT", "TGCA")
    by_pair = {p: v for stack, v in zip(C.STACKS, values["stacks"], strict=True) for p in (stack, stack.translate(swap)[::-1])}
    sums = []
    for k in (0, 1):
        pairs = ", ".join(f"'{p}': {v[k]}" for p, v in by_pair.items())
        ends = lambda e: f"CASE WHEN {e} IN ('A', 'T') THEN {values.get('end AT', (0, 0))[k]} ELSE {values.get('end GC', (0, 0))[k]} END"  # noqa: B023, E731
        stacked = f"coalesce(list_sum(list_transform(range(1, length(seq)), lambda i: MAP {{{pairs}}}[substring(seq, CAST(i AS BIGINT), 2)])), 0)"
        sums.append(f"({stacked} + {values.get('start', (0, 0))[k]} + {ends('left(seq, 1)')} + {ends('right(seq, 1)')})")
    return f"CASE WHEN length(seq) > 1 THEN 10.0::DOUBLE * {sums[0]} / ({sums[1]} / 100.0::DOUBLE + 0.368::DOUBLE * (length(seq) - 1) * ln({na / 1000}::DOUBLE) + {C.GAS}::DOUBLE * ln({(high - low / 2) * 1e-9}::DOUBLE)) - 273.15::DOUBLE END"


@query(f"WITH {SEQ} SELECT id, round({_tm_sql('DNA 1997', 25.0, 25.0, 50.0)}, 4) AS tm97, round({_tm_sql('RNA 1998', 50.0, 0.0, 100.0)}, 4) AS tm98 FROM s")
def melting_nearest_neighbour(spark, d):
    q = F.col("seq")
    return order_sequences(spark, d).select("id", F.round(C.melting_neighbours(q), 4).alias("tm97"), F.round(C.melting_neighbours(q, "RNA 1998", 50.0, 0.0, na=100.0), 4).alias("tm98"))


_GC = f"(100.0::DOUBLE * {_COUNT('seq', 'C')} / length(seq))"


@query(f"WITH {SEQ} SELECT id, round(81.5::DOUBLE + 0.41::DOUBLE * {_GC} - 600.0::DOUBLE / length(seq) + 16.6::DOUBLE * log10(0.05::DOUBLE), 6) AS product, round(78.0::DOUBLE + 0.7::DOUBLE * {_GC} - 500.0::DOUBLE / length(seq) + 16.6::DOUBLE * log10(0.05::DOUBLE / 1.035::DOUBLE) - 2.25::DOUBLE - 3.25::DOUBLE, 6) AS solvent FROM s")
def melting_salt_solvent(spark, d):
    q = F.col("seq")
    return order_sequences(spark, d).select("id", F.round(C.melting_empirical(q), 6).alias("product"), F.round(C.solvent_correction(C.melting_empirical(q, 5), dmso=3, formamide=5), 6).alias("solvent"))


_PLACE = lambda k: f"coalesce(array_to_string(list_transform(range({k}, length(seq) + 1, 3), lambda i: substring(seq, CAST(i AS BIGINT), 1)), ''), '')"
_SHARE = lambda x: f"round(CASE WHEN length({x}) > 0 THEN 100.0::DOUBLE * {_COUNT(x, 'C')} / length({x}) ELSE 0 END, 6)"


@query(f"WITH {SEQ}, q AS (SELECT id, seq, {_PLACE(1)} AS a, {_PLACE(2)} AS b, {_PLACE(3)} AS c FROM s) SELECT id, {_SHARE('seq')} AS gc, {_SHARE('a')} AS gc1, {_SHARE('b')} AS gc2, {_SHARE('c')} AS gc3 FROM q")
def gc_positions(spark, d):
    got = order_sequences(spark, d).select("id", C.gc_by_position(F.col("seq")).alias("g"))
    return got.select("id", *[F.round(f"g.{field}", 6).alias(name) for name, field in (("gc", "all"), ("gc1", "first"), ("gc2", "second"), ("gc3", "third"))])


@query(f"WITH {SEQ}, u AS (SELECT substring(seq, CAST(i AS BIGINT), 3) AS codon FROM (SELECT seq, unnest(range(1, length(seq) + 1, 3)) AS i FROM s)) SELECT codon, CAST(count(*) AS BIGINT) AS n FROM u WHERE length(codon) = 3 GROUP BY 1")
def codon_usage(spark, d):
    return C.codon_adaptiveness(order_sequences(spark, d), "seq").where("n > 0").select("codon", "n")


@query(f"""WITH {SEQ}, m AS (SELECT unnest(map_entries(MAP {{{_CODONS}}}), recursive := true)), w AS (SELECT id, substring(seq, CAST(3 * k + 1 AS BIGINT), 3) AS codon FROM (SELECT id, seq, unnest(range(0, length(seq) // 3)) AS k FROM s)),
n AS (SELECT codon, count(*) AS n FROM w GROUP BY 1), f AS (SELECT key AS codon, coalesce(n, 0.5) / max(coalesce(n, 0.5)) OVER (PARTITION BY value) AS weight FROM m LEFT JOIN n ON codon = key),
g AS (SELECT id, exp(avg(ln(weight))) AS cai FROM w JOIN f USING (codon) WHERE codon NOT IN ('ATG', 'TGG') GROUP BY id) SELECT s.id, round(cai, 6) AS cai FROM s LEFT JOIN g USING (id)""")
def codon_adaptation(spark, d):
    """Whole codons of each sequence against the usage of all of them: 64 weights are collected."""
    rows = order_sequences(spark, d).withColumn("cds", F.left("seq", F.floor(F.char_length("seq") / 3).cast("int") * 3))
    weights = {r.codon: r.weight for r in C.codon_adaptiveness(rows, "cds").collect()}
    return rows.select("id", F.round(C.adaptation_index(F.col("cds"), weights), 6).alias("cai"))


@query(f"WITH {SEQ} SELECT id, CAST(len(list_filter(range(0, length(seq) - 1), lambda i: substring(seq, CAST(i + 1 AS BIGINT), 2) IN ('CA', 'CT'))) AS BIGINT) AS n, CAST(coalesce(list_sum(list_filter(range(0, length(seq) - 1), lambda i: substring(seq, CAST(i + 1 AS BIGINT), 2) IN ('CA', 'CT'))), 0) AS BIGINT) AS total FROM s")
def subsequence_places(spark, d):
    places = order_sequences(spark, d).select("id", C.find_all(F.col("seq"), "CW").alias("at"))
    return places.select("id", F.size("at").cast("long").alias("n"), F.aggregate("at", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def _frame_sql(seq: str, k: int) -> str:
    return f"coalesce(array_to_string(list_transform(range(0, (length({seq}) - {k}) // 3), lambda i: t[substring({seq}, CAST(3 * i + {k + 1} AS BIGINT), 3)]), ''), '')"


_FRAMES = ", ".join(f"{_frame_sql(x, k)} AS {name}{k + 1}" for name, x in (("f", "seq"), ("r", "back")) for k in range(3))


@query(f"WITH {SEQ}, m AS (SELECT MAP {{{_CODONS}}} AS t), b AS (SELECT id, seq, reverse(translate(seq, 'ACGT', 'TGCA')) AS back, t FROM s, m) SELECT id, {_FRAMES} FROM b")
def six_frames(spark, d):
    return order_sequences(spark, d).select("id", C.six_frames(F.col("seq")).alias("f")).select("id", "f.*")


def _list_sql(table: dict) -> str:
    return "list_transform(string_split(aa, ''), lambda c: MAP {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in table.items()) + "}[c])"


def _window_sql(values: str, last: str, weights, middle: int, divisor: float) -> str:
    """The windows of nine of a list of values: pairs from the ends inwards and one in the middle."""
    pairs = " + ".join(f"({values}[i + {j + 1}] + {values}[i + {9 - j}]) * {w}::DOUBLE" for j, w in enumerate(weights))
    return f"list_transform(range(0, greatest({last}, 0)), lambda i: ({values}[i + {middle + 1}] + {pairs}) / {divisor}::DOUBLE)"


_HYDRO_WEIGHTS = [0.4 + 0.15 * j for j in range(4)]
_PROFILES = f"""WITH {AA}, v AS (SELECT id, length(aa) AS n, {_list_sql(C.FLEXIBILITY)} AS fv, {_list_sql(S.HYDROPATHY)} AS hv FROM p),
w AS (SELECT id, {_window_sql('fv', 'n - 9', C.FLEXIBILITY_WEIGHTS, 5, 5.25)} AS f, {_window_sql('hv', 'n - 8', _HYDRO_WEIGHTS, 4, 2 * sum(_HYDRO_WEIGHTS) + 1)} AS h FROM v)
SELECT id, CAST(len(f) AS INT) AS n_flex, round(list_max(f), 6) AS flex, CAST(len(h) AS INT) AS n_hydro, round(list_max(h), 6) AS hydro FROM w"""


@query(_PROFILES)
def protein_profiles(spark, d):
    """Flexibility and hydropathy in windows of nine: how many, and the highest."""
    aa = F.col("aa")
    got = proteins(spark, d).select("id", C.flexibility(aa).alias("flex"), C.residue_scale(aa, S.HYDROPATHY, 9, 0.4).alias("hydro"))
    return got.select("id", F.size("flex").alias("n_flex"), F.round(F.array_max("flex"), 6).alias("flex"), F.size("hydro").alias("n_hydro"), F.round(F.array_max("hydro"), 6).alias("hydro"))


@query()
def sequence_crc(spark, d):
    return order_sequences(spark, d).select("id", F.crc32(F.col("seq").cast("binary")).alias("crc32"), C.crc64(F.col("seq")).alias("crc64"))


@query(f"WITH {SEQ} SELECT id, starts_with(seq, 'AC') OR starts_with(seq, 'C') AS head, ends_with(seq, 'T') AS tail, string_split(seq, 'C') AS pieces, trim(seq, 'A') AS stripped, rtrim(seq, 'AC') AS right_stripped, lower(seq) AS small, replace(seq, 'CC', 'g') AS swapped, array_to_string(string_split(seq, 'C'), '-') AS joined FROM s")
def sequence_text(spark, d):
    """The text methods of sequences."""
    q = F.col("seq")
    got = order_sequences(spark, d)
    return got.select("id", S.starts_with(q, "AC", "C").alias("head"), S.ends_with(q, "T").alias("tail"), S.split(q, "C").alias("pieces"), S.strip(q, "A").alias("stripped"), S.strip(q, "AC", "right").alias("right_stripped"), S.lower(q).alias("small"), S.replace(q, "CC", "g").alias("swapped"), S.join(S.split(q, "C"), "-").alias("joined"))
