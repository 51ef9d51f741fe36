"""Records with nested features: slices with re-based features, coding regions, extraction.

A record is a row with ``record_id``, ``topology``, ``length``, ``seq`` and ``features``, an
array of (type, operator, parts, qualifiers) as the readers return it; parts are 0-based and
half open, in reading order.  Everything works inside a row, on arrays: nothing is shuffled.

Defined cases: null features count as none; a feature without the qualifier that is asked
for has none of it; a location outside of the record is clipped; empty slices keep the record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.sequences import reverse_complement, translate
from helixframe.runtime import barrier

#: The feature types that carry domains and search hits, unless a caller names those of its files.
DOMAIN, BEST_HIT = "domain", "best_hit"
#: Qualifiers that name a coding region, the first that it has.
NAMES = ("gene_id", "locus_tag", "gene", "protein_id")
PEPTIDE_NAMES = ("protein_id", "gene_id", "locus_tag", "gene")
LOCATION = "array<struct<start:int,end:int,strand:int>>"


def qualifier(f: Column, name: str) -> Column:
    """The first value of a feature's qualifier, or null."""
    return F.get(F.try_element_at(f["qualifiers"], F.lit(name)), F.lit(0))


def has(f: Column, name: str) -> Column:
    return F.coalesce(F.map_contains_key(f["qualifiers"], name), F.lit(False))


def pseudo(f: Column) -> Column:
    return has(f, "pseudo") | has(f, "pseudogene")


def place_name(f: Column) -> Column:
    """``first_strand_last`` of each part, 1-based in reading direction, joined by blanks."""

    def one(p: Column) -> Column:
        minus = p["strand"] < 0
        ends = [F.when(minus, p["end"]).otherwise(p["start"] + 1), p["strand"], F.when(minus, p["start"] + 1).otherwise(p["end"])]
        return F.concat_ws("_", *[x.cast("string") for x in ends])

    return F.array_join(F.transform(f["parts"], one), " ")


def cds_number(f: Column) -> Column:
    """The feature's cds_id, or a name from its place."""
    return F.coalesce(qualifier(f, "cds_id"), place_name(f))


def cds_name(f: Column, precedence: Sequence[str] = NAMES) -> Column:
    return F.coalesce(*[qualifier(f, n) for n in precedence], cds_number(f))


def number(f: Column, name: str) -> Column:
    return qualifier(f, name).cast("double")


def size(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda acc, p: acc + p["end"] - p["start"])


# ---- locations of several parts


def spans_origin(parts: Column) -> Column:
    """Whether reading on along the strand leads past the record's end: a part begins before the one ahead of it ends."""
    after = F.zip_with(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda a, b: F.when(a["strand"] < 0, b["start"] >= a["end"]).otherwise(b["end"] <= a["start"]))
    return F.exists(after, lambda x: x)


def envelope(parts: Column, length: Column) -> Column:
    """The smallest location without gaps that holds the parts and what lies between them in reading direction.

    One part, or two, cut at the origin, if the way leads over it.
    """
    low, high = F.array_min(F.transform(parts, lambda p: p["start"])), F.array_max(F.transform(parts, lambda p: p["end"]))
    strand = F.get(parts, F.lit(0))["strand"]
    first, last = F.get(parts, F.lit(0)), F.get(parts, F.size(parts) - 1)
    part = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), strand.alias("strand"))
    # forwards the way starts with the first part and ends with the last; backwards the other way round
    begin, finish = F.when(strand < 0, last["start"]).otherwise(first["start"]), F.when(strand < 0, first["end"]).otherwise(last["end"])
    two = F.array(part(F.lit(0), finish), part(begin, length))
    return F.when(spans_origin(parts) & (finish < begin), two).otherwise(F.array(part(low, high)))


def parts_overlap(a: Column, b: Column) -> Column:
    """Positions that both locations cover, part by part (parts of one location do not overlap)."""
    each = lambda p: F.aggregate(b, F.lit(0), lambda acc, q: acc + F.greatest(F.lit(0), F.least(p["end"], q["end"]) - F.greatest(p["start"], q["start"])))
    return F.aggregate(F.transform(a, each), F.lit(0), lambda acc, n: acc + n)


def parts_contain(a: Column, b: Column) -> Column:
    return parts_overlap(a, b) == size(b)


def inverted(parts: Column, length: Column) -> Column:
    """What the parts leave of [0, length), in order; parts may overlap."""
    order = F.array_sort(F.transform(parts, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        gap = F.array(F.struct(acc["at"].alias("start"), p["start"].alias("end")))
        return F.struct(F.greatest(acc["at"], p["end"]).alias("at"), F.when(p["start"] > acc["at"], F.concat(acc["out"], gap)).otherwise(acc["out"]).alias("out"))

    def close(acc: Column) -> Column:
        return F.when(acc["at"] < length, F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), length.cast("int").alias("end"))))).otherwise(acc["out"])

    return F.aggregate(order, start, step, close)


# ---- slices


def overlay(features: Column, location: Column, truncate: bool) -> Column:
    """The features in the coordinates of ``location`` (start, end, strand, offset).

    Without ``truncate`` only features that lie in it as a whole are kept; ``source`` is always cut.
    """

    def onto(p: Column) -> Column:
        def one(x: Column) -> Column:
            a, b = F.greatest(p["start"], x["start"]), F.least(p["end"], x["end"])
            minus = x["strand"] < 0
            start, end = F.when(minus, x["end"] - b).otherwise(a - x["start"]) + x["offset"], F.when(minus, x["end"] - a).otherwise(b - x["start"]) + x["offset"]
            return F.struct(start.alias("start"), end.alias("end"), F.when(minus, -p["strand"]).otherwise(p["strand"]).alias("strand"), (p["before"] | (a > p["start"])).alias("before"), (p["after"] | (b < p["end"])).alias("after"))

        return F.filter(F.transform(location, one), lambda y: y["end"] > y["start"])

    def feature(f: Column) -> Column:
        return F.struct(f["type"].alias("type"), f["operator"].alias("operator"), F.flatten(F.transform(f["parts"], onto)).alias("parts"), f["qualifiers"].alias("qualifiers"), size(f["parts"]).alias("hx_size"))

    keep = lambda f: (F.size(f["parts"]) > 0) & (F.lit(truncate) | (f["type"] == "source") | (size(f["parts"]) == f["hx_size"]))
    return F.transform(F.filter(F.transform(features, feature), keep), lambda f: F.struct(f["type"].alias("type"), f["operator"].alias("operator"), f["parts"].alias("parts"), f["qualifiers"].alias("qualifiers")))


def sliced(records: DataFrame, location: Column, truncate: bool = True, protein: bool = False) -> DataFrame:
    """``records`` with seq, length and features of ``location``, an array of (start, end, strand) in reading order."""
    clip = lambda p: F.struct(F.greatest(F.lit(0), p["start"]).cast("int").alias("start"), F.least(F.char_length("seq"), p["end"]).cast("int").alias("end"), F.coalesce(p["strand"], F.lit(1)).alias("strand"))
    placed = barrier(records, {"hx_at": F.filter(F.transform(location, clip), lambda p: p["end"] > p["start"])})
    before = lambda i: F.aggregate(F.slice("hx_at", F.lit(1), i), F.lit(0), lambda acc, p: acc + p["end"] - p["start"])
    placed = barrier(placed, {"hx_in": F.transform("hx_at", lambda p, i: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["strand"].alias("strand"), before(i).alias("offset")))})

    def piece(p: Column) -> Column:
        s = F.substring("seq", p["start"] + 1, p["end"] - p["start"])
        return F.when(p["strand"] < 0, F.reverse(s) if protein else reverse_complement(s)).otherwise(s)

    seq = F.array_join(F.transform("hx_in", piece), "")
    out = placed.withColumns({"features": F.when(F.col("features").isNotNull(), overlay(F.col("features"), F.col("hx_in"), truncate)), "seq": seq})
    return out.withColumn("length", F.char_length("seq")).drop("hx_at", "hx_in")


def location(start, end, strand=1) -> Column:
    """A location of one part."""
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.array(F.struct(c(start).cast("int").alias("start"), c(end).cast("int").alias("end"), c(strand).cast("int").alias("strand")))


def padded(parts: Column, up: int, down: int, length: Column) -> Column:
    """The location of a linear record with its first part longer upstream and its last one downstream."""

    def one(p: Column, i: Column) -> Column:
        first, last = F.when(i == 0, F.lit(up)).otherwise(0), F.when(i == F.size(parts) - 1, F.lit(down)).otherwise(0)
        minus = p["strand"] < 0
        left, right = F.when(minus, last).otherwise(first), F.when(minus, first).otherwise(last)
        return F.struct(F.greatest(F.lit(0), p["start"] - left).cast("int").alias("start"), F.least(length, p["end"] + right).cast("int").alias("end"), p["strand"].alias("strand"))

    return F.transform(parts, one)


# ---- coding regions and extraction


def coding(records: DataFrame, evalue: float | None = None, score: float | None = None, skip_pseudo: bool = False, names: Sequence[str] = NAMES, kinds: tuple[str, str] = (DOMAIN, BEST_HIT)) -> DataFrame:
    """A row for each coding region: record_id, idx, num, name, cds, domains, domain_names, best_hit (features).

    Annotations below ``evalue`` and above ``score`` count; of regions with one number the first is kept.
    """
    every = records.select("record_id", "features", F.posexplode("features").alias("idx", "cds"))
    cds = every.where(F.col("cds.type") == "CDS")
    cds = cds.where(~pseudo(F.col("cds"))) if skip_pseudo else cds
    cds = barrier(cds, {"num": cds_number(F.col("cds")), "name": cds_name(F.col("cds"), names)})
    first = F.filter("features", lambda f: (f["type"] == "CDS") & (~pseudo(f) if skip_pseudo else F.lit(True)))
    at = F.array_position(F.transform(first, cds_number), F.col("num"))
    own = F.size(F.filter(F.transform("features", lambda f, i: F.struct(i.alias("i"), f["type"].alias("type"), (~pseudo(f) if skip_pseudo else F.lit(True)).alias("ok"))), lambda x: (x["i"] <= F.col("idx")) & (x["type"] == "CDS") & x["ok"]))
    cds = cds.where(at == own)

    def mine(kind: str):
        def ok(f: Column) -> Column:
            out = (f["type"] == kind) & (qualifier(f, "cds_id") == F.col("num"))
            out = out & (number(f, "evalue") < evalue) if evalue is not None else out
            return out & (number(f, "score") > score) if score is not None else out

        return F.filter("features", ok)

    found = barrier(cds, {"domains": mine(kinds[0]), "best_hit": F.element_at(F.concat(F.array(F.lit(None).cast(cds.schema["cds"].dataType)), mine(kinds[1])), -1)})
    return found.select("record_id", "idx", "num", "name", "cds", "domains", F.array_distinct(F.transform("domains", lambda f: qualifier(f, "name"))).alias("domain_names"), "best_hit")


def extract_domains(records: DataFrame, evalue: float | None = None, score: float | None = None, names: Sequence[str] | None = None, databases: Sequence[str] | None = None, up: int = 0, down: int = 0, splice: bool = False, keep_direction: bool = False, keep_name: bool = False, kind: str = DOMAIN) -> DataFrame:
    """The stretches of the records under their domains: a record for each, named by its place.

    ``splice`` joins a record's stretches, merged and in order, to one record.
    """

    def wanted(f: Column) -> Column:
        ok = f["type"] == kind
        ok = ok & qualifier(f, "name").isin(*names) if names is not None else ok
        ok = ok & qualifier(f, "database").isin(*databases) if databases is not None else ok
        ok = ok & (number(f, "evalue") <= evalue) if evalue is not None else ok
        return ok & (number(f, "score") >= score) if score is not None else ok

    def place(f: Column) -> Column:
        parts = padded(f["parts"], up, down, F.char_length("seq"))
        return F.transform(parts, lambda p: p.withField("strand", F.lit(1))) if keep_direction else parts

    rows = barrier(records, {"hx_places": F.transform(F.filter("features", wanted), place)}).where(F.size("hx_places") > 0)
    if splice:
        order = F.array_sort(F.flatten(F.col("hx_places")))
        empty = F.array().cast(LOCATION)

        def join(acc: Column, p: Column) -> Column:
            last = F.element_at(acc, -1)
            longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], p["end"]).alias("end"), last["strand"].alias("strand"))))
            return F.when((F.size(acc) > 0) & (p["start"] <= F.get(acc, F.size(acc) - 1)["end"]), longer).otherwise(F.concat(acc, F.array(p)))

        rows = barrier(rows, {"hx_place": F.aggregate(order, empty, join)})
    else:
        rows = rows.withColumn("hx_place", F.explode("hx_places"))
    before = F.char_length("seq")
    first, last = F.array_min(F.transform("hx_place", lambda p: p["start"])), F.array_max(F.transform("hx_place", lambda p: p["end"]))
    minus = F.get("hx_place", F.lit(0))["strand"] < 0
    label = F.concat(F.col("record_id"), F.lit("_"), F.when(minus, last).otherwise(first + 1).cast("string"), F.lit(":"), F.when(minus, first + 1).otherwise(last).cast("string"), F.when(minus, F.lit("rc")).otherwise(F.lit("")))
    named = rows if keep_name else rows.withColumn("record_id", F.when(size(F.col("hx_place")) < before, label).otherwise(F.col("record_id")))
    return sliced(named, F.col("hx_place"), truncate=True).drop("hx_places", "hx_place")


def extract_peptides(records: DataFrame, domains: Sequence[str] | None = None, cds: Sequence[str] | None = None, every: bool = False, search_hits: bool = False, unannotated: bool = False, strand: str | None = None, invert: bool = False, evalue: float | None = None, keep_name: bool = False, kinds: tuple[str, str] = (DOMAIN, BEST_HIT)) -> DataFrame:
    """(record_id, source_contig, seq): the peptide of each chosen coding region, its stored translation or a new one."""
    found = coding(records, evalue, skip_pseudo=True, names=PEPTIDE_NAMES, kinds=kinds)
    keep = F.lit(every)
    if domains is not None:
        keep = keep | F.arrays_overlap("domain_names", F.array(*map(F.lit, domains)))
    if cds is not None:
        keep = keep | F.col("name").isin(*cds)
    if search_hits:
        keep = keep | F.col("best_hit").isNotNull()
    if unannotated:
        keep = keep | (F.size("domain_names") == 0)
    if strand:
        minus = F.get("cds.parts", F.lit(0))["strand"] < 0
        keep = keep & (~minus if strand == "f" else minus)
    keep = F.coalesce(keep, F.lit(False))
    chosen = found.where(~keep if invert else keep).select("record_id", "name", "cds")
    whole = chosen.join(records.select("record_id", "seq"), "record_id").withColumn("features", F.array(F.col("cds")))
    dna = sliced(whole.withColumn("hx_cds", F.col("cds")), F.transform("cds.parts", lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["strand"].alias("strand"))))
    stored = qualifier(F.col("hx_cds"), "translation")
    seq = F.when(F.char_length(stored) > 0, stored).otherwise(translate(F.col("seq")))
    return dna.select((F.col("record_id") if keep_name else F.col("name")).alias("record_id"), F.col("record_id").alias("source_contig"), seq.alias("seq"))


def select_by_coord(records: DataFrame, places: DataFrame, truncate: bool = True) -> DataFrame:
    """The stretches of ``places`` (record_id, start, end, strand), as records with re-based features."""
    met = records.join(places.select("record_id", F.col("start").alias("hx_s"), F.col("end").alias("hx_e"), F.col("strand").alias("hx_d")), "record_id")
    return sliced(met, location(F.col("hx_s"), F.col("hx_e"), F.col("hx_d")), truncate).drop("hx_s", "hx_e", "hx_d")


def select_by_cds(records: DataFrame, names: Sequence[str], cds_up: int = 0, cds_down: int = 0, keep_direction: bool = False) -> DataFrame:
    """The neighbourhood of each named coding region: so many regions upstream and downstream of it, on its strand."""
    found = coding(records).select("record_id", "name", "idx", "cds")
    order = records.select("record_id", F.transform(F.array_sort(F.transform(F.filter("features", lambda f: f["type"] == "CDS"), lambda f: F.struct(F.array_min(F.transform(f["parts"], lambda p: p["start"])).alias("start"), F.array_max(F.transform(f["parts"], lambda p: p["end"])).alias("end")))), lambda x: x).alias("hx_all"))
    foci = found.where(F.col("name").isin(*names)).join(order, "record_id")
    low = F.array_min(F.transform("cds.parts", lambda p: p["start"]))
    high = F.array_max(F.transform("cds.parts", lambda p: p["end"]))
    minus = F.get("cds.parts", F.lit(0))["strand"] < 0
    at = F.array_position(F.col("hx_all"), F.struct(low.alias("start"), high.alias("end"))).cast("int")
    left, right = F.when(minus, F.lit(cds_down)).otherwise(cds_up), F.when(minus, F.lit(cds_up)).otherwise(cds_down)
    part = F.slice("hx_all", F.greatest(at - left, F.lit(1)), F.least(at + right, F.size("hx_all")) - F.greatest(at - left, F.lit(1)) + 1)
    foci = foci.select("record_id", "name", minus.alias("minus"), part.alias("part"))
    places = foci.select("record_id", "name", F.array_min(F.transform("part", lambda x: x["start"])).alias("start"), F.array_max(F.transform("part", lambda x: x["end"])).alias("end"), F.when(F.col("minus") & F.lit(not keep_direction), -1).otherwise(1).alias("strand"))
    out = records.join(places.select("record_id", F.col("name").alias("focus"), F.col("start").alias("hx_s"), F.col("end").alias("hx_e"), F.col("strand").alias("hx_d")), "record_id")
    return sliced(out, location(F.col("hx_s"), F.col("hx_e"), F.col("hx_d")), truncate=False).drop("hx_s", "hx_e", "hx_d")


# ---- cleaning, notes and alignment of records


def moved(f: Column, parts: Column) -> Column:
    """A feature with its qualifiers at another place; parts with more than one piece are joined."""
    return f.withField("parts", parts).withField("operator", F.when(F.size(parts) > 1, F.lit("join")).otherwise(F.lit("")))


def cleaned(records: DataFrame, best_hits: bool = False, annotations: bool = False, cds: bool = False, protein: bool = False, kinds: tuple[str, str] = (DOMAIN, BEST_HIT)) -> DataFrame:
    """Records without the features that are switched on, and with ``n_cds``.

    In nucleotide records every coding region that is not a pseudogene gets its number as ``cds_id``
    and, where it has no translation or an empty one, the translation of its place.
    """
    gone = [kind for kind, drop in ((kinds[0], annotations), (kinds[1], best_hits), ("CDS", cds)) if drop]
    kept = F.filter("features", lambda f: ~f["type"].isin(*gone)) if gone else F.col("features")
    if protein:
        return records.withColumns({"features": kept, "n_cds": F.lit(0)})
    real = lambda f: (f["type"] == "CDS") & ~pseudo(f)

    def peptide(f: Column) -> Column:
        def piece(p: Column) -> Column:
            dna = F.substring(F.col("seq"), p["start"] + 1, p["end"] - p["start"])
            return F.when(p["strand"] < 0, reverse_complement(dna)).otherwise(dna)

        return translate(F.array_join(F.transform(f["parts"], piece), ""))

    def filled(f: Column) -> Column:
        stored = qualifier(f, "translation")
        own = F.map_filter(f["qualifiers"], lambda k, _: ~k.isin("cds_id", "translation"))
        made = F.create_map(F.lit("cds_id"), F.array(cds_number(f)), F.lit("translation"), F.array(F.when(F.char_length(stored) > 0, stored).otherwise(peptide(f))))
        return F.when(real(f), f.withField("qualifiers", F.map_concat(own, made))).otherwise(f)

    rows = barrier(records, {"hx_kept": kept})
    return rows.withColumns({"n_cds": F.coalesce(F.size(F.filter("hx_kept", real)), F.lit(0)), "features": F.transform("hx_kept", filled)}).drop("hx_kept")


def notes(records: DataFrame, kind: str = DOMAIN) -> DataFrame:
    """(record_id, cds_id, database, notes): ``name (description, evalue, score)`` of each domain, in the order of the features.

    A domain without one of these qualifiers has an empty string in its place.
    """
    q = lambda name: F.coalesce(qualifier(F.col("f"), name), F.lit(""))
    rows = records.select("record_id", F.posexplode(F.filter("features", lambda f: f["type"] == kind)).alias("k", "f"))
    note = F.concat(q("name"), F.lit(" ("), F.concat_ws(", ", q("description"), q("evalue"), q("score")), F.lit(")"))
    rows = rows.select("record_id", q("cds_id").alias("cds_id"), q("database").alias("database"), F.struct("k", note.alias("note")).alias("x"))
    return rows.groupBy("record_id", "cds_id", "database").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["note"]).alias("notes"))


def source_taxons(features: Column) -> Column:
    """The taxon of each source feature, its first ``taxon:`` reference that ends in a number; sources without one are left out."""
    xrefs = lambda f: F.coalesce(F.try_element_at(f["qualifiers"], F.lit("db_xref")), F.array().cast("array<string>"))
    named = lambda f: F.get(F.filter(xrefs(f), lambda x: x.rlike(r"^taxon:(?:.*:)?\d+$")), F.lit(0))
    found = F.transform(F.filter(features, lambda f: f["type"] == "source"), named)
    return F.transform(F.filter(found, lambda x: x.isNotNull()), lambda x: F.regexp_extract(x, r"(\d+)$", 1).cast("long"))


def aligned(records: DataFrame, before: str, pad: str = "N") -> DataFrame:
    """Sequences padded on both sides, so that the place ``before`` letters from the start is one column and all are of one length."""
    n = F.char_length("seq")
    # one row
    tops = records.agg(F.max(before).alias("hx_left"), F.max(n - F.col(before)).alias("hx_right"))
    left, right = F.col("hx_left") - F.col(before), F.col("hx_right") - (n - F.col(before))
    fill = lambda k: F.repeat(F.lit(pad), k.cast("int"))
    return records.join(F.broadcast(tops), F.lit(True)).withColumn("seq", F.concat(fill(left), "seq", fill(right))).drop("hx_left", "hx_right")


# ---- report columns over nested features


def qualifier_list(features: Column, kind: str, name: str, sep: str = "; ") -> Column:
    """The first values of a qualifier of all features of a kind, in order of their first place."""
    at = lambda f: F.when(F.get(f["parts"], F.lit(0))["strand"] < 0, F.get(f["parts"], F.lit(0))["end"]).otherwise(F.get(f["parts"], F.lit(0))["start"])
    hits = F.filter(features, lambda f: (f["type"] == kind) & has(f, name) & ~(F.lit(kind == "CDS") & has(f, "pseudo") & has(f, "pseudogene")))
    return F.array_join(F.transform(F.array_sort(F.transform(hits, lambda f, i: F.struct(at(f).alias("at"), i.alias("i"), qualifier(f, name).alias("v")))), lambda x: x["v"]), sep)


def qualifier_count(features: Column, kind: str, name: str) -> Column:
    return F.size(F.filter(features, lambda f: (f["type"] == kind) & has(f, name)))


def identity_sum(features: Column, kind: str = DOMAIN) -> Column:
    """The domains' identities in sum; a domain without one counts 0."""
    domains = F.filter(features, lambda f: f["type"] == kind)
    return F.aggregate(F.transform(domains, lambda f: F.coalesce(number(f, "identity"), F.lit(0.0))), F.lit(0.0), lambda acc, x: acc + x)


def starts_with(seq: Column) -> Column:
    """The first letter, or nothing."""
    return F.left(F.coalesce(seq, F.lit("")), F.lit(1))
