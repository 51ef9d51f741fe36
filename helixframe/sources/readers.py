"""Readers: sequence records, profiles, matrices, taxonomies and lists as DataFrames.

Files are cut into records by Spark's own text source with the format's record separator,
so any file system that Spark reads will do, large files are split, and parsing runs where
the blocks are.  Compressed text (.gz) is read through Spark's codecs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = "array<struct<start:int,end:int,strand:int,before:boolean,after:boolean>>"
FEATURES = f"array<struct<type:string,operator:string,parts:{PARTS},qualifiers:map<string,array<string>>>>"
RECORDS = f"record_id string, name string, description string, molecule_type string, topology string, length int, taxid int, seq string, features {FEATURES}"
KINDS = {"gb": "genbank", "gbk": "genbank", "gbff": "genbank", "genbank": "genbank", "fa": "fasta", "faa": "fasta", "fna": "fasta", "fasta": "fasta", "hmm": "hmm", "cm": "cm", "tsv": "matrix", "dat": "swissprot"}


def file_kind(path: str) -> str | None:
    """The format that a file's name says, compression aside."""
    name = re.sub(r"\.(gz|bgz|bgzf|bz2|zst)$", "", path.lower())
    return KINDS.get(name.rpartition(".")[2])


def _blocks(spark: SparkSession, path, separator: str) -> DataFrame:
    text = spark.read.option("lineSep", separator).text(path)
    return text.select(F.col("value"), F.col("_metadata.file_path").alias("file")).where(F.length(F.trim("value")) > 0)


def fasta(spark: SparkSession, path) -> DataFrame:
    """(record_id, description, length, seq, file) of FASTA files."""
    raw = _blocks(spark, path, "\n>")
    v = F.regexp_replace(F.regexp_replace("value", r"\r", ""), "^>", "")
    head, body = F.substring_index(v, "\n", 1), F.regexp_replace(v, r"^[^\n]*\n?", "")
    seq = F.regexp_replace(body, r"[\s>]", "")
    rows = raw.select(F.regexp_extract(head, r"^(\S*)", 1).alias("record_id"), F.trim(F.regexp_extract(head, r"^\S*\s*(.*)$", 1)).alias("description"), seq.alias("seq"), "file")
    return rows.select("record_id", "description", F.length("seq").alias("length"), "seq", "file")


def parse_location(text: str) -> tuple[str, list[dict]]:
    """Operator and parts (0-based, half open) of a feature location, in reading order."""
    text = re.sub(r"\s", "", text)
    if m := re.fullmatch(r"complement\((.*)\)", text):
        op, parts = parse_location(m[1])
        return op, [p | {"strand": -p["strand"]} for p in reversed(parts)]
    if m := re.fullmatch(r"(join|order|bond)\((.*)\)", text):
        items, depth, at = [], 0, 0
        for k, ch in enumerate(m[2] + ","):
            depth += (ch == "(") - (ch == ")")
            if ch == "," and not depth:
                items.append(m[2][at:k])
                at = k + 1
        return m[1], [p for i in items for p in parse_location(i)[1]]
    text = text.rpartition(":")[2]
    if m := re.fullmatch(r"(\d+)\^(\d+)", text):
        return "", [{"start": int(m[1]), "end": int(m[1]), "strand": 1, "before": False, "after": False}]
    m = re.fullmatch(r"(<?)\(?(\d+)(?:\.\d+\))?(?:\.\.(>?)\(?(?:\d+\.)?(\d+)\)?)?", text)
    if not m:
        raise ValueError(f"not a location: {text!r}")
    return "", [{"start": int(m[2]) - 1, "end": int(m[4] or m[2]), "strand": 1, "before": bool(m[1]), "after": bool(m[3])}]


def parse_genbank(block: str) -> dict | None:
    """One flat-file record."""
    lines = block.split("\n")
    head = next((x for x in lines if x.startswith("LOCUS")), None)
    if head is None:
        return None
    words = head.split()
    out = {"record_id": words[1], "name": words[1], "description": "", "topology": "circular" if "circular" in words else "linear", "molecule_type": "protein" if "aa" in words else next((w for w in words[4:] if re.search("NA", w)), "DNA"), "features": [], "taxid": None}
    section, feature, key, seq, about = "", None, "", [], []
    for line in lines:
        if line and not line[0].isspace():
            section = line.split()[0]
            if section == "DEFINITION":
                about = [line[12:].strip()]
            elif section in ("ACCESSION", "VERSION") and len(line.split()) > 1 and section == "VERSION":
                out["record_id"] = line.split()[1]
        elif section == "DEFINITION":
            about.append(line.strip())
        elif section == "FEATURES":
            if line[5:6].strip():
                feature = {"type": line[5:21].strip(), "place": line[21:].strip(), "qualifiers": {}}
                out["features"].append(feature)
                key = ""
            elif feature is not None:
                part = line[21:].rstrip()
                if m := re.match(r"/([^=\s]+)(?:=(.*))?$", part):
                    key = m[1]
                    feature["qualifiers"].setdefault(key, []).append(m[2] if m[2] is not None else "")
                elif key:
                    values = feature["qualifiers"][key]
                    values[-1] += ("" if key == "translation" else " ") + part
                else:
                    feature["place"] += part
        elif section == "ORIGIN":
            seq.append(re.sub(r"[\s\d]", "", line))
    out["description"] = " ".join(about).rstrip(".")
    out["seq"] = "".join(seq).upper()
    out["length"] = len(out["seq"]) or int(words[2])
    features, out["problems"], out["features"] = out["features"], [], []
    for f in features:
        place = f.pop("place")
        try:
            f["operator"], f["parts"] = parse_location(place)
        except ValueError:
            out["problems"].append((f["type"], place))
            continue
        out["features"].append(f)
        f["qualifiers"] = {k: [v.strip().strip('"') for v in vs] for k, vs in f["qualifiers"].items()}
        for x in f["qualifiers"].get("db_xref", []):
            if f["type"] == "source" and x.startswith("taxon:") and out["taxid"] is None:
                out["taxid"] = int(x[6:])
    return out


def genbank_problems(spark: SparkSession, path) -> DataFrame:
    """(record_id, type, place): the features that ``genbank`` leaves out because their location cannot be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["record_id"], *x) for r in (parse_genbank((v or "").replace("\r", "")) for v in batch.column(0).to_pylist()) if r for x in r["problems"]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else [[]] * 3)], names=["record_id", "type", "place"])

    return _blocks(spark, path, "\n//").select("value").mapInArrow(run, "record_id string, type string, place string")


def fasta_two_line(spark: SparkSession, path) -> DataFrame:
    """Like ``fasta`` for files in which each record is a title line and one line of sequence; others are an error."""
    raw = _blocks(spark, path, "\n>")
    lines = F.split(F.rtrim(F.regexp_replace(F.regexp_replace("value", r"\r", ""), "^>", ""), F.lit("\n")), "\n")
    bad = F.size(lines) != 2
    checked = raw.select(F.when(bad, F.raise_error(F.concat(F.lit("not two lines: "), F.substring("value", 1, 60)))).otherwise(lines).alias("x"), "file")
    head, seq = F.col("x")[0], F.col("x")[1]
    rows = checked.select(F.regexp_extract(head, r"^(\S*)", 1).alias("record_id"), F.trim(F.regexp_extract(head, r"^\S*\s*(.*)$", 1)).alias("description"), seq.alias("seq"), "file")
    return rows.select("record_id", "description", F.length("seq").alias("length"), "seq", "file")


def tab(spark: SparkSession, path) -> DataFrame:
    """(record_id, description, length, seq, file) of lines ``title<tab>sequence``; blank lines are passed over."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    x = F.split("value", "\t")
    checked = raw.select(F.when(F.size(x) != 2, F.raise_error(F.concat(F.lit("not a title and a sequence: "), F.substring("value", 1, 60)))).otherwise(x).alias("x"), "file")
    title, seq = F.trim(F.col("x")[0]), F.trim(F.col("x")[1])
    return checked.select(title.alias("record_id"), F.lit("").alias("description"), F.length(seq).alias("length"), seq.alias("seq"), "file")


SWISS = "record_id string, name string, accessions array<string>, description string, gene_name string, organism string, lineage array<string>, taxid int, keywords array<string>, dbxrefs array<string>, comments string, created string, existence string, length int, seq string"


def swissprot(spark: SparkSession, path) -> DataFrame:
    """Protein entries of Swiss-Prot flat files, native: the lines of each code are joined; see SWISS."""
    raw = _blocks(spark, path, "\n//").where(F.col("value").rlike(r"(?m)^ID\s"))
    lines = F.split(F.regexp_replace("value", r"\r", ""), "\n")
    of = lambda code: F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(code + "   "))), lambda x: F.trim(F.substring(x, F.lit(6), F.char_length(x))))
    text = lambda code: F.array_join(of(code), " ")
    parted = lambda c: F.filter(F.transform(F.split(F.regexp_replace(c, r"\.\s*$", ""), ";"), lambda x: F.trim(x)), lambda x: x != "")
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    seq = F.regexp_replace(F.regexp_extract(F.concat(F.regexp_replace("value", r"\r", ""), F.lit("\n")), r"(?s)\nSQ   [^\n]*\n(.*)$", 1), r"\s", "")
    refs = F.transform(of("DR"), lambda x: F.array_join(F.transform(F.slice(F.split(x, ";"), 1, 2), lambda y: F.trim(F.regexp_replace(y, r"\.\s*$", ""))), ":"))
    comments = F.array_join(F.transform(of("CC"), lambda x: x), "\n")
    return raw.select(
        F.get(parted(text("AC")), F.lit(0)).alias("record_id"),
        F.regexp_extract(text("ID"), r"^(\S+)", 1).alias("name"),
        parted(text("AC")).alias("accessions"),
        some(text("DE")).alias("description"),
        some(text("GN")).alias("gene_name"),
        some(F.regexp_replace(text("OS"), r"\.$", "")).alias("organism"),
        parted(text("OC")).alias("lineage"),
        F.nullif(F.regexp_extract(text("OX"), r"NCBI_TaxID=(\d+)", 1), F.lit("")).cast("int").alias("taxid"),
        parted(text("KW")).alias("keywords"),
        F.array_distinct(refs).alias("dbxrefs"),
        some(comments).alias("comments"),
        F.nullif(F.regexp_extract(text("DT"), r"^([^,]+),", 1), F.lit("")).alias("created"),
        some(F.regexp_extract(text("PE"), r"^(\d)", 1)).alias("existence"),
        F.length(seq).alias("length"),
        seq.alias("seq"),
    )


def genbank(spark: SparkSession, path) -> DataFrame:
    """Records with their features; see RECORDS.

    A feature whose location cannot be read is left out, see ``genbank_problems``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("strand", pa.int32()), ("before", pa.bool_()), ("after", pa.bool_())])
        feature = pa.struct([("type", pa.string()), ("operator", pa.string()), ("parts", pa.list_(part)), ("qualifiers", pa.map_(pa.string(), pa.list_(pa.string())))])
        schema = pa.schema([("record_id", pa.string()), ("name", pa.string()), ("description", pa.string()), ("molecule_type", pa.string()), ("topology", pa.string()), ("length", pa.int32()), ("taxid", pa.int32()), ("seq", pa.string()), ("features", pa.list_(feature))])
        for batch in batches:
            rows = [r for r in (parse_genbank((v or "").replace("\r", "")) for v in batch.column(0).to_pylist()) if r]
            for r in rows:
                for f in r["features"]:
                    f["qualifiers"] = list(f["qualifiers"].items())
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema=schema)

    return _blocks(spark, path, "\n//").select("value").mapInArrow(run, RECORDS)


def features_of(records: DataFrame) -> DataFrame:
    """(record_id, fidx, type, operator, parts, start, end, strand, qualifiers): a row for each feature."""
    f = records.select("record_id", F.posexplode("features").alias("fidx", "f")).select("record_id", "fidx", "f.*")
    parts = F.col("parts")
    return f.select("record_id", "fidx", "type", "operator", "parts", F.array_min(F.transform(parts, lambda p: p["start"])).alias("start"), F.array_max(F.transform(parts, lambda p: p["end"])).alias("end"), F.get(parts, 0)["strand"].alias("strand"), "qualifiers")


def profiles(spark: SparkSession, path) -> DataFrame:
    """(database, name, acc, description, length, text) of profile files."""
    raw = _blocks(spark, path, "\n//")
    field = lambda k: F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^{k}\s+(.*)$", 1)), F.lit(""))
    base = F.regexp_extract("file", r"([^/]*?)(?:\.[^/.]*)?$", 1)
    return raw.where(F.col("value").rlike(r"(?m)^NAME\s")).select(base.alias("database"), field("NAME").alias("name"), field("ACC").alias("acc"), field("DESC").alias("description"), field("(?:LENG|CLEN)").cast("int").alias("length"), F.col("value").alias("text"))


def dense_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, score) of a labelled tab-separated matrix: labels in the first row and column."""
    rows = spark.read.option("header", True).option("sep", "\t").csv(path)
    label, *columns = rows.columns
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("j"), F.col(f"`{c}`").cast("double").alias("score")) for c in columns]))
    return rows.select(F.col(f"`{label}`").alias("i"), cells.alias("x")).select("i", "x.j", "x.score")


def sparse_matrix(spark: SparkSession, path: str, lower: float | None = None) -> DataFrame:
    """(i, j, score) of a table of triples."""
    m = spark.read.schema("i string, j string, score double").option("sep", "\t").csv(path)
    return m if lower is None else m.where((F.col("score") > lower) | F.isnan("score"))


def taxonomy_dump(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """nodes (taxid, parent, rank), names (taxid, name, class), merged (old, new), deleted (taxid)."""

    def fields(name: str) -> DataFrame:
        return spark.read.text(f"{folder}/{name}.dmp").select(F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t").alias("x"))

    at = lambda k: F.trim(F.get("x", F.lit(k)))
    return {
        "nodes": fields("nodes").select(at(0).cast("long").alias("taxid"), at(1).cast("long").alias("parent"), at(2).alias("rank")),
        "names": fields("names").select(at(0).cast("long").alias("taxid"), at(1).alias("name"), at(3).alias("class")),
        "merged": fields("merged").select(at(0).cast("long").alias("old"), at(1).cast("long").alias("new")),
        "deleted": fields("delnodes").select(F.regexp_extract(at(0), r"(\d+)", 1).cast("long").alias("taxid")),
    }


def simple_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lines without blanks around them."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''").distinct()


def colour_table(spark: SparkSession, path: str) -> DataFrame:
    """(name, colour) of a table without header; colours as #RRGGBB."""
    from helixframe.functions.sequences import color_hex

    t = spark.read.schema("name string, colour string").option("sep", "\t").csv(path)
    return t.select("name", color_hex(F.col("colour")).alias("colour"))


def coordinates(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(contig, start, end, strand) from 1-based inclusive tables, 0-based half open; the strand defaults to 1."""
    t = spark.read.option("header", True).option("sep", sep).csv(path)
    missing = {"contig", "start", "end"} - set(t.columns)
    if missing:
        raise ValueError(f"the table lacks {sorted(missing)}")
    strand = F.coalesce(F.col("strand").cast("int"), F.lit(1)) if "strand" in t.columns else F.lit(1)
    return t.select("contig", (F.col("start").cast("int") - 1).alias("start"), F.col("end").cast("int").alias("end"), strand.alias("strand"))


def assembly_summary(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an assembly summary (a comment line, then a header that starts with #), all as text, with ``versionless_accession``."""
    # the header is the second line of the file
    head = [r["value"] for r in spark.read.text(path).limit(2).collect()]
    names = head[1].lstrip("# ").rstrip("\n").split("\t")
    rows = spark.read.schema(", ".join(f"`{n}` string" for n in names)).options(sep="\t", comment="#", quote="").csv(path)
    return rows.withColumn("versionless_accession", F.substring_index("assembly_accession", ".", 1))


def offsets(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(offset, n_proteins): where each record of one uncompressed file starts, in bytes, and its coding regions.

    A record of FASTA, or of residues, counts as one.  The file is read in splits; only these
    two numbers of a record leave the task.
    """
    kind = kind or file_kind(path)
    if kind not in ("genbank", "fasta") or re.search(r"\.(gz|bgz|bgzf|bz2|zst)$", path.lower()):
        raise ValueError(f"no offsets for {path}")
    mark = "LOCUS " if kind == "genbank" else ">"
    io = "org.apache.hadoop."
    chunks = spark.sparkContext.newAPIHadoopFile(path, io + "mapreduce.lib.input.TextInputFormat", io + "io.LongWritable", io + "io.Text", conf={"textinputformat.record.delimiter": "\n" + mark})

    def place(chunk: tuple[int, str]):
        at, text = chunk
        if at == 0:
            # what stands before the first record is none
            if not text.startswith(mark):
                return []
            at, text = len(mark), text[len(mark) :]
        if kind == "fasta":
            return [(at - len(mark), 1)]
        words = text.split("\n", 1)[0].split()
        residues = len(words) > 2 and words[2] == "aa"
        return [(at - len(mark), 1 if residues else text.count("\n     CDS "))]

    return spark.createDataFrame(chunks.flatMap(place), "offset long, n_proteins long")
