"""Writers: FASTA, flat files, matrices and network files, from DataFrames.

Text is built in the plan and written by Spark, a file for each partition; nothing is
gathered.  ``check_size`` stops outputs whose size is known to be too large beforehand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT = 25_000_000_000


def check_size(projected: int, limit: int = DEFAULT_LIMIT, what: str = "the output") -> None:
    """Raises if more than ``limit`` bytes are projected; 0 switches the check off."""
    if limit and projected > limit:
        raise ValueError(f"{what} would take {projected} bytes; the limit is {limit}")


def wrap(seq: Column, width: int = 60) -> Column:
    return F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), F.lit("\n"))


def as_fasta(record_id: str = "record_id", description: str = "description", seq: str = "seq") -> Column:
    title = F.rtrim(F.concat_ws(" ", F.col(record_id), F.nullif(F.col(description), F.lit(""))))
    return F.concat(F.lit(">"), title, F.lit("\n"), wrap(F.col(seq)))


def fasta(records: DataFrame, path: str) -> None:
    records.select(as_fasta()).write.text(path)


def _place(parts: Column) -> Column:
    """A feature's location in flat-file form; all parts on the minus strand are complemented at once."""
    one = lambda p: F.concat((p["start"] + 1).cast("string"), F.lit(".."), p["end"].cast("string"))
    signed = lambda p: F.when(p["strand"] < 0, F.concat(F.lit("complement("), one(p), F.lit(")"))).otherwise(one(p))
    joined = F.array_join(F.transform(parts, signed), ",")
    return F.when(F.size(parts) > 1, F.concat(F.lit("join("), joined, F.lit(")"))).otherwise(joined)


def as_genbank() -> Column:
    pad = " " * 21
    quals = lambda f: F.array_join(F.flatten(F.transform(F.map_entries(f["qualifiers"]), lambda e: F.transform(e["value"], lambda v: F.concat(F.lit(f'{pad}/'), e["key"], F.lit('="'), v, F.lit('"'))))), "\n")
    feats = F.array_join(F.transform("features", lambda f: F.concat_ws("\n", F.concat(F.lit("     "), F.rpad(f["type"], 16, " "), _place(f["parts"])), F.nullif(quals(f), F.lit("")))), "\n")
    unit = F.when(F.col("molecule_type") == "protein", "aa").otherwise("bp")
    head = F.concat(F.lit("LOCUS       "), F.rpad("record_id", 16, " "), F.lit(" "), F.col("length").cast("string"), F.lit(" "), unit, F.lit("    "), F.col("molecule_type"), F.lit("     "), F.col("topology"), F.lit("\nDEFINITION  "), F.col("description"), F.lit(".\nVERSION     "), F.col("record_id"), F.lit("\nFEATURES             Location/Qualifiers"))
    rows = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length("seq") - 1) / 60), F.lit(0)).cast("int")), lambda k: F.concat(F.lpad((k * 60 + 1).cast("string"), 9, " "), F.lit(" "), F.rtrim(F.regexp_replace(F.lower(F.substring(F.col("seq"), k * 60 + 1, F.lit(60))), "(.{10})", "$1 "))))
    return F.concat_ws("\n", head, F.nullif(feats, F.lit("")), F.lit("ORIGIN"), F.array_join(rows, "\n"), F.lit("//"))


def genbank(records: DataFrame, path: str) -> None:
    records.select(as_genbank()).write.text(path)


def triples(matrix: DataFrame, path: str) -> None:
    matrix.select("i", "j", "score").write.option("sep", "\t").csv(path)


def dense_text(matrix: DataFrame, path: str, max_columns: int = 20_000) -> None:
    """A labelled matrix; its columns are pivoted, so their number is checked."""
    names = [r["j"] for r in matrix.select("j").distinct().orderBy("j").limit(max_columns + 1).collect()]
    if len(names) > max_columns:
        raise ValueError(f"more than {max_columns} columns")
    wide = matrix.groupBy("i").pivot("j", names).agg(F.first("score")).na.fill(0.0)
    wide.orderBy("i").coalesce(1).write.option("header", True).option("sep", "\t").csv(path)


def network(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as XGMML elements, a line each; ``nodes`` has id and attributes, ``edges`` i, j, score."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    atts = [F.concat(F.lit(f'<att name="{c}" value="'), escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit('"/>')) for c in nodes.columns if c != "id"]
    n = nodes.select(F.concat(F.lit('<node id="'), escape(F.col("id").cast("string")), F.lit('">'), *atts, F.lit("</node>")).alias("value"))
    e = edges.select(F.concat(F.lit('<edge source="'), escape(F.col("i").cast("string")), F.lit('" target="'), escape(F.col("j").cast("string")), F.lit('"><att name="score" value="'), F.col("score").cast("string"), F.lit('"/></edge>')).alias("value"))
    n.unionByName(e).write.text(path)


def by_cluster(rows: DataFrame, cluster: str, path: str, min_size: int = 1) -> None:
    """A folder for each cluster of at least ``min_size``; smaller ones share the folder 0."""
    sizes = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("hx_n"))
    out = rows.join(sizes, cluster).withColumn(cluster, F.when(F.col("hx_n") >= min_size, F.col(cluster)).otherwise(F.lit(0))).drop("hx_n")
    out.write.partitionBy(cluster).parquet(path)


def as_row(rows: DataFrame) -> Column:
    """A row as tab-separated text: nulls empty, whole numbers plain, other numbers with one decimal place, tabs in text as blanks."""

    def cell(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("double", "float") or kind.startswith("decimal"):
            c = F.call_function("format_number", c.cast("double"), F.lit("0.0"))
        else:
            c = F.translate(c.cast("string"), "\t", " ")
        return F.coalesce(c, F.lit(""))

    return F.concat_ws("\t", *[cell(name, kind) for name, kind in rows.dtypes])


def report(rows: DataFrame, path: str) -> None:
    """A typed report; each file starts with the names of its columns."""
    lines = rows.select(as_row(rows).alias("\t".join(rows.columns)))
    # one column with a separator that does not occur: the lines are written as they are
    lines.write.options(header=True, sep="\x01", quote="\x00", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def projected_bytes(lines: DataFrame, column: str = "value") -> int:
    """Bytes that the lines will take as text, for ``check_size``."""
    return lines.agg(F.sum(F.octet_length(column) + 1)).first()[0] or 0
