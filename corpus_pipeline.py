"""The corpus pipeline: from raw documents to packed training sequences.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and calls one operator of
``helixframe.llm``.  All but the last return the columns of documents; a stage's result
is written as Parquet and read back before the next one starts, so a lost executor never
costs more than the stage it works for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import common, lines, mixing, packing, quality, queries, simhash
from helixframe.runtime import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that fail the base rule or the learned decision list."""
    rules = quality.train(docs, common.table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("hx_row"), F.col("text"))
    return quality.judge(rows, rules).where("kept").select("hx_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that stand in three documents or more out of all but the last of them."""
    got = lines.dedup_lines(docs)
    text = F.when(F.col("hx_dropped") > 0, F.col("hx_kept")).otherwise(F.col("text"))
    size = F.when(F.col("hx_dropped") > 0, F.char_length("hx_kept").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    new = {"text": text} | ({"n_chars": size} if size is not None else {})
    return got.select(*[(new[c].alias(c) if c in new else F.col(f"`{c}`")) for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, similarity 0.8."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents to the target weights; a document of a second epoch is a row of its own."""
    return mixing.mix_sources(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens: a row for each piece."""
    return packing.pack_documents(docs, queries.vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing", mix_sources),
    ("best-fit packing", best_fit_packing),
]

#: Learned rules, fingerprints and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"stage-{k}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
