"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import common, hnsw, html, lines, mixing, packing, quality, recompression, simhash, suffixes, urls

#: The vocabulary for packing; a file that the installed tokenizers package provides.
VOCABULARY = "word_bpe_49k.json"
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.dedup(common.table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(common.table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, vocabulary())


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.main_text(pages, html.train(pages))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(common.table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    rules = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return quality.judge(docs.select("doc_id", "text"), rules).drop("text")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(common.table(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    got = mixing.mix_sources(docs.select("doc_id", "text", "lang", "source"))
    return got.select("doc_id", F.col("hx_domain").alias("domain"), F.col("hx_lang").alias("lang"), F.col("hx_source").alias("source"), F.col("hx_tokens").alias("n_tokens"), F.col("hx_epoch").cast("long").alias("epoch"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    got = lines.dedup_lines(docs)
    return got.select("doc_id", F.col("hx_lines").alias("n_lines"), F.col("hx_dropped").alias("n_dropped"), F.sha2("hx_kept", 256).alias("kept_sha256"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = urls.filter_urls(pages, rules)
    return got.select("page_id", F.col("hx_host").alias("host"), F.col("hx_path").alias("path"), F.col("hx_rule").alias("rule"), F.col("hx_verdict").alias("verdict"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_html_extraction": op4_html_extraction,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_mixing": op8_mixing,
    "op9_line_dedup": op9_line_dedup,
    "op10_url_filters": op10_url_filters,
}

_OP9 = r"""
WITH l AS (
  SELECT doc_id, i, line, CASE WHEN length(k) >= 20 THEN k END AS k
  FROM (SELECT doc_id, i, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
        FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
              FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)))),
f AS (SELECT k, max(doc_id) AS last FROM l WHERE k IS NOT NULL GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.doc_id, l.i, l.line, coalesce(l.doc_id <> f.last, FALSE) AS gone FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_OP10 = r"""
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
b AS (SELECT u.page_id, arg_max(rh || rp, length(rh) + length(rp)) AS rule, arg_max(v, length(rh) + length(rp)) AS v
      FROM u JOIN r ON (u.host = rh OR suffix(u.host, '.' || rh)) AND starts_with(u.path, rp) GROUP BY u.page_id)
SELECT u.page_id, u.host, u.path, b.rule AS rule, coalesce(b.v, 'allow') AS verdict FROM u LEFT JOIN b USING (page_id)
"""

_SHARE = """
{n}a AS (SELECT {path}, SUM(tokens * 2) AS cap, SUM(tokens) AS tokens, {w} AS w FROM leaves GROUP BY {path}),
{n}b AS (SELECT a.*, p.total, CAST(a.cap AS HUGEINT) * 1000000 // a.w AS ratio FROM {n}a a JOIN {up} p {on}),
{n}c AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY {part} ORDER BY ratio, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(w) OVER (PARTITION BY {part} ORDER BY ratio, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM {n}b),
{n}d AS (SELECT *, min(CASE WHEN cap * rest_w <= (total - filled) * w THEN 1 ELSE 0 END) OVER (PARTITION BY {part} ORDER BY ratio, {name}) AS is_full FROM {n}c),
{n}e AS (SELECT *, coalesce(sum(CASE WHEN is_full = 1 THEN cap END) OVER (PARTITION BY {part}), 0) AS spent,
         sum(CASE WHEN is_full = 0 THEN w END) OVER (PARTITION BY {part}) AS open_w FROM {n}d),
{n} AS (SELECT {path}, tokens, CASE WHEN is_full = 1 THEN cap ELSE least((total - spent) * w // open_w, cap) END AS total FROM {n}e)"""


def _mix_sql() -> str:
    mix = mixing.Mix()

    def case(name: str, weights: dict[str, int]) -> str:
        return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END" if weights else "1"

    steps = [
        _SHARE.format(n="x1", path="domain", name="domain", part="1", up="root", on="ON TRUE", w=case("domain", mix.domain)),
        _SHARE.format(n="x2", path="domain, lang", name="lang", part="domain", up="x1", on="USING (domain)", w=case("lang", mix.lang)).replace("a.*, p.total", "a.*, p.total"),
        _SHARE.format(n="x3", path="domain, lang, source", name="source", part="domain, lang", up="x2", on="USING (domain, lang)", w="1"),
    ]
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
         CASE WHEN regexp_matches(source, '[0-9]{{1,9}}$') THEN 'd' || CAST(CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INT) % 4 AS VARCHAR) ELSE 'none' END AS domain,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 AS BIGINT) AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, SUM(n_tokens) AS tokens FROM d GROUP BY ALL),
root AS (SELECT SUM(tokens) * {mix.budget_percent} // 100 AS total FROM leaves),
{",".join(steps)},
e AS (SELECT d.*, g.epoch, x3.total - (g.epoch - 1) * x3.tokens AS rest, md5('{mix.seed}:' || g.epoch || ':' || d.doc_id) AS h
      FROM d JOIN x3 USING (domain, lang, source), (VALUES (1), (2)) g(epoch)),
o AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY h GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epoch AS BIGINT) AS epoch FROM o WHERE before < rest
"""


ORACLE: dict[str, str] = {
    "op8_mixing": _mix_sql(),
    "op9_line_dedup": _OP9,
    "op10_url_filters": _OP10,
}
