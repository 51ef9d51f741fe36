"""URL filters by a sort-merge range join (native).

A rule's canonical key is its host's labels in reverse order, each ended by a dot, and its
path; the keys that it is a prefix of are its interval, so the intervals of any two rules
are nested or disjoint.  A host's path rules hold for its subdomains too: a URL looks up
one key for each domain above its host, as deep as rules go.  Keys and rules are dealt
into ranges and sorted, and one sweep goes over them with a stack of nested rules: a rule
that begins stands on the rules it is nested in, and the key that follows takes off what
has ended, that is what is no prefix of it.  The top is the longest rule that fits.  The
longest of a URL's lookups wins.  A stack holds as many rules as are nested, never the
rules of a host.

Ranges come from a bounded sample of lookups and rules, in number as the rows ask for; a
key that fills several quantiles gets as many salted copies of its range, so one hot host
or one hot URL is split.  Each pair of host and path is judged once.

Defined cases: a null URL, or one without ``://``, has an empty host and path and gets
the default verdict; an empty path starts with no rule's path but the empty one; rules
with a null host, path or verdict are dropped, and so are those whose path is neither
empty nor begins with a slash, which no URL's path starts with; of rules with equal host
and path the stricter verdict ("block") counts; equally long rules: the longer host wins.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import LOWER, UPPER, fresh, hash_sample
from helixframe.runtime import materialize

#: Rows that a range is made for, and what is sampled for each range.
RANGE_ROWS, RANGE_SAMPLE = 100_000, 32
#: More ranges than this would make the sample too large for the driver: then ranges grow, and Spark's sort spills.
MOST_RANGES = 4096


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels reversed, each with a dot: ``a.example.org`` is ``org.example.a.``."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def ruled(rules: DataFrame) -> DataFrame:
    """(key, stack): the canonical key of each rule, and the rules it is nested in, outermost first, with itself."""
    clean = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
    clean = clean.where((F.col("path") == "") | F.startswith("path", F.lit("/")))
    clean = clean.groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("block"), F.min("verdict").alias("other"))
    clean = clean.withColumn("host_part", host_key(F.col("host"))).withColumn("key", F.concat("host_part", "path"))
    clean = clean.withColumn(
        "rule",
        F.struct(
            (F.char_length("host") + F.char_length("path")).alias("size"),
            F.char_length("host").alias("host_size"),
            "key",
            F.concat("host", "path").alias("name"),
            F.when(F.col("block"), F.lit("block")).otherwise(F.col("other")).alias("verdict"),
        ),
    )
    clean = materialize(clean.select("key", "rule", "host_part", "path"), "rules", free=False)
    # what a rule can be nested in: its own host's paths, and hosts above without a path
    labels = F.split("host_part", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))
    size = F.char_length("path")
    inside = F.when(size > 0, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.concat("host_part", F.substring("path", F.lit(1), i)))).otherwise(F.array().cast("array<string>"))
    up = clean.select("key", F.explode(F.concat(above, inside)).alias("over"))
    held = clean.select(F.col("key").alias("over"), "rule")
    return up.join(held, "over").groupBy("key").agg(F.sort_array(F.collect_list("rule")).alias("stack"))


def lookups(pairs: DataFrame, depth: int) -> DataFrame:
    """(host, path, key): one for each domain of ``depth`` labels at most above the host, or the host itself."""
    labels = F.reverse(F.split("host", r"\."))
    keys = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(depth))), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit("."), F.col("path")))
    return pairs.select("host", "path", F.explode(keys).alias("key"))


def _position(bounds: list[str], key: Column) -> Column:
    """How many of the sorted ``bounds`` are at most ``key``, by bisection."""
    if not bounds:
        return F.lit(0)
    held, steps = F.array(*[F.lit(b) for b in bounds]), len(bounds).bit_length()

    def halve(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["lo"] + acc["hi"], 1)
        right = (acc["lo"] < acc["hi"]) & (F.get(held, middle) <= key)
        return F.struct(F.when(right, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(right, acc["hi"]).otherwise(F.least(middle, acc["hi"])).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.array_repeat(F.lit(0), steps + 1), start, halve, lambda acc: acc["lo"])


def sweep(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """``keys`` (key and more) with best, the longest of ``rules`` (key, stack) whose key is a prefix, or null."""
    rest = [c for c in keys.columns if c != "key"]
    bounds, copies = _ranges(keys.select("key", F.struct(*rest).alias("ident")).unionByName(rules.select("key", F.lit(None).cast(keys.select(F.struct(*rest)).schema[0].dataType).alias("ident"))))
    many = F.array(*[F.lit(c) for c in copies])
    dealt = keys.withColumn("part", _position(bounds, F.col("key"))).withColumn("salt", F.pmod(F.xxhash64("key", *rest), F.get(many, F.col("part"))).cast("int"))
    opens = rules.withColumn("part", _position(bounds, F.col("key")))
    # the stack with which a range begins is that of the last rule of the ranges before it
    last = opens.groupBy("part").agg(F.max_by("stack", "key").alias("stack"))
    every = keys.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("part")).join(last, "part", "left")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carried = every.select("part", F.lit("").alias("key"), F.last("stack", ignorenulls=True).over(before).alias("stack")).where("stack IS NOT NULL")
    placed = opens.select("part", "key", "stack").unionByName(carried)
    placed = placed.select("part", "key", "stack", F.explode(F.sequence(F.lit(0), F.get(many, F.col("part")) - 1)).alias("salt"))
    both = dealt.withColumn("kind", F.lit(1)).unionByName(placed.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    down = Window.partitionBy("part", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("stack", F.last("stack", ignorenulls=True).over(down)).where("kind = 1")
    # what is no prefix of the key has ended, and is taken off; of what is left the top is the longest
    fits = F.filter("stack", lambda r: F.startswith(F.col("key"), r["key"]))
    return seen.select("key", *rest, F.array_max(fits).alias("best"))


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", id_col: str = "page_id", default: str = "allow") -> DataFrame:
    """``pages`` with hx_host, hx_path, hx_rule (host and path of the rule, or null) and hx_verdict."""
    host, path = fresh(pages, "hx_host_of", "hx_path_of")
    url = F.col(f"`{url_col}`")
    rows = pages.withColumns({host: host_of(url), path: path_of(url)})
    pairs = materialize(rows.select(F.col(host).alias("host"), F.col(path).alias("path")).distinct(), "url-pairs")
    stacks = materialize(ruled(rules), "rule-stacks")
    depth = stacks.agg(F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\.")) - 1)).first()[0] or 1
    found = sweep(lookups(pairs, depth), stacks).where("best IS NOT NULL")
    best = found.groupBy("host", "path").agg(F.max("best").alias("best"))
    best = materialize(best.select(F.col("host").alias(host), F.col("path").alias(path), F.col("best.name").alias("hx_rule"), F.col("best.verdict").alias("hx_verdict")), "url-verdicts")
    # verdicts grow with the table: they are never broadcast
    out = rows.join(best.select(host, path, F.struct("hx_rule", "hx_verdict").alias("hx_best")).hint("merge"), [host, path], "left")
    return out.select(
        *[F.col(f"`{c}`") for c in pages.columns],
        F.col(host).alias("hx_host"),
        F.col(path).alias("hx_path"),
        F.col("hx_best.hx_rule").alias("hx_rule"),
        F.coalesce(F.col("hx_best.hx_verdict"), F.lit(default)).alias("hx_verdict"),
    )


def _ranges(keys: DataFrame) -> tuple[list[str], list[int]]:
    """Range bounds from a bounded sample of keys, and how many salted copies each range gets."""
    ranges = min(MOST_RANGES, keys.count() // RANGE_ROWS + 16)
    got = [r[0] for r in hash_sample(keys, F.struct("ident", "key"), ranges * RANGE_SAMPLE).select("key").collect()]
    got.sort(key=lambda k: k.encode())
    step = max(1, len(got) // ranges)
    cut = got[step::step]
    bounds = sorted(set(cut), key=lambda k: k.encode())
    times = Counter(cut)
    return bounds, [1] + [times[b] for b in bounds]
