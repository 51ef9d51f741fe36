"""Quality rules: text statistics and learned decision lists (native).

Statistics are Spark expressions over whole texts.  A decision list is learned by
sequential covering from a bounded sample of labelled rows: each rule is a conjunction
of thresholds, grown literal by literal on one part of the sample and pruned on the
other, and the finished list is one ordered ``CASE WHEN`` that Spark evaluates.

Defined cases: a null or empty text has no words, all its counts are 0 and it fails the
base rule.  Labels that are null, or that contradict each other for one id, teach
nothing; without labelled rows the list is empty and keeps every row that passes the
base rule.  Repeated rows are judged alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import SPACE_CHARS, fresh, hash_sample, words
from helixframe.runtime import barrier, let

WINDOW = 8  # a power of two
#: At most so many labelled rows teach the list; they are drawn by a hash of the id.
SAMPLE_ROWS = 4000
MIN_WORDS = 20
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbols", "dup_lines", "repeats", "word_length", "upper", "bangs", "line_words", "variety", "digits", "pipes", "stops", "word_count")


def statistics(docs: DataFrame, text_col: str = "text", features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Adds STATS (long) and the ratios named in ``features`` (double) to ``docs``.

    A column of ``docs`` that has one of those names is replaced.
    """
    docs = docs.select([c for c in docs.columns if c.lower() not in (*STATS, *FEATURES)])
    w, ls, h, g, z = fresh(docs, "hx_w", "hx_l", "hx_h", "hx_g", "hx_z")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    a = barrier(docs, {w: words(F.col(f"`{text_col}`")), ls: F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACE_CHARS)) != "")})
    n = F.size(w)
    # hashes of 1, 2, 4 and 8 words from each place, by doubling: a slice for each window would cost eight times the text
    a = barrier(a, {h: F.transform(w, lambda x: F.xxhash64(x))})
    for k in range(WINDOW.bit_length() - 1):
        ahead = F.slice(h, F.lit((1 << k) + 1), F.greatest(F.size(h) - (1 << k), F.lit(0)))
        a = barrier(a, {g: F.zip_with(h, ahead, lambda x, y: F.xxhash64(x, y))}).drop(h).withColumnRenamed(g, h)
    windows = F.when(n >= WINDOW, F.slice(h, F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))))
    e = barrier(
        a,
        {
            "n_words": n.cast("long"),
            "word_chars": F.aggregate(w, F.lit(0).cast("long"), lambda acc, x: acc + F.char_length(x)),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"),
            z: windows,
        },
    ).drop(h)
    # only texts with a repeated window pay for the sort
    again = F.size(F.array_distinct(z)) < F.size(z)
    ordered = F.sort_array(F.transform(z, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    e = barrier(e, {"n_repeat_words": F.when(again, let(ordered, _covered)).otherwise(0).cast("long")}).drop(z)
    some = lambda x: F.greatest(x, F.lit(1)).cast("double")
    count = lambda p: F.regexp_count(text, F.lit(p))
    nw, nc, nl = some(F.col("n_words")), some(F.col("word_chars")), some(F.size(ls))
    ratios = {
        "symbols": F.col("n_symbols") / nc,
        "dup_lines": F.col("n_dup_lines") / nl,
        "repeats": F.col("n_repeat_words") / nw,
        "word_length": F.col("word_chars") / nw,
        "upper": count("[A-Z]") / nc,
        "bangs": count("!") / nw,
        "line_words": F.col("n_words") / nl,
        "variety": F.size(F.array_distinct(w)) / nw,
        "digits": count("[0-9]") / nc,
        "pipes": count(r"[|]") / nw,
        "stops": count("[.]") / nw,
        "word_count": F.col("n_words").cast("double"),
    }
    if features:
        e = barrier(e, {f: ratios[f] for f in features})
    return e.drop(w, ls)


def _covered(s: Column) -> Column:
    """Words in windows that occur twice, from the windows' (hash, place) in order of hash."""
    same = lambda x, i: F.get(s, i)["h"] == x["h"]
    places = F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i - 1), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False))), lambda x: x["i"]))
    return F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("end")),
        lambda acc, i: F.struct((acc["n"] + WINDOW - F.greatest(F.lit(0), acc["end"] - i)).alias("n"), (i + WINDOW).alias("end")),
        lambda acc: acc["n"],
    )


def base_failed(min_words: int = MIN_WORDS) -> Column:
    """Fewer words than ``min_words``, or over 30 of 100 words in repeated windows."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}"


@dataclass
class DecisionList:
    """Ordered rules; the first whose literals all hold rejects, else the row is kept."""

    rules: list[list[Literal]] = field(default_factory=list)

    def kept(self) -> Column:
        out = None
        for rule in self.rules:
            cond = rule[0].column()
            for lit in rule[1:]:
                cond = cond & lit.column()
            out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def features(self) -> tuple[str, ...]:
        """What the rules look at: nothing else need be computed."""
        used = {lit.feature for rule in self.rules for lit in rule}
        return tuple(f for f in FEATURES if f in used)

    def rejects(self, row: dict) -> bool:
        return any(all(lit.holds(row) for lit in rule) for rule in self.rules)

    def __str__(self) -> str:
        return "\n".join(" AND ".join(map(str, r)) for r in self.rules)


def _grow(rows: list[dict], bad: list[bool], features: tuple[str, ...]) -> list[Literal]:
    """Adds the literal of the largest information gain until no good row is covered."""
    rule: list[Literal] = []
    idx = list(range(len(rows)))
    while len(rule) < 4:
        p = sum(bad[i] for i in idx)
        n = len(idx) - p
        if not p or not n:
            break
        before, best = math.log2(p / (p + n)), (1e-9, None)
        for f in features:
            order = sorted(idx, key=lambda i: rows[i][f])
            seen_p = 0
            for k, i in enumerate(order[:-1]):
                seen_p += bad[i]
                lo, hi = rows[i][f], rows[order[k + 1]][f]
                if lo == hi:
                    continue
                for above, pp, size in ((False, seen_p, k + 1), (True, p - seen_p, len(order) - k - 1)):
                    if pp and (gain := pp * (math.log2(pp / size) - before)) > best[0] + 1e-9:
                        best = (gain, Literal(f, above, (lo + hi) / 2))
        if best[1] is None:
            break
        rule.append(best[1])
        idx = [i for i in idx if best[1].holds(rows[i])]
    return rule


def _prune(rule: list[Literal], rows: list[dict], bad: list[bool]) -> tuple[list[Literal], float, int]:
    """The prefix of the rule that does best on the rows held out, its precision and cover."""
    best = (-2.0, rule, 0.0, 0)
    for k in range(1, len(rule) + 1):
        hit = [b for r, b in zip(rows, bad, strict=True) if all(lit.holds(r) for lit in rule[:k])]
        p, n = sum(hit), len(hit) - sum(hit)
        value = (p - n) / (p + n) if hit else -1.0
        if value > best[0] + 1e-12:
            best = (value, rule[:k], p / (p + n) if hit else 0.0, p)
    return best[1], best[2], best[3]


def learn(rows: list[dict], bad: list[bool], features: tuple[str, ...] = FEATURES, precision: float = 0.9, max_rules: int = 16) -> DecisionList:
    """Sequential covering: grow on two thirds, prune on one third, drop what is covered.

    A rule enters the list if it reaches ``precision`` on the held-out third and covers
    some bad row there; the first that does not ends the list.
    """
    held = [i % 3 == 2 for i in range(len(rows))]
    out = DecisionList()
    while len(out.rules) < max_rules:
        grow = [i for i in range(len(rows)) if not held[i]]
        test = [i for i in range(len(rows)) if held[i]]
        if not any(bad[i] for i in grow):
            break
        rule = _grow([rows[i] for i in grow], [bad[i] for i in grow], features)
        if not rule:
            break
        rule, right, cover = _prune(rule, [rows[i] for i in test], [bad[i] for i in test])
        if right < precision or not cover:
            break
        out.rules.append(rule)
        left = [i for i in range(len(rows)) if not all(lit.holds(rows[i]) for lit in rule)]
        rows, bad, held = [rows[i] for i in left], [bad[i] for i in left], [held[i] for i in left]
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """Learns a list from at most ``sample_rows`` labelled ids, chosen by hash (0 is bad)."""
    ident = F.col(f"`{id_col}`")
    known = labels.select(ident.cast("long").alias("hx_id"), F.col(f"`{label_col}`").alias("hx_y")).where("hx_id IS NOT NULL AND hx_y IS NOT NULL")
    known = known.groupBy("hx_id").agg(F.min("hx_y").alias("hx_y"), F.max("hx_y").alias("hx_y2")).where("hx_y = hx_y2")
    sample = hash_sample(known, F.col("hx_id"), sample_rows).select("hx_id", "hx_y")
    texts = docs.select(ident.cast("long").alias("hx_id"), F.col(f"`{text_col}`").alias("text"))
    # at most sample_rows pairs of an id and a label: a side of bounded size
    labelled = statistics(texts.join(F.broadcast(sample), "hx_id")).where(~base_failed())
    got = labelled.select("hx_id", "hx_y", *FEATURES).collect()
    got.sort(key=lambda r: (hash_order(r["hx_id"]), r["hx_id"], [r[f] for f in FEATURES]))
    return learn([{f: float(r[f]) for f in FEATURES} for r in got], [int(r["hx_y"]) == 0 for r in got])


def hash_order(ident: int) -> int:
    """A fixed shuffle of ids, so that the held-out third is not a range of them."""
    return (ident * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % (1 << 64) >> 16


def judge(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """``docs`` with STATS, base_failed and kept."""
    failed, verdict = F.coalesce(base_failed(), F.lit(True)), rules.kept()
    out = statistics(docs.select([c for c in docs.columns if c.lower() not in ("base_failed", "kept")]), text_col, rules.features())
    return out.withColumns({"base_failed": failed, "kept": ~failed & verdict}).drop(*FEATURES)
