"""Profile against profile: local Viterbi alignment of two profile models over five pair states.

The recurrences are those of pairwise profile comparison (Söding 2005): both match; one
matches while the other inserts; one deletes or gaps.  Cells of an anti-diagonal do not
depend on each other, so a pair is one pass of array operations, and three diagonals are
all that is held.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: background frequencies of amino acids
AMINO = {
    "A": 0.0787945, "C": 0.0151600, "D": 0.0535222, "E": 0.0668298, "F": 0.0397062, "G": 0.0695071, "H": 0.0229198, "I": 0.0590092, "K": 0.0594422, "L": 0.0963728,
    "M": 0.0237718, "N": 0.0414386, "P": 0.0482904, "Q": 0.0395639, "R": 0.0540978, "S": 0.0683364, "T": 0.0540687, "V": 0.0673417, "W": 0.0114135, "Y": 0.0304133,
}
#: Columns of the transitions: match to match, insert, delete; insert to match, insert; delete to match, delete.
MM, MI, MD, IM, II, DM, DD = range(7)
#: Bytes of references that every task may hold.
MAX_BYTES = 256 << 20


def parse(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """(letters, emissions, log transitions) of a profile text; row 0 is the entry node."""
    lines = text.splitlines()
    at = next((k for k, line in enumerate(lines) if line.split()[:1] == ["HMM"]), None)
    if at is None:
        raise ValueError("not a profile")
    letters = "".join(lines[at].split()[1:])
    k = len(letters)
    number = lambda x: -np.inf if x == "*" else -float(x)
    body = [line.split() for line in lines[at + 2 :] if line.strip() and not line.startswith("//")]
    if body and body[0][0] == "COMPO":
        body = body[1:]
    first = np.zeros(k)
    first[0] = 1.0
    emissions = [first, *[np.exp([number(x) for x in row[1 : k + 1]]) for row in body[2::3]]]
    transitions = [[number(x) for x in row[:7]] for row in body[1::3]]
    if len(emissions) != len(transitions):
        raise ValueError("a profile that is cut short")
    return letters, np.array(emissions), np.array(transitions)


def background(letters: str) -> np.ndarray:
    return np.array([AMINO[c] for c in letters]) if len(letters) > 4 else np.full(len(letters), 1 / len(letters))


def compare(q: tuple, r: tuple) -> tuple[float, int, int]:
    """Best local score and the nodes of both profiles at which it ends; (0, 0, 0) for none."""
    letters, qe, qt = q
    if letters != r[0]:
        raise ValueError("profiles of different alphabets")
    re_, rt = r[1], r[2]
    with np.errstate(divide="ignore", invalid="ignore"):
        column = np.log(qe @ (re_ / background(letters)).T)
    n, m = len(qe) - 1, len(re_) - 1
    # by query node: match-match, match-insert, insert-match, delete-gap, gap-delete; the border is 0
    zero = lambda: np.zeros((5, n + 1))
    two, one, best = zero(), zero(), (0.0, 0, 0)
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        now = zero()
        a, b = qt[i - 1], rt[j - 1]
        corner, up, left = two[:, i - 1], one[:, i - 1], one[:, i]
        from_corner = [corner[0] + a[:, MM] + b[:, MM], corner[1] + a[:, MM] + b[:, IM], corner[2] + a[:, IM] + b[:, MM], corner[3] + a[:, DM] + b[:, MM], corner[4] + a[:, MM] + b[:, DM]]
        now[0, i] = np.maximum(np.max(from_corner, axis=0), 0) + column[i, j]
        now[1, i] = a[:, MM] + np.maximum(up[0] + rt[j, MI], up[1] + rt[j, II])
        now[2, i] = b[:, MM] + np.maximum(left[0] + qt[i, MI], left[2] + qt[i, II])
        now[3, i] = np.maximum(up[0] + a[:, MD], up[3] + a[:, DD])
        now[4, i] = np.maximum(left[0] + b[:, MD], left[4] + b[:, DD])
        top = int(np.argmax(now[:, i].max(axis=0)))
        score = float(now[:, i[top]].max())
        if score > best[0]:
            best = (score, int(i[top]), int(j[top]))
        two, one = one, now
    return best


def compare_profiles(queries: DataFrame, references: Sequence, cutoff: float = float("-inf")) -> DataFrame:
    """(query, ref, score, query_end, ref_end) of profiles (name, text) against gathered rows of (name, text).

    A query without a profile in its text (null too) gives no row.  References beyond
    ``MAX_BYTES`` are refused: search them in blocks.
    """
    refs = [(r["name"], r["text"]) for r in references]
    if sum(len(t) for _, t in refs) > MAX_BYTES:
        raise ValueError(f"references of more than {MAX_BYTES} bytes; search them in blocks")
    kinds = [pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
    names = ["query", "ref", "score", "query_end", "ref_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(name, parse(text)) for name, text in refs]
        for batch in batches:
            out = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                q = parse(text)
                for ref, r in known:
                    score, i, j = compare(q, r)
                    if score >= cutoff:
                        out.append((name, ref, score, i, j))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    whole = queries.where(F.col("text").rlike(r"(?m)^HMM\s"))
    return whole.select("name", "text").mapInArrow(run, "query string, ref string, score double, query_end int, ref_end int")


def consensus(text: Column) -> Column:
    """The consensus letters of a profile's nodes: the letter after the map number of each match line, in order."""
    lines = F.regexp_extract_all(text, F.lit(r"(?m)^\s+\d+(?:\s+(?:[0-9.]+|\*))+\s+(?:\d+|-)\s+(\S)\s+\S\s+\S\s+\S\s*$"), F.lit(1))
    return F.array_join(lines, "")


def report(profiles: DataFrame) -> DataFrame:
    """(database, name, acc, description, length, consensus) of what the profile reader gives."""
    return profiles.select("database", "name", "acc", "description", "length", consensus(F.col("text")).alias("consensus"))
