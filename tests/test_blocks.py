"""Pairs and matrices by blocks of records: against brute force, and without a shuffled row for each pair."""

import random
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.operators import matrix, similarity


@pytest.fixture
def blocks(monkeypatch):
    """Small blocks, so that a small table has several and features of both kinds."""
    for module in (similarity, matrix):
        monkeypatch.setattr(module, "BLOCK", 16)
        monkeypatch.setattr(module, "MIN_BLOCK", 4)
    monkeypatch.setattr(similarity, "MIN_COMMON", 1)
    monkeypatch.setattr(similarity, "PAIRS_AT_ONCE", 50)


def table(seed, records=70, features=60):
    """Features of very different frequency; repeats and nulls."""
    random.seed(seed)
    rows = [(f"r{r}", int(features * random.random() ** 3)) for r in range(records) for _ in range(random.randrange(1, 12))]
    return rows + rows[:9] + [(None, 1), ("r1", None)]


def brute(rows, score):
    sets = {}
    for r, f in rows:
        if r is not None and f is not None:
            sets.setdefault(r, set()).add(f)
    return {(a, b): score(len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a, b in combinations(sorted(sets), 2) if sets[a] & sets[b]}


SCORES = {"jaccard": lambda s, n, m: s / (n + m - s), "max_containment": lambda s, n, m: s / min(n, m), "min_containment": lambda s, n, m: s / max(n, m)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("common", [8, 10**9, 1])
@pytest.mark.parametrize("metric", similarity.METRICS)
def test_pairs_by_blocks(spark, blocks, monkeypatch, metric, common):
    # an eighth, every feature, and none but those of all records
    monkeypatch.setattr(similarity, "COMMON", common)
    rows = table(1)
    df = similarity.pairs(spark.createDataFrame(rows, "record string, feature long"), metric=metric, lower=0.1)
    want = {k: v for k, v in brute(rows, SCORES[metric]).items() if v > 0.1}
    got = df.collect()
    assert len(got) == len(want) and {(x.i, x.j): x.score for x in got} == want


def test_pairs_of_nothing(spark):
    assert similarity.pairs(spark.createDataFrame([], "record long, feature long")).count() == 0
    assert similarity.pairs(spark.createDataFrame([(1, 1), (2, None)], "record long, feature long")).count() == 0


def test_pairs_are_not_shuffled(spark):
    """a row for each pair went through an aggregate by i and j."""
    text = plan(similarity.pairs(spark.createDataFrame(table(2), "record string, feature long")))
    assert "hashpartitioning(i" not in text and "keys=[i" not in text


def frame(spark, rows):
    return spark.createDataFrame(rows, "record string, feature long")


def cells(seed, n=40):
    random.seed(seed)
    return [(i, j, float(random.randrange(0, 30))) for i in range(n) for j in range(n) if random.random() < 0.3]


def test_weighted_pairs(spark, blocks):
    one, two = table(3), table(4, 50, 9)
    a, b = brute(one, SCORES["jaccard"]), brute(two, SCORES["jaccard"])
    both = Counter({k: v * 0.25 for k, v in a.items()})
    both.update({k: v * 0.75 for k, v in b.items()})
    got = similarity.weighted_pairs([(1, frame(spark, one)), (0, frame(spark, two)), (3, frame(spark, two))], 0.1).collect()
    want = {k: v for k, v in both.items() if v > 0.1}
    assert len(got) == len(want) and {(x.i, x.j): x.score for x in got} == pytest.approx(want)
    with pytest.raises(ValueError):
        similarity.weighted_pairs([(0, frame(spark, one))])


def test_weighted_similarity_shuffles_no_pairs(spark):
    """both parts were made as rows and added by i and j."""
    from helixframe.plans.registry import QUERIES
    from tests.conftest import DATA

    text = plan(QUERIES["weighted_similarity"](spark, str(DATA)))
    assert "hashpartitioning(i" not in text and "keys=[i" not in text


@pytest.fixture
def sorting(spark):
    """Spark broadcasts nothing by itself."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("broadcast", [True, False])
def test_norm(spark, sorting, monkeypatch, broadcast):
    """cells were shuffled and sorted by row, then by column."""
    from helixframe import runtime

    monkeypatch.setattr(runtime, "SMALL", 10**6 if broadcast else 0)
    rows = [*cells(5), (None, 3, 2.0), (4, None, 50.0)]
    df = matrix.norm(spark.createDataFrame(rows, "i long, j long, score double"))
    top_i, top_j = {}, {}
    for i, j, s in rows:
        top_i[i], top_j[j] = max(s, top_i.get(i, s)), max(s, top_j.get(j, s))
    want = {(i, j): s / t if (t := min(top_i[i], top_j[j])) else 0.0 for i, j, s in rows}
    got = df.collect()
    assert len(got) == len(rows) and {(x.i, x.j): x.score for x in got} == want
    assert ("Exchange hashpartitioning" in plan(df)) != broadcast


def test_efi_shuffles_no_cells(spark, sorting):
    """cells were shuffled and sorted twice to meet their lengths."""
    from math import log10

    rows, lengths = cells(6), [(i, 1 + i % 7) for i in range(39)]
    df = matrix.efi(spark.createDataFrame(rows, "i long, j long, score double"), spark.createDataFrame(lengths, "id long, length long"))
    assert "Exchange hashpartitioning" not in plan(df)
    n = dict(lengths)
    want = {(i, j): v for i, j, s in rows if i in n and j in n and (v := s * log10(2) - log10(n[i]) - log10(n[j])) > 0}
    assert {(x.i, x.j): x.score for x in df.collect()} == pytest.approx(want)


def test_dense_matrices(spark, blocks):
    rows = cells(7)
    m, labels = spark.createDataFrame(rows, "i long, j long, score double"), spark.range(2, 45)
    at = {(i, j): s for i, j, s in rows}
    all_cells = {(i, j) for i in range(2, 45) for j in range(2, 45)}
    got = matrix.dense(m, labels).collect()
    assert len(got) == len(all_cells) and {(x.i, x.j): x.score for x in got} == {k: at.get(k, 0.0) for k in all_cells}
    normed = {(x.i, x.j): x.score for x in matrix.norm(m).collect()}
    got = matrix.distance(m, labels).collect()
    assert len(got) == len(all_cells) and {(x.i, x.j): x.score for x in got} == {k: 1 - normed.get(k, 0.0) for k in all_cells}
    assert matrix.dense(m, labels.where("id < 0")).count() == 0
    with pytest.raises(ValueError):
        matrix.dense(m, labels, max_cells=100)


def test_distance_of_many_labels(spark):
    """more than 100,000,000 cells were refused."""
    m = spark.createDataFrame([(1, 2, 3.0)], "i long, j long, score double")
    df = matrix.distance(m, spark.range(10_001))
    assert len(df.limit(2000).collect()) == 2000


def test_efi_distance_of_many_labels(spark):
    """more than 100,000,000 cells were refused."""
    m, lengths = spark.createDataFrame([(1, 2, 30.0)], "i long, j long, score double"), spark.createDataFrame([(1, 3), (2, 4)], "id long, length long")
    got = matrix.efi_distance(m, lengths, spark.range(10_001))
    assert len(got.limit(2000).collect()) == 2000
    assert matrix.efi_distance(m, lengths, spark.range(5)).where(F.col("score") < 1).select("i", "j").collect() == [(1, 2)]


def test_python_hands_over_rows_of_cells(spark, blocks):
    """a cell was a row between Python and Spark."""
    m = spark.createDataFrame(cells(7), "i long, j long, score double")
    assert matrix.dense(m, spark.range(45)).count() == 45 * 45
    i, j = pa.array([[7, 8, 9]]), pa.array([[1, 2]])
    some = pa.table({"p": pa.array([2], pa.int32()), "q": pa.array([0], pa.int32()), "score": [0.25]})
    got = matrix._filled(1.0, True)((), some, pa.table({"i": i, "j": j}))
    assert got.to_pydict() == {"i": [7, 8, 9], "j": [[1, 2]] * 3, "score": [[1.0, 1.0], [1.0, 1.0], [0.75, 1.0]]}


def test_null_scores_are_absent_cells(spark, blocks):
    """a cell whose score is null became NaN."""
    m = spark.createDataFrame([("a", "b", None), ("b", "a", 2.0), ("b", "c", 4.0)], "i string, j string, score double")
    labels = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    want = {(i, j): 0.0 for i in "abc" for j in "abc"} | {("b", "a"): 2.0, ("b", "c"): 4.0}
    got = matrix.dense(m, labels).collect()
    assert len(got) == 9 and {(x.i, x.j): x.score for x in got} == want
    got = matrix.distance(m, labels).collect()
    assert len(got) == 9 and {(x.i, x.j): x.score for x in got} == {k: 0.0 if v else 1.0 for k, v in want.items()}
