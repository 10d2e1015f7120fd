"""Positions, running totals and ranks are the same in one slice and in many."""

import math

import pytest
from pyspark.sql import functions as F

from barloom.operators import evaluate, order_stats


@pytest.fixture
def many_slices(monkeypatch):
    monkeypatch.setattr(order_stats, "ROWS_PER_SLICE", 20)


@pytest.fixture(scope="module")
def awkward_scores(spark):
    """Two models; NULL, NaN, infinite and many tied scores."""
    def score(i):
        return None if i % 9 == 0 else float("nan") if i % 11 == 0 else math.inf if i == 5 else (i * 7919 % 13) / 13
    rows = [(m, i, score(i + k), int((i * 31 + k) % 3 == 0)) for k, m in enumerate(("a", "b")) for i in range(150)]
    return spark.createDataFrame(rows, "model string, id long, probability double, label int")


def table(df):
    return sorted(map(repr, df.collect()))


def test_scores_in_one_and_many_slices(awkward_scores, monkeypatch):
    jobs = (evaluate.auc_by_model, evaluate.roc_curve)
    whole = [table(job(awkward_scores)) for job in jobs]
    monkeypatch.setattr(order_stats, "ROWS_PER_SLICE", 5)
    assert [table(job(awkward_scores)) for job in jobs] == whole
    known = [(r.probability, r.label) for r in awkward_scores.filter("model = 'a' AND probability IS NOT NULL AND NOT isnan(probability)").collect()]
    pos, neg = [p for p, y in known if y], [p for p, y in known if not y]
    wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert evaluate.auc_by_model(awkward_scores).filter("model = 'a'").first().auc == pytest.approx(wins)


def test_positions_in_one_and_many_slices(spark, many_slices):
    rows = [(i, None if i % 4 == 0 else float("nan") if i % 7 == 0 else 1.0 if i % 2 else float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v double")
    found = [r.id for r in order_stats.with_row_number(df, "v", "id").orderBy("row_number").collect()]
    rank = {None: (0, 0)}
    key = lambda r: (rank.get(r[1]) or ((2, 0) if r[1] != r[1] else (1, r[1])), r[0])
    assert found == [r[0] for r in sorted(rows, key=key)]


def test_one_hot_value_is_cut(spark, many_slices):
    df = spark.createDataFrame([(i, 7) for i in range(100)], "id long, v long")
    cut, n = order_stats.with_slices(df, "v", "id")
    assert n == 5 and cut.groupBy("_slice").count().agg(F.max("count")).first()[0] < 60
    assert [r.id for r in order_stats.with_row_number(df, "v", "id").orderBy("row_number").collect()] == list(range(100))


def test_long_ranks_are_exact(spark):
    base = 2**60
    df = spark.createDataFrame([(base + i, float(i)) for i in range(101)], "a long, b double")
    ranks = order_stats.exact_ranks(df, {"a": [51, 52], "b": [1]})
    assert ranks == {"a": {51: base + 50, 52: base + 51}, "b": {1: 0.0}}
