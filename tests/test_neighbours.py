import math
import random

import pytest

from barloom.operators import order_stats
from barloom.operators.neighbours import neighbour_information

EULER = 0.5772156649015329


def digamma(n):
    return sum(1 / i for i in range(1, n)) - EULER


def loop(rows, k=3):
    """One feature: every pair of rows."""
    rows = [(y, x) for y, x in rows if y is not None and x is not None and not math.isnan(x)]
    size = {y: sum(c == y for c, _ in rows) for y, _ in rows}
    rows = [(y, x) for y, x in rows if size[y] > 1]
    total = 0.0
    for i, (y, x) in enumerate(rows):
        own = min(k, size[y] - 1)
        r = sorted(abs(b - x) for j, (c, b) in enumerate(rows) if c == y and j != i)[own - 1]
        m = sum(abs(b - x) < r if r > 0 else b == x for _, b in rows)
        total += digamma(own) - digamma(size[y]) - digamma(m)
    return max(0.0, digamma(len(rows)) + total / len(rows)) if rows else 0.0


def table(n, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        y = rng.choice(["a", "a", "b", "c"])
        near = {"a": 0, "b": 200, "c": 500}[y] + rng.randint(0, 400)
        rows.append((y, float(near), float(rng.randint(0, 10**6)), float(rng.randint(0, 5)), float("nan") if rng.random() < 0.1 else None if rng.random() < 0.1 else float(near)))
    return rows + [("alone", 5.0, 5.0, 5.0, 5.0), (None, 1.0, 2.0, 3.0, 4.0), ("pair", 9.0, 9.0, 9.0, 9.0), ("pair", 700.0, 70.0, 2.0, 9.0)]


@pytest.mark.parametrize("slice_rows", [1_000_000, 40])
def test_equals_a_loop_over_all_pairs(spark, monkeypatch, slice_rows):
    """Also where values are sorted in many slices, whose first and last rows have neighbours in others."""
    monkeypatch.setattr(order_stats, "ROWS_PER_SLICE", slice_rows)
    rows = table(400, 1)
    names = ["near", "noise", "few", "holes"]
    df = spark.createDataFrame(rows, "y string, near double, noise double, few double, holes double")
    got = dict(neighbour_information(df, "y", names).collect())
    for i, name in enumerate(names, 1):
        assert got[name] == pytest.approx(loop([(r[0], r[i]) for r in rows]), abs=1e-9)
    assert got["near"] > 0.2 > got["noise"]


def test_nothing_to_compare(spark):
    schema = "y string, v double"
    for rows in ([], [("a", 1.0), ("b", 2.0)], [("a", None), (None, 2.0)]):
        assert neighbour_information(spark.createDataFrame(rows, schema), "y", ["v"]).collect() == [("v", 0.0)]
    equal = spark.createDataFrame([("a", 1.0)] * 6 + [("b", 1.0)] * 3, schema)
    assert neighbour_information(equal, "y", ["v"]).first()["mi_score"] == pytest.approx(loop([("a", 1.0)] * 6 + [("b", 1.0)] * 3))
