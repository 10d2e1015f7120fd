"""Averages and ranks of long sessions against plain loops, with sessions cut into many ranges."""

from __future__ import annotations

import random

import numpy as np
import pytest

from barloom.operators import long_sessions, order_stats


def plain(values, alpha):
    out = []
    for x in (0.0 if v is None else v for v in values):
        out.append(x if not out else out[-1] + alpha * (x - out[-1]))
    return out


@pytest.fixture
def sessions(spark, monkeypatch):
    """Three sessions, one of them without a symbol, and far fewer rows to a range than a session has."""
    monkeypatch.setattr(order_stats, "ROWS_PER_SLICE", 60)
    rng = random.Random(7)
    values = {"a": [rng.choice([None, float("nan"), *map(float, range(12))]) for _ in range(400)], "b": [3.0], None: [float(i % 5) for i in range(90)]}
    rows = [(s, i * 3, v) for s, vs in values.items() for i, v in enumerate(vs)]
    rng.shuffle(rows)
    return values, spark.createDataFrame(rows, "symbol string, ts long, v double")


def test_ranks_over_ranges(sessions):
    values, df = sessions
    got = {(r["symbol"], r["k"]): r["earlier_at_most"] for r in long_sessions.ranks_before(df, ["symbol"], "ts", "v").collect()}
    order = {s: [None if v is None else (np.isnan(v), 0.0 if np.isnan(v) else v) for v in vs] for s, vs in values.items()}
    want = {(s, i): 0 if v is None else sum(u is not None and u <= v for u in vs[:i]) for s, vs in order.items() for i, v in enumerate(vs)}
    assert got == want


def test_averages_over_ranges(sessions):
    values, df = sessions
    df = df.replace(float("nan"), 40.0, "v")
    weights = {"slow": 0.001, "usual": 0.3, "whole": 1.0}
    got = {(r["symbol"], r["k"]): r for r in long_sessions.averages(df, ["symbol"], "ts", "v", weights).collect()}
    assert len(got) == 491
    for s, vs in values.items():
        vs = [40.0 if v is not None and np.isnan(v) else v for v in vs]
        for name, a in weights.items():
            assert [got[s, i][name] for i in range(len(vs))] == pytest.approx(plain(vs, a), rel=1e-12, abs=1e-12)


def test_no_task_holds_a_session(sessions):
    """A range is what a group of rows is: the plans group by ranges, none sorts or windows the rows of a whole session."""
    _, df = sessions
    for out in (long_sessions.averages(df, ["symbol"], "ts", "v", {"e": 0.1}), long_sessions.ranks_before(df, ["symbol"], "ts", "v")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "_slice" in plan and "Window" not in plan


def test_smaller_before():
    for n in (0, 1, 2, 7, 64, 100):
        seq = np.random.default_rng(n).permutation(n)
        got = long_sessions.smaller_before(seq)
        assert [got[x] for x in seq] == [int((seq[:i] < x).sum()) for i, x in enumerate(seq)]
