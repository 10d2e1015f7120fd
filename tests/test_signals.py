import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import exits, labels, swings

T0 = dt.datetime(2024, 3, 7, 15, 0)
BARS = "symbol string, session date, ts timestamp, close double"


def bar_rows(closes, symbol="a", start=T0, step=60):
    return [(symbol, start.date(), start + dt.timedelta(seconds=step * i), float(c)) for i, c in enumerate(closes)]


def lows_highs(x, order):
    n, lows, highs = len(x), [], []
    for i in range(1, n - 1):
        around = [x[j] for j in range(max(0, i - order), min(n, i + order + 1)) if j != i]
        if all(x[i] < v for v in around):
            lows.append(i)
        if all(x[i] > v for v in around):
            highs.append(i)
    return lows, highs


def gap_filter(idx, limit):
    kept = []
    for j, i in enumerate(idx):
        if j == 0 or i - idx[j - 1] <= limit:
            kept.append(i)
    return kept


def strict_loop(x, order, limit):
    lows, highs = lows_highs(x, order)
    found, prev_low, seen = [], None, []
    for i in range(len(x)):
        if i in highs:
            seen.append(x[i])
        if i in lows:
            if prev_low is not None and len(seen) >= 2 and x[i] > prev_low and seen[-1] > seen[-2]:
                found.append(i)
            prev_low = x[i]
    return gap_filter(found, limit)


def adaptive_loop(x, window, limit):
    s = np.array(x)
    n = len(s)
    rng = [np.ptp(s[i - 19:i + 1]) if i >= 19 else np.nan for i in range(n)]
    short = np.mean(rng[-20:]) if n >= 39 else 0.0
    long = np.mean(rng[-100:]) if n >= 119 else 1.0
    q = short / long if long else 1.0
    order = min(window + 2, 8) if q > 1.5 else max(window - 1, 2) if q < 0.7 else window
    lows, _ = lows_highs(x, order)
    found = [lows[j] for j in range(2, len(lows)) if x[lows[j]] > x[lows[j - 1]] and x[lows[j]] > x[lows[j - 2]]]
    return gap_filter(found, limit), order


@pytest.mark.parametrize("window", [4, 6])
def test_swing_lows_equal_loops(spark, window):
    rng = np.random.default_rng(3)
    series = {f"s{i}": (100 + np.cumsum(rng.normal(0, 0.1 * (1 + (i % 3)), 60 + 40 * i))).round(2) for i in range(5)}
    # calm start and wild end (order up), wild start and calm end (order down)
    series["wild"] = np.concatenate([100 + 0.01 * rng.normal(size=150), 100 + np.cumsum(rng.normal(0, 1, 40))]).round(2)
    series["calm"] = np.concatenate([100 + np.cumsum(rng.normal(0, 1, 150)), 100 + 0.01 * rng.normal(size=60)]).round(2)
    bars = spark.createDataFrame([r for k, x in series.items() for r in bar_rows(x, k)], BARS)
    df = swings.flag_strict_lows(bars, window=window, max_gap_minutes=25, vwap_tolerance=None)
    df = swings.flag_adaptive_lows(df, window=window, max_gap_minutes=25, vwap_tolerance=None)
    rows = df.collect()
    orders = set()
    for k, x in series.items():
        at = {int((r["ts"] - T0).total_seconds() // 60): r for r in rows if r["symbol"] == k}
        assert [i for i in sorted(at) if at[i]["is_strict_low"]] == strict_loop(list(x), window, 25)
        want, order = adaptive_loop(list(x), window, 25)
        orders.add(order)
        assert {r["adaptive_order"] for r in at.values()} == {order}
        assert [i for i in sorted(at) if at[i]["is_adaptive_low"]] == want
    assert len(orders) == 3


def test_strict_comparison_and_edges(spark):
    bars = spark.createDataFrame(bar_rows([1, 2, 2, 1, 1, 3, 0]), BARS)
    rows = swings.local_extrema(bars, order=1).orderBy("ts").collect()
    assert [r["is_low"] for r in rows] == [False] * 7
    assert [r["is_high"] for r in rows] == [False] * 5 + [True, False]


def test_vwap_tolerance_is_strict(spark):
    df = spark.createDataFrame([(10.0, 15.0), (10.5, 15.0)], "close double, vwap double")
    got = df.select(swings._near_vwap("close", 5.0, df.columns).alias("x")).collect()
    assert [r["x"] for r in got] == [False, True]


def test_nearest_minute_prefers_the_earliest(spark):
    points = spark.createDataFrame([("a", T0), ("a", T0 + dt.timedelta(minutes=10))], "symbol string, ts timestamp")
    minutes = spark.createDataFrame(
        [("a", T0 - dt.timedelta(minutes=1)), ("a", T0 + dt.timedelta(minutes=1)), ("b", T0)], "symbol string, minute timestamp"
    )
    got = swings.nearest_minute(points, minutes).collect()
    assert [(r["ts"], r["minute"]) for r in got] == [(T0, T0 - dt.timedelta(minutes=1))]


# --- labels -------------------------------------------------------------------------------------

LEVELS = {"Current_Price": 100.0, "1R_Stop_Loss": 99.0, "ATR_Distance": 1.0, "1R_Target": 101.0, "2R_Target": 102.0}


def label(spark, closes, levels=LEVELS, step=60, **more):
    bars = spark.createDataFrame(bar_rows([100, *closes], step=step), BARS)
    entry = spark.createDataFrame([("a", T0.date(), T0, *levels.values())], "symbol string, session date, ts timestamp, " + ", ".join(f"`{k}` double" for k in levels))
    r = labels.label_barriers(entry, bars, **more).first()
    return r["reason"], r["R"], r["time_minutes"], r["buy"]


@pytest.mark.parametrize(
    "closes, want",
    [
        ([99.0, 105], ("reached_negative_1r", 0, 0, False)),
        ([100.5, 102, 101], ("reached_2r_success", 2, 2, True)),
        ([102, 90, 101], ("reached_2r_success", 2, 1, True)),  # the stop no longer counts after 2R
        ([102, 103, 90], ("reached_3r_success", 3, 2, True)),
        ([100, 104.5], ("reached_4r_success", 4, 2, True)),
        ([103, 104.5], ("reached_3r_success", 3, 1, True)),  # 3R ends the search
        ([100.2, 100.4], ("timeout_no_2r", 0, 0, False)),
        ([], ("no_future_data", 0, 0, False)),
        ([100] * 39 + [102], ("reached_2r_success", 2, 40, True)),
        ([100] * 40 + [102], ("timeout_no_2r", 0, 0, False)),
    ],
)
def test_label_paths(spark, closes, want):
    assert label(spark, closes) == want


def test_label_outer_window_and_screen(spark):
    assert label(spark, [102], step=60 * 241)[0] == "no_data_in_time_window"
    assert label(spark, [102], step=60 * 240)[0] == "timeout_no_2r"
    bad = {**LEVELS, "1R_Target": float("nan"), "ATR_Distance": 0.0}
    assert label(spark, [102], bad)[0] == "missing_or_invalid_1r_target"


def test_screen_spread(spark):
    df = spark.createDataFrame([(*LEVELS.values(), 99.9, 100.5), (*LEVELS.values(), 99.9, 100.3)], ", ".join(f"`{k}` double" for k in LEVELS) + ", bid_px double, ask_px double")
    assert [r["screen_reason"] for r in labels.screen(df).collect()] == ["spread_too_wide", "conditions_met"]


# --- exits --------------------------------------------------------------------------------------


def loop_exit(entry, bars):
    for ts, close in bars:
        if ts < entry["ts"]:
            continue
        if close <= entry["stop"]:
            return ts, "STOP_LOSS"
        if close >= entry["target"]:
            return ts, "TAKE_PROFIT"
        ny = ts - dt.timedelta(hours=5)  # winter time
        if ny.weekday() < 5 and ny.time() >= dt.time(15, 45):
            return ts, "MARKET_CLOSE"
    return None, None


def test_first_position_of_a_tree_equals_a_scan():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 8, 100, 1000):
        price = np.round(100 + rng.normal(0, 1, n).cumsum(), 1)
        price[rng.random(n) < 0.05] = np.nan
        always = rng.random(n) < 0.01
        start = rng.integers(0, n + 1, 300)
        stop, target = 100 - rng.exponential(3, 300), 100 + rng.exponential(3, 300)
        found = exits.ExtremeTree(price, price, always).first(start, stop, target)
        for i in range(300):
            ends = [j for j in range(start[i], n) if price[j] <= stop[i] or price[j] >= target[i] or always[j]]
            assert found[i] == (ends[0] if ends else -1)


@pytest.mark.parametrize("together", [50_000, 7])
def test_exits_equal_loops_over_days_and_weekends(spark, monkeypatch, together):
    """Also with a key whose probes are dealt into parts, each of which meets the whole series."""
    monkeypatch.setattr(exits, "PROBES_TOGETHER", together)
    rnd = random.Random(5)
    start = dt.datetime(2024, 1, 4, 15, 0)  # a Thursday
    bars, price = [], 100.0
    for day in range(6):
        for i in range(0, 380, 7):
            price *= 1 + rnd.gauss(0, 0.002)
            if day != 1 or i < 200:  # the second day ends early, so positions stay open over the weekend
                bars.append((start + dt.timedelta(days=day, minutes=i), round(price, 3)))
    entries = [
        {"id": i, "ts": ts, "price": p, "stop": p * (1 - s), "target": p * (1 + s)}
        for i, ((ts, p), s) in enumerate(zip(bars, [rnd.choice([0.002, 0.01, 0.03, 0.2]) for _ in bars], strict=True))
    ]
    edf = spark.createDataFrame(
        [(e["id"], "a", e["ts"], e["price"], 1000.0, e["stop"], e["target"]) for e in entries],
        "entry_id long, symbol string, ts timestamp, current_price double, budget double, stop_loss_price double, take_profit_price double",
    )
    bdf = spark.createDataFrame([("a", t, c) for t, c in bars], "symbol string, ts timestamp, close double")
    got = {r["entry_id"]: r for r in exits.bracket_exits(edf, bdf).collect()}
    assert len(got) == len(entries)
    reasons = set()
    for e in entries:
        ts, why = loop_exit(e, bars)
        reasons.add(why)
        assert (got[e["id"]]["exit_ts"], got[e["id"]]["exit_reason"]) == (ts, why)
        assert got[e["id"]]["status"] == ("OPEN" if ts is None else "CLOSED")
    assert reasons >= {"STOP_LOSS", "TAKE_PROFIT", "MARKET_CLOSE"}


def test_costs_and_default_brackets(spark):
    edf = spark.createDataFrame([(1, "a", T0, 100.0, 1000.0), (2, "a", T0, 100.0, 50.0)], "entry_id long, symbol string, ts timestamp, current_price double, budget double")
    bdf = spark.createDataFrame([("a", T0 + dt.timedelta(minutes=3), 105.0)], "symbol string, ts timestamp, close double")
    (r,) = exits.bracket_exits(edf, bdf).collect()  # the second entry affords no share
    assert r["quantity"] == 9 and r["exit_reason"] == "TAKE_PROFIT"
    assert r["stop_loss_price"] == pytest.approx(100.1 * 0.98) and r["take_profit_price"] == pytest.approx(100.1 * 1.04)
    assert r["net_pnl"] == pytest.approx(9 * 105 * 0.999 - 1 - (9 * 100.1 + 1))
    assert r["buy_sell_duration_minutes"] == pytest.approx(3.0) and r["commission_paid"] == 2.0


def test_one_position_at_a_time(spark):
    m = dt.timedelta(minutes=1)
    rows = [(1, "a", T0, T0 + 5 * m), (2, "a", T0 + 2 * m, T0 + 9 * m), (3, "a", T0 + 5 * m, None), (4, "a", T0 + 8 * m, T0 + 9 * m), (5, "b", T0 + m, T0 + 2 * m)]
    df = spark.createDataFrame(rows, "entry_id long, symbol string, ts timestamp, exit_ts timestamp")
    assert sorted(r["entry_id"] for r in exits.one_position_at_a_time(df).collect()) == [1, 3, 5]
    assert df.filter(F.col("entry_id").isNull()).count() == 0


def test_positions_across_days_equal_a_loop(spark):
    rnd = random.Random(8)
    rows, i = [], 0
    for symbol in "ab":
        for day in range(12):
            for minute in sorted(rnd.sample(range(400), rnd.randint(0, 9))):
                start = T0 + dt.timedelta(days=day, minutes=minute)
                length = rnd.choice([0, 5, 60, 300, 1500, 3000, 6000])
                rows.append((i, symbol, start, start + dt.timedelta(minutes=length) if rnd.random() > 0.02 else None))
                i += 1
    df = spark.createDataFrame(rows, "entry_id long, symbol string, ts timestamp, exit_ts timestamp")
    kept, until = [], {}
    for i, symbol, start, end in rows:
        if symbol not in until or (until[symbol] is not None and start >= until[symbol]):
            kept.append(i)
            until[symbol] = end
    found = exits.one_position_at_a_time(df)
    assert found.columns == df.columns and sorted(r["entry_id"] for r in found.collect()) == kept


def test_small_groups_are_looked_up_together(spark, monkeypatch):
    """Many groups share a tree: a search ends at its own group's last value, wherever the tables are cut."""
    monkeypatch.setattr(exits, "ROWS_TOGETHER", 7)
    probes = [(s, d, f"{s}{d}{i}", i, 1.0, 9.0) for s in "abc" for d in range(20) for i in range(3)]
    series = [(s, d, i, 5.0 if (d + i) % 3 else 0.5, 5.0, False) for s in "abd" for d in range(20) for i in range(d % 5)]
    p = spark.createDataFrame(probes, "symbol string, day int, entry_id string, after long, stop double, target double")
    rows = spark.createDataFrame(series, "symbol string, day int, at long, low double, high double, closing boolean")
    out = exits.first_in_series(p, rows, ["symbol", "day"])
    assert "FlatMapCoGroups" not in out._jdf.queryExecution().executedPlan().toString()
    want = {}
    for s, d, name, after, *_ in probes:
        hit = [x[2] for x in sorted(series) if x[:2] == (s, d) and x[2] >= after and x[3] <= 1.0]
        want |= {name: hit[0]} if hit else {}
    assert {r["entry_id"]: r["at"] for r in out.collect()} == want and want
