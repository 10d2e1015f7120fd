import bisect
import datetime as dt
import math
import random
import warnings

import numpy as np
import pytest
from bars_fixture import fixture_frames, session_frame, to_spark
from loop_features import features as loop_features
from pyspark.sql import functions as F

from barloom.functions.frames import BLOCK, FrameText, ema_block
from barloom.functions.text import apply_levels
from barloom.operators.daily_context import daily_context
from barloom.operators.session_series import ema_sums, series_levels
from barloom.plans.features import feature_groups, feature_names, feature_table, feature_table_in_passes

DAILY = "symbol string, date date, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def daily_rows():
    day = dt.date(2024, 3, 7)
    rows = [("walk", day - dt.timedelta(days=i), 90.0 + i, 0.0, 0.0, 80.0 + i, 1.0) for i in range(60)]
    rows += [("flat", day - dt.timedelta(days=i + 1), 95.0, 0.0, 0.0, 99.0 - i, 1.0) for i in range(4)]
    return rows


@pytest.fixture(scope="module")
def computed(spark, daily_rows):
    bars = to_spark(spark, fixture_frames())
    daily = spark.createDataFrame(daily_rows, DAILY)
    rows = feature_table(bars, daily).orderBy("symbol", "ts").collect()
    return {(r["symbol"], r["n_hist"]): r for r in rows}


@pytest.mark.parametrize("kind", ["walk", "flat", "up", "down"])
def test_features_equal_loops(computed, kind):
    seeds = {"walk": 1, "flat": 2, "up": 3, "down": 4}
    bars = session_frame(kind, seed=seeds[kind]).to_dict("records")
    # walk: today's row and 59 earlier ones, flat: 4 earlier rows and none today
    day_open = {"walk": 90.0, "flat": 95.0}.get(kind)
    daily_mean = {"walk": np.mean([80.0 + i for i in range(1, 50)]), "flat": np.mean([99.0, 98, 97, 96])}.get(kind)
    for i, now in enumerate(bars):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            want = loop_features(bars[:i], now, day_open, daily_mean)
        got = computed[(kind, i)]
        for name, value in want.items():
            seen = got[name]
            if value is None:
                assert seen is None, (kind, i, name, seen)
            else:
                assert seen is not None and seen == pytest.approx(value, rel=1e-8, abs=1e-9), (kind, i, name)


def test_no_lookahead(spark):
    pdf = session_frame("walk", 90)
    names = feature_names(to_spark(spark, pdf).columns)
    whole = feature_table(to_spark(spark, pdf)).filter("n_hist = 60").select(*names).first()
    cut = feature_table(to_spark(spark, pdf.iloc[:61])).filter("n_hist = 60").select(*names).first()
    assert whole == cut


def test_only_needed_columns_are_planned(spark):
    bars = to_spark(spark, session_frame("walk", 20))
    plan = feature_table(bars, columns=["Return_5min"])._jdf.queryExecution().optimizedPlan().toString()
    assert "stddev" not in plan and "_spreads20" not in plan and "_closes30" in plan


def test_every_level_reads_only_earlier_levels(spark):
    bars = to_spark(spark, session_frame("walk", 20))
    columns = bars.columns
    optional = ["Market_Regime", "Bollinger_Bands_Upper"]
    for name in [*feature_names(columns), *optional]:
        feature_table(bars, columns=[name]).schema  # analysis fails on an unknown column


def test_trade_count_and_missing_quotes(spark):
    bars = to_spark(spark, session_frame("walk", 30)).drop("bid_px", "ask_px", "bid_sz", "ask_sz")
    bars = bars.withColumn("trade_count", F.minute("ts") * 10.0)
    rows = feature_table(bars, columns=["n_hist", "Trade_Count_Per_Minute_Log", "Order_Book_Stability", "Bid_Ask_Spread_Pct", "Mid_Price_Momentum"]).collect()
    by_n = {r["n_hist"]: r for r in rows}
    assert by_n[0]["Trade_Count_Per_Minute_Log"] == 0.0
    assert by_n[1]["Trade_Count_Per_Minute_Log"] == 100.0
    assert by_n[10]["Bid_Ask_Spread_Pct"] is None and by_n[10]["Order_Book_Stability"] == 0.5
    assert by_n[4]["Mid_Price_Momentum"] is None and by_n[5]["Mid_Price_Momentum"] is not None


def test_daily_context_falls_back_to_earlier_days(spark):
    d = dt.date(2024, 1, 1)
    daily = spark.createDataFrame([("a", d, 10.0, 0.0, 0.0, 11.0, 0.0), ("a", d + dt.timedelta(2), 20.0, 0.0, 0.0, 21.0, 0.0)], DAILY)
    days = spark.createDataFrame([("a", d + dt.timedelta(i)) for i in range(4)] + [("b", d)], "symbol string, date date")
    got = {(r["symbol"], (r["date"] - d).days): (r["day_open"], r["daily_mean50"]) for r in daily_context(daily, days).collect()}
    assert got == {("a", 0): (10.0, None), ("a", 1): (10.0, 11.0), ("a", 2): (20.0, 11.0), ("a", 3): (20.0, 16.0), ("b", 0): (None, None)}


@pytest.mark.parametrize("alpha", [0.001, 2 / 31, 0.05, 1 / 14, 0.3, 0.6, 0.7, 0.95, 0.999, 1.0])
def test_averages_of_long_sessions(spark, alpha):
    """Sessions of several blocks: recursive averages of any weight equal a loop, however long the session."""
    n = 3 * BLOCK + 17 if alpha > 0.01 else 2 * ema_block(alpha) + 100
    rows = [("a", "s", i, 100 + (i * 37 % 101) / 7) for i in range(n)]
    fr = FrameText()
    df = apply_levels(
        spark.createDataFrame(rows, "symbol string, session string, ts long, close double"),
        [{"k": fr.index()}, ema_sums(fr, {"e": ("close", alpha)}, "k"), {"e": fr.ema_of("e", "k", alpha)}],
    )
    got = {r.ts: r.e for r in df.collect()}
    e = rows[0][3]
    for i, (_, _, _, x) in enumerate(rows):
        e = e if i == 0 else e + (x - e) * alpha
        assert got[i] == pytest.approx(e, rel=1e-12)


@pytest.mark.parametrize("alpha", [0.0, -0.1, 1.5])
def test_weights_outside_their_range_are_refused(alpha):
    with pytest.raises(ValueError):
        FrameText().ema_sums("close", "k", alpha)


def test_rank_among_earlier_values_of_a_long_session(spark):
    """20,000 bars: the rank equals a sorted list that grows bar by bar; NULL is compared as 0 and never counted."""
    rng = random.Random(3)
    values = [None if i % 97 == 5 else float("nan") if i % 1013 == 7 else float(rng.randint(0, 3_000)) for i in range(20_000)]
    fr = FrameText()
    df = spark.createDataFrame([("a", "s", i, v) for i, v in enumerate(values)], "symbol string, session string, ts long, volume double")
    df = apply_levels(df, [
        {"_n": fr.index(), "_volume": "coalesce(volume, 0D)", "_near": fr.rank_near("volume")}, fr.rank_digits("_n"), fr.rank_sums("_volume", "volume IS NOT NULL"),
        {"r": fr.rank_before("_n", "_volume", "_near")},
    ])
    got = [r["r"] for r in df.orderBy("ts").collect()]
    seen: list[float] = []
    for v, r in zip(values, got):
        now = 0.0 if v is None else math.inf if math.isnan(v) else v
        assert r == bisect.bisect_right(seen, now)
        if v is not None:
            bisect.insort(seen, now)


def test_sessions_longer_than_stated_are_refused(spark):
    n = 64 * 32 + 1
    bars = spark.createDataFrame([("a", "s", i, 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(n)], "symbol string, session string, ts long, open double, high double, low double, close double, volume double")
    name = ["Volume_Percentile_Intraday"]
    assert feature_table(bars, columns=name).count() == n
    with pytest.raises(Exception, match="session_bars"):
        feature_table(bars, columns=name, session_bars=n - 1).collect()


def test_projection_holds_no_long_lists(spark):
    """A session of many bars: no column of any level is a list of more than 100 values."""
    n = 3_000
    rows = [("a", "s", i, 10.0, 11.0 + i % 7, 9.0 - i % 5, 10.0 + i % 3, float(i % 50)) for i in range(n)]
    bars = spark.createDataFrame(rows, "symbol string, session string, ts long, open double, high double, low double, close double, volume double")
    levels = series_levels(FrameText(), bars.columns)
    df = apply_levels(bars, levels)
    lists = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    assert lists and all(v <= 100 for v in df.selectExpr(*[f"max(size({c}))" for c in lists]).first())


def test_day_sessions_share_one_exchange(spark, daily_rows):
    bars = to_spark(spark, fixture_frames())
    daily = spark.createDataFrame(daily_rows, DAILY)
    names = ["Return_Since_Open", "Price_vs_SMA50", "RSI_14"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shared = feature_table(bars, daily, columns=names, day_sessions=True)
        split = feature_table(bars, daily, columns=names)
        keys = ["symbol", "ts", *names]
        assert shared.select(keys).exceptAll(split.select(keys)).count() == 0
        plan = shared._jdf.queryExecution().executedPlan().toString()
        top = plan.split("SortMergeJoin")[0]
        assert "Exchange" not in top  # the windows sit on the join's own partitioning
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_passes_give_the_features_of_one_projection(spark, daily_rows):
    bars, daily = to_spark(spark, fixture_frames()), spark.createDataFrame(daily_rows, DAILY)
    names = feature_names(bars.columns)
    groups = feature_groups(names, bars.columns)
    assert len(groups) > 1 and sorted(n for g in groups for n in g) == sorted(names)
    # a feature that others of a later pass are made from, and features that need no window
    some = ["n_hist", "ATR_Pct", "RSI_14", "RSI_Regime", "Price_vs_SMA50", "Time_Of_Day_Cyclical_Sin", "Volume_Zscore_Intraday"]
    for most in (5, 18):
        split = feature_table_in_passes(bars, daily, min_history=15, columns=some, most=most)
        once = feature_table(bars, daily, min_history=15, columns=some)
        assert split.columns == once.columns and split.count() == once.count()
        assert split.exceptAll(once).count() == 0
