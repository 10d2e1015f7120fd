import datetime as dt
import gzip

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators import clean, evaluate, models, order_stats, prepare, reports
from barloom.sources import bars as B
from barloom.sources import stores
from barloom.streaming import live, quotes


@pytest.fixture()
def numbers(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25), rng.exponential(100, 500)])
    rng.shuffle(x)
    return x, spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "x": x}))


def test_ranks_are_exact_when_brackets_narrow(numbers, monkeypatch):
    x, df = numbers
    monkeypatch.setattr(order_stats, "BRACKET_ROWS", 50)
    s = np.sort(x)
    ranks = [1, 2, 77, 1500, 2500, 2501, 4999, 5000]
    got = order_stats.exact_ranks(df, {"x": ranks}, accuracy=100)["x"]
    assert got == {r: s[r - 1] for r in ranks}
    assert order_stats.exact_medians(df, ["x"])["x"] == np.median(x)


def test_empty_column_has_no_median(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert order_stats.exact_medians(df, ["x"]) == {"x": None}
    assert prepare.impute(df).filter("x IS NULL").count() == 2


def test_folds_are_equal_in_every_class(spark):
    df = spark.range(1003).selectExpr("id", "CASE WHEN id % 10 = 0 THEN 1 WHEN id = 7 THEN NULL ELSE 0 END AS buy")
    sizes = {}
    for r in models.with_folds(df, "buy", ["id"], 5).groupBy("buy", "fold").count().collect():
        sizes.setdefault(r.buy, []).append(r["count"])
    assert sorted(sizes[1]) == [20, 20, 20, 20, 21] and sorted(sizes[0]) == [180, 180, 180, 180, 181]
    assert sizes[None] == [1]  # fewer rows than folds
    assert models.with_folds(df.limit(0), "buy", ["id"], 5).count() == 0


def test_samples_are_exact_under_skew(spark):
    df = spark.range(30_000).select("id", (F.col("id") % 50 == 0).alias("buy"))
    got = prepare.balanced_sample(df, "buy", 1000, ["id"]).groupBy("buy").count().collect()
    assert {r["buy"]: r["count"] for r in got} == {True: 500, False: 500}
    up = prepare.upsample_minority(df, "buy", 4000, ["id"]).groupBy("buy").count().collect()
    assert {r["buy"]: r["count"] for r in up} == {True: 2000, False: 2000}
    assert prepare.upsample_minority(df, "buy", 30_000, ["id"]).filter("copy > 0").count() == 0  # within the target: as it is
    tied = spark.range(100).select("id", (F.col("id") / 10).cast("int").alias("day"), F.lit(None).cast("string").alias("x"))
    recent = [r["day"] for r in prepare.recent_sample(tied, 25, "day", ["id"]).collect()]
    assert len(recent) == 25 and sorted(recent) == [7] * 5 + [8] * 10 + [9] * 10
    again = prepare.balanced_sample(df, "buy", 1000, ["id"]).exceptAll(prepare.balanced_sample(df, "buy", 1000, ["id"]))
    assert again.count() == 0
    splits = {r["split"]: r["count"] for r in prepare.stratified_split(df, "buy", ["id"]).groupBy("split").count().collect()}
    assert splits == {"test": 4500, "val": 3826, "train": 21674}


def test_running_totals_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "ROWS_PER_SLICE", 100)
    rng = np.random.default_rng(2)
    p = np.round(rng.random(3000), 3)
    y = (rng.random(3000) < p).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"model": "m", "probability": p, "label": y}))
    pos, neg = p[y == 1], p[y == 0]
    want = np.mean([(a > neg).mean() + 0.5 * (a == neg).mean() for a in pos])
    assert evaluate.auc_by_model(df).first()["auc"] == pytest.approx(want, abs=1e-12)
    numbered = order_stats.with_row_number(df.withColumn("id", F.monotonically_increasing_id()), "probability", "id").collect()
    assert [r["row_number"] for r in sorted(numbered, key=lambda r: (r["probability"], r["id"]))] == list(range(1, 3001))


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([("m", 0.2, 1), ("m", 0.9, 1)], "model string, probability double, label int")
    assert evaluate.auc_by_model(df).first()["auc"] is None
    assert [r["threshold"] for r in evaluate.threshold_sweep(df).orderBy("threshold").collect()][-1] == 0.9


def test_cleaner_limits(spark):
    values = [-200.5, -100.0, -0.1, 0.0, 50.0, 100.0, 150.0, 200.0, 200.5, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, RSI_14 double")
    got = [r["RSI_14"] for r in clean.clean_features(df).orderBy("i").collect()]
    assert got == [None, None, None, 0.0, 50.0, 100.0, 100.0, 100.0, None, None, None, None]


def test_cleaner_drops_redundant_and_text(spark):
    df = spark.createDataFrame([(1.0, 2.0, "x", 3.0)], "Return_Since_Open_Enhanced double, Return_since_open double, RSI_Regime string, VWAP double")
    r = clean.clean_features(df, report=True).first()
    assert "RSI_Regime" not in r and "VWAP" not in r and r["Return_since_open"] is None
    assert r["missing_categories"] == ["momentum", "risk", "volume", "pattern"] and r["few_features"]


def test_optimizer_scales_and_bounds(spark):
    df = spark.createDataFrame([(0.5, -30.0, -60.0), (50.0, 3.0, -10.0)], "Spread_Percentile_20 double, Return_5min double, Max_Drawdown_30 double")
    got = [tuple(r) for r in clean.optimize_features(df).select("Spread_Percentile_20", "Return_5min", "Max_Drawdown_30").collect()]
    assert got == [(0.005, -5.0, -50.0), (0.5, 3.0, -10.0)]


def test_constant_features_do_not_break_statistics(spark):
    df = spark.createDataFrame([(1.0, float(i), i % 2) for i in range(10)], "c double, x double, y int")
    rows = {r["feature"]: r for r in prepare.leakage_report(df, "y", ["c", "x"]).collect()}
    assert rows["c"]["correlation"] is None and not rows["c"]["leaks"]
    assert {r["feature"]: r["f_score"] for r in evaluate.anova_f(df, "y", ["c", "x"]).collect()}["c"] is None
    assert prepare.clip_to_sigmas(df, ["c", "x"]).exceptAll(df).count() == 0
    assert prepare.winsorize(df, ["c", "x"]).exceptAll(df).count() == 0


def test_required_columns_and_aliases(spark):
    with pytest.raises(B.MissingColumnsError, match="close, high"):
        B.require_columns(spark.createDataFrame([(1,)], "open int"), ["open", "high", "close"])
    with pytest.raises(B.MissingColumnsError):
        B.normalize_bars(spark.createDataFrame([(1,)], "open int"))


def test_daily_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "daily.csv")
    rows = [("a", dt.date(2024, 1, 2), 1.0, 2.0, 0.5, 1.5, 10.0)]
    df = spark.createDataFrame(rows, B.DAILY_SCHEMA)
    df.write.option("header", True).csv(path)
    assert [tuple(r) for r in B.read_daily(spark, path).collect()] == rows


def test_monthly_overwrite_replaces_only_written_months(spark, tmp_path):
    path = str(tmp_path / "m")
    schema = "symbol string, timestamp timestamp, v int"
    a = spark.createDataFrame([("s", dt.datetime(2024, 1, 5), 1), ("s", dt.datetime(2024, 2, 5), 1)], schema)
    stores.write_monthly(a, path)
    stores.write_monthly(spark.createDataFrame([("s", dt.datetime(2024, 2, 9), 2)], schema), path, overwrite=True)
    assert sorted((r["ym"], r["v"]) for r in B.read_monthly(spark, path).collect()) == [("2024-01", 1), ("2024-02", 2)]
    assert [r["v"] for r in B.read_monthly(spark, path, ["s"], 2024, 1).collect()] == [1]


def test_store_and_reset(spark, tmp_path):
    path = str(tmp_path / "log")
    row = {"model_id": "m1", "description": "click model", "date_created": dt.datetime(2024, 1, 1)}
    stores.append_row(spark, {**dict.fromkeys(["artifact_path", "best_model"], "x"), **row, "test_auc": 0.7, "test_f1": 0.5, "best_precision": 0.6, "best_signals": 3, "best_threshold": 0.45, "top_feature_1": "a", "top_feature_2": "b", "top_feature_3": "c"}, stores.MODEL_INDEX_SCHEMA, path)
    index = spark.read.parquet(path)
    assert reports.latest_model(index, "CLICK").first()["best_threshold"] == 0.45
    assert reports.latest_model(index, "view").count() == 0
    assert stores.truncate_dataset(spark, path) == 1 and spark.read.parquet(path).count() == 0


def test_ticks_with_equal_times_follow_the_sequence(spark):
    t = dt.datetime(2024, 1, 1, 10, 0, 5)
    rows = [("a", t, 3.0, 1.0, 3), ("a", t, 1.0, 1.0, 1), ("a", t, 2.0, 1.0, 2)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, price double, size double, seq long")
    bar = B.ticks_to_bars(df, seq="seq")
    r = bar.first()
    assert (r["open"], r["close"], r["high"], r["low"], r["volume"]) == (1.0, 3.0, 3.0, 1.0, 3.0)
    assert "SortAggregate" not in bar._jdf.queryExecution().executedPlan().toString()


def test_quote_messages(spark):
    msg = '{"conid": 7, "topic": "smd", "_updated": 1700000000123, "31": "C1,101.25", "84": "bad", "85": "15K", "87": "1.2M"}'
    r = quotes.decode_quotes(spark.createDataFrame([(msg,), ('{"topic": "other"}',)], "value string"), topic="smd").collect()
    assert len(r) == 1
    assert (r[0]["last_price"], r[0]["bid_price"], r[0]["bid_size"], r[0]["volume"]) == (1101.25, None, 15000, 1200000)
    assert r[0]["server_epoch"] == 1700000000.123


def test_late_ticks_are_dropped_and_repeats_removed(spark, tmp_path):
    src = str(tmp_path / "ticks")
    schema = "symbol string, ts timestamp, price double, size double"
    t = dt.datetime(2024, 1, 1, 10, 0)
    m = dt.timedelta(minutes=1)
    batches = [[("a", t, 1.0, 1.0), ("a", t + 20 * m, 2.0, 1.0)], [("a", t + 21 * m, 2.5, 1.0)],
               [("a", t + m / 2, 9.0, 1.0), ("a", t + 40 * m, 3.0, 1.0)]]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(src)
    stream = quotes.stream_table(spark, src, spark.read.parquet(src).schema, max_files=1)
    out = str(tmp_path / "bars")
    q = (quotes.tick_bars(stream).writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    bars = {r["ts"]: r["close"] for r in spark.read.parquet(out).collect()}
    assert bars[t] == 1.0 and bars[t + 20 * m] == 2.0 and t + 40 * m not in bars


def test_live_rows_equal_batch_rows(spark):
    from bars_fixture import session_frame, to_spark

    from barloom.plans.features import feature_table

    bars = to_spark(spark, session_frame("walk", 55))
    want = feature_table(bars).filter("n_hist = 54").select("symbol", "RSI_14", "2R_Target").collect()
    got = live.latest_feature_rows(bars).select("symbol", "RSI_14", "2R_Target").collect()
    assert [r["symbol"] for r in got] == ["walk"] and got[0]["RSI_14"] == pytest.approx(want[0]["RSI_14"])
    assert got[0]["2R_Target"] == want[0]["2R_Target"]


def test_optimizer_removes_nan_and_bounds_infinities(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(nan, nan, nan, nan), (inf, inf, inf, inf)], "MACD_12_26_9 double, Volume_vs_SMA10 double, Volatility_Percentile_100 double, Other double")
    got = [tuple(r) for r in clean.optimize_base(df).collect()]
    assert got == [(None, None, None, None), (2.0, 50.0, 1.0, None)]


def test_live_history_reaches_over_the_day(spark):
    """80 bars yesterday and 5 today: the newest row stands on 59 earlier bars and passes the screen."""
    day = dt.datetime(2024, 3, 7, 15, 0)
    times = [day + dt.timedelta(minutes=i) for i in range(80)] + [day + dt.timedelta(days=1, minutes=i) for i in range(5)]
    rows = [("a", t, t.date(), t.date(), 100.0, 101.0 + i % 3, 99.0 - i % 2, 100.0 + i % 5 / 10, 1000.0) for i, t in enumerate(times)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, session date, trade_date date, open double, high double, low double, close double, volume double")
    names = live.latest_feature_rows(bars).columns
    (r,) = live.latest_feature_rows(bars).collect()
    assert r["n_hist"] == 59 and r["2R_Target"] is not None and "Current_Price" in names
    (s,) = live.assess(live.latest_feature_rows(bars), lambda df: df.withColumns({"prediction": F.lit(1), "probability": F.lit(0.9)})).collect()
    assert (s["screen_reason"], s["prediction"], s["probability"]) == ("conditions_met", 1, 0.9)


def test_schemas_of_writers_at_the_same_time_are_united(spark, tmp_path):
    path = str(tmp_path / "data")
    fields = lambda *names: T.StructType([T.StructField(n, T.LongType()) for n in names])
    stores.save_schema(spark, path, fields("a", "b"))
    seen = stores.load_schema
    first = stores.load_schema(spark, path)
    stores.load_schema = lambda *_: first  # both have read the schema before either writes
    try:
        stores.save_schema(spark, path, fields("a", "c"))
        stores.save_schema(spark, path, fields("b", "d"))
    finally:
        stores.load_schema = seen
    assert sorted(stores.load_schema(spark, path).fieldNames()) == ["a", "b", "c", "d"]
    files = len(list((tmp_path / "data").glob("_schema-*")))
    stores.save_schema(spark, path, fields("d", "a"))
    assert len(list((tmp_path / "data").glob("_schema-*"))) == files
    with pytest.raises(ValueError):
        stores.save_schema(spark, path, T.StructType([T.StructField("a", T.StringType())]))


def test_headers_are_first_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n" + "1,2\n" * 1000)
    (tmp_path / "b.csv").write_text("")
    (tmp_path / "c.csv.gz").write_bytes(gzip.compress(b"p,q\n3,4\n"))
    files = [f"file:{tmp_path}/{n}" for n in ("a.csv", "b.csv", "c.csv.gz")]
    assert list(B._headers(spark, files).values()) == ["x,y", "p,q"]


def test_a_hot_day_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    """One day holds nearly all rows; its folder gets several files, small days one, and no key is lost or repeated."""
    monkeypatch.setattr(stores, "FILE_ROWS", 4_000)
    start = dt.datetime(2024, 3, 5)
    hot = [("s", start + dt.timedelta(seconds=i), i, float(i % 97)) for i in range(20_000)]
    cold = [("s", start + dt.timedelta(days=d), d, 0.0) for d in range(1, 4)] + [("s", None, 9, 0.0)]
    df = spark.createDataFrame(hot + cold, "symbol_price string, ts_event_price timestamp, k long, p double")
    keyed, history = str(tmp_path / "keyed"), str(tmp_path / "history")
    stored = stores.store_keyed(df, keyed, stores.HISTORY_KEYS, "k", "ts_event_price")
    assert stored.count() == stored.select(*stores.HISTORY_KEYS).distinct().count() == 20_004
    loaded = stores.load_history(df, history, "vendor", "k")
    assert {tuple(r) for r in loaded.select("ts_event_price", "p").collect()} == {(t, p) for _, t, _, p in hot + cold}
    assert loaded.count() == 20_004
    for folder in (f"{keyed}/trade_date=", f"{history}/data_source=vendor/simulation_date="):
        assert len(stores.list_paths(spark, f"{folder}2024-03-05/part-*")) > 2
        assert all(len(stores.list_paths(spark, f"{folder}2024-03-0{d}/part-*")) == 1 for d in (6, 7, 8))
