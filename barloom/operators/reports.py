"""Reports over bars, trades, labels and run logs."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.order_stats import one_row, with_row_number

# --- bars ---------------------------------------------------------------------------------------


def filter_symbol_date(bars: DataFrame, symbol: str | None = None, date: str | None = None) -> DataFrame:
    if symbol is not None:
        bars = bars.filter(F.col("symbol") == symbol)
    if date is not None:
        bars = bars.filter(F.col("trade_date") == F.lit(date).cast("date"))
    return bars


def date_range(bars: DataFrame, symbol: str, start: str, end: str, columns=None) -> DataFrame:
    """Bars of a symbol between two dates (inclusive) in time order; optionally only some columns."""
    days = F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    out = bars.filter((F.col("symbol") == symbol) & days)
    if columns:
        out = out.select(*columns)
    return out.orderBy("ts")


def has_date(bars: DataFrame, symbol: str, date: str) -> bool:
    return not filter_symbol_date(bars, symbol, date).select("symbol").limit(1).isEmpty()


def distinct_minutes(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", F.date_trunc("minute", "ts").alias("minute")).distinct()


def available_dates(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "trade_date").distinct()


def common_symbols(bars: DataFrame, daily: DataFrame) -> DataFrame:
    """Symbols present in both inputs."""
    return bars.select("symbol").intersect(daily.select("symbol"))


def per_symbol_summary(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(
        F.count("*").alias("record_count"),
        F.min("trade_date").alias("first_date"),
        F.max("trade_date").alias("last_date"),
    )


def data_summary(bars: DataFrame) -> DataFrame:
    """One row: records, symbols, date range; from the per-symbol counts, so nothing is scanned twice."""
    return per_symbol_summary(bars).agg(
        F.sum("record_count").alias("total_records"),
        F.count("*").alias("symbol_count"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keep the first row per key. An aggregate with map-side combine: a key with very many copies
    ships one row per task, where a window would sort all copies in one."""
    return _extreme_per_key(df, keys, order, F.min_by)


def latest_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keep the last row per key (upsert, latest wins)."""
    return _extreme_per_key(df, keys, order, F.max_by)


_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _extreme_per_key(df: DataFrame, keys: list[str], order: str, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if all(isinstance(df.schema[c].dataType, _FIXED) for c in {*rest, order}):
        # picks of one order meet the same rows and choose the same one; of plain numbers they need no sort, a struct does
        return df.groupBy(*keys).agg(*[pick(c, order).alias(c) for c in rest], F.count(F.lit(1)).alias("_rows")).select(*df.columns)
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def last_n_per_key(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """Last n rows per key. Spark prunes to n rows per key in every map task before the exchange."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def missing_periods(present: DataFrame, key: str, month: str) -> DataFrame:
    """Months absent between a key's first and last month. ``month`` holds any date of the month."""
    m = F.trunc(month, "month")
    have = present.select(key, m.alias("month")).distinct()
    spans = have.groupBy(key).agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    expected = spans.select(key, F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return expected.join(have, [key, "month"], "left_anti")


def processing_summary(minutes: DataFrame) -> DataFrame:
    """Minutes and processed minutes per (symbol, date) with symbol and grand totals (NULL keys)."""
    per_day = minutes.groupBy("symbol", "trade_date").agg(
        F.count("*").alias("t"), F.count(F.when(F.col("processed"), 1)).alias("p")
    )
    out = per_day.rollup("symbol", "trade_date").agg(
        F.sum("t").alias("total_minutes"), F.sum("p").alias("processed_minutes")
    )
    rate = F.when(F.col("total_minutes") > 0, F.col("processed_minutes") / F.col("total_minutes") * 100)
    return out.withColumn("success_rate", F.coalesce(rate, F.lit(0.0)))


# --- trades and labels --------------------------------------------------------------------------


def trade_summary(trades: DataFrame, keys: list[str]) -> DataFrame:
    closed = F.col("status") == "CLOSED"
    pnl = F.col("net_pnl")
    out = trades.groupBy(*keys).agg(
        F.count("*").alias("total_trades"),
        F.count_if(F.col("status") == "OPEN").alias("open_positions"),
        F.count_if(closed).alias("closed_positions"),
        F.sum(F.when(closed, pnl).otherwise(F.lit(0.0))).alias("total_pnl"),
        F.count_if(closed & (pnl > 0)).alias("winning_trades"),
        F.count_if(closed & (pnl < 0)).alias("losing_trades"),
        F.coalesce(F.avg(F.when(closed, F.col("buy_sell_duration_minutes"))), F.lit(0.0)).alias(
            "avg_duration_minutes"
        ),
        F.sum("commission_paid").alias("total_commissions"),
    )
    rate = F.when(F.col("closed_positions") > 0, F.col("winning_trades") / F.col("closed_positions") * 100)
    return out.withColumn("win_rate", F.coalesce(rate, F.lit(0.0)))


def newest_positions(trades: DataFrame) -> DataFrame:
    return trades.orderBy(F.desc("buy_timestamp"), "position_id")


def label_distribution(labelled: DataFrame) -> DataFrame:
    """Signals per R with their share of all rows and of signals, and time to target.

    Minutes are whole numbers inside the label horizon, so the exact median keeps a small table of
    counts per group, not the values.
    """
    per_r = labelled.groupBy("R").agg(
        F.count("*").alias("rows"),
        F.avg("time_minutes").alias("mean_minutes"),
        F.expr("percentile(time_minutes, 0.5)").alias("median_minutes"),
    )
    totals = one_row(per_r.agg(F.sum("rows").alias("rows"), F.sum(F.when(F.col("R") > 0, F.col("rows"))).alias("buys")))
    share = F.when(F.col("R") > 0, F.col("rows") / totals["buys"])
    return per_r.select(
        "R", "rows", (F.col("rows") / totals["rows"]).alias("share_of_rows"), share.alias("share_of_signals"),
        "mean_minutes", "median_minutes",
    )


# --- run logs -----------------------------------------------------------------------------------


def filter_runs(runs: DataFrame, statuses=None, models=None, start: str | None = None, end: str | None = None) -> DataFrame:
    if statuses:
        runs = runs.filter(F.col("Status").isin(list(statuses)))
    if models:
        runs = runs.filter(F.col("Best_Model").isin(list(models)))
    day = F.to_date("Date_Start")
    if start:
        runs = runs.filter(day >= F.lit(start).cast("date"))
    if end:
        runs = runs.filter(day <= F.lit(end).cast("date"))
    return runs


def successful(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("Status") == "Success")


def run_kpis(runs: DataFrame) -> DataFrame:
    ok = F.col("Status") == "Success"
    return runs.agg(
        F.count("*").alias("total_runs"),
        F.count_if(ok).alias("successful_runs"),
        F.avg(F.when(ok, F.col("Test_AUC"))).alias("avg_test_auc"),
        F.max(F.when(ok, F.col("Test_AUC"))).alias("best_test_auc"),
        F.avg(F.when(ok, F.col("Duration_Seconds"))).alias("avg_duration"),
        F.avg(F.when(ok, F.col("Num_Features"))).alias("avg_features"),
        F.avg(F.when(ok, F.col("Num_Samples"))).alias("avg_samples"),
    )


def model_stats(runs: DataFrame) -> DataFrame:
    """Per best model: count and spread of the metrics, rounded to 4 places."""
    aggs = [F.count("Test_AUC").alias("auc_count")]
    for name, fn in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
        aggs.append(F.bround(fn("Test_AUC"), 4).alias(f"auc_{name}"))
    for column, short in (("Test_F1", "f1"), ("Duration_Seconds", "duration"), ("Num_Features", "features")):
        aggs.append(F.bround(F.avg(column), 4).alias(f"{short}_mean"))
        aggs.append(F.bround(F.stddev_samp(column), 4).alias(f"{short}_std"))
    return successful(runs).groupBy("Best_Model").agg(*aggs)


def slope(y: str | Column, x: str | Column) -> Column:
    return F.regr_slope(y if isinstance(y, Column) else F.col(y), x if isinstance(x, Column) else F.col(x))


def trend_word(s: Column, limit: float, up: str, down: str) -> Column:
    return F.when(s > limit, up).when(s < -limit, down).otherwise("stable")


def run_trends(runs: DataFrame) -> DataFrame:
    """Straight-line slopes over run order with a verdict; one row."""
    numbered = with_row_number(successful(runs), "Date_Start", "Run_Id", "_i")
    numbered = numbered.withColumn("_i", (F.col("_i") - 1).cast("double"))
    out = numbered.agg(
        F.count("*").alias("runs"),
        slope("Test_AUC", "_i").alias("auc_slope"),
        slope(F.col("Duration_Seconds").cast("double"), "_i").alias("duration_slope"),
        slope(F.col("Num_Features").cast("double"), "_i").alias("feature_slope"),
    )
    return out.withColumns(
        {
            "auc_trend": trend_word(F.col("auc_slope"), 0.001, "improving", "declining"),
            "duration_trend": trend_word(F.col("duration_slope"), 1.0, "increasing", "decreasing"),
            "feature_trend": trend_word(F.col("feature_slope"), 0.5, "increasing", "decreasing"),
        }
    )


def numbered_runs(runs: DataFrame) -> DataFrame:
    """Run_Number, 1 for the oldest."""
    return with_row_number(runs, "Date_Start", "Run_Id", "Run_Number")


def best_and_worst(runs: DataFrame, columns: list[str]) -> DataFrame:
    row = F.struct(*columns)
    picked = successful(runs).agg(
        F.max_by(row, F.struct("Test_AUC", F.col("Run_Id"))).alias("best"),
        F.min_by(row, F.struct("Test_AUC", F.col("Run_Id"))).alias("worst"),
    )
    both = F.array(
        F.struct(F.lit("best").alias("kind"), F.col("best").alias("run")),
        F.struct(F.lit("worst").alias("kind"), F.col("worst").alias("run")),
    )
    return picked.select(F.inline(both)).select("kind", "run.*")


def auc_by_feature_count(runs: DataFrame) -> DataFrame:
    return successful(runs).groupBy("Num_Features").agg(
        F.count("*").alias("runs"), F.avg("Test_AUC").alias("avg_auc")
    )


def frequent_top_features(runs: DataFrame, n: int = 5) -> DataFrame:
    names = ["Top_Feature_1", "Top_Feature_2", "Top_Feature_3"]
    long = successful(runs).select(*names).unpivot([], names, "slot", "feature")
    counted = long.filter(F.col("feature").isNotNull() & (F.col("feature") != "None")).groupBy("feature").agg(
        F.count("*").alias("times")
    )
    return counted.orderBy(F.desc("times"), "feature").limit(n)


def error_counts(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("Status") == "Error").groupBy("Error_Message").agg(F.count("*").alias("runs"))


def top_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    return successful(runs).orderBy(F.desc("Test_AUC"), "Run_Id").limit(n)


# --- model index --------------------------------------------------------------------------------


def find_models(index: DataFrame, keywords: list[str]) -> DataFrame:
    text = F.lower("description")
    return index.filter(reduce(or_, [text.contains(k.lower()) for k in keywords], F.lit(False)))


def stale_models(index: DataFrame, days: int, now: Column | None = None) -> DataFrame:
    now = now if now is not None else F.current_timestamp()
    return index.filter(F.col("date_created") < now - F.make_dt_interval(F.lit(days)))


def latest_model(index: DataFrame, symbol: str) -> DataFrame:
    newest = F.max_by(F.struct(*index.columns), F.struct("date_created", F.col("model_id")))
    return index.filter(F.lower("description").contains(symbol.lower())).agg(newest.alias("m")).filter(
        "m IS NOT NULL"
    ).select("m.*")


def list_models(index: DataFrame) -> DataFrame:
    return index.orderBy(F.desc("date_created"), "model_id")


def model_details(index: DataFrame, model_id: str) -> DataFrame:
    return index.filter(F.col("model_id") == model_id)
