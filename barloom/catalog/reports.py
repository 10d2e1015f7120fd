"""Reports over bars, daily series and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.catalog import register
from barloom.catalog.sql_parts import BARS, TICKS, r6, to6
from barloom.operators import reports as R
from barloom.sources import driver_tables as D

SUPPLIER_DAILY = """sd AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date,
  arg_min(l_extendedprice / l_quantity, l_orderkey * 10000000000 + l_partkey * 100 + l_linenumber) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  arg_max(l_extendedprice / l_quantity, l_orderkey * 10000000000 + l_partkey * 100 + l_linenumber) AS close,
  sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)"""

# Orders stand for training runs.
RUN_COLUMNS = {
    "Run_Id": "o_orderkey",
    "Status": "CASE WHEN o_orderstatus = 'P' THEN 'Error' ELSE 'Success' END",
    "Error_Message": "CASE WHEN o_orderstatus = 'P' THEN concat('failed ', o_orderpriority) ELSE 'None' END",
    "Best_Model": "o_orderpriority",
    "Model_Description": "concat('model ', o_orderpriority, ' customer ', CAST(o_custkey AS STRING))",
    "Test_AUC": "0.5 + (o_totalprice - floor(o_totalprice / 1000) * 1000) / 2500",
    "Test_F1": "(o_totalprice - floor(o_totalprice / 700) * 700) / 700",
    "Duration_Seconds": "o_totalprice / 1000",
    "Num_Features": "CAST(10 + o_custkey % 11 AS INT)",
    "Num_Samples": "o_custkey * 100",
    "Top_Feature_1": "concat('f', CAST(o_custkey % 9 AS STRING))",
    "Top_Feature_2": "concat('f', CAST(o_orderkey % 7 AS STRING))",
    "Top_Feature_3": "CASE WHEN o_orderkey % 3 = 0 THEN 'None' ELSE concat('f', CAST(o_orderkey % 5 AS STRING)) END",
}
RUNS = "runs AS (SELECT " + ", ".join(
    f'{e.replace(" AS STRING)", " AS VARCHAR)").replace(" AS INT)", " AS INTEGER)")} AS "{n}"' for n, e in RUN_COLUMNS.items()
) + ", o_orderdate + to_seconds(o_orderkey % 86400) AS \"Date_Start\" FROM orders)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = D.table(spark, sf_dir, "orders")
    start = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400)
    return orders.select(*[F.expr(e).alias(n) for n, e in RUN_COLUMNS.items()], start.alias("Date_Start"))


def six(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


# --- bars ---------------------------------------------------------------------------------------


@register(
    "symbol_date_filter",
    f"""WITH {BARS} SELECT CAST(epoch(ts) AS BIGINT) AS ts_s, {r6('close')} AS close FROM bars
WHERE symbol = 'click' AND trade_date = DATE '2024-01-05'""",
)
def symbol_date_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = R.filter_symbol_date(D.event_bars(spark, sf_dir), "click", "2024-01-05")
    return df.select(F.unix_seconds("ts").alias("ts_s"), to6("close").alias("close"))


@register(
    "date_range",
    f"""WITH {BARS} SELECT CAST(epoch(ts) AS BIGINT) AS ts_s, {r6('open')} AS open, {r6('high')} AS high, {r6('low')} AS low,
  {r6('close')} AS close, {r6('volume')} AS volume FROM bars
WHERE symbol = 'view' AND trade_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' ORDER BY ts_s""",
)
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["open", "high", "low", "close", "volume"]
    df = R.date_range(D.event_bars(spark, sf_dir), "view", "2024-01-10", "2024-01-20", ["ts", *cols])
    return df.select(F.unix_seconds("ts").alias("ts_s"), *[to6(c).alias(c) for c in cols])


@register(
    "distinct_minutes",
    f"WITH {TICKS} SELECT DISTINCT symbol, CAST(floor(epoch(ts) / 60) * 60 AS BIGINT) AS minute_s FROM ticks",
)
def distinct_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.distinct_minutes(D.event_ticks(spark, sf_dir)).select("symbol", F.unix_seconds("minute").alias("minute_s"))


@register("available_dates", f"WITH {BARS} SELECT DISTINCT symbol, CAST(trade_date AS VARCHAR) AS day FROM bars")
def available_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.available_dates(D.event_bars(spark, sf_dir)).select("symbol", F.col("trade_date").cast("string").alias("day"))


@register(
    "common_symbols",
    "SELECT CAST(s_suppkey AS VARCHAR) AS symbol FROM supplier INTERSECT SELECT CAST(l_suppkey AS VARCHAR) FROM lineitem",
)
def common_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = D.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"))
    return R.common_symbols(known, D.supplier_daily(spark, sf_dir))


@register(
    "data_summary",
    f"""WITH {BARS} SELECT count(*) AS total_records, count(DISTINCT symbol) AS symbol_count,
  CAST(min(trade_date) AS VARCHAR) AS first_date, CAST(max(trade_date) AS VARCHAR) AS last_date FROM bars""",
)
def data_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.data_summary(D.event_bars(spark, sf_dir))
    return s.withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})


@register(
    "per_symbol_summary",
    f"WITH {BARS} SELECT symbol, count(*) AS record_count FROM bars GROUP BY 1 ORDER BY 2 DESC, 1",
)
def per_symbol_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.per_symbol_summary(D.event_bars(spark, sf_dir)).select("symbol", "record_count")
    return s.orderBy(F.desc("record_count"), "symbol")


@register(
    "duplicate_keys",
    "SELECT l_suppkey, CAST(l_shipdate AS VARCHAR) AS day, count(*) AS copies FROM lineitem GROUP BY 1, l_shipdate HAVING count(*) > 1",
)
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.duplicate_keys(D.table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_shipdate"])
    return d.select("l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("day"), "copies")


@register(
    "bars_dedupe",
    """SELECT l_suppkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, arg_min(l_extendedprice, k) AS l_extendedprice
FROM (SELECT *, l_orderkey * 10000000000 + l_partkey * 100 + l_linenumber AS k FROM lineitem) GROUP BY 1, 2""",
)
def bars_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = D.table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.to_date("l_shipdate").cast("string").alias("day"), "l_extendedprice",
        F.expr("l_orderkey * 10000000000 + l_partkey * 100 + l_linenumber").alias("k"),
    )
    return R.first_per_key(lines, ["l_suppkey", "day"], "k").drop("k")


@register(
    "latest_per_key",
    "SELECT event_type, user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2",
)
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "value")
    return R.latest_per_key(e, ["event_type", "user_id"], "event_id")


@register(
    "last_n_per_key",
    f"""WITH {BARS} SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts_s, {r6('close')} AS close FROM bars
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 60""",
)
def last_n_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = R.last_n_per_key(D.event_bars(spark, sf_dir), ["symbol"], "ts", 60)
    return df.select("symbol", F.unix_seconds("ts").alias("ts_s"), to6("close").alias("close"))


@register(
    "missing_periods",
    f"""WITH {SUPPLIER_DAILY}, h AS (SELECT DISTINCT symbol || '/' || CAST(volume AS VARCHAR) AS k, date_trunc('month', date) AS m FROM sd),
s AS (SELECT k, min(m) AS lo, max(m) AS hi FROM h GROUP BY 1),
e AS (SELECT k, unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM s)
SELECT k, strftime(e.m, '%Y-%m') AS month FROM e WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.k = e.k AND h.m = e.m)""",
)
def missing_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.supplier_daily(spark, sf_dir).select(
        F.concat_ws("/", "symbol", F.col("volume").cast("string")).alias("k"), "date"
    )
    return R.missing_periods(d, "k", "date").select("k", F.date_format("month", "yyyy-MM").alias("month"))


@register(
    "processing_summary",
    f"""WITH {BARS}, t AS (SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date, count(*) AS n,
  count(*) FILTER (volume > 500) AS p FROM bars GROUP BY ROLLUP (symbol, CAST(trade_date AS VARCHAR)))
SELECT symbol, trade_date, n AS total_minutes, p AS processed_minutes, {r6('p * 100.0 / n')} AS success_rate FROM t""",
)
def processing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = D.event_bars(spark, sf_dir).select(
        "symbol", F.col("trade_date").cast("string").alias("trade_date"), (F.col("volume") > 500).alias("processed")
    )
    return six(R.processing_summary(bars), "success_rate")


# --- run log ------------------------------------------------------------------------------------


@register(
    "filter_runs",
    f"""WITH {RUNS} SELECT "Run_Id" FROM runs WHERE "Status" = 'Success' AND "Best_Model" IN ('1-URGENT', '2-HIGH')
AND CAST("Date_Start" AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'""",
)
def filter_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.filter_runs(
        runs(spark, sf_dir), ["Success"], ["1-URGENT", "2-HIGH"], "1996-01-01", "1998-12-31"
    ).select("Run_Id")


@register(
    "run_kpis",
    f"""WITH {RUNS} SELECT count(*) AS total_runs, count(*) FILTER (ok) AS successful_runs,
  {r6('avg("Test_AUC") FILTER (ok)')} AS avg_test_auc, {r6('max("Test_AUC") FILTER (ok)')} AS best_test_auc,
  {r6('avg("Duration_Seconds") FILTER (ok)')} AS avg_duration, {r6('avg("Num_Features") FILTER (ok)')} AS avg_features,
  {r6('avg("Num_Samples") FILTER (ok)')} AS avg_samples FROM (SELECT *, "Status" = 'Success' AS ok FROM runs)""",
)
def run_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(
        R.run_kpis(runs(spark, sf_dir)), "avg_test_auc", "best_test_auc", "avg_duration", "avg_features", "avg_samples"
    )


_STATS = {"auc": "Test_AUC", "f1": "Test_F1", "duration": "Duration_Seconds", "features": "Num_Features"}


@register(
    "model_stats",
    f"""WITH {RUNS} SELECT "Best_Model", count(*) AS auc_count, {", ".join(
        f'round_even(CAST(avg("{c}") AS DOUBLE), 4) AS {s}_mean, round_even(CAST(stddev_samp("{c}") AS DOUBLE), 4) AS {s}_std'
        for s, c in _STATS.items())}, round_even(CAST(min("Test_AUC") AS DOUBLE), 4) AS auc_min,
  round_even(CAST(max("Test_AUC") AS DOUBLE), 4) AS auc_max FROM runs WHERE "Status" = 'Success' GROUP BY 1""",
)
def model_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.model_stats(runs(spark, sf_dir))


@register(
    "run_trends",
    f"""WITH {RUNS}, o AS (SELECT *, row_number() OVER (ORDER BY "Date_Start", "Run_Id") - 1 AS i FROM runs WHERE "Status" = 'Success'),
s AS (SELECT count(*) AS runs, regr_slope("Test_AUC", i) AS a, regr_slope("Duration_Seconds", i) AS d, regr_slope("Num_Features", i) AS f FROM o)
SELECT runs, round(a * 1e6, 4) AS auc_slope, round(d * 1e6, 4) AS duration_slope, round(f * 1e6, 4) AS feature_slope,
  CASE WHEN a > 0.001 THEN 'improving' WHEN a < -0.001 THEN 'declining' ELSE 'stable' END AS auc_trend,
  CASE WHEN d > 1 THEN 'increasing' WHEN d < -1 THEN 'decreasing' ELSE 'stable' END AS duration_trend,
  CASE WHEN f > 0.5 THEN 'increasing' WHEN f < -0.5 THEN 'decreasing' ELSE 'stable' END AS feature_trend FROM s""",
)
def run_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = R.run_trends(runs(spark, sf_dir))
    return t.withColumns({c: F.round(F.col(c) * 1e6, 4) for c in ("auc_slope", "duration_slope", "feature_slope")})


@register(
    "numbered_runs",
    f'WITH {RUNS} SELECT "Run_Id", row_number() OVER (ORDER BY "Date_Start", "Run_Id") AS "Run_Number" FROM runs',
)
def numbered_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.numbered_runs(runs(spark, sf_dir)).select("Run_Id", F.col("Run_Number").cast("long").alias("Run_Number"))


@register(
    "numbered_undated_runs",
    f"""WITH {RUNS}, dated AS (SELECT "Run_Id", CASE WHEN "Run_Id" % 3 <> 0 THEN "Date_Start" END AS d FROM runs)
SELECT "Run_Id", row_number() OVER (ORDER BY d NULLS FIRST, "Run_Id") AS "Run_Number" FROM dated""",
)
def numbered_undated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs without a date come first and are all numbered."""
    df = runs(spark, sf_dir).withColumn("Date_Start", F.when(F.col("Run_Id") % 3 != 0, F.col("Date_Start")))
    return R.numbered_runs(df).select("Run_Id", F.col("Run_Number").cast("long").alias("Run_Number"))


@register(
    "best_and_worst",
    f"""WITH {RUNS}, ok AS (SELECT * FROM runs WHERE "Status" = 'Success')
(SELECT 'best' AS kind, "Run_Id", "Best_Model" FROM ok ORDER BY "Test_AUC" DESC, "Run_Id" DESC LIMIT 1)
UNION ALL (SELECT 'worst', "Run_Id", "Best_Model" FROM ok ORDER BY "Test_AUC", "Run_Id" LIMIT 1)""",
)
def best_and_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_and_worst(runs(spark, sf_dir), ["Run_Id", "Best_Model"])


@register(
    "auc_by_feature_count",
    f"""WITH {RUNS} SELECT "Num_Features", count(*) AS runs, {r6('avg("Test_AUC")')} AS avg_auc FROM runs WHERE "Status" = 'Success' GROUP BY 1""",
)
def auc_by_feature_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(R.auc_by_feature_count(runs(spark, sf_dir)), "avg_auc")


@register(
    "frequent_top_features",
    f"""WITH {RUNS}, t AS (SELECT unnest(["Top_Feature_1", "Top_Feature_2", "Top_Feature_3"]) AS feature FROM runs WHERE "Status" = 'Success')
SELECT feature, count(*) AS times FROM t WHERE feature <> 'None' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
)
def frequent_top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.frequent_top_features(runs(spark, sf_dir))


@register(
    "error_counts",
    f"""WITH {RUNS} SELECT "Error_Message", count(*) AS runs FROM runs WHERE "Status" = 'Error' GROUP BY 1""",
)
def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.error_counts(runs(spark, sf_dir))


@register(
    "top_runs",
    f"""WITH {RUNS} SELECT "Run_Id", {r6('"Test_AUC"')} AS "Test_AUC" FROM runs WHERE "Status" = 'Success' ORDER BY runs."Test_AUC" DESC, "Run_Id" LIMIT 5""",
)
def top_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_runs(runs(spark, sf_dir)).select("Run_Id", to6("Test_AUC").alias("Test_AUC"))


# --- model index --------------------------------------------------------------------------------

_INDEX = f"""{RUNS}, idx AS (SELECT CAST("Run_Id" AS VARCHAR) AS model_id, "Model_Description" AS description,
  "Date_Start" AS date_created FROM runs)"""


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select(
        F.col("Run_Id").cast("string").alias("model_id"), F.col("Model_Description").alias("description"),
        F.col("Date_Start").alias("date_created"),
    )


@register(
    "find_models",
    f"WITH {_INDEX} SELECT model_id, description FROM idx WHERE lower(description) LIKE '%urgent%' OR lower(description) LIKE '%customer 12%'",
)
def find_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.find_models(index(spark, sf_dir), ["URGENT", "Customer 12"]).select("model_id", "description")


@register("stale_models", f"WITH {_INDEX} SELECT model_id FROM idx WHERE date_created < TIMESTAMP '1999-01-01' - INTERVAL 365 DAYS")
def stale_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("1999-01-01 00:00:00").cast("timestamp")
    return R.stale_models(index(spark, sf_dir), 365, now).select("model_id")


@register(
    "latest_model",
    f"WITH {_INDEX} SELECT model_id, description FROM idx WHERE lower(description) LIKE '%3-medium%' ORDER BY date_created DESC, model_id DESC LIMIT 1",
)
def latest_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest_model(index(spark, sf_dir), "3-MEDIUM").select("model_id", "description")


@register("list_models", f"WITH {_INDEX} SELECT model_id, CAST(epoch(date_created) AS BIGINT) AS made_s FROM idx ORDER BY 2 DESC, 1")
def list_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.list_models(index(spark, sf_dir)).select("model_id", F.unix_seconds("date_created").alias("made_s"))


@register("model_details", f"WITH {_INDEX} SELECT model_id, description FROM idx WHERE model_id = '77'")
def model_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.model_details(index(spark, sf_dir), "77").select("model_id", "description")


@register(
    "supplier_daily",
    f"""WITH {SUPPLIER_DAILY} SELECT symbol, CAST(date AS VARCHAR) AS day, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low,
  round(close, 8) AS close, round(volume, 8) AS volume FROM sd""",
)
def supplier_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.supplier_daily(spark, sf_dir)
    cols = ["open", "high", "low", "close", "volume"]
    return d.select("symbol", F.col("date").cast("string").alias("day"), *[F.round(c, 8).alias(c) for c in cols])
