"""Sources, sinks and scalar functions, on data written from the checking tables to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.catalog import register
from barloom.catalog.sql_parts import BARS, DAILY, TICKS, over_series, r6, to6
from barloom.functions import scalars as S
from barloom.operators import reports
from barloom.session import scratch_path
from barloom.sources import bars as B
from barloom.sources import driver_tables as D
from barloom.sources import stores

OHLCV = ["open", "high", "low", "close", "volume"]
_OHLCV_SQL = ", ".join(f"{r6(c)} AS {c}" for c in OHLCV)
_BARS_OUT = f"WITH {BARS} SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts_s, {_OHLCV_SQL} FROM bars"


def bars_out(df: DataFrame) -> DataFrame:
    return df.select("symbol", F.unix_seconds("ts").alias("ts_s"), *[to6(c).alias(c) for c in OHLCV])


def vendor_names(df: DataFrame) -> DataFrame:
    """The bars under the names of the historical files."""
    return df.select(
        F.col("ts").alias("ts_event_price"), F.col("symbol").alias("symbol_price"),
        *[F.col(c).alias(f"{c}_1min") for c in OHLCV],
        *[F.col(c).alias(f"{c}_00") for c in ("bid_px", "ask_px", "bid_sz", "ask_sz")],
    )


@register("bars_ohlcv", _BARS_OUT)
def bars_ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_out(D.event_bars(spark, sf_dir))


@register(
    "minute_last",
    f"""WITH {TICKS} SELECT symbol, CAST(floor(epoch(ts) / 60) * 60 AS BIGINT) AS ts_s, arg_max(price, ts) AS price,
  arg_max(size, ts) AS size FROM ticks GROUP BY 1, 2""",
)
def minute_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = B.one_bar_per_minute(D.event_ticks(spark, sf_dir), "event_id")
    return m.select("symbol", F.unix_seconds("ts").alias("ts_s"), "price", "size")


@register(
    "daily_bars",
    f"WITH {BARS}, {DAILY} SELECT symbol, CAST(date AS VARCHAR) AS day, {_OHLCV_SQL} FROM daily",
)
def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.event_daily(spark, sf_dir)
    return d.select("symbol", F.col("date").cast("string").alias("day"), *[to6(c).alias(c) for c in OHLCV])


@register(
    "read_daily_csv",
    f"WITH {BARS}, {DAILY} SELECT symbol, CAST(date AS VARCHAR) AS day, {_OHLCV_SQL} FROM daily",
)
def read_daily_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars written as CSV and read back under the daily schema."""
    path = scratch_path(spark, "daily") + ".csv"
    D.event_daily(spark, sf_dir).select(*[f.name for f in B.DAILY_SCHEMA.fields]).write.option("header", True).csv(path)
    d = B.read_daily(spark, path)
    return d.select("symbol", F.col("date").cast("string").alias("day"), *[to6(c).alias(c) for c in OHLCV])


@register("read_bars_csv", _BARS_OUT)
def read_bars_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written as CSV under vendor names, read back and normalised from text."""
    path = scratch_path(spark, "bars") + ".csv"
    vendor_names(D.event_bars(spark, sf_dir)).write.option("header", True).csv(path)
    return bars_out(B.read_bars(spark, path))


@register(
    "normalize_bars",
    """SELECT symbol, ts_s, close FROM (SELECT event_type AS symbol, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s,
  CASE WHEN event_id % 10 = 3 THEN NULL ELSE value END AS close FROM events) WHERE close IS NOT NULL""",
)
def normalize_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text prices with unreadable entries: coerced, and bars without a price dropped."""
    e = D.table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 10 == 3, "n/a").otherwise(F.col("value").cast("string"))
    raw = e.select(
        F.col("ts").alias("timestamp"), F.col("event_type").alias("symbol"), text.alias("lastPrice"),
        *[F.col("value").alias(f"{c}_1min") for c in ("open", "high", "low")], F.lit(1.0).alias("volume"),
    )
    return B.normalize_bars(raw).select("symbol", F.unix_seconds("ts").alias("ts_s"), "close")


@register(
    "read_essential",
    f"WITH {BARS} SELECT symbol AS symbol_price, CAST(epoch(ts) AS BIGINT) AS ts_s, round(bid_px, 8) AS bid_px_00 FROM bars",
)
def read_essential(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "history")
    vendor_names(D.event_bars(spark, sf_dir)).withColumn("other", F.lit(1)).write.parquet(path)
    df = B.read_essential(B.read_table(spark, path))
    return df.select("symbol_price", F.unix_seconds("ts_event_price").alias("ts_s"), F.round("bid_px_00", 8).alias("bid_px_00"))


def monthly_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = D.table(spark, sf_dir, "lineitem")
    return lines.select(
        F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("RSI_14"), F.col("l_tax").alias("bidPrice"),
    )


@register(
    "read_monthly",
    """SELECT l_returnflag AS symbol, strftime(l_shipdate, '%Y-%m') AS ym, count(*) AS n, sum(l_quantity) AS q FROM lineitem
WHERE l_returnflag IN ('A', 'N') AND year(l_shipdate) = 1997 GROUP BY 1, 2""",
)
def read_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write by symbol and month, then read two symbols of one year back by pruning folders."""
    path = scratch_path(spark, "monthly")
    stores.write_monthly(monthly_source(spark, sf_dir), path)
    df = B.read_monthly(spark, path, ["A", "N"], 1997)
    return df.groupBy("symbol", "ym").agg(F.count("*").alias("n"), F.sum("RSI_14").alias("q"))


@register(
    "write_monthly_incremental",
    "SELECT l_returnflag AS symbol, strftime(l_shipdate, '%Y-%m') AS ym, count(*) AS n FROM lineitem GROUP BY 1, 2",
)
def write_monthly_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first write of one symbol, then of all: stored months are skipped, the rest is added."""
    path = scratch_path(spark, "monthly")
    rows = monthly_source(spark, sf_dir)
    stores.write_monthly(rows.filter(F.col("symbol") == "A"), path)
    stores.write_monthly(rows, path)
    return spark.read.parquet(path).groupBy("symbol", "ym").agg(F.count("*").alias("n"))


@register(
    "read_monthly_csv",
    """SELECT l_returnflag AS file_symbol, strftime(l_shipdate, '%Y-%m') AS file_ym, count(*) AS n, sum(l_quantity) AS q,
  CAST(sum(CASE WHEN l_returnflag <> 'A' THEN CAST(round(l_tax * 100) AS BIGINT) END) AS BIGINT) AS tax
FROM lineitem WHERE l_returnflag IN ('A', 'R') AND year(l_shipdate) = 1996 GROUP BY 1, 2""",
)
def read_monthly_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy files of all symbols and months: one symbol lacks a column, another has them in another order, and a
    symbol asked for has no files. One year of two symbols is read back by name."""
    folder = scratch_path(spark, "legacy")
    rows = monthly_source(spark, sf_dir).withColumns(
        {"ym": F.date_format("timestamp", "yyyy-MM"), "file": F.concat_ws("_", "symbol", F.date_format("timestamp", "yyyy-MM"))}
    )
    layouts = {"A": ["timestamp", "k", "RSI_14"], "R": ["bidPrice", "RSI_14", "k", "timestamp"], "N": ["RSI_14", "timestamp", "k", "bidPrice"]}
    for symbol, columns in layouts.items():
        out = rows.filter(F.col("symbol") == symbol).select("file", *columns).repartition("file")
        out.write.option("header", True).partitionBy("file").csv(f"{folder}-{symbol}")
        stores.rename_parts(spark, f"{folder}-{symbol}", "file", folder, "monthly_{}.csv")
    df = B.read_monthly_csv(spark, folder, ["A", "R", "ABSENT"], 1996)
    tax = F.sum(F.round(F.col("bidPrice") * 100).cast("long")).alias("tax")
    return df.groupBy("file_symbol", "file_ym").agg(F.count("*").alias("n"), F.sum("RSI_14").alias("q"), tax)


@register(
    "merge_monthly",
    "SELECT l_returnflag AS symbol, count(*) AS records FROM lineitem GROUP BY 1",
)
def merge_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = monthly_source(spark, sf_dir)
    early, late = rows.filter("year(timestamp) < 1998").drop("bidPrice"), rows.filter("year(timestamp) >= 1998")
    return stores.merge_monthly([early, late], scratch_path(spark, "merged"))


@register(
    "concat_tables",
    """SELECT n_name AS name, n_regionkey AS region, CAST(NULL AS DOUBLE) AS balance FROM nation
UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier""",
)
def concat_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = D.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    b = D.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return B.concat_tables([a, b])


@register(
    "save_features",
    """SELECT 'bidPrice,k,RSI_14,symbol,timestamp' AS layout, count(*) AS n, sum(l_quantity) AS q FROM lineitem""",
)
def save_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "features")
    stores.save_features(monthly_source(spark, sf_dir), path)
    df = spark.read.parquet(path)
    return df.agg(
        F.lit(",".join(df.columns)).alias("layout"), F.count("*").alias("n"), F.sum("RSI_14").alias("q")
    )


_COPIES = """c AS (SELECT l_suppkey, l_shipdate, l_linenumber <= 3 AS early, CAST(round(l_extendedprice * 100) AS BIGINT) AS p,
  l_orderkey * 10000000000 + l_partkey * 100 + l_linenumber AS k FROM lineitem)"""


def _copies(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Two batches of rows that repeat (supplier, time) with different prices."""
    rows = D.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("supplier"), F.col("l_shipdate").cast("timestamp").alias("ts"), "l_linenumber",
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("p"),
        F.expr("l_orderkey * 10000000000 + l_partkey * 100 + l_linenumber").alias("k"),
    )
    return [rows.filter("l_linenumber <= 3").drop("l_linenumber"), rows.filter("l_linenumber > 3").drop("l_linenumber")]


def _stored(spark: SparkSession, sf_dir: str, latest: bool) -> DataFrame:
    path = scratch_path(spark, "keyed-store")
    for batch in _copies(spark, sf_dir):
        done = stores.store_keyed(batch, path, ["supplier", "ts"], "k", "ts", latest)
    return done.select("supplier", F.unix_seconds("ts").alias("ts_s"), "p")


@register(
    "store_latest_wins",
    f"WITH {_COPIES} SELECT l_suppkey AS supplier, CAST(epoch(l_shipdate) AS BIGINT) AS ts_s, arg_max(p, k) AS p FROM c GROUP BY 1, 2",
)
def store_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real-time rows merged into the store and read back: the latest copy of a key stays."""
    return _stored(spark, sf_dir, True)


@register(
    "store_first_wins",
    f"""WITH {_COPIES}, r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY early DESC, k) AS i FROM c)
SELECT l_suppkey AS supplier, CAST(epoch(l_shipdate) AS BIGINT) AS ts_s, p FROM r WHERE i = 1""",
)
def store_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intraday rows: a stored key is never replaced, of new copies the first comes in."""
    return _stored(spark, sf_dir, False)


@register(
    "load_history",
    """SELECT data_source, count(*) AS n, sum(p) AS p FROM (
  SELECT CASE WHEN l_linenumber <= 3 THEN 'local' ELSE 'vendor' END AS data_source, l_suppkey, l_shipdate,
    CAST(round(arg_min(l_extendedprice, k) * 100) AS BIGINT) AS p
  FROM (SELECT *, l_orderkey * 10000000000 + l_partkey * 100 + l_linenumber AS k FROM lineitem) GROUP BY 1, 2, 3) GROUP BY 1""",
)
def load_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources stored, one of them twice: reloading replaces that source and leaves the other."""
    path = scratch_path(spark, "store")
    rows = D.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("symbol_price"), F.col("l_shipdate").cast("timestamp").alias("ts_event_price"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("p"), "l_linenumber",
        F.expr("l_orderkey * 10000000000 + l_partkey * 100 + l_linenumber").alias("k"),
    )
    first, second = rows.filter("l_linenumber <= 3"), rows.filter("l_linenumber > 3")
    stores.load_history(first, path, "vendor", "k")
    stores.load_history(first, path, "local", "k")
    done = stores.load_history(second, path, "vendor", "k")
    return done.groupBy(F.col("data_source").cast("string").alias("data_source")).agg(F.count("*").alias("n"), F.sum("p").alias("p"))


@register(
    "upsert_latest",
    "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1",
)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    stored = stores.upsert(None, e.filter("event_id % 2 = 0"), ["user_id"], "event_id")
    return stores.upsert(stored, e.filter("event_id % 2 = 1"), ["user_id"], "event_id")


@register(
    "insert_new",
    """SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'click' AND user_id NOT IN
  (SELECT user_id FROM events WHERE event_type = 'error' AND value > 100) GROUP BY 1""",
)
def insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    stored = e.filter("event_type = 'error' AND value > 100")
    new = stores.insert_new(stored, e.filter("event_type = 'click'"), ["user_id"], "event_id")
    return new.select("user_id", "event_id")


@register(
    "append_log",
    "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1",
)
def append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One appended record per order status."""
    path = scratch_path(spark, "log")
    counts = D.table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).collect()
    for r in counts:
        stores.append_row(spark, {"status": r["o_orderstatus"], "n": r["n"]}, "status string, n long", path)
    return spark.read.parquet(path).orderBy("status")


@register("truncate_dataset", "SELECT count(*) AS removed, CAST(0 AS BIGINT) AS remaining FROM orders")
def truncate_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "reset")
    D.table(spark, sf_dir, "orders").write.parquet(path)
    removed = stores.truncate_dataset(spark, path)
    return spark.read.parquet(path).agg(F.lit(removed).cast("long").alias("removed"), F.count("*").alias("remaining"))


@register(
    "split_artifact",
    """WITH o AS (SELECT o_orderstatus = 'F' AS buy,
  row_number() OVER (PARTITION BY o_orderstatus = 'F' ORDER BY CAST('0x' || substr(md5('42|' || CAST(o_orderkey AS VARCHAR)), 1, 15) AS BIGINT)) AS r,
  count(*) OVER (PARTITION BY o_orderstatus = 'F') AS n FROM orders), s AS (SELECT *, ceil(n * 0.15) AS t FROM o)
SELECT CASE WHEN r <= t THEN 'test' WHEN r <= t + ceil((n - t) * 0.15) THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM s GROUP BY 1""",
)
def split_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.catalog.datasets import orders_with_class
    from barloom.operators.prepare import stratified_split

    path = scratch_path(spark, "splits")
    stores.save_splits(stratified_split(orders_with_class(spark, sf_dir), "buy", ["o_orderkey"]), ["o_totalprice"], path)
    return spark.read.parquet(f"{path}/rows").groupBy(F.col("split").cast("string").alias("split")).agg(F.count("*").alias("n"))


# --- scalar functions ---------------------------------------------------------------------------


@register(
    "session_clock",
    f"""WITH {TICKS}, l AS (SELECT event_id, ts - INTERVAL 5 HOURS AS ny FROM ticks),
c AS (SELECT event_id, strftime(ny, '%H:%M:%S') AS t, isodow(ny) < 6 AS wd FROM l)
SELECT event_id, t BETWEEN '09:30:00' AND '15:30:00' AS selectable, wd AND t BETWEEN '09:30:00' AND '16:00:00' AS is_open,
  wd AND t >= '15:45:00' AS near_close FROM c""",
)
def session_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market-hours predicates; the events lie in January, where New York is five hours behind."""
    t = D.event_ticks(spark, sf_dir)
    return t.select(
        "event_id", S.in_selection_hours("ts").alias("selectable"), S.is_market_open("ts").alias("is_open"),
        S.is_near_close("ts").alias("near_close"),
    )


@register(
    "parse_number",
    """SELECT event_id, value AS plain, round(value * 1000, 3) AS thousands, round(value * 1000000, 0) AS millions,
  CAST(user_id * 1001 AS DOUBLE) AS grouped FROM events""",
)
def parse_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events")
    v = F.format_string("%.2f", "value")
    return e.select(
        "event_id", S.parse_number(F.concat(F.lit("C"), v)).alias("plain"),
        F.round(S.parse_number(F.concat(v, F.lit("K"))), 3).alias("thousands"),
        F.round(S.parse_number(F.concat(v, F.lit("M"))), 0).alias("millions"),
        S.parse_number(F.format_number(F.col("user_id") * 1001, 0)).alias("grouped"),
    )


@register(
    "epoch_and_dates",
    """SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS from_s, epoch_us(ts) // 1000 AS from_ms,
  CAST(epoch(date_trunc('minute', ts)) AS BIGINT) + 18000 AS parsed_s FROM events""",
)
def epoch_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch seconds and milliseconds, and market-clock text, to UTC."""
    e = D.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ms = F.unix_millis("ts")
    return e.select(
        "event_id", F.unix_seconds(S.epoch_to_utc(F.floor(ms / 1000))).alias("from_s"),
        F.unix_millis(S.epoch_to_utc(ms)).alias("from_ms"),
        F.unix_seconds(S.parse_simulation_date(F.date_format("ts", "yyyyMMddHHmm"))).alias("parsed_s"),
    )


@register(
    "synthetic_quote",
    over_series([], {"bid": "round(close * 0.9995, 8)", "ask": "round(close * 1.0005, 8)", "edge": r6(
        "CASE WHEN volume > 503 THEN close / (volume - 503) ELSE 7 END"),
        "pct": r6("coalesce((close - c1) / c1, 0) * 100")}),
)
def synthetic_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic quotes around the close, and the guarded division and percentage."""
    from barloom.functions.frames import SessionFrames

    bars = D.event_bars(spark, sf_dir).withColumn("c1", SessionFrames().lag("close"))
    over = F.when(F.col("volume") > 503, F.col("volume") - 503).otherwise(0)
    return bars.select(
        "symbol", F.unix_seconds("ts").alias("ts_s"), F.round(S.synthetic_bid("close"), 8).alias("bid"),
        F.round(S.synthetic_ask("close"), 8).alias("ask"), to6(S.safe_divide("close", over, 7.0)).alias("edge"),
        to6(S.safe_percentage("close", "c1")).alias("pct"),
    )


@register("rows_per_date", f"WITH {BARS} SELECT CAST(trade_date AS VARCHAR) AS day, count(*) AS n FROM bars GROUP BY 1")
def rows_per_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars stored by date: a date that is present is found by the existence check."""
    path = scratch_path(spark, "by_date")
    D.event_bars(spark, sf_dir).repartition("trade_date").write.partitionBy("trade_date").parquet(path)
    stored = spark.read.parquet(path)
    if not reports.has_date(stored, "click", "2024-01-03"):
        raise ValueError("a stored date was not found")
    return stored.groupBy(F.col("trade_date").cast("string").alias("day")).agg(F.count("*").alias("n"))
