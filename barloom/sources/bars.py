"""Reading, normalising and building minute bars and daily bars."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.frames import no_nan

# fixed values: accepted source names for each canonical bar column
ALIASES = {
    "ts": ("ts", "ts_event_clean", "timestamp", "ts_event_price"),
    "symbol": ("symbol", "symbol_price"),
    "open": ("open", "open_1min"),
    "high": ("high", "high_1min"),
    "low": ("low", "low_1min"),
    "close": ("close", "close_1min", "lastPrice", "price"),
    "volume": ("volume", "volume_1min"),
    "bid_px": ("bid_px", "bid_px_00", "bidPrice"),
    "ask_px": ("ask_px", "ask_px_00", "askPrice"),
    "bid_sz": ("bid_sz", "bid_sz_00", "bidSize"),
    "ask_sz": ("ask_sz", "ask_sz_00", "askSize"),
    "trade_count": ("trade_count",),
}
PRICE_COLUMNS = ("open", "high", "low", "close", "volume")
QUOTE_COLUMNS = ("bid_px", "ask_px", "bid_sz", "ask_sz", "trade_count")

# fixed values: the eleven columns the historical store keeps
ESSENTIAL_COLUMNS = (
    "ts_event_price", "open_1min", "high_1min", "low_1min", "close_1min", "volume_1min",
    "symbol_price", "bid_px_00", "ask_px_00", "bid_sz_00", "ask_sz_00",
)

DAILY_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in PRICE_COLUMNS]
)


class MissingColumnsError(ValueError):
    """Raised when an input lacks required columns; lists them all."""


def require_columns(df: DataFrame, required, what: str = "input") -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"{what} lacks columns: {', '.join(sorted(missing))}")
    return df


def _as_double(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    c = F.col(name)
    return no_nan(c.try_cast("double") if isinstance(kind, T.StringType) else c.cast("double"))


def normalize_bars(df: DataFrame, drop_incomplete: bool = True) -> DataFrame:
    """Canonical bar columns from any accepted naming: numbers coerced, bad rows dropped."""
    chosen: dict[str, str] = {}
    for name, options in ALIASES.items():
        found = [c for c in options if c in df.columns]
        if found:
            chosen[name] = found[0]
    missing = [c for c in ("ts", "symbol", *PRICE_COLUMNS) if c not in chosen]
    if missing:
        raise MissingColumnsError(f"bars lack columns: {', '.join(missing)}")
    ts = F.col(chosen["ts"])
    if isinstance(df.schema[chosen["ts"]].dataType, T.StringType):
        ts = F.try_to_timestamp(ts)
    out = [F.col(chosen["symbol"]).alias("symbol"), ts.cast("timestamp").alias("ts")]
    out += [_as_double(df, chosen[c]).alias(c) for c in PRICE_COLUMNS]
    out += [_as_double(df, chosen[c]).alias(c) for c in QUOTE_COLUMNS if c in chosen]
    used = set(chosen.values())
    out += [F.col(c) for c in df.columns if c not in used and c not in ALIASES and c != "trade_date"]
    bars = df.select(*out).withColumn("trade_date", F.to_date("ts"))
    if drop_incomplete:
        bars = bars.dropna(subset=["ts", "symbol", *PRICE_COLUMNS])
    return bars


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, header: bool = True) -> DataFrame:
    """CSV with an explicit schema, or any other extension as Parquet."""
    reader = spark.read
    if path.rstrip("/").lower().endswith((".csv", ".csv.gz")):
        reader = reader.option("header", header)
        if schema is not None:
            reader = reader.schema(schema)
        return reader.csv(path)
    return (reader.schema(schema) if schema is not None else reader).parquet(path)


def read_bars(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return normalize_bars(read_table(spark, path, schema))


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, DAILY_SCHEMA if path.rstrip("/").endswith(".csv") else None)


def read_essential(df: DataFrame) -> DataFrame:
    """The stored eleven columns; unreadable timestamps become NULL. Pruned into the scan."""
    require_columns(df, ESSENTIAL_COLUMNS, "history")
    kind = df.schema["ts_event_price"].dataType
    ts = F.try_to_timestamp("ts_event_price") if isinstance(kind, T.StringType) else F.col("ts_event_price")
    return df.select(ts.alias("ts_event_price"), *[c for c in ESSENTIAL_COLUMNS if c != "ts_event_price"])


def read_monthly(
    spark: SparkSession, path: str, symbols=None, year: int | None = None, month: int | None = None
) -> DataFrame:
    """Monthly feature files partitioned by symbol and ym ('YYYY-MM'); the filters prune folders.

    The schema is the one that the writer keeps beside the data; no file is opened to find it.
    """
    from barloom.sources.stores import load_schema

    schema = load_schema(spark, path)
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if symbols:
        df = df.filter(F.col("symbol").isin(list(symbols)))
    if year is not None and month is not None:
        df = df.filter(F.col("ym") == f"{year:04d}-{month:02d}")
    elif year is not None:
        df = df.filter(F.col("ym").startswith(f"{year:04d}-"))
    elif month is not None:
        df = df.filter(F.col("ym").endswith(f"-{month:02d}"))
    return df


#: Columns of monthly files that are not numbers.
TEXT_COLUMNS = ("symbol", "RSI_Regime", "Market_Regime", "reason")
TIME_COLUMNS = ("timestamp", "ts", "ts_event", "ts_event_clean")


#: Files whose first lines are fetched one by one; more are read by a pass over all of them.
FETCHED_HEADERS = 20_000


def _headers(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """The first line of every file, by path; an empty file has none.

    Only the beginning of a file is read, through the file system that the path names, many at a time. The list of files
    is on the driver already.
    """
    if len(files) > FETCHED_HEADERS:
        lines = spark.read.text(files).select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value",
            F.monotonically_increasing_id().alias("i"),
        )
        first = lines.filter("start = 0").groupBy("path").agg(F.min_by("value", "i").alias("header"))
        return {r["path"]: r["header"] for r in first.collect()}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first_line(file: str) -> str | None:
        path = jvm.org.apache.hadoop.fs.Path(file)
        stream = path.getFileSystem(conf).open(path)
        try:
            codec = codecs.getCodec(path)
            plain = codec.createInputStream(stream) if codec is not None else stream
            return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8")).readLine()
        finally:
            stream.close()

    with ThreadPoolExecutor(32) as pool:
        found = zip(files, pool.map(first_line, files))
        return {f: h for f, h in found if h is not None}


def read_monthly_csv(
    spark: SparkSession, folder: str, symbols=None, year: int | None = None, month: int | None = None
) -> DataFrame:
    """Legacy layout: files named monthly_<SYMBOL>_<YYYY-MM>.csv; the name supplies symbol and ym.

    Every file is read by its own header: files of one header together, then all united by column name; a column
    that a file lacks is NULL in its rows. Symbols without files and patterns without a match add nothing. Numbers
    become doubles and times timestamps; what cannot be read is NULL.
    """
    from barloom.sources.stores import list_paths

    y = f"{year:04d}" if year is not None else "*"
    m = f"{month:02d}" if month is not None else "*"
    names = [f"{folder.rstrip('/')}/monthly_{s}_{y}-{m}.csv" for s in (symbols or ["*"])]
    found = [f for n in names for f in list_paths(spark, n)]
    files = [g for f in found for g in (list_paths(spark, f"{f}/part-*") or [f])]  # a file, or a folder of parts
    path, shape = F.col("_metadata.file_path"), r"monthly_([^/]+)_(\d{4}-\d{2})\.csv"
    by_header: dict[str, list[str]] = {}
    for file, header in _headers(spark, files).items() if files else ():
        by_header.setdefault(header, []).append(file)
    tables = []
    for same in by_header.values():
        df = spark.read.option("header", True).csv(same)
        typed = {
            c: F.try_to_timestamp(c) if c in TIME_COLUMNS else F.col(c).try_cast("double")
            for c in df.columns if c not in TEXT_COLUMNS
        }
        df = df.withColumns(typed | {"file_symbol": F.regexp_extract(path, shape, 1), "file_ym": F.regexp_extract(path, shape, 2)})
        tables.append(df)
    return concat_tables(tables) if tables else spark.createDataFrame([], "file_symbol string, file_ym string")


def concat_tables(tables: list[DataFrame]) -> DataFrame:
    """Bag union aligned by column name; a column a table lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def tick_order(ts: Column, seq: Column | None) -> Column:
    """Sortable number for (ts, seq). A decimal keeps min_by/max_by in hash aggregation, a struct would not."""
    micros = F.unix_micros(ts)
    if seq is None:
        return micros
    return micros.cast("decimal(18,0)") * F.expr("CAST(10000000000000000000 AS DECIMAL(20,0))") + seq.cast("decimal(19,0)")


def floor_seconds(ts: Column, seconds: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / seconds) * seconds)


def ticks_to_bars(
    ticks: DataFrame, width_seconds: int = 60, seq: str | None = None, extra: dict[str, Column] | None = None
) -> DataFrame:
    """OHLCV bars from (symbol, ts, price, size) ticks.

    Partial aggregation runs before the exchange, so a symbol holding most ticks still ships only one
    row per bar and map task.
    """
    order = tick_order(F.col("ts"), F.col(seq) if seq else None)
    keyed = ticks.withColumns({"_bar": floor_seconds(F.col("ts"), width_seconds), "_order": order})
    aggs = [
        F.min_by("price", "_order").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "_order").alias("close"),
        F.sum("size").alias("volume"),
    ]
    aggs += [c.alias(name) for name, c in (extra or {}).items()]
    return keyed.groupBy("symbol", F.col("_bar").alias("ts")).agg(*aggs)


def one_bar_per_minute(bars: DataFrame, seq: str | None = None) -> DataFrame:
    """Last record of each minute as that minute's snapshot."""
    order = tick_order(F.col("ts"), F.col(seq) if seq else None)
    keyed = bars.withColumns({"_minute": F.date_trunc("minute", "ts"), "_order": order})
    rest = [c for c in bars.columns if c not in ("symbol", "ts")]
    return keyed.groupBy("symbol", F.col("_minute").alias("ts")).agg(
        *[F.max_by(c, "_order").alias(c) for c in rest]
    )


def daily_from_bars(bars: DataFrame) -> DataFrame:
    """Daily OHLCV per symbol from finer bars."""
    return bars.groupBy("symbol", F.to_date("ts").alias("date")).agg(
        F.min_by("open", "ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"),
    )


def with_day_session(bars: DataFrame) -> DataFrame:
    """Library default: one session per UTC date."""
    return bars.withColumn("session", F.to_date("ts"))


def with_week_session(bars: DataFrame) -> DataFrame:
    """One session per calendar week, for bars wider than a minute."""
    return bars.withColumn("session", F.to_date(F.date_trunc("week", "ts")))
