"""Quote snapshots and tick streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.scalars import parse_number

# fixed values: numeric field code of the snapshot message for each quote column
PRICE_FIELDS = {
    "last_price": "31", "bid_price": "84", "ask_price": "86", "high_price": "70", "low_price": "71",
    "close_price": "7059",
}
SIZE_FIELDS = {"bid_size": "85", "ask_size": "88", "volume": "87"}

MESSAGE_SCHEMA = T.StructType(
    [T.StructField("conid", T.LongType()), T.StructField("topic", T.StringType()), T.StructField("_updated", T.LongType())]
    + [T.StructField(code, T.StringType()) for code in (*PRICE_FIELDS.values(), *SIZE_FIELDS.values())]
)


def decode_quotes(messages: DataFrame, json: str = "value", symbol: Column | None = None, topic: str | None = None) -> DataFrame:
    """JSON snapshots to typed quote rows; works on a batch or a stream.

    Without ``symbol`` the contract id stands for it (join a contract table afterwards).
    """
    m = messages.withColumn("_m", F.from_json(json, MESSAGE_SCHEMA))
    if topic is not None:
        m = m.filter(F.col("_m.topic") == topic)
    columns = [
        (symbol if symbol is not None else F.col("_m.conid").cast("string")).alias("symbol"),
        F.col("_m.conid").alias("contract_id"),
        (F.col("_m._updated") / 1000).alias("server_epoch"),
        F.timestamp_millis("_m._updated").alias("ts"),
    ]
    columns += [parse_number(F.col("_m").getField(code)).alias(n) for n, code in PRICE_FIELDS.items()]
    columns += [parse_number(F.col("_m").getField(code)).cast("long").alias(n) for n, code in SIZE_FIELDS.items()]
    return m.select(*columns)


def stream_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """File stream over a folder; a path naming one file streams that file of its folder."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).load(p.getParent().toString())
    return reader.load(path)


def latest_quotes(quotes: DataFrame) -> DataFrame:
    """Running latest snapshot per symbol (update or complete mode)."""
    rest = [c for c in quotes.columns if c not in ("symbol", "ts")]
    return quotes.groupBy("symbol").agg(
        F.max("ts").alias("ts"), F.max_by(F.struct(*rest), "ts").alias("_q")
    ).select("symbol", "ts", "_q.*")


def first_bars(bars: DataFrame, delay: str = "10 minutes", keys=("symbol", "ts")) -> DataFrame:
    """First arrival per (symbol, bar time); repeats from overlapping polls are dropped within the delay."""
    return bars.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def tick_bars(ticks: DataFrame, width: str = "1 minute", delay: str = "2 minutes") -> DataFrame:
    """OHLCV bars from a tick stream; a bar is emitted once when the watermark passes its end."""
    w = F.window("ts", width)
    micros = F.unix_micros("ts")
    return (
        ticks.withWatermark("ts", delay)
        .withColumn("_order", micros)
        .groupBy("symbol", w.alias("w"))
        .agg(
            F.min_by("price", "_order").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "_order").alias("close"),
            F.sum("size").alias("volume"),
        )
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def freshness(sources: dict[str, tuple[DataFrame, str]], now: Column) -> DataFrame:
    """Per source the newest event time and its age in seconds."""
    out = None
    for name, (df, column) in sources.items():
        part = df.agg(F.max(F.col(column).cast("timestamp")).alias("latest")).select(F.lit(name).alias("source"), "latest")
        out = part if out is None else out.unionByName(part)
    age = (F.unix_micros(now) - F.unix_micros("latest")) / 1e6
    return out.withColumn("latency_seconds", age)
