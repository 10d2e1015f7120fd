"""Streaming jobs, run to completion over the event table, and the live screening path."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from barloom.catalog import SQL, register
from barloom.catalog.features import R_LEVELS, features
from barloom.catalog.signals import (
    CANDIDATES_SQL,
    HORIZON,
    LEVELS_SQL,
    SCREEN_SQL,
    LEVEL_COLUMNS,
    OUTER,
    candidates,
    entry_rows,
    level_rows,
)
from barloom.catalog.sql_parts import BARS, DAILY, SERIES, TICKS, WINDOWS, level, r6, to6
from barloom.operators import labels, models
from barloom.operators.clean import optimize_features
from barloom.plans.features import feature_table
from barloom.session import scratch_path, written_table
from barloom.sources import driver_tables as D
from barloom.streaming import live as L
from barloom.streaming import quotes as Q
from barloom.streaming import stateful
from barloom.streaming.progress import ProgressTable


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a file stream."""
    schema = D.table(spark, sf_dir, "events").schema
    return Q.stream_table(spark, f"{sf_dir}/events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def drain(writer: DataStreamWriter, spark: SparkSession) -> str:
    """Run a streaming query over all present input into a Parquet folder; its path."""
    out = scratch_path(spark, "stream")
    q = (
        writer.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "progress"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return out


def _message() -> Column:
    """A snapshot message as the vendor sends it, from one event."""
    price = F.format_string("%.2f", "value")
    return F.to_json(
        F.struct(
            F.col("user_id").alias("conid"), F.lit("smd").alias("topic"), F.unix_millis("ts").alias("_updated"),
            F.concat(F.lit("C"), price).alias("31"), price.alias("84"), price.alias("86"),
            F.concat(F.col("user_id").cast("string"), F.lit("K")).alias("85"), F.lit("1,200").alias("88"),
            F.concat(F.col("user_id").cast("string"), F.lit("M")).alias("87"),
        )
    )


@register(
    "stream_quotes",
    """SELECT event_type AS symbol, user_id AS contract_id, epoch_us(ts) // 1000 AS ts_ms, value AS last_price, value AS bid_price,
  user_id * 1000 AS bid_size, CAST(1200 AS BIGINT) AS ask_size, user_id * 1000000 AS volume FROM events""",
)
def stream_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON snapshots decoded on the stream."""
    messages = event_stream(spark, sf_dir).select("event_type", _message().alias("value"))
    rows = Q.decode_quotes(messages, symbol=F.col("event_type"), topic="smd")
    df = spark.read.schema(rows.schema).parquet(drain(rows.writeStream, spark))
    return df.select(
        "symbol", "contract_id", F.unix_millis("ts").alias("ts_ms"), "last_price", "bid_price", "bid_size", "ask_size", "volume"
    )


@register(
    "stream_latest",
    "SELECT event_type AS symbol, epoch_us(max(ts)) // 1000 AS ts_ms, arg_max(value, ts) AS value FROM events GROUP BY 1",
)
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest snapshot per symbol: each batch replaces the stored state, one row per symbol."""
    out = scratch_path(spark, "latest")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{batch_id}")

    rows = event_stream(spark, sf_dir).select(F.col("event_type").alias("symbol"), "ts", "value")
    q = (
        Q.latest_quotes(rows).writeStream.outputMode("complete").foreachBatch(keep)
        .option("checkpointLocation", scratch_path(spark, "progress")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    last = q.lastProgress["batchId"] if q.lastProgress else 0
    df = spark.read.parquet(f"{out}/{last}")
    return df.select("symbol", F.unix_millis("ts").alias("ts_ms"), "value")


@register(
    "stream_dedupe",
    """SELECT user_id, CAST(floor(epoch(ts) / 60) * 60 AS BIGINT) AS minute_s,
  max(value) + CASE WHEN floor(epoch(ts) / 60) % 3 = 0 THEN 1000 ELSE 0 END AS value FROM events GROUP BY 1, 2, floor(epoch(ts) / 60)""",
)
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two polls that overlap and differ: the second has other values and every third minute that the first had not."""
    e = D.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("symbol"), F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("ts"))
    once = e.agg(F.max("value").alias("value"))
    path = scratch_path(spark, "polls")
    once.filter(F.unix_seconds("ts") / 60 % 3 != 0).coalesce(1).write.mode("append").parquet(path)
    once.withColumn("value", F.col("value") + 1000).coalesce(1).write.mode("append").parquet(path)
    polls = Q.stream_table(spark, path, spark.read.parquet(path).schema, max_files=1)
    df = spark.read.parquet(drain(Q.first_bars(polls, "31 days").writeStream, spark))
    return df.select(F.col("symbol").alias("user_id"), F.unix_seconds("ts").alias("minute_s"), "value")


@register(
    "stream_minute_bars",
    f"""WITH {TICKS} SELECT symbol, CAST(floor(epoch(ts) / 60) * 60 AS BIGINT) AS ts_s, {r6('arg_min(price, ts)')} AS open,
  {r6('max(price)')} AS high, {r6('min(price)')} AS low, {r6('arg_max(price, ts)')} AS close, {r6('sum(size)')} AS volume
FROM ticks GROUP BY 1, 2 HAVING ts_s + 60 <= (SELECT max(epoch(ts)) FROM ticks) - 120""",
)
def stream_minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-minute bars from the tick stream; bars younger than the watermark are not final yet."""
    e = event_stream(spark, sf_dir)
    ticks = e.select(
        F.col("event_type").alias("symbol"), "ts", (F.lit(100.0) + F.col("value") * 0.02).alias("price"),
        ((F.col("user_id") + 1) * 10).cast("double").alias("size"),
    )
    df = spark.read.parquet(drain(Q.tick_bars(ticks).writeStream.outputMode("append"), spark))
    return df.select(
        "symbol", F.unix_seconds("ts").alias("ts_s"), *[to6(c).alias(c) for c in ("open", "high", "low", "close", "volume")]
    )


@register(
    "freshness",
    f"""WITH {BARS}, {DAILY}, a AS (SELECT 'ticks' AS source, max(ts) AS t FROM events UNION ALL SELECT 'bars', max(ts) FROM bars
  UNION ALL SELECT 'daily', CAST(max(date) AS TIMESTAMP) FROM daily)
SELECT source, CAST(epoch(t) AS BIGINT) AS latest_s, {r6("epoch(TIMESTAMP '2024-02-01') - epoch(t)")} AS latency_seconds FROM a""",
)
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    sources = {
        "ticks": (D.event_ticks(spark, sf_dir), "ts"), "bars": (D.event_bars(spark, sf_dir), "ts"),
        "daily": (D.event_daily(spark, sf_dir), "date"),
    }
    f = Q.freshness(sources, now)
    # ticks have fractions of a second: the nearest second is stated, not the one begun
    latest = F.rint(F.unix_micros("latest") / 1e6).cast("long")
    return f.select("source", latest.alias("latest_s"), to6("latency_seconds").alias("latency_seconds"))


def _score(df: DataFrame) -> DataFrame:
    """Stand-in scorer: the position of the price in its day's range."""
    p = F.coalesce(F.col("Position_In_Day_Range"), F.lit(0.0))
    return df.withColumns({"probability": p, "prediction": (p >= 0.5).cast("int")})


_LIVE_LEVELS = ", ".join(level(f"v{i}", "live_s" if i == 0 else f"v{i - 1}", c) for i, c in enumerate([*R_LEVELS, LEVELS_SQL, {"why": SCREEN_SQL}]))
_LIVE = f"""WITH {BARS}, live AS (SELECT * REPLACE (DATE '2000-01-01' AS session) FROM bars
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 60),
{SERIES.replace("s AS (", "live_s AS (", 1).replace("FROM bars", "FROM live")}, {_LIVE_LEVELS},
w AS (SELECT *, min(low) OVER hist AS lo, max(high) OVER hist AS hi, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS newest
  FROM v{len(R_LEVELS) + 1} WINDOW {WINDOWS}),
z AS (SELECT *, CASE WHEN why <> 'conditions_met' THEN 0 WHEN hi > lo THEN greatest(0, least(1, (close - lo) / (hi - lo))) ELSE 0.5 END AS p FROM w WHERE newest = 1)
SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts_s, why = 'conditions_met' AS screen_pass, why AS screen_reason,
  CAST(p >= 0.5 AS INTEGER) AS prediction, {r6('p')} AS probability FROM z"""


def _screened(rows: DataFrame) -> DataFrame:
    return rows.select(
        "symbol", F.unix_seconds("ts").alias("ts_s"), "screen_pass", "screen_reason", "prediction",
        to6("probability").alias("probability"),
    )


@register("live_screen", _LIVE)
def live_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest bar of every symbol: features from its last 60 bars over day boundaries, screened and scored."""
    return _screened(L.assess(L.latest_feature_rows(D.event_bars(spark, sf_dir)), _score))


def _in_files(df: DataFrame, name: str, part: Column, files: int) -> tuple[str, DataFrame]:
    """The rows in files by ``part``, written one after the other, and the stream that takes a file a trigger."""
    spark = df.sparkSession
    path, dealt = scratch_path(spark, name), written_table(df.withColumn("_part", part), name)
    for i in range(files):
        dealt.filter(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(path)
    return path, Q.stream_table(spark, path, spark.read.parquet(path).schema, max_files=1)


@register("stream_screen", _LIVE)
def stream_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live path as a stream of several triggers whose bars come in no order, with the last bars in the state."""
    _, bars = _in_files(D.event_bars(spark, sf_dir), "bars", F.pmod(F.xxhash64("symbol", "ts"), F.lit(4)), 4)
    out = scratch_path(spark, "screened")
    stateful.run_screen(bars, _score, out, scratch_path(spark, "progress"), availableNow=True).awaitTermination()
    done = spark.read.parquet(out)
    last = done.groupBy("symbol").agg(F.max("batch_id").alias("batch_id"))
    return _screened(done.join(last, ["symbol", "batch_id"]))


_MODEL_FEATURES = ["RSI_14", "Return_5min", "Position_In_Day_Range", "Volume_Percentile_Intraday"]


def fitted_scorer(spark: SparkSession, sf_dir: str):
    """A pipeline fitted on labelled bars, saved and loaded again, as a live process would find it."""
    bars = D.event_bars(spark, sf_dir)
    labelled = written_table(labels.label_own_series(feature_table(bars, columns=[*LEVEL_COLUMNS, *_MODEL_FEATURES]), "close", HORIZON, OUTER), "labelled")
    rows = labelled.withColumn("buy", F.col("buy").cast("int"))
    path = scratch_path(spark, "live-model")
    models.save_model(models.train_models(optimize_features(rows), _MODEL_FEATURES, "buy", {"m": GBTClassifier(maxIter=3, maxDepth=3, seed=42)})["m"], path)
    return models.scorer(models.load_model(path), _MODEL_FEATURES)


@register("stream_screen_model")
def stream_screen_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateful live path scored by a fitted pipeline, and the same rows scored by the batch path: no difference."""
    score = fitted_scorer(spark, sf_dir)
    bars = D.event_bars(spark, sf_dir)
    _, stream = _in_files(bars, "bars", F.pmod(F.xxhash64("symbol", "ts"), F.lit(3)), 3)
    out = scratch_path(spark, "screened")
    stateful.run_screen(stream, score, out, scratch_path(spark, "progress"), availableNow=True).awaitTermination()
    done = spark.read.parquet(out)
    last = done.groupBy("symbol").agg(F.max("batch_id").alias("batch_id"))
    batch = _screened(L.assess(L.latest_feature_rows(bars), score)).withColumnRenamed("probability", "batch_probability")
    return _screened(done.join(last, ["symbol", "batch_id"])).join(batch.select("symbol", "batch_probability"), "symbol", "left")


@register("stream_screen_store", _LIVE)
def stream_screen_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live path against a store: the micro-batch of new bars is screened with the stored ones and written by its
    number; a second run of the same batch changes nothing."""
    bars_path, out = scratch_path(spark, "bars"), scratch_path(spark, "screened")
    D.event_bars(spark, sf_dir).write.parquet(bars_path)
    schema = spark.read.parquet(bars_path).schema

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        store = batch.sparkSession.read.schema(schema).parquet(bars_path)
        for _ in range(2):  # as after a failure between the write and the commit
            known = L.seen_by_batch(store, batch)
            L.write_batch(L.assess(L.latest_feature_rows(known), _score), batch_id, out)

    q = L.run_live(Q.stream_table(spark, bars_path, schema), on_batch, scratch_path(spark, "progress"), availableNow=True)
    q.awaitTermination()
    return _screened(spark.read.parquet(out))


@register(
    "stream_positions",
    f"{SQL['one_position_at_a_time'].split('SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts_s, exit_reason,')[0]}"
    "SELECT k.symbol, CAST(epoch(k.ts) AS BIGINT) AS ts_s, CAST(epoch(t.bts) AS BIGINT) AS exit_s, k.exit_reason FROM kept k JOIN trades t USING (symbol, ts) WHERE t.bts IS NOT NULL",
)
def stream_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions opened and closed on the stream, held over triggers: as the position rule over all trades, but for open ones."""
    events = stateful.position_events(D.event_bars(spark, sf_dir), entry_rows(spark, sf_dir))
    # four triggers of a week or so each
    part = F.least(F.floor((F.col("at") / 1e6 - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))) / (8 * 86_400)), F.lit(3)).cast("int")
    _, stream = _in_files(events, "position-events", F.greatest(part, F.lit(0)), 4)
    with stateful.state_store(spark):
        closed = spark.read.parquet(drain(stateful.closed_positions(stream).writeStream, spark))
    return closed.select("symbol", F.unix_seconds("ts").alias("ts_s"), F.unix_seconds("exit_ts").alias("exit_s"), "exit_reason")


@register(
    "stream_progress",
    "SELECT 'ticks' AS name, CAST(4 AS BIGINT) AS batches, count(*) AS input_rows, epoch_us(max(ts)) // 1000 AS newest_ms, CAST(120 AS DOUBLE) AS final_lag_seconds FROM events",
)
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress rows of a drained query: its triggers, their rows, the newest event, and how far the last watermark is behind it."""
    rows = D.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    _, stream = _in_files(rows, "ticks", F.pmod(F.xxhash64("ts", "user_id"), F.lit(4)), 4)
    table = ProgressTable(spark, scratch_path(spark, "query-progress"), every=3)
    spark.streams.addListener(table)
    try:
        counted = stream.withWatermark("ts", "2 minutes").groupBy(F.window("ts", "1 minute")).count()
        drain(counted.select("window.start", "count").writeStream.queryName("ticks"), spark)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(table)
    rows = F.col("input_rows") > 0  # a last trigger without rows reports the final watermark
    lag = (F.unix_millis(F.max("newest_event")) - F.unix_millis(F.max("watermark"))) / 1000
    return table.table().groupBy("name").agg(
        F.count_if(rows).alias("batches"), F.sum("input_rows").alias("input_rows"), F.unix_millis(F.max("newest_event")).alias("newest_ms"), lag.alias("final_lag_seconds"),
    )


_GATE = ", ".join(
    [CANDIDATES_SQL] + [level(f"q{i}", "s" if i == 0 else f"q{i - 1}", c) for i, c in enumerate([*R_LEVELS, LEVELS_SQL, {"why": SCREEN_SQL}])]
)
_LAST_LEVEL = f"q{len(R_LEVELS) + 1}"


@register(
    "swing_gate",
    f"""WITH {_GATE}, g AS (SELECT symbol, ts, why, EXISTS (SELECT 1 FROM candidates c WHERE c.symbol = e.symbol
  AND abs(epoch(c.ts) - epoch(e.ts)) <= 60) AS low FROM {_LAST_LEVEL} e)
SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts_s, low AS is_swing_low, low AND why = 'conditions_met' AS gate_pass,
  CASE WHEN why = 'conditions_met' THEN CASE WHEN low THEN why || '_at_swing_low' ELSE 'rejected_not_at_swing_low' END
       WHEN low THEN 'at_swing_low_but_' || why ELSE 'no_swing_low_and_' || why END AS gate_reason FROM g""",
)
def swing_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    screened = labels.screen(level_rows(spark, sf_dir)).select("symbol", "ts", "screen_pass", "screen_reason")
    gated = L.swing_gate(screened, candidates(spark, sf_dir))
    return gated.select("symbol", F.unix_seconds("ts").alias("ts_s"), "is_swing_low", "gate_pass", "gate_reason")


@register(
    "replay_asof",
    f"""WITH {BARS} SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts_s FROM bars
WHERE trade_date = DATE '2024-01-17' AND ts <= TIMESTAMP '2024-01-17 15:00:00' - INTERVAL 1 MINUTE""",
)
def replay_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("2024-01-17 15:00:00").cast("timestamp")
    return L.replay_asof(D.event_bars(spark, sf_dir), at).select("symbol", F.unix_seconds("ts").alias("ts_s"))


@register(
    "replay_offset",
    f"""WITH {BARS} SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts_s FROM bars
WHERE trade_date = DATE '2024-01-09' AND ts <= TIMESTAMP '2024-01-09 12:30:00' - INTERVAL 1 MINUTE""",
)
def replay_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replay three quarters of an hour behind a clock that stands at 13:15."""
    now = F.lit("2024-01-09 13:15:00").cast("timestamp")
    return L.replay_offset(D.event_bars(spark, sf_dir), 45, now).select("symbol", F.unix_seconds("ts").alias("ts_s"))


_REPLAYS = "SELECT DISTINCT o_orderkey, TIMESTAMP '2024-01-02 00:00:00' + INTERVAL 37 MINUTE * (o_orderkey % 1000) AS replay_at FROM orders"


@register(
    "replay_many",
    f"""WITH {BARS}, times AS (SELECT DISTINCT replay_at FROM ({_REPLAYS}))
SELECT CAST(epoch(replay_at) AS BIGINT) AS replay_s, count(*) AS bars, CAST(epoch(max(ts)) AS BIGINT) AS newest_s, {r6('sum(volume)')} AS volume
FROM times JOIN bars ON trade_date = CAST(replay_at AS DATE) AND ts <= replay_at - INTERVAL 1 MINUTE GROUP BY replay_at""",
)
def replay_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of a thousand replay times sees."""
    start = F.unix_seconds(F.lit("2024-01-02").cast("timestamp"))
    times = D.table(spark, sf_dir, "orders").select(F.timestamp_seconds(start + 37 * 60 * (F.col("o_orderkey") % 1000)).alias("replay_at"))
    seen = L.replay_many(D.event_bars(spark, sf_dir), times)
    return seen.groupBy(F.unix_seconds("replay_at").alias("replay_s")).agg(
        F.count(F.lit(1)).alias("bars"), F.unix_seconds(F.max("ts")).alias("newest_s"), to6(F.sum("volume")).alias("volume")
    )


@register(
    "entry_signals",
    f"""WITH {_GATE}, p AS (SELECT *, min(low) OVER hist AS lo, max(high) OVER hist AS hi FROM {_LAST_LEVEL} WINDOW {WINDOWS}),
z AS (SELECT symbol, ts, why, CASE WHEN hi > lo THEN greatest(0, least(1, (close - lo) / (hi - lo))) ELSE 0.5 END AS p FROM p)
SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts_s, {r6('p')} AS probability FROM z WHERE why = 'conditions_met' AND p > 0.7""",
)
def entry_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screened rows whose score asks for an entry."""
    rows = labels.screen(features(spark, sf_dir, [*LEVEL_COLUMNS, "Position_In_Day_Range"]))
    return L.entry_signals(_score(rows)).select("symbol", F.unix_seconds("ts").alias("ts_s"), to6("probability").alias("probability"))
