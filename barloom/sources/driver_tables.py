"""Market inputs derived from the generic star-schema and event tables used for checking.

``events`` are the ticks: the event type is the symbol, the value sets the price, the user id the size.
``lineitem`` gives long daily series per supplier. ``documents`` with ``labels`` give a
classification task.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.bars import daily_from_bars, ticks_to_bars, with_day_session, with_week_session

BAR_SECONDS = 1800
#: Users that make one symbol of an event type where bars are to grow with the table.
USERS_PER_SYMBOL = 75
_fine: ContextVar[bool] = ContextVar("fine", default=False)


@contextmanager
def minute_bars() -> Iterator[None]:
    """Within, bars are one-minute bars in day sessions, and symbols are (event type, group of users), so that symbols
    and bars grow with the table."""
    token = _fine.set(True)
    try:
        yield
    finally:
        _fine.reset(token)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One checking table. Its times carry no zone, so the session reads them as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbol = F.col("event_type")
    if _fine.get():
        symbol = F.concat_ws(".", symbol, F.floor(F.col("user_id") / USERS_PER_SYMBOL).cast("string"))
    return table(spark, sf_dir, "events").select(
        symbol.alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.lit(100.0) + F.col("value") * 0.02).alias("price"),
        ((F.col("user_id") + 1) * 10).cast("double").alias("size"),
        "event_id",
    )


def event_bars(spark: SparkSession, sf_dir: str, width_seconds: int | None = None) -> DataFrame:
    """Bars with deterministic quotes around the close, in weekly sessions (one-minute bars in days)."""
    width_seconds = width_seconds or (60 if _fine.get() else BAR_SECONDS)
    bars = ticks_to_bars(
        event_ticks(spark, sf_dir),
        width_seconds,
        extra={"_last_id": F.max_by("event_id", "_order")},
    )
    i, c = F.col("_last_id"), F.col("close")
    bars = bars.withColumns(
        {
            "bid_px": c - c * 0.0005 * (1 + i % 7),
            "ask_px": c + c * 0.0005 * (1 + i % 5),
            "bid_sz": (100 * (1 + i % 9)).cast("double"),
            "ask_sz": (100 * (1 + i % 4)).cast("double"),
            "trade_date": F.to_date("ts"),
        }
    ).drop("_last_id")
    return with_day_session(bars) if _fine.get() else with_week_session(bars)


def event_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_from_bars(event_bars(spark, sf_dir))


def supplier_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily OHLCV per supplier from order lines: price per unit, ordered by order and line."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("symbol"),
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_orderkey") * 10000000000 + F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("_seq"),
    )
    return lines.groupBy("symbol", "date").agg(
        F.min_by("price", "_seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "_seq").alias("close"),
        F.sum("quantity").alias("volume"),
    )
