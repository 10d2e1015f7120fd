"""As-of daily values for each bar: the official open and the trailing daily mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_context(daily: DataFrame, days: DataFrame) -> DataFrame:
    """One row per (symbol, date) in ``days``: what the daily table shows on that date.

    On date D the daily rows with date <= D are visible and D's own row shows only its open. So
    ``day_open`` is the open of the latest visible row and ``daily_mean50`` the mean close of the last 50
    visible rows, D's row counting as one without a close. A day missing from ``daily`` sees the rows
    before it. Frames run over one symbol's days, a calendar-bounded group, and hold at most 50 rows.
    """
    by_day = Window.partitionBy("symbol").orderBy("date")
    listed = daily.groupBy("symbol", "date").agg(F.max("open").alias("open"), F.max("close").alias("close"))
    listed = listed.select(
        "symbol", "date",
        F.avg("close").over(by_day.rowsBetween(-49, -1)).alias("mean_today"),
        F.struct("open", F.avg("close").over(by_day.rowsBetween(-49, 0)).alias("mean_after")).alias("row"),
    )
    marks = days.select("symbol", "date").distinct().withColumn("_wanted", F.lit(True))
    merged = marks.join(listed, ["symbol", "date"], "full_outer")
    latest = F.last("row", ignorenulls=True).over(by_day.rowsBetween(Window.unboundedPreceding, 0))
    merged = merged.withColumn("_latest", latest).filter("_wanted")
    mean = F.when(F.col("row").isNotNull(), F.col("mean_today")).otherwise(F.col("_latest.mean_after"))
    return merged.select("symbol", "date", F.col("_latest.open").alias("day_open"), mean.alias("daily_mean50"))


def join_daily(bars: DataFrame, daily: DataFrame | None, date: str = "trade_date") -> DataFrame:
    """Attach day_open and daily_mean50 to every bar by symbol and the named date column."""
    if daily is None:
        null = F.lit(None).cast("double")
        return bars.withColumns({"day_open": null, "daily_mean50": null})
    days = bars.select("symbol", F.col(date).alias("date"))
    context = daily_context(daily, days).withColumnRenamed("date", date)
    return bars.join(context, ["symbol", date], "left")
