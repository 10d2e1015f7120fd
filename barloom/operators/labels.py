"""Entry screening and barrier labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.frames import SESSION_KEYS

# fixed values: fields an entry needs, in the order they are checked
REQUIRED_LEVELS = ("Current_Price", "1R_Stop_Loss", "1R_Target", "2R_Target", "ATR_Distance")
MAX_SPREAD_PCT = 0.5


def _name(columns, *options: str) -> str | None:
    return next((c for c in options if c in columns), None)


def screen_columns(columns) -> tuple[Column, Column]:
    """(passed, reason) of the basic entry conditions."""
    reason = F.lit(None).cast("string")
    for field in reversed(REQUIRED_LEVELS):
        x = F.col(field) if field in columns else F.lit(None).cast("double")
        bad = x.isNull() | F.isnan(x) | (x <= 0)
        reason = F.when(bad, f"missing_or_invalid_{field.lower()}").otherwise(reason)
    bid, ask = _name(columns, "bid_px", "bidPrice"), _name(columns, "ask_px", "askPrice")
    if bid and ask:
        wide = (
            (F.col(bid) > 0)
            & (F.col(ask) > 0)
            & (F.col("Current_Price") > 0)
            & ((F.col(ask) - F.col(bid)) * 100 > F.col("Current_Price") * MAX_SPREAD_PCT)
        )
        reason = F.coalesce(reason, F.when(wide, "spread_too_wide"))
    reason = F.coalesce(reason, F.lit("conditions_met"))
    return reason == "conditions_met", reason


def screen(df: DataFrame) -> DataFrame:
    passed, reason = screen_columns(df.columns)
    return df.withColumns({"screen_pass": passed, "screen_reason": reason})


def with_default_targets(df: DataFrame) -> DataFrame:
    """Missing 3R and 4R targets continue the 1R-to-2R step."""
    step = F.col("2R_Target") - F.col("1R_Target")
    third = F.col("2R_Target") + step
    if "3R_Target" in df.columns:
        third = F.coalesce(F.col("3R_Target"), third)
    df = df.withColumn("3R_Target", third)
    fourth = F.col("3R_Target") + step
    if "4R_Target" in df.columns:
        fourth = F.coalesce(F.col("4R_Target"), fourth)
    return df.withColumn("4R_Target", fourth)


def _label(df: DataFrame) -> DataFrame:
    """Label rows that carry _path (later closes in the horizon), _ahead and _outer."""

    def first(test) -> Column:
        return F.get(F.filter("_path", test), 0)["at"]

    df = df.withColumns(
        {
            "_t0": first(lambda x: x["close"] <= F.col("1R_Stop_Loss")),
            "_t2": first(lambda x: x["close"] >= F.col("2R_Target")),
            "_t3": first(lambda x: x["close"] >= F.col("3R_Target")),
            "_t4": first(lambda x: x["close"] >= F.col("4R_Target")),
        }
    )
    passed, reason = screen_columns(df.columns)
    t0, t2, t3, t4 = (F.col(c) for c in ("_t0", "_t2", "_t3", "_t4"))
    stopped = t0.isNotNull() & (t2.isNull() | (t0 <= t2))
    outcome = (
        F.when(~passed, reason)
        .when(~F.col("_ahead"), "no_future_data")
        .when(~F.col("_outer"), "no_data_in_time_window")
        .when(stopped, "reached_negative_1r")
        .when(t2.isNull(), "timeout_no_2r")
        .when(t3.isNull(), "reached_2r_success")
        .when(t4 == t3, "reached_4r_success")
        .otherwise("reached_3r_success")
    )
    df = df.withColumn("reason", outcome)
    level = F.regexp_extract("reason", r"^reached_([234])r_success$", 1)
    r = F.when(level != "", level.cast("int")).otherwise(0)
    when_hit = F.when(r == 2, t2).when(r >= 3, t3)
    minutes = F.coalesce(F.floor((when_hit - F.col("_at")) / 60).cast("int"), F.lit(0))
    return df.withColumns({"buy": r >= 2, "R": r, "time_minutes": minutes})


def label_barriers(
    entries: DataFrame, bars: DataFrame, horizon_minutes: int = 40, outer_minutes: int = 240, keys=SESSION_KEYS
) -> DataFrame:
    """Label each entry by the barrier later closes of its session touch first.

    Entries and bars share one window, so each entry sees only the closes inside its horizon: no join
    and no pairs. Bars must hold one row per minute (see ``one_bar_per_minute``).
    """
    entries = with_default_targets(entries)
    fields = [c for c in entries.columns if c not in keys]
    at = F.unix_seconds("ts")
    series = bars.select(*keys, at.alias("_at"), F.col("close").cast("double").alias("_close"))
    asked = entries.select(*keys, at.alias("_at"), F.struct(*fields).alias("_entry"))
    both = series.unionByName(asked, allowMissingColumns=True)
    df = _with_path(both, horizon_minutes, outer_minutes, keys).filter(F.col("_entry").isNotNull())
    df = df.select(*keys, "_at", "_path", "_ahead", "_outer", "_entry.*")
    labelled = _label(df)
    return labelled.drop("_at", "_path", "_ahead", "_outer", "_t0", "_t2", "_t3", "_t4")


def label_own_series(
    rows: DataFrame, price: str = "close", horizon_minutes: int = 40, outer_minutes: int = 240, keys=SESSION_KEYS
) -> DataFrame:
    """Label a feature table whose own rows are the price series: one window, no second input."""
    df = with_default_targets(rows).withColumns(
        {"_at": F.unix_seconds("ts"), "_close": F.col(price).cast("double")}
    )
    df = _label(_with_path(df, horizon_minutes, outer_minutes, keys))
    return df.drop("_at", "_close", "_path", "_ahead", "_outer", "_t0", "_t2", "_t3", "_t4")


def _with_path(df: DataFrame, horizon_minutes: int, outer_minutes: int, keys) -> DataFrame:
    """Closes strictly after each row within the horizon; at most one per minute, so bounded."""
    order = Window.partitionBy(*keys).orderBy("_at")
    close = F.when(F.col("_close").isNotNull(), F.struct(F.col("_at").alias("at"), F.col("_close").alias("close")))
    last = F.max(F.when(F.col("_close").isNotNull(), F.col("_at"))).over(Window.partitionBy(*keys))
    outer = F.count("_close").over(order.rangeBetween(1, outer_minutes * 60))
    return df.withColumns(
        {
            "_path": F.collect_list(close).over(order.rangeBetween(1, horizon_minutes * 60)),
            "_ahead": F.coalesce(last > F.col("_at"), F.lit(False)),
            "_outer": outer > 0,
        }
    )
