"""Live screening: the batch feature logic on the last bars of every symbol, once per trigger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.clean import optimize_features
from barloom.operators.labels import screen
from barloom.operators.reports import last_n_per_key
from barloom.operators.swings import nearest_minute
from barloom.plans.features import feature_table

LIVE_BARS = 60


def latest_feature_rows(
    bars: DataFrame, daily: DataFrame | None = None, last: int = LIVE_BARS, since: Column | None = None
) -> DataFrame:
    """Features of the newest bar per symbol, computed from its last ``last`` bars.

    The bars of earlier days count: just after the open, history is the day before. ``since`` bounds the scan; give a
    time that surely holds enough bars.
    """
    known = bars if since is None else bars.filter(F.col("ts") >= since)
    recent = last_n_per_key(known, ["symbol"], "ts", last).withColumn("session", F.lit("live"))
    return last_n_per_key(feature_table(recent, daily), ["symbol"], "ts", 1)


def assess(rows: DataFrame, scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Screen rows and score them; those that do not pass get probability 0 and prediction 0.

    ``scorer`` adds prediction and probability. One projection serves both outcomes, so features are computed once.
    """
    screened = screen(rows)
    if scorer is None:
        return screened.withColumns({"prediction": F.lit(0), "probability": F.lit(0.0)})
    scored = scorer(optimize_features(screened))
    keep = ["symbol", "ts", "close", "screen_pass", "screen_reason"]
    levels = [c for c in ("1R_Stop_Loss", "2R_Target") if c in screened.columns]
    return scored.select(
        *keep, *levels, F.when(F.col("screen_pass"), F.col("prediction")).otherwise(0).alias("prediction"),
        F.when(F.col("screen_pass"), F.col("probability")).otherwise(0.0).alias("probability"),
    )


def write_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """Write a micro-batch's rows under its number: a batch that runs again replaces its own rows."""
    (
        rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
    )


def seen_by_batch(history: DataFrame, batch: DataFrame, days: int | None = None) -> DataFrame:
    """Stored bars of the batch's symbols up to the batch's last bar, of any age.

    ``days`` is for callers who know that so many days before the batch's first bar hold all they need: the store is
    then pruned by date. A symbol that trades seldom loses bars by it; `stateful.last_bars` needs no store at all.
    """
    first, final = batch.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        return history.limit(0)
    known = history.filter(F.col("ts") <= F.lit(final))
    if days is not None:
        known = known.filter(F.col("ts") >= F.lit(first) - F.expr(f"INTERVAL {int(days)} DAYS"))
    return known.join(batch.select("symbol").distinct(), "symbol", "left_semi")


def swing_gate(assessed: DataFrame, swing_minutes: DataFrame, tolerance_seconds: int = 60) -> DataFrame:
    """Pass only rows that pass the screen and lie within the tolerance of a swing-low minute."""
    near = nearest_minute(assessed.select("symbol", "ts"), swing_minutes, tolerance_seconds).select(
        "symbol", "ts", F.lit(True).alias("_near")
    )
    df = assessed.join(near, ["symbol", "ts"], "left")
    ok, at_low = F.col("screen_pass"), F.col("_near").isNotNull()
    reason = (
        F.when(ok & ~at_low, F.lit("rejected_not_at_swing_low"))
        .when(ok & at_low, F.concat("screen_reason", F.lit("_at_swing_low")))
        .when(at_low, F.concat(F.lit("at_swing_low_but_"), "screen_reason"))
        .otherwise(F.concat(F.lit("no_swing_low_and_"), "screen_reason"))
    )
    return df.withColumns({"is_swing_low": at_low, "gate_pass": ok & at_low, "gate_reason": reason}).drop("_near")


def entry_signals(assessed: DataFrame, min_probability: float = 0.7, gate: str = "screen_pass") -> DataFrame:
    return assessed.filter(F.col(gate) & (F.col("prediction") == 1) & (F.col("probability") > min_probability))


def replay_asof(bars: DataFrame, at: Column) -> DataFrame:
    """Bars a replay at time ``at`` may see: same date, at least one minute old."""
    return bars.filter(
        (F.col("trade_date") == F.to_date(at)) & (F.col("ts") <= at - F.expr("INTERVAL 1 MINUTE"))
    )


def replay_many(bars: DataFrame, times: DataFrame, minutes: int = 60) -> DataFrame:
    """``replay_at`` and the bars that a replay at it may see, for every row of ``times`` (replay_at): one equi-join.

    A day is cut into buckets of ``minutes``. A replay time meets all buckets of its date up to its own, and only in that
    one are times compared; so a day that holds most bars, or most replay times, is dealt to as many keys as it has
    buckets. Equal replay times are one; a NULL time sees nothing.
    """
    width = minutes * 60
    seen = F.col("replay_at") - F.expr("INTERVAL 1 MINUTE")

    def bucket(at: Column) -> Column:
        return F.floor((F.unix_seconds(at) - F.unix_seconds(F.date_trunc("day", at))) / width)

    upto = F.when(F.to_date(seen) == F.to_date("replay_at"), F.sequence(F.lit(0).cast("long"), bucket(seen)))
    wanted = times.select("replay_at").distinct().withColumns({"_until": seen, "_last": bucket(seen)})
    wanted = wanted.select("replay_at", "_until", "_last", F.to_date("replay_at").alias("_date"), F.explode(upto).alias("_bucket"))
    # a bar's own date decides, and its time within it
    dealt = bars.withColumns({"_date": F.col("trade_date"), "_bucket": F.when(F.to_date("ts") == F.col("trade_date"), bucket(F.col("ts")))})
    met = dealt.join(wanted, ["_date", "_bucket"]).filter((F.col("_bucket") < F.col("_last")) | (F.col("ts") <= F.col("_until")))
    return met.select("replay_at", *bars.columns)


def replay_offset(bars: DataFrame, minutes: int, now: Column | None = None) -> DataFrame:
    """Replay at a fixed distance behind the clock."""
    clock = now if now is not None else F.current_timestamp()
    return replay_asof(bars, clock - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))


def run_live(bars_stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Start the screening query: ``on_batch`` gets every micro-batch of new bars."""
    return (
        bars_stream.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(**(trigger or {"processingTime": "30 seconds"}))
        .start()
    )
