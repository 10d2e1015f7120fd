"""Local extrema and higher-swing-low entry candidates.

Extrema look ``order`` bars ahead, and the adaptive order uses the session's last volatility, so these
are batch operators; live use must wait ``order`` bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import in_selection_hours
from barloom.functions.frames import SESSION_KEYS, SessionFrames


def is_local_low(fr: SessionFrames, name: str, order: int) -> Column:
    """Strictly below every neighbour within ``order`` bars; edges use the side that exists."""
    x = F.col(name)
    left = F.min(name).over(fr.rows(-order, -1))
    right = F.min(name).over(fr.rows(1, order))
    return F.coalesce((x < left) & (x < right), F.lit(False))


def is_local_high(fr: SessionFrames, name: str, order: int) -> Column:
    x = F.col(name)
    left = F.max(name).over(fr.rows(-order, -1))
    right = F.max(name).over(fr.rows(1, order))
    return F.coalesce((x > left) & (x > right), F.lit(False))


def local_extrema(bars: DataFrame, price: str = "close", order: int = 4, keys=SESSION_KEYS) -> DataFrame:
    fr = SessionFrames(keys)
    return bars.withColumns(
        {"is_low": is_local_low(fr, price, order), "is_high": is_local_high(fr, price, order)}
    )


def with_running_vwap(bars: DataFrame, keys=SESSION_KEYS) -> DataFrame:
    """Session VWAP up to and including the current bar."""
    fr = SessionFrames(keys)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    value = F.sum(typical * F.col("volume")).over(fr.upto)
    volume = F.sum("volume").over(fr.upto)
    return bars.withColumn("vwap", F.when(volume > 0, value / volume))


def _last_where(fr: SessionFrames, flag: str, value: str) -> Column:
    return F.last(F.when(F.col(flag), F.col(value)), ignorenulls=True).over(fr.hist)


def _within_gap(fr: SessionFrames, flag: str, max_gap_minutes: int) -> Column:
    """First candidate is kept; later ones only if the previous candidate is close enough."""
    previous = _last_where(fr, flag, fr.order)
    gap = F.unix_micros(fr.order) - F.unix_micros(previous)
    return F.col(flag) & (previous.isNull() | (gap <= max_gap_minutes * 60_000_000))


def _near_vwap(price: str, tolerance: float | None, columns) -> Column:
    if tolerance is None or "vwap" not in columns:
        return F.lit(True)
    return F.coalesce(F.abs(F.col(price) - F.col("vwap")) < tolerance, F.lit(False))


def flag_strict_lows(
    bars: DataFrame, price: str = "close", window: int = 4, max_gap_minutes: int = 40,
    vwap_tolerance: float | None = 5.0, keys=SESSION_KEYS,
) -> DataFrame:
    """Adds is_strict_low: a low above the low before it while the latest high tops the high before it."""
    fr = SessionFrames(keys)
    p = F.col(price)
    df = bars.withColumns({"_low": is_local_low(fr, price, window), "_high": is_local_high(fr, price, window)})
    df = df.withColumns(
        {"_prev_low": _last_where(fr, "_low", price), "_prev_high": _last_where(fr, "_high", price)}
    )
    both = F.last(
        F.when(F.col("_high"), F.struct(p.alias("last"), F.col("_prev_high").alias("prior"))), ignorenulls=True
    ).over(fr.hist)
    df = df.withColumn("_highs", both)
    rising = (p > F.col("_prev_low")) & (F.col("_highs")["last"] > F.col("_highs")["prior"])
    df = df.withColumn("_strict", F.coalesce(F.col("_low") & rising, F.lit(False)))
    kept = _within_gap(fr, "_strict", max_gap_minutes) & _near_vwap(price, vwap_tolerance, bars.columns)
    return df.withColumn("is_strict_low", kept).drop(
        "_low", "_high", "_prev_low", "_prev_high", "_highs", "_strict"
    )


def with_adaptive_order(bars: DataFrame, price: str = "close", window: int = 4, keys=SESSION_KEYS) -> DataFrame:
    """Adds adaptive_order, one value per session, from its closing short/long range ratio.

    A missing short mean counts as 0, a missing long mean as 1.
    """
    fr = SessionFrames(keys)
    whole = fr.spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last20, last100 = fr.rows(-19, 0), fr.rows(-99, 0)
    rng = F.when(F.count(price).over(last20) == 20, F.max(price).over(last20) - F.min(price).over(last20))
    df = bars.withColumn("_range", rng)
    df = df.withColumns(
        {
            "_short": F.when(F.count("_range").over(last20) == 20, F.avg("_range").over(last20)),
            "_long": F.when(F.count("_range").over(last100) == 100, F.avg("_range").over(last100)),
        }
    )
    df = df.withColumns({"_short": F.last("_short").over(whole), "_long": F.last("_long").over(whole)})
    short, long = F.coalesce("_short", F.lit(0.0)), F.coalesce("_long", F.lit(1.0))
    vol = F.when(long != 0, short / long).otherwise(F.lit(1.0))
    order = (
        F.when(vol > 1.5, F.lit(min(window + 2, 8))).when(vol < 0.7, F.lit(max(window - 1, 2))).otherwise(window)
    )
    return df.withColumn("adaptive_order", order).drop("_range", "_short", "_long")


def flag_adaptive_lows(
    bars: DataFrame, price: str = "close", window: int = 4, max_gap_minutes: int = 40,
    vwap_tolerance: float | None = 5.0, keys=SESSION_KEYS,
) -> DataFrame:
    """Adds is_adaptive_low: a low above both lows before it, neighbourhood set by adaptive_order."""
    fr = SessionFrames(keys)
    p = F.col(price)
    df = with_adaptive_order(bars, price, window, keys)
    low = F.lit(False)
    for order in sorted({min(window + 2, 8), max(window - 1, 2), window}):
        low = F.when(F.col("adaptive_order") == order, is_local_low(fr, price, order)).otherwise(low)
    df = df.withColumn("_low", low)
    df = df.withColumn("_prev1", _last_where(fr, "_low", price))
    df = df.withColumn("_prev2", _last_where(fr, "_low", "_prev1"))
    rising = (p > F.col("_prev1")) & (p > F.col("_prev2"))
    df = df.withColumn("_adaptive", F.coalesce(F.col("_low") & rising, F.lit(False)))
    kept = _within_gap(fr, "_adaptive", max_gap_minutes) & _near_vwap(price, vwap_tolerance, bars.columns)
    return df.withColumn("is_adaptive_low", kept).drop("_low", "_prev1", "_prev2", "_adaptive")


def swing_candidates(bars: DataFrame, window: int = 4, max_gap_minutes: int = 40,
                     vwap_tolerance: float | None = 5.0, keys=SESSION_KEYS, market_hours: bool = False) -> DataFrame:
    """Distinct swing minutes of either method with tags such as 'adaptive+strict'.

    Both methods flag rows of the same frame, so their union needs no second scan. With ``market_hours`` only bars
    from 09:30 to 15:30 of the market's clock take part, running values included.
    """
    if market_hours:
        bars = bars.filter(in_selection_hours("ts"))
    args = (window, max_gap_minutes, vwap_tolerance, keys)
    df = flag_adaptive_lows(flag_strict_lows(with_running_vwap(bars, keys), "close", *args), "close", *args)
    tags = F.array_compact(
        F.array(F.when(F.col("is_adaptive_low"), "adaptive"), F.when(F.col("is_strict_low"), "strict"))
    )
    hits = df.filter(F.col("is_adaptive_low") | F.col("is_strict_low"))
    return hits.groupBy("symbol", F.date_trunc("minute", "ts").alias("minute")).agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(tags)))), "+").alias("methods"),
        F.max("close").alias("close"),
    )


def union_minutes(*sets: DataFrame) -> DataFrame:
    """Distinct (symbol, minute) over several candidate sets."""
    out = sets[0].select("symbol", "minute")
    for other in sets[1:]:
        out = out.union(other.select("symbol", "minute"))
    return out.distinct()


def nearest_minute(points: DataFrame, minutes: DataFrame, tolerance_seconds: int = 60) -> DataFrame:
    """For each (symbol, ts) point the closest (symbol, minute) within the tolerance, earliest on ties.

    Points are keyed to the buckets their tolerance can reach, so this is an equi-join, not a range join.
    """
    width = max(tolerance_seconds, 1)
    at = F.unix_seconds(F.date_trunc("minute", "ts"))
    left = points.select("symbol", "ts", at.alias("_at")).withColumn(
        "_bucket",
        F.explode(
            F.sequence(
                F.floor((F.col("_at") - tolerance_seconds) / width), F.floor((F.col("_at") + tolerance_seconds) / width)
            )
        ),
    )
    m = F.unix_seconds("minute")
    right = minutes.select("symbol", "minute", m.alias("_m"), F.floor(m / width).alias("_bucket")).distinct()
    pairs = left.join(right, ["symbol", "_bucket"]).withColumn("_gap", F.abs(F.col("_at") - F.col("_m")))
    rank = F.col("_gap") * F.lit(10**11) + F.col("_m")
    return (
        pairs.filter(F.col("_gap") <= tolerance_seconds)
        .groupBy("symbol", "ts")
        .agg(F.min_by("minute", rank).alias("minute"), F.min("_gap").alias("gap_seconds"))
    )
