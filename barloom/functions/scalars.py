"""Row-level market functions: plain Column in, Column out, no window and no shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.frames import clip, no_nan, ratio

MARKET_ZONE = "America/New_York"


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def safe_divide(n, d, default: float = 0.0) -> Column:
    """n/d, or the default when an input is missing, d is zero or the result is not finite."""
    return F.coalesce(no_nan(ratio(col(n), col(d))), F.lit(float(default)))


def safe_percentage(current, previous, default: float = 0.0) -> Column:
    return safe_divide(col(current) - col(previous), previous, default) * 100


def bid_ask_spread_pct(bid, ask) -> Column:
    b, a = col(bid), col(ask)
    return F.when((a > 0) & (b > 0) & (a > b), (a - b) / ((a + b) / 2) * 100)


def order_book_imbalance(bid_size, ask_size) -> Column:
    b, a = col(bid_size), col(ask_size)
    return F.when((b >= 0) & (a >= 0) & (b + a > 0), (b - a) / (b + a))


def price_position_in_spread(price, bid, ask) -> Column:
    p, b, a = col(price), col(bid), col(ask)
    inside = clip((p - b) / (a - b), 0.0, 1.0)
    return F.coalesce(
        F.when((a <= b) | (p <= 0), F.lit(0.5))
        .when(p < b, F.lit(0.0))
        .when(p > a, F.lit(1.0))
        .when(a > b, inside),
        F.lit(0.5),
    )


def value_weighted_imbalance(bid, ask, bid_size, ask_size) -> Column:
    b, a, bs, as_ = col(bid), col(ask), col(bid_size), col(ask_size)
    usable = (b > 0) & (a > 0) & (bs >= 0) & (as_ >= 0)
    return F.coalesce(F.when(usable, safe_divide(b * bs - a * as_, b * bs + a * as_)), F.lit(0.0))


def minutes_since_midnight(ts) -> Column:
    return F.hour(col(ts)) * 60 + F.minute(col(ts))


def time_of_day_sin(ts) -> Column:
    return F.coalesce(F.sin(F.lit(2 * math.pi) * minutes_since_midnight(ts) / F.lit(1440.0)), F.lit(0.0))


def time_of_day_cos(ts) -> Column:
    return F.coalesce(F.cos(F.lit(2 * math.pi) * minutes_since_midnight(ts) / F.lit(1440.0)), F.lit(1.0))


def parse_number(text) -> Column:
    """Vendor number text: thousands commas, a leading 'C' marker, K/M suffixes."""
    cleaned = F.regexp_replace(F.regexp_replace(F.trim(col(text)), ",", ""), "^[Cc]", "")
    factor = (
        F.when(F.upper(cleaned).endswith("M"), F.lit(1e6))
        .when(F.upper(cleaned).endswith("K"), F.lit(1e3))
        .otherwise(F.lit(1.0))
    )
    digits = F.regexp_replace(cleaned, "[KkMm]$", "")
    return digits.try_cast("double") * factor


def epoch_to_utc(epoch) -> Column:
    """Epoch seconds or milliseconds to a timestamp; values above 1e11 are milliseconds."""
    e = col(epoch).cast("double")
    return F.timestamp_micros(F.round(F.when(F.abs(e) > 1e11, e * 1e3).otherwise(e * 1e6)).cast("long"))


def to_market_time(ts) -> Column:
    return F.from_utc_timestamp(col(ts), MARKET_ZONE)


def parse_simulation_date(text) -> Column:
    """YYYYMMDDHHMM market-clock text to UTC; unparsable text gives NULL."""
    return F.to_utc_timestamp(F.try_to_timestamp(col(text), F.lit("yyyyMMddHHmm")), MARKET_ZONE)


def synthetic_bid(price, spread_pct: float = 0.1) -> Column:
    return col(price) * (1 - spread_pct / 200.0)


def synthetic_ask(price, spread_pct: float = 0.1) -> Column:
    return col(price) * (1 + spread_pct / 200.0)


def clock_text(local_ts: Column) -> Column:
    return F.date_format(local_ts, "HH:mm:ss")


def is_weekday(local_ts: Column) -> Column:
    return F.weekday(local_ts) < 5


def in_selection_hours(ts, start: str = "09:30:00", end: str = "15:30:00", zone: str = MARKET_ZONE) -> Column:
    """Inclusive clock range in the market zone; used when picking sample minutes."""
    return clock_text(F.from_utc_timestamp(col(ts), zone)).between(start, end)


def is_market_open(ts, start: str = "09:30:00", end: str = "16:00:00", zone: str = MARKET_ZONE) -> Column:
    local = F.from_utc_timestamp(col(ts), zone)
    return is_weekday(local) & clock_text(local).between(start, end)


def is_near_close(ts, cutoff: str = "15:45:00", zone: str = MARKET_ZONE) -> Column:
    local = F.from_utc_timestamp(col(ts), zone)
    return is_weekday(local) & (clock_text(local) >= F.lit(cutoff))


def performance_note(auc) -> Column:
    a = col(auc)
    return (
        F.when(a > 0.7, "Excellent performance")
        .when(a > 0.6, "Good performance")
        .when(a > 0.55, "Moderate performance")
        .otherwise("Poor performance - needs improvement")
    )
