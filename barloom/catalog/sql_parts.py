"""Shared pieces of the checking SQL (DuckDB): the same stand-in inputs as ``sources.driver_tables``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TICKS = """ticks AS (
  SELECT event_type AS symbol, ts, 100.0 + value * 0.02 AS price,
         CAST((user_id + 1) * 10 AS DOUBLE) AS size, event_id
  FROM events)"""

BARS = f"""{TICKS}, raw_bars AS (
  SELECT symbol, time_bucket(INTERVAL '30 minutes', ts) AS bar_ts,
         arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close,
         sum(size) AS volume, arg_max(event_id, ts) AS last_id
  FROM ticks GROUP BY 1, 2),
bars AS (
  SELECT symbol, bar_ts AS ts, open, high, low, close, volume,
         close - close * 0.0005 * (1 + last_id % 7) AS bid_px,
         close + close * 0.0005 * (1 + last_id % 5) AS ask_px,
         CAST(100 * (1 + last_id % 9) AS DOUBLE) AS bid_sz,
         CAST(100 * (1 + last_id % 4) AS DOUBLE) AS ask_sz,
         CAST(bar_ts AS DATE) AS trade_date,
         CAST(date_trunc('week', bar_ts) AS DATE) AS session
  FROM raw_bars)"""

_W = "PARTITION BY symbol, session ORDER BY ts"


def _rows(a: str, b: str) -> str:
    return f"({_W} ROWS BETWEEN {a} AND {b})"


WINDOWS = ", ".join(
    [f"w AS ({_W})", f"hist AS {_rows('UNBOUNDED PRECEDING', '1 PRECEDING')}",
     f"upto AS {_rows('UNBOUNDED PRECEDING', 'CURRENT ROW')}"]
    + [f"p{n} AS {_rows(f'{n} PRECEDING', '1 PRECEDING')}" for n in (5, 6, 9, 10, 20, 30, 41, 50, 100)]
    + [f"b{n} AS {_rows(f'{n} PRECEDING', '2 PRECEDING')}" for n in (10, 20)]
    + [f"prior30 AS {_rows('30 PRECEDING', '11 PRECEDING')}", f"last4 AS {_rows('4 PRECEDING', '1 PRECEDING')}"]
)


def level(name: str, source: str, columns: dict[str, str]) -> str:
    cols = ", ".join(f"{expr} AS {alias}" for alias, expr in columns.items())
    return f"{name} AS (SELECT *, {cols} FROM {source} WINDOW {WINDOWS})"


SERIES = level(
    "s", "bars",
    {"n": "row_number() OVER w - 1", "c1": "lag(close, 1) OVER w", "v1": "lag(volume, 1) OVER w",
     "v2": "lag(volume, 2) OVER w"},
)

DAILY = """daily AS (
  SELECT symbol, CAST(ts AS DATE) AS date, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
         arg_max(close, ts) AS close, sum(volume) AS volume
  FROM bars GROUP BY 1, 2)"""


def over_series(levels: list[dict[str, str]], out: dict[str, str], where: str = "TRUE", before: str = "") -> str:
    """SELECT over the bar series with extra window levels in between."""
    ctes = [BARS, SERIES]
    if before:
        ctes.append(before)
    source = "s"
    for i, columns in enumerate(levels):
        ctes.append(level(f"s{i}", source, columns))
        source = f"s{i}"
    cols = ", ".join(f"{expr} AS \"{alias}\"" for alias, expr in out.items())
    return f"WITH {', '.join(ctes)} SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts_s, {cols} FROM {source} WHERE {where}"


def r6(expr: str) -> str:
    """Six decimal places by the same arithmetic as ``to6``."""
    return f"floor(CAST({expr} AS DOUBLE) * 1e6 + 0.5) / 1e6"


def to6(c: str | Column) -> Column:
    """Six decimal places; plain double arithmetic, far cheaper than round() and equal in both engines."""
    x = F.col(c) if isinstance(c, str) else c
    return F.floor(x * 1e6 + 0.5) / 1e6


def ema(values: str, alpha: str) -> str:
    """Plain recursion over the list of values."""
    return f"list_reduce({values}, lambda a, x: a + ({alpha}) * (x - a))"


def clip(expr: str, lo: float, hi: float) -> str:
    return f"CASE WHEN ({expr}) IS NOT NULL THEN greatest({lo}, least({hi}, {expr})) END"
