"""Queries over one-minute bars in day sessions whose symbols and bars grow with the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.catalog import QUERIES, SQL, register
from barloom.catalog import features, live, signals  # noqa: F401  the queries repeated here
from barloom.sources import driver_tables as D

NAMES = [
    "feature_table", "macd", "rsi_regime", "swing_candidates", "label_barriers", "bracket_exits",
    "one_position_at_a_time", "live_screen",
]
# the stand-in bars of the half-hour queries, and what stands for it here
_FINER = {
    "SELECT event_type AS symbol, ts, 100.0": "SELECT event_type || '.' || CAST(user_id // 75 AS VARCHAR) AS symbol, ts, 100.0",
    "INTERVAL '30 minutes'": "INTERVAL '1 minute'",
    "CAST(date_trunc('week', bar_ts) AS DATE) AS session": "CAST(bar_ts AS DATE) AS session",
}


def _finer(sql: str) -> str:
    for old, new in _FINER.items():
        if old not in sql:
            raise ValueError(f"the bars of the query are not stated by {old}")
        sql = sql.replace(old, new)
    return sql


def _repeat(name: str) -> None:
    @register(f"{name}_minute", _finer(SQL[name]))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with D.minute_bars():
            return QUERIES[name](spark, sf_dir)


for _name in NAMES:
    _repeat(_name)
