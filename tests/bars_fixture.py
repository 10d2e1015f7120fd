"""Seeded minute bars with the awkward cases the features must survive."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd

START = dt.datetime(2024, 3, 7, 14, 30)  # 09:30 in New York


def session_frame(kind: str, n: int = 130, seed: int = 1) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    if kind == "flat":
        close = np.full(n, 100.0)
        high = low = close
    elif kind == "up":
        close = 100 + 0.25 * np.arange(n)
        high, low = close + 0.25, close - 0.25
    elif kind == "down":
        close = 100 - 0.25 * np.arange(n)
        high, low = close + 0.25, close - 0.25
    else:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.002, n))).round(4)
        high = close + rng.uniform(0, 0.2, n).round(3)
        low = close - rng.uniform(0, 0.2, n).round(3)
    volume = rng.integers(0, 3000, n).astype(float)
    volume[rng.random(n) < 0.1] = 0.0
    bid = close - rng.uniform(0.001, 0.3, n).round(3)
    ask = close + rng.uniform(0.001, 0.3, n).round(3)
    crossed = rng.random(n) < 0.1
    bid[crossed], ask[crossed] = ask[crossed], bid[crossed].copy()
    bid_sz = rng.integers(0, 5, n) * 100.0
    ask_sz = rng.integers(0, 5, n) * 100.0
    bid = bid.astype(object)
    bid[rng.random(n) < 0.03] = None
    ts = [START + dt.timedelta(minutes=i) for i in range(n)]
    return pd.DataFrame(
        {"symbol": kind, "ts": ts, "open": close, "high": high, "low": low, "close": close, "volume": volume,
         "bid_px": bid, "ask_px": ask, "bid_sz": bid_sz, "ask_sz": ask_sz}
    )


SCHEMA = (
    "symbol string, ts timestamp, open double, high double, low double, close double, volume double, "
    "bid_px double, ask_px double, bid_sz double, ask_sz double"
)


def fixture_frames() -> pd.DataFrame:
    return pd.concat([session_frame(k, seed=i + 1) for i, k in enumerate(["walk", "flat", "up", "down"])])


def to_spark(spark, pdf: pd.DataFrame):
    from barloom.sources.bars import normalize_bars, with_day_session

    rows = [
        tuple(None if v is None or (isinstance(v, float) and np.isnan(v)) else (v.to_pydatetime() if hasattr(v, "to_pydatetime") else v) for v in r)
        for r in pdf.itertuples(index=False)
    ]
    return with_day_session(normalize_bars(spark.createDataFrame(rows, SCHEMA)))
