"""The complete point-in-time feature projection."""

from __future__ import annotations

import re
from itertools import combinations, zip_longest

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.frames import SESSION_BARS, FrameText
from barloom.functions.text import apply_levels, needed_levels
from barloom.operators import microstructure as M
from barloom.operators import patterns as P
from barloom.operators import technical as T
from barloom.operators.daily_context import join_daily
from barloom.operators.session_series import Level, series_levels
from barloom.session import written_table

MIN_HISTORY = 15
DAILY_COLUMNS = {"day_open", "daily_mean50"}
#: Window frames of one pass over the bars. Spark makes several classes for a frame and keeps 100 of them unless told
#: otherwise; a task that needs more compiles them all again.
FRAMES_AT_ONCE = 18


def _merge(*series: list[Level]) -> list[Level]:
    """Level i of every series in one projection."""
    return [{k: v for part in parts for k, v in part.items()} for parts in zip_longest(*series, fillvalue={})]


def feature_levels(
    fr: FrameText, columns, multiplier: float = 1.0, max_risk_pct: float | None = None, session_bars: int = SESSION_BARS
) -> list[Level]:
    """All projections in order; a level reads only columns of the levels before it."""
    main = (
        {"n_hist": "_n"} | M.quote_features(columns) | M.volume_features(columns) | T.bollinger_bands()
        | T.trend_features() | T.time_features() | T.atr_features() | T.volatility_percentile() | P.pattern_features()
        | P.impulse_vector()
    )
    return [
        *series_levels(fr, columns, session_bars),
        *_merge([T.atr() | P.level_marks(), P.nearest_levels()], T.range_levels(), P.swing_levels()),
        main,
        *_merge(
            T.risk_levels(multiplier, max_risk_pct), [T.oscillator_words() | M.spread_rank()], T.market_regime()
        ),
    ]


OPTIONAL = ("Market_Regime", "Market_Regime_Numeric", "Bollinger_Bands_Upper", "Bollinger_Bands_Lower")


def feature_names(columns) -> list[str]:
    """Features of the default projection, in order."""
    levels = feature_levels(FrameText(), columns)
    return [n for level in levels for n in level if not n.startswith("_") and n not in OPTIONAL]


def spread_sessions(bars: DataFrame) -> DataFrame:
    """Hash bars by session into the configured number of shuffle partitions.

    The window stages are CPU-bound: letting adaptive execution merge small partitions by their byte size
    would put many sessions on one core. An explicit count keeps the spread, and the windows reuse it.
    """
    n = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bars.repartition(n, "symbol", "session")


def feature_table(
    bars: DataFrame, daily: DataFrame | None = None, min_history: int | None = None,
    columns: list[str] | None = None, atr_multiplier: float = 1.0, max_risk_pct: float | None = None,
    day_sessions: bool = False, session_bars: int = SESSION_BARS,
) -> DataFrame:
    """Features for every bar.

    ``bars`` has one row per (symbol, session, ts) with open, high, low, close, volume, trade_date and
    optionally bid_px, ask_px, bid_sz, ask_sz, trade_count. ``columns`` names the wanted features, optional
    ones included; by default all but the optional ones. Only what they depend on is planned.
    With ``day_sessions`` the session is the trade date, so the daily join uses the partitioning of the
    windows and the bars are exchanged once instead of twice. ``session_bars`` is the most bars a session may have.
    """
    fr = FrameText()
    names = columns if columns is not None else feature_names(bars.columns)
    wanted = list(names) + ([] if min_history is None or "n_hist" in names else ["n_hist"])
    levels = needed_levels(feature_levels(fr, bars.columns, atr_multiplier, max_risk_pct, session_bars), wanted)
    reads_daily = any(c in text for level in levels for text in level.values() for c in DAILY_COLUMNS)
    if not reads_daily:
        spread = spread_sessions(bars)
    elif day_sessions:
        spread = join_daily(spread_sessions(bars), daily, "session")
    else:
        spread = spread_sessions(join_daily(bars, daily))
    df = apply_levels(spread, levels)
    if min_history is not None:
        df = df.filter(f"n_hist >= {int(min_history)}")
    return df.select(*bars.columns, *names)


def feature_groups(names: list[str], columns, most: int = FRAMES_AT_ONCE) -> list[list[str]]:
    """The features in groups whose expressions use at most ``most`` window frames; those that share frames go together."""
    levels = feature_levels(FrameText(), columns)

    def frames(name: str) -> set[tuple[int, str]]:
        found = enumerate(needed_levels(levels, [name]))
        return {(i, over) for i, level in found for text in level.values() for over in re.findall(r"OVER \((?:[^()]|\([^()]*\))*\)", text)}

    groups = [({name}, frames(name)) for name in names]
    while True:
        small = [(a, b) for a, b in combinations(groups, 2) if len(a[1] | b[1]) <= most]
        if not small:
            return [[n for n in names if n in group] for group, _ in groups]
        a, b = max(small, key=lambda pair: (len(pair[0][1] & pair[1][1]), -len(pair[0][1] | pair[1][1])))
        groups = [(a[0] | b[0], a[1] | b[1]) if g is a else g for g in groups if g is not b]


def feature_table_in_passes(
    bars: DataFrame, daily: DataFrame | None = None, min_history: int | None = None, columns: list[str] | None = None,
    most: int = FRAMES_AT_ONCE, **more,
) -> DataFrame:
    """The rows of `feature_table`, a group of features after the other: for many features of many bars.

    Every pass but the last writes the bars with the features so far, so that no task needs the code of all windows.
    """
    names = list(columns) if columns is not None else feature_names(bars.columns)
    *first, last = feature_groups(names, bars.columns, most)
    df = bars
    for i, group in enumerate(first):
        # in a struct of their own, as a later group may need some of the same features on its way
        kept = [c for c in df.columns if c not in bars.columns]
        made = feature_table(df, daily, columns=group, **more)
        df = written_table(made.select(*bars.columns, *kept, F.struct(*[F.col(f"`{n}`") for n in group]).alias(f"_pass{i}")), "features")
    place = {n: f"_pass{i}.`{n}`" for i, group in enumerate(first) for n in group} | {n: f"`{n}`" for n in last}
    made = feature_table(df, daily, min_history, last, **more)
    return made.select(*bars.columns, *[F.col(place[n]).alias(n) for n in names])
