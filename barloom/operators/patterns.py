"""Price-pattern features: range position, levels, breakouts, drawdown and the impulse vector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions import text as X
from barloom.functions.frames import clip, gated
from barloom.operators.session_series import Level

N = F.col


def level_marks() -> Level:
    """Thresholds used by the level search, as columns so that no array element recomputes them."""
    return {
        "_level_gap": "close * 0.001D",
        "_high_mark": "CASE WHEN _top50 > _bottom50 THEN _top50 - (_top50 - _bottom50) * 0.1D END",
        "_low_mark": "CASE WHEN _top50 > _bottom50 THEN _bottom50 + (_top50 - _bottom50) * 0.1D END",
    }


def nearest_levels() -> Level:
    """Nearest level above and below, from at most 50 earlier bars.

    Levels are swing extremes (marked per bar beforehand, so only the few marked bars are collected)
    and the bars in the outer tenth of the frame's range.
    """
    above = "x > close AND x - close >= _level_gap"
    below = "x < close AND close - x >= _level_gap"
    return {
        "_above": f"least(array_min(filter(_levels_above, x -> {above})), "
                  f"array_min(filter(_highs50, x -> x >= _high_mark AND {above})))",
        "_below": f"greatest(array_max(filter(_levels_below, x -> {below})), "
                  f"array_max(filter(_lows50, x -> x <= _low_mark AND {below})))",
    }


def pattern_features() -> Level:
    nearest = "least((_above - close) / close * 100, (close - _below) / close * 100)"
    strength = (
        "CASE WHEN _high_before19 > 0 THEN (close - _high_before19) / _high_before19 ELSE 0D END * 100 "
        "+ (_v1 / _vol_before19 - 1) * 0.1D"
    )
    fold = (
        "aggregate(_closes30, named_struct('peak', CAST(NULL AS DOUBLE), 'worst', 0D), "
        "(a, x) -> named_struct('peak', greatest(a.peak, x), "
        "'worst', least(a.worst, (x - greatest(a.peak, x)) / greatest(a.peak, x) * 100)), a -> a.worst)"
    )
    return {
        "Position_In_Day_Range": X.gated(
            "_n >= 1 AND _hist_high > _hist_low AND close > 0",
            X.bound("(close - _hist_low) / (_hist_high - _hist_low)", 0, 1), "0.5D",
        ),
        "Support_Resistance_Proximity": X.gated(
            "_n >= 20 AND close > 0 AND (_above IS NOT NULL OR _below IS NOT NULL)", f"greatest({nearest}, 0.1D)", "5D"
        ),
        "Breakout_Confirmation": X.gated(
            "_n >= 20 AND close > _high_before19 AND _vol_before19 > 0 AND _v1 > _vol_before19 * 1.5D",
            X.bound(strength, 0, 1), "0D",
        ),
        # deepest fall below the running peak of the last 30 closes, in percent (zero or negative)
        "Max_Drawdown_30": X.gated("_n >= 5", fold, "0D"),
    }


def _edge(here: str, others: tuple[str, ...], pos: str) -> str:
    higher = " AND ".join(f"{here} > {o}" for o in others)
    lower = " AND ".join(f"{here} < {o}" for o in others)
    kind = f"CASE WHEN {higher} THEN 1 WHEN {lower} THEN -1 ELSE 0 END"
    return f"filter(array(named_struct('pos', {pos}, 'price', {here}, 'kind', {kind})), t -> t.kind <> 0)"


def swing_levels() -> list[Level]:
    """Steps to the newest change of direction among the last 30 mid-range prices.

    Interior turning points were marked per bar. The second and the second-last bar of the frame see
    only one neighbour on the frame's edge, so they are judged here. ``_change_at`` is the index of the
    newest point whose predecessor is of the other kind.
    """
    first = _edge("_hl2_29", ("_hl2_30", "_hl2_28", "_hl2_27"), "_n - 29")
    last = _edge("_hl2_2", ("_hl2_4", "_hl2_3", "_hl2_1"), "_n - 2")
    fold = (
        "aggregate(_points, named_struct('i', 0, 'kind', 0, 'hit', 0), "
        "(a, t) -> named_struct('i', a.i + 1, 'kind', t.kind, "
        "'hit', CASE WHEN a.i > 0 AND t.kind <> a.kind THEN a.i ELSE a.hit END), a -> a.hit)"
    )
    return [
        {"_points": f"CASE WHEN _n >= 30 THEN concat({first}, _turns, {last}) END"},
        {"_change_at": f"nullif({fold}, 0)"},
        {"_from": "get(_points, _change_at - 1)", "_to": "get(_points, _change_at)"},
    ]


def impulse_vector() -> Level:
    magnitude = "CASE WHEN _from.price <> 0 THEN abs(_to.price - _from.price) / _from.price ELSE 0D END"
    known = "_change_at IS NOT NULL"
    return {
        "Impulse_Vector_Magnitude": X.gated(known, f"bround({magnitude}, 6)", "0D"),
        "Impulse_Vector_Direction": X.gated(known, "CASE WHEN _to.price > _from.price THEN 1 ELSE -1 END", "0"),
        "Impulse_Vector_Duration": X.gated(known, "_to.pos - _from.pos", "0"),
        "Impulse_Vector_Slope": X.gated(known, f"bround(({magnitude}) / (_to.pos - _from.pos), 6)", "0D"),
    }


def impulse_summary() -> dict[str, Column]:
    """Model-ready impulse columns from the four vector components."""
    m, d = N("Impulse_Vector_Magnitude"), N("Impulse_Vector_Direction")
    t, s = N("Impulse_Vector_Duration"), N("Impulse_Vector_Slope")
    moving = (m > 0) & (t > 0)
    return {
        "Impulse_Magnitude": clip(m * 100, 0, 10),
        "Impulse_Direction": d,
        "Impulse_Duration": F.least(F.greatest(t, F.lit(0)), F.lit(30)),
        "Impulse_Slope": clip(s * 1000, -5, 5),
        "Impulse_Strength": gated(moving, m * d * 100, 0.0),
        "Impulse_Momentum": gated(moving, m / F.sqrt(t.cast("double")) * 100, 0.0),
        "Impulse_Quality": gated(moving & (t >= 3), clip(m * F.ln(t.cast("double")), 0, 2), 0.0),
        "Impulse_Type": F.when(m > 0.002, F.when(t <= 5, 1).when(t <= 15, 2).otherwise(3)).otherwise(0),
    }


def impulse_interactions() -> dict[str, Column]:
    """Impulse against volume, RSI, levels and momentum; missing inputs take their neutral value."""
    strength = N("Impulse_Strength")
    size = F.abs(strength)
    strong = size > 0.1
    volume = F.coalesce(N("Volume_vs_SMA10"), F.lit(1.0))
    r = F.coalesce(N("RSI_14"), F.lit(50.0))
    near = F.coalesce(N("Support_Resistance_Proximity"), F.lit(5.0))
    mom = F.coalesce(N("Mid_Price_Momentum"), F.lit(0.0))
    heading = F.when(mom > 0, 1).otherwise(-1)
    aligned = F.when(N("Impulse_Direction") == heading, size * F.abs(mom)).otherwise(-size * F.abs(mom))
    none = F.lit(None).cast("double")
    # in a strong oversold move only the oversold column exists, in an overbought one only the other
    return {
        "Impulse_Volume_Confirmation": clip(gated(strong & (volume > 0), strength * F.ln(volume), 0.0), -10, 10),
        "Impulse_RSI_Oversold": clip(
            F.when(strong & (r < 30), size * (30 - r) / 30).when(strong & (r > 70), none).otherwise(F.lit(0.0)),
            -10, 10,
        ),
        "Impulse_RSI_Overbought": clip(
            F.when(strong & (r > 70), size * (r - 70) / 30).when(strong & (r < 30), none).otherwise(F.lit(0.0)),
            -10, 10,
        ),
        "Impulse_Near_Support_Resistance": clip(gated(strong & (near < 2.0), size / near, 0.0), -10, 10),
        "Impulse_Momentum_Alignment": clip(
            F.when(strong & (F.abs(mom) > 0.1), aligned).otherwise(F.lit(0.0)), -10, 10
        ),
    }
