"""Trend, oscillator, volatility and risk-level features."""

from __future__ import annotations

from barloom.functions.text import bound, gated, pct
from barloom.operators.session_series import WILDER, Level

TIE = 1e-12  # relative slack when comparing decayed averages that should be equal

# fixed values: target column name for each risk multiple
TARGETS = {1.0: "1R_Target", 1.5: "1_5R_Target", 2.0: "2R_Target", 3.0: "3R_Target", 4.0: "4R_Target"}


def bollinger_bands() -> Level:
    ok = "_n >= 20 AND _sd20 > 0 AND _mean20 > 0"
    return {
        "Bollinger_Bands_Upper": gated(ok, "_mean20 + 2 * _sd20", "close"),
        "Bollinger_Bands_Lower": gated(ok, "_mean20 - 2 * _sd20", "close"),
        "Bollinger_Band_Width": gated(ok, "4 * _sd20 / _mean20", "0D"),
    }


def trend_features() -> Level:
    moved = " + ".join(f"CAST(_c{i} <> _c{i + 1} AS INT)" for i in range(1, 6))
    agree = " + ".join(
        f"CAST(signum(_c{i} - _c{i + 1}) * signum(_c{i + 1}) = CASE WHEN _c1 > _c6 THEN 1 ELSE -1 END AS INT)"
        for i in range(1, 6)
    )
    recent = "coalesce(CASE WHEN _c3 <> 0 THEN (_c1 - _c3) / _c3 END, 0D)"
    earlier = "coalesce(CASE WHEN _c6 <> 0 THEN (_c3 - _c6) / _c6 END, 0D)"
    # squared correlation of ten consecutive positions (variance 8.25) with their closes
    fit = "CASE WHEN _close_var10 > 0 THEN power(_trend_cov10, 2D) / (8.25D * _close_var10) ELSE 0D END"
    direct = "coalesce(CASE WHEN _path9 > 0 THEN abs(_c1 - _c10) / _path9 END, 0D)"
    since_open = bound(pct("close", "day_open"), -20, 20)
    return {
        "MACD_12_26_9": gated("_n >= 35 AND close > 0", bound("(_ema12 - _ema26 - _signal1) / close * 100", -2, 2), "0D"),
        "RSI_14": gated(
            "_n >= 15",
            f"CASE WHEN _loss1 = 0 THEN 100D ELSE {bound('100 - 100 / (1 + _gain1 / _loss1)', 0, 100)} END", "50D",
        ),
        "Price_vs_SMA50":
            f"CASE WHEN _n >= 50 THEN CASE WHEN _mean50 > 0 THEN {pct('close', '_mean50')} ELSE 0D END "
            f"WHEN daily_mean50 > 0 THEN {pct('close', 'daily_mean50')} ELSE 0D END",
        "Return_5min": gated("_n >= 6 AND _c6 > 0", bound(pct("close", "_c6"), -5, 5), "0D"),
        "Return_Since_Open": gated("day_open > 0 AND close > 0", since_open, "0D"),
        "Return_Since_Open_Enhanced": gated("_n >= 1 AND day_open > 0 AND close > 0", since_open, "0D"),
        "Intraday_Performance_Percentile": gated(
            "_n > 10 AND close > 0 AND day_open > 0 AND _hist_cmax > _hist_cmin",
            bound("(close - _hist_cmin) / (_hist_cmax - _hist_cmin)", 0, 1), "0.5D",
        ),
        "Price_Acceleration": gated("_n >= 3 AND close > 0", bound("(_c1 - 2 * _c2 + _c3) / close * 100", -10, 10), "0D"),
        "Momentum_Acceleration": gated("_n >= 6", f"{recent} - {earlier}", "0D"),
        "Momentum_Consistency": gated(f"_n >= 6 AND {moved} > 0", f"({agree}) / ({moved})", "0.5D"),
        "Price_Action_Quality": gated("_n >= 10", f"({fit} + {direct}) / 2", "0.5D"),
    }


def time_features() -> Level:
    angle = "2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440"
    return {
        "Time_Of_Day_Cyclical_Sin": f"coalesce(sin({angle}), 0D)",
        "Time_Of_Day_Cyclical_Cos": f"coalesce(cos({angle}), 1D)",
    }


def atr() -> Level:
    """Wilder average of the true range over at most 30 earlier bars, restarted at the first of them.

    The first bar of the frame is the seed: it weighs as the whole start value, and its range is its own
    high minus low because the frame has no close before it.
    """
    q, a = 1.0 - WILDER, WILDER
    seed = f"power({q!r}D, least(_n, 30) - 1) * (_hl_first30 - {a!r}D * _tr_first30)"
    return {"_atr": f"_tr_decayed30 + {seed}"}


def atr_features() -> Level:
    # the differences leave noise of the size of rounding when every range in the frame is zero
    return {
        "ATR_Pct": gated("_n >= 15 AND close > 0 AND abs(_atr) > close * 1e-13D", "_atr / close * 100", "0D"),
        "Volatility_Regime_Shift_Norm": gated(
            "_n >= 31 AND _ret_sd_prior20 <> 0",
            "signum(_ret_sd10 / _ret_sd_prior20 - 1) * tanh(abs(_ret_sd10 / _ret_sd_prior20 - 1) / 2)", "0D",
        ),
    }


def range_levels() -> list[Level]:
    """Steps to the smoothed ranges ranked by ``volatility_percentile``; one projection each, so that
    nothing is rebuilt per array element. Sessions of 20 to 41 earlier bars use a third of their number
    as the span."""
    step = "concat(acc, array(coalesce(try_element_at(acc, -1) + _short_alpha * (x - try_element_at(acc, -1)), x)))"
    short = f"aggregate(_early_trs, CAST(array() AS ARRAY<DOUBLE>), (acc, x) -> {step})"
    return [
        {"_short_alpha": "2D / (_n div 3 + 1)"},
        {"_ranges": f"CASE WHEN _n >= 20 AND _n < 42 THEN {short} ELSE _tr_emas100 END"},
        {
            "_range_limit": f"try_element_at(_ranges, -1) * {1 + TIE!r}D",
            "_range_max": "array_max(_ranges)",
            "_range_min": "array_min(_ranges)",
        },
    ]


def volatility_percentile() -> Level:
    """Rank of the latest smoothed range among the last 100, in percent."""
    return {
        "Volatility_Percentile_100":
            f"CASE WHEN _n < 20 OR _range_max - _range_min <= _range_max * {TIE!r}D THEN 50D "
            "ELSE size(filter(_ranges, x -> x <= _range_limit)) / size(_ranges) * 100 END"
    }


def oscillator_words() -> Level:
    r = "RSI_14"
    return {
        "RSI_Regime":
            f"CASE WHEN {r} >= 70 THEN 'overbought' WHEN {r} <= 30 THEN 'oversold' WHEN {r} >= 60 THEN 'bullish' "
            f"WHEN {r} <= 40 THEN 'bearish' ELSE 'neutral' END",
        "RSI_Regime_Numeric":
            f"CASE WHEN {r} >= 70 THEN 1D WHEN {r} <= 30 THEN -1D WHEN {r} >= 60 THEN 0.5D "
            f"WHEN {r} <= 40 THEN -0.5D ELSE 0D END",
        "RSI_Distance_From_50": f"abs({r} - 50) / 50",
    }


def market_regime() -> list[Level]:
    """Score from four votes, then its band."""

    def vote(x: str, lo: float, hi: float, weight: float) -> str:
        return f"CASE WHEN {x} > {hi} THEN {weight}D WHEN {x} < {lo} THEN -{weight}D ELSE 0D END"

    score = " + ".join(
        [
            vote("RSI_14", 30, 70, 1.0), vote("Volume_Percentile_Intraday", 0.2, 0.8, 0.5),
            vote("Momentum_Acceleration", -0.001, 0.001, 0.5), vote("Return_Since_Open_Enhanced", -2.0, 2.0, 0.5),
        ]
    )
    s = "_regime_score"
    return [
        {s: score},
        {
            "Market_Regime":
                f"CASE WHEN {s} >= 1.5 THEN 'strong_bullish' WHEN {s} >= 0.5 THEN 'bullish' "
                f"WHEN {s} <= -1.5 THEN 'strong_bearish' WHEN {s} <= -0.5 THEN 'bearish' ELSE 'neutral' END",
            "Market_Regime_Numeric":
                f"CASE WHEN {s} >= 1.5 THEN 2 WHEN {s} >= 0.5 THEN 1 WHEN {s} <= -1.5 THEN -2 "
                f"WHEN {s} <= -0.5 THEN -1 ELSE 0 END",
        },
    ]


def risk_levels(multiplier: float = 1.0, max_risk_pct: float | None = None) -> list[Level]:
    """Stop, targets and position size from price and ATR; all NULL (size 0) without a usable ATR.

    ``max_risk_pct`` caps the risk distance at that share of price (an older variant used 0.6).
    """
    risk = f"(ATR_Pct / 100 * close) * {float(multiplier)}D"
    if max_risk_pct is not None:
        risk = f"least({risk}, close * {max_risk_pct / 100.0}D)"
    first = {
        "ATR_Stop_Risk_Pct": gated("close > 0 AND ATR_Pct > 0", bound("2 * ATR_Pct / close * 100", 0, 50), "0D"),
        "_risk": f"CASE WHEN close > 0 AND ATR_Pct > 0 THEN {risk} END",
    }
    known = "_risk IS NOT NULL"
    second = {
        "Current_Price": f"CASE WHEN {known} THEN bround(close, 2) END",
        "1R_Stop_Loss": "bround(close - _risk, 2)",
        "Risk_Amount_Pct": f"CASE WHEN {known} THEN bround(_risk / close * 100, 2) END",
        "ATR_Distance": f"CASE WHEN {known} THEN bround(ATR_Pct / 100 * close, 3) END",
        "ATR_Multiplier_Used": f"CASE WHEN {known} THEN {float(multiplier)}D END",
    }
    reward = "greatest(close * 0.0020D, _risk)"
    for multiple, name in TARGETS.items():
        second[name] = f"CASE WHEN {known} THEN bround(close + {reward} * {multiple}D, 2) END"
    third = {
        "Position_Size_1pct_Risk": gated("Risk_Amount_Pct > 0", "bround(100D / Risk_Amount_Pct, 2)", "0D"),
    }
    return [first, second, third]
