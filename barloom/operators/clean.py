"""Feature cleaning, bounding, enrichment and consistency checks, driven by small fixed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.frames import clip, no_nan
from barloom.operators.patterns import impulse_interactions, impulse_summary

# fixed values: columns the cleaner always removes
REMOVED = (
    "Max_Drawdown_Return_Interaction", "RSI_Momentum_Signal", "RSI_Regime_Numeric", "Volume_Zscore_Intraday",
    "Normalized_Price_VWAP", "Breakout_Confirmation", "VWAP", "Bid_Ask_Spread", "ATR_14", "Bollinger_Bands_20_2",
    "Volatility_Regime_Shift", "Time_Of_Day_Cyclical", "Trade_count_per_minute",
    "Volume_weighted_order_book_imbalance",
)

# fixed values: accepted range per feature; beyond twice the range a value is rejected
RANGES = {
    "RSI_14": (0.0, 100.0),
    "MACD_12_26_9": (-5.0, 5.0),
    "Bollinger_Band_Width": (0.0, 1.0),
    "Return_5min": (-10.0, 10.0),
    "Return_since_open": (-25.0, 25.0),
    "Return_Since_Open_Enhanced": (-25.0, 25.0),
    "Position_in_day_range": (0.0, 1.0),
    "Price_Position_In_Spread": (0.0, 1.0),
    "Intraday_Performance_Percentile": (0.0, 1.0),
    "Spread_Percentile_20": (0.0, 1.0),
    "Volatility_Percentile_100": (0.0, 100.0),
    "Volume_Percentile_Intraday": (0.0, 1.0),
    "Volume_vs_SMA10": (0.0, 100.0),
    "Price_vs_SMA50": (-50.0, 50.0),
    "Order_Book_Imbalance": (-1.0, 1.0),
    "ATR_Stop_Risk_Pct": (0.0, 50.0),
    "Max_Drawdown_30": (-100.0, 0.0),
    "Support_Resistance_Proximity": (0.0, 20.0),
    "Mid_Price_Momentum": (-10.0, 10.0),
    "Price_Acceleration": (-20.0, 20.0),
    "Momentum_Acceleration": (-10.0, 10.0),
    "Momentum_Consistency": (0.0, 1.0),
    "Order_Book_Stability": (0.0, 1.0),
    "Price_Action_Quality": (0.0, 1.0),
}

# fixed values: (kept, dropped) when both are present in a row
PREFERRED = (
    ("Normalized_Price_VWAP", "VWAP"),
    ("ATR_Stop_Risk_Pct", "ATR_14"),
    ("Bollinger_Band_Width", "Bollinger_Bands_20_2"),
    ("Return_Since_Open_Enhanced", "Return_since_open"),
    ("Volume_Percentile_Intraday", "Volume_Zscore_Intraday"),
    ("Return_Since_Open_Enhanced", "Max_Drawdown_Return_Interaction"),
    ("RSI_14", "RSI_Momentum_Signal"),
)

# fixed values: every category needs at least one of its features
CATEGORIES = {
    "momentum": ("RSI_14", "MACD_12_26_9", "Mid_Price_Momentum"),
    "returns": ("Return_5min", "Return_since_open", "Return_Since_Open_Enhanced"),
    "risk": ("Max_Drawdown_30", "ATR_Stop_Risk_Pct"),
    "volume": ("Volume_vs_SMA10", "Volume_Percentile_Intraday"),
    "pattern": ("Support_Resistance_Proximity", "Price_vs_SMA50"),
}

# fixed values: keys, outcome and raw bar columns are not features
NOT_FEATURES = (
    "buy", "sell", "reason", "entry_time", "exit_time", "symbol", "date", "session", "ts", "timestamp", "trade_date",
    "R", "time_minutes", "n_hist", "open", "high", "low", "close", "volume",
    "bid_px", "ask_px", "bid_sz", "ask_sz", "trade_count", "day_open", "daily_mean50",
)
KEPT_TEXT = ("reason", "symbol", "date")
MIN_FEATURES = 10

# fixed values: columns the optimiser removes
OPTIMISER_REMOVED = (
    "Breakout_Confirmation", "VWAP", "Bid_Ask_Spread", "ATR_14", "Bollinger_Bands_20_2", "Volatility_Regime_Shift",
    "RSI_Regime_Numeric", "Volume_Zscore_Intraday",
)

# fixed values: first bounds of the optimiser
OUTLIER_BOUNDS = {
    "MACD_12_26_9": (-10.0, 10.0),
    "Return_5min": (-10.0, 10.0),
    "Price_vs_SMA50": (-20.0, 20.0),
    "Volume_vs_SMA10": (0.0, 50.0),
    "Mid_Price_Momentum": (-5.0, 5.0),
    "Momentum_Acceleration": (-5.0, 5.0),
}
PERCENT_COLUMNS = (
    "Spread_Percentile_20", "Volatility_Percentile_100", "Volume_Percentile_Intraday", "Intraday_Performance_Percentile",
)

# fixed values: last bounds of the optimiser
FINAL_BOUNDS = {
    "RSI_14": (0.0, 100.0),
    "MACD_12_26_9": (-2.0, 2.0),
    "Return_5min": (-5.0, 5.0),
    "Position_In_Day_Range": (0.0, 1.0),
    "Price_Position_In_Spread": (0.0, 1.0),
    "Order_Book_Imbalance": (-1.0, 1.0),
    "Max_Drawdown_30": (-50.0, 0.0),
}


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def numeric_columns(df: DataFrame, skip=()) -> list[str]:
    return [c for c in df.columns if c not in skip and is_numeric(df, c)]


def bounded_or_null(x: Column, lo: float, hi: float) -> Column:
    """Reject beyond twice the range, else clip into it; with lo = 0 any negative value is rejected.

    NaN, infinities and NULL are not between anything, so they are rejected too.
    """
    return F.when(x.between(2.0 * lo, 2.0 * hi), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def feature_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NOT_FEATURES]


def clean_features(df: DataFrame, report: bool = False) -> DataFrame:
    """Cleaned feature rows. A rejected value is NULL, which stands for an absent feature.

    With ``report`` each row also lists the categories it misses and whether few features remain.
    """
    df = df.drop(*[c for c in REMOVED if c in df.columns])
    texts = [
        c for c in df.columns
        if isinstance(df.schema[c].dataType, T.StringType) and c not in KEPT_TEXT and c not in NOT_FEATURES
    ]
    df = df.drop(*texts)
    changed = {}
    for name in numeric_columns(df, NOT_FEATURES):
        x = F.col(name)
        if name in RANGES:
            changed[name] = bounded_or_null(x.cast("double"), *RANGES[name])
        elif isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            changed[name] = no_nan(x)
    df = df.withColumns(changed)
    drops = {
        weak: F.when(F.col(keep).isNull(), F.col(weak))
        for keep, weak in PREFERRED
        if keep in df.columns and weak in df.columns
    }
    if drops:
        df = df.withColumns(drops)
    if report:
        df = df.withColumns(
            {"missing_categories": missing_categories(df), "few_features": present_count(df) < MIN_FEATURES}
        )
    return df


def missing_categories(df: DataFrame) -> Column:
    checks = []
    for category, names in CATEGORIES.items():
        have = [F.col(n) for n in names if n in df.columns]
        absent = F.coalesce(*have).isNull() if have else F.lit(True)
        checks.append(F.when(absent, category))
    return F.array_compact(F.array(*checks))


def present_count(df: DataFrame) -> Column:
    total = F.lit(0)
    for name in feature_names(df):
        total = total + F.col(name).isNotNull().cast("int")
    return total


def apply_bounds(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: clip(F.col(c).cast("double"), *b) for c, b in bounds.items() if c in df.columns})


def add_interactions(df: DataFrame) -> DataFrame:
    """Products of feature pairs; NULL where a factor is missing."""
    have = set(df.columns)
    new = {}
    if {"Max_Drawdown_30", "Return_Since_Open_Enhanced"} <= have:
        new["Max_Drawdown_Return_Interaction"] = F.col("Max_Drawdown_30") * F.col("Return_Since_Open_Enhanced")
    if {"Support_Resistance_Proximity", "Mid_Price_Momentum"} <= have:
        new["Support_Momentum_Interaction"] = F.col("Support_Resistance_Proximity") * F.col("Mid_Price_Momentum")
    if {"RSI_14", "RSI_Distance_From_50"} <= have:
        new["RSI_Momentum_Signal"] = (F.col("RSI_14") - 50) * F.col("RSI_Distance_From_50")
    return df.withColumns(new) if new else df


def percent_share(x: Column) -> Column:
    """Values in [0, 100] are divided by 100 (those already in [0, 1] too), others go to 0 or 1."""
    return F.when(x.between(0, 100), x / 100).when(x < 0, 0.0).when(x <= float("inf"), 1.0)


def optimize_base(df: DataFrame, normalize: bool = True, interactions: bool = True) -> DataFrame:
    """Bounded, scaled features with pair products; invalid values become NULL.

    A column with a final bound skips the wider first one. Products use the values between the two.
    """
    df = df.drop(*[c for c in OPTIMISER_REMOVED if c in df.columns])
    df = apply_bounds(df, {c: b for c, b in OUTLIER_BOUNDS.items() if c not in FINAL_BOUNDS})
    if interactions:
        df = add_interactions(df)
    last: dict[str, Column] = {}
    for c in df.columns:
        if c in NOT_FEATURES or not isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            continue
        if c in FINAL_BOUNDS:
            last[c] = clip(F.col(c), *FINAL_BOUNDS[c])
        elif normalize and c in PERCENT_COLUMNS:
            last[c] = percent_share(F.col(c))
        elif c not in OUTLIER_BOUNDS:
            last[c] = no_nan(F.col(c))
    return df.withColumns(last) if last else df


def optimize_features(
    df: DataFrame, normalize: bool = True, interactions: bool = True, impulse: bool = True
) -> DataFrame:
    """Model-ready features; impulse columns are added when the four vector columns are present."""
    df = optimize_base(df, normalize, interactions)
    if impulse and "Impulse_Vector_Magnitude" in df.columns:
        df = df.withColumns(impulse_summary())
        df = df.drop(*[c for c in df.columns if c.startswith("Impulse_Vector_")])
        if interactions:
            for name, neutral in (
                ("Volume_vs_SMA10", 1.0), ("RSI_14", 50.0),
                ("Support_Resistance_Proximity", 5.0), ("Mid_Price_Momentum", 0.0),
            ):
                if name not in df.columns:
                    df = df.withColumn(name, F.lit(neutral))
            df = df.withColumns(impulse_interactions())
    return df


def _warnings(checks: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), name) for name, cond in checks.items()]))


def _get(df: DataFrame, name: str, default: float) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(float(default))) if name in df.columns else F.lit(float(default))


def consistency_warnings(df: DataFrame) -> DataFrame:
    """Adds feature_warnings: names of the relations between main features that do not hold."""

    def g(name: str, default: float = 0.0) -> Column:
        return _get(df, name, default)

    price, day_open = g("close"), g("day_open")
    ret = g("Return_Since_Open")
    vwap, over_vwap = g("VWAP"), g("Normalized_Price_VWAP", 1.0)
    up, down, width = g("Bollinger_Bands_Upper"), g("Bollinger_Bands_Lower"), g("Bollinger_Band_Width")
    bands = (up > 0) & (down > 0) & (width > 0)
    imb, vw_imb = g("Order_Book_Imbalance"), g("Volume_Weighted_Order_Book_Imbalance")
    spread, rank = g("Bid_Ask_Spread_Pct"), g("Spread_Percentile_20", 0.5)
    atr, shift = g("ATR_14"), g("Volatility_Regime_Shift")
    current = g("Current_Price")
    checks = {
        "Return_Since_Open_Consistency": F.when(
            (price > 0) & (day_open > 0) & (F.abs(ret) < 50),
            F.abs((price - day_open) / day_open * 100 - ret) > 0.1,
        ),
        "VWAP_Normalization": F.when((price > 0) & (vwap > 0), F.abs(price / vwap - over_vwap) > 0.001),
        "Bollinger_Bands": F.when(bands, F.abs((up - down) / ((up + down) / 2) - width) > 0.001),
        "Bollinger_Bands_Order": bands & (up <= down),
        "Imbalance_Signs": (F.abs(imb) > 0.1) & (F.abs(vw_imb) > 0.1) & (F.signum(imb) != F.signum(vw_imb)),
        "Spread_Percentile": (spread <= 0) & ~rank.isin(0.0, 0.5, 1.0),
        "Volatility_Consistency": F.when(
            (atr > 0) & (F.abs(shift) > 1.0) & (price > 0), atr / price * 100 < 0.05
        ),
        "Price_Position_Bounds": ~g("Price_Position_In_Spread", 0.5).between(0, 1),
        "Day_Position_Bounds": ~g("Position_In_Day_Range", 0.5).between(0, 1),
        "RSI_Bounds": ~g("RSI_14", 50).between(0, 100),
        "R_Levels_Stop": (current > 0) & (g("1R_Stop_Loss") >= current),
        "R_Levels_Target": (current > 0) & (g("2R_Target") <= current),
    }
    return df.withColumn("feature_warnings", _warnings(checks))


def extra_consistency_warnings(df: DataFrame) -> DataFrame:
    """Adds extra_warnings for the additional features; a check applies only where its columns exist."""
    checks: dict[str, Column] = {}
    for name, label in (
        ("Volume_Percentile_Intraday", "Volume_Percentile_Intraday_Range"),
        ("Intraday_Performance_Percentile", "Intraday_Performance_Percentile_Range"),
        ("RSI_Distance_From_50", "RSI_Distance_Range"),
        ("Momentum_Consistency", "Momentum_Consistency_Range"),
        ("Order_Book_Stability", "Order_Book_Stability_Range"),
        ("Price_Action_Quality", "Price_Action_Quality_Range"),
    ):
        if name in df.columns:
            checks[label] = ~F.col(name).between(0, 1)
    if {"RSI_Regime_Numeric", "RSI_Distance_From_50"} <= set(df.columns):
        checks["RSI_Regime_Consistency"] = (F.abs("RSI_Regime_Numeric") == 1) & (F.col("RSI_Distance_From_50") < 0.4)
    if {"Market_Regime_Numeric", "Return_Since_Open_Enhanced"} <= set(df.columns):
        regime, ret = F.col("Market_Regime_Numeric"), F.col("Return_Since_Open_Enhanced")
        checks["Market_Regime_Return_Mismatch"] = ((regime >= 1) & (ret < -1.0)) | ((regime <= -1) & (ret > 1.0))
    return df.withColumn("extra_warnings", _warnings(checks))


def align_features(df: DataFrame, names: list[str]) -> DataFrame:
    """Features in model order: absent ones are 0.0, and missing_features lists them per row."""
    have = set(df.columns)
    absent = [
        F.when(F.col(n).isNull(), n) if n in have else F.lit(n) for n in names
    ]
    values = [(F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in have else F.lit(0.0)).alias(n) for n in names]
    rest = [F.col(c) for c in df.columns if c not in names]
    return df.select(*rest, *values, F.array_compact(F.array(*absent)).alias("missing_features"))
