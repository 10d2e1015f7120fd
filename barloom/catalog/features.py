"""Point-in-time features over the event bars, one query per feature group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.catalog import register
from barloom.catalog.sql_parts import BARS, DAILY, SERIES, WINDOWS, clip, ema, over_series, r6
from barloom.functions.frames import FrameText, span_alpha
from barloom.functions.text import apply_levels
from barloom.operators import long_sessions
from barloom.operators.session_series import ema_sums
from barloom.plans.features import MIN_HISTORY, feature_table, feature_table_in_passes
from barloom.sources import driver_tables as D


def features(spark: SparkSession, sf_dir: str, columns: list[str] | None = None, daily: bool = False, **more) -> DataFrame:
    bars = D.event_bars(spark, sf_dir)
    return feature_table(bars, D.event_daily(spark, sf_dir) if daily else None, columns=columns, **more)


def rounded(df: DataFrame, names: list[str]) -> DataFrame:
    """Keys plus the named columns; doubles to six places."""
    kinds = dict(df.dtypes)
    cols = [
        f"floor(`{n}` * 1e6D + 0.5D) / 1e6D AS `{n}`" if kinds[n] == "double" else f"`{n}`" for n in names
    ]
    return df.selectExpr("symbol", "unix_seconds(ts) AS ts_s", *cols)


FEATURE_SQL: dict[str, str] = {}  # the parts that together state the full projection


def feature_query(name: str, columns: list[str], sql: str, daily: bool = False):
    FEATURE_SQL[name] = sql

    @register(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(features(spark, sf_dir, columns, daily), columns)

    return run


SPREAD = "CASE WHEN ask_px > bid_px AND bid_px > 0 THEN (ask_px - bid_px) / ((ask_px + bid_px) / 2) * 100 END"

feature_query(
    "quote_state",
    ["Bid_Ask_Spread_Pct", "Order_Book_Imbalance", "Price_Position_In_Spread", "Volume_Weighted_Order_Book_Imbalance"],
    over_series([], {
        "Bid_Ask_Spread_Pct": r6(SPREAD),
        "Order_Book_Imbalance": r6("(bid_sz - ask_sz) / (bid_sz + ask_sz)"),
        "Price_Position_In_Spread": r6("(close - bid_px) / (ask_px - bid_px)"),
        "Volume_Weighted_Order_Book_Imbalance":
            r6("(bid_px * bid_sz - ask_px * ask_sz) / (bid_px * bid_sz + ask_px * ask_sz)"),
    }),
)

feature_query(
    "mid_price_momentum", ["Mid_Price_Momentum"],
    over_series(
        [{"mid": "(bid_px + ask_px) / 2"}, {"m1": "lag(mid, 1) OVER w", "m5": "lag(mid, 5) OVER w"}],
        {"Mid_Price_Momentum": r6(f"CASE WHEN n >= 5 THEN {clip('(m1 - m5) / m5 * 100', -2, 2)} END")},
    ),
)

feature_query(
    "spread_percentile", ["Spread_Percentile_20"],
    over_series(
        [{"sp": SPREAD}, {"l": "list(sp) OVER p20"}],
        {"Spread_Percentile_20": r6(
            "CASE WHEN n < 20 THEN 0.5 ELSE len(list_filter(l, lambda x: x <= sp)) / len(l) END")},
    ),
)

feature_query(
    "trade_count_log", ["Trade_Count_Per_Minute_Log"],
    over_series(
        [{"base": "CASE WHEN close > 200 THEN 200.0 WHEN close > 50 THEN 300.0 ELSE 500.0 END"},
         {"size": "base * CASE WHEN v1 < 500 THEN 0.5 WHEN v1 > 5000 THEN 1.5 ELSE 1.0 END"}],
        {"Trade_Count_Per_Minute_Log": r6(
            "CASE WHEN v1 > 0 THEN least(5.0, greatest(0.0, ln(1 + v1 / size))) ELSE 0 END")},
    ),
)

feature_query(
    "volume_rate_of_change", ["Volume_Rate_of_Change"],
    over_series([], {"Volume_Rate_of_Change": r6(
        f"CASE WHEN n >= 2 THEN CASE WHEN v2 > 0 THEN {clip('(v1 - v2) / v2 * 100', -95, 500)} "
        "WHEN v1 > 0 THEN 500 END END")}),
)

feature_query(
    "price_impact", ["Price_Impact_Normalized"],
    over_series(
        [{"d": "abs(close - c1)"},
         {"x": "list(d / volume) FILTER (d > 0 AND volume >= 100) OVER last4"}],
        {"Price_Impact_Normalized": r6(
            "CASE WHEN n >= 3 AND len(x) >= 2 THEN "
            "least(5.0, greatest(0.0, list_median(x) / close * 1000 / close * 10000)) ELSE 0 END")},
    ),
)

feature_query(
    "volume_vs_sma10", ["Volume_vs_SMA10"],
    over_series([{"a": "avg(volume) OVER b10"}], {"Volume_vs_SMA10": r6(
        f"CASE WHEN n >= 2 AND a > 0 THEN {clip('v1 / a', 0, 50)} ELSE 1 END")}),
)

feature_query(
    "vwap_ratio", ["Normalized_Price_VWAP"],
    over_series(
        [{"vwap": "sum((high + low + close) / 3 * volume) OVER hist / sum(volume) OVER hist"}],
        {"Normalized_Price_VWAP": r6(f"coalesce({clip('close / vwap', 0.5, 2)}, 1)")},
    ),
)

_MACD = [
    {"e12": ema("list(close) OVER upto", "2.0/13"), "e26": ema("list(close) OVER upto", "2.0/27")},
    {"macd": "e12 - e26"},
    {"hist_line": f"macd - {ema('list(macd) OVER upto', '2.0/10')}"},
    {"h1": "lag(hist_line) OVER w"},
]
feature_query(
    "macd", ["MACD_12_26_9"],
    over_series(_MACD, {"MACD_12_26_9": r6(f"CASE WHEN n >= 35 THEN {clip('h1 / close * 100', -2, 2)} ELSE 0 END")}),
)

_RSI = [
    {"gain": "CASE WHEN close > c1 THEN close - c1 ELSE 0.0 END", "loss": "CASE WHEN close < c1 THEN c1 - close ELSE 0.0 END"},
    {"ag": ema("list(gain) OVER hist", "1.0/14"), "al": ema("list(loss) OVER hist", "1.0/14")},
    {"rsi": "CASE WHEN n < 15 THEN 50.0 WHEN al = 0 THEN 100.0 ELSE 100 - 100 / (1 + ag / al) END"},
]
_REGIME = ("CASE WHEN rsi >= 70 THEN 'overbought' WHEN rsi <= 30 THEN 'oversold' WHEN rsi >= 60 THEN 'bullish' "
           "WHEN rsi <= 40 THEN 'bearish' ELSE 'neutral' END")
_REGIME_NUMBER = "CASE WHEN rsi >= 70 THEN 1 WHEN rsi <= 30 THEN -1 WHEN rsi >= 60 THEN 0.5 WHEN rsi <= 40 THEN -0.5 ELSE 0 END"
feature_query(
    "rsi_regime", ["RSI_14", "RSI_Regime", "RSI_Regime_Numeric", "RSI_Distance_From_50"],
    over_series(_RSI, {
        "RSI_14": r6("rsi"), "RSI_Regime": _REGIME, "RSI_Regime_Numeric": r6(_REGIME_NUMBER),
        "RSI_Distance_From_50": r6("abs(rsi - 50) / 50"),
    }),
)

feature_query(
    "bollinger_width", ["Bollinger_Band_Width"],
    over_series(
        [{"m": "avg(close) OVER p20", "sd": "stddev_samp(close) OVER p20"}],
        {"Bollinger_Band_Width": r6("CASE WHEN n >= 20 AND sd > 0 THEN 4 * sd / m ELSE 0 END")},
    ),
)


@register(
    "bollinger_bands",
    over_series(
        [{"m": "avg(close) OVER p20", "sd": "stddev_samp(close) OVER p20"}],
        {"upper": r6("CASE WHEN n >= 20 AND sd > 0 THEN m + 2 * sd ELSE close END"),
         "lower": r6("CASE WHEN n >= 20 AND sd > 0 THEN m - 2 * sd ELSE close END")},
    ),
)
def bollinger_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["Bollinger_Bands_Upper", "Bollinger_Bands_Lower"]
    df = features(spark, sf_dir, names).withColumnsRenamed(dict(zip(names, ["upper", "lower"], strict=True)))
    return rounded(df, ["upper", "lower"])


# Open and mean close of the visible daily rows, by scanning all earlier days of the symbol for each bar.
_DAILY_VISIBLE = f"""{DAILY}, dctx AS (
  SELECT d.symbol, d.date,
    (SELECT arg_max(x.open, x.date) FROM daily x WHERE x.symbol = d.symbol AND x.date <= d.date) AS day_open,
    (SELECT CASE WHEN count(*) >= 49
       THEN list_avg(list_slice(list(x.close ORDER BY x.date DESC), 1, 49)) ELSE avg(x.close) END
     FROM daily x WHERE x.symbol = d.symbol AND x.date < d.date) AS daily_mean
  FROM daily d)"""
_WITH_DAILY = f"""WITH {BARS}, {SERIES}, {_DAILY_VISIBLE}, p AS (
  SELECT s.*, dctx.day_open, dctx.daily_mean,
    avg(s.close) OVER p50 AS mean50, min(s.close) OVER hist AS lo, max(s.close) OVER hist AS hi
  FROM s JOIN dctx ON dctx.symbol = s.symbol AND dctx.date = s.trade_date
  WINDOW p50 AS (PARTITION BY s.symbol, s.session ORDER BY s.ts ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING),
         hist AS (PARTITION BY s.symbol, s.session ORDER BY s.ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_SINCE_OPEN = clip("(close - day_open) / day_open * 100", -20, 20)

feature_query(
    "daily_asof_open",
    ["Return_Since_Open", "Return_Since_Open_Enhanced", "Intraday_Performance_Percentile", "Price_vs_SMA50"],
    f"""{_WITH_DAILY}
SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts_s,
  {r6(_SINCE_OPEN)} AS "Return_Since_Open",
  {r6(f"CASE WHEN n >= 1 THEN {_SINCE_OPEN} ELSE 0 END")} AS "Return_Since_Open_Enhanced",
  {r6("CASE WHEN n > 10 AND hi > lo THEN greatest(0, least(1, (close - lo) / (hi - lo))) ELSE 0.5 END")}
    AS "Intraday_Performance_Percentile",
  {r6("coalesce(CASE WHEN n >= 50 THEN (close - mean50) / mean50 * 100 ELSE (close - daily_mean) / daily_mean * 100 END, 0)")}
    AS "Price_vs_SMA50"
FROM p""",
    daily=True,
)

feature_query(
    "return_5min", ["Return_5min"],
    over_series([{"c6": "lag(close, 6) OVER w"}], {"Return_5min": r6(
        f"CASE WHEN n >= 6 THEN {clip('(close - c6) / c6 * 100', -5, 5)} ELSE 0 END")}),
)

# Wilder average restarted on every 30-bar list, as a plain loop over the list.
_ATR = [
    {"bar": "struct_pack(h := high, l := low, c := close)"},
    {"bs": "list(bar) OVER p30"},
    {"trs": "list_transform(range(1, len(bs) + 1), lambda i: CASE WHEN i = 1 THEN bs[1].h - bs[1].l "
            "ELSE greatest(bs[i].h - bs[i].l, abs(bs[i].h - bs[i-1].c), abs(bs[i].l - bs[i-1].c)) END)"},
    {"atr_pct": f"CASE WHEN n >= 15 THEN {ema('trs', '1.0/14')} / close * 100 ELSE 0 END"},
]
feature_query(
    "atr_pct", ["ATR_Pct", "ATR_Stop_Risk_Pct"],
    over_series(_ATR, {
        "ATR_Pct": r6("atr_pct"),
        "ATR_Stop_Risk_Pct": r6("least(50.0, 2 * atr_pct / close * 100)"),
    }),
)

feature_query(
    "vol_regime_shift", ["Volatility_Regime_Shift_Norm"],
    over_series(
        [{"r": "(close - c1) / c1"}, {"a": "stddev_samp(r) OVER p10", "b": "stddev_samp(r) OVER prior30"},
         {"q": "a / nullif(b, 0)"}],
        {"Volatility_Regime_Shift_Norm": r6(
            "CASE WHEN n < 31 OR q IS NULL THEN 0 WHEN q > 1 THEN tanh((q - 1) / 2) ELSE -tanh((1 - q) / 2) END")},
    ),
)

# Smoothed ranges by recursion: span 14 over the whole session, or a third of a short session.
_VOLPCT = [
    {"tr": "greatest(high - low, abs(high - c1), abs(low - c1))"},
    {"trs": "list(tr) OVER hist"},
    {"alpha": "2.0 / (least(14, n // 3) + 1)"},
    {"atrs": "list_transform(range(greatest(1, n - 99), n + 1), lambda i: "
             "list_reduce(trs[1:i], lambda a, x: a + alpha * (x - a)))"},
]
feature_query(
    "vol_percentile", ["Volatility_Percentile_100"],
    over_series(_VOLPCT, {"Volatility_Percentile_100": r6(
        "CASE WHEN n < 20 THEN 50 ELSE len(list_filter(atrs, lambda x: x <= atrs[-1] * (1 + 1e-12))) / len(atrs) * 100 END")}),
)

feature_query(
    "position_in_day_range", ["Position_In_Day_Range"],
    over_series([{"lo": "min(low) OVER hist", "hi": "max(high) OVER hist"}], {"Position_In_Day_Range": r6(
        "CASE WHEN hi > lo THEN greatest(0, least(1, (close - lo) / (hi - lo))) ELSE 0.5 END")}),
)

# Centred frames of 10 (5 before, 4 after) and 20 (10 before, 9 after) inside the list of 50 bars.
_LEVELS = [
    {"hs": "list(high) OVER p50", "ls": "list(low) OVER p50"},
    {"k": "len(hs)", "span": "list_max(hs) - list_min(ls)"},
    {"ups": "list_filter(range(1, k + 1), lambda i: "
            "(i > 5 AND i + 4 <= k AND hs[i] = list_max(hs[i-5:i+4])) OR "
            "(i > 10 AND i + 9 <= k AND hs[i] = list_max(hs[i-10:i+9])) OR "
            "(span > 0 AND hs[i] >= list_max(hs) - span * 0.1))",
     "downs": "list_filter(range(1, k + 1), lambda i: "
              "(i > 5 AND i + 4 <= k AND ls[i] = list_min(ls[i-5:i+4])) OR "
              "(i > 10 AND i + 9 <= k AND ls[i] = list_min(ls[i-10:i+9])) OR "
              "(span > 0 AND ls[i] <= list_min(ls) + span * 0.1))"},
    {"up": "list_min(list_filter(list_transform(ups, lambda i: hs[i]), lambda x: x > close AND x - close >= close * 0.001))",
     "down": "list_max(list_filter(list_transform(downs, lambda i: ls[i]), lambda x: x < close AND close - x >= close * 0.001))"},
    {"near": "least((up - close) / close * 100, (close - down) / close * 100)"},
]
feature_query(
    "support_resistance", ["Support_Resistance_Proximity"],
    over_series(_LEVELS, {"Support_Resistance_Proximity": r6(
        "CASE WHEN n < 20 OR near IS NULL THEN 5 ELSE greatest(near, 0.1) END")}),
)

feature_query(
    "breakout", ["Breakout_Confirmation"],
    over_series(
        [{"top": "max(high) OVER b20", "av": "avg(volume) OVER b20"}],
        {"Breakout_Confirmation": r6(
            "CASE WHEN n >= 20 AND close > top AND v1 > 1.5 * av THEN "
            "greatest(0.0, least(1.0, (close - top) / top * 100 + 0.1 * (v1 / av - 1))) ELSE 0 END")},
    ),
)

feature_query(
    "price_acceleration", ["Price_Acceleration"],
    over_series(
        [{"c2": "lag(close, 2) OVER w", "c3": "lag(close, 3) OVER w"}],
        {"Price_Acceleration": r6(f"CASE WHEN n >= 3 THEN {clip('(c1 - 2 * c2 + c3) / close * 100', -10, 10)} ELSE 0 END")},
    ),
)

feature_query(
    "max_drawdown_30", ["Max_Drawdown_30"],
    over_series(
        [{"cs": "list(close) OVER p30"},
         {"dd": "list_min(list_transform(range(1, len(cs) + 1), lambda i: (cs[i] - list_max(cs[1:i])) / list_max(cs[1:i]) * 100))"}],
        {"Max_Drawdown_30": r6("CASE WHEN n >= 5 THEN least(0, dd) ELSE 0 END")},
    ),
)

feature_query(
    "time_of_day", ["Time_Of_Day_Cyclical_Sin", "Time_Of_Day_Cyclical_Cos"],
    over_series([], {
        "Time_Of_Day_Cyclical_Sin": r6("sin(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440)"),
        "Time_Of_Day_Cyclical_Cos": r6("cos(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440)"),
    }),
)

feature_query(
    "volume_rank", ["Volume_Percentile_Intraday", "Volume_Zscore_Intraday"],
    over_series(
        [{"vs": "list(volume) OVER hist", "m": "avg(volume) OVER hist", "sd": "stddev_samp(volume) OVER hist"}],
        {"Volume_Percentile_Intraday": r6(
            "CASE WHEN n = 0 THEN 0.5 ELSE (len(list_filter(vs, lambda x: x <= volume)) + 1) / (n + 1) END"),
         "Volume_Zscore_Intraday": r6("CASE WHEN n > 2 AND sd > 0 THEN (volume - m) / sd ELSE 0 END")},
    ),
)

_MOMENTUM = [
    {"cs": "list(close) OVER p6"},
    {"steps": "list_filter(list_transform(range(2, len(cs) + 1), lambda i: sign(cs[i] - cs[i-1])), lambda x: x <> 0)",
     "trend": "CASE WHEN cs[6] > cs[1] THEN 1 ELSE -1 END"},
]
feature_query(
    "momentum_shape", ["Momentum_Acceleration", "Momentum_Consistency"],
    over_series(_MOMENTUM, {
        "Momentum_Acceleration": r6(
            "CASE WHEN n >= 6 THEN (cs[6] - cs[4]) / cs[4] - (cs[4] - cs[1]) / cs[1] ELSE 0 END"),
        "Momentum_Consistency": r6(
            "CASE WHEN n >= 6 AND len(steps) > 0 THEN len(list_filter(steps, lambda x: x = trend)) / len(steps) ELSE 0.5 END"),
    }),
)

feature_query(
    "order_book_stability", ["Order_Book_Stability"],
    over_series(
        [{"imb": "(bid_sz - ask_sz) / (bid_sz + ask_sz)"},
         {"sd": "stddev_pop(imb) OVER p10", "m": "avg(abs(imb)) OVER p10"}],
        {"Order_Book_Stability": r6(
            "CASE WHEN n >= 3 AND m > 0.01 THEN greatest(0, least(1, 1 - sd / m)) ELSE 0.5 END")},
    ),
)

feature_query(
    "price_action_quality", ["Price_Action_Quality"],
    over_series(
        [{"d": "abs(close - c1)", "nd": "CAST(n AS DOUBLE)"},
         {"r": "corr(nd, close) OVER p10", "path": "sum(d) OVER p9", "c10": "lag(close, 10) OVER w"}],
        {"Price_Action_Quality": r6(
            "CASE WHEN n >= 10 THEN (coalesce(CASE WHEN isfinite(r) THEN r * r END, 0) + "
            "CASE WHEN path > 0 THEN abs(c1 - c10) / path ELSE 0 END) / 2 ELSE 0.5 END")},
    ),
)

_LEVEL_SQL = {
    "Current_Price": "round_even(close, 2)",
    "1R_Stop_Loss": "round_even(close - atr, 2)",
    "Risk_Amount_Pct": "risk_pct",
    "ATR_Distance": "round_even(atr, 3)",
    "1R_Target": "round_even(close + reward, 2)",
    "1_5R_Target": "round_even(close + 1.5 * reward, 2)",
    "2R_Target": "round_even(close + 2 * reward, 2)",
    "3R_Target": "round_even(close + 3 * reward, 2)",
    "4R_Target": "round_even(close + 4 * reward, 2)",
}
R_LEVELS = [
    *_ATR,
    {"atr": "atr_pct / 100 * close"},
    {"reward": "greatest(0.0020 * close, atr)", "risk_pct": "round_even(atr / close * 100, 2)"},
]
feature_query(
    "r_levels", [*_LEVEL_SQL, "Position_Size_1pct_Risk"],
    over_series(R_LEVELS, {
        **{k: r6(f"CASE WHEN atr_pct > 0 THEN {v} END") for k, v in _LEVEL_SQL.items()},
        "Position_Size_1pct_Risk":
            r6("CASE WHEN atr_pct > 0 AND risk_pct > 0 THEN round_even(100 / risk_pct, 2) ELSE 0 END"),
    }),
)

# Turning points found inside each list of 30, the list's ends having one-sided neighbours.
_IMPULSE = [
    {"x": "list((high + low) / 2) OVER p30"},
    {"kinds": "list_transform(range(1, 31), lambda i: CASE "
              "WHEN len(x) < 30 OR i = 1 OR i = 30 THEN 0 "
              "WHEN x[i] > list_max(x[greatest(1, i-2):i-1]) AND x[i] > list_max(x[i+1:least(30, i+2)]) THEN 1 "
              "WHEN x[i] < list_min(x[greatest(1, i-2):i-1]) AND x[i] < list_min(x[i+1:least(30, i+2)]) THEN -1 "
              "ELSE 0 END)"},
    {"pts": "list_filter(range(1, 31), lambda i: kinds[i] <> 0)"},
    {"hit": "list_max(list_filter(range(2, len(pts) + 1), lambda j: kinds[pts[j]] <> kinds[pts[j-1]]))"},
    {"a": "pts[hit - 1]", "b": "pts[hit]"},
    {"mag": "abs(x[b] - x[a]) / x[a]"},
]
feature_query(
    "impulse_vector",
    ["Impulse_Vector_Magnitude", "Impulse_Vector_Direction", "Impulse_Vector_Duration", "Impulse_Vector_Slope"],
    over_series(_IMPULSE, {
        "Impulse_Vector_Magnitude": "CASE WHEN hit IS NULL THEN 0.0 ELSE round_even(CAST(mag AS DOUBLE), 6) END",
        "Impulse_Vector_Direction": "CAST(CASE WHEN hit IS NULL THEN 0 WHEN x[b] > x[a] THEN 1 ELSE -1 END AS INTEGER)",
        "Impulse_Vector_Duration": "CAST(CASE WHEN hit IS NULL THEN 0 ELSE b - a END AS INTEGER)",
        "Impulse_Vector_Slope": "CASE WHEN hit IS NULL THEN 0.0 ELSE round_even(CAST(mag / (b - a) AS DOUBLE), 6) END",
    }),
)


_SCORE = """(CASE WHEN rsi > 70 THEN 1 WHEN rsi < 30 THEN -1 ELSE 0 END
  + CASE WHEN vp > 0.8 THEN 0.5 WHEN vp < 0.2 THEN -0.5 ELSE 0 END
  + CASE WHEN acc > 0.001 THEN 0.5 WHEN acc < -0.001 THEN -0.5 ELSE 0 END
  + CASE WHEN ret > 2 THEN 0.5 WHEN ret < -2 THEN -0.5 ELSE 0 END)"""


@register(
    "market_regime",
    f"""{_WITH_DAILY}, r0 AS (
  SELECT *, CASE WHEN close > c1 THEN close - c1 ELSE 0.0 END AS gain,
         CASE WHEN close < c1 THEN c1 - close ELSE 0.0 END AS loss FROM p),
r1 AS (SELECT *, {ema('list(gain) OVER hist', '1.0/14')} AS ag, {ema('list(loss) OVER hist', '1.0/14')} AS al,
         list(volume) OVER hist AS vs, list(close) OVER p6 AS cs FROM r0 WINDOW {WINDOWS}),
r2 AS (SELECT *, CASE WHEN n < 15 THEN 50.0 WHEN al = 0 THEN 100.0 ELSE 100 - 100 / (1 + ag / al) END AS rsi,
         CASE WHEN n = 0 THEN 0.5 ELSE (len(list_filter(vs, lambda x: x <= volume)) + 1) / (n + 1) END AS vp,
         CASE WHEN n >= 6 THEN (cs[6] - cs[4]) / cs[4] - (cs[4] - cs[1]) / cs[1] ELSE 0 END AS acc,
         CASE WHEN n >= 1 THEN {_SINCE_OPEN} ELSE 0 END AS ret FROM r1),
r3 AS (SELECT *, {_SCORE} AS score FROM r2)
SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts_s,
  CASE WHEN score >= 1.5 THEN 'strong_bullish' WHEN score >= 0.5 THEN 'bullish' WHEN score <= -1.5 THEN 'strong_bearish'
       WHEN score <= -0.5 THEN 'bearish' ELSE 'neutral' END AS "Market_Regime",
  CAST(CASE WHEN score >= 1.5 THEN 2 WHEN score >= 0.5 THEN 1 WHEN score <= -1.5 THEN -2 WHEN score <= -0.5 THEN -1
       ELSE 0 END AS INTEGER) AS "Market_Regime_Numeric"
FROM r3""",
)
def market_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["Market_Regime", "Market_Regime_Numeric"]
    return rounded(features(spark, sf_dir, names, True), names)


@register(
    "ema_kernel",
    over_series([{"l": "list(close) OVER upto"}], {
        "ema12": r6(ema("l", "2.0/13")), "ema26": r6(ema("l", "2.0/27")), "wilder14": r6(ema("l", "1.0/14"))}),
)
def ema_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(recursive_averages(D.event_bars(spark, sf_dir)), ["ema12", "ema26", "wilder14"])


def recursive_averages(bars: DataFrame) -> DataFrame:
    fr = FrameText()
    kinds = {"ema12": ("close", span_alpha(12)), "ema26": ("close", span_alpha(26)), "wilder14": ("close", 1 / 14)}
    sums, now = ema_sums(fr, kinds, "k"), {name: fr.ema_of(name, "k", alpha) for name, (_, alpha) in kinds.items()}
    return apply_levels(bars, [{"k": fr.index()}, sums, now])


@register(
    "ema_long_sessions",
    """WITH RECURSIVE t AS (SELECT 'orders' AS symbol, o_totalprice / 1000 AS x, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders),
e AS (SELECT symbol, k, x, x AS ema12, x AS ema26, x AS wilder14 FROM t WHERE k = 0
  UNION ALL SELECT t.symbol, t.k, t.x, e.ema12 + 2.0 / 13 * (t.x - e.ema12), e.ema26 + 2.0 / 27 * (t.x - e.ema26), e.wilder14 + 1.0 / 14 * (t.x - e.wilder14)
  FROM e JOIN t ON t.symbol = e.symbol AND t.k = e.k + 1)
SELECT symbol, CAST(k AS BIGINT) AS k, round_even(CAST(ema12 AS DOUBLE), 6) AS ema12, round_even(CAST(ema26 AS DOUBLE), 6) AS ema26,
  round_even(CAST(wilder14 AS DOUBLE), 6) AS wilder14 FROM e""",
)
def ema_long_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session of all orders: its length grows with the table, and the averages stay recursive."""
    kinds = {"ema12": span_alpha(12), "ema26": span_alpha(26), "wilder14": 1 / 14}
    df = long_sessions.averages(_order_session(spark, sf_dir), ["symbol", "session"], "ts", "close", kinds)
    return df.select("symbol", "k", *[F.bround(c, 6).alias(c) for c in kinds])


_ORDERS = "t AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS k, o_totalprice / 1000 AS x, CAST(floor(o_totalprice / 1000) AS DOUBLE) AS v FROM orders)"
_WEIGHTS = {"w001": 0.001, "w050": 0.05, "w300": 0.3, "w700": 0.7, "w950": 0.95, "w1000": 1.0}


def _order_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session of all orders: its length grows with the table."""
    price = F.col("o_totalprice") / 1000
    return D.table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("symbol"), F.lit("all").alias("session"), F.col("o_orderkey").alias("ts"), price.alias("close"), F.floor(price).cast("double").alias("volume"),
    )


@register(
    "ema_weights",
    f"""WITH RECURSIVE {_ORDERS}, e AS (SELECT k, {', '.join(f'x AS {n}' for n in _WEIGHTS)} FROM t WHERE k = 0
  UNION ALL SELECT t.k, {', '.join(f'e.{n} + {w!r} * (t.x - e.{n})' for n, w in _WEIGHTS.items())} FROM e JOIN t ON t.k = e.k + 1)
SELECT CAST(k AS BIGINT) AS k, {', '.join(f'round_even(CAST({n} AS DOUBLE), 6) AS {n}' for n in _WEIGHTS)} FROM e""",
)
def ema_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive averages of slow and fast weights over one long session."""
    df = long_sessions.averages(_order_session(spark, sf_dir), ["symbol", "session"], "ts", "close", _WEIGHTS)
    return df.select("k", *[F.bround(n, 6).alias(n) for n in _WEIGHTS])


@register(
    "rank_long_sessions",
    f"""WITH {_ORDERS} SELECT CAST(a.k AS BIGINT) AS k, count(b.k) AS earlier_at_most FROM t a LEFT JOIN t b ON b.k < a.k AND b.v <= a.v GROUP BY a.k""",
)
def rank_long_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of each value among the earlier ones of one long session, without lists."""
    return long_sessions.ranks_before(_order_session(spark, sf_dir), ["symbol", "session"], "ts", "volume").select("k", "earlier_at_most")


_BAR_COLUMNS = ("open", "high", "low", "close", "volume", "bid_px", "ask_px", "bid_sz", "ask_sz")
_BASE_SQL = over_series(
    _ATR,
    {"n_hist": "CAST(n AS INTEGER)", **{c: r6(c) for c in _BAR_COLUMNS},
     "ATR_Multiplier_Used": r6("CASE WHEN atr_pct > 0 THEN 1.0 END")},
    where=f"n >= {MIN_HISTORY}",
)


@register(
    "feature_table",
    f"SELECT * FROM ({_BASE_SQL}) base "
    + " ".join(f"JOIN ({sql}) {name} USING (symbol, ts_s)" for name, sql in FEATURE_SQL.items()),
)
def full_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature of every bar with enough history."""
    df = feature_table_in_passes(D.event_bars(spark, sf_dir), D.event_daily(spark, sf_dir), min_history=MIN_HISTORY)
    skip = ("symbol", "ts", "session", "trade_date", "day_open", "daily_mean50")
    return rounded(df, [c for c in df.columns if c not in skip])


@register(
    "minimum_slice",
    over_series(
        [{"vwap": "sum((high + low + close) / 3 * volume) OVER hist / sum(volume) OVER hist",
          "m": "avg(close) OVER p20", "sd": "stddev_samp(close) OVER p20", "c6": "lag(close, 6) OVER w",
          "lo": "min(low) OVER hist", "hi": "max(high) OVER hist"}],
        {"Normalized_Price_VWAP": r6(clip("close / vwap", 0.5, 2)),
         "Bollinger_Band_Width": r6("CASE WHEN n >= 20 AND sd > 0 THEN 4 * sd / m ELSE 0 END"),
         "Return_5min": r6(clip("(close - c6) / c6 * 100", -5, 5)),
         "Position_In_Day_Range": r6("CASE WHEN hi > lo THEN greatest(0, least(1, (close - lo) / (hi - lo))) ELSE 0.5 END")},
        where="n >= 15",
    ),
)
def minimum_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: VWAP ratio, Bollinger width, short return and range position for bars with history."""
    names = ["Normalized_Price_VWAP", "Bollinger_Band_Width", "Return_5min", "Position_In_Day_Range"]
    return rounded(features(spark, sf_dir, names, min_history=MIN_HISTORY), names)
