"""Quote, spread and volume features of the current bar against the bars before it."""

from __future__ import annotations

from barloom.functions.text import bound, gated, pct
from barloom.operators.session_series import Level, has_quotes, has_sizes


def quote_features(columns) -> Level:
    quotes, sizes = has_quotes(columns), has_sizes(columns)
    null = "CAST(NULL AS DOUBLE)"
    out = {
        "Bid_Ask_Spread_Pct": null,
        "Order_Book_Imbalance": null,
        "Price_Position_In_Spread": "0.5D",
        "Volume_Weighted_Order_Book_Imbalance": "0D",
        "Mid_Price_Momentum":
            "CASE WHEN size(_mids5) = 5 THEN "
            f"CASE WHEN _mid5 = 0 THEN 0D ELSE {bound(pct('_mid1', '_mid5'), -2, 2)} END END",
    }
    if quotes:
        out["Bid_Ask_Spread_Pct"] = (
            "CASE WHEN ask_px > 0 AND bid_px > 0 AND ask_px > bid_px "
            "THEN (ask_px - bid_px) / ((ask_px + bid_px) / 2) * 100 END"
        )
        out["Price_Position_In_Spread"] = (
            "CASE WHEN ask_px <= bid_px OR close <= 0 THEN 0.5D WHEN close < bid_px THEN 0D "
            "WHEN close > ask_px THEN 1D WHEN ask_px > bid_px THEN (close - bid_px) / (ask_px - bid_px) ELSE 0.5D END"
        )
    if sizes:
        out["Order_Book_Imbalance"] = (
            "CASE WHEN bid_sz >= 0 AND ask_sz >= 0 AND bid_sz + ask_sz > 0 "
            "THEN (bid_sz - ask_sz) / (bid_sz + ask_sz) END"
        )
    if quotes and sizes:
        bid, ask = "bid_px * bid_sz", "ask_px * ask_sz"
        out["Volume_Weighted_Order_Book_Imbalance"] = gated(
            f"bid_px > 0 AND ask_px > 0 AND bid_sz >= 0 AND ask_sz >= 0 AND {bid} + {ask} > 0",
            f"({bid} - {ask}) / ({bid} + {ask})", "0D",
        )
    return out


def spread_rank() -> Level:
    """Share of the positive spreads among 20 earlier bars that are at most the current spread."""
    return {
        "Spread_Percentile_20":
            "CASE WHEN _n < 20 OR _spread_count20 < 5 OR Bid_Ask_Spread_Pct <= 0 OR size(_spreads20) = 0 THEN 0.5D "
            "WHEN Bid_Ask_Spread_Pct IS NULL THEN 0D "
            "ELSE size(filter(_spreads20, x -> x <= Bid_Ask_Spread_Pct)) / size(_spreads20) END"
    }


def volume_features(columns) -> Level:
    counted = "trade_count" in columns
    base = "CASE WHEN close > 200 THEN 200D WHEN close > 50 THEN 300D ELSE 500D END"
    size = f"({base}) * CASE WHEN _v1 < 500 THEN 0.5D WHEN _v1 > 5000 THEN 1.5D ELSE 1D END"
    median = (
        "(get(sort_array(_impacts), (size(_impacts) - 1) div 2) + get(sort_array(_impacts), size(_impacts) div 2)) / 2"
    )
    stable = bound("1 - _imb_sd10 / _imb_abs10", 0, 1)
    return {
        # trades in the last bar: the count itself where the feed has one, else an estimate from volume
        "Trade_Count_Per_Minute_Log": (
            gated("_n >= 1", bound("_trade_count1", 1, 100), "0D")
            if counted
            else gated("_v1 > 0", bound(f"log1p(_v1 / ({size}))", 0, 5), "0D")
        ),
        "Volume_Rate_of_Change":
            f"CASE WHEN _n >= 2 THEN CASE WHEN _v2 > 0 THEN {bound('(_v1 - _v2) / _v2 * 100', -95, 500)} "
            "WHEN _v1 > 0 THEN 500D END END",
        # median price change per share, per $1000 traded and in basis points
        "Price_Impact_Normalized": gated(
            "_n >= 3 AND size(_impacts) >= 2 AND close > 0", bound(f"{median} * 1e7D / (close * close)", 0, 5), "0D"
        ),
        "Volume_vs_SMA10": gated("_n >= 2 AND _vol_before9 > 0", bound("_v1 / _vol_before9", 0, 50), "1D"),
        "Normalized_Price_VWAP": gated(
            "_vpos_hist > 0 AND _value_hist > 0 AND close > 0", bound("close / (_value_hist / _vpos_hist)", 0.5, 2), "1D"
        ),
        "Volume_Percentile_Intraday": gated(
            "_vol_count_hist > 0", "(_vol_rank + 1) / (_vol_count_hist + 1)", "0.5D",
        ),
        "Volume_Zscore_Intraday": gated("_n > 2 AND _vol_sd_hist > 0", "(volume - _vol_mean_hist) / _vol_sd_hist", "0D"),
        "Order_Book_Stability": gated("_n >= 3 AND _imb_count10 >= 2 AND _imb_abs10 > 0.01", stable, "0.5D"),
    }
