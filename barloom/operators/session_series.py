"""Per-bar series shared by the features: lags, running sums, decayed averages, swing levels.

Each level is one projection whose windows read only columns of the levels before it, so Spark plans
one Window operator per level over a single exchange and sort.
"""

from __future__ import annotations

from barloom.functions.frames import SESSION_BARS, FrameText, span_alpha

WILDER = 1.0 / 14.0

Level = dict[str, str]


def has_quotes(columns) -> bool:
    return {"bid_px", "ask_px"} <= set(columns)


def has_sizes(columns) -> bool:
    return {"bid_sz", "ask_sz"} <= set(columns)


def row_values(fr: FrameText, columns) -> Level:
    """Values that need only the bar itself, and its position in the session."""
    out = {"_n": fr.index(), "_hl": "high - low", "_hl2": "(high + low) / 2", "_volume": "coalesce(volume, 0D)"}
    if has_quotes(columns):
        out["_mid"] = "(bid_px + ask_px) / 2"
        mid = out["_mid"]
        out["_spread"] = (
            f"CASE WHEN {mid} IS NOT NULL THEN coalesce(CASE WHEN {mid} <> 0 THEN (ask_px - bid_px) / ({mid}) * 100 END, 0D) END"
        )
    else:
        out["_mid"] = "(high + low) / 2"
        out["_spread"] = "coalesce(CASE WHEN close <> 0 THEN (high - low) / close * 100 END, 0D)"
    out["_imb"] = (
        "CASE WHEN bid_sz + ask_sz > 0 THEN (bid_sz - ask_sz) / (bid_sz + ask_sz) END"
        if has_sizes(columns)
        else "CAST(NULL AS DOUBLE)"
    )
    return out


def bar_windows(fr: FrameText, columns) -> Level:
    """Windows over bar columns."""
    out = {"_vols_near": fr.rank_near("volume")}
    if "trade_count" in columns:
        out["_trade_count1"] = fr.lag("trade_count")
    out |= {
        "_mids5": f"collect_list(_mid) {fr.past(5)}",
        "_spread_count20": f"count(_spread) {fr.past(20)}",
        "_spreads20": f"collect_list(CASE WHEN _spread > 0 THEN _spread END) {fr.past(20)}",
        "_vol_before9": f"avg(volume) {fr.rows(-10, -2)}",
        "_value_hist": f"sum(CASE WHEN volume > 0 THEN (high + low + close) / 3 * volume END) {fr.hist}",
        "_vpos_hist": f"sum(CASE WHEN volume > 0 THEN volume END) {fr.hist}",
        "_mean20": f"avg(close) {fr.past(20)}",
        "_sd20": f"stddev_samp(close) {fr.past(20)}",
        "_mean50": f"avg(close) {fr.past(50)}",
        "_hist_high": f"max(high) {fr.hist}",
        "_hist_low": f"min(low) {fr.hist}",
        "_hist_cmax": f"max(close) {fr.hist}",
        "_hist_cmin": f"min(close) {fr.hist}",
        "_high_before19": f"max(high) {fr.rows(-20, -2)}",
        "_vol_before19": f"avg(volume) {fr.rows(-20, -2)}",
        "_hl2s30": f"collect_list(_hl2) {fr.past(30)}",
        "_vols10": f"collect_list(volume) {fr.past(10)}",
        "_closes30": f"collect_list(close) {fr.past(30)}",
        "_highs50": f"collect_list(high) {fr.past(50)}",
        "_lows50": f"collect_list(low) {fr.past(50)}",
        "_top50": f"max(high) {fr.past(50)}",
        "_bottom50": f"min(low) {fr.past(50)}",
        "_vol_count_hist": f"count(volume) {fr.hist}",
        "_vol_mean_hist": f"avg(volume) {fr.hist}",
        "_vol_sd_hist": f"stddev_samp(volume) {fr.hist}",
        "_imb_sd10": f"stddev_pop(_imb) {fr.past(10)}",
        "_imb_abs10": f"avg(abs(_imb)) {fr.past(10)}",
        "_imb_count10": f"count(_imb) {fr.past(10)}",
    }
    # swing levels: a bar whose high (low) is the extreme of a full centred frame of 10 or 20 bars
    for size, (before, after) in {10: (-5, 4), 20: (-10, 9)}.items():
        over = fr.rows(before, after)
        out[f"_top{size}"] = f"CASE WHEN count(high) {over} = {size} AND high = max(high) {over} THEN high END"
        out[f"_bottom{size}"] = f"CASE WHEN count(low) {over} = {size} AND low = min(low) {over} THEN low END"
    # mid-range turning points with two complete neighbours on each side
    left, right = fr.rows(-2, -1), fr.rows(1, 2)
    out["_turn"] = (
        f"CASE WHEN count(_hl2) {fr.rows(-2, 2)} < 5 THEN 0 "
        f"WHEN _hl2 > max(_hl2) {left} AND _hl2 > max(_hl2) {right} THEN 1 "
        f"WHEN _hl2 < min(_hl2) {left} AND _hl2 < min(_hl2) {right} THEN -1 ELSE 0 END"
    )
    return out


def single_bars(fr: FrameText, session_bars: int) -> Level:
    """Values of single earlier bars, read from the lists: a lag would be one more frame each; and the volume's rank."""
    out = {"_vol_rank": fr.rank_before("_n", "_volume", "_vols_near", session_bars)}
    out |= {f"_c{i}": f"try_element_at(_closes30, -{i})" for i in (*range(1, 7), 10)}
    out |= {f"_v{i}": f"try_element_at(_vols10, -{i})" for i in (1, 2)}
    out |= {f"_mid{i}": f"try_element_at(_mids5, -{i})" for i in (1, 5)}
    out |= {f"_hl2_{i}": f"try_element_at(_hl2s30, -{i})" for i in (1, 2, 3, 4, 27, 28, 29, 30)}
    return out


def changes() -> Level:
    """Bar-to-bar changes; the first bar of a session has no change."""
    return {
        "_gain": "CASE WHEN close > _c1 THEN close - _c1 ELSE 0D END",
        "_loss": "CASE WHEN close < _c1 THEN _c1 - close ELSE 0D END",
        "_absd": "abs(close - _c1)",
        "_ret": "CASE WHEN _c1 <> 0 THEN (close - _c1) / _c1 END",
        # greatest skips the missing previous close of the first bar
        "_tr": "greatest(_hl, abs(high - _c1), abs(low - _c1))",
    }


def change_windows(fr: FrameText) -> Level:
    """Windows over the changes: decayed averages and change statistics."""
    return {
        **ema_sums(fr, AVERAGES, "_n"),
        "_trs30": f"collect_list(_tr) {fr.past(30)}",
        "_tr_first30": f"first(_tr) {fr.past(30)}",
        "_hl_first30": f"first(_hl) {fr.past(30)}",
        "_early_trs": f"collect_list(CASE WHEN _n < 41 THEN _tr END) {fr.past(41)}",
        "_ret_sd10": f"stddev_samp(_ret) {fr.past(10)}",
        "_ret_sd_prior20": f"stddev_samp(_ret) {fr.rows(-30, -11)}",
        "_impacts": f"collect_list(CASE WHEN volume >= 100 AND _absd > 0 THEN _absd / volume END) {fr.past(4)}",
        "_path9": f"sum(_absd) {fr.past(9)}",
        # not corr(): it divides by the deviations, which a flat frame makes zero
        "_trend_cov10": f"covar_pop(CAST(_n AS DOUBLE), close) {fr.past(10)}",
        "_close_var10": f"var_pop(close) {fr.past(10)}",
        "_levels_above": f"concat(collect_list(_top10) {fr.rows(-45, -5)}, collect_list(_top20) {fr.rows(-40, -10)})",
        "_levels_below": (
            f"concat(collect_list(_bottom10) {fr.rows(-45, -5)}, collect_list(_bottom20) {fr.rows(-40, -10)})"
        ),
        "_turns": (
            "collect_list(CASE WHEN _turn <> 0 THEN named_struct('pos', _n, 'price', _hl2, 'kind', _turn) END) "
            + fr.rows(-28, -3)
        ),
    }


# recursive averages: name, input column, weight of the newest value
AVERAGES = {
    "_ema12": ("close", span_alpha(12)), "_ema26": ("close", span_alpha(26)), "_gain1": ("_gain", WILDER),
    "_loss1": ("_loss", WILDER), "_tr_ema1": ("_tr", span_alpha(14)),
}
SIGNAL = {"_signal1": ("_ema12 - _ema26", span_alpha(9))}


def ema_sums(fr: FrameText, averages: dict[str, tuple[str, float]], k: str) -> Level:
    out: Level = {}
    for name, (x, alpha) in averages.items():
        out[f"{name}_in"], out[f"{name}_old"] = fr.ema_sums(f"({x})", k, alpha)
    return out


def averages_now(fr: FrameText) -> Level:
    """The averages up to and including the bar, and the decayed sum of the 30 true ranges before it."""
    decayed = f"aggregate(_trs30, 0D, (e, x) -> e * {1 - WILDER!r}D + {WILDER!r}D * x)"
    return {f"{name}_now": fr.ema_of(name, "_n", alpha) for name, (_, alpha) in AVERAGES.items()} | {"_tr_decayed30": decayed}


def averages_before(fr: FrameText) -> Level:
    """The averages as they stood one bar earlier, which describe the bar before the current one."""
    return {name: fr.lag(f"{name}_now") for name in AVERAGES}


def signal_windows(fr: FrameText) -> Level:
    """Windows over the averages."""
    return {
        # the line has its first value on the second bar, so its positions count from there
        **ema_sums(fr, SIGNAL, "(_n - 1)"),
        "_tr_emas100": f"collect_list(_tr_ema1) {fr.rows(-99, 0)}",
    }


def signal_line(fr: FrameText) -> Level:
    return {name: fr.ema_of(name, "(_n - 1)", alpha) for name, (_, alpha) in SIGNAL.items()}


def series_levels(fr: FrameText, columns, session_bars: int = SESSION_BARS) -> list[Level]:
    return [
        row_values(fr, columns), fr.rank_digits("_n", session_bars), fr.rank_sums("_volume", "volume IS NOT NULL", session_bars),
        bar_windows(fr, columns), single_bars(fr, session_bars), changes(), change_windows(fr), averages_now(fr),
        averages_before(fr), signal_windows(fr), signal_line(fr),
    ]
