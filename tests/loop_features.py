"""Features of one bar by plain loops over the earlier bars: a slow restatement to check against."""

from __future__ import annotations

import math

import numpy as np


def clip(x, lo, hi):
    return max(lo, min(hi, x))


def smooth(xs, alpha):
    out = [xs[0]]
    for x in xs[1:]:
        out.append(out[-1] + alpha * (x - out[-1]))
    return out


def ranges(h, low, c):
    return [h[0] - low[0]] + [max(h[i] - low[i], abs(h[i] - c[i - 1]), abs(low[i] - c[i - 1])) for i in range(1, len(c))]


def turning(x, order):
    n, found = len(x), []
    for i in range(1, n - 1):
        around = [x[j] for j in range(max(0, i - order), min(n, i + order + 1)) if j != i]
        if all(x[i] > v for v in around):
            found.append((i, x[i], 1))
        elif all(x[i] < v for v in around):
            found.append((i, x[i], -1))
    return found


def features(past: list[dict], now: dict, day_open=None, daily_mean=None) -> dict:
    n = len(past)
    p = now["close"]
    c, h, low, v = ([b[k] for b in past] for k in ("close", "high", "low", "volume"))
    out: dict = {}

    def spread(b):
        return (b["ask_px"] - b["bid_px"]) / ((b["ask_px"] + b["bid_px"]) / 2) * 100

    quoted = now["bid_px"] is not None
    cur = spread(now) if quoted and now["ask_px"] > now["bid_px"] else None
    out["Bid_Ask_Spread_Pct"] = cur
    total = now["bid_sz"] + now["ask_sz"]
    out["Order_Book_Imbalance"] = (now["bid_sz"] - now["ask_sz"]) / total if total else None

    mids = [(b["bid_px"] + b["ask_px"]) / 2 for b in past[-5:] if b["bid_px"] is not None]
    out["Mid_Price_Momentum"] = clip((mids[-1] - mids[0]) / mids[0] * 100, -2, 2) if n >= 5 and len(mids) == 5 else None

    sp = [spread(b) for b in past[-20:] if b["bid_px"] is not None]
    good = [x for x in sp if x > 0]
    if n < 20 or len(sp) < 5 or not good:
        out["Spread_Percentile_20"] = 0.5
    else:
        out["Spread_Percentile_20"] = 0.0 if cur is None else sum(x <= cur for x in good) / len(good)

    if n >= 2:
        if v[-2] <= 0:
            out["Volume_Rate_of_Change"] = 500.0 if v[-1] > 0 else None
        else:
            out["Volume_Rate_of_Change"] = clip((v[-1] - v[-2]) / v[-2] * 100, -95, 500)
    else:
        out["Volume_Rate_of_Change"] = None

    moves = [(abs(c[i] - c[i - 1]), v[i]) for i in range(max(n - 4, 1), n)]
    kept = [d / (w * p) * 1000 / p * 10000 for d, w in moves if w >= 100 and d > 0]
    out["Price_Impact_Normalized"] = clip(float(np.median(kept)), 0, 5) if n >= 3 and len(kept) >= 2 else 0.0

    before = v[-10:-1]
    out["Volume_vs_SMA10"] = clip(v[-1] / np.mean(before), 0, 50) if n >= 2 and np.mean(before) > 0 else 1.0

    value = sum((h[i] + low[i] + c[i]) / 3 * v[i] for i in range(n) if v[i] > 0)
    shares = sum(x for x in v if x > 0)
    out["Normalized_Price_VWAP"] = clip(p / (value / shares), 0.5, 2) if shares > 0 else 1.0

    if n >= 35:
        line = np.array(smooth(c, 2 / 13)) - np.array(smooth(c, 2 / 27))
        out["MACD_12_26_9"] = clip((line[-1] - smooth(list(line), 0.2)[-1]) / p * 100, -2, 2)
    else:
        out["MACD_12_26_9"] = 0.0

    if n >= 15:
        d = [0.0] + [c[i] - c[i - 1] for i in range(1, n)]
        g = smooth([max(x, 0.0) for x in d], 1 / 14)[-1]
        lo = smooth([max(-x, 0.0) for x in d], 1 / 14)[-1]
        out["RSI_14"] = 100.0 if lo == 0 else 100 - 100 / (1 + g / lo)
    else:
        out["RSI_14"] = 50.0

    sd = float(np.std(c[-20:], ddof=1)) if n >= 20 else 0.0
    out["Bollinger_Band_Width"] = 4 * sd / np.mean(c[-20:]) if n >= 20 and sd > 1e-12 else 0.0
    out["Return_5min"] = clip((p - c[-6]) / c[-6] * 100, -5, 5) if n >= 6 else 0.0
    if n >= 50:
        out["Price_vs_SMA50"] = (p - np.mean(c[-50:])) / np.mean(c[-50:]) * 100
    else:
        out["Price_vs_SMA50"] = (p - daily_mean) / daily_mean * 100 if daily_mean else 0.0
    out["Return_Since_Open"] = clip((p - day_open) / day_open * 100, -20, 20) if day_open else 0.0

    if n >= 15:
        tr = ranges(h[-30:], low[-30:], c[-30:])
        out["ATR_Pct"] = smooth(tr, 1 / 14)[-1] / p * 100
    else:
        out["ATR_Pct"] = 0.0

    r = [(c[i] - c[i - 1]) / c[i - 1] for i in range(1, n)]
    out["Volatility_Regime_Shift_Norm"] = 0.0
    if len(r) >= 30 and np.std(r[-30:-10], ddof=1) > 0:
        q = np.std(r[-10:], ddof=1) / np.std(r[-30:-10], ddof=1)
        out["Volatility_Regime_Shift_Norm"] = math.tanh((q - 1) / 2) if q > 1 else -math.tanh((1 - q) / 2)

    out["Volatility_Percentile_100"] = 50.0
    if n >= 20:
        e = smooth(ranges(h, low, c), 2 / (min(14, n // 3) + 1))[-100:]
        if max(e) - min(e) > max(e) * 1e-12:
            out["Volatility_Percentile_100"] = sum(x <= e[-1] * (1 + 1e-12) for x in e) / len(e) * 100

    out["Position_In_Day_Range"] = (
        clip((p - min(low)) / (max(h) - min(low)), 0, 1) if n >= 1 and max(h) > min(low) else 0.5
    )

    out["Support_Resistance_Proximity"] = 5.0
    if n >= 20:
        hs, ls = h[-50:], low[-50:]
        k, up, down = len(hs), set(), set()
        for before_, after in ((5, 4), (10, 9)):
            for i in range(before_, k - after):
                if hs[i] == max(hs[i - before_:i + after + 1]):
                    up.add(hs[i])
                if ls[i] == min(ls[i - before_:i + after + 1]):
                    down.add(ls[i])
        span = max(hs) - min(ls)
        if span > 0:
            up |= {x for x in hs if x >= max(hs) - span * 0.1}
            down |= {x for x in ls if x <= min(ls) + span * 0.1}
        above = [x for x in up if x > p and x - p >= p * 0.001]
        below = [x for x in down if x < p and p - x >= p * 0.001]
        dist = [(min(above) - p) / p * 100] if above else []
        dist += [(p - max(below)) / p * 100] if below else []
        if dist:
            out["Support_Resistance_Proximity"] = max(min(dist), 0.1)

    out["Breakout_Confirmation"] = 0.0
    if n >= 20:
        top, avg = max(h[-20:-1]), np.mean(v[-20:-1])
        if p > top and avg > 0 and v[-1] > 1.5 * avg:
            out["Breakout_Confirmation"] = clip((p - top) / top * 100 + 0.1 * (v[-1] / avg - 1), 0, 1)

    out["Price_Acceleration"] = clip((c[-1] - 2 * c[-2] + c[-3]) / p * 100, -10, 10) if n >= 3 else 0.0
    out["Max_Drawdown_30"] = 0.0
    if n >= 5:
        last = c[-30:]
        out["Max_Drawdown_30"] = min(0.0, min((x - max(last[:i + 1])) / max(last[:i + 1]) * 100 for i, x in enumerate(last)))
    out["Volume_Percentile_Intraday"] = (sum(x <= now["volume"] for x in v) + 1) / (n + 1) if n else 0.5
    sdv = np.std(v, ddof=1) if n > 2 else 0
    out["Volume_Zscore_Intraday"] = (now["volume"] - np.mean(v)) / sdv if sdv > 0 else 0.0

    out["Momentum_Acceleration"], out["Momentum_Consistency"] = 0.0, 0.5
    if n >= 6:
        out["Momentum_Acceleration"] = (c[-1] - c[-3]) / c[-3] - (c[-3] - c[-6]) / c[-6]
        s = [np.sign(c[-i] - c[-i - 1]) for i in range(1, 6)]
        s = [x for x in s if x]
        if s:
            out["Momentum_Consistency"] = sum(x == (1 if c[-1] > c[-6] else -1) for x in s) / len(s)

    imb = [
        (b["bid_sz"] - b["ask_sz"]) / (b["bid_sz"] + b["ask_sz"]) for b in past[-10:] if b["bid_sz"] + b["ask_sz"] > 0
    ]
    out["Order_Book_Stability"] = 0.5
    if n >= 3 and len(imb) >= 2 and np.mean(np.abs(imb)) > 0.01:
        out["Order_Book_Stability"] = clip(1 - np.std(imb) / np.mean(np.abs(imb)), 0, 1)

    out["Price_Action_Quality"] = 0.5
    if n >= 10:
        last = c[-10:]
        fit = np.corrcoef(range(10), last)[0, 1] ** 2 if np.std(last) > 0 else 0.0
        path = sum(abs(last[i] - last[i - 1]) for i in range(1, 10))
        out["Price_Action_Quality"] = (fit + (abs(last[-1] - last[0]) / path if path else 0.0)) / 2

    out.update({"Impulse_Vector_Magnitude": 0.0, "Impulse_Vector_Direction": 0, "Impulse_Vector_Duration": 0})
    if n >= 30:
        pts = turning([(a + b) / 2 for a, b in zip(h[-30:], low[-30:], strict=True)], 2)
        for i in range(len(pts) - 1, 0, -1):
            (i1, x1, k1), (i2, x2, k2) = pts[i - 1], pts[i]
            if k1 != k2:
                out["Impulse_Vector_Magnitude"] = round(abs(x2 - x1) / x1, 6)
                out["Impulse_Vector_Direction"] = 1 if x2 > x1 else -1
                out["Impulse_Vector_Duration"] = i2 - i1
                break
    return out
