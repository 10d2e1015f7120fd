"""Swing lows, screening, barrier labels and bracket exits over the event bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.catalog import register
from barloom.catalog.features import R_LEVELS, features, rounded
from barloom.catalog.sql_parts import BARS, SERIES, level, over_series, r6, to6
from barloom.operators import exits, labels, reports, swings
from barloom.sources import driver_tables as D

GAP = 3000  # minutes between candidates, for half-hour bars
TOLERANCE = 1.0
HORIZON, OUTER = 1200, 7200  # 40 and 240 bars
BUDGET = 10_000.0
LEVEL_COLUMNS = [
    "Current_Price", "1R_Stop_Loss", "ATR_Distance", "1R_Target", "2R_Target", "3R_Target", "4R_Target",
]


def _keys(df: DataFrame, *more) -> DataFrame:
    return df.select("symbol", F.unix_seconds("ts").alias("ts_s"), *more)


def _extrema_sql(order: str, price: str = "close") -> dict[str, str]:
    part = "PARTITION BY symbol, session ORDER BY ts ROWS BETWEEN"
    before, after = f"({part} {order} PRECEDING AND 1 PRECEDING)", f"({part} 1 FOLLOWING AND {order} FOLLOWING)"
    return {
        "is_low": f"coalesce({price} < min({price}) OVER {before} AND {price} < min({price}) OVER {after}, FALSE)",
        "is_high": f"coalesce({price} > max({price}) OVER {before} AND {price} > max({price}) OVER {after}, FALSE)",
    }


@register("local_extrema", over_series([_extrema_sql("4")], {"is_low": "is_low", "is_high": "is_high"}))
def local_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(swings.local_extrema(D.event_bars(spark, sf_dir)), "is_low", "is_high")


@register(
    "running_vwap",
    over_series([{"vwap": "sum((high + low + close) / 3 * volume) OVER upto / sum(volume) OVER upto"}],
                {"vwap": r6("vwap")}),
)
def running_vwap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(swings.with_running_vwap(D.event_bars(spark, sf_dir)), ["vwap"])


# Earlier lows and highs are looked up per low among all extrema of the session.
_VWAP = level("v", "s", {"vwap": "sum((high + low + close) / 3 * volume) OVER upto / sum(volume) OVER upto"})
_STRICT = f"""{BARS}, {SERIES}, {_VWAP}, {level('ext', 'v', _extrema_sql('4'))},
strict0 AS (
  SELECT e.*,
    (SELECT arg_max(x.close, x.ts) FROM ext x WHERE x.symbol = e.symbol AND x.session = e.session
       AND x.ts < e.ts AND x.is_low) AS prev_low,
    (SELECT arg_max(x.close, x.ts, 2) FROM ext x WHERE x.symbol = e.symbol AND x.session = e.session
       AND x.ts < e.ts AND x.is_high) AS highs
  FROM ext e WHERE e.is_low),
strict1 AS (SELECT * FROM strict0 WHERE close > prev_low AND len(highs) = 2 AND highs[1] > highs[2]),
strict2 AS (SELECT *, lag(ts) OVER (PARTITION BY symbol, session ORDER BY ts) AS before_ts FROM strict1),
strict_lows AS (SELECT symbol, ts, close FROM strict2
  WHERE (before_ts IS NULL OR ts - before_ts <= INTERVAL {GAP} MINUTES) AND abs(close - vwap) < {TOLERANCE})"""

_RANGES = [
    {"r": "CASE WHEN count(close) OVER l20 = 20 THEN max(close) OVER l20 - min(close) OVER l20 END"},
    {"a": "CASE WHEN count(r) OVER l20 = 20 THEN avg(r) OVER l20 END",
     "b": "CASE WHEN count(r) OVER l100 = 100 THEN avg(r) OVER l100 END"},
]
_LAST = (
    "WINDOW l20 AS (PARTITION BY symbol, session ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), "
    "l100 AS (PARTITION BY symbol, session ORDER BY ts ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"
)


def _range_level(name: str, source: str, cols: dict[str, str]) -> str:
    return f"{name} AS (SELECT *, {', '.join(f'{e} AS {a}' for a, e in cols.items())} FROM {source} {_LAST})"


_ADAPTIVE = f"""{_range_level('g0', 's', _RANGES[0])}, {_range_level('g1', 'g0', _RANGES[1])},
g2 AS (SELECT symbol, session, coalesce(arg_max_null(a, ts), 0) AS a, coalesce(arg_max_null(b, ts), 1) AS b
       FROM g1 GROUP BY ALL),
g3 AS (SELECT symbol, session, CASE WHEN b = 0 THEN 4 WHEN a / b > 1.5 THEN 6 WHEN a / b < 0.7 THEN 3 ELSE 4 END AS ord
       FROM g2),
av AS (SELECT v.*, g3.ord FROM v JOIN g3 USING (symbol, session)),
al AS (SELECT *, row_number() OVER (PARTITION BY symbol, session ORDER BY ts) AS i FROM av),
low3 AS (SELECT *, {_extrema_sql('3')['is_low']} AS low3, {_extrema_sql('4')['is_low']} AS low4,
         {_extrema_sql('6')['is_low']} AS low6 FROM al),
lows AS (SELECT * FROM low3 WHERE CASE ord WHEN 3 THEN low3 WHEN 4 THEN low4 ELSE low6 END),
ad0 AS (SELECT *, lag(close, 1) OVER q AS p1, lag(close, 2) OVER q AS p2 FROM lows
        WINDOW q AS (PARTITION BY symbol, session ORDER BY ts)),
ad1 AS (SELECT *, lag(ts) OVER (PARTITION BY symbol, session ORDER BY ts) AS before_ts FROM ad0
        WHERE close > p1 AND close > p2),
adaptive_lows AS (SELECT symbol, ts, close FROM ad1
  WHERE (before_ts IS NULL OR ts - before_ts <= INTERVAL {GAP} MINUTES) AND abs(close - vwap) < {TOLERANCE})"""
_OUT = "SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts_s, round(close, 6) AS close FROM"


def _low_query(flag: str, fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars = swings.with_running_vwap(D.event_bars(spark, sf_dir))
        df = fn(bars, max_gap_minutes=GAP, vwap_tolerance=TOLERANCE).filter(flag)
        return rounded(df, ["close"])

    return run


register("strict_swing_lows", f"WITH {_STRICT} {_OUT} strict_lows")(_low_query("is_strict_low", swings.flag_strict_lows))
register("adaptive_swing_lows", f"WITH {BARS}, {SERIES}, {_VWAP}, {_ADAPTIVE} {_OUT} adaptive_lows")(
    _low_query("is_adaptive_low", swings.flag_adaptive_lows)
)

CANDIDATES_SQL = f"""{_STRICT}, {_ADAPTIVE}, candidates AS (
  SELECT symbol, ts, string_agg(DISTINCT m, '+' ORDER BY m) AS methods, max(close) AS close FROM (
    SELECT *, 'strict' AS m FROM strict_lows UNION ALL SELECT *, 'adaptive' AS m FROM adaptive_lows) GROUP BY 1, 2)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swings.swing_candidates(D.event_bars(spark, sf_dir), max_gap_minutes=GAP, vwap_tolerance=TOLERANCE)


@register(
    "swing_candidates",
    f"WITH {CANDIDATES_SQL} SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts_s, methods, round(close, 6) AS close FROM candidates",
)
def swing_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(candidates(spark, sf_dir).withColumnRenamed("minute", "ts"), ["methods", "close"])


_OPEN_HOURS = "FROM raw_bars WHERE strftime(bar_ts - INTERVAL 5 HOURS, '%H:%M:%S') BETWEEN '09:30:00' AND '15:30:00')"


@register(
    "swing_candidates_market_hours",
    f"WITH {CANDIDATES_SQL.replace('FROM raw_bars)', _OPEN_HOURS)} SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts_s, methods, "
    "round(close, 6) AS close FROM candidates",
)
def swing_candidates_market_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swings among the bars of market hours; the events lie in January, five hours behind."""
    found = swings.swing_candidates(D.event_bars(spark, sf_dir), max_gap_minutes=GAP, vwap_tolerance=TOLERANCE, market_hours=True)
    return rounded(found.withColumnRenamed("minute", "ts"), ["methods", "close"])


@register(
    "union_minutes",
    f"WITH {_STRICT}, {_ADAPTIVE} SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts_s FROM strict_lows "
    "UNION SELECT symbol, CAST(epoch(ts) AS BIGINT) FROM adaptive_lows",
)
def union_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = swings.with_running_vwap(D.event_bars(spark, sf_dir))
    args = {"max_gap_minutes": GAP, "vwap_tolerance": TOLERANCE}
    minute = F.date_trunc("minute", "ts").alias("minute")
    a = swings.flag_strict_lows(bars, **args).filter("is_strict_low").select("symbol", minute)
    b = swings.flag_adaptive_lows(bars, **args).filter("is_adaptive_low").select("symbol", minute)
    return swings.union_minutes(a, b).select("symbol", F.unix_seconds("minute").alias("ts_s"))


@register(
    "nearest_minute",
    f"""WITH {CANDIDATES_SQL}, m AS (SELECT DISTINCT symbol, CAST(floor(epoch(ts) / 60) * 60 AS BIGINT) AS m FROM ticks),
c AS (SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts_s FROM candidates)
SELECT c.symbol, c.ts_s, arg_min(m.m, abs(m.m - c.ts_s) * 100000000000 + m.m) AS minute_s,
       min(abs(m.m - c.ts_s)) AS gap_seconds
FROM c JOIN m ON m.symbol = c.symbol AND abs(m.m - c.ts_s) <= 900 GROUP BY 1, 2""",
)
def nearest_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = candidates(spark, sf_dir).select("symbol", F.col("minute").alias("ts"))
    minutes = reports.distinct_minutes(D.event_ticks(spark, sf_dir))
    near = swings.nearest_minute(points, minutes, 900)
    return _keys(near, F.unix_seconds("minute").alias("minute_s"), "gap_seconds")


# --- screening and labels -----------------------------------------------------------------------

LEVELS_SQL = {
    "cur": "CASE WHEN atr_pct > 0 THEN round_even(close, 2) END",
    "stop": "CASE WHEN atr_pct > 0 THEN round_even(close - atr, 2) END",
    "dist": "CASE WHEN atr_pct > 0 THEN round_even(atr, 3) END",
    "r1": "CASE WHEN atr_pct > 0 THEN round_even(close + reward, 2) END",
    "r2": "CASE WHEN atr_pct > 0 THEN round_even(close + 2 * reward, 2) END",
    "r3": "CASE WHEN atr_pct > 0 THEN round_even(close + 3 * reward, 2) END",
    "r4": "CASE WHEN atr_pct > 0 THEN round_even(close + 4 * reward, 2) END",
}
SCREEN_SQL = (
    "CASE WHEN cur IS NULL OR cur <= 0 THEN 'missing_or_invalid_current_price' "
    "WHEN stop IS NULL OR stop <= 0 THEN 'missing_or_invalid_1r_stop_loss' "
    "WHEN r1 IS NULL OR r1 <= 0 THEN 'missing_or_invalid_1r_target' "
    "WHEN r2 IS NULL OR r2 <= 0 THEN 'missing_or_invalid_2r_target' "
    "WHEN dist IS NULL OR dist <= 0 THEN 'missing_or_invalid_atr_distance' "
    "WHEN bid_px > 0 AND ask_px > 0 AND (ask_px - bid_px) / cur * 100 > 0.5 THEN 'spread_too_wide' "
    "ELSE 'conditions_met' END"
)


def level_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir, LEVEL_COLUMNS)


@register(
    "screen",
    over_series([*R_LEVELS, LEVELS_SQL], {"screen_pass": f"({SCREEN_SQL}) = 'conditions_met'", "screen_reason": SCREEN_SQL}),
)
def screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(labels.screen(level_rows(spark, sf_dir)), "screen_pass", "screen_reason")


@register(
    "default_targets",
    over_series(
        [*R_LEVELS, LEVELS_SQL],
        {"target_3r": r6("r2 + (r2 - r1)"), "target_4r": r6("CASE WHEN n % 2 = 0 THEN r4 ELSE r2 + 2 * (r2 - r1) END")},
        where="atr_pct > 0",
    ),
)
def default_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third targets are missing everywhere and fourth targets on every other bar; both continue the step before."""
    rows = features(spark, sf_dir, [*LEVEL_COLUMNS, "n_hist"]).filter(F.col("2R_Target").isNotNull()).drop("3R_Target")
    rows = labels.with_default_targets(rows.withColumn("4R_Target", F.when(F.col("n_hist") % 2 == 0, F.col("4R_Target"))))
    return _keys(rows, to6("3R_Target").alias("target_3r"), to6("4R_Target").alias("target_4r"))


def _label_sql() -> str:
    ctes = [BARS, SERIES]
    source = "s"
    for i, columns in enumerate([*R_LEVELS, LEVELS_SQL, {"why": SCREEN_SQL}]):
        ctes.append(level(f"s{i}", source, columns))
        source = f"s{i}"
    ctes.append(f"""ahead AS (
  SELECT e.symbol, e.ts, any_value(e.why) AS why, count(b.ts) AS later,
    count(b.ts) FILTER (b.ts <= e.ts + INTERVAL {OUTER} MINUTES) AS outer_rows,
    min(b.ts) FILTER (near AND b.close <= e.stop) AS t0, min(b.ts) FILTER (near AND b.close >= e.r2) AS t2,
    min(b.ts) FILTER (near AND b.close >= e.r3) AS t3, min(b.ts) FILTER (near AND b.close >= e.r4) AS t4
  FROM {source} e LEFT JOIN (SELECT symbol, session, ts, close FROM bars) b
    ON b.symbol = e.symbol AND b.session = e.session AND b.ts > e.ts,
    LATERAL (SELECT b.ts <= e.ts + INTERVAL {HORIZON} MINUTES AS near)
  GROUP BY 1, 2)""")
    ctes.append("""lab AS (SELECT *, CASE WHEN why <> 'conditions_met' THEN why WHEN later = 0 THEN 'no_future_data'
  WHEN outer_rows = 0 THEN 'no_data_in_time_window' WHEN t0 IS NOT NULL AND (t2 IS NULL OR t0 <= t2) THEN 'reached_negative_1r'
  WHEN t2 IS NULL THEN 'timeout_no_2r' WHEN t3 IS NULL THEN 'reached_2r_success' WHEN t4 = t3 THEN 'reached_4r_success'
  ELSE 'reached_3r_success' END AS reason FROM ahead)""")
    ctes.append("""lab2 AS (SELECT symbol, ts, reason, CASE reason WHEN 'reached_2r_success' THEN 2 WHEN 'reached_3r_success' THEN 3
  WHEN 'reached_4r_success' THEN 4 ELSE 0 END AS r, t2, t3 FROM lab)""")
    ctes.append("""labelled AS (SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts_s, r >= 2 AS buy, CAST(r AS INTEGER) AS "R",
  CAST(CASE WHEN r = 2 THEN epoch(t2 - ts) / 60 WHEN r > 2 THEN epoch(t3 - ts) / 60 ELSE 0 END AS INTEGER) AS time_minutes,
  reason FROM lab2)""")
    return "WITH " + ", ".join(ctes)


LABELLED = _label_sql()
LABEL_COLUMNS = ["buy", "R", "time_minutes", "reason"]


def labelled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_own_series(level_rows(spark, sf_dir), "close", HORIZON, OUTER)


@register("label_barriers", f"{LABELLED} SELECT * FROM labelled")
def label_barriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = D.event_bars(spark, sf_dir)
    done = labels.label_barriers(level_rows(spark, sf_dir), bars, HORIZON, OUTER)
    return _keys(done, *LABEL_COLUMNS)


@register("label_own_series", f"{LABELLED} SELECT * FROM labelled")
def label_own_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(labelled_rows(spark, sf_dir), *LABEL_COLUMNS)


@register(
    "label_distribution",
    f"""{LABELLED} SELECT "R", count(*) AS rows, count(*) / (SELECT count(*) FROM labelled) AS share_of_rows,
  CASE WHEN "R" > 0 THEN count(*) / (SELECT count(*) FROM labelled WHERE "R" > 0) END AS share_of_signals,
  avg(time_minutes) AS mean_minutes, CAST(median(time_minutes) AS DOUBLE) AS median_minutes
FROM labelled GROUP BY 1""",
)
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.label_distribution(labelled_rows(spark, sf_dir))


# --- exits --------------------------------------------------------------------------------------

_ENTRY_SQL = f"""{BARS}, {SERIES}, {", ".join(
    level(f"s{i}", "s" if i == 0 else f"s{i - 1}", c) for i, c in enumerate([*R_LEVELS, LEVELS_SQL, {"why": SCREEN_SQL}])
)}, entries AS (
  SELECT symbol, ts, close AS price, stop, r2, close * 1.001 AS buy FROM s{len(R_LEVELS) + 1} WHERE why = 'conditions_met'),
held AS (SELECT *, CAST(floor({BUDGET} / buy) AS BIGINT) AS qty FROM entries),
look AS (
  SELECT h.symbol, h.ts, b.ts AS bts, b.close,
    CASE WHEN b.close <= h.stop THEN 'STOP_LOSS' WHEN b.close >= h.r2 THEN 'TAKE_PROFIT'
         WHEN isodow(b.ts - INTERVAL 5 HOURS) < 6 AND strftime(b.ts - INTERVAL 5 HOURS, '%H:%M:%S') >= '15:45:00'
         THEN 'MARKET_CLOSE' END AS why
  FROM held h JOIN bars b ON b.symbol = h.symbol AND b.ts >= h.ts),
hit AS (SELECT symbol, ts, min(bts) AS bts, arg_min(close, bts) AS px, arg_min(why, bts) AS why
        FROM look WHERE why IS NOT NULL GROUP BY 1, 2),
trades AS (
  SELECT h.symbol, h.ts, h.qty AS quantity, h.qty * h.buy + 1 AS total_cost, hit.why AS exit_reason, hit.bts,
    h.qty * (hit.px * 0.999) - 1 AS total_proceeds,
    CASE WHEN hit.bts IS NULL THEN 1.0 ELSE 2.0 END AS commission_paid,
    CASE WHEN hit.bts IS NULL THEN 'OPEN' ELSE 'CLOSED' END AS status,
    h.qty * (hit.px * 0.999) - 1 - (h.qty * h.buy + 1) AS net_pnl,
    epoch(hit.bts - h.ts) / 60 AS minutes
  FROM held h LEFT JOIN hit USING (symbol, ts) WHERE h.qty > 0)"""


def entry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels.screen(level_rows(spark, sf_dir)).filter("screen_pass")
    return rows.select(
        F.concat_ws("|", "symbol", F.unix_seconds("ts").cast("string")).alias("entry_id"), "symbol", "ts",
        F.col("close").alias("current_price"), F.lit(BUDGET).alias("budget"),
        F.col("1R_Stop_Loss").alias("stop_loss_price"), F.col("2R_Target").alias("take_profit_price"),
    )


def trade_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exits.bracket_exits(entry_rows(spark, sf_dir), D.event_bars(spark, sf_dir))


@register(
    "bracket_exits",
    f"""WITH {_ENTRY_SQL} SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts_s, quantity, exit_reason, status,
  CAST(epoch(bts) AS BIGINT) AS exit_s, {r6('total_cost')} AS total_cost, {r6('total_proceeds')} AS total_proceeds,
  {r6('net_pnl')} AS net_pnl, {r6('commission_paid')} AS commission_paid, {r6('minutes')} AS minutes FROM trades""",
)
def bracket_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trade_rows(spark, sf_dir).withColumn("minutes", F.col("buy_sell_duration_minutes"))
    names = ["total_cost", "total_proceeds", "net_pnl", "commission_paid", "minutes"]
    return _keys(
        t, "quantity", "exit_reason", "status", F.unix_seconds("exit_ts").alias("exit_s"),
        *[to6(n).alias(n) for n in names],
    )


@register(
    "trade_summary",
    f"""WITH {_ENTRY_SQL} SELECT symbol, count(*) AS total_trades,
  count(*) FILTER (status = 'OPEN') AS open_positions, count(*) FILTER (status = 'CLOSED') AS closed_positions,
  {r6("coalesce(sum(net_pnl) FILTER (status = 'CLOSED'), 0)")} AS total_pnl,
  count(*) FILTER (net_pnl > 0) AS winning_trades, count(*) FILTER (net_pnl < 0) AS losing_trades,
  {r6("coalesce(avg(minutes), 0)")} AS avg_duration_minutes, {r6("sum(commission_paid)")} AS total_commissions,
  {r6("coalesce(count(*) FILTER (net_pnl > 0) * 100.0 / nullif(count(*) FILTER (status = 'CLOSED'), 0), 0)")} AS win_rate
FROM trades GROUP BY 1""",
)
def trade_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reports.trade_summary(trade_rows(spark, sf_dir), ["symbol"])
    doubles = ["total_pnl", "avg_duration_minutes", "total_commissions", "win_rate"]
    return s.withColumns({c: to6(c) for c in doubles})


@register(
    "one_position_at_a_time",
    f"""WITH RECURSIVE {_ENTRY_SQL}, t AS (SELECT symbol, ts, exit_reason, net_pnl,
  coalesce(bts, TIMESTAMP '9999-01-01') AS until FROM trades),
kept AS (
  SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM t x WHERE x.symbol = t.symbol AND x.ts < t.ts)
  UNION ALL
  SELECT n.* FROM kept k JOIN t n ON n.symbol = k.symbol AND n.ts = (
    SELECT min(x.ts) FROM t x WHERE x.symbol = k.symbol AND x.ts >= k.until AND x.ts > k.ts))
SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts_s, exit_reason, {r6('net_pnl')} AS net_pnl FROM kept""",
)
def one_position_at_a_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry rule: at most one open position per symbol."""
    kept = exits.one_position_at_a_time(trade_rows(spark, sf_dir))
    return _keys(kept, "exit_reason", to6("net_pnl").alias("net_pnl"))


@register(
    "positions_newest_first",
    f"""WITH {_ENTRY_SQL} SELECT symbol || '|' || CAST(CAST(epoch(ts) AS BIGINT) AS VARCHAR) AS position_id, status,
  CAST(epoch(ts) AS BIGINT) + 2 AS buy_s FROM trades ORDER BY buy_s DESC, position_id""",
)
def positions_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trade_rows(spark, sf_dir).withColumnRenamed("entry_id", "position_id")
    return reports.newest_positions(t).select("position_id", "status", F.unix_seconds("buy_timestamp").alias("buy_s"))
