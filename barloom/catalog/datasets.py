"""Cleaning, bounding, preparing and sampling of feature tables.

Order lines stand in for a raw feature table: their columns are scaled into the ranges of the features.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.catalog import register, stated
from barloom.catalog.sql_parts import r6, to6
from barloom.operators import clean, evaluate, neighbours, prepare
from barloom.operators import patterns as P
from barloom.operators.order_stats import exact_medians
from barloom.sources import driver_tables as D

# name of the stand-in feature -> expression over lineitem (the same text in both engines)
RAW = {
    "RSI_14": "l_quantity * 5.0 - 20.0",
    "MACD_12_26_9": "(l_tax - 0.04) * 300.0",
    "Return_5min": "(l_discount - 0.05) * 500.0",
    "Return_Since_Open_Enhanced": "(l_discount - 0.05) * 900.0",
    "Price_vs_SMA50": "l_quantity * 4.0 - 100.0",
    "Volume_vs_SMA10": "l_quantity * 5.0 - 25.0",
    "Mid_Price_Momentum": "(l_tax - 0.04) * 600.0",
    "Momentum_Acceleration": "(l_tax - 0.04) * 400.0",
    "Max_Drawdown_30": "20.0 - l_quantity * 5.0",
    "Support_Resistance_Proximity": "l_quantity - 5.0",
    "Volume_Percentile_Intraday": "l_discount * 20.0 - 0.2",
    "Volatility_Percentile_100": "l_quantity * 4.0 - 10.0",
    "Position_In_Day_Range": "l_discount * 15.0",
    "Order_Book_Imbalance": "l_tax * 40.0 - 1.5",
    "RSI_Distance_From_50": "abs(l_quantity * 2.0 - 50.0) / 50.0",
}
_SQL_COLS = ", ".join(f'CAST({e} AS DOUBLE) AS "{n}"' for n, e in RAW.items())
RAW_SQL = f"""raw AS (SELECT l_orderkey, l_linenumber, l_partkey, {_SQL_COLS},
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END AS gap_price, l_extendedprice,
  CASE WHEN l_linenumber > 5 THEN NULL ELSE l_returnflag END AS gap_flag, l_returnflag FROM lineitem)"""
KEYS = ["l_orderkey", "l_partkey", "l_linenumber"]
KEY_SQL = "l_orderkey, l_partkey, l_linenumber"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = D.table(spark, sf_dir, "lineitem")
    return lines.select(
        *KEYS,
        *[F.expr(e).cast("double").alias(n) for n, e in RAW.items()],
        F.expr("CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END").alias("gap_price"),
        "l_extendedprice",
        F.expr("CASE WHEN l_linenumber > 5 THEN NULL ELSE l_returnflag END").alias("gap_flag"),
        "l_returnflag",
    )


def six(df: DataFrame, names, keys=KEYS) -> DataFrame:
    return df.select(*keys, *[to6(n).alias(n) for n in names])


def _bounded(name: str) -> str:
    lo, hi = stated.RANGES[name]
    return (
        f'CASE WHEN "{name}" < {2 * lo} OR "{name}" > {2 * hi} THEN NULL '
        f'ELSE greatest({lo}, least({hi}, "{name}")) END'
    )


_RANGED = [n for n in RAW if n in stated.RANGES]
_PASSED = [n for n in RAW if n not in stated.RANGES]


@register(
    "clean_features",
    f"""WITH {RAW_SQL} SELECT {KEY_SQL}, {", ".join(f'{r6(_bounded(n))} AS "{n}"' for n in _RANGED)},
{", ".join(f'{r6(f'"{n}"')} AS "{n}"' for n in _PASSED)} FROM raw""",
)
def clean_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = raw(spark, sf_dir).select(*KEYS, *RAW)
    return six(clean.clean_features(df), RAW)


_CATS = {
    c: " AND ".join(f"({_bounded(n) if n in stated.RANGES else n}) IS NULL" for n in names if n in RAW)
    for c, names in stated.CATEGORIES.items()
}


@register(
    "category_coverage",
    f"""WITH {RAW_SQL} SELECT {KEY_SQL}, array_to_string(list_filter([{", ".join(
        f"CASE WHEN {cond} THEN '{c}' END" for c, cond in _CATS.items())}], lambda x: x IS NOT NULL), ',') AS missing
FROM raw""",
)
def category_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clean.clean_features(raw(spark, sf_dir).select(*KEYS, *RAW), report=True)
    return df.select(*KEYS, F.array_join("missing_categories", ",").alias("missing"))


def _c(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest({lo}, least({hi}, {x})) END"


def _first_bound(n: str) -> str:
    return _c(f'"{n}"', *stated.OUTLIER_BOUNDS[n]) if n in stated.OUTLIER_BOUNDS else f'"{n}"'


def _scaled(n: str, x: str) -> str:
    if n not in stated.PERCENT_COLUMNS:
        return x
    return f"CASE WHEN ({x}) BETWEEN 0 AND 100 THEN ({x}) / 100.0 ELSE {_c(x, 0, 1)} END"


def _last_bound(n: str, x: str) -> str:
    return _c(x, *stated.FINAL_BOUNDS[n]) if n in stated.FINAL_BOUNDS else x


_PRODUCTS = {
    "Max_Drawdown_Return_Interaction": '"Max_Drawdown_30" * "Return_Since_Open_Enhanced"',
    "Support_Momentum_Interaction": f'"Support_Resistance_Proximity" * ({_first_bound("Mid_Price_Momentum")})',
    "RSI_Momentum_Signal": '("RSI_14" - 50) * "RSI_Distance_From_50"',
}


@register(
    "optimize_base",
    f"""WITH {RAW_SQL} SELECT {KEY_SQL},
{", ".join(f'{r6(_last_bound(n, _scaled(n, _first_bound(n))))} AS "{n}"' for n in RAW)},
{", ".join(f'{r6(e)} AS "{n}"' for n, e in _PRODUCTS.items())} FROM raw""",
)
def optimize_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clean.optimize_base(raw(spark, sf_dir).select(*KEYS, *RAW))
    return six(df, [*RAW, *_PRODUCTS])


_IMPULSE_SQL = """imp AS (SELECT l_orderkey, l_partkey, l_linenumber, CAST(l_discount * 0.2 AS DOUBLE) AS m,
  CASE WHEN l_linenumber % 3 = 0 THEN 0 WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END AS d,
  CAST(l_quantity AS INTEGER) % 32 AS t, CAST(l_tax * 0.1 AS DOUBLE) AS s,
  CAST(l_quantity * 0.1 AS DOUBLE) AS vol, CAST(l_quantity * 2 AS DOUBLE) AS rsi,
  CAST(0.1 + l_tax * 50 AS DOUBLE) AS near, CAST((l_discount - 0.05) * 20 AS DOUBLE) AS mom FROM lineitem),
imp2 AS (SELECT *, CASE WHEN m > 0 AND t > 0 THEN m * d * 100 ELSE 0 END AS st FROM imp)"""
_IMPULSE_OUT = {
    "Impulse_Magnitude": "greatest(0, least(10, m * 100))",
    "Impulse_Slope": "greatest(-5, least(5, s * 1000))",
    "Impulse_Strength": "st",
    "Impulse_Momentum": "CASE WHEN m > 0 AND t > 0 THEN m / sqrt(t) * 100 ELSE 0 END",
    "Impulse_Quality": "CASE WHEN m > 0 AND t >= 3 THEN greatest(0, least(2, m * ln(t))) ELSE 0 END",
    "Impulse_Volume_Confirmation":
        "CASE WHEN abs(st) > 0.1 AND vol > 0 THEN greatest(-10, least(10, st * ln(vol))) ELSE 0 END",
    "Impulse_RSI_Oversold":
        "CASE WHEN abs(st) > 0.1 AND rsi < 30 THEN least(10, abs(st) * (30 - rsi) / 30) "
        "WHEN abs(st) > 0.1 AND rsi > 70 THEN NULL ELSE 0 END",
    "Impulse_RSI_Overbought":
        "CASE WHEN abs(st) > 0.1 AND rsi > 70 THEN least(10, abs(st) * (rsi - 70) / 30) "
        "WHEN abs(st) > 0.1 AND rsi < 30 THEN NULL ELSE 0 END",
    "Impulse_Near_Support_Resistance": "CASE WHEN abs(st) > 0.1 AND near < 2 THEN least(10, abs(st) / near) ELSE 0 END",
    "Impulse_Momentum_Alignment":
        "CASE WHEN abs(st) > 0.1 AND abs(mom) > 0.1 THEN greatest(-10, least(10, abs(st) * abs(mom) * "
        "CASE WHEN d = CASE WHEN mom > 0 THEN 1 ELSE -1 END THEN 1 ELSE -1 END)) ELSE 0 END",
}


@register(
    "impulse_features",
    f"""WITH {_IMPULSE_SQL} SELECT {KEY_SQL}, {", ".join(f'{r6(e)} AS "{n}"' for n, e in _IMPULSE_OUT.items())},
  CAST(d AS INTEGER) AS "Impulse_Direction", CAST(greatest(0, least(30, t)) AS INTEGER) AS "Impulse_Duration",
  CAST(CASE WHEN m > 0.002 THEN CASE WHEN t <= 5 THEN 1 WHEN t <= 15 THEN 2 ELSE 3 END ELSE 0 END AS INTEGER) AS "Impulse_Type"
FROM imp2""",
)
def impulse_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = D.table(spark, sf_dir, "lineitem").select(
        *KEYS,
        F.expr("CAST(l_discount * 0.2D AS DOUBLE)").alias("Impulse_Vector_Magnitude"),
        F.expr("CASE WHEN l_linenumber % 3 = 0 THEN 0 WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END").alias(
            "Impulse_Vector_Direction"
        ),
        F.expr("CAST(l_quantity AS INT) % 32").alias("Impulse_Vector_Duration"),
        F.expr("l_tax * 0.1D").alias("Impulse_Vector_Slope"),
        F.expr("l_quantity * 0.1D").alias("Volume_vs_SMA10"),
        F.expr("l_quantity * 2D").alias("RSI_14"),
        F.expr("0.1D + l_tax * 50D").alias("Support_Resistance_Proximity"),
        F.expr("(l_discount - 0.05D) * 20D").alias("Mid_Price_Momentum"),
    )
    df = df.withColumns(P.impulse_summary())
    df = df.withColumns(P.impulse_interactions())
    return six(df, _IMPULSE_OUT, [*KEYS, "Impulse_Direction", "Impulse_Duration", "Impulse_Type"])


# --- consistency checks -------------------------------------------------------------------------

_CHECK_IN = {
    "close": "l_quantity * 2D", "day_open": "l_quantity * 1.9D", "Return_Since_Open": "l_discount * 100D",
    "Order_Book_Imbalance": "l_tax * 10D - 0.4D", "Volume_Weighted_Order_Book_Imbalance": "l_discount * 10D - 0.5D",
    "Bid_Ask_Spread_Pct": "l_tax - 0.01D", "Spread_Percentile_20": "l_discount * 10D",
    "Position_In_Day_Range": "l_discount * 11D", "RSI_14": "l_quantity * 2.1D", "Current_Price": "l_quantity * 2D",
    "1R_Stop_Loss": "l_quantity * 2.02D - 0.5D", "2R_Target": "l_quantity * 1.98D + 0.5D",
    "Volume_Percentile_Intraday": "l_discount * 12D", "RSI_Distance_From_50": "abs(l_quantity * 2.1D - 50D) / 50D",
    "RSI_Regime_Numeric": "CASE WHEN l_linenumber = 1 THEN 1D ELSE 0.5D END", "Momentum_Consistency": "l_tax * 20D",
    "Market_Regime_Numeric": "CAST(l_linenumber - 3 AS INT)", "Return_Since_Open_Enhanced": "l_discount * 100D - 5D",
}
_CHECK_SQL = "chk AS (SELECT l_orderkey, l_partkey, l_linenumber, " + ", ".join(
    f'{re.sub(r"(?<=[0-9])D\b", "", e)} AS "{n}"' for n, e in _CHECK_IN.items()
) + " FROM lineitem)"
_MAIN_CHECKS = {
    "Return_Since_Open_Consistency":
        'abs("Return_Since_Open") < 50 AND abs((close - day_open) / day_open * 100 - "Return_Since_Open") > 0.1',
    "Imbalance_Signs":
        'abs("Order_Book_Imbalance") > 0.1 AND abs("Volume_Weighted_Order_Book_Imbalance") > 0.1 AND '
        'sign("Order_Book_Imbalance") <> sign("Volume_Weighted_Order_Book_Imbalance")',
    "Spread_Percentile": '"Bid_Ask_Spread_Pct" <= 0 AND "Spread_Percentile_20" NOT IN (0.0, 0.5, 1.0)',
    "Day_Position_Bounds": '"Position_In_Day_Range" NOT BETWEEN 0 AND 1',
    "RSI_Bounds": '"RSI_14" NOT BETWEEN 0 AND 100',
    "R_Levels_Stop": '"Current_Price" > 0 AND "1R_Stop_Loss" >= "Current_Price"',
    "R_Levels_Target": '"Current_Price" > 0 AND "2R_Target" <= "Current_Price"',
}
_EXTRA_CHECKS = {
    "Volume_Percentile_Intraday_Range": '"Volume_Percentile_Intraday" NOT BETWEEN 0 AND 1',
    "RSI_Distance_Range": '"RSI_Distance_From_50" NOT BETWEEN 0 AND 1',
    "Momentum_Consistency_Range": '"Momentum_Consistency" NOT BETWEEN 0 AND 1',
    "RSI_Regime_Consistency": 'abs("RSI_Regime_Numeric") = 1 AND "RSI_Distance_From_50" < 0.4',
    "Market_Regime_Return_Mismatch":
        '("Market_Regime_Numeric" >= 1 AND "Return_Since_Open_Enhanced" < -1) OR '
        '("Market_Regime_Numeric" <= -1 AND "Return_Since_Open_Enhanced" > 1)',
}


def _names_sql(checks: dict[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN {cond} THEN '{n}' END" for n, cond in checks.items())
    return f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ',')"


def _check_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "lineitem").select(*KEYS, *[F.expr(e).alias(n) for n, e in _CHECK_IN.items()])


@register(
    "consistency_warnings",
    f"WITH {_CHECK_SQL} SELECT {KEY_SQL}, {_names_sql(_MAIN_CHECKS)} AS warnings FROM chk",
)
def consistency_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clean.consistency_warnings(_check_rows(spark, sf_dir))
    return df.select(*KEYS, F.array_join("feature_warnings", ",").alias("warnings"))


@register(
    "extra_consistency_warnings",
    f"WITH {_CHECK_SQL} SELECT {KEY_SQL}, {_names_sql(_EXTRA_CHECKS)} AS warnings FROM chk",
)
def extra_consistency_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clean.extra_consistency_warnings(_check_rows(spark, sf_dir))
    return df.select(*KEYS, F.array_join("extra_warnings", ",").alias("warnings"))


@register(
    "align_features",
    f"""WITH {RAW_SQL} SELECT {KEY_SQL}, {r6('coalesce(gap_price, 0)')} AS gap_price, {r6('"RSI_14"')} AS "RSI_14",
  0.0::DOUBLE AS "Not_There", CASE WHEN gap_price IS NULL THEN 'gap_price,Not_There' ELSE 'Not_There' END AS missing FROM raw""",
)
def align_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clean.align_features(raw(spark, sf_dir).select(*KEYS, "gap_price", "RSI_14"), ["gap_price", "RSI_14", "Not_There"])
    df = df.withColumn("missing", F.array_join("missing_features", ","))
    return six(df, ["gap_price", "RSI_14", "Not_There"], [*KEYS, "missing"])


# --- preparation --------------------------------------------------------------------------------


@register(
    "impute_median",
    f"""WITH {RAW_SQL} SELECT {KEY_SQL},
  {r6("coalesce(gap_price, (SELECT median(gap_price) FROM raw))")} AS gap_price,
  coalesce(gap_flag, (SELECT gap_flag FROM raw WHERE gap_flag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))
    AS gap_flag FROM raw""",
)
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prepare.impute(raw(spark, sf_dir).select(*KEYS, "gap_price", "gap_flag"), ["gap_price", "gap_flag"])
    return six(df, ["gap_price"], [*KEYS, "gap_flag"])


_MEDIANS = ["l_extendedprice", "l_quantity", "l_discount", "l_tax"]


@register(
    "exact_medians",
    " UNION ALL ".join(f"SELECT '{c}' AS feature, {r6(f'median({c})')} AS median FROM lineitem" for c in _MEDIANS),
)
def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact medians of whole columns by narrowing brackets; the result has one row per column."""
    values = exact_medians(D.table(spark, sf_dir, "lineitem"), _MEDIANS)
    return spark.createDataFrame([(c, round(v, 6)) for c, v in values.items()], "feature string, median double")


_HEAVY = "CASE WHEN l_linenumber = 7 AND l_quantity > 45 THEN l_extendedprice * 30 ELSE l_extendedprice END"


@register(
    "winsorize",
    f"""WITH h AS (SELECT {KEY_SQL}, CAST({_HEAVY} AS DOUBLE) AS x FROM lineitem),
o AS (SELECT x, row_number() OVER (ORDER BY x) AS r, count(*) OVER () AS n FROM h),
b AS (SELECT min(x) FILTER (r = floor(0.005 * n) + 1) AS lo, min(x) FILTER (r = n - floor(0.005 * n)) AS hi FROM o)
SELECT {KEY_SQL}, {r6('greatest(lo, least(hi, x))')} AS x FROM h, b""",
)
def winsorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = D.table(spark, sf_dir, "lineitem").select(*KEYS, F.expr(_HEAVY).alias("x"))
    return six(prepare.winsorize(df, ["x"]), ["x"])


@register(
    "low_variance",
    """WITH v AS (SELECT var_samp(l_tax) AS l_tax, var_samp(l_quantity) AS l_quantity, var_samp(l_discount) AS l_discount FROM lineitem)
SELECT u.feature FROM (UNPIVOT v ON COLUMNS(*) INTO NAME feature VALUE x) u WHERE u.x >= 0.001""",
)
def low_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the features that survive the variance filter."""
    df = D.table(spark, sf_dir, "lineitem").select("l_tax", "l_quantity", "l_discount")
    kept = prepare.drop_low_variance(df, df.columns).columns
    return spark.createDataFrame([(c,) for c in kept], "feature string")


@register(
    "clip_3sigma",
    f"""WITH h AS (SELECT {KEY_SQL}, CAST({_HEAVY} AS DOUBLE) AS x FROM lineitem),
m AS (SELECT avg(x) AS a, stddev_samp(x) AS s FROM h)
SELECT {KEY_SQL}, round(greatest(a - 3 * s, least(a + 3 * s, x)), 3) AS x FROM h, m""",
)
def clip_3sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = D.table(spark, sf_dir, "lineitem").select(*KEYS, F.expr(_HEAVY).alias("x"))
    return prepare.clip_to_sigmas(df, ["x"]).select(*KEYS, F.round("x", 3).alias("x"))


@register(
    "clean_dataset",
    f"""WITH {RAW_SQL} SELECT {KEY_SQL}, {r6("coalesce(gap_price, (SELECT median(gap_price) FROM raw))")} AS gap_price,
  {r6('"RSI_14"')} AS "RSI_14" FROM raw""",
)
def clean_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops a listed, a mostly missing and a constant column and fills the remaining gaps."""
    df = raw(spark, sf_dir).select(
        *KEYS, "gap_price", "RSI_14", F.lit(1.0).alias("constant"), F.col("RSI_14").alias("VWAP"),
        F.when(F.col("l_linenumber") == 1, 1.0).alias("sparse"),
    )
    out = prepare.clean_dataset(df, target="l_returnflag")
    return six(out, [c for c in out.columns if c not in KEYS])


@register(
    "narrow_types",
    """SELECT l_orderkey, l_partkey, l_linenumber, CAST(CAST(l_tax AS FLOAT) AS DOUBLE) AS l_tax,
  'int,smallint,tinyint,float' AS kinds FROM lineitem""",
)
def narrow_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = D.table(spark, sf_dir, "lineitem").select(*KEYS, "l_tax")
    # widths are decided from the data, and keys grow with the table: the stated kinds are those of columns with known ranges
    known = {"wide": F.pmod("l_orderkey", F.lit(100000)) + 100000, "middle": F.pmod("l_partkey", F.lit(20000)) + 1000}
    df = prepare.narrow_types(lines.withColumns(known))
    kinds = [df.schema[c].dataType.simpleString() for c in ("wide", "middle", "l_linenumber", "l_tax")]
    return df.select(
        F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_partkey").cast("long").alias("l_partkey"),
        F.col("l_linenumber").cast("int").alias("l_linenumber"), F.col("l_tax").cast("double").alias("l_tax"),
        F.lit(",".join(kinds)).alias("kinds"),
    )


# --- samples ------------------------------------------------------------------------------------


def orders_with_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a binary class: finished or not."""
    return D.table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").alias("buy"), "o_totalprice", "o_orderdate"
    )


_HASH = "CAST('0x' || substr(md5('42|' || CAST(o_orderkey AS VARCHAR)), 1, 15) AS BIGINT)"
_CLASSED = f"o AS (SELECT o_orderkey, o_orderstatus = 'F' AS buy, o_orderdate, {_HASH} AS h FROM orders)"
_RANKED = f"{_CLASSED}, k AS (SELECT *, row_number() OVER (PARTITION BY buy ORDER BY h) AS r, count(*) OVER (PARTITION BY buy) AS n FROM o)"


@register("balanced_sample", f"WITH {_RANKED} SELECT o_orderkey, buy FROM k WHERE r <= 2000")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.balanced_sample(orders_with_class(spark, sf_dir), "buy", 4000, ["o_orderkey"]).select("o_orderkey", "buy")


@register(
    "stratified_sample",
    f"WITH {_RANKED} SELECT o_orderkey, buy FROM k WHERE r <= round_even(n * (3000 / (SELECT count(*) FROM orders)), 0)",
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.stratified_sample(orders_with_class(spark, sf_dir), "buy", 3000, ["o_orderkey"]).select("o_orderkey", "buy")


@register(
    "random_sample",
    f"WITH {_CLASSED} SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY h) AS r FROM o) WHERE r <= 2500",
)
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.random_sample(orders_with_class(spark, sf_dir), 2500, ["o_orderkey"]).select("o_orderkey")


@register(
    "recent_sample",
    f"WITH {_CLASSED} SELECT o_orderkey FROM (SELECT o_orderkey FROM o ORDER BY o_orderdate DESC, h LIMIT 1000)",
)
def recent_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = orders_with_class(spark, sf_dir).withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    return prepare.recent_sample(df, 1000, "ts", ["o_orderkey"]).select("o_orderkey")


# a class of few orders, to be repeated
_RARE = "o_orderkey % 20 = 0"


@register(
    "upsample_minority",
    f"""WITH {_CLASSED}, k AS (SELECT o_orderkey, h, {_RARE} AS rare FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY rare ORDER BY h) AS r, count(*) OVER (PARTITION BY rare) AS n FROM k)
SELECT o_orderkey, rare, CAST(unnest(range(0, CASE WHEN rare AND n < 3000 THEN (3000 // n) + CASE WHEN r <= 3000 % n THEN 1 ELSE 0 END
  WHEN r <= 3000 THEN 1 ELSE 0 END)) AS INTEGER) AS copy FROM r""",
)
def upsample_minority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six thousand rows: the rare class repeated, the others drawn once."""
    df = orders_with_class(spark, sf_dir).withColumn("rare", F.expr(_RARE))
    return prepare.upsample_minority(df, "rare", 6000, ["o_orderkey"]).select("o_orderkey", "rare", "copy")


@register("upsample_small_table", f"SELECT o_orderkey, {_RARE} AS rare, 0 AS copy FROM orders")
def upsample_small_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table within the target comes back as it is."""
    df = orders_with_class(spark, sf_dir).withColumn("rare", F.expr(_RARE))
    return prepare.upsample_minority(df, "rare", 10**9, ["o_orderkey"]).select("o_orderkey", "rare", "copy")


@register(
    "stratified_split",
    f"""WITH {_RANKED}, s AS (SELECT *, ceil(n * 0.15) AS t FROM k)
SELECT o_orderkey, buy, CASE WHEN r <= t THEN 'test' WHEN r <= t + ceil((n - t) * 0.15) THEN 'val' ELSE 'train' END AS split FROM s""",
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.stratified_split(orders_with_class(spark, sf_dir), "buy", ["o_orderkey"]).select("o_orderkey", "buy", "split")


@register(
    "stratified_folds",
    f"""WITH {_RANKED}
SELECT o_orderkey, buy, CASE WHEN r <= n * 1 // 5 THEN 0 WHEN r <= n * 2 // 5 THEN 1 WHEN r <= n * 3 // 5 THEN 2
  WHEN r <= n * 4 // 5 THEN 3 ELSE 4 END AS fold FROM k""",
)
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold of every row: each class in five parts of equal size."""
    from barloom.operators.models import with_folds

    return with_folds(orders_with_class(spark, sf_dir), "buy", ["o_orderkey"], 5).select("o_orderkey", "buy", "fold")


@register(
    "size_recommendation",
    """WITH c AS (SELECT o_orderstatus = 'F' AS b, count(*) AS n FROM orders GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS total_samples, min(n) AS minority_class_count, round(max(n) / min(n), 6) AS imbalance_ratio,
  CAST(CASE WHEN sum(n) > 10000000 THEN 500000 WHEN sum(n) > 1000000 THEN 200000 ELSE least(100000, sum(n)) END AS BIGINT)
    AS recommended_size FROM c""",
)
def size_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prepare.size_recommendation(orders_with_class(spark, sf_dir), "buy")
    return df.withColumn("imbalance_ratio", to6("imbalance_ratio"))


@register(
    "leakage_report",
    """WITH t AS (SELECT l_quantity AS q, l_extendedprice AS p, l_quantity * 2 + 1 AS leak, l_discount AS d FROM lineitem)
SELECT 'l_extendedprice' AS feature, round(corr(p, q), 6) AS correlation, abs(corr(p, q)) >= 0.999 AS leaks FROM t
UNION ALL SELECT 'leak', round(corr(leak, q), 6), abs(corr(leak, q)) >= 0.999 FROM t
UNION ALL SELECT 'l_discount', round(corr(d, q), 6), abs(corr(d, q)) >= 0.999 FROM t""",
)
def leakage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = D.table(spark, sf_dir, "lineitem").withColumn("leak", F.col("l_quantity") * 2 + 1)
    out = prepare.leakage_report(df, "l_quantity", ["l_extendedprice", "leak", "l_discount"])
    return out.withColumn("correlation", to6("correlation"))


_F_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_F_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round((b / (k - 1)) / (w / (n - k)), 4) AS f_score FROM (
  SELECT sum(cn * (m - g) * (m - g)) AS b, sum(ss) AS w, count(*) AS k, sum(cn) AS n FROM (
    SELECT l_returnflag, count(*) AS cn, avg({c}) AS m, var_pop({c}) * count(*) AS ss,
      (SELECT avg({c}) FROM lineitem) AS g FROM lineitem GROUP BY 1))"""
    for c in _F_COLS
)


@register("anova_f", _F_SQL)
def anova_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = evaluate.anova_f(D.table(spark, sf_dir, "lineitem"), "l_returnflag", _F_COLS)
    return df.withColumn("f_score", F.round("f_score", 4))


_CUTS = {"l_quantity": [10.0, 20.0, 30.0, 40.0], "l_discount": [0.02, 0.05, 0.08], "l_tax": [0.02, 0.04, 0.06]}
_MI_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(sum(n / t * ln(n * t / (nb * ny))), 6) AS mi_score FROM (
  SELECT count(*)::DOUBLE AS n, (sum(count(*)) OVER (PARTITION BY b))::DOUBLE AS nb,
    (sum(count(*)) OVER (PARTITION BY y))::DOUBLE AS ny, (sum(count(*)) OVER ())::DOUBLE AS t FROM (
    SELECT {' + '.join(f'CASE WHEN {c} >= {e} THEN 1 ELSE 0 END' for e in cuts)} AS b, l_returnflag AS y FROM lineitem)
  GROUP BY b, y)"""
    for c, cuts in _CUTS.items()
)


@register("mutual_information", _MI_SQL)
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = evaluate.mutual_information(D.table(spark, sf_dir, "lineitem"), "l_returnflag", list(_CUTS), _CUTS)
    return df.withColumn("mi_score", to6("mi_score"))


_NEAR = {"quantity": "CAST(l_quantity AS BIGINT)", "cents": "CAST(round(l_extendedprice * 100) AS BIGINT)", "partkey": "l_partkey", "days": "datediff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE))"}


def _digamma_sql(m: str) -> str:
    """Ten steps of the recurrence, then the series."""
    z = f"({m} + 10.0)"
    return f"(ln({z}) - 1 / (2 * {z}) - 1 / (12 * {z} ** 2) + 1 / (120 * {z} ** 4) - 1 / (252 * {z} ** 6) - list_sum(list_transform(range(0, 10), lambda i: 1.0 / ({m} + i))))"


# whole numbers, so nearer than r is within r - 0.5
_NEAR_SQL = f"""WITH v AS ({' UNION ALL '.join(f"SELECT '{n}' AS feature, l_returnflag AS y, {x} AS x FROM lineitem" for n, x in _NEAR.items())}),
d AS (SELECT feature, y, x, {', '.join(f"abs({f}(x, {i}) OVER c - x) AS {f}{i}" for f in ('lag', 'lead') for i in (1, 2, 3))},
  count(*) OVER (PARTITION BY feature, y) AS ny, count(*) OVER (PARTITION BY feature) AS n FROM v WINDOW c AS (PARTITION BY feature, y ORDER BY x)),
r AS (SELECT *, CAST(list_sort(list_filter([lag1, lag2, lag3, lead1, lead2, lead3], lambda t: t IS NOT NULL))[3] AS DOUBLE) AS r FROM d),
m AS (SELECT *, count(*) OVER (PARTITION BY feature ORDER BY CAST(x AS DOUBLE) RANGE BETWEEN greatest(r - 0.5, 0.0) PRECEDING AND greatest(r - 0.5, 0.0) FOLLOWING) AS m FROM r)
SELECT feature, round(greatest(0, any_value({_digamma_sql('n')}) + {_digamma_sql('3')} - avg({_digamma_sql('ny')}) - avg({_digamma_sql('m')})), 6) AS mi_score FROM m GROUP BY feature"""


@register("neighbour_information", _NEAR_SQL)
def neighbour_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-neighbour mutual information of numeric columns with a class."""
    days = F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date"))
    rows = D.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("y"), F.col("l_quantity").alias("quantity"), F.round(F.col("l_extendedprice") * 100).alias("cents"),
        F.col("l_partkey").alias("partkey"), days.alias("days"),
    )
    return neighbours.neighbour_information(rows, "y", list(_NEAR)).withColumn("mi_score", F.round("mi_score", 6))


@register(
    "valid_reasons",
    """SELECT o_orderkey, reason FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'reached_2r_success'
  WHEN 'O' THEN 'reached_negative_1r' ELSE 'timeout_no_2r' END AS reason FROM orders)
WHERE reason IN ('reached_2r_success', 'reached_3r_success', 'reached_4r_success', 'reached_negative_1r')""",
)
def valid_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep trainable outcomes, tidy the names and drop leaking columns."""
    status = F.col("o_orderstatus")
    reason = F.when(status == "F", "reached_2r_success").when(status == "O", "reached_negative_1r").otherwise("timeout_no_2r")
    df = D.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias(" o-orderkey "), reason.alias("reason"), F.lit(2).alias("R"), F.lit(5).alias("time_minutes")
    )
    df = prepare.drop_leakage(prepare.tidy_names(prepare.keep_valid_reasons(df)))
    return df.select("o_orderkey", "reason")


@register(
    "training_features",
    f"""WITH {RAW_SQL} SELECT {KEY_SQL}, {", ".join(f'{r6(f'"{n}"')} AS "{n}"' for n in RAW if n in stated.TRAINING_FEATURES)},
  CAST({sum(n not in RAW for n in stated.TRAINING_FEATURES)} AS INTEGER) AS n_missing FROM raw""",
)
def training_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, chosen, missing = prepare.select_training_features(raw(spark, sf_dir), keep=KEYS)
    return six(df.withColumn("n_missing", F.lit(len(missing))), chosen, [*KEYS, "n_missing"])
