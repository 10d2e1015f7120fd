"""Dataset preparation: impute, winsorise, filter, clip, sample, balance, split."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.frames import no_nan
from barloom.operators.clean import REMOVED, is_numeric, numeric_columns
from barloom.operators.order_stats import (
    exact_medians,
    exact_ranks,
    hash_cuts,
    hash_rank_key,
    hash_thresholds,
    one_row,
    within_thresholds,
)

# fixed values: outcomes usable for training
VALID_REASONS = ("reached_2r_success", "reached_3r_success", "reached_4r_success", "reached_negative_1r")

# fixed values: the training features
TRAINING_FEATURES = (
    "Time_Of_Day_Cyclical_Sin", "Time_Of_Day_Cyclical_Cos", "Bid_Ask_Spread_Pct",
    "Volume_Weighted_Order_Book_Imbalance", "Volume_Percentile_Intraday", "Volume_vs_SMA10",
    "Volatility_Regime_Shift_Norm", "Max_Drawdown_Return_Interaction", "Support_Momentum_Interaction",
    "Max_Drawdown_30", "Return_Since_Open_Enhanced", "ATR_Stop_Risk_Pct", "Price_vs_SMA50",
    "Support_Resistance_Proximity", "RSI_14", "Return_5min", "Mid_Price_Momentum", "Price_Acceleration",
    "RSI_Distance_From_50", "Price_Action_Quality",
)
LEAKAGE_COLUMNS = ("R", "time_minutes", "future_return", "label_debug")


def keep_valid_reasons(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reason").isin(*VALID_REASONS))


def tidy_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().replace(" ", "_").replace("-", "_") for c in df.columns])


def select_training_features(df: DataFrame, names=TRAINING_FEATURES, keep=()) -> tuple[DataFrame, list[str], list[str]]:
    """(selected frame, chosen features, missing features); non-numeric ones are not chosen."""
    chosen = [c for c in names if c in df.columns and is_numeric(df, c)]
    missing = [c for c in names if c not in df.columns]
    return df.select(*keep, *chosen), chosen, missing


def drop_leakage(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in LEAKAGE_COLUMNS if c in df.columns])


def leakage_report(df: DataFrame, target: str, features: list[str], threshold: float = 0.999) -> DataFrame:
    """feature, correlation of every feature with the target, and whether it leaks; one pass."""
    y = F.col(target).cast("double")

    def correlation(c: str) -> Column:
        x = F.col(c).cast("double")
        xx, yy = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        spread = F.stddev_pop(xx) * F.stddev_pop(yy)  # zero for a constant column, which has no correlation
        return F.when(spread > 0, F.covar_pop(x, y) / spread)

    row = df.agg(*[correlation(c).alias(c) for c in features])
    long = row.unpivot([], features, "feature", "correlation")
    return long.withColumn("leaks", F.coalesce(F.abs("correlation") >= threshold, F.lit(False)))


def numbers_to_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """NaN and infinities become NULL so that counts and means skip them."""
    doubles = [c for c in cols if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: no_nan(F.col(c)) for c in doubles}) if doubles else df


def modes(df: DataFrame, cols: list[str]) -> dict:
    """Most frequent value of each text or boolean column (smallest on ties), all from one pass."""
    if not cols:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])
    counts = df.select(F.inline(pairs)).filter("v IS NOT NULL").groupBy("c", "v").agg(F.count("*").alias("n"))
    top = counts.groupBy("c").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v")).collect()
    flags = {c for c in cols if isinstance(df.schema[c].dataType, T.BooleanType)}
    return {r["c"]: r["v"] == "true" if r["c"] in flags else r["v"] for r in top}


def fill_values(df: DataFrame, cols: list[str] | None = None, counts: dict[str, int] | None = None) -> dict:
    """Median of each numeric column and most frequent value of the others (smallest on ties)."""
    cols = cols or df.columns
    numeric = [c for c in cols if is_numeric(df, c)]
    known = {c: counts[c] for c in numeric} if counts else None
    values: dict = dict(exact_medians(numbers_to_null(df.select(*numeric), numeric), numeric, counts=known))
    return values | modes(df, [c for c in cols if c not in numeric and isinstance(df.schema[c].dataType, (T.StringType, T.BooleanType))])


def impute(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Fill gaps with medians and modes; integer columns that have gaps become doubles."""
    cols = cols or df.columns
    numeric = [c for c in cols if is_numeric(df, c)]
    df = numbers_to_null(df, numeric)
    total, *filled = df.agg(F.count(F.lit(1)), *[F.count(c) for c in cols]).first()
    counts = dict(zip(cols, filled, strict=True))
    todo = [c for c in cols if counts[c] < total]
    values = fill_values(df, todo, counts) if todo else {}
    new = {}
    for c in todo:
        if values.get(c) is not None:
            x = F.col(c).cast("double") if c in numeric else F.col(c)
            new[c] = F.coalesce(x, F.lit(values[c]))
    return df.withColumns(new) if new else df


def winsorize(df: DataFrame, cols: list[str], share: float = 0.005, z: float = 4.0, min_extreme: int = 5) -> DataFrame:
    """Pull the lowest and highest floor(share*n) values to the next order statistic.

    Only columns with more than ``min_extreme`` values beyond ``z`` population deviations are touched.
    """
    if not cols:
        return df
    stats = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in cols],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in cols],
        *[F.count(c).alias(f"n_{c}") for c in cols],
    ).first()
    usable = [c for c in cols if stats[f"s_{c}"]]
    if not usable:
        return df
    extreme = df.agg(
        *[
            F.count(F.when(F.abs((F.col(c) - stats[f"m_{c}"]) / stats[f"s_{c}"]) > z, 1)).alias(c)
            for c in usable
        ]
    ).first()
    ranks = {}
    for c in usable:
        n = stats[f"n_{c}"]
        cut = math.floor(share * n)
        if extreme[c] > min_extreme and cut > 0:
            ranks[c] = [cut + 1, n - cut]
    limits = exact_ranks(df, ranks, {c: stats[f"n_{c}"] for c in ranks})
    new = {}
    for c, (lo, hi) in ranks.items():
        low, high = limits[c][lo], limits[c][hi]
        new[c] = F.when(F.col(c) < low, low).when(F.col(c) > high, high).otherwise(F.col(c))
    return df.withColumns(new) if new else df


def variances(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    return df.agg(*[F.var_samp(c).alias(c) for c in cols]).first().asDict() if cols else {}


def drop_low_variance(df: DataFrame, cols: list[str], threshold: float = 0.001) -> DataFrame:
    seen = variances(df, cols)
    return df.drop(*[c for c in cols if seen[c] is None or seen[c] < threshold])


def clip_to_sigmas(df: DataFrame, cols: list[str], sigmas: float = 3.0) -> DataFrame:
    """Clip each column to mean +- 3 sample deviations; the statistics are one scalar subquery."""
    if not cols:
        return df
    stats = one_row(
        df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"s_{c}") for c in cols])
    )
    new = {}
    for c in cols:
        x, m, s = F.col(c), stats[f"m_{c}"], stats[f"s_{c}"]
        new[c] = F.when(
            (s > 0) & x.isNotNull(), F.greatest(m - s * sigmas, F.least(m + s * sigmas, x))
        ).otherwise(x)
    return df.withColumns(new)


def column_report(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column: share of NULLs and whether it holds more than one distinct value (min differs from max)."""
    row = df.agg(
        *[F.avg(F.col(c).isNull().cast("double")).alias(f"null_{i}") for i, c in enumerate(cols)],
        *[F.coalesce(F.min(c) != F.max(c), F.lit(False)).alias(f"vary_{i}") for i, c in enumerate(cols)],
    )
    parts = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"null_{i}").alias("null_share"), F.col(f"vary_{i}").alias("varies"))
            for i, c in enumerate(cols)
        ]
    )
    return row.select(F.inline(parts))


def clean_dataset(df: DataFrame, target: str = "buy", max_missing: float = 0.5) -> DataFrame:
    """Drop listed, mostly missing and constant columns, then fill the remaining gaps."""
    df = df.drop(*[c for c in REMOVED if c in df.columns])
    report = {r["column"]: r for r in column_report(df, df.columns).collect()}
    sparse = [c for c in df.columns if report[c]["null_share"] > max_missing]
    constant = [
        c for c in numeric_columns(df, skip=(target, *sparse)) if not report[c]["varies"]
    ]
    return impute(df.drop(*sparse, *constant))


def narrow_types(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Doubles to float, longs to the smallest integer type that holds their range."""
    cols = cols or numeric_columns(df)
    longs = [c for c in cols if isinstance(df.schema[c].dataType, (T.LongType, T.IntegerType))]
    new: dict[str, Column] = {
        c: F.col(c).cast("float") for c in cols if isinstance(df.schema[c].dataType, T.DoubleType)
    }
    if longs:
        seen = df.agg(*[F.min(c).alias(f"a_{c}") for c in longs], *[F.max(c).alias(f"b_{c}") for c in longs]).first()
        for c in longs:
            lo, hi = seen[f"a_{c}"], seen[f"b_{c}"]
            if lo is None:
                continue
            for kind, bits in (("byte", 7), ("short", 15), ("int", 31), ("long", 63)):
                if -(1 << bits) <= lo and hi < (1 << bits):
                    new[c] = F.col(c).cast(kind)
                    break
    return df.withColumns(new) if new else df


# --- samples and splits -------------------------------------------------------------------------


def balanced_sample(df: DataFrame, target: str, size: int, keys: list[str], seed: int = 42) -> DataFrame:
    """Up to size/2 rows of each class, chosen by hash of the key: exact and repeatable."""
    key = hash_rank_key(keys, seed)
    return df.filter(within_thresholds(target, hash_thresholds(df, target, lambda g, n: size // 2, key), key))


def stratified_sample(df: DataFrame, target: str, size: int, keys: list[str], seed: int = 42) -> DataFrame:
    """``size`` rows with every class in proportion."""
    share = min(1.0, size / max(df.count(), 1))
    key = hash_rank_key(keys, seed)
    return df.filter(within_thresholds(target, hash_thresholds(df, target, lambda g, n: round(n * share), key), key))


def random_sample(df: DataFrame, size: int, keys: list[str], seed: int = 42) -> DataFrame:
    key = hash_rank_key(keys, seed)
    return df.filter(within_thresholds(None, hash_thresholds(df, None, lambda g, n: size, key), key))


def recent_sample(df: DataFrame, size: int, order: str, keys: list[str], seed: int = 42) -> DataFrame:
    """The last ``size`` rows in time, exactly: of rows at the boundary time those with the smallest hashes.

    Rows without a time are the oldest.
    """
    time = F.unix_micros(order) if isinstance(df.schema[order].dataType, T.TimestampType) else F.col(order)
    rows, timed = df.agg(F.count(F.lit(1)), F.count(order)).first()
    if rows <= size:
        return df
    key = hash_rank_key(keys, seed)
    if timed <= size:
        edge, after = F.col(order).isNull(), F.col(order).isNotNull()
        room = size - timed
    else:
        cut = exact_ranks(df.select(time.alias("t")), {"t": [timed - size + 1]}, {"t": timed})["t"][timed - size + 1]
        edge, after = time == F.lit(cut), time > F.lit(cut)
        room = size - df.filter(after).count()
    chosen = within_thresholds(None, hash_thresholds(df.filter(edge), None, lambda g, n: room, key), key)
    return df.filter(after | (edge & chosen))


def shuffled(df: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    return df.orderBy(hash_rank_key(keys, seed))


def upsample_minority(df: DataFrame, target: str, size: int, keys: list[str], seed: int = 42) -> DataFrame:
    """size/2 rows with the target true and size/2 others, the true ones repeated where there are fewer.

    A table not larger than ``size`` comes back as it is. Others are never repeated. Of a repeated class every row
    is used equally often, the remainder chosen by hash. Adds ``copy``, 0 for the first use of a row.
    """
    half = size // 2
    key = hash_rank_key(keys, seed)
    hit = F.coalesce(F.col(target).cast("boolean"), F.lit(False))
    marked = df.withColumn("_hit", hit)
    seen: dict = {}

    def wanted(g: object, n: int) -> int:
        seen[g] = n
        return half % n if g and n < half else half

    limits = hash_thresholds(marked, "_hit", wanted, key)
    if sum(seen.values()) <= size:
        return df.withColumn("copy", F.lit(0))
    whole = half // seen[True] if 0 < seen.get(True, 0) < half else 0
    copies = F.when(F.col("_hit"), F.lit(whole)).otherwise(0) + within_thresholds("_hit", limits, key).cast("int")
    return (
        marked.withColumn("_copies", copies).filter("_copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies", "_hit")
    )


def stratified_split(
    df: DataFrame, target: str, keys: list[str], test: float = 0.15, validation: float = 0.15, seed: int = 42
) -> DataFrame:
    """Adds split: 'test' 15% of each class, 'val' 15% of the rest, else 'train'."""

    def wanted(g: object, n: int) -> list[int]:
        first = math.ceil(n * test)
        return [first, first + math.ceil((n - first) * validation)]

    key = hash_rank_key(keys, seed)
    cuts = hash_cuts(df, target, wanted, key)
    in_test, upto_val = (within_thresholds(target, {g: c[j] for g, c in cuts.items()}, key) for j in (0, 1))
    return df.withColumn("split", F.when(in_test, "test").when(upto_val, "val").otherwise("train"))


SAMPLERS = {
    "balanced": balanced_sample,
    "stratified": stratified_sample,
    "diverse": lambda df, target, size, keys, seed=42: random_sample(df, size, keys, seed),
    "recent": lambda df, target, size, keys, seed=42: recent_sample(df, size, "ts", keys, seed),
}


def take_sample(df: DataFrame, target: str, size: int, keys: list[str], strategy: str = "balanced", seed: int = 42):
    """One of the sampling strategies, shuffled by the key's hash; an unknown name samples at random."""
    return shuffled(SAMPLERS.get(strategy, SAMPLERS["diverse"])(df, target, size, keys, seed), keys, seed)


def size_recommendation(df: DataFrame, target: str) -> DataFrame:
    """Rows, class counts, minority count, imbalance and the suggested training size."""
    per_class = df.groupBy(target).agg(F.count("*").alias("n"))
    out = per_class.agg(
        F.sum("n").alias("total_samples"),
        F.min("n").alias("minority_class_count"),
        (F.max("n") / F.min("n")).alias("imbalance_ratio"),
    )
    total = F.col("total_samples")
    size = (
        F.when(total > 10_000_000, F.lit(500_000))
        .when(total > 1_000_000, F.lit(200_000))
        .otherwise(F.least(F.lit(100_000), total))
    )
    return out.withColumn("recommended_size", size.cast("long"))
