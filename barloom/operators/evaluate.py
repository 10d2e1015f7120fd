"""Model evaluation as tables: AUC, ROC, confusion, threshold sweep, importances, feature ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.order_stats import one_row, with_slices


def running_totals(values: DataFrame, group: str, order: str, sums: list[str]) -> DataFrame:
    """Adds cum_<name> for each sum: totals over the values up to and including the row, per group.

    Two levels: totals per slice, then a running sum inside each slice plus the slices before it. No
    window ever covers a whole group. NULL comes before and NaN after every other value, in any number of slices.
    """
    sliced, slices = with_slices(values, group, order)
    inside = Window.partitionBy(group, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    if slices == 1:
        return sliced.withColumns({f"cum_{s}": F.sum(s).over(inside) for s in sums}).drop("_slice")
    per_slice = sliced.groupBy(group, "_slice").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        F.col(group).alias("_g"), F.col("_slice").alias("_s"),
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
    )
    joined = sliced.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_slice") == F.col("_s")))
    for s in sums:
        joined = joined.withColumn(f"cum_{s}", F.sum(s).over(inside) + F.col(f"_o_{s}"))
    return joined.drop("_slice", "_g", "_s", *[f"_o_{s}" for s in sums])


def score_counts(scored: DataFrame, group: str = "model") -> DataFrame:
    """Positives and negatives per distinct score; copies of a score collapse before any ordering.

    A row without a score (NULL or NaN) has no place in a ranking and is left out.
    """
    y, p = F.col("label").cast("int"), F.col("probability")
    return scored.filter(p.isNotNull() & ~F.isnan(p)).groupBy(group, "probability").agg(
        F.count(F.when(y == 1, 1)).alias("pos"), F.count(F.when(y == 0, 1)).alias("neg")
    )


def auc_by_model(scored: DataFrame, group: str = "model") -> DataFrame:
    """Exact area under the ROC curve: rank sum with averaged ties."""
    cum = running_totals(score_counts(scored, group), group, "probability", ["neg"])
    wins = F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)
    out = cum.groupBy(group).agg(
        F.sum(wins).alias("_w"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives")
    )
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return out.select(group, F.when(pairs > 0, F.col("_w") / pairs).alias("auc"), "positives", "negatives")


def best_by_auc(aucs: DataFrame, group: str = "model") -> DataFrame:
    best = F.max_by(F.struct(group, "auc"), F.struct(F.col("auc"), F.col(group)))
    return aucs.agg(best.alias("b")).select(F.col(f"b.{group}").alias(group), F.col("b.auc").alias("auc"))


def roc_curve(scored: DataFrame, group: str = "model") -> DataFrame:
    """One point per distinct score: rates of the rows at or above it."""
    cum = running_totals(score_counts(scored, group), group, "probability", ["pos", "neg"])
    # the totals are the largest running totals
    totals = cum.groupBy(group).agg(F.max("cum_pos").alias("_p"), F.max("cum_neg").alias("_n"))
    df = cum.join(totals, group)
    return df.select(
        group,
        F.col("probability").alias("threshold"),
        F.when(F.col("_n") > 0, (F.col("_n") - F.col("cum_neg") + F.col("neg")) / F.col("_n")).alias("fpr"),
        F.when(F.col("_p") > 0, (F.col("_p") - F.col("cum_pos") + F.col("pos")) / F.col("_p")).alias("tpr"),
    )


def _share(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, p * r * 2 / (p + r)).otherwise(F.lit(0.0))


def confusion_counts(scored: DataFrame, threshold: float = 0.5, group: str = "model") -> DataFrame:
    y, guess = F.col("label").cast("int"), (F.col("probability") >= threshold).cast("int")
    return scored.groupBy(group).agg(
        F.count(F.when((guess == 1) & (y == 1), 1)).alias("tp"),
        F.count(F.when((guess == 1) & (y == 0), 1)).alias("fp"),
        F.count(F.when((guess == 0) & (y == 1), 1)).alias("fn"),
        F.count(F.when((guess == 0) & (y == 0), 1)).alias("tn"),
    )


def classification_report(scored: DataFrame, threshold: float = 0.5, group: str = "model") -> DataFrame:
    """Per class precision, recall, f1, support, then accuracy, macro and weighted averages."""
    c = confusion_counts(scored, threshold, group)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p1, r1, p0, r0 = _share(tp, tp + fp), _share(tp, tp + fn), _share(tn, tn + fn), _share(tn, tn + fp)
    s1, s0 = tp + fn, tn + fp
    f1, f0 = _f1(p1, r1), _f1(p0, r0)
    total = s0 + s1

    def line(name: str, p: Column, r: Column, f: Column, s: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
            s.cast("long").alias("support"),
        )

    def weighted(a0: Column, a1: Column) -> Column:
        return _share(a0 * s0 + a1 * s1, total)

    acc = _share(tp + tn, total)
    rows = F.array(
        line("0", p0, r0, f0, s0),
        line("1", p1, r1, f1, s1),
        line("accuracy", acc, acc, acc, total),
        line("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, total),
        line("weighted avg", weighted(p0, p1), weighted(r0, r1), weighted(f0, f1), total),
    )
    return c.select(group, F.inline(rows))


def threshold_grid() -> list[float]:
    return [round(0.10 + 0.05 * i, 2) for i in range(17)]


def threshold_sweep(scored: DataFrame, group: str = "model") -> DataFrame:
    """Signals and quality at 17 thresholds; thresholds without signals are left out.

    Every row falls into one of 18 score bands, so the table is aggregated once to at most 18 rows per
    model and the thresholds are running sums over those, not a cross join with the rows.
    """
    grid = threshold_grid()
    band = F.lit(-1)
    for i, t in enumerate(grid):
        band = F.when(F.col("probability") >= t, F.lit(i)).otherwise(band)
    y = F.col("label").cast("int")
    bands = scored.groupBy(group, band.alias("band")).agg(
        F.count(F.when(y == 1, 1)).alias("pos"), F.count(F.when(y == 0, 1)).alias("neg")
    )
    per_model = bands.groupBy(group).agg(
        F.collect_list(F.struct("band", "pos", "neg")).alias("b"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n")
    )
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)])
    df = per_model.select(group, "b", "_p", "_n", F.inline(steps))

    def at_least(name: str) -> Column:
        return F.aggregate(
            F.filter("b", lambda x: x["band"] >= F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x[name]
        )

    df = df.withColumns({"tp": at_least("pos"), "fp": at_least("neg")})
    df = df.withColumns({"fn": F.col("_p") - F.col("tp"), "tn": F.col("_n") - F.col("fp")})
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    df = df.withColumns({"signals": tp + fp, "precision": _share(tp, tp + fp), "recall": _share(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return df.filter("signals > 0").select(
        group, "threshold", "signals", "precision", "recall",
        _share(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _f1(p, r).alias("f1"), p.alias("hit_rate"), (p * 2 - 1).alias("expected_value"),
    )


def best_strategies(sweep: DataFrame, group: str = "model") -> DataFrame:
    """Thresholds with the best F1, expected value and precision (within 50 to 1000 signals, else at
    least 20). The lowest threshold wins ties."""
    whole = F.struct("threshold", "signals", "precision", "recall", "accuracy", "f1", "expected_value")

    def best(name: str, gate: Column) -> Column:
        return F.max_by(F.when(gate, whole), F.when(gate, F.struct(F.col(name), -F.col("threshold"))))

    usual = F.col("signals").between(50, 1000)
    rows = sweep.groupBy(group).agg(
        best("f1", F.lit(True)).alias("by_f1"),
        best("expected_value", F.lit(True)).alias("by_ev"),
        F.coalesce(best("precision", usual), best("precision", F.col("signals") >= 20)).alias("by_precision"),
        F.min(F.when(F.col("expected_value") > 0, F.col("threshold"))).alias("min_profitable_threshold"),
        F.max(F.when(F.col("expected_value") > 0, F.col("threshold"))).alias("max_profitable_threshold"),
    )
    return rows.select(
        group,
        F.col("by_f1.threshold").alias("best_threshold"), F.col("by_f1.f1").alias("test_f1"),
        F.col("by_f1.recall").alias("test_recall"), F.col("by_f1.accuracy").alias("test_accuracy"),
        F.col("by_f1.signals").alias("best_signals"),
        F.col("by_ev.threshold").alias("best_ev_threshold"),
        F.col("by_ev.expected_value").alias("best_expected_value"),
        F.col("by_precision.precision").alias("best_precision"),
        F.col("by_precision.signals").alias("best_precision_signals"),
        F.col("by_precision.threshold").alias("best_precision_threshold"),
        "min_profitable_threshold", "max_profitable_threshold",
    )


def importance_table(importances: DataFrame) -> DataFrame:
    """Across models per feature: percent importances aggregated, and an impact band by mean and deviation.

    The number of features is the width of a table, so the one-row statistics are small.
    """
    sums = importances.groupBy("model").agg(F.sum("importance").alias("_s"))
    pct = importances.join(F.broadcast(sums), "model").withColumn(
        "pct", F.when(F.col("_s") != 0, F.col("importance") / F.col("_s") * 100)
    )
    out = pct.groupBy("feature").agg(
        F.avg("pct").alias("mean_importance"), F.stddev_samp("pct").alias("std_importance"),
        F.min("pct").alias("min_importance"), F.max("pct").alias("max_importance"),
    )
    mean = F.col("mean_importance")
    out = out.withColumn("cv_importance", F.when(mean != 0, F.col("std_importance") / mean))
    band = one_row(out.agg(F.avg("mean_importance").alias("m"), F.stddev_samp("mean_importance").alias("d")))
    impact = (
        F.when(mean > band["m"] + band["d"], "high").when(mean < band["m"] - band["d"], "low").otherwise("medium")
    )
    return out.withColumn("impact", impact)


def metrics_summary(aucs: DataFrame, strategies: DataFrame, importances: DataFrame, group: str = "model") -> DataFrame:
    """One row: best model with its strategy metrics, top three features and low-impact features."""
    best = best_by_auc(aucs, group).withColumnRenamed("auc", "test_auc")
    ranked = importances.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("mean_importance")).alias("m"), "feature"))).alias("r"),
        F.array_sort(F.collect_list(F.when(F.col("impact") == "low", F.col("feature")))).alias("low"),
    )
    none = F.lit("None")
    tops = ranked.select(
        *[F.coalesce(F.get("r", i)["feature"], none).alias(f"top_feature_{i + 1}") for i in range(3)],
        F.when(F.size("low") > 0, F.array_join("low", ", ")).otherwise(none).alias("low_impact_features"),
    )
    tops_row = one_row(tops)
    return best.join(strategies, group, "left").withColumns({c: tops_row[c] for c in tops.columns})


# --- feature ranking ----------------------------------------------------------------------------


def anova_f(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """One-way F score per feature from class counts, means and variances: one aggregation."""
    long = df.select(F.col(target).alias("_y"), *[F.col(c).cast("double") for c in features]).unpivot(
        "_y", features, "feature", "x"
    )
    per_class = long.groupBy("feature", "_y").agg(
        F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v")
    )
    n, m = F.col("n"), F.col("m")
    total = per_class.groupBy("feature").agg(
        F.sum("n").alias("rows"), F.count("*").alias("k"),
        (F.sum(n * m) / F.sum("n")).alias("mean"), F.sum(n * F.col("v")).alias("within"),
        F.collect_list(F.struct("n", "m")).alias("classes"),
    )
    between = F.aggregate(
        "classes", F.lit(0.0), lambda a, c: a + c["n"] * (c["m"] - F.col("mean")) * (c["m"] - F.col("mean"))
    )
    df_b, df_w = F.col("k") - 1, F.col("rows") - F.col("k")
    score = F.when(
        (F.col("within") > 0) & (df_b > 0) & (df_w > 0), (between / df_b) / (F.col("within") / df_w)
    )
    return total.select("feature", score.alias("f_score"))


def mutual_information(df: DataFrame, target: str, features: list[str], cuts: dict[str, list[float]]) -> DataFrame:
    """Mutual information (nats) of each binned feature with the target, from a contingency table.

    ``cuts`` are inner bin edges; a value equal to an edge falls into the bin above it. For the estimate by nearest
    neighbours see `neighbours.neighbour_information`.
    """
    def bin_of(c: str) -> Column:
        b = F.lit(0)
        for i, edge in enumerate(cuts[c], start=1):
            b = F.when(F.col(c) >= edge, F.lit(i)).otherwise(b)
        return b

    binned = df.select(F.col(target).alias("_y"), *[bin_of(c).alias(c) for c in features])
    cells = binned.unpivot("_y", features, "feature", "bin").groupBy("feature", "bin", "_y").agg(F.count("*").alias("n"))
    by_feature = Window.partitionBy("feature")
    cells = cells.withColumns(
        {
            "total": F.sum("n").over(by_feature),
            "nb": F.sum("n").over(Window.partitionBy("feature", "bin")),
            "ny": F.sum("n").over(Window.partitionBy("feature", "_y")),
        }
    )
    n, total = F.col("n").cast("double"), F.col("total").cast("double")
    part = n / total * F.ln(n * total / (F.col("nb").cast("double") * F.col("ny")))
    return cells.groupBy("feature").agg(F.sum(part).alias("mi_score"))


def ensemble_ranking(scores: DataFrame, measures: list[str], top: int | None = None) -> DataFrame:
    """Min-max normalise each measure over the features, average, best first."""
    spans = one_row(
        scores.agg(*[F.min(m).alias(f"lo_{m}") for m in measures], *[F.max(m).alias(f"hi_{m}") for m in measures])
    )
    df = scores
    total = F.lit(0.0)
    for m in measures:
        norm = (F.coalesce(F.col(m), F.lit(0.0)) - spans[f"lo_{m}"]) / (
            spans[f"hi_{m}"] - spans[f"lo_{m}"] + 1e-9
        )
        df = df.withColumn(f"{m}_norm", norm)
        total = total + F.col(f"{m}_norm")
    df = df.withColumn("ensemble_score", total / len(measures))
    out = df.select("feature", *measures, *[f"{m}_norm" for m in measures], "ensemble_score")
    out = out.orderBy(F.desc("ensemble_score"), "feature")
    return out.limit(top) if top else out


def readiness(cv_auc: float, cv_test_gap: float, samples: int, features: int, sweep: DataFrame) -> DataFrame:
    """Checklist rows (check, passed) before a model is used."""
    profitable = sweep.agg(F.coalesce(F.bool_or(F.col("expected_value") > 0), F.lit(False)).alias("p"))
    checks = F.array(
        F.struct(F.lit("model_performance").alias("check"), F.lit(cv_auc >= 0.75).alias("passed")),
        F.struct(F.lit("generalization").alias("check"), F.lit(cv_test_gap <= 0.05).alias("passed")),
        F.struct(F.lit("training_size").alias("check"), F.lit(samples >= 1000).alias("passed")),
        F.struct(F.lit("feature_count").alias("check"), F.lit(features >= 10).alias("passed")),
        F.struct(F.lit("profitable_threshold").alias("check"), F.col("p").alias("passed")),
    )
    return profitable.select(F.inline(checks))
