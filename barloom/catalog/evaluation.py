"""Model evaluation over scored tables, and model training on document labels."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.catalog import register
from barloom.catalog.sql_parts import r6, to6
from barloom.operators import boosting
from barloom.operators import evaluate as E
from barloom.operators import models as M
from barloom.operators import prepare
from barloom.session import scratch_path, written_table
from barloom.sources import driver_tables as D

# Scores of two stand-in models over orders; two decimals, so many scores tie.
_RAW_A, _RAW_B = (f"(o_totalprice - floor(o_totalprice / {n}) * {n}) / {n}" for n in (1000, 777))
_A, _B = f"round({_RAW_A}, 2)", f"round({_RAW_B}, 4)"
SCORED = f"""scored AS (
  SELECT 'coarse' AS model, {_A} AS probability, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders
  UNION ALL SELECT 'fine', {_B}, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END FROM orders)"""


def _rounded(expr: str, digits: int) -> Column:
    """A score of at least 0 rounded in doubles, as the SQL does it: Spark's round() goes by the decimal digits printed,
    so 0.145, which is a little less in binary, would become 0.15."""
    scale = F.lit(float(10**digits))
    whole = F.floor(F.expr(expr) * scale)
    return (whole + (F.expr(expr) * scale - whole >= 0.5).cast("int")) / scale


def _coarse() -> Column:
    return _rounded(_RAW_A, 2)


def _fine() -> Column:
    return _rounded(_RAW_B, 4)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = D.table(spark, sf_dir, "orders")
    label = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label")
    a = orders.select(F.lit("coarse").alias("model"), _coarse().alias("probability"), label)
    return a.unionByName(orders.select(F.lit("fine").alias("model"), _fine().alias("probability"), label))


def six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: to6(n) for n in names})


_AUC = """auc AS (
  SELECT model, sum(w) / (sum(p) * sum(n)) AS auc, sum(p) AS positives, sum(n) AS negatives FROM (
    SELECT model, probability, p, n, p * (coalesce(sum(n) OVER (PARTITION BY model ORDER BY probability
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2) AS w FROM (
      SELECT model, probability, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM scored GROUP BY 1, 2))
  GROUP BY 1)"""


@register(
    "auc_rank",
    f"""WITH {SCORED}, ranked AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY probability)
    + (count(*) OVER (PARTITION BY model, probability) - 1) / 2.0 AS r FROM scored)
SELECT model, {r6('''(sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
    / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0))''')} AS auc,
  count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives FROM ranked GROUP BY 1""",
)
def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(E.auc_by_model(scored(spark, sf_dir)), "auc")


@register(
    "auc_missing_scores",
    f"""WITH seen AS (
  SELECT 'coarse' AS model, {_A} AS p, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders WHERE o_orderkey % 5 <> 0
  UNION ALL SELECT 'fine', {_B}, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END FROM orders WHERE o_orderkey % 5 <> 0),
ranked AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0 AS r FROM seen)
SELECT model, {r6('''(sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
    / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0))''')} AS auc,
  count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives FROM ranked GROUP BY 1""",
)
def auc_missing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every fifth order are missing, of every tenth not a number; both have no rank."""
    lost = F.when(F.col("o_orderkey") % 10 == 0, F.lit(float("nan")))
    orders = D.table(spark, sf_dir, "orders")
    label = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label")
    both = [
        orders.select(F.lit(name).alias("model"), F.when(F.col("o_orderkey") % 5 == 0, lost).otherwise(score).alias("probability"), label)
        for name, score in (("coarse", _coarse()), ("fine", _fine()))
    ]
    return six(E.auc_by_model(both[0].unionByName(both[1])), "auc")


@register(
    "best_model",
    f"WITH {SCORED}, {_AUC} SELECT model, {r6('auc')} AS auc FROM auc ORDER BY auc.auc DESC, model DESC LIMIT 1",
)
def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(E.best_by_auc(E.auc_by_model(scored(spark, sf_dir))), "auc")


@register(
    "performance_notes",
    f"""WITH {SCORED}, {_AUC} SELECT model, CASE WHEN auc > 0.7 THEN 'Excellent performance' WHEN auc > 0.6 THEN
  'Good performance' WHEN auc > 0.55 THEN 'Moderate performance' ELSE 'Poor performance - needs improvement' END AS notes FROM auc""",
)
def performance_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.functions.scalars import performance_note

    return E.auc_by_model(scored(spark, sf_dir)).select("model", performance_note("auc").alias("notes"))


@register(
    "roc_curve",
    f"""WITH {SCORED}, c AS (SELECT model, probability, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n
  FROM scored GROUP BY 1, 2)
SELECT model, probability AS threshold,
  {r6('sum(n) OVER d / sum(n) OVER (PARTITION BY model)')} AS fpr, {r6('sum(p) OVER d / sum(p) OVER (PARTITION BY model)')} AS tpr
FROM c WINDOW d AS (PARTITION BY model ORDER BY probability DESC)""",
)
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(E.roc_curve(scored(spark, sf_dir)), "fpr", "tpr")


_CELLS = f"""{SCORED}, cells AS (SELECT model, count(*) FILTER (probability >= 0.5 AND label = 1) AS tp,
  count(*) FILTER (probability >= 0.5 AND label = 0) AS fp, count(*) FILTER (probability < 0.5 AND label = 1) AS fn,
  count(*) FILTER (probability < 0.5 AND label = 0) AS tn FROM scored GROUP BY 1)"""


@register("confusion_counts", f"WITH {_CELLS} SELECT * FROM cells")
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion_counts(scored(spark, sf_dir))


@register(
    "classification_report",
    f"""WITH {_CELLS}, per AS (
  SELECT model, '1' AS class, tp / (tp + fp) AS p, tp / (tp + fn) AS r, tp + fn AS s FROM cells
  UNION ALL SELECT model, '0', tn / (tn + fn), tn / (tn + fp), tn + fp FROM cells),
f AS (SELECT *, 2 * p * r / (p + r) AS f FROM per),
alls AS (SELECT model, class, p, r, f, s FROM f
  UNION ALL SELECT model, 'macro avg', avg(p), avg(r), avg(f), sum(s) FROM f GROUP BY 1
  UNION ALL SELECT model, 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s) FROM f GROUP BY 1
  UNION ALL SELECT model, 'accuracy', (tp + tn) / (tp + tn + fp + fn), (tp + tn) / (tp + tn + fp + fn),
    (tp + tn) / (tp + tn + fp + fn), tp + tn + fp + fn FROM cells)
SELECT model, class, {r6('p')} AS precision, {r6('r')} AS recall, {r6('f')} AS f1, CAST(s AS BIGINT) AS support FROM alls""",
)
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(E.classification_report(scored(spark, sf_dir)), "precision", "recall", "f1")


_GRID = "(VALUES " + ", ".join(f"(CAST({t} AS DOUBLE))" for t in E.threshold_grid()) + ") g(threshold)"
_SWEEP = f"""{SCORED}, cell AS (SELECT model, threshold,
  count(*) FILTER (probability >= threshold AND label = 1) AS tp, count(*) FILTER (probability >= threshold AND label = 0) AS fp,
  count(*) FILTER (probability < threshold AND label = 1) AS fn, count(*) FILTER (probability < threshold AND label = 0) AS tn
  FROM scored, {_GRID} GROUP BY 1, 2),
pr AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM cell WHERE tp + fp > 0),
sweep AS (SELECT model, threshold, tp + fp AS signals, p AS precision, r AS recall, (tp + tn) / (tp + tn + fp + fn) AS accuracy,
  CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1, p AS hit_rate, 2 * p - 1 AS expected_value FROM pr)"""


@register(
    "threshold_sweep",
    f"""WITH {_SWEEP} SELECT model, threshold, signals, {r6('precision')} AS precision, {r6('recall')} AS recall,
  {r6('accuracy')} AS accuracy, {r6('f1')} AS f1, {r6('hit_rate')} AS hit_rate, {r6('expected_value')} AS expected_value FROM sweep""",
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(
        E.threshold_sweep(scored(spark, sf_dir)), "precision", "recall", "accuracy", "f1", "hit_rate", "expected_value"
    )


@register(
    "best_strategies",
    f"""WITH {_SWEEP},
a AS (SELECT DISTINCT ON (model) * FROM sweep ORDER BY model, f1 DESC, threshold),
b AS (SELECT DISTINCT ON (model) * FROM sweep ORDER BY model, expected_value DESC, threshold),
c AS (SELECT DISTINCT ON (model) * FROM sweep WHERE signals BETWEEN 50 AND 1000 OR (signals >= 20 AND NOT EXISTS
  (SELECT 1 FROM sweep z WHERE z.model = sweep.model AND z.signals BETWEEN 50 AND 1000)) ORDER BY model, precision DESC, threshold),
d AS (SELECT model, min(threshold) FILTER (expected_value > 0) AS lo, max(threshold) FILTER (expected_value > 0) AS hi FROM sweep GROUP BY 1)
SELECT a.model, a.threshold AS best_threshold, {r6('a.f1')} AS test_f1, {r6('a.recall')} AS test_recall,
  {r6('a.accuracy')} AS test_accuracy, a.signals AS best_signals, b.threshold AS best_ev_threshold,
  {r6('b.expected_value')} AS best_expected_value, {r6('c.precision')} AS best_precision,
  c.signals AS best_precision_signals, c.threshold AS best_precision_threshold,
  d.lo AS min_profitable_threshold, d.hi AS max_profitable_threshold
FROM a JOIN b USING (model) LEFT JOIN c USING (model) JOIN d USING (model)""",
)
def best_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = E.best_strategies(E.threshold_sweep(scored(spark, sf_dir)))
    return six(best, "test_f1", "test_recall", "test_accuracy", "best_expected_value", "best_precision")


# Importances: revenue per ship year and return flag stands for (feature, model, importance).
_IMPORT = """imp AS (SELECT 'f' || CAST(l_linenumber AS VARCHAR) AS feature, l_returnflag AS model,
  sum(l_quantity) * l_linenumber AS importance FROM lineitem GROUP BY l_linenumber, l_returnflag),
pct AS (SELECT feature, importance / sum(importance) OVER (PARTITION BY model) * 100 AS p FROM imp),
agg AS (SELECT feature, avg(p) AS m, stddev_samp(p) AS s, min(p) AS lo, max(p) AS hi FROM pct GROUP BY 1),
band AS (SELECT avg(m) AS bm, stddev_samp(m) AS bs FROM agg)"""


def importance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = D.table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_linenumber", "l_returnflag").agg(F.sum("l_quantity").alias("q")).select(
        F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("feature"),
        F.col("l_returnflag").alias("model"), (F.col("q") * F.col("l_linenumber")).alias("importance"),
    )


@register(
    "importance_table",
    f"""WITH {_IMPORT} SELECT feature, {r6('m')} AS mean_importance, {r6('s')} AS std_importance, {r6('lo')} AS min_importance,
  {r6('hi')} AS max_importance, {r6('s / m')} AS cv_importance,
  CASE WHEN m > bm + bs THEN 'high' WHEN m < bm - bs THEN 'low' ELSE 'medium' END AS impact FROM agg, band""",
)
def importance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = E.importance_table(importance_rows(spark, sf_dir))
    return six(t, "mean_importance", "std_importance", "min_importance", "max_importance", "cv_importance")


@register(
    "metrics_summary",
    f"""WITH {_SWEEP}, {_AUC}, {_IMPORT}, best AS (SELECT model, auc FROM auc ORDER BY auc.auc DESC, model DESC LIMIT 1),
top AS (SELECT list(feature ORDER BY m DESC, feature) AS t FROM agg),
low AS (SELECT coalesce(string_agg(feature, ', ' ORDER BY feature) FILTER (m < bm - bs), 'None') AS l FROM agg, band),
st AS (SELECT s.* FROM sweep s JOIN best USING (model) ORDER BY f1 DESC, threshold LIMIT 1)
SELECT best.model, {r6('best.auc')} AS test_auc, st.threshold AS best_threshold, {r6('st.f1')} AS test_f1,
  t[1] AS top_feature_1, t[2] AS top_feature_2, t[3] AS top_feature_3, l AS low_impact_features FROM best, top, low, st""",
)
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    strategies = E.best_strategies(E.threshold_sweep(rows)).select("model", "best_threshold", "test_f1")
    out = E.metrics_summary(E.auc_by_model(rows), strategies, E.importance_table(importance_rows(spark, sf_dir)))
    return six(out, "test_auc", "test_f1")


@register(
    "readiness",
    f"""WITH {_SWEEP}, h AS (SELECT CAST(o_orderkey % 2 AS VARCHAR) AS half, {_B} AS p, o_orderstatus = 'F' AS y FROM orders),
k AS (SELECT *, rank() OVER (PARTITION BY half ORDER BY p) + (count(*) OVER (PARTITION BY half, p) - 1) / 2.0 AS r FROM h),
a AS (SELECT half, (sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y)) AS auc FROM k GROUP BY 1)
SELECT 'model_performance' AS "check", max(auc) FILTER (half = '0') >= 0.75 AS passed FROM a
UNION ALL SELECT 'generalization', abs(max(auc) FILTER (half = '0') - max(auc) FILTER (half = '1')) <= 0.05 FROM a
UNION ALL SELECT 'training_size', count(*) >= 1000 FROM orders
UNION ALL SELECT 'feature_count', count(DISTINCT l_linenumber) >= 10 FROM lineitem
UNION ALL SELECT 'profitable_threshold', coalesce(bool_or(expected_value > 0), FALSE) FROM sweep""",
)
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even orders stand for the training half, odd ones for the test; line numbers for features."""
    half = (F.col("o_orderkey") % 2).cast("string").alias("model")
    label = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label")
    orders = D.table(spark, sf_dir, "orders")
    auc = {r["model"]: r["auc"] for r in E.auc_by_model(orders.select(half, _fine().alias("probability"), label)).collect()}
    features = D.table(spark, sf_dir, "lineitem").select("l_linenumber").distinct().count()
    return E.readiness(auc["0"], abs(auc["0"] - auc["1"]), orders.count(), features, E.threshold_sweep(scored(spark, sf_dir)))


# --- training -----------------------------------------------------------------------------------

FEATURES = ["n_chars", "n_words", "n_lines", "digit_share", "upper_share", "mean_word"]


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape features of every labelled document with its quality class; ``lang`` stands for the symbol."""
    docs = D.table(spark, sf_dir, "documents")
    text = F.col("text")
    size = F.greatest(F.length(text), F.lit(1))
    words = F.size(F.split(text, r"\s+"))
    shape = docs.select(
        "doc_id", F.col("lang").alias("symbol"), F.col("n_chars").cast("double").alias("n_chars"),
        words.cast("double").alias("n_words"), F.size(F.split(text, "\n")).cast("double").alias("n_lines"),
        (F.length(F.regexp_replace(text, "[^0-9]", "")) / size).alias("digit_share"),
        (F.length(F.regexp_replace(text, "[^A-Z]", "")) / size).alias("upper_share"),
        (size / words).alias("mean_word"),
    )
    labels = D.table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("buy"))
    return shape.join(labels, "doc_id")


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.stratified_split(document_rows(spark, sf_dir), "buy", ["doc_id"])


def small() -> GBTClassifier:
    return GBTClassifier(maxIter=5, maxDepth=3, seed=42)


def _scored_test(spark: SparkSession, sf_dir: str):
    rows = written_table(split_rows(spark, sf_dir), "split-rows")
    models = M.train_models(rows.filter("split <> 'test'"), FEATURES, "buy", M.model_families("small"))
    return models, M.score_all(models, rows.filter("split = 'test'"), FEATURES, ["doc_id"], "buy")


@register("train_and_score")
def train_and_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tree families: test AUC per model."""
    return six(E.auc_by_model(_scored_test(spark, sf_dir)[1]), "auc")


@register("score_threshold")
def score_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written_table(split_rows(spark, sf_dir), "split-rows")
    model = M.train_models(rows.filter("split <> 'test'"), FEATURES, "buy", {"m": small()})["m"]
    return M.score(model, rows, FEATURES, 0.6).select("doc_id", "split", "prediction", to6("probability").alias("probability"), "threshold")


@register("model_importances")
def model_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    models, _ = _scored_test(spark, sf_dir)
    return E.importance_table(M.importances(models, spark, FEATURES))


@register("cross_validation")
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cross_validate(document_rows(spark, sf_dir), FEATURES, "buy", ["doc_id"], M.model_families("small"), folds=5)


@register("parameter_search")
def parameter_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    est = small()
    _, table = M.search(
        document_rows(spark, sf_dir), FEATURES, "buy", ["doc_id"], est, M.depth_grid(est), folds=3
    )
    return table


_SPLIT = """k AS (SELECT doc_id, lang, quality = 1 AS buy, CAST('0x' || substr(md5('42|' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h
  FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY buy ORDER BY h) AS r, count(*) OVER (PARTITION BY buy) AS n FROM k),
split AS (SELECT doc_id, lang, buy, CASE WHEN r <= ceil(n * 0.15) THEN 'test' WHEN r <= ceil(n * 0.15) + ceil((n - ceil(n * 0.15)) * 0.15) THEN 'val' ELSE 'train' END AS split FROM r)"""


@register(
    "train_per_symbol",
    f"""WITH {_SPLIT} SELECT lang AS symbol, count(*) AS rows, CASE WHEN count(DISTINCT buy) = 2 THEN 'Success' ELSE 'Error' END AS status,
  CASE WHEN count(DISTINCT buy) < 2 THEN 'one class' END AS error, true AS ranked FROM split WHERE split <> 'test' GROUP BY 1 UNION ALL SELECT 'absent', 0, 'Error', 'no rows', true""",
)
def train_per_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit per language and one symbol without rows: rows and status are stated, the AUC only has to be one."""
    rows = written_table(split_rows(spark, sf_dir), "split-rows")
    symbols = sorted(r["symbol"] for r in rows.select("symbol").distinct().collect())  # a handful of languages
    out = M.train_per_symbol(rows, [*symbols, "absent"], FEATURES, "buy", small)
    return out.select("symbol", "rows", "status", "error", F.coalesce(F.col("auc").between(0, 1), F.lit(True)).alias("ranked"))


_STUMP_CUTS = {"l_quantity": [10.0, 20.0, 30.0, 40.0], "l_discount": [0.02, 0.05, 0.08], "l_tax": [0.02, 0.04, 0.06]}
_STUMP_CODES = ", ".join(f"[{i}, {' + '.join(f'CAST({c} > {e} AS INT)' for e in cuts)} + 1]" for i, (c, cuts) in enumerate(_STUMP_CUTS.items()))


@register(
    "boosted_stumps",
    f"""WITH r AS (SELECT CAST(l_linenumber AS VARCHAR) AS symbol, CAST(l_returnflag = 'R' AS INT) AS y, [{_STUMP_CODES}] AS codes FROM lineitem),
b AS (SELECT symbol, count(*) AS n, ln(sum(y) / (count(*) - sum(y))) AS base, avg(y) AS q FROM r GROUP BY 1),
c AS (SELECT symbol, q - y AS g, q * (1 - q) AS h, unnest(codes) AS code FROM r JOIN b USING (symbol)),
k AS (SELECT symbol, code[1] AS feature, code[2] AS bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM c GROUP BY 1, 2, 3),
s AS (SELECT *, sum(g) OVER u AS gl, sum(h) OVER u AS hl, sum(n) OVER u AS nl, sum(g) OVER a AS gt, sum(h) OVER a AS ht, sum(n) OVER a AS nt FROM k
  WINDOW a AS (PARTITION BY symbol, feature), u AS (PARTITION BY symbol, feature ORDER BY bin)),
w AS (SELECT *, round(gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1), 9) AS gain FROM s WHERE nl >= 5 AND nt - nl >= 5),
t AS (SELECT * FROM w WHERE gain > 1e-6 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY gain DESC, feature, bin) = 1)
SELECT symbol, b.n AS rows, round(base, 6) AS base, CAST(feature AS INT) AS feature, CAST(bin AS INT) AS bin, round(gain, 6) AS gain,
  round(-0.3 * gl / (hl + 1), 6) AS low_leaf, round(-0.3 * (gt - gl) / (ht - hl + 1), 6) AS high_leaf FROM t JOIN b USING (symbol)""",
)
def boosted_stumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of one split for every line number: base, best split and leaves."""
    rows = D.table(spark, sf_dir, "lineitem").withColumns({"symbol": F.col("l_linenumber").cast("string"), "returned": (F.col("l_returnflag") == "R").cast("int")})
    models = boosting.fit_all(rows, list(_STUMP_CUTS), "returned", boosting.Boosting(rounds=1, depth=1), cuts=_STUMP_CUTS)
    t = models.withColumn("t", F.get("trees", F.lit(0))).withColumn("s", F.get("t.tree", F.lit(0))).filter("s IS NOT NULL")
    return t.select(
        "symbol", "rows", F.round("base", 6).alias("base"), "s.feature", "s.bin", F.round("s.gain", 6).alias("gain"),
        F.round(F.get("t.leaves", F.lit(1)), 6).alias("low_leaf"), F.round(F.get("t.leaves", F.lit(2)), 6).alias("high_leaf"),
    )


@register("boosted_per_symbol")
def boosted_per_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees of every supplier's line items in one fit: status, rows and test AUC; a third of the items is held out."""
    items = D.table(spark, sf_dir, "lineitem").withColumns(
        {"symbol": F.col("l_suppkey").cast("string"), "returned": (F.col("l_returnflag") == "R").cast("int"),
         "day": F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).cast("double"), "held_out": F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(3)) == 0}
    )
    names = ["day", "l_quantity", "l_extendedprice", "l_discount"]
    p = boosting.Boosting(rounds=5, depth=2, bins=16)
    models = written_table(boosting.fit_all(items.filter("NOT held_out"), names, "returned", p), "boosted-models")
    tested = boosting.score_all(items.filter("held_out").select("symbol", "returned", *names), models, names, p.depth)
    tested = written_table(tested.filter("probability IS NOT NULL").select("symbol", "probability", F.col("returned").alias("label")), "boosted-scores")
    auc = E.auc_by_model(tested, "symbol")
    return models.select("symbol", "status", "rows").join(auc.select("symbol", to6("auc").alias("auc")), "symbol", "left")


@register(
    "stored_predictions",
    f"""WITH {_SPLIT} SELECT doc_id, split, CAST(0.6 AS DOUBLE) AS threshold, true AS consistent, 'nightly' AS run FROM split""",
)
def stored_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted pipeline saved, loaded, applied to all rows and its predictions stored twice under one run."""
    rows = written_table(split_rows(spark, sf_dir), "split-rows")
    fitted = M.train_models(rows.filter("split <> 'test'"), FEATURES, "buy", {"m": small()})["m"]
    path = scratch_path(spark, "model")
    M.save_model(fitted, path)
    sink = scratch_path(spark, "predictions")
    for _ in range(2):
        M.write_predictions(M.score(M.load_model(path), rows, FEATURES, 0.6).select("doc_id", "split", "prediction", "probability", "threshold"), sink, "nightly")
    return spark.read.parquet(sink).select(
        "doc_id", "split", "threshold", ((F.col("probability") >= 0.6).cast("int") == F.col("prediction")).alias("consistent"),
        F.col("run").cast("string").alias("run"),
    )


@register("sampling_benchmark")
def sampling_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_rows(spark, sf_dir).withColumn("ts", F.timestamp_seconds("doc_id"))
    out = M.sampling_benchmark(rows, FEATURES, "buy", ["doc_id"], ["balanced", "stratified", "recent", "diverse"], [200], small)
    return out.select("strategy", "size", to6("auc").alias("auc"))


@register("ensemble_ranking")
def ensemble_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance ratio, mutual information over decile bins and tree importance, combined."""
    rows = written_table(document_rows(spark, sf_dir), "document-rows")
    from barloom.operators.order_stats import exact_ranks

    n = rows.count()
    ranks = exact_ranks(rows, {c: [max(n * i // 10, 1) for i in range(1, 10)] for c in FEATURES})
    cuts = {c: sorted(set(v.values())) for c, v in ranks.items()}
    model = M.train_models(rows, FEATURES, "buy", {"m": small()})
    tree = M.importances(model, spark, FEATURES).select("feature", F.col("importance").alias("tree"))
    scores = E.anova_f(rows, "buy", FEATURES).join(E.mutual_information(rows, "buy", FEATURES, cuts), "feature").join(tree, "feature")
    return E.ensemble_ranking(scores, ["mi_score", "f_score", "tree"], top=20)
