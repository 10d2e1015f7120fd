"""Training, search, cross-validation and scoring with MLlib."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from barloom.operators.clean import align_features
from barloom.operators.evaluate import auc_by_model
from barloom.operators.order_stats import hash_cuts, hash_rank_key, within_thresholds
from barloom.operators.prepare import take_sample


def model_families(size: str = "full", seed: int = 42) -> dict:
    """Three boosted or bagged tree families; 'small' keeps trial runs short."""
    small = size == "small"
    return {
        "boosted_tuned": GBTClassifier(
            maxIter=5 if small else 100, maxDepth=3 if small else 5, stepSize=0.1, subsamplingRate=0.8, seed=seed
        ),
        "boosted": GBTClassifier(
            maxIter=5 if small else 50, maxDepth=3 if small else 6, stepSize=0.1, minInstancesPerNode=10, seed=seed
        ),
        "forest": RandomForestClassifier(
            numTrees=10 if small else 200, maxDepth=4 if small else 6, minInstancesPerNode=10, seed=seed
        ),
    }


def assemble(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """The two columns MLlib needs, gaps as 0.0."""
    filled = df.select(
        F.col(label).cast("double").alias("label"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features],
        *[F.col(c) for c in df.columns if c not in features and c != label],
    )
    return VectorAssembler(inputCols=features, outputCol="features").transform(filled)


def pipeline(features: list[str], estimator) -> Pipeline:
    return Pipeline(
        stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), estimator]
    )


def train_models(train: DataFrame, features: list[str], label: str, families: dict) -> dict[str, PipelineModel]:
    data = train.select(F.col(label).cast("double").alias("label"), *[F.col(c).cast("double") for c in features])
    data = data.na.fill(0.0).persist()
    try:
        return {name: pipeline(features, est).fit(data) for name, est in families.items()}
    finally:
        data.unpersist()


def score(model: PipelineModel, df: DataFrame, features: list[str], threshold: float = 0.5) -> DataFrame:
    """Adds prediction, probability and threshold; features are aligned to the model's list first."""
    aligned = align_features(df, features)
    out = model.transform(aligned)
    probability = vector_to_array("probability")[1]
    return out.select(
        *aligned.columns,
        (probability >= threshold).cast("int").alias("prediction"),
        probability.alias("probability"),
        F.lit(float(threshold)).alias("threshold"),
    )


def scorer(model: PipelineModel, features: list[str], threshold: float = 0.5) -> Callable[[DataFrame], DataFrame]:
    """A fitted pipeline as the scorer of the live screen: adds prediction and probability to rows of features.

    Features that a row's table lacks are aligned as in training, and rows keep their other columns.
    """
    return lambda rows: score(model, rows, features, threshold)


def score_all(models: dict[str, PipelineModel], df: DataFrame, features: list[str], keys: list[str], label: str) -> DataFrame:
    """Long table (keys, model, probability, label) over all models."""
    out = None
    for name, model in models.items():
        part = score(model, df, features).select(
            *keys, F.lit(name).alias("model"), "probability", F.col(label).cast("int").alias("label")
        )
        out = part if out is None else out.unionByName(part)
    return out


def importances(models: dict[str, PipelineModel], spark: SparkSession, features: list[str]) -> DataFrame:
    """Long table (feature, model, importance); its size is the feature list, not the data."""
    rows = [
        Row(feature=f, model=name, importance=float(v))
        for name, model in models.items()
        for f, v in zip(features, model.stages[-1].featureImportances.toArray(), strict=True)
    ]
    return spark.createDataFrame(rows, "feature string, model string, importance double")


def with_folds(df: DataFrame, label: str, keys: list[str], folds: int, seed: int = 42) -> DataFrame:
    """Adds fold, 0 to folds - 1: the hashes of a class's keys cut it into parts whose sizes differ by one row at most.
    Rows of one key stay together."""
    key = hash_rank_key(keys, seed)
    cuts = hash_cuts(df, label, lambda g, n: [n * i // folds for i in range(1, folds)], key)
    fold = F.lit(folds - 1)
    for j in reversed(range(folds - 1)):
        fold = F.when(within_thresholds(label, {g: c[j] for g, c in cuts.items()}, key), j).otherwise(fold)
    return df.withColumn("fold", fold)


def cross_validate(
    df: DataFrame, features: list[str], label: str, keys: list[str], families: dict, folds: int = 5, seed: int = 42
) -> DataFrame:
    """(model, mean_auc, std_auc) over k folds."""
    data = assemble(with_folds(df, label, keys, folds, seed).select(label, "fold", *features), features, label)
    data = data.select("label", "features", "fold").persist()
    rows = []
    for name, est in families.items():
        cv = CrossValidator(
            estimator=est, estimatorParamMaps=[{}], evaluator=BinaryClassificationEvaluator(),
            numFolds=folds, foldCol="fold", parallelism=2, seed=seed,
        ).fit(data)
        rows.append(Row(model=name, mean_auc=float(cv.avgMetrics[0]), std_auc=float(cv.stdMetrics[0])))
    data.unpersist()
    return df.sparkSession.createDataFrame(rows, "model string, mean_auc double, std_auc double")


def random_grid(estimator: GBTClassifier, trials: int, seed: int = 42) -> list:
    """Random points over tree count, depth, step and row sample."""
    draw = random.Random(seed)
    return [
        {
            estimator.maxIter: draw.randint(5, 40),
            estimator.maxDepth: draw.randint(2, 6),
            estimator.stepSize: 10 ** draw.uniform(-2, -0.5),
            estimator.subsamplingRate: draw.uniform(0.6, 1.0),
        }
        for _ in range(trials)
    ]


def depth_grid(estimator: GBTClassifier, depths=(2, 3, 4, 5, 6)) -> list:
    return ParamGridBuilder().addGrid(estimator.maxDepth, list(depths)).build()


def search(
    df: DataFrame, features: list[str], label: str, keys: list[str],
    estimator: GBTClassifier | None = None, grid: list | None = None, trials: int = 50, folds: int = 5, seed: int = 42,
):
    """(best parameters by CV AUC, table of trials)."""
    est = estimator or GBTClassifier(seed=seed)
    grid = grid if grid is not None else random_grid(est, trials, seed)
    data = assemble(with_folds(df, label, keys, folds, seed).select(label, "fold", *features), features, label)
    data = data.select("label", "features", "fold").persist()
    cv = CrossValidator(
        estimator=est, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(),
        numFolds=folds, foldCol="fold", parallelism=2, seed=seed,
    ).fit(data)
    data.unpersist()
    rows = [
        Row(trial=i, params=", ".join(f"{p.name}={v}" for p, v in sorted(g.items(), key=lambda t: t[0].name)),
            mean_auc=float(a))
        for i, (g, a) in enumerate(zip(grid, cv.avgMetrics, strict=True))
    ]
    best = max(range(len(grid)), key=lambda i: cv.avgMetrics[i])
    table = df.sparkSession.createDataFrame(rows, "trial int, params string, mean_auc double")
    return {p.name: v for p, v in grid[best].items()}, table


def train_per_symbol(
    df: DataFrame, symbols: list[str], features: list[str], label: str, estimator_factory, test_col: str = "split",
    parallelism: int = 4,
) -> DataFrame:
    """One distributed fit per named symbol: (symbol, rows, auc, status, error), ``parallelism`` fits at a time.

    Rows are counted for all symbols in one pass. A symbol of one class, or whose fit fails, has status Error and says
    why; it does not stop the others. The symbol list is a parameter. For very many symbols see `boosting.fit_all`.
    """
    train_rows = df.filter((F.col(test_col) != "test") & F.col("symbol").isin(symbols))
    seen = {r["symbol"]: r for r in train_rows.groupBy("symbol").agg(F.count("*").alias("n"), F.countDistinct(label).alias("k")).collect()}

    def run(symbol: str) -> Row:
        rows = seen[symbol]["n"] if symbol in seen else 0
        if not rows or seen[symbol]["k"] < 2:
            return Row(symbol=symbol, rows=rows, auc=None, status="Error", error="one class" if rows else "no rows")
        try:
            part = df.filter(F.col("symbol") == symbol)
            model = train_models(part.filter(F.col(test_col) != "test"), features, label, {"m": estimator_factory()})["m"]
            scored = score(model, part.filter(F.col(test_col) == "test"), features).select(
                F.lit("m").alias("model"), "probability", F.col(label).cast("int").alias("label")
            )
            found = auc_by_model(scored).first()
            return Row(symbol=symbol, rows=rows, auc=found["auc"] if found else None, status="Success", error=None)
        except Exception as failure:  # noqa: BLE001  one symbol's failure is its status
            return Row(symbol=symbol, rows=rows, auc=None, status="Error", error=f"{type(failure).__name__}: {failure}")

    with ThreadPoolExecutor(parallelism) as pool:
        rows = list(pool.map(run, symbols))
    return df.sparkSession.createDataFrame(rows, "symbol string, rows long, auc double, status string, error string")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_predictions(scored: DataFrame, path: str, run: str) -> None:
    """Store predictions under the run's name; a run that is repeated replaces its own rows."""
    (
        scored.withColumn("run", F.lit(run)).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)
    )


def sampling_benchmark(
    df: DataFrame, features: list[str], label: str, keys: list[str], strategies, sizes, estimator_factory
) -> DataFrame:
    """AUC on the test split and fit time for every sampling strategy and size."""
    train, test = df.filter("split <> 'test'"), df.filter("split = 'test'")
    rows = []
    for strategy in strategies:
        for size in sizes:
            began = time.monotonic()
            sample = take_sample(train, label, size, keys, strategy)
            model = train_models(sample, features, label, {"m": estimator_factory()})["m"]
            scored = score(model, test, features).select(
                F.lit("m").alias("model"), "probability", F.col(label).cast("int").alias("label")
            )
            found = auc_by_model(scored).first()
            rows.append(
                Row(strategy=strategy, size=size, auc=found["auc"] if found else None,
                    seconds=float(time.monotonic() - began))
            )
    return df.sparkSession.createDataFrame(rows, "strategy string, size int, auc double, seconds double")
