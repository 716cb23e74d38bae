"""Training, search, calibration and ensembles on Spark MLlib."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, functions as F

from windowlab.functions.expressions import dbl
from windowlab.functions.hashing import order_key, uniform
from windowlab.operators.splits import stratified_folds
from windowlab.session import stored

FEATURES, LABEL = "features", "label"


def assemble(df: DataFrame, features: Sequence[str], label: str = LABEL) -> DataFrame:
    """Feature vector at the edge to MLlib; everything else stays plain columns."""
    out = VectorAssembler(inputCols=list(features), outputCol=FEATURES).transform(df)
    return out.withColumn(LABEL, F.col(label).cast("double"))


# ---- estimators ------------------------------------------------------------------

def logistic(c: float = 1.0, n_rows: int | None = None, max_iter: int = 100) -> LogisticRegression:
    """L2 logistic regression; C is turned into MLlib's per-row penalty 1/(C n)."""
    reg = 1.0 / (c * n_rows) if n_rows else 0.0
    return LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, regParam=reg, elasticNetParam=0.0, maxIter=max_iter, standardization=False)


def random_forest(trees: int = 20, depth: int = 5, seed: int = 42, features: str = "sqrt", sample: float = 1.0, bins: int = 32) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL, numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy=features, subsamplingRate=sample, maxBins=bins)


def extra_trees(trees: int = 20, depth: int = 5, seed: int = 42) -> RandomForestClassifier:
    """Forest on all rows per tree with few candidate cuts, the nearest Spark has to fully random cuts."""
    return RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL, numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", bootstrap=False, maxBins=8)


def boosted(iterations: int = 20, depth: int = 4, step: float = 0.1, sample: float = 1.0, seed: int = 42) -> GBTClassifier:
    return GBTClassifier(featuresCol=FEATURES, labelCol=LABEL, maxIter=iterations, maxDepth=depth, stepSize=step, subsamplingRate=sample, seed=seed)


def bagged_trees(trees: int = 20, depth: int = 8, features: float = 0.8, sample: float = 0.8, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL, numTrees=trees, maxDepth=depth, featureSubsetStrategy=str(features), subsamplingRate=sample, seed=seed)


def margin(c: float = 1.0, n_rows: int | None = None, max_iter: int = 50) -> LinearSVC:
    reg = 1.0 / (c * n_rows) if n_rows else 0.0
    return LinearSVC(featuresCol=FEATURES, labelCol=LABEL, regParam=reg, maxIter=max_iter)


# Parameter names of the boosting and tree families -> (MLlib parameter, conversion).
PARAM_MAP = {
    "n_estimators": {"gbt": "maxIter", "rf": "numTrees"},
    "iterations": {"gbt": "maxIter"},
    "max_depth": {"gbt": "maxDepth", "rf": "maxDepth"},
    "depth": {"gbt": "maxDepth"},
    "learning_rate": {"gbt": "stepSize"},
    "subsample": {"gbt": "subsamplingRate", "rf": "subsamplingRate"},
    "max_samples": {"rf": "subsamplingRate"},
    "max_features": {"rf": "featureSubsetStrategy"},
    "colsample_bytree": {"gbt": "featureSubsetStrategy"},
    "min_samples_leaf": {"gbt": "minInstancesPerNode", "rf": "minInstancesPerNode"},
    "min_child_samples": {"gbt": "minInstancesPerNode"},
    "border_count": {"gbt": "maxBins"},
}
MAX_DEPTH = 30  # MLlib's limit


def mapped_params(params: dict, kind: str, without_counterpart: Sequence[str] = (), open_depth: int | None = None) -> dict:
    """Tuned parameters of another library in MLlib's names.

    A parameter that MLlib has no counterpart for is an error unless ``without_counterpart`` names it; so is an open-ended
    depth unless ``open_depth`` says which depth stands for it (MLlib's largest is ``MAX_DEPTH``).
    """
    out = {}
    for name, value in params.items():
        target = PARAM_MAP.get(name, {}).get(kind)
        if target is None:
            if name not in without_counterpart:
                raise ValueError(f"parameter {name} has no counterpart for {kind}")
            continue
        if target == "maxDepth" and (value is None or value == -1):
            if open_depth is None:
                raise ValueError("an open-ended depth needs open_depth")
            value = open_depth
        if target == "featureSubsetStrategy":
            value = str(value)
        out[target] = value
    return out


def build(name: str, n_rows: int, without_counterpart: Sequence[str] = (), open_depth: int | None = None, **params) -> Estimator:
    """Estimator of a model name with tuned parameters applied; see ``mapped_params`` for what it refuses."""
    small = dict(params)
    c = float(small.pop("C", 1.0))
    if name == "logisticregression":
        return logistic(c, n_rows)
    if name == "svm":
        return margin(c, n_rows)
    made = {
        "randomforest": (random_forest, "rf"), "extratrees": (extra_trees, "rf"), "bagging_rf": (bagged_trees, "rf"),
        "gradientboosting": (boosted, "gbt"), "xgboost": (boosted, "gbt"), "lightgbm": (boosted, "gbt"), "catboost": (boosted, "gbt"),
    }
    if name not in made:
        raise ValueError(f"unknown model {name}")
    factory, kind = made[name]
    return factory().setParams(**mapped_params(small, kind, without_counterpart, open_depth))


def score_column(predictions: DataFrame) -> tuple[Column, str]:
    """Score by capability: probability, else decision value, else hard label."""
    if "probability" in predictions.columns:
        return vector_to_array("probability")[1], "proba"
    if "rawPrediction" in predictions.columns:
        return vector_to_array("rawPrediction")[1], "decision"
    return F.col("prediction").cast("double"), "hard"


def scored(model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Kept columns with ``score`` and ``score_type``."""
    p = model.transform(df)
    s, kind = score_column(p)
    return p.select(*keep, s.alias("score"), F.lit(kind).alias("score_type"))


# ---- ridge on +-1 ------------------------------------------------------------------

def fit_ridge(df: DataFrame, alpha: float, n_rows: int):
    """Least squares on +-1 labels with L2 penalty; the prediction is the decision score.

    MLlib minimises half the mean squared error of the label divided by its standard deviation, so
    the penalty that equals ``alpha`` on the sum of squares is alpha/n times that deviation.
    """
    train = df.withColumn("_t", F.lit(2.0) * F.col(LABEL) - F.lit(1.0))
    spread = train.agg(F.stddev_pop("_t")).first()[0] or 1.0
    lr = LinearRegression(featuresCol=FEATURES, labelCol="_t", solver="normal", regParam=alpha / n_rows * spread, elasticNetParam=0.0, standardization=False)
    return lr.fit(train)


def linear_score(model, features: Sequence[str]) -> Column:
    """The decision score of a linear model as a plain column expression."""
    w = model.coefficients.toArray()
    return sum((dbl(float(c)) * F.col(f) for c, f in zip(w, features)), dbl(model.intercept))


def ridge_scored(model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return model.transform(df).select(*keep, F.col("prediction").alias("score"), F.lit("decision").alias("score_type"))


# ---- AdaBoost -------------------------------------------------------------------------

def fit_adaboost(df: DataFrame, rounds: int, depth: int = 1, learning_rate: float = 1.0, seed: int = 42, key: str = "row_key") -> list[tuple[float, object]]:
    """Discrete two-class AdaBoost: [(alpha, tree)].

    A row's weight is exp(sum of alpha over the trees that got it wrong), so it is one column over the
    unchanged training table; the table is written once and each round reads it.  No lineage builds up.
    """
    base = stored(df.select(key, FEATURES, LABEL), "boost")
    ensemble: list[tuple[float, object]] = []
    for r in range(rounds):
        w = base.withColumn("_e", dbl(0))
        for i, (alpha, tree) in enumerate(ensemble):
            p = tree.copy().setPredictionCol(f"_p{i}").setRawPredictionCol("").setProbabilityCol("")
            w = p.transform(w).withColumn("_e", F.col("_e") + F.when(F.col(f"_p{i}") != F.col(LABEL), dbl(alpha)).otherwise(dbl(0))).drop(f"_p{i}")
        w = w.withColumn("_w", F.exp("_e")).drop("_e")
        tree = DecisionTreeClassifier(featuresCol=FEATURES, labelCol=LABEL, weightCol="_w", maxDepth=depth, seed=seed + r).fit(w)
        err = tree.transform(w).agg(
            (F.sum(F.when(F.col("prediction") != F.col(LABEL), F.col("_w")).otherwise(dbl(0))) / F.sum("_w")).alias("e")
        ).first()["e"]
        if err >= 0.5:
            break
        if err <= 0:
            ensemble.append((1.0, tree))
            break
        ensemble.append((learning_rate * math.log((1.0 - err) / err), tree))
    return ensemble


def adaboost_scored(ensemble: list[tuple[float, object]], df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Weighted vote in [-1, 1] as decision score."""
    out = df.withColumn("score", dbl(0))
    for i, (alpha, tree) in enumerate(ensemble):
        p = tree.copy().setPredictionCol(f"_p{i}").setRawPredictionCol("").setProbabilityCol("")
        out = p.transform(out).withColumn("score", F.col("score") + dbl(alpha) * (F.lit(2.0) * F.col(f"_p{i}") - F.lit(1.0))).drop(f"_p{i}")
    total = sum(a for a, _ in ensemble) or 1.0
    return out.select(*keep, (F.col("score") / dbl(total)).alias("score"), F.lit("decision").alias("score_type"))


def fit_bagged_forests(df: DataFrame, forests: int, trees: int, depth: int, sample: float, seed: int = 42, key: str = "row_key") -> list:
    """Bagging of extra-tree forests: each forest sees a hashed share of the rows."""
    models = []
    for i in range(forests):
        part = df.where(uniform(order_key(seed + i, key)) < sample)
        models.append(extra_trees(trees, depth, seed + i).fit(part))
    return models


def mean_probability(models: Sequence, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Mean of the models' probabilities, one pass over the rows."""
    out = df.withColumn("score", dbl(0))
    for i, m in enumerate(models):
        c = m.copy().setProbabilityCol(f"_b{i}").setPredictionCol("").setRawPredictionCol("")
        out = c.transform(out).withColumn("score", F.col("score") + vector_to_array(f"_b{i}")[1]).drop(f"_b{i}")
    return out.select(*keep, (F.col("score") / dbl(len(models))).alias("score"), F.lit("proba").alias("score_type"))


def random_fourier(features: Sequence[str], gamma: float, n: int, seed: int = 42) -> dict[str, Column]:
    """Columns cos(w x + b) that let a linear margin act like one with a Gaussian kernel."""
    import numpy as np

    rng = np.random.default_rng(seed)
    w, b = rng.normal(0.0, math.sqrt(2 * gamma), (n, len(features))), rng.uniform(0, 2 * math.pi, n)
    scale = math.sqrt(2.0 / n)
    return {
        f"rff_{i}": dbl(scale) * F.cos(sum((dbl(w[i, j]) * F.col(f) for j, f in enumerate(features)), dbl(b[i])))
        for i in range(n)
    }


# ---- calibration ------------------------------------------------------------------------

def fit_isotonic(df: DataFrame, score: str, y: str):
    """Isotonic curve of label on score.

    Rows are pooled per distinct score first (mean label, row count as weight); the fit then runs on
    the distinct scores, which gives the same curve.
    """
    pooled = df.groupBy(score).agg(F.avg(F.col(y).cast("double")).alias("_l"), F.count(F.lit(1)).cast("double").alias("_w"))
    return IsotonicRegression(featuresCol=score, labelCol="_l", weightCol="_w", isotonic=True).fit(pooled)


def isotonic_scored(model, df: DataFrame, score: str, out: str = "calibrated") -> DataFrame:
    """Calibrated score: the curve is linear between its knots and flat outside."""
    m = model.copy().setFeaturesCol(score).setPredictionCol(out)
    return m.transform(df)


def calibrate(df: DataFrame, apply_to: DataFrame, fit_score: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], y: str, strata: Sequence[str], key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """k-fold isotonic calibration: per fold a model on the other folds, a curve on the held-out fold; mean of the curves.

    ``fit_score(train)`` returns a function that adds ``score`` to a table.
    """
    d = stored(stratified_folds(df, strata, key, seed, k=folds), "folds")
    out = apply_to.withColumn("calibrated", dbl(0))
    for k in range(folds):
        add = fit_score(d.where(F.col("fold") != k))
        curve = fit_isotonic(add(d.where(F.col("fold") == k)), "score", y)
        out = isotonic_scored(curve, add(out), "score", "_c").withColumn("calibrated", F.col("calibrated") + F.col("_c") / folds).drop("score", "_c")
    return out


# ---- ensembles ----------------------------------------------------------------------------

def soft_vote(df: DataFrame, keys: Sequence[str], score: str, y: str, model: str, n_models: int = 10) -> DataFrame:
    """Mean score of the first ``n_models`` models (by name) per row of a long score table."""
    names = F.slice(F.array_sort(F.collect_list(F.struct(F.col(model).alias("m"), F.col(score).alias("s")))), 1, n_models)
    g = df.groupBy(*keys).agg(names.alias("_s"), F.max(y).alias(y))  # one entry per model
    return g.select(*keys, (F.aggregate("_s", dbl(0), lambda a, x: a + x["s"]) / F.size("_s")).alias("vote"), y)


def stack(train: DataFrame, test: DataFrame, bases: dict[str, Estimator], fold: str, keep: Sequence[str], min_bases: int = 3, c: float = 1.0) -> tuple[DataFrame, object]:
    """Out-of-fold probabilities of the bases feed an L2 logistic meta model; returns scored test rows and the meta model.

    Bases must give probabilities.  ``train`` has a fold column (grouped folds keep runs together).
    Out-of-fold rows are written once, because the meta fit reads them many times.
    """
    usable = {n: e for n, e in bases.items() if e.hasParam("probabilityCol")}
    if len(usable) < min_bases:
        raise ValueError(f"stacking needs at least {min_bases} probability models, got {len(usable)}")
    names = sorted(usable)
    folds = [r[0] for r in train.select(fold).distinct().collect()]

    def score_all(models: dict, df: DataFrame) -> DataFrame:
        for n in names:
            m = models[n].copy().setProbabilityCol(f"_b_{n}").setPredictionCol("").setRawPredictionCol("")
            df = m.transform(df).withColumn(f"p_{n}", vector_to_array(f"_b_{n}")[1]).drop(f"_b_{n}")
        return df

    parts = None
    for k in folds:
        rest = train.where(F.col(fold) != k)
        part = score_all({n: usable[n].fit(rest) for n in names}, train.where(F.col(fold) == k))
        part = part.select(*keep, LABEL, *[f"p_{n}" for n in names])
        parts = part if parts is None else parts.unionByName(part)
    oof = stored(parts, "oof")
    meta_in = VectorAssembler(inputCols=[f"p_{n}" for n in names], outputCol="_meta")
    n_rows = oof.count()
    meta = LogisticRegression(featuresCol="_meta", labelCol=LABEL, regParam=1.0 / (c * n_rows), standardization=False).fit(meta_in.transform(oof))
    full = {n: usable[n].fit(train) for n in names}
    out = meta.transform(meta_in.transform(score_all(full, test)))
    return out.select(*keep, LABEL, vector_to_array("probability")[1].alias("score")), meta


# ---- search ---------------------------------------------------------------------------------

def combinations(space: dict[str, list], limit: int | None = None, seed: int = 42) -> list[dict]:
    """All parameter combinations, or ``limit`` of them in hash order."""
    names = sorted(space)
    combos = [dict(zip(names, v)) for v in itertools.product(*(space[n] for n in names))]
    if limit is not None and limit < len(combos):
        combos = sorted(combos, key=lambda c: hashlib.md5(f"{seed}|{sorted(c.items(), key=str)}".encode()).hexdigest())[:limit]
    return combos


def search(df: DataFrame, estimator: Estimator, space: dict[str, list], fold: str, limit: int | None = None, parallelism: int = 2, seed: int = 42):
    """Cross-validated grid or randomised search on accuracy with a fold column; returns (model, [(params, mean_cv)])."""
    combos = combinations(space, limit, seed)
    grid = [{estimator.getParam(k): v for k, v in c.items()} for c in combos]
    k = df.agg(F.max(fold)).first()[0] + 1
    cv = CrossValidator(
        estimator=estimator, estimatorParamMaps=grid, numFolds=k, foldCol=fold, parallelism=parallelism,
        evaluator=MulticlassClassificationEvaluator(labelCol=LABEL, metricName="accuracy"),
    ).fit(df)
    return cv.bestModel, list(zip(combos, cv.avgMetrics))


def importances(model, features: Sequence[str], spark) -> DataFrame:
    """Impurity importances of a fitted tree ensemble as rows; one row per feature."""
    v = model.featureImportances.toArray()
    return spark.createDataFrame([(f, float(x)) for f, x in zip(features, v)], "feature string, importance double")
