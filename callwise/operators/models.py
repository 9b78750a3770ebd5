"""Classifiers over ``features`` / ``label``: fitting, scoring, saving, comparing."""

from __future__ import annotations

import json
import logging
import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwise.config import DEFAULTS
from callwise.functions import probabilities as P
from callwise.functions.sqltext import name
from callwise.operators import trees
from callwise.operators.evaluation import eval_summary

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Fitted:
    """A fitted classifier: a model of Spark's, an ensemble of trees, or a majority class."""

    name: str
    labels: tuple[str, ...]
    model: LogisticRegressionModel | trees.Ensemble | None = None
    majority: int | None = None

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``proba``, an array of doubles along ``labels``."""
        if self.majority is not None:
            sure = ", ".join("1D" if i == self.majority else "0D" for i in range(len(self.labels)))
            return df.withColumn("proba", F.expr(f"array({sure})"))
        if isinstance(self.model, trees.Ensemble):
            return self.model.score(df)
        # Only the probability is computed; the two other outputs are switched off.
        quiet = self.model.copy().setProbabilityCol("__v").setRawPredictionCol("").setPredictionCol("")
        return quiet.transform(df).withColumn("proba", vector_to_array("__v")).select(*df.columns, "proba")

    def predict(self, df: DataFrame) -> DataFrame:
        """Add label, confidence and probability map; input columns stay."""
        return self.score(df).selectExpr(
            *map(name, df.columns), f"{P.predicted_label(self.labels)} AS predicted_next_step",
            f"{P.confidence()} AS confidence", f"{P.probability_map(self.labels)} AS probabilities")


def fit_majority(df: DataFrame, labels: Sequence[str]) -> Fitted:
    row = df.groupBy("label").count().orderBy(F.desc("count"), "label").first()
    return Fitted("dummy_most_frequent", tuple(labels), majority=int(row["label"]))


def fit_logistic(df: DataFrame, labels: Sequence[str], c: float = 1.0, max_iter: int = 1000) -> Fitted:
    """L2-penalised multinomial regression; ``c`` is the inverse penalty on the summed loss."""
    lr = LogisticRegression(family="multinomial", maxIter=max_iter, regParam=1.0 / (c * df.count()),
                            elasticNetParam=0.0, standardization=False)
    return Fitted("logistic_regression", tuple(labels), lr.fit(df))


def _fit_trees(df: DataFrame, labels: Sequence[str], spec: trees.Spec, name: str) -> Fitted:
    nodes = trees.fit(trees.bin_table(df, len(labels)), [spec])
    return Fitted(name, tuple(labels), trees.Ensemble(spec.kind, len(labels), nodes))


def forest_spec(n_estimators: int = 100, max_depth: int | None = None, min_samples_leaf: int = 1, min_samples_split: int = 2,
                max_features: str | None = "sqrt", seed: int = DEFAULTS.seed) -> trees.Spec:
    return trees.Spec("forest", n_estimators, max_depth, seed, min_samples_leaf=min_samples_leaf,
                      min_samples_split=min_samples_split, max_features=max_features)


def fit_forest(df: DataFrame, labels: Sequence[str], **params) -> Fitted:
    """Random forest on bootstrapped rows; parameters are those of ``forest_spec``."""
    return _fit_trees(df, labels, forest_spec(**params), "random_forest")


def boosted_spec(n_estimators: int = 300, max_depth: int = 6, learning_rate: float = 0.1, subsample: float = 0.8,
                 colsample_bytree: float = 0.8, min_child_weight: float = 3, seed: int = DEFAULTS.seed) -> trees.Spec:
    return trees.Spec("boost", n_estimators, max_depth, seed, learning_rate=learning_rate, subsample=subsample,
                      colsample_bytree=colsample_bytree, min_child_weight=min_child_weight)


def fit_boosted(df: DataFrame, labels: Sequence[str], name: str = "gradient_boosting", **params) -> Fitted:
    """Boosted trees on the softmax loss, a tree per class and round; parameters are those of ``boosted_spec``."""
    return _fit_trees(df, labels, boosted_spec(**params), name)


def spec_of(fit: Callable) -> trees.Spec | None:
    """What a fit function with its bound parameters grows; None if it grows no trees."""
    given = dict(fit.keywords) if isinstance(fit, partial) else {}
    given.pop("name", None)
    make = {fit_forest: forest_spec, fit_boosted: boosted_spec}.get(fit.func if isinstance(fit, partial) else fit)
    return make(**given) if make else None


Fit = Callable[[DataFrame, Sequence[str]], Fitted]


def model_set(booster: dict | None = None, forest: dict | None = None,
              logistic: dict | None = None, second_booster: dict | None = None) -> dict[str, Fit]:
    """The five classifiers under comparison, by name; arguments override their parameters."""
    second = {"n_estimators": 100, "max_depth": 5, "subsample": 1.0, "colsample_bytree": 1.0,
              "min_child_weight": 20}
    return {
        "dummy_most_frequent": fit_majority,
        "logistic_regression": partial(fit_logistic, **(logistic or {})),
        "random_forest": partial(fit_forest, **(forest or {})),
        "gradient_boosting": partial(fit_boosted, **{**DEFAULTS.booster, **(booster or {})}),
        "gradient_boosting_light": partial(
            fit_boosted, name="gradient_boosting_light", **{**second, **(second_booster or {})}),
    }


def evaluate(fitted: Fitted, df: DataFrame, k: int = 3) -> dict:
    """Headline metrics on rows with a ``label`` code, unrounded, as a plain dict."""
    scored = fitted.score(df.select("features", "label")).selectExpr(
        f"element_at({P.label_array(fitted.labels)}, cast(label AS int) + 1) AS y_true", "proba")
    return eval_summary(scored, fitted.labels, k, digits=12).first().asDict()


def fold_scores(fits: Sequence[Fit], data: DataFrame, labels: Sequence[str], k: int = DEFAULTS.folds,
                metric: str = "f1_weighted") -> list[list[float]]:
    """The metric of every tree ensemble on every fold; the table is binned once and all ensembles share its passes.

    Cuts come from the features of all folds; labels of a fold are never seen by the ensembles that leave
    it out. A fold without rows scores 0.
    """
    table = trees.bin_table(data, len(labels))
    specs = [replace(spec_of(f), fold=i) for f in fits for i in range(k)]
    code = P.label_array(labels)
    scored = trees.held_out(table, specs).selectExpr("model", f"element_at({code}, label + 1) AS y_true", "proba")
    found = {r["model"]: r[metric] for r in eval_summary(scored, labels, digits=12, by=["model"]).collect()}
    return [[found.get(f * k + i, 0.0) for i in range(k)] for f in range(len(fits))]


def cross_validate(fit: Fit, data: DataFrame, labels: Sequence[str], k: int = DEFAULTS.folds,
                   metric: str = "f1_weighted", parallelism: int = 5) -> list[float]:
    """The metric on each of the ``k`` folds of column ``fold``.

    Tree ensembles share one binned table. For other models all folds filter one persisted table rather than keep a copy of the training
    rows per fold. A failed fold is logged and scores NaN; the other folds keep their scores.
    """
    if spec_of(fit):
        return fold_scores([fit], data, labels, k, metric)[0]

    def one(i: int) -> float:
        try:
            fitted = fit(data.where(F.col("fold") != i), labels)
            return evaluate(fitted, data.where(F.col("fold") == i))[metric]
        except Exception:  # noqa: BLE001
            log.exception("fold %d failed", i)
            return math.nan

    with ThreadPool(min(parallelism, k)) as pool:
        return pool.map(inheritable_thread_target(data.sparkSession)(one), range(k))


def mean_std(scores: Sequence[float]) -> tuple[float, float]:
    mean = sum(scores) / len(scores)
    return mean, math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))


COMPARISON_SCHEMA = (
    "model_name string, cv_f1_mean double, cv_f1_std double, accuracy double, f1_macro double, "
    "f1_weighted double, precision_macro double, precision_weighted double, recall_macro double, "
    "recall_weighted double, top3_accuracy double, brier_score_avg double, fit_time_s double, "
    "predict_time_s double")


def compare_models(train: DataFrame, test: DataFrame, labels: Sequence[str],
                   models: dict[str, Fit] | None = None, k: int = DEFAULTS.folds,
                   metric: str = "f1_weighted") -> DataFrame:
    """One row per classifier, best weighted F1 first.

    ``train`` needs ``features``, ``label`` and ``fold``; ``test`` the first two.
    """
    train, test = train.persist(StorageLevel.MEMORY_AND_DISK), test.persist(StorageLevel.MEMORY_AND_DISK)
    counts = train.groupBy("label").count().agg(F.sum("count"), F.min("count")).first()
    enough = counts[0] >= 2 * k and counts[1] >= 2
    models, rows = models or model_set(), []
    grown = [name for name, fit in models.items() if spec_of(fit)]
    # The folds of all tree ensembles share the passes over one binned table.
    known = dict(zip(grown, fold_scores([models[name] for name in grown], train, labels, k, metric))) if enough and grown else {}
    for name, fit in models.items():
        mean, std = mean_std(known.get(name) or cross_validate(fit, train, labels, k, metric)) if enough else (math.nan,) * 2
        t0 = time.perf_counter()
        fitted = fit(train, labels)
        t1 = time.perf_counter()
        m = evaluate(fitted, test)
        t2 = time.perf_counter()
        rows.append((name, round(mean, 4), round(std, 4), *[round(m[c], 4) for c in (
            "accuracy", "f1_macro", "f1_weighted", "precision_macro", "precision_weighted",
            "recall_macro", "recall_weighted", "top3_accuracy", "brier_score_avg")],
            round(t1 - t0, 2), round(t2 - t1, 3)))
    train.unpersist()
    test.unpersist()
    return train.sparkSession.createDataFrame(rows, COMPARISON_SCHEMA).orderBy(
        F.desc("f1_weighted"), "model_name")


def feature_importance(fitted: Fitted, names: Sequence[str], spark: SparkSession, top: int = 30) -> DataFrame:
    """The ``top`` features of an ensemble by importance; features that no split uses have 0."""
    rows = spark.createDataFrame([(i, n, n.startswith("emb_")) for i, n in enumerate(names)], "i int, feature string, is_embedding boolean")
    worth = fitted.model.importance().withColumnRenamed("feature", "_i")
    return rows.join(worth, F.col("i") == F.col("_i"), "left").select(
        "feature", F.coalesce("importance", F.lit(0.0)).alias("importance"), "is_embedding").orderBy(
        F.desc("importance"), "feature").limit(top)


def save(fitted: Fitted, path: str, spark: SparkSession, features: PipelineModel | None = None,
         info: dict | None = None) -> None:
    """Feature pipeline, model and labels under one folder."""
    kind = None
    if isinstance(fitted.model, trees.Ensemble):
        kind = fitted.model.kind
        fitted.model.nodes.write.mode("overwrite").parquet(f"{path}/model")
    elif fitted.model is not None:
        kind = "logistic"
        fitted.model.write().overwrite().save(f"{path}/model")
    if features is not None:
        features.write().overwrite().save(f"{path}/features")
    meta = {"name": fitted.name, "labels": list(fitted.labels), "majority": fitted.majority, "kind": kind,
            "features": features is not None, "info": info or {}}
    spark.createDataFrame([(json.dumps(meta, ensure_ascii=False),)], "value string").coalesce(1).write.mode(
        "overwrite").text(f"{path}/metadata")


def load(path: str, spark: SparkSession) -> tuple[Fitted, PipelineModel | None, dict]:
    meta = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    labels, model = tuple(meta["labels"]), None
    if meta["kind"] == "logistic":
        model = LogisticRegressionModel.load(f"{path}/model")
    elif meta["kind"]:
        model = trees.Ensemble(meta["kind"], len(labels), spark.read.schema(trees.NODE_SCHEMA).parquet(f"{path}/model"))
    features = PipelineModel.load(f"{path}/features") if meta["features"] else None
    return Fitted(meta["name"], labels, model, meta["majority"]), features, meta["info"]
