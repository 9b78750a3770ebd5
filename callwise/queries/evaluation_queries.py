"""Splits and the evaluation of a scored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwise.operators import clean, evaluation, split
from callwise.queries import adapters as A
from callwise.queries.adapters import PRIORITIES, SCORED
from callwise.queries.registry import query
from callwise.sources.calls import read_table


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("interaction_id"), F.col("o_orderpriority").alias("next_step"))


@query("stratified_split", "SELECT interaction_id, next_step, split FROM split", "calls quotas split")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return split.stratified_split(labelled(spark, d), "interaction_id", "next_step")


@query("stratified_folds", """
SELECT interaction_id, next_step, CAST(CAST(rn > n // 5 AS INT) + CAST(rn > 2 * n // 5 AS INT)
  + CAST(rn > 3 * n // 5 AS INT) + CAST(rn > 4 * n // 5 AS INT) AS INTEGER) AS fold
FROM (SELECT o_orderkey AS interaction_id, o_orderpriority AS next_step,
        count(*) OVER (PARTITION BY o_orderpriority) AS n, row_number() OVER (PARTITION BY o_orderpriority
          ORDER BY md5('42-' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rn FROM orders)""")
def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    return split.stratified_folds(labelled(spark, d), "interaction_id", "next_step")


@query("predicted_label", "SELECT interaction_id, y_pred, round(top_p, 4) AS confidence FROM predicted", SCORED)
def predicted_label(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.with_prediction(A.scored(spark, d), PRIORITIES).select(
        "interaction_id", "y_pred", "confidence")


@query("probability_map", "SELECT interaction_id, label, round(p, 4) AS probability FROM scored_long", SCORED)
def probability_map(spark: SparkSession, d: str) -> DataFrame:
    from callwise.functions.probabilities import probability_map as as_map

    return A.scored(spark, d).selectExpr(
        "interaction_id", f"explode({as_map(PRIORITIES)}) AS (label, probability)")


@query("probabilities_ranked", """
SELECT interaction_id, CAST(place AS INTEGER) AS place, label, round(p, 4) AS probability FROM ranked""", SCORED)
def probabilities_ranked(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.probabilities_long(A.scored(spark, d), PRIORITIES, "interaction_id")


@query("topk_labels", """
SELECT interaction_id, string_agg(label, ',' ORDER BY place) AS top_labels FROM ranked WHERE place <= 3
GROUP BY interaction_id""", SCORED)
def topk_labels(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.with_top_k(A.scored(spark, d), PRIORITIES).select(
        "interaction_id", F.concat_ws(",", "top_labels").alias("top_labels"))


@query("present_labels", "SELECT y_true AS label FROM predicted UNION SELECT y_pred FROM predicted", SCORED)
def present_labels(spark: SparkSession, d: str) -> DataFrame:
    return clean.present_labels(
        evaluation.with_prediction(A.scored(spark, d), PRIORITIES), "y_true", "y_pred")


SUMMARY = """
SELECT CAST(sum(support) AS BIGINT) AS n_rows, round(sum(tp) / CAST(sum(support) AS DOUBLE), 4) AS accuracy,
  round(avg(f1) FILTER (WHERE support + predicted > 0), 4) AS f1_macro,
  round(sum(f1 * support) / CAST(sum(support) AS DOUBLE), 4) AS f1_weighted,
  round(avg(precision) FILTER (WHERE support + predicted > 0), 4) AS precision_macro,
  round(sum(precision * support) / CAST(sum(support) AS DOUBLE), 4) AS precision_weighted,
  round(avg(recall) FILTER (WHERE support + predicted > 0), 4) AS recall_macro,
  round(sum(recall * support) / CAST(sum(support) AS DOUBLE), 4) AS recall_weighted,
  (SELECT round(avg(hit), 4) FROM predicted) AS top3_accuracy,
  (SELECT round(sum(pow(p - CASE WHEN label = y_true THEN 1 ELSE 0 END, 2))
     / count(DISTINCT interaction_id) / 5, 4) FROM scored_long) AS brier_score_avg
FROM class_table"""


@query("eval_summary", SUMMARY, SCORED + " class_table")
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.eval_summary(A.scored(spark, d), PRIORITIES)


@query("classification_report", """
SELECT label, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support
FROM class_table WHERE support + predicted > 0
UNION ALL SELECT 'accuracy', a, a, a, s FROM (SELECT round(sum(tp) / CAST(sum(support) AS DOUBLE), 4) AS a,
  CAST(sum(support) AS BIGINT) AS s FROM class_table)
UNION ALL SELECT 'macro avg', round(avg(precision) FILTER (WHERE support + predicted > 0), 4),
  round(avg(recall) FILTER (WHERE support + predicted > 0), 4),
  round(avg(f1) FILTER (WHERE support + predicted > 0), 4), CAST(sum(support) AS BIGINT) FROM class_table
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / CAST(sum(support) AS DOUBLE), 4),
  round(sum(recall * support) / CAST(sum(support) AS DOUBLE), 4),
  round(sum(f1 * support) / CAST(sum(support) AS DOUBLE), 4), CAST(sum(support) AS BIGINT) FROM class_table""",
       SCORED + " class_table")
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.classification_report(A.scored(spark, d), PRIORITIES)


@query("per_class_metrics", """
SELECT label, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support
FROM class_table""", SCORED + " class_table")
def per_class_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.per_class_metrics(A.scored(spark, d), PRIORITIES)


@query("topk_accuracy", """
SELECT count(*) AS n_rows, CAST(sum(hit) AS BIGINT) AS hits, round(avg(hit), 4) AS topk_accuracy FROM predicted""",
       SCORED)
def topk_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.topk_accuracy(A.scored(spark, d), PRIORITIES)


@query("brier_scores", """
SELECT label, round(b, 6) AS brier FROM (
  SELECT label, avg(pow(p - CASE WHEN label = y_true THEN 1 ELSE 0 END, 2)) AS b FROM scored_long GROUP BY label
  UNION ALL SELECT '(mean)', avg(pow(p - CASE WHEN label = y_true THEN 1 ELSE 0 END, 2)) FROM scored_long)""", SCORED)
def brier_scores(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.brier_scores(A.scored(spark, d), PRIORITIES)


@query("confusion_matrix", """
SELECT t.label AS y_true, q.label AS y_pred, count(x.interaction_id) AS n,
  round(count(x.interaction_id) / CAST(nullif(any_value(s.n), 0) AS DOUBLE), 4) AS row_share
FROM labels_list t CROSS JOIN labels_list q LEFT JOIN predicted x ON x.y_true = t.label AND x.y_pred = q.label
  LEFT JOIN (SELECT y_true, count(*) AS n FROM predicted GROUP BY 1) s ON s.y_true = t.label
GROUP BY 1, 2""", SCORED)
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion_matrix(A.scored(spark, d), PRIORITIES)


@query("label_distribution_compare", "SELECT label, support AS n_true, predicted AS n_pred FROM class_table",
       SCORED + " class_table")
def label_distribution_compare(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.label_distribution(A.scored(spark, d), PRIORITIES)


@query("calibration_bins", """
SELECT label, bin, n, round(mp, 6) AS mean_predicted, round(fp, 6) AS fraction_positive FROM (
  SELECT label, CAST((SELECT count(*) FROM range(1, 10) e(k) WHERE k * 0.1::DOUBLE < p) AS BIGINT) AS bin,
    count(*) AS n, avg(p) AS mp, avg(CASE WHEN label = y_true THEN 1.0 ELSE 0.0 END) AS fp,
    sum(sum(CASE WHEN label = y_true THEN 1 ELSE 0 END)) OVER (PARTITION BY label) AS pos
  FROM scored_long GROUP BY 1, 2) WHERE pos > 0""", SCORED)
def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.calibration_bins(A.scored(spark, d), PRIORITIES)
