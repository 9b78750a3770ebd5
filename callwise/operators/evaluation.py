"""Evaluation of a scored table: ``y_true`` and ``proba``, an array along sorted labels.

Everything but the reliability bins comes from one aggregate over the rows,
``label_cells``: one row per pair of true and predicted label.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwise.functions import probabilities as P
from callwise.functions.sqltext import text


def with_prediction(scored: DataFrame, labels: Sequence[str]) -> DataFrame:
    return scored.selectExpr("*", f"{P.predicted_label(labels)} AS y_pred", f"{P.confidence()} AS confidence")


def with_top_k(scored: DataFrame, labels: Sequence[str], k: int = 3) -> DataFrame:
    return scored.selectExpr("*", f"{P.top_k_labels(labels, k)} AS top_labels")


def probabilities_long(scored: DataFrame, labels: Sequence[str], key: str) -> DataFrame:
    """One row per scored row and label: place 1 is the best, probability to four decimals."""
    return scored.selectExpr(key, f"posexplode({P.ranked(labels)}) AS (pos, r)").selectExpr(
        key, "pos + 1 AS place", "r.label AS label", "round(r.p, 4) AS probability")


def _squared_error(labels: Sequence[str]) -> list[str]:
    return [f"sum(pow(proba[{i}] - cast(y_true = {text(x)} AS double), 2))" for i, x in enumerate(labels)]


def label_cells(scored: DataFrame, labels: Sequence[str], k: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Per (true, predicted), and group if columns ``by`` are given: rows, top-k hits and summed squared error of each class."""
    rows = scored.selectExpr(*by, "y_true", "proba", f"{P.predicted_label(labels)} AS y_pred",
                             f"cast({P.in_top_k(labels, k)} AS bigint) AS hit")
    return rows.groupBy(*by, "y_true", "y_pred").agg(
        F.expr("count(1)").alias("n"), F.expr("sum(hit)").alias("hits"),
        *[F.expr(e).alias(f"sq{i}") for i, e in enumerate(_squared_error(labels))])


def _label_totals(scored: DataFrame, labels: Sequence[str], k: int, by: Sequence[str] = ()) -> DataFrame:
    """Per class: support, predicted, true positives, hits, squared errors; all of the list unless in groups."""
    cells = label_cells(scored, labels, k, by)
    sq = [f"sq{i}" for i in range(len(labels))]

    def part(label: str, support: str, predicted: str, tp: str, hits: str, errors: Sequence[str]) -> str:
        return (f"struct({label} AS label, cast({support} AS bigint) AS support, "
                f"cast({predicted} AS bigint) AS predicted, cast({tp} AS bigint) AS tp, "
                f"cast({hits} AS bigint) AS hits, {', '.join(f'{e} AS {s}' for e, s in zip(errors, sq))})")

    none = ["0D"] * len(labels)
    parts = [part("y_true", "n", "0", "if(y_true = y_pred, n, 0)", "hits", sq),
             part("y_pred", "0", "n", "0", "0", none)]
    rows = cells.selectExpr(*by, f"inline(array({', '.join(parts)}))")
    if not by:
        listed = [part(text(x), "0", "0", "0", "0", none) for x in labels]
        rows = rows.unionByName(scored.sparkSession.range(1).selectExpr(f"inline(array({', '.join(listed)}))"))
    return rows.groupBy(*by, "label").agg(
        *[F.expr(f"sum({c})").alias(c) for c in ("support", "predicted", "tp", "hits", *sq)])


def _with_scores(totals: DataFrame) -> DataFrame:
    return totals.selectExpr(
        "*", "coalesce(try_divide(tp, predicted), 0D) AS precision",
        "coalesce(try_divide(tp, support), 0D) AS recall",
        "coalesce(try_divide(2 * tp, support + predicted), 0D) AS f1")


SCORES = ("precision", "recall", "f1")
_PRESENT = "support + predicted > 0"


def _macro(c: str) -> str:
    return f"avg({c}) FILTER (WHERE {_PRESENT})"


def _weighted(c: str) -> str:
    return f"coalesce(try_divide(sum({c} * support), sum(support)), 0D)"


_ACCURACY = "coalesce(try_divide(sum(tp), sum(support)), 0D)"


def per_class_metrics(scored: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Precision, recall, F1 and support of every class in the list, 0 where absent."""
    return _with_scores(_label_totals(scored, labels, k=1)).selectExpr(
        "label", *[f"round({c}, 4) AS {c}" for c in SCORES], "support")


def eval_summary(scored: DataFrame, labels: Sequence[str], k: int = 3, digits: int = 4, by: Sequence[str] = ()) -> DataFrame:
    """One row with all headline metrics; one per group of the columns ``by``, if given."""
    total_error = " + ".join(f"sum(sq{i})" for i in range(len(labels)))
    values = {
        "accuracy": _ACCURACY,
        "f1_macro": _macro("f1"), "f1_weighted": _weighted("f1"),
        "precision_macro": _macro("precision"), "precision_weighted": _weighted("precision"),
        "recall_macro": _macro("recall"), "recall_weighted": _weighted("recall"),
        f"top{k}_accuracy": "coalesce(try_divide(sum(hits), sum(support)), 0D)",
        "brier_score_avg": f"coalesce(try_divide({total_error}, sum(support) * {len(labels)}), 0D)",
    }
    return _with_scores(_label_totals(scored, labels, k, by)).groupBy(*by).agg(
        F.expr("sum(support)").alias("n_rows"),
        *[F.expr(f"round({v}, {digits})").alias(n) for n, v in values.items()])


def topk_accuracy(scored: DataFrame, labels: Sequence[str], k: int = 3) -> DataFrame:
    return scored.selectExpr(f"cast({P.in_top_k(labels, k)} AS bigint) AS hit").selectExpr(
        "count(1) AS n_rows", "sum(hit) AS hits", "round(avg(hit), 4) AS topk_accuracy")


def classification_report(scored: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Rows per present class, then accuracy, macro and weighted averages."""
    table = _with_scores(_label_totals(scored, labels, k=1))
    classes = table.where(_PRESENT).selectExpr("label", *[f"round({c}, 4) AS {c}" for c in SCORES], "support")
    averages = table.agg(
        F.expr("sum(support)").alias("support"), F.expr(_ACCURACY).alias("acc"),
        *[F.expr(_macro(c)).alias(f"m_{c}") for c in SCORES],
        *[F.expr(_weighted(c)).alias(f"w_{c}") for c in SCORES])

    def line(title: str, columns: Sequence[str]) -> str:
        values = ", ".join(f"round({v}, 4) AS {c}" for v, c in zip(columns, SCORES))
        return f"struct('{title}' AS label, {values}, support AS support)"

    lines = [line("accuracy", ["acc"] * 3), line("macro avg", [f"m_{c}" for c in SCORES]),
             line("weighted avg", [f"w_{c}" for c in SCORES])]
    return classes.unionByName(averages.selectExpr(f"inline(array({', '.join(lines)}))"))


def brier_scores(scored: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Mean squared error of each class's probability, one against the rest, and their mean."""
    one = scored.agg(F.expr("count(1)").alias("n"),
                     *[F.expr(e).alias(f"sq{i}") for i, e in enumerate(_squared_error(labels))])
    lines = [f"struct({text(x)} AS label, try_divide(sq{i}, n) AS brier)" for i, x in enumerate(labels)]
    total = " + ".join(f"sq{i}" for i in range(len(labels)))
    lines.append(f"struct('(mean)' AS label, try_divide({total}, n * {len(labels)}) AS brier)")
    return one.selectExpr(f"inline(array({', '.join(lines)}))").selectExpr("label", "round(brier, 6) AS brier")


def confusion_matrix(scored: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Every pair of listed classes: count, and share of the true class's rows (null if none)."""
    columns = [f"n{i}" for i in range(len(labels))]
    rows = scored.selectExpr("y_true", f"{P.predicted_label(labels)} AS y_pred")
    counts = rows.groupBy("y_true").agg(*[
        F.expr(f"count_if(y_pred = {text(x)})").alias(c) for c, x in zip(columns, labels)])
    zero = rows.sparkSession.range(1).selectExpr(
        f"explode({P.label_array(labels)}) AS y_true", *[f"0L AS {c}" for c in columns])
    full = counts.unionByName(zero).groupBy("y_true").agg(*[F.expr(f"sum({c})").alias(c) for c in columns])
    cells = [f"struct({text(x)} AS y_pred, {c} AS n, round(try_divide({c}, {' + '.join(columns)}), 4) AS row_share)"
             for c, x in zip(columns, labels)]
    return full.selectExpr("y_true", f"inline(array({', '.join(cells)}))")


def label_distribution(scored: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Rows per class in truth and in prediction, 0 where a class is absent."""
    return _label_totals(scored, labels, k=1).selectExpr("label", "support AS n_true", "predicted AS n_pred")


def calibration_bins(scored: DataFrame, labels: Sequence[str], n_bins: int = 10) -> DataFrame:
    """Reliability curve of each class that occurs: mean probability and positive share per bin.

    A probability on an edge counts for the lower bin; empty bins are left out.
    """
    step = 1.0 / n_bins
    edges = ", ".join(f"{i * step!r}D" for i in range(1, n_bins))
    binned = scored.selectExpr("y_true", "posexplode(proba) AS (i, p)").selectExpr(
        f"get({P.label_array(labels)}, i) AS label", "y_true", "p",
        f"cast(size(filter(array({edges}), e -> e < p)) AS bigint) AS bin")
    bins = binned.groupBy("label", "bin").agg(
        F.expr("count(1)").alias("n"), F.expr("avg(p)").alias("mean_p"),
        F.expr("count_if(y_true = label)").alias("positives"))
    # At most n_bins rows per class.
    return bins.withColumn("occurs", F.expr("sum(positives) OVER (PARTITION BY label)")).where(
        "occurs > 0").selectExpr("label", "bin", "n", "round(mean_p, 6) AS mean_predicted",
                                 "round(positives / n, 6) AS fraction_positive")
