from __future__ import annotations

import hashlib
import random
from collections import Counter
from fractions import Fraction

import pytest

from callwise.functions import probabilities as P
from callwise.operators import evaluation, split

LABELS = ("a", "b", "c", "d")


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    rows = [(i, rng.choices(["x", "y", "z'q"], [30, 6, 1])[0]) for i in range(1072)]
    return spark.createDataFrame(rows, "id long, label string").repartition(5)


def order(rows):
    return sorted(rows, key=lambda r: hashlib.md5(f"42-{r[0]}".encode()).hexdigest())


@pytest.mark.parametrize("digits", [0, 1, 4])
def test_split_equals_plain_ranking(labelled, digits):
    got = {r["id"]: r["split"] for r in split.stratified_split(labelled, "id", "label", digits=digits).collect()}
    rows = [tuple(r) for r in labelled.collect()]
    quotas = split.test_quotas(Counter(r[1] for r in rows))
    assert sum(quotas.values()) == 215 == sum(v == "test" for v in got.values())
    for label, quota in quotas.items():
        mine = order(r for r in rows if r[1] == label)
        assert {r[0] for r in mine[:quota]} == {r[0] for r in mine if got[r[0]] == "test"}


@pytest.mark.parametrize("k, digits", [(2, 1), (5, 3), (7, 4)])
def test_folds_are_even_and_complete(labelled, k, digits):
    rows = split.stratified_folds(labelled, "id", "label", k=k, digits=digits).collect()
    assert len(rows) == 1072 and {r["fold"] for r in rows} == set(range(k))
    for label in {r["label"] for r in rows}:
        sizes = Counter(r["fold"] for r in rows if r["label"] == label)
        assert max(sizes.values()) - min(sizes[i] for i in range(k)) <= 1


def test_split_adds_no_shuffle_to_the_table(labelled):
    plan = split.stratified_split(labelled, "id", "label")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Join" not in plan


def test_folds_with_more_folds_than_rows(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id long, label string")
    assert split.stratified_folds(df, "id", "label", k=5).count() == 3


def test_single_row_class_trains_and_the_rest_is_split(spark):
    rows = [(i, "a") for i in range(20)] + [(99, "z"), (100, None), (101, None)]
    out = split.stratified_split(spark.createDataFrame(rows, "id long, label string"), "id", "label")
    got = {r["id"]: r["split"] for r in out.collect()}
    assert len(got) == 23 and got[99] == "train" and got[100] is None and got[101] is None
    assert sum(v == "test" for v in got.values()) == 4 and split.train_part(out).count() == 17


def test_unlabelled_rows_have_no_fold(spark):
    df = spark.createDataFrame([(i, "x" if i < 6 else None) for i in range(10)], "id long, label string")
    got = {r["id"]: r["fold"] for r in split.stratified_folds(df, "id", "label", k=3).collect()}
    assert [got[i] for i in range(6, 10)] == [None] * 4 and Counter(got[i] for i in range(6)) == {0: 2, 1: 2, 2: 2}
    empty = split.stratified_folds(df.where("label IS NULL"), "id", "label", k=3)
    assert [r["fold"] for r in empty.collect()] == [None] * 4
    assert [r["split"] for r in split.stratified_split(df.where("id > 6"), "id", "label").collect()] == [None] * 3


def test_joined_borders_equal_literal_ones(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "a", "b", "c'd", None])) for i in range(300)] + [(900, "one"), (901, "two"), (902, "two")]
    df = spark.createDataFrame(rows, "id long, label string")
    want = (sorted(split.stratified_split(df, "id", "label").collect(), key=str), sorted(split.stratified_folds(df, "id", "label", k=4).collect(), key=str))
    monkeypatch.setattr(split, "LITERAL_LABELS", 1)
    got = split.stratified_split(df, "id", "label", digits=1), split.stratified_folds(df, "id", "label", k=4, digits=1)
    assert sorted(got[0].collect(), key=str) == want[0] and sorted(got[1].collect(), key=str) == want[1]
    assert got[0].columns == ["id", "label", "split"] and got[1].columns == ["id", "label", "fold"]


def test_copies_of_a_key_stay_together(spark):
    rows = [(7, "x")] * 400 + [(i, "x") for i in range(100, 500)] + [(i, "y") for i in range(500, 900)]
    df = spark.createDataFrame(rows, "id long, label string")
    for digits in (0, 2):
        out = split.stratified_split(df, "id", "label", digits=digits)
        assert out.count() == 1200
        assert out.where("id = 7").select("split").distinct().count() == 1
        assert out.where("label = 'y' AND split = 'test'").count() == 80
        folds = split.stratified_folds(df, "id", "label", k=4, digits=digits)
        assert folds.count() == 1200 and folds.where("id = 7").select("fold").distinct().count() == 1


def test_quotas_by_largest_remainder():
    assert split.test_quotas({"a": 7, "b": 7, "c": 7}, Fraction(1, 5)) == {"a": 2, "b": 2, "c": 1}
    assert split.test_quotas({"a": 10, "b": 3}, Fraction(1, 5)) == {"a": 2, "b": 1}


def test_group_split_keeps_leads_together(spark):
    df = spark.range(3000).selectExpr("id", "id % 300 AS lead")
    out = split.group_split(df, "lead").selectExpr("lead", "split").distinct()
    assert out.count() == 300
    assert 30 < out.where("split = 'test'").count() < 90


def proba(*p):
    return [float(x) for x in p]


@pytest.fixture(scope="module")
def scored(spark):
    rows = [
        (1, "a", proba(0.5, 0.5, 0, 0)),      # tie: first wins for the label
        (2, "b", proba(0.5, 0.5, 0, 0)),
        (3, "b", proba(0.1, 0.7, 0.2, 0)),
        (4, "a", proba(0.1, 0.2, 0.3, 0.4)),  # d is predicted but never true
        (5, "b", proba(0, 0.3, 0.3, 0.4)),
    ]
    return spark.createDataFrame(rows, "id int, y_true string, proba array<double>")


def test_label_and_top_k_break_ties_differently(scored):
    rows = evaluation.with_top_k(evaluation.with_prediction(scored, LABELS), LABELS, 1).orderBy("id").collect()
    assert [r["y_pred"] for r in rows] == ["a", "a", "b", "d", "d"]
    assert rows[0]["top_labels"] == ["b"]
    assert rows[0]["confidence"] == 0.5


def test_metrics_by_hand(scored):
    table = {r["label"]: r for r in evaluation.per_class_metrics(scored, LABELS).collect()}
    assert set(table) == set(LABELS)
    assert (table["a"]["precision"], table["a"]["recall"], table["a"]["support"]) == (0.5, 0.5, 2)
    assert (table["b"]["precision"], table["b"]["recall"], table["b"]["f1"]) == (1.0, 0.3333, 0.5)
    assert (table["c"]["precision"], table["c"]["support"], table["d"]["f1"]) == (0.0, 0, 0.0)
    row = evaluation.eval_summary(scored, LABELS, k=1).first()
    assert row["accuracy"] == 0.4
    assert row["f1_macro"] == round((0.5 + 0.5 + 0) / 3, 4)  # c occurs nowhere and is left out
    assert row["f1_weighted"] == 0.5 and row["precision_weighted"] == 0.8
    squares = [(0.5, 0.5, 0, 0, 0), (0.5, 0.5, 0, 0, 1), (0.1, 0.7, 0.2, 0, 1), (0.1, 0.2, 0.3, 0.4, 0),
               (0, 0.3, 0.3, 0.4, 1)]
    total = sum((p - (i == s[4])) ** 2 for s in squares for i, p in enumerate(s[:4]))
    assert row["brier_score_avg"] == round(total / 20, 4)
    brier = {r["label"]: r["brier"] for r in evaluation.brier_scores(scored, LABELS).collect()}
    assert brier["(mean)"] == pytest.approx(total / 20, abs=1e-6) and len(brier) == 5


def test_topk_accuracy_counts_the_higher_index_on_ties(scored):
    row = evaluation.topk_accuracy(scored, LABELS, k=1).first()
    assert (row["n_rows"], row["hits"]) == (5, 2)  # rows 2 and 3


def test_report_lines(scored):
    rows = {r["label"]: r for r in evaluation.classification_report(scored, LABELS).collect()}
    assert set(rows) == {"a", "b", "d", "accuracy", "macro avg", "weighted avg"}
    assert rows["macro avg"]["support"] == 5


def test_confusion_grid_is_full(scored):
    cells = {(r["y_true"], r["y_pred"]): (r["n"], r["row_share"])
             for r in evaluation.confusion_matrix(scored, LABELS).collect()}
    assert len(cells) == 16
    assert cells["b", "a"] == (1, 0.3333) and cells["c", "a"] == (0, None)


def test_bins_put_edges_low_and_skip_absent_classes(spark):
    rows = [("a", [0.1, 0.9]), ("a", [0.30000000000000004, 0.7]), ("a", [0.31, 0.69])]
    df = spark.createDataFrame(rows, "y_true string, proba array<double>")
    bins = {(r["label"], r["bin"]): r["n"] for r in evaluation.calibration_bins(df, ["a", "b"]).collect()}
    assert bins == {("a", 0): 1, ("a", 2): 1, ("a", 3): 1}


def test_majority_model_on_published_counts(spark):
    """The majority row of the published comparison: accuracy and weighted F1 of 59 in 215."""
    counts = {"a": 59, "b": 51, "c": 39, "d": 30, "e": 29, "f": 7}
    rows = [(c, [1.0] + [0.0] * 5) for c, n in counts.items() for _ in range(n)]
    row = evaluation.eval_summary(spark.createDataFrame(rows, "y_true string, proba array<double>"), list(counts)).first()
    assert row["accuracy"] == 0.2744 and row["f1_weighted"] == 0.1182 and row["f1_macro"] == 0.0718
    assert row["brier_score_avg"] == 0.2419


def test_labels_with_quotes(spark):
    names = ["it's", "b\\s"]
    df = spark.createDataFrame([("it's", [0.4, 0.6]), ("b\\s", [0.2, 0.8])], "y_true string, proba array<double>")
    assert [r["y_pred"] for r in evaluation.with_prediction(df, names).collect()] == ["b\\s", "b\\s"]
    found = df.selectExpr(f"{P.probability_map(names)} AS m").first()["m"]
    assert found == {"it's": 0.4, "b\\s": 0.6}


def test_empty_scored_table(scored):
    row = evaluation.eval_summary(scored.limit(0), LABELS).first()
    assert row["n_rows"] == 0 and row["accuracy"] == 0.0
