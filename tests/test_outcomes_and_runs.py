from __future__ import annotations

import json

import pytest

from callwise.config import RUN_METRICS
from callwise.operators import outcomes, runs
from callwise.sources import embedding_cache, run_records
from callwise.operators.features import hashing_encoder


def test_unknown_action_takes_defaults(spark):
    steps = spark.createDataFrame([("Cerrar lead - no interesado",), ("Llamar",)], "action string")
    rows = {r["action"]: r for r in outcomes.with_outcome(steps, outcomes.default_outcomes(spark)).collect()}
    assert rows["Cerrar lead - no interesado"]["terminal"] is True
    new = rows["Llamar"]
    assert (new["terminal"], new["prob_terminal"], new["days_lo"], new["days_hi"], new["outcome_summary"]) == (
        False, 0.0, 7, 14, "Llamar")


def test_strategy_overrides(spark):
    rows = [(s, a) for s in ("default", "aggressive", "conservative")
            for a in ("Aplazar lead", "Escalar a manager del lead")]
    out = outcomes.with_strategy_outcome(
        spark.createDataFrame(rows, "strategy string, action string"),
        outcomes.default_outcomes(spark), outcomes.default_overrides(spark)).collect()
    got = {(r["strategy"], r["action"][:7]): (r["prob_terminal"], r["days_lo"], r["days_hi"]) for r in out}
    assert got["default", "Aplazar"] == (0.4, 10, 21) and got["aggressive", "Aplazar"] == (0.4, 3, 10)
    assert got["aggressive", "Escalar"] == (0.35, 7, 14) and got["conservative", "Escalar"] == (0.1, 7, 14)


def test_large_outcome_table_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(outcomes, "MAX_OUTCOMES", 3)
    hint = outcomes._small(outcomes.default_outcomes(spark))
    assert "ResolvedHint" not in hint._jdf.queryExecution().analyzed().toString()


STEPS = "lead_id string, strategy string, step int, day int, confidence double, status string"


@pytest.fixture(scope="module")
def summary(spark):
    rows = [("a", "s", 1, 0, 0.5, None), ("a", "s", 2, 7, 0.8, "converted"), ("b", "s", 1, 0, None, "lost"),
            ("c", "t", 1, 0, 0.4, None), ("c", "t", 2, 9, 0.6, None), ("d", "t", 1, 3, 0.7, "nurturing")]
    return outcomes.trajectory_summary(spark.createDataFrame(rows, STEPS))


def test_trajectories(summary):
    rows = {r["lead_id"]: r for r in summary.collect()}
    assert (rows["a"]["total_steps"], rows["a"]["confidence_avg"], rows["a"]["total_days"]) == (2, 0.65, 7)
    assert rows["a"]["final_status"] == "converted"
    assert rows["b"]["confidence_avg"] == 0.0
    assert rows["c"]["final_status"] == "max_steps_reached"


def test_batch_and_strategy_summaries(summary):
    stats = outcomes.outcome_stats(summary).first()
    assert (stats["n_leads"], stats["conversion_rate"], stats["loss_rate"], stats["avg_steps"]) == (4, 0.25, 0.25, 1.5)
    by = {r["strategy_name"]: r for r in outcomes.strategy_comparison(summary).collect()}
    assert (by["s"]["conversion_rate"], by["t"]["max_steps_rate"], by["t"]["nurturing_rate"]) == (0.5, 0.5, 0.5)
    assert by["s"]["avg_total_days"] == 3.5


def write_run(folder, name, **fields):
    (folder / f"{name}.json").write_text(json.dumps(fields, indent=2))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("runs")
    write_run(folder, "r1", run_id="r1", experiment_name="cmp", timestamp="2024-01-02T00:00:00",
              model_info={"model_name": "m", "params": {"a": [1, None]}}, duration_seconds=1.5,
              metrics={"x_accuracy": 0.5, "y_accuracy": 0.75, "best": "y", "z_accuracy": "high", "f1_weighted": 0.6})
    write_run(folder, "r2", experiment_name="tune", timestamp="2024-01-03T00:00:00",
              metrics={"accuracy": "n/a", "x_accuracy": 0.9, "f1_weighted": 0.6})
    write_run(folder, "r3", run_id="r3", timestamp="2024-01-01T00:00:00")
    return runs.runs_summary(run_records.read_records(spark, str(folder)))


def test_metric_extraction(index):
    rows = {r["run_id"]: r for r in index.collect()}
    assert set(rows) == {"r1", "r2", "r3"}                 # r2 takes its file's name
    assert rows["r1"]["accuracy"] == 0.75                  # largest number with the suffix
    assert rows["r2"]["accuracy"] is None                  # exact key, but no number
    assert rows["r3"]["f1_weighted"] is None and rows["r3"]["experiment_name"] == ""
    assert rows["r1"]["model_name"] == "m" and rows["r1"]["duration_seconds"] == 1.5


def test_order_and_best(index):
    assert [r["run_id"] for r in runs.list_runs(index).collect()] == ["r2", "r1", "r3"]
    assert runs.best_run(index).first()["run_id"] == "r1"  # first of two equal values
    assert runs.best_run(index, "top3_accuracy").count() == 0
    with pytest.raises(ValueError):
        runs.best_run(index, "nothing")


def test_index_file(spark, index, tmp_path):
    path = str(tmp_path / "index")
    absent = run_records.read_index(spark, path)
    assert absent.count() == 0 and set(RUN_METRICS) <= set(absent.columns)
    run_records.write_index(index, path)
    back = run_records.read_index(spark, path)
    assert back.columns == index.columns and back.count() == 3
    assert {r["run_id"]: r["accuracy"] for r in back.collect()} == {r["run_id"]: r["accuracy"] for r in index.collect()}


@pytest.mark.parametrize("rows_per_slice", [2, None])
def test_ranks_share_places(spark, rows_per_slice):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.9), ("c", 0.5), ("d", 0.1), ("e", 0.9)], "c string, s double")
    got = {r["c"]: r["rank_test_score"] for r in runs.rank_candidates(df, "c", "s", rows_per_slice).collect()}
    assert got == {"b": 1, "e": 1, "a": 3, "c": 3, "d": 5}


def test_embedding_cache_encodes_each_text_once(spark, tmp_path):
    path = str(tmp_path / "cache")
    df = spark.createDataFrame([("one",), ("two",), ("one",), (None,), ("",)], "t string")
    first = embedding_cache.update_cache(df.limit(1), "t", path, "h", hashing_encoder(8))
    assert first.count() == 1
    assert embedding_cache.missing_texts(df, "t", first, "h").count() == 2
    assert embedding_cache.missing_texts(df, "t", first, "other").count() == 3
    full = embedding_cache.update_cache(df, "t", path, "h", hashing_encoder(8))
    assert full.count() == 3 == full.select("text_hash").distinct().count()
    assert embedding_cache.update_cache(df, "t", path, "h", hashing_encoder(8)).count() == 3


def test_nan_is_never_the_best(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 0.5), ("b", nan), ("c", None), ("d", 0.7), ("e", 0.7)], "c string, s double")
    for per_slice in (None, 2):
        got = {r["c"]: r["rank_test_score"] for r in runs.rank_candidates(df, "c", "s", per_slice).collect()}
        assert got == {"d": 1, "e": 1, "a": 3, "b": 4, "c": 4}
    index = df.selectExpr("c AS run_id", "s AS f1_weighted", "'t' AS timestamp")
    assert runs.best_run(index).first()["run_id"] == "d"
    assert runs.best_run(index.where("run_id IN ('b', 'c')")).count() == 0
    from pyspark.sql import functions as F

    metrics = spark.sql("SELECT map('x_f1', 'NaN', 'y_f1', '0.5', 'z_f1', 'no') AS m, map('x_f1', 'NaN') AS n")
    row = metrics.select(runs.standard_metric(F.col("m"), "f1").alias("m"), runs.standard_metric(F.col("n"), "f1").alias("n")).first()
    assert row["m"] == 0.5 and row["n"] is None
