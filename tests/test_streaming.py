from __future__ import annotations

import random

import pytest

from callwise.config import FIRST_CALL
from callwise.plans.sequence import sequence_columns
from callwise.plans.storage import materialise, scratch_path
from callwise.streaming import lead_state, scoring

SCHEMA = "lead_id long, interaction_id long, day int, next_step string, outcome string"


@pytest.mark.parametrize("rows_per_slice", [None, 4])
def test_lead_state_equals_the_batch_answer(spark, tmp_path, rows_per_slice):
    rng = random.Random(4)
    rows = sorted((rng.randrange(6), i, i // 3, rng.choice("abc"), rng.choice("xy")) for i in range(90))
    by_day = sorted(rows, key=lambda r: (r[2], r[1]))
    base = str(tmp_path)
    for start in range(0, 90, 30):  # three arrivals, each lead's calls in order across them
        part = by_day[start:start + 30]
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(f"{base}/in")
        stream = scoring.arriving_parquet(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema)
        lead_state.carry_lead_state(stream, f"{base}/out", f"{base}/cp", rows_per_slice).awaitTermination()
    state = lead_state.LeadState(f"{base}/out")
    got = {r["interaction_id"]: r for r in state.rows(spark).collect()}
    # A batch that is run again, as after a lost driver, changes neither rows nor state.
    versions = sorted(map(str, spark.read.parquet(f"{base}/out/state").collect()))
    state.advance(spark.createDataFrame(by_day[60:], SCHEMA), 2, rows_per_slice)
    assert {r["interaction_id"]: r for r in state.rows(spark).collect()} == got
    assert sorted(map(str, spark.read.parquet(f"{base}/out/state").collect())) == versions
    want = sequence_columns(
        spark.createDataFrame(rows, SCHEMA), ["lead_id"], ["day", "interaction_id"],
        lags={"s": "next_step", "o": "outcome", "d": "day"}, firsts={"f": "day"}, rows_per_slice=4).collect()
    assert len(got) == len(want) == 90
    for w in want:
        g = got[w["interaction_id"]]
        assert g["call_number"] == w["position"]
        assert g["prev_next_step"] == (w["s"] or FIRST_CALL) and g["prev_outcome"] == (w["o"] or FIRST_CALL)
        assert g["days_since_entry"] == w["day"] - w["f"]
        assert g["days_since_last_call"] == (0 if w["d"] is None else w["day"] - w["d"])


def test_scored_stream_holds_each_row_once(spark, tmp_path):
    base = str(tmp_path)
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).write.mode("append").parquet(f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").schema
    for _ in range(2):  # a second run finds nothing new
        stream = scoring.arriving_parquet(spark, f"{base}/in", schema, files_per_batch=4)
        scoring.score_stream(stream, lambda df: df.selectExpr("id", "id * 2 AS y"), f"{base}/out",
                             f"{base}/cp").awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(f"{base}/out").collect()) == [(i, 2 * i) for i in range(30)]


class _Session:
    """As much of a session as the folder lookup reads."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{master}"})


def test_scratch_folder_comes_from_the_session(spark):
    assert scratch_path(_Session("yarn", "hdfs://x/cp/"), "t").startswith("hdfs://x/cp/callwise/t-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(_Session("yarn"), "t")
    own = _Session("local[2]")
    assert scratch_path(own, "t").rsplit("/", 1)[0] == scratch_path(own, "t").rsplit("/", 1)[0]
    out = materialise(spark.range(5), "five")
    assert out.count() == 5 and "Range" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_replayed_batch_keeps_its_model(spark, tmp_path):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml import Pipeline

    base, labels = str(tmp_path), ("a", "b")
    rows = spark.createDataFrame([(i, float(i), float(i % 2)) for i in range(20)], "id int, x double, label double")
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features")]).fit(rows)
    registry = scoring.ModelRegistry(f"{base}/models")
    with pytest.raises(Exception):
        registry.newest(spark)
    from callwise.operators import models

    registry.publish(models.Fitted("one", labels, majority=0), spark, pipeline, 1)

    def arrive(part):
        part.select("id", "x").write.mode("append").parquet(f"{base}/in")
        stream = scoring.arriving_parquet(spark, f"{base}/in", rows.select("id", "x").schema)
        scoring.score_arriving(stream, registry, f"{base}/out", f"{base}/cp", ["id"]).awaitTermination()

    arrive(rows.where("id < 10"))
    registry.publish(models.Fitted("two", labels, majority=1), spark, pipeline, 2)
    assert registry.newest(spark) == 2
    # A folder without metadata is a version that was never finished.
    spark.range(1).write.parquet(f"{base}/models/version=3/model")
    assert registry.newest(spark) == 2
    arrive(rows.where("id >= 10"))
    got = {r["id"]: (r["predicted_next_step"], r["model_version"]) for r in scoring.scored_rows(spark, f"{base}/out").collect()}
    assert got == {i: (("a", 1) if i < 10 else ("b", 2)) for i in range(20)}


def test_texts_on_one_line(spark):
    from callwise.functions.cells import one_line
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("\n a\nb \t\n",), ("",), (None,), (" x ",)], "t string")
    assert [r[0] for r in rows.select(one_line(F.col("t"))).collect()] == ["a b", "", None, "x"]
