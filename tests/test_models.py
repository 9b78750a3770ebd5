from __future__ import annotations

import math
import random
from functools import partial

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from callwise.config import FIRST_CALL, Settings
from callwise.operators import features, models, report, search, split

SMALL = Settings(categorical=("lead_source",), numeric=("a", "b"), embedding_dim=16)
LABELS = ("hot", "ice", "warm")


@pytest.fixture(scope="module")
def calls(spark):
    rng = random.Random(8)
    rows = []
    for i in range(180):
        label = LABELS[i % 3]
        words = {"hot": "yes buy now", "warm": "maybe later call", "ice": "no never stop"}[label].split()
        rows.append((i, rng.gauss(3 * LABELS.index(label), 1), 5.0, rng.choice(["web", "fair", None]),
                     " ".join(rng.choices(words, k=5)), "note", label))
    return spark.createDataFrame(
        rows, "id int, a double, b double, lead_source string, current_transcript string, "
              "context_text string, next_step string")


@pytest.fixture(scope="module")
def fitted_features(calls):
    return features.fit_features(calls, SMALL)


@pytest.fixture(scope="module")
def table(calls, fitted_features):
    coded = features.fit_labels(calls).transform(features.add_features(fitted_features, calls))
    data = split.stratified_folds(coded.select("id", "next_step", "features", "label"), "id", "next_step", k=3)
    return data.persist()


def test_population_scaling_and_constant_column(calls):
    stats = features.scale_stats(calls, ["a", "b"])
    assert stats["b"] == (5.0, 1.0)
    row = features.standard_scale(calls, stats).agg(
        F.avg("a_z"), F.stddev_pop("a_z"), F.max(F.abs("b_z"))).first()
    assert row[0] == pytest.approx(0, abs=1e-9) and row[1] == pytest.approx(1) and row[2] == 0


def test_matrix_width_names_and_rows(calls, fitted_features):
    names = features.feature_names(fitted_features, SMALL, 32)
    rows = features.add_features(fitted_features, calls).select("id", vector_to_array("features").alias("v")).collect()
    assert len(rows) == 180 and all(len(r["v"]) == len(names) == 2 + 3 + 32 for r in rows)
    assert names[:5] == ["a", "b", f"lead_source_{FIRST_CALL}", "lead_source_fair", "lead_source_web"]
    assert all(sum(r["v"][2:5]) == 1 for r in rows)


def test_transform_only_keeps_the_fit(calls, fitted_features):
    one = calls.where("id = 7").drop("next_step").withColumn("lead_source", F.lit("unseen"))
    v = features.add_features(fitted_features, one).select(vector_to_array("features")).first()[0]
    full = features.add_features(fitted_features, calls.where("id = 7")).select(vector_to_array("features")).first()[0]
    assert v[0] == full[0] and v[2:5] == [0, 0, 0] and v[5:] == full[5:]


def test_unseen_label_is_an_error(calls, spark):
    model = features.fit_labels(calls)
    assert list(model.labels) == sorted(LABELS)
    with pytest.raises(Exception, match="Unseen label"):
        model.transform(spark.createDataFrame([("other",)], "next_step string")).collect()
    back = features.decode_labels(model.transform(calls), model.labels)
    assert back.where("decoded <> next_step").count() == 0


def test_batch_encoder_and_hash_encoder(calls):
    def make():
        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

    df = features.batch_encoder(make, 2, batch_size=16)(calls, "current_transcript", "e")
    assert df.where("e[0] <> length(current_transcript)").count() == 0
    h = features.hashing_encoder(16)(calls, "current_transcript", "e")
    assert h.where("size(e) <> 16").count() == 0
    with_vectors = h.withColumn("v", features.as_vector(F.col("e")))
    model = features.fit_features(with_vectors, SMALL, texts=(), vectors={"v": 16})
    assert len(features.add_features(model, with_vectors).select(vector_to_array("features")).first()[0]) == 2 + 3 + 16


def test_components_are_centred(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(60, 4)) * [5, 2, 1, 0.1] + 100
    raw = spark.createDataFrame([(r.tolist(),) for r in data], "a array<double>")
    df = raw.select(features.as_vector(F.col("a")).alias("v"))
    rows, explained = features.principal_components(df, "v")
    centred = data - data.mean(axis=0)
    values = np.linalg.svd(centred, compute_uv=False) ** 2
    assert explained == pytest.approx((values / values.sum())[:2].tolist(), rel=1e-6)
    got = rows.agg(F.avg("pc1"), F.avg("pc2"), F.var_samp("pc1")).first()
    assert got[0] == pytest.approx(0, abs=1e-9) and got[2] == pytest.approx(values[0] / 59, rel=1e-6)


FITS = {
    "majority": models.fit_majority,
    "logistic": partial(models.fit_logistic, max_iter=30),
    "forest": partial(models.fit_forest, n_estimators=5, max_depth=4),
    "boosted": partial(models.fit_boosted, n_estimators=3, max_depth=2, min_child_weight=1),
}


@pytest.mark.parametrize("kind", list(FITS))
def test_probabilities_and_reload(spark, table, fitted_features, calls, tmp_path, kind):
    fitted = FITS[kind](table, LABELS)
    scored = fitted.score(table)
    bad = scored.where("size(proba) <> 3 OR abs(aggregate(proba, 0D, (a, x) -> a + x) - 1) > 1e-9")
    assert bad.count() == 0 and scored.count() == 180
    metrics = models.evaluate(fitted, table)
    assert metrics["accuracy"] > (0.3 if kind == "majority" else 0.9)
    models.save(fitted, str(tmp_path / "m"), spark, fitted_features, {"seed": 1})
    again, pipeline, info = models.load(str(tmp_path / "m"), spark)
    assert info == {"seed": 1} and again.labels == LABELS
    rows = features.add_features(fitted_features, calls).select("id", "features")
    a = {r["id"]: (r["predicted_next_step"], r["confidence"], r["probabilities"]) for r in fitted.predict(rows).collect()}
    b = {r["id"]: (r["predicted_next_step"], r["confidence"], r["probabilities"]) for r in again.predict(
        features.add_features(pipeline, calls).select("id", "features")).collect()}
    assert a == b
    for label, confidence, p in a.values():
        assert label in LABELS and set(p) == set(LABELS) and confidence == max(p.values())


def test_cross_validation_and_failure(table):
    scores = models.cross_validate(FITS["forest"], table, LABELS, k=3)
    assert len(scores) == 3 and min(scores) > 0.8

    def broken(df, labels):
        raise RuntimeError("no")

    assert all(math.isnan(s) for s in models.cross_validate(broken, table, LABELS, k=3))
    assert models.mean_std([0.5, 0.7]) == pytest.approx((0.6, 0.1))


def test_comparison_bins_the_table_once_for_all_folds(table, monkeypatch):
    fits = {"random_forest": partial(models.fit_forest, n_estimators=2, max_depth=2), "gradient_boosting": partial(models.fit_boosted, n_estimators=2, max_depth=2)}
    alone = {name: models.mean_std(models.cross_validate(fit, table, LABELS, k=3)) for name, fit in fits.items()}
    binned, bin_table = [], models.trees.bin_table
    monkeypatch.setattr(models.trees, "bin_table", lambda *a: binned.append(1) or bin_table(*a))
    rows = models.compare_models(table, table, LABELS, fits, k=3).collect()
    assert len(binned) == 1 + len(fits)
    for r in rows:
        assert (r["cv_f1_mean"], r["cv_f1_std"]) == pytest.approx(alone[r["model_name"]], abs=1e-4)


def test_pipelines_for_texts_and_for_word_counts_agree(calls, fitted_features):
    texts = calls.withColumn("current_transcript", F.when(F.col("id") % 7 > 0, F.col("current_transcript")))
    counted = features.word_counts(texts, dim=16)
    whole, rest = features.fit_counted(counted.drop(*features.TEXTS), SMALL)
    known = {r["id"]: r["features"] for r in features.add_features(whole, texts).collect()}
    assert {r["id"]: r["features"] for r in features.add_features(rest, counted.drop(*features.TEXTS)).collect()} == known
    again = features.fit_features(texts, SMALL)
    assert {r["id"]: r["features"] for r in features.add_features(again, texts).collect()} == known


def test_documents_are_read_once_for_all_fits(spark, tmp_path):
    from callwise.queries import model_queries

    docs = [(i, f"word{i % 5} text {i % 3}" if i % 9 else None, ("de", "en", "es", "fr")[i % 4], "src", 10 + i) for i in range(80)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    pipeline, coded = model_queries.doc_features(spark, str(tmp_path))
    assert coded.inputFiles() and not any("documents" in f for f in coded.inputFiles())
    raw = features.add_features(pipeline, model_queries.doc_table(spark, str(tmp_path))).select("interaction_id", "features")
    # Numbers of null texts are NaN, so vectors are compared as text.
    assert {r["interaction_id"]: str(r["features"]) for r in raw.collect()} == {r["interaction_id"]: str(r["features"]) for r in coded.collect()}


def test_comparison_ranks_models(table):
    rows = models.compare_models(
        table.where("fold <> 0"), table.where("fold = 0"), LABELS,
        {"dummy_most_frequent": FITS["majority"], "random_forest": FITS["forest"]}, k=3).collect()
    assert [r["model_name"] for r in rows] == ["random_forest", "dummy_most_frequent"]
    assert len(rows[0]) == 14
    assert set(models.model_set()) == {"dummy_most_frequent", "logistic_regression", "random_forest",
                                       "gradient_boosting", "gradient_boosting_light"}


def test_importance(spark, table):
    fitted = FITS["boosted"](table, LABELS)
    rows = models.feature_importance(fitted, [f"n{i}" for i in range(36)] + ["emb_0"], spark, top=5).collect()
    assert len(rows) == 5 and rows[0]["importance"] >= rows[4]["importance"]
    assert sum(r["importance"] for r in rows) <= 1.0 + 1e-9


def test_candidates_are_distinct_and_seeded():
    grid = search.param_grid("random_forest")
    found = search.draw_candidates(grid, 20, 42)
    assert len({tuple(c.items()) for c in found}) == 20 and found == search.draw_candidates(grid, 20, 42)
    assert all(c[k] in grid[k] for c in found for k in grid)
    assert len(search.draw_candidates({"x": [1, 2]}, 20, 42)) == 2
    assert math.prod(map(len, search.param_grid("gradient_boosting").values())) == 3840
    with pytest.raises(KeyError):
        search.param_grid("nothing")


def test_search_refits_the_best(table):
    fitted, best, candidates = search.random_search(
        models.fit_forest, {"n_estimators": [1, 5], "max_depth": [1, 4]}, table, LABELS, n_iter=3, k=3)
    rows = candidates.collect()
    assert len(rows) == 3 and rows[0]["rank_test_score"] == 1
    assert rows[0]["mean_test_score"] == max(r["mean_test_score"] for r in rows)
    assert models.evaluate(fitted, table)["accuracy"] > 0.8 and best["n_estimators"] in (1, 5)


def test_tuning_files(spark, table, tmp_path):
    grids = {"gradient_boosting": {"n_estimators": [1], "max_depth": [1, 2]}, "random_forest": {"n_estimators": [1, 3]}}
    tuned, tables = search.tune_all(table.where("fold <> 0"), table.where("fold = 0"), LABELS, grids, n_iter=2, k=3)
    search.save_tuning(tuned, tables, str(tmp_path))
    best = {r["model_name"]: r for r in spark.read.json(str(tmp_path / "best_params")).collect()}
    assert set(best) == set(grids) and all(0 <= r["test_accuracy"] <= 1 for r in best.values())
    assert spark.read.csv(str(tmp_path / "random_forest_cv_results"), header=True).count() == 2


def test_sample_components(calls):
    rows, explained = report.sample_components(calls, "current_transcript", "id", n=50)
    assert rows.count() == 50 and len(explained) == 2 and 0 < sum(explained) <= 1


def test_a_failed_candidate_is_never_first(spark, monkeypatch):
    from callwise.operators import search

    scores = {1: float("nan"), 2: 0.4, 3: 0.6, 4: 0.4}
    monkeypatch.setattr(search, "cross_validate", lambda fit, *a: fit.keywords["p"])
    monkeypatch.setattr(search, "mean_std", lambda p: (scores[p], 0.0))
    data = spark.range(1)
    fit = lambda *a, p: p
    model, best, table = search.random_search(fit, {"p": [1, 2, 3, 4]}, data, ["x"], n_iter=4)
    ranks = {r["params"]: r["rank_test_score"] for r in table.collect()}
    assert best == {"p": 3} and model == 3
    assert ranks == {'{"p": 3}': 1, '{"p": 2}': 2, '{"p": 4}': 2, '{"p": 1}': 4}
    scores.update({2: float("nan"), 3: float("nan"), 4: float("nan")})
    with pytest.raises(ValueError):
        search.random_search(fit, {"p": [1, 2]}, data, ["x"], n_iter=2)


def test_only_the_most_frequent_categories_have_slots(spark):
    rows = spark.createDataFrame([(i, v, 1.0) for i, v in enumerate(["b"] * 5 + ["a"] * 5 + ["d"] * 3 + ["c"] * 3 + [None] * 9 + ["e"])],
                                 "id int, lead_source string, x double")
    settings = Settings(categorical=("lead_source",), numeric=("x",), most_categories=4)
    model = features.fit_features(rows, settings, texts=())
    assert features.feature_names(model, settings) == ["x", f"lead_source_{FIRST_CALL}", "lead_source_a", "lead_source_b", "lead_source_c"]
    hot = {r["lead_source"]: r["v"][1:] for r in features.add_features(model, rows).select("lead_source", vector_to_array("features").alias("v")).collect()}
    assert hot["c"] == [0, 0, 0, 1] and hot["d"] == hot["e"] == [0, 0, 0, 0] and hot[None] == [1, 0, 0, 0]


def test_the_best_candidate_of_shared_passes_equals_fits_one_by_one(table):
    fits = [partial(models.fit_boosted, n_estimators=2, max_depth=2), partial(models.fit_forest, n_estimators=3, min_samples_split=9)]
    together = models.fold_scores(fits, table, LABELS, 3)
    assert together == [models.cross_validate(f, table, LABELS, 3) for f in fits]
    assert models.spec_of(models.fit_logistic) is None and models.spec_of(fits[1]).min_samples_split == 9


def test_tune_all_reads_the_whole_train_part(spark, tmp_path, monkeypatch):
    from callwise.queries import model_queries

    rows = [(i, f"text {i} {'ab'[i % 2]}", ("de", "en", "es", "fr")[i % 4], f"s{i % 3}", 10 + i % 7) for i in range(800)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    monkeypatch.setattr(model_queries.search, "tune_all", lambda train, test, labels: seen.extend([train.count(), test.count()]) or (None, {}))
    model_queries.tune_all(spark, str(tmp_path))
    assert seen == [640, 160]
