"""Features, classifiers, search and streams."""

from __future__ import annotations


from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwise.config import Settings
from callwise.operators import evaluation, features, models, search, split, text_space
from callwise.plans.storage import materialise, scratch_path
from callwise.queries import adapters as A
from callwise.queries.registry import query
from callwise.sources.calls import read_table
from callwise.streaming import lead_state, scoring

DOCS = Settings(
    labels=A.LANGUAGES, categorical=("lead_source",), numeric=("company_num_employees", "days_since_entry"))
DIGITS = tuple(str(i) for i in range(10))

# Labelled rows that random_search fits on, for each of 20 candidates and 5 folds; grid, draws and folds are full.
SEARCH_ROWS = 500


def doc_table(spark: SparkSession, d: str) -> DataFrame:
    from callwise.operators.clean import with_context_text

    return with_context_text(A.doc_calls(spark, d))


def doc_features(spark: SparkSession, d: str) -> tuple:
    """(feature pipeline, documents with features, label code and split), fitted on the train part."""
    docs = split.stratified_split(doc_table(spark, d), "interaction_id", "next_step")
    # Words are cut and counted once; fits and folds read the counts.
    counted = materialise(features.word_counts(docs, dim=DOCS.embedding_dim).drop(*features.TEXTS), "counted")
    pipeline, rest = features.fit_counted(split.train_part(counted), DOCS)
    coded = features.fit_labels(counted).transform(features.add_features(rest, counted))
    return pipeline, coded.select("interaction_id", "next_step", "features", "label", "split")


def doc_train_test(spark: SparkSession, d: str, k: int = 5) -> tuple[DataFrame, DataFrame]:
    _, coded = doc_features(spark, d)
    train = split.stratified_folds(split.train_part(coded), "interaction_id", "next_step", k=k)
    return train, split.test_part(coded)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select(
        "vec_id", features.as_vector(F.col("embedding")).alias("features"),
        F.col("label").cast("double").alias("label"), F.col("label").cast("string").alias("y_true"))


def _scored(fitted: models.Fitted, rows: DataFrame) -> DataFrame:
    """Rows with label, confidence and a check that the probabilities add up to 1."""
    out = fitted.score(rows)
    return evaluation.with_prediction(out, fitted.labels).selectExpr(
        "vec_id", "y_pred", "confidence", "round(aggregate(proba, 0D, (a, x) -> a + x), 3) AS total")


# ---- features ----

@query("standard_scale", """
SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 6) AS price_z,
  0.0::DOUBLE AS one_z FROM orders""")
def standard_scale(spark: SparkSession, d: str) -> DataFrame:
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit(1.0).alias("one"))
    stats = features.scale_stats(orders, ["o_totalprice", "one"])
    return features.standard_scale(orders, stats).select(
        "o_orderkey", F.round("o_totalprice_z", 6).alias("price_z"), F.col("one_z"))


@query("one_hot_counts", """
SELECT 'company_sector' AS "column", coalesce(company_sector, 'PRIMERA_LLAMADA') AS category, count(*) AS n
FROM raw_calls GROUP BY 2 UNION ALL
SELECT 'prev_next_step', coalesce(prev_next_step, 'PRIMERA_LLAMADA'), count(*) FROM raw_calls GROUP BY 2""",
       "calls raw_calls")
def one_hot_counts(spark: SparkSession, d: str) -> DataFrame:
    return features.one_hot_counts(A.raw_lead_calls(spark, d), ["company_sector", "prev_next_step"])


@query("one_hot_unknown", """
SELECT doc_id AS interaction_id, CAST(CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS BIGINT) AS ones FROM documents""")
def one_hot_unknown(spark: SparkSession, d: str) -> DataFrame:
    """Categories fitted on English documents only: all other languages encode to zeros."""
    docs = A.doc_calls(spark, d)
    only = Settings(categorical=("next_step",), numeric=())
    pipeline = features.fit_features(docs.where(F.col("next_step") == "en"), only, texts=())
    rows = features.add_features(pipeline, docs)
    ones = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)
    return rows.select("interaction_id", ones.cast("long").alias("ones"))


@query("label_index", """
SELECT o_orderkey AS interaction_id, o_orderpriority AS next_step,
  dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS label, o_orderpriority AS decoded FROM orders""")
def label_index(spark: SparkSession, d: str) -> DataFrame:
    orders = read_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("interaction_id"), F.col("o_orderpriority").alias("next_step"))
    fitted = features.fit_labels(orders)
    return features.decode_labels(fitted.transform(orders), fitted.labels).select(
        "interaction_id", "next_step", F.col("label").cast("long").alias("label"), "decoded")


@query("text_embeddings", """
SELECT doc_id AS interaction_id, 384 AS width, 1.0::DOUBLE AS norm FROM documents""")
def text_embeddings(spark: SparkSession, d: str) -> DataFrame:
    docs = A.doc_calls(spark, d).select("interaction_id", "current_transcript")
    rows = features.hashing_encoder(384)(docs, "current_transcript", "embedding")
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return rows.select("interaction_id", F.size("embedding").alias("width"),
                       F.round(F.sqrt(squares), 3).alias("norm"))


@query("text_space_terms", r"""
WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents)
SELECT term, count(*) AS texts FROM w GROUP BY term ORDER BY texts DESC, term LIMIT 16384""")
def text_space_terms(spark: SparkSession, d: str) -> DataFrame:
    return text_space.text_terms(A.doc_calls(spark, d), "current_transcript")


@query("text_space_vectors")
def text_space_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Dense vectors of all texts in the space of the train part."""
    docs = split.stratified_split(A.doc_calls(spark, d), "interaction_id", "next_step")
    space = text_space.fit_text_space(split.train_part(docs), "current_transcript")
    return text_space.space_vectors(docs.select("interaction_id", "current_transcript"), "current_transcript",
                                    text_space.share_space(docs, space)).select("interaction_id", "embedding")


@query("feature_matrix", """
SELECT doc_id AS interaction_id, (SELECT 2 + count(DISTINCT source) + 768 FROM documents) AS width,
  (SELECT 2 + count(DISTINCT source) + 768 FROM documents) AS n_names FROM documents""")
def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    docs = doc_table(spark, d)
    pipeline = features.fit_features(docs, DOCS)
    names = features.feature_names(pipeline, DOCS, 2 * DOCS.embedding_dim)
    return features.add_features(pipeline, docs).select(
        "interaction_id", F.size(vector_to_array("features")).cast("long").alias("width"),
        F.lit(len(names)).cast("long").alias("n_names"))


@query("feature_transform_only", """
SELECT d.doc_id AS interaction_id, round((d.n_chars - m.a) / m.s, 6) AS size_z
FROM documents d, (SELECT avg(n_chars) AS a, stddev_pop(n_chars) AS s FROM documents WHERE lang = 'en') m""")
def feature_transform_only(spark: SparkSession, d: str) -> DataFrame:
    """A pipeline fitted on one part keeps its statistics on the whole table, target or not."""
    docs = doc_table(spark, d)
    pipeline = features.fit_features(docs.where(F.col("next_step") == "en"), DOCS)
    rows = features.add_features(pipeline, docs.drop("next_step"))
    return rows.select("interaction_id", F.round(F.get(vector_to_array("features"), F.lit(0)), 6).alias("size_z"))


@query("pca_explained")
def pca_explained(spark: SparkSession, d: str) -> DataFrame:
    rows, explained = features.principal_components(vectors(spark, d), "features")
    shares = F.array(*[F.lit(x) for x in explained])
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.abs(F.avg("pc1")), 6).alias("mean_pc1"),
        F.round(F.var_samp("pc1") / F.var_samp("pc2"), 4).alias("variance_ratio"),
    ).withColumn("explained", F.round(F.aggregate(shares, F.lit(0.0), lambda a, x: a + x), 4))


# ---- classifiers ----

@query("model_dummy", """
SELECT vec_id, (SELECT CAST(label AS VARCHAR) FROM embeddings GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
  AS y_pred, 1.0::DOUBLE AS confidence, 1.0::DOUBLE AS total FROM embeddings""")
def model_dummy(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    return _scored(models.fit_majority(rows, DIGITS), rows)


@query("model_logistic")
def model_logistic(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    return _scored(models.fit_logistic(rows, DIGITS), rows)


@query("model_random_forest")
def model_random_forest(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    return _scored(models.fit_forest(rows, DIGITS), rows)


@query("model_gbt")
def model_gbt(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    return _scored(models.fit_boosted(rows, DIGITS), rows)


@query("cv_scores")
def cv_scores(spark: SparkSession, d: str) -> DataFrame:
    train, _ = doc_train_test(spark, d, k=5)
    train = train.persist()
    scores = models.cross_validate(models.fit_logistic, train, A.LANGUAGES, k=5)
    train.unpersist()
    mean, std = models.mean_std(scores)
    return spark.createDataFrame(
        [(i, s, round(mean, 4), round(std, 4)) for i, s in enumerate(scores)],
        "fold int, f1_weighted double, mean double, std double")


def _comparison(spark: SparkSession, d: str) -> DataFrame:
    train, test = doc_train_test(spark, d)
    return models.compare_models(train, test, A.LANGUAGES)


@query("model_comparison")
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    return _comparison(spark, d)


@query("model_ranking")
def model_ranking(spark: SparkSession, d: str) -> DataFrame:
    table = _comparison(spark, d)
    return table.select("model_name", "f1_weighted", "accuracy", "top3_accuracy")


def _search_rows(train: DataFrame) -> DataFrame:
    """At most SEARCH_ROWS labelled rows, by the hash of their key."""
    return train.orderBy(F.xxhash64("interaction_id")).limit(SEARCH_ROWS)


@query("random_search")
def random_search(spark: SparkSession, d: str) -> DataFrame:
    train, _ = doc_train_test(spark, d)
    _, _, table = search.random_search(
        models.fit_forest, search.param_grid("random_forest"), _search_rows(train), A.LANGUAGES)
    return table


@query("tune_all")
def tune_all(spark: SparkSession, d: str) -> DataFrame:
    train, test = doc_train_test(spark, d)
    table, _ = search.tune_all(train, test, A.LANGUAGES)
    return table


@query("feature_importance")
def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    pipeline, coded = doc_features(spark, d)
    fitted = models.fit_forest(split.train_part(coded), A.LANGUAGES)
    names = features.feature_names(pipeline, DOCS, 2 * DOCS.embedding_dim)
    return models.feature_importance(fitted, names, spark)


@query("score_calls")
def score_calls(spark: SparkSession, d: str) -> DataFrame:
    pipeline, coded = doc_features(spark, d)
    fitted = models.fit_logistic(split.train_part(coded), A.LANGUAGES)
    rows = features.add_features(pipeline, doc_table(spark, d).drop("next_step"))
    return fitted.predict(rows.select("interaction_id", "features")).drop("features").select(
        "interaction_id", "predicted_next_step", "confidence", F.to_json("probabilities").alias("probabilities"))


@query("model_roundtrip", "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_changed FROM documents")
def model_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Pipeline and boosted models reloaded from disk score every document as before."""
    pipeline, coded = doc_features(spark, d)
    fitted = models.fit_boosted(split.train_part(coded), A.LANGUAGES)
    path = scratch_path(spark, "model")
    models.save(fitted, path, spark, pipeline, {"seed": 42})
    again, pipeline_again, _ = models.load(path, spark)
    docs = doc_table(spark, d)
    before = fitted.score(features.add_features(pipeline, docs)).select("interaction_id", "proba")
    after = again.score(features.add_features(pipeline_again, docs)).select(
        F.col("interaction_id").alias("id2"), F.col("proba").alias("p2"))
    pairs = before.join(after, F.col("interaction_id") == F.col("id2"))
    return pairs.agg(F.count(F.lit(1)).alias("n_rows"),
                     F.sum((F.col("proba") != F.col("p2")).cast("long")).alias("n_changed"))


# ---- streams ----

@query("stream_score", """
SELECT vec_id, (SELECT CAST(label AS VARCHAR) FROM embeddings GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
  AS predicted_next_step, 1.0::DOUBLE AS confidence FROM embeddings""")
def stream_score(spark: SparkSession, d: str) -> DataFrame:
    """Vectors arrive as files and are scored into a table; the majority model makes the answer known."""
    rows = vectors(spark, d).select("vec_id", "label", "features")
    fitted = models.fit_majority(rows, DIGITS)
    base = scratch_path(spark, "stream")
    read_table(spark, d, "embeddings").repartition(4).write.parquet(f"{base}/in")
    stream = scoring.arriving_parquet(
        spark, f"{base}/in", read_table(spark, d, "embeddings").schema, files_per_batch=2)
    ready = stream.select("vec_id", features.as_vector(F.col("embedding")).alias("features"))
    scoring.score_stream(ready, fitted.predict, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("vec_id", "predicted_next_step", "confidence")


@query("stream_score_swap", """
SELECT doc_id AS interaction_id, CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS model_version, true AS as_in_batch FROM documents""")
def stream_score_swap(spark: SparkSession, d: str) -> DataFrame:
    """Documents arrive in two parts and are scored by the whole pipeline; a logistic model takes over from the majority
    between the parts. Every row must come out as the same model scores it in a batch."""
    pipeline, coded = doc_features(spark, d)
    train = split.train_part(coded)
    fitted = {1: models.fit_majority(train, A.LANGUAGES), 2: models.fit_logistic(train, A.LANGUAGES)}
    raw = doc_table(spark, d)
    base = scratch_path(spark, "arriving")
    registry = scoring.ModelRegistry(f"{base}/models")
    english = F.col("next_step") == "en"
    for version, part in ((1, raw.where(english)), (2, raw.where(~english))):
        registry.publish(fitted[version], spark, pipeline, version)
        part.write.mode("append").parquet(f"{base}/in")
        stream = scoring.arriving_parquet(spark, f"{base}/in", raw.schema)
        scoring.score_arriving(stream, registry, f"{base}/out", f"{base}/checkpoint", ["interaction_id"]).awaitTermination()
    rows = features.add_features(pipeline, raw).select("interaction_id", "features")
    known = [fitted[v].predict(rows).select(F.col("interaction_id").alias("id"), F.lit(v).alias("v"), F.col("predicted_next_step").alias("label"),
                                            F.col("confidence").alias("p")) for v in fitted]
    same = (F.col("predicted_next_step") == F.col("label")) & (F.col("confidence") == F.col("p"))
    return scoring.scored_rows(spark, f"{base}/out").join(
        known[0].union(known[1]), (F.col("interaction_id") == F.col("id")) & (F.col("model_version") == F.col("v"))).select(
        "interaction_id", "model_version", same.alias("as_in_batch"))


@query("stream_lead_state", """
SELECT interaction_id, lead_id, call_number, prev_next_step, prev_outcome,
  CAST(days_since_last_call AS INTEGER) AS days_since_last_call,
  CAST(days_since_entry AS INTEGER) AS days_since_entry FROM calls""", "calls")
def stream_lead_state(spark: SparkSession, d: str) -> DataFrame:
    """Orders arrive in three date ranges, one run each; state carries over between runs."""
    orders = read_table(spark, d, "orders").select(
        F.col("o_custkey").alias("lead_id"), F.col("o_orderkey").alias("interaction_id"),
        F.unix_date(F.to_date("o_orderdate")).alias("day"), F.col("o_orderpriority").alias("next_step"),
        F.col("o_orderstatus").alias("outcome"))
    year = F.year(F.date_from_unix_date("day"))
    base = scratch_path(spark, "leads")
    for part in (orders.where(year < 1995), orders.where((year >= 1995) & (year < 1998)),
                 orders.where(year >= 1998)):
        part.write.mode("append").parquet(f"{base}/in")
        stream = scoring.arriving_parquet(spark, f"{base}/in", orders.schema)
        lead_state.carry_lead_state(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return lead_state.LeadState(f"{base}/out").rows(spark)
