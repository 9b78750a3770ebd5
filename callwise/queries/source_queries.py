"""Scans, sinks and run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwise.config import MISSING_TOKENS
from callwise.operators import clean, runs
from callwise.operators.features import hashing_encoder
from callwise.plans.storage import scratch_path
from callwise.queries import adapters as A
from callwise.queries.registry import query
from callwise.sources import calls as files
from callwise.sources import embedding_cache, run_records
from callwise.sources.calls import read_table

TOKEN_SQL = ", ".join("'" + t + "'" for t in MISSING_TOKENS)


@query("src_csv_roundtrip", """
SELECT doc_id, md5(text) AS text_md5, lang, source, CAST(n_chars AS BIGINT) AS n_chars FROM documents""")
def src_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    docs = read_table(spark, d, "documents")
    files.write_csv(docs, path)
    back = files.read_csv(spark, path, docs.schema)
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang", "source",
                       "n_chars")


@query("clean_missing_tokens", f"""
SELECT interaction_id,
  CASE WHEN prev_outcome IN ({TOKEN_SQL}) THEN NULL ELSE prev_outcome END AS prev_outcome,
  CASE WHEN prev_next_step IN ({TOKEN_SQL}) THEN NULL ELSE prev_next_step END AS prev_next_step,
  CASE WHEN days_since_entry IN ({TOKEN_SQL}) THEN NULL ELSE days_since_entry END AS days_since_entry
FROM raw_calls""", "calls raw_calls")
def clean_missing_tokens(spark: SparkSession, d: str) -> DataFrame:
    raw = A.raw_calls(spark, d).select("interaction_id", "prev_outcome", "prev_next_step", "days_since_entry")
    return clean.null_missing_tokens(raw)


@query("sink_append", "SELECT o_orderpriority AS next_step, count(*) AS n, 2 AS writes FROM orders GROUP BY 1")
def sink_append(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "append")
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    early = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    for i, part in enumerate((orders.where(early), orders.where(~early))):
        files.append(part.withColumn("write", F.lit(i)), path)
    return spark.read.parquet(path).groupBy(F.col("o_orderpriority").alias("next_step")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("write").cast("int").alias("writes"))


@query("embed_cache_missing", """
SELECT sha256(text) AS text_hash FROM documents GROUP BY text HAVING count(*) FILTER (WHERE lang = 'en') = 0""")
def embed_cache_missing(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("text", "lang")
    path = scratch_path(spark, "cache")
    cache = embedding_cache.update_cache(
        docs.where(F.col("lang") == "en"), "text", path, "hash-64", hashing_encoder(64))
    return embedding_cache.missing_texts(docs, "text", cache, "hash-64").select("text_hash")


@query("embed_cache_hit", """
SELECT doc_id, sha256(text) AS text_hash, 64 AS width, CAST(0 AS BIGINT) AS encoded_again FROM documents""")
def embed_cache_hit(spark: SparkSession, d: str) -> DataFrame:
    """Every document gets its vector from the cache; a second run finds nothing left to encode."""
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    path = scratch_path(spark, "cache")
    first = embedding_cache.cached_embeddings(docs, "text", path, "hash-64", hashing_encoder(64))
    again = embedding_cache.missing_texts(docs, "text", embedding_cache.read_cache(spark, path), "hash-64").count()
    return embedding_cache.with_hash(first, "text").select(
        "doc_id", "text_hash", F.size("embedding").alias("width"), F.lit(again).cast("long").alias("encoded_again"))


def run_table(spark: SparkSession, d: str) -> DataFrame:
    """Events as run records: one run per user, metrics by event type."""
    events = read_table(spark, d, "events").select("user_id", "ts", "event_type", "value")
    # One row per (run, event type): the map of a run has a few entries per type.
    kinds = events.groupBy("user_id", "event_type").agg(
        F.expr("cast(round(avg(cast(value AS decimal(20, 10))), 3) AS double)").alias("mean"), F.max("value").alias("top"), F.min("ts").alias("first"))
    even = F.col("user_id") % 2 == 0
    kv = lambda k, v: F.struct(k.alias("key"), v.cast("string").alias("value"))
    entries = F.when(even, F.array(kv(F.col("event_type"), F.col("mean")))).otherwise(F.array(
        kv(F.concat(F.lit("a_"), "event_type"), F.col("mean")),
        kv(F.concat(F.lit("b_"), "event_type"), F.col("top"))))
    per_run = kinds.groupBy("user_id").agg(
        F.flatten(F.collect_list(entries)).alias("entries"), F.min("first").alias("first"))
    note = F.array(kv(F.lit("signup"), F.lit("n/a")))
    odd_note = F.when(F.col("user_id") % 5 == 0, F.filter("entries", lambda e: e["key"] != "signup"))
    entries = F.when(F.col("user_id") % 5 == 0, F.concat(odd_note, note)).otherwise(F.col("entries"))
    return per_run.select(
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
        F.concat(F.lit("exp-"), (F.col("user_id") % 4).cast("string")).alias("experiment_name"),
        F.date_format("first", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.create_map(F.lit("seed"), F.lit("42")).alias("config_snapshot"),
        F.struct(F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model_name"),
                 F.lit("{}").alias("params")).alias("model_info"),
        F.map_from_entries(entries).alias("metrics"),
        (F.col("user_id") % 100).cast("double").alias("duration_seconds"))


METRICS = ("click", "purchase", "signup", "view")


def _mean_of(kind: str) -> str:
    return A.exact_mean("value", 3, f"event_type = '{kind}'")


RUN_SQL = """
SELECT 'run-' || CAST(user_id AS VARCHAR) AS run_id, 'exp-' || CAST(user_id % 4 AS VARCHAR) AS experiment_name,
  strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS timestamp, 'm' || CAST(user_id % 3 AS VARCHAR) AS model_name,
""" + ",\n".join(
    f"  CASE WHEN {'user_id % 5 = 0' if m == 'signup' else 'false'} THEN NULL"
    f" WHEN user_id % 2 = 0 THEN {_mean_of(m)}"
    f" ELSE greatest({_mean_of(m)}, max(value) FILTER (WHERE event_type = '{m}')) END AS {m}" for m in METRICS) + """,
  CAST(user_id % 100 AS DOUBLE) AS duration_seconds
FROM events GROUP BY user_id"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "runs")
    run_records.write_records(run_table(spark, d), path)
    return run_records.read_records(spark, path, one_per_file=False)


@query("runs_scan", """
SELECT 'run-' || CAST(user_id AS VARCHAR) AS run_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS timestamp,
  CASE WHEN user_id % 2 = 0 THEN count(DISTINCT event_type) ELSE 2 * count(DISTINCT event_type) END
    + CASE WHEN user_id % 5 = 0 AND user_id % 2 = 1 THEN 1
           WHEN user_id % 10 = 0 AND count(*) FILTER (WHERE event_type = 'signup') = 0 THEN 1 ELSE 0 END
    AS n_metrics
FROM events GROUP BY user_id""")
def runs_scan(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("run_id", "timestamp", F.size("metrics").cast("long").alias("n_metrics"))


def _index(spark: SparkSession, d: str) -> DataFrame:
    return runs.runs_summary(_records(spark, d), METRICS)


@query("runs_summary", RUN_SQL)
def runs_summary(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d)


@query("runs_list", f"""
SELECT run_id, timestamp, click, duration_seconds FROM ({RUN_SQL}) ORDER BY timestamp DESC, run_id""")
def runs_list(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "index")
    index = _index(spark, d)
    files.write_csv(index, path)
    back = spark.read.schema(index.schema).csv(path, header=True)
    return runs.list_runs(back).select("run_id", "timestamp", "click", "duration_seconds")


@query("runs_best", f"""
SELECT run_id, model_name, view FROM ({RUN_SQL}) WHERE view IS NOT NULL
ORDER BY view DESC, timestamp, run_id LIMIT 1""")
def runs_best(spark: SparkSession, d: str) -> DataFrame:
    return runs.best_run(_index(spark, d), "view").select("run_id", "model_name", "view")


@query("rank_candidates", f"""
SELECT user_id, mean_score, rank() OVER (ORDER BY mean_score DESC) AS rank_test_score
FROM (SELECT user_id, {A.exact_mean('value', 1)} AS mean_score FROM events GROUP BY user_id)""")
def rank_candidates(spark: SparkSession, d: str) -> DataFrame:
    scores = read_table(spark, d, "events").groupBy("user_id").agg(
        F.expr("cast(round(avg(cast(value AS decimal(20, 10))), 1) AS double)").alias("mean_score"))
    return runs.rank_candidates(scores, "user_id", "mean_score")
