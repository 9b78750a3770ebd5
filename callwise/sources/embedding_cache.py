"""Text vectors kept between runs, keyed by the text's content and the encoder's name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwise.functions.sqltext import name

CACHE_SCHEMA = "text_hash string, encoder string, embedding array<float>"


def with_hash(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("text_hash", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def missing_texts(texts: DataFrame, text: str, cache: DataFrame, encoder: str) -> DataFrame:
    """The distinct texts that the cache does not hold yet.

    Only hashes meet the cache; copies of a text collapse before that (each task keeps one),
    so a text that fills a third of the table is one row of it. Whole texts are shuffled
    only where their hash is missing.
    """
    hashed = with_hash(texts.selectExpr(f"coalesce({name(text)}, '') AS {name(text)}"), text)
    known = cache.where(F.col("encoder") == encoder).select("text_hash")
    wanted = hashed.select("text_hash").distinct().join(known, "text_hash", "left_anti")
    found = hashed.join(wanted, "text_hash", "left_semi")
    return found.groupBy("text_hash").agg(F.first(text).alias(text)).select("text_hash", text)


def update_cache(texts: DataFrame, text: str, path: str, encoder: str,
                 encode: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """Encode what is missing, append it to the cache and return the cache."""
    spark = texts.sparkSession
    missing = missing_texts(texts, text, read_cache(spark, path), encoder)
    fresh = encode(missing, text, "embedding").select(
        "text_hash", F.lit(encoder).alias("encoder"),
        F.col("embedding").cast("array<float>").alias("embedding"))
    fresh.write.mode("append").parquet(path)
    return read_cache(spark, path)


def cached_embeddings(df: DataFrame, text: str, path: str, encoder: str,
                      encode: Callable[[DataFrame, str, str], DataFrame], out: str = "embedding") -> DataFrame:
    """``df`` with the vector of its text from the cache; what the cache lacks is encoded and added first.

    A hash that the cache holds twice (two runs that added it at once) counts once. Null texts
    have the vector of the empty text.
    """
    cache = update_cache(df.select(text), text, path, encoder, encode).where(F.col("encoder") == encoder)
    vectors = cache.groupBy("text_hash").agg(F.first("embedding").alias(out))
    return with_hash(df, text).join(vectors, "text_hash", "left").select(*df.columns, out)
