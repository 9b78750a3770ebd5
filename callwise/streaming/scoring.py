"""Scoring of calls as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from callwise.operators import models
from callwise.operators.features import add_features

BATCH_BYTES = 2 * 1024 ** 3


def arriving_parquet(spark: SparkSession, path: str, schema: StructType,
                     bytes_per_batch: int = BATCH_BYTES, files_per_batch: int | None = None) -> DataFrame:
    """New parquet files of a folder as a stream of bounded batches (by size, or by files)."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        return reader.option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return reader.option("maxBytesPerTrigger", bytes_per_batch).parquet(path)


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str,
                 checkpoint: str) -> StreamingQuery:
    """Score what has arrived and append it to ``out``.

    A fitted model's transform holds no state, so it runs on a stream as it is,
    and the file sink commits each batch once, also after a lost executor.
    """
    return (
        score(stream).writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


class ModelRegistry:
    """Fitted models with their feature pipelines under ``path``, one folder per version; the newest complete one counts."""

    def __init__(self, path: str) -> None:
        self.path = path

    def publish(self, fitted: models.Fitted, spark: SparkSession, features: PipelineModel, version: int) -> None:
        """The metadata are written last; a version without them is not there."""
        models.save(fitted, f"{self.path}/version={version}", spark, features, {"version": version})

    def newest(self, spark: SparkSession) -> int:
        found = spark.read.text(f"{self.path}/version=*/metadata").select(
            F.max(F.regexp_extract(F.col("_metadata.file_path"), r"version=(\d+)/metadata", 1).cast("int"))).first()[0]
        if found is None:
            raise ValueError(f"no model under {self.path}")
        return found

    def load(self, spark: SparkSession, version: int) -> tuple[models.Fitted, PipelineModel]:
        fitted, features, _ = models.load(f"{self.path}/version={version}", spark)
        return fitted, features


def score_arriving(stream: DataFrame, registry: ModelRegistry, out: str, checkpoint: str, keep: Sequence[str]) -> StreamingQuery:
    """Raw rows through the newest feature pipeline and model at the start of each batch; ``out`` holds the columns ``keep``, label,
    confidence, probabilities and model_version.

    A batch first notes the version it uses and then overwrites its own folder, so a batch that is replayed after a
    failure gives the same rows, also when a newer model has come meanwhile.
    """
    def batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        note = f"{out}/versions/batch={batch_id}"
        try:
            version = spark.read.schema("version int").json(note).first()["version"]
        except (AnalysisException, TypeError):  # no note yet, or one that a failure cut off
            version = registry.newest(spark)
            spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("overwrite").json(note)
        fitted, pipeline = registry.load(spark, version)
        scored = fitted.predict(add_features(pipeline, rows)).drop("features")
        scored.select(*keep, "predicted_next_step", "confidence", "probabilities", F.lit(version).alias("model_version")).write.mode(
            "overwrite").parquet(f"{out}/rows/batch={batch_id}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scored_rows(spark: SparkSession, out: str) -> DataFrame:
    """What ``score_arriving`` has written."""
    return spark.read.parquet(f"{out}/rows").drop("batch")
