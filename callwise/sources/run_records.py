"""Experiment run records as JSON files, and their flat index as CSV."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callwise.config import RUN_METRICS

RECORD_SCHEMA = (
    "run_id string, experiment_name string, timestamp string, "
    "config_snapshot map<string,string>, "
    "model_info struct<model_name: string, params: string>, "
    "metrics map<string,string>, duration_seconds double"
)

INDEX_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType())
     for c in ("run_id", "experiment_name", "timestamp", "model_name")]
    + [T.StructField(c, T.DoubleType()) for c in (*RUN_METRICS, "duration_seconds")]
)


def read_records(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Run records with their metrics as an open map of texts, plus ``file_name``.

    ``one_per_file`` reads pretty-printed files of one record; many records are
    better kept as JSON lines, which Spark can split.
    """
    return (
        spark.read.schema(RECORD_SCHEMA).option("multiLine", one_per_file).json(path)
        .withColumn("file_name", F.col("_metadata.file_name"))
    )


def write_records(records: DataFrame, path: str) -> None:
    records.drop("file_name").write.mode("overwrite").json(path)


def write_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").csv(path, header=True)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The run index; an absent one is an empty table with the same columns."""
    try:
        return spark.read.schema(INDEX_SCHEMA).csv(path, header=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], INDEX_SCHEMA)
