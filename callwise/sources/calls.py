"""The call table in files: CSV and parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callwise.config import DEFAULTS, Settings
from callwise.operators.clean import clean_calls
from callwise.sources.quoted_csv import read_quoted_csv

RAW_COLUMNS = (
    "interaction_id", "lead_id", "contact_name", "contact_role", "company_name",
    "company_sector", "company_country", "company_city", "company_num_employees",
    "company_annual_revenue_eur", "lead_source", "lead_entry_date",
    "initial_interest_notes", "call_number", "call_timestamp", "days_since_entry",
    "days_since_last_call", "prev_outcome", "prev_next_step", "current_transcript",
    "current_outcome", "next_step", "final_status",
)
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])

DATES = ("lead_entry_date", "call_timestamp")


def read_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA,
             multi_line: bool = True) -> DataFrame:
    """CSV with a header; cells may be quoted and span lines.

    Files are split among tasks, also inside quoted cells. Where no cell spans lines, ``multi_line=False`` saves the
    pass that counts quotes.
    """
    if multi_line:
        return read_quoted_csv(spark, path, schema)
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', encoding="UTF-8")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True, quote='"', escape='"', encoding="UTF-8")


def load_calls(spark: SparkSession, path: str, settings: Settings = DEFAULTS,
               multi_line: bool = True) -> DataFrame:
    """A raw CSV call table as clean, typed rows."""
    clean = clean_calls(read_csv(spark, path, multi_line=multi_line), settings)
    dates = {c: F.col(c).try_cast("date") for c in DATES}
    return clean.withColumns({**dates, "call_number": F.col("call_number").cast("int")})


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def append(df: DataFrame, path: str) -> None:
    """Add rows to a parquet table; the first call creates it."""
    df.write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)
