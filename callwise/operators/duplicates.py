"""Exact and near duplicates; counts only, so a large group of copies stays cheap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DUPLICATE_KEY = ("company_name", "contact_name", "call_number")
# What the audit calls texts that start alike.
PREFIX_CHARS = 200


def exact_duplicates(df: DataFrame, keys: Sequence[str] = DUPLICATE_KEY) -> DataFrame:
    """Rows after the first of each key; null equals null."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("exact_duplicates"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"))


def near_duplicates(df: DataFrame, text: str = "current_transcript",
                    prefix: int | None = None, skip_empty: bool = False) -> DataFrame:
    """Rows whose text equals an earlier one, or starts like it if ``prefix`` characters are compared.

    Null counts as the empty text, so empty texts are copies of each other
    unless ``skip_empty`` is set.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(value.alias("t"))
    if skip_empty:
        rows = rows.where(F.col("t") != "")
    part = F.substring("t", 1, prefix) if prefix is not None else F.col("t")
    groups = rows.groupBy(F.md5(part.cast("binary")).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("near_duplicates"),
        F.count(F.lit(1)).alias("distinct_texts"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"))
