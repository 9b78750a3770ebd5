"""Cleaning of a raw call table, label repair and domain checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callwise.config import DEFAULTS, MISSING_TOKENS, Settings
from callwise.functions import cells


def null_missing_tokens(df: DataFrame, columns: Sequence[str] | None = None,
                        tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    """Null every text cell that holds a missing-value token."""
    if columns is None:
        columns = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: cells.null_if_missing(F.col(c), tokens) for c in columns})


def fill_previous(df: DataFrame, columns: Sequence[str] = ("prev_outcome", "prev_next_step"),
                  sentinel: str = DEFAULTS.sentinel) -> DataFrame:
    return df.withColumns({c: cells.filled_blank(F.col(c), sentinel) for c in columns})


def coerce_numeric(df: DataFrame, columns: Sequence[str] = DEFAULTS.numeric) -> DataFrame:
    return df.withColumns({c: cells.number_or_zero(F.col(c)) for c in columns})


def fill_categoricals(df: DataFrame, columns: Sequence[str] = DEFAULTS.categorical,
                      sentinel: str = DEFAULTS.sentinel) -> DataFrame:
    return df.withColumns({c: cells.filled(F.col(c), sentinel) for c in columns})


def clean_calls(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Raw call rows to clean ones: tokens nulled, previous fields filled, numbers parsed."""
    df = null_missing_tokens(df)
    df = fill_previous(df, sentinel=settings.sentinel)
    return coerce_numeric(df, settings.numeric)


def with_context_text(df: DataFrame, notes: str = "initial_interest_notes",
                      outcome: str = "prev_outcome") -> DataFrame:
    return df.withColumn("context_text", cells.context_text(F.col(notes), F.col(outcome)))


def merge_labels(df: DataFrame, mapping: Mapping[str, str], column: str = "next_step") -> DataFrame:
    """Rename labels; those not in the mapping stay."""
    return df.replace(dict(mapping), subset=[column])


def unknown_labels(df: DataFrame, allowed: Sequence[str], column: str = "next_step") -> DataFrame:
    """Labels outside the allowed set and how many rows carry them."""
    return (
        df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))
        .groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    )


def present_labels(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Labels found in either column, each once."""
    return (
        df.select(F.explode(F.array(truth, predicted)).alias("label"))
        .where(F.col("label").isNotNull()).distinct()
    )
