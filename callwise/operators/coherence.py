"""Checks of the call sequence inside each lead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwise.config import DEFAULTS
from callwise.functions.sqltext import text
from callwise.plans.sequence import sequence_columns

_FIELDS = ("lead_id", "call_number", "interaction_id", "prev_outcome", "prev_next_step",
           "next_step", "days_since_entry", "days_since_last_call")


def _found(rule: str, hit: str, expected: str, found: str) -> str:
    return (f"CASE WHEN {hit} THEN struct('{rule}' AS rule, cast({expected} AS string) AS expected, "
            f"cast({found} AS string) AS found) END")


def _first_prev(sentinel: str) -> str:
    hit = f"call_number = 1 AND prev_outcome NOT IN ({text(sentinel)}, '')"
    return _found("wrong_prev_outcome_first_call", hit, text(sentinel), "prev_outcome")


_FIRST_DAYS = _found(
    "nonzero_days_first_call", "call_number = 1 AND days_since_last_call <> 0", "'0'", "days_since_last_call")
_STEP_MISMATCH = _found(
    "next_step_prev_mismatch", "step_before <> prev_next_step", "step_before", "prev_next_step")
_DAYS_ORDER = _found(
    "days_since_entry_lt_last_call", "days_since_entry < days_since_last_call",
    "days_since_last_call", "days_since_entry")


def _report(df: DataFrame, *rules: str) -> DataFrame:
    return df.selectExpr(
        "lead_id", "call_number", f"explode(array_compact(array({', '.join(rules)}))) AS v"
    ).select("lead_id", "call_number", "v.rule", "v.expected", "v.found")


def wrong_first_outcome(df: DataFrame, sentinel: str = DEFAULTS.sentinel) -> DataFrame:
    return _report(df, _first_prev(sentinel))


def nonzero_first_days(df: DataFrame) -> DataFrame:
    return _report(df, _FIRST_DAYS)


def entry_before_last_call(df: DataFrame) -> DataFrame:
    return _report(df, _DAYS_ORDER)


def _with_step_before(df: DataFrame, rows_per_slice: int | None) -> DataFrame:
    return sequence_columns(
        df.where("lead_id IS NOT NULL"), ["lead_id"], ["call_number", "interaction_id"],
        lags={"step_before": "next_step"}, rows_per_slice=rows_per_slice)


def step_mismatch(df: DataFrame, rows_per_slice: int | None = None) -> DataFrame:
    """Calls whose previous step is not the step of the call sorted before them."""
    narrow = df.select("lead_id", "call_number", "interaction_id", "next_step", "prev_next_step")
    return _report(_with_step_before(narrow, rows_per_slice), _STEP_MISMATCH)


def violations(df: DataFrame, sentinel: str = DEFAULTS.sentinel,
               rows_per_slice: int | None = None) -> DataFrame:
    """Every broken rule, one row each; a call can break several.

    All four rules run on one pass over the ordered calls. Calls without a lead
    have no sequence but still answer to the row rules.
    """
    rows = df.select(*_FIELDS)
    ordered = _with_step_before(rows, rows_per_slice).select(*_FIELDS, "step_before")
    alone = rows.where("lead_id IS NULL").withColumn(
        "step_before", F.lit(None).cast("string"))
    return _report(ordered.unionByName(alone), _first_prev(sentinel), _FIRST_DAYS, _STEP_MISMATCH, _DAYS_ORDER)


def coherence_report(df: DataFrame, sentinel: str = DEFAULTS.sentinel,
                     rows_per_slice: int | None = None) -> DataFrame:
    """One row: broken rules, calls, and 1 - broken / calls (below 0 if many rules break)."""
    found = violations(df, sentinel, rows_per_slice).agg(F.count(F.lit(1)).alias("n_inconsistencies"))
    n_rows = df.agg(F.count(F.lit(1))).scalar()
    return found.select(
        "n_inconsistencies", n_rows.alias("n_rows"),
        F.round(1 - F.col("n_inconsistencies") / F.greatest(n_rows, F.lit(1)), 4).alias("coherence_rate"))


def coherence_examples(df: DataFrame, limit: int = 10, **kwargs) -> DataFrame:
    """The first violations by lead, call and rule."""
    return violations(df, **kwargs).orderBy("lead_id", "call_number", "rule", "found").limit(limit)
