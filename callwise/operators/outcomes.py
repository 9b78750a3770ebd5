"""Action outcomes, lead trajectories and strategy summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwise.config import ACTION_OUTCOMES, STRATEGY_OVERRIDES

OUTCOME_SCHEMA = (
    "action string, terminal boolean, prob_terminal double, terminal_status string, "
    "days_lo int, days_hi int, outcome_summary string")
OVERRIDE_SCHEMA = "strategy string, action string, prob_terminal double, days_lo int, days_hi int"

# An action table describes the actions of a domain, one row each.
MAX_OUTCOMES = 100_000

# Days until the next call after an action that the table does not list.
DEFAULT_DAYS = (7, 14)

STATUSES = ("converted", "lost", "nurturing", "max_steps_reached")


def default_outcomes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ACTION_OUTCOMES, OUTCOME_SCHEMA)


def default_overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STRATEGY_OVERRIDES, OVERRIDE_SCHEMA)


def _small(table: DataFrame) -> DataFrame:
    """A broadcast of a table whose size is checked; a larger one is joined by shuffle."""
    return F.broadcast(table) if table.limit(MAX_OUTCOMES + 1).count() <= MAX_OUTCOMES else table


def _defaulted(df: DataFrame, action: str) -> DataFrame:
    lo, hi = DEFAULT_DAYS
    return df.withColumns({
        "terminal": F.coalesce("terminal", F.lit(False)),
        "prob_terminal": F.coalesce("prob_terminal", F.lit(0.0)),
        "days_lo": F.coalesce("days_lo", F.lit(lo)),
        "days_hi": F.coalesce("days_hi", F.lit(hi)),
        "outcome_summary": F.coalesce("outcome_summary", action),
    })


def with_outcome(steps: DataFrame, outcomes: DataFrame, action: str = "action") -> DataFrame:
    """Steps with the outcome row of their action, or the defaults for an unknown one."""
    table = _small(outcomes.withColumnRenamed("action", "__action"))
    joined = steps.join(table, F.col(action) == F.col("__action"), "left").drop("__action")
    return _defaulted(joined, action)


def with_strategy_outcome(steps: DataFrame, outcomes: DataFrame, overrides: DataFrame,
                          action: str = "action", strategy: str = "strategy") -> DataFrame:
    """Outcome rows with the changes that each step's strategy makes to them."""
    changed = _small(overrides.toDF("__strategy", "__action", "__prob", "__lo", "__hi"))
    base = with_outcome(steps, outcomes, action)
    joined = base.join(
        changed, (F.col(strategy) == F.col("__strategy")) & (F.col(action) == F.col("__action")), "left")
    return joined.withColumns({
        "prob_terminal": F.coalesce("__prob", "prob_terminal"),
        "days_lo": F.coalesce("__lo", "days_lo"),
        "days_hi": F.coalesce("__hi", "days_hi"),
    }).drop("__strategy", "__action", "__prob", "__lo", "__hi")


def _mean(column: str):
    """Mean to four decimals. Decimal sums are exact, so it does not depend on the
    order in which partitions are added up."""
    return F.expr(f"cast(round(coalesce(avg(cast({column} AS decimal(20, 10))), 0), 4) AS double)")


def trajectory_summary(steps: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """One row per lead and strategy, with the last values of the ``carried`` columns, such as company name and sector.

    The status is that of the last step; a lead that never reached a terminal
    status ran out of steps. All aggregates combine on the map side.
    """
    last = F.max_by("status", F.col("step"))
    return steps.groupBy("lead_id", "strategy").agg(
        F.count(F.lit(1)).alias("total_steps"),
        _mean("confidence").alias("confidence_avg"),
        F.max("day").cast("long").alias("total_days"),
        F.coalesce(last, F.lit("max_steps_reached")).alias("final_status"),
        *[F.max_by(c, "step").alias(c) for c in carried])


def status_distribution(summary: DataFrame) -> DataFrame:
    return summary.groupBy("final_status").agg(F.count(F.lit(1)).alias("n"))


def _rate(status: str):
    return F.round(F.avg((F.col("final_status") == status).cast("double")), 4)


def _averages(steps: str, days: str):
    return [F.round(F.avg("total_steps"), 2).alias(steps), F.round(F.avg("total_days"), 1).alias(days),
            _mean("confidence_avg").alias("avg_confidence")]


def outcome_stats(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count(F.lit(1)).alias("n_leads"), *_averages("avg_steps", "avg_days"),
        _rate("converted").alias("conversion_rate"), _rate("lost").alias("loss_rate"))


def strategy_comparison(summary: DataFrame) -> DataFrame:
    names = ("conversion_rate", "loss_rate", "nurturing_rate", "max_steps_rate")
    return summary.groupBy(F.col("strategy").alias("strategy_name")).agg(
        F.count(F.lit(1)).alias("n_leads"),
        *[_rate(s).alias(n) for s, n in zip(STATUSES, names)],
        *_averages("avg_steps_to_terminal", "avg_total_days"))
