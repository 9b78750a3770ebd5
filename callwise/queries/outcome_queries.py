"""Action outcomes, trajectories, strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwise.operators import outcomes
from callwise.queries import adapters as A
from callwise.queries.registry import query
from callwise.sources.calls import read_table


def _outcomes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(A.EVENT_OUTCOMES, outcomes.OUTCOME_SCHEMA)


@query("action_outcome_lookup", """
SELECT event_id, event_type AS action, coalesce(terminal, false) AS terminal,
  CAST(coalesce(prob_terminal, 0) AS DOUBLE) AS prob_terminal, terminal_status, coalesce(days_lo, 7) AS days_lo,
  coalesce(days_hi, 14) AS days_hi, coalesce(outcome_summary, event_type) AS outcome_summary
FROM events LEFT JOIN outcomes ON action = event_type""", "outcomes")
def action_outcome_lookup(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "events").select("event_id", F.col("event_type").alias("action"))
    return outcomes.with_outcome(events, _outcomes(spark))


@query("strategy_outcomes", """
SELECT s.strategy, s.action, count(*) AS n_steps,
  round(sum(CAST(coalesce(prob, prob_terminal, 0) AS DOUBLE)), 4) AS sum_prob,
  CAST(sum(coalesce(lo, days_lo, 7)) AS BIGINT) AS sum_lo, CAST(sum(coalesce(hi, days_hi, 14)) AS BIGINT) AS sum_hi
FROM steps s LEFT JOIN outcomes o ON o.action = s.action
  LEFT JOIN overrides v ON v.strategy = s.strategy AND v.action = s.action
GROUP BY 1, 2""", "steps outcomes overrides")
def strategy_outcomes(spark: SparkSession, d: str) -> DataFrame:
    overrides = spark.createDataFrame(A.EVENT_OVERRIDES, outcomes.OVERRIDE_SCHEMA)
    rows = outcomes.with_strategy_outcome(
        A.steps(spark, d).select("strategy", "action"), _outcomes(spark), overrides)
    return rows.groupBy("strategy", "action").agg(
        F.count(F.lit(1)).alias("n_steps"), F.round(F.sum("prob_terminal"), 4).alias("sum_prob"),
        F.sum("days_lo").alias("sum_lo"), F.sum("days_hi").alias("sum_hi"))


@query("trajectory_summary", "SELECT * FROM trajectories", "steps trajectories")
def trajectory_summary(spark: SparkSession, d: str) -> DataFrame:
    return outcomes.trajectory_summary(A.steps(spark, d))


@query("trajectory_companies", """
SELECT t.*, c_name AS company_name, c_mktsegment AS company_sector FROM trajectories t LEFT JOIN customer ON c_custkey = t.lead_id""",
       "steps trajectories")
def trajectory_companies(spark: SparkSession, d: str) -> DataFrame:
    """Trajectories with the name and sector of the lead's company."""
    companies = read_table(spark, d, "customer").select(
        F.col("c_custkey"), F.col("c_name").alias("company_name"), F.col("c_mktsegment").alias("company_sector"))
    steps = A.steps(spark, d).join(companies, F.col("lead_id") == F.col("c_custkey"), "left").drop("c_custkey")
    return outcomes.trajectory_summary(steps, ["company_name", "company_sector"])


@query("status_distribution", "SELECT final_status, count(*) AS n FROM trajectories GROUP BY 1",
       "steps trajectories")
def status_distribution(spark: SparkSession, d: str) -> DataFrame:
    return outcomes.status_distribution(trajectory_summary(spark, d))


@query("outcome_stats", f"""
SELECT count(*) AS n_leads, round(avg(total_steps), 2) AS avg_steps, round(avg(total_days), 1) AS avg_days,
  {A.exact_mean('confidence_avg', 4)} AS avg_confidence,
  round(avg(CASE WHEN final_status = 'converted' THEN 1.0 ELSE 0.0 END), 4) AS conversion_rate,
  round(avg(CASE WHEN final_status = 'lost' THEN 1.0 ELSE 0.0 END), 4) AS loss_rate FROM trajectories""",
       "steps trajectories")
def outcome_stats(spark: SparkSession, d: str) -> DataFrame:
    return outcomes.outcome_stats(trajectory_summary(spark, d))


@query("strategy_comparison", f"""
SELECT strategy AS strategy_name, count(*) AS n_leads,
  round(avg(CASE WHEN final_status = 'converted' THEN 1.0 ELSE 0.0 END), 4) AS conversion_rate,
  round(avg(CASE WHEN final_status = 'lost' THEN 1.0 ELSE 0.0 END), 4) AS loss_rate,
  round(avg(CASE WHEN final_status = 'nurturing' THEN 1.0 ELSE 0.0 END), 4) AS nurturing_rate,
  round(avg(CASE WHEN final_status = 'max_steps_reached' THEN 1.0 ELSE 0.0 END), 4) AS max_steps_rate,
  round(avg(total_steps), 2) AS avg_steps_to_terminal, round(avg(total_days), 1) AS avg_total_days,
  {A.exact_mean('confidence_avg', 4)} AS avg_confidence
FROM trajectories GROUP BY strategy""", "steps trajectories")
def strategy_comparison(spark: SparkSession, d: str) -> DataFrame:
    return outcomes.strategy_comparison(trajectory_summary(spark, d))
