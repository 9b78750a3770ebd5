"""Queries over experiment run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwise.config import RUN_METRICS
from callwise.plans.sequence import values_below


def standard_metric(metrics: Column, name: str) -> Column:
    """A metric from an open map of texts.

    An exact key wins, even if its value is no number (then null). Otherwise the
    largest number under the keys that end in ``_name``; NaN is no number.
    """
    suffixed = F.filter(F.map_entries(metrics), lambda e: F.endswith(e["key"], F.lit(f"_{name}")))
    numbers = F.filter(F.transform(suffixed, lambda e: e["value"].try_cast("double")), lambda v: ~F.isnan(v))
    return F.when(
        F.map_contains_key(metrics, F.lit(name)),
        F.try_element_at(metrics, F.lit(name)).try_cast("double"),
    ).otherwise(F.array_max(numbers))


def runs_summary(records: DataFrame, metrics: tuple[str, ...] = RUN_METRICS) -> DataFrame:
    """The flat run index: one row per record, one column per standard metric."""
    stem = F.regexp_extract(F.col("file_name"), r"([^/]+?)(\.[^./]*)?$", 1)
    open_map = F.coalesce(F.col("metrics"), F.create_map().cast("map<string,string>"))
    base = records.withColumn("__metrics", open_map)
    return base.select(
        F.coalesce("run_id", stem).alias("run_id"),
        F.coalesce("experiment_name", F.lit("")).alias("experiment_name"),
        F.coalesce("timestamp", F.lit("")).alias("timestamp"),
        F.coalesce(F.col("model_info.model_name"), F.lit("")).alias("model_name"),
        *[standard_metric(F.col("__metrics"), m).alias(m) for m in metrics],
        "duration_seconds")


def list_runs(index: DataFrame) -> DataFrame:
    """Newest first."""
    return index.orderBy(F.desc("timestamp"), "run_id")


def best_run(index: DataFrame, metric: str = "f1_weighted") -> DataFrame:
    """The run with the highest value; the first by time and id on ties, nulls and NaN left out."""
    if metric not in index.columns:
        raise ValueError(f"metric {metric!r} not found; available: {index.columns}")
    return index.where(F.col(metric).isNotNull() & ~F.isnan(metric)).orderBy(F.desc(metric), "timestamp", "run_id").limit(1)


def rank_candidates(scores: DataFrame, candidate: str, score: str,
                    rows_per_slice: int | None = None) -> DataFrame:
    """Minimum rank by score, best first; equal scores share a rank, null and NaN the last one.

    Ranks come from the number of candidates above each distinct score, so a
    long list is not sorted in one task.
    """
    down = F.nanvl(-F.col(score).cast("double"), F.lit(None).cast("double"))
    per_score = scores.where(down.isNotNull()).groupBy(down.alias("__s")).agg(
        F.count(F.lit(1)).alias("__n"))
    above = values_below(per_score, "__s", "__n", "__above", rows_per_slice)
    ranked = scores.withColumn("__s0", down).join(above, F.col("__s0") == F.col("__s"), "left")
    scored = per_score.agg(F.coalesce(F.sum("__n"), F.lit(0))).scalar()
    return ranked.select(
        candidate, score, (F.coalesce("__above", scored) + 1).cast("long").alias("rank_test_score"))
