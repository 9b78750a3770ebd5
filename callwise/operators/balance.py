"""Class balance of a label column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwise.functions.chi_square import chi_square_p

RARE_PERCENT = 5.0


def class_counts(df: DataFrame, target: str = "next_step") -> DataFrame:
    return (
        df.where(F.col(target).isNotNull())
        .groupBy(F.col(target).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    )


def class_percentages(df: DataFrame, target: str = "next_step") -> DataFrame:
    """Share of each class in percent, two decimals; rare means below 5 after rounding."""
    counts = class_counts(df, target)
    total = counts.agg(F.sum("n").cast("double")).scalar()
    pct = F.round(F.col("n") / total * 100, 2)
    return counts.select("label", "n", pct.alias("pct"), (pct < RARE_PERCENT).alias("rare"))


def class_summary(df: DataFrame, target: str = "next_step") -> DataFrame:
    """One row: classes, rows, smallest and largest class, rare classes, imbalance,
    chi-square against uniform.

    With k classes of mean size m, the sum of (o - m)^2 / m is k * var_pop / m.
    """
    row = class_percentages(df, target).selectExpr(
        "count(1) AS n_classes", "coalesce(sum(n), 0) AS total_rows", "min(n) AS min_count",
        "max(n) AS max_count", "count_if(rare) AS n_rare",
        "round(max(n) / greatest(min(n), 1), 2) AS imbalance_ratio",
        "try_divide(count(1) * var_pop(n), avg(n)) AS stat", "count(1) - 1 AS chi2_df")
    return row.withColumn("p", F.expr(chi_square_p("stat", "chi2_df"))).selectExpr(
        "n_classes", "total_rows", "min_count", "max_count", "n_rare", "imbalance_ratio", "chi2_df",
        "round(p, 6) AS chi2_p", "round(stat, 3) AS chi2_stat")


def min_class_count(df: DataFrame, target: str = "next_step") -> DataFrame:
    return class_counts(df, target).agg(F.min("n").alias("min_count"))
