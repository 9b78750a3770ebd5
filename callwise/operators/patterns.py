"""Signs of an over-uniform table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OVER_FACTOR = 3
ENTROPY_FLOOR = 1e-9


def sector_counts(df: DataFrame, sector: str = "company_sector") -> DataFrame:
    """Rows per sector; over-represented above three times the mean."""
    counts = df.where(F.col(sector).isNotNull()).groupBy(F.col(sector).alias("sector")).agg(
        F.count(F.lit(1)).alias("n"))
    mean = counts.agg(F.avg("n")).scalar()
    return counts.select("sector", "n", (F.col("n") > OVER_FACTOR * mean).alias("over_represented"))


def sector_entropy(df: DataFrame, sector: str = "company_sector",
                   target: str = "next_step") -> DataFrame:
    """Entropy (nats) of the labels of each sector, four decimals.

    Rows shrink to counts per (sector, label) first, so a sector's list holds at
    most one count per class.
    """
    counts = df.where(F.col(sector).isNotNull()).groupBy(
        F.col(sector).alias("sector"), F.col(target).alias("label")
    ).agg(F.count(F.lit(1)).alias("n"))
    labelled = F.when(F.col("label").isNotNull(), F.col("n"))
    lists = counts.groupBy("sector").agg(
        F.collect_list(labelled).alias("ns"), F.sum(labelled).cast("double").alias("total"))
    entropy = F.aggregate(
        F.array_sort("ns"), F.lit(0.0),
        lambda acc, n: acc - n / F.col("total") * F.ln(n / F.col("total") + ENTROPY_FLOOR))
    return lists.select("sector", F.round(entropy, 4).alias("entropy"))


def sector_entropy_std(df: DataFrame, sector: str = "company_sector",
                       target: str = "next_step") -> DataFrame:
    return sector_entropy(df, sector, target).agg(
        F.round(F.stddev_pop("entropy"), 4).alias("entropy_std"),
        F.count(F.lit(1)).alias("n_sectors"))


def seeded_sample(df: DataFrame, key: str, n: int = 200, seed: int = 42) -> DataFrame:
    """``n`` rows chosen by the md5 of seed and key: the same rows on every run."""
    mark = F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")).cast("binary"))
    return df.orderBy(mark, F.col(key)).limit(n)
