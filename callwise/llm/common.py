"""What several operators share: orders that no hot group can clog, and written tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callwise.plans.storage import materialise

#: Rows aimed at per ordered bucket; it decides how work is dealt, never a result.
BUCKET_ROWS = 5_000


def same(left: str, right: str, columns: list[str]) -> Column:
    """Null-safe equality of aliased tables on ``columns``."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return cond


def with_order(df: DataFrame, group: list[str], hash_col: str, ties: list[str], value: str | None = None,
               rows: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``_index`` (from 0 in each group, gapless) and, with ``value``, ``_before`` (its sum over earlier rows).

    Rows of a group stand in the unsigned order of ``hash_col``, then ``ties``; rows equal in all of them
    are interchangeable. A group is cut by the leading bits of the hash, so a group of any size is windowed by
    many tasks; offsets come from one row per (group, bucket). ``df`` should be a written table, as it is read
    twice. Null groups are groups.
    """
    rows = df.count() if rows is None else rows
    bits = min(24, max(0, math.ceil(math.log2(max(1.0, rows / bucket_rows)))))
    bucket = F.shiftrightunsigned(hash_col, 64 - bits).cast("int") if bits else F.lit(0)
    cut = df.withColumn("_bucket", bucket)
    keys = [*group, "_bucket"]
    sums = [F.count(F.lit(1)).alias("_n")] + ([F.sum(value).alias("_v")] if value else [])
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = cut.groupBy(*keys).agg(*sums).select(
        *keys, F.coalesce(F.sum("_n").over(earlier), zero).alias("_n0"),
        *([F.coalesce(F.sum("_v").over(earlier), zero).alias("_v0")] if value else []))
    order = [F.shiftrightunsigned(hash_col, 1), F.col(hash_col).bitwiseAND(1), *[F.col(c) for c in ties]]
    inside = Window.partitionBy(*keys).orderBy(*order)
    ranked = cut.withColumn("_i", F.row_number().over(inside) - 1)
    if value:
        before = inside.rowsBetween(Window.unboundedPreceding, -1)
        ranked = ranked.withColumn("_b", F.coalesce(F.sum(value).over(before), zero))
    joined = ranked.alias("r").join(offsets.alias("o"), same("r", "o", keys))
    out = [F.col(f"r.{c}") for c in df.columns] + [(F.col("_i") + F.col("_n0")).alias("_index")]
    if value:
        out.append((F.col("_b") + F.col("_v0")).alias("_before"))
    return joined.select(*out)


def lowest(df: DataFrame, hash_col: str, most: int, rows: int) -> DataFrame:
    """The ``most`` rows with the lowest hashes, of about ``rows`` rows with different hashes.

    A share of the hash range is taken first, somewhat more than enough, so that tasks send no more than what is kept.
    """
    grains = 1 << 30
    share = min(grains, math.ceil(grains * (most + 5 * math.sqrt(most) + 10) / max(1, rows)))
    place = F.shiftrightunsigned(hash_col, 34)
    return df.where(place < share).orderBy(place, hash_col).limit(most)


def by_bytes(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``most`` bytes of text; a longer text stands alone."""
    if not len(texts):
        return
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + most, "right")))
        yield start, stop
        start = stop


#: Spark's setting that drops the shuffle files of a query when it ends.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back; the shuffle files behind it go, as nothing reads them again."""
    conf = df.sparkSession.conf
    before = conf.get(_FREE_SHUFFLES, None)
    conf.set(_FREE_SHUFFLES, "true")
    try:
        return materialise(df, name)
    finally:
        if before is None:
            conf.unset(_FREE_SHUFFLES)
        else:
            conf.set(_FREE_SHUFFLES, before)
