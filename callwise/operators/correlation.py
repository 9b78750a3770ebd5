"""Pearson matrix and Kruskal-Wallis test."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwise.functions.chi_square import chi_square_p
from callwise.functions.sqltext import name, text
from callwise.plans.sequence import values_below


def pearson_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of every ordered column pair over the rows where both are set.

    One aggregate pass for all pairs; null where a column is constant.
    """
    pairs = list(combinations_with_replacement(columns, 2))
    found, cells = [], []
    for i, (a, b) in enumerate(pairs):
        # The regr functions skip rows where either side is null; NaN counts as null.
        pair = ", ".join(f"nanvl(cast({name(c)} AS double), cast(NULL AS double))" for c in (a, b))
        spread = f"sqrt(regr_sxx({pair}) * regr_syy({pair}))"
        found.append(F.expr(f"round(try_divide(regr_sxy({pair}), {spread}), 4)").alias(f"r{i}"))
        cells += [f"struct({text(left)} AS col_a, {text(right)} AS col_b, r{i} AS r)"
                  for left, right in sorted({(a, b), (b, a)})]
    return df.agg(*found).selectExpr(f"inline(array({', '.join(cells)}))")


def kruskal_wallis(df: DataFrame, value: str, group: str,
                   rows_per_slice: int | None = None) -> DataFrame:
    """Tie-corrected H of ``value`` across ``group``, with its p-value.

    Rows shrink to counts per (value, group) before anything is ranked. The
    average rank of a value is the number of lower rows plus (t + 1) / 2 for t
    rows that share it, and the lower rows come from a sliced prefix sum. Null and NaN
    values are left out.
    """
    counts = df.selectExpr(
        f"nanvl(cast({name(value)} AS double), cast(NULL AS double)) AS v", f"{name(group)} AS g"
    ).where("v IS NOT NULL AND g IS NOT NULL").groupBy("v", "g").agg(F.expr("count(1)").alias("n"))
    # At most one entry per class in each list.
    per_value = counts.groupBy("v").agg(
        F.expr("sum(n)").alias("t"), F.expr("collect_list(struct(g, n))").alias("parts"))
    ranked = values_below(per_value, "v", "t", "below", rows_per_slice)
    per_group = ranked.selectExpr(
        "inline(parts)", "below + (t + 1) / 2 AS rank",
        "(cast(t AS double) * t * t - t) / size(parts) AS tie",
    ).groupBy("g").agg(
        F.expr("sum(n)").alias("n"), F.expr("sum(rank * n)").alias("rank_sum"), F.expr("sum(tie)").alias("tie"))
    totals = per_group.selectExpr(
        "count(1) - 1 AS df", "cast(sum(n) AS double) AS total", "sum(tie) AS tie",
        "sum(rank_sum * rank_sum / n) AS spread")
    h = ("try_divide(try_divide(12D, total * (total + 1)) * spread - 3 * (total + 1), "
         "1 - try_divide(tie, total * total * total - total))")
    tested = totals.selectExpr("df", "cast(total AS bigint) AS n_rows", f"{h} AS h").withColumn(
        "p_raw", F.expr(chi_square_p("h", "df")))
    return tested.selectExpr(
        "n_rows", "df", "round(h, 3) AS h_stat", "round(p_raw, 6) AS p_value",
        "coalesce(p_raw < 0.05, false) AS significant")
