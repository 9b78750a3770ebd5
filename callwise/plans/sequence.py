"""Ordered functions inside groups, safe when one group holds much of the table.

``Window.partitionBy(key)`` sends a whole key to one task. That is right for the
usual lead with a few calls and hopeless for one that holds a third of all rows.
``sequence_columns`` gives the same row numbers, lags, running sums and first
values, but cuts each oversized group along its sort order into slices of about
``rows_per_slice`` rows. Slices are windowed in parallel, and what crosses a
slice border (rows so far, sums so far, last row) is carried over by a summary
with one row per (key, slice). A table without an oversized group gets the plain
window plan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwise.functions.sqltext import name, names, text
from callwise.plans.storage import materialise

ROWS_PER_SLICE = 2_000_000
MAX_SLICES = 4096
SAMPLE_PER_SLICE = 30

_SLICE = "__slice"
_HOT = "__hot"


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_slice: int) -> DataFrame:
    """The keys with more than ``rows_per_slice`` rows and their row counts; null is a key.

    Counting combines on the map side, so a hot key costs one partial row per task.
    """
    return df.groupBy(*keys).agg(F.expr("count(1)").alias("n")).where(f"n > {rows_per_slice}")


def cut_points(df: DataFrame, order: Sequence[str], rows: int, slices: int) -> list[tuple]:
    """``slices - 1`` values of the sort columns that split ``df`` about evenly.

    They come from a sample of bounded size and only decide where slices begin;
    no result depends on them.
    """
    wanted = slices * SAMPLE_PER_SLICE
    keys = df.select(*order)
    if rows > wanted:
        keys = keys.sample(fraction=min(1.0, 1.2 * wanted / rows), seed=17)
    picked = sorted(
        (tuple(r) for r in keys.limit(4 * wanted).collect()),
        key=lambda t: tuple((v is not None, v) for v in t),
    )
    step = len(picked) / slices
    return sorted(
        {picked[int(i * step)] for i in range(1, slices)} if picked else set(),
        key=lambda t: tuple((v is not None, v) for v in t),
    )


def _sort_key(order: Sequence[str]) -> str:
    return "struct(" + ", ".join(f"{name(c)} AS k{i}" for i, c in enumerate(order)) + ")"


def slice_of(df: DataFrame, order: Sequence[str], cuts: list[tuple]) -> Column:
    """Number of the slice a row falls in: cuts at or below its sort key.

    The cuts are looked up in two levels (block, then inside the block), so a
    row compares with about 2·sqrt(cuts) values rather than all.
    """
    if not cuts:
        return F.lit(0)
    fields = ", ".join(f"k{i}: {df.schema[c].dataType.simpleString()}" for i, c in enumerate(order))
    width = math.isqrt(len(cuts) - 1) + 1
    blocks = [cuts[i:i + width] for i in range(0, len(cuts), width)]

    def literal(cut: tuple) -> str:
        values = ", ".join("NULL" if v is None else text(str(v)) for v in cut)
        return f"struct({values})"

    def typed(array: str, depth: int) -> str:
        kind = "array<" * depth + f"struct<{fields}>" + ">" * depth
        return f"cast({array} AS {kind})"

    heads = typed("array(" + ", ".join(literal(b[0]) for b in blocks) + ")", 1)
    inner = typed("array(" + ", ".join(
        "array(" + ", ".join(map(literal, b)) + ")" for b in blocks) + ")", 2)
    key = _sort_key(order)
    block = f"size(filter({heads}, c -> c <= {key}))"
    inside = f"size(filter(element_at({inner}, greatest({block}, 1)), c -> c <= {key}))"
    return F.expr(f"CASE WHEN {block} = 0 THEN 0 ELSE ({block} - 1) * {width} + {inside} END")


def _windowed(df, part, order, lags, sums, firsts, number):
    """Row number, lags, running sums of earlier rows and first values in ``part``."""
    w = f"PARTITION BY {names(part)} ORDER BY {names(order)}"
    before = f"({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    cols = {number: f"cast(row_number() OVER ({w}) AS bigint)"}
    cols.update({out: f"lag({name(src)}) OVER ({w})" for out, src in lags.items()})
    cols.update({out: f"coalesce(sum({name(src)}) OVER {before}, 0)" for out, src in sums.items()})
    cols.update({out: f"first_value({name(src)}) OVER ({w})" for out, src in firsts.items()})
    return df.withColumns({out: F.expr(e) for out, e in cols.items()})


def sequence_columns(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    lags: dict[str, str] | None = None,
    sums: dict[str, str] | None = None,
    firsts: dict[str, str] | None = None,
    number: str = "position",
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Add ordered columns per group of ``keys``.

    ``order`` must be a total order inside a group, ascending, nulls first.
    ``number`` counts rows from 1; ``lags`` take the column of the row before;
    ``sums`` add up the rows before (0 for the first); ``firsts`` take the column
    of the group's first row. Without keys the whole table is one group.
    A null key is a group like any other.
    """
    lags, sums, firsts = lags or {}, sums or {}, firsts or {}
    rows_per_slice = rows_per_slice or ROWS_PER_SLICE
    added = [number, *lags, *sums, *firsts]

    if keys:
        hot = hot_keys(df, keys, rows_per_slice)
        rows = hot.agg(F.sum("n")).first()[0]
        if not rows:
            return _windowed(df, keys, order, lags, sums, firsts, number)
        marks = materialise(hot.selectExpr(*[f"{name(k)} AS `__hot_key_{k}`" for k in keys], f"true AS {_HOT}"), "hot-keys")
        same = F.expr(" AND ".join(f"{name(k)} <=> `__hot_key_{k}`" for k in keys))
        marked = df.join(marks, same, "left").drop(*[f"__hot_key_{k}" for k in keys])
        hot_rows = marked.where(_HOT)
    else:
        rows = df.count()
        marked = df.withColumn(_HOT, F.lit(True))
        hot_rows = df

    slices = min(MAX_SLICES, math.ceil(rows / rows_per_slice))
    cuts = cut_points(hot_rows, order, rows, slices) if slices > 1 else []
    sliced = marked.withColumn(_SLICE, F.when(F.col(_HOT), slice_of(df, order, cuts)).otherwise(0))
    part = [*keys, _SLICE]
    local = _windowed(sliced, part, order, lags, sums, firsts, number)
    if not cuts:
        return local.drop(_HOT, _SLICE)

    # One row per (hot key, slice); counting and sums combine on the map side.
    key = _sort_key(order)
    hot_cells = sliced.where(_HOT).groupBy(*part).agg(
        F.expr("count(1)").alias("__carry_n"),
        *[F.expr(f"sum({name(src)})").alias(f"__carry_sum_{out}") for out, src in sums.items()],
        *[F.expr(f"max_by(struct({name(src)} AS v), {key})").alias(f"__carry_lag_{out}") for out, src in lags.items()],
        *[F.expr(f"min_by(struct({name(src)} AS v), {key})").alias(f"__carry_first_{out}") for out, src in firsts.items()],
    )
    along = (f"PARTITION BY {names(keys)} " if keys else "") + f"ORDER BY {_SLICE}"
    before = f"({along} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    carried = hot_cells.selectExpr(
        *[f"{name(c)} AS `__carry_key_{c}`" for c in part],
        f"coalesce(sum(__carry_n) OVER {before}, 0) AS __carry_n",
        *[f"coalesce(sum(`__carry_sum_{out}`) OVER {before}, 0) AS `__carry_sum_{out}`" for out in sums],
        *[f"lag(`__carry_lag_{out}`) OVER ({along}) AS `__carry_lag_{out}`" for out in lags],
        *[f"first_value(`__carry_first_{out}`) OVER ({along}) AS `__carry_first_{out}`" for out in firsts],
    )
    joined = local.join(carried, F.expr(" AND ".join(f"{name(c)} <=> `__carry_key_{c}`" for c in part)), "left")
    fixed = {number: f"{name(number)} + coalesce(__carry_n, 0)"}
    for out in lags:
        fixed[out] = f"CASE WHEN {_HOT} AND {name(number)} = 1 THEN `__carry_lag_{out}`.v ELSE {name(out)} END"
    for out in sums:
        fixed[out] = f"{name(out)} + coalesce(`__carry_sum_{out}`, 0)"
    for out in firsts:
        fixed[out] = f"CASE WHEN {_HOT} THEN `__carry_first_{out}`.v ELSE {name(out)} END"
    kept = [name(c) for c in df.columns if c not in added]
    return joined.selectExpr(*kept, *[f"{fixed[c]} AS {name(c)}" for c in added])


def values_below(counted: DataFrame, value: str, weight: str, out: str,
                 rows_per_slice: int | None = None) -> DataFrame:
    """For a table with one row per ``value``: the sum of ``weight`` over lower values."""
    return sequence_columns(
        counted, [], [value], sums={out: weight}, number="__rank",
        rows_per_slice=rows_per_slice,
    ).drop("__rank")
