"""Exact stratified split and folds in md5 order.

Ranking every row of a class would need one task per class and a shuffle of the
table. Instead the borders are found: rows are counted per class and bucket (the
leading hex digits of a row's md5), which tells the bucket each border lies in,
and only rows of those buckets are ranked. What remains are a few md5 values per
class, and every row is placed by comparing with them, without a shuffle. A column
with more values than ``LITERAL_LABELS`` gets the same borders from a table joined by label.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwise.config import DEFAULTS
from callwise.functions.sqltext import name, text

# A border bucket should hold about this many rows; more digits make more and smaller buckets.
ROWS_PER_BUCKET = 100_000
# Up to so many classes the borders are literals of the plan; beyond, a joined table. Results are the same.
LITERAL_LABELS = 1_000


def md5_mark(key: str, seed: int) -> str:
    """A fixed random-looking order: md5 of seed and key."""
    return f"md5(cast(concat('{seed}-', cast({name(key)} AS string)) AS binary))"


def class_sizes(df: DataFrame, label: str) -> dict[str, int] | None:
    """Rows per class, nulls left out; None if there are more than ``LITERAL_LABELS`` classes."""
    rows = df.where(f"{name(label)} IS NOT NULL").groupBy(label).count().limit(LITERAL_LABELS + 1).collect()
    if len(rows) > LITERAL_LABELS:
        return None
    return {str(r[0]): r[1] for r in sorted(rows, key=lambda r: r[0])}


def test_quotas(sizes: Mapping[str, int], test_size: Fraction = DEFAULTS.test_size) -> dict[str, int]:
    """Test rows per class: ceil(share * rows) in all, spread by largest remainder.

    Whole-number arithmetic; ties go to the lower label.
    """
    total = sum(sizes.values())
    wanted = -(-total * test_size.numerator // test_size.denominator)
    quotas = {c: n * wanted // total for c, n in sizes.items()}
    by_rest = sorted(sizes, key=lambda c: (-(sizes[c] * wanted % total), c))
    for c in by_rest[: wanted - sum(quotas.values())]:
        quotas[c] += 1
    return quotas


def bucket_digits(rows: int) -> int:
    digits = 0
    while digits < 32 and rows > ROWS_PER_BUCKET * 16 ** digits:
        digits += 1
    return digits


def _by_label(values: Mapping[str, str], column: str = "label") -> str:
    """A literal map from label to an SQL value, looked up with ``column``."""
    entries = ", ".join(f"{text(c)}, {v}" for c, v in values.items())
    return f"try_element_at(map({entries}), {column})"


def _marks_at(df: DataFrame, key: str, label: str, ranks: Mapping[str, Sequence[int]], seed: int,
              digits: int) -> dict[str, list[str]]:
    """The md5 of the row with each wanted rank of each class; '' for rank 0.

    Both jobs read key and label only and return a few rows per class.
    """
    rows = df.where(f"{name(label)} IS NOT NULL").selectExpr(
        f"cast({name(label)} AS string) AS label", f"{md5_mark(key, seed)} AS mark"
    ).selectExpr("label", "mark", f"substring(mark, 1, {digits}) AS bucket")
    wanted = {c: f"array({', '.join(f'{r}L' for r in found)})" for c, found in ranks.items()}
    borders = rows.groupBy("label", "bucket").agg(F.expr("count(1)").alias("n")).selectExpr(
        "label", "bucket", "n", "sum(n) OVER (PARTITION BY label ORDER BY bucket) - n AS before"
    ).selectExpr(
        "label", "bucket", "before",
        f"explode(filter({_by_label(wanted)}, r -> r > before AND r <= before + n)) AS wanted").collect()
    marks = {}
    if borders:
        cells: dict[str, dict[str, list]] = {}
        for r in borders:
            cells.setdefault(r["label"], {}).setdefault(r["bucket"], []).append(r["wanted"] - r["before"])
        owed = {c: "map(" + ", ".join(
            f"{text(b)}, array({', '.join(f'{o}L' for o in found)})" for b, found in of.items()) + ")"
            for c, of in cells.items()}
        before = {(r["label"], r["bucket"]): r["before"] for r in borders}
        # Rows that share a key are one row here, however many they are.
        distinct = rows.where(f"map_contains_key({_by_label(owed)}, bucket)").groupBy(
            "label", "bucket", "mark").agg(F.expr("count(1)").alias("n"))
        upto = distinct.selectExpr(
            "label", "bucket", "mark", "n", "sum(n) OVER (PARTITION BY label, bucket ORDER BY mark) AS upto")
        found = upto.selectExpr(
            "label", "bucket", "mark",
            f"explode(filter(try_element_at({_by_label(owed)}, bucket), o -> o > upto - n AND o <= upto)) AS rank")
        for r in found.collect():
            marks[r["label"], r["rank"] + before[r["label"], r["bucket"]]] = r["mark"]
    return {c: [marks[c, r] if r > 0 else "" for r in found] for c, found in ranks.items()}


def stratified_split(df: DataFrame, key: str, label: str,
                     test_size: Fraction = DEFAULTS.test_size, seed: int = DEFAULTS.seed,
                     digits: int | None = None) -> DataFrame:
    """Add ``split``: ``test`` or ``train``; null for rows without a label.

    A class of one row trains; the other classes share the test rows. Sizes are exact for a
    unique ``key``; rows of a class that share a key stay together.
    """
    sizes = class_sizes(df, label)
    placed = "CASE WHEN {label} IS NULL THEN NULL WHEN {mark} <= {cut} THEN 'test' ELSE 'train' END"
    at = {"label": name(label), "mark": md5_mark(key, seed)}
    if sizes is None:
        return _beside(df, label, _many_marks(df, key, label, _quota_table(df, label, test_size), seed, digits)).withColumn(
            "split", F.expr(placed.format(cut="__marks[0]", **at))).drop("__marks")
    usable = {c: n for c, n in sizes.items() if n > 1}
    if not usable:
        return df.withColumn("split", F.expr(f"CASE WHEN {name(label)} IS NOT NULL THEN 'train' END"))
    quotas = {c: [q] for c, q in test_quotas(usable, test_size).items()}
    cuts = {c: text(m[0]) for c, m in _marks_at(
        df, key, label, quotas, seed, bucket_digits(sum(sizes.values())) if digits is None else digits).items()}
    return df.withColumn("split", F.expr(placed.format(cut=_by_label(cuts, f"cast({name(label)} AS string)"), **at)))


def train_part(split: DataFrame) -> DataFrame:
    return split.where("split = 'train'").drop("split")


def test_part(split: DataFrame) -> DataFrame:
    return split.where("split = 'test'").drop("split")


def _quota_table(df: DataFrame, label: str, test_size: Fraction) -> DataFrame:
    """(label, rank): ``test_quotas`` as a table, one row per class of two rows or more."""
    sizes = df.where(f"{name(label)} IS NOT NULL").groupBy(F.expr(f"cast({name(label)} AS string)").alias("label")).agg(
        F.expr("cast(count(1) AS decimal(20, 0))").alias("n")).where("n > 1")
    wanted = f"(total * {test_size.numerator} + {test_size.denominator - 1}) div {test_size.denominator}"
    shared = sizes.selectExpr("label", "n", "cast(sum(n) OVER () AS decimal(20, 0)) AS total").selectExpr(
        "label", "n", "total", f"cast({wanted} AS decimal(18, 0)) AS wanted").selectExpr(
        "label", "wanted", "n * wanted div total AS base", "n * wanted % total AS rest")
    return shared.selectExpr(
        "label", "base + if(row_number() OVER (ORDER BY rest DESC, label) <= wanted - sum(base) OVER (), 1, 0) AS rank")


def _many_marks(df: DataFrame, key: str, label: str, ranks: DataFrame, seed: int, digits: int | None) -> DataFrame:
    """(label, marks): ``_marks_at`` as a table, for any number of classes; ranks has a row per wanted (label, rank)."""
    if digits is None:
        digits = bucket_digits(df.count())
    rows = df.where(f"{name(label)} IS NOT NULL").selectExpr(
        f"cast({name(label)} AS string) AS label", f"{md5_mark(key, seed)} AS mark"
    ).selectExpr("label", "mark", f"substring(mark, 1, {digits}) AS bucket")
    counted = rows.groupBy("label", "bucket").agg(F.expr("count(1)").alias("n")).selectExpr(
        "label", "bucket", "n", "sum(n) OVER (PARTITION BY label ORDER BY bucket) - n AS before")
    owed = counted.join(ranks, "label").where("rank > before AND rank <= before + n").selectExpr(
        "label", "bucket", "rank", "rank - before AS owed")
    upto = rows.join(owed.select("label", "bucket").distinct(), ["label", "bucket"]).groupBy("label", "bucket", "mark").agg(
        F.expr("count(1)").alias("n")).selectExpr(
        "label", "bucket", "mark", "n", "sum(n) OVER (PARTITION BY label, bucket ORDER BY mark) AS upto")
    found = upto.join(owed, ["label", "bucket"]).where("owed > upto - n AND owed <= upto").select("label", "rank", "mark")
    return ranks.join(found, ["label", "rank"], "left").groupBy("label").agg(
        F.expr("transform(sort_array(collect_list(struct(rank, coalesce(mark, '') AS mark))), m -> m.mark)").alias("__marks"))


def _beside(df: DataFrame, label: str, marks: DataFrame) -> DataFrame:
    """``df`` with the marks of its label, null where there are none."""
    found = marks.withColumnRenamed("label", "__label")
    return df.join(found, F.expr(f"cast({name(label)} AS string) = __label"), "left").drop("__label")


def stratified_folds(df: DataFrame, key: str, label: str, k: int = DEFAULTS.folds,
                     seed: int = DEFAULTS.seed, digits: int | None = None) -> DataFrame:
    """Add ``fold`` in 0..k-1: each class in md5 order, cut into k parts whose
    sizes differ by at most one. Rows without a label have a null fold."""
    sizes = class_sizes(df, label)
    placed = "CASE WHEN {label} IS NOT NULL THEN size(filter({marks}, m -> m < __mark)) END"
    marked = df.withColumn("__mark", F.expr(md5_mark(key, seed)))
    if sizes is None:
        counts = df.where(f"{name(label)} IS NOT NULL").groupBy(F.expr(f"cast({name(label)} AS string)").alias("label")).agg(
            F.expr("count(1)").alias("n"))
        cuts = counts.selectExpr("label", f"explode(transform(sequence(1, {k - 1}), i -> cast(i * n div {k} AS decimal(20, 0)))) AS rank") \
            if k > 1 else counts.selectExpr("label", "cast(0 AS decimal(20, 0)) AS rank")
        # Classes with fewer rows than folds share ranks; each counts once per fold.
        ranks = cuts.groupBy("label", "rank").agg(F.expr("count(1)").alias("times"))
        marks = _many_marks(df, key, label, ranks.select("label", "rank"), seed, digits)
        repeats = ranks.groupBy("label").agg(F.expr("transform(sort_array(collect_list(struct(rank, times))), r -> r.times)").alias("__times"))
        weight = "aggregate(zip_with(__marks, __times, (m, t) -> if(m < __mark, t, 0L)), 0L, (s, t) -> s + t)"
        return _beside(marked, label, marks.join(repeats, "label")).withColumn("fold", F.expr(
            f"CASE WHEN {name(label)} IS NOT NULL THEN cast({weight if k > 1 else '0'} AS int) END")).drop("__marks", "__times", "__mark")
    if not sizes:
        return df.withColumn("fold", F.lit(None).cast("int"))
    ranks = {c: [i * n // k for i in range(1, k)] for c, n in sizes.items()}
    marks = _marks_at(
        df, key, label, ranks, seed, bucket_digits(sum(sizes.values())) if digits is None else digits)
    arrays = {c: "array(" + ", ".join(text(m) for m in found) + ")" for c, found in marks.items()}
    return marked.withColumn("fold", F.expr(placed.format(
        label=name(label), marks=_by_label(arrays, f"cast({name(label)} AS string)")))).drop("__mark")


def group_split(df: DataFrame, group: str, test_size: Fraction = DEFAULTS.test_size,
                seed: int = DEFAULTS.seed) -> DataFrame:
    """Add ``split`` so that all calls of a lead fall on one side (share by hash, not exact)."""
    limit = test_size.numerator * 16 ** 8
    share = f"cast(conv(substring({md5_mark(group, seed)}, 1, 8), 16, 10) AS bigint) * {test_size.denominator}"
    return df.withColumn("split", F.expr(f"CASE WHEN {share} < {limit} THEN 'test' ELSE 'train' END"))
