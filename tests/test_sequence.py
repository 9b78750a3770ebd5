from __future__ import annotations

import random
from collections import defaultdict

import pytest

from callwise.plans import sequence
from callwise.plans.sequence import cut_points, hot_keys, sequence_columns, slice_of, values_below

SCHEMA = "lead string, num int, id long, step string, gap int"


@pytest.fixture(scope="module")
def rows():
    """One lead holds a third of all rows; numbers repeat and steps are null in places."""
    rng = random.Random(5)
    found = []
    for i in range(900):
        lead = "hot" if i % 3 == 0 else f"lead-{rng.randrange(120)}"
        found.append((lead, rng.randrange(40), i, rng.choice(["a", "b", None]), rng.choice([1, 2, 3])))
    return found


def by_hand(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    want = {}
    for lead, found in groups.items():
        found.sort(key=lambda r: (r[1], r[2]))
        total = 0
        for i, r in enumerate(found):
            want[r[2]] = (i + 1, found[i - 1][3] if i else None, total, found[0][3])
            total += r[4]
    return want


@pytest.mark.parametrize("rows_per_slice", [7, 20, 1000])
def test_sliced_groups_equal_plain_order(spark, rows, rows_per_slice):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = sequence_columns(df, ["lead"], ["num", "id"], lags={"before": "step"}, sums={"so_far": "gap"},
                           firsts={"first": "step"}, rows_per_slice=rows_per_slice)
    got = {r["id"]: (r["position"], r["before"], r["so_far"], r["first"]) for r in out.collect()}
    assert got == by_hand(rows)


def test_hot_lead_is_cut_into_small_groups(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    hot = hot_keys(df, ["lead"], 20)
    assert [r["lead"] for r in hot.collect()] == ["hot"]
    only = df.where("lead = 'hot'")
    cuts = cut_points(only, ["num", "id"], 300, 15)
    sizes = [r["count"] for r in only.withColumn("s", slice_of(df, ["num", "id"], cuts)).groupBy("s").count().collect()]
    assert sum(sizes) == 300 and len(sizes) == 15 and max(sizes) < 60


def test_slice_lookup_counts_cuts_at_or_below(spark):
    df = spark.range(100).selectExpr("id")
    cuts = [(v,) for v in (3, 10, 11, 50, 77, 78, 79)]
    got = {r["id"]: r["s"] for r in df.withColumn("s", slice_of(df, ["id"], cuts)).collect()}
    assert all(got[v] == sum(c[0] <= v for c in cuts) for v in range(100))


def test_no_oversized_group_means_a_plain_window(spark, rows):
    out = sequence_columns(spark.createDataFrame(rows, SCHEMA), ["lead"], ["num", "id"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and sequence._SLICE not in plan


@pytest.mark.parametrize("rows_per_slice", [3, 10_000])
def test_whole_table_prefix_sum(spark, rows_per_slice):
    values = [(float(v), v % 5 + 1) for v in random.Random(1).sample(range(1000), 60)]
    out = values_below(spark.createDataFrame(values, "v double, n int"), "v", "n", "below", rows_per_slice)
    for r in out.collect():
        assert r["below"] == sum(n for v, n in values if v < r["v"])


def test_timestamps_and_texts_as_sort_keys(spark):
    rows = [("k", f"2024-01-{d:02d} 10:00:00", f"o'{d}") for d in range(1, 29)]
    df = spark.createDataFrame(rows, "k string, t string, id string").selectExpr(
        "k", "cast(t AS timestamp_ntz) AS t", "id")
    out = sequence_columns(df, ["k"], ["t", "id"], lags={"prev": "id"}, rows_per_slice=4).orderBy("t").collect()
    assert [r["position"] for r in out] == list(range(1, 29))
    assert [r["prev"] for r in out] == [None] + [r[2] for r in rows[:-1]]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sequence_columns(empty, ["lead"], ["num", "id"]).count() == 0
    assert sequence_columns(empty, [], ["num", "id"]).count() == 0


def test_a_hot_null_key_is_sliced_like_any_other(spark, monkeypatch):
    monkeypatch.setattr(sequence, "ROWS_PER_SLICE", 8)
    rows = [(None, i, f"s{i}") for i in range(200)] + [("a", i, f"t{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "lead string, num int, step string").repartition(3)
    out = sequence_columns(df, ["lead"], ["num"], lags={"before": "step"}, firsts={"first": "step"})
    assert sequence._SLICE in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["lead"], r["num"]): (r["position"], r["before"], r["first"]) for r in out.collect()}
    assert len(got) == 203
    for i in range(200):
        assert got[None, i] == (i + 1, f"s{i - 1}" if i else None, "s0")
    assert got["a", 2] == (3, "t1", "t0")
