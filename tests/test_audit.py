from __future__ import annotations

import math

import pytest

from callwise.config import FIRST_CALL
from callwise.functions.chi_square import chi_square_p
from callwise.operators import balance, coherence, correlation, duplicates, patterns, report

PUBLISHED = {"a": 295, "b": 253, "c": 197, "d": 149, "e": 146, "f": 32}


@pytest.fixture(scope="module")
def published(spark):
    rows = [(c,) for c, n in PUBLISHED.items() for _ in range(n)] + [(None,)]
    return spark.createDataFrame(rows, "next_step string")


def test_published_class_balance(published):
    row = balance.class_summary(published).first()
    assert row["total_rows"] == 1072 and row["n_classes"] == 6
    assert row["imbalance_ratio"] == 9.22
    assert row["chi2_stat"] == 239.851 and row["chi2_df"] == 5 and row["chi2_p"] == 0.0
    assert row["n_rare"] == 1
    assert balance.min_class_count(published).first()[0] == 32


def test_rare_is_judged_after_rounding(spark):
    rows = [("a",)] * 19_001 + [("b",)] * 1_000
    out = {r["label"]: r for r in balance.class_percentages(spark.createDataFrame(rows, "next_step string")).collect()}
    assert out["b"]["pct"] == 5.0 and out["b"]["rare"] is False


def plain_tail(stat, df):
    """The finite sum for whole degrees of freedom, term by term in logarithms."""
    half = stat / 2
    if df % 2 == 0:
        return sum(math.exp(j * math.log(half) - half - math.lgamma(j + 1)) for j in range(df // 2))
    return math.erfc(math.sqrt(half)) + sum(
        math.exp((j - 0.5) * math.log(half) - half - math.lgamma(j + 0.5)) for j in range(1, (df - 1) // 2 + 1))


def test_chi_square_tail_known_values(spark):
    cases = [(16.556, 5), (3.841458820694124, 1), (9.487729036781154, 4), (2000.0, 1000), (2000.0, 2000), (1500.0, 1400), (0.01, 3), (700.0, 2),
             (100_500.0, 100_000), (5.0, 1001), (60.0, 61)]
    df = spark.createDataFrame([*cases, (0.0, 3), (4.0, 0), (None, 3)], "s double, d int")
    got = {(r["s"], r["d"]): r["p"] for r in df.selectExpr("s", "d", f"{chi_square_p('s', 'd')} AS p").collect()}
    for s, d in cases:
        assert got[s, d] == pytest.approx(plain_tail(s, d), abs=1e-8), (s, d)
    assert got[16.556, 5] == pytest.approx(0.005423, abs=2e-6)
    assert (got[0.0, 3], got[4.0, 0], got[None, 3]) == (1.0, 1.0, None)


def test_nan_counts_as_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 1.0, "a"), (2.0, 2.0, "a"), (3.0, 3.0, "b"), (4.0, 4.0, "b"), (nan, 9.0, "b"), (None, 1.0, "a")],
                               "x double, y double, g string")
    r = correlation.kruskal_wallis(df, "x", "g").first()
    assert (r["n_rows"], r["h_stat"]) == (4, 2.4)
    assert {c["r"] for c in correlation.pearson_matrix(df, ["x"]).collect()} == {1.0}
    assert {(c["col_a"], c["col_b"]): c["r"] for c in correlation.pearson_matrix(df, ["x", "y"]).collect()}["x", "y"] == 1.0


def test_pearson_is_pairwise_and_null_for_constants(spark):
    rows = [(1.0, 2.0, 5.0), (2.0, None, 5.0), (3.0, 7.0, 5.0), (4.0, 7.5, 5.0), (None, 1.0, 5.0)]
    out = correlation.pearson_matrix(spark.createDataFrame(rows, "x double, y double, k double"), ["x", "y", "k"])
    got = {(r["col_a"], r["col_b"]): r["r"] for r in out.collect()}
    xs, ys = [1.0, 3.0, 4.0], [2.0, 7.0, 7.5]
    mx, my = sum(xs) / 3, sum(ys) / 3
    r = sum((a - mx) * (b - my) for a, b in zip(xs, ys)) / math.sqrt(
        sum((a - mx) ** 2 for a in xs) * sum((b - my) ** 2 for b in ys))
    assert got["x", "y"] == got["y", "x"] == round(r, 4)
    assert got["x", "x"] == 1.0 and got["x", "k"] is None and got["k", "k"] is None


def brute_kruskal(groups):
    values = sorted(v for g in groups.values() for v in g)
    n = len(values)
    rank = {v: (values.index(v) + 1 + n - values[::-1].index(v)) / 2 for v in set(values)}
    h = 12 / (n * (n + 1)) * sum(sum(rank[v] for v in g) ** 2 / len(g) for g in groups.values()) - 3 * (n + 1)
    ties = sum(values.count(v) ** 3 - values.count(v) for v in set(values))
    return h / (1 - ties / (n ** 3 - n))


@pytest.mark.parametrize("rows_per_slice", [2, 1_000_000])
def test_kruskal_with_ties(spark, rows_per_slice):
    groups = {"a": [1, 2, 2, 9, 4], "b": [5, 6, 2, 8, 8, 8], "c": [1, 1, 3]}
    rows = [(float(v), g) for g, vs in groups.items() for v in vs] + [(None, "a"), (3.0, None)]
    out = correlation.kruskal_wallis(spark.createDataFrame(rows, "v double, g string"), "v", "g", rows_per_slice)
    row = out.first()
    assert row["n_rows"] == 14 and row["df"] == 2
    assert row["h_stat"] == round(brute_kruskal(groups), 3)


def test_kruskal_of_one_constant_value_is_null(spark):
    rows = [(1.0, "a"), (1.0, "b"), (1.0, "b")]
    row = correlation.kruskal_wallis(spark.createDataFrame(rows, "v double, g string"), "v", "g").first()
    assert row["h_stat"] is None and row["significant"] is False


def test_duplicates(spark):
    rows = [("c", "n", 1, "same " * 50 + "x"), ("c", "n", 1, "same " * 50 + "y"), (None, "n", 1, None),
            (None, "n", 1, ""), ("c", "m", 1, "á" * 200 + "1"), ("c", "m", 2, "á" * 200 + "2")]
    df = spark.createDataFrame(rows, "company_name string, contact_name string, call_number int, current_transcript string")
    assert tuple(duplicates.exact_duplicates(df).first()) == (2, 6)
    assert tuple(duplicates.near_duplicates(df, prefix=200).first()) == (3, 3, 6)
    assert tuple(duplicates.near_duplicates(df, prefix=200, skip_empty=True).first()) == (2, 2, 4)
    assert tuple(duplicates.near_duplicates(df).first()) == (1, 5, 6)
    assert tuple(duplicates.near_duplicates(df.limit(0)).first()) == (0, 0, 0)


CALLS = ("interaction_id long, lead_id string, call_number int, prev_outcome string, prev_next_step string, "
         "next_step string, days_since_entry double, days_since_last_call double")


@pytest.fixture(scope="module")
def calls(spark):
    return spark.createDataFrame([
        (1, "a", 1, FIRST_CALL, FIRST_CALL, "s1", 1.0, 0.0),
        (2, "a", 4, "o", "s1", "s2", 5.0, 4.0),        # a gap in numbers is no fault
        (3, "a", 6, "o", "other", "s3", 3.0, 9.0),     # wrong step, entry below last call
        (4, "b", 1, "o", FIRST_CALL, "s1", 2.0, 2.0),  # outcome and days on a first call
        (5, "b", 2, None, None, "s2", 2.0, None),      # nulls are skipped
        (6, "c", 1, "", FIRST_CALL, None, 0.0, 0.0),
        (7, "c", 2, "o", "s9", "s1", 1.0, 1.0),        # the call before has no step
        (8, None, 1, FIRST_CALL, FIRST_CALL, "s1", 0.0, 3.0),
        (9, None, 2, "o", "zzz", "s1", 0.0, 0.0)], CALLS)


@pytest.mark.parametrize("rows_per_slice", [1, 1000])
def test_violations(calls, rows_per_slice):
    found = sorted((r["lead_id"] or "", r["call_number"], r["rule"])
                   for r in coherence.violations(calls, rows_per_slice=rows_per_slice).collect())
    assert found == [
        ("", 1, "days_since_entry_lt_last_call"), ("", 1, "nonzero_days_first_call"),
        ("a", 6, "days_since_entry_lt_last_call"), ("a", 6, "next_step_prev_mismatch"),
        ("b", 1, "nonzero_days_first_call"), ("b", 1, "wrong_prev_outcome_first_call")]


def test_single_rules_agree_with_the_union(calls):
    one_by_one = [coherence.wrong_first_outcome(calls), coherence.nonzero_first_days(calls),
                  coherence.step_mismatch(calls), coherence.entry_before_last_call(calls)]
    assert [df.count() for df in one_by_one] == [1, 2, 1, 2]


def test_coherence_report_and_empty_table(calls):
    assert tuple(coherence.coherence_report(calls).first()) == (6, 9, round(1 - 6 / 9, 4))
    assert tuple(coherence.coherence_report(calls.limit(0)).first()) == (0, 0, 1.0)


def test_sector_patterns(spark):
    rows = [("big", "x")] * 97 + [("s1", "x"), ("s1", "y"), ("s2", "x"), ("s3", None), (None, "x")]
    df = spark.createDataFrame(rows, "company_sector string, next_step string")
    counts = {r["sector"]: r["over_represented"] for r in patterns.sector_counts(df).collect()}
    assert counts == {"big": True, "s1": False, "s2": False, "s3": False}
    entropy = {r["sector"]: r["entropy"] for r in patterns.sector_entropy(df).collect()}
    assert entropy["s1"] == round(math.log(2), 4) and entropy["s3"] == 0.0
    values = list(entropy.values())
    mean = sum(values) / 4
    want = math.sqrt(sum((v - mean) ** 2 for v in values) / 4)
    assert patterns.sector_entropy_std(df).first()["entropy_std"] == round(want, 4)


def test_seeded_sample_is_stable(spark):
    df = spark.range(1000)
    first = {r[0] for r in patterns.seeded_sample(df, "id", 50).collect()}
    assert len(first) == 50
    assert {r[0] for r in patterns.seeded_sample(df.repartition(7), "id", 50).collect()} == first
    assert {r[0] for r in patterns.seeded_sample(df, "id", 50, seed=1).collect()} != first


def test_full_report(spark, calls):
    from pyspark.sql import functions as F

    full = calls.withColumns({
        "company_name": F.lit("c"), "contact_name": F.col("lead_id"), "company_sector": F.lit("s"),
        "company_num_employees": F.col("interaction_id") * 2.0,
        "company_annual_revenue_eur": F.col("interaction_id") * 3.0,
        "current_transcript": F.col("interaction_id").cast("string")})
    table = report.validation_report(full)
    rows = {r["check_name"]: r for r in table.collect()}
    assert len(rows) == 5
    assert rows["feature_correlations"]["passed"] and len(rows["feature_correlations"]["warnings"]) == 1
    assert rows["feature_correlations"]["stats"]["r_employees_revenue"] == 1.0
    assert rows["duplicates"]["passed"] and rows["duplicates"]["stats"]["distinct_texts"] == 9
    assert not rows["temporal_coherence"]["passed"]
    assert rows["artificial_patterns"]["warnings"] == ["sectors have very similar label mixes"]
    totals = report.report_totals(table).first()
    assert totals["checks_total"] == 5 and totals["all_passed"] is False
    assert tuple(report.lead_summary(full).first()) == (9, 3)
