"""The five-check audit of a call table, one row per check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwise.config import DEFAULTS, Settings
from callwise.operators import balance, coherence, correlation, duplicates, features, patterns
from callwise.plans.storage import materialise

# Thresholds of the audit's warnings.
MAX_IMBALANCE = 10
SIGNIFICANT = 0.05
HIGH_CORRELATION = 0.8
LOW_ENTROPY_STD = 0.1


def lead_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("lead_id").alias("n_leads"))


def _check(row: DataFrame, check: str, warnings: dict[str, str], stats: dict[str, str],
           passed: str = "size(warnings) = 0") -> DataFrame:
    found = ", ".join(f"CASE WHEN {hit} THEN '{said}' END" for said, hit in warnings.items())
    values = ", ".join(f"'{k}', cast({v} AS double)" for k, v in stats.items())
    return row.selectExpr(
        f"array_compact(array({found})) AS warnings", f"map({values}) AS stats"
    ).selectExpr(f"'{check}' AS check_name", f"{passed} AS passed", "warnings",
                 "cast(array() AS array<string>) AS errors", "stats")


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


def class_distribution(df: DataFrame, target: str = "next_step") -> DataFrame:
    return _check(
        balance.class_summary(df, target), "class_distribution",
        {"high imbalance": f"imbalance_ratio > {MAX_IMBALANCE}", "rare classes": "n_rare > 0",
         "classes are not uniform": f"chi2_p < {SIGNIFICANT}"},
        _same("n_classes", "total_rows", "imbalance_ratio", "n_rare", "chi2_stat", "chi2_p"))


def feature_correlations(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The pair of company columns in one row, with the rank test of the first by class."""
    a, b = "company_num_employees", "company_annual_revenue_eur"
    pair = correlation.pearson_matrix(df, (a, b)).where(f"col_a = '{a}' AND col_b = '{b}'").agg(
        F.max("r").alias("r"))
    test = correlation.kruskal_wallis(df, a, settings.target).select(F.struct("h_stat", "p_value")).scalar()
    return _check(
        pair.withColumn("kw", test), "feature_correlations",
        {"employees and revenue move together": f"abs(r) > {HIGH_CORRELATION}"},
        {"r_employees_revenue": "r", "kruskal_h": "kw.h_stat", "kruskal_p": "kw.p_value"}, passed="true")


def duplicate_rows(df: DataFrame) -> DataFrame:
    near = duplicates.near_duplicates(df, prefix=duplicates.PREFIX_CHARS).select(F.struct("near_duplicates", "distinct_texts")).scalar()
    return _check(
        duplicates.exact_duplicates(df).withColumn("near", near), "duplicates",
        {"exact duplicate calls": "exact_duplicates > 0", "texts that start alike": "near.near_duplicates > 0"},
        {"exact_duplicates": "exact_duplicates", "near_duplicates": "near.near_duplicates",
         "distinct_texts": "near.distinct_texts", "total_rows": "total_rows"})


def temporal_coherence(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return _check(
        coherence.coherence_report(df, settings.sentinel), "temporal_coherence",
        {"calls out of sequence": "n_inconsistencies > 0"},
        {**_same("n_inconsistencies", "coherence_rate"),
         "share_of_rows": "coalesce(try_divide(n_inconsistencies, n_rows), 0D)"})


def artificial_patterns(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    over = patterns.sector_counts(df).agg(F.expr("count_if(over_represented)")).scalar()
    row = patterns.sector_entropy_std(df, target=settings.target).withColumn("over", over)
    return _check(
        row, "artificial_patterns",
        {"over-represented sectors": "over > 0",
         "sectors have very similar label mixes": f"entropy_std < {LOW_ENTROPY_STD}"},
        {"n_over_represented": "over", "sector_entropy_std": "entropy_std", "n_sectors": "n_sectors"})


#: What the checks read besides the columns that settings name.
AUDITED = ("interaction_id", "lead_id", "call_number", "company_name", "contact_name", "company_sector", "company_num_employees",
           "company_annual_revenue_eur", "days_since_entry", "days_since_last_call", "prev_outcome", "prev_next_step", "current_transcript")


def audited(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The audited columns, written once: whatever ``df`` is made of is computed a single time, and each check reads
    its own columns of the written table."""
    wanted = dict.fromkeys([*AUDITED, settings.target, *settings.numeric])
    return materialise(df.select(*[c for c in wanted if c in df.columns]), "audit")


def validation_report(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """All five checks over one scan of the source."""
    df = audited(df, settings)
    return reduce(DataFrame.unionByName, [
        class_distribution(df, settings.target), feature_correlations(df, settings),
        duplicate_rows(df), temporal_coherence(df, settings), artificial_patterns(df, settings)])


def validation_stats(df: DataFrame, settings: Settings = DEFAULTS, examples: int = 10) -> DataFrame:
    """What stands behind the checks, a row per figure: check_name, stat, item, value.

    Counts and shares of classes, all correlations, duplicate counts, the first violations, counts and label entropies of sectors.
    """
    df = audited(df, settings)

    def rows(table: DataFrame, check: str, stat: str, item: str, value: str) -> DataFrame:
        return table.selectExpr(f"'{check}' AS check_name", f"'{stat}' AS stat", f"{item} AS item", f"cast({value} AS double) AS value")

    classes = balance.class_percentages(df, settings.target)
    sectors = patterns.sector_counts(df)
    numeric = [c for c in settings.numeric if c in df.columns]
    return reduce(DataFrame.unionByName, [
        rows(classes, "class_distribution", "count", "label", "n"),
        rows(classes, "class_distribution", "percent", "label", "pct"),
        rows(classes.where("rare"), "class_distribution", "rare", "label", "n"),
        rows(correlation.pearson_matrix(df, numeric), "feature_correlations", "pearson", "concat(col_a, ' ', col_b)", "r"),
        rows(duplicates.exact_duplicates(df), "duplicates", "exact", "'rows'", "exact_duplicates"),
        rows(duplicates.near_duplicates(df, prefix=duplicates.PREFIX_CHARS), "duplicates", "near", "'rows'", "near_duplicates"),
        rows(coherence.coherence_examples(df, examples, sentinel=settings.sentinel), "temporal_coherence", "example",
             "concat_ws(' ', rule, lead_id, call_number)", "call_number"),
        rows(sectors, "artificial_patterns", "sector_count", "sector", "n"),
        rows(sectors.where("over_represented"), "artificial_patterns", "over_represented", "sector", "n"),
        rows(patterns.sector_entropy(df, target=settings.target), "artificial_patterns", "sector_entropy", "sector", "entropy")])


def report_totals(report: DataFrame) -> DataFrame:
    return report.selectExpr("count_if(passed) AS checks_passed", "count(1) AS checks_total",
                             "every(passed) AS all_passed")


def sample_components(df: DataFrame, text: str, key: str, encoder=None, n: int = 200,
                      seed: int = DEFAULTS.seed, k: int = 2):
    """Principal components of the text vectors of a seeded sample (see ``principal_components``)."""
    sample = patterns.seeded_sample(df.select(key, text), key, n, seed)
    vectors = (encoder or features.hashing_encoder())(sample, text, "embedding")
    return features.principal_components(
        vectors.select(key, features.as_vector(F.col("embedding")).alias("v")), "v", k)
