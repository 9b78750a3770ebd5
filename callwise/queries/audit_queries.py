"""Audit of the call table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwise.config import Settings
from callwise.operators import balance, coherence, correlation, duplicates, patterns, report
from callwise.plans.storage import scratch_path
from callwise.queries import adapters as A
from callwise.queries.registry import query
from callwise.sources import calls as files
from callwise.sources.calls import read_table


def labels(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").select(F.col("o_orderpriority").alias("next_step"))


COUNTS = "SELECT o_orderpriority AS label, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1"


@query("class_counts", COUNTS)
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return balance.class_counts(labels(spark, d))


@query("class_percentages", f"""
SELECT label, n, round(n / CAST(sum(n) OVER () AS DOUBLE) * 100, 2) AS pct,
  round(n / CAST(sum(n) OVER () AS DOUBLE) * 100, 2) < 5 AS rare FROM ({COUNTS})""")
def class_percentages(spark: SparkSession, d: str) -> DataFrame:
    return balance.class_percentages(labels(spark, d))


@query("imbalance_ratio", f"""
SELECT min(n) AS min_count, max(n) AS max_count, round(max(n) / CAST(greatest(min(n), 1) AS DOUBLE), 2)
  AS imbalance_ratio FROM ({COUNTS})""")
def imbalance_ratio(spark: SparkSession, d: str) -> DataFrame:
    return balance.class_summary(labels(spark, d)).select("min_count", "max_count", "imbalance_ratio")


@query("chi_square_uniform", f"""
SELECT k - 1 AS chi2_df, round(stat, 3) AS chi2_stat, round(exp(-stat / 2) * (1 + stat / 2), 6) AS chi2_p
FROM (SELECT count(*) AS k, sum((n - e) * (n - e) / e) AS stat
      FROM (SELECT n, avg(n) OVER () AS e FROM ({COUNTS})))""")
def chi_square_uniform(spark: SparkSession, d: str) -> DataFrame:
    return balance.class_summary(labels(spark, d)).select("chi2_df", "chi2_stat", "chi2_p")


@query("min_class_count", f"SELECT min(n) AS min_count FROM ({COUNTS})")
def min_class_count(spark: SparkSession, d: str) -> DataFrame:
    return balance.min_class_count(labels(spark, d))


def _pearson_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 4) AS r FROM broken_calls"
        for a in A.CALL_NUMERIC for b in A.CALL_NUMERIC)


@query("pearson_matrix", _pearson_sql(), "calls broken_calls")
def pearson_matrix(spark: SparkSession, d: str) -> DataFrame:
    return correlation.pearson_matrix(A.broken(A.calls(spark, d)), A.CALL_NUMERIC)


KRUSKAL_SQL = """
SELECT CAST(n AS BIGINT) AS n_rows, k - 1 AS df, round(h, 3) AS h_stat,
  round(exp(-h / 2) * (1 + h / 2), 6) AS p_value, exp(-h / 2) * (1 + h / 2) < 0.05 AS significant
FROM (SELECT n, count(*) AS k,
        (12.0 / (n * (n + 1)) * sum(r * r / m) - 3 * (n + 1)) / (1 - max(tie) / (n * n * n - n)) AS h
      FROM (SELECT g, count(*) AS m, sum(rk) AS r, any_value(n) AS n, any_value(tie) AS tie
            FROM (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk,
                    CAST(count(*) OVER () AS DOUBLE) AS n, t.tie
                  FROM vals CROSS JOIN (SELECT sum(CAST(c AS DOUBLE) * c * c - c) AS tie
                    FROM (SELECT count(*) AS c FROM vals GROUP BY v)) t)
            GROUP BY g) GROUP BY n)"""


@query("kruskal_wallis", "WITH vals AS (SELECT c_acctbal AS v, o_orderpriority AS g FROM orders "
       "JOIN customer ON o_custkey = c_custkey)" + KRUSKAL_SQL)
def kruskal_wallis(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "orders").join(
        read_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return correlation.kruskal_wallis(rows, "c_acctbal", "o_orderpriority")


@query("kruskal_quantity", "WITH vals AS (SELECT l_quantity AS v, "
       "CAST(l_linenumber % 5 AS VARCHAR) AS g FROM lineitem)" + KRUSKAL_SQL)
def kruskal_quantity(spark: SparkSession, d: str) -> DataFrame:
    """Heavy ties: few distinct values over the largest table."""
    rows = read_table(spark, d, "lineitem").select(
        "l_quantity", (F.col("l_linenumber") % 5).cast("string").alias("g"))
    return correlation.kruskal_wallis(rows, "l_quantity", "g")


@query("exact_duplicates", """
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS exact_duplicates, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_rows
FROM (SELECT count(*) AS n FROM broken_calls GROUP BY company_name, contact_name, call_number)""",
       "calls broken_calls")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.exact_duplicates(A.broken(A.calls(spark, d)))


@query("near_duplicates", """
SELECT CAST(sum(n - 1) AS BIGINT) AS near_duplicates, count(*) AS distinct_texts, CAST(sum(n) AS BIGINT) AS total_rows
FROM (SELECT count(*) AS n FROM documents GROUP BY md5(substring(coalesce(text, ''), 1, 200)))""")
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.near_duplicates(read_table(spark, d, "documents"), "text", prefix=duplicates.PREFIX_CHARS)


@query("whole_text_duplicates", """
SELECT CAST(sum(n - 1) AS BIGINT) AS near_duplicates, count(*) AS distinct_texts, CAST(sum(n) AS BIGINT) AS total_rows
FROM (SELECT count(*) AS n FROM documents WHERE coalesce(text, '') <> '' GROUP BY md5(text))""")
def whole_text_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.near_duplicates(read_table(spark, d, "documents"), "text", prefix=None, skip_empty=True)


@query("lead_summary", "SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_leads FROM orders")
def lead_summary(spark: SparkSession, d: str) -> DataFrame:
    return report.lead_summary(read_table(spark, d, "orders").select(F.col("o_custkey").alias("lead_id")))


@query("sector_overrep", """
SELECT sector, n, n > 3 * avg(n) OVER () AS over_represented
FROM (SELECT source AS sector, count(*) AS n FROM documents GROUP BY 1)""")
def sector_overrep(spark: SparkSession, d: str) -> DataFrame:
    return patterns.sector_counts(read_table(spark, d, "documents"), "source")


ENTROPY_SQL = """
SELECT sector, round(-sum(n / t * ln(n / t + 1e-9)), 4) AS entropy
FROM (SELECT sector, n, CAST(sum(n) OVER (PARTITION BY sector) AS DOUBLE) AS t
      FROM (SELECT source AS sector, lang, count(*) AS n FROM documents GROUP BY 1, 2)) GROUP BY sector"""


@query("sector_entropy", ENTROPY_SQL)
def sector_entropy(spark: SparkSession, d: str) -> DataFrame:
    return patterns.sector_entropy(read_table(spark, d, "documents"), "source", "lang")


@query("sector_entropy_std", f"""
SELECT round(stddev_pop(entropy), 4) AS entropy_std, count(*) AS n_sectors FROM ({ENTROPY_SQL})""")
def sector_entropy_std(spark: SparkSession, d: str) -> DataFrame:
    return patterns.sector_entropy_std(read_table(spark, d, "documents"), "source", "lang")


@query("seeded_sample", """
SELECT doc_id, md5(text) AS text_md5 FROM documents
ORDER BY md5('42-' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 200""")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return patterns.seeded_sample(docs, "doc_id").select(
        "doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _rule(name: str) -> str:
    return f"SELECT * FROM violations WHERE rule = '{name}'"


BROKEN = "calls broken_calls violations"


@query("coherence_first_prev", _rule("wrong_prev_outcome_first_call"), BROKEN)
def coherence_first_prev(spark: SparkSession, d: str) -> DataFrame:
    return coherence.wrong_first_outcome(A.broken_calls(spark, d))


@query("coherence_first_days", _rule("nonzero_days_first_call"), BROKEN)
def coherence_first_days(spark: SparkSession, d: str) -> DataFrame:
    return coherence.nonzero_first_days(A.broken_calls(spark, d))


@query("coherence_next_prev", _rule("next_step_prev_mismatch"), BROKEN)
def coherence_next_prev(spark: SparkSession, d: str) -> DataFrame:
    return coherence.step_mismatch(A.broken_calls(spark, d))


@query("coherence_days_order", _rule("days_since_entry_lt_last_call"), BROKEN)
def coherence_days_order(spark: SparkSession, d: str) -> DataFrame:
    return coherence.entry_before_last_call(A.broken_calls(spark, d))


@query("coherence_report", """
SELECT v.n AS n_inconsistencies, c.n AS n_rows, round(1 - v.n / CAST(c.n AS DOUBLE), 4) AS coherence_rate
FROM (SELECT count(*) AS n FROM violations) v, (SELECT count(*) AS n FROM broken_calls) c""", BROKEN)
def coherence_report(spark: SparkSession, d: str) -> DataFrame:
    return coherence.coherence_report(A.broken_calls(spark, d))


@query("coherence_examples", "SELECT * FROM violations ORDER BY lead_id, call_number, rule, found LIMIT 10", BROKEN)
def coherence_examples(spark: SparkSession, d: str) -> DataFrame:
    return coherence.coherence_examples(A.broken_calls(spark, d))


VALIDATION_SQL = """, counts AS (SELECT next_step AS label, count(*) AS n FROM call_texts GROUP BY 1),
bal AS (SELECT round(max(n) / CAST(min(n) AS DOUBLE), 2) AS ratio, count(*) AS k,
    count(*) FILTER (WHERE round(n * 100.0 / t, 2) < 5) AS rare, sum((n - e) * (n - e) / e) AS x
  FROM (SELECT n, avg(n) OVER () AS e, sum(n) OVER () AS t FROM counts)),
pear AS (SELECT round(corr(company_num_employees, company_annual_revenue_eur), 4) AS r FROM call_texts),
ex AS (SELECT coalesce(sum(n - 1), 0) AS n FROM (SELECT count(*) AS n FROM call_texts
  GROUP BY company_name, contact_name, call_number)),
near AS (SELECT coalesce(sum(n - 1), 0) AS n FROM (SELECT count(*) AS n FROM call_texts
  GROUP BY md5(substring(coalesce(current_transcript, ''), 1, 200)))),
bad AS (SELECT count(*) AS n FROM (SELECT *, lag(next_step) OVER (PARTITION BY lead_id
    ORDER BY call_number, interaction_id) AS sb FROM call_texts)
  WHERE sb <> prev_next_step OR days_since_entry < days_since_last_call
    OR (call_number = 1 AND (prev_outcome <> 'PRIMERA_LLAMADA' OR days_since_last_call <> 0))),
ent AS (SELECT round(stddev_pop(e), 4) AS s FROM (SELECT company_sector, round(-sum(n / t * ln(n / t + 1e-9)), 4) AS e
  FROM (SELECT company_sector, n, CAST(sum(n) OVER (PARTITION BY company_sector) AS DOUBLE) AS t
    FROM (SELECT company_sector, next_step, count(*) AS n FROM call_texts GROUP BY 1, 2)) GROUP BY 1)),
over AS (SELECT count(*) FILTER (WHERE n > 3 * m) AS n FROM (SELECT n, avg(n) OVER () AS m
  FROM (SELECT count(*) AS n FROM call_texts GROUP BY company_sector)))
SELECT 'class_distribution' AS check_name, w = 0 AS passed, w AS n_warnings, ratio AS key_value FROM (SELECT ratio,
  CAST(ratio > 10 AS INT) + CAST(rare > 0 AS INT) + CAST(exp(-x / 2) * (1 + x / 2) < 0.05 AS INT) AS w FROM bal)
UNION ALL SELECT 'feature_correlations', true, CAST(abs(r) > 0.8 AS INT), r FROM pear
UNION ALL SELECT 'duplicates', ex.n + near.n = 0, CAST(ex.n > 0 AS INT) + CAST(near.n > 0 AS INT), CAST(near.n AS DOUBLE)
  FROM ex, near
UNION ALL SELECT 'temporal_coherence', n = 0, CAST(n > 0 AS INT), CAST(n AS DOUBLE) FROM bad
UNION ALL SELECT 'artificial_patterns', s >= 0.1 AND n = 0, CAST(s < 0.1 AS INT) + CAST(n > 0 AS INT), s FROM ent, over"""


KEY_VALUES = {
    "class_distribution": "imbalance_ratio", "feature_correlations": "r_employees_revenue",
    "duplicates": "near_duplicates", "temporal_coherence": "n_inconsistencies",
    "artificial_patterns": "sector_entropy_std"}


def _flat(table: DataFrame) -> DataFrame:
    key = ", ".join(f"'{check}', '{value}'" for check, value in KEY_VALUES.items())
    return table.selectExpr("check_name", "passed", "size(warnings) AS n_warnings",
                            f"try_element_at(stats, element_at(map({key}), check_name)) AS key_value")


@query("validation_report", VALIDATION_SQL, "calls call_texts")
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    return _flat(report.validation_report(A.call_texts(spark, d)))


@query("report_json", VALIDATION_SQL, "calls call_texts")
def report_json(spark: SparkSession, d: str) -> DataFrame:
    """The report written as JSON and read back."""
    path = scratch_path(spark, "report")
    files.write_json(report.validation_report(A.call_texts(spark, d)), path)
    return _flat(spark.read.schema(
        "check_name string, passed boolean, warnings array<string>, errors array<string>, "
        "stats map<string,double>").json(path))


def _stats_sql() -> str:
    pairs = " UNION ALL ".join(
        f"SELECT 'feature_correlations', 'pearson', '{a} {b}', round(corr({a}, {b}), 4) FROM call_texts"
        for a in A.CALL_NUMERIC for b in A.CALL_NUMERIC)
    return f""", counts AS (SELECT next_step AS label, count(*) AS n FROM call_texts WHERE next_step IS NOT NULL GROUP BY 1),
shares AS (SELECT label, n, round(n / CAST(sum(n) OVER () AS DOUBLE) * 100, 2) AS pct FROM counts),
sectors AS (SELECT company_sector AS sector, count(*) AS n FROM call_texts WHERE company_sector IS NOT NULL GROUP BY 1),
bad AS (SELECT *, lag(next_step) OVER (PARTITION BY lead_id ORDER BY call_number, interaction_id) AS sb FROM call_texts)
SELECT 'class_distribution' AS check_name, 'count' AS stat, label AS item, CAST(n AS DOUBLE) AS value FROM counts
UNION ALL SELECT 'class_distribution', 'percent', label, pct FROM shares
UNION ALL SELECT 'class_distribution', 'rare', label, n FROM shares WHERE pct < 5
UNION ALL {pairs}
UNION ALL SELECT 'duplicates', 'exact', 'rows', coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM call_texts
  GROUP BY company_name, contact_name, call_number)
UNION ALL SELECT 'duplicates', 'near', 'rows', coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM call_texts
  GROUP BY md5(substring(coalesce(current_transcript, ''), 1, 200)))
UNION ALL SELECT 'artificial_patterns', 'sector_count', sector, n FROM sectors
UNION ALL SELECT 'artificial_patterns', 'over_represented', sector, n FROM (SELECT *, avg(n) OVER () AS m FROM sectors) WHERE n > 3 * m
UNION ALL SELECT 'artificial_patterns', 'sector_entropy', sector, round(-sum(n / t * ln(n / t + 1e-9)), 4)
  FROM (SELECT company_sector AS sector, n, CAST(sum(n) OVER (PARTITION BY company_sector) AS DOUBLE) AS t
    FROM (SELECT company_sector, next_step, count(*) AS n FROM call_texts GROUP BY 1, 2)) GROUP BY sector"""


@query("validation_stats", _stats_sql(), "calls call_texts")
def validation_stats(spark: SparkSession, d: str) -> DataFrame:
    """All figures but the example rows, which ``coherence_examples`` holds."""
    stats = report.validation_stats(A.call_texts(spark, d), Settings(numeric=A.CALL_NUMERIC))
    return stats.where("stat != 'example'")
