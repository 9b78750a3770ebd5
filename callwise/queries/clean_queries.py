"""Cleaning, label repair, lead records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwise.functions.cells import one_line
from callwise.operators import clean, leads
from callwise.queries import adapters as A
from callwise.queries.registry import query
from callwise.sources.calls import read_table


@query("clean_prev_fill", """
SELECT interaction_id, coalesce(nullif(prev_outcome, ''), 'PRIMERA_LLAMADA') AS prev_outcome,
  coalesce(nullif(prev_next_step, ''), 'PRIMERA_LLAMADA') AS prev_next_step FROM raw_calls""", "calls raw_calls")
def clean_prev_fill(spark: SparkSession, d: str) -> DataFrame:
    raw = A.raw_calls(spark, d).select("interaction_id", "prev_outcome", "prev_next_step")
    return clean.fill_previous(raw)


@query("clean_numeric_coerce", """
SELECT interaction_id, coalesce(try_cast(days_since_entry AS DOUBLE), 0) AS days_since_entry,
  coalesce(try_cast(call_number AS DOUBLE), 0) AS call_number FROM raw_calls""", "calls raw_calls")
def clean_numeric_coerce(spark: SparkSession, d: str) -> DataFrame:
    raw = A.raw_calls(spark, d).select("interaction_id", "days_since_entry", "call_number")
    return clean.coerce_numeric(raw, ["days_since_entry", "call_number"])


@query("clean_categoricals", """
SELECT interaction_id, coalesce(company_sector, 'PRIMERA_LLAMADA') AS company_sector,
  coalesce(prev_next_step, 'PRIMERA_LLAMADA') AS prev_next_step FROM raw_calls""", "calls raw_calls")
def clean_categoricals(spark: SparkSession, d: str) -> DataFrame:
    raw = A.raw_lead_calls(spark, d).select("interaction_id", "company_sector", "prev_next_step")
    return clean.fill_categoricals(raw, ["company_sector", "prev_next_step"])


@query("context_text", """
SELECT interaction_id, coalesce(initial_interest_notes, '') || ' | ' || coalesce(prev_outcome, '') AS context_text
FROM raw_calls""", "calls raw_calls")
def context_text(spark: SparkSession, d: str) -> DataFrame:
    raw = A.raw_lead_calls(spark, d).select("interaction_id", "initial_interest_notes", "prev_outcome")
    return clean.with_context_text(raw).select("interaction_id", "context_text")


@query("merge_labels", """
SELECT CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'DEFER' ELSE o_orderpriority END AS next_step,
  count(*) AS n FROM orders GROUP BY 1""")
def merge_labels(spark: SparkSession, d: str) -> DataFrame:
    orders = read_table(spark, d, "orders").select(F.col("o_orderpriority").alias("next_step"))
    merged = clean.merge_labels(orders, {"4-NOT SPECIFIED": "DEFER", "5-LOW": "DEFER"})
    return merged.groupBy("next_step").agg(F.count(F.lit(1)).alias("n"))


@query("unknown_labels", """
SELECT o_orderpriority AS next_step, count(*) AS n FROM orders
WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1""")
def unknown_labels(spark: SparkSession, d: str) -> DataFrame:
    orders = read_table(spark, d, "orders").select(F.col("o_orderpriority").alias("next_step"))
    return clean.unknown_labels(orders, A.PRIORITIES[:3])


@query("leads_with_class", """
SELECT interaction_id, lead_id, next_step FROM calls
WHERE lead_id IN (SELECT lead_id FROM calls WHERE next_step = '1-URGENT')""", "calls")
def leads_with_class(spark: SparkSession, d: str) -> DataFrame:
    rows = A.order_calls(spark, d).select("interaction_id", "lead_id", "next_step")
    return leads.leads_with_class(rows, "1-URGENT")


@query("augment_report", """
SELECT next_step, count(*) AS n_before,
  count(*) + count(*) FILTER (WHERE hot) AS n_after, count(*) FILTER (WHERE hot) AS n_added
FROM (SELECT o_orderpriority AS next_step, o_custkey IN (SELECT o_custkey FROM orders
        WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'F') AS hot FROM orders) GROUP BY 1""")
def augment_report(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "orders").select(
        F.col("o_custkey").alias("lead_id"), F.col("o_orderpriority").alias("next_step"),
        F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("mark"))
    added = leads.leads_with_class(rows, "5-LOW/F", label="mark")
    return leads.augment_report(rows, added)


SOURCES = ("Formulario web", "Llamada en frío", "LinkedIn", "Referencia de cliente", "Inbound / Blog")


@query("journey_prior", """
WITH leads AS (SELECT c_custkey AS lead_id, c_acctbal AS size, CASE c_custkey % 5 WHEN 0 THEN 'Formulario web'
    WHEN 1 THEN 'Llamada en frío' WHEN 2 THEN 'LinkedIn' WHEN 3 THEN 'Referencia de cliente'
    ELSE 'Inbound / Blog' END AS src FROM customer),
w AS (SELECT lead_id, 0.3::DOUBLE * CASE WHEN size >= 500 THEN 1.5 ELSE 1.0 END
    * CASE WHEN src IN ('Formulario web', 'Referencia de cliente', 'Inbound / Blog') THEN 1.4 ELSE 1.0 END
    * CASE WHEN size < 50 THEN 0.7 ELSE 1.0 END AS c,
  0.4::DOUBLE * CASE WHEN src = 'Llamada en frío' THEN 1.3 ELSE 1.0 END AS l FROM leads)
SELECT lead_id, round(c / (c + l + 0.2 + 0.1), 6) AS p_converted, round(l / (c + l + 0.2 + 0.1), 6) AS p_lost,
  round(0.2 / (c + l + 0.2 + 0.1), 6) AS p_nurturing, round(0.1 / (c + l + 0.2 + 0.1), 6) AS p_in_progress
FROM w""")
def journey_prior(spark: SparkSession, d: str) -> DataFrame:
    source = F.get(F.array(*[F.lit(s) for s in SOURCES]), (F.col("c_custkey") % 5).cast("int"))
    table = read_table(spark, d, "customer").select(
        F.col("c_custkey").alias("lead_id"), F.col("c_acctbal").alias("company_num_employees"),
        source.alias("lead_source"))
    return leads.journey_prior(table).drop("company_num_employees", "lead_source")


@query("lead_to_rows", """
SELECT lead_id, company_sector, call_number,
  strftime(entry_date + CAST(day AS INTEGER), '%Y-%m-%d') AS call_date, day AS days_since_entry,
  CASE WHEN call_number = 1 THEN 0 ELSE day - lag(day) OVER w END AS days_since_last_call,
  coalesce(nullif(lag(outcome) OVER w, ''), 'PRIMERA_LLAMADA') AS prev_outcome,
  coalesce(nullif(lag(next_step) OVER w, ''), 'PRIMERA_LLAMADA') AS prev_next_step,
  md5(transcript) AS transcript_md5, outcome AS current_outcome, next_step
FROM (SELECT *, CAST(first_offset + coalesce(sum(gap) OVER (PARTITION BY lead_id ORDER BY i
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS day
      FROM (SELECT lead_id, company_sector, entry_date, first_offset, i, CAST(i AS INTEGER) AS call_number, transcript,
              CASE WHEN len % 5 = 0 THEN '' ELSE 'len-' || CAST(len % 10 AS VARCHAR) END AS outcome,
              'step-' || CAST((len + i - 1) % 6 AS VARCHAR) AS next_step,
              greatest(1, CASE WHEN len % 4 = 0 THEN 7 ELSE len % 15 - 1 END) AS gap FROM record_calls))
WINDOW w AS (PARTITION BY lead_id ORDER BY i)""", "record_calls")
def lead_to_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = leads.lead_to_rows(A.lead_records(spark, d))
    return rows.select(
        "lead_id", "company_sector", "call_number",
        F.date_format("call_timestamp", "yyyy-MM-dd").alias("call_date"), "days_since_entry",
        "days_since_last_call", "prev_outcome", "prev_next_step",
        F.md5(F.col("current_transcript").cast("binary")).alias("transcript_md5"), "current_outcome", "next_step")


@query("records_with_class", """
SELECT lead_id, count(*) AS n_calls FROM record_calls GROUP BY lead_id
HAVING count(*) FILTER (WHERE (len + i - 1) % 6 = 2) > 0""", "record_calls")
def records_with_class(spark: SparkSession, d: str) -> DataFrame:
    kept = leads.records_with_class(A.lead_records(spark, d), "step-2")
    return kept.select("lead_id", F.size("calls").cast("long").alias("n_calls"))


@query("one_line_texts", r"""
SELECT doc_id, md5(replace(regexp_replace(text, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g'), chr(10), ' ')) AS text_md5
FROM documents""")
def one_line_texts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", F.md5(one_line(F.col("text")).cast("binary")).alias("text_md5"))
