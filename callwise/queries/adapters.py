"""The driver's tables seen as call tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwise.config import FIRST_CALL
from callwise.functions.sqltext import text, texts
from callwise.plans.sequence import sequence_columns
from callwise.sources.calls import read_table

# Classes of the order table, which stand for the next steps.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
LANGUAGES = ("de", "en", "es", "fr")

CALL_NUMERIC = ("company_num_employees", "company_annual_revenue_eur", "call_number",
                "days_since_entry", "days_since_last_call")


def order_calls(spark: SparkSession, d: str) -> DataFrame:
    """Orders as the calls of a lead: sequence columns only."""
    orders = read_table(spark, d, "orders").selectExpr(
        "o_orderkey AS interaction_id", "o_custkey AS lead_id", "o_orderstatus AS current_outcome",
        "o_orderpriority AS next_step", "o_totalprice AS company_annual_revenue_eur",
        "to_date(o_orderdate) AS call_timestamp")
    ordered = sequence_columns(
        orders, ["lead_id"], ["call_timestamp", "interaction_id"],
        lags={"step": "next_step", "outcome": "current_outcome", "day_before": "call_timestamp"},
        firsts={"lead_entry_date": "call_timestamp"}, number="call_number")
    return ordered.selectExpr(
        "interaction_id", "lead_id", "call_number", "call_timestamp", "lead_entry_date",
        "datediff(call_timestamp, lead_entry_date) AS days_since_entry",
        "coalesce(datediff(call_timestamp, day_before), 0) AS days_since_last_call",
        f"coalesce(outcome, '{FIRST_CALL}') AS prev_outcome", f"coalesce(step, '{FIRST_CALL}') AS prev_next_step",
        "current_outcome", "next_step", "company_annual_revenue_eur", "current_outcome AS lead_source")


def with_leads(calls: DataFrame, d: str) -> DataFrame:
    """Calls with the static fields of their lead, from the customer tables."""
    spark = calls.sparkSession
    customer, nation, region = (read_table(spark, d, t) for t in ("customer", "nation", "region"))
    leads = customer.join(nation, F.expr("c_nationkey = n_nationkey")).join(
        region, F.expr("n_regionkey = r_regionkey")
    ).selectExpr(
        "c_custkey", "c_name AS contact_name", "concat('role-', cast(c_custkey % 15 AS string)) AS contact_role",
        "concat(n_name, '-', c_mktsegment) AS company_name", "c_mktsegment AS company_sector",
        "n_name AS company_country", "r_name AS company_city", "c_acctbal AS company_num_employees",
        "concat(c_mktsegment, ' ', n_name) AS initial_interest_notes")
    return calls.join(leads, F.expr("lead_id = c_custkey")).drop("c_custkey")


def calls(spark: SparkSession, d: str) -> DataFrame:
    """The call table: orders as calls, customers as leads."""
    return with_leads(order_calls(spark, d), d)


RAW = (
    "interaction_id", "lead_id",
    "CASE WHEN interaction_id % 7 = 0 THEN '' WHEN interaction_id % 11 = 0 THEN 'NA' "
    "WHEN interaction_id % 13 = 0 THEN NULL ELSE prev_outcome END AS prev_outcome",
    "CASE WHEN interaction_id % 5 = 0 THEN '' WHEN interaction_id % 17 = 0 THEN 'nan' "
    "ELSE prev_next_step END AS prev_next_step",
    "CASE WHEN interaction_id % 9 = 0 THEN 'x1' WHEN interaction_id % 10 = 0 THEN 'NULL' "
    "WHEN interaction_id % 19 = 0 THEN '1d' ELSE concat(' ', cast(days_since_entry AS string)) END "
    "AS days_since_entry",
    "CASE WHEN interaction_id % 6 = 0 THEN NULL ELSE cast(call_number AS string) END AS call_number",
    "next_step",
)


def raw_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls as a raw file would hold them, with damaged cells."""
    return order_calls(spark, d).selectExpr(*RAW)


def raw_lead_calls(spark: SparkSession, d: str) -> DataFrame:
    """The same with damaged fields of the lead."""
    return calls(spark, d).selectExpr(
        *RAW, "CASE WHEN interaction_id % 8 = 0 THEN NULL ELSE company_sector END AS company_sector",
        "CASE WHEN interaction_id % 4 = 0 THEN NULL ELSE initial_interest_notes END AS initial_interest_notes")


def broken(calls: DataFrame) -> DataFrame:
    """Calls whose sequence fields are wrong in places."""
    return calls.withColumns({c: F.expr(e) for c, e in {
        "prev_outcome": "CASE WHEN interaction_id % 23 = 0 THEN 'ODD' ELSE prev_outcome END",
        "prev_next_step": "CASE WHEN interaction_id % 29 = 0 THEN NULL WHEN interaction_id % 31 = 0 THEN 'ODD' "
                          "ELSE prev_next_step END",
        "days_since_last_call": "CASE WHEN interaction_id % 37 = 0 THEN NULL WHEN interaction_id % 41 = 0 "
                                "THEN days_since_last_call + 5000 ELSE days_since_last_call END",
        "call_number": "CASE WHEN interaction_id % 43 = 0 THEN call_number + 3 ELSE call_number END",
    }.items()})


def broken_calls(spark: SparkSession, d: str) -> DataFrame:
    return broken(order_calls(spark, d))


def call_texts(spark: SparkSession, d: str) -> DataFrame:
    """Calls with the document of the same number as transcript, null where there is none."""
    docs = read_table(spark, d, "documents").selectExpr("doc_id", "text AS current_transcript")
    return calls(spark, d).join(docs, F.expr("interaction_id = doc_id"), "left").drop("doc_id")


def lead_records(spark: SparkSession, d: str) -> DataFrame:
    """Documents as nested lead records: each line of the text is a call."""
    return read_table(spark, d, "documents").selectExpr(
        "doc_id AS lead_id", "source AS company_sector",
        "date_add(DATE'2024-01-01', cast(n_chars % 90 AS int)) AS entry_date",
        "cast(doc_id % 7 + 1 AS int) AS first_offset",
        "transform(split(text, '\n'), (t, i) -> named_struct('transcript', t, "
        "'outcome', if(length(t) % 5 = 0, '', concat('len-', cast(length(t) % 10 AS string))), "
        "'next_step', concat('step-', cast((length(t) + i) % 6 AS string)), "
        "'days_until_next_call', if(length(t) % 4 = 0, NULL, length(t) % 15 - 1))) AS calls")


def doc_calls(spark: SparkSession, d: str) -> DataFrame:
    """Documents as calls with a transcript; the language is the label."""
    return read_table(spark, d, "documents").selectExpr(
        "doc_id AS interaction_id", "text AS current_transcript", "source AS lead_source",
        "source AS initial_interest_notes", "concat('out-', cast(n_chars % 3 AS string)) AS prev_outcome",
        "cast(n_chars AS double) AS company_num_employees",
        "cast(size(split(text, ' ')) AS double) AS days_since_entry", "lang AS next_step")


def steps(spark: SparkSession, d: str) -> DataFrame:
    """Events as steps, users as leads."""
    events = read_table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    ordered = sequence_columns(events, ["user_id"], ["ts", "event_id"], firsts={"start": "ts"}, number="step")
    return ordered.selectExpr(
        "user_id AS lead_id",
        "element_at(array('default', 'aggressive', 'conservative'), cast(user_id % 3 + 1 AS int)) AS strategy",
        "step", "datediff(to_date(ts), to_date(start)) AS day", "event_type AS action", "value AS confidence",
        "CASE event_type WHEN 'purchase' THEN 'converted' WHEN 'error' THEN 'lost' "
        "WHEN 'view' THEN 'nurturing' END AS status")


EVENT_OUTCOMES = (
    ("purchase", True, 1.0, "converted", 0, 0, "bought"),
    ("error", True, 1.0, "lost", 0, 0, "gave up"),
    ("view", False, 0.4, "nurturing", 10, 21, "looked around"),
    ("signup", False, 0.3, "converted", 5, 10, "signed up"),
)
EVENT_OVERRIDES = (
    ("aggressive", "signup", 0.5, None, None), ("aggressive", "view", None, 3, 10),
    ("conservative", "signup", 0.15, None, None), ("conservative", "view", None, 14, 30),
    ("conservative", "click", 0.05, None, None),
)


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Test calls scored with the step frequencies that training calls show after each step.

    Fitting yields one small row per previous step, which becomes a literal map,
    so scoring is a projection.
    """
    from callwise.operators.split import stratified_split, test_part, train_part

    rows = stratified_split(
        order_calls(spark, d).select("interaction_id", "prev_next_step", "next_step"),
        "interaction_id", "next_step")
    known = (FIRST_CALL, *PRIORITIES)
    counts = train_part(rows).where(f"prev_next_step IN ({texts(known)})").groupBy("prev_next_step").agg(
        *[F.expr(f"count_if(next_step = {text(x)})").alias(x) for x in PRIORITIES]).collect()

    def shares(found: list[int]) -> str:
        return "array(" + ", ".join(f"{n}D / {sum(found)}D" for n in found) + ")"

    table = ", ".join(f"{text(r[0])}, {shares(list(r[1:]))}" for r in counts)
    prior = shares([sum(column) for column in zip(*[r[1:] for r in counts])])
    return test_part(rows).selectExpr(
        "interaction_id", "next_step AS y_true",
        f"coalesce(try_element_at(map({table}), prev_next_step), {prior}) AS proba")


def exact_mean(column: str, digits: int, only: str = "") -> str:
    """SQL for a mean rounded half-up without a float in between; four decimals in, no negatives."""
    keep = f" FILTER (WHERE {only})" if only else ""
    total = f"CAST(sum(CAST({column} AS DECIMAL(18, 4))){keep} * 10000 AS HUGEINT)"
    n = f"count({column}){keep}"
    unit = 10 ** (4 - digits)
    return f"(2 * {total} + {n} * {unit}) // nullif(2 * {n} * {unit}, 0) / {10 ** digits}.0::DOUBLE"


CTES = {
    "calls": """
SELECT o_orderkey AS interaction_id, o_custkey AS lead_id, c_name AS contact_name,
  'role-' || CAST(c_custkey % 15 AS VARCHAR) AS contact_role,
  n_name || '-' || c_mktsegment AS company_name, c_mktsegment AS company_sector,
  n_name AS company_country, r_name AS company_city,
  c_acctbal AS company_num_employees, o_totalprice AS company_annual_revenue_eur,
  o_orderstatus AS lead_source, first_value(CAST(o_orderdate AS DATE)) OVER w AS lead_entry_date,
  c_mktsegment || ' ' || n_name AS initial_interest_notes,
  row_number() OVER w AS call_number, CAST(o_orderdate AS DATE) AS call_timestamp,
  date_diff('day', first_value(CAST(o_orderdate AS DATE)) OVER w, CAST(o_orderdate AS DATE)) AS days_since_entry,
  coalesce(date_diff('day', lag(CAST(o_orderdate AS DATE)) OVER w, CAST(o_orderdate AS DATE)), 0)
    AS days_since_last_call,
  coalesce(lag(o_orderstatus) OVER w, 'PRIMERA_LLAMADA') AS prev_outcome,
  coalesce(lag(o_orderpriority) OVER w, 'PRIMERA_LLAMADA') AS prev_next_step,
  o_orderstatus AS current_outcome, o_orderpriority AS next_step
FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WINDOW w AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey)""",
    "raw_calls": """
SELECT interaction_id, lead_id,
  CASE WHEN interaction_id % 7 = 0 THEN '' WHEN interaction_id % 11 = 0 THEN 'NA'
    WHEN interaction_id % 13 = 0 THEN NULL ELSE prev_outcome END AS prev_outcome,
  CASE WHEN interaction_id % 5 = 0 THEN '' WHEN interaction_id % 17 = 0 THEN 'nan'
    ELSE prev_next_step END AS prev_next_step,
  CASE WHEN interaction_id % 9 = 0 THEN 'x1' WHEN interaction_id % 10 = 0 THEN 'NULL'
    WHEN interaction_id % 19 = 0 THEN '1d' ELSE ' ' || CAST(days_since_entry AS VARCHAR) END AS days_since_entry,
  CASE WHEN interaction_id % 6 = 0 THEN NULL ELSE CAST(call_number AS VARCHAR) END AS call_number,
  CASE WHEN interaction_id % 8 = 0 THEN NULL ELSE company_sector END AS company_sector,
  CASE WHEN interaction_id % 4 = 0 THEN NULL ELSE initial_interest_notes END AS initial_interest_notes,
  next_step
FROM calls""",
    "broken_calls": """
SELECT * REPLACE (
  CASE WHEN interaction_id % 23 = 0 THEN 'ODD' ELSE prev_outcome END AS prev_outcome,
  CASE WHEN interaction_id % 29 = 0 THEN NULL WHEN interaction_id % 31 = 0 THEN 'ODD'
    ELSE prev_next_step END AS prev_next_step,
  CASE WHEN interaction_id % 37 = 0 THEN NULL WHEN interaction_id % 41 = 0 THEN days_since_last_call + 5000
    ELSE days_since_last_call END AS days_since_last_call,
  CASE WHEN interaction_id % 43 = 0 THEN call_number + 3 ELSE call_number END AS call_number)
FROM calls""",
    "violations": """
SELECT lead_id, call_number, 'wrong_prev_outcome_first_call' AS rule, 'PRIMERA_LLAMADA' AS expected,
  prev_outcome AS found FROM broken_calls
WHERE call_number = 1 AND prev_outcome IS NOT NULL AND prev_outcome NOT IN ('PRIMERA_LLAMADA', '')
UNION ALL
SELECT lead_id, call_number, 'nonzero_days_first_call', '0', CAST(days_since_last_call AS VARCHAR)
FROM broken_calls WHERE call_number = 1 AND days_since_last_call <> 0
UNION ALL
SELECT lead_id, call_number, 'next_step_prev_mismatch', step_before, prev_next_step
FROM (SELECT *, lag(next_step) OVER (PARTITION BY lead_id ORDER BY call_number, interaction_id) AS step_before
      FROM broken_calls)
WHERE step_before <> prev_next_step
UNION ALL
SELECT lead_id, call_number, 'days_since_entry_lt_last_call', CAST(days_since_last_call AS VARCHAR),
  CAST(days_since_entry AS VARCHAR) FROM broken_calls WHERE days_since_entry < days_since_last_call""",
    "call_texts": """
SELECT c.*, d.text AS current_transcript FROM calls c LEFT JOIN documents d ON c.interaction_id = d.doc_id""",
    "record_calls": """
SELECT doc_id AS lead_id, source AS company_sector,
  DATE '2024-01-01' + CAST(n_chars % 90 AS INTEGER) AS entry_date, doc_id % 7 + 1 AS first_offset,
  i, list_extract(lines, i) AS transcript, length(list_extract(lines, i)) AS len
FROM (SELECT *, string_split(text, chr(10)) AS lines FROM documents),
  LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)""",
    "steps": """
SELECT user_id AS lead_id, CASE user_id % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'aggressive'
    ELSE 'conservative' END AS strategy,
  row_number() OVER w AS step,
  date_diff('day', CAST(first_value(ts) OVER w AS DATE), CAST(ts AS DATE)) AS day,
  event_type AS action, value AS confidence,
  CASE event_type WHEN 'purchase' THEN 'converted' WHEN 'error' THEN 'lost'
    WHEN 'view' THEN 'nurturing' END AS status
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "outcomes": """
SELECT * FROM (VALUES ('purchase', true, 1.0, 'converted', 0, 0, 'bought'),
  ('error', true, 1.0, 'lost', 0, 0, 'gave up'), ('view', false, 0.4, 'nurturing', 10, 21, 'looked around'),
  ('signup', false, 0.3, 'converted', 5, 10, 'signed up'))
  AS t(action, terminal, prob_terminal, terminal_status, days_lo, days_hi, outcome_summary)""",
    "overrides": """
SELECT * FROM (VALUES ('aggressive', 'signup', 0.5, NULL, NULL), ('aggressive', 'view', NULL, 3, 10),
  ('conservative', 'signup', 0.15, NULL, NULL), ('conservative', 'view', NULL, 14, 30),
  ('conservative', 'click', 0.05, NULL, NULL)) AS t(strategy, action, prob, lo, hi)""",
    "trajectories": f"""
SELECT lead_id, strategy, count(*) AS total_steps, coalesce({exact_mean("confidence", 4)}, 0) AS confidence_avg,
  CAST(max(day) AS BIGINT) AS total_days,
  coalesce(max(status) FILTER (WHERE step = n_steps), 'max_steps_reached') AS final_status
FROM (SELECT *, count(*) OVER (PARTITION BY lead_id) AS n_steps FROM steps)
GROUP BY lead_id, strategy""",
    "quotas": """
SELECT label, n, (n * n_test) // total + CASE WHEN row_number() OVER (ORDER BY (n * n_test) % total DESC, label)
    <= n_test - sum((n * n_test) // total) OVER () THEN 1 ELSE 0 END AS quota
FROM (SELECT next_step AS label, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total,
        (CAST(sum(count(*)) OVER () AS BIGINT) + 4) // 5 AS n_test
      FROM calls GROUP BY next_step)""",
    "split": """
SELECT interaction_id, prev_next_step, next_step, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split
FROM (SELECT interaction_id, prev_next_step, next_step, row_number() OVER (PARTITION BY next_step
        ORDER BY md5('42-' || CAST(interaction_id AS VARCHAR)), interaction_id) AS rn FROM calls)
  JOIN quotas ON label = next_step""",
    "labels_list": """
SELECT * FROM (VALUES (0, '1-URGENT'), (1, '2-HIGH'), (2, '3-MEDIUM'), (3, '4-NOT SPECIFIED'), (4, '5-LOW'))
  AS t(idx, label)""",
    "model": """
SELECT p.prev, l.idx, l.label, CAST(count(*) FILTER (WHERE s.next_step = l.label) AS DOUBLE) / count(*) AS p
FROM (SELECT DISTINCT prev_next_step AS prev FROM split WHERE split = 'train') p
  JOIN split s ON s.prev_next_step = p.prev AND s.split = 'train' CROSS JOIN labels_list l
GROUP BY p.prev, l.idx, l.label""",
    "scored_long": """
SELECT s.interaction_id, s.next_step AS y_true, l.idx, l.label, coalesce(m.p, prior.p) AS p
FROM split s CROSS JOIN labels_list l LEFT JOIN model m ON m.prev = s.prev_next_step AND m.idx = l.idx
  JOIN (SELECT l.idx, CAST(count(*) FILTER (WHERE t.next_step = l.label) AS DOUBLE) / count(*) AS p
        FROM split t CROSS JOIN labels_list l WHERE t.split = 'train' GROUP BY l.idx) prior ON prior.idx = l.idx
WHERE s.split = 'test'""",
    "ranked": """
SELECT *, row_number() OVER (PARTITION BY interaction_id ORDER BY p DESC, idx DESC) AS place,
  row_number() OVER (PARTITION BY interaction_id ORDER BY p DESC, idx) AS best
FROM scored_long""",
    "predicted": """
SELECT interaction_id, y_true, max(label) FILTER (WHERE best = 1) AS y_pred, max(p) AS top_p,
  CAST(max(CASE WHEN place <= 3 AND label = y_true THEN 1 ELSE 0 END) AS BIGINT) AS hit
FROM ranked GROUP BY interaction_id, y_true""",
    "class_table": """
SELECT label, support, predicted, tp,
  CASE WHEN predicted = 0 THEN 0 ELSE tp / CAST(predicted AS DOUBLE) END AS precision,
  CASE WHEN support = 0 THEN 0 ELSE tp / CAST(support AS DOUBLE) END AS recall,
  CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / CAST(support + predicted AS DOUBLE) END AS f1
FROM (SELECT l.label, count(*) FILTER (WHERE y_true = l.label) AS support,
        count(*) FILTER (WHERE y_pred = l.label) AS predicted,
        count(*) FILTER (WHERE y_true = l.label AND y_pred = l.label) AS tp
      FROM predicted CROSS JOIN labels_list l GROUP BY l.label)""",
}

SCORED = "calls quotas split labels_list model scored_long ranked predicted"
