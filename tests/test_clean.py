from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from callwise.config import FIRST_CALL, MERGED_STEPS, MISSING_TOKENS, NEXT_STEPS
from callwise.operators import clean, leads
from callwise.sources import calls as files


def test_missing_tokens_become_null(spark):
    rows = [(t,) for t in (*MISSING_TOKENS, "Na", "value", " ")]
    out = clean.null_missing_tokens(spark.createDataFrame(rows, "c string"))
    assert [r["c"] for r in out.collect() if r["c"] is not None] == ["Na", "value", " "]


def test_previous_fields_take_the_sentinel(spark):
    df = spark.createDataFrame([(None, ""), ("", "x"), ("kept", None)], "prev_outcome string, prev_next_step string")
    assert [tuple(r) for r in clean.fill_previous(df).collect()] == [
        (FIRST_CALL, FIRST_CALL), (FIRST_CALL, "x"), ("kept", FIRST_CALL)]


@pytest.mark.parametrize("cell, want", [
    ("12", 12.0), (" 7.5 ", 7.5), ("1e3", 1000.0), ("-4", -4.0), ("x1", 0.0), ("", 0.0), (None, 0.0),
    ("1d", 0.0), ("2.5f", 0.0), ("NaN", 0.0), ("12,5", 0.0)])
def test_numbers_or_zero(spark, cell, want):
    df = spark.createDataFrame([(cell,)], "n string")
    assert clean.coerce_numeric(df, ["n"]).first()["n"] == want


def test_context_text_treats_null_as_empty(spark):
    df = spark.createDataFrame([("a", None), (None, "b"), (None, None)],
                               "initial_interest_notes string, prev_outcome string")
    assert [r["context_text"] for r in clean.with_context_text(df).collect()] == ["a | ", " | b", " | "]


def test_old_labels_merge_into_the_six(spark):
    df = spark.createDataFrame([(x,) for x in (*MERGED_STEPS, "Enviar documentación")], "next_step string")
    merged = clean.merge_labels(df, MERGED_STEPS)
    assert {r[0] for r in merged.collect()} <= set(NEXT_STEPS)
    assert clean.unknown_labels(df, NEXT_STEPS).count() == 2
    assert clean.unknown_labels(merged, NEXT_STEPS).count() == 0


def test_csv_with_bom_quotes_and_line_breaks(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    header = ",".join(files.RAW_COLUMNS)
    cells = {c: "x" for c in files.RAW_COLUMNS} | {
        "company_num_employees": "12", "company_annual_revenue_eur": "bad", "call_number": "1",
        "days_since_entry": "3", "days_since_last_call": "", "prev_outcome": "", "prev_next_step": "NA",
        "current_transcript": '"line one\nsaid ""hello"", left"', "lead_entry_date": "2024-03-01",
        "call_timestamp": "soon"}
    (folder / "part.csv").write_text(
        header + "\n" + ",".join(cells[c] for c in files.RAW_COLUMNS) + "\n", encoding="utf-8-sig")
    row = files.load_calls(spark, str(folder)).first()
    assert row["interaction_id"] == "x" and row["call_number"] == 1
    assert row["current_transcript"] == 'line one\nsaid "hello", left'
    assert (row["prev_outcome"], row["prev_next_step"]) == (FIRST_CALL, FIRST_CALL)
    assert (row["company_annual_revenue_eur"], row["days_since_last_call"]) == (0.0, 0.0)
    assert str(row["lead_entry_date"]) == "2024-03-01" and row["call_timestamp"] is None


def test_csv_roundtrip_keeps_texts(spark, tmp_path):
    rows = [(1, 'a "b"\nc, d'), (2, "é|ñ"), (3, "\\\" mixed")]
    df = spark.createDataFrame(rows, "id int, t string")
    files.write_csv(df, str(tmp_path / "out"))
    back = files.read_csv(spark, str(tmp_path / "out"), df.schema)
    assert sorted(tuple(r) for r in back.collect()) == rows


def record(lead, entry, calls):
    return (lead, entry, 2, [(t, o, s, g) for t, o, s, g in calls])


RECORD = ("lead_id string, entry_date date, first_offset int, calls array<struct<transcript: string, "
          "outcome: string, next_step: string, days_until_next_call: int>>")


def test_nested_record_to_rows(spark):
    import datetime

    day = datetime.date(2024, 1, 30)
    df = spark.createDataFrame([
        record("a", day, [("t1", "o1", "s1", 0), ("t2", "", "s2", None), ("t3", "o3", None, 4)]),
        record("a", day, [("u1", "p1", "q1", 9)]), record("b", day, [])], RECORD)
    out = [r.asDict() for r in leads.lead_to_rows(df).orderBy("current_transcript").collect()]
    assert [r["call_number"] for r in out] == [1, 2, 3, 1]
    assert [r["days_since_entry"] for r in out] == [2, 3, 10, 2]
    assert [r["days_since_last_call"] for r in out] == [0, 1, 7, 0]
    assert [r["prev_outcome"] for r in out] == [FIRST_CALL, "o1", FIRST_CALL, FIRST_CALL]
    assert [r["prev_next_step"] for r in out] == [FIRST_CALL, "s1", "s2", FIRST_CALL]
    assert str(out[2]["call_timestamp"]) == "2024-02-09"
    assert leads.records_with_class(df, "s2").count() == 1


def test_prior_sums_to_one(spark):
    df = spark.createDataFrame(
        [(600, "Formulario web"), (10, "Llamada en frío"), (100, "LinkedIn"), (10, "Inbound / Blog")],
        "company_num_employees int, lead_source string")
    out = leads.journey_prior(df).collect()
    for r in out:
        assert abs(r["p_converted"] + r["p_lost"] + r["p_nurturing"] + r["p_in_progress"] - 1) < 1e-5
    w = 0.3 * 1.5 * 1.4
    assert out[0]["p_converted"] == pytest.approx(w / (w + 0.7), abs=1e-6)
    assert out[2]["p_lost"] == pytest.approx(0.4)


def test_augmentation_counts_and_append(spark):
    old = spark.createDataFrame([("x",), ("y",), ("y",)], "next_step string")
    new = spark.createDataFrame([("x", 1), ("z", 2)], "next_step string, extra int")
    got = {r["next_step"]: tuple(r)[1:] for r in leads.augment_report(old, new).collect()}
    assert got == {"x": (1, 2, 1), "y": (2, 2, 0), "z": (0, 1, 1)}
    assert leads.append_calls(old, new).where(F.col("extra").isNull()).count() == 3
    with pytest.raises(ValueError):
        leads.check_target("nothing")


def test_leads_with_class_keeps_whole_leads(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "b"), (3, "a"), (3, "a")],
                               "lead_id int, next_step string")
    out = leads.leads_with_class(df, "a").collect()
    assert sorted(tuple(r) for r in out) == [(1, "a"), (1, "b"), (3, "a"), (3, "a")]


def test_a_long_record_is_walked_in_order(spark):
    rows = spark.range(1).selectExpr(
        "'x' AS lead_id", "date'2024-01-01' AS entry_date", "5 AS first_offset",
        "transform(sequence(1, 60000), i -> named_struct('transcript', 't', 'outcome', cast(i AS string), 'next_step', 'n', "
        "'days_until_next_call', cast(i % 3 AS int))) AS calls")
    out = leads.lead_to_rows(rows).selectExpr("call_number AS n", "days_since_entry AS day", "days_since_last_call AS since", "prev_outcome AS p")
    got = sorted(map(tuple, out.collect()))
    day, want = 5, []
    for i in range(1, 60001):
        gap = max(1, (i - 1) % 3)
        want.append((i, day if i == 1 else day + gap, 0 if i == 1 else gap, "PRIMERA_LLAMADA" if i == 1 else str(i - 1)))
        day = want[-1][1]
    assert got == want
