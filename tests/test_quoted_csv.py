"""Quoted CSV cut into byte ranges against Spark's reader of whole files."""

from __future__ import annotations

import random

import pytest

from callwise.sources import calls, quoted_csv


def whole_files(spark, path, schema):
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")

SCHEMA = "id int, a string, b string, n double"


@pytest.fixture
def tiny_ranges(spark):
    """Ranges of a few dozen bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "40b", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def cell(rng):
    text = "".join(rng.choice(["word", " ", ",", "\n", '""', "é", "\n\n", "x" * 30, "'"]) for _ in range(rng.randrange(9)))
    return f'"{text}"' if text else rng.choice(["", "plain", '""'])


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_equals_the_reader_of_whole_files(spark, tmp_path, tiny_ranges, ends):
    rng = random.Random(5)
    for name in ("one", "two"):
        lines = ["id,a,b,n"] + [f"{i},{cell(rng)},{cell(rng)},{i / 4}" for i in range(120)]
        (tmp_path / f"{name}.csv").write_bytes(("﻿" if name == "two" else "").encode() + ends.join(lines).encode() + ends.encode())
    schema = spark.createDataFrame([], SCHEMA).schema
    got = quoted_csv.read_quoted_csv(spark, str(tmp_path), schema)
    want = whole_files(spark, str(tmp_path), schema)
    assert rows_of(got) == rows_of(want) and got.count() == 240
    assert quoted_csv.range_starts(quoted_csv.physical_lines(spark, str(tmp_path))).where("inside").count() > 20


def test_a_cell_may_fill_many_ranges(spark, tmp_path, tiny_ranges):
    long = "\n".join(f"line {i} of it" for i in range(50))
    (tmp_path / "t.csv").write_text(f'id,a,b,n\n1,"{long}",x,1\n2,"{long}","{long}",2\n\n3,y,z,3')
    schema = spark.createDataFrame([], SCHEMA).schema
    assert rows_of(quoted_csv.read_quoted_csv(spark, str(tmp_path / "t.csv"), schema)) == [
        (1, long, "x", 1.0), (2, long, long, 2.0), (3, "y", "z", 3.0)]


def test_headers_alone_and_no_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,a,b,n\n")
    (tmp_path / "empty.csv").write_text("")
    schema = spark.createDataFrame([], SCHEMA).schema
    assert quoted_csv.read_quoted_csv(spark, str(tmp_path), schema).collect() == []


def test_roundtrip_of_odd_texts(spark, tmp_path, tiny_ranges):
    texts = ['a "quoted" word', "two\nlines", "tab\t", "trailing ", None, 'ends with "', "a,b", "\n", "naïve"]
    df = spark.createDataFrame([(i, t, "k", 0.5) for i, t in enumerate(texts)], SCHEMA)
    calls.write_csv(df, str(tmp_path / "out"))
    got = calls.read_csv(spark, str(tmp_path / "out"), df.schema)
    assert rows_of(got) == rows_of(whole_files(spark, str(tmp_path / "out"), df.schema)) and got.where("b = 'k'").count() == len(texts)
