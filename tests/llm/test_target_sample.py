from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from callwise.llm import target_sample
from callwise.llm.queries import QUERIES
from tests.llm.brute import ODD_TEXTS

SCHEMA = "doc_id long, text string, n_words long, score string, rank int, _bucket int"


def corpus(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", 1, 1) for r in rows], SCHEMA)


def plain(rows, target, longest=1, buckets=10_000, percent=10, least=20):
    def words(text):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(f for _, x in rows for f in features(x)), Counter(f for x in target for f in features(x))
    many, wanted = sum(s.values()), sum(t.values())
    out = []
    for key, text in rows:
        weight = sum(math.floor(1000 * math.log((t[f] + 1.0) * (many + buckets) / ((s[f] + 1.0) * (wanted + buckets)))) for f in features(text))
        h = int(hashlib.sha256(f"2024:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(features(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = [r for r, (_, x) in zip(out, rows) if len(words(x)) >= least]
    able.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = i + 1
    return sorted(map(tuple, out), key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_equals_the_definition(spark, longest, monkeypatch):
    monkeypatch.setattr(target_sample, "HEAD", 5)
    monkeypatch.setattr(target_sample, "AT_ONCE", 7)
    monkeypatch.setattr(target_sample, "ORDERED_ROWS", 10)
    rows = [(i, " ".join(f"W{(i * j) % 17}é" for j in range(5 + i % 40))) for i in range(200)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(7, rows[7][1]), (None, rows[30][1])]
    target = [rows[3][1], rows[4][1], None, "other words ZZ"]
    got = target_sample.resample(corpus(spark, rows), corpus(spark, [(None, t) for t in target]), longest=longest, percent=30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert rows_of(got) == plain(rows, target, longest, percent=30)


def test_head_and_tail_agree():
    head = target_sample.Head([b"a", b"bc"], [b"a bc", b"x y"], 97)
    words = [b"a", b"bc", b"a", b"x", b"y", b"a", b"bc", b"q"]
    runs = words + [b" ".join(words[i:i + 2]) for i in range(7)] + [b" ".join(words[i:i + 3]) for i in range(6)]
    got = [int(x) for part in head.of(words, 3) for x in part]
    assert got == [zlib.crc32(r) % 97 for r in runs] and b"q" not in head


def test_ties_go_to_the_smaller_key(spark):
    scored = spark.createDataFrame([(k, s, n) for k, s, n in [(5, 7, 9), (2, 7, 9), (3, 9, 9), (1, 9, 1), (4, 1, 9), (None, 7, 9)]],
                                   "k long, score long, n long")
    got = target_sample.numbered(scored, "k", 4, scored["n"] > 5).select("k", "rank").collect()
    assert {(r["k"], r["rank"]) for r in got} == {(3, 1), (None, 2), (2, 3), (5, 4), (4, None), (1, None)}


def test_empty_tables(spark):
    nobody = corpus(spark, [])
    assert target_sample.resample(nobody, nobody).count() == 0
    some = [(1, "a " * 30), (2, None)]
    assert rows_of(target_sample.resample(corpus(spark, some), nobody, percent=100)) == plain(some, [], percent=100)


def test_invalid_utf8(spark):
    docs = spark.range(3).selectExpr("id AS doc_id", "cast(X'61FF6220C0' AS string) AS text")
    assert [r["n_features"] for r in target_sample.resample(docs, docs).collect()] == [2, 2, 2]


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert rows_of(QUERIES["op12_target_resample"](spark, sf)) == plain(rows, target)
