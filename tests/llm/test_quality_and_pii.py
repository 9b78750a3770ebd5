from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest

from callwise.llm import pii, quality, tagger
from tests.llm.brute import ODD_TEXTS, personal_data

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_quality_on_held_out_documents(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = spark.sparkContext.broadcast(quality.fit(docs.select("doc_id", "text"), labels, rows=2000))
    got = {r["doc_id"]: r for r in quality.score(docs.select("doc_id", "text"), model).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    held = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    good = [got[r["doc_id"]]["predicted"] == r["quality"] for r in held]
    assert sum(good) / len(good) > 0.97
    assert sum(got[r["doc_id"]]["predicted"] for r in held if r["quality"]) >= 0.99 * sum(r["quality"] for r in held)
    flag = {r["doc_id"]: r["h"] for r in docs.select("doc_id", quality.held_out().alias("h")).collect()}
    assert all(flag[r["doc_id"]] for r in held)


def test_quality_fit_holds_its_sample_once(spark):
    words = ["one", "Two", "%%3", "|", "a1b2", "(x)", "ÄÖ", "9.9", "#"]
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(words, k=40)), i % 2) for i in range(2_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    tracemalloc.start()
    try:
        model = quality.fit(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    n = len(model["labels"])
    assert n > 1_500 and peak < 4 * (4 * n * quality.BINS), peak
    # The same as from all counts at once, in the order of the keys.
    learnt = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    assert model["labels"].tolist() == [r[2] for r in learnt]
    x = quality.weighted(np.stack([quality.text_counts(r[1]) for r in learnt]), model["idf"])
    assert np.array_equal(model["vectors"], quality.project(x, quality.singular_vectors(x, quality.RANK)))


def test_quality_votes_equal_all_products(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["one", "Two", "%%3", "|"], 20)) for _ in range(60)]
    x = quality.weighted(np.stack([quality.text_counts(t) for t in texts]), np.ones(quality.BINS))
    basis = quality.singular_vectors(x, 8)
    model = {"idf": np.ones(quality.BINS), "basis": basis, "vectors": quality.project(x, basis), "labels": rng.integers(0, 2, 60).astype(np.float32)}
    got = quality.vote(model, texts, 7)
    for i, z in enumerate(model["vectors"]):
        cos = model["vectors"] @ z
        near = np.argsort(-cos, kind="stable")[:7]
        w = np.maximum(cos[near].astype(float), 0) ** 4
        assert abs(got[i] - (w * model["labels"][near]).sum() / w.sum()) < 1e-3


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 0.5, 9) for i, t in enumerate(ODD_TEXTS)] + [(None, "x", 0.1, 1), (0, None, 0.5, 9)],
                                 "doc_id long, text string, score double, predicted int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (3, 1), (3, 0), (99, 1), (None, 1)], "doc_id long, quality int")
    for have in (labels, labels.where("false")):
        model = spark.sparkContext.broadcast(quality.fit(docs, have))
        got = quality.score(docs, model)
        rows = got.collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows) and got.columns == ["doc_id", "text", "score", "predicted"]
        assert quality.score(docs.where("false"), model).collect() == []


def test_patterns_equal_the_regular_expressions():
    rng = random.Random(2)
    for _ in range(4000):
        t = "".join(rng.choice("aB1029.@-+ ()%_é@.5") for _ in range(rng.randint(0, 40)))
        assert [(k, *s) for k, v in pii.base_spans(t).items() for s in v] == personal_data(t)
    pii.base_spans("a" * 300_000 + "@" * 3000 + "1" * 300_000 + "1." * 50_000)  # linear


def test_gradients_equal_differences():
    model = tagger.Tagger.new(5, 3, 0)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 9, (2, 6)).astype(np.uint8), rng.integers(0, 5, (2, 6)).astype(np.int8)
    _, grads = model.gradients(x, y)
    for k, g in grads.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in g.shape) if k != "wx" else (rng.integers(0, 2), int(x[0, 1]), rng.integers(0, 12))
            was, losses = model.w[k][at], []
            for e in (1e-4, -1e-4):
                model.w[k][at] = was + e
                losses.append(model.gradients(x, y)[0])
            model.w[k][at] = was
            assert abs((losses[0] - losses[1]) / 2e-4 - g[at]) < 2e-3 * (1 + abs(g[at]))


def test_decoding_finds_the_best_path():
    model = tagger.Tagger.new(3, 2, 4)
    model.w["trans"] = np.random.default_rng(5).normal(size=(3, 3)).astype(np.float32)
    x = np.random.default_rng(6).integers(0, 9, (4, 5)).astype(np.uint8)
    scores, _ = model.run(x)
    got = model.decode(x)
    for b in range(4):
        paths = np.array(np.meshgrid(*[range(3)] * 5)).reshape(5, -1).T
        total = [scores[b, range(5), p].sum() + model.w["start"][p[0]] + model.w["trans"][p[:-1], p[1:]].sum() for p in paths]
        assert paths[int(np.argmax(total))].tolist() == got[b].tolist()


@pytest.fixture(scope="module")
def weights(spark, docs):
    return pii.fit(docs, windows=(800, 400))


def test_tagger_adds_other_ways_of_writing(weights):
    texts = ["please ring (212) 555-0187 for it", "nothing to see", "mail ab.77@mail.example.com or call 415-555-0132 at once"]
    found = pii.find_all(texts, tagger.Tagger(weights))
    added = [[texts[i][s:e] for _, s, e in a] for i, (_, a) in enumerate(found)]
    assert added[0] == ["(212) 555-0187"] and added[1] == [] and added[2] == ["415-555-0132"]


def test_spans_do_not_depend_on_where_a_window_starts(weights):
    model = tagger.Tagger(weights)
    for shift in range(0, 70, 7):
        text = "w " * shift + "please ring (212) 555-0187 for it"
        (_, added), = pii.find_all([text], model)
        assert [text[s:e] for _, s, e in added] == ["(212) 555-0187"]


def test_spans_of_odd_rows_and_redaction(spark, weights):
    texts = [*ODD_TEXTS, "a.b@c.de w +1 (787) 555-9386 x 9.9.9.9 y 4111 1111 1111 1111", "x" * 50_000 + " q@r.st"]
    docs = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)] + [(None, "9.9.9.9", "p")] * 2, "doc_id long, text string, pii string")
    share = spark.sparkContext.broadcast(weights)
    got = pii.digest(pii.find(docs, share)).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = texts[r["doc_id"]] if r["doc_id"] is not None else "9.9.9.9"
        base = [f"{k}:{s}:{e}" for k, s, e in personal_data(text)]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r["spans"].split(",")) | {""}
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b.startswith(k) for b in base) for k in pii.KINDS]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs, share).collect()}
    assert clean[len(ODD_TEXTS)] == "<EMAIL> w <PHONE> x <IP> y <CARD>" and clean[0] is None and clean[1] == ""
    assert not any(re.search(r"@|9\.9", clean[i] or "") for i in clean)
    assert pii.find(docs.where("false"), share).collect() == []
    assert len(pii.fit(docs.where("false"), steps=2)) == 6
