from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from callwise.operators import text_space
from callwise.sources.embedding_cache import cached_embeddings


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    topics = [[f"t{t}w{i}" for i in range(30)] for t in range(6)]
    rows = [" ".join(rng.choice(topics[i % 6]) if rng.random() < 0.8 else f"c{rng.randrange(20)}" for _ in range(rng.randint(5, 60))) for i in range(300)]
    return [*rows, rows[0], "", None, "ÉTÉ été", "?!", "unseen" * 3]


def matrix(texts, terms, weights):
    out = np.zeros((len(texts), len(terms)))
    place = {t: i for i, t in enumerate(terms)}
    for i, t in enumerate(texts):
        for w, c in Counter(re.findall(r"[^\W_]+", (t or "").lower())).items():
            if w in place:
                out[i, place[w]] = c * weights[place[w]]
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length > 0, length, 1)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, t string")


@pytest.fixture(scope="module")
def fitted(spark, texts):
    return text_space.fit_text_space(frame(spark, texts), "t", dim=12, passes=4)


def test_terms_are_those_of_most_texts(spark, texts):
    held = Counter(w for t in texts for w in set(re.findall(r"[^\W_]+", (t or "").lower())))
    want = sorted(held.items(), key=lambda x: (-x[1], x[0]))
    assert [tuple(r) for r in text_space.text_terms(frame(spark, texts), "t", 40).collect()] == want[:40]


def test_directions_are_as_good_as_an_exact_decomposition(fitted, texts):
    a = matrix(list(dict.fromkeys(texts)), fitted.terms, fitted.weights)
    b = fitted.basis.astype(float)
    assert np.abs(b.T @ b - np.eye(12)).max() < 1e-5
    exact = np.linalg.svd(a, compute_uv=False)
    lost, least = np.linalg.norm(a - a @ b @ b.T), np.sqrt((exact[12:] ** 2).sum())
    assert lost <= 1.01 * least
    assert np.allclose(fitted.strengths[:6], exact[:6], rtol=0.01)


def test_vectors_are_projected_rows(spark, fitted, texts):
    df = frame(spark, texts)
    got = {r["id"]: np.array(r["e"]) for r in text_space.space_vectors(df, "t", text_space.share_space(df, fitted), "e").collect()}
    want = matrix(texts, fitted.terms, fitted.weights) @ fitted.basis
    for i, x in enumerate(want):
        n = np.linalg.norm(x)
        assert np.allclose(got[i], x / n if n > 0 else x, atol=1e-5)
    assert np.allclose(got[0], got[300]) and not got[301].any() and not got[302].any()


def test_texts_of_a_topic_are_near(spark, fitted, texts):
    df = frame(spark, texts)
    rows = text_space.space_vectors(df.where("id < 300"), "t", text_space.share_space(df, fitted), "e").orderBy("id").collect()
    x = np.array([r["e"] for r in rows])
    s, same = x @ x.T, np.arange(300)[:, None] % 6 == np.arange(300)[None, :] % 6
    assert s[same].mean() > 0.6 > 0.3 > s[~same].mean()


def test_bounded_fit_and_odd_tables(spark, texts):
    df = frame(spark, texts)
    part = text_space.fit_text_space(df, "t", dim=4, fit_rows=100)
    assert part.terms == text_space.fit_text_space(df, "t", dim=4).terms and part.strengths[0] > 0
    none = text_space.fit_text_space(df.where("t = ''"), "t", dim=3)
    assert none.terms == [] and none.basis.shape == (0, 3)
    got = text_space.space_vectors(df.where("id < 2"), "t", text_space.share_space(df, none), "e").collect()
    assert [list(r["e"]) for r in got] == [[0.0] * 3] * 2
    few = text_space.fit_text_space(frame(spark, ["a b", "b c", "c"]), "t", dim=8)
    assert few.basis.shape == (3, 8) and not few.basis[:, 3:].any()
    assert text_space.space_vectors(df.where("false"), "t", text_space.share_space(df, few)).collect() == []


def test_directions_come_from_all_different_texts(spark):
    """Half of 240,000 different texts hold the only term, so its column has that many ones; each text comes twice here and there."""
    n = 240_000
    rows = spark.range(n).unionAll(spark.range(0, n, 400)).selectExpr("concat(if(id % 2 = 0, 'a', 'b'), ' x', id) AS t")
    space = text_space.fit_text_space(rows, "t", dim=2, terms=1)
    assert space.terms == ["a"] and space.weights[0] > 0
    assert space.strengths[0] ** 2 == pytest.approx(n / 2, rel=1e-9)


def test_vectors_go_through_the_cache(spark, fitted, texts, tmp_path):
    df = frame(spark, texts)
    encode = text_space.space_encoder(text_space.share_space(df, fitted))
    for _ in range(2):
        rows = cached_embeddings(df, "t", str(tmp_path / "cache"), "space-1", encode)
        assert rows.where(F.size("embedding") == 12).count() == len(texts)


def test_products_of_entries_stay_small_and_sums_keep_their_order(monkeypatch):
    assert text_space.PRODUCTS * 8 <= 2 << 20
    rng = np.random.default_rng(1)
    row, term, value = np.sort(rng.integers(0, 7, 200)), rng.integers(0, 11, 200), rng.random(200)
    matrix = np.zeros((7, 11))
    np.add.at(matrix, (row, term), value)
    onto, x, found = rng.normal(size=(11, 3)), rng.normal(size=(7, 3)), []
    monkeypatch.setattr(text_space, "ENTRIES", 90)
    for most in (1000, 100, 30, 1):
        monkeypatch.setattr(text_space, "PRODUCTS", most)
        back = np.zeros((11, 3))
        text_space._back(row, term, value, x, back)
        found.append((text_space._projected(row, term, value, 7, onto).tolist(), back.tolist()))
        assert np.allclose(found[-1][0], matrix @ onto) and np.allclose(found[-1][1], matrix.T @ x)
    assert all(f == found[0] for f in found)
