from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from callwise.llm import alignment
from callwise.llm.queries import BYTE_MODEL, PIECE_MODEL, QUERIES
from tests.llm.brute import ODD_TEXTS

SCHEMA = "doc_id long, text string, pairs int, times string, _row int, n_best int"
TEXTS = [*ODD_TEXTS, "Don't <|endoftext|> stop", "a▁b", "<0x41> </s>", "it's   3,141.59\t\r\n　x", "привет мир", " lead", "trail ", "é‍"]


def corpus(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", 2, 3) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def sides():
    return alignment.ByteLevel(open(BYTE_MODEL, "rb").read()), alignment.Pieces(open(PIECE_MODEL, "rb").read())


def plain_links(sides, text):
    """(ids of A, ids of B, links as places, ends of groups in bytes), by walking over bytes."""
    a, b = sides[0].encode([" " + (text or "")])[0], sides[1].encode([text or ""])[0]
    want = (" " + (text or "")).encode()
    spelt = [b"".join(side.spelt[i] for i in ids) for side, ids in zip(sides, (a, b))]
    if not text or spelt != [want, want]:
        return [], [], [], []
    owner = [[], []]
    for k, ids in enumerate((a, b)):
        for at, i in enumerate(ids):
            owner[k] += [at] * len(sides[k].spelt[i])
    links = sorted(set(zip(*owner)))
    ends = [{j + 1 for j in range(len(want)) if j + 1 == len(want) or o[j] != o[j + 1]} for o in owner]
    return a, b, links, sorted(ends[0] & ends[1])


def plain(sides, rows):
    found = [plain_links(sides, t) for _, t in rows]
    count = Counter(p for a, b, links, _ in found for p in {(a[x], b[y]) for x, y in links})
    highest: dict = {}
    for (x, _), n in count.items():
        highest[x] = max(highest.get(x, 0), n)
    out = []
    for (key, text), (a, b, links, cuts) in zip(rows, found):
        groups = []
        at_a = at_b = done = 0
        for cut in cuts:
            sizes = [cut - done, cut - done]
            parts: list = [[], []]
            while sizes[0]:
                parts[0].append(a[at_a]); sizes[0] -= len(sides[0].spelt[a[at_a]]); at_a += 1
            while sizes[1]:
                parts[1].append(b[at_b]); sizes[1] -= len(sides[1].spelt[b[at_b]]); at_b += 1
            groups.append("|".join(",".join(map(str, p)) for p in parts))
            done = cut
        counts = [count[a[x], b[y]] for x, y in links]
        out.append((key, len(a), len(b), len(groups), len(links), sum(n == highest[a[x]] for (x, _), n in zip(links, counts)), sum(counts),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("held", [3, 2_000_000])
def test_equals_the_definition(spark, sides, held):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[8]), (None, TEXTS[8]), (None, None)]
    got = alignment.align_corpus(corpus(spark, rows), BYTE_MODEL, PIECE_MODEL, held=held)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(got) == plain(sides, rows)


def test_links_and_cuts(spark, sides):
    files = alignment.share_files(spark, BYTE_MODEL, PIECE_MODEL)
    got = {r["doc_id"]: r for r in alignment.links(corpus(spark, list(enumerate(TEXTS))), files).collect()}
    for i, text in enumerate(TEXTS):
        a, b, links, cuts = plain_links(sides, text)
        assert (got[i]["ids_a"], got[i]["ids_b"], [tuple(x) for x in got[i]["links"]], got[i]["cuts"]) == (a, b, links, cuts)


@pytest.mark.parametrize("lane", [1, 2, 7, 1000])
def test_lanes_do_not_matter(lane):
    rng = np.random.default_rng(lane)
    sizes = rng.integers(1, 5, 600)
    half = [rng.integers(1, 5, 600) for _ in range(2)]
    total = min(h.sum() for h in half)
    lists = []
    for h in half:
        ends = np.cumsum(h)
        ends = np.append(ends[ends < total], total)
        side = alignment.Lists.__new__(alignment.Lists)
        side.sizes, side.start, side.ids, side.end = np.array([0, len(ends), 0]), np.array([0, 0, len(ends), len(ends)]), ends, ends
        lists.append(side)
    x, y, cuts, cuts_b = alignment.lockstep(*lists, lane)
    begin = [np.concatenate([[0], s.end[:-1]]) for s in lists]
    want = {(i, j) for i in range(len(lists[0].end)) for j in range(len(lists[1].end))
            if begin[0][i] < lists[1].end[j] and begin[1][j] < lists[0].end[i]}
    assert len(x) == len(want) and set(zip(x.tolist(), y.tolist())) == want
    assert (lists[0].end[cuts] == lists[1].end[cuts_b]).all()
    assert sorted(lists[0].end[cuts]) == sorted(set(lists[0].end) & set(lists[1].end)) and len(sizes) == 600


def test_units_give_the_tokens_of_whole_texts(sides, monkeypatch):
    """Random texts of words, marks, spaces and other scripts, with a cache that is dropped again and again."""
    monkeypatch.setattr(alignment, "KEPT_UNITS", 40)
    rng = np.random.default_rng(2)
    parts = ["the", "Word", "9", "it's", "x1y2", " ", "  ", "\n", "\t", ".", ",", "'s", "-", "é", "ß", "漢", "\u00a0", "\u3000", "🙂", "_", "##", "a", "'", "ab", " ", " 's", "ж", "\x85", "\x1c", "\u2009", "×"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 80))) for _ in range(400)]
    texts += [" ".join(rng.choice(parts[:5], 40_000))]
    aligner = alignment.Aligner(*(open(p, "rb").read() for p in (BYTE_MODEL, PIECE_MODEL)))
    for at in range(0, len(texts), 50):
        some = texts[at:at + 50]
        got = aligner.tokens([t.encode() for t in some])
        for side, lists, space in zip(sides, got, (" ", "")):
            for i, want in enumerate(side.encode([space + t for t in some])):
                assert lists.ids[lists.start[i]:lists.start[i + 1]].tolist() == want


def test_empty_table_and_invalid_utf8(spark):
    assert alignment.align_corpus(corpus(spark, []), BYTE_MODEL, PIECE_MODEL).count() == 0
    docs = spark.range(2).selectExpr("id AS doc_id", "cast(X'61FF62' AS string) AS text")
    assert [tuple(r)[1:] for r in alignment.align_corpus(docs, BYTE_MODEL, PIECE_MODEL).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_registered_query(spark, sides):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op13_lockstep_alignment"](spark, sf)) == plain(sides, rows)
