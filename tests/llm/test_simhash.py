from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from callwise.llm import simhash
from callwise.llm.queries import QUERIES
from tests.llm.brute import ODD_TEXTS, WORD

SCHEMA = "doc_id long, text string, fp long, label string, bucket int"


def corpus(spark, rows):
    return spark.createDataFrame([(*r, 1, "l", 2) for r in rows], SCHEMA)


def plain_fingerprint(text, n=4):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    if not words:
        return 0
    n = min(n, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(fps, most=4):
    """Place to the least place reachable."""
    left, out = set(range(len(fps))), {}
    while left:
        start = min(left)
        reached, queue = {start}, [start]
        while queue:
            at = queue.pop()
            near = [j for j in left - reached if bin(fps[at] ^ fps[j]).count("1") <= most]
            reached.update(near)
            queue += near
        out.update(dict.fromkeys(reached, start))
        left -= reached
    return out


def checked(got, rows, most=4):
    fps = [plain_fingerprint(t) for _, t in rows]
    parts = plain_components(fps, most)
    want = sorted((k, f"{fps[i]:016x}", min(rows[j][0] for j in parts if parts[j] == parts[i])) for i, (k, _) in enumerate(rows))
    assert sorted(map(tuple, got.collect())) == want


def texts(rng, n):
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.randint(1, 60))] for _ in range(n // 6)]
    for i in range(n):
        words = list(base[rng.randrange(len(base))])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            words[rng.randrange(len(words))] = f"new{rng.randrange(99)}"
        yield i, " ".join(words).upper() if rng.random() < 0.2 else " ".join(words)


def test_equals_the_definition(spark):
    rows = [*texts(random.Random(3), 300), *((1000 + i, t) for i, t in enumerate(ODD_TEXTS))]
    got = simhash.near_duplicates(corpus(spark, rows))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    checked(got, rows)


@pytest.mark.parametrize("size", [3, 16])
def test_crowded_buckets_lose_no_link(spark, size):
    """Random walks of bits around few centres: every bucket is cut, and classes meet only across blocks."""
    rng = random.Random(size)
    fps = {0}
    for _ in range(5):
        at = rng.getrandbits(64)
        for _ in range(60):
            fps.add(at)
            for _ in range(rng.randint(1, 6)):
                at ^= 1 << rng.randrange(20)  # the other segments stay equal
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    assert simhash.crowded(nodes, 4, size).count() > 0
    labels = dict(map(tuple, simhash.components(simhash.links(nodes, 4, size)).collect()))
    want = plain_components(fps)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(want[i], set()).add(labels.get(signed[i], signed[i]))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


@pytest.mark.parametrize("most", [2, 3, 4, 6])
def test_every_close_pair_shares_a_variant(spark, most):
    rng = random.Random(most)
    pairs = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), most):
            b ^= 1 << bit
        pairs.append((a, b))
    signed = [tuple(x - (1 << 64) if x >> 63 else x for x in p) for p in pairs]
    frame = spark.createDataFrame([(i, x) for i, p in enumerate(signed) for x in p], "i int, fp long")
    buckets = {}
    for r in simhash.indexed(frame, most).collect():
        buckets.setdefault(r["fp"], set()).add(r["bucket"])
    assert all(len(v) == 64 for v in buckets.values())
    assert all(buckets[a] & buckets[b] for a, b in signed)


def test_empty_table_null_and_repeated_keys(spark):
    assert simhash.near_duplicates(corpus(spark, [])).count() == 0
    rows = [(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (2, None), (1, ""), (None, "x y z")]
    got = sorted(map(tuple, simhash.near_duplicates(corpus(spark, rows)).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (5, 5), (2, 1), (1, 1), (None, None)], key=str)


def test_invalid_utf8(spark):
    docs = spark.range(2).selectExpr("id AS doc_id", "cast(X'61FF6220C0' AS string) AS text")
    assert {r["component_id"] for r in simhash.near_duplicates(docs).collect()} == {0}


def test_long_text():
    words = np.random.default_rng(1).integers(0, 5000, 80_000)
    text = " ".join(f"w{w}" for w in words)
    assert simhash.fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    checked(QUERIES["op11_simhash_variants"](spark, sf), rows)
