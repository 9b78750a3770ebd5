from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from callwise.llm import common, mixing, reshard
from tests.llm.brute import ODD_TEXTS, WORD

SCHEMA = "doc_id long, text string, source string, size string, _h string, shard string"


def corpus(spark, rows):
    return spark.createDataFrame([(*r, "s", "h", "x") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 60))), rng.choice(["a", "a", "a", "b", "c", None, "é"])) for i in range(400)]
    return out + [(1000 + i, t, "odd") for i, t in enumerate(ODD_TEXTS)] + [(7, "same row", "b")] * 3 + [(None, "no key", None)]


def targets(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            out.update({s: level * w[s] for s in free})
            break
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free -= over
    return out


def test_mix_meets_its_targets(spark, rows):
    got = mixing.mix(corpus(spark, rows)).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    want, taken = targets(size), defaultdict(int)
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in size:
        assert abs(taken[s] - want[s]) <= 2
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(corpus(spark, rows[::-1]).repartition(5)).collect()), key=str)


def test_seats_go_to_the_highest_quotients(spark):
    t = spark.createDataFrame([("a", 53.0), ("b", 24.0), ("c", 23.0), (None, 0.0)], "source string, target double")
    got = {r["source"]: r["quota"] for r in mixing.sainte_lague(t, 7).collect()}
    seats = defaultdict(int)
    for _ in range(7):
        best = max("abc", key=lambda s: ({"a": 53, "b": 24, "c": 23}[s] / (2 * seats[s] + 1), -ord(s)))
        seats[best] += 1
    assert got == dict(seats)


def test_seats_of_any_number_go_to_the_highest_quotients(spark):
    rng = random.Random(5)
    for n, seats in ((1, 1), (6, 2), (6, 40), (30, 7), (30, 500)):
        share = {f"s{i:02}": rng.choice([0.01, 1.0, 1.0, 40.0]) * rng.random() for i in range(n)}
        want = defaultdict(int)
        for _ in range(seats):
            want[max(sorted(share), key=lambda s: share[s] / (2 * want[s] + 1))] += 1
        t = spark.createDataFrame(list(share.items()), "source string, target double")
        assert {r["source"]: r["quota"] for r in mixing.sainte_lague(t, seats).collect()} == {s: k for s, k in want.items() if k}
    t = spark.createDataFrame([("a", 3e9), ("b", 2e9 - 35.0), ("c", 35.0)], "source string, target double")
    assert {r["source"]: r["quota"] for r in mixing.sainte_lague(t, 5_000_000_000).collect()} == {"a": 3_000_000_000, "b": 1_999_999_965, "c": 35}


def test_small_sources_get_their_target_beside_large_ones(spark):
    rows = [(i, "w " * 100_000, "large") for i in range(40)] + [(100 + i, "just five words of it", f"small{i}") for i in range(4)]
    for docs in (corpus(spark, rows), corpus(spark, rows[:1] + rows[40:])):
        taken = defaultdict(int)
        for r in mixing.mix(docs).collect():
            taken[r["source"]] += r["taken"]
        assert all(taken[f"small{i}"] == 15 for i in range(4))
    assert all(r["taken"] > 0 for r in mixing.mix(corpus(spark, rows), seats=50).collect() if r["source"] != "large")


def test_coarse_blocks_keep_every_bound(spark, rows):
    for r in mixing.mix(corpus(spark, rows), seats=50).collect():
        assert 0 <= r["taken"] <= 3 * r["size"]


def test_mixed_rows_hold_the_words_taken(spark, rows):
    docs = corpus(spark, rows)
    want = defaultdict(int)
    for r in mixing.mix(docs).collect():
        want[(r["doc_id"], r["source"])] += r["taken"]
    got = defaultdict(int)
    for r in mixing.apply_mix(docs).collect():
        got[(r["doc_id"], r["source"])] += len(WORD.findall(r["text"]))
    assert {k: v for k, v in want.items() if v} == dict(got)


@pytest.mark.parametrize("seats", [None, 50])
def test_texts_stay_whole_but_for_one_a_source(spark, rows, seats):
    docs, cut = corpus(spark, [(i, t, s) for i, (_, t, s) in enumerate(rows)]), defaultdict(set)
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in mixing.apply_mix(docs, **({"seats": seats} if seats else {})).collect():
        if r["text"] != whole[r["doc_id"]]:
            cut[r["source"]].add(r["doc_id"])
    assert all(len(ids) == 1 for ids in cut.values())


def test_mix_of_nothing(spark):
    assert mixing.mix(corpus(spark, [])).collect() == []
    assert [r["taken"] for r in mixing.mix(corpus(spark, [(1, None, None), (2, "", "a")])).collect()] == [0, 0]


def test_order_does_not_depend_on_buckets(spark, rows):
    df = common.written(corpus(spark, rows).select("doc_id", "source", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"),
                                                  F.xxhash64("doc_id", "text").alias("h")), "t")
    one = common.with_order(df, ["source"], "h", ["doc_id", "n"], "n", bucket_rows=10 ** 9).collect()
    many = common.with_order(df, ["source"], "h", ["doc_id", "n"], "n", bucket_rows=7).collect()
    assert sorted(map(tuple, one), key=str) == sorted(map(tuple, many), key=str)


def old(n):
    return F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(n))


def test_reshard_deals_rows_evenly_and_keeps_what_it_can(spark, rows):
    docs = corpus(spark, rows)
    got = reshard.reshard(docs, old(5), lambda n: reshard.even_capacities(n, 7)).collect()
    assert len(got) == len(rows)
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r["slot"])
    counts = [len(v) for v in by_shard.values()]
    assert max(counts) - min(counts) <= 1 and len(by_shard) == 7
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, reshard.reshard(docs.repartition(3), old(5), lambda n: reshard.even_capacities(n, 7)).collect()), key=str)
    assert reshard.reshard(docs.where("false"), old(5), lambda n: reshard.even_capacities(n, 7)).collect() == []


def test_plan_moves_the_fewest_bytes(spark):
    rng = random.Random(9)
    for _ in range(60):
        shards = rng.randint(1, 3)
        blocks = [(i, k, rng.randint(1, 4), 0) for i in range(rng.randint(1, 3)) for k in range(2)]
        blocks = [(i, k, n, n * rng.choice([1, 10, 100])) for i, k, n, _ in blocks]
        total = sum(b[2] for b in blocks)
        caps = reshard.even_capacities(total, shards)
        runs = reshard.plan_moves(blocks, caps)
        assert sum(r[3] for r in runs) == total
        price = {(b[0], b[1]): b[3] / b[2] for b in blocks}
        moved = sum(r[3] * price[(r[0], r[1])] for r in runs if r[0] != r[4])
        # What stays in an old shard is best its dearest rows, as many as its successor holds.
        best = 0.0
        for i in {b[0] for b in blocks}:
            each = sorted((price[(b[0], b[1])] for b in blocks if b[0] == i for _ in range(b[2])), reverse=True)
            best += sum(each[caps[i] if i < shards else 0:])
        assert abs(moved - best) < 1e-6


def test_only_changed_shards_are_rewritten(spark, tmp_path):
    docs = corpus(spark, [(i, f"text {i}", "s") for i in range(40)])
    old_shard = F.when(F.col("doc_id") < 10, 0).when(F.col("doc_id") < 20, 1).otherwise(2)
    stored = reshard.stored_shards(docs, old_shard)
    plan = reshard.plan_rows(stored, lambda n: [10, 10, 10, 10])
    after, changed = reshard.rewrite_shards(stored, plan, str(tmp_path / "new"))
    assert changed == [2, 3]
    new = spark.read.parquet(str(tmp_path / "new"))
    assert new.count() == 20 and {r["shard"] for r in new.select("shard").distinct().collect()} == {2, 3}
    got = after.select("row.*", F.col("shard").alias("to"), F.col("slot").alias("at")).collect()
    assert sorted((r["doc_id"], r["text"], r["_h"], r["shard"]) for r in got) == [(i, f"text {i}", "h", "x") for i in range(40)]
    assert len({(r["to"], r["at"]) for r in got}) == 40 and {r["to"] for r in got if r["doc_id"] < 10} == {0}


@pytest.mark.parametrize("sent", [reshard.SENT_ROWS, 0])
def test_the_smallest_rows_move_and_every_row_is_read_back(spark, rows, monkeypatch, sent):
    monkeypatch.setattr(reshard, "SENT_ROWS", sent)
    docs = corpus(spark, rows)
    got = reshard.reshard(docs, F.pmod(F.coalesce("doc_id", F.lit(3)), F.lit(3)), lambda n: reshard.even_capacities(n, 5)).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    for shard in range(3):
        mine = sorted((r["size"] for r in got if r["old_shard"] == shard), reverse=True)
        stay = sorted((r["size"] for r in got if r["old_shard"] == r["shard"] == shard), reverse=True)
        assert len(stay) < len(mine) and stay == mine[:len(stay)]
