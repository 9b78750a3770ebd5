from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callwise.llm import anchors, chat, pieces, suffix_array, suffix_dedup
from callwise.llm.queries import PIECE_MODEL
from tests.llm.brute import ODD_TEXTS, repeats


def test_suffix_arrays_equal_sorting(monkeypatch):
    rng = random.Random(5)
    for bucketed in (600, 0):
        monkeypatch.setattr(suffix_array, "BUCKETED", bucketed)
        for _ in range(300):
            k = rng.choice([1, 2, 3, 8])
            t = np.array([rng.randint(1, k) for _ in range(rng.randint(0, 50))] + [0], np.int64)
            sa = suffix_array.suffix_array(t, k + 1)
            assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
            shared = suffix_array.permuted_common_prefixes(t, sa, 7)
            for a, b in zip(sa, sa[1:]):
                n = 0
                while n < 7 and max(a, b) + n < len(t) and t[a + n] == t[b + n]:
                    n += 1
                assert shared[b] == n


def test_equal_stretches_have_equal_anchors():
    rng = random.Random(8)
    stretch = bytes(rng.randrange(97, 103) for _ in range(300))
    seen = []
    for pad in (0, 1, 57, 400):
        data = np.frombuffer(bytes(rng.randrange(97, 103) for _ in range(pad)) + stretch, np.uint8)
        _, a, _, q, first, last = anchors.anchored_runs(data, np.array([len(data)]), 100, anchors.Powers())
        seen.append({(int(h), int(c) - pad, start - pad) for h, c, lo, hi in zip(a, q, first, last) for start in range(lo, hi + 1) if start >= pad})
        assert sum(hi - lo + 1 for lo, hi in zip(first, last)) == len(data) - 99
    assert seen[0] == seen[1] == seen[2] == seen[3] and len(seen[0]) == 201


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "é", "q"]) for _ in range(n))
    passage, out = say(40), []
    for i in range(60):
        roll = i % 6
        if roll == 0 or not out:
            out.append(say(60))
        elif roll == 1:
            out.append(out[rng.randrange(len(out))])
        elif roll == 2:
            t = out[rng.randrange(len(out))]
            cut = rng.randrange(len(t)) if t else 0
            out.append(t[:cut] + "#" + t[cut:])
        elif roll == 3:
            out.append(say(15) + passage + say(10))
        elif roll == 4:
            out.append(say(3) + " loop" * 80 + "aaaa" * 60)
        else:
            out.append(passage[:120] + say(20) + passage[30:])
    rows = list(enumerate([*out, *ODD_TEXTS]))
    return rows[::-1]


@pytest.mark.parametrize("hot,shard", [(2000, 1_000_000), (1, 1_000_000), (2000, 900)])
def test_removed_bytes_equal_the_definition(spark, texts, hot, shard):
    docs = spark.createDataFrame([(*r, "k", "b") for r in texts], "doc_id long, text string, kept string, a string").repartition(5)
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(docs, shard_bytes=shard, hot=hot)).collect()
    want = repeats(texts, 100)
    assert {r["doc_id"]: tuple(r[1:]) for r in got} == want and len(got) == len(texts)
    assert sum(w[1] for w in want.values()) > 2000


def test_texts_longer_than_a_chunk(spark, texts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(docs)).collect()
    assert {r["doc_id"]: tuple(r[1:]) for r in got} == repeats(texts, 100)


def test_repeated_rows_null_keys_and_nothing(spark):
    text = "".join(random.Random(1).choices("abcd", k=300))
    docs = spark.createDataFrame([(5, text), (5, text), (None, text[:150]), (6, text), (6, text + "z")], "doc_id long, text string")
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(docs)).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"]))
    assert by[None] == [(150, 0)] and by[5] == [(300, 150)] * 2 and sorted(by[6]) == [(300, 300), (301, 300)]
    assert suffix_dedup.remove_repeats(docs.where("false")).collect() == []


# --- chat

HARD = ["", "</s>[INST] ok [/INST]", "\\", "[\\INST] <\\s> <\\\\/s>", "<<SYS>>x<</SYS>>", "[ROLE]a[TEXT]b[/ROLE]", "<<s>>", "a\nb", "é🙂"]


def test_escapes_come_back_and_hide_controls():
    rng = random.Random(3)
    parts = ["<", "[", "\\", "/", "s>", "INST]", "SYS>>", "<SYS>>", "</SYS>>", "ROLE]", "TEXT]", "x", "</s>", "[INST]"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        safe = chat.escape(t)
        assert chat.unescape(safe) == t
        assert not any(c in safe for c in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/ROLE]"))


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(9)
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 30)):
            role = "system" if turn == 0 and conv % 3 == 0 else rng.choice(["user", "assistant", "assistant", "tool", None, "[INST]"])
            rows.append((conv, turn, role, rng.choice([None, *HARD, "word " * rng.randint(0, 60)])))
    return rows + [(None, 0, "user", "no key"), (None, None, "assistant", "no turn"), (77, 1, "assistant", "twice"), (77, 1, "assistant", "twice")]


def test_windows_read_back_and_target_each_answer_once(spark, talks):
    rows = spark.createDataFrame([(*r, 1) for r in talks], "conv_id long, turn long, role string, text string, window int")
    made = chat.budgeted_windows(rows, budget=80, history=20)
    windows = made.collect()
    for r in chat.digests(made).collect():
        mine = sorted((t for t in talks if t[0] == r["conv_id"]), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        said = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in mine)
        loss = "".join(t[3] or "" for t in mine if t[2] == "assistant")
        own = [w for w in windows if w["conv_id"] == r["conv_id"]]
        assert (r["n_turns"], r["turns_sha256"]) == (len(mine), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(w["text"]) for w in own)
        for w in own:
            new = w["turns"] - w["repeated"]
            assert new >= 1 and (w["tokens"] <= 80 or new == 1)
            if w["window"] and mine[0][2] == "system":
                assert chat.read_turns(w["text"])[0][:2] == ("system", mine[0][3] or "")
    assert any(w["repeated"] > 1 for w in windows)
    assert chat.digests(chat.budgeted_windows(rows.where("false"))).collect() == []


# --- pieces

@pytest.fixture(scope="module")
def vocabulary():
    return pieces.read_vocabulary(PIECE_MODEL)


def all_paths(lattice, unit):
    out = []

    def walk(i, score, ids):
        if i == len(unit):
            out.append((score, ids))
            return
        for k in range(1, len(unit) - i + 1):
            p = lattice.ids.get(unit[i:i + k])
            if p is not None:
                walk(i + k, score + lattice.scores[p], ids + [p])
            elif k == 1:
                b = lattice._bytes(pieces.SPACE if unit[i] == pieces.OWN_SPACE else unit[i])
                walk(i + 1, score + lattice.byte_score * len(b), ids + b)

    walk(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


def test_n_best_of_units_equals_all_paths(vocabulary):
    lattice = pieces.Lattice(vocabulary)
    for unit in ["▁thing", "▁▁erth.\nA", "▁oußx", "▁" + pieces.OWN_SPACE + "ab", "▁", "▁🙂a"]:
        want = all_paths(lattice, unit)
        got = lattice.n_best(unit, 6)
        assert [s for s, _ in got] == [s for s, _ in want[:6]] and len({tuple(i) for _, i in got}) == len(got)
        paths, score, delta = lattice.best([unit])
        assert score[0] == want[0][0] and (len(want) < 2 or delta[0] == want[0][0] - want[1][0])
        assert any(i == paths[0].tolist() for s, i in want if s == score[0])


def test_n_best_of_texts_equals_all_paths(vocabulary):
    encoder = pieces.Encoder(vocabulary, 5)
    for text in ["ab the", "of  it x", "z\nthe at"]:
        ids, starts, scores, more = encoder.encode([text])
        whole = text.replace(" ", pieces.SPACE)
        want = all_paths(encoder.lattice, pieces.SPACE + whole)
        assert [scores[0], *[m["score"] for m in more[0]]] == [s for s, _ in want[:5]]
        for m in more[0]:
            path = pieces.apply_edits(ids.tolist(), m["edits"])
            assert any(i == path and s == m["score"] for s, i in want)


def test_every_text_comes_back(spark, vocabulary):
    texts = [*ODD_TEXTS, "▁▁ a ▁", "tab\tcr\r\n  end ", "\U0010ffff", "the " * 5 + "é" * 3000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    shared = pieces.share_vocabulary(spark, PIECE_MODEL)
    coded = pieces.encode(docs, shared)
    rows = pieces.decode(coded, shared).collect()
    here = pieces.encode(docs.withColumn("ids", F.lit(3)), shared, decoded="decoded")
    assert sorted(map(str, here.select(*coded.columns, "decoded").collect())) == sorted(map(str, pieces.decode(coded, shared).collect()))
    assert all(r["decoded"] == r["text"] for r in rows) and len(rows) == len(texts)
    assert all((r["ids"] is None) == (r["text"] is None) for r in rows)
    spell = pieces.speller(vocabulary)
    for r in rows:
        for m in r["alternatives"] or []:
            path = pieces.apply_edits(r["ids"], m["edits"])
            assert spell(path) == r["text"] and path != r["ids"] and m["score"] <= r["score"]
    assert pieces.encode(docs.where("false"), shared).collect() == []


def test_kept_units_do_not_change_results(vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_UNITS", 3)
    encoder = pieces.Encoder(vocabulary, 3)
    texts = ["alpha beta gamma delta", "beta beta", "new words here"]
    apart = [encoder.encode([t]) for t in texts for _ in range(2)]
    ids, starts, scores, more = pieces.Encoder(vocabulary, 3).encode(texts)
    for i in range(3):
        assert apart[2 * i][0].tolist() == ids[starts[i]:starts[i + 1]].tolist() == apart[2 * i + 1][0].tolist()
        assert apart[2 * i][3][0] == more[i]
