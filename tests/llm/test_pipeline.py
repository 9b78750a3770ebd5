"""The pipeline's stages on the smallest tables, each against its own input."""

from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
import pytest
from callwise.llm import near_dup
from callwise.llm.common import written
from tests.llm.brute import WORD, edit_distance, personal_data
from tests.llm.test_mixing_and_reshard import targets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def test_columns_stay(results):
    assert all(r.columns == results[0].columns for r in results[:-1]) and [n for n, _ in corpus_pipeline.STAGES][0] == "quality"


def test_quality_drops_poor_documents_and_keeps_good_ones(spark, results):
    kept = {r["doc_id"] for r in results[1].collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = [r["doc_id"] in kept for r in labels if r["quality"] == 1]
    poor = [r["doc_id"] in kept for r in labels if r["quality"] == 0]
    assert sum(good) == len(good) and sum(poor) <= len(poor) / 2


def test_one_document_of_each_group_stays(results):
    before, after = results[1].collect(), results[2].collect()
    words = {r["doc_id"]: near_dup.word_hashes(r["text"] or "").tolist() for r in before}
    kept = sorted(r["doc_id"] for r in after)

    def near(a, b):
        longest = max(len(words[a]), len(words[b]))
        return abs(len(words[a]) - len(words[b])) <= 0.2 * longest and len(set(words[a]) & set(words[b])) > 0.4 * len(set(words[a])) \
            and edit_distance(words[a], words[b]) <= 0.2 * longest

    assert not any(near(a, b) for i, a in enumerate(kept) for b in kept[:i])
    gone = set(words) - set(kept)
    assert all(any(near(a, b) for b in words if b != a) for a in gone) and gone


def test_no_personal_data_is_left(results):
    assert results[2].count() == results[3].count()
    assert any(personal_data(r["text"]) for r in results[2].collect())
    for r in results[3].collect():
        assert personal_data(r["text"]) == [] and r["n_chars"] == len(r["text"])


def test_sources_meet_their_targets(results):
    size, got, whole = defaultdict(int), defaultdict(int), {}
    for r in results[3].collect():
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
        whole[r["doc_id"]] = r["text"]
    for r in results[4].collect():
        got[r["source"]] += len(WORD.findall(r["text"] or ""))
        assert whole[r["doc_id"]].startswith(r["text"])
    want = targets(size)
    assert all(abs(got[s] - want[s]) <= 2 for s in size)


def test_ids_spell_the_texts(results):
    from callwise.llm.pieces import read_vocabulary, speller
    from callwise.llm.queries import PIECE_MODEL

    spell = speller(read_vocabulary(PIECE_MODEL))
    assert sorted(spell(r["ids"]) for r in results[5].collect()) == sorted(r["text"] for r in results[4].collect())


def test_run_gives_the_last_stage(spark, results):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, results[5].collect()))
