"""The near-duplicate stage against Jaccard similarity of all pairs."""

import numpy as np
import pytest
from brute import near_groups

import corpus_pipeline
from tessera.llm import neardup

SCHEMA = "doc_id long, text string"


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 50000, n)]


def changed(rng, text, places):
    out = list(text)
    for k in rng.choice(len(out), places, replace=False):
        out[k] = f"new{rng.integers(1 << 30)}"
    return out


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(map(" ".join, texts))), SCHEMA)
    return {r.key.id: r.keeper.id for r in neardup.groups(docs).collect()}


def test_unrelated_texts_with_repeated_lines_stay(spark):
    rng = np.random.default_rng(1)
    line = words(rng, 12)
    texts = [words(rng, 300) + line * 20 for _ in range(6)]
    assert found(spark, texts) == near_groups(texts) == {k: k for k in range(6)}


def test_groups_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(2)
    texts = []
    for places in (0, 1, 2, 4, 5, 6, 6, 7, 7, 8, 9, 12) * 4:
        a = words(rng, 300)
        texts += [a, changed(rng, a, places), a + words(rng, 12) * 5, a[:240], a[:235]]
    texts += [[], [], ["one"], ["one", "two"], ["One,", "two"]]
    want = near_groups(texts)
    assert len(set(want.values())) < len(texts) / 2
    assert found(spark, texts) == want
    docs = spark.createDataFrame(list(enumerate(map(" ".join, texts))), SCHEMA)
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == set(want.values())


@pytest.mark.parametrize("step", [2, 16])
def test_full_buckets_lose_no_pair(spark, monkeypatch, step):
    rng = np.random.default_rng(3)
    passage = words(rng, 150)
    texts = []
    for _ in range(40):
        a = words(rng, 60)
        texts += [passage + a, changed(rng, passage, 1) + changed(rng, a, 3), passage + changed(rng, a, 12)]
    # no shingle counts as common, so the passage's are in all prefixes
    monkeypatch.setattr(neardup, "_common", lambda slim: (np.zeros(0, np.uint64), np.zeros(0, np.int64)), raising=False)
    monkeypatch.setattr(neardup, "STEP", step, raising=False)
    want = near_groups(texts)
    assert 20 < len(set(want.values())) < len(texts)
    assert found(spark, texts) == want


def compared(spark, monkeypatch, texts):
    """The pairs that were compared."""
    pairs, verified = [], neardup.verified

    def counted(found, *rest):
        pairs.extend(tuple(r) for r in found.distinct().collect())
        return verified(found, *rest)

    monkeypatch.setattr(neardup, "verified", counted)
    assert found(spark, texts) == {k: k for k in range(len(texts))}
    monkeypatch.setattr(neardup, "verified", verified)
    return len(pairs)


def test_passages_that_a_sample_misses_are_not_compared_in_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    passages = [words(rng, 60) for _ in range(8)]
    monkeypatch.setattr(neardup, "SAMPLE", 4)
    # 12 and 48 texts with each passage, with their sizes close enough to be compared
    few, many = (compared(spark, monkeypatch, [words(rng, 240) + passages[k % 8] for k in range(8 * n)]) for n in (12, 48))
    assert few <= 96 and many <= 4 * 96


def test_moved_shingles_lose_no_pair(spark, monkeypatch):
    rng = np.random.default_rng(5)
    passages, texts = [words(rng, 40) for _ in range(3)], []
    for k in range(30):
        a = words(rng, 160) + passages[k % 3]
        texts += [a, changed(rng, a, 3), changed(rng, a, 5), changed(rng, a, 8), passages[k % 3] + words(rng, 10)]
    want = near_groups(texts)
    assert 30 < len(set(want.values())) < len(texts)
    monkeypatch.setattr(neardup, "SAMPLE", 4)
    for full, most in ((1, 500_000), (8, 40)):
        monkeypatch.setattr(neardup, "FULL", full)
        monkeypatch.setattr(neardup, "MOVED", most)
        assert found(spark, texts) == want


def test_full_buckets_lose_no_pair_where_nothing_moves(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FULL", 1 << 20)
    test_full_buckets_lose_no_pair(spark, monkeypatch, 2)
