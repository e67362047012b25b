import random

import numpy as np

from tidemark.llm import bpe, topics

KINDS = ["invoice payment total amount due bank", "football match goal team player score", "recipe flour butter oven sugar bake"]


def _rows():
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(KINDS[i % 3].split()) for _ in range(40)), "x") for i in range(90)]
    return rows + [(100, None, "x"), (101, "", "x"), (102, "1 2 3 -- !", "x"), (None, "goal goal team", "x"), (103, "sugar " * 50_000, "x")]


def _topics(spark, rows, model):
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    return {r.doc_id: r.label for r in bpe.token_counts(df, "text", ["doc_id"], label=model).collect()}


def test_clusters_separate_vocabularies_and_reach_every_row(spark):
    df = spark.createDataFrame(_rows(), "doc_id long, text string, label string")
    model = topics.fitted(df, k=3)
    got = _topics(spark, _rows(), model)
    assert len(got) == len(_rows()) and None not in got.values()
    of_kind = [{got[i] for i in range(k, 90, 3)} for k in range(3)]
    assert [len(s) for s in of_kind] == [1, 1, 1] and len(set.union(*of_kind)) == 3
    assert got[None] in of_kind[1] and got[103] in of_kind[2]
    again = topics.fitted(df.repartition(5), k=3)
    assert np.array_equal(again.centres, model.centres) and np.array_equal(again.weights, model.weights)


def test_a_sample_is_enough(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(KINDS[i % 3].split()) for _ in range(30)), "x") for i in range(600)]
    monkeypatch.setattr(topics, "SAMPLE_ROWS", 60)
    got = _topics(spark, rows, topics.fitted(spark.createDataFrame(rows, "doc_id long, text string, label string"), k=3))
    assert all(len({got[i] for i in range(k, 600, 3)}) == 1 for k in range(3))


def test_few_or_no_texts(spark):
    one = spark.createDataFrame([(1, "same words here", "x")] * 5, "doc_id long, text string, label string")
    assert set(_topics(spark, [(1, "same words here", "x")], topics.fitted(one)).values()) == {0}
    for none in (one.limit(0), spark.createDataFrame([(1, None, "x"), (2, "1 2", "x")], "doc_id long, text string, label string")):
        assert set(_topics(spark, _rows(), topics.fitted(none)).values()) == {0}


def test_pieces_change_no_topic(monkeypatch):
    rows = [t or "" for _, t, _ in _rows()]
    model = topics.clustered(np.vstack(list(topics._features(*bpe.split(rows)))), 3)
    whole = model(*bpe.split(rows))
    monkeypatch.setattr(topics, "ROWS", 7)
    assert np.array_equal(model(*bpe.split(rows)), whole)
    assert np.array_equal(np.concatenate([model(*bpe.split([t])) for t in rows]), whole)


def test_the_clusters_are_those_of_all_texts(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(KINDS[i % 3].split()) for _ in range(25)), "x") for i in range(6_000)] + [(6_000 + i, "anchor sail keel mast " + "sail " * i, "x") for i in range(10)]
    model = topics.fitted(spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(3), k=5)
    counts = np.vstack(list(topics._features(*bpe.split([t for _, t, _ in rows]))))
    different = np.unique(counts, axis=0)
    assert len(different) > 5_000
    assert np.array_equal(model.weights, np.log((1 + len(different)) / (1 + (different > 0).sum(axis=0))))
    whole = topics.clustered(counts, 5)
    assert np.array_equal(model.centres, whole.centres) and len(model.centres) == 5


def test_candidates_change_no_seed(monkeypatch):
    rng = random.Random(5)
    counts = np.vstack(list(topics._features(*bpe.split([" ".join(rng.choice(" ".join(KINDS).split()) for _ in range(20)) for _ in range(400)]))))
    many = topics.clustered(counts, 8)
    monkeypatch.setattr(topics, "CANDIDATES", 1)
    assert np.array_equal(topics.clustered(counts, 8).centres, many.centres)


def test_packed_counts_are_whole():
    counts = np.zeros((3, topics.FEATURES), np.int64)
    counts[0, [0, 5, 1023]] = 1, 2**22 - 1, 2**22
    counts[2, [5, 6]] = 2**27 + 3, 7
    (c,) = topics._unpacked(topics._packed(topics._sparse(counts)))
    back = np.zeros_like(counts)
    back[c.row, c.feature] = c.n
    assert np.array_equal(back, counts)
