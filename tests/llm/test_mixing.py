import random

import pandas as pd
import pytest

from tidemark.llm import bpe, mixing

DOCS = "doc_id long, text string, source string, lang string, mailbox string, rate double, size int"
MIX = "mix_name string, source string, target_share double, max_repeats int"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    docs = []
    for i in range(3000):
        source = rng.choices(["Big ", "mid", "tiny", None, "other"], [60, 20, 2, 3, 15])[0]
        text = None if rng.random() < 0.02 else "word " * rng.randint(0, 60)
        docs.append((i, text, source, rng.choice(["en", "EN", "de", None, "??"]), rng.choice([None, "a@x", "b@x"]), 1.0, 1))
    mix = [("even", "BIG", 1.0, 3), ("even", "mid", 1.0, 3), ("even", "tiny", 1.0, 3), ("even", "absent", 1.0, 3), ("own", "big", 0.5, 1), ("own", "mid", 0.3, None), ("own", "mid", 0.2, 2), ("own", "zero", 0.0, 1)]
    return docs, spark.createDataFrame(docs, DOCS), spark.createDataFrame(mix, MIX)


def test_shares_and_caps(spark, tables):
    docs, df, mix = tables
    copies, shares = mixing.mixed(df, mix)
    drawn, shares = copies.toPandas(), shares.toPandas().set_index(["mix_name", "source"])
    n = dict(zip([d[0] for d in docs], bpe.encode(bpe.vocabulary(bpe.default_path()), [d[1] or "" for d in docs])[1], strict=True))
    assert not drawn.duplicated(["mix_name", "doc_id"]).any() and (drawn.n_tokens == drawn.doc_id.map(n)).all()
    got = (drawn.n_tokens * drawn.copies).groupby([drawn.mix_name, drawn.source]).sum()
    for key, r in shares.iterrows():
        have = sum(n[d[0]] for d in docs if d[2] and d[2].strip().lower() == key[1])
        assert r.available == have and r.reached_tokens == got.get(key, 0) and r.most_copies <= r.max_repeats
        aim = min(r.target_tokens, have * r.max_repeats)
        assert abs(r.reached_tokens - aim) <= 130, key
    status = shares.status.to_dict()
    assert status["even", "absent"] == "no documents" and status["even", "tiny"] == "short" and status["own", "zero"] == "met"
    for key, r in shares.iterrows():
        assert (r.status == "met") == (r.available * r.max_repeats >= r.target_tokens)
    assert abs(shares.loc["own"].reached_share.sum() - 1) < 1e-9
    again = mixing.mixed(df.repartition(7), mix)[0].toPandas()
    pd.testing.assert_frame_equal(*(x.sort_values(["mix_name", "doc_id"], ignore_index=True) for x in (drawn, again)))


def test_a_given_size(spark, tables):
    _, df, mix = tables
    got = {r.source: r for r in mixing.mixed(df, mix.filter("mix_name = 'even'"), size_tokens=4000)[1].collect()}
    assert all(r.status == "met" and abs(r.reached_tokens - 1000) < 130 for s, r in got.items() if s != "absent")


def test_the_largest_size_at_which_shares_are_reached(spark, tables):
    _, df, mix = tables
    m = mixing.mixture(df, mix, size_tokens=mixing.REACHABLE)
    got = {(r.mix_name, r.source): r for r in mixing.shares(m.copies, m.docs, m.goals, mixing.REACHABLE, tolerance=0.02).collect()}
    for (name, source), r in got.items():
        if source == "absent":
            assert r.status == "no documents" and r.attainable_share == 0
        else:
            assert abs(r.reached_share - r.attainable_share) <= 0.02 * r.attainable_share
            assert r.status == ("over" if name == "even" else "met") and r.most_copies <= r.max_repeats
    tight = min((r for r in got.values() if r.mix_name == "even" and r.available), key=lambda r: r.available * r.max_repeats)
    assert tight.source == "tiny" and abs(tight.reached_tokens - tight.available * tight.max_repeats) <= 130
    plain = {(r.mix_name, r.source): r.status for r in mixing.shares(m.copies, m.docs, m.goals, tolerance=0.02).collect()}
    assert plain["even", "absent"] == "no documents"


def test_marginals_against_pandas(spark, tables):
    _, df, mix = tables
    m = mixing.mixture(df, mix, size_tokens=mixing.REACHABLE)
    docs, copies, goals = m.docs.toPandas(), m.copies.toPandas(), m.goals.toPandas()
    got = {(r.mix_name, r.axis, r.value): r for r in mixing.marginals(m.copies, m.docs, m.goals).collect()}
    for (name, axis, value), r in got.items():
        own = docs[docs.source.isin(goals[goals.mix_name == name].source)]
        mine = copies[copies.mix_name == name]
        assert r.target_share == pytest.approx(own[own[axis].astype(str) == value].n_tokens.sum() / own.n_tokens.sum())
        weight = mine.n_tokens * mine.copies
        assert r.reached_share == pytest.approx(weight[mine[axis].astype(str) == value].sum() / weight.sum()) and r.residual == pytest.approx(r.reached_share - r.target_share)
    assert {a for _, a, _ in got} == {"lang", "topic"}


def test_topics_of_the_caller(spark, tables):
    from pyspark.sql import functions as F

    _, df, mix = tables
    m = mixing.mixture(df, mix, topic=F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3))
    assert {r.topic for r in m.docs.select("topic").distinct().collect()} == {-1, 1, 2}


def test_raking_reaches_the_marginals():
    cells = pd.DataFrame({"mix_name": "m", "source": list("aabb"), "lang": ["x", "y", "x", "y"], "topic": 0, "tokens": [100, 300, 300, 100], "target_share": [0.5, 0.5, 0.5, 0.5], "max_repeats": 4})
    w = mixing._rake(cells).rate.to_numpy() * cells.tokens.to_numpy()
    assert w[:2].sum() == pytest.approx(400) and w[2:].sum() == pytest.approx(400) and w[[0, 2]].sum() == pytest.approx(400, rel=1e-3)


def test_a_full_cell_passes_its_rest_on():
    cells = pd.DataFrame({"mix_name": "m", "source": list("abb"), "lang": ["x", "x", "y"], "topic": 0, "tokens": [800, 10, 190], "target_share": [0.7, 0.3, 0.3], "max_repeats": 2})
    out = mixing._rake(cells)
    w = out.rate.to_numpy() * cells.tokens.to_numpy()
    assert w[1:].sum() == pytest.approx(300) and (out.rate <= 2 + 1e-9).all()


def test_empty_tables(spark, tables):
    _, df, mix = tables
    copies, shares = mixing.mixed(df.limit(0), mix)
    assert copies.count() == 0 and {r.status for r in shares.collect()} <= {"no documents", "met"}
    copies, shares = mixing.mixed(df, mix.limit(0))
    assert copies.count() == 0 and shares.count() == 0
