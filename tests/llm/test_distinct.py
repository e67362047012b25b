import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.keys import plain_key
from tidemark.llm import distinct

ROWS = "u string, day int, g string, bucket int, bits string"


@pytest.fixture
def data(spark):
    rng = random.Random(4)
    rows = [(f"U{int(rng.paretovariate(0.4)) % 9000}", rng.choice([1, 2, 3, None]), rng.choice("aab") if rng.random() > 0.05 else None, 1, "x") for _ in range(30_000)]
    rows += [(" u7 ", 1, "a", 1, "x"), (None, 1, "a", 1, "x"), ("", 2, "b", 1, "x")]
    return rows, spark.createDataFrame(rows, ROWS)


def _seen(rows):
    return {(d, g, u.strip().lower()) for u, d, g, *_ in rows if u and u.strip()}


def _stored(df, sparse=None, monkeypatch=None):
    seen = distinct.facts(df, plain_key("u"), {"day": F.col("day"), "g": F.col("g")})
    return distinct.buckets(seen, distinct.dictionary(seen, parts=7), ["day", "g"])


@pytest.mark.parametrize("sparse", [0, 100, 2047])
def test_counts_of_every_combination(data, sparse, monkeypatch):
    monkeypatch.setattr(distinct, "SPARSE", sparse)
    rows, df = data
    stored, seen = _stored(df), _seen(rows)
    for dims in ([], ["day"], ["g"], ["day", "g"]):
        got = {tuple(r[d] for d in dims): r.n_distinct for r in distinct.count(distinct.union(stored, dims), dims).collect()}
        want = {}
        for d, g, u in seen:
            want.setdefault(tuple({"day": d, "g": g}[x] for x in dims), set()).add(u)
        assert got == {k: len(v) for k, v in want.items()}
    for days in itertools.combinations([1, 2, 3], 2):
        got = distinct.count(distinct.intersection(stored, "day", days), []).first()[0]
        assert got == len(set.intersection(*[{u for d, _, u in seen if d == x} for x in days]))


def test_dictionary_is_dense_and_grows(spark, data):
    _, df = data
    seen = distinct.facts(df, plain_key("u"), {"day": F.col("day")})
    old = distinct.dictionary(seen.filter("day = 1"), parts=5).cache()
    new = distinct.dictionary(seen, old, parts=5).cache()
    for codes in (old, new):
        ns = sorted(r.n for r in codes.collect())
        assert ns == list(range(len(ns)))
    assert old.join(new.withColumnRenamed("n", "m"), "id").filter("n != m").count() == 0
    assert new.count() == seen.select("id").distinct().count()


def test_empty(spark):
    stored = _stored(spark.createDataFrame([], ROWS))
    assert distinct.count(distinct.union(stored, ["day"]), ["day"]).count() == 0


def test_returning_on_every_day(spark):
    import datetime
    import random

    rng = random.Random(4)
    days = [None, *[datetime.date(2024, 2, x) for x in (27, 28, 29)], *[datetime.date(2024, 3, x) for x in (1, 2, 5, 6)]]
    seen = {(rng.choice(days), rng.choice(["c", "d", None]), f"u{rng.randint(0, 60)}") for _ in range(900)}
    rows = spark.createDataFrame(sorted(seen, key=str), "day date, c string, id string")
    got = distinct.count(distinct.returning(distinct.buckets(rows, distinct.dictionary(rows), ["day", "c"]), "day", ["c"]), ["day", "c"])
    users = lambda d, c: {u for x, y, u in seen if (x, y) == (d, c)}
    want = {(d, c): len(users(d, c) & users(d + datetime.timedelta(days=1), c)) for d in days if d for c in ("c", "d", None)}
    assert {(r.day, r.c): r.n_distinct for r in got.collect() if r.n_distinct} == {k: n for k, n in want.items() if n}
