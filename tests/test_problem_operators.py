"""The operators for late events, references, differing copies and redelivery, on small cases and against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.keys import MINUTE, arrival_us, campaign_key, floor_to, plain_key, request_key, wall_us
from tidemark.operators import compare, late, redelivery, references

T0 = dt.datetime(2024, 2, 5, 12)
RAW = "event_id string, campaign_id string, event_time timestamp_ntz, server_ts string, extra string"


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_arrival_notations(spark):
    cases = {
        "2024-02-05T12:00:00Z": 0, "2024-02-05 12:00:00.5": 500_000, "2024-02-05T21:00:00+09:00": 0, "2024-02-05T07:00:00-0500": 0,
        "2024-02-05T12:00:00.1234567Z": 123_456, "1707134400000": 0, "now()": None, "": None, "-": None, None: None, "2024-02-05": None, "2024-13-05T12:00:00Z": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", arrival_us("t").alias("us")).collect()
    base = 1_707_134_400_000_000
    assert {r.t: None if r.us is None else r.us - base for r in rows} == cases


def test_keys(spark):
    ids = [" REQ-1a\n", "req-000", "-", "", None, "0", "req-10"]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i string").select(request_key("i")).collect()]
    assert got == ["req-1a", None, None, None, None, None, "req-10"]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ["None", "CMP-1\t", "nofill", None, "pending"]], "i string").select(campaign_key("i")).collect()]
    assert got == [None, "cmp-1", None, None, None]


def _late_by_hand(rows, lateness=600, delay=10):
    seen = [(e, t, s) for e, _, t, s, _ in rows if s is not None]
    first, out = {}, set()
    for e, _, s in seen:
        if e is not None:
            first[e] = min(first.get(e, s), s)
    for e, t, s in seen:
        if e is None or t is None or s != first[e]:
            continue
        before = [x for _, x, y in seen if y < s and x is not None]
        end = t.replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
        if before and max(before) - dt.timedelta(seconds=delay) >= end + dt.timedelta(seconds=lateness):
            out.add(e)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_late_firsts_against_a_walk_over_the_log(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        t = None if rng.random() < 0.05 else at(rng.randint(0, 4000) + rng.choice([0, 0.5, 59.999999]))
        s = None if rng.random() < 0.05 else (t or T0) + dt.timedelta(seconds=rng.choice([0, 1, 30, 650, 670, 671, 900]))
        row = (None if rng.random() < 0.05 else f"e{i}", "c", t, s, "x")
        rows += [row] * rng.choice([1, 1, 1, 3])
    df = spark.createDataFrame([(e, c, t, None if s is None else s.isoformat(), x) for e, c, t, s, x in rows], RAW)
    got = [r[0] for r in late.late_firsts(df).collect()]
    assert sorted(got) == sorted(_late_by_hand(rows))


def test_cut_off_boundary(spark):
    rows = [("a", "c", at(0), at(0)), ("p", "c", at(669.999999), at(700)), ("b", "c", at(1), at(701)), ("q", "c", at(670), at(702)), ("tie", "c", at(2), at(702)), ("d", "c", at(2), at(703))]
    df = spark.createDataFrame([(e, c, t, s.isoformat(), None) for e, c, t, s in rows], RAW)
    assert [r[0] for r in late.late_firsts(df).collect()] == ["d"]


def test_frozen_periods_stay(spark):
    view = late.LambdaView()
    rows = [("a", at(0), at(1)), ("b", at(5), at(2)), ("x", at(800), at(800)), ("late", at(6), at(900)), ("y", at(801), at(901))]
    log = late.read_log(spark.createDataFrame([(e, "C ", t, s.isoformat(), None) for e, t, s in rows], RAW))
    firsts = view.firsts(view.stamped(log, view.closings(log)))
    us = lambda s: int((at(s) - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
    s1 = view.refresh(None, firsts, us(3))
    s2 = view.refresh(s1, firsts, us(850))
    full = {(r.group, r.n, r.provisional, r.frozen) for r in view.view(s2, view.speed(firsts, us(850))).collect()}
    assert full == {("c", 2, 0, True), ("c", 2, 1, False)}
    assert {r.n for r in s1.collect()} == {2}


def test_ids_without_arrival_count_in_their_period(spark):
    rows = [("a", at(0), at(1).isoformat()), ("u", at(5), "bad"), ("u", at(65), None), ("a", at(6), None), ("w", at(50_000), at(50_000).isoformat()), ("x", at(100_000), at(100_000).isoformat()), ("v", at(99_999_999), None), ("n", None, None), (None, at(0), None)]
    df = spark.createDataFrame([(e, "C ", t, s, None) for e, t, s in rows], RAW)
    minute = lambda s: int((at(s) - dt.datetime(1970, 1, 1)).total_seconds()) // 60 * 60_000_000 + MINUTE
    view = lambda **how: {(r.period_end, r.n, r.provisional, r.frozen) for r in late.corrected_periods(df, **how).collect()}
    later = {(minute(50_000), 1, 0, False), (minute(100_000), 1, 1, False)}
    assert view() == {(minute(0), 1, 0, True), *later}
    assert view(undated=True) == {(minute(0), 2, 0, True), (minute(99_999_999), 1, 0, False), *later}


def _messy_log(seed, n=500):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = None if rng.random() < 0.05 else at(rng.randint(0, 9000) + rng.choice([0, 0.5, 59.999999]))
        s = None if rng.random() < 0.05 else (t or T0) + dt.timedelta(seconds=rng.choice([0, 1, 30, 650, 670, 671, 900, 4000]))
        rows += [(None if rng.random() < 0.05 else f"e{i}", rng.choice(["c", " C", "d", None]), t, None if s is None else s.isoformat(), "x")] * rng.choice([1, 1, 1, 3])
        if rng.random() < 0.1:  # the same id once more, with another event time
            rows.append((f"e{i}", "c", at(rng.randint(0, 9000)), at(rng.randint(0, 12_000)).isoformat(), "x"))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_a_stored_run_is_a_full_recompute_of_what_had_arrived(spark, seed):
    view = late.LambdaView()
    log = late.read_log(spark.createDataFrame(_messy_log(seed), RAW), undated=True)
    kept = late.Kept(view, log, [6_000_000_000, 3_000_000_000, 1_000_000_000, 0])
    assert len(kept.instants) == 4
    rejected = set()
    for number, as_of in enumerate(kept.instants):
        seen = log.filter((F.col("arrival_us") <= as_of) | F.col("arrival_us").isNull())
        # ids whose deliveries with arrival come later are known as undated by then: the log decides over the whole what an id is
        seen = seen.join(log.groupBy("event_id").agg(F.min("arrival_us").alias("first_us")), "event_id", "left").filter(F.col("first_us").isNull() | F.col("arrival_us").isNotNull()).drop("first_us")
        firsts = view.firsts(view.stamped(seen, view.closings(seen)))
        want = view.refresh(None, firsts, as_of)
        rows = lambda df: sorted(map(tuple, df.select("period_end", "group", "n", "frozen").collect()), key=str)
        assert rows(kept.state(number)) == rows(want)
        rejected = {r[0] for r in firsts.filter("rejected").collect()}
    got = [r[0] for r in kept.rejected().collect()]
    assert sorted(got) == sorted(rejected) and rejected


def test_a_log_shorter_than_the_lag_is_all_provisional(spark):
    rows = [(f"e{i}", "c", at(i * 60), at(i * 60).isoformat(), None) for i in range(30)] + [("u", "c", at(0), None, None)]
    df = spark.createDataFrame(rows, RAW)
    got = late.corrected_periods(df).collect()
    assert len(got) == 30 and all(r.n == r.provisional == 1 and not r.frozen for r in got)
    got = sorted((r.period_end, r.n, r.provisional) for r in late.corrected_periods(df, undated=True).collect())
    assert [x[1:] for x in got] == [(2, 1)] + [(1, 1)] * 29


def test_the_schedule_changes_no_result(spark):
    df = spark.createDataFrame(_messy_log(7), RAW)
    want = sorted(_late_by_hand([(e, c, t, None if s is None else dt.datetime.fromisoformat(s), x) for e, c, t, s, x in _messy_log(7)]))
    for schedule in ((0,), (3_600_000_000, 0), (5_000_000_000, 4_000_000_000, 10, 0)):
        assert sorted(r[0] for r in late.late_firsts(df, before_end_us=schedule).collect()) == want


def test_a_run_reads_new_records_and_open_periods_only(spark):
    rows = [(f"a{i}", "c", at(i * 60), at(i * 60).isoformat(), None) for i in range(400)]
    kept = late.Kept(late.LambdaView(), late.read_log(spark.createDataFrame(rows, RAW)), [6_000_000_000, 0])
    assert kept.firsts.filter("met = 0").count() == 300
    first = kept.spark.read.parquet(f"{kept._periods}/run=0")
    second = kept.spark.read.parquet(f"{kept._periods}/run=1")
    frozen = first.filter("frozen").count()
    assert frozen == 288 and second.count() == 400 - frozen and kept.state().count() == 400


def test_late_on_an_empty_log(spark):
    df = spark.createDataFrame([], RAW)
    assert late.late_firsts(df).count() == 0 and late.corrected_periods(df).count() == 0


def test_late_recorded(spark):
    schema = "event_id string, event_time timestamp_ntz, window_end timestamp_ntz, watermark_at timestamp_ntz"
    rows = [("a", at(0), at(0), at(660)), ("a", at(0), at(0), at(900)), ("b", at(0), at(0), at(659)), ("b", at(0), at(0), at(900)), (None, at(0), at(0), at(900)), ("c", None, at(0), at(900)), ("d", at(0), at(0), None)]
    assert [r[0] for r in late.late_recorded(spark.createDataFrame(rows, schema)).collect()] == ["a"]


def _tables(spark):
    imp = "event_id string, campaign_id string, ad_request_id string, event_time timestamp_ntz"
    out = "aggregate_id string, occurred_at timestamp_ntz"
    i = spark.createDataFrame(
        [("1", "A", "req-1", at(0)), ("1", "a", "req-1", at(0)), ("2", "gone", "req-2", at(0)), ("3", "never", "req-3", at(0)), ("4", None, "-", at(0)), ("5", "none", "req-2", at(50)), (None, "never", "req-3", at(0)), ("6", "a", "req-2", None)],
        imp,
    )
    o = spark.createDataFrame([("REQ-1 ", at(-1)), ("req-2", at(10)), ("req-2", at(20)), (None, at(0))], out)
    return i, spark.createDataFrame([("a",), ("gone",)], "campaign_id string"), spark.createDataFrame([("A ",), ("ghost",), (None,)], "campaign_id string"), o


def test_orphans(spark):
    i, c, r, o = _tables(spark)
    got = {tuple(x) for x in references.orphan_records(references.impression_references(i, c, r, o)).collect()}
    assert got == {
        ("src_impression", "2", "ad_request_id", "later"), ("src_impression", "3", "ad_request_id", "missing"), ("src_impression", "2", "campaign_id", "deleted"),
        ("src_impression", "3", "campaign_id", "missing"), ("campaign_rates", "ghost", "campaign_id", "missing"),
    }


def test_ledger_follows_changes(spark):
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    state = references.ledger(references.reference_deltas(keys("a", "b", "b", None), F.col("k")), references.existence_deltas(keys("a"), F.col("k")))
    assert {r.key for r in references.orphans(state).collect()} == {"b"}
    state = references.ledger(state, references.existence_deltas(keys("b"), F.col("k")), references.existence_deltas(keys("a"), F.col("k"), sign=-1))
    assert {r.key for r in references.orphans(state).collect()} == {"a"}
    state = references.ledger(state, references.reference_deltas(keys("a"), F.col("k"), sign=-1))
    assert references.orphans(state).count() == 0
    assert {r.key for r in state.collect()} == {"b"}


def test_a_maintained_ledger_reports_as_one_of_whole_tables(spark):
    i, c, r, o = _tables(spark)
    want = sorted(map(str, references.impression_references(i, c, r, o).collect()))
    state = references.ledger(*references.changes(i.filter("event_id < '3'"), c, r.filter("campaign_id is null"), o.limit(0)))
    state = references.ledger(state, *references.changes(i.filter("event_id >= '3' or event_id is null"), rates=r.filter("campaign_id is not null"), outbox=o), *references.changes(campaigns=c.limit(0), rates=c))
    state = references.ledger(state, *references.changes(rates=c, sign=-1), *references.changes(i), *references.changes(i, sign=-1))
    assert sorted(map(str, references.offending(state, i, c, r).collect())) == want


def test_both_sides_of_the_join_to_records_are_shuffles(spark):
    """So Spark can split a hot key; without statistics for a broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = references.orphan_report(references.impression_references(*_tables(spark)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [x.strip(" :+-") for x in plan.splitlines()]
    join = next(i for i, x in enumerate(lines) if "SortMergeJoin" in x)
    sides = [i for i, x in enumerate(lines) if i > join and x.startswith("Sort ")]
    assert len(sides) == 2 and all(lines[i + 1].startswith("Exchange hashpartitioning(key") for i in sides)


def test_references_on_empty_tables(spark):
    i, c, r, o = (t.limit(0) for t in _tables(spark))
    assert references.impression_references(i, c, r, o).count() == 0


def _keys():
    return {"m": floor_to(wall_us("t"), MINUTE), "c": plain_key("c")}


SIDE = "t timestamp_ntz, c string, n bigint, x double, computed int"


def _diff(spark, a, b, **how):
    return sorted(map(tuple, compare.differences(spark.createDataFrame(a, SIDE), spark.createDataFrame(b, SIDE), _keys(), ["t", "c", "n", "x"], **how).select("c", "difference").collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"bucket_rows": 3, "hot_rows": 2}])
def test_differences(spark, how):
    a = [(at(0), "A", 1, 1.0, 1), (at(0), "A", 1, 1.0, 2), (at(0), "b", None, float("nan"), 1), (at(0), "gone", 1, None, 1), (at(60), None, 5, None, 1), (None, "z", 1, None, 1)]
    b = [(at(3), "a ", 1, 2.0, 9), (at(0), "b", 0, float("nan"), 9), (at(0), "new", 1, None, 9), (at(60), None, 5, None, 9), (None, "z", 2, None, 9)]
    assert _diff(spark, a, b, **how) == sorted([("a", "t"), ("a", "c"), ("a", "x"), ("b", "n"), ("gone", "missing_in_copy"), ("new", "missing_in_original"), ("z", "n")], key=str)


def test_differences_of_a_hot_key_and_empty_sides(spark):
    rows = [(at(0), "hot", i, None, 0) for i in range(50)]
    got = _diff(spark, rows, rows[:-1] + [(at(60), "x", 1, None, 0)], bucket_rows=7, hot_rows=5)
    assert got == [("hot", "missing_in_copy"), ("x", "missing_in_original")]
    assert _diff(spark, rows, rows) == []
    assert _diff(spark, [], []) == [] and len(_diff(spark, rows, [])) == 50


def test_changed_fields_of_a_hot_key_do_not_depend_on_the_split(spark):
    a = [(at(0), None if i % 2 else "k", i, 1.0, 0) for i in range(80)]
    b = [(t, c, n, 2.0 if n % 5 == 0 else x, 0) for t, c, n, x, _ in a]
    for how in ({}, {"bucket_rows": 3, "hot_rows": 2}, {"bucket_rows": 7, "hot_rows": 5}):
        assert _diff(spark, a, b, **how) == sorted([(None, "x")] * 8 + [("k", "x")] * 8, key=str)
    b = [r for r in b if r[2] not in (1, 2, 33)] + [(at(0), "k", 500, 1.0, 0), (at(0), "k", None, 1.0, 0)]
    assert _diff(spark, a, b, bucket_rows=3, hot_rows=2) == _diff(spark, a, b)


MSG = "event_id string, server_ts string, at string, marks int, payload string"


def _messages(spark, path, rows, files=3):
    spark.createDataFrame(rows, MSG).repartition(files).write.parquet(str(path))
    return spark.read.parquet(str(path))


@pytest.mark.parametrize("group", [8192, 3])
def test_kept_once(spark, tmp_path, group):
    rng = random.Random(5)
    rows = [(f"e{rng.randint(0, 30_000)}", (T0 + dt.timedelta(seconds=i)).isoformat(), "x", i, "p" * 9) for i in range(70_000)]
    rows += [("hot", None if i else "bad", "x", i, None) for i in range(30_000)] + [("hot", at(0).isoformat(), "win", -1, "w")] + [(None, None, "null", 7, None)] * 5
    df = _messages(spark, tmp_path / "m", rows)
    first = {}
    for r in rows:
        if r[0] is not None and (r[0] not in first or (r[1] not in (None, "bad")) and (first[r[0]][1] in (None, "bad") or r[1] < first[r[0]][1])):
            first[r[0]] = r
    got = redelivery.kept_once(df, "event_id", [arrival_us("server_ts")], vectors_per_group=group)
    assert got.columns == df.columns
    kept = [tuple(r) for r in got.collect()]
    assert sorted(r for r in kept if r[0]) == sorted(first.values())
    assert sum(r[0] is None for r in kept) == 5
    again = redelivery.kept_once(df, "event_id", [arrival_us("server_ts")], ["event_id"], repeated_only=True, vectors_per_group=group)
    counts = {}
    for r in rows:
        counts[r[0]] = counts.get(r[0], 0) + 1
    assert sorted(r[0] for r in again.collect()) == sorted(k for k, n in counts.items() if k and n > 1)


@pytest.mark.parametrize("group", [8192, 4, 1])
def test_reads_of_vectors_do_not_grow_with_their_groups(spark, tmp_path, group):
    """One scan in the plan of the result; a group's job reads the files and the vectors of the group only."""
    rows = [(f"e{i % 900}", (T0 + dt.timedelta(seconds=i)).isoformat(), "x", i, "p") for i in range(2000)]
    df = _messages(spark, tmp_path / "m", rows, 12)
    once = redelivery.Once(df, "event_id", [arrival_us("server_ts")], vectors_per_group=group)
    assert once.groups == {8192: 1, 4: 3, 1: 12}[group]
    got = once.read()
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation") == (2 if group == 8192 else 1)
    assert sorted(r.marks for r in got.collect()) == list(range(900))
    if once.groups > 1:
        own = [{r[0] for r in df.filter(F.pmod(redelivery._file(), F.lit(once.groups)) == g).select("_metadata.file_path").collect()} for g in range(once.groups)]
        assert sum(map(len, own)) == len(set().union(*own)) == 12
        assert once.marks.groupBy("file").agg(F.count_distinct("part").alias("n")).filter("n != 1").count() == 0


def test_kept_once_of_an_empty_table(spark, tmp_path):
    df = _messages(spark, tmp_path / "m", [], 1)
    assert redelivery.kept_once(df, "event_id", [F.col("server_ts")]).count() == 0
