import datetime as dt
import random
from collections import defaultdict

import pytest

from tidemark.llm import survivor
from tidemark.llm.components import components

COLUMNS = ("event_id string, ad_request_id string, ssai_twin_of string, source string, server_ts string, creative_id string, session_id string, user_id string, device string,"
           " content_id string, ad_pod_id string, ad_slot int, ad_duration_s int, playhead_s double, vertex string, root string, layers int")  # fmt: skip
T0 = dt.datetime(2024, 2, 5)


def _row(rng, i, n):
    f = [rng.choice([None, "", f"v{i}"]) for _ in range(6)] + [rng.choice([None, i]) for _ in range(2)] + [rng.choice([None, float(i)])]
    ts = rng.choice([None, "bad", (T0 + dt.timedelta(seconds=rng.randint(0, 50))).isoformat()])
    request = rng.choice([None, "-", "req-000", "", *[f"REQ-{k}x " for k in range(1, n // 3)]])
    return (f"e{i:04d}", request, rng.choice([None, None, None, f"E{rng.randint(0, n):04d}\t"]), rng.choice([None, "Server", "client ", "lab", ""]), ts, *f, "x", "y", 3)


def _by_hand(rows):
    arr = lambda r: None if r[4] in (None, "bad") else r[4]
    recs = {}
    for r in rows:
        if r[0] is not None and (r[0] not in recs or (arr(r) and (arr(recs[r[0]]) is None or arr(r) < arr(recs[r[0]])))):
            recs[r[0]] = r
    up = {k: k for k in recs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    first = {}
    for k, r in recs.items():
        q = (r[1] or "").strip().lower()
        if q and q not in ("-", "req-000"):
            up[root(k)] = root(first.setdefault(q, k))
        t = (r[2] or "").strip().lower()
        if t in recs:
            up[root(k)] = root(t)
    groups = defaultdict(list)
    for k in recs:
        groups[root(k)].append(k)
    out = {}
    for members in groups.values():
        if len(members) < 2:
            continue

        def rank(k):
            r = recs[k]
            trust = {"server": 0, "client": 1}.get((r[3] or "").strip().lower(), 2)
            return trust, sum(x in (None, "") for x in r[5:14]), (arr(r) is None, "" if arr(r) is None else tuple(-ord(c) for c in arr(r))), k

        out[min(members)] = (min(members, key=rank), len(members), [any(recs[k][i] not in (None, "") for k in members) for i in range(5, 14)])
    return out, recs


def _table(spark, path, rows):
    spark.createDataFrame(rows, COLUMNS).repartition(2).write.parquet(str(path))
    return spark.read.parquet(str(path))


@pytest.mark.parametrize("seed", range(2))
def test_against_plain_python(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [_row(rng, i, 120) for i in range(120)]
    rows += [(r[0], r[1], r[2], r[3], (T0 + dt.timedelta(days=9)).isoformat(), *r[5:]) for r in rows[:30]] + [(None, "req-1x", None, "server", None, *[None] * 9, "x", "y", 3)]
    want, recs = _by_hand(rows)
    df = _table(spark, tmp_path / "t", rows)
    assert {r.group_id: r.survivor_id for r in survivor.found(df).collect()} == {k: v[0] for k, v in want.items()}
    merged = survivor.merged(df).collect()
    assert {r.group_id: (r.survivor_id, r.n_records, [r[f] not in (None, "") for f in survivor.FIELDS]) for r in merged} == want
    for r in merged:
        own = recs[r.survivor_id][5:14]
        assert all(a == r[f] for a, f in zip(own, survivor.FIELDS, strict=True) if a not in (None, ""))


def test_layers(spark):
    reps = [(0, 3, 5, "a", 1), (0, 4, 1, "b", 2), (1, 3, 6, "c", 4), (1, 2, 9, "d", 8), (1, 3, 7, "e", 16)]
    df = spark.createDataFrame([("g", 5, sorted(reps))], "group_id string, n_records long, reps array<struct<trust:int,missing:int,age_us:bigint,event_id:string,filled:int>>")
    assert {x.event_id: x.layer for x in survivor.layered(df).first().layers} == {"a": 1, "b": 1, "d": 1, "c": 2, "e": 3}


def _filled_by_hand(members):
    """Fields of the group's survivor, by peeling skylines off all its records."""
    key = lambda r: ({"server": 0, "client": 1}.get(r[3], 2), sum(x in (None, "") for x in r[5:14]), -dt.datetime.fromisoformat(r[4]).timestamp())
    rest, order = list(members), []
    while rest:
        beats = lambda x, y: key(x) != key(y) and all(a <= b for a, b in zip(key(x), key(y), strict=True))
        layer = [r for r in rest if not any(beats(x, r) for x in rest)]
        order += sorted(layer, key=lambda r: (*key(r), r[0]))
        rest = [r for r in rest if r not in layer]
    return order[0][0], [next((r[i] for r in order if r[i] not in (None, "")), None) for i in range(5, 14)]


@pytest.mark.parametrize("list_rows", [200_000, 4])
def test_values_come_from_layers_of_all_records(spark, tmp_path, list_rows):
    rng, by_group = random.Random(11), defaultdict(list)
    for i in range(240):
        g, mask = i % 6, rng.choice([0b000000111, 0b000011001, 0b000100000, 0b001000011, 0b110000000])
        f = [(f"v{i}" if k < 6 else i if k < 8 else float(i)) if mask >> k & 1 else None for k in range(9)]
        r = (f"e{rng.randint(0, 99):02d}-{i}", f"req-{g + 1}", None, rng.choice(["server", "client", "lab"]), (T0 + dt.timedelta(seconds=rng.randint(0, 25))).isoformat(), *f, "x", "y", 3)
        by_group[g].append(r)
    want = {min(r[0] for r in m): (*_filled_by_hand(m), len(m)) for m in by_group.values()}
    got = survivor.merged(_table(spark, tmp_path / "t", sum(by_group.values(), [])), list_rows).collect()
    assert {r.group_id: (r.survivor_id, [r[f] for f in survivor.FIELDS], r.n_records) for r in got} == want


def test_dropped_records_count_in_the_depth_of_others(spark, tmp_path):
    """y1 dominates the other three, y (of the mask of y1) dominates x: x is third, z second, so the value of z is taken."""
    row = lambda e, source, age, values: (e, "req-1", None, source, (T0 - dt.timedelta(seconds=age)).isoformat(), *values, "x", "y", 3)
    fill = lambda e, n, f: [e if f else None, *[e] * min(n, 5), *[None] * (5 - min(n, 5)), *([None] * 3)]
    rows = [row("y1", "server", 1, fill("y1", 5, False)), row("y", "server", 20, fill("y", 5, False)), row("z", "client", 10, fill("z", 3, True)), row("x", "server", 30, fill("x", 2, True))]
    assert [r.creative_id for r in survivor.merged(_table(spark, tmp_path / "t", rows)).collect()] == ["z"]


def test_empty(spark, tmp_path):
    df = _table(spark, tmp_path / "t", [])
    assert survivor.found(df).count() == 0 and survivor.merged(df).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(90)] + [("hub", f"s{i}") for i in range(50)] + [("x", "x"), ("y", "z"), ("z", "y")]
    rng.shuffle(edges)
    got = defaultdict(set)
    for r in components(spark.createDataFrame(edges, "a string, b string")).collect():
        got[r.root].add(r.node)
    assert sorted(map(len, got.values())) == [2, 51, 91]
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0
