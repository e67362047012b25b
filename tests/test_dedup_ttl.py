"""Keep-first with time to live, against a walk over each id's arrivals."""

import random

import pytest

from tidemark.operators import realtime

ROWS = "event_id string, arrival_us long, n long, kind string, campaign_id string, is_twin int, event_us long, ad_request_id string"


def _kept(spark, arrivals, ttl_us, **how):
    rows = [(e, us, i, "impression", "c", 0, 0, None) for i, (e, us) in enumerate(arrivals)]
    return sorted((r.event_id, r.arrival_us, r.n) for r in realtime.deliveries(spark.createDataFrame(rows, ROWS), ttl_us, **how).collect())


def _by_hand(arrivals, ttl_us):
    last, out = {}, []
    for us, i, e in sorted((us, i, e) for i, (e, us) in enumerate(arrivals)):
        if e not in last or us >= last[e] + ttl_us:
            last[e] = us
            out.append((e, us, i))
    return sorted(out)


def test_time_to_live_that_ends_within_a_second(spark):
    assert [us for _, us, _ in _kept(spark, [("a", 500_000), ("a", 1_800_300_000), ("a", 1_800_600_000)], 1_800_000_000)] == [500_000, 1_800_600_000]
    assert [us for _, us, _ in _kept(spark, [("a", 500_000), ("a", 1_800_499_999), ("a", 1_800_500_000)], 1_800_000_000)] == [500_000, 1_800_500_000]


@pytest.mark.parametrize("how", [{}, {"list_rows": 5}])
def test_many_arrivals_a_second(spark, how):
    rng = random.Random(3)
    arrivals = [("hot", rng.randint(0, 9_000_000)) for _ in range(400)] + [(f"e{rng.randint(0, 40)}", rng.randint(0, 9_000_000)) for _ in range(200)]
    arrivals += arrivals[::7]
    assert _kept(spark, arrivals, 1_300_000, **how) == _by_hand(arrivals, 1_300_000)
