"""Rows whose keys are written carelessly are found, and placeholder requests are not looked up."""

import datetime as dt

import pytest

from tidemark.plans import ledger

T = dt.datetime(2024, 2, 5, 3, 30)


@pytest.fixture
def folder(spark, tmp_path):
    imp = [("a", "cmp-2193", "REQ-1"), ("b", "CMP-2193\t", "-"), ("c", " Cmp-2193", "req-000"), ("d", "cmp-4993", "r"), ("e", " CMP-4993\n", "r"), ("f", "cmp-8500", "r"), ("g", "cmp-1", "r"), (None, "cmp-2193", "r")]
    rows = spark.createDataFrame([(*x, "t", T) for x in imp], "event_id string, campaign_id string, ad_request_id string, server_ts string, event_time timestamp_ntz")
    rows.write.parquet(f"{tmp_path}/src_impression.parquet")
    out = [(7, "o1", "x", " req-1", T), (8, "o2", "x", "-", T), (9, "o3", "x", "req-000", T)]
    spark.createDataFrame(out, "id long, event_id string, event_type string, aggregate_id string, occurred_at timestamp_ntz").write.parquet(f"{tmp_path}/event_outbox.parquet")
    spark.createDataFrame([("b", T)], "event_id string, watermark_at timestamp_ntz").write.parquet(f"{tmp_path}/late_dropped.parquet")
    return str(tmp_path)


def test_trace(spark, folder):
    got = {(r.event_id, r.request, r.outbox_id, r.watermark_at) for r in ledger.trace_impressions_all(spark, folder).collect()}
    assert got == {("a", "req-1", 7, None), ("b", None, None, T), ("c", None, None, None)}


def test_lookup(spark, folder):
    assert {r.event_id for r in ledger.archive_lookup_all(spark, folder).collect()} == {"d", "e", "f"}
