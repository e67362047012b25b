"""Every registered query over the smallest tables: against DuckDB where it has SQL; the others run and keep the columns that are promised."""

import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")

COLUMNS = {
    "p7_ids": ["doc_id", "ids"],
    "p8_mix": ["mix_name", "source", "doc_id", "n_tokens", "copies"],
    "p8_marginals": ["mix_name", "axis", "value", "target_share", "reached_share", "residual"],
    "p9_found": ["doc_id_a", "doc_id_b"],
    "p9_classes": ["doc_id", "class_id", "n_rows", "n_forms"],
    "p9_forms": ["doc_id", "skeleton"],
}


def _plan():
    from tidemark.llm import queries

    return queries


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", list(_plan().SQL))
def test_same_rows_as_sql(spark, con, name):
    from oracle import rows

    got = _plan().QUERIES[name](spark, FOLDER).toPandas()
    want = con.sql(_plan().SQL[name]).to_arrow_table().to_pandas(date_as_object=True)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n in _plan().QUERIES if n not in _plan().SQL])
def test_runs_with_stable_columns(spark, name):
    df = _plan().QUERIES[name](spark, FOLDER)
    assert name not in COLUMNS or df.columns == COLUMNS[name]
    assert df.count() > 0 or name in ("p9_found", "p9_classes")  # a hundred documents hold no pair


def test_mix_keeps_caps_and_reports_what_it_holds(spark):
    from tidemark.sources.tables import table

    mix = _plan().p8_mix(spark, FOLDER).toPandas()
    shares = _plan().p8_shares(spark, FOLDER).toPandas()
    caps = {(r.mix_name, r.source): r.max_repeats for r in table(spark, FOLDER, "mix_targets").collect()}
    assert not mix.duplicated(["mix_name", "doc_id"]).any()
    assert all(r.copies <= caps[r.mix_name, r.source] for r in mix.itertuples())
    held = (mix.n_tokens * mix.copies).groupby([mix.mix_name, mix.source]).sum().to_dict()
    assert {(r.mix_name, r.source): r.reached_tokens for r in shares.itertuples() if r.reached_tokens} == held
    assert set(zip(shares.mix_name, shares.source, strict=True)) == set(caps)


def test_pairs_are_those_of_the_classes(spark):
    folder = FOLDER.replace("0.001", "0.01")
    pairs = {tuple(r) for r in _plan().p9_found(spark, folder).collect()}
    of = {r.doc_id: r.class_id for r in _plan().p9_classes(spark, folder).collect()}
    assert pairs and {x for p in pairs for x in p} == set(of) and all(of[a] == of[b] for a, b in pairs)
