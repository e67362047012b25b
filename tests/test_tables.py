"""Tables of a database, over the embedded one that Spark carries."""

import pytest

from tidemark.sources import tables

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def test_definition_append_overwrite_and_read_in_parts(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    try:
        tables.execute(spark, url, "create table settled (id bigint primary key, name varchar(20))", "create index by_name on settled (name)")
    except Exception as e:  # noqa: BLE001
        if "No suitable driver" in str(e):
            pytest.skip("no embedded database on the class path")
        raise
    rows = spark.range(10).selectExpr("id as ID", "concat('n', id) as NAME")
    tables.write_jdbc(rows.filter("id < 6"), url, "settled", **DRIVER)
    tables.write_jdbc(rows.filter("id >= 6"), url, "settled", **DRIVER)
    read = tables.jdbc_table(spark, url, "settled", "ID", (0, 10), 3, **DRIVER)
    assert read.rdd.getNumPartitions() == 3 and sorted(r.ID for r in read.collect()) == list(range(10))
    tables.write_jdbc(rows.limit(2), url, "settled", mode="overwrite", **DRIVER)
    assert tables.jdbc_table(spark, url, "settled", **DRIVER).count() == 2
    with pytest.raises(Exception, match="(?i)duplicate|constraint"):  # the definition is still there
        tables.write_jdbc(rows.limit(1), url, "settled", **DRIVER)
