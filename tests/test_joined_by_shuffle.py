import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="bench tables not present")
@pytest.mark.parametrize("name", ["header_contract"])
def test_query_equals_sql_when_its_joins_are_shuffled(spark, name):
    """As on large tables, where no side of a join is small enough to be broadcast."""
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = entry.queries()[name](spark, SF)
        want = sorted(repr([r[columns.index(c)] for c in df.columns]) for r in cursor.fetchall())
        assert sorted(repr(list(r)) for r in df.collect()) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
