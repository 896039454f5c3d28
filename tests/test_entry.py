"""The driver's contract, and queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
CHOSEN = ["p1_found", "p3_found", "p5_found", "p6_found", "bgp_star", "triple_ordinal", "index_view_ops", "rule_sibling_is_not", "provenance_bag", "versions_intervals", "turtle_round_trip"]


def test_contract(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 70
    assert __spark_entry__.entry(spark).count() == 100


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    made = __spark_entry__.queries()[name](spark, FOLDER)
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(made.columns)
    got = sorted(tuple(str(v) for v in r) for r in made.select(*columns).collect())
    assert got == sorted(tuple(str(v) for v in r) for r in want.fetchall())
