"""Steps whose tasks must not grow with the tables."""

import duckdb
import pytest

from threadloom import registry
from threadloom.operators import joins

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["bipartite_weights", "label_communities"])
def test_larger_tables_are_spread_over_more_tasks(spark, monkeypatch, name):
    monkeypatch.setattr(joins, "ROWS_A_TASK", 500)
    con = duckdb.connect()
    for table in ("orders", "lineitem", "customer", "supplier"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = registry.queries()[name](spark, SF)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert name != "bipartite_weights" or got.rdd.getNumPartitions() == 12  # of 6,000 lines
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_orders_of_a_pair_are_counted_once(spark, tmp_path):
    spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 5), (1, 5), (2, 5), (3, 5), (4, 5)], "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.queries()["bipartite_weights"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(7, 5, 3, 2), (8, 5, 1, 1)]


def test_simhash_groups_digests_and_no_tokens(spark):
    got = registry.queries()["simhash_near_duplicates"](spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Exchange hashpartitioning(digest" in line or "Exchange hashpartitioning(low" in line]
    assert exchanged and all("digest" in line for line in exchanged) and "sum(CASE" not in plan


def test_module_z_holds_no_community_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(joins, "ROWS_A_TASK", 500)
    con = duckdb.connect()
    for table in ("orders", "lineitem", "customer", "supplier"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = registry.queries()["module_z"](spark, SF)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()['module_z']})").fetchall()
    assert sorted(map(tuple, got.collect())) == [pytest.approx(x) for x in sorted(want)]
