"""Every catalogue query gives the rows of its SQL; plans are as they should be."""

import duckdb
import pytest

from codelode.operators import search
from codelode.plans import catalogue
from codelode.plans.adapters import Tables

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["call_edges", "dead_code", "partition_assignment", "partition_select", "duplicate_pairs", "topk_similar"])
def test_no_cross_joins(spark, sf, name):
    p = plan(catalogue.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_columns_are_pruned_and_filters_pushed(spark, sf):
    p = plan(Tables(spark, sf).returned().select("l_partkey"))
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in p and "ReadSchema: struct<l_partkey:bigint,l_returnflag:string>" in p
    assert "content" not in plan(search.exact_copies(Tables(spark, sf).files()).select("n")).split("ReadSchema")[1].replace("text", "")


def test_throughput_rates_of_whole_seconds_and_without_times(spark, tmp_path):
    """Rates that end in a half at the sixth place, marks of one time, and marks without a time or a type."""
    d = duckdb.connect()
    times = "[0, 320, 640, 640, 13120, 20800, 20800, 92480, NULL, NULL]"
    d.sql(f"CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(CASE WHEN i < 1000 THEN 320 * i ELSE {times}[i - 999] END) AS ts, 1::BIGINT AS user_id, CASE WHEN i < 500 THEN 'a' WHEN i < 1005 THEN 'b' END AS event_type, 1.0::DOUBLE AS value, '{{}}' AS props FROM range(1010) r(i)")
    d.sql(f"COPY events TO '{tmp_path}/events.parquet'")
    df = catalogue.QUERIES["throughput_rates"](spark, str(tmp_path))
    want = d.sql(catalogue.ORACLE_SQL["throughput_rates"])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_task_history_of_items_without_a_date(spark, tmp_path):
    d = duckdb.connect()
    d.sql("CREATE TABLE orders AS SELECT i AS o_orderkey, i % 2 AS o_custkey, 'F' AS o_orderstatus, 1.0::DOUBLE AS o_totalprice, TIMESTAMP '2024-01-01' AS o_orderdate, 'p' AS o_orderpriority FROM range(4) r(i)")
    d.sql("CREATE TABLE lineitem AS SELECT * FROM (VALUES (0::BIGINT, 1::BIGINT, 'O', NULL::TIMESTAMP), (0, 1, 'O', TIMESTAMP '2024-02-01'), (0, 1, 'O', TIMESTAMP '2024-02-01'), (1, 2, 'O', NULL), (9, 3, 'O', NULL), (NULL, 3, 'O', NULL)) v(l_orderkey, l_partkey, l_linestatus, l_shipdate)")
    for t in ("orders", "lineitem"):
        d.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    df = catalogue.QUERIES["task_history"](spark, str(tmp_path))
    want = d.sql(catalogue.ORACLE_SQL["task_history"])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
