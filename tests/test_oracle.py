"""Every query against its DuckDB statement."""

import sys

import duckdb
import pytest
from conftest import ROOT

sys.path.insert(0, f"{ROOT}/tools")
from verify import TABLES, digest  # noqa: E402

from quern.queries import oracle_sql, queries  # noqa: E402


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(name, spark, tiny, duck):
    df = queries()[name](spark, tiny)
    found = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert digest(df.columns, df.collect()) == digest(columns, found.fetchall())


def test_every_query_has_a_statement():
    assert set(queries()) == set(oracle_sql())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["c_mktsegment", "revenue", "n_orders"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_unpivot_reads_all_of_lineitem(spark, tiny):
    found = queries()["unpivot_lineitem"](spark, tiny).where("name = 'quantity'")
    assert found.count() == spark.read.parquet(f"{tiny}/lineitem.parquet").where("l_quantity IS NOT NULL").count()


def plan(spark, tiny, name):
    return queries()[name](spark, tiny)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize(
    "name, pushed",
    [
        ("filter_gt", "GreaterThan(o_totalprice,200000.0)"),
        ("filter_eq_str", "EqualTo(event_type,click)"),
        ("filter_and_or", "LessThan(o_totalprice,50000.0)"),
        ("filter_not", "LessThan(p_size,10)"),
        ("filter_not_or", "LessThanOrEqual(p_size,12)"),
        ("flagship", "GreaterThan(o_totalprice,100000.0)"),
        ("workload_find", "EqualTo(user_id,7)"),
        ("workload_aggregate", "GreaterThanOrEqual(user_id,3)"),
        ("transform_text", "GreaterThan(o_custkey,30)"),
        ("expr_contains", "StringContains(event_type,ic)"),
        ("expr_between", "GreaterThanOrEqual(p_size,5)"),
        ("part_range_prune", "GreaterThan(o_custkey,60)"),
        ("part_hash_prune", "EqualTo(user_id,11)"),
    ],
)
def test_filters_reach_the_scan(spark, tiny, name, pushed):
    filters = [line for line in plan(spark, tiny, name).splitlines() if line.startswith("PushedFilters")]
    assert any(pushed in line for line in filters), filters


@pytest.mark.parametrize("name", ["part_range_prune", "part_list_prune", "part_hash_prune", "part_tree_prune"])
def test_partitions_are_pruned(spark, tiny, name):
    made = queries()[name](spark, tiny)
    filters = [line for line in plan(spark, tiny, name).splitlines() if line.startswith("PartitionFilters")]
    assert filters and any("p#" in line for line in filters)
    whole = len(made.sparkSession.read.parquet(made.inputFiles()[0].rsplit("/p=", 1)[0]).inputFiles())
    made.collect()
    scan = made._jdf.queryExecution().executedPlan().toString()
    assert whole > 1 and "PartitionFilters: [isnotnull(p" in scan or "PartitionFilters: [p" in scan or "PartitionFilters: [((p" in scan
