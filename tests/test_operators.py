"""Hand-computed results of the operators, and their rules for nulls, types and empty input."""

import pytest
from pyspark.sql import functions as F

from quern.operators import relational as r
from quern.operators import reshape, windows
from quern.sources.tables import ascii_table


def rows(df):
    return [tuple(x) for x in df.collect()]


@pytest.fixture(scope="module")
def staff(spark):
    return spark.createDataFrame([("HR", 5000), ("IT", 8000), ("HR", 6000)], "dept string, salary int")


def test_sort_and_limit(spark):
    df = spark.createDataFrame([(30,), (10,), (20,)], "val int")
    assert rows(r.sort(df, "val")) == [(10,), (20,), (30,)]
    assert rows(r.top(df, "val", 2)) == [(30,), (20,)]


def test_group_sum(staff):
    assert sorted(rows(r.aggregate(staff, "salary", "sum", ["dept"]))) == [("HR", 11000), ("IT", 8000)]


def test_missing_values_in_aggregates(spark):
    df = spark.createDataFrame([("a", 5), ("a", None), ("b", None)], "g string, x int")
    assert sorted(rows(r.aggregate(df, "x", "avg", ["g"], missing="zero"))) == [("a", 2), ("b", 0)]
    assert sorted(rows(r.aggregate(df, "x", "avg", ["g"])), key=str) == [("a", 5), ("b", None)]
    assert sorted(rows(r.aggregate(df, "x", "count", ["g"]))) == [("a", 1), ("b", 0)]
    assert sorted(rows(r.aggregate(df, "x", "count", ["g"], missing="zero"))) == [("a", 2), ("b", 1)]
    nothing = df.where("false")
    assert rows(r.aggregate(nothing, "x", "sum")) == [(None,)]
    assert rows(r.aggregate(nothing, "x", "sum", missing="zero")) == []


def test_aggregate_many(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 1, None), ("b", 2, 5)], "g string, h int, x int")
    found = r.aggregate_many(df, "x", ["g", "h"], "key").select("key", "count", "sum", "min", "max")
    assert sorted(rows(found)) == [("a#1#", 1, 3, 3, 3), ("b#2#", 1, 5, 5, 5)]


def test_join(spark):
    people = spark.createDataFrame([(1, "Alice"), (2, "Bob")], "id int, name string")
    logs = spark.createDataFrame([(1, "login", "x"), (2, "logout", "y"), (None, "lost", "z")], "user_id int, event string, name string")
    assert sorted(rows(r.equi_join(people, logs, "id", "user_id").select("name", "event"))) == [("Alice", "login"), ("Bob", "logout")]
    for strategy in ("broadcast", "shuffle_hash", "merge"):
        assert r.equi_join(people, logs, "id", "user_id", strategy).count() == 2


def test_join_keys_are_strict(spark):
    a = spark.createDataFrame([(1,), (None,)], "k int")
    b = spark.createDataFrame([("1",)], "k2 string")
    c = spark.createDataFrame([(1,), (None,)], "k2 int")
    assert r.equi_join(a, b, "k", "k2").count() == 0
    assert r.equi_join(a, c, "k", "k2").count() == 1
    assert r.equi_join(a, c, "k", "k2", null_safe=True).count() == 2


def test_join_without_cap(spark):
    left = spark.range(200).select(F.lit("match_key").alias("join_key"), "id")
    assert r.equi_join(left, spark.createDataFrame([("match_key", 1)], "k string, v int"), "join_key", "k").count() == 200


def test_project(spark):
    df = spark.createDataFrame([("Alice", 30, 5000)], "name string, age int, salary int")
    assert rows(r.project(df, ["name", "salary:pay", "gone"])) == [("Alice", 5000)]
    assert rows(r.project_padded(df, ["name", "gone"])) == [("Alice", None)]


def test_predicates(spark):
    df = spark.createDataFrame([(1, "a", True), (2, None, False), (None, "c", None)], "i int, s string, b boolean")
    count = lambda *p: r.where(df, *p).count()
    assert [count("i", ">", 1), count("i", "!=", 1), count("i", "=", "1"), count("i", "!=", "x")] == [1, 1, 0, 2]
    assert [count("s", "=", "a"), count("s", ">", "a"), count("b", "=", True), count("gone", "=", 1), count("gone", "!=", 1)] == [1, 1, 1, 0, 0]
    assert df.where(r.tree(df, ("not", ("i", "=", 1)))).count() == 2  # a comparison with null is false
    assert df.where(r.tree(df, ("or", ("i", "=", 1), ("and", ("s", "=", "c"), ("not", ("b", "=", True)))))).count() == 2


def test_having_and_distinct(spark):
    assert rows(r.having(spark.createDataFrame([(15,), (5,)], "result int"), "result", ">", 10)) == [(15,)]
    names = spark.createDataFrame([("Alice", 1), ("Bob", 2), ("Alice", 3)], "name string, n int")
    assert sorted(rows(r.distinct_on(names, ["name"], ["n"]))) == [("Alice", 1), ("Bob", 2)]


def test_windows(spark):
    df = spark.createDataFrame([("HR", 10), ("IT", 20), ("HR", 15)], "dept string, val int")
    assert sorted(rows(windows.ranking(df, "row_number", ["dept"], ["val"]))) == [("HR", 10, 1), ("HR", 15, 2), ("IT", 20, 1)]
    two = spark.createDataFrame([("HR", 10, 1), ("HR", 20, 2)], "dept string, val int, id int")
    assert [x[3] for x in sorted(rows(windows.rolling(two, "cumulative_sum", "val", ["dept"], ["id"])))] == [10, 30]
    assert [x[3] for x in sorted(rows(windows.offset(two, "lag", "val", ["dept"], ["id"], 1, 0)))] == [0, 10]
    assert [x[3] for x in sorted(rows(windows.rolling(two, "variance", "val", ["dept"], ["id"])))] == [0, 50]
    assert [x[3] for x in sorted(rows(windows.rolling(two, "percentile", "val", ["dept"], ["id"])))] == [50, 100]
    gaps = spark.createDataFrame([(1, None), (2, 7)], "id int, val int")
    assert [x[2] for x in sorted(rows(windows.offset(gaps, "lag", "val", [], ["id"], 1, -1)), key=lambda x: x[0])] == [-1, -1]


def test_pivot_and_unpivot(spark):
    df = spark.createDataFrame([(2025, "HR", 5000), (2025, "IT", 12000), (2025, "HR", 3000), (2026, "XX", 1)], "year int, dept string, revenue int")
    wide = reshape.pivot(df, ["year"], "dept", "revenue", ["HR", "IT"])
    assert sorted(rows(wide)) == [(2025, 8000, 12000), (2026, 0, 0)]
    long = reshape.unpivot(wide.where("year = 2025"), ["year"], ["HR", "IT", "gone"], "dept", "revenue")
    assert sorted(rows(long)) == [(2025, "HR", 8000), (2025, "IT", 12000)]


def test_recursion_stops_at_the_bound(spark):
    forever = reshape.recurse(spark.sql("SELECT 1 AS n"), lambda w: w.selectExpr("n + 1 AS n"), rounds=5)
    assert sorted(rows(forever)) == [(n,) for n in range(1, 7)]


def test_recursion_with_join(spark):
    names = spark.createDataFrame([(1, "CEO"), (2, "VP"), (3, "Manager")], "emp_id int, name string")
    chain = reshape.recurse(spark.sql("SELECT 1 AS id"), lambda w: w.where("id < 3").selectExpr("id + 1 AS id"))
    assert sorted(rows(r.equi_join(chain, names, "id", "emp_id").select("id", "name"))) == [(1, "CEO"), (2, "VP"), (3, "Manager")]


def test_ascii_table(spark):
    assert "| null |" in ascii_table(spark.createDataFrame([(1, None)], "a int, b string"))


def test_plans(spark, tiny):
    """Filters and columns reach the scan; top n is one bounded pass; group limits come before the shuffle."""
    orders = spark.read.parquet(f"{tiny}/orders.parquet")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    scan = plan(r.point(orders, "o_orderkey", 42).select("o_custkey"))
    assert "EqualTo(o_orderkey,42)" in scan and "o_totalprice" not in scan
    assert "TakeOrderedAndProject" in plan(r.top(orders, "o_totalprice", 3))
    assert "WindowGroupLimit" in plan(r.group_top(orders, ["o_custkey"], "o_totalprice", 2, ["o_orderkey"]))
    assert "EqualTo" in plan(r.where(orders, "o_orderkey", "=", 42)) or "o_orderkey" in plan(r.where(orders, "o_orderkey", "=", 42))
