"""Registry of the engine's own queries, each with a DuckDB statement over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import json as js
from .functions import predicates, scalars
from .functions.expressions import condition, with_expression
from .operators import relational as r
from .operators import reshape, windows
from .plans import catalog, cluster, dsl, evolution, history, partitions, statistics, telemetry
from .sources import manifests
from .sources.tables import delete, demo_events, demo_users, table, update
from .streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE


# Flagship


@query(
    """SELECT c_mktsegment, round(sum(o_totalprice), 2) AS revenue, count(*) AS n_orders
    FROM customer JOIN orders ON c_custkey = o_custkey
    WHERE o_totalprice > 100000 GROUP BY c_mktsegment HAVING count(*) > 10
    ORDER BY revenue DESC, c_mktsegment LIMIT 3"""
)
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Revenue and orders by market segment for orders over 100,000; top 3."""
    orders = r.where(table(spark, d, "orders"), "o_totalprice", ">", 100000).select("o_custkey", "o_totalprice")
    joined = r.equi_join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), orders, "c_custkey", "o_custkey")
    made = joined.groupBy("c_mktsegment").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.count("*").alias("n_orders"))
    return r.top(r.having(made, "n_orders", ">", 10), "revenue", 3, tie=["c_mktsegment"])


# Scans and lookups


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def scan_orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT * FROM orders WHERE o_orderkey = 42")
def index_lookup(spark, d):
    return r.point(table(spark, d, "orders"), "o_orderkey", 42)


@query("SELECT c_custkey, c_name FROM customer WHERE c_name BETWEEN 'Customer#000000010' AND 'Customer#000000040'")
def key_range(spark, d):
    return r.key_range(table(spark, d, "customer").select("c_custkey", "c_name"), "c_name", "Customer#000000010", "Customer#000000040")


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 21")
def query_text(spark, d):
    return predicates.query(table(spark, d, "part"), "p_size > 21").select("p_partkey", "p_size")


# Filters and projections


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 200000")
def filter_gt(spark, d):
    return r.where(table(spark, d, "orders"), "o_totalprice", ">", 200000).select("o_orderkey")


@query("SELECT event_id FROM events WHERE event_type = 'click'")
def filter_eq_str(spark, d):
    return r.where(table(spark, d, "events"), "event_type", "=", "click").select("event_id")


@query("SELECT event_id FROM events WHERE event_type <> 'click'")
def filter_neq(spark, d):
    return r.where(table(spark, d, "events"), "event_type", "!=", "click").select("event_id")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice < 50000) OR o_custkey = 7")
def filter_and_or(spark, d):
    df = table(spark, d, "orders")
    return df.where(r.tree(df, ("or", ("and", ("o_orderstatus", "=", "F"), ("o_totalprice", "<", 50000)), ("o_custkey", "=", 7)))).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE NOT (p_size >= 10 AND p_size <= 40)")
def filter_not(spark, d):
    df = table(spark, d, "part")
    return df.where(r.tree(df, ("not", ("and", ("p_size", ">=", 10), ("p_size", "<=", 40))))).select("p_partkey")


@query("SELECT n_nationkey FROM nation WHERE false")
def filter_wrong_kind(spark, d):
    """A number column compared with text matches nothing."""
    return r.where(table(spark, d, "nation"), "n_nationkey", "=", "five").select("n_nationkey")


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders")
def project_alias(spark, d):
    return r.project(table(spark, d, "orders"), ["o_orderkey:id", "o_totalprice:price", "absent"])


@query("SELECT n_name, CAST(NULL AS VARCHAR) AS absent FROM nation")
def project_padded(spark, d):
    return r.project_padded(table(spark, d, "nation"), ["n_name", "absent"])


# Joins


@query("SELECT o_orderkey, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def join_hash(spark, d):
    orders = table(spark, d, "orders").where("o_totalprice > 300000").select("o_orderkey", "o_custkey")
    customer = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    return r.equi_join(orders, customer, "o_custkey", "c_custkey", strategy="shuffle_hash").select("o_orderkey", "c_name", "c_nationkey")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_small(spark, d):
    """25 and 5 rows: the planner broadcasts by size."""
    return r.equi_join(table(spark, d, "nation"), table(spark, d, "region"), "n_regionkey", "r_regionkey").select("n_name", "r_name")


@query("SELECT a.n_nationkey, a.n_name, a.n_regionkey FROM nation a JOIN nation b ON a.n_nationkey = b.n_regionkey")
def join_clash(spark, d):
    """Columns that both sides have come from the outer one."""
    nation = table(spark, d, "nation")
    return r.equi_join(nation, nation, "n_nationkey", "n_regionkey")


@query("SELECT n_name FROM nation WHERE false")
def join_mixed_kinds(spark, d):
    return r.equi_join(table(spark, d, "nation"), table(spark, d, "region"), "n_nationkey", "r_name").select("n_name")


@query("SELECT n_name, c_name FROM nation JOIN customer ON n_nationkey IS NOT DISTINCT FROM c_nationkey WHERE c_acctbal > 9000")
def join_null_safe(spark, d):
    customer = table(spark, d, "customer").where("c_acctbal > 9000").select("c_nationkey", "c_name")
    return r.equi_join(table(spark, d, "nation"), customer, "n_nationkey", "c_nationkey", null_safe=True).select("n_name", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def join_semi_in(spark, d):
    return r.semi_join(table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 300000"), "c_custkey", "o_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100 * c.c_acctbal)")
def join_correlated_exists(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_totalprice") > 100 * F.col("c_acctbal")), "left_semi").select("c_custkey")


@query("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top_price FROM customer")
def join_scalar_subquery(spark, d):
    tops = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top_price"))
    return table(spark, d, "customer").select("c_custkey").join(tops, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "top_price")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def join_anti(spark, d):
    return r.anti_join(table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 200000"), "c_custkey", "o_custkey").select("c_custkey")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) ON c_custkey = o_custkey GROUP BY c_custkey")
def join_left_count(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 250000").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(big, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


# Aggregates

for _name, _sql in {"sum": "sum(p_size)", "min": "min(p_size)", "max": "max(p_size)", "count": "count(p_size)", "avg": "sum(p_size) // count(p_size)"}.items():

    def _aggregate(spark, d, f=_name):
        made = r.aggregate(table(spark, d, "part"), "p_size", f, ["p_brand"])
        return made.withColumn("result", F.col("result").cast("long"))

    _aggregate.__name__ = f"agg_{_name}"
    query(f"SELECT p_brand, CAST({_sql} AS BIGINT) AS result FROM part GROUP BY p_brand")(_aggregate)


@query("SELECT p_brand, CAST(sum(coalesce(CASE WHEN p_size < 25 THEN p_size END, 0)) // count(*) AS BIGINT) AS result FROM part GROUP BY p_brand")
def agg_avg_missing_as_zero(spark, d):
    part = table(spark, d, "part").withColumn("small", F.when(F.col("p_size") < 25, F.col("p_size")))
    return r.aggregate(part, "small", "avg", ["p_brand"], missing="zero")


@query("SELECT CAST(sum(p_size) AS BIGINT) AS result FROM part WHERE p_size < 0 HAVING count(*) > 0")
def agg_empty(spark, d):
    """In zero mode an empty input has no row."""
    return r.aggregate(table(spark, d, "part").where("p_size < 0"), "p_size", "sum", missing="zero")


@query(
    """SELECT o_orderstatus, o_orderpriority, o_orderstatus || '#' || o_orderpriority || '#' AS group_key, count(o_custkey) AS count,
    CAST(sum(o_custkey) AS BIGINT) AS sum, min(o_custkey) AS min, max(o_custkey) AS max FROM orders GROUP BY ALL"""
)
def agg_multi_key(spark, d):
    return r.aggregate_many(table(spark, d, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"], "group_key")


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
    round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"""
)
def agg_pricing(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_discount"),
        F.count("*").alias("n"),
    )


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority HAVING count(*) > 100")
def having_gt(spark, d):
    return r.having(table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")), "n", ">", 100)


@query("SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1")
def distinct_on_customer(spark, d):
    return r.distinct_on(table(spark, d, "orders"), ["o_custkey"], ["o_orderkey"])


@query("SELECT DISTINCT event_type, user_id FROM events")
def distinct_pairs(spark, d):
    return table(spark, d, "events").select("event_type", "user_id").distinct()


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority")
def agg_count_distinct(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def agg_rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


# Sorting


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def sort_desc(spark, d):
    return r.sort(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", False, ["o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def limit_topk(spark, d):
    return r.top(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 25, tie=["o_orderkey"])


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2")
def group_topk(spark, d):
    return r.group_top(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", 2, ["o_orderkey"]).withColumn("rank", F.col("rank").cast("long"))


# Windows over parts, by brand, size and key

PART_WINDOW = "PARTITION BY p_brand ORDER BY p_size, p_partkey"
PART_ROWS = f"({PART_WINDOW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
PART_COLUMNS = "p_brand, p_partkey, p_size"


def _parts(spark, d):
    return table(spark, d, "part").select("p_brand", "p_partkey", "p_size")


def _window(name: str, sql: str, f: Callable[[DataFrame], DataFrame]) -> None:
    def made(spark, d):
        return f(_parts(spark, d))

    made.__name__ = name
    query(f"SELECT {PART_COLUMNS}, {sql} FROM part")(made)


_by, _order = ["p_brand"], ["p_size", "p_partkey"]
_window("win_row_number", f"row_number() OVER ({PART_WINDOW}) AS window_result", lambda p: windows.ranking(p, "row_number", _by, _order))
_window("win_rank", "rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS window_result", lambda p: windows.ranking(p, "rank", _by, ["p_size"]))
_window("win_dense_rank", "dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS window_result", lambda p: windows.ranking(p, "dense_rank", _by, ["p_size"]))
_window("win_rank_unordered", "CAST(1 AS BIGINT) AS window_result", lambda p: windows.ranking(p, "rank", _by, []))
_window("win_running_sum", f"CAST(sum(p_size) OVER {PART_ROWS} AS BIGINT) AS window_result", lambda p: windows.running(p, "sum", "p_size", _by, _order))
_window("win_running_avg", f"CAST(sum(p_size) OVER {PART_ROWS} // count(*) OVER {PART_ROWS} AS BIGINT) AS window_result", lambda p: windows.running(p, "avg", "p_size", _by, _order))
_window("roll_cumsum", f"CAST(sum(p_size) OVER {PART_ROWS} AS BIGINT) AS rolling_result", lambda p: windows.rolling(p, "cumulative_sum", "p_size", _by, _order))
_n, _s1, _s2 = f"count(*) OVER {PART_ROWS}", f"CAST(sum(p_size) OVER {PART_ROWS} AS HUGEINT)", f"CAST(sum(p_size * p_size) OVER {PART_ROWS} AS HUGEINT)"
_window(
    "roll_variance",
    f"CAST(CASE WHEN {_n} > 1 THEN ({_n} * {_s2} - {_s1} * {_s1}) // ({_n} * ({_n} - 1)) ELSE 0 END AS BIGINT) AS rolling_result",
    lambda p: windows.rolling(p, "variance", "p_size", _by, _order),
)
_window(
    "roll_stddev",
    f"CASE WHEN {_n} > 1 THEN round(sqrt(CAST({_n} * {_s2} - {_s1} * {_s1} AS DOUBLE) / ({_n} * ({_n} - 1))), 6) ELSE 0.0 END AS rolling_result",
    lambda p: windows.rolling(p, "stddev", "p_size", _by, _order),
)
_window(
    "roll_percentile",
    f"CAST(row_number() OVER ({PART_WINDOW}) * 100 // count(*) OVER (PARTITION BY p_brand) AS BIGINT) AS rolling_result",
    lambda p: windows.rolling(p, "percentile", "p_size", _by, _order),
)
_window("rank_lag", f"coalesce(lag(p_size, 2) OVER ({PART_WINDOW}), -1) AS ranking_result", lambda p: windows.offset(p, "lag", "p_size", _by, _order, 2, -1))
_window("rank_lead", f"coalesce(lead(p_size, 1) OVER ({PART_WINDOW}), 0) AS ranking_result", lambda p: windows.offset(p, "lead", "p_size", _by, _order, 1, 0))
_whole_part = f"({PART_WINDOW} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
_window("rank_first", f"first_value(p_partkey) OVER {_whole_part} AS ranking_result", lambda p: windows.offset(p, "first_value", "p_partkey", _by, _order))
_window("rank_last", f"last_value(p_partkey) OVER {_whole_part} AS ranking_result", lambda p: windows.offset(p, "last_value", "p_partkey", _by, _order))
_window(
    "win_first_sum",
    f"CAST(sum(CASE WHEN k <= 3 THEN p_size ELSE 0 END) OVER (PARTITION BY p_brand) AS BIGINT) AS window_total FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part) AS part --",
    lambda p: windows.first_sum(p, "p_size", _by, ["p_partkey"], 3),
)


# Reshaping, recursion, sets


@query(
    """SELECT c_nationkey, coalesce(sum(o_custkey) FILTER (o_orderstatus = 'F'), 0)::BIGINT AS "F", coalesce(sum(o_custkey) FILTER (o_orderstatus = 'O'), 0)::BIGINT AS "O",
    coalesce(sum(o_custkey) FILTER (o_orderstatus = 'X'), 0)::BIGINT AS "X" FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey"""
)
def pivot_status(spark, d):
    joined = r.equi_join(table(spark, d, "orders").select("o_custkey", "o_orderstatus"), table(spark, d, "customer").select("c_custkey", "c_nationkey"), "o_custkey", "c_custkey")
    return reshape.pivot(joined, ["c_nationkey"], "o_orderstatus", "o_custkey", ["F", "O", "X"])


@query(
    """SELECT l_orderkey, name, value FROM (UNPIVOT (SELECT l_orderkey, l_quantity AS quantity, CASE WHEN l_discount > 0.05 THEN l_discount END AS discount
    FROM lineitem) ON quantity, discount INTO NAME name VALUE value)"""
)
def unpivot_lineitem(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("quantity"), F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("discount"))
    return reshape.unpivot(li, ["l_orderkey"], ["quantity", "discount", "absent"], "name", "value")


@query("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 40) SELECT n FROM t")
def recursive_seq(spark, d):
    return spark.sql("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 40) SELECT n FROM t")


_TREE = """WITH RECURSIVE tree(id, depth) AS (
  SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 0
  UNION ALL SELECT n_nationkey, depth + 1 FROM tree JOIN nation ON n_nationkey BETWEEN 4 * id + 1 AND 4 * id + 4 WHERE depth < 50)
SELECT id, depth, n_name, r_name FROM tree JOIN nation ON n_nationkey = id JOIN region ON r_regionkey = n_regionkey"""


@query(_TREE)
def recursive_tree_join(spark, d):
    for name in ("nation", "region"):
        table(spark, d, name).createOrReplaceTempView(f"__{name}")
    return spark.sql(_TREE.replace("FROM nation", "FROM __nation AS nation").replace("JOIN nation", "JOIN __nation AS nation").replace("JOIN region", "JOIN __region AS region"))


@query("SELECT * FROM (VALUES (1), (2), (3)) t(n)")
def recursive_dataframe(spark, d):
    """The recursion as DataFrame code: 1, then n + 1 while n < 3."""
    return reshape.recurse(spark.sql("SELECT 1 AS n"), lambda work: work.where("n < 3").selectExpr("n + 1 AS n"))


@query("SELECT n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT r_name, 'region' FROM region")
def union_all(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("kind"))
    return reshape.union_all([nation, table(spark, d, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("kind"))])


@query("(SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def set_operations(spark, d):
    rich = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"))
    return rich.intersect(table(spark, d, "supplier").select("s_nationkey")).subtract(table(spark, d, "nation").where("n_regionkey = 1").select("n_nationkey"))


# Expressions and JSON


@query("SELECT event_id, strlen(event_type)::BIGINT AS v FROM events")
def expr_len(spark, d):
    return with_expression(table(spark, d, "events"), "len(event_type)", "v").select("event_id", "v")


@query("SELECT event_id FROM events WHERE contains(event_type, 'ic')")
def expr_contains(spark, d):
    df = table(spark, d, "events")
    return df.where(condition("contains(event_type, 'ic')", df.schema)).select("event_id")


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 15")
def expr_between(spark, d):
    df = table(spark, d, "part")
    return df.where(condition("between(p_size, 5)", df.schema)).select("p_partkey")


@query("SELECT (p_partkey - 100) // 8 + CASE WHEN p_partkey < 100 AND (p_partkey - 100) % 8 <> 0 THEN 0 ELSE 0 END AS b, count(*) AS n FROM part WHERE p_partkey >= 100 GROUP BY b")
def expr_bucket(spark, d):
    return with_expression(table(spark, d, "part").where("p_partkey >= 100"), "bucket(p_partkey - 100)", "b").groupBy("b").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_partkey // (p_size % 5) END + 2 * 3 - 1 AS v FROM part")
def expr_arithmetic(spark, d):
    """Whole division; by zero it gives 0."""
    part = table(spark, d, "part").withColumn("m", F.col("p_size") % 5)
    return with_expression(part, "p_partkey / m + 2 * 3 - 1", "v").select("p_partkey", "v")


@query("SELECT p_partkey, (p_size + 2 * 3 > 20) = (p_brand = 'Brand#11') AS v FROM part")
def expr_precedence(spark, d):
    return with_expression(table(spark, d, "part"), "(p_size + 2 * 3 > 20) = (p_brand = 'Brand#11')", "v").select("p_partkey", "v")


@query("SELECT event_id, strlen(event_type) AS n, user_id // 8 AS b, user_id BETWEEN 10 AND 20 AS near FROM events")
def sql_functions(spark, d):
    scalars.register(spark)
    return table(spark, d, "events").select("event_id", F.expr("cast(q_len(event_type) AS BIGINT)").alias("n"), F.expr("q_bucket(user_id)").alias("b"), F.expr("q_between(user_id, 10)").alias("near"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", js.get(js.parse(F.col("props")), "$.k", "long").alias("k"))


@query("SELECT user_id, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY user_id")
def json_group(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.sum(js.get(js.parse(F.col("props")), "$.k", "long")).alias("k"))


@query("""SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS doc FROM nation""")
def json_serialise(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name")).alias("doc"))


@query("SELECT event_id, '$.k: maximum 50' AS issue FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def json_schema(spark, d):
    rules = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 50}}}
    return table(spark, d, "events").select("event_id", F.explode(js.violations(js.parse(F.col("props")), rules)).alias("issue"))


# Written plans


@query(
    """SELECT event_id, user_id, kind, CAST(sum(CASE WHEN k <= 3 THEN score ELSE 0 END) OVER (PARTITION BY kind) AS BIGINT) AS window_total FROM (
    SELECT event_id, user_id, event_type AS kind, event_id % 97 AS score, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events WHERE event_id % 97 > 10)"""
)
def pipeline_window(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("kind"), (F.col("event_id") % 97).alias("score"))
    text = "load|events\nfilter|score > 10\nwindow|kind|rows|3\nproject|event_id,user_id,kind,window_total"
    return dsl.run_pipeline({"events": events}, dsl.parse_pipeline(text), ["event_id"])


@query("SELECT o_orderkey AS \"order\", c_mktsegment AS event_kind FROM orders JOIN customer ON o_custkey = c_custkey")
def pipeline_join(spark, d):
    tables = {
        "orders": table(spark, d, "orders").select("o_orderkey", "o_custkey"),
        "customer": table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind")),
    }
    return dsl.run_pipeline(tables, dsl.parse_pipeline("load|orders\njoin|customer|o_custkey\nproject|o_orderkey:order,event_kind"), [])


@query("SELECT n_name, CAST(NULL AS BIGINT) AS bytes FROM nation UNION ALL SELECT NULL, count(*) FROM nation")
def pipeline_preview(spark, d):
    return dsl.run_pipeline({"nation": table(spark, d, "nation")}, dsl.parse_pipeline("load|nation\nproject|n_name\npreview|gray"), [])


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey > 30 ORDER BY o_orderkey LIMIT 50")
def transform_text(spark, d):
    return dsl.run_transform(table(spark, d, "orders"), dsl.parse_transform("project=o_orderkey,o_orderstatus,absent|filter=o_custkey>30|limit=50"), ["o_orderkey"])[0]


@query("SELECT event_id, event_type FROM events WHERE user_id = 7")
def workload_find(spark, d):
    return dsl.execute(dsl.parse_workload("find|events|where=user_id=7|project=event_id,event_type")[0], table(spark, d, "events"))


@query("SELECT count(user_id) AS count, CAST(sum(user_id) AS BIGINT) AS sum, min(user_id) AS min, max(user_id) AS max FROM events WHERE event_type = 'click' AND user_id >= 3")
def workload_aggregate(spark, d):
    return dsl.execute(dsl.parse_workload("aggregate|events|where=event_type=click,user_id>=3|agg=user_id")[0], table(spark, d, "events"))


@query("SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN 'moved' ELSE s_name END AS s_name FROM supplier")
def table_update(spark, d):
    return update(table(spark, d, "supplier"), F.col("s_nationkey") == 3, {"s_name": F.lit("moved")}).select("s_suppkey", "s_name")


@query("SELECT s_suppkey FROM supplier WHERE NOT (s_acctbal < 0)")
def table_delete(spark, d):
    return delete(table(spark, d, "supplier"), F.col("s_acctbal") < 0).select("s_suppkey")


@query("SELECT i AS id, CASE WHEN i % 2 = 0 THEN 'west' ELSE 'east' END AS region, i * 7 AS score, (SELECT count(*) FROM range(32) e(j) WHERE j % 12 = i) AS n FROM range(12) u(i)")
def demo_tables(spark, d):
    counts = demo_events(spark).groupBy(F.col("id").alias("event_user")).agg(F.count("*").alias("n"))
    return demo_users(spark).join(counts, F.col("id") == F.col("event_user")).select("id", "region", "score", "n")


# Catalog, statistics

ORDER_RULES = catalog.Table(
    "orders",
    (
        catalog.Field("o_orderkey", "int", required=True, unique=True, least=0),
        catalog.Field("o_orderstatus", "string", values=("F", "O")),
        catalog.Field("o_totalprice", "double", most=300000),
        catalog.Field("o_orderpriority", "string", max_length=8),
        catalog.Field("note", "string", default="none"),
    ),
)


@query(
    """SELECT o_orderkey, 'o_orderstatus' AS field, 'not a listed value' AS issue FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
    UNION ALL SELECT o_orderkey, 'o_totalprice', 'above 300000' FROM orders WHERE o_totalprice > 300000
    UNION ALL SELECT o_orderkey, 'o_orderpriority', 'longer than 8' FROM orders WHERE strlen(o_orderpriority) > 8"""
)
def catalog_issues(spark, d):
    return catalog.issues(table(spark, d, "orders"), ORDER_RULES, ["o_orderkey"])


@query("SELECT n_nationkey, n_name, true AS active FROM nation")
def catalog_defaults(spark, d):
    t = catalog.Table("nation", (catalog.Field("n_nationkey", "int"), catalog.Field("n_name"), catalog.Field("active", "bool", default=True)))
    return catalog.insertable(table(spark, d, "nation"), t)


@query("SELECT n_nationkey AS id, CAST(n_regionkey AS VARCHAR) AS region, 0 AS score FROM nation")
def schema_migration(spark, d):
    t = catalog.Table("nation", tuple(catalog.Field(n, k) for n, k in (("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int"))))
    steps = "step nation 1 2\nrename_field n_nationkey id\ndrop_field n_name\nrename_field n_regionkey region\nchange_type region string\nadd_field score int default=0\nadd_index by_score score"
    return evolution.migrate(t, evolution.parse(steps), table(spark, d, "nation"), strict=False).rows.withColumn("score", F.col("score").cast("int"))


@query(
    """SELECT 'o_orderkey' AS column_name, count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_distinct, count(*) - count(o_orderkey) AS n_null, CAST(min(o_orderkey) AS VARCHAR) AS least, CAST(max(o_orderkey) AS VARCHAR) AS greatest FROM orders
    UNION ALL SELECT 'o_orderstatus', count(*), count(DISTINCT o_orderstatus), count(*) - count(o_orderstatus), min(o_orderstatus), max(o_orderstatus) FROM orders"""
)
def column_stats(spark, d):
    return statistics.column_stats(table(spark, d, "orders"), ["o_orderkey", "o_orderstatus"])


@query("SELECT CAST(least(floor((p_size - 1) / 5.0), 9) AS BIGINT) AS bucket, count(*) AS n FROM part WHERE p_size BETWEEN 1 AND 51 GROUP BY bucket")
def hist_equi_width(spark, d):
    return statistics.equi_width(table(spark, d, "part"), "p_size", 1, 51)


@query("SELECT bucket, min(p_partkey) AS low, max(p_partkey) AS high, count(*) AS n FROM (SELECT p_partkey, ntile(8) OVER (ORDER BY p_partkey) AS bucket FROM part) GROUP BY bucket")
def hist_equi_depth(spark, d):
    return statistics.equi_depth(table(spark, d, "part").select("p_partkey"), "p_partkey", 8)


@query(
    """SELECT round(sum(CASE WHEN b < 4 THEN n WHEN b = 4 THEN n * 0.8 ELSE 0 END) / sum(n), 6) AS selectivity
    FROM (SELECT CAST(least(floor((p_size - 1) / 5.0), 9) AS BIGINT) AS b, CAST(count(*) AS DOUBLE) AS n FROM part WHERE p_size BETWEEN 1 AND 51 GROUP BY b)"""
)
def selectivity_estimate(spark, d):
    """The share of parts below size 25, from the histogram."""
    histogram = statistics.equi_width(table(spark, d, "part"), "p_size", 1, 51)
    return statistics.width_selectivity(histogram, 1, 51, 10, "<", 25).select(F.round("selectivity", 6).alias("selectivity"))


@query("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9000")
def bloom_filter_join(spark, d):
    """The filter lets every match through; the join takes out the few others."""
    rich = table(spark, d, "customer").where("c_acctbal > 9000").select("c_custkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return r.semi_join(statistics.bloom_may_contain(rich, "c_custkey", orders, "o_custkey", 10_000), rich, "o_custkey", "c_custkey").select("o_orderkey")


@query("SELECT n_nationkey, dense_rank() OVER (ORDER BY n_regionkey) - 1 AS code FROM nation")
def encode_dictionary(spark, d):
    return statistics.dictionary_encode(table(spark, d, "nation"), "n_regionkey").select("n_nationkey", "code")


@query("SELECT p_partkey, p_size - coalesce(lag(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey), 0) AS delta, CAST(p_size AS BIGINT) AS value FROM part")
def encode_delta(spark, d):
    made = statistics.delta_encode(table(spark, d, "part").select("p_brand", "p_partkey", "p_size"), "p_size", ["p_partkey"], ["p_brand"])
    return statistics.delta_decode(made, ["p_partkey"], ["p_brand"]).select("p_partkey", "delta", "value")


@query(
    """SELECT user_id, run, any_value(event_type) AS value, count(*) AS n FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run FROM (
    SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, run"""
)
def encode_run_length(spark, d):
    return statistics.run_length(table(spark, d, "events").select("user_id", "event_id", "event_type"), "event_type", ["event_id"], ["user_id"])


@query("SELECT n_nationkey, n_name, n_name AS decoded FROM nation")
def encode_decode_dictionary(spark, d):
    """A delta of text falls back to a dictionary, whose codes give the text back."""
    how, coded = statistics.encode(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_name", ["n_nationkey"], "delta")
    dictionary = coded.select("code", "n_name")
    return statistics.dictionary_decode(coded.withColumn("kept", F.col("code")), dictionary, "kept", "n_name").select("n_nationkey", "n_name", F.col("value").alias("decoded"))


@query("SELECT user_id, event_type AS value, count(*) AS n FROM events GROUP BY ALL")
def encode_decode_run_length(spark, d):
    runs = statistics.run_length(table(spark, d, "events").select("user_id", "event_id", "event_type"), "event_type", ["event_id"], ["user_id"])
    return statistics.run_length_decode(runs, ["user_id"]).groupBy("user_id", "value").agg(F.count("*").alias("n"))


@query(
    """SELECT event_id, unnest(list_concat(CASE WHEN k > 50 THEN ['$.list[].k: maximum 50'] ELSE [] END, CASE WHEN strlen(event_type) > 5 THEN ['$.list[].a.b: maxLength 5'] ELSE [] END)) AS issue
    FROM (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""
)
def json_schema_items(spark, d):
    """Rules for the members of objects in an array, one of them with a dot in its name."""
    schema = {"type": "object", "properties": {"list": {"type": "array", "items": {"type": "object", "properties": {"k": {"type": "integer", "maximum": 50}, "a.b": {"type": "string", "maxLength": 5}}}}}}
    text = F.concat(F.lit('{"list":[{"k":1},{"a.b":"'), "event_type", F.lit('","k":'), F.get_json_object("props", "$.k"), F.lit("}]}"))
    return table(spark, d, "events").select("event_id", F.explode(js.violations(js.parse(text), schema)).alias("issue"))


PART_RULES = catalog.Table("part", (catalog.Field("p_partkey", "int"), catalog.Field("p_name"), catalog.Field("p_size", "int")), (catalog.Index("part_pk", "btree", ("p_partkey",), True),))


@query("SELECT * FROM (VALUES ('lookup', 'part_pk', 6, 14), ('filter', '', 96, 384), ('project', 'p_name', 96, 2)) t(step, uses, n_rows, cost)")
def workload_plan(spark, d):
    made = dsl.plan(dsl.parse_workload("find|part|where=p_partkey=7|project=p_name")[0], catalog.Catalog([PART_RULES]))
    return spark.createDataFrame(made.steps, "step string, uses string, n_rows int, cost int")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, NULL")
def workload_insert(spark, d):
    return dsl.execute(dsl.parse_workload("insert|region|doc=r_regionkey=99")[0], table(spark, d, "region"))


@query("SELECT unnest(['field p_size: int became string', 'field p_name removed', 'new field p_kind is required without a default']) AS issue")
def schema_compatibility(spark, d):
    later = catalog.Table("part", (catalog.Field("p_partkey", "int"), catalog.Field("p_size", "string"), catalog.Field("p_kind", required=True)))
    return spark.createDataFrame([(x,) for x in evolution.compatibility(PART_RULES, later)], "issue string")


@query("SELECT p_partkey FROM part WHERE p_size > 30")
def expr_slot_names(spark, d):
    parts = table(spark, d, "part")
    return parts.where(condition("slot.p.size > 30", parts.schema)).select("p_partkey")


@query("SELECT * FROM (VALUES (0, 'load'), (1, 'clean'), (1, 'count'), (2, 'report')) t(level, task)")
def batch_levels(spark, d):
    levels, _, _ = dsl.dry_run(dsl.parse_batch("task|load|2\ntask|clean|3|load\ntask|count|1|load\ntask|report|1|clean,count\ntask|never|1|missing"))
    return spark.createDataFrame([(i, name) for i, names in enumerate(levels) for name in names], "level int, task string")


@query("SELECT p_size AS value, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys FROM part WHERE NOT (p_size = 5 OR p_size > 12) GROUP BY p_size")
def filter_not_or(spark, d):
    df = table(spark, d, "part")
    found = df.where(r.tree(df, ("not", ("or", ("p_size", "=", 5), ("p_size", ">", 12)))))
    return found.groupBy(F.col("p_size").alias("value")).agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


# Partitions

PRICE_BANDS = partitions.Ranges("o_custkey", (("low", 0, 40), ("middle", 41, 90), ("high", 91, 10_000_000)))


@query("SELECT CASE WHEN o_custkey BETWEEN 0 AND 40 THEN 'low' WHEN o_custkey BETWEEN 41 AND 90 THEN 'middle' ELSE 'high' END AS p, count(*) AS n FROM orders GROUP BY p")
def part_range_label(spark, d):
    return table(spark, d, "orders").groupBy(PRICE_BANDS.label().alias("p")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey > 60")
def part_range_prune(spark, d):
    stored = partitions.stored(table(spark, d, "orders"), PRICE_BANDS, f"{d}/orders")
    return partitions.read_where(stored, PRICE_BANDS, "o_custkey", ">", 60).select("o_orderkey")


@query("SELECT event_id FROM events WHERE event_type = 'click'")
def part_list_prune(spark, d):
    lists = partitions.Lists("event_type", (("active", ("click", "purchase")), ("passive", ("view", "scroll"))))
    return partitions.read_where(partitions.stored(table(spark, d, "events"), lists, f"{d}/events"), lists, "event_type", "=", "click").select("event_id")


@query("SELECT event_id FROM events WHERE user_id = 11")
def part_hash_prune(spark, d):
    hashed = partitions.Hashed("user_id", 8)
    return partitions.read_where(partitions.stored(table(spark, d, "events"), hashed, f"{d}/events"), hashed, "user_id", "=", 11).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE (o_custkey < 30 AND o_custkey > 10) OR o_custkey = 95")
def part_tree_prune(spark, d):
    df, node = partitions.stored(table(spark, d, "orders"), PRICE_BANDS, f"{d}/orders"), ("or", ("and", ("o_custkey", "<", 30), ("o_custkey", ">", 10)), ("o_custkey", "=", 95))
    return df.where(F.col("p").isin(*sorted(partitions.keep(PRICE_BANDS, node)))).where(r.tree(df, node)).select("o_orderkey")


# Telemetry


@query("SELECT event_type, count(*) AS samples, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def telemetry_counter(spark, d):
    return telemetry.counters(table(spark, d, "events"), ["event_type"]).withColumn("total", F.round("total", 2))


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def telemetry_gauge(spark, d):
    return telemetry.gauges(table(spark, d, "events"), ["user_id", "event_type"], "value", "event_id")


@query("SELECT CASE WHEN value <= 1 THEN 1.0::DOUBLE WHEN value <= 10 THEN 10.0::DOUBLE WHEN value <= 100 THEN 100.0::DOUBLE END AS bound, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY bound")
def telemetry_hist(spark, d):
    return telemetry.histogram(table(spark, d, "events"), "value", [1, 10, 100]).withColumn("total", F.round("total", 2))


@query("SELECT event_id, duration FROM (SELECT event_id, event_id % 1000 AS start_ms, (event_id * 7) % 3000 AS end_ms, (event_id * 7) % 3000 - event_id % 1000 AS duration FROM events) WHERE end_ms <> 0 AND duration >= 500")
def telemetry_slow_spans(spark, d):
    spans = table(spark, d, "events").select("event_id", (F.col("event_id") % 1000).alias("start_ms"), (F.col("event_id") * 7 % 3000).alias("end_ms"))
    return telemetry.slow_spans(spans, 500).select("event_id", "duration")


@query(
    """SELECT section, name, n, round(value, 2) AS value FROM (
      SELECT CASE event_type WHEN 'click' THEN 'counter' WHEN 'view' THEN 'gauge' ELSE 'observe' END AS section, CAST(user_id % 10 AS VARCHAR) AS name, count(*) AS n,
        CASE WHEN any_value(event_type) = 'view' THEN arg_max(value, event_id) ELSE sum(value) END AS value FROM events GROUP BY 1, 2
      UNION ALL SELECT 'slow_span', event_type, 1, CAST((event_id * 7) % 3000 - event_id % 1000 AS DOUBLE) FROM events
      WHERE (event_id * 7) % 3000 <> 0 AND (event_id * 7) % 3000 - event_id % 1000 >= 2500)"""
)
def telemetry_report(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "counter").when(F.col("event_type") == "view", "gauge").otherwise("observe")
    samples = e.select(kind.alias("kind"), (F.col("user_id") % 10).cast("string").alias("name"), "value", F.col("event_id").alias("at"))
    spans = e.select(F.col("event_type").alias("operation"), (F.col("event_id") % 1000).alias("start_ms"), (F.col("event_id") * 7 % 3000).alias("end_ms"))
    return telemetry.report(samples, spans, 2500).withColumn("value", F.round("value", 2))


# Histories


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events WHERE event_id <= 400 GROUP BY user_id")
def mvcc_snapshot(spark, d):
    return history.snapshot(table(spark, d, "events"), "user_id", "event_id", history.visible_at("snapshot", 400), ["event_type", "value"])


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def mvcc_read_uncommitted(spark, d):
    return history.snapshot(table(spark, d, "events"), "user_id", "event_id", history.visible_at("read_uncommitted", 400), ["event_type"])


@query(
    """SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events
    WHERE event_id % 50 IN (SELECT event_id % 50 FROM events WHERE event_type = 'purchase' AND event_id % 50 < 25) GROUP BY user_id"""
)
def wal_recover(spark, d):
    """Events as a log: the number modulo 50 is the transaction, some purchases commit theirs."""
    log = table(spark, d, "events").withColumn("tx", F.col("event_id") % 50)
    return history.recover(log, "tx", "user_id", "event_id", log.where("event_type = 'purchase' AND tx < 25"), ["value"])


@query("SELECT DISTINCT event_id % 50 AS tx FROM events WHERE event_id % 50 NOT IN (SELECT event_id % 50 FROM events WHERE event_type = 'purchase' AND event_id % 50 < 25)")
def wal_losers(spark, d):
    log = table(spark, d, "events").withColumn("tx", F.col("event_id") % 50)
    return history.losers(log, "tx", log.where("event_type = 'purchase' AND tx < 25"))


@query("SELECT count(*) AS n, max(event_id) AS last FROM events WHERE event_id % 50 <> 3 OR event_id <= 300")
def savepoint_rollback(spark, d):
    log = table(spark, d, "events").withColumn("tx", F.col("event_id") % 50)
    return history.rollback_to(log, "tx", "event_id", 3, 300).agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("SELECT least((SELECT min(event_id) FROM events WHERE event_type = 'purchase'), (SELECT min(event_id) FROM events WHERE user_id = 5)) AS start_lsn")
def checkpoint_start(spark, d):
    e = table(spark, d, "events")
    return history.recovery_start(e.where("event_type = 'purchase'"), e.where("user_id = 5"), "event_id", "event_id")


@query(
    """SELECT event_id, seq, before FROM (SELECT event_id, user_id, (event_id * 13) % 101 AS seq, lag((event_id * 13) % 101) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
    WHERE before IS NOT NULL AND seq <= before"""
)
def frame_sequence(spark, d):
    frames = table(spark, d, "events").select("event_id", "user_id", (F.col("event_id") * 13 % 101).alias("seq"))
    return history.sequence_breaks(frames, "event_id", "seq", "user_id").select("event_id", "seq", "before")


# Operations


@query(
    """SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'shutdown' WHEN event_id % 400 < 30 THEN 'wait' WHEN event_id % 53 = 0 THEN 'backup' WHEN event_id % 1300 >= 1000 THEN 'wal'
    WHEN event_id % 120 >= 100 THEN 'dirty' WHEN event_id % 40 >= 32 THEN 'replica' WHEN event_id % 400 >= 300 THEN 'periodic' ELSE 'none' END AS reason FROM events"""
)
def checkpoint_decision(spark, d):
    i = F.col("event_id")
    signals = table(spark, d, "events").select(
        "event_id",
        (i % 97 == 0).alias("shutdown"),
        (i % 400).alias("since_last"),
        (i % 53 == 0).alias("backup_requested"),
        (i % 1300).alias("wal_records"),
        (i % 120).alias("dirty_pages"),
        (i % 40).alias("replica_lag"),
        (i % 9).alias("checkpoints_done"),
    )
    return cluster.checkpoint_decisions(signals).select("event_id", "reason")


_MODE = """CASE WHEN event_id % 9 > 0 AND event_id % 9 % 4 = 0 THEN 'full' WHEN event_id % 97 = 0 THEN 'consistent' WHEN event_id % 40 >= 32 THEN 'light' ELSE 'incremental' END"""


@query(f"SELECT event_id, mode, CASE WHEN mode = 'light' THEN least(128, dirty) WHEN mode = 'incremental' THEN least(500, dirty) ELSE dirty END AS flush_pages FROM (SELECT event_id, event_id % 600 AS dirty, {_MODE} AS mode FROM events)")
def checkpoint_modes(spark, d):
    """Either shutdown, a lagging replica or the period calls for a checkpoint; every fourth is full."""
    i = F.col("event_id")
    no = F.lit(0)
    signals = table(spark, d, "events").select(
        "event_id", (i % 97 == 0).alias("shutdown"), F.lit(900).alias("since_last"), F.lit(False).alias("backup_requested"), no.alias("wal_records"), (i % 600).alias("dirty_pages"), (i % 40).alias("replica_lag"), (i % 9).alias("checkpoints_done")
    )
    return cluster.checkpoint_decisions(signals, dirty_limit=1000, min_interval=30).select("event_id", "mode", "flush_pages")


@query(
    """SELECT event_id, k <= 5 OR event_id + 20 > 990 OR event_type = 'purchase' AS kept
    FROM (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id DESC) AS k FROM events)"""
)
def checkpoint_retained(spark, d):
    mode = F.when(F.col("event_type") == "purchase", "full").otherwise("light")
    taken = table(spark, d, "events").select("event_id", F.col("event_id").alias("id"), F.col("event_id").alias("at"), mode.alias("mode"), F.col("event_id").alias("wal_start"))
    return cluster.checkpoint_retention(taken, 5, 20, 990).select("event_id", "kept")


@query("SELECT unnest(['checkpoint', 'payload']) AS missing")
def frame_types_missing(spark, d):
    """Events as frames of three types; two required types are absent."""
    frames = table(spark, d, "events").select((F.col("event_id") % 3 + 1).alias("type"))
    return history.missing_frame_types(frames, "type", ["page", "log", "checkpoint", "payload"])


_TOPOLOGY = """node n1 z1 r1 storage online capacity=10
node n2 z1 r2 storage online
node n4 z2 r1 storage offline
shard s1 4 n1:leader:log=100 n2:log=98
shard s2 4 n4:leader:log=100 n2:log=90"""


@query("SELECT 's2' AS shard, 'n2' AS new_leader, true AS safe")
def topology_failover(spark, d):
    """A topology read from text."""
    return cluster.failover(spark.createDataFrame(manifests.read_topology(_TOPOLOGY)[1]))


@query("SELECT * FROM (VALUES ('b0', NULL, 0, 10, 2), ('b1', 'b0', 10, 20, 1), ('b2', 'b1', 21, 30, 0)) t(id, parent, start_lsn, end_lsn, steps)")
def backup_restore_plan(spark, d):
    backups = spark.sql("SELECT * FROM VALUES ('b0', CAST(NULL AS STRING), 0, 10), ('b1', 'b0', 10, 20), ('b2', 'b1', 21, 30), ('c0', NULL, 0, 5) AS t(id, parent, start_lsn, end_lsn)")
    return cluster.restore_plan(spark, backups, "b2")


@query("SELECT 'b2' AS id, 20 AS expected")
def backup_gap(spark, d):
    backups = spark.sql("SELECT * FROM VALUES ('b', 'b0', 0, 10), ('b', 'b1', 10, 20), ('b', 'b2', 21, 30), ('c', 'c0', 0, 5) AS t(chain, id, start_lsn, end_lsn)")
    return cluster.backup_gaps(backups).select("id", "expected")


_REPLICAS = """SELECT * FROM VALUES ('s1', 'n1', true, true, true, 100), ('s1', 'n2', true, true, false, 98), ('s2', 'n4', false, true, true, 100), ('s2', 'n2', true, true, false, 90),
('s2', 'n3', true, false, false, 99) AS t(shard, node, online, voter, leader, log_index)"""


@query("SELECT 's2' AS shard, 'n2' AS new_leader, true AS safe")
def replica_failover(spark, d):
    return cluster.failover(spark.sql(_REPLICAS))


@query("SELECT 's2' AS shard, 'no single online leader' AS issue")
def replica_placement(spark, d):
    return cluster.placement_issues(spark.sql(_REPLICAS))


@query("SELECT * FROM (VALUES (1), (2), (3)) t(tx)")
def lock_wait_circles(spark, d):
    return cluster.wait_circles(spark, spark.sql("SELECT * FROM VALUES (1, 2), (2, 3), (3, 1), (4, 1) AS t(waiter, holder)"))


# Extension: windows over event time, here over the whole table as a batch


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    return stream.tumbling(table(spark, d, "events"), "ts", "1 hour", "1 hour", ["event_type"], "value").withColumn("total", F.round("total", 2))


@query(
    """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
    SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, s"""
)
def event_sessions(spark, d):
    return stream.sessions(table(spark, d, "events"), "ts", "30 minutes", "1 hour", ["user_id"])
