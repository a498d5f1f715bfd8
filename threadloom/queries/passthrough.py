"""The SQL surface: statements that run as they are on both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.plans.sqlmode import run_sql
from threadloom.tables import register

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

SQL = {
    "sql_grouping_sets": """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty
        FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""",
    "sql_rollup": """SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(max(o_totalprice), 2) AS top FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""",
    "sql_cube": """SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)""",
    "sql_window_rank": """SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place,
        CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS prio FROM orders""",
    "sql_window_frame": """SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS run FROM events""",
    "sql_setops": """SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier EXCEPT SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1""",
    "sql_nested_subquery": """SELECT c_custkey, c_name FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer x WHERE x.c_nationkey = c.c_nationkey)
        AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)""",
    "sql_join_agg": """SELECT n_name, count(*) AS n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "sql_tumbling_window": """SELECT CAST(date_trunc('hour', ts) AS STRING) AS hour, event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY date_trunc('hour', ts), event_type""",
    "sql_having_case": """SELECT p_brand, CAST(sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) AS BIGINT) AS large, count(*) AS n FROM part GROUP BY p_brand HAVING count(*) > 3""",
    "sql_left_anti": """SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)""",
    "sql_full_outer": """SELECT coalesce(a.k, b.k) AS k, a.n AS n_customers, b.n AS n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) a
        FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey) b ON a.k = b.k""",
}


def _query(text: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        register(s, d, [t for t in TABLES if t in text])
        return run_sql(s, text)

    return run


QUERIES = {name: _query(text) for name, text in SQL.items()}
