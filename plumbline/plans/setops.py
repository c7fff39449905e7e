"""Set operations."""

from __future__ import annotations

from plumbline.plans.text import sql_query as q

A, B = "SELECT n_regionkey AS k FROM nation", "SELECT NULLIF(r_regionkey, 2) AS k FROM region"
q("setop_union_all", f"{A} UNION ALL {B} UNION ALL SELECT NULL")
q("setop_union", f"{A} UNION {B}")
q("setop_union_types", "SELECT n_nationkey AS k FROM nation UNION SELECT o_orderkey FROM orders WHERE o_orderkey < 60")
q("setop_intersect", f"{A} INTERSECT {B}")
q("setop_intersect_all", f"{A} INTERSECT ALL ({A} WHERE n_nationkey < 13)")
q("setop_except", f"{B} EXCEPT {A} WHERE n_nationkey > 20")
q("setop_except_all", f"{A} EXCEPT ALL {B}")
q("setop_precedence", f"{A} UNION ALL {B} INTERSECT SELECT 3 AS k")
q("setop_parentheses", f"({A} EXCEPT {B}) UNION ALL (SELECT r_regionkey FROM region ORDER BY r_regionkey DESC LIMIT 2)")
q("setop_in_subquery", f"SELECT n_name FROM nation WHERE n_nationkey IN (SELECT r_regionkey FROM region UNION ALL SELECT s_nationkey FROM supplier WHERE s_suppkey < 4)")
q("setop_filter_pushed", f"SELECT k, count(*) AS n FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT l_suppkey FROM lineitem) u WHERE k < 50 GROUP BY k")
q("setop_order_limit", f"SELECT o_orderkey AS k FROM orders UNION ALL SELECT l_partkey FROM lineitem WHERE l_orderkey < 50 ORDER BY k DESC LIMIT 20")
