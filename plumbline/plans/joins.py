"""Joins of every kind."""

from __future__ import annotations

from plumbline.plans.text import sql_query as q

q("join_inner", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS t FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")
q("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name LIKE 'A%'")
q("join_cross", "SELECT count(*) AS n FROM nation CROSS JOIN region")
q("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000 GROUP BY c_custkey")
q("join_left_condition_on_left", "SELECT n_nationkey, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND n_nationkey > 10")
q("join_full", "SELECT a.k AS ak, b.k AS bk FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 12) a FULL JOIN (SELECT n_nationkey + 5 AS k FROM nation) b ON a.k = b.k")
q("join_full_residual", "SELECT a.n_name AS a, b.n_name AS b FROM nation a FULL OUTER JOIN nation b ON a.n_regionkey = b.n_nationkey AND a.n_nationkey > b.n_regionkey")
q("join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
q("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
q("join_null_aware_anti", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(r_regionkey, 99) FROM region)")
q("join_null_aware_anti_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(r_regionkey, 3) FROM region)")
q("join_null_aware_anti_empty", "SELECT count(*) AS n FROM nation WHERE NULLIF(n_nationkey, 4) NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 100)")
q("join_mark", "SELECT count(*) AS n FROM nation WHERE NULLIF(n_nationkey, 7) IN (SELECT NULLIF(r_regionkey, 1) FROM region) OR n_name LIKE 'U%'")
q("join_mark_null_seen", "SELECT count(*) AS n FROM nation WHERE (n_nationkey IN (SELECT NULLIF(r_regionkey, 1) FROM region)) IS NULL")
q("join_mark_value", "SELECT n_nationkey, CASE WHEN n_nationkey IN (SELECT NULLIF(r_regionkey, 1) FROM region) THEN 1 WHEN n_nationkey NOT IN (SELECT r_regionkey FROM region) THEN 2 ELSE 3 END AS m FROM nation")
q("join_mark_exists", "SELECT count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING') OR o_totalprice > 300000")
q("join_one_row", "SELECT o_orderkey, round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 2) AS d FROM orders")
q("join_theta", "SELECT a.n_nationkey AS a, count(b.n_nationkey) AS n FROM nation a LEFT JOIN nation b ON a.n_nationkey < b.n_regionkey GROUP BY a.n_nationkey")
q("join_theta_inner", "SELECT count(*) AS n FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal AND a.s_nationkey = b.s_nationkey")
q("join_null_equal", "SELECT a.k AS k, count(*) AS n FROM (SELECT NULLIF(n_regionkey, 1) AS k FROM nation) a JOIN (SELECT NULLIF(r_regionkey, 1) AS k FROM region) b ON a.k IS NOT DISTINCT FROM b.k GROUP BY a.k")
q("join_two_columns", "SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey WHERE a.l_linenumber < b.l_linenumber")
q("join_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey < b.s_suppkey")
q("join_two_types", "SELECT count(*) AS n FROM orders JOIN nation ON o_custkey = n_nationkey")
q("join_many", "SELECT r_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
q("join_or_factored", "SELECT count(*) AS n FROM lineitem, part WHERE (p_partkey = l_partkey AND p_size < 10 AND l_quantity < 5) OR (p_partkey = l_partkey AND p_size > 40 AND l_quantity > 45)")
q("join_transitive", "SELECT count(*) AS n FROM orders, lineitem, customer WHERE o_orderkey = l_orderkey AND o_custkey = c_custkey AND c_custkey = 7")
q("join_empty_side", "SELECT count(*) AS n, count(r_name) AS m FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey > 100) r ON n_regionkey = r_regionkey")
q("join_using", "SELECT count(*) AS n FROM (SELECT o_orderkey AS k FROM orders) a JOIN (SELECT l_orderkey AS k FROM lineitem) b USING (k)")
q("join_asof_by_window", "SELECT event_id, prev FROM (SELECT event_id, event_type, max(CASE WHEN event_type = 'view' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS prev FROM events) e WHERE event_type = 'purchase'")
