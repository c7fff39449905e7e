"""Subqueries, correlated and not, and query blocks."""

from __future__ import annotations

from plumbline.plans.text import sql_query as q

q("sub_any", "SELECT n_name FROM nation WHERE n_regionkey = ANY (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
q("sub_some_all", "SELECT n_name FROM nation WHERE n_regionkey = SOME (SELECT r_regionkey FROM region) AND n_nationkey <> ALL (SELECT r_regionkey FROM region)")
q("sub_in_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) IN (SELECT n_nationkey FROM nation)")
q("sub_in_select", "SELECT n_nationkey, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier) THEN 'yes' ELSE 'no' END AS has FROM nation")
q("sub_not_over_or", "SELECT count(*) AS n FROM nation WHERE NOT (n_nationkey IN (SELECT r_regionkey FROM region) OR n_name LIKE '%A')")
q("sub_coalesce_mark", "SELECT count(*) AS n FROM nation WHERE COALESCE(n_nationkey IN (SELECT NULLIF(r_regionkey, 0) FROM region), TRUE)")
q("sub_scalar_everywhere", "SELECT n_regionkey + (SELECT min(r_regionkey) FROM region) AS k, count(*) AS n FROM nation WHERE n_nationkey > (SELECT max(r_regionkey) FROM region) GROUP BY n_regionkey + (SELECT min(r_regionkey) FROM region) HAVING count(*) > (SELECT min(r_regionkey) FROM region)")
q("sub_scalar_empty", "SELECT n_nationkey, (SELECT r_name FROM region WHERE r_regionkey > 100) AS nothing FROM nation")
q("sub_exists_uncorrelated", "SELECT count(*) AS n FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE r_regionkey = 3) AND NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey = 30)")
q("sub_exists_residual", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_shipdate > o.o_orderdate AND l.l_quantity <> 10)")
q("sub_exists_group", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT o_orderstatus FROM orders WHERE o_custkey = c_custkey GROUP BY o_orderstatus HAVING count(*) > 5)")
q("sub_correlated_scalar", "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30) AS big FROM orders")
q("sub_count_bug", "SELECT c_custkey FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000) = 0")
q("sub_correlated_compare", "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity > (SELECT 1.4 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey)")
q("sub_correlated_in", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN (SELECT l_linestatus FROM lineitem WHERE l_orderkey = o_orderkey)")
q("sub_correlated_not_in", "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN (SELECT l_linestatus FROM lineitem WHERE l_orderkey = o_orderkey)")
q("sub_correlated_order_by", "SELECT n_nationkey, n_name FROM nation ORDER BY (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) DESC, n_nationkey LIMIT 7")
q("sub_two_values", "SELECT c_custkey FROM customer WHERE (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) > 3 * (SELECT avg(o_totalprice) FROM orders WHERE o_custkey = c_custkey)")
q("sub_aggregate_argument", "SELECT CAST(sum((SELECT count(*) FROM orders WHERE o_custkey = c_custkey)) AS BIGINT) AS n FROM customer")
q("sub_nested_in", "SELECT s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000))")
q("sub_between_values", "SELECT count(*) AS n FROM orders WHERE o_totalprice BETWEEN (SELECT avg(o_totalprice) FROM orders) AND (SELECT max(o_totalprice) * 0.9 FROM orders)")
q("block_derived_columns", "SELECT k, v FROM (SELECT n_regionkey, count(*) FROM nation GROUP BY n_regionkey) AS s(k, v) WHERE v > 4")
q("block_with", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), top AS (SELECT max(t) AS m FROM big) SELECT o_custkey, round(t, 2) AS t FROM big, top WHERE t > m * 0.8")
q("block_with_twice", "WITH s(k, n) AS (SELECT l_suppkey, count(*) FROM lineitem GROUP BY l_suppkey) SELECT a.k, a.n FROM s a WHERE a.n = (SELECT max(n) FROM s)")
q("block_nested_with", "SELECT * FROM (WITH r AS (SELECT r_regionkey AS k FROM region) SELECT k, count(*) AS n FROM r JOIN nation ON n_regionkey = k GROUP BY k) d WHERE k > 1")
