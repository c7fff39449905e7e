"""Scans, projections, filters and predicates."""

from __future__ import annotations

from plumbline.plans.text import sql_query as q

q("scan_projection", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-04-01 00:00:00'")
q("scan_star_twice", "SELECT n.*, r.r_name, n.n_name AS again FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
q("scan_row_count", "SELECT count(*) AS n FROM lineitem")
q("scan_count_empty", "SELECT count(*) AS n, count(l_orderkey) AS k, min(l_quantity) AS low FROM lineitem WHERE l_quantity < 0")
q("scan_quoted_names", 'SELECT o."o_orderkey" AS "key", o.o_totalprice AS "total price" FROM orders AS o WHERE "o"."o_orderkey" < 100')
q("scan_in_or_pushdown", "SELECT count(*) AS n FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 100000) OR (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
q("pred_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%e%' AND p_type NOT LIKE 'S%' AND p_brand LIKE 'Brand#_1'")
q("pred_like_backslash", r"SELECT count(*) AS n, count(CASE WHEN concat(p_brand, '\x') LIKE '%\x' THEN 1 END) AS m FROM part")
q("pred_in_list", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey NOT IN (1, 2, 3, 32)")
q("pred_in_null", "SELECT count(*) AS n FROM nation WHERE n_nationkey NOT IN (1, NULL) OR n_nationkey IN (2, NULL)")
q("pred_between", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem WHERE l_discount BETWEEN 0.03 AND 0.05 AND l_quantity NOT BETWEEN 10 AND 20")
q("pred_is_null", "SELECT NULLIF(n_regionkey, 2) AS k, n_name FROM nation WHERE NULLIF(n_regionkey, 2) IS NULL OR NULLIF(n_regionkey, 3) IS NOT NULL")
q("pred_distinct_from", "SELECT n_name FROM nation WHERE NULLIF(n_regionkey, 1) IS DISTINCT FROM NULLIF(n_regionkey, 2) AND NULLIF(n_regionkey, 3) IS NOT DISTINCT FROM n_regionkey")
q("pred_three_valued", "SELECT n_nationkey, CASE WHEN NOT (NULLIF(n_regionkey, 1) > 2 AND n_nationkey > 10) THEN 1 ELSE 0 END AS a, CASE WHEN NULLIF(n_regionkey, 1) > 2 OR n_nationkey > 10 THEN 1 ELSE 0 END AS b FROM nation")
q("pred_reversed_literals", "SELECT count(*) AS n FROM lineitem WHERE 25 < l_quantity AND 0.05 >= l_discount AND 3 <> l_linenumber")
q("pred_exact_literals", "SELECT count(*) AS n FROM orders WHERE o_orderkey > 1.5 AND o_custkey < 1000000000000 AND o_orderkey <> 7.5")
q("pred_column_columns", "SELECT count(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_shipdate > o.o_orderdate AND l.l_extendedprice < o.o_totalprice")
q("select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
q("select_distinct_expression", "SELECT DISTINCT o_orderkey % 7 AS m, NULLIF(o_orderstatus, 'F') AS s FROM orders")
q("constant_rows", "SELECT 1 AS a, 'x''y' AS b, CAST(NULL AS BIGINT) AS c, CAST(1.5 AS DOUBLE) AS d, DATE '2020-02-29' AS e")
