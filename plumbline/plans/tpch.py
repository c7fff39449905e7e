"""The decision-support queries that the tables at hand allow, re-expressed where a column is missing."""

from __future__ import annotations

from plumbline.plans.text import sql_query as q

REV = "l_extendedprice * (1 - l_discount)"
q("tpch_q01_pricing_summary", f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum({REV}), 4) AS sum_disc,
  round(sum({REV} * (1 + l_tax)), 6) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-08-02 00:00:00' GROUP BY l_returnflag, l_linestatus""")
q("tpch_q02_cheapest_supplier", """WITH offers AS (SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS cost FROM lineitem GROUP BY l_partkey, l_suppkey)
  SELECT p_partkey, s_suppkey, n_name, round(cost, 9) AS cost FROM part JOIN offers o ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE p_size < 20 AND r_name = 'EUROPE' AND cost = (SELECT min(i.cost) FROM offers i JOIN supplier ON s_suppkey = i.l_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE i.l_partkey = o.l_partkey AND r_name = 'EUROPE')""")
q("tpch_q03_shipping_priority", f"""SELECT l_orderkey, round(sum({REV}), 4) AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
  AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""")
q("tpch_q04_order_priority", """SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-10-01 00:00:00'
  AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority""")
q("tpch_q05_local_supplier", f"""SELECT n_name, round(sum({REV}), 4) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey
  AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY n_name""")
q("tpch_q06_forecast", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
q("tpch_q07_volume", f"""SELECT supp, cust, y, round(sum(volume), 4) AS revenue FROM (SELECT n1.n_name AS supp, n2.n_name AS cust, EXTRACT(year FROM l_shipdate) AS y, {REV} AS volume FROM supplier, lineitem, orders, customer, nation n1, nation n2
  WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND n1.n_regionkey = 2 AND n2.n_regionkey = 3) v GROUP BY supp, cust, y""")
q("tpch_q08_market_share", f"""SELECT y, round(sum(CASE WHEN n = 'CHINA' THEN volume ELSE 0 END) / sum(volume), 8) AS share FROM (SELECT EXTRACT(year FROM o_orderdate) AS y, {REV} AS volume, n2.n_name AS n FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
  WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND r_name = 'ASIA' AND s_nationkey = n2.n_nationkey) a GROUP BY y""")
q("tpch_q09_profit", f"""SELECT n_name, EXTRACT(year FROM o_orderdate) AS y, round(sum({REV} - 0.6 * p_retailprice * l_quantity), 4) AS profit FROM part, supplier, lineitem, orders, nation
  WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%e%' GROUP BY n_name, y""")
q("tpch_q10_returned", f"""SELECT c_custkey, c_name, round(sum({REV}), 4) AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey
  AND o_orderdate >= TIMESTAMP '1996-10-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-10-01 00:00:00' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
q("tpch_q11_important_stock", """SELECT l_partkey, round(sum(l_extendedprice), 2) AS value FROM lineitem, supplier, nation WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = 1
  GROUP BY l_partkey HAVING sum(l_extendedprice) > (SELECT sum(l_extendedprice) * 0.0008 FROM lineitem, supplier, nation WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = 1)""")
q("tpch_q12_priority_counts", """SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY l_linestatus""")
q("tpch_q13_order_counts", "SELECT c_count, count(*) AS n FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%LOW%' GROUP BY c_custkey) c GROUP BY c_count")
q("tpch_q14_promotion", f"SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REV} ELSE 0 END) / sum({REV}), 8) AS share FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1997-09-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-12-01 00:00:00'")
q("tpch_q15_top_supplier", f"""WITH revenue AS (SELECT l_suppkey AS k, round(sum({REV}), 4) AS total FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-04-01 00:00:00' GROUP BY l_suppkey)
  SELECT s_suppkey, s_name, total FROM supplier, revenue WHERE s_suppkey = k AND total = (SELECT max(total) FROM revenue)""")
q("tpch_q16_part_suppliers", """SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS n FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand <> 'Brand#45' AND p_size IN (1, 4, 7, 14, 23, 36, 45, 49)
  AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size""")
q("tpch_q17_small_orders", "SELECT round(sum(l_extendedprice) / 7.0, 4) AS yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_size < 25 AND l_quantity < (SELECT 0.4 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey)")
q("tpch_q18_large_orders", """SELECT c_name, c_custkey, o_orderkey, o_totalprice, round(sum(l_quantity), 2) AS q FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 220)
  AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, c_custkey, o_orderkey, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
q("tpch_q19_discounted", f"""SELECT round(sum({REV}), 4) AS revenue FROM lineitem, part WHERE (p_partkey = l_partkey AND p_size BETWEEN 1 AND 5 AND l_quantity BETWEEN 1 AND 11) OR (p_partkey = l_partkey AND p_size BETWEEN 6 AND 10 AND l_quantity BETWEEN 10 AND 20)
  OR (p_partkey = l_partkey AND p_size BETWEEN 11 AND 15 AND l_quantity BETWEEN 20 AND 30)""")
q("tpch_q20_promotion_suppliers", """SELECT s_name FROM supplier, nation WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem o WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 15)
  AND l_quantity > (SELECT 0.9 * max(l_quantity) FROM lineitem i WHERE i.l_partkey = o.l_partkey AND i.l_suppkey = o.l_suppkey)) AND s_nationkey = n_nationkey AND n_regionkey < 3""")
q("tpch_q21_waiting", """SELECT s_name, count(*) AS n FROM supplier, lineitem l1, orders, nation WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate
  AND EXISTS (SELECT * FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) AND NOT EXISTS (SELECT * FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_quantity > l1.l_quantity)
  AND s_nationkey = n_nationkey AND n_regionkey = 3 GROUP BY s_name""")
q("tpch_q22_opportunity", """SELECT code, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM (SELECT substring(c_name, 16, 2) AS code, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)
  AND NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)) c GROUP BY code""")
q("ds_channel_growth", """WITH y AS (SELECT o_custkey AS c, EXTRACT(year FROM o_orderdate) AS y, sum(o_totalprice) AS t FROM orders GROUP BY 1, 2)
  SELECT a.c, round(b.t / a.t, 6) AS growth FROM y a JOIN y b ON a.c = b.c AND b.y = a.y + 1 WHERE a.y = 1996 AND a.t > 0 AND b.t / a.t > 1.5""")
q("ds_ratio_to_class", """SELECT p_brand, p_type, round(sum(l_extendedprice), 2) AS rev, round(sum(l_extendedprice) * 100 / sum(sum(l_extendedprice)) OVER (PARTITION BY p_brand), 6) AS ratio FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 10 GROUP BY p_brand, p_type""")
q("ds_rank_rollup", """SELECT r_name, n_name, round(sum(c_acctbal), 2) AS t, GROUPING(r_name) + GROUPING(n_name) AS lochierarchy, RANK() OVER (PARTITION BY GROUPING(r_name) + GROUPING(n_name) ORDER BY round(sum(c_acctbal), 2) DESC) AS rk
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
q("ds_case_buckets", """SELECT CASE WHEN (SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20) > 1000 THEN (SELECT round(avg(l_tax), 6) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20) ELSE (SELECT round(avg(l_discount), 6) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20) END AS b1,
  CASE WHEN (SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN 21 AND 40) > 100000000 THEN 0.0e0 ELSE (SELECT round(avg(l_discount), 6) FROM lineitem WHERE l_quantity BETWEEN 21 AND 40) END AS b2""")
