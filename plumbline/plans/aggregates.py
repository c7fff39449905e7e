"""Aggregation, DISTINCT, HAVING and grouping sets."""

from __future__ import annotations

from plumbline.plans.text import sql_query as q

q("agg_global", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, round(avg(l_quantity), 6) AS a, min(l_shipdate) AS lo, max(l_extendedprice) AS hi FROM lineitem")
q("agg_count_null", "SELECT n_regionkey, count(*) AS n, count(NULLIF(n_nationkey, n_regionkey)) AS m FROM nation GROUP BY n_regionkey")
q("agg_null_key", "SELECT NULLIF(n_regionkey, 2) AS k, count(*) AS n, min(n_name) AS lo, max(n_name) AS hi FROM nation GROUP BY NULLIF(n_regionkey, 2)")
q("agg_sum_types", "SELECT l_returnflag, CAST(sum(l_orderkey) AS BIGINT) AS a, round(sum(l_extendedprice), 2) AS b, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS c FROM lineitem GROUP BY l_returnflag")
q("agg_sum_beyond_bigint", "SELECT CAST(sum(o_orderkey * 100000000000000) AS VARCHAR) AS s, CAST(sum(-o_orderkey * 100000000000000) AS VARCHAR) AS t, count(*) AS n FROM orders")
q("agg_avg_types", "SELECT l_linestatus, round(avg(l_linenumber), 8) AS a, round(avg(l_tax), 8) AS b, round(avg(CAST(l_extendedprice AS DECIMAL(12,2))), 4) AS c FROM lineitem GROUP BY l_linestatus")
q("agg_avg_time", "SELECT event_type, date_trunc('second', avg(ts)) AS t FROM events GROUP BY event_type")
q("agg_variance", "SELECT event_type, round(stddev(value), 6) AS a, round(stddev_pop(value), 6) AS b, round(variance(value), 4) AS c, round(var_pop(value), 4) AS d, round(stddev_samp(value), 6) AS e, round(var_samp(value), 4) AS f FROM events GROUP BY event_type")
q("agg_variance_single", "SELECT n_nationkey, stddev(n_regionkey) AS a, stddev_pop(n_regionkey) AS b, var_samp(n_regionkey) AS c FROM nation GROUP BY n_nationkey")
q("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS a, count(DISTINCT l_partkey) AS b, count(*) AS n FROM lineitem GROUP BY l_returnflag")
q("agg_count_distinct_global", "SELECT count(DISTINCT o_custkey) AS a, count(DISTINCT NULLIF(o_orderstatus, 'F')) AS b FROM orders")
q("agg_distinct_skewed", "SELECT event_type, count(DISTINCT user_id) AS u, count(DISTINCT date_trunc('hour', ts)) AS h FROM events GROUP BY event_type")
q("agg_min_max_text", "SELECT lang, min(text) AS lo, max(text) AS hi, max(strlen(text)) AS longest FROM documents GROUP BY lang")
q("agg_expression_arguments", "SELECT l_shipdate, round(sum(l_extendedprice * (1 - l_discount)), 4) AS r, max(l_linenumber * 2 + 1) AS m FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01 00:00:00' GROUP BY l_shipdate")
q("agg_many_sums", "SELECT " + ", ".join(f"CAST(sum(l_linenumber + {i}) AS BIGINT) AS s{i}" for i in range(30)) + " FROM lineitem")
q("agg_dependent_keys", "SELECT o_custkey, o_custkey + 1 AS k1, o_custkey * 2 AS k2, count(*) AS n FROM orders GROUP BY o_custkey, o_custkey + 1, o_custkey * 2")
q("group_by_position_alias", "SELECT substring(o_orderpriority, 1, 1) AS p, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY p, 2")
q("group_by_constant", "SELECT 'all' AS k, count(*) AS n FROM orders GROUP BY 1")
q("group_by_empty", "SELECT count(*) AS n, max(o_orderkey) AS m FROM orders GROUP BY ()")
q("group_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
q("group_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, GROUPING(o_orderstatus) AS g1, GROUPING(o_orderstatus, o_orderpriority) AS g2 FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
q("group_sets", "SELECT r_name, n_name, count(*) AS n, GROUPING_ID(r_name, n_name) AS g FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name, n_name), (r_name), ())")
q("group_sets_combined", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_returnflag, ROLLUP (l_linestatus), CUBE (l_linenumber)")
q("group_sets_null_values", "SELECT NULLIF(o_orderstatus, 'F') AS s, GROUPING(NULLIF(o_orderstatus, 'F')) AS g, count(*) AS n FROM orders GROUP BY ROLLUP (NULLIF(o_orderstatus, 'F'))")
q("having_alias", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY o_custkey HAVING n > 3 AND sum(o_totalprice) > 500000")
q("having_hidden_aggregate", "SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING max(l_quantity) = 50 AND avg(l_discount) > 0.04")
q("having_without_groups", "SELECT count(*) AS n FROM orders HAVING count(*) > 10")
