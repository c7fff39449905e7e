"""Window functions, sorting and top-N."""

from __future__ import annotations

from plumbline.plans.text import sql_query as q

q("win_whole_partition", "SELECT o_orderkey, o_orderstatus, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_orderstatus), 10) AS share, count(*) OVER (PARTITION BY o_orderstatus) AS n, max(o_totalprice) OVER () AS hi FROM orders")
q("win_over_groups", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY l_returnflag) AS BIGINT) AS of FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10")
q("win_variance", "SELECT n_nationkey, round(stddev_samp(n_nationkey) OVER (PARTITION BY n_regionkey), 8) AS s, round(avg(n_nationkey) OVER (PARTITION BY n_regionkey), 8) AS a FROM nation")
q("win_rank", "SELECT s_suppkey, RANK() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS r, RANK() OVER (ORDER BY NULLIF(s_nationkey, 3) NULLS FIRST, s_suppkey) AS f, RANK() OVER (ORDER BY NULLIF(s_nationkey, 3), s_suppkey) AS l FROM supplier")
q("win_rank_unordered", "SELECT n_nationkey, RANK() OVER () AS r FROM nation")
q("win_rank_top", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, RANK() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) t WHERE r <= 2")
q("win_running", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS t, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS lo FROM orders")
q("win_row_number", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, dense_rank() OVER (ORDER BY event_type) AS dr, ntile(4) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS q FROM events")
q("win_percent", "SELECT n_nationkey, round(percent_rank() OVER (ORDER BY n_regionkey), 10) AS p, round(cume_dist() OVER (ORDER BY n_regionkey), 10) AS c FROM nation")
q("win_lag_lead", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, lead(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events")
q("win_range_default", "SELECT n_nationkey, CAST(sum(n_nationkey) OVER (ORDER BY n_regionkey) AS BIGINT) AS s FROM nation")
q("win_frame_bounds", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS a FROM events")
q("win_named", "SELECT n_nationkey, CAST(sum(n_nationkey) OVER w AS BIGINT) AS s, count(*) OVER w AS n FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)")
q("sort_nulls_last", "SELECT NULLIF(n_regionkey, 2) AS k, n_nationkey FROM nation ORDER BY k DESC, n_nationkey DESC LIMIT 22")
q("sort_nulls_first", "SELECT NULLIF(n_regionkey, 2) AS k, n_nationkey FROM nation ORDER BY k NULLS FIRST, n_nationkey LIMIT 8")
q("sort_hidden_key", "SELECT n_name FROM nation ORDER BY n_regionkey DESC, n_nationkey * -1 LIMIT 9")
q("topn_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 25")
q("topn_offset_first", "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 5 LIMIT 10")
q("topn_groups", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 10")
q("topn_wide", "SELECT * FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 15")
q("limit_zero", "SELECT count(*) AS n FROM orders LIMIT 0")
