"""Rows of the inventory that need more than one statement over named tables, or that others touch only in passing."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.engine import Engine
from plumbline.functions import sem
from plumbline.operators import window
from plumbline.plans.registry import register
from plumbline.plans.text import sql_query as q
from plumbline.session import prepared

register(
    "scan_path",
    lambda s, d: Engine(s).sql(f"SELECT n_name, nation.n_regionkey, r_name FROM '{d}/nation.parquet' JOIN '{d}/region.parquet' AS r ON n_regionkey = r.r_regionkey"),
    "SELECT n_name, nation.n_regionkey, r_name FROM nation JOIN region AS r ON n_regionkey = r.r_regionkey",
)


def _day_numbers(s, d):  # noqa: ANN001, ANN202
    engine = Engine(s)
    engine.register("numbered", f"{d}/nation.parquet", dates=("n_nationkey",))
    return engine.sql("SELECT n_name, n_nationkey AS day, EXTRACT(dow FROM n_nationkey) AS dow, n_nationkey > DATE '1970-01-10' AS late FROM numbered")


register("scan_day_numbers", _day_numbers, "SELECT n_name, DATE '1970-01-01' + n_nationkey AS day, EXTRACT(dow FROM DATE '1970-01-01' + n_nationkey) AS dow, DATE '1970-01-01' + n_nationkey > DATE '1970-01-10' AS late FROM nation")

q("scan_comments", "SELECT /* block -- comment */ n_name, n_nationkey FROM nation WHERE n_regionkey = 1 /* all; of it */ ;")
_NAN = "CASE WHEN n_regionkey = 0 THEN CAST('NaN' AS DOUBLE) WHEN n_regionkey = 1 THEN CAST('-Infinity' AS DOUBLE) WHEN n_regionkey = 2 THEN CAST('Infinity' AS DOUBLE) ELSE n_nationkey * 1.0e0 END"
q("pred_nan", f"SELECT n_nationkey, x = CAST('NaN' AS DOUBLE) AS a, x > 1e308 AS b, x < 5 AS c, x <> x AS d, x BETWEEN 0 AND CAST('Infinity' AS DOUBLE) AS e, x IN (1, CAST('NaN' AS DOUBLE)) AS f FROM (SELECT n_nationkey, {_NAN} AS x FROM nation) AS t WHERE x > -5 OR n_nationkey > 3")
q("agg_nan_keys", f"SELECT isnan(x) AS k, count(*) AS n, min(n_nationkey) AS lo, count(DISTINCT x) AS m FROM (SELECT n_nationkey, {_NAN} AS x FROM nation) AS t GROUP BY x")
q("agg_zero_keys", "SELECT x = 0 AS zero, count(*) AS n FROM (SELECT CASE WHEN n_regionkey = 0 THEN -0.0e0 ELSE 0.0e0 END AS x FROM nation) AS t GROUP BY x")
q("sort_nan", f"SELECT n_nationkey FROM (SELECT n_nationkey, {_NAN} AS x FROM nation) AS t ORDER BY x DESC, n_nationkey LIMIT 8")
q("sub_cast_correlated", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = CAST(o_totalprice / 60000 AS INTEGER))")
q("sub_having_correlated", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey HAVING count(*) > (SELECT CAST(r_regionkey * 1.5e0 AS INTEGER) FROM region WHERE r_regionkey = n_regionkey)")
q("sub_lateral", "SELECT r_name, x.n, x.last FROM region, LATERAL (SELECT count(*) AS n, max(n_name) AS last FROM nation WHERE n_regionkey = r_regionkey) AS x")
q("sub_exists_limit", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 LIMIT 1) AND c_acctbal < 0")
q("sub_not_in_or", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) OR c_nationkey NOT IN (SELECT NULLIF(s_nationkey, 3) FROM supplier)")
q("select_alias_in_cast", "SELECT l_orderkey, l_linenumber, l_extendedprice / 1000 AS k, CAST(k AS INTEGER) AS r FROM lineitem")
q("fn_regexp_computed", "SELECT p_partkey, regexp_replace(p_name, substring(p_type, 1, 1), '<\\0>') AS a, regexp_replace(p_name, concat('[', substring(p_brand, 1, 3), 'e]'), substring(p_type, 1, 2), 'g') AS b FROM part")
q("pred_like_computed", "SELECT count(*) AS n FROM part WHERE p_name LIKE concat('%', substring(p_type, 2, 2), '%') OR p_name NOT LIKE concat(p_brand, '\\%')")
q("fn_case_mapping", "SELECT upper(x) AS a, lower(x) AS b FROM (SELECT concat(n_name, 'ﬁŉǰ ΑΣ İ ᾳß') AS x FROM nation) AS t")
q("group_rollup_empty", "SELECT l_returnflag, l_linestatus, GROUPING(l_returnflag, l_linestatus) AS g, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem WHERE l_quantity < 0 GROUP BY ROLLUP (l_returnflag, l_linestatus)")
q("group_cube_empty", "SELECT o_orderstatus AS s, count(*) AS n FROM orders WHERE o_totalprice < 0 GROUP BY CUBE (o_orderstatus) ORDER BY GROUPING(o_orderstatus), s LIMIT 3")
q("group_sets_empty", "SELECT n_regionkey, n_name, max(n_nationkey) AS m FROM nation WHERE n_nationkey > 1000 GROUP BY GROUPING SETS ((n_regionkey, n_name), (n_regionkey), ()) HAVING count(*) < 10")
q("win_filter", "SELECT o_orderkey, count(*) FILTER (WHERE o_totalprice > 100000) OVER (PARTITION BY o_custkey) AS n, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS t FROM orders")
q("win_everything", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / sum(l_extendedprice) OVER (), 12) AS share, count(*) OVER () AS n, count(*) FILTER (WHERE l_quantity > 25) OVER () AS many, max(l_shipdate) OVER () AS last FROM lineitem WHERE l_discount > 0.02")
q("win_nth_value", "SELECT event_id, nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second, lag(NULLIF(event_type, 'click') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events")
register(
    "df_case_and_sums",
    lambda s, d: (lambda t: t.groupBy(sem.upper("x").alias("u"), sem.lower("x").alias("l")).agg(sem.sum_int(F.col("n_nationkey").cast("long") * 300000000000000000).cast("string").alias("s")))(prepared(s).read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.concat(F.lit("ﬁß İΑΣ "), F.col("n_regionkey").cast("string")).alias("x"))),
    "SELECT upper(x) AS u, lower(x) AS l, CAST(sum(CAST(n_nationkey AS BIGINT) * 300000000000000000) AS VARCHAR) AS s FROM (SELECT n_nationkey, concat('ﬁß İΑΣ ', CAST(n_regionkey AS VARCHAR)) AS x FROM nation) AS t GROUP BY 1, 2",
)
register(
    "df_whole_table",
    lambda s, d: window.whole_table(prepared(s).read.parquet(f"{d}/orders.parquet").select("o_orderkey"), hi=F.max("o_orderkey"), n=F.count("*")),
    "SELECT o_orderkey, max(o_orderkey) OVER () AS hi, count(*) OVER () AS n FROM orders",
)
register(
    "df_global_ranks",
    lambda s, d: window.global_ranks(prepared(s).read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p")), ["-p", "o_orderstatus"]).withColumns({"percent_rank": F.round("percent_rank", 10), "cume_dist": F.round("cume_dist", 10)}),
    "SELECT o_orderkey, o_orderstatus, p, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, round(percent_rank() OVER w, 10) AS percent_rank, round(cume_dist() OVER w, 10) AS cume_dist FROM (SELECT o_orderkey, o_orderstatus, NULLIF(o_orderpriority, '5-LOW') AS p FROM orders) AS t WINDOW w AS (ORDER BY p DESC, o_orderstatus)",
)
