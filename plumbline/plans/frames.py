"""Queries built with the DataFrame operators, each beside the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import sem
from plumbline.operators import agg, joins, setops, topn, window
from plumbline.plans.registry import register
from plumbline.session import prepared
from plumbline.streaming import events as stream


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _nullable_regions(spark: SparkSession, d: str, at: int) -> DataFrame:
    return _t(spark, d, "region").select(F.nullif(F.col("r_regionkey"), F.lit(at)).alias("k"))


register(
    "df_mark_join",
    lambda s, d: joins.mark(_t(s, d, "nation").select("n_nationkey"), _nullable_regions(s, d, 1), "n_nationkey", "k"),
    "SELECT n_nationkey, n_nationkey IN (SELECT NULLIF(r_regionkey, 1) FROM region) AS mark FROM nation",
)
register(
    "df_null_aware_anti",
    lambda s, d: joins.null_aware_anti(_t(s, d, "nation").select("n_nationkey", "n_name"), _nullable_regions(s, d, 99), "n_nationkey", "k"),
    "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(r_regionkey, 99) FROM region)",
)
register(
    "df_one_row",
    lambda s, d: joins.one_row(_t(s, d, "nation").select("n_name"), _t(s, d, "region").agg(F.max("r_regionkey").alias("m"))),
    "SELECT n_name, (SELECT max(r_regionkey) FROM region) AS m FROM nation",
)
register(
    "df_theta_join",
    lambda s, d: joins.theta(_t(s, d, "nation").select("n_nationkey"), _t(s, d, "region").select("r_regionkey"), F.col("n_nationkey") < F.col("r_regionkey"), "left"),
    "SELECT n_nationkey, r_regionkey FROM nation LEFT JOIN region ON n_nationkey < r_regionkey",
)
register(
    "df_null_equal_join",
    lambda s, d: joins.join(_t(s, d, "nation").select(F.nullif("n_regionkey", F.lit(1)).alias("a"), "n_name"), _nullable_regions(s, d, 1), [("a", "k")], null_equal=True),
    "SELECT a, n_name, k FROM (SELECT NULLIF(n_regionkey, 1) AS a, n_name FROM nation) n JOIN (SELECT NULLIF(r_regionkey, 1) AS k FROM region) r ON a IS NOT DISTINCT FROM k",
)
register(
    "df_salted_join",
    lambda s, d: joins.salted(_t(s, d, "events").select("event_type", "event_id"), _t(s, d, "events").groupBy("event_type").agg(F.max("event_id").alias("last")), "event_type", 8),
    "SELECT e.event_type, e.event_id, m.last FROM events e JOIN (SELECT event_type, max(event_id) AS last FROM events GROUP BY event_type) m ON e.event_type = m.event_type",
)
register(
    "df_rollup",
    lambda s, d: agg.rollup(_t(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], [F.count("*").alias("n"), sem.sum_int("l_linenumber").cast("long").alias("s")], "g"),
    "SELECT l_returnflag, l_linestatus, GROUPING(l_returnflag, l_linestatus) AS g, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
)
register(
    "df_rollup_empty",
    lambda s, d: agg.rollup(_t(s, d, "lineitem").filter("l_quantity < 0"), ["l_returnflag"], [F.count("*").alias("n")]),
    "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity < 0 GROUP BY ROLLUP (l_returnflag)",
)
register(
    "df_cube",
    lambda s, d: agg.cube(_t(s, d, "orders"), ["o_orderstatus", "o_orderpriority"], [F.count("*").alias("n"), F.round(sem.avg_num("o_totalprice"), 4).alias("a")], "g"),
    "SELECT o_orderstatus, o_orderpriority, GROUPING(o_orderstatus, o_orderpriority) AS g, count(*) AS n, round(avg(o_totalprice), 4) AS a FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
)
register(
    "df_grouping_sets_repeated",
    lambda s, d: agg.grouping_sets(_t(s, d, "nation"), [("n_regionkey",), ("n_regionkey",), ()], [F.count("*").alias("n")]),
    "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY GROUPING SETS ((n_regionkey), (n_regionkey), ())",
)
register(
    "df_grouping_sets_crossed",
    lambda s, d: agg.grouping_sets(_t(s, d, "lineitem"), agg.crossed([("l_returnflag",)], agg.rollup_sets("l_linestatus"), agg.cube_sets("l_linenumber")), [F.count("*").alias("n")]),
    "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_returnflag, ROLLUP (l_linestatus), CUBE (l_linenumber)",
)
register(
    "df_count_distinct_two_level",
    lambda s, d: agg.count_distinct_two_level(_t(s, d, "events"), ["event_type"], "user_id", "u"),
    "SELECT event_type, count(DISTINCT user_id) AS u FROM events GROUP BY event_type",
)
register(
    "df_aggregate_below_join",
    lambda s, d: agg.aggregate_below_join(_t(s, d, "orders"), _t(s, d, "customer"), "o_custkey", "c_custkey", [F.count("*").alias("k")], ["c_mktsegment"], [F.sum("k").alias("n")]),
    "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
)
register(
    "df_sums_exact",
    lambda s, d: _t(s, d, "orders").groupBy("o_orderstatus").agg(sem.sum_int("o_orderkey").cast("long").alias("k"), sem.sum_dec(F.col("o_totalprice").cast("decimal(15,2)"), 2).cast("double").alias("t"), sem.avg_time("o_orderdate").alias("at")).withColumn("at", F.date_trunc("second", "at").cast("timestamp_ntz")),
    "SELECT o_orderstatus, CAST(sum(o_orderkey) AS BIGINT) AS k, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS t, date_trunc('second', avg(o_orderdate)) AS at FROM orders GROUP BY o_orderstatus",
)
register(
    "df_scalar_functions",
    lambda s, d: _t(s, d, "nation").select("n_nationkey", sem.substr("n_name", F.col("n_nationkey") - 5, F.col("n_regionkey") - 1).alias("a"), sem.substr("n_name", -3).alias("b"), sem.regexp_first("n_name", "([A-Z])([A-Z])", "\\2\\1").alias("c"), sem.concat_skip("n_name", F.lit("-"), F.nullif("n_regionkey", F.lit(1))).alias("d"), sem.strlen("n_name").alias("e"), sem.div("n_nationkey", "n_regionkey").alias("f"), sem.idiv(F.col("n_nationkey") - 12, F.lit(5)).alias("g"), sem.cast_int((F.col("n_nationkey") - 12) * 0.5).alias("h")).filter("n_nationkey > 0"),
    "SELECT n_nationkey, substring(n_name, n_nationkey - 5, n_regionkey - 1) AS a, substr(n_name, -3) AS b, regexp_replace(n_name, '([A-Z])([A-Z])', '\\2\\1') AS c, concat(n_name, '-', NULLIF(n_regionkey, 1)) AS d, strlen(n_name) AS e, n_nationkey / n_regionkey AS f, CAST((n_nationkey - 12) // 5 AS BIGINT) AS g, CAST((n_nationkey - 12) * 0.5e0 AS INTEGER) AS h FROM nation WHERE n_nationkey > 0",
)
register(
    "df_set_operations",
    lambda s, d: setops.union_all(setops.intersect(_t(s, d, "nation").select("n_regionkey"), _nullable_regions(s, d, 2), every=True), setops.difference(_t(s, d, "nation").select("n_regionkey"), _nullable_regions(s, d, 2)), setops.union(_nullable_regions(s, d, 2), _nullable_regions(s, d, 3))),
    "(SELECT n_regionkey FROM nation INTERSECT ALL SELECT NULLIF(r_regionkey, 2) FROM region) UNION ALL (SELECT n_regionkey FROM nation EXCEPT SELECT NULLIF(r_regionkey, 2) FROM region) UNION ALL (SELECT NULLIF(r_regionkey, 2) FROM region UNION SELECT NULLIF(r_regionkey, 3) FROM region)",
)
register(
    "df_windows",
    lambda s, d: _t(s, d, "orders").select("o_orderkey", window.rank(["o_custkey"], ["-o_totalprice", "o_orderkey"]).alias("r"), F.round(window.running(F.sum("o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"]), 2).alias("t"), window.whole(F.count("*"), ["o_orderstatus"]).alias("n"), window.rank().alias("one")),
    "SELECT o_orderkey, RANK() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS t, count(*) OVER (PARTITION BY o_orderstatus) AS n, RANK() OVER () AS one FROM orders",
)
register(
    "df_top_n_by_group",
    lambda s, d: window.top_n_by(_t(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["-o_totalprice", "o_orderkey"], 2),
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 2",
)
register(
    "df_late_top_n",
    lambda s, d: topn.late_top(_t(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["-l_extendedprice", "l_orderkey", "l_linenumber"], 15),
    "SELECT * FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 15",
)
register(
    "df_top_offset",
    lambda s, d: topn.top(_t(s, d, "orders").select("o_orderkey"), ["-o_orderkey"], 10, 5),
    "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 10 OFFSET 5",
)
register(
    "df_event_windows",
    lambda s, d: stream.windowed(_t(s, d, "events"), "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("v", 4).alias("v")),
    "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2",
)
