import datetime
import io
import json
from decimal import Decimal

import pytest

from plumbline import __main__ as cli
from plumbline.engine import Engine
from plumbline.operators import agg, joins, setops, topn, window
from plumbline.sources import parquet_tables, sinks
from plumbline.streaming import events as stream


@pytest.fixture
def folder(spark, tmp_path):
    for i in (1, 2):
        spark.createDataFrame([(i, 19000 + i, 0.1)], "a long, day int, f float").coalesce(1).write.parquet(str(tmp_path / f"part_{i}"))
    return tmp_path


def test_register_patterns_dates_and_floats(spark, folder):
    engine = Engine(spark)
    df = engine.register("Things", f"{folder}/part_*", dates=("DAY",))
    assert engine.schema("things") == [("a", "BIGINT"), ("day", "DATE"), ("f", "DOUBLE")]
    assert sorted(r.a for r in engine.sql("SELECT a FROM THINGS").collect()) == [1, 2]
    assert engine.sql("SELECT max(day) AS d FROM things").first().d == datetime.date(1970, 1, 1) + datetime.timedelta(19002)
    assert df.filter("f = cast(cast(0.1 as float) as double)").count() == 2
    assert engine.sql(f"SELECT count(*) AS n FROM '{folder}/part_*' p WHERE p.a > 1").first().n == 1


def test_schemas_must_be_the_same(spark, folder):
    spark.createDataFrame([("x",)], "a string").write.parquet(str(folder / "part_3"))
    with pytest.raises(parquet_tables.SchemaMismatchError):
        Engine(spark).register("t", f"{folder}/part_*")
    with pytest.raises(FileNotFoundError):
        Engine(spark).register("t", f"{folder}/none_*")


def test_formats(spark):
    df = spark.createDataFrame([(1, "a,b", 0.1, Decimal("1.50")), (None, None, float("nan"), None)], "i int, s string, d double, c decimal(5,2)").coalesce(1)
    assert list(sinks.csv_lines(df)) == ["i,s,d,c", '1,"a,b",0.1,1.50', ",,nan,"]
    assert [json.loads(x) for x in sinks.json_lines(df)] == [{"i": 1, "s": "a,b", "d": 0.1, "c": "1.50"}, {"i": None, "s": None, "d": "nan", "c": None}]
    out = io.StringIO()
    sinks.print_result(df, "table", out)
    assert out.getvalue().splitlines()[0] == "i    | s    | d   | c"


@pytest.mark.parametrize("form", ["parquet", "csv", "json"])
def test_written_results(spark, tmp_path, form):
    df = spark.range(3).selectExpr("id", "cast(id as decimal(38,0)) as c")
    sinks.write_result(df, str(tmp_path / "out"), form)
    assert spark.read.option("header", "true").format(form).load(str(tmp_path / "out")).count() == 3


def test_explain_and_bench(spark, sf_dir):
    engine = Engine(spark)
    engine.register("lineitem", f"{sf_dir}/lineitem.parquet")
    plan = engine.explain("SELECT l_orderkey FROM lineitem WHERE l_orderkey = 3")
    assert "PushedFilters: [IsNotNull(l_orderkey), EqualTo(l_orderkey,3)]" in plan and "ReadSchema: struct<l_orderkey:bigint>" in plan
    assert "seconds:" in engine.explain("SELECT count(*) AS n FROM lineitem", "analyze")
    good, bad = engine.bench(["SELECT 1 AS a", "SELECT nothing"], tries=2)
    assert all(t > 0 for t in good) and bad == [None, None]


def test_command_line(spark, sf_dir, capsys):
    table = f"nation={sf_dir}/nation.parquet"
    assert cli.main(["query", "-c", "SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 1", "--table", table, "--format", "csv"]) == 0
    assert capsys.readouterr().out.splitlines()[0] == "n_name"
    assert cli.main(["schema", "--table", table]) == 0
    assert "n_nationkey INTEGER" in capsys.readouterr().out
    assert cli.main(["query", "-c", "SELECT nothing FROM nation", "--table", table]) == 4
    assert cli.main(["version"]) == 0


# -- plans ----------------------------------------------------------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_need_no_python(spark, sf_dir):
    from plumbline.plans import REGISTRY

    for name, q in REGISTRY.items():
        assert "Python" not in plan_of(q.run(spark, sf_dir)), name


def test_top_n_sorts_nothing_in_full(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    assert "TakeOrderedAndProject" in plan_of(topn.top(df, ["-l_extendedprice"], 5))
    assert "WindowGroupLimit" in plan_of(window.top_n_by(df, ["l_suppkey"], ["-l_quantity"], 3))


def test_null_aware_anti_does_not_broadcast_rows(spark):
    a, b = spark.range(1000).toDF("x"), spark.range(5000).toDF("y")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = joins.null_aware_anti(a, b, "x", "y")
        assert "SortMergeJoin" in plan_of(df) and df.count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_join_helpers(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    b = spark.createDataFrame([(2,), (None,)], "y int")
    empty = b.filter("y > 9")
    marks = lambda r: {k.x: k.mark for k in joins.mark(a, r, "x", "y").collect()}
    assert marks(b) == {1: None, 2: True, None: None} and marks(empty) == {1: False, 2: False, None: False}
    assert joins.null_aware_anti(a, empty, "x", "y").count() == 3 and joins.null_aware_anti(a, b, "x", "y").count() == 0
    assert joins.semi(a, b, [("x", "y")]).count() == 1 and joins.anti(a, b, [("x", "y")]).count() == 2
    assert {r.y for r in joins.one_row(a, empty).collect()} == {None}
    with pytest.raises(Exception, match="more than one row"):
        joins.one_row(a, b).collect()
    with pytest.raises(ValueError):
        joins.salted(a, a, "x", how="full")


def test_metamorphic(spark, sf_dir):
    """A cube is the union of its groupings, split inputs make the whole, IN is EXISTS."""
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    count = [F.count("*").alias("n")]
    cube = agg.cube(df, ["o_orderstatus", "o_orderpriority"], count)
    by_hand = setops.union_all(
        df.groupBy("o_orderstatus", "o_orderpriority").agg(*count),
        df.groupBy("o_orderstatus").agg(*count).selectExpr("o_orderstatus", "cast(null as string)", "n"),
        df.groupBy("o_orderpriority").agg(*count).selectExpr("cast(null as string)", "o_orderpriority", "n"),
        df.agg(*count).selectExpr("cast(null as string)", "cast(null as string)", "n"),
    )
    assert setops.difference(cube, by_hand, every=True).count() == 0 and cube.count() == by_hand.count()
    halves = setops.union_all(df.filter("o_orderkey % 2 = 0"), df.filter("o_orderkey % 2 <> 0"))
    assert setops.difference(df, halves, every=True).count() == 0
    engine = Engine(spark)
    engine.register_frame("orders", df)
    engine.register("customer", f"{sf_dir}/customer.parquet")
    a = engine.sql("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
    b = engine.sql("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
    assert setops.difference(a, b, every=True).count() == 0 and a.count() == b.count()


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from pyspark.sql import functions as F

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.union(events.limit(50)).repartition(6).write.parquet(str(tmp_path / "in"))
    live = stream.first_of_each(stream.read_stream(spark, str(tmp_path / "in"), events.schema), late="40 days")
    stream.write_all(live, str(tmp_path / "out"), str(tmp_path / "state"))
    once = spark.read.schema(events.schema).parquet(str(tmp_path / "out"))
    assert once.count() == events.count() and setops.difference(once, events, every=True).count() == 0
    counts = stream.windowed(stream.read_stream(spark, str(tmp_path / "in"), events.schema), "1 day", late="1 hour")
    query = counts.writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT sum(n) AS n FROM daily").first().n == events.count() + 50
    assert stream.windowed(events, "1 day").agg(F.sum("n").alias("n")).first().n == events.count()
