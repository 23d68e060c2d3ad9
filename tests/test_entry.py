import re

import __spark_entry__ as entry
from spanmeter.functions.exprs import age_text, ms_text, to_ms
from spanmeter.sources.history import is_fresh, is_stale

SF = "/root/testdata/sf0.001"
AVOIDED = re.compile(r"CartesianProduct|BroadcastNestedLoopJoin|SinglePartition|EvalPython")


def test_every_sql_belongs_to_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100
    own = {n for n in queries if not re.match(r"op\d+_|pipeline$", n)}
    assert own - set(sql) == {"signals_all"}


def test_flagship_query(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["trace_id", "detector", "location"] and df.count() > 0


def test_plans_have_no_cross_join_and_no_python(spark):
    for name in ("anr", "frame_jank", "sittings", "session_gaps", "report_summary", "name_map"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not AVOIDED.search(plan), name


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    from pyspark.sql import functions as F

    from spanmeter.functions.exprs import glob
    spark.range(10).select(F.col("id"), F.concat(F.lit("binder "), F.col("id")).alias("name"),
                           F.lit(1).alias("unused")).write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s")).where(glob("name", "binder 7*")).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(name,binder 7)" in plan and "unused" not in plan
    assert [r.id for r in df.collect()] == [7]


def test_small_text_functions(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(5,), (100,), (7000,), (200000,)], "s long")
    assert [r[0] for r in df.select(age_text(F.col("s"))).collect()] == [
        "5s ago", "1m ago", "2h ago", "2d ago"]
    n = spark.createDataFrame([(5000,), (-5000,), (12_345_678_900_000_000,)], "n long")
    assert [(r[0], r[1]) for r in n.select(to_ms("n"), ms_text("n")).collect()] == [
        (0.01, "0.0"), (-0.01, "0.0"), (12345678900.0, "12345678900.0")]
    t = spark.sql("select timestamp'2026-01-08 00:00:00' now, timestamp'2026-01-01 00:00:00' old")
    assert t.select(is_stale(F.col("old"), F.col("now")), is_fresh(F.col("old"), F.col("now"))).first() \
        == (True, False)
