"""Loaders keep ids as they are, and a single repeat keeps its rows."""

from pyspark.sql import functions as F

from spanmeter.operators.repeats import merge_repeats
from spanmeter.sources.readers import load_traces


def test_ids_in_folder_names_stay_text(spark, tmp_path):
    for name, ids in (("process", ["0012", "run-a"]), ("slice", ["0012", "0013"])):
        df = spark.createDataFrame([(i,) for i in ids], "trace_id string")
        if name == "slice":
            df = df.selectExpr("trace_id", "1L id", "0L ts", "5L dur", "'x' name")
        else:
            df = df.selectExpr("trace_id", "1 upid", "2 pid", "'p' name")
        df.write.partitionBy("trace_id").parquet(str(tmp_path / name))
    t = load_traces(spark, str(tmp_path))
    assert {r[0] for r in t.slice.select("trace_id").collect()} == {"0012", "0013"}
    assert t.slice.join(t.process, "trace_id").count() == 1
    noted = t.where_noted(spark.createDataFrame([("0013",)], "trace_id string"))
    assert [r[0] for r in noted.slice.select("trace_id").collect()] == ["0013"] and noted.process.count() == 0


def test_one_repeat_keeps_two_rows_of_one_identity(spark):
    from spanmeter.operators.repeats import METRICS
    rows = spark.createDataFrame(
        [("t1", "frame_jank", "app.Frame", "220 ms", 220.0), ("t1", "frame_jank", "app.Frame", "60 ms", 60.0)],
        "trace_id string, detector string, location string, detail string, v double")
    rows = rows.select("trace_id", "detector", "location", "detail", *[F.col("v").alias(m) for m in METRICS])
    traces = spark.createDataFrame([("t1", "s1", 1)], "trace_id string, scenario_id string, repeat_no int")
    got = sorted((r.detail, r[METRICS[0]], r.runs, r.spread) for r in merge_repeats(rows, traces).collect())
    assert got == [("220 ms", 220.0, None, None), ("60 ms", 60.0, None, None)]


def test_rows_without_a_time_are_counted(spark, tmp_path):
    from spanmeter.sources.readers import unplaced_rows
    spark.sql("SELECT * FROM VALUES ('t1', 1L, 0L, 5L), ('t1', 2L, NULL, 5L), ('t2', 3L, 4L, NULL), ('t2', 4L, 4L, -1L) "
              "AS t(trace_id, id, ts, dur)").write.partitionBy("trace_id").parquet(str(tmp_path / "slice"))
    spark.sql("SELECT 't1' trace_id, 1 utid, 0L ts, 5L dur, 'R' state").write.partitionBy("trace_id").parquet(
        str(tmp_path / "thread_state"))
    rejects = {}
    t = load_traces(spark, str(tmp_path), rejects)
    assert sorted(r.id for r in t.slice.collect()) == [1, 4] and t.thread_state.count() == 1
    assert rejects["slice"].get == {"read": 4, "rejected": 2} and rejects["thread_state"].get["rejected"] == 0
    got = {(r.trace_id, r.table): (r["rows"], r.rejected) for r in unplaced_rows(spark, str(tmp_path)).collect()}
    assert got == {("t1", "slice"): (2, 1), ("t2", "slice"): (2, 1), ("t1", "thread_state"): (1, 0)}
