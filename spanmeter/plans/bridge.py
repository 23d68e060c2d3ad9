"""The sample tables re-read as trace tables, logs, dumps and sources.

Every table is a projection of a whole sample table, so that work grows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import epoch_us, lng
from ..sources.readers import TraceTables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("trace_id"), "event_id", "user_id", "event_type",
        "value", (epoch_us("ts") * lng(1000)).alias("ns"), epoch_us("ts").alias("us"),
        (F.col("user_id") % 24).cast("int").alias("utid"),
        F.round(F.col("value") * 100).cast("long").alias("cents"))


def trace_tables(spark: SparkSession, sf_dir: str) -> TraceTables:
    """A trace per calendar day of `events`, 24 threads in 4 processes each; all tables are projections."""
    e = _events(spark, sf_dir)
    upid = F.col("utid") % 4
    threads = e.select("trace_id", "utid").distinct()
    depth = (F.when(F.col("event_type").isin("view", "click"), 0)
             .when(F.col("event_type") == "signup", 2).otherwise(1))
    named = F.concat("event_type", F.lit(" "), (F.col("event_id") % 5).cast("string"))
    open_span = (F.col("event_type") == "signup") & (F.col("value") < 5)
    parent = F.col("event_id") - 1 - F.col("event_id") % 7
    state = F.element_at(F.create_map(*[F.lit(x) for pair in {
        "click": "Running", "view": "R", "signup": "R+", "error": "D", "purchase": "S"
    }.items() for x in pair]), F.col("event_type"))
    tag = (F.when(F.col("event_type") == "view", "No Jank")
           .when(F.col("event_type").isin("click", "error"), "Self Jank").otherwise("Other Jank"))
    return TraceTables(
        process=threads.select(
            "trace_id", upid.alias("upid"), (upid + 1000).alias("pid"),
            F.concat(F.lit("app.p"), upid.cast("string")).alias("name")).distinct(),
        thread=threads.select(
            "trace_id", "utid",
            F.when(F.col("utid") < 4, upid + 1000).otherwise(F.col("utid") + 2000).alias("tid"),
            F.concat(F.lit("worker-"), F.col("utid").cast("string")).alias("name"),
            upid.alias("upid")),
        thread_track=threads.select("trace_id", (F.col("utid") + 100).alias("id"), "utid"),
        slice=e.select(
            "trace_id", F.col("event_id").alias("id"), (F.col("utid") + 100).alias("track_id"),
            F.when(depth != 0, parent).alias("parent_id"), F.col("ns").alias("ts"),
            F.when(open_span, lng(-1)).otherwise(F.col("cents") * lng(200_000_000)).alias("dur"),
            named.alias("name"), depth.alias("depth")),
        thread_state=e.select(
            "trace_id", "utid", F.col("ns").alias("ts"),
            (F.col("cents") * lng(100_000_000)).alias("dur"), state.alias("state")),
        actual_frame=e.select(
            "trace_id",
            F.when(F.col("event_id") % 50 != 0, F.col("event_id")).alias("surface_frame_token"),
            upid.alias("upid"), F.col("ns").alias("ts"),
            (F.col("cents") * lng(100_000)).alias("dur"), F.col("event_type").alias("jank_type"),
            tag.alias("jank_tag")),
        expected_frame=e.where(F.col("event_id") % 7 != 0).select(
            "trace_id", F.col("event_id").alias("surface_frame_token"), upid.alias("upid"),
            F.col("ns").alias("ts"), lng(300_000_000).alias("dur")),
        freeze_record=e.where((F.col("event_type") == "error") & (F.col("value") > 150)).select(
            "trace_id", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("error_id"),
            F.col("ns").alias("ts"),
            F.when(F.col("event_id") % 2 == 0, "").otherwise("input timeout").alias("subject"),
            F.lit("timer").alias("anr_type"), F.col("value").alias("anr_dur_ms"),
            F.when(F.col("user_id") % 2 == 0, upid).alias("upid"),
            (upid + 1000).alias("pid"), F.lit(None).cast("string").alias("process_name")),
    )


# The same tables for the check engine. `ev` is one scan, the rest are projections of it.
TRACE_SQL = """
ev AS (
  SELECT strftime(ts, '%Y-%m-%d') AS trace_id, event_id, user_id, event_type, value,
         epoch_us(ts) * 1000 AS ns, epoch_us(ts) AS us, CAST(user_id % 24 AS INTEGER) AS utid,
         CAST(round(value * 100) AS BIGINT) AS cents
  FROM events),
thread AS (
  SELECT DISTINCT trace_id, utid,
         CASE WHEN utid < 4 THEN 1000 + utid % 4 ELSE 2000 + utid END AS tid,
         'worker-' || utid AS name, utid % 4 AS upid FROM ev),
process AS (
  SELECT DISTINCT trace_id, upid, 1000 + upid AS pid, 'app.p' || upid AS name FROM thread),
thread_track AS (SELECT trace_id, 100 + utid AS id, utid FROM thread),
slice AS (
  SELECT trace_id, event_id AS id, 100 + utid AS track_id,
         CASE WHEN event_type NOT IN ('view', 'click')
              THEN event_id - 1 - event_id % 7 END AS parent_id,
         ns AS ts,
         CASE WHEN event_type = 'signup' AND value < 5 THEN -1 ELSE cents * 200000000 END AS dur,
         event_type || ' ' || (event_id % 5) AS name,
         CASE WHEN event_type IN ('view', 'click') THEN 0
              WHEN event_type = 'signup' THEN 2 ELSE 1 END AS depth
  FROM ev),
thread_state AS (
  SELECT trace_id, utid, ns AS ts, cents * 100000000 AS dur,
         CASE event_type WHEN 'click' THEN 'Running' WHEN 'view' THEN 'R' WHEN 'signup' THEN 'R+'
                         WHEN 'error' THEN 'D' WHEN 'purchase' THEN 'S' END AS state FROM ev),
actual_frame AS (
  SELECT trace_id, CASE WHEN event_id % 50 <> 0 THEN event_id END AS surface_frame_token,
         utid % 4 AS upid, ns AS ts, cents * 100000 AS dur, event_type AS jank_type,
         CASE WHEN event_type = 'view' THEN 'No Jank'
              WHEN event_type IN ('click', 'error') THEN 'Self Jank' ELSE 'Other Jank' END
           AS jank_tag FROM ev),
expected_frame AS (
  SELECT trace_id, event_id AS surface_frame_token, utid % 4 AS upid, 300000000 AS dur
  FROM ev WHERE event_id % 7 <> 0),
freeze_record AS (
  SELECT trace_id, 'e' || event_id AS error_id, ns AS ts,
         CASE WHEN event_id % 2 = 0 THEN '' ELSE 'input timeout' END AS subject,
         'timer' AS anr_type, value AS anr_dur_ms,
         CASE WHEN user_id % 2 = 0 THEN utid % 4 END AS upid, 1000 + utid % 4 AS pid,
         CAST(NULL AS VARCHAR) AS process_name
  FROM ev WHERE event_type = 'error' AND value > 150)"""
