"""Queries through the loaders and writers: the bridge tables are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import epoch_us
from ..operators import repeats as rep
from ..session import shared_dir
from ..sources import readers, writers
from .bridge import table, trace_tables
from .reports import MERGED_BODY, merged, merged_sql
from .sqltext import big, bridge, with_


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/spanmeter-{uuid.uuid4().hex}"


def _stored_traces(spark: SparkSession, sf: str) -> str:
    """Span and state tables as a decoder writes them, a folder per trace; some rows lack their time."""
    path, t = _folder(spark), trace_tables(spark, sf)
    for name, c in (("slice", F.col("id")), ("thread_state", F.col("ts"))):
        df = getattr(t, name).withColumns({"ts": F.when(c % 11 != 0, F.col("ts")), "dur": F.when(c % 13 != 0, F.col("dur"))})
        df.repartition("trace_id").write.partitionBy("trace_id").parquet(f"{path}/{name}")
    return path


def _load_traces(spark, sf):
    return readers.load_traces(spark, _stored_traces(spark, sf)).slice.select(
        "trace_id", "id", "track_id", "parent_id", "ts", "dur", "name", "depth")


def _unplaced(spark, sf):
    return readers.unplaced_rows(spark, _stored_traces(spark, sf))


def _load_runs(spark, sf):
    """A run log of JSON lines, every ninth of which was cut off while it was written."""
    e, path = table(spark, sf, "events"), _folder(spark)
    line = F.to_json(F.struct(
        F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")).alias("project"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts"), F.col("event_type").alias("cmd"),
        (F.col("event_id") % 3).cast("int").alias("exit"), F.round(F.col("value") * 1000).cast("long").alias("ms"),
        F.array(F.lit("-c"), F.col("event_type")).alias("argv")))
    e.select(F.when(F.col("event_id") % 9 == 0, F.substring(line, 1, 40)).otherwise(line)).write.text(path)
    return readers.load_runs(spark, path).select(
        "project", epoch_us("ts").alias("us"), "cmd", "exit", "ms", F.array_join("argv", " ").alias("argv"))


def _load_dumps(spark, sf):
    """Texts of documents as dump files, numbered by file block; the document's number leads its lines."""
    d, path = table(spark, sf, "documents"), _folder(spark)
    lines = readers.text_lines(d.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text")
    named = lines.select(F.floor(F.col("doc_id") / 200).alias("file_no"), "doc_id", "line_no", F.concat_ws(
        "|", F.col("doc_id").cast("string"), F.col("line_no").cast("string"), F.regexp_replace("line", r"[\r\n\x0B\x0C\x1C-\x1E\x85  ]", " ")).alias("value"))
    (named.repartition("file_no").sortWithinPartitions("file_no", "doc_id", "line_no").select("file_no", "value")
     .write.partitionBy("file_no").text(path))
    got = readers.load_dumps(spark, path)
    return got.select(F.regexp_extract("dump_id", r"file_no=(\d+)", 1).cast("long").alias("file_no"),
                      F.col("line_no").cast("long").alias("line_no"), F.substring_index("line", "|", 2).alias("said"))


def _round_trip(spark, sf):
    """Merged findings written as reports and loaded again."""
    path, m = _folder(spark), merged(spark, sf)
    found = m.withColumnRenamed("scenario_id", "report_id")
    heads = found.select("report_id").distinct()
    runs = found.select("report_id", "detector").distinct()
    writers.write_report(readers.Report(heads, runs, found), path)
    r = readers.load_report(spark, path)
    return r.finding.join(r.detector_run.select("report_id", "detector"), ["report_id", "detector"]).select(
        F.col("report_id").alias("scenario_id"), "detector", "location", "detail", F.col("runs").cast("long").alias("runs"),
        F.col("runs_total").cast("long").alias("runs_total"), *rep.METRICS, F.to_json("identity").alias("identity"))


def _appended(spark, sf):
    """Reports filed one after another under two investigations."""
    path, e = _folder(spark), table(spark, sf, "events")
    seqs = []
    for k, name in enumerate(["slow start", "jank", "slow start", "slow start"]):
        day = e.where(F.dayofmonth("ts") == k + 1)
        found = day.groupBy("event_type").agg(F.count(F.lit(1)).cast("double").alias("count")).select(
            F.lit(f"r{k}").alias("report_id"), F.lit("gc_pressure").alias("detector"), F.col("event_type").alias("location"), "count")
        one = found.select("report_id").distinct()
        seqs.append(writers.append_report(readers.Report(one, one.withColumn("detector", F.lit("gc_pressure")), found), path, name))
    return spark.read.parquet(f"{path}/finding").select("investigation", F.col("seq").cast("long").alias("seq"), "report_id", "location", "count")


_TIMED = """
timed AS (SELECT * REPLACE (CASE WHEN {c} % 11 <> 0 THEN ts END AS ts, CASE WHEN {c} % 13 <> 0 THEN dur END AS dur) FROM {t})"""

QUERIES = {
    "load_traces": (_load_traces, with_(bridge(), _TIMED.format(c="id", t="slice"), body="""
        SELECT trace_id, id, track_id, parent_id, ts, dur, name, depth FROM timed WHERE ts IS NOT NULL AND dur IS NOT NULL""")),
    "unplaced_rows": (_unplaced, with_(bridge(), _TIMED.format(c="id", t="slice"), _TIMED.format(c="ts", t="thread_state").replace(
        "timed AS", "timed_states AS"), body=" UNION ALL ".join(f"""
        SELECT trace_id, '{name}' AS "table", {big('count(*)')} AS "rows",
               {big('count(*) FILTER (ts IS NULL OR dur IS NULL)')} AS rejected FROM {t} GROUP BY trace_id"""
        for name, t in (("slice", "timed"), ("thread_state", "timed_states"))))),
    "load_runs": (_load_runs, f"""
        SELECT 'p' || user_id % 7 AS project, epoch_us(ts) AS us, event_type AS cmd, CAST(event_id % 3 AS INTEGER) AS exit,
               CAST(round(value * 1000) AS BIGINT) AS ms, '-c ' || event_type AS argv
        FROM events WHERE event_id % 9 <> 0"""),
    "load_dumps": (_load_dumps, """
        WITH cut AS (
          SELECT doc_id, CASE WHEN len(l) > 1 AND l[-1] = '' THEN l[:-2] ELSE l END AS l
          FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10)) AS l FROM documents))
        SELECT doc_id // 200 AS file_no, row_number() OVER (PARTITION BY doc_id // 200 ORDER BY doc_id, k) AS line_no,
               doc_id || '|' || k AS said
        FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS k FROM cut)"""),
    "report_round_trip": (_round_trip, merged_sql(MERGED_BODY)),
    "append_report": (_appended, f"""
        SELECT CASE WHEN day = 2 THEN 'jank' ELSE 'slow start' END AS investigation,
               {big("CASE day WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 3 END")} AS seq, 'r' || (day - 1) AS report_id,
               event_type AS location, CAST(count(*) AS DOUBLE) AS "count"
        FROM (SELECT *, day(ts) AS day FROM events) WHERE day <= 4 GROUP BY day, event_type"""),
}
