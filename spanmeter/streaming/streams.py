"""Structured Streaming twins of the run-log operators and of the detectors."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming import StreamingQuery

from ..functions.exprs import iso_text
from ..operators.context import build_context
from ..operators.registry import run_detectors
from ..sources import schemas
from ..session import settle
from ..sources.readers import load_traces


def read_log(spark: SparkSession, path: str, lateness: str = "1 hour",
             max_files: int | None = None) -> DataFrame:
    """A growing folder of run-log files; lines which do not parse are skipped."""
    reader = spark.readStream.schema(schemas.RUN_LOG).option("mode", "DROPMALFORMED")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path).where(F.col("ts").isNotNull()).withWatermark("ts", lateness)


def stream_sittings(log: DataFrame, gap_s: int = 30 * 60) -> DataFrame:
    """Sittings as they close, the same as in the batch form: the silence is counted from the END of the run before.

    Runs wait until the watermark has passed them and then go in order of their start, so a file that arrives
    late but in time changes nothing. State per project: the runs that wait, and the open sitting with the end of
    its last run, at which a timer closes it. `log` needs a watermark on `ts`.
    """
    gap = gap_s * 1_000_000

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, sitting = json.loads(state.get[0]) if state.exists else ([], None)
        for b in batches:
            us = b["ts"].astype("datetime64[us]").astype("int64")
            ends = us + b["ms"].fillna(0).astype("int64") * 1000
            waiting += [[int(u), c, int(e), v] for u, c, e, v in zip(
                us, b["cmd"].astype(object).where(b["cmd"].notna(), None), ends,
                b["version"].astype(object).where(b["version"].notna(), None), strict=True)]
        passed = state.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda r: (r[0], r[1] or ""))
        closed = []
        while waiting and waiting[0][0] < passed:
            us, _, end, version = waiting.pop(0)
            if sitting is not None and us - sitting[1] > gap:
                closed.append(sitting)
                sitting = None
            started, _, runs, known = sitting or (us, end, 0, None)
            sitting = (started, end, runs + 1, version if version is not None else known)
        if sitting is not None and passed - sitting[1] > gap:
            closed.append(sitting)
            sitting = None
        if waiting or sitting is not None:
            state.update((json.dumps([waiting, sitting]),))
            due = min([r[0] for r in waiting[:1]] + ([sitting[1] + gap] if sitting is not None else []))
            state.setTimeoutTimestamp(max(due, passed) // 1000 + 2)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], *c) for c in closed], columns=["project", "started", "ended", "runs", "version"])

    rows = log.select(F.coalesce("project", F.lit("")).alias("project"), "ts", "cmd", "ms", "version")
    d = rows.groupBy("project").applyInPandasWithState(
        advance, "project string, started long, ended long, runs long, version string", "held string",
        "append", GroupStateTimeout.EventTimeTimeout)
    d = d.withColumns({"started": F.timestamp_micros("started"), "ended": F.timestamp_micros("ended")})
    ident = F.substring(F.sha2(F.concat_ws("\n", "project", iso_text("started")), 256), 1, 12)
    return d.select("project", ident.alias("sitting_id"), "started", "ended", "runs", "version")


def stream_failures(log: DataFrame, window: str = "10 minutes") -> DataFrame:
    """Runs, failures and the last run of each command per window."""
    return log.groupBy(F.window("ts", window).alias("w"), "project", "cmd").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("exit") != 0).alias("failures"),
        F.max_by(F.struct("ts", "exit"), "ts").alias("last")).select(
        F.col("w.start").alias("from"), "project", "cmd", "runs", "failures",
        F.col("last.ts").alias("last_ts"), F.col("last.exit").alias("last_exit"))


def stream_findings(spark: SparkSession, arrivals: str, traces: str, out: str, checkpoint: str,
                    process: str, start: str | None = None, end: str | None = None,
                    detectors: list[str] | None = None, max_traces: int = 1000,
                    trigger: Callable | None = None) -> StreamingQuery:
    """Runs the batch detectors on every trace which has arrived whole.

    `arrivals` is a folder of JSON notes `{"trace_id": …}`, one written after a trace's tables are
    complete under `traces/<table>/trace_id=…`; a batch takes at most `max_traces` notes, the rest
    follow in the next. Only the noted traces are read (directories are
    pruned), so there is no state across batches. A batch writes to its own folder
    `out/batch=<id>`, replaced when the batch is run again: findings land exactly once.
    """
    notes = spark.readStream.schema("trace_id string").option(
        "maxFilesPerTrigger", max_traces).json(arrivals)

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        # Settled, since every table meets the names; a semi-join prunes folders as it runs.
        t = load_traces(batch.sparkSession, traces).where_noted(settle(batch.select("trace_id").distinct()))
        ctx = build_context(t, process, start, end).settled()
        run_detectors(ctx, detectors).findings.write.mode("overwrite").parquet(
            f"{out}/batch={batch_id}")

    writer = notes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    writer = trigger(writer) if trigger else writer.trigger(availableNow=True)
    return writer.start()
