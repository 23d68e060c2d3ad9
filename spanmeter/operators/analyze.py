"""From traces to a stored report in one go: context, detectors, repeats, headers."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from ..sources.readers import Report, TraceTables
from .context import TraceContext, build_context, window_info
from .registry import guarded, run_detectors
from .repeats import merge_repeats, merge_windows


def analyze(t: TraceTables, process: str, start: str | None = None, end: str | None = None, *,
            scenarios: DataFrame | None = None, names: list[str] | None = None,
            overrides: Mapping[str, Mapping[str, Any]] | None = None,
            config: Mapping[str, Mapping[str, Any]] | None = None,
            extra: Mapping[str, Callable[[TraceContext], DataFrame]] | None = None,
            config_sha: str | None = None) -> Report:
    """One report per scenario. `scenarios(trace_id, scenario_id, repeat_no)`; without it every
    trace is a scenario of its own. All findings of a detector are merged and kept. `extra` are detectors of one's
    own beside the named ones; a detector that fails has an entry with its error and no rows."""
    ctx = build_context(t, process, start, end).settled()
    if scenarios is None:
        scenarios = ctx.window.select("trace_id", F.col("trace_id").alias("scenario_id"),
                                      F.lit(1).alias("repeat_no"))
    done = guarded(run_detectors(ctx, names, overrides, config, limit=None, extra=extra))
    merged = settle(merge_repeats(done.findings, scenarios))
    heads = settle(_headers(ctx, scenarios, config_sha, overrides is None and config is None))
    plan = F.array(*[F.struct(
        F.lit(r["detector"]).alias("detector"), _literal_map(r["params"]).alias("params"),
        F.lit(r["params_source"]).alias("params_source"),
        F.array(*[F.lit(c) for c in r["identity"]]).cast("array<string>").alias("identity"),
        F.lit(r["error"]).cast("string").alias("error")) for r in done.runs])
    runs = heads.select("report_id", F.explode(plan).alias("_d")).select("report_id", "_d.*")
    finding = merged.withColumnRenamed("scenario_id", "report_id")
    return Report(heads, runs, finding)


def _literal_map(d: Mapping[str, str]):
    pairs = [F.lit(x) for kv in d.items() for x in kv]
    return (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>")


def _headers(ctx, scenarios: DataFrame, config_sha: str | None, defaults: bool) -> DataFrame:
    info = window_info(ctx).join(scenarios, "trace_id")
    first = info.groupBy("scenario_id").agg(
        F.min_by(F.struct("process", "pid"), "repeat_no").alias("_p"),
        F.min_by("start_matches", "repeat_no").alias("start_matches"),
        F.min_by("end_matches", "repeat_no").alias("end_matches"))
    win = merge_windows(ctx.window, scenarios)
    return first.join(win, "scenario_id").select(
        F.col("scenario_id").alias("report_id"), F.col("_p.process").alias("process"),
        F.col("_p.pid").alias("pid"), "duration_ms", F.col("repeats").cast("int").alias("runs"),
        F.lit(config_sha).cast("string").alias("config_sha"), F.lit(defaults).alias("defaults"),
        "start_matches", "end_matches")
