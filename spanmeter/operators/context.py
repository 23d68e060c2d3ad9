"""One process and one scenario window per trace, and the views clipped to them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import any_glob, glob, lng, nonneg, to_ms
from ..functions.ordered import top_k
from ..session import settle, together
from ..sources.readers import TraceTables


def _per_process(t: TraceTables, pattern: str, start: str | None = None) -> DataFrame:
    """Processes whose name matches: slice count (0 without slices), first span, first span of the start
    anchor, and the largest end."""
    procs = t.process.where(glob("name", pattern)).select("trace_id", "upid", "pid", "name")
    # Folded per track before the joins: what travels is one row per track, not per slice.
    per_track = t.slice.groupBy("trace_id", F.col("track_id").alias("id")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("ts").alias("_first"),
        F.min(F.when(any_glob("name", [start]), F.col("ts"))).alias("_anchored"),
        F.max(F.col("ts") + nonneg("dur")).alias("_last"))
    per_upid = (
        per_track.join(t.thread_track, ["trace_id", "id"])
        .join(t.thread.select("trace_id", "utid", "upid"), ["trace_id", "utid"])
        .groupBy("trace_id", "upid").agg(
            F.sum("_n").alias("slices"), F.min("_first").alias("_first"),
            F.min("_anchored").alias("_anchored"), F.max("_last").alias("_last"))
    )
    return procs.join(per_upid, ["trace_id", "upid"], "left").withColumn(
        "slices", F.coalesce("slices", lng(0)))


def slices_per_process(t: TraceTables, pattern: str) -> DataFrame:
    """Processes whose name matches, with their slice count; 0 for a process without slices."""
    return _per_process(t, pattern).select("trace_id", "upid", "pid", "name", "slices")


def _fattest_first():
    return [F.col("slices").desc(), F.col("upid").asc()]


def resolve_process(t: TraceTables, pattern: str) -> DataFrame:
    """The matching process with most slices, one row per trace (ties: smallest upid)."""
    return top_k(slices_per_process(t, pattern), ["trace_id"], _fattest_first(), 1)


def require_process(t: TraceTables, pattern: str) -> None:
    """Raises when no trace holds a process of that name. Runs one small job."""
    if t.process.where(glob("name", pattern)).limit(1).isEmpty():
        raise ValueError(f"no process matches {pattern!r}; see process_inventory for the names")


def process_alternatives(t: TraceTables, pattern: str, n: int = 5) -> DataFrame:
    """The next n candidates after the chosen one, and how many there were in all."""
    found = slices_per_process(t, pattern)
    total = found.groupBy("trace_id").agg((F.count(F.lit(1)) - 1).alias("alternatives_total"))
    ranked = top_k(found, ["trace_id"], _fattest_first(), n + 1, rank="rank")
    return (
        ranked.where(F.col("rank") > 1).join(total, "trace_id")
        .select("trace_id", (F.col("rank") - 1).alias("place"), "upid", "pid", "name", "slices",
                "alternatives_total")
    )


def process_threads(t: TraceTables, proc: DataFrame) -> DataFrame:
    """Threads of the chosen process, with the main-thread flag `tid = pid`."""
    return _threads(t, proc)


def process_spans(t: TraceTables, proc: DataFrame) -> DataFrame:
    """Spans on the threads of the chosen process. Spans on other tracks drop out."""
    # The three small tables first, so that the span table takes part in a single join.
    return t.slice.join(_tracks(t, proc), ["trace_id", "track_id"]).select(
        "trace_id", F.col("id").alias("slice_id"), "ts", "dur", "name", "depth", "utid", "tid",
        "thread_name", "is_main_thread")


def anchor_hits(spans: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """How many spans each anchor matched; 0 means the window is not the scenario."""
    return spans.groupBy("trace_id").agg(
        F.count_if(any_glob("name", [start])).alias("start_matches"),
        F.count_if(any_glob("name", [end])).alias("end_matches"))


def chosen_process(t: TraceTables, pattern: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """`resolve_process` with its window `ts_start, ts_end`: one row per trace from one pass over the spans.

    Start: the first span of the start anchor, else the first span. End: the end of the FIRST span by `ts` of
    the end anchor at or after the start, else the largest end; the anchor takes a second pass, over the spans
    of that name alone. A span still open counts no length here. An anchor of None matches
    nothing; the bounds of a process without spans are NULL.
    """
    best = top_k(_per_process(t, pattern, start), ["trace_id"], _fattest_first(), 1).select(
        "trace_id", "upid", "pid", "name", "slices",
        F.coalesce("_anchored", "_first").alias("ts_start"), F.col("_last").alias("ts_end"))
    if end is None:
        return best
    tracks = _tracks(t, best.select("trace_id", "upid", "pid", "ts_start"), "ts_start")
    ends = (
        t.slice.where(glob("name", end)).join(tracks, ["trace_id", "track_id"])
        .where(F.col("ts") >= F.col("ts_start")).groupBy("trace_id")
        .agg(F.min_by(F.col("ts") + nonneg("dur"), F.struct("ts", "id")).alias("_end"))
    )
    return best.join(ends, "trace_id", "left").withColumn(
        "ts_end", F.coalesce("_end", "ts_end")).drop("_end")


def _threads(t: TraceTables, chosen: DataFrame, *more: str) -> DataFrame:
    return t.thread.join(chosen.select("trace_id", "upid", "pid", *more), ["trace_id", "upid"]).select(
        "trace_id", "utid", "tid", F.col("name").alias("thread_name"),
        (F.col("tid") == F.col("pid")).alias("is_main_thread"), *more)


def _tracks(t: TraceTables, chosen: DataFrame, *more: str) -> DataFrame:
    return _threads(t, chosen, *more).join(t.thread_track.withColumnRenamed("id", "track_id"), ["trace_id", "utid"])


def clip_spans(t: TraceTables, chosen: DataFrame) -> DataFrame:
    """Spans which overlap the window: real `dur`, plus the clipped `ts_win` and `dur_win`.

    An open span (`dur = -1`) runs to the end of the window and is marked `unfinished`. Process, threads, tracks and
    window are joined among themselves, so the spans take part in a single join.
    """
    d = t.slice.join(_tracks(t, chosen, "ts_start", "ts_end"), ["trace_id", "track_id"])
    real = F.when(F.col("dur") < 0, F.col("ts_end") - F.col("ts")).otherwise(F.col("dur"))
    end = F.col("ts") + F.when(F.col("dur") < 0, F.col("ts_end") - F.col("ts")).otherwise(
        nonneg("dur"))
    inside = (F.col("ts") < F.col("ts_end")) & (end > F.col("ts_start"))
    ts_win = F.greatest("ts", "ts_start")
    return d.where(inside).select(
        "trace_id", F.col("id").alias("slice_id"), "ts", real.alias("dur"), "name", "depth", "utid", "tid",
        "thread_name", "is_main_thread", (F.col("dur") < 0).alias("unfinished"),
        ts_win.alias("ts_win"), (F.least(end, F.col("ts_end")) - ts_win).alias("dur_win"))


def clip_states(t: TraceTables, chosen: DataFrame) -> DataFrame:
    """Scheduler states of the process; `dur` is the part inside the window."""
    d = t.thread_state.where(F.col("dur") > 0).join(_threads(t, chosen, "ts_start", "ts_end"), ["trace_id", "utid"])
    end = F.col("ts") + F.col("dur")
    start = F.greatest("ts", "ts_start")
    return (
        d.where((F.col("ts") < F.col("ts_end")) & (end > F.col("ts_start")))
        .select("trace_id", "utid", "tid", "thread_name", "is_main_thread", "state",
                start.alias("ts"), (F.least(end, F.col("ts_end")) - start).alias("dur"))
    )


def fold_spans(slice_win: DataFrame) -> DataFrame:
    """Spans of a name on a thread as one row: what the detectors which only count and add up read."""
    longest = F.struct("dur", -F.col("slice_id"))
    return slice_win.groupBy("trace_id", "utid", "thread_name", "is_main_thread", "name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("dur").alias("dur_sum"), F.max("dur").alias("dur_max"),
        F.max(longest).alias("longest"))


def fold_states(tstate_win: DataFrame) -> DataFrame:
    """Scheduler states of a kind on a thread as one row."""
    return tstate_win.groupBy("trace_id", "utid", "thread_name", "state").agg(
        F.count(F.lit(1)).alias("n"), F.sum("dur").alias("dur_sum"), F.max("dur").alias("dur_max"))


@dataclass(frozen=True)
class TraceContext:
    """Everything a detector reads, for every trace at once. All of it is lazy.

    `chosen` holds one row per trace: the process and the bounds of its window.
    """

    tables: TraceTables
    chosen: DataFrame
    slice_win: DataFrame
    tstate_win: DataFrame
    span_folds: DataFrame
    state_folds: DataFrame
    process_glob: str
    start: str | None
    end: str | None

    @property
    def proc(self) -> DataFrame:
        return self.chosen.select("trace_id", "upid", "pid", "name", "slices")

    @property
    def window(self) -> DataFrame:
        return self.chosen.where(F.col("ts_start").isNotNull()).select("trace_id", "ts_start", "ts_end")

    @property
    def spans(self) -> DataFrame:
        return process_spans(self.tables, self.chosen)

    def settled(self) -> TraceContext:
        """The same context with its clipped views and folds written out once, for when several detectors
        read them: ten scans and joins of the span table become one."""
        chosen = settle(self.chosen)
        slice_win, tstate_win = together([lambda: settle(clip_spans(self.tables, chosen)),
                                          lambda: settle(clip_states(self.tables, chosen))])
        return replace(self, chosen=chosen, slice_win=slice_win, tstate_win=tstate_win,
                       span_folds=settle(fold_spans(slice_win)), state_folds=fold_states(tstate_win))


def build_context(t: TraceTables, process: str, start: str | None = None,
                  end: str | None = None) -> TraceContext:
    chosen = chosen_process(t, process, start, end)
    slice_win, tstate_win = clip_spans(t, chosen), clip_states(t, chosen)
    return TraceContext(t, chosen, slice_win, tstate_win, fold_spans(slice_win), fold_states(tstate_win),
                        process, start, end)


def window_info(ctx: TraceContext) -> DataFrame:
    """One row per trace: bounds, duration, process, anchor evidence, number of alternatives."""
    hits = anchor_hits(ctx.spans, ctx.start, ctx.end)
    others = ctx.tables.process.where(glob("name", ctx.process_glob)).groupBy("trace_id").agg(
        (F.count(F.lit(1)) - 1).alias("process_alternatives"))
    p = ctx.proc.select("trace_id", F.col("name").alias("process"), "pid")
    return (
        ctx.window.join(p, "trace_id").join(hits, "trace_id").join(others, "trace_id")
        .select("trace_id", "ts_start", "ts_end",
                to_ms(F.col("ts_end") - F.col("ts_start")).alias("duration_ms"),
                "process", "pid", "start_matches", "end_matches", "process_alternatives")
    )
