"""What is inside a trace: processes, threads, longest spans, name families and mask coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import family, glob, int_div, lng, nonneg, to_ms
from ..functions.ordered import top_k
from ..sources.readers import TraceTables
from .context import slices_per_process
from .detectors import DETECTORS
from .registry import defaults_of

# Inventory sections with the words a family name is claimed by, first match wins.
BUCKETS: list[tuple[str, list[str]]] = [
    ("Garbage collection", ["gc", "garbage", "collection", "allocating", "heap"]),
    ("Locks and waiting", ["contention", "monitor", "locked", "mutex", "futex"]),
    ("Binder / IPC", ["binder", "transact", "ipc"]),
]
REST = "Everything else"


def process_inventory(t: TraceTables, n: int | None = 15) -> DataFrame:
    """Named processes by slice count, top n per trace."""
    found = slices_per_process(t, "*").where(F.col("name").isNotNull())
    return top_k(found, ["trace_id"], [F.col("slices").desc(), F.col("upid")], n)


def tenth_ms(x: str) -> Column:
    return int_div(F.coalesce(x, lng(0)) + lng(50_000), lng(100_000)).cast("double") / F.lit(10.0)


def thread_inventory(t: TraceTables, pattern: str, n: int | None = 25) -> DataFrame:
    """Threads of matching processes: span count, span time, CPU time; busiest first."""
    procs = t.process.where(glob("name", pattern)).select("trace_id", "upid")
    threads = t.thread.join(procs, ["trace_id", "upid"]).select(
        "trace_id", "utid", F.col("name").alias("thread"), "tid")
    spans = (
        t.slice.groupBy("trace_id", F.col("track_id").alias("id")).agg(
            F.count(F.lit(1)).alias("_n"), F.sum(nonneg("dur")).alias("_ns"))
        .join(t.thread_track, ["trace_id", "id"])
        .groupBy("trace_id", "utid").agg(F.sum("_n").alias("_slices"), F.sum("_ns").alias("_span"))
    )
    cpu = (
        t.thread_state.where((F.col("state") == "Running") & (F.col("dur") > 0))
        .groupBy("trace_id", "utid").agg(F.sum("dur").alias("_cpu"))
    )
    rows = (
        threads.join(spans, ["trace_id", "utid"], "left").join(cpu, ["trace_id", "utid"], "left")
        .select("trace_id", "utid", "thread", "tid", F.coalesce("_slices", lng(0)).alias("slices"),
                tenth_ms("_span").alias("sliced_ms"), tenth_ms("_cpu").alias("running_ms"))
    )
    return top_k(rows, ["trace_id"], [F.col("running_ms").desc(), F.col("slices").desc(),
                                      F.col("utid")], n)


def named_spans(t: TraceTables, procs: DataFrame) -> DataFrame:
    """Spans folded by (name, thread) for the given processes: count, length, longest."""
    tracks = (
        t.thread.join(procs.select("trace_id", "upid"), ["trace_id", "upid"])
        .select("trace_id", "utid", F.col("name").alias("thread"))
        .join(t.thread_track.withColumnRenamed("id", "track_id"), ["trace_id", "utid"])
    )
    return (
        t.slice.join(tracks, ["trace_id", "track_id"])
        .groupBy("trace_id", "name", "thread")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(nonneg("dur")).alias("ns"),
             F.max("dur").alias("longest"))
    )


def longest_spans(t: TraceTables, pattern: str, n: int | None = 25) -> DataFrame:
    """Span names by their longest occurrence, with the thread it ran on."""
    folded = named_spans(t, t.process.where(glob("name", pattern)))
    rows = folded.groupBy("trace_id", "name").agg(
        F.max_by("thread", F.struct("longest", "thread")).alias("thread"),
        F.sum("n").alias("n"), to_ms(F.max("longest")).alias("max_ms"))
    return top_k(rows, ["trace_id"], [F.col("max_ms").desc(), F.col("name")], n)


def name_family(c: Column | str) -> Column:
    return family(c)


def masks_of(overrides: Mapping[str, Mapping[str, str]] | None = None
             ) -> list[tuple[str, str, str]]:
    """(detector, kind, glob) of every mask parameter; kind is name, thread or skip."""
    out = []
    for d, fn in DETECTORS.items():
        for key, value in {**defaults_of(fn), **(overrides or {}).get(d, {})}.items():
            kind = next((k for k, part in (("skip", "skip_glob"), ("thread", "thread_glob"),
                                           ("name", "name_glob")) if part in key), None)
            if kind:
                out.append((d, kind, str(value)))
    return out


def mask_coverage(spans: DataFrame, masks: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Per name: which detectors see it, and which exclude it on purpose.

    `spans` are the folded rows of `named_spans`. The masks are a handful of parameters, so they
    become columns of one pass and no join is needed.
    """
    dets = list(dict.fromkeys(d for d, _, _ in masks))

    def hit(det: str, kinds: tuple[str, ...]) -> Column:
        e = F.lit(False)
        for d, kind, pattern in masks:
            if d == det and kind in kinds:
                e = e | F.coalesce(glob("thread" if kind == "thread" else "name", pattern),
                                   F.lit(False))
        return e

    flags = spans.groupBy("trace_id", "name").agg(*[
        e for i, d in enumerate(dets) for e in (
            F.max(hit(d, ("name", "thread"))).alias(f"_p{i}"),
            F.max(hit(d, ("skip",))).alias(f"_s{i}"))])

    def ids(want_skip: bool) -> Column:
        return F.array_compact(F.array(*[
            F.when(F.col(f"_p{i}") & (F.col(f"_s{i}") if want_skip else ~F.col(f"_s{i}")), F.lit(d))
            for i, d in enumerate(dets)]))
    return flags.select("trace_id", "name", ids(False).alias("covered_by"),
                        ids(True).alias("skipped_by"))


def family_inventory(spans: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """Folded spans by name family: count, time, threads and, with coverage, the detectors."""
    d = spans.withColumn("family", family("name"))
    if coverage is None:
        return d.groupBy("trace_id", "family").agg(
            F.sum("n").alias("n"), F.sum("ns").alias("ns"),
            F.array_sort(F.collect_set("thread")).alias("threads"))
    # Detector ids are a closed set of ten, so the union of the lists stays small.
    d = d.join(coverage, ["trace_id", "name"])
    return d.groupBy("trace_id", "family").agg(
        F.sum("n").alias("n"), F.sum("ns").alias("ns"),
        F.array_sort(F.collect_set("thread")).alias("threads"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("covered_by")))).alias("covered_by"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("skipped_by")))).alias("skipped_by"))


def bucket_families(fams: DataFrame, rules: Sequence[tuple[str, Sequence[str]]] = BUCKETS
                    ) -> DataFrame:
    """Adds `section`: the first bucket one of whose words is in the family name."""
    low = F.lower("family")
    e = F.lit(REST)
    for title, words in reversed(list(rules)):
        e = F.when(low.rlike("|".join(words)), F.lit(title)).otherwise(e)
    return fams.withColumn("section", e)


def top_families(fams: DataFrame, min_ms: float = 1, top: int = 15) -> DataFrame:
    """The longest families of each section, and how many there were: `place, shown_of`."""
    kept = fams.where(F.col("ns") >= lng(round(min_ms * 1_000_000)))
    total = kept.groupBy("trace_id", "section").agg(F.count(F.lit(1)).alias("shown_of"))
    best = top_k(kept, ["trace_id", "section"], [F.col("ns").desc(), F.col("family")], top,
                 rank="place")
    return best.join(total, ["trace_id", "section"])


def missed_families(fams: DataFrame, min_ms: float = 1, top: int = 15) -> DataFrame:
    """Families of a claimed section which no mask sees and none excludes on purpose."""
    missed = fams.where(
        (F.col("section") != REST) & (F.col("ns") >= lng(round(min_ms * 1_000_000)))
        & (F.size("covered_by") == 0) & (F.size("skipped_by") == 0))
    total = missed.groupBy("trace_id").agg(F.count(F.lit(1)).alias("shown_of"))
    best = top_k(missed, ["trace_id"], [F.col("ns").desc(), F.col("family")], top, rank="place")
    return best.join(total, "trace_id")
