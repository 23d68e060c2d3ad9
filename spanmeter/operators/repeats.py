"""Repeats of one scenario merged into one report: medians, spread, reproducibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import as_key, from_key, half_up_mean, hundredths, int_div, lng
from ..functions.ordered import counted_values, top_k, values_at_ranks
from .detectors import identity_of

METRICS = ["count", "self_ms", "total_ms", "max_ms", "covered_ms"]
SPREAD = ["self_ms", "total_ms", "max_ms"]


def rank_metric() -> Column:
    """The column a row is judged by: self time where measured, else total."""
    return F.coalesce("self_ms", "total_ms", F.lit(0.0))


def _keyed(findings: DataFrame, traces: DataFrame, by: str) -> DataFrame:
    """Findings with their scenario, repeat number and identity columns; `identity_more` lists the values of
    those beside location and detail, by name."""
    d = findings.withColumn("identity", identity_of(findings)).join(
        traces.select("trace_id", by, "repeat_no"), "trace_id")
    more = F.sort_array(F.map_entries(F.map_filter(
        "identity", lambda k, v: ~k.isin("location", "detail"))))
    return d.withColumns({
        "location": as_key("location"),
        "identity_detail": F.coalesce(F.try_element_at("identity", F.lit("detail")), F.lit("")),
        "identity_more": F.transform(more, lambda e: F.concat_ws("=", e["key"], e["value"]))})


def _names(by: str) -> list[str]:
    return [by, "detector", "location", "identity_detail", "identity_more"]


def _long(rows: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """One row per metric value, in hundredths, so that medians are exact."""
    return rows.select(
        *_names(by), "repeat_no",
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), hundredths(m).alias("v"))
                            for m in metrics])).alias("_m")
    ).select(*_names(by), "repeat_no", "_m.metric", "_m.v").where(F.col("v").isNotNull())


def medians(rows: DataFrame, by: str) -> DataFrame:
    """Median of every metric per finding row, wide. Exact, with no group held in one task."""
    keys = [*_names(by), "metric"]
    counted = counted_values(_long(rows, by, METRICS), keys, "v")
    mid = values_at_ranks(counted, keys, "v", {
        "_a": int_div(F.col("n") + 1, lng(2)), "_b": int_div(F.col("n"), lng(2)) + 1})
    value = half_up_mean(F.col("_a"), F.col("_b")).cast("double") / F.lit(100.0)
    return mid.groupBy(*keys[:-1]).agg(*[
        F.max(F.when(F.col("metric") == m, value)).alias(m) for m in METRICS])


def spread(findings: DataFrame, traces: DataFrame, by: str = "scenario_id") -> DataFrame:
    """Per row and ranking metric: smallest, largest and all values in repeat order.

    The list has one number per repeat which holds the row; it is part of the report itself.
    """
    return _spread(_keyed(findings, traces, by), by).withColumn("location", from_key("location"))


def _spread(rows: DataFrame, by: str) -> DataFrame:
    long = _long(rows, by, SPREAD)
    num = F.col("v").cast("double") / F.lit(100.0)
    return long.groupBy(*_names(by), "metric").agg(
        F.min(num).alias("min"), F.max(num).alias("max"),
        F.transform(F.array_sort(F.collect_list(F.struct("repeat_no", num.alias("x")))),
                    lambda s: s["x"]).alias("values"))


def worst_evidence(rows: DataFrame, by: str) -> DataFrame:
    """`detail` of the repeat with the largest ranking metric (ties: the earliest repeat), and the identity."""
    return rows.groupBy(*_names(by)).agg(F.max_by(
        "detail", F.struct(rank_metric(), -F.col("repeat_no"))).alias("detail"),
        F.first("identity").alias("identity"))


def scenario_size(traces: DataFrame, by: str = "scenario_id") -> DataFrame:
    """How many repeats a scenario has, silent ones included."""
    return traces.groupBy(by).agg(F.count_distinct("trace_id").alias("runs_total"))


def merge_repeats(findings: DataFrame, traces: DataFrame, by: str = "scenario_id",
                  with_spread: bool = True) -> DataFrame:
    """Findings of all repeats as one row per identity and scenario.

    `traces(trace_id, <by>, repeat_no)` lists every repeat. A scenario with a single repeat keeps
    its rows as they are, without `runs` and `spread`.
    """
    keyed = _keyed(findings, traces, by)
    sizes = scenario_size(traces, by)
    rows = keyed.join(sizes.where("runs_total > 1").select(by), by, "left_semi")
    # Nothing to merge: two rows of one identity in the only repeat stay two rows.
    single = keyed.join(sizes.where("runs_total = 1").select(by), by, "left_semi")
    keys = _names(by)
    # Counted per repeat first: a detector may have several rows of one identity in a repeat.
    runs = rows.select(*keys, "trace_id").distinct().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"))
    merged = (
        medians(rows, by).join(runs, keys).join(worst_evidence(rows, by), keys)
        .join(sizes, by)
    )
    cols = [by, "detector", from_key("location").alias("location"), F.when(F.col("identity_detail") != "", F.col("identity_detail"))
            .otherwise(F.col("detail")).alias("detail"),
            "identity", "runs", "runs_total", *METRICS]
    if with_spread:
        bands = _spread(rows, by).groupBy(*keys).agg(F.map_from_entries(
            F.collect_list(F.struct("metric", F.struct("min", "max", "values")))).alias("spread"))
        merged = merged.join(bands, keys, "left")
        cols.append("spread")
    merged = merged.select(*cols)
    kinds = dict(merged.dtypes)
    return merged.union(single.select(*[
        F.lit(None).cast(kinds[c]).alias(c) if c in ("runs", "runs_total", "spread")
        else (from_key("location") if c == "location" else F.col(c)).cast(kinds[c]).alias(c)
        for c in merged.columns]))


def ranked(merged: DataFrame, by: str = "scenario_id", limit: int | None = None) -> DataFrame:
    """Rows of each detector with their place, worst first."""
    return top_k(merged, [by, "detector"],
                 [rank_metric().desc(), F.col("location"), F.col("detail")],
                 limit or 2**31 - 1, rank="place")


def merge_windows(win: DataFrame, traces: DataFrame, by: str = "scenario_id",
                  ratio: float = 2) -> DataFrame:
    """Median, shortest and longest window of a scenario; `divergent` beyond the ratio."""
    d = win.join(traces.select("trace_id", by), "trace_id").select(
        by, hundredths((F.col("ts_end") - F.col("ts_start")) / F.lit(1e6)).alias("v"))
    counted = counted_values(d, [by], "v")
    mid = values_at_ranks(counted, [by], "v", {
        "_a": int_div(F.col("n") + 1, lng(2)), "_b": int_div(F.col("n"), lng(2)) + 1})
    ends = counted.groupBy(by).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    h = F.lit(100.0)
    return mid.join(ends, by).select(
        by, F.col("n").alias("repeats"),
        (half_up_mean(F.col("_a"), F.col("_b")).cast("double") / h).alias("duration_ms"),
        (F.col("_lo").cast("double") / h).alias("duration_ms_min"),
        (F.col("_hi").cast("double") / h).alias("duration_ms_max"),
        (F.col("_hi") > F.col("_lo") * ratio).alias("divergent"))


def report_summary(findings: DataFrame, runs: DataFrame, catalogue: list[str],
                   by: str = "report_id") -> DataFrame:
    """Per report and detector of the catalogue: `fired`, `silent` or `absent`, with row counts."""
    counts = findings.groupBy(by, "detector").agg(F.count(F.lit(1)).alias("_n"))
    ran = runs.select(by, "detector").distinct().withColumn("_ran", F.lit(True))
    grid = runs.select(by).distinct().select(by, F.explode(F.array(*[
        F.lit(d) for d in catalogue])).alias("detector"))
    grid = grid.unionByName(ran.select(by, "detector")).distinct()
    return (
        grid.join(ran, [by, "detector"], "left").join(counts, [by, "detector"], "left")
        .select(by, "detector", F.coalesce("_n", lng(0)).alias("rows"),
                F.when(F.col("_ran").isNull(), "absent").when(F.col("_n") > 0, "fired")
                .otherwise("silent").alias("state"))
    )


def summary_counts(summary: DataFrame, by: str = "report_id") -> DataFrame:
    """Detectors run, fired, silent and absent per report."""
    return summary.groupBy(by).agg(
        F.count_if(F.col("state") != "absent").alias("detectors_run"),
        *[F.count_if(F.col("state") == s).alias(s) for s in ("fired", "silent", "absent")],
        F.concat_ws(",", F.array_sort(F.collect_set(
            F.when(F.col("state") == "fired", F.col("detector"))))).alias("fired_ids"))


def merged_detector_runs(runs: DataFrame, by: str = "scenario_id") -> DataFrame:
    """A detector described by its first repeat which did not fail; error = the first error."""
    order = F.struct(F.col("error").isNotNull(), F.col("repeat_no"))
    described = [c for c in ("params", "params_source", "identity") if c in runs.columns]
    return runs.groupBy(by, "detector").agg(
        *[F.min_by(c, order).alias(c) for c in described],
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("repeat_no"))).alias("error"))
