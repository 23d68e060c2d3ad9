"""Times all ten detectors over traces of 475 000 spans each: python tools/baseline.py [traces …]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from spanmeter.operators.context import build_context  # noqa: E402
from spanmeter.operators.registry import run_detectors  # noqa: E402
from spanmeter.session import configure, settle  # noqa: E402
from spanmeter.sources.readers import TraceTables, empty_tables  # noqa: E402

SPANS, THREADS = 475_000, 60


def tables(spark: SparkSession, traces: int) -> TraceTables:
    """One process of 60 threads per trace; a minute of spans, three deep, and as many states and frames as fit."""
    each = spark.range(traces * SPANS).select(
        F.concat(F.lit("t"), F.floor(F.col("id") / SPANS).cast("string")).alias("trace_id"), (F.col("id") % SPANS).alias("n"),
        F.xxhash64("id").alias("h")).withColumn("utid", F.pmod(F.col("h"), F.lit(THREADS)).cast("int"))
    ns = F.col("n") * 126_000
    span = F.pmod(F.shiftright("h", 8), F.lit(2_000_000)) + 1000
    who = spark.range(traces).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("trace_id"))
    thread = who.select("trace_id", F.explode(F.sequence(F.lit(0), F.lit(THREADS - 1))).alias("utid"))
    made = empty_tables(spark).replace(
        process=who.select("trace_id", F.lit(1).alias("upid"), F.lit(100).alias("pid"), F.lit("app").alias("name")),
        thread=thread.select("trace_id", "utid", (F.col("utid") + 100).alias("tid"), F.concat(F.lit("w"), "utid").alias("name"), F.lit(1).alias("upid")),
        thread_track=thread.select("trace_id", F.col("utid").alias("id"), "utid"),
        slice=each.select("trace_id", F.col("n").alias("id"), F.col("utid").alias("track_id"), F.when(F.col("n") % 3 != 0, F.col("n") - 1).alias("parent_id"),
                          ns.alias("ts"), span.alias("dur"), F.concat(F.lit("work "), F.pmod("h", F.lit(175)).cast("string")).alias("name"),
                          (F.col("n") % 3).cast("int").alias("depth")),
        thread_state=each.where("n % 2 = 0").select("trace_id", "utid", ns.alias("ts"), span.alias("dur"),
                                                    F.element_at(F.array(F.lit("Running"), F.lit("R"), F.lit("S")), (F.pmod("h", F.lit(3)) + 1).cast("int")).alias("state")),
        actual_frame=each.where("n % 130 = 0").select("trace_id", F.col("n").alias("surface_frame_token"), F.lit(1).alias("upid"), ns.alias("ts"), span.alias("dur"),
                                                      F.lit("App Deadline Missed").alias("jank_type"), F.lit("Self Jank").alias("jank_tag")),
        expected_frame=each.where("n % 130 = 0").select("trace_id", F.col("n").alias("surface_frame_token"), F.lit(1).alias("upid"), ns.alias("ts"), F.lit(500_000).cast("long").alias("dur")))
    return TraceTables(**{n: settle(df) for n, df in vars(made).items()})


def main() -> None:
    spark = configure(SparkSession.builder.master(f"local[{os.cpu_count()}]").config("spark.ui.enabled", "false")
                      .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", os.cpu_count())
                      .config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    for traces in [int(a) for a in sys.argv[1:]] or [1, 1, 10]:
        t = tables(spark, traces)
        t0 = time.perf_counter()
        rows = run_detectors(build_context(t, "app*").settled()).findings.count()
        print(f"{traces} traces of {SPANS} spans: {time.perf_counter() - t0:.1f} s, {rows} rows", flush=True)


if __name__ == "__main__":
    main()
