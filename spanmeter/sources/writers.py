"""Writing reports: the three tables, the nested document, and an investigation's history."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detectors import LIMIT
from ..operators.repeats import ranked
from .readers import Report, _conform
from .schemas import DETECTOR_RUN, REPORT, REPORT_FINDING


def write_report(report: Report, path: str, mode: str = "append") -> None:
    """`report/`, `detector_run/` and `finding/`, partitioned by `report_id`."""
    for name, df, ddl in (("report", report.report, REPORT),
                          ("detector_run", report.detector_run, DETECTOR_RUN),
                          ("finding", report.finding, REPORT_FINDING)):
        # One report is small: its rows go to one file rather than one per task.
        _conform(df, ddl).repartition("report_id").write.mode(mode).partitionBy(
            "report_id").parquet(f"{path}/{name}")


def nested(report: Report) -> DataFrame:
    """One row per report: header, and detectors each with its rows (at most 20 of a detector)."""
    row_cols = [c for c in report.finding.columns if c not in ("report_id", "detector")]
    rows = ranked(report.finding, "report_id", LIMIT).groupBy("report_id", "detector").agg(F.reverse(F.array_sort(F.collect_list(
        F.struct(F.coalesce("self_ms", "total_ms", F.lit(0.0)).alias("_by"), F.struct(
            *[F.to_json(c).alias(c) if c in ("spread", "identity") else F.col(c) for c in row_cols])
            .alias("row"))))).alias("rows"))
    runs = report.detector_run.join(rows, ["report_id", "detector"], "left").groupBy(
        "report_id").agg(F.array_sort(F.collect_list(F.struct(
            "detector", F.to_json("params").alias("params"), "params_source", "error",
            F.transform("rows", lambda r: r["row"]).alias("rows")))).alias("detectors"))
    return report.report.join(runs, "report_id", "left")


def write_documents(report: Report, path: str, mode: str = "append") -> None:
    nested(report).write.mode(mode).json(path)


def next_seq(spark: SparkSession, path: str, investigation: str) -> int:
    """One past the highest number there, not one past how many there are."""
    try:
        d = spark.read.parquet(f"{path}/report")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return 1
    top = d.where(F.col("investigation") == investigation).agg(F.max("seq")).first()[0]
    return int(top or 0) + 1


def append_report(report: Report, path: str, investigation: str) -> int:
    """Files a report under its investigation with the next number. One writer per investigation
    is assumed."""
    spark = report.report.sparkSession
    seq = next_seq(spark, path, investigation)
    for name, df in (("report", report.report), ("detector_run", report.detector_run),
                     ("finding", report.finding)):
        df.withColumns({"investigation": F.lit(investigation), "seq": F.lit(seq)}).write.mode(
            "append").partitionBy("investigation", "seq").parquet(f"{path}/{name}")
    return seq
