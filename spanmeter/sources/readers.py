"""Reading the inputs: trace tables, run logs, transcripts, thread dumps, source files, reports."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from . import schemas


@dataclass(frozen=True)
class TraceTables:
    """The eight decoded trace tables; every one carries `trace_id`."""

    process: DataFrame
    thread: DataFrame
    thread_track: DataFrame
    slice: DataFrame
    thread_state: DataFrame
    actual_frame: DataFrame
    expected_frame: DataFrame
    freeze_record: DataFrame

    def replace(self, **tables: DataFrame) -> TraceTables:
        mine = {f.name: getattr(self, f.name) for f in fields(self)}
        return TraceTables(**{**mine, **tables})

    def where_noted(self, notes: DataFrame) -> TraceTables:
        """Only the traces which `notes(trace_id)` names; the names stay distributed."""
        wanted = notes.select("trace_id").distinct()
        return TraceTables(**{f.name: getattr(self, f.name).join(wanted, "trace_id", "left_semi")
                              for f in fields(self)})

    def where_traces(self, trace_ids: list[str]) -> TraceTables:
        """Only the named traces; on partitioned tables this prunes directories."""
        return TraceTables(**{
            f.name: getattr(self, f.name).where(F.col("trace_id").isin(trace_ids))
            for f in fields(self)})


def _read(spark: SparkSession, path: str) -> DataFrame:
    """A stored table; what folder names hold stays text, so that ids like 0012 keep their zeros."""
    key = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(key, before)


def _conform(df: DataFrame, ddl: str) -> DataFrame:
    """The declared columns in order; absent ones as NULL."""
    out = []
    for part in _columns(ddl):
        name, kind = part
        out.append((F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name))
    return df.select(*out)


def _columns(ddl: str) -> list[tuple[str, str]]:
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(ddl + ","):
        depth += ch in "<(" and 1 or ch in ">)" and -1 or 0
        if ch == "," and depth == 0:
            name, kind = ddl[start:i].strip().split(" ", 1)
            parts.append((name, kind))
            start = i + 1
    return parts


def empty_tables(spark: SparkSession) -> TraceTables:
    return TraceTables(**{n: spark.createDataFrame([], s) for n, s in
                          schemas.TRACE_TABLES.items()})


UNPLACED = "ts IS NULL OR dur IS NULL"


def load_traces(spark: SparkSession, path: str, rejects: dict[str, Observation] | None = None) -> TraceTables:
    """Trace tables under `path/<table>/`, usually partitioned by `trace_id=…`.

    A table which is absent becomes an empty one: a trace without frames is silence, not an
    error. Rows whose `ts` or `dur` is NULL cannot be placed in time and are left out: they are counted while the
    table is first read, in `rejects[table].get["rejected"]`, and `unplaced_rows` gives them per trace.
    """
    tables = {}
    for name, ddl in schemas.TRACE_TABLES.items():
        try:
            df = _conform(_read(spark, f"{path}/{name}"), ddl)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
                raise
            df = spark.createDataFrame([], ddl)
        if name in ("slice", "thread_state"):
            if rejects is not None:
                rejects[name] = Observation(f"{name} of {path}")
                df = df.observe(rejects[name], F.count(F.lit(1)).alias("read"), F.count_if(F.expr(UNPLACED)).alias("rejected"))
            df = df.where(f"NOT ({UNPLACED})")
        tables[name] = df
    return TraceTables(**tables)


def unplaced_rows(spark: SparkSession, path: str) -> DataFrame:
    """`trace_id, table, rows, rejected`: rows which `load_traces` leaves out for want of a time."""
    out = None
    for name in ("slice", "thread_state"):
        one = _conform(_read(spark, f"{path}/{name}"), schemas.TRACE_TABLES[name]).groupBy("trace_id").agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(F.expr(UNPLACED)).alias("rejected")).select(
            "trace_id", F.lit(name).alias("table"), "rows", "rejected")
        out = one if out is None else out.unionByName(one)
    return out


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    """A run log, one JSON object per line; lines which do not parse are skipped."""
    return (
        spark.read.schema(schemas.RUN_LOG).option("mode", "DROPMALFORMED").json(path)
        .where(F.col("ts").isNotNull())
    )


def load_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Session transcripts: `<session>.jsonl` plus `<session>/…/agent-<id>.jsonl` of subagents.

    One row per content block. The session and the agent come from the file path; lines which
    are no JSON object are skipped.
    """
    rows = (
        spark.read.schema(schemas.TRANSCRIPT + ", _bad string")
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
        .json(path)
        .withColumn("_file", F.col("_metadata.file_path"))
        .where(F.col("_bad").isNull() & F.col("type").isNotNull())
    )
    sub = F.regexp_extract("_file", r"/([^/]+)/(?:[^/]+/)*agent-([^/]+)\.jsonl$", 2)
    own = F.regexp_extract("_file", r"/([^/]+)\.jsonl$", 1)
    parent = F.regexp_extract("_file", r"/([^/]+)/(?:subagents/)?agent-[^/]+\.jsonl$", 1)
    content = F.col("message.content")
    blocks = F.when(content.startswith("["), F.from_json(content, schemas.CONTENT_BLOCKS))
    said = F.col("block.content")
    parts = F.from_json(said, "array<struct<type:string,text:string>>")
    blocks_text = F.array_join(F.transform(F.filter(parts, lambda b: b["type"] == "text"),
                                           lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    plain = F.from_json(
        F.concat(F.lit('[{"type":"text"}]')), schemas.CONTENT_BLOCKS)
    return (
        rows.withColumn("session_id", F.when(sub != "", parent).otherwise(own))
        .withColumn("agent", F.when(sub != "", F.concat(F.lit("sub:"), sub))
                    .when(F.col("isSidechain"), F.lit("sub:inline")).otherwise(F.lit("main")))
        .withColumn("_text", F.when(~content.startswith("["), content))
        .select(
            "session_id", "agent", "type", F.col("timestamp").alias("ts"), "cwd",
            F.coalesce("message.id", "requestId", "uuid").alias("message_id"),
            F.col("message.model").alias("model"), F.col("message.usage").alias("usage"),
            "toolUseResult", "_text",
            F.posexplode_outer(F.coalesce(blocks, plain)).alias("pos", "block"))
        .select(
            "session_id", "agent", "type", "ts", "cwd", "message_id", "model", "usage",
            "toolUseResult", "pos", F.col("block.type").alias("block_type"),
            F.coalesce("block.text", "_text").alias("text"), F.col("block.id").alias("use_id"),
            F.col("block.name").alias("tool"), F.col("block.input").alias("input"),
            F.col("block.tool_use_id").alias("result_of"),
            F.when(said.startswith("["), blocks_text).otherwise(said).alias("result"), F.col("block.is_error").alias("is_error"))
    )


def load_dumps(spark: SparkSession, path: str) -> DataFrame:
    """Text thread dumps as numbered lines: `dump_id, line_no, line`; see `numbered_lines`."""
    return numbered_lines(spark, path).withColumnRenamed("file", "dump_id")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """`file, line_no, line` of text files of any size: a file is read in blocks by many tasks.

    A row's place in its block and the lines of the blocks before it give its number; what is added up is one
    row per block. Lines end at \\n, \\r\\n or \\r; a last empty line is none.
    """
    rows = (
        spark.read.option("recursiveFileLookup", "true").text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
                F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    )
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")).select(
        "file", "_block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_lines"))
    return rows.join(blocks, ["file", "_block"]).select(
        "file", (F.col("_lines") + F.col("_at") - F.col("_first") + 1).cast("int").alias("line_no"), "line")


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """`key, line_no, line` of a table of whole texts; a last empty line is none."""
    body = F.regexp_replace(F.col(text), r"\r\n?", "\n")
    lines = F.split(body, "\n")
    lines = F.when(body.endswith("\n"), F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return (
        df.select(F.col(key), F.posexplode(lines).alias("_pos", "line"))
        .select(key, (F.col("_pos") + 1).alias("line_no"), "line")
    )


# Directories a source walk does not enter.
SKIP_DIRS = ["build", ".git", ".gradle", "generated", "node_modules", ".venv", "venv", ".idea",
             "__pycache__", ".tox"]


def in_source_tree(path, skip_dirs: list[str] = SKIP_DIRS):
    """A Kotlin or Java file none of whose directories is a build or version-control one."""
    escaped = "|".join(d.replace(".", r"\.") for d in skip_dirs)
    return path.rlike(r"\.(kt|java)$") & ~path.rlike(rf"(^|/)({escaped})/")


def load_corpus(spark: SparkSession, root: str, skip_dirs: list[str] = SKIP_DIRS) -> DataFrame:
    """Source files below `root` as `path` (relative) and `text`."""
    prefix = root.rstrip("/") + "/"
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{kt,java}").text(root, wholetext=True)
        .select(F.regexp_replace(F.col("_metadata.file_path"), r"^file:/+", "/").alias("_p"),
                F.col("value").alias("text"))
        .select(F.when(F.col("_p").startswith(prefix), F.substring("_p", len(prefix) + 1, 1 << 20))
                .otherwise(F.col("_p")).alias("path"), "text")
    )
    return files.where(in_source_tree(F.col("path"), skip_dirs))


@dataclass(frozen=True)
class Report:
    """One or many reports: headers, detector runs and finding rows, joined on `report_id`."""

    report: DataFrame
    detector_run: DataFrame
    finding: DataFrame


def load_report(spark: SparkSession, path: str) -> Report:
    """Reports written by `write_report`; anything without detector runs is refused."""
    try:
        runs = _conform(_read(spark, f"{path}/detector_run"), schemas.DETECTOR_RUN)
        head = _conform(_read(spark, f"{path}/report"), schemas.REPORT)
        rows = _conform(_read(spark, f"{path}/finding"), schemas.REPORT_FINDING)
    except AnalysisException as e:
        raise ValueError(f"{path} is not a report: {e.getCondition()}") from e
    if runs.isEmpty():
        raise ValueError(f"{path} is not a report: it names no detector")
    return Report(head, runs, rows)
