"""Rules over session facts. Each gives `session_id, signal, severity, rows`.

`rows` is the number of pieces of evidence. A rule with nothing to say gives no row for the
session; one whose source table a session does not carry gives `skip`, never `ok`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import lng
from ..functions.ordered import LOG_CELL_US, carry, time_cell
from ..session import settle
from . import sessions as ss

SEVERITY = ["warn", "info", "ok", "skip"]

# Captures outside the tool, and how traces are kept, moved and named in a shell.
BYPASS = [
    ("gradle", r"gradlew\b[^\n]*(?:\bconnected\w*|AndroidTest\b)"),
    ("adb", r"\badb\s+(?:-s\s+\S+\s+)?shell\s+(?:perfetto|am\s+start|cmd\s+activity)"),
    ("perfetto", r"(?:^|\s)perfetto\s+(?:-c|--txt|-o)"),
]
DETECTOR_KEY = r"\b(?:min|max)_[a-z_]+\s*:"
PRESERVE = r"(?:^|[\s;&|(])(?:cp|rsync|tar|zip|ditto)\s"
MOVE = r"(?:^|[\s;&|(])mv\s+(?:-\S+\s+)*(\"[^\"]*\"|'[^']*'|\S+)\s+(\"[^\"]*\"|'[^']*'|\S+)"
TRACE_ARGUMENT = r"((?:\"[^\"]*\"|'[^']*'|[^\s\"'])*\.(?:perfetto-trace|pftrace))\b"
ASSIGNMENT = r"(?m)^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)=(\"[^\"]*\"|'[^']*'|\S+)"
PIECES = r"\n|;|&&|\|\|?"


@dataclass
class SessionTables:
    """Facts of any number of sessions. A table which is None was not in the source."""

    calls: DataFrame
    turns: DataFrame | None = None
    subagents: DataFrame | None = None
    runs: DataFrame | None = None          # session_id, call_id, pos, exit of matched log entries
    invoked: DataFrame | None = None
    carries_tools: DataFrame | None = None  # session_id, tools boolean; None: all carry them
    allowed: Sequence[str] = field(default_factory=tuple)
    prefix: str = ss.PREFIX
    config_name: str = ss.TOOL + ".yml"
    balance: DataFrame | None = None        # marker balance per file; None: made from the calls

    def __post_init__(self):
        if self.invoked is None:
            self.invoked = ss.subcommands(self.calls)


def _out(df: DataFrame, signal: str, severity: Column | str, rows: Column | None = None
         ) -> DataFrame:
    s = F.lit(severity) if isinstance(severity, str) else severity
    n = rows if rows is not None else F.col("n")
    return df.select("session_id", F.lit(signal).alias("signal"), s.alias("severity"),
                     n.cast("long").alias("rows"))


def _count(df: DataFrame, cond: Column | None = None) -> DataFrame:
    d = df if cond is None else df.where(cond)
    return d.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


def _shell_calls(t: SessionTables) -> DataFrame:
    return t.calls.where(F.col("command").isNotNull()).withColumn("_sh", ss.shell())


def entry_fumbling(t: SessionTables, min_slash: int = 3) -> DataFrame:
    e = ss.entry_cost(t.turns, t.subagents, t.invoked)
    return _out(e.where((F.col("slash_in_entry") >= min_slash) | (F.col("interrupts_in_entry") > 0)),
                "entry_fumbling", "info", F.col("slash_in_entry"))


def agent_prompt_gaps(t: SessionTables) -> DataFrame:
    m = ss.prompt_mentions(t.subagents)
    gap = ~(F.col("traces") & F.col("regression") & F.col("since_change"))
    return _out(_count(m, gap), "agent_prompt_gaps", "info")


def doctor_first(t: SessionTables) -> DataFrame:
    first = t.invoked.where("sub = 'analyze'").groupBy("session_id").agg(F.min("us").alias("_a"))
    d = t.invoked.where("sub = 'doctor'").join(first, "session_id").where(F.col("us") <= F.col("_a"))
    d = d.groupBy("session_id").agg(F.count(F.lit(1)).alias("_d"),
                                    F.count_if(F.col("exit") != 0).alias("_failed"))
    j = first.join(d, "session_id", "left")
    severity = F.when(F.col("_d").isNull() | (F.col("_failed") > 0), "warn").otherwise("ok")
    return _out(j, "doctor_first", severity, F.when(F.col("_d").isNull(), 1)
                .otherwise(F.col("_failed")))


def trace_opened_directly(t: SessionTables) -> DataFrame:
    read = (F.col("tool") == "Read") & F.col("path").rlike(ss.TRACE_FILE)
    hit = ss.shell().rlike(ss.TRACE_OPEN) | F.coalesce(read, F.lit(False))
    d = t.calls.groupBy("session_id").agg(F.count_if(hit).alias("n"))
    return _out(d, "trace_opened_directly", F.when(F.col("n") > 0, "warn").otherwise("ok"))


def loop_in_main_context(t: SessionTables) -> DataFrame:
    edit = (F.col("tool").isin(ss.EDIT_TOOLS) & (F.col("agent") == ss.MAIN)
            & (F.col("new_text").contains(t.prefix) | F.col("old_text").contains(t.prefix)))
    edits = t.calls.where(edit).groupBy("session_id").agg(
        F.min("us").alias("_e"), F.count(F.lit(1)).alias("_edits"))
    again = t.calls.where(F.col("agent") == ss.MAIN).join(edits, "session_id").where(
        (F.col("us") > F.col("_e")) & ss.shell().rlike(ss.RE_RECORD)).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("_again"))
    warn = _out(edits.join(again, "session_id", "left"), "loop_in_main_context", "warn",
                F.col("_edits") + F.coalesce("_again", lng(0)))
    if t.subagents is None:
        return warn
    calm = t.subagents.select("session_id").distinct().join(edits, "session_id", "left_anti")
    return warn.unionByName(_out(calm, "loop_in_main_context", "ok", lng(0)))


def rounds_over_max(t: SessionTables, limit: int = 3) -> DataFrame:
    r = ss.rounds(t.calls).groupBy("session_id").agg(
        F.count_if(F.col("rounds") > limit).alias("n"))
    return _out(r, "rounds_over_max", F.when(F.col("n") > 0, "warn").otherwise("ok"))


def _balance(t: SessionTables) -> DataFrame:
    return ss.marker_balance(t.calls, t.prefix, t.allowed) if t.balance is None else t.balance


def instrumentation_prefix(t: SessionTables) -> DataFrame:
    d = _balance(t).groupBy("session_id").agg(
        F.sum("unprefixed").alias("n"), F.sum(F.col("added") + F.col("removed") + F.col("shell"))
        .alias("_touched")).where((F.col("n") > 0) | (F.col("_touched") > 0))
    return _out(d, "instrumentation_prefix", F.when(F.col("n") > 0, "warn").otherwise("ok"))


def edits_outside_allowed(t: SessionTables) -> DataFrame:
    edited = t.calls.where(F.col("tool").isin(ss.EDIT_TOOLS)).select("session_id").distinct()
    if not t.allowed:
        return _out(edited, "edits_outside_allowed", "info", lng(0))
    bad = _count(_balance(t), F.col("outside_allowed"))
    d = edited.join(bad, "session_id", "left").fillna(0, ["n"])
    return _out(d, "edits_outside_allowed", F.when(F.col("n") > 0, "warn").otherwise("ok"))


def cleanup_balance(t: SessionTables) -> DataFrame:
    touched = _balance(t).where(F.col("added") + F.col("removed") + F.col("shell") > 0)
    files = touched.groupBy("session_id").agg(F.count_if("unbalanced").alias("_bad"),
                                              F.count(F.lit(1)).alias("_files"))
    marks = F.col("new_text").contains(t.prefix) | F.col("old_text").contains(t.prefix)
    cmd = F.coalesce("command", F.lit(""))
    by_shell = cmd.contains(t.prefix) & (cmd.rlike(ss.PY_WRITES) | cmd.rlike(ss.EDIT_VERB))
    last = t.calls.groupBy("session_id").agg(F.max(F.when(
        (F.col("tool").isin(ss.EDIT_TOOLS) & marks) | by_shell, F.col("us"))).alias("_last"))
    looks = cmd.contains("grep") & cmd.contains(t.prefix) & ~cmd.rlike(ss.PY_WRITES)
    grep = t.calls.where(looks).join(last, "session_id").where(
        F.col("us") >= F.coalesce("_last", lng(0))).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("_greps"),
        F.max_by("first_line", F.struct("us", "call_id")).alias("_seen"))
    first = F.coalesce("_seen", F.lit(""))
    number = F.regexp_extract(first, r"(?:^|[\s:])(\d+)\s*$", 1)
    # A trailing number is a count; else a line with the prefix is a leftover.
    dirty = F.when(number != "", number.cast("long") != 0).otherwise(first.contains(t.prefix))
    d = files.join(grep, "session_id", "left").withColumn("_dirty", dirty)
    warn = (F.col("_bad") > 0) | F.col("_greps").isNull() | F.col("_dirty")
    return _out(d, "cleanup_balance", F.when(warn, "warn").otherwise("ok"),
                F.when(F.col("_bad") > 0, F.col("_bad")).otherwise(F.col("_files")))


def conclusion_shape(t: SessionTables) -> DataFrame:
    d = ss.conclusion_fields(t.subagents)
    whole = F.lit(True)
    for k in ss.CONCLUSION:
        whole = whole & F.col(k)
    d = d.groupBy("session_id").agg(F.count_if(~whole).alias("n"))
    return _out(d, "conclusion_shape", F.when(F.col("n") > 0, "warn").otherwise("ok"))


def config_bypassed(t: SessionTables) -> DataFrame:
    name, p = t.config_name, F.regexp_replace("config", "[\"']", "")
    other = (F.substring_index(p, "/", -1) != name) | p.rlike(r"/scratchpad/|/T/|^/tmp/")
    used = t.invoked.where(F.col("sub").isin("analyze", "calibrate", "collect", "names")
                           & F.col("config").isNotNull() & other).select("session_id", "us")
    wrote = t.calls.where((F.col("tool") == "Write") & F.col("path").rlike(r"\.ya?ml$") & (
        F.substring_index("path", "/", -1) != name)).select("session_id", "us")
    target = F.regexp_extract_all(ss.shell(), F.lit(r">>?\s*[\"']?([^\s\"'<>|;&]+\.ya?ml)"), 1)
    piped = t.calls.where(F.col("command").isNotNull()).select(
        "session_id", "us", F.explode(target).alias("_p")).where(
        F.substring_index("_p", "/", -1) != name).select("session_id", "us")
    rows = used.unionByName(wrote).unionByName(piped)
    first = ss.config_writes(t.calls, (name,)).groupBy("session_id").agg(F.min("us").alias("_c"))
    d = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.max("us").alias("_l")).join(
        first, "session_id", "left")
    return _out(d, "config_bypassed", F.when(F.col("_l") < F.col("_c"), "info").otherwise("warn"))


def thresholds_by_hand(t: SessionTables) -> DataFrame:
    w = ss.config_writes(t.calls, (t.config_name, "local.yml")).where(
        F.col("text").rlike(DETECTOR_KEY)).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("us").alias("_w"))
    c = t.invoked.where("sub = 'calibrate'").groupBy("session_id").agg(F.min("us").alias("_c"))
    d = w.join(c, "session_id", "left")
    return _out(d, "thresholds_by_hand", F.when(F.col("_c") < F.col("_w"), "info").otherwise("warn"))


def _expanded(piece: Column, command: Column) -> Column:
    """A piece of a command with the variables that the command itself sets put in, longer names first."""
    pairs = F.arrays_zip(F.regexp_extract_all(command, F.lit(ASSIGNMENT), 1).alias("n"),
                         F.regexp_extract_all(command, F.lit(ASSIGNMENT), 2).alias("v"))
    longest = F.reverse(F.sort_array(F.transform(pairs, lambda p: F.struct(F.length(p["n"]).alias("k"), p["n"].alias("n"), p["v"].alias("v")))))

    def put(text: Column, p: Column) -> Column:
        value = F.regexp_replace(p["v"], "[\"']", "")
        return F.replace(F.replace(text, F.concat(F.lit("${"), p["n"], F.lit("}")), value), F.concat(F.lit("$"), p["n"]), value)

    return F.aggregate(longest, piece, put)


def _as_argument(folder: Column) -> Column:
    """Pattern of a folder taken whole: on its own, or with a star below it; `out` is not `build/out`."""
    return F.concat(F.lit(r"(?:^|[ \"'=])\Q"), folder, F.lit(r"\E(?:$|[ \"']|/(?:$|[\s\"']|[^\s\"']*\*))"))


def lost_baselines(t: SessionTables) -> DataFrame:
    """Recordings over traces that were analyzed and not kept: `session_id, us, call_id, agent, traces_before, note`.

    An analysis makes the traces worth keeping, a recording ends that. Between the two, copying a trace file or an
    analyzed folder as a whole keeps them, and so does moving it, but not within the build tree, which
    the next build cleans. The tool's own collect keeps the old set itself.
    """
    keys = ["session_id", "us", "call_id"]
    d = t.calls.where(F.col("command").isNotNull() & F.col("us").isNotNull()).select(
        *keys, "agent", ss.shell().alias("_sh")).where(
        F.col("_sh").rlike(ss.TOOL + r"\s+analyze\b|" + PRESERVE + "|" + MOVE) | F.col("_sh").rlike(ss.RE_RECORD))
    analysis = F.col("_sh").rlike(ss.TOOL + r"\s+analyze\b")
    argv = F.regexp_extract_all("_sh", F.lit(ss.TOOL + r"\s+analyze\b([^;&|\n]*)"), 1)
    trace = F.regexp_replace(F.regexp_extract("_argv", TRACE_ARGUMENT, 1), "[\"']", "")
    folders = (
        d.where(analysis).select(*keys, F.explode(argv).alias("_argv")).withColumn("_trace", trace)
        .where(F.col("_trace").contains("/") & ~F.col("_trace").startswith("$"))
        .select("session_id", "us", F.regexp_replace("_trace", "/[^/]*$", "").alias("folder"))
        .where("folder <> ''").groupBy("session_id", "folder").agg(F.min("us").alias("_since"))
    )
    # Pieces of commands meet the folders their session has analyzed until then: few of either.
    pieces = d.where(~analysis & F.col("_sh").rlike(PRESERVE + "|" + MOVE)).select(
        *keys, F.posexplode(F.split("_sh", PIECES)).alias("_pos", "_p"), "_sh").select(
        *keys, "_pos", _expanded(F.trim("_p"), F.col("_sh")).alias("_p"))
    source, target = (F.regexp_replace(F.regexp_extract("_p", MOVE, k), "^[\"']|[\"']$", "") for k in (1, 2))
    met = pieces.select(*keys, "_pos", F.col("_p").rlike(PRESERVE).alias("_copies"), "_p", source.alias("_from"),
                        target.alias("_to")).join(folders, "session_id", "left")
    known = F.col("_since") < F.col("us")
    parent = F.when(F.col("folder").contains("/"), F.regexp_replace("folder", "/[^/]*$", ""))
    moved = F.col("_from").rlike(ss.TRACE_FILE) | F.coalesce(known & F.regexp_like("_from", _as_argument(F.col("folder"))), F.lit(False))
    per_piece = met.groupBy(*keys, "_pos", "_copies", "_p", "_from", "_to").agg(
        F.max(F.coalesce(known & F.regexp_like("_p", _as_argument(F.col("folder"))), F.lit(False))).alias("_whole"),
        F.max(moved).alias("_moves"),
        F.max(F.when(known & F.col("_from").contains(F.col("folder")), F.col("folder"))).alias("_touched"),
        F.max(F.coalesce(known & F.col("_to").startswith(parent), F.lit(False))).alias("_near"))
    in_build = F.col("_to").contains("/build/") | F.col("_to").startswith("build/") | F.col("_near")
    kept = (F.col("_copies") & (F.col("_whole") | F.col("_p").rlike(ss.TRACE_FILE))) | (F.col("_moves") & ~in_build)
    did = per_piece.groupBy(*keys).agg(
        F.max(kept).alias("_kept"),
        F.max(F.when(F.col("_moves") & in_build, F.struct("_pos", F.col("_to").alias("to")))).alias("_moved"),
        F.max(F.when(F.col("_moves"), F.struct("_pos", F.col("_touched").alias("folder")))).alias("_touched"))
    at = F.struct("us", "call_id")
    named = d.where(analysis).select(*keys, F.regexp_replace(F.regexp_replace(F.regexp_extract(
        F.coalesce(F.get(argv, F.lit(0)), F.lit("")), TRACE_ARGUMENT, 1), "[\"']", ""), "/?[^/]*$", "").alias("_folder"))
    d = d.join(did, keys, "left").join(named, keys, "left")
    records = ~analysis & F.col("_sh").rlike(ss.RE_RECORD)
    seen = carry(d.withColumn("_records", records).withColumn("_analysis", analysis), ["session_id"], ["us", "call_id"],
                 time_cell("us", LOG_CELL_US),
                 maxes={"_last_kept": F.when(F.col("_kept"), at),
                        "_last_moved": F.when(F.col("_moved").isNotNull(), F.struct("us", "call_id", F.col("_moved.to").alias("to"))),
                        "_last_touched": F.when(F.col("_touched.folder").isNotNull(), F.struct("us", "call_id", F.col("_touched.folder").alias("folder")))},
                 maxes_before={"_last_analysis": F.when(F.col("_analysis"), F.struct("us", "call_id")),
                               "_last_folder": F.when(F.col("_folder") != "", F.struct("us", "call_id", F.col("_folder").alias("folder"))),
                               "_last_record": F.when(F.col("_records"), F.struct("us", "call_id"))})

    def since(event: str) -> Column:
        """Whether the event came after the analysis."""
        return F.col(event).isNotNull() & (F.struct(F.col(f"{event}.us"), F.col(f"{event}.call_id")) > F.col("_last_analysis"))

    lost = (F.col("_records") & ~F.col("_sh").rlike(ss.TOOL + r"\s+collect\b") & F.col("_last_analysis").isNotNull()
            & ~since("_last_record") & ~since("_last_kept"))
    return seen.where(lost).select(
        *keys, "agent", F.coalesce(F.when(since("_last_touched"), F.col("_last_touched.folder")), F.col("_last_folder.folder"), F.lit("?"))
        .alias("traces_before"),
        F.when(since("_last_moved"), F.concat(F.lit("moved to "), F.col("_last_moved.to"), F.lit(" inside the build tree")))
        .otherwise("no copy of the previous traces first").alias("note"))


def baseline_lost(t: SessionTables) -> DataFrame:
    return _out(_count(lost_baselines(t)), "baseline_lost", "warn")


def report_sliced_by_hand(t: SessionTables) -> DataFrame:
    return _out(_count(_shell_calls(t), F.col("_sh").rlike(ss.REPORT_BY_HAND)),
                "report_sliced_by_hand", "info")


def help_lookups(t: SessionTables) -> DataFrame:
    return _out(_count(t.invoked, F.col("is_help")), "help_lookups", "info")


def _invokes() -> Column:
    return F.col("_sh").rlike(r"(?:^|[\s;&|(`$/])" + ss.TOOL + r"\s+[a-z-]+")


def bypass_kinds(t: SessionTables) -> DataFrame:
    """Captures around the tool by kind: `session_id, kind, n`."""
    kind = F.lit(None).cast("string")
    for name, rx in reversed(BYPASS):
        kind = F.when(F.col("_sh").rlike(rx), F.lit(name)).otherwise(kind)
    return _shell_calls(t).where(~_invokes()).withColumn("kind", kind).where(
        "kind is not null").groupBy("session_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def bypass_tools(t: SessionTables) -> DataFrame:
    return _out(_count(bypass_kinds(t)), "bypass_tools", "info")


def _failures(t: SessionTables) -> DataFrame:
    """Invocations with `failed`; a logged exit of 0 outranks what the transcript shows."""
    d = t.invoked
    if t.runs is not None:
        d = d.join(t.runs.select("session_id", "call_id", "pos", F.col("exit").alias("_logged")),
                   ["session_id", "call_id", "pos"], "left")
    else:
        d = d.withColumn("_logged", F.lit(None).cast("int"))
    failed = (F.col("traceback") | F.col("is_error") | F.col("shell_error")
              | F.coalesce(F.col("exit") != 0, F.lit(False)))
    return d.withColumn("failed", failed & ~F.coalesce(F.col("_logged") == 0, F.lit(False)))


def tool_failures(t: SessionTables) -> DataFrame:
    d = _failures(t).where(F.col("failed") & ~F.col("is_help"))
    own = ~F.col("shell_error") & (
        F.col("_logged").isNotNull() | F.lit(t.runs is None) | F.col("traceback"))
    d = d.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(own).alias("_own"))
    return _out(d, "tool_failures", F.when(F.col("_own") > 0, "warn").otherwise("info"))


def retry_rows(t: SessionTables, within_s: int = 180) -> DataFrame:
    """Failed invocations followed at once by the same command of the same agent."""
    nxt = carry(_failures(t), ["session_id"], ["us", "call_id", "pos"],
                time_cell("us", LOG_CELL_US), leads={
                    "_n": F.struct("us", "agent", "sub", "is_help", "argv")})
    return nxt.where(
        F.col("failed") & (F.col("_n.sub") == F.col("sub")) & (F.col("_n.agent") == F.col("agent"))
        & ~F.col("is_help") & ~F.col("_n.is_help") & (F.col("_n.us") != F.col("us"))
        & (F.col("_n.us") - F.col("us") <= lng(within_s * 1_000_000))).select(
        "session_id", "call_id", "us", "agent", "sub", "argv", F.col("_n.argv").alias("then"),
        (F.col("_n.us") - F.col("us")).alias("after_us"))


def retries(t: SessionTables) -> DataFrame:
    return _out(_count(retry_rows(t)), "retries", "info")


def env_kinds(t: SessionTables) -> DataFrame:
    """Errors of other tools by kind: `session_id, kind, n`."""
    d = t.calls.where("is_error").withColumn("_sh", ss.shell())
    return d.where(~_invokes()).groupBy("session_id", F.col("env_kind").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"))


def env_friction(t: SessionTables) -> DataFrame:
    return _out(_count(env_kinds(t)), "env_friction", "info")


def code_read_by_hand(t: SessionTables, min_share: int = 20, min_calls: int = 10,
                      warn_share: int = 40) -> DataFrame:
    m = ss.window_mix(t.calls.where(F.col("agent") != ss.MAIN), prefix=t.prefix).where(
        (F.col("activity") == "source reading") & (F.col("chars") > 0)
        & ((F.col("share") >= min_share) | (F.col("calls") >= min_calls)))
    d = m.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.max("share").alias("_w"))
    return _out(d, "code_read_by_hand", F.when(F.col("_w") >= warn_share, "warn").otherwise("info"))


def long_gaps(t: SessionTables, min_s: int = 120) -> DataFrame:
    return _out(_count(ss.gaps(t.calls, min_s)), "long_gaps", "info")


def context_hogs(t: SessionTables, min_chars: int = 8000) -> DataFrame:
    return _out(_count(ss.top_outputs(t.calls), F.col("chars") >= min_chars), "context_hogs", "info")


SIGNALS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (
    entry_fumbling, agent_prompt_gaps, doctor_first, trace_opened_directly, loop_in_main_context,
    rounds_over_max, instrumentation_prefix, edits_outside_allowed, cleanup_balance,
    conclusion_shape, config_bypassed, thresholds_by_hand, baseline_lost, report_sliced_by_hand,
    help_lookups, bypass_tools, tool_failures, retries, env_friction, code_read_by_hand, long_gaps,
    context_hogs)}
# What the tool's own calls alone can answer, and which tables the other rules need.
FROM_CALLS_ALONE = {"doctor_first", "tool_failures", "retries", "help_lookups", "long_gaps"}
BALANCED = {"instrumentation_prefix", "edits_outside_allowed", "cleanup_balance"}
NEEDS = {"entry_fumbling": "turns", "agent_prompt_gaps": "subagents",
         "conclusion_shape": "subagents"}


def run_signals(t: SessionTables, names: Sequence[str] | None = None) -> DataFrame:
    """All rules as one union. A rule which lacks its table, fails to plan, or meets a session
    without the tool calls it needs gives `skip` for that session."""
    # Every rule reads the calls, and half of them the invocations.
    t = replace(t, calls=settle(t.calls), invoked=settle(t.invoked))
    if len(BALANCED.intersection(names or SIGNALS)) > 1:
        try:
            t = replace(t, balance=settle(_balance(t)))
        except PySparkException:
            pass                            # the rules say so themselves
    everyone = t.calls.select("session_id").distinct()
    out = None
    for name in names or SIGNALS:
        def skip(who: DataFrame, n=name) -> DataFrame:
            return _out(who, n, "skip", lng(0))
        if name in NEEDS and getattr(t, NEEDS[name]) is None:
            part = skip(everyone)
        else:
            try:
                part = SIGNALS[name](t)
                part.schema
            except PySparkException:
                part = skip(everyone)
            else:
                if t.carries_tools is not None and name not in FROM_CALLS_ALONE:
                    bare = t.carries_tools.where(~F.col("tools")).select("session_id")
                    part = part.join(bare, "session_id", "left_anti").unionByName(skip(bare))
        out = part if out is None else out.unionByName(part)
    return out


def by_severity(signals: DataFrame) -> DataFrame:
    """Most severe first."""
    order = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("severity"))
    return signals.orderBy("session_id", order, "signal")


def session_summary(signals: DataFrame) -> DataFrame:
    """Signals per severity and session."""
    return signals.groupBy("session_id").agg(*[
        F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY])
