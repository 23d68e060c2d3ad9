"""Facts about assistant sessions: calls, usage, rounds, activity, cost, gaps, edits, milestones.

`calls(session_id, agent, call_id, us, tool, command, path, new_text, old_text, is_error,
output_chars, output_head, duration_s)` and the columns of `verdicts`, `us` in epoch microseconds, agent
`main` or `sub:<id>`. Command rules read the command without here-document bodies; rules on results read
what the whole result says, `output_head` is for display.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip_text, epoch_us, int_div, lng, strip_heredocs
from ..functions.ordered import LOG_CELL_US, carry, time_cell, top_k

TOOL = "spanmeter"
PREFIX = "AGENTTMP_"
MAIN = "main"

# The verbs of the command line, and the patterns session rules look for.
VERBS = ["status", "init", "hunt", "doctor", "collect", "analyze", "compare", "guide", "anr", "probe",
         "names", "domains", "mark", "calibrate", "explain", "reflect", "setup", "selftest", "help"]
RE_RECORD = (r"(?is)gradlew\b(?![^\n]*\btasks\b)[^\n]*\bconnected\w+|" + TOOL + r"\s+collect|"
             r"adb\s+shell\s+perfetto|adb\s+shell\s+am\s+start|record_android_trace")
TRACE_FILE = r"\.(perfetto-trace|pftrace)\b"
TRACE_OPEN = r"(?i)trace_processor|from\s+perfetto|import\s+perfetto|TraceProcessor\("
REPORT_BY_HAND = (r"(?s)(json\.load|jq\b|python3?\s+-c).*report\.json|"
                  r"report\.json.*(json\.load|jq\b)")
HELP_FLAG = r"(?:^|\s)(?:--help|-h)(?:\s|$)"
TRACE_CALL = (r'(?s)\btrace\s*\(\s*"|Trace\.beginSection\s*\(|beginAsyncSection\s*\(|'
              r"androidx\.tracing")
SOURCE_FILE = r"\.(?:kt|java|kts|xml|toml|properties|gradle|json|proto)\b|/src/"
READ_VERB = r"(?:^|[\s;&|(])(?:cat|sed\s+-n|head|tail|grep|rg|find|ls|wc|awk|less)\b"
BUILD = r"gradlew|\badb\s|\bsleep\s+\d|emulator\b"
REPORT_FILE = r"report\.(?:json|md)|\." + TOOL + r"/out/"
PY_WRITES = r"(?s)open\([^)]*[\"'](?:w|a|r\+)[\"']|\.write_text\(|\.write\("
EDIT_VERB = r"(?:^|[\s;&|(])(?:sed\s+-[a-zA-Z]*i|perl\s+-[a-zA-Z]*i)\b"
SHELL_ERROR = r"\(eval\):|\bcd:\d*:|no matches found|command not found: (?!" + TOOL + ")"
PLACELESS_TRACEBACK = r"Traceback \(most recent call last\):(?!\s*File \"<(?:stdin|string)>\")"
EXIT_CODE = r"(?m)^Exit code (\d+)"
ENV_KINDS = [
    ("hook redirected the call", r"(?i)hook|redirected"),
    ("missing python module", r"(?i)ModuleNotFoundError|No module named"),
    ("path not found", r"(?i)No such file or directory|no such file"),
    ("command not found", r"(?i)command not found"),
    ("permission denied", r"(?i)Permission denied"),
    ("timeout", r"(?i)timed out|timeout"),
]
SHELL_TOOLS = (r"(?i)(?:^|__)(?:ctx_execute|ctx_batch_execute|bash|shell|sh|terminal|"
               r"execute_command|run_command|run_shell_command|execute)$")
CONCLUSION = {
    "place": r"\bPlace\b|Место",
    "evidence": r"\bEvidence\b|Улик|Доказательств",
    "mechanism": r"\bMechanism\b|Механизм",
    "suggestion": r"\bSuggestion\b|\bFix\b|Предложен|Что делать|Что чинить|Что исправ|Рекоменд",
    "confidence": r"\bConfidence\b|Уверенност",
    "cleanup": r"\bCleanup\b|Уборк|Очистк",
}
CONFIDENCE = r"(?iu)(?:Confidence|Уверенность)\s*[:*]*\s*\**\s*([^\n.*(]{0,60})"
MENTIONS = {
    "traces": TRACE_FILE + r"|(?iu:\btraces?\b|трейс)",
    "regression": r"(?iu)было|стало|regress|was\b.*\bnow\b|просел|P9\d|\d+\s*(?:ms|мс|s|с)\b",
    "since_change": (r"(?iu)после\s+(?:какого|коммит|измен)|after\s+(?:which|the)\s+(?:change|commit)|"
                     r"since\s+commit|\bcommit\b|\bPR\b|\bMR\b"),
}
ACTIVITIES = [TOOL, "report reading", "source reading", "instrumentation edit", "build/device",
              "other"]
EDIT_TOOLS = ["Edit", "Write", "MultiEdit"]


def shell(c: str = "command") -> Column:
    return F.coalesce(strip_heredocs(c), F.lit(""))


def verdicts(text: Column) -> dict[str, Column]:
    """What a whole tool result says: exit code, traceback, shell error, kind of trouble, first line with text.

    Taken while calls are put together, so that the result itself need not travel.
    """
    code = F.regexp_extract(text, EXIT_CODE, 1)
    kind = F.lit("other")
    for name, rx in reversed(ENV_KINDS):
        kind = F.when(text.rlike(rx), F.lit(name)).otherwise(kind)
    lines = F.filter(F.split(text, "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("Exit code"))
    return {"exit_code": F.when(code != "", code.try_cast("int")),
            "traceback": text.rlike(PLACELESS_TRACEBACK), "shell_words": text.rlike(SHELL_ERROR),
            "env_kind": kind, "first_line": F.trim(F.coalesce(F.get(lines, F.lit(0)), F.lit("")))}


def calls(rows: DataFrame) -> DataFrame:
    """Tool uses joined with their results by id. Duration is result time less use time, at least 0.

    Takes the content blocks `load_transcripts` gives. A shell command may come through another tool than the
    usual one, as its `command`, or as `code` in a shell language.
    """
    use = rows.where((F.col("type") == "assistant") & (F.col("block_type") == "tool_use")).select(
        "session_id", "agent", F.col("use_id").alias("call_id"), epoch_us("ts").alias("us"), "tool",
        "input")
    out = F.coalesce("result", F.lit(""))
    said = rows.where((F.col("type") == "user") & (F.col("block_type") == "tool_result")).select(
        "session_id", "agent", F.col("result_of").alias("call_id"), "ts", F.struct(
            epoch_us("ts").alias("us"), "is_error", F.length(out).cast("long").alias("output_chars"),
            clip_text(out, 300).alias("output_head"),
            *[e.alias(n) for n, e in verdicts(out).items()]).alias("_s"))
    result = said.groupBy("session_id", "agent", "call_id").agg(F.max_by("_s", "ts").alias("_r"))

    def field(name: str) -> Column:
        return F.get_json_object("input", f"$.{name}")

    seconds = F.greatest(lng(0), F.col("_r.us") - F.col("us")) / F.lit(1e6)
    shell_code = F.when(F.lower(field("language")).isin("shell", "bash", "sh"), field("code"))
    command = F.when(F.col("tool").rlike(SHELL_TOOLS), F.coalesce(
        field("command"), F.nullif(F.trim(shell_code), F.lit(""))))
    none = verdicts(F.lit(""))
    return use.join(result, ["session_id", "agent", "call_id"], "left").select(
        "session_id", "agent", "call_id", "us", "tool", command.alias("command"),
        F.coalesce(field("file_path"), field("path"), field("notebook_path")).alias("path"),
        F.coalesce(field("new_string"), field("content"), F.lit("")).alias("new_text"),
        F.coalesce(field("old_string"), F.lit("")).alias("old_text"),
        F.coalesce("_r.is_error", F.lit(False)).alias("is_error"),
        F.coalesce("_r.output_chars", lng(0)).alias("output_chars"),
        F.coalesce("_r.output_head", F.lit("")).alias("output_head"),
        *[F.coalesce(F.col(f"_r.{n}"), e).alias(n) for n, e in none.items()],
        F.round(seconds, 1).alias("duration_s"), "input")


def questions(rows: DataFrame) -> DataFrame:
    """Questions put to the human: options, recommended and chosen answer, seconds to it."""
    asked = rows.where(F.col("tool") == "AskUserQuestion").select(
        "session_id", "agent", F.col("use_id").alias("call_id"), epoch_us("ts").alias("us"),
        F.explode(F.from_json(F.get_json_object("input", "$.questions"),
                              "array<struct<question:string,options:array<struct<label:string>>>>"))
        .alias("q"))
    answer = rows.where(F.col("block_type") == "tool_result").select(
        "session_id", F.col("result_of").alias("call_id"), epoch_us("ts").alias("_us"),
        F.col("toolUseResult").alias("_t"))
    reply = F.from_json(F.get_json_object("_t", "$.answers"), "map<string,string>")
    labels = F.transform("q.options", lambda o: o["label"])
    return asked.join(answer, ["session_id", "call_id"], "left").select(
        "session_id", "agent", "us", F.col("q.question").alias("question"), labels.alias("options"),
        F.get(F.filter(labels, lambda x: F.lower(x).contains("recommended")), F.lit(0))
        .alias("recommended"),
        F.element_at(reply, F.col("q.question")).alias("chosen"),
        F.round((F.col("_us") - F.col("us")) / 1e6).cast("long").alias("answered_after_s"))


def usage_totals(rows: DataFrame) -> DataFrame:
    """Token counters per session and agent. A message is written as several growing rows, so each
    counter's maximum per message is taken first, then the sum.

    Takes `session_id, agent, message_id, input, cache_read, cache_create, output`.
    """
    counters = ["input", "cache_read", "cache_create", "output"]
    per_message = rows.where(F.col("message_id").isNotNull()).groupBy(
        "session_id", "agent", "message_id").agg(*[F.max(c).alias(c) for c in counters])
    return per_message.groupBy("session_id", "agent").agg(
        F.count(F.lit(1)).alias("messages"), *[F.sum(c).alias(c) for c in counters])


def usage_rows(rows: DataFrame) -> DataFrame:
    u = F.col("usage")
    return rows.where(F.col("type") == "assistant").select(
        "session_id", "agent", "message_id", u["input_tokens"].alias("input"),
        u["cache_read_input_tokens"].alias("cache_read"),
        u["cache_creation_input_tokens"].alias("cache_create"), u["output_tokens"].alias("output"))


def turns(rows: DataFrame) -> DataFrame:
    """What human and assistant said: `kind` is text, slash or interrupt."""
    text = F.trim(F.coalesce("text", F.lit("")))
    name = F.regexp_extract(text, r"<command-name>\s*([^<\s]+)\s*</command-name>", 1)
    kind = (F.when(name != "", "slash").when(text.contains("[Request interrupted by user"),
                                             "interrupt").otherwise("text"))
    return rows.where((F.col("block_type") == "text") & (text != "")).select(
        "session_id", "agent", epoch_us("ts").alias("us"), F.col("type").alias("role"),
        kind.alias("kind"), text.alias("text"),
        F.nullif(name, F.lit("")).alias("command"))


def subagents(rows: DataFrame) -> DataFrame:
    """Launched subagents with their prompt, start, end and final text."""
    launched = rows.where((F.col("tool") == "Agent") & (F.col("block_type") == "tool_use")).select(
        "session_id", F.col("use_id").alias("call_id"), epoch_us("ts").alias("started_us"),
        F.get_json_object("input", "$.subagent_type").alias("type"),
        F.get_json_object("input", "$.prompt").alias("prompt"))
    ended = rows.where(F.col("block_type") == "tool_result").select(
        "session_id", F.col("result_of").alias("call_id"), epoch_us("ts").alias("ended_us"),
        F.concat(F.lit("sub:"), F.get_json_object("toolUseResult", "$.agentId")).alias("agent"))
    said = rows.where((F.col("agent") != MAIN) & (F.col("type") == "assistant")
                      & (F.col("block_type") == "text")).groupBy("session_id", "agent").agg(
        F.max_by("text", F.struct("ts", "pos")).alias("final_text"))
    return launched.join(ended, ["session_id", "call_id"], "left").join(
        said, ["session_id", "agent"], "left")


def subcommands(c: DataFrame, tool: str = TOOL, verbs: Sequence[str] = VERBS) -> DataFrame:
    """One row per invocation of the tool in a shell command; prose and unknown words are none."""
    pattern = r"(?:^|[\s;&|(`$/])" + tool + r"\s+([a-z-]+)((?:\s+[^;&|\n]*)?)"
    text = shell()
    hits = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("w"),
                        F.regexp_extract_all(text, F.lit(pattern), 2).alias("a"))
    d = c.where(F.col("command").contains(tool)).withColumn("_m", F.filter(
        hits, lambda m: m["w"].startswith("-") | m["w"].isin(list(verbs))))
    d = d.select("*", F.size("_m").alias("shared"), F.posexplode("_m").alias("pos", "_x"))
    sub = F.when(F.col("_x.w").startswith("-"), "help").otherwise(F.col("_x.w"))
    argv = F.trim(F.regexp_replace("_x.a", r"(?:^|\s+)\d?[<>]\S*.*$", ""))
    return d.select(
        "session_id", "agent", "call_id", "pos", "us", sub.alias("sub"), argv.alias("argv"),
        "is_error", F.coalesce("exit_code", F.when(~F.col("is_error"), 0)).alias("exit"), "output_chars", "shared",
        F.nullif(F.regexp_extract(argv, r"(?:^|\s)(?:-c|--config)\s+(\S+)", 1), F.lit(""))
        .alias("config"),
        "traceback", (F.col("shell_words") & F.col("is_error")).alias("shell_error"),
        (sub.isin("help", "explain") | argv.rlike(HELP_FLAG)).alias("is_help"))


def rounds(c: DataFrame, tool: str = TOOL) -> DataFrame:
    """Rounds per subagent: an analysis opens one when it is the first or a recording came since.

    A call which records is no analysis, whatever else it says.
    """
    text = shell()
    records = text.rlike(RE_RECORD)
    kind = F.when(records, 1).when(text.rlike(tool + r"\s+analyze\b"), 2)
    d = c.where(F.col("agent") != MAIN).select("session_id", "agent", "us", "call_id",
                                               kind.alias("kind")).where("kind is not null")
    keys = ["session_id", "agent"]
    d = carry(d, keys, ["us", "call_id"], time_cell("us", LOG_CELL_US), lags={"_before": F.col("kind")})
    # Between two analyses nothing but recordings is left, so the neighbour tells.
    opens = (F.col("kind") == 2) & (F.col("_before").isNull() | (F.col("_before") == 1))
    return d.groupBy(*keys).agg(
        F.count_if(opens).alias("rounds"), F.count_if(F.col("kind") == 2).alias("analyze_calls"),
        F.count_if(F.col("kind") == 1).alias("re_records"))


def activity(tool: str = TOOL, prefix: str = PREFIX) -> Column:
    """What a call was for; the first rule which holds decides."""
    path, cmd, text = F.coalesce("path", F.lit("")), F.coalesce("command", F.lit("")), shell()
    reads = F.col("tool") == "Read"
    edits = F.col("tool").isin(EDIT_TOOLS)
    return (
        F.when(reads & path.rlike(REPORT_FILE), "report reading")
        .when(reads & path.rlike(SOURCE_FILE), "source reading")
        .when(reads, "other")
        .when(edits & path.rlike(SOURCE_FILE), "instrumentation edit")
        .when(edits | F.col("command").isNull(), "other")
        .when(text.rlike(r"(?:^|[\s;&|(`$/])" + tool + r"\s+[a-z-]+"), tool)
        .when(cmd.rlike(REPORT_FILE), "report reading")
        .when(cmd.contains(prefix) & (cmd.rlike(PY_WRITES) | cmd.rlike(EDIT_VERB)),
              "instrumentation edit")
        .when(cmd.rlike(BUILD), "build/device")
        .when(cmd.rlike(SOURCE_FILE) & cmd.rlike(READ_VERB), "source reading")
        .otherwise("other"))


def window_mix(c: DataFrame, tool: str = TOOL, prefix: str = PREFIX) -> DataFrame:
    """Calls, output and share in percent by activity, per session and agent; and how many source
    reads came before the first edit."""
    keys = ["session_id", "agent"]
    d = c.withColumn("activity", activity(tool, prefix))
    first = d.where(F.col("activity") == "instrumentation edit").groupBy(*keys).agg(
        F.min("us").alias("_edit"))
    by = d.join(first, keys, "left").groupBy(*keys, "activity").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("output_chars").alias("chars"),
        F.count_if((F.col("activity") == "source reading")
                   & (F.col("_edit").isNull() | (F.col("us") < F.col("_edit"))))
        .alias("before_first_edit"))
    total = d.groupBy(*keys).agg(F.sum("output_chars").alias("_total"))
    share = F.when(F.col("_total") > 0, int_div(F.col("chars") * 200 + F.col("_total"),
                                                F.col("_total") * 2)).otherwise(lng(0))
    return by.join(total, keys).select(*keys, "activity", "calls", "chars", share.alias("share"),
                                       "before_first_edit")


def session_cost(c: DataFrame, t: DataFrame | None = None, asks: DataFrame | None = None
                 ) -> DataFrame:
    """Calls by main and subagents, output size, duration, user turns and questions per session."""
    is_main = F.col("agent") == MAIN
    d = c.groupBy("session_id").agg(
        F.count_if(is_main).alias("calls_main"), F.count_if(~is_main).alias("calls_sub"),
        F.sum("output_chars").alias("output_chars"), F.min("us").alias("started_us"),
        F.max("us").alias("ended_us"))
    d = d.withColumn("duration_s", int_div(F.col("ended_us") - F.col("started_us"), lng(1_000_000)))
    if t is not None:
        said = t.where((F.col("role") == "user") & (F.col("kind") == "text")).groupBy(
            "session_id").agg(F.count(F.lit(1)).alias("user_turns"))
        d = d.join(said, "session_id", "left").fillna(0, ["user_turns"])
    if asks is not None:
        n = asks.groupBy("session_id").agg(F.count(F.lit(1)).alias("asks"))
        d = d.join(n, "session_id", "left").fillna(0, ["asks"])
    return d


def tool_counts(c: DataFrame) -> DataFrame:
    """Calls per tool, main and subagents apart."""
    return c.groupBy("session_id", F.when(F.col("agent") == MAIN, MAIN).otherwise("sub").alias("side"),
                     "tool").agg(F.count(F.lit(1)).alias("calls"))


def top_outputs(c: DataFrame, n: int | None = 5) -> DataFrame:
    """The largest outputs of a session, empty ones left out."""
    d = c.where(F.col("output_chars") > 0).select(
        "session_id", "call_id", "agent", "tool", F.col("output_chars").alias("chars"),
        F.substring(F.coalesce("command", "path", F.lit("")), 1, 120).alias("what"))
    return top_k(d, ["session_id"], [F.col("chars").desc(), F.col("call_id")], n, rank="place")


def gaps(c: DataFrame, min_s: float = 120, n: int | None = 8) -> DataFrame:
    """The longest silences between consecutive calls of one agent, top n per session."""
    keys = ["session_id", "agent"]
    d = c.select(*keys, "us", "call_id", F.coalesce("command", "path", F.lit("")).alias("_what"),
                 "tool")
    d = carry(d, keys, ["us", "call_id"], time_cell("us", LOG_CELL_US),
              leads={"_next": F.col("us")})
    wait = F.col("_next") - F.col("us")
    d = d.where(wait >= lng(round(min_s * 1_000_000))).select(
        *keys, "us", "call_id", int_div(wait + lng(500_000), lng(1_000_000)).alias("seconds"),
        F.concat(F.col("tool"), F.lit(": "), F.substring("_what", 1, 80)).alias("after"))
    return top_k(d, ["session_id"], [F.col("seconds").desc(), F.col("us"), F.col("call_id")], n,
                 rank="place")


def config_writes(c: DataFrame, names: Sequence[str] = (TOOL + ".yml", "local.yml")) -> DataFrame:
    """Writes of a config file by an edit tool or from the shell: redirect, in-place edit, python."""
    base = F.substring_index(F.coalesce("path", F.lit("")), "/", -1)
    by_tool = c.where(F.col("tool").isin(EDIT_TOOLS) & base.isin(list(names))).select(
        "session_id", "agent", "call_id", "us", base.alias("file"), "tool",
        F.col("new_text").alias("text"))
    cmd = F.col("command")
    picked = None
    for name in reversed(names):
        n = name.replace(".", r"\.") + r"(?![\w.-])"
        hit = cmd.rlike(n) & (
            cmd.rlike(r">>?\s*[\"']?[^\s\"'|;&]*" + n)
            | cmd.rlike(r"(?:^|[\s;&|(])(?:sed\s+-[a-zA-Z]*i\S*|perl\s+-[a-zA-Z]*i\S*|tee|cp|mv)\b"
                        r"[^\n;|&]*" + n)
            | cmd.rlike(PY_WRITES))
        picked = F.when(hit, F.lit(name)).otherwise(picked if picked is not None else F.lit(None))
    by_shell = c.where(cmd.isNotNull()).withColumn("file", picked).where("file is not null").select(
        "session_id", "agent", "call_id", "us", "file", "tool", F.col("command").alias("text"))
    return by_tool.unionByName(by_shell)


def is_source(path: Column) -> Column:
    return (~path.startswith("/") & ~path.contains("/scratchpad/")
            & ~path.startswith("." + TOOL + "/") & path.rlike(r"\.(kt|java|kts|xml)$"))


def shell_edits(c: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """Source edits through the shell which mention the prefix, one row per file named."""
    cmd = F.col("command")
    d = c.where(cmd.contains(prefix) & (cmd.rlike(PY_WRITES) | cmd.rlike(EDIT_VERB)))
    files = F.array_distinct(F.regexp_extract_all(
        cmd, F.lit(r"(?<![\w/.-])((?:[\w.-]+/)*[\w.-]+\.(?:kt|java|kts))\b"), 1))
    return d.select("session_id", "agent", "call_id", "us", F.explode_outer(files).alias("file"))


def marker_balance(c: DataFrame, prefix: str = PREFIX, allowed: Sequence[str] = ()) -> DataFrame:
    """Per file: edits which add and remove the marker prefix, shell edits, and whether the file
    lies outside the allowed roots. `unbalanced` is judged on tool edits only."""
    new, old = F.col("new_text").contains(prefix), F.col("old_text").contains(prefix)
    tool = c.where(F.col("tool").isin(EDIT_TOOLS) & F.col("path").isNotNull()).groupBy(
        "session_id", F.col("path").alias("file")).agg(
        F.count_if(new & ~old).alias("added"), F.count_if(old & ~new).alias("removed"),
        F.count_if(F.col("new_text").rlike(TRACE_CALL) & ~new & ~F.col("old_text").rlike(TRACE_CALL))
        .alias("unprefixed"),
        F.count_if((F.col("agent") != MAIN) | new | old).alias("temporary"))
    by_shell = shell_edits(c, prefix).where("file is not null").groupBy("session_id", "file").agg(
        F.count(F.lit(1)).alias("shell"))
    zero = lng(0)
    d = tool.join(by_shell, ["session_id", "file"], "full_outer").select(
        "session_id", "file", *[F.coalesce(x, zero).alias(x) for x in (
            "added", "removed", "shell", "unprefixed", "temporary")])
    inside = F.lit(False)
    for root in allowed:
        r = root.rstrip("/")
        inside = inside | (F.col("file") == r) | F.col("file").startswith(r + "/")
    outside = F.lit(bool(allowed)) & is_source(F.col("file")) & ~inside & (
        (F.col("temporary") > 0) | (F.col("shell") > 0))
    return d.withColumns({
        "unbalanced": (F.col("added") != F.col("removed")) & (F.col("shell") == 0),
        "outside_allowed": outside})


def text_fields(texts: DataFrame, patterns: dict[str, str], column: str = "text") -> DataFrame:
    """One boolean per pattern: does the text mention it?"""
    return texts.withColumns({k: F.coalesce(F.col(column), F.lit("")).rlike(p)
                              for k, p in patterns.items()})


def conclusion_fields(subs: DataFrame) -> DataFrame:
    d = text_fields(subs, CONCLUSION, "final_text")
    return d.withColumn("confidence_text", F.nullif(F.trim(F.regexp_extract(
        F.coalesce("final_text", F.lit("")), CONFIDENCE, 1)), F.lit("")))


def prompt_mentions(subs: DataFrame) -> DataFrame:
    return text_fields(subs, MENTIONS, "prompt")


def entry_cost(t: DataFrame, subs: DataFrame | None, invoked: DataFrame) -> DataFrame:
    """Slash commands and interrupts before the first real work, and seconds to the first call.

    Work starts with the first analyze, calibrate or collect, or the first subagent.
    """
    work = invoked.groupBy("session_id").agg(
        F.min("us").alias("first_us"),
        F.min(F.when(F.col("sub").isin("analyze", "calibrate", "collect"), F.col("us"))).alias("_w"))
    start = t.groupBy("session_id").agg(F.min("us").alias("started_us"))
    d = start.join(work, "session_id", "left")
    if subs is not None:
        d = d.join(subs.groupBy("session_id").agg(F.min("started_us").alias("_s")), "session_id",
                   "left").withColumn("_w", F.least("_w", "_s")).drop("_s")
    d = d.withColumn("_end", F.coalesce("_w", "first_us"))
    early = t.where(F.col("role") == "user").join(d.select("session_id", "_end"), "session_id").where(
        F.col("_end").isNull() | (F.col("us") < F.col("_end"))).groupBy("session_id").agg(
        F.count_if(F.col("kind") == "slash").alias("slash_in_entry"),
        F.count_if(F.col("kind") == "interrupt").alias("interrupts_in_entry"))
    second = lng(1_000_000)
    return d.join(early, "session_id", "left").select(
        "session_id", F.coalesce("slash_in_entry", lng(0)).alias("slash_in_entry"),
        F.coalesce("interrupts_in_entry", lng(0)).alias("interrupts_in_entry"),
        int_div(F.col("_w") - F.col("started_us"), second).alias("entry_seconds"),
        int_div(F.col("first_us") - F.col("started_us"), second).alias("seconds_to_first_call"))


def milestones(c: DataFrame, invoked: DataFrame, t: DataFrame | None = None,
               asks: DataFrame | None = None, subs: DataFrame | None = None,
               prefix: str = PREFIX, tool: str = TOOL) -> DataFrame:
    """The marks of a session: `session_id, us, label, agent, detail`; sort by `us` to read."""
    def mark(df, label, detail=None, us="us"):
        agent = F.col("agent") if "agent" in df.columns else F.lit(MAIN)
        return df.select("session_id", F.col(us).alias("us"), label.alias("label"),
                         agent.alias("agent"), (detail if detail is not None else F.lit(""))
                         .alias("detail"))
    first = invoked.groupBy("session_id", "sub").agg(F.min_by(
        F.struct("us", "agent", F.substring("argv", 1, 80).alias("argv")),
        F.struct("us", "call_id", "pos")).alias("_f")).select("session_id", "sub", "_f.*")
    out = mark(first, F.concat(F.lit(f"first {tool} "), F.col("sub")), F.col("argv"))
    writes = config_writes(c)
    how = F.when(F.col("tool").isin(EDIT_TOOLS), F.col("tool")).otherwise(F.lit("shell wrote"))
    parts = [mark(writes, F.concat(how, F.lit(" "), F.col("file")))]
    added = (F.col("tool").isin("Edit", "Write") & F.col("new_text").contains(prefix)
             & ~F.col("old_text").contains(prefix))
    by_shell = F.col("command").contains(prefix) & (
        F.col("command").rlike(PY_WRITES) | F.col("command").rlike(EDIT_VERB))
    hit = c.where(added | F.coalesce(by_shell, F.lit(False))).groupBy("session_id").agg(F.min_by(
        F.struct("us", "agent"), F.struct("us", "call_id")).alias("_f")).select(
        "session_id", "_f.*")
    parts.append(mark(hit, F.lit("temporary instrumentation added")))
    if t is not None:
        parts.append(mark(t.where("kind = 'slash'"), F.concat(F.lit("slash "), F.col("command"))))
        parts.append(mark(t.where("kind = 'interrupt'"), F.lit("user interrupted")))
    if asks is not None:
        parts.append(mark(asks, F.lit("asked the human"), F.substring("question", 1, 80)))
    if subs is not None:
        kind = F.coalesce("type", F.lit("?"))
        s = subs.drop("agent")
        parts.append(mark(s, F.concat(F.lit("agent "), kind, F.lit(" launched")), us="started_us"))
        parts.append(mark(s.where("ended_us is not null"),
                          F.concat(F.lit("agent "), kind, F.lit(" finished")), us="ended_us"))
    for p in parts:
        out = out.unionByName(p)
    return out


def session_list(c: DataFrame, t: DataFrame, invoked: DataFrame, subs: DataFrame | None = None,
                 since_us: int | None = None, prefix: str | None = None,
                 hunter: str = "perf-hunter") -> DataFrame:
    """Sessions with start, duration, invocations, hunts and first prompt. Only those which used the
    tool for real work, by command, slash command or hunt, unless named by an id prefix. Looking back on
    sessions is no such work."""
    base = c.select("session_id", "us").unionByName(t.select("session_id", "us")).groupBy(
        "session_id").agg(F.min("us").alias("started_us"), F.max("us").alias("ended_us"))
    n = invoked.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("invocations"), F.count_if(F.col("sub") != "reflect").alias("_real"))
    first = t.where((F.col("role") == "user") & (F.col("kind") == "text")).groupBy("session_id").agg(
        F.min_by(F.substring(F.regexp_replace("text", r"\s+", " "), 1, 60), F.struct("us", "text"))
        .alias("first_prompt"))
    own = t.where((F.col("kind") == "slash") & F.col("command").startswith("/" + TOOL)
                  & (F.col("command") != f"/{TOOL}-reflect")).groupBy("session_id").agg(F.count(F.lit(1)).alias("_slash"))
    d = base.join(n, "session_id", "left").join(first, "session_id", "left").join(own, "session_id", "left")
    if subs is not None:
        d = d.join(subs.where(F.col("type") == hunter).groupBy("session_id").agg(
            F.count(F.lit(1)).alias("hunts")), "session_id", "left")
    else:
        d = d.withColumn("hunts", lng(0))
    d = d.fillna(0, ["invocations", "_real", "hunts", "_slash"])
    if since_us is not None:
        d = d.where(F.col("ended_us") >= since_us)
    d = d.where(F.col("session_id").startswith(prefix)) if prefix else d.where(
        (F.col("_real") > 0) | (F.col("_slash") > 0) | (F.col("hunts") > 0))
    return d.select("session_id", "started_us", int_div(
        F.col("ended_us") - F.col("started_us"), lng(1_000_000)).alias("duration_s"),
        "invocations", "hunts", "first_prompt")
