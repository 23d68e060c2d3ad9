"""Run-log and session queries. Events are runs of a tool and calls of a session; turns and token
usage come from conversations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import clip_text, epoch_us
from ..operators import runlog as rl
from ..operators import sessions as ss
from ..operators import signals as sg
from .bridge import table
from .sqltext import big, with_

# What a call of each kind did, chosen by event number.
COMMANDS = [
    "spanmeter analyze -c spanmeter.yml traces/a.perfetto-trace",
    "cd app && spanmeter doctor",
    "./gradlew :app:connectedCheck",
    "grep -rn AGENTTMP_ src | wc -l",
    "cat src/main/A.kt; head -5 build.gradle",
    "sed -i 's/x/AGENTTMP_x/' src/main/B.kt",
    "spanmeter names --help; spanmeter calibrate -c /tmp/draft.yml",
    "cp traces/a.perfetto-trace /backup/",
    "python3 -c 'import json; print(json.load(open(\"report.json\")))'",
    "echo min_slice_ms: 40 >> spanmeter.yml",
    "cat > notes.md <<EOF\nspanmeter analyze was run by hand\nEOF",
    "adb shell perfetto -c cfg -o out; sleep 3",
    "spanmeter analyze other.yml | tail -3",
]
SLASH = ["/go", "/spanmeter-hunt", "/spanmeter-reflect"]
# What a result says may come late in it.
LATE = "\n".join(["line of a long build log"] * 40) + "\n"
RESULTS = ["ok", "Exit code 2\nno such option", LATE + "Traceback (most recent call last):\n  File \"x.py\"",
           LATE + "No module named yaml", "zsh: command not found: foo"]


def runs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("project"), "event_id", epoch_us("ts").alias("us"),
        F.col("event_type").alias("cmd"), F.round(F.col("value") * 1000).cast("long").alias("ms"),
        F.when(F.col("event_id") % 7 == 0, 1).otherwise(0).alias("exit"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("0."), (F.col("event_id") % 5)
                                                    .cast("string"))).alias("version"))


def _array(items):
    return F.array(*[F.lit(x) for x in items])


def calls(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    i, kind = F.col("event_id"), F.col("event_type")
    agent = F.when(i % 3 == 0, "main").otherwise(F.concat(F.lit("sub:"), (F.col("user_id") % 2)
                                                          .cast("string")))
    command = F.when(kind.isin("click", "error"), F.get(_array(COMMANDS), (i % 13).cast("int")))
    path = (F.when(kind == "view", F.get(_array(
                ["src/a/A.kt", "out/report.json", "traces/x.pftrace", "README.md"]),
                (i % 4).cast("int")))
            .when(kind == "purchase", F.concat(F.lit("src/m"), (i % 6).cast("string"),
                                               F.lit("/F"), (i % 11).cast("string"), F.lit(".kt"))))
    new = F.when(kind == "purchase", F.get(_array(
        ["trace(\"AGENTTMP_a\") {", "plain", "trace(\"bare\") {"]), (i % 3).cast("int")))
    old = F.when(kind == "purchase", F.get(_array(["plain", "AGENTTMP_b", "plain"]),
                                           (i % 3).cast("int")))
    return e.select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        agent.alias("agent"), i.alias("call_id"), epoch_us("ts").alias("us"),
        F.when(kind.isin("click", "error"), "Bash").when(kind == "view", "Read")
        .when(kind == "purchase", "Edit").otherwise("Agent").alias("tool"),
        command.alias("command"), path.alias("path"), F.coalesce(new, F.lit("")).alias("new_text"),
        F.coalesce(old, F.lit("")).alias("old_text"), (kind == "error").alias("is_error"),
        F.round(F.col("value") * 100).cast("long").alias("output_chars"),
        F.when(kind == "error", F.get(_array(RESULTS), (i % 5).cast("int"))).otherwise(F.lit("ok"))
        .alias("_result"), F.lit(1.0).alias("duration_s")).withColumns(
            {"output_head": clip_text(F.col("_result"), 300), **ss.verdicts(F.col("_result"))}).drop("_result")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select(
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
        F.lit("main").alias("agent"),
        (F.lit(1704067200000000).cast("long") + F.col("conv_id") * 60_000_000
         + F.col("turn") * 30_000_000).alias("us"), "role",
        F.when((F.col("role") == "user") & (F.col("turn") == 0) & (F.col("conv_id") % 4 == 0), "slash")
        .when((F.col("role") == "user") & (F.col("conv_id") % 7 == 0), "interrupt")
        .otherwise("text").alias("kind"), "text",
        F.get(_array(SLASH), (F.col("conv_id") % 3).cast("int")).alias("command"))


def usage(spark: SparkSession, sf: str) -> DataFrame:
    """Every message twice, the first time with half its counters, as a stream would write it."""
    c = table(spark, sf, "conversations").withColumn("n", F.length("text").cast("long"))
    part = F.explode(F.array(F.lit(1), F.lit(2)))
    return c.select(
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
        F.col("role").alias("agent"),
        F.concat("conv_id", F.lit("/"), "turn").alias("message_id"), "n", part.alias("p")).select(
        "session_id", "agent", "message_id", F.expr("n * p div 2").alias("input"),
        (F.col("n") % 100).alias("cache_read"), F.col("p").cast("long").alias("cache_create"),
        F.expr("n div (3 - p)").alias("output"))


def tables(spark: SparkSession, sf: str, **more) -> sg.SessionTables:
    return sg.SessionTables(calls(spark, sf), turns=turns(spark, sf), **more)


def _matched(s, d):
    """Runs are the even events moved by a few seconds, calls are the odd ones."""
    e = runs(s, d).select(F.concat(F.lit("s"), (F.col("project") % 5).cast("string"))
                          .alias("session_id"), "cmd", "us", "event_id")
    c = e.where("event_id % 2 = 1").select("session_id", "cmd", "us", F.col("event_id").alias("call_id"))
    r = e.where("event_id % 2 = 0").select("session_id", "cmd", "us", F.col("event_id").alias("run_id"))
    return rl.match_runs(c, r, slack_s=300)


def _array_sql(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


CALLS_SQL = f"""
runs AS (
  SELECT user_id AS project, event_id, epoch_us(ts) AS us, event_type AS cmd,
         CAST(round(value * 1000) AS BIGINT) AS ms,
         CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS exit,
         CASE WHEN event_id % 3 = 0 THEN '0.' || event_id % 5 END AS version FROM events),
calls AS (
  SELECT 's' || user_id AS session_id,
         CASE WHEN event_id % 3 = 0 THEN 'main' ELSE 'sub:' || user_id % 2 END AS agent,
         event_id AS call_id, epoch_us(ts) AS us,
         CASE WHEN event_type IN ('click', 'error') THEN 'Bash' WHEN event_type = 'view' THEN 'Read'
              WHEN event_type = 'purchase' THEN 'Edit' ELSE 'Agent' END AS tool,
         CASE WHEN event_type IN ('click', 'error') THEN event_id % 13 END AS k,
         CASE WHEN event_type IN ('click', 'error')
              THEN {_array_sql(COMMANDS)}[event_id % 13 + 1] END AS command,
         CASE WHEN event_type = 'view' THEN
                ['src/a/A.kt', 'out/report.json', 'traces/x.pftrace', 'README.md'][event_id % 4 + 1]
              WHEN event_type = 'purchase' THEN 'src/m' || event_id % 6 || '/F' || event_id % 11 || '.kt'
         END AS path,
         event_type = 'error' AS is_error, event_id,
         CAST(round(value * 100) AS BIGINT) AS output_chars,
         CASE WHEN event_type = 'error' THEN {_array_sql(RESULTS)}[event_id % 5 + 1] ELSE 'ok' END AS head
  FROM events),
acts AS (
  SELECT *, CASE
    WHEN tool = 'Read' AND path = 'out/report.json' THEN 'report reading'
    WHEN tool = 'Read' AND path = 'src/a/A.kt' THEN 'source reading'
    WHEN tool = 'Edit' THEN 'instrumentation edit'
    WHEN k IN (0, 1, 6, 12) THEN 'spanmeter' WHEN k = 8 THEN 'report reading'
    WHEN k = 5 THEN 'instrumentation edit' WHEN k IN (2, 11) THEN 'build/device'
    WHEN k IN (4) THEN 'source reading' ELSE 'other' END AS activity FROM calls),
invoked AS (
  SELECT session_id, agent, call_id, us, is_error, head, output_chars,
         unnest(CASE k WHEN 0 THEN [{{'p': 0, 's': 'analyze', 'h': FALSE}}]
                       WHEN 1 THEN [{{'p': 0, 's': 'doctor', 'h': FALSE}}]
                       WHEN 6 THEN [{{'p': 0, 's': 'names', 'h': TRUE}}, {{'p': 1, 's': 'calibrate', 'h': FALSE}}]
                       WHEN 12 THEN [{{'p': 0, 's': 'analyze', 'h': FALSE}}] END) AS x
  FROM calls WHERE k IN (0, 1, 6, 12)),
subs AS (
  SELECT session_id, agent, call_id, us, x.p AS pos, x.s AS sub, x.h AS is_help, is_error,
         CASE WHEN head LIKE 'Exit code%' THEN 2 WHEN NOT is_error THEN 0 END AS exit
  FROM invoked)"""

TURNS_SQL = """
turns AS (
  SELECT 's' || conv_id AS session_id, role, text, CASE conv_id % 3 WHEN 0 THEN '/go' WHEN 1 THEN '/spanmeter-hunt'
           ELSE '/spanmeter-reflect' END AS command,
         1704067200000000 + conv_id * 60000000 + turn * 30000000 AS us,
         CASE WHEN role = 'user' AND turn = 0 AND conv_id % 4 = 0 THEN 'slash'
              WHEN role = 'user' AND conv_id % 7 = 0 THEN 'interrupt' ELSE 'text' END AS kind
  FROM conversations)"""

SIT_SQL = """
cut AS (
  SELECT *, CASE WHEN lag(us + ms * 1000) OVER w IS NULL
                   OR us - lag(us + ms * 1000) OVER w > 1800000000 THEN 1 ELSE 0 END AS c
  FROM runs WINDOW w AS (PARTITION BY project ORDER BY us, cmd)),
sat AS (
  SELECT *, CAST(sum(c) OVER (PARTITION BY project ORDER BY us, cmd ROWS UNBOUNDED PRECEDING)
              AS BIGINT) AS sitting FROM cut)"""


def _q(body: str, *ctes: str) -> str:
    return with_(CALLS_SQL, *ctes, body=body)


def _sig(name: str, severity: str, rows: str, source: str) -> str:
    return (f"SELECT session_id, '{name}' AS signal, {severity} AS severity, {big(rows)} AS \"rows\" "
            f"FROM {source}")


# The walk in call order, one call of every command at a time, with the list of runs it has taken.
_MATCH_SQL = """
sides AS (
  SELECT 's' || project % 5 AS session_id, cmd,
         list({'us': us, 'id': event_id} ORDER BY us, event_id) FILTER (event_id % 2 = 1) AS calls,
         list({'us': us, 'id': event_id} ORDER BY us, event_id) FILTER (event_id % 2 = 0) AS logged
  FROM runs GROUP BY ALL),
walk AS (
  SELECT session_id, cmd, calls, logged, 0 AS n, CAST([] AS BIGINT[]) AS taken,
         CAST(NULL AS STRUCT(gap BIGINT, us BIGINT, id BIGINT)) AS best
  FROM sides WHERE len(calls) > 0
  UNION ALL
  SELECT session_id, cmd, calls, logged, n + 1,
         CASE WHEN found IS NULL THEN taken ELSE list_append(taken, found.id) END, found
  FROM (SELECT *, list_min(list_transform(
                 list_filter(coalesce(logged, []), lambda r: abs(r.us - calls[n + 1].us) <= 300000000
                                                             AND NOT list_contains(taken, r.id)),
                 lambda r: {'gap': abs(r.us - calls[n + 1].us), 'us': r.us, 'id': r.id})) AS found
        FROM walk WHERE n < len(calls)))"""


_ROUND_SQL = """
marks AS (
  SELECT *, lag(kind) OVER (PARTITION BY session_id, agent ORDER BY us, call_id) AS before
  FROM (SELECT *, CASE WHEN k IN (2, 11) THEN 1 WHEN k IN (0, 12) THEN 2 END AS kind FROM calls
        WHERE agent <> 'main') WHERE kind IS NOT NULL),
rounds AS (
  SELECT session_id, agent,
         count(*) FILTER (kind = 2 AND (before IS NULL OR before = 1)) AS rounds,
         count(*) FILTER (kind = 2) AS analyze_calls, count(*) FILTER (kind = 1) AS re_records
  FROM marks GROUP BY session_id, agent)"""

_MIX_SQL = """
firsts AS (SELECT session_id, agent, min(us) AS e FROM acts
           WHERE activity = 'instrumentation edit' GROUP BY session_id, agent),
mix AS (
  SELECT a.session_id, a.agent, a.activity, count(*) AS calls, sum(output_chars) AS chars,
         count(*) FILTER (activity = 'source reading' AND (f.e IS NULL OR us < f.e)) AS before_first_edit
  FROM acts a LEFT JOIN firsts f ON f.session_id = a.session_id AND f.agent = a.agent
  GROUP BY a.session_id, a.agent, a.activity),
mixed AS (
  SELECT *, CASE WHEN total > 0 THEN (chars * 200 + total) // (total * 2) ELSE 0 END AS share
  FROM (SELECT *, sum(chars) OVER (PARTITION BY session_id, agent) AS total FROM mix))"""

_GAP_SQL = """
waits AS (
  SELECT *, (nxt - us + 500000) // 1000000 AS seconds FROM (
    SELECT *, lead(us) OVER (PARTITION BY session_id, agent ORDER BY us, call_id) AS nxt FROM calls)
  WHERE nxt - us >= 120000000),
top_waits AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seconds DESC, us, call_id) AS rk
  FROM waits)"""

_TOP_SQL = """
tops AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY output_chars DESC, call_id) AS rk
  FROM calls WHERE output_chars > 0)"""

_RETRY_SQL = """
fails AS (
  SELECT *, is_error OR coalesce(exit <> 0, FALSE) AS failed,
         lead(us) OVER w AS nus, lead(sub) OVER w AS nsub, lead(agent) OVER w AS nagent,
         lead(is_help) OVER w AS nhelp
  FROM subs WINDOW w AS (PARTITION BY session_id ORDER BY us, call_id, pos)),
retries AS (
  SELECT * FROM fails WHERE failed AND nsub = sub AND nagent = agent AND NOT is_help AND NOT nhelp
    AND nus <> us AND nus - us <= 86400000000)"""

_BAL_SQL = """
edits AS (
  SELECT session_id, path AS file, agent, event_id % 3 AS m FROM calls WHERE tool = 'Edit'),
balance AS (
  SELECT coalesce(t.session_id, s.session_id) AS session_id, coalesce(t.file, s.file) AS file,
         coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, coalesce(shell, 0) AS shell,
         coalesce(unprefixed, 0) AS unprefixed, coalesce(temporary, 0) AS temporary
  FROM (SELECT session_id, file, count(*) FILTER (m = 0) AS added, count(*) FILTER (m = 1) AS removed,
               count(*) FILTER (m = 2) AS unprefixed,
               count(*) FILTER (agent <> 'main' OR m IN (0, 1)) AS temporary
        FROM edits GROUP BY session_id, file) t
  FULL JOIN (SELECT session_id, 'src/main/B.kt' AS file, count(*) AS shell FROM calls WHERE k = 5
             GROUP BY session_id) s ON s.session_id = t.session_id AND s.file = t.file)"""

_DOCTOR_SQL = """
fa AS (SELECT session_id, min(us) AS a FROM subs WHERE sub = 'analyze' GROUP BY session_id),
dj AS (
  SELECT fa.session_id, d.n, d.failed FROM fa LEFT JOIN (
    SELECT s.session_id, count(*) AS n, count(*) FILTER (s.exit <> 0) AS failed
    FROM subs s JOIN fa ON fa.session_id = s.session_id
    WHERE s.sub = 'doctor' AND s.us <= fa.a GROUP BY s.session_id) d ON d.session_id = fa.session_id)"""

_SIGNAL_SQL = {
    "doctor_first": (_DOCTOR_SQL, _sig(
        "doctor_first", "CASE WHEN n IS NULL OR failed > 0 THEN 'warn' ELSE 'ok' END",
        "CASE WHEN n IS NULL THEN 1 ELSE failed END", "dj")),
    "rounds_over_max": (_ROUND_SQL, _sig(
        "rounds_over_max", "CASE WHEN n > 0 THEN 'warn' ELSE 'ok' END", "n",
        "(SELECT session_id, count(*) FILTER (rounds > 3) AS n FROM rounds GROUP BY session_id)")),
    "retries": (_RETRY_SQL.replace("86400000000", "180000000"), _sig(
        "retries", "'info'", "n",
        "(SELECT session_id, count(*) AS n FROM retries GROUP BY session_id)")),
    "code_read_by_hand": (_MIX_SQL, _sig(
        "code_read_by_hand", "CASE WHEN w >= 40 THEN 'warn' ELSE 'info' END", "n",
        "(SELECT session_id, count(*) AS n, max(share) AS w FROM mixed WHERE agent <> 'main' AND "
        "activity = 'source reading' AND chars > 0 AND (share >= 20 OR calls >= 10) "
        "GROUP BY session_id)")),
    "long_gaps": (_GAP_SQL, _sig(
        "long_gaps", "'info'", "n",
        "(SELECT session_id, count(*) AS n FROM top_waits WHERE rk <= 8 GROUP BY session_id)")),
    "context_hogs": (_TOP_SQL, _sig(
        "context_hogs", "'info'", "n",
        "(SELECT session_id, count(*) AS n FROM tops WHERE rk <= 5 AND output_chars >= 8000 "
        "GROUP BY session_id)")),
    "help_lookups": ("", _sig("help_lookups", "'info'", "n",
                              "(SELECT session_id, count(*) AS n FROM subs WHERE is_help GROUP BY session_id)")),
    "trace_opened_directly": ("", _sig(
        "trace_opened_directly", "CASE WHEN n > 0 THEN 'warn' ELSE 'ok' END", "n",
        "(SELECT session_id, count(*) FILTER (path = 'traces/x.pftrace') AS n FROM calls "
        "GROUP BY session_id)")),
    "report_sliced_by_hand": ("", _sig(
        "report_sliced_by_hand", "'info'", "n",
        "(SELECT session_id, count(*) AS n FROM calls WHERE k = 8 GROUP BY session_id)")),
    "bypass_tools": ("", _sig(
        "bypass_tools", "'info'", "n",
        "(SELECT session_id, count(DISTINCT k) AS n FROM calls WHERE k IN (2, 11) GROUP BY session_id)")),
    "env_friction": ("", _sig(
        "env_friction", "'info'", "n",
        "(SELECT session_id, count(DISTINCT CASE event_id % 5 WHEN 3 THEN 'module' WHEN 4 THEN 'command' ELSE 'other' END) AS n "
        "FROM calls WHERE is_error AND k NOT IN (0, 1, 6, 12) GROUP BY session_id)")),
    "tool_failures": ("", _sig(
        "tool_failures", "CASE WHEN own > 0 THEN 'warn' ELSE 'info' END", "n",
        "(SELECT session_id, count(*) AS n, count(*) FILTER (head NOT LIKE 'zsh:%') AS own FROM invoked "
        "WHERE is_error AND NOT x.h GROUP BY session_id)")),
    "loop_in_main_context": ("", _sig(
        "loop_in_main_context", "'warn'", "n", """
        (SELECT e.session_id, any_value(e.edits) + count(c.call_id) AS n
         FROM (SELECT session_id, min(us) AS first, count(*) AS edits FROM calls
               WHERE tool = 'Edit' AND agent = 'main' GROUP BY session_id) e
         LEFT JOIN calls c ON c.session_id = e.session_id AND c.agent = 'main' AND c.us > e.first AND c.k IN (2, 11)
         GROUP BY e.session_id)""")),
    "instrumentation_prefix": (_BAL_SQL, _sig(
        "instrumentation_prefix", "CASE WHEN n > 0 THEN 'warn' ELSE 'ok' END", "n", """
        (SELECT session_id, sum(unprefixed) AS n FROM balance GROUP BY session_id
         HAVING sum(unprefixed) > 0 OR sum(added + removed + shell) > 0)""")),
    "edits_outside_allowed": ("", _sig(
        "edits_outside_allowed", "'info'", "0", "(SELECT DISTINCT session_id FROM calls WHERE tool = 'Edit')")),
    "config_bypassed": ("", _sig(
        "config_bypassed", "CASE WHEN last < wrote THEN 'info' ELSE 'warn' END", "n", """
        (SELECT session_id, count(*) FILTER (k = 6) AS n, max(us) FILTER (k = 6) AS last,
                min(us) FILTER (k = 9) AS wrote FROM calls GROUP BY session_id HAVING count(*) FILTER (k = 6) > 0)""")),
    "thresholds_by_hand": ("", _sig(
        "thresholds_by_hand", "CASE WHEN calibrated < wrote THEN 'info' ELSE 'warn' END", "n", """
        (SELECT session_id, count(*) FILTER (k = 9) AS n, min(us) FILTER (k = 9) AS wrote,
                min(us) FILTER (k = 6) AS calibrated FROM calls GROUP BY session_id HAVING count(*) FILTER (k = 9) > 0)""")),
    "baseline_lost": ("", _sig(
        "baseline_lost", "'warn'", "n", """
        (SELECT session_id, count(*) AS n FROM (
           SELECT *, lag(kind) OVER (PARTITION BY session_id ORDER BY us, call_id) AS before
           FROM (SELECT *, CASE WHEN k IN (0, 12) THEN 1 WHEN k IN (2, 11) THEN 2 WHEN k = 7 THEN 3 END AS kind FROM calls)
           WHERE kind IS NOT NULL) WHERE kind = 2 AND before = 1 GROUP BY session_id)""")),
    "agent_prompt_gaps": ("", _sig("agent_prompt_gaps", "'skip'", "0", "(SELECT DISTINCT session_id FROM calls)")),
    "conclusion_shape": ("", _sig("conclusion_shape", "'skip'", "0", "(SELECT DISTINCT session_id FROM calls)")),
}
# Rules over a table that the sample sessions lack; alone they have nothing to read.
_SKIPPED = ("agent_prompt_gaps", "conclusion_shape")


def signal(name: str, **limits):
    return lambda s, d: sg.SIGNALS[name](tables(s, d), **limits)


def _signals_all(s, d):
    return sg.run_signals(tables(s, d, allowed=["src/m0", "src/m1"]))


def _summary(s, d):
    return sg.session_summary(sg.run_signals(tables(s, d), list(_SIGNAL_SQL)))


_SUMMARY_SQL = _q(
    "SELECT session_id, " + ", ".join(
        f"{big(f'''count(*) FILTER (severity = '{v}')''')} AS {v}" for v in sg.SEVERITY)
    + " FROM (" + " UNION ALL ".join(b for _, b in _SIGNAL_SQL.values()) + ") GROUP BY session_id",
    *[c for c, _ in _SIGNAL_SQL.values() if c])

QUERIES = {
    "sittings": (
        lambda s, d: rl.sittings(runs(s, d)).select("project", "event_id", "sitting"),
        _q("SELECT project, event_id, sitting FROM sat", SIT_SQL)),
    "sitting_facts": (
        lambda s, d: rl.sitting_facts(rl.sittings(runs(s, d))),
        _q(f"""
        SELECT project, sitting, min(us) AS started_us, arg_max(us + ms * 1000, us) AS ended_us,
               {big('count(*)')} AS runs,
               arg_max(version, us) FILTER (version IS NOT NULL) AS version,
               bool_or(cmd <> 'reflect') AS worth_reporting,
               substr(sha256(CAST(project AS VARCHAR) || chr(10)
                      || strftime(make_timestamp(min(us)), '%Y-%m-%dT%H:%M:%S.%fZ')), 1, 12)
                 AS sitting_id
        FROM sat GROUP BY project, sitting""", SIT_SQL)),
    "newest_sittings": (
        lambda s, d: rl.newest_sittings(rl.sitting_facts(rl.sittings(runs(s, d)))).select(
            "project", "sitting", "runs"),
        _q(f"""SELECT project, sitting, {big('n')} AS runs FROM (
                 SELECT project, sitting, count(*) AS n, row_number() OVER (
                        PARTITION BY project ORDER BY arg_max(us + ms * 1000, us) DESC) AS rk
                 FROM sat GROUP BY project, sitting) WHERE rk = 1""", SIT_SQL)),
    "last_runs": (
        lambda s, d: rl.last_runs(runs(s, d)),
        _q("""SELECT project, cmd, max(us) AS us, CAST(arg_max(exit, us) AS INTEGER) AS exit,
                     arg_max(ms, us) AS ms FROM runs GROUP BY project, cmd""")),
    "match_runs": (
        _matched,
        _q("SELECT session_id, cmd, calls[n].id AS call_id, best.id AS run_id, best.gap AS gap_us "
           "FROM walk WHERE best IS NOT NULL", _MATCH_SQL).replace("WITH", "WITH RECURSIVE", 1)),
    "baseline_lost": (
        lambda s, d: sg.lost_baselines(tables(s, d)).select("session_id", "call_id", "agent", "traces_before", "note"),
        _q("""
        SELECT session_id, call_id, agent, CASE WHEN named > 0 THEN 'traces' ELSE '?' END AS traces_before,
               'no copy of the previous traces first' AS note
        FROM (SELECT *, lag(kind) OVER (PARTITION BY session_id ORDER BY us, call_id) AS before,
                     count(*) FILTER (k = 0) OVER (PARTITION BY session_id ORDER BY us, call_id
                                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS named
              FROM (SELECT *, CASE WHEN k IN (0, 12) THEN 'analysis' WHEN k IN (2, 11) THEN 'recording'
                                   WHEN k = 7 THEN 'copy' END AS kind FROM calls) WHERE kind IS NOT NULL)
        WHERE kind = 'recording' AND before = 'analysis'""")),
    "usage_totals": (
        lambda s, d: ss.usage_totals(usage(s, d)),
        f"""
        SELECT 's' || conv_id AS session_id, role AS agent, {big('count(*)')} AS messages,
               {big('sum(length(text))')} AS input, {big('sum(length(text) % 100)')} AS cache_read,
               {big('sum(2)')} AS cache_create, {big('sum(length(text))')} AS output
        FROM conversations GROUP BY conv_id, role"""),
    "subcommands": (
        lambda s, d: ss.subcommands(calls(s, d)).select(
            "session_id", "agent", "call_id", "pos", "sub", "is_help", "exit"),
        _q("SELECT session_id, agent, call_id, CAST(pos AS INTEGER) AS pos, sub, is_help, "
           "CAST(exit AS INTEGER) AS exit FROM subs")),
    "rounds": (
        lambda s, d: ss.rounds(calls(s, d)),
        _q(f"SELECT session_id, agent, {big('rounds')} AS rounds, {big('analyze_calls')} AS "
           f"analyze_calls, {big('re_records')} AS re_records FROM rounds", _ROUND_SQL)),
    "activity_mix": (
        lambda s, d: ss.window_mix(calls(s, d)),
        _q(f"SELECT session_id, agent, activity, {big('calls')} AS calls, {big('chars')} AS chars, "
           f"{big('share')} AS share, {big('before_first_edit')} AS before_first_edit FROM mixed",
           _MIX_SQL)),
    "session_cost": (
        lambda s, d: ss.session_cost(calls(s, d), turns(s, d)),
        _q(f"""
        SELECT c.session_id, {big("count(*) FILTER (agent = 'main')")} AS calls_main,
               {big("count(*) FILTER (agent <> 'main')")} AS calls_sub,
               {big('sum(output_chars)')} AS output_chars, min(us) AS started_us,
               max(us) AS ended_us, {big('(max(us) - min(us)) // 1000000')} AS duration_s,
               {big('coalesce(any_value(t.n), 0)')} AS user_turns
        FROM calls c LEFT JOIN (SELECT session_id, count(*) AS n FROM turns
                                WHERE role = 'user' AND kind = 'text' GROUP BY session_id) t
          ON t.session_id = c.session_id GROUP BY c.session_id""", TURNS_SQL)),
    "tool_counts": (
        lambda s, d: ss.tool_counts(calls(s, d)),
        _q(f"""SELECT session_id, CASE WHEN agent = 'main' THEN 'main' ELSE 'sub' END AS side, tool,
                      {big('count(*)')} AS calls FROM calls GROUP BY 1, 2, 3""")),
    "top_outputs": (
        lambda s, d: ss.top_outputs(calls(s, d)).drop("what"),
        _q("SELECT session_id, call_id, agent, tool, output_chars AS chars, "
           "CAST(rk AS INTEGER) AS place FROM tops WHERE rk <= 5", _TOP_SQL)),
    "session_gaps": (
        lambda s, d: ss.gaps(calls(s, d)),
        _q(f"""SELECT session_id, agent, us, call_id, {big('seconds')} AS seconds,
                      tool || ': ' || substr(coalesce(command, path, ''), 1, 80) AS after,
                      CAST(rk AS INTEGER) AS place FROM top_waits WHERE rk <= 8""", _GAP_SQL)),
    "entry_cost": (
        lambda s, d: ss.entry_cost(turns(s, d), None, ss.subcommands(calls(s, d))),
        _q(f"""
        SELECT d.session_id, {big("coalesce(e.sl, 0)")} AS slash_in_entry,
               {big("coalesce(e.it, 0)")} AS interrupts_in_entry,
               {big('(w - started) // 1000000')} AS entry_seconds,
               {big('(f - started) // 1000000')} AS seconds_to_first_call
        FROM starts d LEFT JOIN (
          SELECT t.session_id, count(*) FILTER (kind = 'slash') AS sl,
                 count(*) FILTER (kind = 'interrupt') AS it
          FROM turns t JOIN starts d ON d.session_id = t.session_id
          WHERE role = 'user' AND (coalesce(w, f) IS NULL OR us < coalesce(w, f))
          GROUP BY t.session_id) e ON e.session_id = d.session_id""", TURNS_SQL, """
        starts AS (
          SELECT t.session_id, t.started, s.f, s.w
          FROM (SELECT session_id, min(us) AS started FROM turns GROUP BY session_id) t
          LEFT JOIN (SELECT session_id, min(us) AS f,
                            min(CASE WHEN sub IN ('analyze', 'calibrate', 'collect') THEN us END) AS w
                     FROM subs GROUP BY session_id) s ON s.session_id = t.session_id)""")),
    "milestones": (
        lambda s, d: ss.milestones(calls(s, d), ss.subcommands(calls(s, d)), turns(s, d)).select(
            "session_id", "us", "label", "agent"),
        _q("""
        SELECT session_id, min(us) AS us, 'first spanmeter ' || sub AS label,
               arg_min(agent, us) AS agent FROM subs GROUP BY session_id, sub
        UNION ALL SELECT session_id, us, 'shell wrote spanmeter.yml', agent FROM calls WHERE k = 9
        UNION ALL SELECT session_id, min(us), 'temporary instrumentation added', arg_min(agent, us)
          FROM calls WHERE k = 5 OR (tool = 'Edit' AND event_id % 3 = 0) GROUP BY session_id
        UNION ALL SELECT session_id, us, 'slash ' || command, 'main' FROM turns WHERE kind = 'slash'
        UNION ALL SELECT session_id, us, 'user interrupted', 'main' FROM turns
          WHERE kind = 'interrupt'""", TURNS_SQL)),
    "marker_balance": (
        lambda s, d: ss.marker_balance(calls(s, d), allowed=["src/m0", "src/m1"]),
        _q(f"""SELECT session_id, file, {', '.join(f'{big(c)} AS {c}' for c in ('added', 'removed', 'shell', 'unprefixed', 'temporary'))},
                      added <> removed AND shell = 0 AS unbalanced,
                      NOT (file LIKE 'src/m0/%' OR file LIKE 'src/m1/%')
                        AND (temporary > 0 OR shell > 0) AS outside_allowed FROM balance""", _BAL_SQL)),
    "config_writes": (
        lambda s, d: ss.config_writes(calls(s, d)).drop("text"),
        _q("SELECT session_id, agent, call_id, us, 'spanmeter.yml' AS file, tool FROM calls "
           "WHERE k = 9")),
    "session_list": (
        lambda s, d: ss.session_list(calls(s, d), turns(s, d), ss.subcommands(calls(s, d))).drop(
            "first_prompt"),
        _q(f"""
        SELECT b.session_id, min(b.us) AS started_us, {big('(max(b.us) - min(b.us)) // 1000000')}
                 AS duration_s, {big('coalesce(any_value(n.n), 0)')} AS invocations, CAST(0 AS BIGINT) AS hunts
        FROM (SELECT session_id, us FROM calls UNION ALL SELECT session_id, us FROM turns) b
        LEFT JOIN (SELECT session_id, count(*) AS n FROM subs GROUP BY session_id) n USING (session_id)
        GROUP BY b.session_id
        HAVING any_value(n.n) > 0 OR b.session_id IN (
          SELECT session_id FROM turns WHERE kind = 'slash' AND command = '/spanmeter-hunt')""", TURNS_SQL)),
    "prompt_mentions": (
        lambda s, d: ss.text_fields(table(s, d, "conversations"), {
            "opens": "(?i)^the", "number": r"\d+", "question": r"\?"}).drop("text"),
        """SELECT conv_id, turn, role, regexp_matches(text, '(?i)^the') AS "opens",
                  regexp_matches(text, '[0-9]+') AS "number", contains(text, '?') AS question
           FROM conversations"""),
    "retry_rows": (
        lambda s, d: sg.retry_rows(tables(s, d), 86400).select(
            "session_id", "call_id", "us", "agent", "sub", "after_us"),
        _q("SELECT session_id, call_id, us, agent, sub, nus - us AS after_us FROM retries",
           _RETRY_SQL)),
    **{f"signal_{n}": (signal(n), _q(body, *([c] if c else [])))
       for n, (c, body) in _SIGNAL_SQL.items() if n not in _SKIPPED},
    "signals_all": (_signals_all, None),
    "session_summary": (_summary, _SUMMARY_SQL),
}
