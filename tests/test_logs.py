import json
import random

import pytest
from pyspark.sql import functions as F

from spanmeter.functions.exprs import strip_heredocs
from spanmeter.operators import corpus as cp
from spanmeter.operators import runlog as rl
from spanmeter.operators import sessions as ss
from spanmeter.operators import signals as sg
from spanmeter.sources.readers import load_corpus, load_runs, load_transcripts

MIN = 60_000_000
H10 = 1_750_000_000_000_000


def runs(spark, rows):
    return spark.createDataFrame([("p", "analyze", H10 + m * MIN, ms, "1", 0) for m, ms in rows],
                                 "project string, cmd string, us long, ms long, version string, exit int")


def test_sittings(spark):
    got = rl.sitting_facts(rl.sittings(runs(spark, [(240, 1000), (0, 1000), (2, 1000)]))).collect()
    assert sorted(r.runs for r in got) == [1, 2]
    assert len({r.sitting_id for r in got}) == 2
    assert rl.sitting_facts(rl.sittings(runs(spark, [(0, 25 * 60_000), (35, 1)]))).count() == 1
    # exactly the gap still joins
    assert rl.sitting_facts(rl.sittings(runs(spark, [(0, 0), (30, 1)]))).count() == 1


def walked(calls, logged, slack):
    """The walk in call order, on lists of (time, id)."""
    free, pairs = sorted(logged), set()
    for us, call in sorted(calls):
        near = [r for r in free if abs(r[0] - us) <= slack]
        if near:
            best = min(near, key=lambda r: abs(r[0] - us))
            free.remove(best)
            pairs.add((call, best[1], abs(best[0] - us)))
    return pairs


def matched(spark, calls, logged, slack_s):
    c = spark.createDataFrame([("s", cmd, i, t) for cmd, t, i in calls],
                              "session_id string, cmd string, call_id long, us long")
    r = spark.createDataFrame([("s", cmd, i, t) for cmd, t, i in logged],
                              "session_id string, cmd string, run_id long, us long")
    return {(x.cmd, x.call_id, x.run_id, x.gap_us) for x in rl.match_runs(c, r, slack_s=slack_s).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matching_walks_in_call_order(spark, seed):
    rnd = random.Random(seed)
    calls, logged = ([(cmd, rnd.randrange(500) * 1_000_000, k) for cmd in "ab" for k in range(60)] for _ in "xy")
    want = {(cmd, *p) for cmd in "ab" for p in walked([(t, i) for c, t, i in calls if c == cmd],
                                                      [(t, i) for c, t, i in logged if c == cmd], 15_000_000)}
    assert matched(spark, calls, logged, 15) == want


def test_an_earlier_call_takes_the_run_a_later_one_is_nearer_to(spark):
    # Distances shrink from pair to pair: each call's nearest run is nearer to the call after it.
    at = [0]
    for step in range(12, 0, -1):
        at.append(at[-1] + step)
    events = [("a", t * 1_000_000, k) for k, t in enumerate(at)]
    got = matched(spark, events[0::2], events[1::2], 15)
    assert {(c, r) for _, c, r, _ in got} == {(k, k + 1) for k in range(0, 12, 2)}


def test_a_pause_of_just_the_slack_is_none(spark):
    got = matched(spark, [("a", 0, 1), ("a", 100_000_000, 2)], [("a", 15_000_000, 7), ("a", 84_999_999, 8)], 15)
    assert got == {("a", 1, 7, 15_000_000)}
    assert matched(spark, [("a", 5, 1)], [], 15) == matched(spark, [], [("a", 5, 1)], 15) == set()


def test_log_lines_which_do_not_parse_are_skipped(spark, tmp_path):
    (tmp_path / "runs.jsonl").write_text(
        json.dumps({"project": "p", "ts": "2026-01-01T10:00:00Z", "cmd": "doctor", "exit": 1, "ms": 5,
                    "argv": ["doctor"], "facts": {"a": "b"}}) + "\n{broken\n\n[1]\n")
    (r,) = load_runs(spark, str(tmp_path)).collect()
    assert (r.cmd, r.exit, r.facts) == ("doctor", 1, {"a": "b"})
    assert rl.last_runs(rl.from_log(load_runs(spark, str(tmp_path)))).first().exit == 1


def test_heredoc_bodies_are_data(spark):
    cmd = "cat > x <<'EOF' && ls\nspanmeter analyze\nEOF\nspanmeter doctor"
    got = spark.createDataFrame([(cmd,)], "c string").select(strip_heredocs("c")).first()[0]
    assert "analyze" not in got and "doctor" in got and got.startswith("cat > x <<'EOF' && ls\n")


def use(i, ts, tool, **inp):
    return {"type": "assistant", "timestamp": ts, "message": {"id": f"m{i}", "model": "x", "content": [
        {"type": "tool_use", "id": f"u{i}", "name": tool, "input": inp}],
        "usage": {"input_tokens": 1, "output_tokens": 10}}}


def result(i, ts, text, error=False, **more):
    return {"type": "user", "timestamp": ts, "message": {"content": [
        {"type": "tool_result", "tool_use_id": f"u{i}", "content": text, "is_error": error}]}, **more}


def transcript(tmp_path):
    t = "2026-01-01T10:%02d:00Z"
    main = [
        {"type": "user", "timestamp": t % 0, "message": {"content": "<command-name>/go</command-name>"}},
        {"type": "user", "timestamp": t % 0, "message": {"content": "why is it slow?"}},
        use(1, t % 1, "Bash", command="spanmeter analyze -c other.yml"),
        result(1, t % 2, "Exit code 2\nbad", True),
        use(2, t % 3, "Bash", command="spanmeter analyze"), result(2, t % 4, "fine " * 2000),
        use(3, t % 5, "AskUserQuestion", questions=[
            {"question": "Which?", "options": [{"label": "a (recommended)"}, {"label": "b"}]}]),
        result(3, t % 6, "b", toolUseResult={"answers": {"Which?": "b"}}),
        use(4, t % 7, "Agent", subagent_type="perf-hunter", prompt="compare traces"),
        result(4, t % 40, "done", toolUseResult={"agentId": "h1"}),
        dict(use(5, t % 41, "Read", file_path="traces/a.pftrace"))]
    main.insert(3, json.loads(json.dumps(main[2])))
    main[3]["message"]["content"] = [{"type": "text", "text": "thinking aloud"}]
    main[3]["message"]["usage"]["output_tokens"] = 250
    sub = [
        use(11, t % 8, "Bash", command="spanmeter analyze a"), result(11, t % 9, "x"),
        use(12, t % 10, "Edit", file_path="src/A.kt", old_string="a", new_string="trace(\"AGENTTMP_x\")"),
        use(13, t % 11, "Bash", command="./gradlew connectedCheck"), result(13, t % 20, "x"),
        use(14, t % 21, "Bash", command="spanmeter analyze b"), result(14, t % 22, "x"),
        {"type": "assistant", "timestamp": t % 30, "message": {"id": "m99", "content": [
            {"type": "text", "text": "Place: A.kt\nEvidence: e\nMechanism: m\nFix: f\nConfidence: high\nCleanup: no"}]}}]
    d = tmp_path / "logs"
    (d / "s1").mkdir(parents=True)
    (d / "s1.jsonl").write_text("\n".join(json.dumps(r) for r in main) + "\nnot json\n7\n")
    (d / "s1" / "agent-h1.jsonl").write_text("\n".join(json.dumps(r) for r in sub))
    return str(d)


def test_transcripts_to_signals(spark, tmp_path):
    rows = load_transcripts(spark, transcript(tmp_path)).persist()
    assert {(r.session_id, r.agent) for r in rows.select("session_id", "agent").distinct().collect()} \
        == {("s1", "main"), ("s1", "sub:h1")}
    c = ss.calls(rows).persist()
    by_id = {r.call_id: r for r in c.collect()}
    assert len(by_id) == 9
    assert (by_id["u1"].duration_s, by_id["u1"].is_error, by_id["u2"].output_chars) == (60.0, True, 10000)
    usage = {r.agent: r for r in ss.usage_totals(ss.usage_rows(rows)).collect()}
    assert (usage["main"].messages, usage["main"].output) == (5, 250 + 4 * 10)
    (q,) = ss.questions(rows).collect()
    assert (q.options, q.recommended, q.chosen, q.answered_after_s) == (
        ["a (recommended)", "b"], "a (recommended)", "b", 60)
    subs = ss.subagents(rows).persist()
    (s,) = subs.collect()
    assert (s.agent, s.type) == ("sub:h1", "perf-hunter") and "Evidence" in s.final_text
    (r,) = ss.rounds(c).collect()
    assert (r.rounds, r.analyze_calls, r.re_records) == (2, 2, 1)
    turns = ss.turns(rows)
    t = sg.SessionTables(c, turns=turns, subagents=subs)
    got = {r.signal: (r.severity, r.rows) for r in sg.run_signals(t).collect()}
    assert got["doctor_first"] == ("warn", 1)
    assert got["trace_opened_directly"] == ("warn", 1)
    assert got["tool_failures"] == ("warn", 1)
    assert got["retries"] == ("info", 1)
    assert got["config_bypassed"] == ("warn", 1)
    assert got["conclusion_shape"] == ("ok", 0)
    assert got["agent_prompt_gaps"] == ("info", 1)
    assert got["cleanup_balance"] == ("warn", 1)
    assert got["loop_in_main_context"] == ("ok", 0)
    assert got["rounds_over_max"] == ("ok", 0)
    assert got["baseline_lost"] == ("warn", 1)
    assert got["context_hogs"] == ("info", 1)
    assert got["edits_outside_allowed"] == ("info", 0)
    assert "entry_fumbling" not in got
    (x,) = sg.session_summary(sg.run_signals(t)).collect()
    assert x.warn == sum(1 for v, _ in got.values() if v == "warn")
    (l,) = ss.session_list(c, turns, t.invoked, subs).collect()
    assert (l.invocations, l.hunts, l.first_prompt) == (4, 1, "why is it slow?")
    labels = [r.label for r in ss.milestones(c, t.invoked, turns, None, subs).orderBy("us").collect()]
    assert labels[0] == "slash /go" and "agent perf-hunter finished" in labels
    assert "temporary instrumentation added" in labels


def test_rules_over_the_markers_share_one_balance(spark, tmp_path, monkeypatch):
    made, balance = [], ss.marker_balance
    monkeypatch.setattr(ss, "marker_balance", lambda *a: made.append(a) or balance(*a))
    t = sg.SessionTables(ss.calls(load_transcripts(spark, transcript(tmp_path))), allowed=["src"])
    got = {r.signal: (r.severity, r.rows) for r in sg.run_signals(t, sorted(sg.BALANCED)).collect()}
    assert len(made) == 1
    alone = {r.signal: (r.severity, r.rows) for x in sorted(sg.BALANCED) for r in sg.SIGNALS[x](t).collect()}
    assert got == alone and got["cleanup_balance"] == ("warn", 1)


def test_missing_tables_are_skipped_not_ok(spark, tmp_path):
    c = ss.calls(load_transcripts(spark, transcript(tmp_path)))
    bare = spark.createDataFrame([("s1", False)], "session_id string, tools boolean")
    got = {r.signal: r.severity for r in sg.run_signals(
        sg.SessionTables(c, carries_tools=bare)).collect()}
    assert got["entry_fumbling"] == "skip" and got["trace_opened_directly"] == "skip"
    assert got["doctor_first"] == "warn" and got["retries"] == "info"


def shell_session(spark, commands):
    rows = [("s", "main", f"c{k:02}", k * 60_000_000, "Bash", cmd, None, "", "", False, 1, "ok", None, False, False, "other", "ok", 1.0)
            for k, cmd in enumerate(commands)]
    return sg.SessionTables(spark.createDataFrame(
        rows, "session_id string, agent string, call_id string, us long, tool string, command string, path string, new_text string, "
              "old_text string, is_error boolean, output_chars long, output_head string, exit_code int, traceback boolean, "
              "shell_words boolean, env_kind string, first_line string, duration_s double"))


ANALYZE, AGAIN = "spanmeter analyze build/out/*.perfetto-trace", "./gradlew :app:connectedCheck"


@pytest.mark.parametrize("commands,lost", [
    ([ANALYZE, AGAIN], [("build/out", "no copy of the previous traces first")]),
    ([AGAIN, AGAIN], []),
    ([ANALYZE, "cp build/out/a.perfetto-trace /safe/", AGAIN], []),
    ([ANALYZE, "cp -r build/out /safe/ && ls", AGAIN], []),
    ([ANALYZE, "cp -r 'build/out/' /safe/; " + AGAIN], []),
    ([ANALYZE, "cp build/out/metrics.json /safe/", AGAIN], [("build/out", "no copy of the previous traces first")]),
    ([ANALYZE, "cp -r other/build/out /safe/", AGAIN], [("build/out", "no copy of the previous traces first")]),
    ([ANALYZE, "mv build/out build/out_before_fix", AGAIN], [("build/out", "moved to build/out_before_fix inside the build tree")]),
    ([ANALYZE, "mv build/out /safe/before", AGAIN], []),
    ([ANALYZE, 'OUT=build/out\ncp metrics.json /tmp && mv "$OUT" "${OUT}_old"', AGAIN],
     [("build/out", "moved to build/out_old inside the build tree")]),
    ([ANALYZE, "cp -r build/out /safe", ANALYZE, AGAIN], [("build/out", "no copy of the previous traces first")]),
    ([ANALYZE, "spanmeter collect --into x", AGAIN], []),
    ([ANALYZE, AGAIN, AGAIN, ANALYZE, AGAIN], [("build/out", "no copy of the previous traces first")] * 2),
    (['spanmeter analyze "$T"', AGAIN], [("?", "no copy of the previous traces first")]),
])
def test_lost_baselines(spark, commands, lost):
    got = sg.lost_baselines(shell_session(spark, commands)).orderBy("us").collect()
    assert [(r.traces_before, r.note) for r in got] == lost


def test_what_a_result_says_late_is_seen(spark, tmp_path):
    late = "a line of a build log\n" * 100
    said = [(1, late + "Traceback (most recent call last):\n  File \"x.py\""), (2, late + "Traceback (most recent call last):\n  File \"<stdin>\""),
            (3, late + "ls: No such file or directory"), (4, "\n Exit code 1 is not its first word\n7 left"), (5, [
                {"type": "text", "text": "Exit code 3"}, {"type": "image", "text": "x"}, {"type": "text", "text": "end"}])]
    rows = [use(k, "2026-01-01T10:%02d:00Z" % k, "Bash", command="x") for k, _ in said]
    rows += [use(6, "2026-01-01T10:06:00Z", "mcp__box__execute", language="sh", code="ls"),
             use(7, "2026-01-01T10:07:00Z", "Read", path="a.kt")]
    rows += [result(k, "2026-01-01T11:%02d:00Z" % k, text) for k, text in said]
    (tmp_path / "s2.jsonl").write_text("\n".join(map(json.dumps, rows)))
    c = {r.call_id: r for r in ss.calls(load_transcripts(spark, str(tmp_path))).collect()}
    assert [c[f"u{k}"].traceback for k in range(1, 6)] == [True, False, False, False, False]
    assert c["u3"].env_kind == "path not found" and len(c["u3"].output_head) == 301
    assert (c["u4"].exit_code, c["u4"].first_line) == (None, "Exit code 1 is not its first word")
    assert (c["u5"].exit_code, c["u5"].output_chars, c["u5"].output_head, c["u5"].first_line) == (3, 15, "Exit code 3\nend", "end")
    assert (c["u6"].command, c["u7"].path, c["u7"].traceback, c["u7"].env_kind) == ("ls", "a.kt", False, "other")


KT = """package a
import androidx.tracing.trace

class Repo {
  suspend fun load() {
    trace("Repo.load") {
      Trace.beginSection("inner")
      trace(name) { }
"""


def test_corpus(spark, tmp_path):
    for path, text in {
        "core/build.gradle.kts": "", "core/src/Repo.kt": KT,
        "core/net/build.gradle": "",
        "core/net/src/B.java": "public class B {\n  public void go(int a) {\n"
                               "    Trace.beginSection(\"inner\"); // AGENTTMP_ spanmeter:mark\n",
        "build/src/Gen.kt": "trace(\"no\")", "plain/P.kt": "trace(\"no import\")\nstartKoin {\n",
    }.items():
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    files = load_corpus(spark, str(tmp_path)).persist()
    assert {r.path for r in files.collect()} == {"core/src/Repo.kt", "core/net/src/B.java", "plain/P.kt"}
    lines = cp.site_lines(files)
    got = {(r.path, r.name): r.symbol for r in cp.nearest_symbol(lines).collect()}
    assert got == {("core/src/Repo.kt", "Repo.load"): "fun load", ("core/src/Repo.kt", "inner"): "fun load",
                   ("core/net/src/B.java", "inner"): "method go"}
    dirs = spark.createDataFrame([("core",), ("core/net",)], "dir string")
    stats = {r.module: (r.files, r.sites, r.dynamic) for r in
             cp.module_stats(lines, cp.file_modules(files, dirs)).collect()}
    assert stats == {":core": (1, 2, 1), ":core:net": (1, 1, 0), ":": (1, 0, 0)}
    assert [r.module for r in cp.bare_modules(cp.module_stats(
        lines, cp.file_modules(files, dirs))).collect()] == [":"]
    m = {r.name: r for r in cp.name_map(cp.trace_sites(lines)).collect()}
    assert (m["inner"].path, m["inner"].sites, m["inner"].others) == (
        "core/net/src/B.java", 2, ["core/src/Repo.kt:7"])
    (left,) = cp.leftover_markers(files, "AGENTTMP_", "spanmeter:mark").collect()
    assert (left.path, left.markers, left.removable) == ("core/net/src/B.java", 1, 1)
    assert [(r.kind, r.files) for r in cp.pattern_inventory(files).collect()] == [("di_koin", 1)]


def test_a_session_of_slash_commands_alone_is_listed(spark):
    t = shell_session(spark, ["ls"])
    turns = spark.createDataFrame(
        [("a", "main", 1, "user", "slash", "x", "/spanmeter-hunt"), ("b", "main", 1, "user", "slash", "x", "/spanmeter-reflect"),
         ("c", "main", 1, "user", "text", "hello", None)],
        "session_id string, agent string, us long, role string, kind string, text string, command string")
    assert [r.session_id for r in ss.session_list(t.calls, turns, t.invoked).collect()] == ["a"]
