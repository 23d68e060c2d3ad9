import json
from datetime import datetime, timedelta, timezone

from spanmeter.operators import runlog as rl
from spanmeter.sources.readers import load_runs
from spanmeter.sources.schemas import FINDING, TRACE_TABLES
from spanmeter.streaming.streams import read_log, stream_failures, stream_findings, stream_sittings

from planted import rows as planted_rows

T0 = datetime(2026, 1, 1, 10, tzinfo=timezone.utc)


def log(folder, name, entries):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({
        "project": p, "ts": (T0 + timedelta(minutes=m)).isoformat(), "cmd": c, "ms": ms, "exit": x,
        "version": "1"}) for p, m, c, ms, x in entries) + "\n{bad\n")


def drain(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(
        availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_sittings_equal_the_batch_form(spark, tmp_path):
    entries = [("p", 0, "analyze", 1000, 0), ("p", 2, "doctor", 25 * 60_000, 1), ("p", 50, "analyze", 5, 0),
               ("p", 240, "analyze", 5, 0), ("q", 1, "names", 10, 0)]
    log(tmp_path / "log", "a.json", entries[:3])
    log(tmp_path / "log", "b.json", entries[3:])
    # A much later run lets the watermark close what came before.
    log(tmp_path / "log", "c.json", [("z", 2000, "reflect", 1, 0)])
    got = drain(stream_sittings(read_log(spark, str(tmp_path / "log"), max_files=1)), "sat")
    batch = rl.sitting_facts(rl.sittings(rl.from_log(load_runs(spark, str(tmp_path / "log"))))).where(
        "project <> 'z'").collect()
    assert {(r.project, r.runs, r.sitting_id) for r in got} == {
        (r.project, r.runs, r.sitting_id) for r in batch}
    assert sorted(r.runs for r in got) == [1, 1, 3]


def test_nested_and_late_runs_sit_as_in_the_batch_form(spark, tmp_path):
    # A run of two hours with short ones inside: the silence counts from the run before, not from the largest end.
    entries = [("p", 0, "analyze", 120 * 60_000, 0), ("p", 10, "doctor", 1, 0), ("p", 60, "names", 1, 0), ("p", 85, "mark", None, 0),
               ("p", 150, "analyze", 1, 0), ("q", 5, "names", 10, 0), ("p", 400, "analyze", 20 * 60_000, 0), ("p", 450, "anr", 1, 0)]
    log(tmp_path / "log", "a.json", [entries[k] for k in (4, 0, 2)])
    log(tmp_path / "log", "b.json", [entries[k] for k in (3, 1, 5)])    # within the watermark, out of order
    log(tmp_path / "log", "c.json", entries[6:])
    log(tmp_path / "log", "d.json", [("z", 9000, "reflect", 1, 0)])
    got = drain(stream_sittings(read_log(spark, str(tmp_path / "log"), lateness="3 hours", max_files=1)), "nested")
    batch = rl.sitting_facts(rl.sittings(rl.from_log(load_runs(spark, str(tmp_path / "log"))))).where("project <> 'z'").collect()
    assert sorted((r.project, r.sitting_id, r.runs, r.version, round(r.ended.timestamp() * 1e6)) for r in got) == sorted(
        (r.project, r.sitting_id, r.runs, r.version, r.ended_us) for r in batch)
    assert sorted(r.runs for r in got) == [1, 1, 2, 2, 2]


def test_failures(spark, tmp_path):
    log(tmp_path / "log", "a.json", [("p", 1, "analyze", 1, 1), ("p", 3, "analyze", 1, 0),
                                     ("p", 4, "doctor", 1, 2), ("z", 999, "x", 1, 0)])
    got = {r.cmd: (r.runs, r.failures, r.last_exit) for r in drain(
        stream_failures(read_log(spark, str(tmp_path / "log"))), "failures") if r.project == "p"}
    assert got == {"analyze": (2, 1, 0), "doctor": (1, 1, 2)}


def test_findings_of_arriving_traces(spark, tmp_path):
    src, notes, out, ck = (str(tmp_path / n) for n in ("t", "notes", "out", "ck"))
    (tmp_path / "notes").mkdir()

    def arrive(trace):
        for name in TRACE_TABLES:
            spark.createDataFrame(planted_rows(trace)[name], TRACE_TABLES[name]).write.mode(
                "append").partitionBy("trace_id").parquet(f"{src}/{name}")
        (tmp_path / "notes" / f"{trace}.json").write_text(json.dumps({"trace_id": trace}))

    for trace in ("t1", "t2"):
        arrive(trace)
        q = stream_findings(spark, notes, src, out, ck, "com.example.app*", "AppStart",
                            "Screen.firstFrame", ["binder_txn", "anr"])
        q.awaitTermination()
    got = spark.read.schema(FINDING + ", batch int").parquet(out).collect()
    assert sorted((r.batch, r.trace_id, r.detector) for r in got) == [
        (0, "t1", "anr"), (0, "t1", "binder_txn"), (1, "t2", "anr"), (1, "t2", "binder_txn")]
