"""Detectors that fail, detectors of one's own, and what a report carries of them."""

from spanmeter.operators import context as cx
from spanmeter.operators.analyze import analyze
from spanmeter.operators.registry import custom_detector, guarded, run_detectors

from planted import tables

OWN = "SELECT trace_id, name AS location, thread_name, count(*) AS count, 1.0 AS total_ms FROM slice_win GROUP BY 1, 2, 3"
BROKEN = "SELECT trace_id, name AS location, CAST(CAST(max(name) AS INT) AS DOUBLE) AS total_ms FROM slice_win GROUP BY 1, 2"


def broken(ctx):
    return custom_detector(ctx, BROKEN, name="broken")


def own(ctx):
    return custom_detector(ctx, OWN, name="own", identity=("location", "thread_name"), limit=None)


def test_a_detector_that_fails_while_running_leaves_the_others(spark):
    ctx = cx.build_context(tables(spark, ("t1",)), "com.example.app*", "AppStart", "Screen.firstFrame")
    planned = run_detectors(ctx, ["gc_pressure", "anr", "anr_risk"], {"anr_risk": {"max_gap_ms": -1}}, extra={"broken": broken, "own": own})
    done = guarded(planned)
    errors = {r["detector"]: r["error"] for r in done.runs}
    assert errors["gc_pressure"] is errors["anr"] is errors["own"] is None
    assert "CAST_INVALID_INPUT" in errors["broken"] and "max_gap_ms" in errors["anr_risk"]
    assert {r.detector for r in done.findings.select("detector").distinct().collect()} == {"gc_pressure", "anr", "own"}
    assert sorted(done.per_detector) == ["anr", "gc_pressure", "own"]
    fine = guarded(run_detectors(ctx, ["gc_pressure"]))
    assert fine.per_detector["gc_pressure"].count() == fine.findings.count() == 2


def test_reports_carry_identity_errors_and_config(spark):
    report = analyze(tables(spark, ("t1",)), "com.example.app*", "AppStart", "Screen.firstFrame", names=["gc_pressure"],
                     config={"gc_pressure": {"max_events": 10}}, extra={"own": own, "broken": broken})
    runs = {r.detector: r for r in report.detector_run.collect()}
    assert runs["gc_pressure"].params["max_events"] == "10" and runs["gc_pressure"].identity == ["location", "detail"]
    assert runs["broken"].error is not None and runs["own"].error is None
    found = report.finding.collect()
    assert {r.detector for r in found} == {"gc_pressure", "own"}
    assert all(sorted(r.identity) == ["location", "thread_name"] for r in found if r.detector == "own")
    assert not report.report.first().defaults
