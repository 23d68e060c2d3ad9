"""Schemas of every input and output table, as Spark DDL."""

from __future__ import annotations

TRACE_TABLES: dict[str, str] = {
    "process": "trace_id string, upid int, pid int, name string",
    "thread": "trace_id string, utid int, tid int, name string, upid int",
    "thread_track": "trace_id string, id int, utid int",
    "slice": "trace_id string, id long, track_id int, parent_id long, ts long, dur long, "
             "name string, depth int",
    "thread_state": "trace_id string, utid int, ts long, dur long, state string",
    "actual_frame": "trace_id string, surface_frame_token long, upid int, ts long, dur long, "
                    "jank_type string, jank_tag string",
    "expected_frame": "trace_id string, surface_frame_token long, upid int, ts long, dur long",
    "freeze_record": "trace_id string, error_id string, ts long, subject string, "
                     "anr_type string, anr_dur_ms double, upid int, pid int, process_name string",
}

FINDING = ("trace_id string, detector string, location string, count long, self_ms double, "
           "total_ms double, max_ms double, covered_ms double, detail string, "
           "extra map<string,string>")

SPREAD = "struct<min:double,max:double,values:array<double>>"

REPORT = ("report_id string, process string, pid int, duration_ms double, runs int, "
          "config_sha string, defaults boolean, start_matches long, end_matches long")

DETECTOR_RUN = ("report_id string, detector string, params map<string,string>, "
                "params_source string, identity array<string>, error string")

REPORT_FINDING = ("report_id string, detector string, location string, detail string, "
                  "identity map<string,string>, "
                  "runs int, runs_total int, count double, self_ms double, total_ms double, "
                  f"max_ms double, covered_ms double, spread map<string,{SPREAD}>")

RUN_LOG = ("project string, ts timestamp, cmd string, argv array<string>, cwd string, exit int, "
           "ms long, version string, config struct<path:string,sha:string>, "
           "facts map<string,string>, error string")

TRANSCRIPT = (
    "type string, timestamp timestamp, requestId string, uuid string, isSidechain boolean, "
    "cwd string, message struct<id:string,model:string,content:string,"
    "usage:struct<input_tokens:long,cache_read_input_tokens:long,"
    "cache_creation_input_tokens:long,output_tokens:long>>, toolUseResult string")

CONTENT_BLOCKS = ("array<struct<type:string,text:string,id:string,name:string,input:string,"
                  "tool_use_id:string,content:string,is_error:boolean>>")

INVESTIGATION = ("n long, question string, status string, opened_at timestamp, "
                 "touched_at timestamp")
