"""Text thread dumps as tables: producer, header, threads, frames, locks, load, idleness.

Input is `dump_id, line_no, line` for any number of dumps. One ordered pass over the lines finds
the thread, process and entry every line belongs to; the rest are projections of that.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import lng
from ..functions.ordered import carry, line_cell, top_k
from ..session import settle

# How each producer announces a thread. Groups are named by `fields`, in order.
# `indented`: the body is indented, so an unindented line ends the thread.


@dataclass(frozen=True)
class Producer:
    name: str
    signature: str
    fields: tuple[str, ...]
    native: str
    lock: str | None
    held: str | None
    noise: str | None
    lock_on_signature: bool
    indented: bool


PRODUCERS = [
    Producer(
        "crashlytics",
        r"^(.+?) \(([^)]*)\):tid=(-?\d+) systid=(-?\d+)\s*(?:\|\s*(.*))?$",
        ("name", "state", "tid", "systid", "note"),
        r"^\s*(?:native:\s*)?#\d+ pc 0x[0-9a-f]+ \S+",
        r"waiting to lock <(0x[0-9a-f]+)> \(([^)]*)\) held by thread (-?\d+)",
        None, None, True, False),
    Producer(
        "dumpsys",
        r'^"([^"]*)"(?:\s+daemon)?\s+(?:prio=\d+\s+tid=(-?\d+)\s+([A-Za-z]\w*)'
        r"|prio=\d+\s+\((not attached)\)|sysTid=(\d+))(?:\s+\(.*\))?\s*$",
        ("name", "tid", "state", "detached", "systid"),
        r"^\s*(?:native:\s*)?#\d+ pc [0-9a-fx]+\s+\S+",
        r"^\s*- waiting to lock <(0x[0-9a-f]+)>\s+\(a ([^)]*)\) held by thread (-?\d+)",
        r"^\s*- locked <(0x[0-9a-f]+)>",
        r"^\s*(?:- (?:waiting on|sleeping on) <0x[0-9a-f]+>.*|\(no managed stack frames\)"
        r"|DumpLatencyMs:.*|\|.*)$", False, True),
    Producer(
        "play", r'^"([^"]*)" tid=(-?\d+) (.+?)\s*$', ("name", "tid", "state"),
        r"^\s*#\d+\s+pc\s+[0-9a-fx]+\s+\S+", None, None, None, False, True),
]
FRAME = r"^\s+at (.+)$"
HEADER = r"^#?\s*([A-Za-z][A-Za-z _-]*):\s?(.*)$"
PROCESS = r"^-{2,}\s*pid \d+ at .*-{2,}\s*$"
CMDLINE = r"^Cmd line: (\S+)"
ENTRY = r"^={20,}\s*$"
LOAD = r"^\s*([\d.]+)% (\d+)/(.+?):\s(.*)$"
SYS_TID = r"^\s*\|\s*sysTid=(\d+)"
SCAFFOLD = (r"^(?:-{2,}.*-{2,}\s*|DALVIK THREADS \(\d+\):|suspend all histogram:.*|CPU usage from .*"
            r"|\s*[+-]?[\d.]+% .*|\d{4}-\d\d-\d\d \d\d:\d\d:\d\d \w+ \(.*\)\s*)$")

# Reasons a thread is idle, with the stack texts which mean only that.
IDLE: list[tuple[str, list[str]]] = [
    ("looper idle", ["android.os.MessageQueue.nativePollOnce"]),
    ("pool waiting for work", [
        "java.util.concurrent.ThreadPoolExecutor.getTask",
        "java.util.concurrent.LinkedBlockingQueue.take",
        "java.util.concurrent.PriorityBlockingQueue.take",
        "java.util.concurrent.ArrayBlockingQueue.take",
        "ScheduledThreadPoolExecutor$DelayedWorkQueue.take",
        "java.util.concurrent.SynchronousQueue.poll"]),
    ("coroutine worker parked", [
        "CoroutineScheduler$Worker.park", "CoroutineScheduler$Worker.tryPark"]),
    ("runtime daemon", ["java.lang.Daemons$"]),
    ("binder pool waiting", ["IPCThreadState::joinThreadPool"]),
    ("runtime housekeeping", [
        "ThreadPoolWorker::Run", "ProfileSaver::RunProfileSaverThread",
        "TaskProcessor::RunAllTasks", "SignalCatcher::Run", "walSyncThreadFunc",
        "libperfetto_hprof.so"]),
    ("library idle loop", [
        "java.util.TimerThread.mainLoop", "com.google.android.gms.dynamite.zza.run",
        "okhttp3.internal.concurrent.TaskRunner"]),
    ("waiting on a descriptor", [
        "__epoll_pwait", "__ppoll", "java.nio.channels.Selector.select"]),
    ("sleeping", ["__futex_wait", "pthread_cond_wait", "java.lang.Thread.sleep"]),
]

# Packages of the platform, the runtime and common libraries.
PLATFORM = ["java.", "javax.", "jdk.", "sun.", "libcore.", "dalvik.", "android.", "androidx.",
            "com.android.", "kotlin.", "kotlinx.", "com.google.", "okhttp3.", "okio.",
            "retrofit2.", "io.reactivex."]


def detect_producer(lines: DataFrame, producers: Sequence[Producer] = PRODUCERS) -> DataFrame:
    """Whose signature matches most lines of the dump; ties go to the earlier producer."""
    line = F.rtrim("line")
    hits = lines.groupBy("dump_id").agg(*[
        F.count_if(line.rlike(p.signature)).alias(f"_{i}") for i, p in enumerate(producers)])
    best = F.array_max(F.array(*[
        F.struct(F.col(f"_{i}").alias("n"), F.lit(-i).alias("rank"), F.lit(p.name).alias("name"))
        for i, p in enumerate(producers)]))
    return hits.select("dump_id", best["n"].alias("signatures"),
                       F.when(best["n"] > 0, best["name"]).alias("producer"))


def normalise_state(c: Column | str) -> Column:
    """`TimedWaiting` and `timed waiting` become one word."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(c, r"(?<=[a-z])(?=[A-Z])", " "))


def _by_producer(pick) -> Column:
    e = None
    for p in PRODUCERS:
        hit = F.col("producer") == p.name
        e = F.when(hit, pick(p)) if e is None else e.when(hit, pick(p))
    return e


def _part(p: Producer, field: str) -> Column:
    if field not in p.fields:
        return F.lit("")
    return F.regexp_extract("text", p.signature, p.fields.index(field) + 1)


def segment_threads(lines: DataFrame) -> DataFrame:
    """Every line with the thread, process and region it belongs to.

    Adds `producer`, `thread_no` (0 before the first thread), `in_thread`, `process`, `is_sig`,
    and drops what follows the first dump entry. Settled, as all dump tables read it.
    """
    d = lines.join(detect_producer(lines).select("dump_id", F.coalesce(
        "producer", F.lit(PRODUCERS[0].name)).alias("producer")), "dump_id")
    d = d.withColumn("text", F.rtrim("line")).where(F.length(F.trim("text")) > 0)
    d = d.withColumn("is_sig", _by_producer(lambda p: F.col("text").rlike(p.signature)))
    named = F.regexp_extract("text", CMDLINE, 1)
    block, entry = F.col("text").rlike(PROCESS), F.col("text").rlike(ENTRY)
    flush = _by_producer(lambda p: ~F.col("line").rlike(r"^\s") if p.indented else F.lit(False))
    ends = ~F.col("is_sig") & (flush | block | (named != "") | entry)
    at = F.col("line_no").cast("long")
    # The expressions above are the costly part, and the ordered pass reads its input twice.
    d = settle(d.withColumns({"is_entry": ~F.col("is_sig") & entry, "_ends": ends,
                              "_block": block, "_cmd": named}))
    block, named = F.col("_block"), F.col("_cmd")
    d = carry(d, ["dump_id"], ["line_no"], line_cell(),
              sums={"thread_no": F.when(F.col("is_sig"), lng(1)).otherwise(lng(0))},
              maxes={"_sig": F.when(F.col("is_sig"), at), "_end": F.when(F.col("_ends"), at),
                     "_entry": F.when(F.col("is_entry"), at),
                     "_first": F.when(F.col("is_sig"), -at),
                     "_proc": F.when(block | (named != ""), F.struct(
                         at.alias("at"), F.when(block, F.lit("")).otherwise(named).alias("name")))})
    past_end = F.col("_first").isNotNull() & (F.coalesce("_entry", lng(0)) > -F.col("_first"))
    return settle(d.where(~past_end).select(
        "dump_id", "line_no", "text", "producer", "is_sig", "is_entry", "thread_no",
        (F.coalesce("_sig", lng(0)) > F.coalesce("_end", lng(0))).alias("in_thread"),
        F.coalesce("_proc.name", F.lit("")).alias("process")))


def dump_threads(seg: DataFrame) -> DataFrame:
    """`dump_id, thread_no, name, tid, systid, state, process` of every announced thread."""
    def pick(field):
        return _by_producer(lambda p: _part(p, field))
    sys_line = seg.where(F.col("in_thread") & ~F.col("is_sig")).groupBy("dump_id", "thread_no").agg(
        F.max(F.nullif(F.regexp_extract("text", SYS_TID, 1), F.lit(""))).alias("_sys"))
    state = F.coalesce(F.nullif(pick("state"), F.lit("")), pick("detached"))
    return seg.where("is_sig").select(
        "dump_id", "thread_no", pick("name").alias("name"), pick("tid").alias("tid"),
        pick("systid").alias("systid"), normalise_state(state).alias("state"), "process"
    ).join(sys_line, ["dump_id", "thread_no"], "left").withColumn(
        "systid", F.coalesce("_sys", "systid")).drop("_sys")


def _body(seg: DataFrame) -> DataFrame:
    return seg.where(F.col("in_thread") & ~F.col("is_sig"))


def dump_frames(seg: DataFrame) -> DataFrame:
    """Managed and native frames in order: `dump_id, thread_no, kind, pos, frame`."""
    java = F.regexp_extract("text", FRAME, 1)
    native = _by_producer(lambda p: F.col("text").rlike(p.native))
    rows = _body(seg).withColumns({
        "kind": F.when(java != "", "java").when(native, "native"),
        "frame": F.when(java != "", java).otherwise(F.trim("text"))}).where("kind is not null")
    rows = carry(rows.select("dump_id", "thread_no", "kind", "line_no", "frame"),
                 ["dump_id", "thread_no", "kind"], ["line_no"], line_cell(), sums={"pos": lng(1)})
    return rows.select("dump_id", "thread_no", "kind", F.col("pos").cast("int").alias("pos"), "frame")


def dump_locks(seg: DataFrame) -> DataFrame:
    """Wanted and held monitors: `dump_id, thread_no, role, addr, cls, owner_tid, line_no`."""
    def group(i):
        return _by_producer(lambda p: F.regexp_extract("text", p.lock, i) if p.lock else F.lit(""))
    on_sig = _by_producer(lambda p: F.lit(p.lock_on_signature))
    wants = seg.where(F.when(on_sig, F.col("is_sig")).otherwise(
        F.col("in_thread") & ~F.col("is_sig"))).select(
        "dump_id", "thread_no", F.lit("wants").alias("role"), group(1).alias("addr"),
        group(2).alias("cls"), group(3).alias("owner_tid"), "line_no").where("addr <> ''")
    held = _body(seg).select(
        "dump_id", "thread_no", F.lit("holds").alias("role"),
        _by_producer(lambda p: F.regexp_extract("text", p.held, 1) if p.held else F.lit(""))
        .alias("addr"), F.lit(None).cast("string").alias("cls"),
        F.lit(None).cast("string").alias("owner_tid"), "line_no").where("addr <> ''")
    return wants.unionByName(held)


def _before_threads(seg: DataFrame) -> DataFrame:
    """Lines of the header region: before the first thread, after the last entry rule above it."""
    head = seg.where(F.col("thread_no") == 0)
    start = head.where("is_entry").groupBy("dump_id").agg(F.max("line_no").alias("_from"))
    return head.join(start, "dump_id", "left").where(
        F.col("line_no") > F.coalesce("_from", F.lit(0))).drop("_from")


def _is_header(c: str = "text") -> Column:
    t = F.col(c)
    return (t.rlike(HEADER) & ~t.rlike(SCAFFOLD) & ~t.rlike(PROCESS) & ~t.rlike(CMDLINE)
            & ~t.rlike(LOAD))


def dump_header_fields(seg: DataFrame) -> DataFrame:
    """`dump_id, key, value`: the `Key: value` lines above the threads; a later line wins."""
    rows = _before_threads(seg).where(_is_header()).select(
        "dump_id", "line_no", F.trim(F.regexp_extract("text", HEADER, 1)).alias("key"),
        F.trim(F.regexp_extract("text", HEADER, 2)).alias("value"))
    return rows.groupBy("dump_id", "key").agg(F.max_by("value", "line_no").alias("value"))


def dump_headers(fields: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """`dump_id, head`: the header of a dump as a map, of the named fields or all of them."""
    kept = fields if keys is None else fields.where(F.col("key").isin(list(keys)))
    return kept.groupBy("dump_id").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("head"))


def dump_load(seg: DataFrame) -> DataFrame:
    """The record's own CPU table: `dump_id, share, process, place`, busiest first."""
    rows = seg.where(~F.col("in_thread") & F.col("text").rlike(LOAD)).select(
        "dump_id", F.regexp_extract("text", LOAD, 1).cast("double").alias("share"),
        F.trim(F.regexp_extract("text", LOAD, 3)).alias("process"))
    place = Window.partitionBy("dump_id").orderBy(F.col("share").desc(), F.col("process").desc())
    return rows.withColumn("place", F.row_number().over(place))


def unread_lines(seg: DataFrame) -> DataFrame:
    """Lines nothing could read, per dump, and lines skipped after the threads."""
    t = F.col("text")
    known = t.rlike(FRAME) | _by_producer(lambda p: (
        t.rlike(p.native) | (t.rlike(p.lock) if p.lock and not p.lock_on_signature else F.lit(False))
        | (t.rlike(p.held) if p.held else F.lit(False))
        | (t.rlike(p.noise) if p.noise else F.lit(False))))
    frame_line = t.rlike(SCAFFOLD) | t.rlike(PROCESS) | t.rlike(CMDLINE) | t.rlike(ENTRY) | \
        t.rlike(LOAD)
    inside = F.col("in_thread") & ~F.col("is_sig") & ~known & ~frame_line
    above = ((F.col("thread_no") == 0) & ~F.col("is_sig") & ~frame_line & ~t.rlike(HEADER)
             & ~t.startswith("#"))
    after = (~F.col("in_thread") & (F.col("thread_no") > 0) & ~F.col("is_sig") & ~frame_line)
    return seg.groupBy("dump_id").agg(F.count_if(inside | above).alias("unread"),
                                      F.count_if(after).alias("skipped"))


def dump_package(fields: DataFrame) -> DataFrame:
    """The application a dump is about (first word of Application, Process or Package) and why the
    system wrote it."""
    def field(name: str) -> Column:
        return F.max(F.when((F.col("key") == name) & (F.col("value") != ""), F.col("value")))
    value = F.coalesce(*[field(k) for k in ("Application", "Process", "Package")])
    return fields.groupBy("dump_id").agg(
        F.split(value, r"\s+")[0].alias("package"),
        F.coalesce(field("Subject"), field("Reason")).alias("reason"))


def scope_process(threads: DataFrame, packages: DataFrame) -> DataFrame:
    """Only threads of the process which hung: the named one, else the first in the record.

    Dumps with a single process keep all threads. Adds `elsewhere`, the number set aside.
    """
    seen = threads.where(F.col("process") != "").join(
        packages.select("dump_id", "package"), "dump_id", "left").groupBy("dump_id").agg(
        F.min("process").alias("_a"), F.max("process").alias("_z"),
        F.max(F.when(F.col("process") == F.col("package"), F.col("process"))).alias("_named"),
        F.min_by("process", "thread_no").alias("_first"))
    target = seen.where(F.col("_a") != F.col("_z")).select(
        "dump_id", F.coalesce("_named", "_first").alias("_target"))
    d = threads.join(target, "dump_id", "left")
    mine = F.col("_target").isNull() | (F.col("process") == F.col("_target"))
    away = d.groupBy("dump_id").agg(F.count_if(~mine).alias("elsewhere"))
    return d.where(mine).drop("_target").join(away, "dump_id")


def scope_dump(threads: DataFrame, frames: DataFrame, locks: DataFrame, packages: DataFrame
               ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Threads, frames and locks of the process which hung. Locks and idleness are judged on these: another
    process may use the same thread ids and addresses."""
    mine = scope_process(threads, packages)
    keys = mine.select("dump_id", "thread_no")
    return mine, *(df.join(keys, ["dump_id", "thread_no"], "left_semi") for df in (frames, locks))


def mask_rank(c: Column | str, masks: Sequence[tuple[str, Sequence[str]]] = IDLE) -> Column:
    """Place of the first reason one of whose texts is in the frame, else NULL."""
    c = F.col(c) if isinstance(c, str) else c
    e = F.lit(None).cast("int")
    for i, (_, texts) in reversed(list(enumerate(masks))):
        hit = F.lit(False)
        for t in texts:
            hit = hit | c.contains(t)
        e = F.when(hit, F.lit(i)).otherwise(e)
    return e


def idle_reason(threads: DataFrame, frames: DataFrame,
                masks: Sequence[tuple[str, Sequence[str]]] = IDLE) -> DataFrame:
    """Adds `idle`: why the thread did nothing, NULL when it worked. A blocked one never idles.

    The masks are parameters of fixed size, so they are one expression per frame and the
    smallest rank per thread; no join with a mask table and no stack text is built.
    """
    rank = frames.select("dump_id", "thread_no", mask_rank("frame", masks).alias("_r")).groupBy(
        "dump_id", "thread_no").agg(F.min("_r").alias("_r"))
    names = F.array(*[F.lit(n) for n, _ in masks])
    return threads.join(rank, ["dump_id", "thread_no"], "left").withColumn(
        "idle", F.when(F.col("state") != "blocked", F.get(names, F.col("_r")))).drop("_r")


def working_threads(idle: DataFrame) -> DataFrame:
    return idle.where(F.col("idle").isNull())


def own_frames(frames: DataFrame, packages: DataFrame | None = None,
               platform: Sequence[str] = PLATFORM) -> DataFrame:
    """Managed frames which are no platform or library code; the app's own package always counts."""
    lib = F.lit(False)
    for p in platform:
        lib = lib | F.col("frame").startswith(p)
    d = frames.where(F.col("kind") == "java") if "kind" in frames.columns else frames
    if packages is None:
        return d.where(~lib)
    root = F.when(F.instr("package", ".") > 0, F.substring_index("package", ".", 2)).otherwise(
        F.col("package"))
    d = d.join(packages.select("dump_id", "package", root.alias("_root")), "dump_id", "left")
    mine = F.coalesce(F.col("frame").startswith(F.col("package"))
                      | F.col("frame").startswith(F.col("_root")), F.lit(False)) \
        & (F.coalesce("package", F.lit("")) != "")
    return d.where(mine | ~lib).drop("package", "_root")


def shown_frames(frames: DataFrame, own: DataFrame, limit: int = 8) -> DataFrame:
    """Frames worth printing per thread: the top one, the one where the app called into a library,
    and both ends of the app's own frames: `dump_id, thread_no, place, frame`.

    Only the frames which can be shown are gathered, a dozen of a thread, however deep its stack.
    """
    keys = ["dump_id", "thread_no"]
    java = frames.where("kind = 'java'")
    top = frames.where("pos <= 3").groupBy(*keys).agg(
        F.max(F.when((F.col("kind") == "java") & (F.col("pos") == 1), F.col("frame"))).alias("_j"),
        *[F.max(F.when((F.col("kind") == "native") & (F.col("pos") == i), F.col("frame")))
          .alias(f"_n{i}") for i in (1, 2, 3)]).withColumn("top", F.coalesce("_j", "_n1"))
    mine = settle(own.select(*keys, "pos", "frame").join(top.select(*keys, "top"), keys).where(
        F.col("frame") != F.col("top")).drop("top"))

    def pick(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(
            F.struct("pos", "frame"))), lambda s: s["frame"]).alias(name))
    first = pick(top_k(mine, keys, [F.col("pos")], limit), "_first")
    last = pick(top_k(mine, keys, [F.col("pos").desc()], 2), "_last")
    size = mine.groupBy(*keys).agg(F.count(F.lit(1)).alias("_own"), F.min("pos").alias("_edge"))
    before = java.join(size.select(*keys, (F.col("_edge") - 1).alias("pos")), [*keys, "pos"]).select(
        *keys, F.col("frame").alias("_before"))
    d = top.join(size, keys, "left").join(first, keys, "left").join(last, keys, "left").join(
        before, keys, "left")
    head = F.when(F.col("_before") != F.col("top"), F.array("top", "_before")).otherwise(F.array("top"))
    d = d.withColumn("head", head)
    room = F.lit(limit) - F.size("head")
    ends = F.concat(F.slice("_first", F.lit(1), F.greatest(room - 3, F.lit(1))),
                    F.array(F.lit("…")), F.col("_last"))
    out = (F.when(F.col("_own") > room, F.concat("head", ends))
           .when(F.col("_own") > 0, F.concat("head", "_first"))
           .otherwise(F.array_compact(F.array("top", "_n2", "_n3"))))
    return d.select(*keys, F.posexplode(out).alias("place", "frame")).withColumn(
        "place", F.col("place") + 1)


def source_index(files: DataFrame) -> DataFrame:
    """`file, path` of every source path."""
    return files.select(F.substring_index("path", "/", -1).alias("file"), "path").distinct()


def place_frames(frames: DataFrame, index: DataFrame) -> DataFrame:
    """Where in the corpus each distinct frame is: `frame, symbol, file, line, path, exact`.

    The file name finds the candidates, the package the right one; a single candidate is exact,
    several with no agreeing package give the first path, flagged. `path` is NULL for a frame
    which names a source file the corpus lacks. A package agrees when its directories stand in
    the path in a row; the paths are indexed by those runs, so no frame meets every file of a
    common name.
    """
    shape = r"^([^(]+)\(\s*([\w$]+\.(?:kt|java))(?::(\d+))?\s*\)\s*$"
    d = frames.select("frame").distinct().where(F.col("frame").rlike(shape)).select(
        "frame", F.trim(F.regexp_extract("frame", shape, 1)).alias("symbol"),
        F.regexp_extract("frame", shape, 2).alias("file"),
        F.nullif(F.regexp_extract("frame", shape, 3), F.lit("")).cast("int").alias("line"))
    owner = F.substring_index(F.regexp_replace("symbol", r"\.[^.]*$", ""), "$", 1)
    package = F.when(F.instr(owner, ".") > 0, F.regexp_replace(owner, r"\.[^.]*$", ""))
    d = d.withColumn("run", F.translate(package, ".", "/"))
    first = index.groupBy("file").agg(F.min("path").alias("_first"), F.count(F.lit(1)).alias("_n"))
    dirs = index.withColumn("_d", F.split("path", "/")).withColumn(
        "_d", F.slice("_d", F.lit(1), F.size("_d") - 1)).where(F.size("_d") > 0)
    starts = dirs.select("file", "path", "_d", F.explode(
        F.sequence(F.lit(1), F.size("_d"))).alias("_i"))
    runs = starts.select("file", "path", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("_d") - F.col("_i") + 1),
        lambda k: F.array_join(F.slice("_d", F.col("_i"), k), "/"))).alias("run"))
    agreed = runs.groupBy("file", "run").agg(F.min("path").alias("_agreed"))
    return (
        d.join(first, "file", "left").join(agreed, ["file", "run"], "left")
        .select("frame", "symbol", "file", "line", F.coalesce("_agreed", "_first").alias("path"),
                (F.col("_agreed").isNotNull() | F.coalesce(F.col("_n") == 1, F.lit(False)))
                .alias("exact"))
    )


def unplaced_frames(placed: DataFrame) -> DataFrame:
    """Frames which name a source file the corpus lacks."""
    return placed.where(F.col("path").isNull()).select("frame", "symbol", "file", "line")


def rank_working(working: DataFrame, own: DataFrame, top: int | None = 12) -> DataFrame:
    """Working threads without a wanted lock: own code first, waiting ones last, `place` per dump."""
    first = own.groupBy("dump_id", "thread_no").agg(F.min_by("frame", "pos").alias("own_frame"))
    d = working.join(first, ["dump_id", "thread_no"], "left")
    if "wants" in d.columns:
        d = d.where(~F.col("wants"))
    order = [F.col("own_frame").isNull(), F.col("state").endswith("waiting"), F.col("thread_no")]
    return top_k(d.where(F.col("name") != "main"), ["dump_id"], order, top or 2**31 - 1,
                 rank="place")


def dump_summary(threads: DataFrame, idle: DataFrame, groups: DataFrame | None = None,
                 unread: DataFrame | None = None) -> DataFrame:
    """Threads, working, idle, elsewhere, chains and unread lines per dump."""
    elsewhere = F.max("elsewhere") if "elsewhere" in threads.columns else F.lit(0).cast("long")
    d = threads.groupBy("dump_id").agg(F.count(F.lit(1)).alias("threads"),
                                       elsewhere.alias("elsewhere"))
    d = d.join(idle.groupBy("dump_id").agg(F.count_if(F.col("idle").isNull()).alias("working"),
                                           F.count("idle").alias("idle")), "dump_id", "left")
    if groups is not None:
        d = d.join(groups.groupBy("dump_id").agg(
            F.count(F.lit(1)).alias("chains"), F.count_if("blocks_main").alias("blocking_main")),
            "dump_id", "left").fillna(0, ["chains", "blocking_main"])
    if unread is not None:
        d = d.join(unread, "dump_id", "left")
    return d
