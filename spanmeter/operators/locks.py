"""Lock chains of thread dumps: who waits, who holds, who is at the bottom, who is deadlocked.

`threads(dump_id, thread_no, name, tid, …)`, `locks(dump_id, thread_no, role, addr, cls,
owner_tid)`. Thread ids are compared as given, an empty one names nobody.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import top_k
from ..session import settle


def _wants(locks: DataFrame, threads: DataFrame) -> DataFrame:
    return locks.where(F.col("role") == "wants").join(
        threads.select("dump_id", "thread_no", "name", "tid"), ["dump_id", "thread_no"])


def lock_groups(locks: DataFrame, threads: DataFrame) -> DataFrame:
    """One row per wanted monitor and owner: waiters, whether main is among them, the holder.

    The holder is the thread of the named tid, the first of several processes' threads with that tid; when the
    tid is not in the dump, the first thread which says it holds the address. Order: `blocks_main` first, then by
    number of waiters.
    """
    groups = _wants(locks, threads).groupBy("dump_id", "addr", "owner_tid").agg(
        F.count(F.lit(1)).alias("waiters"),
        F.max(F.col("name") == "main").alias("blocks_main"),
        F.min_by("cls", "thread_no").alias("monitor"))
    by_tid = threads.where(F.col("tid").cast("string") != "").groupBy(
        "dump_id", F.col("tid").alias("owner_tid")).agg(F.min_by("name", "thread_no").alias("_n1")).withColumn(
        "_t1", F.col("owner_tid"))
    holds = locks.where(F.col("role") == "holds").join(
        threads.select("dump_id", "thread_no", "name", "tid"), ["dump_id", "thread_no"]).groupBy(
        "dump_id", "addr").agg(F.min_by(F.struct("name", "tid"), "thread_no").alias("_h"))
    return (
        groups.join(by_tid, ["dump_id", "owner_tid"], "left")
        .join(holds, ["dump_id", "addr"], "left")
        .select("dump_id", "addr", "owner_tid", "monitor", "waiters", "blocks_main",
                F.coalesce("_n1", "_h.name").alias("holder"),
                F.coalesce("_t1", "_h.tid").alias("holder_tid"))
    )


def ordered_groups(groups: DataFrame, top: int | None = None) -> DataFrame:
    """Adds `place` per dump: groups which block main first, then the longest queue."""
    return top_k(groups, ["dump_id"], [F.col("blocks_main").desc(), F.col("waiters").desc(),
                                       F.col("addr"), F.col("owner_tid")], top or 2**31 - 1,
                 rank="place")


def wait_edges(locks: DataFrame, threads: DataFrame) -> DataFrame:
    """`dump_id, tid, next`: the thread whose monitor a thread wants, where that thread exists.

    Of several notes the last one stands, by `line_no` where the locks carry it; of several threads of one tid, that
    of the last thread.
    """
    alive = threads.where(F.col("tid").cast("string") != "").select(
        "dump_id", F.col("tid").alias("next")).distinct()
    at = F.struct("thread_no", *[F.col(c) for c in ("line_no",) if c in locks.columns], "owner_tid")
    edges = _wants(locks, threads).where(F.col("tid").cast("string") != "").join(
        alive.withColumnRenamed("next", "owner_tid"), ["dump_id", "owner_tid"], "left_semi")
    return edges.groupBy("dump_id", "tid").agg(F.max_by("owner_tid", at).alias("next"))


SQUARED_AT_ONCE = 3    # squarings of the jump table between two writes: eight times as far each


def wait_roots(edges: DataFrame) -> DataFrame:
    """For every thread with an edge: `root, steps, in_cycle`.

    A thread wants at most one monitor, so the graph is a function and pointer doubling finds the
    end of every walk. Walks that have ended are set aside, so what is doubled on shrinks fast: most chains have
    a few steps. A walk that has not ended after as many steps as there are edges runs into a loop; its
    root is the last thread before the loop closes.
    """
    edges = settle(edges)
    ended, loops = _walked(edges, edges)
    straight = ended.select("dump_id", "tid", F.col("at").alias("root"), "steps", F.lit(False).alias("in_cycle"))
    if loops is None:
        return straight
    # After n steps every looping walk stands on its loop: those threads are the loop's members.
    members = settle(loops.select("dump_id", F.col("at").alias("tid")).distinct())
    before = edges.join(members, ["dump_id", "tid"]).select(
        "dump_id", F.col("next").alias("entry"), F.col("tid").alias("_last"))
    # Walk again, stopping at the loop: its members have no edge here.
    outside = edges.join(loops.select("dump_id", "tid"), ["dump_id", "tid"], "left_semi").join(
        members, ["dump_id", "tid"], "left_anti")
    reach, _ = _walked(outside, outside)
    entries = reach.select("dump_id", "tid", F.col("at").alias("entry"), "steps").unionByName(
        members.select("dump_id", "tid", F.col("tid").alias("entry"), F.lit(0).cast("long")
                       .alias("steps")))
    looped = entries.join(before, ["dump_id", "entry"]).select(
        "dump_id", "tid", F.col("_last").alias("root"), "steps", F.lit(True).alias("in_cycle"))
    return straight.unionByName(looped)


def _walked(edges: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The walks from `starts` along `edges`: those that end (`at`, `steps`), and those that never do."""
    jump = edges.select("dump_id", "tid", F.col("next").alias("at"), F.lit(1).cast("long").alias("steps"))
    walks = starts.select("dump_id", "tid", F.col("next").alias("at"), F.lit(1).cast("long").alias("steps"))
    live = edges.select("dump_id", F.col("tid").alias("at"), F.lit(True).alias("_live"))
    done, far, n = None, 1, None
    while True:
        for _ in range(SQUARED_AT_ONCE):
            walks, jump, far = _onward(walks, jump), _onward(jump, jump), far * 2
        both = settle(walks.join(live, ["dump_id", "at"], "left").select("dump_id", "tid", "at", "steps", "_live"))
        some = both.where("_live IS NULL").drop("_live")
        done = some if done is None else done.unionByName(some)
        walks = both.where("_live").drop("_live")
        if walks.isEmpty():
            return done, None
        if n is None:
            n = edges.groupBy("dump_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if far > n:
            return done, walks
        jump = settle(jump)


def _onward(walks: DataFrame, jump: DataFrame) -> DataFrame:
    """Walks continued by the jumps of where they stand."""
    further = jump.select("dump_id", F.col("tid").alias("at"), F.col("at").alias("_to"), F.col("steps").alias("_more"))
    return walks.join(further, ["dump_id", "at"], "left").select(
        "dump_id", "tid", F.coalesce("_to", "at").alias("at"),
        (F.col("steps") + F.coalesce("_more", F.lit(0).cast("long"))).alias("steps"))


def chain_roots(locks: DataFrame, threads: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Lock groups with the thread at the bottom of the chain and whether it is a deadlock.

    `holders` counts the threads from the holder down to the root (NULL inside a loop). A group is
    a deadlock when its holder walks into a loop or down to one of the group's own waiters.
    """
    groups = settle(groups if groups is not None else lock_groups(locks, threads))
    roots = wait_roots(wait_edges(locks, threads)).select(
        "dump_id", F.col("tid").alias("holder_tid"), F.col("root").alias("_root"),
        F.col("steps").alias("_steps"), F.col("in_cycle").alias("_cycle"))
    d = groups.join(roots, ["dump_id", "holder_tid"], "left")
    root = F.coalesce("_root", "holder_tid")
    d = d.withColumns({"root_tid": root, "_loop": F.coalesce("_cycle", F.lit(False))})
    waiting = _wants(locks, threads).select(
        "dump_id", "addr", "owner_tid", F.col("tid").alias("root_tid"), F.lit(True).alias("_own"))
    d = d.join(waiting.dropDuplicates(), ["dump_id", "addr", "owner_tid", "root_tid"], "left")
    own = F.coalesce("_own", F.lit(False)) & (F.col("root_tid") != F.col("holder_tid"))
    return d.select(
        "dump_id", "addr", "owner_tid", "monitor", "waiters", "blocks_main", "holder",
        "holder_tid", "root_tid",
        F.when(F.col("holder_tid").isNull(), F.lit(0).cast("long"))
        .when(~F.col("_loop"), F.coalesce("_steps", F.lit(0).cast("long")) + 1).alias("holders"),
        (F.col("_loop") | own).alias("deadlock"))


def deadlocks(chains: DataFrame) -> DataFrame:
    return chains.where("deadlock")


def monitor_names(locks: DataFrame, threads: DataFrame, frames: DataFrame) -> DataFrame:
    """The readable class of a monitor from the top frame of the first waiter whose package agrees
    with the printed class: `dump_id, addr, owner_tid, named`."""
    top = frames.where((F.col("kind") == "java") & (F.col("pos") == 1)).select(
        "dump_id", "thread_no", "frame")
    d = _wants(locks, threads).join(top, ["dump_id", "thread_no"])
    method = F.substring_index("frame", "(", 1)
    named = F.regexp_replace(method, r"\.[^.]*$", "")
    package = F.when(F.instr("cls", ".") > 0, F.regexp_replace("cls", r"\.[^.]*$", ""))
    agrees = F.regexp_replace(named, r"\.[^.]*$", "") == package
    first_cls = F.min_by("cls", "thread_no")
    return d.withColumn("_named", F.when(agrees, named)).groupBy(
        "dump_id", "addr", "owner_tid").agg(
        first_cls.alias("monitor"),
        F.min_by("_named", F.when(F.col("_named").isNotNull(), F.col("thread_no"))).alias("named"))


def inferred_queues(threads: DataFrame, frames: DataFrame, locks: DataFrame) -> DataFrame:
    """Blocked threads standing in the same class, for dumps which carry no lock note at all.

    A queue is two or more threads, or the main thread alone. Who holds the monitor is not known.
    """
    top = frames.where((F.col("kind") == "java") & (F.col("pos") == 1)).select(
        "dump_id", "thread_no", "frame")
    noted = locks.where(F.col("role") == "wants").select("dump_id").distinct()
    method = F.trim(F.substring_index("frame", "(", 1))
    d = threads.where(F.col("state") == "blocked").join(noted, "dump_id", "left_anti").join(
        top, ["dump_id", "thread_no"]).withColumn("monitor", F.regexp_replace(method, r"\.[^.]*$", ""))
    return d.where(F.col("monitor") != "").groupBy("dump_id", "monitor").agg(
        F.count(F.lit(1)).alias("waiters"),
        F.max(F.col("name") == "main").alias("blocks_main")).where(
        (F.col("waiters") > 1) | F.col("blocks_main"))


def threads_of_interest(threads: DataFrame, locks: DataFrame, groups: DataFrame,
                        idle: DataFrame) -> DataFrame:
    """Waiters, holders, the main thread and the working ones, each thread once."""
    keys = ["dump_id", "thread_no"]
    waiters = locks.where(F.col("role") == "wants").select(*keys)
    holders = threads.join(groups.where(F.col("holder_tid").isNotNull()).select(
        "dump_id", F.col("holder_tid").alias("tid")).distinct(), ["dump_id", "tid"],
        "left_semi").select(*keys)
    main = threads.where(F.col("name") == "main").select(*keys)
    working = idle.where(F.col("idle").isNull()).select(*keys)
    wanted = waiters.unionByName(holders).unionByName(main).unionByName(working).distinct()
    return threads.join(wanted, keys, "left_semi")
