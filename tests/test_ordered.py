"""The chunked ordered helpers against brute force, with cells small enough to cut everywhere."""

import random
from statistics import median

from pyspark.sql import functions as F

from spanmeter.functions.exprs import int_div, lng
from spanmeter.functions.ordered import carry, counted_values, time_cell, values_at_ranks
from spanmeter.operators.intervals import intersect_intervals, islands


def test_carry_equals_one_window(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < .7 else "cold", t, rnd.randint(-5, 9))
            for t in rnd.sample(range(400), 120)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    v = F.col("v")
    got = carry(df, ["k"], ["t"], time_cell("t", 7), sums={"s": v}, sums_before={"sb": v},
                maxes={"m": v}, maxes_before={"mb": v}, lags={"lag": v}, leads={"lead": v}).collect()
    assert len(got) == len(rows)
    for k in ("hot", "cold"):
        mine = sorted((t, x) for kk, t, x in rows if kk == k)
        values = [x for _, x in mine]
        by_t = {r.t: r for r in got if r.k == k}
        for i, (t, x) in enumerate(mine):
            r = by_t[t]
            assert r.s == sum(values[:i + 1]) and r.sb == sum(values[:i])
            assert r.m == max(values[:i + 1])
            assert r.mb == (max(values[:i]) if i else None)
            assert r.lag == (values[i - 1] if i else None)
            assert r.lead == (values[i + 1] if i + 1 < len(values) else None)


def test_ranks_are_exact(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), rnd.choice([rnd.randint(0, 9), rnd.randint(0, 10**12)]))
            for _ in range(301)]
    df = spark.createDataFrame(rows, "k string, v long")
    got = values_at_ranks(counted_values(df, ["k"], "v"), ["k"], "v", {
        "low": int_div(F.col("n") + 1, lng(2)), "high": int_div(F.col("n"), lng(2)) + 1})
    for r in got.collect():
        mine = sorted(v for k, v in rows if k == r.k)
        assert r.n == len(mine) and (r.low + r.high) / 2 == median(mine)


def test_intersection_with_overlaps(spark):
    rnd = random.Random(3)
    def some(n):
        return [("x", rnd.randint(0, 200), rnd.randint(1, 30)) for _ in range(n)]
    a, b = some(12), some(9)
    schema = "k string, ts long, dur long"
    got = intersect_intervals(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema),
                              ["k"], cell_ns=11).first()
    inside = [sum(any(s <= t < s + d for _, s, d in side) for side in (a, b)) == 2
              for t in range(300)]
    assert got.shared_ns == sum(inside)


def test_islands_match_a_scan(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(60):
        t = rnd.randint(0, 500)
        rows.append(("x", i, t, t + rnd.randint(1, 12)))
    rows += [("x", 100 + i, r[2], r[3]) for i, r in enumerate(rows[:10])]  # equal intervals
    got = islands(spark.createDataFrame(rows, "k string, i long, ts long, te long"), ["k"], 2,
                  cell_ns=9).collect()
    reach, island, want = None, None, {}
    for _, i, ts, te in sorted(rows, key=lambda r: (r[2], r[3])):
        if reach is None or ts - reach > 2:
            island = ts   # an island is named by the time at which it opens
        want[i] = island
        reach = te if reach is None else max(reach, te)
    assert {r.i: r.island for r in got} == want
