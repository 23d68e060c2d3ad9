"""Two sets of reports subtracted pair by pair, with explicit rules for what is noise.

Finding rows carry `pair_id`, `detector`, `location`, `detail` and the numeric columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import as_key, family, from_key, hundredths
from .detectors import identity_of

FLOOR_MS = 5.0
FLOOR_RATIO = 0.10
_KEY = ["pair_id", "detector", "key_location", "key_detail", "key_more"]


def _common(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per pair and detector, the identity columns which the rows of both sides carry; where one side has
    no rows, those of the other. Sides with nothing in common are matched on the location."""
    def names(df: DataFrame, side: str) -> DataFrame:
        return df.select("pair_id", "detector", *[
            (F.map_keys(identity_of(df)) if s == side else F.lit(None).cast("array<string>")).alias(s) for s in "ba"])

    met = names(before, "b").unionByName(names(after, "a")).groupBy("pair_id", "detector").agg(
        *[F.first(s, ignorenulls=True).alias(s) for s in "ba"])
    both = F.array_sort(F.array_intersect("b", "a"))
    return met.select("pair_id", "detector", F.when(F.col("b").isNull(), F.col("a")).when(F.col("a").isNull(), F.col("b"))
                      .when(F.size(both) > 0, both).otherwise(F.array(F.lit("location"))).alias("_names"))


def _keyed(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Identity columns, and an ordinal for rows which share one.

    Rows of one report share an identity only when edited by hand, so the ordinal window holds
    one or two rows.
    """
    def value(name: str) -> Column:
        return F.when(F.array_contains("_names", name), as_key(F.try_element_at("_identity", F.lit(name)))).otherwise("")

    more = F.filter("_names", lambda n: ~n.isin("location", "detail"))
    d = rows.withColumn("_identity", identity_of(rows)).join(names, ["pair_id", "detector"]).withColumns({
        "key_location": value("location"), "key_detail": value("detail"),
        "key_more": F.transform(more, lambda n: as_key(F.try_element_at("_identity", n)))})
    place = Window.partitionBy(*_KEY).orderBy(
        F.col("total_ms").desc_nulls_last(), F.col("detail"))
    return d.drop("_identity", "_names").withColumn("ordinal", F.row_number().over(place))


def _side(df: DataFrame, side: str) -> DataFrame:
    keep = [*_KEY, "ordinal"]
    cols = [c for c in df.columns if c not in keep]
    return df.select(*keep, F.struct(*cols).alias(side))


def pair_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of both sides matched exactly, then by name family, then left over.

    A row is named by the identity columns which both reports carry (`identity`, a map). A report without them
    is matched on the location alone; rows of frames without that column are named as the detectors
    here declare. A family pairs only when exactly one row is left of it on each side: with two workers before
    and three after there is no honest way to say which became which.
    """
    keep, names = [*_KEY, "ordinal"], _common(before, after)
    b, a = _side(_keyed(before, names), "b"), _side(_keyed(after, names), "a")
    full = b.join(a, keep, "full_outer")
    exact = full.where(F.col("b").isNotNull() & F.col("a").isNotNull()).withColumn(
        "matched_by", F.lit("exact"))
    rest = full.where(F.col("b").isNull() | F.col("a").isNull()).withColumns({
        "fam_location": family("key_location"), "fam_detail": family("key_detail"),
        "fam_more": F.transform("key_more", family)})
    fam = ["pair_id", "detector", "fam_location", "fam_detail", "fam_more"]
    # Both leftovers of an unambiguous family meet in one aggregate; no self-join is needed.
    groups = rest.groupBy(*fam).agg(
        F.count("b").alias("nb"), F.count("a").alias("na"),
        F.first("b", ignorenulls=True).alias("fb"), F.first("a", ignorenulls=True).alias("fa"))
    one = (F.col("nb") == 1) & (F.col("na") == 1)
    by_family = groups.where(one).select(
        "pair_id", "detector", F.col("fam_location").alias("key_location"),
        F.col("fam_detail").alias("key_detail"), F.col("fam_more").alias("key_more"), F.lit(1).alias("ordinal"),
        F.col("fb").alias("b"), F.col("fa").alias("a"), F.lit("family").alias("matched_by"))
    left = rest.join(groups.where(one).select(*fam), fam, "left_anti").select(
        *keep, "b", "a", F.lit("exact").alias("matched_by"))
    return exact.unionByName(by_family).unionByName(left)


def classify_changes(pairs: DataFrame, floor_ms: float = FLOOR_MS,
                     floor_ratio: float = FLOOR_RATIO) -> DataFrame:
    """appeared / vanished / grew / shrank / steady, with delta and ratio.

    A move below max(floor_ms, floor_ratio of before) is steady. The metric is self time where
    the after side (else the before side) measures it.
    """
    lead = F.coalesce(F.col("a.self_ms"), F.when(F.col("a").isNull(), F.col("b.self_ms")))
    metric = F.when(lead.isNotNull(), "self_ms").otherwise("total_ms")
    pick = {s: F.when(F.col("metric") == "self_ms", F.col(f"{s}.self_ms"))
            .otherwise(F.col(f"{s}.total_ms")) for s in ("b", "a")}
    d = pairs.withColumn("metric", metric).withColumns(
        {"before_ms": pick["b"], "after_ms": pick["a"]})
    vb, va = F.coalesce("before_ms", F.lit(0.0)), F.coalesce("after_ms", F.lit(0.0))
    gone, new = F.col("a").isNull(), F.col("b").isNull()
    # Subtracted in hundredths: both numbers carry two digits.
    delta = (hundredths(va) - hundredths(vb)).cast("double") / F.lit(100.0)
    d = d.withColumn("delta_ms", F.when(new, va).when(gone, -vb).otherwise(delta))
    floor = F.greatest(F.lit(float(floor_ms)), vb * F.lit(floor_ratio))
    change = (F.when(new, "appeared").when(gone, "vanished")
              .when(F.abs("delta_ms") < floor, "steady")
              .when(F.col("delta_ms") > 0, "grew").otherwise("shrank"))
    detail = F.when(F.col("key_detail") != "", from_key("key_detail"))
    return d.select(
        "pair_id", "detector", from_key("key_location").alias("location"), detail.alias("detail"),
        "metric", change.alias("change"), "matched_by", "before_ms", "after_ms", "delta_ms",
        F.when(~new & ~gone & (F.col("before_ms") != 0), F.round(va / F.col("before_ms"), 2))
        .alias("ratio"), "b", "a")


def largest_move() -> list[Column]:
    return [F.abs("delta_ms").desc(), F.asc("detector"), F.asc("location"), F.asc("detail")]


def ordered_changes(changes: DataFrame) -> DataFrame:
    """The largest move first."""
    return changes.orderBy("pair_id", *largest_move())


def range_overlap(changes: DataFrame) -> DataFrame:
    """Adds `overlap`: do the ranges of the two sets of repeats intersect? NULL without ranges.

    Sides need `spread` as a map of metric to (min, max, …).
    """
    b, a = F.col("b.spread")[F.col("metric")], F.col("a.spread")[F.col("metric")]
    apart = (a["max"] < b["min"]) | (b["max"] < a["min"])
    return changes.withColumn("overlap", F.when(b.isNotNull() & a.isNotNull(), ~apart))


def faces(changes: DataFrame) -> DataFrame:
    """Each side as one struct: value, range, count, repeats, coverage and evidence."""
    def face(side: str, value: str) -> Column:
        band = F.col(f"{side}.spread")[F.col("metric")]
        return F.when(F.col(side).isNotNull(), F.struct(
            F.col(value).alias("value"), band["min"].alias("min"), band["max"].alias("max"),
            band["values"].alias("values"), F.col(f"{side}.count").alias("count"),
            F.col(f"{side}.runs").alias("runs"), F.col(f"{side}.covered_ms").alias("covered_ms"),
            F.col(f"{side}.detail").alias("detail")))
    return changes.withColumns({"before": face("b", "before_ms"), "after": face("a", "after_ms")})


def param_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Parameters which differ, one row each, for detectors on both sides.

    Inputs: `pair_id, detector, params map`.
    """
    both = before.select("pair_id", "detector").distinct().join(
        after.select("pair_id", "detector").distinct(), ["pair_id", "detector"])
    b = before.select("pair_id", "detector", F.explode("params").alias("param", "was"))
    a = after.select("pair_id", "detector", F.explode("params").alias("param", "now"))
    return (
        b.join(a, ["pair_id", "detector", "param"], "full_outer")
        .join(both, ["pair_id", "detector"], "left_semi")
        .where(~F.col("was").eqNullSafe(F.col("now")))
    )


def detectors_one_side(before: DataFrame, after: DataFrame) -> DataFrame:
    """Detectors which ran on one side only: `pair_id, detector, side`."""
    b = before.select("pair_id", "detector").distinct()
    a = after.select("pair_id", "detector").distinct()
    return b.join(a, ["pair_id", "detector"], "left_anti").withColumn("side", F.lit("before")) \
        .unionByName(a.join(b, ["pair_id", "detector"], "left_anti")
                     .withColumn("side", F.lit("after")))


def compare_warnings(before: DataFrame, after: DataFrame, runs_before: DataFrame,
                     runs_after: DataFrame, planted: DataFrame | None = None) -> DataFrame:
    """Why two reports may say less about each other than it looks: `pair_id, id, comparable`.

    Headers: `pair_id, process, runs, config_sha, defaults, start_matches`. Only different
    processes make a pair incomparable.
    """
    sides = [c for c in ("process", "runs", "config_sha", "defaults", "start_matches")]
    h = before.select("pair_id", *[F.col(c).alias(f"b_{c}") for c in sides]).join(
        after.select("pair_id", *[F.col(c).alias(f"a_{c}") for c in sides]), "pair_id")
    c = F.col
    rb, ra = F.coalesce("b_runs", F.lit(1)), F.coalesce("a_runs", F.lit(1))
    rules = {
        "process": c("b_process") != c("a_process"),
        "anchor-before": c("b_start_matches") == 0,
        "anchor-after": c("a_start_matches") == 0,
        "config": c("b_config_sha") != c("a_config_sha"),
        "defaults": F.coalesce("b_defaults", F.lit(False)) != F.coalesce("a_defaults", F.lit(False)),
        "runs": rb != ra,
        "single": (rb == 1) | (ra == 1),
    }
    hits = F.array_compact(F.array(*[F.when(e, F.lit(n)) for n, e in rules.items()]))
    out = h.select("pair_id", F.explode(hits).alias("id"))
    extra = [param_diff(runs_before, runs_after).select("pair_id", F.lit("thresholds").alias("id")),
             detectors_one_side(runs_before, runs_after).select(
                 "pair_id", F.lit("detectors").alias("id"))]
    if planted is not None:
        extra.append(planted.select("pair_id", F.lit("instrumentation").alias("id")))
    for e in extra:
        out = out.unionByName(e.distinct())
    return out.withColumn("comparable", c("id") != "process")


def planted_rows(changes: DataFrame, prefix: str) -> DataFrame:
    """Rows which appeared because somebody instrumented them, by their name prefix."""
    return changes.where((F.col("change") == "appeared") & F.col("location").startswith(prefix))


def state_changes(before: DataFrame, after: DataFrame, runs_before: DataFrame,
                  runs_after: DataFrame) -> DataFrame:
    """Detectors of both sides which went from silent to firing or back, with their row counts."""
    keys = ["pair_id", "detector"]
    both = runs_before.select(*keys).distinct().join(runs_after.select(*keys).distinct(), keys)
    nb = before.groupBy(*keys).agg(F.count(F.lit(1)).alias("_b"))
    na = after.groupBy(*keys).agg(F.count(F.lit(1)).alias("_a"))
    zero = F.lit(0).cast("long")
    return (
        both.join(nb, keys, "left").join(na, keys, "left")
        .select(*keys, F.coalesce("_b", zero).alias("rows_before"),
                F.coalesce("_a", zero).alias("rows_after"))
        .where((F.col("rows_before") > 0) != (F.col("rows_after") > 0))
    )


def window_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Window lengths of a pair, their difference and ratio. Headers carry `duration_ms`."""
    d = before.select("pair_id", F.col("duration_ms").alias("before_ms")).join(
        after.select("pair_id", F.col("duration_ms").alias("after_ms")), "pair_id")
    return d.select(
        "pair_id", "before_ms", "after_ms",
        ((hundredths("after_ms") - hundredths("before_ms")).cast("double") / F.lit(100.0))
        .alias("delta_ms"),
        F.when(F.col("before_ms") != 0, F.round(F.col("after_ms") / F.col("before_ms"), 2))
        .alias("ratio"))


def compare_summary(changes: DataFrame) -> DataFrame:
    """Rows per kind of change and pair, and the detectors which fired on each side."""
    def ids(side: str) -> Column:
        return F.concat_ws(",", F.array_sort(F.collect_set(
            F.when(F.col(side).isNotNull(), F.col("detector")))))
    kind = F.col("change")
    return changes.groupBy("pair_id").agg(
        F.count_if(kind.isin("grew", "shrank")).alias("moved"),
        *[F.count_if(kind == k).alias(k) for k in ("appeared", "vanished", "steady")],
        ids("b").alias("fired_before"), ids("a").alias("fired_after"))


def silent_in_both(summary: DataFrame) -> DataFrame:
    """Detectors which ran on both sides and found nothing on either.

    Takes `report_summary` rows with `pair_id` and `side`.
    """
    return summary.groupBy("pair_id", "detector").agg(
        F.count_if(F.col("state") == "silent").alias("_n")).where(F.col("_n") == 2).drop("_n")
