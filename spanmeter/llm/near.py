"""Links and components of near-identical sets, found through posted keys.

Given one row per different set with the keys it is posted under, two sets are compared when they
share at least `need` keys. The keys which no other set has can't match; each set posts only the
rarest of its shared keys, as many as make it certain that two sets with `need` common keys meet in
one of them (with m shared keys: m - need + 1). Frequent keys, such as those of a passage which a
third of all texts hold, are thereby never posted by texts that are otherwise different.

Not every pair inside a bucket is formed. First each posted set meets the smallest member of each of
its buckets; after the components of these links are known, only sets of different components meet,
each pair once, at the smallest key which both have posted. Every link is confirmed on the full sets,
and no cap is set on buckets or partners.

A crowded bucket of different sets that are too alike to be told apart by rare keys is compared in blocks
instead: a task holds the sets of two blocks, compares them all on the full sets, and returns which of them
hang together, so that no pair is written. That is still work with the square of the bucket, but each set
travels once per block and not per partner.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .graph import components


def posted(items: DataFrame, need: int) -> DataFrame:
    """items (id, n, keys) -> (id, n, keys, posts) of the sets which can have a partner at all."""
    posts = items.select("id", F.explode("keys").alias("key"))
    often = posts.groupBy("key").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    shared = (posts.join(often, "key").groupBy("id")
              .agg(F.sort_array(F.collect_list(F.struct("f", "key"))).alias("s")).where(F.size("s") >= need))
    return (items.select("id", "n").join(shared, "id")
            .select("id", "n", F.col("s.key").alias("keys"),
                    F.slice(F.col("s.key"), F.lit(1), F.size("s") - (need - 1)).alias("posts")))


BLOCK_SETS = 2048         # about as many sets and elements go into a block
BLOCK_ELEMENTS = 1_000_000


def _confirmed(pairs: DataFrame, kept: DataFrame, full: DataFrame, need: int, percent: int) -> DataFrame:
    """Of pairs (a, b, n), n the sum of their sizes, those with enough common keys (the pairs share one),
    then with the asked share of common elements."""
    def side(table: DataFrame, name: str) -> DataFrame:
        return table.select(*[F.col(c).alias(name if c == "id" else f"{name}_{c}") for c in table.columns])
    if need > 1:
        keys = kept.select("id", "keys")
        pairs = (pairs.join(side(keys, "a"), "a").join(side(keys, "b"), "b")
                 .where(F.size(F.array_intersect("a_keys", "b_keys")) >= need).select("a", "b", "n"))
    both = F.size(F.array_intersect("a_items", "b_items"))
    return (pairs.join(side(full, "a"), "a").join(side(full, "b"), "b").withColumn("both", both)
            .where(F.col("both") * 100 >= (F.col("n") - F.col("both")) * percent).select("a", "b"))


def _hanging_together(ids: np.ndarray, items: pa.ListArray, left: np.ndarray, right: np.ndarray,
                      percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Sets of `left` and `right` (masks) which links between the two connect: their ids, and the smallest
    id each is connected with."""
    items = items.combine_chunks() if isinstance(items, pa.ChunkedArray) else items
    n = np.diff(items.offsets.to_numpy()).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(n)])[:-1]
    names, number = np.unique(items.flatten().to_numpy(), return_inverse=True)
    root = np.arange(len(ids))
    order = np.argsort(ids, kind="stable")
    mark = np.zeros(len(names), bool)
    for x in order[left[order]].tolist():
        mine = number[starts[x]:starts[x] + n[x]]
        mark[mine] = True
        both = np.add.reduceat(mark[number], starts, dtype=np.int64)
        mark[mine] = False
        linked = right & (both * 100 >= (n + n[x] - both) * percent)
        linked[x] = False
        if linked.any():
            linked[x] = True
            groups = np.unique(root[linked])
            root[np.isin(root, groups)] = groups[np.argmin(ids[groups])]
    found = np.flatnonzero(root != np.arange(len(ids)))
    return ids[found], ids[root[found]]


def _in_blocks(posts: DataFrame, crowded: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(a, b): what hangs together by links inside the crowded buckets (key, f, w: members, elements)."""
    blocks = F.greatest(F.ceil(F.col("f") / BLOCK_SETS), F.ceil(F.col("w") / BLOCK_ELEMENTS)).cast("int")
    rows = (posts.select("id", "key").join(crowded.select("key", blocks.alias("nb")), "key").join(full, "id")
            .withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("nb")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))))
    rows = rows.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                       "block", "id", "items")

    def compare(t: pa.Table) -> pa.Table:
        block = t.column("block").to_numpy()
        a, b = _hanging_together(t.column("id").to_numpy(), t.column("items"), block == t.column("lo")[0].as_py(),
                                 block == t.column("hi")[0].as_py(), percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("key", "lo", "hi").applyInArrow(compare, "a long, b long").distinct()


def links(items: DataFrame, need: int, contents: Callable[[DataFrame], DataFrame],
          percent: int = 75, crowd: int | None = None) -> DataFrame:
    """(id, component) of the sets linked to another one, component the smallest id reachable.

    items: (id long, n long, keys array<long>), ids unique, n the size of the set. contents: gives
    (id, items array<long>) for a table of ids. Linked: 100 * common >= percent * united.
    crowd: buckets of more sets of different components are compared in blocks (None: none are).
    """
    kept = settle(posted(items, need))
    full = settle(contents(kept.select("id")))
    posts = kept.select("id", "n", "posts", F.explode("posts").alias("key"))
    first = (posts.groupBy("key").agg(F.min(F.struct("id", "n")).alias("b"), F.count(F.lit(1)).alias("f"))
             .where("f > 1").select("key", F.col("b.id").alias("b"), F.col("b.n").alias("nb")))
    meet = (posts.select("id", "n", "key").join(first, "key").where("id <> b")
            .select(F.col("id").alias("a"), "b", (F.col("n") + F.col("nb")).alias("n")).distinct())
    stars = components(_confirmed(meet, kept, full, need, percent))
    stars = settle(stars)
    named = kept.select("id", "n", "posts").join(stars, "id", "left").select(
        "id", "n", "posts", F.coalesce("component", "id").alias("c"))
    named = settle(named)
    posts = named.select("id", "n", "c", "posts", F.explode("posts").alias("key"))
    extra = None
    if crowd is not None:
        # A bucket whose sets are all of one component has nothing left to find.
        crowded = settle(posts.groupBy("key").agg(
            F.count(F.lit(1)).alias("f"), F.sum("n").alias("w"), F.min("c").alias("c0"), F.max("c").alias("c1"))
            .where((F.col("f") > crowd) & (F.col("c0") != F.col("c1"))).select("key", "f", "w"))
        extra = settle(_in_blocks(posts, crowded, full, percent))
        posts = posts.join(crowded, "key", "left_anti")
    left, right = (posts.select("key", F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("c").alias(f"c{x}"),
                                F.col("posts").alias(f"p{x}")) for x in "ab")
    # A pair whose smallest common key is crowded has been compared in blocks.
    rest = left.join(right, on=(left.key == right.key) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))
                     & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
                     & (F.array_min(F.array_intersect("pa", "pb")) == left.key)).select(
                         "a", "b", (F.col("na") + F.col("nb")).alias("n"))
    more = _confirmed(rest, kept, full, need, percent)
    more = more.union(stars.select(F.col("id").alias("a"), F.col("component").alias("b")))
    return components(more if extra is None else more.union(extra))
