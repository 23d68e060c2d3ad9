"""Near-duplicate vectors through an inverted multi-index over the two halves of a vector.

Each half has a codebook of its own, fitted on a bounded sample; the pairs of code words form the
grid of cells. A query walks the cells outwards (multi-sequence traversal): both halves' code words
are ordered by the least distance at which a vector nearer to that code word than to the query's own
can lie, the distance to the bisecting plane, and a pair of code words is visited while the sum of
the two squares stays within a bound. With the whole squared distance that the cosine allows as the
bound, no link can be missed. The target recall lowers it: of a difference without a preferred
direction, the part across one plane of each half is a share of its squared length distributed as
chi-square with two degrees over the dimension, whose quantile at the target is -2 ln(1 - recall).
What is visited is compared exactly, in double precision, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .graph import components
from .words import mix

COSINE = 0.95
SAMPLE = 4096        # vectors which the codebooks are fitted on
RECALL = 0.999       # of links just at the threshold; closer ones are missed less often
PER_CELL = 512       # vectors of an even cell, from which the size of the codebooks follows
MAX_WORDS = 64       # code words of a half
BLOCK = 1024         # vectors compared with another block at a time


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that squares neither overflow nor vanish."""
    if not len(x):
        return x
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_codebook(points: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """k-means with evenly picked starts; empty code words keep their place."""
    points = np.unique(points, axis=0)
    words = points[np.unique(np.linspace(0, len(points) - 1, min(size, len(points))).astype(int))].copy()
    for _ in range(rounds):
        own = _distances(points, words).argmin(1)
        for k in range(len(words)):
            if (own == k).any():
                words[k] = points[own == k].mean(0)
    return np.unique(words, axis=0)


def _distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1)[None], 0)


def _outward(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest code word of each row, and the least squared distance to any point of each word's region."""
    d = _distances(x, words)
    own = d.argmin(1)
    apart = np.sqrt(_distances(words, words))[own]
    far = d - d[np.arange(len(x)), own][:, None]
    step = np.divide(far, 2 * apart, out=np.zeros_like(far), where=apart > 0)
    return own, step * step


def visits(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own cell of each row; and the (row, cell) visits of the two sorted sequences, nearest pairs first."""
    half = x.shape[1] // 2
    own1, far1 = _outward(x[:, :half], books[0])
    own2, far2 = _outward(x[:, half:], books[1])
    order1, order2 = far1.argsort(1), far2.argsort(1)
    s1, s2 = np.take_along_axis(far1, order1, 1), np.take_along_axis(far2, order2, 1)
    rows, cells = [], []
    width = len(books[1])
    for k in range(len(books[0])):            # the k-th word of the first sequence ...
        going = np.flatnonzero(s1[:, k] <= reach)
        if not len(going):
            break
        n = (s2[going] <= (reach - s1[going, k])[:, None]).sum(1)   # ... meets so many of the second
        r = np.repeat(going, n)
        j = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
        rows.append(r)
        cells.append(order1[r, k] * width + order2[r, j])
    empty = np.zeros(0, np.int64)
    return own1 * width + own2, np.concatenate([empty, *rows]), np.concatenate([empty, *cells])


def _join_labels(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id reachable inside a block of links between `left` (rows) and `right` (columns)."""
    big = np.iinfo(np.int64).max
    l, r = left.copy(), right.copy()
    while True:
        r2 = np.minimum(r, np.where(linked, l[:, None], big).min(0, initial=big))
        l2 = np.minimum(l, np.where(linked, r2[None], big).min(1, initial=big))
        if (l2 == l).all() and (r2 == r).all():
            return l, r
        l, r = l2, r2


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                 cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `vectors`.

    Rows link at a cosine of `cosine` or more. A vector that is null, empty, zero or holds a null or
    non-finite component links with nothing, and vectors of different lengths do not link. Equal
    vectors are one class, compared once, and count as links of each other. A row without an id links
    with nothing, has no component and is not kept. Other columns are not read.
    A `recall` of 1 visits every cell that can hold a link.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).alias("v"))
    if dict(rows.dtypes)["v"] not in ("array<float>", "array<double>"):
        rows = rows.select("i", F.col("v").cast("array<double>").alias("v"))
    sound = (F.col("i").isNotNull() & (F.size("v") > 0)
             & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
             & F.exists("v", lambda x: x != 0))
    rows = settle(rows.select("i", F.when(sound, F.col("v")).alias("v")))
    classes = settle(rows.where("v is not null").groupBy("v").agg(F.min("i").alias("id"), F.count("*").alias("m")))
    edges, counts = [], []
    for width, n in classes.groupBy(F.size("v")).count().orderBy(F.size("v")).collect():
        linked = settle(_links(classes.where(F.size("v") == width), n, cosine, recall))
        counts.append(linked.select("id", "links"))
        edges.append(linked.select(F.col("id").alias("a"), F.col("root").alias("b")))
    empty = vectors.sparkSession.range(0)
    other = empty.select("id", F.col("id").alias("links"))
    pairs = empty.select(F.col("id").alias("a"), F.col("id").alias("b"))
    for c, e in zip(counts, edges, strict=True):
        other, pairs = other.union(c), pairs.union(e)
    found = (classes.join(other.groupBy("id").agg(F.sum("links").alias("links")), "id", "left")
             .join(components(pairs), "id", "left")
             .select("v", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"),
                     F.coalesce("component", "id").alias("c")))
    out = rows.join(found, "v", "left").select(
        F.col("i").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("c", "i").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(classes: DataFrame, n: int, cosine: float, recall: float) -> DataFrame:
    """(id, links, root): links to other classes by multiplicity, and an edge towards the component, per block."""
    kind = np.float32 if dict(classes.dtypes)["v"] == "array<float>" else np.float64
    size = int(np.clip(np.sqrt(n / PER_CELL), 2, MAX_WORDS))
    share = min(1.0, SAMPLE / n)
    picked = classes.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) <= F.lit(int(share * (1 << 20)))).select("v")
    sample = picked.limit(2 * SAMPLE).toArrow()
    sample = _matrix(sample.column("v").combine_chunks()) if sample.num_rows else np.ones((1, 2))
    sample = _unit(sample)
    half = sample.shape[1] // 2
    reach = min(1.0, -2 * np.log(1 - recall) / sample.shape[1]) if recall < 1 else 1.0
    allowed = 2 * (1 - cosine) * reach + 1e-9
    books = fit_codebook(sample[:, :half], size), fit_codebook(sample[:, half:], size)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of role 0 for the cell of each vector, of role 1 for each cell that it visits."""
        for b in batches:
            raw = _matrix(b.column("v"))
            x, raw = _unit(raw), raw.astype(kind)
            for at in range(0, len(x), 4096):
                part = x[at:at + 4096]
                own, r, cell = visits(part, books, allowed)
                row = np.concatenate([np.arange(len(part)), r])
                ids = b.column("id").to_numpy()[at:at + 4096][row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([own, cell])), pa.array(np.repeat([0, 1], [len(part), len(r)])),
                     pa.array(ids), pa.array(b.column("m").to_numpy()[at:at + 4096][row]),
                     pa.FixedSizeBinaryArray.from_buffers(
                         pa.binary(raw.itemsize * raw.shape[1]), len(row),
                         [None, pa.py_buffer(raw[at:at + 4096][row].tobytes())]).cast(pa.binary())],
                    ["cell", "role", "id", "m", "u"])

    placed = settle(classes.mapInArrow(place, "cell long, role long, id long, m long, u binary"))
    # The grid is bounded by the codebooks; its counts say into how many blocks a cell is cut.
    grid = placed.groupBy("cell").agg(
        F.ceil(F.count_if(F.col("role") == 0) / BLOCK).cast("int").alias("s"),
        F.ceil(F.count_if(F.col("role") == 1) / BLOCK).cast("int").alias("q")).where("s > 0 and q > 0")
    here = placed.join(grid, "cell").withColumn("h", F.xxhash64("id"))
    stored = here.where("role = 0").select(
        "cell", F.pmod("h", "s").cast("int").alias("sb"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("qb"), "id", "m", "u")
    asking = here.where("role = 1").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("sb"), F.pmod("h", "q").cast("int").alias("qb"), "id", "m", "u")
    asking = asking.select(*[F.col(c).alias(c) for c in asking.columns])  # columns of its own for the cogroup

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        def side(t: pa.Table):
            ids = t.column("id").to_numpy()
            x = _unit(np.frombuffer(b"".join(t.column("u").to_pylist()), kind).reshape(len(ids), -1).astype(np.float64))
            order = np.argsort(ids)
            return ids[order], t.column("m").to_numpy()[order], x[order]
        out = [np.zeros(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            (si, sm, sx), (qi, _, qx) = side(left), side(right)
            linked = qx @ sx.T >= cosine
            linked &= qi[:, None] != si[None]
            total = linked.astype(np.float64) @ sm.astype(np.float64)
            ql, sl = _join_labels(linked, qi, si)
            some, met = linked.any(1), linked.any(0)
            out = [np.concatenate([qi[some], si[met]]),
                   np.concatenate([total[some].astype(np.int64), np.zeros(int(met.sum()), np.int64)]),
                   np.concatenate([ql[some], sl[met]])]
        return pa.table({"id": out[0], "links": out[1], "root": out[2]})

    keys = ["cell", "sb", "qb"]
    return (stored.groupBy(*keys).cogroup(asking.groupBy(*keys))
            .applyInArrow(compare, "id long, links long, root long"))
