"""k-means of integer vectors on bit planes.

A vector of 64 whole numbers in two's complement is one 64-bit word per bit: bit i of plane b is bit b of
component i. With w(b) the weight of a bit (negative for the sign's), the dot product of two vectors is the sum
of w(a) w(b) popcount(plane a AND plane b), exact in integers; norms and squared distances follow from it. The
sums which a new centroid needs are counted per plane as well. Planes are packed once and written; each round
reads them, and only k rows of sums leave it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle

WIDTH = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = 3
MAX_BITS = 28      # with the sign: a squared distance of 64 such components still fits a long
_SLICE = 1 << 15


def bits_needed(least: int, most: int) -> int:
    """Bits of two's complement which hold all of [least, most]."""
    return max((-least - 1).bit_length() if least < 0 else 0, most.bit_length() if most > 0 else 0) + 1


def bit_weights(bits: int) -> np.ndarray:
    w = np.left_shift(np.int64(1), np.arange(bits, dtype=np.int64))
    w[-1] = -w[-1]
    return w


def packed(x: np.ndarray, bits: int) -> np.ndarray:
    """The planes, (n, bits) of uint64, of whole numbers (n, 64)."""
    out = np.empty((len(x), bits), np.uint64)
    for b in range(bits):
        bit = ((x >> b) & 1).astype(np.uint8)
        out[:, b] = np.packbits(bit, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def dots(planes: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The dot product of each row of `planes` (n, bits) with the one vector `other` (bits)."""
    w = bit_weights(planes.shape[1])
    out = np.zeros(len(planes), np.int64)
    for a in range(planes.shape[1]):
        column = np.ascontiguousarray(planes[:, a])
        part = np.zeros(len(planes), np.int64)
        for b in range(len(other)):
            part += np.bitwise_count(column & other[b]).astype(np.int64) * w[b]
        out += part * w[a]
    return out


def norms(planes: np.ndarray) -> np.ndarray:
    """The squared length of each row: plane pairs with themselves."""
    w = bit_weights(planes.shape[1])
    out = np.zeros(len(planes), np.int64)
    for a in range(planes.shape[1]):
        for b in range(a + 1):
            met = np.bitwise_count(planes[:, a] & planes[:, b]).astype(np.int64)
            out += met * (w[a] * w[b] * (1 if a == b else 2))
    return out


def nearest(planes: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre (ties: the smaller) and the squared distance to it, for each row."""
    own, theirs = norms(planes), norms(centres)
    best = np.zeros(len(planes), np.int32)
    least = None
    for c in range(len(centres)):
        d = own + theirs[c] - 2 * dots(planes, centres[c])
        if least is None:
            least = d
            continue
        closer = d < least
        best[closer], least[closer] = c, d[closer]
    return best, least if least is not None else own


def sums(planes: np.ndarray) -> np.ndarray:
    """The sum of all rows, component by component: set bits counted per plane."""
    w = bit_weights(planes.shape[1])
    out = np.zeros(WIDTH, np.int64)
    for b in range(planes.shape[1]):
        bits = np.unpackbits(np.ascontiguousarray(planes[:, b]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out += bits.sum(axis=0, dtype=np.int64) * w[b]
    return out


def _planes(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.uint64)


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x): floor(scale * component) of the vectors with 64 finite components below 2^27 after scaling."""
    v = F.col("v")
    x = F.transform(v, lambda e: F.floor(e.cast("double") * F.lit(float(scale))))
    sound = (F.size(v) == WIDTH) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (
        F.abs(e.cast("double")) * F.lit(float(scale)) < F.lit(float(1 << (MAX_BITS - 1)))))
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
            .where(F.coalesce(sound, F.lit(False))).select("vec_id", x.alias("x")))


def _pack(rows: DataFrame, bits: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                b = whole.slice(at, _SLICE)
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
                p = packed(x, bits)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(x) + 1, dtype=np.int32) * bits), pa.array(p.view(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], ["vec_id", "planes"])

    return rows.mapInArrow(pack, "vec_id long, planes array<long>")


def first_centres(rows: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors whose ids hash lowest, in that order; (k, 64), k at most `clusters`."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = rows.orderBy(h, "x").limit(clusters).select("x").collect()
    return np.array([r["x"] for r in found], np.int64).reshape(-1, WIDTH)


def _moved(planes: DataFrame, centres: np.ndarray, bits: int) -> np.ndarray:
    """The centres after one round: floored means of what is nearest to each."""
    shipped = packed(centres, bits)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((len(shipped), WIDTH), np.int64), np.zeros(len(shipped), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                p = _planes(whole.slice(at, _SLICE).column(0))
                best, _ = nearest(p, shipped)
                for c in np.unique(best):
                    own = p[best == c]
                    total[c] += sums(own)
                    n[c] += len(own)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({
            "c": pa.array(used, pa.int32()), "n": pa.array(n[used], pa.int64()),
            "s": pa.array(total[used].tolist(), pa.list_(pa.int64()))})

    parts = planes.select("planes").mapInArrow(fold, "c int, n long, s array<long>")
    found = parts.select("c", "n", F.posexplode("s").alias("i", "s")).groupBy("c", "i").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"))
    moved = centres.copy()
    for r in found.collect():   # clusters x 64 rows
        moved[r["c"], r["i"]] = r["s"] // r["n"]
    return moved


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
             clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector that is kept.

    Kept are vectors of 64 components, none null or non-finite, whose scaled values are below 2^27 (squared
    distances are longs). Others, an empty table among them, give no rows; with fewer vectors than clusters, each
    is a centre. A vector without an id hashes as an empty one; rows with the same id are vectors of their own.
    Sums of distances which no long holds are null. Other columns are not read.
    """
    rows = kept_vectors(vectors, id_col, vector_col, scale)
    low, high = rows.agg(F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    bits = bits_needed(low or 0, high or 0)
    planes = settle(_pack(rows, bits))
    centres = first_centres(rows, clusters, seed)
    for _ in range(rounds):
        moved = _moved(planes, centres, bits)
        if (moved == centres).all():
            break   # a fixed point: further rounds change nothing
        centres = moved
    shipped = packed(centres, bits)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                b = whole.slice(at, _SLICE)
                best, d = nearest(_planes(b.column(1)), shipped)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.int32()), pa.array(d, pa.int64())],
                                                 ["vec_id", "cluster", "distance"])

    assigned = planes.mapInArrow(assign, "vec_id long, cluster int, distance long")
    spread = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster")
              .agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    texts = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]

    def by_cluster(values: list, kind: str):
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values] or [F.lit(None).cast(kind)]), F.col("cluster") + 1)

    def fits(v: int) -> int | None:
        return v if v < 1 << 63 else None

    return assigned.select(
        "vec_id", "cluster", "distance", by_cluster([fits(spread.get(c, 0)) for c in range(len(texts))], "long").alias("cluster_inertia"),
        F.lit(fits(sum(spread.values()))).cast("long").alias("inertia"), by_cluster(texts, "string").alias("centroid_sha256"))
