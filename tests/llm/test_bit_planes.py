"""Bit-plane k-means against integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from spanmeter.llm import bit_planes


def vector(seed, spread=0.3):
    r = random.Random(seed)
    centre = random.Random(seed % 9)
    return [centre.gauss(0, spread) + r.gauss(0, spread / 3) for _ in range(64)]


VECTORS = [(k, vector(k)) for k in range(150)]
VECTORS += [(200, None), (201, []), (202, vector(1)[:63]), (203, vector(1) + [0.0]), (204, [None] + vector(2)[1:]),
            (205, [math.nan] + vector(2)[1:]), (206, [math.inf] + vector(2)[1:]), (207, [0.0] * 64), (208, vector(3)),
            (7, vector(11)), (7, vector(12)), (None, vector(13)), (209, [1e30] + vector(4)[1:]), (210, [100.5, -2000.25] + vector(5)[2:])]


def kept(rows):
    return [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) * 1024 < 1 << 27 for x in v)]


def brute(rows, k=8, rounds=10):
    rows = kept(rows)
    hashed = sorted(rows, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(x) for _, x in hashed[:k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        of = [near(x)[1] for _, x in rows]
        for c in range(len(centres)):
            own = [x for (_, x), n in zip(rows, of, strict=True) if n == c]
            if own:
                centres[c] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    found = [(i, *near(x)) for i, x in rows]
    total = sum(d for _, d, _ in found)
    return sorted([(i, c, d, sum(e for _, e, n in found if n == c), total,
                    hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, d, c in found], key=str)


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in VECTORS],
                                 "vec_id long, embedding array<double>, v string, cluster int, x long").repartition(3)


@pytest.mark.parametrize("k,rounds", [(8, 10), (3, 1), (500, 2)])
def test_against_integers(vectors, k, rounds):
    got = bit_planes.clusters(vectors, clusters=k, rounds=rounds)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(VECTORS, k, rounds)


def test_empty_table(vectors):
    assert bit_planes.clusters(vectors.where("false")).collect() == []
    assert bit_planes.clusters(vectors.where("vec_id between 200 and 206")).collect() == []


@pytest.mark.parametrize("low,high", [(0, 0), (0, 1), (-1, 0), (-8, 7), (-9, 7), (-(1 << 27), (1 << 27) - 1)])
def test_planes_give_exact_dots_norms_and_sums(low, high):
    bits = bit_planes.bits_needed(low, high)
    r = np.random.default_rng(1)
    x = r.integers(low, high, size=(40, 64), endpoint=True)
    x[0], x[1] = low, high
    p = bit_planes.packed(x, bits)
    assert (bit_planes.sums(p) == x.sum(axis=0)).all() and (bit_planes.norms(p) == (x * x).sum(axis=1)).all()
    for k in range(5):
        assert (bit_planes.dots(p, p[k]) == x @ x[k]).all()
