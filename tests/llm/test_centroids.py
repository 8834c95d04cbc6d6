"""Centroid clustering against a plain version in Python integers; odd vectors, ties, components beyond 2^53."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from lodeworks.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int, id string, cluster string, x int"


def plain(rows, k, rounds, dimension):
    """(vec_id, cluster, distance, cluster inertia, inertia, centroid) of each kept row."""
    fit = lambda v: v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, v) for i, v in rows if fit(v)]
    key = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    whole = lambda v: [math.floor(256 * int(x)) if abs(x) > 2**60 else math.floor(256 * x) for x in v]
    now = [whole(v) for _, v in sorted(kept, key=lambda r: (key(r[0]), r[1]))[:k]]
    own = [whole(v) for _, v in kept]

    def assign():
        far = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in now] for v in own]
        return [(d.index(min(d)), min(d)) for d in far]

    for _ in range(rounds):
        best = assign()
        for c in range(len(now)):
            mine = [v for v, b in zip(own, best, strict=True) if b[0] == c]
            if mine:
                now[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    best = assign()
    inertia = [sum(d for c, d in best if c == k) for k in range(len(now))]
    fits = lambda x: x if x < 2**63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return [(i, c, fits(d), fits(inertia[c]), fits(sum(inertia)), sha[c]) for (i, _), (c, d) in zip(kept, best, strict=True)]


def answer(spark, rows, k, rounds, dimension):
    df = spark.createDataFrame([(i, v, 1, "a", "b", 2) for i, v in rows], SCHEMA).repartition(3)
    found = centroids.cluster(df, k=k, rounds=rounds, dimension=dimension)
    return [tuple(r) for r in found.assigned().join(found.described(), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()]


@pytest.mark.parametrize("large", [None, 2.0**22, 3.0e17, 1.0e300])
def test_matches_plain_version(spark, large):
    rng = random.Random(4)
    spots = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(spots)]) for i in range(400)]
    rows += [(400, None), (401, [1.0] * 5), (402, [1.0] * 7), (403, [None] + [1.0] * 5), (404, [math.nan] * 6), (405, [math.inf] + [0.0] * 5), (406, []), (None, spots[0])]
    rows += [(500, [0.5] * 6), (500, [0.25] * 6), (501, [0.0] * 6), (501, [0.0] * 6), (502, [-0.0] * 6), *((600 + k, [0.125 * (k % 3)] * 6) for k in range(60))]
    if large:
        rows += [(700 + k, [large * rng.choice([1, -1, 0.5]) for _ in range(6)]) for k in range(30)]
    want = plain(rows, 9, 4, 6)
    assert Counter(answer(spark, rows, 9, 4, 6)) == Counter(want)
    assert len({r[1] for r in want}) > 4


def test_few_and_none(spark):
    rows = [(1, [0.0, 1.0]), (2, [3.0, 1.0])]
    assert Counter(answer(spark, rows, 40, 5, 2)) == Counter(plain(rows, 40, 5, 2))
    assert answer(spark, [(1, None), (2, [1.0])], 40, 5, 2) == []
    same = [(i, [0.5, 0.5]) for i in range(50)]
    assert Counter(answer(spark, same, 7, 3, 2)) == Counter(plain(same, 7, 3, 2))  # empty centroids stay


def test_expansion_is_exact_up_to_the_bound():
    """Ties and distances at the largest components that the matrix product takes."""
    rng = np.random.default_rng(1)
    for d in (1, 3, 64, 1000):
        top = centroids.bound(d)
        assert 4 * d * top * top <= 2**53 < 4 * d * (top + 1) ** 2
        x = rng.integers(-top, top, (50, d), endpoint=True)
        c = rng.integers(-top, top, (8, d), endpoint=True)
        x[0], c[0], x[1], c[1], c[2] = top, -top, -top, top, top
        now = centroids.Centroids(c.tolist())
        assert not now.large
        best, far = now.nearest(x.astype(float))
        exact = now.nearest_exact(x.astype(object))
        assert best.tolist() == exact[0].tolist() and far.tolist() == exact[1].tolist()
        over = centroids.Centroids([*c.tolist(), [top + 1] * d])
        assert over.large == [8] and over.nearest(x.astype(float))[1].tolist() == over.nearest_exact(x.astype(object))[1].tolist()


def test_scale_is_a_power_of_two(spark):
    with pytest.raises(ValueError, match="power of two"):
        centroids.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>"), scale=100)
