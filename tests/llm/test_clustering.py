"""Clustering against exact integers in plain Python."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from ledgerlight.llm import clustering

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, distance string, key string, x int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "a", "b", "c", 1) for i, v in rows], SCHEMA).repartition(3)


def brute_force(rows, k=16, rounds=3, width=64):
    held = [(i, tuple(math.floor(Fraction(x) * 64) for x in v)) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]

    def luck(row):
        return (row[0] is None, "" if row[0] is None else hashlib.sha256(f"1:{row[0]}".encode()).hexdigest(), row[1])

    centroids = [v for _, v in sorted(held, key=luck)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        by = {}
        for _, v in held:
            by.setdefault(nearest(v)[1], []).append(v)
        centroids = [tuple(sum(x) // len(x) for x in zip(*by[n])) if n in by else c for n, c in enumerate(centroids)]
    far = [(i, *nearest(v)) for i, v in held]
    inertia = {}
    for _, d, n in far:
        inertia[n] = inertia.get(n, 0) + d

    def fits(x):
        return x if x < 1 << 63 else None

    # a distance that is null leaves no sum
    own = {n: fits(s) if all(d < 1 << 63 for _, d, m in far if m == n) else None for n, s in inertia.items()}
    whole = None if any(d >= 1 << 63 for _, d, _ in far) else fits(sum(inertia.values()))
    return sorted(((i, n, fits(d), own[n], whole,
                    hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, d, n in far), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def some(r, spread=0.5):
    return [r.uniform(-spread, spread) for _ in range(64)]


def test_against_exact_integers_with_ties_and_odd_vectors(spark):
    r = random.Random(3)
    corners = [[r.choice((-1.0, 1.0)) for _ in range(64)] for _ in range(5)]
    rows = [(i, some(r)) for i in range(150)] + [(1000 + i, corners[i % 5]) for i in range(300)]
    rows += [(7, corners[0])] * 40 + [(None, some(r)), (None, corners[1])]  # repeats and missing ids
    rows += [(2000, None), (2001, []), (2002, [None] + [0.0] * 63), (2003, [float("nan")] + [0.0] * 63),
             (2004, [float("inf")] + [0.0] * 63), (2005, [0.0] * 63), (2006, [0.0] * 65), (2007, [-0.0] * 64)]
    found = result(clustering.cluster(table(spark, rows)))
    assert found == brute_force(rows)
    assert found == result(clustering.cluster(table(spark, rows).repartition(7)))


@pytest.mark.parametrize("large", [2.0**20, 1e15, 1e200])
def test_large_components_are_exact(spark, large):
    r = random.Random(4)
    rows = [(i, some(r)) for i in range(40)]
    rows += [(100 + i, [large * r.uniform(-1, 1) if k == i % 64 else x for k, x in enumerate(some(r))]) for i in range(20)]
    assert result(clustering.cluster(table(spark, rows))) == brute_force(rows)


def test_fewer_vectors_than_centroids_and_none(spark):
    r = random.Random(6)
    rows = [(i, some(r)) for i in range(3)] + [(9, [0.25] * 64)] * 2
    assert result(clustering.cluster(table(spark, rows))) == brute_force(rows)
    assert result(clustering.cluster(table(spark, rows).where("vec_id < 0"))) == []


def test_tournament_finds_the_nearest(spark):
    random_ = np.random.default_rng(1)
    centroids = [tuple(int(x) for x in c) for c in random_.integers(-3, 4, (16, 4))]
    centroids[9] = centroids[2]  # an equal pair: the smaller number wins
    x = random_.integers(-4, 5, (3000, 4)).astype(float)
    bisectors = clustering.Bisectors(centroids)
    best = bisectors.nearest(x)
    far = ((x[:, None, :] - np.array(centroids)[None]) ** 2).sum(2)
    assert (best == far.argmin(1)).all()
    assert (bisectors.distance(x, best) == far.min(1)).all()
