"""Sort-means against a plain version that measures every distance in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from lumenframe.llm import clustering


def plain(rows, k, rounds, dim, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cents = [q for _, q in sorted(kept, key=key)[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        member = [near(q)[1] for _, q in kept]
        for j in range(len(cents)):
            mine = [q for (_, q), m in zip(kept, member) if m == j]
            if mine:
                cents[j] = [sum(c) // len(mine) for c in zip(*mine)]
    return sorted((str(i), *reversed(near(q))) for i, q in kept), cents


def same(spark, rows, k=16, rounds=3, dim=6, scale=64, parts=3):
    schema = "vec_id long, embedding array<float>, cluster int, distance string, q int, n int, kind int, sums int"
    df = spark.createDataFrame([(i, v, 1, "x", 1, 1, 1, 1) for i, v in rows], schema).repartition(parts)
    out, about = clustering.cluster(df, k=k, rounds=rounds, dim=dim, scale=scale)
    assert out.columns == ["vec_id", "cluster", "distance"]
    got = sorted((str(r.vec_id), r.cluster, r.distance) for r in out.collect())
    want, cents = plain(rows, k, rounds, dim, scale)
    assert got == want and [a["centroid"] for a in about] == cents
    for j, a in enumerate(about):
        assert (a["n"], a["inertia"]) == (sum(r[1] == j for r in got), sum(r[2] for r in got if r[1] == j))


@pytest.mark.parametrize("seed", range(3))
def test_random_vectors(spark, seed):
    r = random.Random(seed)
    centres = [[r.uniform(-2, 2) for _ in range(6)] for _ in range(9)]
    rows = [(i, [float(np.float32(x + r.gauss(0, 0.3))) for x in r.choice(centres)]) for i in range(300)]
    same(spark, rows, k=[16, 5, 1][seed], rounds=[3, 1, 0][seed])


def test_ties_repeats_nulls_and_odd_vectors(spark):
    r = random.Random(8)
    rows = [(i % 40, [float(r.randint(-2, 2)) / 64 for _ in range(6)]) for i in range(160)]  # few values: distances tie, vectors and ids repeat
    rows += [(7, [0.5] * 6)] * 120 + [(None, [0.25] * 6), (None, [-0.25] * 6)]
    rows += [(900, None), (901, []), (902, [0.0] * 5), (903, [0.0] * 7), (904, [0.0, None, 0.0, 0.0, 0.0, 0.0]), (905, [math.nan] + [0.0] * 5), (906, [math.inf] * 6), (907, [-math.inf] * 6), (908, [-1e-9] * 6)]
    same(spark, rows)


def test_few_vectors_and_none(spark):
    same(spark, [(1, [0.1] * 6), (None, [0.2] * 6), (3, [9.0] * 6)])
    same(spark, [(1, None), (2, [1.0])])
    same(spark, [])


def test_far_components_are_an_error(spark):
    with pytest.raises(Exception, match="is not below"):
        clustering.cluster(spark.createDataFrame([(1, [1e30] * 4)], "vec_id long, embedding array<float>"), dim=4)


def test_scan_stops_strictly_beyond_twice_the_distance():
    # centroid 0 lies at exactly twice the distance from centroid 1, opposite: a tie that the smaller number wins
    cents = np.array([[4], [0], [100]])
    order, apart = clustering.neighbours(cents)
    best, dist, measured = clustering.assign(np.array([[2], [1], [99]]), np.array([1, 1, 1]), cents, order, apart)
    assert best.tolist() == [0, 1, 2] and dist.tolist() == [4, 1, 1]
    assert measured == 3 + 2 + 1  # one first distance each; the first vector looks at one more, the last at both, the middle one at none


def test_fewer_distances_than_all_pairs():
    g = np.random.default_rng(4)
    cents = g.integers(-900, 900, (16, 8))
    before = np.repeat(np.arange(16), 50)
    x = cents[before] + g.integers(-60, 60, (800, 8))
    best, dist, measured = clustering.assign(x, before, cents, *clustering.neighbours(cents))
    every = ((x[:, None] - cents) ** 2).sum(2)
    assert (best == every.argmin(1)).all() and (dist == every.min(1)).all() and measured < 0.5 * every.size
