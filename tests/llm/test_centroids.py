import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sonolume.llm import centroids


def brute(rows, clusters, rounds, dim):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: ("~" if r[0] is None else hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    where = [v for _, v in sorted(kept, key=key)[:clusters]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [min((apart(v, c), n) for n, c in enumerate(where)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for c in range(len(where)):
            own = [v for (_, v), (_, n) in zip(kept, found) if n == c]
            if own:
                where[c] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    by = Counter()
    for distance, n in found:
        by[n] += distance
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in where]
    return Counter((i, n, distance, by[n], sum(by.values()), digest[n]) for (i, _), (distance, n) in zip(kept, found))


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, distance string, `v.x` int, cluster string, vec_ID_ int")


def found(df, **options):
    return Counter(tuple(r) for r in centroids.cluster_vectors(df, **options).collect())


@pytest.mark.parametrize("scale", [1.0, 2.5e5])
def test_equals_brute_force(spark, scale):
    rng = random.Random(4)
    dim = 6
    rows = [(i, [float(np.float32(rng.choice([-1, 0, 0.5, rng.gauss(0, 1)]) * scale)) for _ in range(dim)]) for i in range(120)]
    rows += [(1, rows[1][1]), (1, rows[2][1]), (None, rows[3][1]), (None, None), (200, [1.0] * 5), (201, []), (202, [None] + [1.0] * 5), (203, [math.nan] + [1.0] * 5), (204, [math.inf] + [1.0] * 5)]
    df = table(spark, [(i, v, "x", 1, "y", 2) for i, v in rows]).repartition(5)
    assert found(df, clusters=9, rounds=4, dim=dim) == brute(rows, 9, 4, dim)


def test_few_vectors_equal_ones_and_none(spark):
    rows = [(i, [0.5, -0.25]) for i in range(4)] + [(9, [3.0, 3.0])]
    df = table(spark, [(i, v, None, None, None, None) for i, v in rows], "double")
    assert found(df, clusters=40, rounds=5, dim=2) == brute(rows, 40, 5, 2)
    assert found(df.limit(0)) == Counter() and found(df, dim=3) == Counter()


def test_distance_beyond_a_long_is_an_error(spark):
    df = table(spark, [(1, [1e30, 0.0], None, None, None, None), (2, [-1e30, 0.0], None, None, None, None)], "double")
    with pytest.raises(Exception, match="(?i)overflow|too big|large|decimal"):
        found(df, clusters=1, rounds=1, dim=2)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 12), st.integers(1, 4), st.integers(0, 9), st.integers(1, 3), st.randoms(use_true_random=False))
def test_walk_finds_the_nearest(k, d, n, spread, rng):
    c = np.array([[rng.randint(-spread * 4, spread * 4) for _ in range(d)] for _ in range(k)])
    x = np.array([[rng.randint(-spread * 6, spread * 6) for _ in range(d)] for _ in range(n)]).reshape(n, d)
    apart = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    for kind in (np.int64, object):
        cluster, distance, depth = centroids.Frontier(c.astype(kind)).nearest(x.astype(kind))
        assert cluster.tolist() == apart.argmin(axis=1).tolist() and distance.tolist() == apart.min(axis=1).tolist()
        assert all(1 <= t <= k for t in depth)


def test_walk_stops_early_where_centroids_lie_apart():
    c = np.arange(400).reshape(200, 2) * 1000
    _, _, depth = centroids.Frontier(c).nearest(c + 3)
    assert depth.max() <= 2
