import numpy as np
import pytest

from sonolume.operators import grids, scans
from sonolume.operators.grids import Even


def linear(image, source, z, x):
    fz, fx = (z - source[0].first) / source[0].step, (x - source[1].first) / source[1].step
    if not (-1e-9 <= fz <= source[0].count - 1 + 1e-9 and -1e-9 <= fx <= source[1].count - 1 + 1e-9):
        return 0.0
    i, j = min(int(fz + 1e-9), source[0].count - 2), min(int(fx + 1e-9), source[1].count - 2)
    u, v = fz - i, fx - j
    return (1 - u) * ((1 - v) * image[i, j] + v * image[i, j + 1]) + u * ((1 - v) * image[i + 1, j] + v * image[i + 1, j + 1])


@pytest.mark.parametrize("source, target", [
    ((Even(0.0, 0.5, 7), Even(-1.0, 0.4, 6)), (Even(-1.0, 0.3, 15), Even(-2.0, 0.25, 20))),  # the target is wider on all sides
    ((Even(-2.0, 1.0, 9), Even(-3.0, 0.5, 15)), (Even(0.1, 0.7, 4), Even(-1.0, 0.3, 8))),  # and inside
    ((Even(0.0, 0.1, 11), Even(0.0, 0.2, 4)), (Even(0.0, 0.1, 11), Even(0.0, 0.2, 4))),  # the same
    ((Even(0.0, 1.0, 5), grids.centred(6, 0.5)), (Even(2.5, 0.5, 9), Even(-0.3, 0.2, 30))),  # overlapping at a corner
])
def test_resampled_and_shared(spark, source, target):
    rng = np.random.default_rng(1)
    image, truth = rng.random((source[0].count, source[1].count)), rng.random((target[0].count, target[1].count))
    frame = lambda m: spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "z long, x long, value double")
    z, x = (t.first + t.step * np.arange(t.count) for t in target)
    want = np.array([[linear(image, source, a, b) for b in x] for a in z])
    got = np.zeros(want.shape)
    for r in grids.resampled(frame(image), source, target).collect():
        got[r.z, r.x] = r.value
    assert np.allclose(got, want)
    inside = [[k for k, p in enumerate(places) if max(s.first, t.first) - 1e-9 <= p <= min(s.last, t.last) + 1e-9] for places, s, t in zip((z, x), source, target)]
    both = {(r.z, r.x): (r.value, r.truth) for r in grids.with_truth(frame(image), frame(truth), source, target).collect()}
    assert both.keys() == {(i, j) for i in range(len(inside[0])) for j in range(len(inside[1]))}
    assert all(np.isclose(both[i, j], (want[a, b], truth[a, b])).all() for i, a in enumerate(inside[0]) for j, b in enumerate(inside[1]))


def test_grids_apart(spark):
    image = spark.createDataFrame([(0, 0, 1.0)], "z long, x long, value double")
    with pytest.raises(ValueError, match="no place in common"):
        grids.with_truth(image, image, (Even(0, 1, 2), Even(0, 1, 2)), (Even(5, 1, 2), Even(0, 1, 2)))


@pytest.mark.parametrize("elements", [6, 48, 192])
def test_list_from_matrix(spark, elements):
    rng = np.random.default_rng(elements)
    m = rng.integers(0, 2, (elements, 5))
    m[:, 3], m[:, 4] = 1, 0
    bits = spark.createDataFrame([(i, n, float(m[i, n])) for i in range(elements) for n in range(5) if m[i, n] or n > 1], "i long, n long, value double").repartition(4)
    angles = spark.createDataFrame([(n, n - 2) for n in range(5)], "n long, angle long")
    got = {r.n: (r.code, r.angle) for r in scans.from_matrix(bits, angles, elements).collect()}
    want = {n: (f"{sum(int(b) << i for i, b in enumerate(m[:, n])):0{-(-elements // 4)}x}", n - 2) for n in range(5)}
    assert got == want
    for bad, more in ((bits.withColumn("i", bits.i + 1), angles), (bits, angles.where("n > 0"))):
        with pytest.raises(Exception, match="no (element|angle)"):
            scans.from_matrix(bad, more, elements).collect()


@pytest.mark.parametrize("pattern, angle", [(True, True), (True, False), (False, True)])
def test_flip_of_an_experiment(spark, pattern, angle):
    listed = spark.createDataFrame([(0, "f0a1", 5, 3), (1, "8001", -7, 4), (2, "ffff", 0, 0)], "n long, code string, angle int, decimation int")
    signals = spark.createDataFrame([(n, t, 10.0 * n + t) for n in range(3) for t in range(4)], "n long, t long, y double")
    fields = spark.createDataFrame([(n, 0, z, x, float(100 * n + 10 * z + x)) for n in range(3) for z in range(2) for x in range(5)], "n long, t long, z long, x long, value double")
    flip = lambda s, y, f: scans.flip_experiment(s.drop("delays"), y, f, 16, 5, 0.3, 1540.0, pattern, angle)
    once = flip(listed, signals, fields)
    mirror = lambda c: f"{int(f'{int(c, 16):016b}'[::-1], 2):04x}" if pattern else c
    got = {r.n: (r.code, r.angle, r.decimation, r.delays) for r in once[0].collect()}
    for n, (c, a, k) in enumerate([("f0a1", 5, 3), ("8001", -7, 4), ("ffff", 0, 0)]):
        a = -a if angle else a
        law = 1000 / 1540.0 * np.sin(np.deg2rad(a)) * np.arange(1, 17) * 0.3
        assert got[n][:3] == (mirror(c), a, k) and np.allclose(got[n][3], law - law.min())
    assert {(r.n, r.t): r.y for r in once[1].collect()} == {((2 - n if pattern else n), t): 10.0 * n + t for n in range(3) for t in range(4)}
    assert {tuple(r)[:4]: r.value for r in once[2].collect()} == {(n, 0, z, 4 - x if pattern else x): float(100 * n + 10 * z + x) for n in range(3) for z in range(2) for x in range(5)}
    twice = flip(*once)
    for a, b in zip((listed, signals, fields), (twice[0].drop("delays"), *twice[1:])):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    with pytest.raises(Exception, match="no scan"):
        flip(listed, signals.withColumn("n", signals.n + 1), None)[1].collect()
    with pytest.raises(ValueError, match="without gaps"):
        flip(listed.where("n <> 1"), signals, None)
