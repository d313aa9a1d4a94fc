import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolume.functions import fourier
from sonolume.operators import generators, scans
from sonolume.sources import store


def test_pick_is_fixed_by_its_seed(spark):
    lines = spark.range(500).withColumnRenamed("id", "n")
    first = [r.n for r in scans.pick(lines, 40, 3).collect()]
    assert len(set(first)) == 40
    assert sorted(first) == sorted(r.n for r in scans.pick(lines.repartition(7), 40, 3).collect())
    assert set(first) != {r.n for r in scans.pick(lines, 40, 4).collect()}
    assert scans.pick(lines, 600).count() == 500 and scans.pick(lines.limit(0), 5).count() == 0


def test_order_by_stripes(spark):
    rows = [(1, 4, 4, 0, 1), (2, 5, 3, 0, 0), (3, 3, 5, 0, 0), (4, 4, 4, 0, 0), (5, 8, 8, 0, 0), (6, 4, 4, 2, 1)]
    df = spark.createDataFrame(rows, "n int, zeros int, ones int, head int, tail int")
    want = sorted(rows, key=lambda r: (-(r[1] + r[2]), -max(r[1], r[2]), -r[1], -r[3], r[4]))
    assert [r.n for r in scans.order_by_stripes(df).collect()] == [r[0] for r in want]


def test_irregular_patterns_are_sums_of_distinct_cosines(spark):
    got = [r.bits for r in spark.range(20).select(generators.irregular_pattern(F.col("id"), 32, 8, 1).alias("bits")).collect()]
    assert len(set(got)) > 10 and all(len(b) == 32 and set(b) <= {"0", "1"} for b in got)
    assert all(b[0] == "1" for b in got)  # every cosine is 1 at the first element
    assert all(b[i] == b[32 - i] for b in got for i in range(1, 32))


def test_resampled_field_keeps_slow_waves(spark):
    wave = lambda t, z, x, nt, nz, nx: 1 + math.cos(2 * math.pi * t / nt) * math.cos(2 * math.pi * z / nz) + math.sin(2 * math.pi * x / nx)
    rows = [(7, t, z, x, wave(t, z, x, 16, 12, 10)) for t in range(16) for z in range(12) for x in range(10)]
    df = spark.createDataFrame(rows, "n int, t int, z int, x int, value double")
    got = {(r.t, r.z, r.x): r.value for r in fourier.resample_field(df, ["n"], (32, 8, 20)).collect()}
    assert len(got) == 32 * 8 * 20
    assert all(abs(v - wave(*at, 32, 8, 20)) < 1e-9 for at, v in got.items())


def test_stored_medium_names_what_differs(spark, tmp_path):
    pixels = spark.createDataFrame([(0, 0, 1.5), (0, 1, 2.5)], "z int, x int, value double")
    at = str(tmp_path / "medium")
    store.write_medium(pixels, at, {"speed": "1540", "kind": "homogeneous"})
    assert sorted(map(tuple, store.read_medium(spark, at, {"speed": "1540"}).collect())) == [(0, 0, 1.5), (0, 1, 2.5)]
    with pytest.raises(ValueError, match="speed"):
        store.read_medium(spark, at, {"speed": "1500"})


@pytest.mark.parametrize("n", [1, 7, 12, 64, 1 << 12])
@pytest.mark.parametrize("inverse", [False, True])
def test_long_transform(spark, n, inverse):
    rng = np.random.default_rng(n)
    v = rng.normal(size=(2, n)) + 1j * rng.normal(size=(2, n))
    v[1, rng.random(n) < 0.3] = 0
    df = spark.createDataFrame([(k, t, float(v[k, t].real), float(v[k, t].imag)) for k in range(2) for t in range(n) if v[k, t]], "k long, t long, re double, im double")
    f = fourier.long_transform(df, ["k"], "t", n, inverse)
    found = np.zeros((2, n), complex)
    for r in f.collect():
        found[r.k, r.t] = complex(r.re, r.im)
    filled = [k for k in range(2) if v[k].any()]
    assert np.allclose(found[filled], (np.fft.ifft if inverse else np.fft.fft)(v[filled]))
    centred = np.zeros((2, n), complex)
    for r in fourier.centred_transform(df, ["k"], "t", n, 0.5, inverse).collect():
        centred[r.k, r.t] = complex(r.re, r.im)
    want = np.fft.ifftshift(np.fft.ifft(np.fft.fftshift(v, axes=1)), axes=1) * 2 if inverse else np.fft.fftshift(np.fft.fft(np.fft.ifftshift(v, axes=1)), axes=1) * n * 0.5
    assert np.allclose(centred[filled], want[filled])


def test_groups_of_a_long_transform(spark):
    assert fourier._divided(1 << 16) == 1 << 8 and fourier._divided(1000) == 25 and fourier._divided(13) == 1
    with pytest.raises(Exception, match="no point"):
        fourier.long_transform(spark.createDataFrame([(0, 9, 1.0, 0.0)], "k long, t long, re double, im double"), ["k"], "t", 9).collect()


def test_renumber_carries_other_tables(spark):
    listed = spark.range(0, 300, 3).withColumnRenamed("id", "n").repartition(7)
    other = spark.range(0, 400).withColumnRenamed("id", "n").withColumn("was", F.col("n"))
    got, (carried,) = scans.renumber(listed, [other])
    assert sorted(r.n for r in got.collect()) == list(range(100))
    assert sorted((r.n, r.was) for r in carried.collect()) == [(k, 3 * k) for k in range(100)]
