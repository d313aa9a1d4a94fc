import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolume.functions import fourier
from sonolume.operators import stencil
from sonolume.plans import focused
from sonolume.sources.npy import read_npy


def spline(v, size):
    """Cubic spline through v with flat ends by a dense solve for its coefficients."""
    n = len(v)
    m = np.zeros((n, n))
    for i in range(n):
        m[i, i] += 4
        for j in (i - 1, i + 1):
            m[i, abs(j) if j < n else 2 * (n - 1) - j] += 1
    c = np.linalg.solve(m / 6, v)
    out = []
    for x in np.linspace(0, n - 1, size):
        total = 0.0
        for k in range(int(x) - 2, int(x) + 4):
            d = abs(x - k)
            w = (2 / 3 - d * d + d**3 / 2) if d < 1 else (2 - d) ** 3 / 6 if d < 2 else 0.0
            j = abs(k)
            total += w * c[j if j < n else 2 * (n - 1) - j]
        out.append(total)
    return out


def smooth(v, sigma):
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2) if r else np.ones(1)
    n = len(v)
    at = np.arange(n)[:, None] + np.arange(-r, r + 1)
    at = at % (2 * n)
    return (v[np.where(at < n, at, 2 * n - 1 - at)] * w).sum(axis=1) / w.sum()


def image_rows(spark, a):
    return spark.createDataFrame([(z, x, float(v)) for (z, x), v in np.ndenumerate(a)], "z long, x long, value double")


def as_array(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["z"], r["x"]] = r["value"]
    return out


def test_cubic_zoom(spark):
    rng = np.random.default_rng(0)
    series = [rng.normal(size=n).tolist() for n in (2, 5, 12)]
    df = spark.createDataFrame([(s,) for s in [*series, [3.0], [], None]], "s array<double>")
    for size in (4, 12, 31):
        got = [r.z for r in df.select(fourier.cubic_zoom(F.col("s"), size).alias("z")).collect()]
        for v, z in zip(series, got):
            assert np.allclose(z, spline(v, size), atol=1e-9)
        assert got[3:] == [[3.0] * size, [], None]


def test_uniform_length(spark):
    rows = [(n, t, float(n + t * t)) for n in range(3) for t in range(9)]
    got = fourier.uniform_length(spark.createDataFrame(rows, "n int, t int, y double"), ["n"], 5).collect()
    assert len(got) == 15
    for r in got:
        assert abs(r.y - spline([r.n + t * t for t in range(9)], 5)[r.t]) < 1e-9


def test_gaussian_lines(spark):
    a = np.random.default_rng(1).normal(size=(4, 7))
    got = as_array(stencil.gaussian_lines(image_rows(spark, a), 0.1 + F.col("z") * 1.5, 7), a.shape)
    assert np.allclose(got, [smooth(a[z], 0.1 + 1.5 * z) for z in range(4)])


@pytest.mark.parametrize("band", [3, 2048])
def test_bands_exchange_pixels_not_taps(spark, monkeypatch, band):
    """Lines cut into bands, absent pixels, widths over the line's end: one exchange, no join, and the sums of all taps."""
    monkeypatch.setattr(stencil, "BAND", band)
    a = np.random.default_rng(8).normal(size=(4, 17))
    gone = [(1, 3), (2, 0), (2, 16)]
    df = image_rows(spark, a).where(" and ".join(f"not (z = {z} and x = {x})" for z, x in gone))
    found = stencil.gaussian_lines(df, 0.2 + F.col("z") * 1.5, 17)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    got = {(r["z"], r["x"]): r["value"] for r in found.collect()}
    assert len(got) == a.size - len(gone)
    for (z, x), value in got.items():
        sigma = 0.2 + z * 1.5
        total = weights = 0.0
        for k in range(-int(4 * sigma + 0.5), int(4 * sigma + 0.5) + 1):
            m = (x + k) % 34
            m = m if m < 17 else 33 - m
            if (z, m) not in gone:
                w = np.exp(-0.5 * (k / sigma) ** 2)
                total, weights = total + w * a[z, m], weights + w
        assert np.isclose(value, total / weights)


def test_focused_image(spark):
    t_size, n_size, z_size, x_size = 40, 6, 9, 11
    dx, dz, speed, rate, frequency, cycles, focus, aperture = 1e-3, 1e-3, 1500.0, 5e6, 1e6, 2.0, 4e-3, 3e-3
    y = np.random.default_rng(2).normal(size=(t_size, n_size))
    rows = spark.createDataFrame([(n, t, float(v)) for (t, n), v in np.ndenumerate(y)], "n int, t int, y double")
    got = as_array(focused.focused_image(rows, t_size, n_size, z_size, x_size, dx, dz, speed, rate, frequency, cycles, focus, aperture), (z_size, x_size))
    cut = y[5 : int(np.ceil(z_size * dx / speed * rate))]
    zs, xs = np.linspace(0, len(cut) - 1, z_size), np.linspace(0, n_size - 1, x_size)
    rows_at = np.array([np.interp(zs, range(len(cut)), cut[:, n]) for n in range(n_size)]).T
    want = np.array([np.interp(xs, range(n_size), line) for line in rows_at])
    want = want - want.min(axis=0)
    wave, fwhm = speed / frequency, 2 * np.sqrt(2 * np.log(2))
    want = np.array([smooth(want[:, x], cycles * wave / fwhm / dz) for x in range(x_size)]).T
    waist = 1.028 * wave * focus / aperture / fwhm
    want = np.array([smooth(want[z], waist * np.sqrt(1 + ((z * dz - focus) / (np.pi * waist**2 / wave)) ** 2) / dx) for z in range(z_size)])
    assert np.allclose(got, (want - want.min()) / (want.max() - want.min() + 1e-9))


@pytest.mark.parametrize("kind", ["<f4", ">f8", "<i2", "<c8"])
def test_npy(spark, tmp_path, kind):
    a = (np.random.default_rng(3).normal(size=(3, 4, 5)) * 100).astype(kind)
    np.save(tmp_path / "a.npy", a)
    axes = ["t", "z", "x"]
    got = read_npy(spark, str(tmp_path / "a.npy"), axes, complex_values=kind == "<c8").collect()
    assert len(got) == 60
    for r in got:
        v = a[r.t, r.z, r.x]
        assert (r.re, r.im) == (v.real, v.imag) if kind == "<c8" else r.value == v


def test_npy_ranges_and_refusals(spark, tmp_path):
    np.save(tmp_path / "long.npy", np.arange(1000.0))
    np.save(tmp_path / "none.npy", np.zeros((0, 4)))
    np.save(tmp_path / "turned.npy", np.asfortranarray(np.arange(12.0).reshape(3, 4)))
    np.save(tmp_path / "objects.npy", np.array([1, "a"], object))
    whole = read_npy(spark, str(tmp_path / "long.npy"), ["i"], task=300)
    assert whole.rdd.getNumPartitions() == 4
    assert [(r.i, r.value) for r in sorted(whole.collect())] == [(i, float(i)) for i in range(1000)]
    assert read_npy(spark, str(tmp_path / "none.npy"), ["i", "j"]).count() == 0
    assert all(r.value == 4 * r.i + r.j for r in read_npy(spark, str(tmp_path / "turned.npy"), ["i", "j"]).collect())
    for name, axes in (("objects", ["i"]), ("long", ["i", "j"])):
        with pytest.raises(ValueError):
            read_npy(spark, f"{tmp_path}/{name}.npy", axes)
