"""Operators without SQL against plain NumPy on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolume.functions import fourier, patterns
from sonolume.operators import generators, metrics, scans, stencil
from sonolume.plans import analytic, solvers
from sonolume.sources import active_list, binary, store

Z, X, ROWS = 4, 5, 12
rng = np.random.default_rng(3)
A = rng.random((ROWS, Z * X)) * (rng.random((ROWS, Z * X)) < 0.6)
TRUE = rng.random(Z * X)
Y = A @ TRUE
assert (A.sum(0) > 0).all() and (A.sum(1) > 0).all()


@pytest.fixture(scope="module")
def matrix(spark):
    return spark.createDataFrame([(i, j, float(A[i, j])) for i in range(ROWS) for j in range(Z * X) if A[i, j]], "row_id long, col_id long, v double")


@pytest.fixture(scope="module")
def signal(spark):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(Y)], "row_id long, y double")


def vector(image, size=Z * X):
    out = np.zeros(size)
    for r in image.collect():
        out[r["col_id"]] = r["value"]
    return out


def grid_of(df, z, x):
    out = np.zeros((z, x))
    for r in df.collect():
        out[r["z"], r["x"]] = r["value"]
    return out


def quadratic(x, beta):
    g = np.zeros((Z, X))
    e, u = 0.0, x.reshape(Z, X)
    for dz, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
        for z in range(Z):
            for c in range(X):
                if 0 <= z + dz < Z and 0 <= c + dx < X:
                    d = u[z, c] - u[z + dz, c + dx]
                    g[z, c] += beta * d
                    e += beta * d * d / 2
    return g.ravel(), e / 2


def test_primal_dual(matrix, signal):
    beta, rho = 0.05, 0.99
    grad = lambda u: (np.diff(u, axis=0, append=u[-1:]), np.diff(u, axis=1, append=u[:, -1:]))
    near = np.array([[4 - (z in (0,)) - (z == Z - 1) - (x == 0) - (x == X - 1) for x in range(X)] for z in range(Z)]).ravel()
    tau, sigma = rho / (A.sum(0) + near), rho / A.sum(1)
    lam, bar, q, pz, px = np.zeros(Z * X), np.zeros(Z * X), np.zeros(ROWS), np.zeros((Z, X)), np.zeros((Z, X))
    for _ in range(3):
        q = (q + sigma * (A @ bar - Y)) / (1 + sigma)
        gz, gx = grad(bar.reshape(Z, X))
        pz, px = pz + rho / 2 * gz, px + rho / 2 * gx
        size = np.sqrt(pz**2 + px**2 + 1e-12)
        pz, px = np.where(size > beta, pz * beta / size, pz), np.where(size > beta, px * beta / size, px)
        adj = np.zeros((Z, X))
        adj[:-1] -= pz[:-1]
        adj[1:] += pz[:-1]
        adj[:, :-1] -= px[:, :-1]
        adj[:, 1:] += px[:, :-1]
        new = np.maximum(0, lam - tau * (A.T @ q + adj.ravel()))
        lam, bar = new, new + (new - lam)
    got = vector(solvers.reconstruct(matrix, signal, "primal_dual", 3, beta=beta, x_size=X, z_size=Z).image)
    assert np.allclose(got, lam, atol=1e-9)


def test_lbfgs(matrix, signal):
    """A plain two-loop recursion on arrays gives the same images."""
    beta, w = 0.01, np.full(Z * X, 0.1**0.5)
    cost = lambda w: 0.5 * ((A @ w**2 - Y) ** 2).sum() + quadratic(w**2, beta)[1]
    slope = lambda w: (A.T @ (A @ w**2 - Y) + quadratic(w**2, beta)[0]) * 2 * w
    g, kept, start = slope(w), [], cost(w)
    for _ in range(4):
        q, al = g.copy(), []
        for s, u in reversed(kept):
            al.append(s @ q / (s @ u))
            q -= al[-1] * u
        q *= kept[-1][0] @ kept[-1][1] / (kept[-1][1] @ kept[-1][1] + 1e-10) if kept else 1 / (np.linalg.norm(q) + 1e-5)
        for (s, u), a in zip(kept, reversed(al)):
            q += s * (a - u @ q / (s @ u))
        t = 1.0
        while cost(w - t * q) > cost(w) - 1e-4 * t * (g @ q):
            t /= 2
        new = w - t * q
        h = slope(new)
        kept.append((new - w, h - g))
        w, g = new, h
    assert cost(w) < start / 2
    got = vector(solvers.lbfgs(matrix, signal, 4, solvers.Prior(beta, X)))
    assert np.allclose(got, w**2, atol=1e-7)


def test_stop_costs_saves(matrix, signal):
    result = solvers.reconstruct(matrix, signal, "mlem", 8, costs=True, max_saves=4, stop=solvers.Stop("relative_change", 10.0, 2))
    assert result.rounds == 2 and len(result.costs) == 2 and result.costs[1] <= result.costs[0]
    assert {r.iter for r in result.saved.select("iter").distinct().collect()} == {0}
    mass = vector(solvers.mlem(matrix, signal, 1))
    assert math.isclose((A @ mass).sum(), (A * mass).sum()) and math.isclose((A.sum(0) * mass).sum(), Y.sum())
    with pytest.raises(ValueError):
        solvers.reconstruct(matrix, signal, "mlem", 1, prior=solvers.Prior(1.0, X))
    assert solvers.saved_rounds(10, 5000) == list(range(10))


def test_lipschitz(matrix):
    assert math.isclose(solvers.lipschitz(matrix, 30), np.linalg.eigvalsh(A.T @ A).max(), rel_tol=1e-4)


def test_gaussian_and_zoom(spark):
    u = rng.random((6, 7))
    df = spark.createDataFrame([(z, x, float(u[z, x])) for z in range(6) for x in range(7)], "z long, x long, value double")
    r = 4
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / 1.0) ** 2)
    want = np.apply_along_axis(lambda v: np.convolve(np.pad(v, r, mode="symmetric"), w / w.sum(), "valid"), 1, u)
    assert np.allclose(grid_of(stencil.gaussian(df, 1.0, "x", 7), 6, 7), want)
    big = grid_of(stencil.zoom(df, (6, 7), (11, 13)), 11, 13)
    assert np.allclose(big[::2, ::2], u) and np.allclose(big[1::2, ::2], (u[:-1] + u[1:]) / 2)


def _traces(spark):
    values = {(d, a): rng.normal(size=8) + 1j * (rng.normal(size=8) if d else 0) for d in (0, 1, 2) for a in (0.0, 10.0)}
    rows = [(d, a, z, float(v[z].real), float(v[z].imag)) for (d, a), v in values.items() for z in range(8)]
    return values, spark.createDataFrame(rows, "decimation int, angle double, z long, re double, im double")


def test_inverse_fourier(spark):
    values, df = _traces(spark)
    nx, dx, total = 6, 0.5, np.zeros((8, 6))
    for a in (0.0, 10.0):
        f = np.zeros((8, nx), dtype=complex)
        for d in (0, 1, 2):
            f[:, nx // 2 + d] = values[d, a]
            if d:
                f[1:, nx // 2 - d] = values[d, a].conj()[:-1]
        f[:, nx // 2] *= 0.5
        image = np.fft.ifftshift(np.fft.ifft(np.fft.fftshift(f, axes=1), axis=1), axes=1).real / dx * nx
        t = -math.radians(a)
        for z in range(8):
            for x in range(nx):
                fx, fz = (math.cos(t) * x * dx + math.sin(t) * z * 0.25) / dx, (-math.sin(t) * x * dx + math.cos(t) * z * 0.25) / 0.25
                for i in (0, 1):
                    for j in (0, 1):
                        cz, cx = math.floor(fz) + i, math.floor(fx) + j
                        if 0 <= cz < 8 and 0 <= cx < nx:
                            total[z, x] += image[cz, cx] * abs(1 - i - (fz - math.floor(fz))) * abs(1 - j - (fx - math.floor(fx)))
    got = grid_of(analytic.inverse_fourier(df, nx, dx, dz=0.25), 8, nx)
    assert np.allclose(got, total * dx / (6 * 0.75 * 4))


def test_inverse_fourier_whole_and_by_rows(spark, monkeypatch):
    """Images turned as a whole exchange no pixel of an angle, and equal those by joins: absent depths, repeated traces, centres."""
    _, df = _traces(spark)
    more = df.where("not (z = 3 or (z = 5 and angle = 10))").unionByName(df.where("decimation = 1 and z = 2"))
    centres = spark.createDataFrame([(10.0, 1.25)], "angle double, centre_x double")
    whole = analytic.inverse_fourier(more, 6, 0.5, z0=0.5, dz=0.25, x0=-1.0, centres=centres)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "cx#" not in plan and "cz#" not in plan
    got = {(r["z"], r["x"]): r["value"] for r in whole.collect()}
    monkeypatch.setattr(analytic, "WHOLE_PIXELS", 0)
    want = {(r["z"], r["x"]): r["value"] for r in analytic.inverse_fourier(more, 6, 0.5, z0=0.5, dz=0.25, x0=-1.0, centres=centres).collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in got)


def test_back_projection(spark):
    values, df = _traces(spark)
    nz, nx, dz, dx, f0, cut = 8, 6, 0.25, 0.5, 0.3, 1.5
    freq = (np.arange(nz) - nz // 2) / (nz * dz)
    weight = np.where(np.abs(freq) > cut, 0, np.abs(freq)) * np.exp(-2 * np.abs(freq / cut) ** 10)
    back = lambda b: np.fft.ifftshift(np.fft.ifft(np.fft.fftshift(b))) / dz
    total = np.zeros((nz, nx))
    for (d, a), v in values.items():
        bins = np.fft.fftshift(np.fft.fft(np.fft.ifftshift(v))) * nz * dz * weight
        sup, low, t = back(bins * (freq >= 0)), back(bins * (np.abs(freq) < d * f0) * (d == 0)), math.radians(a)
        for z in range(nz):
            for x in range(nx):
                place = (x * dx * math.sin(t) + z * dz * math.cos(t)) / dz
                s = (x * dx - (nx - 1) / 2 * dx) * math.cos(t) - z * dz * math.sin(t)
                i0, i1 = (min(max(math.floor(place) + k, 0), nz - 1) for k in (0, 1))
                w = place - i0
                total[z, x] += (2 * np.exp(2j * math.pi * d * f0 * s) * ((1 - w) * sup[i0] + w * sup[i1]) + (1 - w) * low[i0] + w * low[i1]).real
    filtered = analytic.filtered_traces(df, nz, dz, cut, f0)
    got = grid_of(analytic.back_project(filtered, generators.grid(spark, nz, nx), nz, nx, dx, dz, f0), nz, nx)
    assert np.allclose(got, total * dz / (6 * 0.75 * 4))


def test_ray_field(spark):
    bits, nt, nz, nx, dt, dx, c, burst, k = "1011", 6, 5, 5, 1e-7, 2e-4, 1540.0, 3, 4
    want = np.zeros((2, nt, nz, nx))
    shape = np.sin(np.linspace(0, np.pi, burst)) ** 2
    for n, angle in enumerate((10, -10)):
        a, fine = math.radians(angle), dx / k
        for i, b in enumerate(bits):
            at, pivot = i * 2, 0 if angle >= 0 else 8
            for t in range(nt):
                eff = t * dt - abs(at - pivot) * fine * math.sin(abs(a)) / c
                if b == "0" or eff <= 0 or eff >= (nt - 1) * dt:
                    continue
                z, x0 = int(eff * c * math.cos(a) / fine), int((at * fine + eff * c * math.sin(a)) / fine)
                for s in range(burst):
                    for o in (0, 1):
                        if t + s < nt and z < nz * k and 0 <= x0 + o < nx * k:
                            want[n, t + s, z // k, (x0 + o) // k] += shape[s] / k**2
    df = generators.ray_field(spark.createDataFrame([(0, bits, 10), (1, bits, -10)], "n long, bits string, angle int"), 4, 2, nt, nz, nx, dt, dx, c, burst, k)
    got = np.zeros_like(want)
    for r in df.collect():
        got[r["n"], r["t"], r["z"], r["x"]] = r["value"]
    assert want.any() and np.allclose(got, want)


def test_resample_and_field(spark):
    v = np.cos(2 * np.pi * 2 * np.arange(32) / 32)
    df = spark.createDataFrame([(v.tolist(),), (None,), ([],)], "s array<double>")
    got = df.select(fourier.resample(F.col("s"), 16).alias("r"), fourier.envelope(F.col("s")).alias("e")).collect()
    assert np.allclose(got[0]["r"], v[::2], atol=1e-9)
    assert np.allclose(got[0]["e"], 1) and got[1]["r"] is None


def test_patterns(spark):
    made = generators.random_patterns(spark.range(40), 48)
    assert made.count() > 10 and generators.check_patterns(made, 48).where("not valid").count() == 0
    bad = spark.createDataFrame([("f0f0f0f0f0f1", 0), ("00ff00ff00ff", 0), ("00ff00ff00ff", 0), ("0f", 1)], "code string, angle int")
    rows = {r["code"]: r for r in generators.check_patterns(bad, 48).collect()}
    assert not rows["f0f0f0f0f0f1"].regular and rows["00ff00ff00ff"].regular and rows["00ff00ff00ff"].copies == 2 and not rows["0f"].right_length
    flip = scans.flipped(spark.createDataFrame([(0, "8", 5), (1, "1", -5), (2, "c", 5)], "n long, code string, angle int"), 4)
    assert {(r.n, r.source, r.found) for r in flip.collect()} == {(0, 1, True), (1, 0, True), (2, 2, False)}
    assert spark.range(1).select(patterns.bits_to_hex_reversed(F.lit("10000000"))).first()[0] == "01"


def test_active_list(spark):
    lines = spark.createDataFrame([("ff00_110",), ("((2, 2, 1, 0), [-10, 5])",), ("zz_000",), ("",), (" ",), ("((0, 0, 0, 0), [1])",)], "line string")
    got = [(r.code, r.angle, r.malformed) for r in active_list.parse(lines, 8).collect()]
    assert sorted(got, key=repr) == sorted([("ff00", -10, False), ("66", -10, False), ("66", 5, False), (None, None, True), (None, None, True)], key=repr)


def test_stores(spark, tmp_path, matrix):
    store.write_matrix(matrix, f"{tmp_path}/m", "csr", 0.1)
    assert store.read_matrix(spark, f"{tmp_path}/m", "real").count() == matrix.count()
    with pytest.raises(ValueError):
        store.read_matrix(spark, f"{tmp_path}/m", "complex")
    image = matrix.select("col_id").distinct().select(F.lit(0).alias("iter"), "col_id", F.lit(1.0).alias("value"))
    store.write_reconstruction(image, f"{tmp_path}/r", "mlem", True)
    store.write_reconstruction(image.limit(1), f"{tmp_path}/r", "mlem", True)
    assert store.read_reconstruction(spark, f"{tmp_path}/r", "mlem", True).count() == image.count()
    (tmp_path / "p.json").write_text('{"Parameters": {"general": {"Xrange": [-0.02, 0.02], "Zrange": [0, 0.037], "dx": 0.0002, "dz": 0.0002}}}')
    row = store.read_parameters(spark, f"{tmp_path}/p.json").first()
    assert (row.Nx, row.Nz) == (200, 185)


def test_noise_and_similarity(spark):
    y = spark.range(4000).select((F.col("id") % 4).alias("n"), F.col("id").alias("t"), F.lit(10.0).alias("y"))
    sd = generators.gaussian_noise(y, 20.0).agg(F.stddev("y")).first()[0]
    assert abs(sd - 1.0) < 0.05
    mean, var = y.select(generators.poisson(F.col("y"), 5, F.col("t")).alias("p")).agg(F.avg("p"), F.variance("p")).first()
    assert abs(mean - 10) < 0.2 and abs(var - 10) < 1
    image = generators.grid(spark, 9, 9).withColumn("value", F.col("x") * F.col("z") + 0.0)
    assert math.isclose(metrics.structural_similarity(image, image).first()[0], 1.0)


def test_damaged_image_fails(spark, tmp_path):
    (tmp_path / "data").write_bytes(b"\0" * 18)
    (tmp_path / "header").write_text("!matrix size [1] := 2\n!matrix size [2] := 2\n!number format := short float\n")
    with pytest.raises(Exception):
        binary.read_image(spark, f"{tmp_path}/data", f"{tmp_path}/header").collect()


def test_pair_mean_of_a_hot_key(spark):
    draw = np.random.default_rng(12)
    rows = [(None if i % 11 == 0 else 1 if i % 3 else i % 7, int(n), float(draw.normal())) for i, n in enumerate(draw.permutation(5000))]
    rows += [(50, 1, 2.0), (51, 1, None), (51, 2, 3.0), (52, 1, math.inf), (53, 1, 1e300), *[(k, n, 0.0) for k in (52, 53) for n in range(2, 2 + 3000 if k == 52 else 2 + 1080)]]
    df = spark.createDataFrame(rows, "k long, n long, y double").repartition(9)
    found = scans.running_pair_mean(df, ["k"])
    assert "collect_list" not in found._jdf.queryExecution().toString()
    want = {}
    for k, _, y in sorted(rows, key=lambda r: r[1]):
        want[k] = y if k not in want else None if y is None or want[k] is None else (want[k] + y) / 2
    got = {r.k: r.y for r in found.collect()}
    assert set(got) == set(want) and got[51] is None
    assert all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want if k != 51)
