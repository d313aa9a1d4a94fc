import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolume.functions import patterns
from sonolume.operators import metrics, scans, smatrix
from sonolume.plans import solvers


def tables(spark, rows=40, cols=30, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.random((rows, cols)) * (rng.random((rows, cols)) < 0.4)
    x = rng.random(cols)
    cells = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))]
    y = [(i, float(v)) for i, v in enumerate(a @ x)]
    return a, x, spark.createDataFrame(cells, "row_id long, col_id long, v double"), spark.createDataFrame(y, "row_id long, y double")


@pytest.mark.parametrize("optimizer", ["gradient", "fista", "conjugate"])
@pytest.mark.parametrize("prior", [None, solvers.Prior(0.05, 6)])
def test_default_steps_do_not_diverge(spark, optimizer, prior):
    if prior and not solvers.OPTIMIZERS[optimizer]:
        return
    a, x, cells, signal = tables(spark)
    found = solvers.reconstruct(cells, signal, optimizer, 12, prior=prior, costs=True, start=0.0)
    assert found.costs[-1] < 0.5 * 0.5 * float(np.sum((a @ x) ** 2)) and found.costs[-1] <= 1.5 * min(found.costs)


def test_complex_steps_against_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.random((20, 8)) + 1j * rng.random((20, 8))
    y = a @ rng.random(8)
    cells = spark.createDataFrame([(i, j, float(a[i, j].real), float(a[i, j].imag)) for i in range(20) for j in range(8)], "row_id long, col_id long, vre double, vim double")
    signal = spark.createDataFrame([(i, float(v.real), float(v.imag)) for i, v in enumerate(y)], "row_id long, yre double, yim double")
    x, g = np.full(8, 0.1), np.zeros(8)
    for _ in range(3):
        x = np.maximum(0, x * (a.conj().T @ (y / (a @ x))).real / np.abs(a.conj().T @ np.ones(20)))
        g = np.maximum(0, g - 0.01 * (a.conj().T @ (a @ g - y)).real)
    value = lambda df: [r.value for r in df.orderBy("col_id").collect()]
    assert np.allclose(value(solvers.mlem_complex(cells, signal, 3)), x)
    assert np.allclose(value(solvers.gradient_complex(cells, signal, 3, 0.01)), g)


def test_view_against_slices(spark):
    t_size, x_size, z_size, n = 9, 5, 4, 3
    dense = np.arange(n * t_size * x_size * z_size, dtype=float).reshape(n * t_size, -1) + 1
    cells = spark.createDataFrame([(i, j, float(dense[i, j])) for i in range(dense.shape[0]) for j in range(dense.shape[1])], "row_id long, col_id long, v double")
    view = smatrix.View(t_size, x_size, t_range=(1, 8), t_step=2, z_range=(1, 3), x_range=(2, 5))
    times = [t for t in range(t_size) if 1 <= t < 8 and t % 2 == 0]
    columns = [z * x_size + x for z in range(1, 3) for x in range(2, 5)]
    small = dense[[k * t_size + t for k in range(n) for t in times]][:, columns]
    assert view.times() == (2, len(times))
    seen = view.of(cells).select(view.effective_row(F.col("row_id")).alias("r"), view.effective_column(F.col("col_id")).alias("c"), "v", "col_id", view.full_column(view.effective_column(F.col("col_id"))).alias("back")).collect()
    got = np.zeros_like(small)
    for r in seen:
        got[r.r, r.c] = r.v
        assert r.back == r.col_id
    assert np.array_equal(got, small) and len(seen) == small.size
    assert view.extent((0.0, 10.0), (0.0, 8.0), z_size) == [4.0, 10.0, 6.0, 2.0]
    assert smatrix.View(t_size, x_size).of(cells).count() == dense.size


def test_names_and_codes(spark):
    rows = [("field_ff0a_112.hdr",), ("a/b_c/field_00_ff_000",), ("field_aa_212",), ("field_aa_1x",), ("noangle",)]
    df = spark.createDataFrame(rows, "name string").select("name", patterns.angle_of(F.col("name")).alias("angle"), patterns.pattern_of(F.col("name")).alias("pattern"))
    assert [(r.angle, r.pattern) for r in df.collect()] == [(None, "ff0a"), (0, "00ff"), (None, "aa"), (None, "aa"), (None, "")]
    codes = spark.createDataFrame([("ff",), ("f0",), ("FF F",), ("zz",), ("",), ("0f0f0f",)], "c string").select(patterns.hex_to_bits(F.col("c"), 12).alias("b"))
    assert [r.b for r in codes.collect()] == ["1" * 12, "11110000" + "0" * 4, "1" * 12, "0" * 12, "0" * 12, "000011110000"]


def test_plane_wave_angle(spark):
    df = spark.createDataFrame([(-20,), (20,)], "a int")
    assert [r.a for r in df.select(patterns.plane_wave_angle(F.col("a")).alias("a")).collect()] == [-20, 20]
    with pytest.raises(Exception, match="between -20 and 20"):
        df.select(patterns.plane_wave_angle(F.col("a") + 1)).collect()


def test_shown_iterations():
    assert metrics.shown_iterations(0, 9) == np.linspace(0, 9, 5, dtype=int).tolist()
    assert metrics.shown_iterations(3, 5) == [3, 4, 5] and metrics.shown_iterations(2, 2) == [2]


def test_serpentine_volume(spark):
    nx, ny, nz = 3, 2, 2
    xy = [(x if y % 2 == 0 else nx - 1 - x, y) for y in range(ny) for x in range(nx)]
    want = [(x, y, z) for z in range(nz) for x, y in (xy if z % 2 == 0 else xy[::-1])]
    x, y, z = scans.serpentine_volume(F.col("id"), nx, ny)
    assert [tuple(r) for r in spark.range(nx * ny * nz).orderBy("id").select(x, y, z).collect()] == want


def test_bucketed_matrix_is_not_exchanged_by_row(spark):
    rng = np.random.default_rng(5)
    cells = [(r, c, float(rng.random())) for r in range(40) for c in range(12) if rng.random() < 0.6]
    a = spark.createDataFrame(cells, "row_id long, col_id long, v double")
    y = a.groupBy("row_id").agg(F.sum("v").alias("y"))
    for optimizer, step in (("mlem", None), ("gradient", 1e-3)):
        plain, bucketed = (
            {r.col_id: r.value for r in solvers.reconstruct(a, y, optimizer, 3, step_size=step, buckets=n).image.collect()} for n in (None, 4)
        )
        assert plain.keys() == bucketed.keys() and np.allclose([plain[c] for c in sorted(plain)], [bucketed[c] for c in sorted(plain)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big, signal = solvers.stored(a, y, 4)
        plan = smatrix.backward(big, signal)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange hashpartitioning(col_id" in plan and "Exchange hashpartitioning(row_id" not in plan
