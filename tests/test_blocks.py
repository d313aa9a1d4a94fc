"""Records of rows against NumPy and against joins; optimizers of complex matrices."""

import numpy as np
import pytest

from sonolume.operators import blocks, metrics
from sonolume.plans import solvers

ROWS, COLS = 60, 20
rng = np.random.default_rng(17)
MASK = rng.random((ROWS, COLS)) < 0.4
MASK[:, 0] = MASK[3] = True  # a full row; every row has a cell
REAL = rng.random((ROWS, COLS)) * MASK
WAVE = (rng.normal(size=(ROWS, COLS)) + 1j * rng.normal(size=(ROWS, COLS))) * MASK


def tables(spark, m, y, lacks=()):
    wave = np.iscomplexobj(m)
    cells = [(i, 7 * j + 3, *((float(m[i, j].real), float(m[i, j].imag)) if wave else (float(m[i, j]),))) for i in range(ROWS) for j in range(COLS) if MASK[i, j]]
    signal = [(i, *((float(v.real), float(v.imag)) if wave else (float(v),))) for i, v in enumerate(y) if i not in lacks] + [(10**6, *((1.0, 1.0) if wave else (1.0,)))]
    names = ("vre double, vim double", "yre double, yim double") if wave else ("v double", "y double")
    return spark.createDataFrame(cells, f"row_id long, col_id long, {names[0]}").repartition(5), spark.createDataFrame(signal, f"row_id long, {names[1]}")


def found(df):
    out = np.zeros(COLS)
    for r in df.collect():
        out[(r["col_id"] - 3) // 7] = r[1]
    return out


@pytest.mark.parametrize("wave", [False, True])
@pytest.mark.parametrize("longest, block", [(blocks.LONGEST, blocks.BLOCK), (12, 1)])
def test_pulled_equals_numpy(spark, wave, longest, block, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", block)
    m = WAVE if wave else REAL
    x = rng.random(COLS)
    y, lacks = m @ rng.random(COLS), (5, 11)
    a, signal = tables(spark, m, y, lacks)
    image = spark.createDataFrame([(7 * j + 3, float(v)) for j, v in enumerate(x)] + [(4, 9.0)], "col_id long, value double")
    made = blocks.RowBlocks(a, signal, longest=longest)
    assert (made.long is not None) == (longest == 12)
    there = np.array([i not in lacks for i in range(ROWS)])
    q = m @ x
    for f, r in ((blocks.ratio, np.where(there, y / q, 0)), (blocks.residual, q - np.where(there, y, 0)), (blocks.itself, q), (blocks.ones, np.ones(ROWS))):
        want = (m.conj().T @ r).real
        assert np.allclose(found(made.pulled(image, f, 1e-10)), want)
        assert np.allclose(found(blocks.joined(a, signal, image, f, 1e-10)), want)
    assert np.allclose(found(made.pulled(None, blocks.residual)), -(m.conj().T @ np.where(there, y, 0)).real)


def test_no_cell_is_exchanged_in_a_round(spark):
    a, signal = tables(spark, REAL, REAL @ rng.random(COLS))
    made = blocks.RowBlocks(a, signal)
    image = spark.createDataFrame([(3, 1.0)], "col_id long, value double")
    plan = made.pulled(image, blocks.residual)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_optimizers_of_complex_matrices(spark):
    y = WAVE @ rng.random(COLS)
    a, signal = tables(spark, WAVE, y)
    step, x, d, last = 0.005, np.full(COLS, 0.1), np.zeros(COLS), 0.0
    for k in range(3):
        r = -(WAVE.conj().T @ (WAVE @ x - y)).real
        d = r + ((r @ r) / (last + 1e-10) if k else 0.0) * d
        last, x = r @ r, np.maximum(0, x + step * d)
    result = solvers.reconstruct(a, signal, "conjugate", 3, step_size=step, costs=True)
    assert np.allclose(found(result.image), x) and np.isclose(result.costs[-1], 0.5 * np.sum(np.abs(WAVE @ x - y) ** 2) + 1.0)  # the signal has a row beyond the matrix
    assert np.isclose(solvers.lipschitz(a, 60), np.linalg.eigvalsh((WAVE.conj().T @ WAVE).real).max(), rtol=1e-3)
    with pytest.raises(ValueError, match="complex"):
        solvers.reconstruct(a, signal, "lbfgs", 1)
    with pytest.raises(ValueError, match="complex"):
        solvers.reconstruct(a, signal, "mlem", 1, costs=True)


@pytest.mark.parametrize("step", [1, 7])
def test_power_iteration_collects_no_vector(spark, monkeypatch, step):
    """Columns with and without gaps between them; vectors stay in files."""
    rng = np.random.default_rng(4)
    m = rng.random((12, 9))
    cells = spark.createDataFrame([(i, 5 + step * j, float(m[i, j])) for i in range(12) for j in range(9)], "row_id long, col_id long, v double")

    def refused(*_):
        raise AssertionError("a table was collected")

    for name in ("toArrow", "collect", "toPandas"):
        monkeypatch.setattr(type(cells), name, refused)
    monkeypatch.setattr(type(cells), "first", lambda df: df.tail(1)[0])  # single rows of scalars
    assert np.isclose(solvers.lipschitz(cells, 10), np.linalg.norm(m, 2) ** 2)


@pytest.mark.parametrize("wave", [False, True])
@pytest.mark.parametrize("longest", [blocks.LONGEST, 12])
def test_duals_of_rows_equal_numpy(spark, wave, longest):
    """Two rounds, the second from dealt duals; rows that are kept as cells too."""
    m, step = WAVE if wave else REAL, 0.3
    y = m @ rng.random(COLS)
    a, signal = tables(spark, m, y, (5,))
    made, dual, before = blocks.RowBlocks(a, signal, longest=longest), np.zeros(ROWS), None
    for _ in range(2):
        x = rng.random(COLS)
        image = spark.createDataFrame([(7 * j + 3, float(v)) for j, v in enumerate(x)], "col_id long, ahead double")
        dual = dual + step * (m @ x - 2 * np.where(np.arange(ROWS) == 5, 0, y))
        before, back = made.advanced(image, "ahead", before and made.dealt(before), lambda d, q, y, s: d + s * (q - 2 * y), step)
        assert np.allclose(found(back), (m.conj().T @ dual).real)
    got = {r.row_id: complex(r[1], r[2]) if wave else r[1] for r in blocks.only_duals(before, wave).collect()}
    assert len(got) == ROWS and np.allclose([got[i] for i in range(ROWS)], dual)


def test_primal_dual_and_lbfgs_join_no_cells(spark, monkeypatch):
    a, signal = tables(spark, REAL, REAL @ rng.random(COLS))

    def refused(*_):
        raise AssertionError("cells were joined")

    for name in ("forward", "backward"):
        monkeypatch.setattr(blocks.smatrix, name, refused)
    for steps in ("diagonal", "scalar"):
        solvers.reconstruct(a, signal, "primal_dual", 1, beta=0.1, x_size=10, z_size=20, steps=steps)
    solvers.reconstruct(a, signal, "lbfgs", 1)


def test_median_sorts_few_values_at_once(spark, monkeypatch):
    monkeypatch.setattr(metrics, "NEAR", 20)
    for values in (rng.random(3001), rng.random(3000), np.repeat([1.0, 2.0], 1500), np.floor(8 * rng.random(2000)), [4.0]):
        table = spark.createDataFrame([(float(v),) for v in values], "total double")
        assert np.isclose(metrics.median(table, "total"), np.median(values), rtol=1e-15)
    assert metrics.median(table.where("total > 9"), "total") is None
