"""Reconstructions that go on after a lost driver, and what they leave behind."""

import math
import os

import numpy as np
import pytest

from sonolume import session
from sonolume.operators import metrics
from sonolume.plans import solvers

Z, X, ROWS = 4, 5, 12
rng = np.random.default_rng(3)
A = rng.random((ROWS, Z * X)) * (rng.random((ROWS, Z * X)) < 0.6)
Y = A @ rng.random(Z * X)


@pytest.fixture(scope="module")
def matrix(spark):
    return spark.createDataFrame([(i, j, float(A[i, j])) for i in range(ROWS) for j in range(Z * X) if A[i, j]], "row_id long, col_id long, v double").coalesce(1)


@pytest.fixture(scope="module")
def signal(spark):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(Y)], "row_id long, y double").coalesce(1)


def vector(image):
    out = np.zeros(Z * X)
    for r in image.collect():
        out[r["col_id"]] = r["value"]
    return out


SETTINGS = {"mlem": {}, "conjugate": {"step_size": 0.01}, "fista": {}, "primal_dual": {"beta": 0.05, "x_size": X, "z_size": Z}, "mapem": {"prior": solvers.Prior(0.01, X)}}


@pytest.mark.parametrize("optimizer", ["conjugate", "fista", "primal_dual"])
def test_resumed_equals_unbroken(spark, matrix, signal, tmp_path, optimizer):
    """Two rounds, then a call for four: the first two are not run again, and all is as in four rounds at once."""
    options = SETTINGS[optimizer]
    folder = str(tmp_path / "journal")
    whole = solvers.reconstruct(matrix, signal, optimizer, 4, costs=True, max_saves=2, **options)
    solvers.reconstruct(matrix, signal, optimizer, 2, costs=True, max_saves=2, journal=folder, **options)
    begun = []
    step = solvers._run

    def watched(state, rounds, *more):
        begun.append(more[3])
        return step(state, rounds, *more)

    solvers._run = watched
    try:
        again = solvers.reconstruct(matrix, signal, optimizer, 4, costs=True, max_saves=2, journal=folder, **options)
    finally:
        solvers._run = step
    assert begun == [2]
    assert np.allclose(vector(again.image), vector(whole.image), rtol=1e-9) and np.allclose(again.costs, whole.costs) and again.rounds == 4
    assert {r.iter for r in again.saved.select("iter").distinct().collect()} == {0, 1, 2, 3}
    with pytest.raises(ValueError, match="other settings"):
        solvers.reconstruct(matrix, signal, "mlem", 7, start=0.7, journal=folder)


def test_a_stopped_run_stays_stopped(spark, matrix, signal, tmp_path):
    folder = str(tmp_path / "journal")
    runs = [solvers.reconstruct(matrix, signal, "mlem", 9, stop=solvers.Stop("relative_change", 10.0, 2), journal=folder) for _ in range(2)]
    assert [r.rounds for r in runs] == [2, 2] and np.array_equal(*(vector(r.image) for r in runs))


def test_a_round_without_its_row_is_run_again(spark, matrix, signal, tmp_path, monkeypatch):
    """The driver is lost after the third round's tables were written, before their row was."""
    folder = str(tmp_path / "journal")
    commit = solvers.Journal.commit

    def lost(self, k, state, scalars):
        if k == 2:
            raise RuntimeError("lost")
        commit(self, k, state, scalars)

    monkeypatch.setattr(solvers.Journal, "commit", lost)
    with pytest.raises(RuntimeError):
        solvers.reconstruct(matrix, signal, "primal_dual", 4, journal=folder, **SETTINGS["primal_dual"])
    monkeypatch.undo()
    got = solvers.reconstruct(matrix, signal, "primal_dual", 4, journal=folder, **SETTINGS["primal_dual"])
    assert np.allclose(vector(got.image), vector(solvers.reconstruct(matrix, signal, "primal_dual", 4, **SETTINGS["primal_dual"]).image))


@pytest.mark.parametrize("optimizer", ["conjugate", "primal_dual", "lbfgs"])
def test_tables_left_do_not_grow_with_rounds(spark, matrix, signal, optimizer):
    folder = session.shared_folder(spark).removeprefix("file://")
    left = []
    for rounds in (2, 4):
        before = set(os.listdir(folder))
        solvers.reconstruct(matrix, signal, optimizer, rounds, **SETTINGS.get(optimizer, {})).image.count()
        left.append(len(set(os.listdir(folder)) - before))
    assert left[1] <= left[0] <= 9


def test_power_iteration_where_the_leading_vector_sums_to_zero(spark):
    b = np.array([[3.0, -3.0, 0.0], [1.0, 1.0, 1.0]])
    df = spark.createDataFrame([(i, j, float(b[i, j])) for i in range(2) for j in range(3) if b[i, j]], "row_id long, col_id long, v double")
    assert math.isclose(solvers.lipschitz(df, 20), 18.0, rel_tol=1e-6)
    tau, sigma, p = solvers.scalar_steps(df, subsets=2)
    assert math.isclose(p, 0.99 / 44**0.5, rel_tol=1e-6) and {round(r.sigma / p, 9) for r in sigma.collect()} == {2.0} and {round(r.tau / p, 9) for r in tau.collect()} == {1.0}
    assert solvers.lipschitz(df.where("v > 100"), 3) == 0.0


def test_stored_history_stops_where_the_run_does(spark):
    values = [3.0, 2.0, 1.5, 1.4, 1.39, 1.385, 1.3849, 1.38489]
    history = spark.createDataFrame([(run, k, v * (1 + run)) for run in range(2) for k, v in enumerate(values)], "run long, iter long, value double")
    for kind, threshold, window in (("relative_change", 1.45, 3), ("gradient_norm", 3.0, 2), ("cost", 0.05, 2), ("squared_error", 0.01, 4), ("cost", 1e-9, 3)):
        want = {}
        for run in range(2):
            rule = solvers.Stop(kind, threshold, window)
            ends = [k for k, v in enumerate(values) if rule.done(v * (1 + run))]
            if ends:
                want[run] = ends[0]
        assert {r.run: r.iter for r in metrics.stopping_rounds(history, kind, threshold, window, ["run"]).collect()} == want
    assert {(r.run, r.iter) for r in metrics.stopping_rounds(history, "max_iterations", 3, 1, ["run"]).collect()} == {(0, 2), (1, 2)}
    with pytest.raises(ValueError):
        metrics.stopping_rounds(history, "other", 1.0, 1, ["run"])
