"""Steps whose work once grew faster than their input: array files of scattered values, phantoms of many absorbers."""

import time

import numpy as np
from pyspark.sql import functions as F

from sonolume.operators import generators, smatrix
from sonolume.plans import catalogue
from sonolume.sources import npy


def test_scattered_values_of_a_file_are_written_once_each(spark, tmp_path):
    n = 600000
    cells = spark.range(0, n, 3).select(F.lit(0).alias("z"), F.col("id").alias("x"), (F.col("id") + 1.0).alias("value"))
    path = str(tmp_path / "sparse.npy")
    began = time.time()
    npy.write_npy(cells, path, ["z", "x"], (1, n))
    assert time.time() - began < 40
    want = np.zeros(n)
    want[::3] = np.arange(0, n, 3) + 1
    assert np.array_equal(np.load(path).ravel(), want)


def test_phantom_of_many_absorbers_meets_only_what_they_reach(spark):
    beam = generators.gaussian_beam(generators.grid(spark, 4000, 50), 20.0, 24.5, 2.0)
    i = F.col("id")
    absorbers = spark.range(10000).select((i * 7 % 50).cast("double").alias("cx"), (i % 4).cast("double").alias("cz"), (i % 3 + F.lit(0.5)).alias("radius"), F.lit(1e-5).alias("amplitude"))
    began = time.time()
    found = generators.phantom(beam, absorbers).toPandas().sort_values(["z", "x"])
    assert time.time() - began < 30
    assert len(found) == 4000 * 50
    z, x = found["z"].to_numpy(), found["x"].to_numpy()
    near = z < 120
    k = np.arange(10000)
    kinds, copies = np.unique(np.stack([k * 7 % 50, k % 4, k % 3]), axis=1, return_counts=True)
    z, x = z[near, None], x[near, None]
    taken = (1e-5 * copies * np.exp(-((x - kinds[0]) ** 2 + (z - kinds[1]) ** 2) / (kinds[2] + 0.5) ** 2)).sum(1)
    want = np.maximum(0, np.exp(-2 * ((x - 24.5) ** 2 + (z - 2) ** 2) / 400).ravel() - taken)
    assert np.allclose(found["value"].to_numpy()[near], want, rtol=0, atol=1e-12)
    assert (found["value"].to_numpy()[~near] == np.exp(-2 * ((found["x"] - 24.5) ** 2 + (found["z"] - 2.0) ** 2) / 400).to_numpy()[~near]).mean() > 0.99


def test_products_do_not_merge_cells_first(spark, sf_dir):
    """Repeated cells add up in a product; grouping lines by cell would hold a group for nearly every line."""
    for name in ("forward_projection", "forward_projection_complex", "back_projection", "back_projection_complex"):
        plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        groups = [line for line in plan.splitlines() if "Aggregate [" in line]
        assert groups and not any("l_orderkey" in g.split("]")[0] and "l_partkey" in g.split("]")[0] for g in groups)
    lines = spark.createDataFrame([(0, 1, 2.0, 1.0), (0, 1, 3.0, -4.0), (0, 2, 1.0, 0.5), (5, 1, 7.0, 2.0)], "row_id long, col_id long, vre double, vim double")
    image = spark.createDataFrame([(1, 10.0), (2, 100.0)], "col_id long, value double")
    found = {r.row_id: (r.qre, r.qim) for r in smatrix.forward_complex(lines, image).collect()}
    assert found == {0: (150.0, 20.0), 5: (70.0, 20.0)}
