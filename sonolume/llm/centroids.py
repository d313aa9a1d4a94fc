"""Clustering around centroids; the threshold algorithm finds each vector's nearest centroid."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, quoted

#: Cells (vectors x centroids x components) that are worked on at once.
BLOCK_CELLS = 4_000_000
#: Components below this are worked on as 64-bit integers, where no distance overflows; larger ones as Python integers.
SMALL = 1 << 27


class Frontier:
    """Centroids sorted by their value in each dimension, with their numbers."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable")
        self.value = np.take_along_axis(centroids, self.order, axis=0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance, depth of the walk) of every row of x; ties go to the smaller number.

        In every dimension the sorted list is walked outward from the vector's own value, one entry a step, whichever side
        is closer. Each centroid met for the first time gets its exact distance. A centroid not yet met is at least as far
        in every dimension as the frontier there, so the walk ends when the sum of the squared frontier distances strictly
        exceeds the best exact distance (at equality a smaller number could still tie), or when no centroid is left.
        """
        k, d = self.centroids.shape
        whole = x.dtype == np.int64
        far = np.int64(1 << 62) if whole else 1 << 4096
        n = len(x)
        cluster, depth = np.full(n, k), np.zeros(n, np.int64)
        best = np.full(n, np.iinfo(np.int64).max) if whole else np.full(n, far, object)
        seen = np.zeros((n, k), bool)
        dims = np.arange(d)
        up = np.stack([np.searchsorted(self.value[:, j], x[:, j]) for j in dims], axis=1) if n else np.zeros((0, d), int)
        down = up - 1
        at = np.arange(n)
        for step in range(k):
            here, above, below = x[at], up[at], down[at]
            over = np.where(above < k, self.value[np.minimum(above, k - 1), dims] - here, far)
            under = np.where(below >= 0, here - self.value[np.maximum(below, 0), dims], far)
            rises = over <= under
            met = np.where(rises, self.order[np.minimum(above, k - 1), dims], self.order[np.maximum(below, 0), dims])
            up[at], down[at] = above + rises, below - ~rises
            frontier = (np.where(rises, over, under) ** 2).sum(axis=1)
            new = np.zeros((len(at), k), bool)
            new[np.arange(len(at))[:, None], met] = True
            new &= ~seen[at]
            seen[at] |= new
            row, number = np.nonzero(new)
            exact = np.full((len(at), k), np.iinfo(np.int64).max) if whole else np.full((len(at), k), far, object)
            exact[row, number] = ((here[row] - self.centroids[number]) ** 2).sum(axis=1)
            first = exact.argmin(axis=1)
            least = exact[np.arange(len(at)), first]
            better = (least < best[at]) | ((least == best[at]) & (first < cluster[at]))
            best[at], cluster[at] = np.where(better, least, best[at]), np.where(better, first, cluster[at])
            depth[at] = step + 1
            at = at[(frontier <= best[at]) & ~seen[at].all(axis=1)]
            if not len(at):
                break
        return cluster, best, depth


def grid(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, or as Python integers where some are large."""
    found = np.floor(values.astype(np.float64) * scale)
    return found.astype(np.int64) if not found.size or np.abs(found).max() < SMALL else np.array([[int(v) for v in row] for row in found], object)


def _blocks(batch, dim: int, scale: float, frontier: Frontier):
    """(first row, integer vectors, cluster, distance) of each block of an Arrow batch (id, vector)."""
    vectors = grid(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale)
    size = max(1, BLOCK_CELLS // frontier.centroids.size)
    exact = vectors.dtype == object or frontier.centroids.dtype == object
    walk = Frontier(frontier.centroids.astype(object)) if exact else frontier
    for k in range(0, len(vectors), size):
        part = vectors[k : k + size]
        cluster, distance, _ = walk.nearest(part.astype(object) if exact else part)
        yield k, part, cluster, distance


def _partial_sums(dim: int, scale: float, sent):
    """mapInArrow: for each centroid and dimension the sum of a task's vectors, and their number."""

    def run(batches):
        frontier = Frontier(sent.value)
        k = len(sent.value)
        total, count = np.zeros((k, dim), object), np.zeros(k, np.int64)
        for batch in batches:
            for _, part, cluster, _ in _blocks(batch, dim, scale, frontier):
                sums = np.zeros((k, dim), part.dtype)
                np.add.at(sums, cluster, part)
                total += sums
                count += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(count)
        yield pa.record_batch(
            [
                pa.array(np.repeat(some, dim), pa.int32()), pa.array(np.tile(np.arange(dim), len(some)), pa.int32()),
                pa.array([Decimal(int(v)) for v in total[some].ravel()], pa.decimal128(38, 0)), pa.array(np.repeat(count[some], dim), pa.int64()),
            ],
            ["cluster", "dim", "total", "n"],
        )

    return run


def _assignments(dim: int, scale: float, sent):
    def run(batches):
        frontier = Frontier(sent.value)
        for batch in batches:
            for k, part, cluster, distance in _blocks(batch, dim, scale, frontier):
                yield pa.record_batch([batch.column(0).slice(k, len(part)), pa.array(cluster, pa.int32()), pa.array(distance.tolist(), pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def _usable(vector: Column, dim: int) -> Column:
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & (F.size(vector) == dim) & ~F.exists(vector, odd)


def cluster_vectors(vectors: DataFrame, clusters: int = 40, rounds: int = 5, dim: int = 64, scale: float = 256.0, seed: str = "2", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared, of integer vectors), cluster_inertia, inertia and centroid_sha256 for every usable vector.

    Usable: exactly dim components, none null or not finite; they become floor(scale * x). The vectors with the smallest
    SHA-256 of ``seed:id`` are the first centroids; each round moves every centroid that has vectors to floor(sum / count)
    of them, in exact integers. A round is one pass over the vectors: tasks add up their own vectors by centroid, and
    clusters x dim sums (a size set by the parameters alone) are shuffled, finished and collected for the next round.

    Rows that repeat are vectors of their own. A null id is kept, and seeds after all others. Fewer usable vectors than
    clusters: one centroid each. Ids are read as longs; other columns are not read. A squared distance that fits no long
    is an error. None usable or an empty table: no rows.
    """
    spark = vectors.sparkSession
    vector = F.col(quoted(vec_col))
    # Doubles hold every float, so that integers don't depend on the column's type.
    usable = vectors.where(_usable(vector, dim)).select(F.col(quoted(id_col)).cast("long").alias("vec_id"), vector.cast("array<double>").alias("v"))
    seeds = usable.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(clusters).toArrow()
    kinds = "vec_id long, cluster int, distance long"
    if not seeds.num_rows:
        return spark.createDataFrame([], f"{kinds}, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = grid(seeds["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(centroids)
        sums = usable.mapInArrow(_partial_sums(dim, scale, sent), "cluster int, dim int, total decimal(38,0), n long").groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        moved = centroids.astype(object)
        for r in sums.collect():
            moved[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
        centroids = moved.astype(np.int64) if np.abs(moved).max() < SMALL else moved
        sent.unpersist()
    assigned = materialize(usable.mapInArrow(_assignments(dim, scale, spark.sparkContext.broadcast(centroids)), kinds), "assigned")
    inertia = {r["cluster"]: r["distance"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("distance")).collect()}
    facts = [(c, s, sum(inertia.values()), ",".join(map(str, centroids[c]))) for c, s in inertia.items()]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, listed string").withColumn("centroid_sha256", F.sha2("listed", 256)).drop("listed")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
