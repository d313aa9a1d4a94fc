"""Neighbourhoods on the pixel grid: gradients, divergence, priors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offsets(radius: int, shape: str = "cross") -> list[tuple[int, int, float]]:
    """(dz, dx, weight) of all neighbours within the radius; weights fall with distance and add up to 4."""
    near = {"cross": lambda z, x: abs(z) + abs(x) <= radius, "square": lambda z, x: True, "circle": lambda z, x: z * z + x * x <= radius * radius}[shape]
    found = [(z, x, 1 / math.hypot(z, x)) for z in range(-radius, radius + 1) for x in range(-radius, radius + 1) if (z, x) != (0, 0) and near(z, x)]
    total = sum(w for *_, w in found)
    return [(z, x, 4 * w / total) for z, x, w in found]


def gradient(image: DataFrame) -> DataFrame:
    """Forward differences gz, gx; zero in the last row and column."""
    down, right = Window.partitionBy("x").orderBy("z"), Window.partitionBy("z").orderBy("x")
    return image.select("z", "x", F.coalesce(F.lead("value").over(down) - F.col("value"), F.lit(0.0)).alias("gz"), F.coalesce(F.lead("value").over(right) - F.col("value"), F.lit(0.0)).alias("gx"))


def divergence(field: DataFrame) -> DataFrame:
    """Negative adjoint of gradient for a field (z, x, gz, gx): (z, x, value)."""

    def part(c: str, w) -> F.Column:
        before, is_last = F.coalesce(F.lag(c).over(w), F.lit(0.0)), F.lead(F.lit(1)).over(w).isNull()
        return F.when(is_last, -before).otherwise(F.col(c) - before)

    down, right = Window.partitionBy("x").orderBy("z"), Window.partitionBy("z").orderBy("x")
    return field.select("z", "x", (part("gz", down) + part("gx", right)).alias("value"))


def gradient_adjoint(field: DataFrame) -> DataFrame:
    """Adjoint of gradient, minus the divergence: what total variation adds to a primal step."""
    return divergence(field).select("z", "x", (-F.col("value")).alias("value"))


def project_ball(field: DataFrame, radius: float) -> DataFrame:
    """Scale vectors longer than the radius back to it."""
    norm = F.sqrt(F.col("gz") * F.col("gz") + F.col("gx") * F.col("gx") + 1e-12)
    scale = F.when(norm > radius, F.lit(radius) / norm).otherwise(1.0)
    return field.select("z", "x", (F.col("gz") * scale).alias("gz"), (F.col("gx") * scale).alias("gx"))


def pair_energy(kind: str, a, b, w, beta: float, delta: float = 1.0, gamma: float = 0.05, surrogate: bool = False):
    """Gradient, Hessian and energy of one pair (a, b) as columns; with surrogate the Huber Hessian keeps its linear part."""
    d, w = a - b, w * beta
    size = F.abs(d)
    if kind == "quadratic":
        return w * d, w, w * d * d / 2
    if kind == "huber":
        small = size <= delta
        beyond = w / (size + 1e-8) if surrogate else F.lit(0.0)
        return F.when(small, w * d / delta).otherwise(w * F.signum(d)), F.when(small, w / delta).otherwise(beyond), F.when(small, w * d * d / (2 * delta)).otherwise(w * (size - delta / 2))
    if kind == "relative":
        below = a + b + gamma + delta * size
        return w * d * (2 * below - d * (1 + delta * F.signum(d))) / (below * below), 2 * w / below, w * d * d / below
    raise ValueError(f"unknown prior {kind}")


def pairs(image: DataFrame, columns: list[str], radius: int = 1, shape: str = "cross") -> DataFrame:
    """Each pixel with each neighbour on the grid: (z, x, a_<column>.., b_<column>.., w), by an equi-join on (z, x)."""
    spark = image.sparkSession
    steps = F.broadcast(spark.createDataFrame(offsets(radius, shape), "dz int, dx int, _w double"))  # at most (2 radius + 1)^2 rows
    asked = image.crossJoin(steps).select("z", "x", *[F.col(c).alias(f"a_{c}") for c in columns], F.col("_w").alias("w"), (F.col("z") + F.col("dz")).alias("nz"), (F.col("x") + F.col("dx")).alias("nx"))
    other = image.select(F.col("z").alias("nz"), F.col("x").alias("nx"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return asked.join(other, ["nz", "nx"]).drop("nz", "nx")


def prior(image: DataFrame, beta: float, kind: str = "quadratic", delta: float = 1.0, gamma: float = 0.05, radius: int = 1, shape: str = "cross", surrogate: bool = False) -> DataFrame:
    """Gradient, Hessian and energy of a pair prior: (z, x, grad, hess, energy). A pixel without neighbours has no row."""
    grad, hess, energy = pair_energy(kind, F.col("a_value"), F.col("b_value"), F.col("w"), beta, delta, gamma, surrogate)
    return pairs(image, ["value"], radius, shape).groupBy("z", "x").agg(F.sum(grad).alias("grad"), F.sum(hess).alias("hess"), (F.sum(energy) / 2).alias("energy"))


#: Pixels of a line that one group of _smoothed holds, besides those that its Gaussians reach.
BAND = 2048


def _smoothed(image: DataFrame, sigma: Column, along: str, size: int, truncate: float, whole: bool) -> DataFrame:
    """(z, x, value): Gaussian sums along an axis, mirrored at the borders; ``sigma`` is one number a line.

    Lines are cut into bands. A pixel goes to its own band and to those that it is within reach of, as one row each: taps
    are met inside the task. Sums are divided by all weights (whole), else by those of the pixels that the image has.
    """
    line_name = "x" if along == "z" else "z"
    reach = F.greatest(F.floor(F.lit(truncate) * sigma + 0.5), F.lit(0))
    rows = image.select(F.col(line_name).cast("long").alias("line"), F.col(along).cast("long").alias("at"), F.col("value").cast("double").alias("value"), sigma.cast("double").alias("s"), reach.cast("long").alias("r"))
    last = max(0, (size - 1) // BAND)
    band = lambda c: F.greatest(F.lit(0), F.least(F.lit(last), F.floor(c / BAND))).cast("long")
    rows = rows.withColumn("own", band(F.col("at"))).withColumn("band", F.explode(F.sequence(band(F.col("at") - F.col("r")), band(F.col("at") + F.col("r")))))

    def sums(line, band, at, value, null, s, r, own):
        group = np.cumsum((np.diff(line, prepend=line[:1]) != 0) | (np.diff(band, prepend=band[:1]) != 0))
        keys, mine = group * size + at, own == band
        line, at, group, s, r = (c[mine] for c in (line, at, group, s, r))
        total, weights, seen = np.zeros(len(at)), np.zeros(len(at)), np.zeros(len(at), bool)
        for k in range(-int(r.max(initial=0)), int(r.max(initial=0)) + 1):
            m = np.mod(at + k, 2 * size)
            key = group * size + np.where(m < size, m, 2 * size - 1 - m)
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            w = np.exp(-0.5 * (k / s) ** 2) if k else np.ones(len(at))
            asked = r >= abs(k)
            hit = asked & (keys[place] == key)
            known = hit & ~null[place]
            total += np.where(known, w * value[place], 0)
            weights += np.where(asked if whole else hit, w, 0)
            seen |= known
        found = {line_name: pa.array(line), along: pa.array(at), "value": pa.array(total / weights, mask=~seen)}
        return pa.RecordBatch.from_arrays([found["z"], found["x"], found["value"]], ["z", "x", "value"])

    def run(batches):
        waiting: list = []
        for batch in batches:
            value = batch.column("value")
            columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("line", "band", "at")]
            columns += [value.fill_null(0.0).to_numpy(zero_copy_only=False), value.is_null().to_numpy(zero_copy_only=False)]
            columns += [batch.column(n).to_numpy(zero_copy_only=False) for n in ("s", "r", "own")]
            if waiting:
                columns = [np.concatenate(c) for c in zip(waiting, columns)]
            # Rows come sorted; the last group may go on in the next batch.
            starts = np.flatnonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0)) + 1
            if len(starts):
                yield sums(*(c[: starts[-1]] for c in columns))
            waiting = [c[starts[-1] if len(starts) else 0 :] for c in columns]
        if waiting and len(waiting[0]):
            yield sums(*waiting)

    return rows.repartition("line", "band").sortWithinPartitions("line", "band", "at").mapInArrow(run, "z long, x long, value double")


def gaussian(image: DataFrame, sigma: float, along: str, size: int, truncate: float = 4.0) -> DataFrame:
    """Gaussian filter along z or x of a grid whose index runs from 0 to size - 1, mirrored at the borders (edge pixel repeated)."""
    return _smoothed(image, F.lit(float(max(sigma, 0.0))), along, size, truncate, True)


def gaussian_lines(image: DataFrame, sigma: Column, size: int, truncate: float = 4.0) -> DataFrame:
    """Gaussian filter along x with a width of its own in each line; ``sigma`` is an expression of z, borders as in ``gaussian``."""
    return _smoothed(image, sigma, "x", size, truncate, False)


def crop(image: DataFrame, z_range: tuple[int, int], x_range: tuple[int, int], step: int = 1) -> DataFrame:
    """Pixels within [from, to), thinned out by the step and numbered anew."""
    keep = (F.col("z") >= z_range[0]) & (F.col("z") < z_range[1]) & (F.col("x") >= x_range[0]) & (F.col("x") < x_range[1])
    at = lambda c, lo: F.floor((F.col(c) - lo) / step).alias(c)
    return image.where(keep & ((F.col("z") - z_range[0]) % step == 0) & ((F.col("x") - x_range[0]) % step == 0)).select(at("z", z_range[0]), at("x", x_range[0]), "value")


def sample(image: DataFrame, points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Bilinear values at points (keys.., z, x, fz, fx: real coordinates in pixels); corners outside count as zero.

    Each point asks its four corners by an equi-join; the corners' weights are summed after it.
    """
    keys = keys or []
    z0, x0 = F.floor("fz"), F.floor("fx")
    uz, ux = F.col("fz") - z0, F.col("fx") - x0
    corner = lambda dz, dx: F.struct((z0 + dz).alias("cz"), (x0 + dx).alias("cx"), ((uz if dz else 1 - uz) * (ux if dx else 1 - ux)).alias("w"))
    asked = points.select(*keys, "z", "x", F.explode(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)])).alias("c")).select(*keys, "z", "x", "c.cz", "c.cx", "c.w").where("w > 0")
    values = [c for c in image.columns if c not in ("z", "x", *keys)]
    have = image.select(*keys, F.col("z").alias("cz"), F.col("x").alias("cx"), *values)
    joined = asked.join(have, [*keys, "cz", "cx"], "left")
    return joined.groupBy(*keys, "z", "x").agg(*[F.sum(F.coalesce(F.col(c), F.lit(0.0)) * F.col("w")).alias(c) for c in values])


def rotate(image: DataFrame, angle: float, centre_x: float, centre_z: float, x0: float, dx: float, z0: float, dz: float) -> DataFrame:
    """The image turned by the angle about a centre, bilinear, zero outside. Axes start at x0, z0 with steps dx, dz."""
    rx, rz = F.col("x") * dx + x0 - centre_x, F.col("z") * dz + z0 - centre_z
    c, s = math.cos(angle), math.sin(angle)
    points = image.select("z", "x", ((-s * rx + c * rz + centre_z - z0) / dz).alias("fz"), ((c * rx + s * rz + centre_x - x0) / dx).alias("fx"))
    return sample(image, points)


def zoom(image: DataFrame, from_size: tuple[int, int], to_size: tuple[int, int]) -> DataFrame:
    """Linear resize of (z, x, value); first and last pixels map to each other."""
    ratio = [(a - 1) / (b - 1) if b > 1 else 0.0 for a, b in zip(from_size, to_size)]
    spark = image.sparkSession
    grid = spark.range(to_size[0] * to_size[1]).select(F.floor(F.col("id") / to_size[1]).alias("z"), (F.col("id") % to_size[1]).alias("x"))
    return sample(image, grid.withColumn("fz", F.col("z") * ratio[0]).withColumn("fx", F.col("x") * ratio[1]))
