"""Direct reconstructions from spatial-frequency traces: inverse Fourier and filtered back-projection."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.fourier import ramp_filter
from ..operators import stencil

#: Pixels of one angle's image up to which one task transforms and turns it as a whole.
WHOLE_PIXELS = 1 << 20
#: Up to so many pixels (16 bytes each) are sent to the tasks that hold the traces.
SENT_PIXELS = 1_000_000
_COMPLEX = "struct<re:array<double>,im:array<double>>"


def _line_inverse(size: int, dx: float) -> Column:
    """One line of pixels from its frequencies (k, re, im); the opposite frequencies come as (k, re, im) of their own."""

    @pandas_udf(_COMPLEX)
    def run(cells: pd.Series) -> pd.DataFrame:
        out = []
        for row in cells:
            line = np.zeros(size, dtype=complex)
            for c in row:
                at = size // 2 + int(c["k"])
                if 0 <= at < size:
                    line[at] += complex(c["re"], c["im"])
            v = np.fft.ifftshift(np.fft.ifft(np.fft.fftshift(line))) / dx * size
            out.append((v.real, v.imag))
        return pd.DataFrame(out, columns=["re", "im"])

    return run


def _turned_whole(traces: DataFrame, depth: int, z_size: int, x_size: int, dx: float, z0: float, dz: float, x0: float) -> DataFrame:
    """(z, x, value): the images of all angles turned and added. traces: (angle, centre_x, k, z, re, im), k >= 0; depth: the last z of all.

    The traces of an angle meet in one task, in batches with those of others; a task adds up its images before they are
    exchanged. Depths without a sample have no pixels, in the image and in the result.
    """

    def run(batches):
        total, seen = np.zeros((z_size, x_size)), np.zeros((z_size, x_size), bool)
        angle = centre = None
        lines, there = np.zeros((z_size, x_size), complex), np.zeros(z_size, bool)

        def add(k, z, values):
            half = np.where(k == 0, 0.5, 1.0) * values
            opposite = (k != 0) & (z < depth)
            for at, depths, v in ((k, z, half), (-k[opposite], z[opposite] + 1, np.conj(values[opposite]))):
                there[depths] = True
                column = x_size // 2 + at
                inside = (column >= 0) & (column < x_size)
                np.add.at(lines, (depths[inside], column[inside]), v[inside])

        def turn():
            used = np.flatnonzero(there)
            image = np.zeros((z_size, x_size))
            image[used] = (np.fft.ifftshift(np.fft.ifft(np.fft.fftshift(lines[used], axes=1), axis=1), axes=1) / dx * x_size).real
            rz, rx = (used * dz + z0)[:, None], (np.arange(x_size) * dx + x0 - centre)[None, :]
            a = -np.radians(angle)
            fz, fx = (-np.sin(a) * rx + np.cos(a) * rz - z0) / dz, (np.cos(a) * rx + np.sin(a) * rz + centre - x0) / dx
            cz, cx = np.floor(fz), np.floor(fx)
            for i in (0, 1):
                for j in (0, 1):
                    w = (fz - cz if i else 1 - (fz - cz)) * (fx - cx if j else 1 - (fx - cx))
                    inside = (cz + i >= 0) & (cz + i < z_size) & (cx + j >= 0) & (cx + j < x_size)
                    at_z, at_x = (np.where(inside, c, 0).astype(int) for c in (cz + i, cx + j))
                    total[used] += np.where(inside, w * image[at_z, at_x], 0)
            seen[used], lines[:], there[:] = True, 0, False

        # Rows come sorted by angle, which may go on in the next batch.
        for batch in batches:
            rows = [batch.column(n).to_numpy(zero_copy_only=False) for n in range(6)]
            starts = [0, *(np.flatnonzero(np.diff(rows[0]) != 0) + 1), len(rows[0])]
            for s, e in zip(starts, starts[1:]):
                if s < e and rows[0][s] != angle:
                    if angle is not None:
                        turn()
                    angle, centre = rows[0][s], rows[1][s]
                add(rows[2][s:e], rows[3][s:e], rows[4][s:e] + 1j * rows[5][s:e])
        if angle is not None:
            turn()
        z, x = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(z), pa.array(x), pa.array(total[z, x])], ["z", "x", "value"])

    # One image a core is exchanged.
    spread = traces.repartition(traces.sparkSession.sparkContext.defaultParallelism, "angle").sortWithinPartitions("angle")
    return spread.mapInArrow(run, "z long, x long, value double").groupBy("z", "x").agg(F.sum("value").alias("value"))


def _turned_rows(traces: DataFrame, x_size: int, dx: float, z0: float, dz: float, x0: float, centres: DataFrame | None) -> DataFrame:
    """As _turned_whole, pixel by pixel with joins, for images of any size; angle and frequency may be null or below zero."""
    own = traces.select("angle", "z", F.col("decimation").cast("int").alias("k"), *[(F.col(c) * F.when(F.col("decimation") == 0, 0.5).otherwise(1.0)).alias(c) for c in ("re", "im")])
    depth = traces.agg(F.max("z").alias("_last"))
    mirrored = own.where("k <> 0").crossJoin(F.broadcast(depth)).where("z < _last").select("angle", (F.col("z") + 1).alias("z"), (-F.col("k")).alias("k"), "re", (-F.col("im")).alias("im"))
    lines = own.unionByName(mirrored).groupBy("angle", "z").agg(F.collect_list(F.struct("k", "re", "im")).alias("cells"))
    flat = lines.select("angle", "z", _line_inverse(x_size, dx)("cells").alias("v")).select("angle", "z", F.posexplode("v.re").alias("x", "value")).withColumn("x", F.col("x").cast("long"))
    points = flat.join(centres, "angle", "left") if centres is not None else flat.withColumn("centre_x", F.lit(0.0))
    centre = F.coalesce("centre_x", F.lit(0.0))
    rx, rz = F.col("x") * dx + x0 - centre, F.col("z") * dz + z0
    a = -F.radians("angle")
    asked = points.select("angle", "z", "x", ((-F.sin(a) * rx + F.cos(a) * rz - z0) / dz).alias("fz"), ((F.cos(a) * rx + F.sin(a) * rz + centre - x0) / dx).alias("fx"))
    return stencil.sample(flat, asked, ["angle"]).groupBy("z", "x").agg(F.sum("value").alias("value"))


def inverse_fourier(traces: DataFrame, x_size: int, dx: float, z0: float = 0.0, dz: float = 1.0, x0: float = 0.0, centres: DataFrame | None = None) -> DataFrame:
    """(z, x, value) from complex traces (decimation, angle in degrees, z, re, im).

    Each trace fills the column of its frequency, its conjugate (one sample later) the opposite one; frequency 0 counts
    half. Every depth's line is transformed by itself, the images of the angles are turned back about their centres
    (angle, centre_x; 0 if not given) and added. Images of up to WHOLE_PIXELS are transformed and turned as a whole.
    """
    ends = traces.agg(F.min("z"), F.max("z"), F.count(F.when(F.col("angle").isNull() | F.isnan("angle") | F.col("decimation").isNull() | F.col("z").isNull() | (F.col("decimation") < 0), 1))).first()
    if ends[0] is not None and ends[0] >= 0 and not ends[2] and (ends[1] + 1) * x_size <= WHOLE_PIXELS:
        rows = traces.join(centres, "angle", "left") if centres is not None else traces.withColumn("centre_x", F.lit(0.0))
        number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
        rows = rows.select((F.col("angle").cast("double") + 0.0).alias("angle"), number("centre_x"), F.col("decimation").cast("long").alias("k"), F.col("z").cast("long").alias("z"), number("re"), number("im"))
        turned = _turned_whole(rows, ends[1], ends[1] + 1, x_size, dx, z0, dz, x0)
    else:
        turned = _turned_rows(traces, x_size, dx, z0, dz, x0, centres)
    shots = traces.select("decimation", "angle").distinct().agg(F.count(F.lit(1)).alias("_all"), F.count(F.when(F.col("decimation") != 0, 1)).alias("_four"))
    scale = dx / (F.col("_all") * F.greatest(0.75 * F.col("_four"), F.lit(0.25)))  # a quarter of the scans beyond one a trace
    return turned.crossJoin(F.broadcast(shots)).select("z", "x", (F.col("value") * scale).alias("value"))


def filtered_traces(traces: DataFrame, z_size: int, dz: float, cutoff: float, frequency: float, kind: str = "ram-lak") -> DataFrame:
    """(decimation, angle, sup, low): each trace along z filtered, kept at frequencies >= 0 (sup); for decimation 0 those below ``frequency`` x decimation (low)."""
    spark = traces.sparkSession
    f = (F.col("id") - z_size // 2) / (z_size * dz)
    # z_size numbers: one weight a frequency.
    weights = np.array([r[0] for r in spark.range(z_size).orderBy("id").select(ramp_filter(f, kind, cutoff)).collect()])
    freqs = (np.arange(z_size) - z_size // 2) / (z_size * dz)

    @pandas_udf(f"struct<sup:{_COMPLEX},low:{_COMPLEX}>")
    def run(decimation: pd.Series, cells: pd.Series) -> pd.DataFrame:
        out = []
        for d, row in zip(decimation, cells):
            v = np.zeros(z_size, dtype=complex)
            for c in row:
                if 0 <= c["z"] < z_size:
                    v[int(c["z"])] += complex(c["re"], c["im"])
            bins = np.fft.fftshift(np.fft.fft(np.fft.ifftshift(v))) * z_size * dz * weights
            back = lambda b: np.fft.ifftshift(np.fft.ifft(np.fft.fftshift(b))) / dz
            sup, low = back(bins * (freqs >= 0)), back(bins * (np.abs(freqs) < abs(d) * frequency) * (d == 0))
            out.append(({"re": sup.real, "im": sup.imag}, {"re": low.real, "im": low.imag}))
        return pd.DataFrame(out, columns=["sup", "low"])

    packed = traces.groupBy("decimation", "angle").agg(F.collect_list(F.struct("z", "re", "im")).alias("cells"))
    return packed.select("decimation", "angle", run("decimation", "cells").alias("t")).select("decimation", "angle", "t.sup", "t.low")


def back_project(filtered: DataFrame, pixels: DataFrame, z_size: int, x_size: int, dx: float, dz: float, frequency: float, x0: float = 0.0, z0: float = 0.0, centres: DataFrame | None = None) -> DataFrame:
    """(z, x, value): every pixel adds, over all traces, the trace at its distance along the angle, on its carrier wave.

    Each pixel needs each trace: pixels x traces sums by nature. The traces stay where they are; up to SENT_PIXELS pixels
    are sent to them, and each task adds its traces up before the shuffle, which then is of the image's size.
    """
    t = filtered.join(centres, ["decimation", "angle"], "left") if centres is not None else filtered.withColumn("centre_x", F.lit(0.0))
    t = t.select("decimation", "angle", "centre_x", "sup", F.col("low.re").alias("low"))
    a, centre = F.radians("angle"), F.coalesce("centre_x", F.lit(0.0))
    px, pz = F.col("x") * dx + x0, F.col("z") * dz + z0
    along = (px - centre) * F.sin(a) + pz * F.cos(a)
    across = (px - (x0 + (x_size - 1) / 2 * dx)) * F.cos(a) - pz * F.sin(a)
    place = (along - z0) / dz
    i0 = F.greatest(F.lit(0), F.least(F.floor(place), F.lit(z_size - 1))).cast("int")
    i1 = F.greatest(F.lit(0), F.least(F.floor(place) + 1, F.lit(z_size - 1))).cast("int")
    w = place - i0
    at = lambda c: (1 - w) * F.col(c)[i0] + w * F.col(c)[i1]
    turn = 2 * math.pi * F.col("decimation") * frequency * across
    real = 2 * (F.cos(turn) * at("sup.re") - F.sin(turn) * at("sup.im")) + at("low")
    shots = filtered.agg(F.count(F.lit(1)).alias("_all"), F.count(F.when(F.col("decimation") != 0, 1)).alias("_four"))
    grid = pixels.select("z", "x")
    few = grid.limit(SENT_PIXELS + 1).count() <= SENT_PIXELS
    added = t.crossJoin(F.broadcast(grid) if few else grid).groupBy("z", "x").agg(F.sum(real).alias("value"))
    return added.crossJoin(F.broadcast(shots)).select("z", "x", (F.col("value") * dz / (F.col("_all") * F.greatest(0.75 * F.col("_four"), F.lit(0.25)))).alias("value"))
