"""Image of a focused scan: each emission is one lateral place, time is depth."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import stencil

#: Samples at the start that hold the emission itself.
SKIPPED = 5
#: Full width at half maximum of a Gaussian in standard deviations.
FWHM = 2 * math.sqrt(2 * math.log(2))


def raw_image(signals: DataFrame, t_size: int, n_size: int, z_size: int, x_size: int, dx: float, speed: float, rate: float) -> DataFrame:
    """(z, x, value): samples from SKIPPED to the deepest pixel's time, resized linearly to the pixel grid."""
    end = min(t_size, math.ceil(z_size * dx / speed * rate))
    if end <= SKIPPED:
        raise ValueError(f"the deepest pixel is reached after {end} samples, {SKIPPED} are skipped")
    cut = signals.where((F.col("t") >= SKIPPED) & (F.col("t") < end)).select((F.col("t") - SKIPPED).cast("long").alias("z"), F.col("n").cast("long").alias("x"), F.col("y").alias("value"))
    return stencil.zoom(cut, (end - SKIPPED, n_size), (z_size, x_size))


def focused_image(
    signals: DataFrame, t_size: int, n_size: int, z_size: int, x_size: int, dx: float, dz: float, speed: float, rate: float, frequency: float, cycles: float, focus: float, aperture: float,
    medium_speed: float | None = None,
) -> DataFrame:
    """The raw image without each column's minimum, smoothed by the pulse's length axially and by the beam's width at each
    depth laterally, then scaled to 0..1.

    signals: (n, t, y), every emission 0..n_size-1 with every sample 0..t_size-1. aperture: width of the elements that
    focus. The beam is narrowest at ``focus`` and widens as a Gaussian beam does. medium_speed: slowest speed of the
    medium, if it isn't ``speed``.
    """
    raw = raw_image(signals, t_size, n_size, z_size, x_size, dx, speed, rate)
    level = raw.select("z", "x", (F.col("value") - F.min("value").over(Window.partitionBy("x"))).alias("value"))
    wavelength = (medium_speed or speed) / frequency
    waist = 1.028 * wavelength * focus / aperture / FWHM
    rayleigh = math.pi * waist**2 / wavelength
    axial = stencil.gaussian(level, cycles * wavelength / FWHM / dz, "z", z_size)
    width = waist * F.sqrt(1 + F.pow((F.col("z") * dz - focus) / rayleigh, F.lit(2))) / dx
    smooth = stencil.gaussian_lines(axial, width, x_size)
    ends = smooth.agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    return smooth.crossJoin(F.broadcast(ends)).select("z", "x", ((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9)).alias("value"))
