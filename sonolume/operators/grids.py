"""Images on axes with a begin and a step: from one grid to another, and what two grids share."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stencil

#: Of a step: places so close count as one.
CLOSE = 1e-9


@dataclass(frozen=True)
class Even:
    """Places at even distances along an axis."""

    first: float
    step: float
    count: int

    def __len__(self) -> int:
        return self.count

    @property
    def last(self) -> float:
        return self.first + (self.count - 1) * self.step

    def inside(self, low: float, high: float) -> range:
        """Numbers of the places from low to high."""
        return range(max(0, math.ceil((low - self.first) / self.step - CLOSE)), min(self.count - 1, math.floor((high - self.first) / self.step + CLOSE)) + 1)


Grid = tuple[Even, Even]


def centred(count: int, step: float) -> Even:
    """Places around zero, as those of a probe's elements."""
    return Even(-(count - 1) / 2 * step, step, count)


def shared(source: Grid, target: Grid) -> tuple[range, range]:
    """Lines and columns of the target that lie within both grids."""
    return tuple(t.inside(max(s.first, t.first), min(s.last, t.last)) for s, t in zip(source, target))


def resampled(image: DataFrame, source: Grid, target: Grid) -> DataFrame:
    """(z, x, value) at every place of the target: linear between the source's places, zero outside them. Pixels that the image lacks are zero."""
    (sz, sx), (tz, tx) = source, target
    places = image.sparkSession.range(tz.count * tx.count).select(F.floor(F.col("id") / tx.count).alias("z"), (F.col("id") % tx.count).alias("x"))
    at = {}
    for name, s, t in (("z", sz, tz), ("x", sx, tx)):
        found = (F.lit(float(t.first)) + F.col(name) * F.lit(float(t.step)) - F.lit(float(s.first))) / F.lit(float(s.step))
        # Places that rounding puts beside a source's place, or just outside the last, are taken for it.
        at["f" + name] = F.when(F.abs(found - F.rint(found)) <= CLOSE, F.rint(found)).otherwise(found)
    points = places.withColumns(at)
    inside = (F.col("fz") >= 0) & (F.col("fz") <= sz.count - 1) & (F.col("fx") >= 0) & (F.col("fx") <= sx.count - 1)
    found = stencil.sample(image.select("z", "x", "value"), points.where(inside))
    return places.join(found, ["z", "x"], "left").select("z", "x", F.coalesce("value", F.lit(0.0)).alias("value"))


def with_truth(image: DataFrame, truth: DataFrame, source: Grid, target: Grid) -> DataFrame:
    """(z, x, value, truth) where both grids are, numbered anew: the image brought to the truth's grid, and the truth (z, x, value), zero where it lacks a pixel."""
    lines, columns = shared(source, target)
    if not lines or not columns:
        raise ValueError("the grids have no place in common")
    part = (Even(target[0].first + lines[0] * target[0].step, target[0].step, len(lines)), Even(target[1].first + columns[0] * target[1].step, target[1].step, len(columns)))
    cropped = stencil.crop(truth, (lines[0], lines[-1] + 1), (columns[0], columns[-1] + 1)).withColumnRenamed("value", "truth")
    return resampled(image, source, part).join(cropped, ["z", "x"], "left").select("z", "x", "value", F.coalesce("truth", F.lit(0.0)).alias("truth"))
