"""Sparse system matrices as tables (row_id, col_id, v); row_id = n * T + t, col_id = z * X + x.

Vectors are tables too: images (col_id, value), signals (row_id, y). Absent cells are zero. The products (forward,
backward and their complex forms) are sums over cells, so they also take entries whose cells repeat. Layouts of compressed formats
have no counterpart: Spark's partitioning takes their place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def from_entries(entries: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Add up repeated cells."""
    return entries.groupBy(F.col(row).alias("row_id"), F.col(col).alias("col_id")).agg(F.sum(value).alias("v"))


def threshold_rows(a: DataFrame, share: float) -> DataFrame:
    """Keep cells above ``share`` of the largest absolute value of their row (strictly)."""
    top = F.max(F.abs("v")).over(Window.partitionBy("row_id"))
    return a.withColumn("_top", top).where(F.abs("v") > F.lit(share) * F.col("_top")).drop("_top")


def forward(a: DataFrame, image: DataFrame) -> DataFrame:
    """q = A x: (row_id, q). Spark broadcasts the image where its size is known to be small."""
    return a.join(image, "col_id").groupBy("row_id").agg(F.sum(F.col("v") * F.col("value")).alias("q"))


def backward(a: DataFrame, signal: DataFrame, value: str = "y") -> DataFrame:
    """c = A^T e: (col_id, c)."""
    return a.join(signal, "row_id").groupBy("col_id").agg(F.sum(F.col("v") * F.col(value)).alias("c"))


def backward_complex(a: DataFrame, signal: DataFrame) -> DataFrame:
    """c = A^H e for cells (vre, vim) and signals (yre, yim): (col_id, cre, cim)."""
    re = F.col("vre") * F.col("yre") + F.col("vim") * F.col("yim")
    im = F.col("vre") * F.col("yim") - F.col("vim") * F.col("yre")
    return a.join(signal, "row_id").groupBy("col_id").agg(F.sum(re).alias("cre"), F.sum(im).alias("cim"))


def sensitivity(a: DataFrame, floor: float = 1e-10) -> DataFrame:
    return a.groupBy("col_id").agg(F.greatest(F.sum("v"), F.lit(floor)).alias("sens"))


def norm_factors(a: DataFrame, kind: str = "csr") -> DataFrame:
    """Inverse column weights: dense 1/max(sum v, 1e-6), csr 1/max(sum |v|, 1e-6), sell 1/(sum |v| + 1e-10)."""
    whole = {"dense": lambda: F.greatest(F.sum("v"), F.lit(1e-6)), "csr": lambda: F.greatest(F.sum(F.abs("v")), F.lit(1e-6)), "sell": lambda: F.sum(F.abs("v")) + 1e-10}[kind]()
    return a.groupBy("col_id").agg((1 / whole).alias("norm"))


def _power(a: DataFrame) -> Column:
    """|v|^2 of real or complex cells."""
    return F.col("vre") * F.col("vre") + F.col("vim") * F.col("vim") if "vre" in a.columns else F.col("v") * F.col("v")


def absolute_sums(a: DataFrame, by: str) -> DataFrame:
    return a.groupBy(by).agg(F.sum(F.sqrt(_power(a)) if "vre" in a.columns else F.abs("v")).alias("total"))


def hessian_diagonal(a: DataFrame) -> DataFrame:
    return a.groupBy("col_id").agg(F.sum(_power(a)).alias("diagonal"))


def precondition(a: DataFrame, image: DataFrame) -> DataFrame:
    """x / (diag(A^T A) + 1e-3 of its maximum)."""
    d = hessian_diagonal(a)
    top = d.agg(F.max("diagonal").alias("top"))
    return image.join(d, "col_id").crossJoin(F.broadcast(top)).select("col_id", (F.col("value") / (F.col("diagonal") + 1e-3 * F.col("top"))).alias("value"))


def normalise(a: DataFrame) -> DataFrame:
    """Divide by the largest absolute value (one row, broadcast)."""
    top = a.agg(F.max(F.abs("v")).alias("top"))
    return a.crossJoin(F.broadcast(top)).select("row_id", "col_id", (F.col("v") / F.col("top")).alias("v"))


def density(a: DataFrame) -> DataFrame:
    """Cells, and their share in percent of the smallest matrix from (0, 0) that holds them."""
    cells = F.count(F.lit(1))
    return a.agg(cells.alias("cells"), (100.0 * cells / ((F.max("row_id") + 1) * (F.max("col_id") + 1))).alias("percent"))


def row_layout(a: DataFrame, sigma: int) -> DataFrame:
    """Cells a row, their running total, and the row's place when each window of sigma rows is sorted by falling count."""
    counts = a.groupBy("row_id").agg(F.count(F.lit(1)).alias("cells")).withColumn("block", F.floor(F.col("row_id") / sigma))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("cells"), "row_id")) - 1)


def truncate(a: DataFrame, t_size: int, x_size: int, t_range=None, t_step: int = 1, z_range=None, x_range=None, space_step: int = 1) -> DataFrame:
    """Cut to [from, to) ranges of t, z and x, thin out by steps, and number rows and columns anew. Filters reach the scan."""
    n, t = F.floor(F.col("row_id") / t_size), F.col("row_id") % t_size
    z, x = F.floor(F.col("col_id") / x_size), F.col("col_id") % x_size
    t0, t1 = t_range or (0, t_size)
    x0, x1 = x_range or (0, x_size)
    z0 = z_range[0] if z_range else 0
    keep = (t >= t0) & (t < t1) & ((t - t0) % t_step == 0) & (x >= x0) & (x < x1) & ((x - x0) % space_step == 0) & (z >= z0) & ((z - z0) % space_step == 0)
    if z_range:
        keep &= z < z_range[1]
    new_t, new_x = -(-(t1 - t0) // t_step), -(-(x1 - x0) // space_step)
    row = n * new_t + F.floor((t - t0) / t_step)
    col = F.floor((z - z0) / space_step) * new_x + F.floor((x - x0) / space_step)
    return a.where(keep).select(row.cast("long").alias("row_id"), col.cast("long").alias("col_id"), "v")


def apodise(a: DataFrame, window: DataFrame) -> DataFrame:
    """v * w of the column; columns without a weight stay."""
    return a.join(window, "col_id", "left").select("row_id", "col_id", (F.col("v") * F.coalesce("w", F.lit(1.0))).alias("v"))


def forward_complex(a: DataFrame, image: DataFrame) -> DataFrame:
    """q = A x for cells (vre, vim) and a real image: (row_id, qre, qim)."""
    return a.join(image, "col_id").groupBy("row_id").agg(F.sum(F.col("vre") * F.col("value")).alias("qre"), F.sum(F.col("vim") * F.col("value")).alias("qim"))


def sensitivity_complex(a: DataFrame, floor: float = 1e-10) -> DataFrame:
    """|A^H 1|: (col_id, sens)."""
    return a.groupBy("col_id").agg(F.greatest(F.sqrt(F.pow(F.sum("vre"), F.lit(2)) + F.pow(F.sum("vim"), F.lit(2))), F.lit(floor)).alias("sens"))


@dataclass(frozen=True)
class View:
    """A virtual truncation: the matrix stays as it is, the view is a filter over it that reaches the scan.

    Times within t_range that are multiples of t_step and pixels of the box are active. Effective rows and columns number
    the active ones without gaps; gather and scatter carry vectors between both. Without a view the table itself is used.
    """

    t_size: int
    x_size: int
    t_range: tuple[int, int] | None = None
    t_step: int = 1
    z_range: tuple[int, int] | None = None
    x_range: tuple[int, int] | None = None

    def times(self) -> tuple[int, int]:
        """First active time and number of active times."""
        lo, hi = self.t_range or (0, self.t_size)
        first = -(-max(lo, 0) // self.t_step) * self.t_step
        return first, max(0, -(-(min(hi, self.t_size) - first) // self.t_step))

    def rows(self, row_id: Column) -> Column:
        t, (first, count) = row_id % self.t_size, self.times()
        return (t >= first) & (t < first + count * self.t_step) & (t % self.t_step == 0)

    def columns(self, col_id: Column) -> Column:
        keep = F.lit(True)
        for at, span in ((F.floor(col_id / self.x_size), self.z_range), (col_id % self.x_size, self.x_range)):
            if span:
                keep = keep & (at >= span[0]) & (at < span[1])
        return keep

    def of(self, a: DataFrame) -> DataFrame:
        """The active cells, under their own rows and columns."""
        return a.where(self.rows(F.col("row_id")) & self.columns(F.col("col_id")))

    def effective_row(self, row_id: Column) -> Column:
        first, count = self.times()
        return (F.floor(row_id / self.t_size) * count + F.floor((row_id % self.t_size - first) / self.t_step)).cast("long")

    def effective_column(self, col_id: Column) -> Column:
        (z0, _), (x0, x1) = self.z_range or (0, 0), self.x_range or (0, self.x_size)
        return ((F.floor(col_id / self.x_size) - z0) * (x1 - x0) + col_id % self.x_size - x0).cast("long")

    def full_column(self, column: Column) -> Column:
        (z0, _), (x0, x1) = self.z_range or (0, 0), self.x_range or (0, self.x_size)
        return ((F.floor(column / (x1 - x0)) + z0) * self.x_size + column % (x1 - x0) + x0).cast("long")

    def gather(self, image: DataFrame) -> DataFrame:
        """The active pixels of an image under their effective columns."""
        return image.where(self.columns(F.col("col_id"))).withColumn("col_id", self.effective_column(F.col("col_id")))

    def scatter(self, image: DataFrame) -> DataFrame:
        """An image of the view under the columns of the whole."""
        return image.withColumn("col_id", self.full_column(F.col("col_id")))

    def extent(self, x_ends: tuple[float, float], z_ends: tuple[float, float], z_size: int) -> list[float]:
        """[x from, x to, z to, z from] of the active box in the units of the whole grid's ends."""
        (z0, z1), (x0, x1) = self.z_range or (0, z_size), self.x_range or (0, self.x_size)
        dx, dz = (x_ends[1] - x_ends[0]) / self.x_size, (z_ends[1] - z_ends[0]) / z_size
        return [x_ends[0] + x0 * dx, x_ends[0] + x1 * dx, z_ends[0] + z1 * dz, z_ends[0] + z0 * dz]
