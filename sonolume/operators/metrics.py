"""Image quality: squared error, contrast recovery, noise, best iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def squared_error(images: DataFrame, truth: DataFrame) -> DataFrame:
    """(iter, mse, noise) of images (iter, col_id, value) against (col_id, truth)."""
    d = F.col("value") - F.col("truth")
    return images.join(truth, "col_id").groupBy("iter").agg(F.avg(d * d).alias("mse"), F.greatest(F.avg(F.abs(d)), F.lit(1e-10)).alias("noise"))


def contrast_recovery(with_lesion: DataFrame, without: DataFrame, truth: DataFrame) -> DataFrame:
    """(mean with / mean without - 1) over the same of the truth (col_id, truth_with, truth_without)."""
    both = with_lesion.select("col_id", F.col("value").alias("p")).join(without.select("col_id", F.col("value").alias("l")), "col_id").join(truth, "col_id")
    ratio = lambda a, b: F.avg(a) / F.avg(b) - 1
    return both.agg((ratio("p", "l") / ratio("truth_with", "truth_without")).alias("crc"))


def best_iteration(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.min_by("iter", F.struct("mse", "iter")).alias("iter"), F.min("mse").alias("mse"))


def structural_similarity(image: DataFrame, truth: DataFrame, size: int = 7, data_range: float | None = None) -> DataFrame:
    """(ssim,): mean over the pixels whose whole size x size window lies in the image; uniform windows, sample covariance.

    Box sums are two passes of a window function, along x and then along z; no pixel meets its 49 neighbours by a join.
    """
    from pyspark.sql import Window

    half = size // 2
    both = image.select("z", "x", F.col("value").alias("a")).join(truth.select("z", "x", F.col("value").alias("b")), ["z", "x"])
    cells = both.select("z", "x", "a", "b", (F.col("a") * F.col("a")).alias("aa"), (F.col("b") * F.col("b")).alias("bb"), (F.col("a") * F.col("b")).alias("ab"), F.lit(1).alias("n"))
    names = ["a", "b", "aa", "bb", "ab", "n"]
    for along, across in (("x", "z"), ("z", "x")):
        w = Window.partitionBy(across).orderBy(along).rangeBetween(-half, half)
        cells = cells.select("z", "x", *[F.sum(c).over(w).alias(c) for c in names])
    n = size * size
    whole = cells.where(F.col("n") == n)
    ends = truth.agg((F.max("value") - F.min("value")).alias("_range")) if data_range is None else truth.sparkSession.range(1).select(F.lit(float(data_range)).alias("_range"))
    c1, c2 = F.pow(0.01 * F.col("_range"), F.lit(2)), F.pow(0.03 * F.col("_range"), F.lit(2))
    ma, mb = F.col("a") / n, F.col("b") / n
    unbiased = n / (n - 1)
    va, vb, vab = (F.col("aa") / n - ma * ma) * unbiased, (F.col("bb") / n - mb * mb) * unbiased, (F.col("ab") / n - ma * mb) * unbiased
    score = (2 * ma * mb + c1) * (2 * vab + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    return whole.crossJoin(F.broadcast(ends)).agg(F.avg(score).alias("ssim"))


def maximum_projection(field: DataFrame) -> DataFrame:
    """(z, x, value, db): largest amplitude over time of squared envelopes, and in decibels of the largest pixel."""
    top = field.groupBy("z", "x").agg(F.sqrt(F.max("value")).alias("value"))
    peak = F.broadcast(top.agg(F.max("value").alias("_peak")))
    return top.crossJoin(peak).select("z", "x", "value", F.when(F.col("value") > 0, 20 * F.log10(F.col("value") / F.col("_peak"))).alias("db"))


def regional_contrast(images: DataFrame, region: DataFrame) -> DataFrame:
    """(iter, inside, outside, contrast) of images (iter, z, x, value) against a region (z, x)."""
    marked = images.join(region.select("z", "x").distinct().withColumn("_in", F.lit(True)), ["z", "x"], "left")
    inside, outside = F.avg(F.when(F.col("_in"), F.col("value"))), F.avg(F.when(F.col("_in").isNull(), F.col("value")))
    return marked.groupBy("iter").agg(inside.alias("inside"), outside.alias("outside"), (inside / outside - 1).alias("contrast"))


def progress(images: DataFrame, truth: DataFrame) -> DataFrame:
    """(iter, mse, noise, least, most): errors of each iteration, and the extrema of |value - truth| over all iterations after the first."""
    d = F.abs(F.col("value") - F.col("truth"))
    found = images.join(truth, "col_id").groupBy("iter").agg(F.avg(d * d).alias("mse"), F.avg(d).alias("noise"), F.min(d).alias("_lo"), F.max(d).alias("_hi"))
    later = F.col("iter") > F.col("_first")
    ends = found.crossJoin(F.broadcast(found.agg(F.min("iter").alias("_first")))).agg(F.min(F.when(later, F.col("_lo"))).alias("least"), F.max(F.when(later, F.col("_hi"))).alias("most"))
    return found.select("iter", "mse", "noise").crossJoin(F.broadcast(ends))


def shown_iterations(first: int, last: int, most: int = 5) -> list[int]:
    """Up to ``most`` evenly spaced iterations."""
    n = min(most, last - first + 1)
    return [first + (k * (last - first)) // (n - 1) for k in range(n)] if n > 1 else [first]


def relative_costs(costs: DataFrame, by: str) -> DataFrame:
    """cost divided by the largest of its history."""
    top = costs.groupBy(by).agg(F.max("cost").alias("_top"))
    return costs.join(top, by).withColumn("cost", F.col("cost") / F.col("_top")).drop("_top")


def apart_by_noise(metrics: DataFrame, distance: float) -> DataFrame:
    """(iter, noise) of the iterations whose noise differs by more than the distance from that of the one taken before; the first is taken.

    One row holds the history of a reconstruction: as many pairs as it has iterations.
    """
    history = metrics.agg(F.sort_array(F.collect_list(F.struct("iter", "noise"))).alias("h"))
    far = lambda taken, x: F.abs(x["noise"] - F.element_at(taken, -1)["noise"]) > distance
    taken = F.aggregate(F.slice("h", 2, F.greatest(F.size("h") - 1, F.lit(0))), F.slice("h", 1, 1), lambda acc, x: F.when(far(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return history.select(F.explode(taken).alias("e")).select("e.iter", "e.noise")


def stopping_rounds(history: DataFrame, kind: str, threshold: float, window: int, by: list[str]) -> DataFrame:
    """(by.., iter): the first round of each history (by.., iter, value) at which a rule ends it; none where it never does.

    relative_change and gradient_norm average the values, cost and squared_error the relative changes of the values, each
    over the last ``window`` rounds after the first, or over those there are; below the threshold ends. max_iterations ends
    after threshold rounds. A history has as many rows as a reconstruction has rounds.
    """
    ordered = Window.partitionBy(*by).orderBy("iter")
    numbered = history.withColumn("_k", F.row_number().over(ordered))
    if kind == "max_iterations":
        return numbered.where(F.col("_k") == int(threshold)).select(*by, "iter")
    if kind in ("relative_change", "gradient_norm"):
        step = F.col("value")
    elif kind in ("cost", "squared_error"):
        before = F.lag("value").over(ordered)
        step = F.abs(F.col("value") - before) / (F.abs(before) + 1e-10)
    else:
        raise ValueError(f"unknown stopping rule {kind}")
    steps = numbered.withColumn("_step", F.when(F.col("_k") > 1, step))
    mean = F.avg("_step").over(ordered.rowsBetween(1 - window, 0))
    return steps.withColumn("_mean", mean).where((F.col("_k") > 1) & (F.col("_mean") < threshold)).groupBy(*by).agg(F.min("iter").alias("iter"))


#: Values around the median that the driver sorts at most, but for values that many rows share.
NEAR = 4096


def median(df: DataFrame, name: str) -> float | None:
    """The exact median of a column (of the two middle values, their mean), None without values.

    Approximate quantiles close in on it until few values are left around it, so that no task holds all values.
    """
    values = df.select(F.col(name).cast("double").alias("v")).where(F.col("v").isNotNull())
    total, low, high = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not total:
        return None
    ranks, v, error = ((total - 1) // 2, total // 2), F.col("v"), 1e-3
    while low < high:
        below, inside = values.agg(F.count(F.when(v < low, 1)), F.count(F.when((v >= low) & (v <= high), 1))).first()
        near = values.where((v >= low) & (v <= high))
        shares = [(r - below) / inside for r in ranks]
        closer = near.approxQuantile("v", [max(0.0, shares[0] - 3 * error), min(1.0, shares[1] + 3 * error)], error) if inside > NEAR else [low, high]
        if closer == [low, high]:
            found, at = [], below
            for value, count in near.groupBy("v").count().orderBy("v").collect():
                found += [value for r in ranks if at <= r < at + count]
                at += count
            return sum(found) / 2
        low, high = closer
    return low
