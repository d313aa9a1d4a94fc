"""Signals (n, t, y): demodulation, normalisation, cropping, noise measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scans


def demodulate(signals: DataFrame, keys: list[str]) -> DataFrame:
    """Four phases (0, 1, 2, 3 quarter turns in column phase) to a complex value; a missing phase counts as zero."""
    s = [F.sum(F.when(F.col("phase") == k, F.col("y")).otherwise(0.0)) for k in range(4)]
    scale = F.pi() / 2
    return signals.groupBy(*keys).agg(((s[0] - s[2]) * scale).alias("re"), ((s[3] - s[1]) * scale).alias("im"))


def normalise(signals: DataFrame, value: str = "y") -> DataFrame:
    """(y - min) / (max - min) over all rows; zero where all are equal."""
    ends = signals.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.coalesce((F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), F.lit(0.0))
    return signals.crossJoin(F.broadcast(ends)).withColumn(value, scaled).drop("_lo", "_hi")


def crop(signals: DataFrame, first: int, end: int) -> DataFrame:
    return signals.where((F.col("t") >= first) & (F.col("t") < end)).withColumn("t", F.col("t") - first)


def halve(fields: DataFrame, mode: str = "avg") -> DataFrame:
    """Pool pairs along t, z and x by mean or maximum."""
    pool = {"avg": F.avg, "max": F.max}[mode]
    half = [F.floor(F.col(c) / 2).cast("long").alias(c) for c in ("t", "z", "x")]
    return fields.groupBy("n", *half).agg(pool("value").alias("value"))


def demodulate_fields(fields: DataFrame, digits: int = 5) -> DataFrame:
    """Fields (n, fs, theta, phase 0 to 3, y and t, z, x) to one complex field for each rounded (fs, theta).

    Repeats of a phase are folded by pairs in the order of n. A field of frequency 0 is passed on as its first phase's.
    """
    keys = ["fs", "theta", "t", "z", "x"]
    rounded = fields.withColumn("fs", F.round("fs", digits)).withColumn("theta", F.round("theta", digits))
    folded = scans.running_pair_mean(rounded, [*keys, "phase"])
    begins = rounded.groupBy(*keys, "phase").agg(F.min("n").alias("first"))
    whole = folded.join(begins, [*keys, "phase"])
    s = [F.coalesce(F.sum(F.when(F.col("phase") == k, F.col("y"))), F.lit(0.0)) for k in range(4)]
    flat, scale = F.col("fs") == 0, F.pi() / 2
    sums = whole.groupBy(*keys).agg(F.min_by("y", "first").alias("_plain"), ((s[0] - s[2]) * scale).alias("_re"), ((s[3] - s[1]) * scale).alias("_im"))
    return sums.select(*keys, F.when(flat, F.col("_plain")).otherwise(F.col("_re")).alias("re"), F.when(flat, F.lit(0.0)).otherwise(F.col("_im")).alias("im"))
