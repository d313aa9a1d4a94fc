"""Discrete Fourier transforms along array columns. A series is one array a key, as long as one acquisition (at most some thousand samples)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def _each(f):
    return lambda series: pd.Series([None if v is None else f(np.asarray(v, dtype=float)) for v in series])


def _weights(n: int) -> np.ndarray:
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return h


def _analytic(v: np.ndarray) -> np.ndarray:
    return np.fft.ifft(np.fft.fft(v) * _weights(len(v))) if len(v) else v


def pack(samples: DataFrame, keys: list[str], at: str, value: str = "value") -> DataFrame:
    """(keys.., series): the samples of each key in the order of ``at``."""
    rows = F.array_sort(F.collect_list(F.struct(at, value)))
    return samples.groupBy(*keys).agg(F.transform(rows, lambda r: r[value]).alias("series"))


def unpack(packed: DataFrame, keys: list[str], at: str, value: str = "value") -> DataFrame:
    return packed.select(*keys, F.posexplode("series").alias(at, value))


def envelope(series: Column) -> Column:
    """Magnitude of the analytic signal."""
    return pandas_udf(_each(lambda v: np.abs(_analytic(v)).tolist()), "array<double>")(series)


def envelope_squared(series: Column) -> Column:
    return pandas_udf(_each(lambda v: (np.abs(_analytic(v)) ** 2).tolist()), "array<double>")(series)


def spectrum(series: Column) -> Column:
    """Magnitudes of the bins 0 to n // 2."""
    return pandas_udf(_each(lambda v: np.abs(np.fft.rfft(v)).tolist() if len(v) else []), "array<double>")(series)


def _resampled(v: np.ndarray, size: int) -> list[float]:
    n = len(v)
    if n in (0, size):
        return v.tolist()
    bins = np.fft.rfft(v)
    kept = min(len(bins), size // 2 + 1)
    limit = min(n, size) / 2
    k = np.arange(kept)
    fade = np.clip((k - 0.7 * limit) / (0.3 * limit), 0, None)
    window = np.where(k > limit, 0, np.where(fade > 0, 0.5 * (1 + np.cos(np.pi * fade)), 1.0))
    out = np.zeros(size // 2 + 1, dtype=complex)
    out[:kept] = bins[:kept] * window
    return (np.fft.irfft(out, size) * (size / n)).tolist()


def resample(series: Column, size: int) -> Column:
    """Band-limited change of length: a raised cosine falls from 0.7 of the smaller Nyquist bin to it."""
    return pandas_udf(_each(lambda v: _resampled(v, size)), "array<double>")(series)


def resample_field(field: DataFrame, keys: list[str], sizes: tuple[int, int, int]) -> DataFrame:
    """Field (keys.., t, z, x, value) resampled along t, then z, then x."""
    for along, size in zip(("t", "z", "x"), sizes):
        rest = [*keys, *[c for c in ("t", "z", "x") if c != along]]
        packed = pack(field, rest, along)
        field = unpack(packed.withColumn("series", resample(F.col("series"), size)), rest, along)
    return field


def _cubic(v: np.ndarray, size: int) -> list[float]:
    n = len(v)
    if n < 2 or size < 1:
        return (np.repeat(v, size) if n else v).tolist()
    period = 2 * (n - 1)
    turn = 2 * np.pi * np.arange(period // 2 + 1) / period
    # The series mirrored about both ends is periodic, so its spline coefficients come from one division of spectra.
    c = np.fft.irfft(np.fft.rfft(np.concatenate([v, v[-2:0:-1]])) * 6 / (4 + 2 * np.cos(turn)), period)
    at = np.arange(size) * ((n - 1) / (size - 1) if size > 1 else 0.0)
    i = np.floor(at).astype(int)
    u = at - i
    parts = ((1 - u) ** 3, 4 - 6 * u**2 + 3 * u**3, 1 + 3 * u + 3 * u**2 - 3 * u**3, u**3)
    return (sum(w * c[(i + k - 1) % period] for k, w in enumerate(parts)) / 6).tolist()


def cubic_zoom(series: Column, size: int) -> Column:
    """Interpolating cubic spline at ``size`` even places from the first sample to the last; mirrored at the ends. Empty: empty."""
    return pandas_udf(_each(lambda v: _cubic(v, size)), "array<double>")(series)


def uniform_length(signals: DataFrame, keys: list[str], size: int, at: str = "t", value: str = "y") -> DataFrame:
    """Signals (keys.., t, y) stretched or shrunk along t to ``size`` samples by cubic splines."""
    packed = pack(signals, keys, at, value)
    return unpack(packed.withColumn("series", cubic_zoom(F.col("series"), size)), keys, at, value)


def _dominant(bits: pd.Series) -> pd.Series:
    found = pd.Series([None] * len(bits), bits.index, "Int32")
    for n, same in bits.dropna().groupby(bits.str.len()):
        v = np.frombuffer("".join(same).encode(), np.uint8).reshape(len(same), -1) - ord("0")
        if (v > 1).any():
            raise ValueError("patterns are strings of 0 and 1")
        n = int(n)
        if n < 4:
            found[same.index] = 0
            continue
        # Magnitudes that differ by rounding alone count as equal.
        size = np.round(np.abs(np.fft.rfft(v.astype(float), axis=1)[:, 1 : n // 2]), 6)
        found[same.index] = np.where(v.all(axis=1), 0, size.argmax(axis=1) + 1)
    return found


def dominant_bin(bits: Column) -> Column:
    """Bin 1 to n/2 - 1 with the largest magnitude in a string of 0 and 1 (ties: the lowest); 0 if all are 1 or there is no such bin."""
    return pandas_udf(_dominant, "int")(bits)


def ramp_filter(f: Column, kind: str, cutoff: float) -> Column:
    """Ramp |f| shaped by a window, zero above the cutoff, with a steep roll-off before it."""
    if kind == "ram-lak":
        shape = F.lit(1.0)
    elif kind == "shepp-logan":
        turn = F.pi() * f / cutoff
        shape = F.when(f == 0, F.lit(1.0)).otherwise(F.sin(turn) / turn)
    elif kind == "cosine":
        shape = F.cos(F.pi() * f / (2 * cutoff))
    elif kind == "hamming":
        shape = 0.54 + 0.46 * F.cos(2 * F.pi() * f / cutoff)
    elif kind == "hann":
        shape = (1 + F.cos(F.pi() * f / (2 * cutoff))) / 2
    else:
        raise ValueError(f"unknown filter {kind}")
    return F.when(F.abs(f) > cutoff, 0.0).otherwise(F.abs(f) * shape * F.exp(-2 * F.pow(F.abs(f) / cutoff, F.lit(10))))


def _divided(n: int) -> int:
    """The largest divisor of n up to its root."""
    return next(d for d in range(math.isqrt(n), 0, -1) if n % d == 0)


def _grouped(rows: DataFrame, keys: list[str], group: str, at: str, size: int, sign: int) -> DataFrame:
    """(keys.., group, at, re, im): transforms of ``size`` points along ``at``; a point that a group lacks is zero."""

    @pandas_udf("array<struct<re: double, im: double>>")
    def transform(points: pd.Series) -> pd.Series:
        out = []
        for p in points:
            v = np.zeros(size, complex)
            v[[x["at"] for x in p]] = [complex(x["re"], x["im"]) for x in p]
            w = np.fft.fft(v) if sign < 0 else np.fft.ifft(v) * size
            out.append([{"re": x.real, "im": x.imag} for x in w])
        return pd.Series(out)

    packed = rows.groupBy(*keys, group).agg(F.collect_list(F.struct(F.col(at).alias("at"), "re", "im")).alias("p"))
    return packed.select(*keys, group, F.posexplode(transform("p")).alias(at, "w")).select(*keys, group, at, "w.re", "w.im")


def long_transform(samples: DataFrame, keys: list[str], at: str, n: int, inverse: bool = False) -> DataFrame:
    """(keys.., at, re, im): the discrete Fourier transform of n points along ``at`` of (keys.., at, re, im), for axes longer than a row should hold.

    n is parted into n1 x n2, n1 the largest divisor up to its root. Point n2 a + b stands in column b: columns of n1
    points are transformed, turned by their place (b c / n of a circle) and transformed along rows of n2 points, whose
    point d is that of c + n1 d. So no group holds more than n2 points: 2^8 of 2^16 (all n, where n is prime). Absent
    points are zero; points outside the axis are an error.
    """
    n1 = _divided(n)
    n2, sign = n // n1, 1 if inverse else -1
    t = F.when((F.col(at) >= 0) & (F.col(at) < n), F.col(at)).otherwise(F.raise_error(F.concat(F.lit("the axis has no point "), F.col(at).cast("string"))).cast("long"))
    rows = samples.select(*keys, F.floor(t / n2).cast("int").alias("_a"), (t % n2).cast("int").alias("_b"), "re", "im")
    columns = _grouped(rows, keys, "_b", "_a", n1, sign)
    turn = sign * 2 * F.pi() * (F.col("_a") * F.col("_b") % n) / n
    re, im = F.col("re") * F.cos(turn) - F.col("im") * F.sin(turn), F.col("re") * F.sin(turn) + F.col("im") * F.cos(turn)
    turned = columns.select(*keys, "_a", "_b", re.alias("re"), im.alias("im"))
    found = _grouped(turned, keys, "_a", "_b", n2, sign)
    scale = 1.0 / n if inverse else 1.0
    return found.select(*keys, (F.col("_a").cast("long") + F.lit(n1) * F.col("_b")).alias(at), (F.col("re") * scale).alias("re"), (F.col("im") * scale).alias("im"))


def centred_transform(samples: DataFrame, keys: list[str], at: str, n: int, step: float, inverse: bool = False) -> DataFrame:
    """long_transform between an axis of places and one of frequencies, both with zero in the middle: forward times n and the step, back divided by the step."""
    half = n // 2
    moved = lambda df, by: df.withColumn(at, F.pmod(F.col(at) + by, F.lit(n)))
    found = moved(long_transform(moved(samples, half if inverse else -half), keys, at, n, inverse), -half if inverse else half)
    scale = 1 / step if inverse else n * step
    return found.select(*keys, at, (F.col("re") * scale).alias("re"), (F.col("im") * scale).alias("im"))
