"""Recordings of an experiment: parameters, repeated signals and hydrophone scans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fourier
from ..operators import scans
from ..operators.grids import Even
from . import arrays, binary, hdf5, mat, npy

#: Parameters, the variables that hold them, and factors to SI units.
TEXTS = {"TypeOfSequence": "TypeOfSequence"}
NUMBERS = {
    "FreqSonde": ("FreqSonde", 1e6), "Naverage": ("NTrig", 1), "Nelement": ("NbElemts", 1), "SampleRate": ("SampleRate", 1), "Volt": ("Volt", 1), "nbHemicycle": ("NbHemicycle", 1), "prof": ("Prof", 1),
    "c": ("c", 1), "pitch": ("pitch", 1), "dFx": ("dFx", 1), "Foc": ("Foc", 1),
}
LISTS = {"z": "z", "AngleMatrix": "Alphas", "decimation": "decimation", "x": "x"}
MATRICES = {"ActiveListMatrix": "ActiveLIST", "DelayLAWS": "DelayLAWS", "ScanParam": "ScanParam"}
RAW = "raw"


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """One row: texts, numbers (in SI units) and lists of a recording; null where the file has no such variable."""
    wanted = [*TEXTS.values(), *(v for v, _ in NUMBERS.values()), *LISTS.values()]
    rows = mat.read_mat(spark, path, [v for v in wanted if v in mat.variables(spark, path)] or ["none of them"])
    ordered = F.array_sort(F.collect_list(F.struct("position", "re")))
    lists = rows.groupBy("variable").agg(F.transform(ordered, lambda r: r["re"]).alias("values"))
    of = lambda v: F.max(F.when(F.col("variable") == v, F.col("values")))
    digits = lambda v: F.array_join(F.transform(of(v), lambda c: F.lpad(F.hex(c.cast("int")), 4, "0")), "")
    text = lambda v: F.decode(F.unhex(digits(v)), "UTF-16BE")
    first = lambda v: F.get(of(v), F.lit(0))
    return lists.agg(
        *(text(v).alias(k) for k, v in TEXTS.items()), *((first(v) * F.lit(float(s))).cast("long" if k in ("Naverage", "Nelement") else "double").alias(k) for k, (v, s) in NUMBERS.items()), *(of(v).alias(k) for k, v in LISTS.items())
    )


def read_matrix(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(i, j, value) of one of MATRICES."""
    return mat.read_array(spark, path, MATRICES[name], ["i", "j"])


def read_repeats(spark: SparkSession, path: str) -> DataFrame:
    """(n, repeat, t, y): the raw signals. The first axis is time; all others, the last the fastest, are the repeats and in each of them the scans."""
    found = mat.variables(spark, path)
    if RAW not in found or "NTrig" not in found:
        raise ValueError(f"{path} lacks {RAW} or NTrig; it has {sorted(found)}")
    shape = found[RAW].shape
    repeats = int(mat.read_mat(spark, path, ["NTrig"]).first()["re"])
    columns = math.prod(shape[1:])
    if repeats < 1 or columns % repeats:
        raise ValueError(f"{columns} signals can't be parted into {repeats} repeats")
    axes = [f"a{k}" for k in range(len(shape))]
    flat = F.lit(0).cast("long")
    for a, s in zip(axes[1:], arrays.strides(shape[1:], False)):
        flat = flat + F.col(a) * F.lit(s)
    cells = mat.read_array(spark, path, RAW, axes, "y").select(F.col("a0").alias("t"), flat.alias("column"), "y")
    each = max(columns // repeats, 1)
    return cells.select((F.col("column") % each).alias("n"), F.expr(f"column div {each}").alias("repeat"), "t", "y")


def read_signals(spark: SparkSession, path: str, first: int = 0, count: int | None = None) -> DataFrame:
    """(n, t, y): the mean of ``count`` repeats from ``first`` on, or of all."""
    return scans.mean_of_repeats(read_repeats(spark, path), first, count)


def read_file(spark: SparkSession, path: str, axes: list[str], array: str = "data", value: str = "value") -> DataFrame:
    """(axes.., value) of a file, whatever its format: an array of an HDF5 or MAT file, a NPY file, or an Interfile header
    (with the image beside it, axes t, z, x). The ending of the name tells the format."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "npy":
        return npy.read_npy(spark, path, axes, value)
    if kind == "mat":
        return mat.read_array(spark, path, array, axes, value)
    if kind in ("h5", "hdf5"):
        return hdf5.read_hdf5(spark, path, array, axes, value)
    if kind == "hdr":
        if len(axes) != 3:
            raise ValueError(f"{path}: an image has the axes of time, depth and width")
        about = binary.header(spark, path, ":=")
        data = about.get("name of data file") or about.get("name of date file")
        if not data:
            raise ValueError(f"{path} names no data file")
        image = binary.read_image(spark, f"{path.rsplit('/', 1)[0]}/{data.rsplit('/', 1)[-1]}", path)
        return image.select(*(F.col(c).cast("long").alias(a) for c, a in zip(("t", "z", "x"), axes)), F.col("value").alias(value))
    raise ValueError(f"{path}: files are npy, mat, h5, hdf5 or hdr")


def write_file(cells: DataFrame, path: str, axes: list[str], shape, array: str = "data", value: str = "value", facts: dict[str, object] | None = None) -> None:
    """cells (axes.., value) as one file of the format that the ending of its name tells; facts go beside it in a MAT file only."""
    kind = path.rsplit(".", 1)[-1].lower()
    if facts and kind != "mat":
        raise ValueError("only MAT files take facts")
    if kind == "npy":
        npy.write_npy(cells, path, axes, shape, value)
    elif kind == "mat":
        mat.write_mat(cells, path, array, axes, shape, facts, value)
    elif kind in ("h5", "hdf5"):
        hdf5.write_hdf5(cells, path, array, axes, shape, value)
    else:
        raise ValueError(f"{path}: files are npy, mat, h5 or hdf5")


#: The grid of the planar scans, in millimetres (fixed values).
PLANE = {"x": Even(-23, 0.2, 221), "z": Even(0, 0.2, 186)}


def _place(index: Column, axis: list[float] | Even) -> Column:
    if isinstance(axis, Even):
        return F.lit(float(axis.first)) + index * F.lit(float(axis.step))
    return F.element_at(F.array(*map(F.lit, map(float, axis))), (index + 1).cast("int"))


def hydrophone_scan(stops: DataFrame, **axes: list[float] | Even) -> DataFrame:
    """(axes in millimetres.., t, value): the envelope at every stop of a scan that turns back at the end of each row (and plane).

    stops: (stop, t, value), stops numbered from 0 in the order of the recording; axes: the places along x or y or both,
    and z, the first the fastest. A stop beyond the scan is an error, a stop that is missing gives no rows. Each stop's samples are one
    array in a task, as long as one recording.
    """
    names = [n for n in ("x", "y", "z") if n in axes]
    if names not in (["x", "z"], ["y", "z"], ["x", "y", "z"]) or len(axes) != len(names):
        raise ValueError("a scan has the axes x and z, y and z, or x, y and z")
    sizes = [len(axes[n]) for n in names]
    stop = F.col("stop")
    stop = F.when((stop >= 0) & (stop < math.prod(sizes)), stop).otherwise(F.raise_error(F.concat(F.lit("the scan has no stop "), stop.cast("string"))).cast("long"))
    if len(names) == 2:
        places = [scans.serpentine(stop, sizes[0]), F.floor(stop / sizes[0])]
    else:
        places = list(scans.serpentine_volume(stop, *sizes[:2]))
    packed = fourier.pack(stops, ["stop"], "t")
    strong = packed.select(*(_place(p, axes[n]).alias(f"{n}_mm") for n, p in zip(names, places)), fourier.envelope(F.col("series")).alias("series"))
    return fourier.unpack(strong, [f"{n}_mm" for n in names], "t")
