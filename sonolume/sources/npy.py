"""Arrays in NPY files: tasks read and write ranges of one file."""

from __future__ import annotations

import ast
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from . import arrays


def describe(uri: str) -> tuple[np.dtype, tuple[int, ...], bool, int]:
    """Number type, sizes of the axes, whether the first axis is the fastest, first byte of the values. Arrays of objects fail."""
    with arrays.open_input(uri) as f:
        start = f.read(8)
        if start[:6] != b"\x93NUMPY":
            raise ValueError(f"{uri} is not an NPY file")
        wide = 2 if start[6] == 1 else 4
        size = int.from_bytes(f.read(wide), "little")
        about = ast.literal_eval(f.read(size).decode("latin1"))
    number = np.dtype(about["descr"])
    if number.hasobject or number.names:
        raise ValueError(f"{uri}: values must be numbers")
    return number, tuple(about["shape"]), bool(about["fortran_order"]), 8 + wide + size


class _Reader(DataSourceReader):
    def __init__(self, uri: str, task: int):
        self.uri, self.task = uri, task
        self.number, self.shape, _, self.offset = describe(uri)

    def partitions(self):
        return arrays.ranges(math.prod(self.shape), task=self.task) or [arrays.Range(0, 0)]

    def read(self, partition):
        size = self.number.itemsize
        with arrays.open_input(self.uri) as f:
            for k in range(partition.first, partition.end, arrays.BATCH):
                n = min(arrays.BATCH, partition.end - k)
                yield arrays.batch_of(k, np.frombuffer(f.read_at(n * size, self.offset + k * size), self.number, n))


class NpyFile(DataSource):
    """Rows (position long, re double, im double) of one NPY file, position counting the values as they lie in it."""

    @classmethod
    def name(cls):
        return "sonolume_npy"

    def schema(self):
        return "position long, re double, im double"

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options["task"]))


def read_npy(spark: SparkSession, path: str, axes: list[str], value: str = "value", complex_values: bool = False, task: int = arrays.TASK) -> DataFrame:
    """(axes.., value), or (axes.., re, im) of complex values: a row for each value of the array, in C or Fortran order. Empty array: no rows."""
    uri = arrays.located(spark, path)
    _, shape, fortran, _ = describe(uri)
    if len(shape) != len(axes):
        raise ValueError(f"{path} has {len(shape)} axes, {len(axes)} are named")
    spark.dataSource.register(NpyFile)
    rows = spark.read.format("sonolume_npy").option("task", str(task)).load(uri)
    return rows.select(*arrays.indices(axes, shape, fortran), *(["re", "im"] if complex_values else [F.col("re").alias(value)]))


def write_npy(cells: DataFrame, path: str, axes: list[str], shape, value: str = "value", number: str = "<f8", fortran: bool = False) -> None:
    """cells (axes.., value), or (axes.., re, im) for a complex number type, as one NPY file. Places without a row are zero."""
    text = f"{{'descr': '{np.dtype(number).str}', 'fortran_order': {fortran}, 'shape': ({', '.join(map(str, shape))}{',' if len(shape) == 1 else ''}), }}"
    text += " " * (-(len(text) + 11) % 64) + "\n"
    head = b"\x93NUMPY\x01\x00" + len(text).to_bytes(2, "little") + text.encode("latin1")
    arrays.write_array(arrays.placed(cells, axes, shape, fortran, value), path, number, math.prod(shape), head)
