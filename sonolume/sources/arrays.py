"""Arrays inside one file: tasks read and write byte ranges of it, wherever the file lies."""

from __future__ import annotations

import base64
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, InputPartition, WriterCommitMessage

#: Values in one batch of a task, and in one task.
BATCH, TASK = 1 << 17, 1 << 22
#: Absent values between neighbours at most that a task writes as zeros instead of beginning a new run.
GAP = 64


def located(spark: SparkSession, path: str) -> str:
    """The path with its scheme, resolved as Spark's own readers do: without one it lies on the default file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    if whole.startswith("file:/") and not whole.startswith("file://"):
        return "file://" + whole[5:]
    return "s3" + whole[3:] if whole.startswith(("s3a://", "s3n://")) else whole


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def open_input(uri: str):
    files, at = file_system(uri)
    return files.open_input_file(at)


class Range(InputPartition):
    """Values from first to end (excluded) of an array; what names the array where a file has several."""

    def __init__(self, first: int, end: int, what=None):
        self.first, self.end, self.what = first, end, what


def ranges(total: int, what=None, task: int = TASK) -> list[Range]:
    return [Range(k, min(k + task, total), what) for k in range(0, total, task)]


def strides(shape, fortran: bool) -> list[int]:
    """Values between neighbours along each axis."""
    return [math.prod(shape[:k] if fortran else shape[k + 1 :]) for k in range(len(shape))]


def indices(axes: list[str], shape, fortran: bool, position: str = "position") -> list[Column]:
    """The place along each axis of the value at a position."""
    return [F.expr(f"({position} div {max(s, 1)}) % {max(n, 1)}").alias(a) for a, n, s in zip(axes, shape, strides(shape, fortran))]


def position_of(axes: list[str], shape, fortran: bool) -> Column:
    """The position of the value at a place; a place outside the array is an error."""
    total, inside = F.lit(0).cast("long"), F.lit(True)
    for a, n, s in zip(axes, shape, strides(shape, fortran)):
        total, inside = total + F.col(a) * F.lit(s), inside & (F.col(a) >= 0) & (F.col(a) < n)
    return F.when(inside, total).otherwise(F.raise_error(F.lit(f"a value lies outside the array of shape {tuple(shape)}")).cast("long"))


def batch_of(first: int, re: np.ndarray, im: np.ndarray | None = None, **more) -> pa.RecordBatch:
    """(what is in more.., position, re, im) of values in a row; imaginary parts may be in ``re`` already."""
    n = len(re)
    columns = {**{k: pa.repeat(v, n) for k, v in more.items()}, "position": np.arange(first, first + n), "re": re.real.astype(float), "im": re.imag.astype(float) if im is None else im.astype(float)}
    return pa.RecordBatch.from_arrays([pa.array(c) if not isinstance(c, pa.Array) else c for c in columns.values()], list(columns))


class _Written(WriterCommitMessage):
    """What a task wrote: its first and last position and how many there are."""

    def __init__(self, first: int, last: int, count: int, name: str | None):
        self.first, self.last, self.count, self.name = first, last, count, name


class _Writer(DataSourceArrowWriter):
    """Where files can be written anywhere inside (scheme file, a folder that all executors share), tasks put their values
    in place in one hidden file that the commit renames; a repeated task writes the same bytes again. Elsewhere each task
    writes a part, and the commit copies the parts one after the other. After a failure neither is left."""

    def __init__(self, options):
        self.uri, self.number, self.total = options["path"], np.dtype(options["number"]), int(options["total"])
        self.head, self.foot = base64.b64decode(options["head"]), base64.b64decode(options["foot"])
        files, at = file_system(self.uri)
        self.at, self.in_place = at, self.uri.startswith("file://")
        folder, _, name = at.rpartition("/")
        files.create_dir(folder, recursive=True)
        self.hidden = f"{folder}/_{name}-{uuid.uuid4().hex}"
        if self.in_place:
            with open(self.hidden, "wb") as f:
                f.write(self.head)
                f.truncate(len(self.head) + self.total * self.number.itemsize)
                f.seek(0, 2)
                f.write(self.foot)

    def write(self, iterator):
        from pyspark import TaskContext

        size, name, first, last, count = self.number.itemsize, None, None, -1, 0
        if self.in_place:
            out = open(self.hidden, "r+b")
        else:
            task = TaskContext.get()
            name = f"{self.hidden}-{task.partitionId()}-{task.taskAttemptId()}"
            out = file_system(self.uri)[0].open_output_stream(name)
        with out:
            for batch in iterator:
                position = batch.column(0).to_numpy(zero_copy_only=False)
                re, im = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
                values = (re + 1j * im if self.number.kind == "c" else np.rint(re) if self.number.kind in "iu" else re).astype(self.number)
                if not len(position):
                    continue
                # Rows are sorted within tasks, and tasks hold ranges: equal positions are neighbours.
                if position[0] == last or (np.diff(position) == 0).any():
                    raise ValueError(f"{self.uri}: a position is given twice")
                first, last, count = int(position[0]) if first is None else first, int(position[-1]), count + len(position)
                if not self.in_place:
                    out.write(values.tobytes())
                    continue
                cuts = np.flatnonzero(np.diff(position) > GAP) + 1
                for a, b in zip([0, *cuts], [*cuts, len(position)]):
                    # No other task has places between those of this one, and zero is what the file holds there.
                    run = np.zeros(position[b - 1] - position[a] + 1, self.number)
                    run[position[a:b] - position[a]] = values[a:b]
                    out.seek(len(self.head) + int(position[a]) * size)
                    out.write(run.tobytes())
        return _Written(-1 if first is None else first, last, count, name)

    def commit(self, messages):
        files, _ = file_system(self.uri)
        done = sorted((m for m in messages if m is not None and m.count), key=lambda m: m.first)
        if any(a.last >= b.first for a, b in zip(done, done[1:])):
            raise ValueError(f"{self.uri}: a position is given twice")
        if self.in_place:
            files.move(self.hidden, self.at)
            return
        if sum(m.count for m in done) != self.total:
            raise ValueError(f"{self.uri}: on this file system every position must be given")
        with files.open_output_stream(self.at) as out:
            out.write(self.head)
            for m in done:
                with files.open_input_stream(m.name) as part:
                    while piece := part.read(1 << 23):
                        out.write(piece)
            out.write(self.foot)
        self._drop(files, [m.name for m in messages if m is not None])

    def abort(self, messages):
        files, _ = file_system(self.uri)
        self._drop(files, [self.hidden] if self.in_place else [m.name for m in messages if m is not None])

    def _drop(self, files, names):
        for name in names:
            if files.get_file_info(name).type.name != "NotFound":
                files.delete_file(name)


class ArrayFile(DataSource):
    """Sink of (position long, re double, im double): one file of a head, ``total`` numbers in the order of position, and a foot."""

    @classmethod
    def name(cls):
        return "sonolume_array"

    def schema(self):
        return "position long, re double, im double"

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def write_array(values: DataFrame, path: str, number: str, total: int, head: bytes, foot: bytes = b"") -> None:
    """values (position, re, im) into one file, sorted by ranges of positions; a position without a value is zero. The file must not exist."""
    spark, uri = values.sparkSession, located(values.sparkSession, path)
    files, at = file_system(uri)
    if files.get_file_info(at).type.name != "NotFound":
        raise ValueError(f"{uri} exists")
    spark.dataSource.register(ArrayFile)
    ordered = values.select(F.col("position").cast("long").alias("position"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im")).repartitionByRange("position").sortWithinPartitions("position")
    options = {"number": number, "total": str(total), "head": base64.b64encode(head).decode(), "foot": base64.b64encode(foot).decode()}
    ordered.write.format("sonolume_array").options(**options).mode("append").save(uri)


def placed(cells: DataFrame, axes: list[str], shape, fortran: bool, value: str) -> DataFrame:
    """(position, re, im) of cells (axes.., value), or (axes.., re, im) where there is no column of that name."""
    re, im = (F.col(value), F.lit(0.0)) if value in cells.columns else (F.col("re"), F.col("im"))
    return cells.select(position_of(axes, shape, fortran).alias("position"), re.alias("re"), im.alias("im"))
