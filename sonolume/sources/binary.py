"""Binary formats of fixed-length records: list mode (pattern, angle, samples) and Interfile images (header and pixels).

Tasks read ranges of records and decode their own. Writing gives one data file a task, in order: the
records of all files, one after the other, are the format's single data file.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, WriterCommitMessage

from . import arrays

#: Names of number formats in headers.
NUMBERS = {"short float": "f4", "float": "f4", "int16": "i2", "int32": "i4", "uint16": "u2", "uint8": "u1"}
PATTERN_BYTES = 24


def header(spark: SparkSession, path: str, separator: str) -> dict[str, str]:
    """Keys (lower case, without marks) and values of a text header of at most some hundred lines."""
    found = {}
    for row in spark.read.text(path, wholetext=True).collect():
        for line in row.value.splitlines():
            if separator in line:
                key, value = line.split(separator, 1)
                found[key.strip().lower().replace("!", "")] = value.strip()
    return found


class _Records(DataSourceReader):
    def __init__(self, uri: str, size: int, task: int):
        self.uri, self.size, self.task = uri, size, task

    def partitions(self):
        from pyarrow import fs

        files, at = arrays.file_system(self.uri)
        if files.get_file_info(at).type == fs.FileType.Directory:
            found = sorted((f.base_name, f.path, f.size) for f in files.get_file_info(fs.FileSelector(at)) if f.is_file and not f.base_name.startswith(("_", ".")))
        else:
            found = [("", at, files.get_file_info(at).size)]
        out, before = [], 0
        for _, path, size in found:
            if size % self.size:
                raise ValueError(f"{path} has {size} bytes: these are no whole records of {self.size}")
            several = max(1, self.task // self.size)
            out += [arrays.Range(k, min(k + several, size // self.size), (path, before)) for k in range(0, size // self.size, several)]
            before += size // self.size
        return out or [arrays.Range(0, 0)]

    def read(self, partition):
        if partition.what is None:
            return
        path, before = partition.what
        several = max(1, (1 << 23) // self.size)
        with arrays.file_system(self.uri)[0].open_input_file(path) as f:
            for k in range(partition.first, partition.end, several):
                n = min(several, partition.end - k)
                raw = pa.py_buffer(f.read_at(n * self.size, k * self.size))
                fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(self.size), n, [None, raw])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(before + k, before + k + n)), fixed.cast(pa.binary())], ["n", "record"])


class RecordFiles(DataSource):
    """Rows (n long, record binary) of a file or a folder of files of records of one size, numbered in the order of the files' names."""

    @classmethod
    def name(cls):
        return "sonolume_records"

    def schema(self):
        return "n long, record binary"

    def reader(self, schema):
        return _Records(self.options["path"], int(self.options["size"]), int(self.options["task"]))


def records(spark: SparkSession, path: str, size: int, task: int = 1 << 26) -> DataFrame:
    """(n, record): tasks read ranges of about ``task`` bytes. A file that is not whole records fails."""
    spark.dataSource.register(RecordFiles)
    return spark.read.format("sonolume_records").options(size=str(size), task=str(task)).load(arrays.located(spark, path))


class _Writer(DataSourceArrowWriter):
    """One file a task, renamed into place by the commit; a failed or repeated task leaves only unused files."""

    def __init__(self, options):
        self.uri, self.run = options["path"], uuid.uuid4().hex

    def write(self, iterator):
        from pyspark import TaskContext

        task = TaskContext.get()
        files, root = arrays.file_system(self.uri)
        name = f"{root}/_{self.run}-{task.partitionId():06d}-{task.taskAttemptId()}"
        files.create_dir(root, recursive=True)
        with files.open_output_stream(name) as out:
            for batch in iterator:
                for record in batch.column(0):
                    out.write(record.as_buffer())
        return _Part(name, f"{root}/part-{task.partitionId():06d}.bin")

    def commit(self, messages):
        files, _ = arrays.file_system(self.uri)
        for m in messages:
            if m is not None:
                files.move(m.name, m.final)

    def abort(self, messages):
        files, _ = arrays.file_system(self.uri)
        for m in messages:
            if m is not None:
                files.delete_file(m.name)


class _Part(WriterCommitMessage):
    def __init__(self, name, final):
        self.name, self.final = name, final


class BinaryFiles(DataSource):
    """Sink of a table (record binary): the bytes of the rows, in their order. The path is one that all executors share."""

    @classmethod
    def name(cls):
        return "sonolume_binary"

    def schema(self):
        return "record binary"

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def write_records(rows: DataFrame, order: str, path: str) -> None:
    spark = rows.sparkSession
    spark.dataSource.register(BinaryFiles)
    rows.repartitionByRange(order).sortWithinPartitions(order).select("record").write.format("sonolume_binary").mode("append").save(arrays.located(spark, path))


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A short header as one text file in a folder."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def write_listmode(signals: DataFrame, scans: DataFrame, folder: str, t_size: int, rate: float, elements: int) -> None:
    """signals (n, t, y) and scans (n, code, angle) as folder/data and folder/header. Missing samples are zero; a record is one acquisition."""
    packed = signals.groupBy("n").agg(F.map_from_entries(F.collect_list(F.struct(F.col("t").cast("int"), F.col("y").cast("double")))).alias("samples"))
    whole = scans.select("n", F.rpad(F.lower("code"), 2 * PATTERN_BYTES, "0").alias("code"), F.col("angle").cast("int").alias("angle")).join(packed, "n", "left")
    dense = whole.withColumn("samples", F.transform(F.sequence(F.lit(0), F.lit(t_size - 1)), lambda t: F.coalesce(F.try_element_at("samples", t), F.lit(0.0))))

    def encode(batches):
        for batch in batches:
            out = [bytes.fromhex(c) + np.int8(a).tobytes() + np.asarray(s, dtype="<f4").tobytes() for c, a, s in zip(batch["code"], batch["angle"], batch["samples"])]
            yield pd.DataFrame({"n": batch["n"], "record": out})

    count = scans.count()
    write_records(dense.mapInPandas(encode, "n long, record binary"), "n", f"{folder}/data")
    lines = ("Data filename: data", f"Number of events: {count}", f"Number of acquisitions per event: {t_size}", "Start time (s): 0", "Duration (s): 1", f"Acquisition frequency (Hz): {rate}", "Data mode: histogram", "Data type: AOT", f"Number of US transducers: {elements}")
    write_text(scans.sparkSession, "\n".join(lines), f"{folder}/header")


def read_listmode(spark: SparkSession, data: str, header_path: str) -> DataFrame:
    """(n, code, angle, t, y)."""
    about = header(spark, header_path, ":")
    t_size = int(about["number of acquisitions per event"])

    def decode(batches):
        for batch in batches:
            raw = batch["record"].tolist()
            yield pd.DataFrame({
                "n": batch["n"], "code": [bytes(r[:PATTERN_BYTES]).hex() for r in raw], "angle": [int(np.frombuffer(r, "i1", 1, PATTERN_BYTES)[0]) for r in raw],
                "samples": [np.frombuffer(r, "<f4", t_size, PATTERN_BYTES + 1).astype(float) for r in raw],
            })

    rows = records(spark, data, PATTERN_BYTES + 1 + 4 * t_size).mapInPandas(decode, "n long, code string, angle int, samples array<double>")
    return rows.select("n", "code", "angle", F.posexplode("samples").alias("t", "y"))


def write_image(field: DataFrame, folder: str, t_size: int, z_size: int, x_size: int, dx_mm: float = 1.0, dz_mm: float = 1.0, dt: float = 1.0) -> None:
    """Field (t, z, x, value) as 32-bit floats, x fastest, with an Interfile header. A record is one line of pixels; missing pixels are zero."""
    packed = field.groupBy((F.col("t") * z_size + F.col("z")).cast("long").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("x").cast("int"), F.col("value").cast("double")))).alias("v"))
    lines = field.sparkSession.range(t_size * z_size).withColumnRenamed("id", "n").join(packed, "n", "left")
    dense = lines.select("n", F.transform(F.sequence(F.lit(0), F.lit(x_size - 1)), lambda x: F.coalesce(F.try_element_at("v", x), F.lit(0.0))).alias("v"))

    def encode(batches):
        for batch in batches:
            yield pd.DataFrame({"n": batch["n"], "record": [np.asarray(v, dtype="<f4").tobytes() for v in batch["v"]]})

    write_records(dense.mapInPandas(encode, "n long, record binary"), "n", f"{folder}/data")
    pairs = {
        "!INTERFILE": "", "!name of data file": "data", "!imagedata byte order": "LITTLEENDIAN", "number of dimensions": 3, "!matrix size [1]": x_size, "!matrix size [2]": z_size, "!matrix size [3]": t_size,
        "!number format": "short float", "!number of bytes per pixel": 4, "scaling factor (mm/pixel) [1]": dx_mm, "scaling factor (mm/pixel) [2]": dz_mm, "scaling factor (s/pixel) [3]": dt, "data rescale slope": 1, "data rescale offset": 0,
    }
    write_text(field.sparkSession, "\n".join(f"{k} := {v}" for k, v in pairs.items()), f"{folder}/header")


def read_image(spark: SparkSession, data: str, header_path: str) -> DataFrame:
    """(t, z, x, value) with the header's slope and offset; one line of pixels is one record. A file that is not whole lines fails."""
    about = header(spark, header_path, ":=")
    x_size, z_size = int(about["matrix size [1]"]), int(about["matrix size [2]"])
    kind = NUMBERS[about.get("number format", "short float").lower()]
    number = np.dtype(("<" if "little" in about.get("imagedata byte order", "LITTLEENDIAN").lower() else ">") + kind)
    slope, offset = float(about.get("data rescale slope", 1)), float(about.get("data rescale offset", 0))

    def decode(batches):
        for batch in batches:
            yield pd.DataFrame({"n": batch["n"], "v": [np.frombuffer(bytes(r), number).astype(float) * slope + offset for r in batch["record"]]})

    lines = records(spark, data, x_size * number.itemsize).mapInPandas(decode, "n long, v array<double>")
    return lines.select(F.floor(F.col("n") / z_size).alias("t"), (F.col("n") % z_size).alias("z"), F.posexplode("v").alias("x", "value"))
