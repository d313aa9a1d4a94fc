"""The shared folder, the cutting of lineage in iterations, and the dealing out of rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode alone, where that is unset, a folder of this machine."""
    global _own_dir
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own_dir = _own_dir or tempfile.mkdtemp(prefix="spark-sonolume-")
        base = _own_dir
    return base


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out to as many tasks as there are cores, by the keys: a small file is one task, whatever its rows cost."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)


def cut(df: DataFrame, name: str = "step", by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back; by: its last column, each value of which gets a folder of its own."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return stored_table(df.sparkSession, path, df.schema)


def stored_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table that cut has written; it knows its folder."""
    found = spark.read.schema(schema).parquet(path)
    found.cut_to = path
    return found


def cut_path(df: DataFrame) -> str | None:
    """The folder of a result of cut, None for any other table."""
    return df.__dict__.get("cut_to")


def cut_bucketed(df: DataFrame, key: str, name: str = "step", buckets: int | None = None) -> DataFrame:
    """As cut, but as a table bucketed and sorted by ``key``: joins and sums by it need no exchange of these rows.

    buckets: by default as many as shuffle partitions; tables to be joined without exchange need the same number.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", f"{shared_folder(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def discard(df: DataFrame) -> None:
    """Delete the files of a result of cut (or of columns of it) that nothing reads any more."""
    spark = df.sparkSession
    path = cut_path(df)
    if path is None:
        found = df.inputFiles()
        path = found[0].rsplit("/", 1)[0] if found else None
    if path is not None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
