"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that separates words throughout this subpackage.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; in local mode alone, where that is unset, a folder of this machine."""
    global _own_dir
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="spark-sonolume-")
    return _own_dir


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there and no executor holds the only copy."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a result of materialize that nothing reads any more."""
    spark = df.sparkSession
    found = df.inputFiles()
    if found:
        folder = spark._jvm.org.apache.hadoop.fs.Path(found[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name for F.col, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def word_array(text: Column) -> Column:
    """Words (maximal runs of non-white-space) of a text; null and blank texts give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS))


def count_words(batches):
    """mapInArrow over one binary column of texts: word (A-Z in lower case), freq; many partial counts, of bounded memory."""
    seen: Counter = Counter()

    def flush():
        out = pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "freq"])
        seen.clear()
        return out

    for batch in batches:
        for text in batch.column(0):
            seen.update((text.as_py() or b"").lower().split())
            if len(seen) > 250_000:
                yield flush()
    if seen:
        yield flush()


def common_floor(total: int, most: int) -> float:
    """The share of ``total`` occurrences that a word needs to be among the ``most`` commonest: a hundredth of an equal one.

    At most 100 * most words have it, so the task that picks the commonest reads no more, however many partitions there are.
    """
    return total / (100 * most)


def row_keys(batches, start: int):
    """Number the rows of one task: yields (batch, first key), keys being unique over all tasks."""
    for batch in batches:
        yield batch, start
        start += batch.num_rows


def first_row_key() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 40


def group_ranks(df: DataFrame, group: str, spread: Column, order: list[str], pieces: int) -> DataFrame:
    """Add ``rank`` (long, gapless from 0) within each value of ``group``.

    Each group is cut into ``pieces`` by the hash ``spread`` and only a piece is ever sorted in one task, so a group may
    hold most of the rows. ``order`` names columns that settle the order inside a piece.
    """
    cut = df.withColumn("_piece", F.pmod(spread, F.lit(pieces)).cast("int"))
    counts = cut.groupBy(F.col(group).alias("_group"), F.col("_piece").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_group").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = cut.join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_piece") == F.col("_p")))
    place = F.row_number().over(Window.partitionBy(group, "_piece").orderBy(*order)) - 1
    return joined.withColumn("rank", place + F.col("_offset")).drop("_piece", "_group", "_p", "_offset")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the edge list; component is the smallest node reachable.

    Alternating large-star and small-star contraction: every round joins edges with per-node minima, so that a node with
    a very large degree is spread by the shuffle join's skew handling and never gathered into one group. Rounds go on until
    a round leaves the edges as they were. Nodes are long or string; null ends and loops are ignored. An empty edge list
    gives no rows.
    """
    pairs = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    ).distinct()
    pairs = materialize(pairs, "cc")
    digest = None
    while True:
        seen = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo") % 1_000_003), F.sum(F.xxhash64("lo", "hi") % 998_244_353)).first()
        if seen == digest or seen[0] == 0:
            break
        digest = seen
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.where(F.col("hi") != F.col("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(low, "hi")
        small = joined.select(F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        spent, pairs = pairs, materialize(small.select("e.hi", "e.lo").where(F.col("hi") != F.col("lo")).distinct(), "cc")
        discard(spent)
    labels = pairs.groupBy("hi").agg(F.min("lo").alias("component")).select(F.col("hi").alias("node"), "component")
    roots = labels.select(F.col("component").alias("node"), "component").distinct()
    return labels.unionByName(roots)
