"""Scan lists as text, one scan a line: ``<hex>_<angle code>``, or ``((zeros, ones, head, tail), [angles])``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns

_TUPLE = r"^\(\s*\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)\s*,\s*\[([-+0-9,\s]*)\]\s*\)$"


def parse(lines: DataFrame, elements: int) -> DataFrame:
    """(line, code, angle, malformed) of a table (line): a row for each scan; blank lines go, malformed ones stay marked."""
    text = F.trim("line")
    part = lambda i: F.regexp_extract(text, _TUPLE, i)
    number = lambda i: part(i).try_cast("int")
    hexadecimal = text.rlike("^[0-9a-fA-F]*_")
    made = patterns.bits_to_hex(patterns.striped(number(1), number(2), number(3), number(4), elements))
    angles = F.transform(F.filter(F.split(part(5), ","), lambda a: F.trim(a) != ""), lambda a: F.trim(a).try_cast("int"))
    scans = (
        F.when(hexadecimal, F.array(F.struct(F.split(text, "_")[0].alias("code"), patterns.angle_of(text).cast("int").alias("angle"), F.lit(False).alias("malformed"))))
        .when(text.rlike(_TUPLE) & (number(1) + number(2) > 0), F.transform(angles, lambda a: F.struct(made.alias("code"), a.alias("angle"), F.lit(False).alias("malformed"))))
        .otherwise(F.array(F.struct(F.lit(None).cast("string").alias("code"), F.lit(None).cast("int").alias("angle"), F.lit(True).alias("malformed"))))
    )
    return lines.where(text != "").select("line", F.explode(scans).alias("s")).select("line", "s.*")


def read(spark: SparkSession, path: str, elements: int) -> DataFrame:
    return parse(spark.read.text(path).withColumnRenamed("value", "line"), elements)


def lines_of(scans: DataFrame) -> DataFrame:
    return scans.select(F.concat_ws("_", "code", patterns.angle_code(F.col("angle"))).alias("line"))


def write(scans: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lines in the order of n, over as many files as the sort has ranges."""
    lines_of(scans.orderBy("n") if "n" in scans.columns else scans).write.mode(mode).text(path)
