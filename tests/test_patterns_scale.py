"""Patterns by the hundred thousand: what the steps cost a row, and short strings."""

import time

import pytest

from pyspark.sql import functions as F

from sonolume.plans import catalogue
from sonolume.functions import fourier, patterns


def test_dominant_bin_of_short_and_mixed_strings(spark):
    rows = [("",), ("0",), ("1",), ("10",), ("110",), ("0000",), ("1111",), ("1100" * 4,), ("10" * 8,), ("1" * 8 + "0" * 8,), (None,)]
    found = spark.createDataFrame(rows, "b string").select(fourier.dominant_bin(F.col("b")).alias("bin"))
    assert [r["bin"] for r in found.collect()] == [0, 0, 0, 0, 0, 1, 0, 4, 1, 1, None]


def test_dominant_bin_is_cheap_a_row(spark):
    codes = spark.range(4000).select(F.substring(F.md5(F.col("id").cast("string")), 1, 12).alias("c")).select(patterns.hex_to_bits(F.col("c"), 48).alias("b"))
    began = time.time()
    assert codes.agg(F.max(fourier.dominant_bin(F.col("b")))).first()[0] <= 23
    assert time.time() - began < 15


def test_digits_and_bits_of_any_length(spark):
    codes = spark.createDataFrame([("0f",), ("Gg",), ("1 0\na",), ("h",), ("",), (None,)], "c string").select(patterns.hex_to_bits(F.col("c"), 12).alias("b"))
    assert [r["b"] for r in codes.collect()] == ["000011110000", "0" * 12, "000100001010", "0" * 12, "0" * 12, "0" * 12]
    bits = spark.createDataFrame([("",), ("1",), ("00011111",), ("0" * 9,), (None,)], "b string").select(patterns.bits_to_hex(F.col("b")).alias("c"))
    assert [r["c"] for r in bits.collect()] == ["", "8", "1f", "000", None]


def test_mirrored_codes_are_cheap_a_row(spark):
    codes = spark.range(100000).select(F.substring(F.md5(F.col("id").cast("string")), 1, 12).alias("c"))
    turned = patterns.bits_to_hex(patterns.mirrored(patterns.hex_to_bits(F.col("c"), 48)))
    began = time.time()
    assert codes.where(F.length(turned) != 12).count() == 0
    assert time.time() - began < 8


@pytest.mark.parametrize("name", ["pattern_mirror", "pattern_bits", "pattern_frequency", "pattern_phase"])
def test_rows_of_one_small_file_are_dealt_to_all_cores(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
