"""Exact dedup: Misra-Gries finds frequent digests, whose rows are settled against a broadcast table; the others are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, materialize, quoted

#: A digest of more than this share of all rows is certain to be found frequent; at most 1 / SUPPORT digests are.
SUPPORT = 1e-3


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row (different for each row), digest (SHA-256 of the normalised text, 32 bytes)."""
    text = F.regexp_replace(F.coalesce(F.col(quoted(text_col)), F.lit("")), SPACE_CLASS, " ")
    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(text, 256)).alias("digest"))


def _groups(rows: DataFrame) -> DataFrame:
    """digest, group_size and the keeper: the smallest id, null ids last, of rows with one id the first."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    grouped = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), first.alias("keeper"))
    return grouped.select("digest", "group_size", F.col("keeper.doc_id").alias("keep_id"), F.col("keeper.row").alias("keep_row"))


def exact_duplicates(docs: DataFrame, support: float = SUPPORT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row: texts are equal if they are so after replacing each run of white space by one space.

    The Misra-Gries summary (Spark's freqItems, 1 / support counters a task, merged) holds every digest of more than
    support x rows; those in it are counted exactly, and the ones that are so frequent (1 / support at most) are broadcast
    with their keepers: their rows, however many, are answered where they are read. The rest is grouped by digest with
    partial counts, and only groups of two rows or more are joined back to their rows.

    Null text counts as empty. Of equal texts exactly one row stays: the one with the smallest id, null ids last; of rows
    that repeat an id too, the first written. A group of null ids alone has a null keep_id. Ids are read as longs. Texts
    of any length are hashed whole. Other columns of any name are not read. Empty table: no rows.
    """
    # Written: every pass below sees the same row numbers, also where a task runs again.
    keys = materialize(_keyed(docs, id_col, text_col), "digests")
    found = keys.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    counted = _groups(keys.join(F.broadcast(found), "digest", "left_semi"))
    frequent = materialize(counted.where(F.col("group_size") > support * keys.count()), "frequent")
    rest = keys.join(F.broadcast(frequent.select("digest")), "digest", "left_anti")
    # Written, so that the join deals out both sides anew and can split what is still large.
    several = materialize(_groups(rest).where("group_size > 1"), "several")
    answered = keys.join(F.broadcast(frequent), "digest").unionByName(
        rest.join(several.hint("shuffle_merge"), "digest", "left"), allowMissingColumns=True
    )
    kept = F.col("keep_row").isNull() | (F.col("row") == F.col("keep_row"))
    return answered.select(
        "doc_id", F.when(F.col("keep_row").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
