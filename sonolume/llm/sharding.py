"""Consistent-hash sharding with virtual nodes and bounded loads."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Ring positions are the upper 60 bits of xxhash64.
RING_BITS = 60


def ring_position(*cols):
    return F.shiftrightunsigned(F.xxhash64(*cols), 64 - RING_BITS)


def _virtual_nodes(spark, shards: int, virtual: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node in ring order; hashed by Spark, shards * virtual rows."""
    rows = spark.range(shards * virtual).select(
        (F.col("id") / F.lit(virtual)).cast("int").alias("shard"),
        ring_position(F.concat_ws(":", F.lit("node"), F.col("id").cast("string"))).alias("position"),
    ).collect()
    return sorted((r["position"], r["shard"]) for r in rows)


def _walk(nodes, cumulative_at, total: int, shards: int) -> list[tuple[int, int, int, int]]:
    """Segments (first rank, end rank, shard, first slot) of keys in ring order.

    Every virtual node takes the waiting keys (its own arc's and those that overflowed before it) until its shard is full;
    the rest goes on clockwise. Capacities are floor or ceil of total / shards and add up to total.
    """
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    segments, taken = [], 0
    for lap in range(2):
        for position, shard in nodes:
            waiting = (total if lap else cumulative_at(position)) - taken
            n = min(waiting, room[shard])
            if n > 0:
                segments.append((taken, taken + n, shard, filled[shard]))
                taken, room[shard], filled[shard] = taken + n, room[shard] - n, filled[shard] + n
    return segments


def _crowded_positions(spark, placed: DataFrame, arcs: list[tuple[int, int]], least: int) -> dict[int, int]:
    """Ring positions (h) with more than ``least`` rows in these arcs, and their rows. Fewer than all rows / least of them exist."""
    if not arcs:
        return {}
    crowded = spark.createDataFrame(arcs, "cell long, arc int")
    found = placed.join(F.broadcast(crowded), ["cell", "arc"], "left_semi").groupBy("h").count().where(F.col("count") > least)
    return {r["h"]: r["count"] for r in found.collect()}


def bounded_ring_shards(docs: DataFrame, shards: int = 24, virtual: int = 64, cells: int = 4096, crowd: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of ``shards`` shards: a ring with ``virtual`` nodes a shard, counts at most one apart (law ``rows``).

    Keys lie on the ring by the hash of their id and go clockwise to the next virtual node whose shard has room. Only key
    counts of arcs (between neighbouring virtual nodes, ring cells and positions with very many rows: a bounded number)
    reach the driver; the walk over them gives contiguous segments of the ring order, and each row finds its segment by
    its rank: its arc's offset and its place in its arc. A repeated or null id is one ring position. Where it holds more
    rows than ``crowd`` and than a ring cell on the average it is an arc of its own, whose rows are numbered once in a
    written table and ranked in pieces.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null under law ``rows``).
    Null text: size 8, CRC of the empty string. Null id: a key like any other. Repeated rows: one slot each. Texts of any
    length are read whole. Empty: no rows.
    """
    spark = docs.sparkSession
    nodes = _virtual_nodes(spark, shards, virtual)
    bits = RING_BITS - (cells - 1).bit_length()
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    cuts: dict[int, set[int]] = {}
    for p, _ in nodes:
        cuts.setdefault(p >> bits, set()).add(p)

    def in_arcs(rows: DataFrame) -> DataFrame:
        """Add cell and arc: the cuts inside a cell part it into arcs, arc a holds the keys after cut a - 1, up to cut a."""
        inside = spark.createDataFrame([(c, sorted(ps)) for c, ps in cuts.items()], "cell long, cuts array<long>")
        placed = rows.withColumn("cell", F.shiftright("h", bits)).join(F.broadcast(inside), "cell", "left")
        return placed.withColumn("arc", F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda p: p < F.col("h"))))).drop("cuts")

    def arc_counts() -> dict[tuple[int, int], int]:
        return {(r["cell"], r["arc"]): r["count"] for r in in_arcs(docs.select(ring_position(key).alias("h"))).groupBy("cell", "arc").count().collect()}

    counts = arc_counts()
    total = sum(counts.values())
    most = max(crowd, 4 * total // cells)
    hot = _crowded_positions(spark, in_arcs(docs.select(ring_position(key).alias("h"))), [a for a, n in counts.items() if n > most], most // 4)
    for h in hot:
        cuts.setdefault(h >> bits, set()).update(p for p in (h - 1, h) if p >> bits == h >> bits)
    if hot:
        counts = arc_counts()

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), ring_position(key).alias("h")
    )
    if hot:
        # Numbered rows are written: a task that runs again finds the same numbers.
        pieces = spark.createDataFrame([(h, n // (most // 4 + 1) + 1) for h, n in hot.items()], "h long, pieces long")
        numbered = materialize(in_arcs(rows).withColumn("number", F.monotonically_increasing_id()), "ring")
        rows = numbered.join(F.broadcast(pieces), "h", "left").withColumn("piece", F.coalesce(F.pmod("number", "pieces"), F.lit(0)))
        split = rows.where("pieces is not null").groupBy("cell", "arc", "piece").count().collect()
        by_piece = {(r["cell"], r["arc"], r["piece"]): r["count"] for r in split}
        parted = {k[:2] for k in by_piece}
        by_piece |= {(c, a, 0): n for (c, a), n in counts.items() if (c, a) not in parted}
    else:
        rows = in_arcs(rows).withColumn("piece", F.lit(0).cast("long"))
        by_piece = {(c, a, 0): n for (c, a), n in counts.items()}

    names, starts, taken = sorted(by_piece), [], 0
    for name in names:
        starts.append(taken)
        taken += by_piece[name]
    in_order = {cell: sorted(ps) for cell, ps in cuts.items()}

    def cumulative_at(position: int) -> int:
        """Keys at or before a virtual node: whole arcs up to the one that the node ends."""
        cell = position >> bits
        i = bisect.bisect_left(names, (cell, bisect.bisect_left(in_order[cell], position) + 1, 0))
        return starts[i] if i < len(starts) else total

    segments = _walk(nodes, cumulative_at, total, shards)
    ends = [s[1] for s in segments]
    plan = []
    for name, first in zip(names, starts):
        lo, hi = bisect.bisect_right(ends, first), bisect.bisect_left(ends, first + by_piece[name])
        plan.append((*name, first, segments[lo : hi + 1]))
    plan_df = spark.createDataFrame(plan, "cell long, arc int, piece long, first long, segments array<struct<lo:long,hi:long,shard:int,slot:long>>")
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("cell", "arc", "piece").orderBy("h", "doc_id", "size", "text_crc32")) - 1)
    return (
        ranked.join(F.broadcast(plan_df), ["cell", "arc", "piece"])
        .withColumn("at", F.col("first") + F.col("place"))
        .withColumn("s", F.element_at(F.filter("segments", lambda s: (s["lo"] <= F.col("at")) & (F.col("at") < s["hi"])), 1))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("s.shard").alias("shard"), (F.col("s.slot") + F.col("at") - F.col("s.lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
