"""Best-fit packing into bins of several permitted lengths."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import group_ranks, materialize, word_array

CAPACITIES = (512, 1024, 2048, 4096, 8192)


def attention_cost(capacity: int) -> float:
    """Cost of one bin: linear in its length, with a quadratic part that equals the linear one at 32768, and a fixed part."""
    return 16 + capacity * (1 + capacity / 32768)


def plan_bins(histogram: dict[int, int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = attention_cost) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(capacity, number of bins, [(length, pieces of it in each bin)]) for a histogram of lengths up to the largest capacity.

    Each step takes the longest length left and fills a bin of every permitted size with the best fit: the longest piece
    that the remaining room holds, again and again. The size with the least cost a token (each bin downsized to the
    smallest permitted size that holds its contents) is opened, as often as the counts allow. A step uses a length up,
    so there are at most as many steps as lengths, whatever the number of pieces.
    """
    capacities = sorted(capacities)
    left = {n: c for n, c in histogram.items() if c > 0}
    alive = sorted(left)
    plan = []
    while alive:
        longest = alive[-1]
        best = None
        for capacity in capacities[bisect.bisect_left(capacities, longest) :]:
            room, uses, top = capacity, [], len(alive)
            while room and (top := bisect.bisect_right(alive, room, 0, top)):
                top -= 1
                n = alive[top]
                k = min(room // n, left[n])
                uses.append((n, k))
                room -= n * k
            size = capacities[bisect.bisect_left(capacities, capacity - room)]
            price = cost(size) / (capacity - room)
            if best is None or price < best[0]:
                best = price, size, uses
        _, size, uses = best
        times = min(left[n] // k for n, k in uses)
        plan.append((size, times, uses))
        for n, k in uses:
            left[n] -= k * times
            if not left[n]:
                del alive[bisect.bisect_left(alive, n)]
    return plan


def pack(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = attention_cost, length: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, bin, capacity, offset.

    length: tokens of a row (default: words and one end token). Documents beyond the largest capacity are cut into pieces.
    The driver sees the histogram of lengths alone (as many numbers as the largest capacity); its plan says, for each
    length, which bins take which ranks. Pieces of one length are ranked in hashed cuts, so a very common length, or one id on many rows, is spread.
    Null and blank texts: length 1. Repeated rows: packed once each. Empty table: no rows.
    """
    spark = docs.sparkSession
    most = max(capacities)
    tokens = length if length is not None else F.size(word_array(F.col(text_col))) + 1
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(tokens.cast("long"), F.lit(1)).alias("n"))
    pieces = sized.select("doc_id", "n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(most).cast("long"))).alias("piece", "start"))
    pieces = materialize(pieces.select("doc_id", "piece", "start", F.least(F.lit(most), F.col("n") - F.col("start")).cast("int").alias("length"), F.monotonically_increasing_id().alias("key")), "lengths")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    ranges: dict[int, list] = {}
    taken: dict[int, int] = {}
    bins = 0
    for size, times, uses in plan_bins(histogram, capacities, cost):
        at = 0
        for n, k in uses:
            first = taken.get(n, 0)
            ranges.setdefault(n, []).append((first, first + k * times, bins, k, at, size))
            taken[n], at = first + k * times, at + n * k
        bins += times
    plan = spark.createDataFrame(sorted(ranges.items()), "length int, ranges array<struct<lo:long,hi:long,bin:long,k:int,at:int,size:int>>")
    total = sum(histogram.values())
    ranked = group_ranks(pieces, "length", F.xxhash64("key"), ["doc_id", "piece", "key"], 64 + total // 100_000)
    placed = ranked.join(F.broadcast(plan), "length").withColumn("r", F.element_at(F.filter("ranges", lambda r: (r["lo"] <= F.col("rank")) & (F.col("rank") < r["hi"])), 1))
    place = F.col("rank") - F.col("r.lo")
    return placed.select(
        "doc_id", "piece", "start", "length", (F.col("r.bin") + F.floor(place / F.col("r.k"))).alias("bin"), F.col("r.size").alias("capacity"),
        (F.col("r.at") + (place % F.col("r.k")) * F.col("length")).cast("int").alias("offset"),
    )
