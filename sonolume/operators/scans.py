"""Tables of scans (n, code, angle) and what selects, orders, matches and mirrors them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns
from ..session import cut


def near_phases(scans: DataFrame, phases: list[float], column: str = "phase") -> DataFrame:
    """Scans whose phase is within 1e-3 (and 1e-5 of its size) of a wanted one."""
    return scans.where(F.exists(F.array(*map(F.lit, map(float, phases))), lambda p: F.abs(F.col(column) - p) <= 1e-3 + 1e-5 * F.abs(p)))


def having(scans: DataFrame, column: str, values: list) -> DataFrame:
    """Scans whose angle, decimation or other property is one of the values; renumber carries the choice over."""
    return scans.where(F.col(column).isin(values))


def named(scans: DataFrame, names: DataFrame) -> DataFrame:
    """Scans whose name stands in a table of names."""
    return scans.join(names.select("name"), "name", "left_semi")


def key_ranks(scans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rank: place of each distinct combination in their order from 0, that of the rows of a complex matrix. The
    combinations are as many as an acquisition has decimations and angles, whatever the samples."""
    distinct = scans.select(*keys).distinct()
    return distinct.withColumn("rank", F.row_number().over(Window.orderBy(*keys)) - 1)


def aligned(signals: DataFrame, fields: DataFrame) -> DataFrame:
    """Signals cut to the shortest length of the fields."""
    least = shortest_length(fields)
    return signals.join(F.broadcast(least), F.col("t") < F.col("length")).drop("length")


def shortest_length(fields: DataFrame) -> DataFrame:
    """(length,): samples of the shortest of the fields (n, t, ..)."""
    return fields.groupBy("n").agg((F.max("t") + 1).alias("size")).agg(F.min("size").alias("length"))


def mean_of_repeats(signals: DataFrame, first: int = 0, count: int | None = None) -> DataFrame:
    """(n, t, y): mean over the repeats (column repeat), of ``count`` from ``first`` on or of all."""
    if count is not None:
        signals = signals.where((F.col("repeat") >= first) & (F.col("repeat") < first + count))
    return signals.groupBy("n", "t").agg(F.avg("y").alias("y"))


def pick(scans: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """A random selection of the given size without replacement, fixed by the seed; Spark keeps ``count`` rows a task, then merges."""
    order = F.xxhash64(F.lit(seed), F.col("n"))
    return scans.orderBy(order, "n").limit(count)


def renumber(scans: DataFrame, others: list[DataFrame] = ()) -> tuple[DataFrame, list[DataFrame]]:
    """Numbers from 0 in the order of n, carried over to tables keyed by n; rows of dropped scans go.

    Numbers come from counts of ranges, so no task sees all scans: each range is numbered within itself and shifted by
    the ranges before it.
    """
    # Written once: the rows of a range and their count come from the same division.
    placed = cut(scans.select("n").distinct().repartitionByRange("n").withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.select("_part", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    ids = placed.join(F.broadcast(before), "_part").select("n", (F.col("_base") + F.row_number().over(Window.partitionBy("_part").orderBy("n")) - 1).alias("_new"))
    carry = lambda t: t.join(ids, "n").withColumn("n", F.col("_new")).drop("_new")
    return carry(scans), [carry(t) for t in others]


def order_by_stripes(scans: DataFrame) -> DataFrame:
    """Wide patterns first: by the sum, the larger and the first of zero and one runs, falling; then head and tail moves."""
    return scans.orderBy(F.desc(F.col("zeros") + F.col("ones")), F.desc(F.greatest("zeros", "ones")), F.desc("zeros"), F.desc("head"), F.asc("tail"))


def flipped(scans: DataFrame, elements: int) -> DataFrame:
    """(n, source, found): the scan whose pattern and angle mirror those of n; n itself where there is none. Repeats: the last one."""
    bits = patterns.hex_to_bits(F.col("code"), elements)
    asked = scans.select("n", patterns.bits_to_hex(patterns.mirrored(bits)).alias("code"), (-F.col("angle")).alias("angle"))
    have = scans.groupBy("code", "angle").agg(F.max("n").alias("m"))
    return asked.join(have, ["code", "angle"], "left").select("n", F.coalesce("m", "n").alias("source"), F.col("m").isNotNull().alias("found"))


def from_matrix(bits: DataFrame, angles: DataFrame, elements: int) -> DataFrame:
    """(n, code, angle) of an experiment's matrix of elements (i, n, value: 0 or 1) and its angles (n, angle).

    As a shift register takes them, the last element stands first: element i has the place value 2^i, and the code is the
    whole number in hexadecimal digits, four elements each. Digits are sums of place values, 48 elements in one column, so a
    scan's elements are never listed. An element that the matrix lacks is off; a scan without an angle, or an element
    beyond the probe, is an error.
    """
    wide, digits = 48, -(-elements // 4)
    i, on = F.col("i"), F.col("value") > 0
    known = F.when((i >= 0) & (i < elements), i).otherwise(F.raise_error(F.concat(F.lit("there is no element "), i.cast("string"))).cast("long"))
    place = F.pow(F.lit(2.0), known % wide).cast("long")
    words = [F.sum(F.when(on & (F.floor(known / wide) == w), place).otherwise(0)) for w in reversed(range(-(-elements // wide)))]
    code = F.concat(*(F.lpad(F.lower(F.hex(w)), wide // 4, "0") for w in words)).substr(len(words) * (wide // 4) - digits + 1, digits)
    named = bits.groupBy("n").agg(code.alias("code")).join(angles.select("n", "angle"), "n", "left")
    return named.select("n", "code", F.coalesce(F.col("angle").cast("int"), F.raise_error(F.concat(F.lit("no angle of scan "), F.col("n").cast("string"))).cast("int")).alias("angle"))


def flip_experiment(
    scans: DataFrame, signals: DataFrame, fields: DataFrame | None, elements: int, x_size: int, width: float, speed: float, flip_pattern: bool = True, flip_angle: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The experiment as a mirrored probe sees it: scans (n, code, angle, other columns, delays), signals (n, t, y), fields (n, t, z, x, value).

    flip_pattern mirrors every scan's code, turns the order of the signals (the list is its own mirror image, so the mirror
    of scan n is scan N - 1 - n) and mirrors the fields along x; a mirrored pattern keeps its frequency, so decimations stay.
    flip_angle turns the signs of the angles. Delays follow from the angles. Scans are numbered from 0 without gaps;
    a signal or field of any other number is an error, so that nothing is left behind. Twice is as before.
    """
    total = scans.count()
    if scans.where((F.col("n") >= 0) & (F.col("n") < total)).select("n").distinct().count() != total:
        raise ValueError("scans must be numbered from 0 without gaps")
    own = F.when((F.col("n") >= 0) & (F.col("n") < total), F.col("n")).otherwise(F.raise_error(F.concat(F.lit("no scan "), F.col("n").cast("string"))).cast("long"))
    code = patterns.bits_to_hex(patterns.mirrored(patterns.hex_to_bits(F.col("code"), elements))) if flip_pattern else F.col("code")
    angle = -F.col("angle") if flip_angle else F.col("angle")
    turned = scans.withColumns({"code": code, "angle": angle}).withColumn("delays", patterns.delay_law(F.col("angle"), elements, width, speed))
    moved = signals.withColumn("n", total - 1 - own if flip_pattern else own)
    if fields is not None:
        fields = fields.withColumn("n", own)
        fields = flip_fields(fields, x_size) if flip_pattern else fields
    return turned, moved, fields


def flip_signals(signals: DataFrame, flips: DataFrame) -> DataFrame:
    """Signals (n, t, y) of each scan replaced by those of its mirror scan."""
    return flips.select("n", "source").join(signals.withColumnRenamed("n", "source"), "source").select("n", "t", "y")


def flip_fields(fields: DataFrame, x_size: int) -> DataFrame:
    """Fields mirrored along x."""
    return fields.withColumn("x", F.lit(x_size - 1) - F.col("x"))


def line_matches(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """(n, line) of ``lines`` that ``wanted`` asks for, each used once: k-th copy meets k-th copy."""
    nth = F.row_number().over(Window.partitionBy("line").orderBy("n"))
    return lines.withColumn("_k", nth).join(wanted.withColumn("_k", nth).select("line", "_k"), ["line", "_k"]).select("n", "line")


def missing_lines(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    return wanted.select("line").exceptAll(lines.select("line"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positions at which two scan lists (n, line) differ or where one ends; none if they are equal."""
    return a.select("n", F.col("line").alias("a")).join(b.select("n", F.col("line").alias("b")), "n", "full").where(~F.col("a").eqNullSafe(F.col("b")))


def combine_phases(traces: DataFrame, keys: list[str]) -> DataFrame:
    """Four scans (h 0 to 3) of a decimation and angle to one complex value: ((h0 - h1) - i (h2 - h3)) / 2; decimation 0 stays real."""
    s = [F.sum(F.when(F.col("h") == k, F.col("y")).otherwise(0.0)) for k in range(4)]
    plane = F.col("decimation") == 0
    sums = traces.groupBy("decimation", "angle", *keys).agg(*[c.alias(f"_s{k}") for k, c in enumerate(s)])
    d = [F.col(f"_s{k}") for k in range(4)]
    return sums.select("decimation", "angle", *keys, F.when(plane, d[0]).otherwise((d[0] - d[1]) / 2).alias("re"), F.when(plane, F.lit(0.0)).otherwise(-(d[2] - d[3]) / 2).alias("im"))


def running_pair_mean(signals: DataFrame, keys: list[str]) -> DataFrame:
    """Repeats of a key folded in the order of n as ((a + b) / 2 + c) / 2. A null y makes the fold null, as an addition does.

    The fold is a weighted sum: the k-th of m repeats counts 2^-(m - k + 1), the first as much as the second. The m - k come
    from counts of ranges of (n, y) over all keys, as in renumber, so that no key is sorted in one task.
    """
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    own = [f"_k{i}" for i in range(len(keys))]
    rows = signals.select(*named, "n", "y")
    order = [F.asc_nulls_first("n"), F.asc_nulls_first("y")]
    placed = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    placed = cut(placed, "repeats")
    sizes = placed.groupBy(*own, "_part").agg(F.count(F.lit(1)).alias("_c"))
    after = Window.partitionBy(*own).orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    later = sizes.select(*(F.col(c).alias("_j" + c) for c in own), F.col("_part").alias("_q"), F.coalesce(F.sum("_c").over(after), F.lit(0)).alias("_later"), F.sum("_c").over(Window.partitionBy(*own)).alias("_m"))
    same = F.col("_part") == F.col("_q")
    for c in own:
        same = same & F.col(c).eqNullSafe(F.col("_j" + c))
    inside = Window.partitionBy(*own, "_part").orderBy(F.desc_nulls_last("n"), F.desc_nulls_last("y"), F.desc("_at"))
    ranked = placed.join(later, same).withColumn("_behind", F.col("_later") + F.row_number().over(inside) - 1)
    first = F.col("_behind") == F.col("_m") - 1
    halvings = F.col("_behind") + F.when(first, 0).otherwise(1)
    half = F.floor(halvings / 2)
    term = F.col("y") * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - halvings)  # in two steps: 2^-1080 alone is zero
    term = F.when(F.abs("y") == F.lit(float("inf")), F.col("y")).otherwise(term)
    folded = ranked.groupBy(*own).agg(F.sum(term).alias("_s"), F.count(F.lit(1)).alias("_n"), F.count("y").alias("_filled"))
    return folded.select(*(F.col(c).alias(k) for c, k in zip(own, keys)), F.when(F.col("_n") == F.col("_filled"), F.col("_s")).alias("y"))


def serpentine(position, x_size: int):
    """Column x of the n-th stop of a scan that turns back at each row's end."""
    row, at = F.floor(position / x_size), F.pmod(position, F.lit(x_size))
    return F.when(row % 2 == 0, at).otherwise(x_size - 1 - at)


def serpentine_volume(position, x_size: int, y_size: int):
    """Columns x, y, z of the n-th stop of a scan of planes that runs each row and each plane back and forth."""
    plane = x_size * y_size
    z, at = F.floor(position / plane), F.pmod(position, F.lit(plane))
    at = F.when(z % 2 == 0, at).otherwise(plane - 1 - at)
    # The rows' places in the list rise with the stops; only the pairs of a plane are turned.
    return serpentine(at, x_size), F.floor(at / x_size), z
