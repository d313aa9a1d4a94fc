"""Generated tables: beams, phantoms, media, emission patterns, analytic fields, noise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns
from . import stencil


def draw(seed: int, *keys: Column) -> Column:
    """Uniform in [0, 1), fixed by the seed and the keys: the same however rows are partitioned."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / float(1 << 52)


def normal(seed: int, *keys: Column) -> Column:
    """Standard normal from two uniform draws."""
    return F.sqrt(-2 * F.ln(1 - draw(seed, *keys))) * F.cos(2 * F.pi() * draw(seed + 1, *keys))


def poisson(mean: Column, seed: int, *keys: Column) -> Column:
    """Poisson draw: exact inversion up to a mean of 30, rounded normal above."""
    u = draw(seed, *keys)
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.lit(0).alias("n")),
        lambda s, k: F.struct((s["p"] * mean / k).alias("p"), (s["sum"] + s["p"] * mean / k).alias("sum"), F.when(u > s["sum"], k).otherwise(s["n"]).cast("int").alias("n")),
    )
    return F.when(mean <= 30, walk["n"].cast("double")).otherwise(F.greatest(F.lit(0.0), F.rint(mean + F.sqrt(mean) * normal(seed + 2, *keys))))


def grid(spark: SparkSession, z_size: int, x_size: int) -> DataFrame:
    return spark.range(z_size * x_size).select(F.floor(F.col("id") / x_size).alias("z"), (F.col("id") % x_size).alias("x"))


def gaussian_beam(pixels: DataFrame, waist: float, x0: float, z0: float, dx: float = 1.0, dz: float = 1.0) -> DataFrame:
    """exp(-2 r^2 / waist^2) about (x0, z0), in the unit of dx and dz."""
    r2 = F.pow(F.col("x") * dx - x0, F.lit(2)) + F.pow(F.col("z") * dz - z0, F.lit(2))
    return pixels.select("z", "x", F.exp(-2 * r2 / waist**2).alias("value"))


#: exp(-r^2 / radius^2) is zero in double precision beyond this many radii; pixels of a tile along each axis.
REACH, TILE = math.sqrt(746.0), 16


def phantom(beam: DataFrame, absorbers: DataFrame, dx: float = 1.0, dz: float = 1.0) -> DataFrame:
    """The beam less a Gaussian for each absorber (cx, cz, radius, amplitude), clipped at zero.

    Absorbers alike but for their amplitude are added first. Each lists the tiles of the beam that its Gaussian reaches
    and meets their pixels by an equi-join: what is left out is zero in double precision.
    """
    alike = absorbers.where("amplitude is not null and radius is not null").groupBy("cx", "cz", "radius").agg(F.sum("amplitude").alias("amplitude"))
    tile = lambda c: F.floor(c / TILE)
    extent = beam.agg(*(f(tile(F.col(c))).alias(f"_{n}_{c}") for c in ("z", "x") for n, f in (("low", F.min), ("high", F.max))))

    def reached(axis: str, centre: str, step: float):
        far = REACH * F.abs("radius")
        low = F.greatest(F.floor((F.col(centre) - far) / step / TILE), F.col(f"_low_{axis}"))
        high = F.least(F.floor((F.col(centre) + far) / step / TILE), F.col(f"_high_{axis}"))
        return F.explode(F.when(low <= high, F.sequence(low, high)))

    listed = alike.crossJoin(F.broadcast(extent)).withColumn("_tz", reached("z", "cz", dz)).withColumn("_tx", reached("x", "cx", dx))
    r2 = F.pow(F.col("x") * dx - F.col("cx"), F.lit(2)) + F.pow(F.col("z") * dz - F.col("cz"), F.lit(2))
    taken = F.sum(F.coalesce(F.col("amplitude") * F.exp(-r2 / (F.col("radius") * F.col("radius"))), F.lit(0.0)))
    pixels = beam.withColumn("_tz", tile(F.col("z"))).withColumn("_tx", tile(F.col("x")))
    found = pixels.join(listed.select("cx", "cz", "radius", "amplitude", "_tz", "_tx"), ["_tz", "_tx"], "left")
    return found.groupBy("z", "x").agg(F.greatest(F.lit(0.0), F.first("value") - taken).alias("value"))


def regions(pixels: DataFrame, absorbers: DataFrame, dx: float = 1.0, dz: float = 1.0) -> DataFrame:
    """(name, z, x) of pixels within each absorber's radius: each absorber lists the pixels of its bounding box, which then meet the pixels by an equi-join."""
    span = lambda c, step: F.sequence(F.ceil((F.col(c) - F.col("radius")) / step), F.floor((F.col(c) + F.col("radius")) / step))
    boxed = absorbers.where("radius >= 0").withColumn("z", F.explode(span("cz", dz))).withColumn("x", F.explode(span("cx", dx)))
    r2 = F.pow(F.col("x") * dx - F.col("cx"), F.lit(2)) + F.pow(F.col("z") * dz - F.col("cz"), F.lit(2))
    return boxed.where(r2 <= F.col("radius") * F.col("radius")).join(pixels.select("z", "x"), ["z", "x"]).select("name", "z", "x")


def box_medium(pixels: DataFrame, inside: tuple[float, float], outside: tuple[float, float], z_range: tuple[int, int], x_range: tuple[int, int]) -> DataFrame:
    """(z, x, speed, density): one pair of values in a box of pixels, another around it."""
    within = F.col("z").between(z_range[0], z_range[1] - 1) & F.col("x").between(x_range[0], x_range[1] - 1)
    return pixels.select("z", "x", *[F.when(within, i).otherwise(o).alias(n) for i, o, n in zip(inside, outside, ("speed", "density"))])


def bubble_medium(medium: DataFrame, bubbles: DataFrame, speed: float = 343.0, density: float = 1.2) -> DataFrame:
    """Discs (cx, cz, radius in pixels) of gas in a medium (z, x, speed, density)."""
    hit = regions(medium, bubbles.withColumn("name", F.lit("bubble"))).select("z", "x").distinct().withColumn("_hit", F.lit(True))
    gas = lambda c, v: F.when(F.col("_hit"), v).otherwise(F.col(c)).alias(c)
    return medium.join(hit, ["z", "x"], "left").select("z", "x", gas("speed", speed), gas("density", density))


def random_bubbles(spark: SparkSession, count: int, z_size: int, x_size: int, radius: tuple[float, float], seed: int = 0) -> DataFrame:
    i = F.col("id")
    return spark.range(count).select((draw(seed, i) * x_size).alias("cx"), (draw(seed + 1, i) * z_size).alias("cz"), (radius[0] + draw(seed + 2, i) * (radius[1] - radius[0])).alias("radius"))


def textured_medium(pixels: DataFrame, speed: float, spread: float, phases: list[float], size: int, gradient: float = 5.0, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """(z, x, value): for each structure size, smoothed noise becomes a soft mask that blends the medium towards speed + spread."""
    image = pixels.withColumn("value", speed * (1 + noise * normal(seed, F.col("z"), F.col("x"))))
    for k, sigma in enumerate(phases):
        raw = pixels.withColumn("value", normal(seed + 10 * (k + 1), F.col("z"), F.col("x")))
        smooth = stencil.gaussian(stencil.gaussian(raw, sigma, "z", size), sigma, "x", size)
        spread_of = F.broadcast(smooth.agg(F.stddev_pop("value").alias("sd")))
        mask = smooth.crossJoin(spread_of).select("z", "x", (1 / (1 + F.exp(-gradient * F.col("value") / F.col("sd")))).alias("m"))
        image = image.join(mask, ["z", "x"]).select("z", "x", (F.col("value") * (1 - F.col("m")) + (speed + spread) * F.col("m")).alias("value"))
    return image


def emission_patterns(decimations: DataFrame, angles: DataFrame, elements: int, pitch: float) -> DataFrame:
    """Scans of tables (decimation) and (angle): (n, code, angle, decimation, phase). Decimation 0 gives one full aperture an angle, others the
    four phases cos, not cos, not sin, sin; scans run by decimation, phase, angle."""
    wave = lambda kind: patterns.square_wave(elements, pitch, F.col("decimation") / (elements * pitch), kind)
    negative = lambda bits: F.translate(bits, "01", "10")
    four = F.array(*[F.struct(F.lit(i).alias("phase"), b.alias("bits")) for i, b in enumerate((wave("cos"), negative(wave("cos")), negative(wave("sin")), wave("sin")))])
    whole = F.array(F.struct(F.lit(0).alias("phase"), F.repeat(F.lit("1"), F.lit(elements)).alias("bits")))
    kinds = decimations.distinct().select("decimation", F.explode(F.when(F.col("decimation") == 0, whole).otherwise(four)).alias("p"))
    scans = kinds.crossJoin(angles.distinct()).select(patterns.bits_to_hex_reversed(F.col("p.bits")).alias("code"), "angle", "decimation", F.col("p.phase").alias("phase"))
    # Scans are few (decimations x 4 x angles): one window numbers them.
    return scans.withColumn("n", F.row_number().over(Window.orderBy("decimation", "phase", "angle")) - 1)


def random_patterns(seeds: DataFrame, elements: int, low: int = -20, high: int = 20, seed: int = 0) -> DataFrame:
    """For each id: a balanced pattern (stripes whose period divides the number of elements, rolled) and an angle; distinct (code, angle) with their smallest id."""
    periods = [d for d in range(2, elements + 1, 2) if elements % d == 0]
    pick = F.element_at(F.array(*map(F.lit, periods)), (F.floor(draw(seed, F.col("id")) * len(periods)) + 1).cast("int"))
    base = seeds.select("id", pick.alias("period"))
    stripes = patterns.striped((F.col("period") / 2).cast("int"), (F.col("period") / 2).cast("int"), F.lit(0), F.lit(0), elements)
    shift = F.floor(draw(seed + 1, F.col("id")) * F.col("period")).cast("int")
    rolled = F.when(F.col("period") == elements, F.repeat(F.lit("1"), F.lit(elements))).otherwise(F.concat(F.substr("bits", elements - F.col("shift") + 1, F.lit(elements)), F.substr("bits", F.lit(1), elements - F.col("shift"))))
    angle = (low + F.floor(draw(seed + 2, F.col("id")) * (high - low + 1))).cast("int")
    made = base.withColumns({"bits": stripes, "shift": shift}).select("id", patterns.bits_to_hex(rolled).alias("code"), angle.alias("angle"))
    return made.groupBy("code", "angle").agg(F.min("id").alias("n"))


def check_patterns(scans: DataFrame, elements: int) -> DataFrame:
    """(code, angle, copies, right_length, balanced, regular, valid) of distinct scans. Full apertures are always balanced and regular."""
    distinct = scans.groupBy("code", "angle").agg(F.count(F.lit(1)).alias("copies")).withColumn("bits", patterns.hex_to_bits(F.col("code"), elements))
    ones = F.length(F.replace("bits", F.lit("0"), F.lit("")))
    full = ones == elements
    # Stripes of period p: runs of p/2, and digits p/2 apart differ (around the end as well).
    periods = [p for p in range(2, elements + 1, 2) if elements % p == 0]
    doubled = F.concat("bits", "bits")
    run = F.greatest(patterns.longest_run(doubled, "0"), patterns.longest_run(doubled, "1"))
    striped = F.exists(F.array(*map(F.lit, periods)), lambda p: (run == p / 2) & (F.substr(doubled, (p / 2).cast("int") + 1, F.lit(elements)) == F.translate("bits", "01", "10")))
    right = F.length("code") * 4 == elements
    out = distinct.select("code", "angle", "copies", right.alias("right_length"), (full | (ones == elements // 2)).alias("balanced"), (full | striped).alias("regular"))
    return out.withColumn("valid", (F.col("copies") == 1) & F.col("right_length") & F.col("balanced") & F.col("regular"))


def irregular_pattern(seed_col: Column, elements: int, waves: int = 8, seed: int = 0) -> Column:
    """Bits where the sum of cosines of ``waves`` distinct random frequencies is not negative."""
    order = F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(elements // 2)), lambda f: F.struct(draw(seed, seed_col, f).alias("u"), f.alias("f"))))
    chosen = F.transform(F.slice(order, 1, waves), lambda p: p["f"])
    total = lambda i: F.aggregate(chosen, F.lit(0.0), lambda s, f: s + F.cos(2 * F.pi() * f * i / elements))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(elements - 1)), lambda i: F.when(F.round(total(i), 9) >= 0, "1").otherwise("0")), "")


def element_pixels(elements: DataFrame, width: float, pitch: float, start: float, dx: float, x_size: int) -> DataFrame:
    """(i, x, weight): share of each pixel that element i covers, from its interval; no theta join: the pixels are listed by a sequence."""
    lo = start + F.col("i") * pitch
    hi = lo + width
    listed = elements.select("i", lo.alias("lo"), hi.alias("hi"), F.explode(F.sequence(F.floor(lo / dx), F.floor(hi / dx))).alias("x"))
    covered = (F.least("hi", (F.col("x") + 1) * dx) - F.greatest("lo", F.col("x") * dx)) / dx
    return listed.select("i", "x", covered.alias("weight")).where((F.col("weight") * dx > 1e-9) & (F.col("x") >= 0) & (F.col("x") < x_size))


def tone_burst(frequency: float, cycles: float, rate: float) -> list[float]:
    """Sine of whole cycles under a Gaussian window, sampled at the rate."""
    size = int(round(cycles / frequency * rate)) + 1
    middle, spread = (size - 1) / 2, (size - 1) / 6 or 1.0
    return [math.sin(2 * math.pi * frequency * k / rate) * math.exp(-0.5 * ((k - middle) / spread) ** 2) for k in range(size)]


#: Scans of a partition of ray_field, about.
RAY_SCANS = 1 << 13


def ray_field(scans: DataFrame, elements: int, width_px: int, t_size: int, z_size: int, x_size: int, dt: float, dx: float, speed: float, burst: int, factor: int = 4, start_px: int = 0) -> DataFrame:
    """Analytic fields (n, t, z, x, value) of scans (n, bits, angle in degrees).

    Each active element sends a ray along the angle, delayed by its distance from the pivot; it lights the fine pixels
    (dx / factor) that it is over, then a sin^2 envelope of ``burst`` samples is laid over time. Rays are added on the
    coarse grid before the envelope multiplies the rows. Scans are numbered (n) differently.
    """
    fine = dx / factor
    a = F.radians("angle")
    # All pixels of a scan stay in its partition: sums by scan need no exchange, and a task's tables hold some thousand scans.
    scans = scans.repartition(max(1, -(-scans.count() // RAY_SCANS)), "n")
    active = scans.select("n", "angle", F.posexplode(F.split("bits", "")).alias("i", "bit")).where("bit = '1'")
    at = start_px + F.col("i") * width_px
    pivot = F.when(F.col("angle") >= 0, F.lit(start_px)).otherwise(F.lit(start_px + elements * width_px))
    delay = F.abs(at - pivot) * fine * F.sin(F.abs(a)) / speed
    rays = active.select("n", "angle", at.alias("at"), delay.alias("delay"), F.explode(F.sequence(F.lit(0), F.lit(t_size - 1))).alias("t"))
    way = (F.col("t") * dt - F.col("delay")) * speed
    rays = rays.where((F.col("t") * dt > F.col("delay")) & (F.col("t") * dt - F.col("delay") < (t_size - 1) * dt))
    towards_zero = lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))
    spots = rays.select("n", "t", F.floor(way * F.cos(a) / fine).alias("fz"), towards_zero((F.col("at") * fine + way * F.sin(a)) / fine).alias("fx0"), F.explode(F.sequence(F.lit(0), F.lit(width_px - 1))).alias("k"))
    inside = (F.col("fz") >= 0) & (F.col("fz") < z_size * factor) & (F.col("fx0") + F.col("k") >= 0) & (F.col("fx0") + F.col("k") < x_size * factor)
    lit = spots.where(inside).groupBy("n", "t", F.floor(F.col("fz") / factor).alias("z"), F.floor((F.col("fx0") + F.col("k")) / factor).alias("x")).agg((F.count(F.lit(1)) / float(factor * factor)).alias("value"))
    shape = [math.sin(math.pi * k / (burst - 1)) ** 2 if burst > 1 else 0.0 for k in range(burst)]
    spread = lit.select("n", "t", "z", "x", "value", F.posexplode(F.array(*map(F.lit, shape))).alias("k", "w")).where(F.col("t") + F.col("k") < t_size)
    return spread.groupBy("n", (F.col("t") + F.col("k")).alias("t"), "z", "x").agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def gaussian_noise(signals: DataFrame, snr_db: float, per_signal: bool = False, seed: int = 0) -> DataFrame:
    """y plus normal noise at the ratio to the mean square of all signals, or of each one."""
    power = F.avg(F.col("y") * F.col("y"))
    sd = F.sqrt(F.col("_p") / 10 ** (snr_db / 10))
    if per_signal:
        joined = signals.join(signals.groupBy("n").agg(power.alias("_p")), "n")
    else:
        joined = signals.crossJoin(F.broadcast(signals.agg(power.alias("_p"))))
    return joined.withColumn("y", F.col("y") + sd * normal(seed, F.col("n"), F.col("t"))).drop("_p")


def poisson_noise(signals: DataFrame, level: float, seed: int = 0) -> DataFrame:
    """y times Poisson(level |y|) / (level max|y| of its signal)."""
    top = signals.groupBy("n").agg(F.max(F.abs("y")).alias("_top"))
    noisy = F.col("y") * poisson(level * F.abs("y"), seed, F.col("n"), F.col("t")) / (level * F.col("_top"))
    return signals.join(top, "n").withColumn("y", F.when(F.col("_top") == 0, F.col("y")).otherwise(noisy)).drop("_top")


def repeat_noise(repeats: DataFrame) -> DataFrame:
    """Noise of repeated acquisitions (rep, t, y): variance from differences of neighbouring repeats, and the deviation of their mean over t."""
    w = Window.partitionBy("t").orderBy("rep")
    d = F.col("y") - F.lag("y").over(w)
    variance = repeats.withColumn("_d", d).agg((F.avg(F.col("_d") * F.col("_d")) / 2).alias("variance"))
    amplitude = repeats.groupBy("t").agg(F.avg("y").alias("m")).agg(F.stddev_pop("m").alias("amplitude"))
    return variance.crossJoin(amplitude)


def shift_nonnegative(signals: DataFrame) -> DataFrame:
    """Each signal less its minimum where that is negative."""
    low = signals.groupBy("n").agg(F.least(F.lit(0.0), F.min("y")).alias("_low"))
    return signals.join(low, "n").withColumn("y", F.col("y") - F.col("_low")).drop("_low")
