"""Registered queries: patterns, scans, spectra, generated media and beams, files, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fourier, patterns
from ..operators import generators, scans, signals
from ..session import shared_folder, spread
from ..sources import active_list, binary
from ..streaming import ingest
from .catalogue import _BITS, _P, _S, T, X, _grid, _series, _signal, _table, register


def _codes(spark, d):
    n = F.col("p_partkey")
    return spread(_table(spark, d, "part").select(n), "p_partkey").select(n.alias("n"), F.substring(F.md5(n.cast("string")), 1, 12).alias("code"), (n % 41 - 20).cast("int").alias("angle"))


_RUNS = "r AS (SELECT *, list_max(list_transform(string_split(bits, '1'), lambda s: length(s))) AS zeros, list_max(list_transform(string_split(bits, '0'), lambda s: length(s))) AS ones, length(regexp_extract(bits, '^(0+|1+)')) AS head FROM b)"


@register(f"""WITH {_P}, {_BITS}, {_RUNS} SELECT n, CASE WHEN bits[1] = '1' THEN CASE WHEN head / greatest(zeros, ones) > 0.3 AND head / greatest(zeros, ones) < 0.7 THEN 0 ELSE 1 END
 ELSE CASE WHEN head / greatest(zeros, ones) > 0.3 AND head / greatest(zeros, ones) < 0.7 THEN 2 ELSE 3 END END AS phase FROM r""")
def pattern_phase(spark, d):
    return _codes(spark, d).select("n", patterns.phase_of(patterns.hex_to_bits(F.col("code"), 48)).alias("phase"))


@register(f"""WITH {_P}, {_BITS}, e AS (SELECT n, i, CAST(bits[i + 1] AS INTEGER) AS v FROM b, range(0, 48) r(i)), k AS (SELECT k FROM range(1, 24) r(k)),
 m AS (SELECT n, k, round(sqrt(power(sum(v * cos(2 * pi() * k * i / 48)), 2) + power(sum(v * sin(2 * pi() * k * i / 48)), 2)), 6) AS p FROM e, k GROUP BY 1, 2)
 SELECT n, CAST(first(k ORDER BY p DESC, k) AS INTEGER) AS bin FROM m GROUP BY 1""")
def pattern_frequency(spark, d):
    return _codes(spark, d).select("n", fourier.dominant_bin(patterns.hex_to_bits(F.col("code"), 48)).cast("int").alias("bin"))


@register("""WITH p AS (SELECT p_partkey AS n, p_size % 7 + 1 AS a, p_size % 5 + 1 AS b, p_size % 3 AS h, p_size % 2 AS t FROM part),
 u AS (SELECT *, substr(repeat(repeat('0', a) || repeat('1', b), 48), 1, 48) AS bits FROM p), m AS (SELECT *, substr(bits, h + 1) || repeat('0', h) AS moved FROM u)
 SELECT n, repeat('1', t) || substr(moved, 1, 48 - t) AS bits FROM m""")
def pattern_striped(spark, d):
    size = F.col("p_size").cast("int")
    bits = patterns.striped(size % 7 + 1, size % 5 + 1, size % 3, size % 2, 48)
    return _table(spark, d, "part").select(F.col("p_partkey").alias("n"), bits.alias("bits"))


@register("""WITH p AS (SELECT p_partkey AS n, radians(p_partkey % 41 - 20) AS a FROM part), e AS (SELECT n, i, 1000.0 / 1540 * sin(a) * i * 0.0002 AS raw FROM p, range(1, 17) r(i))
 SELECT n, i - 1 AS i, round(raw - min(raw) OVER (PARTITION BY n), 9) + 0.0 AS delay FROM e""")
def delay_laws(spark, d):
    law = patterns.delay_law(F.col("angle"), 16, 0.0002, 1540.0)
    return _codes(spark, d).select("n", F.posexplode(law).alias("i", "delay")).select("n", F.col("i").cast("long").alias("i"), (F.round("delay", 9) + 0.0).alias("delay"))


@register("SELECT p_partkey AS n, p_partkey % 41 - 20 AS angle FROM part")
def delays_to_angle(spark, d):
    """The angle read back from its delay law."""
    law = F.transform(patterns.delay_law(F.col("angle"), 192, 0.0002, 1540.0), lambda t: t / 1000)
    return _codes(spark, d).select("n", patterns.angle_of_delays(law, 0.0002, 1540.0).cast("long").alias("angle"))


@register("""WITH d AS (SELECT DISTINCT p_size % 8 AS dec FROM part), g AS (SELECT DISTINCT p_partkey % 41 - 20 AS angle FROM part),
 e AS (SELECT dec, i, CASE WHEN cos(2 * pi() * dec / (16 * 0.2) * ((i - 7.5) * 0.2)) > 0 THEN '1' ELSE '0' END AS c, CASE WHEN sin(2 * pi() * dec / (16 * 0.2) * ((i - 7.5) * 0.2)) > 0 THEN '1' ELSE '0' END AS s FROM d, range(0, 16) r(i)),
 b AS (SELECT dec, string_agg(c, '' ORDER BY i DESC) AS c, string_agg(s, '' ORDER BY i DESC) AS s FROM e GROUP BY 1),
 k AS (SELECT dec, 0 AS phase, CASE WHEN dec = 0 THEN repeat('1', 16) ELSE c END AS bits FROM b UNION ALL SELECT dec, 1, translate(c, '01', '10') FROM b WHERE dec <> 0
  UNION ALL SELECT dec, 2, translate(s, '01', '10') FROM b WHERE dec <> 0 UNION ALL SELECT dec, 3, s FROM b WHERE dec <> 0)
 SELECT CAST(row_number() OVER (ORDER BY dec, phase, angle) - 1 AS INTEGER) AS n, lower(lpad(to_hex(list_sum(list_transform(range(0, 16), lambda j: CAST(bits[j + 1] AS BIGINT) << (15 - j)))::BIGINT), 4, '0')) AS code, CAST(angle AS BIGINT) AS angle, CAST(dec AS BIGINT) AS decimation, phase FROM k, g""")
def emission_patterns(spark, d):
    part = _table(spark, d, "part")
    decimations, angles = part.select((F.col("p_size") % 8).alias("decimation")), part.select((F.col("p_partkey") % 41 - 20).alias("angle"))
    found = generators.emission_patterns(decimations, angles, 16, 0.2)
    return found.select("n", "code", F.col("angle").cast("long").alias("angle"), F.col("decimation").cast("long").alias("decimation"), "phase")


@register()
def random_patterns(spark, d):
    return generators.random_patterns(_table(spark, d, "part").select(F.col("p_partkey").alias("id")), 48)


_FLIPS = """s AS (SELECT p_partkey AS n, substr(md5(CAST(p_partkey AS VARCHAR)), 1, 1) AS code, p_partkey % 5 - 2 AS angle FROM part),
 f AS (SELECT n, code, angle, substr('084c2a6e195d3b7f', CAST('0x' || code AS INTEGER) + 1, 1) AS turned FROM s),
 m AS (SELECT f.n, coalesce(max(s.n), f.n) AS source, max(s.n) IS NOT NULL AS found FROM f LEFT JOIN s ON s.code = f.turned AND s.angle = -f.angle GROUP BY f.n)"""


@register(f"WITH {_FLIPS} SELECT * FROM m")
def flip_lookup(spark, d):
    n = F.col("p_partkey")
    some = _table(spark, d, "part").select(n.alias("n"), F.substring(F.md5(n.cast("string")), 1, 1).alias("code"), (n % 5 - 2).cast("int").alias("angle"))
    return scans.flipped(some, 4)


@register(f"WITH {_FLIPS} SELECT n, l_orderkey AS t, sum(l_quantity) AS y FROM m JOIN lineitem ON l_partkey = source GROUP BY 1, 2")
def signal_flip(spark, d):
    signals = _table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("n"), F.col("l_orderkey").alias("t")).agg(F.sum("l_quantity").alias("y"))
    return scans.flip_signals(signals, flip_lookup(spark, d))


@register("""WITH p AS (SELECT p_partkey AS n, round(radians(p_partkey % 41 - 20), 5) AS a, p_size % 7 * 1e-7 * 1540 AS first, p_size * 1e-7 * 1540 AS last, p_partkey % 9 = 0 AS silent FROM part),
 q AS (SELECT n, silent, 0.001 - sin(a) * first AS x1, 0.004 - sin(a) * last AS x2, -cos(a) * first AS z1, -cos(a) * last AS z2 FROM p)
 SELECT n, round(CASE WHEN silent OR z1 = z2 THEN 0 ELSE (z2 * x1 - z1 * x2) / (z2 - z1) END, 8) + 0.0 AS x FROM q""")
def rotation_centres(spark, d):
    """Every part as an emission of four elements: where its wave front meets the probe."""
    delays = F.array((F.col("p_size") % 7) * 1e-7, F.col("p_size") * 1e-7)
    bits = F.when(F.col("p_partkey") % 9 == 0, "0000").otherwise("0110")
    x = patterns.rotation_centre([0.001, 0.002, 0.003, 0.004], F.radians(F.col("p_partkey") % 41 - 20), delays, bits, 1540.0)
    return _table(spark, d, "part").select(F.col("p_partkey").alias("n"), (F.round(x, 8) + 0.0).alias("x"))


_LINES = "w AS (SELECT s_suppkey AS n, CAST(s_nationkey AS VARCHAR) AS line FROM supplier), l AS (SELECT c_custkey AS n, CAST(c_nationkey AS VARCHAR) AS line FROM customer)"


def _lines(spark, d):
    wanted = _table(spark, d, "supplier").select(F.col("s_suppkey").alias("n"), F.col("s_nationkey").cast("string").alias("line"))
    return wanted, _table(spark, d, "customer").select(F.col("c_custkey").alias("n"), F.col("c_nationkey").cast("string").alias("line"))


@register(f"""WITH {_LINES}, wk AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY n) AS k FROM w), lk AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY n) AS k FROM l)
 SELECT lk.n, lk.line FROM lk JOIN wk USING (line, k)""")
def line_matches(spark, d):
    return scans.line_matches(*_lines(spark, d))


@register(f"WITH {_LINES} SELECT line FROM l EXCEPT ALL SELECT line FROM w")
def missing_lines(spark, d):
    wanted, lines = _lines(spark, d)
    return scans.missing_lines(lines, wanted)


@register("WITH w AS (SELECT user_id, event_type, list_reduce(list(value ORDER BY event_id), lambda a, b: (a + b) / 2) AS y FROM events GROUP BY 1, 2) SELECT user_id, event_type, round(y, 6) AS y FROM w")
def repeated_pair_mean(spark, d):
    e = _table(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("n"), F.col("value").alias("y"))
    return scans.running_pair_mean(e, ["user_id", "event_type"]).select("user_id", "event_type", F.round("y", 6).alias("y"))


@register(f"""WITH {_S}, h AS (SELECT n % 4 AS decimation, n % 3 AS angle, t, phase, sum(y) AS y FROM s WHERE phase IS NOT NULL GROUP BY 1, 2, 3, 4),
 c AS (SELECT decimation, angle, t, sum(CASE WHEN phase = 0 THEN y ELSE 0 END) AS a, sum(CASE WHEN phase = 1 THEN y ELSE 0 END) AS b, sum(CASE WHEN phase = 2 THEN y ELSE 0 END) AS c, sum(CASE WHEN phase = 3 THEN y ELSE 0 END) AS e FROM h GROUP BY 1, 2, 3)
 SELECT decimation, angle, t, round(CASE WHEN decimation = 0 THEN a ELSE (a - b) / 2 END, 4) + 0.0 AS re, round(CASE WHEN decimation = 0 THEN 0 ELSE (e - c) / 2 END, 4) + 0.0 AS im FROM c""")
def phase_combination(spark, d):
    s = _series(spark, d).where("phase is not null").select((F.col("n") % 4).alias("decimation"), (F.col("n") % 3).alias("angle"), "t", F.col("phase").alias("h"), "y")
    return scans.combine_phases(s, ["t"]).select("decimation", "angle", "t", (F.round("re", 4) + 0.0).alias("re"), (F.round("im", 4) + 0.0).alias("im"))


@register("SELECT event_id AS n, phase FROM (SELECT event_id, event_id % 7 * pi() / 4 AS phase FROM events) WHERE abs(phase - pi() / 2) <= 1e-3 + 1e-5 * pi() / 2 OR abs(phase) <= 1e-3")
def phase_selection(spark, d):
    e = _table(spark, d, "events").select(F.col("event_id").alias("n"), (F.col("event_id") % 7 * F.pi() / 4).alias("phase"))
    return scans.near_phases(e, [0.0, 1.5707963267948966])


@register("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS n, vec_id AS old FROM (SELECT DISTINCT 3 * l_orderkey + l_linenumber AS vec_id FROM lineitem)".replace("vec_id", "k"))
def scan_renumber(spark, d):
    """Numbers with gaps, made of all order lines, numbered anew."""
    kept = _table(spark, d, "lineitem").select((3 * F.col("l_orderkey") + F.col("l_linenumber")).alias("n")).distinct().select("n", F.col("n").alias("old"))
    return scans.renumber(kept)[0]


_SERIES = "s AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(0, 64) r(i))"


def _vectors(spark, d):
    return _table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("series"))


@register(f"WITH {_SERIES} SELECT vec_id, CAST(k AS INTEGER) AS bin, round(sqrt(power(sum(v * cos(2 * pi() * k * i / 64)), 2) + power(sum(v * sin(2 * pi() * k * i / 64)), 2)), 5) AS size FROM s, range(0, 33) b(k) GROUP BY 1, 2")
def signal_spectrum(spark, d):
    return _vectors(spark, d).select("vec_id", F.posexplode(fourier.spectrum(F.col("series"))).alias("bin", "size")).select("vec_id", "bin", F.round("size", 5).alias("size"))


_ANALYTIC = f"""WITH {_SERIES}, f AS MATERIALIZED (SELECT vec_id, k, CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END * sum(v * cos(2 * pi() * k * i / 64)) AS re, -CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END * sum(v * sin(2 * pi() * k * i / 64)) AS im FROM s, range(0, 33) b(k) GROUP BY 1, 2),
 a AS (SELECT vec_id, i, sum(re * cos(2 * pi() * k * i / 64) - im * sin(2 * pi() * k * i / 64)) / 64 AS re, sum(re * sin(2 * pi() * k * i / 64) + im * cos(2 * pi() * k * i / 64)) / 64 AS im FROM f, range(0, 64) r(i) GROUP BY 1, 2)"""


@register(f"""{_ANALYTIC}
 SELECT vec_id, CAST(i AS INTEGER) AS t, round(sqrt(re * re + im * im), 5) AS value FROM a""")
def signal_envelope(spark, d):
    return _vectors(spark, d).select("vec_id", F.posexplode(fourier.envelope(F.col("series"))).alias("t", "value")).select("vec_id", "t", F.round("value", 5).alias("value"))


@register(f"""{_ANALYTIC}
 SELECT vec_id, CAST(i AS INTEGER) AS t, round(re * re + im * im, 6) AS value FROM a""")
def signal_power(spark, d):
    return _vectors(spark, d).select("vec_id", F.posexplode(fourier.envelope_squared(F.col("series"))).alias("t", "value")).select("vec_id", "t", F.round("value", 6).alias("value"))


@register(f"""WITH {_SERIES}, f AS MATERIALIZED (SELECT vec_id, k, CASE WHEN k = 0 THEN 1 ELSE 2 END * CASE WHEN k <= 14 THEN 1 ELSE 0.5 * (1 + cos(pi() * (k - 14) / 6)) END AS w, sum(v * cos(2 * pi() * k * i / 64)) AS re, -sum(v * sin(2 * pi() * k * i / 64)) AS im FROM s, range(0, 20) b(k) GROUP BY 1, 2)
 SELECT vec_id, CAST(t AS INTEGER) AS t, round(sum(w * (re * cos(2 * pi() * k * t / 40) - im * sin(2 * pi() * k * t / 40))) / 64, 5) + 0.0 AS value FROM f, range(0, 40) r(t) GROUP BY 1, 2""")
def signal_resample(spark, d):
    return _vectors(spark, d).select("vec_id", F.posexplode(fourier.resample(F.col("series"), 40)).alias("t", "value")).select("vec_id", "t", (F.round("value", 5) + 0.0).alias("value"))


# The spline's coefficients are sums over the mirrored samples with weights that fall by sqrt(3) - 2 a step: 40 steps reach 1e-22.
@register(f"""WITH {_SERIES}, c AS (SELECT k, CASE WHEN m < 64 THEN m ELSE 126 - m END AS i, sum(w) AS w FROM
  (SELECT k, ((k + d) % 126 + 126) % 126 AS m, sqrt(3) * power(sqrt(3) - 2, abs(d)) AS w FROM range(-1, 66) a(k), range(-40, 41) b(d)) GROUP BY 1, 2),
 o AS (SELECT t, CAST(floor(t * 63 / 99.0) AS BIGINT) AS f, t * 63 / 99.0 - floor(t * 63 / 99.0) AS u FROM range(0, 100) r(t)),
 p AS (SELECT t, f - 1 AS k, (1 - u) ** 3 / 6 AS w FROM o UNION ALL SELECT t, f, (4 - 6 * u ** 2 + 3 * u ** 3) / 6 FROM o UNION ALL SELECT t, f + 1, (1 + 3 * u + 3 * u ** 2 - 3 * u ** 3) / 6 FROM o UNION ALL SELECT t, f + 2, u ** 3 / 6 FROM o),
 m AS MATERIALIZED (SELECT t, i, sum(p.w * c.w) AS w FROM p JOIN c USING (k) GROUP BY 1, 2)
 SELECT vec_id, CAST(t AS INTEGER) AS t, round(sum(w * v), 5) + 0.0 AS value FROM m JOIN s USING (i) GROUP BY 1, 2""")
def signal_cubic_zoom(spark, d):
    return _vectors(spark, d).select("vec_id", F.posexplode(fourier.cubic_zoom(F.col("series"), 100)).alias("t", "value")).select("vec_id", "t", (F.round("value", 5) + 0.0).alias("value"))


_FREQ = "f AS (SELECT p_partkey AS n, (p_partkey % 101 - 50) / 25.0 AS f FROM part)"


@register(f"""WITH {_FREQ}, w AS (SELECT n, f, CASE WHEN abs(f) > 1.5 THEN 0 ELSE abs(f) * exp(-2 * power(abs(f) / 1.5, 10)) END AS r FROM f)
 SELECT n, round(r, 9) AS ram_lak, round(CASE WHEN f = 0 THEN r ELSE r * sin(pi() * f / 1.5) / (pi() * f / 1.5) END, 9) + 0.0 AS shepp_logan, round(r * cos(pi() * f / 3), 9) + 0.0 AS cosine, round(r * (0.54 + 0.46 * cos(2 * pi() * f / 1.5)), 9) AS hamming, round(r * (1 + cos(pi() * f / 3)) / 2, 9) AS hann FROM w""")
def ramp_filters(spark, d):
    f = _table(spark, d, "part").select(F.col("p_partkey").alias("n"), ((F.col("p_partkey") % 101 - 50) / 25.0).alias("f"))
    return f.select("n", *[(F.round(fourier.ramp_filter(F.col("f"), k, 1.5), 9) + 0.0).alias(k.replace("-", "_")) for k in ("ram-lak", "shepp-logan", "cosine", "hamming", "hann")])


_ABSORBERS = "o AS (SELECT s_name AS name, CAST(s_suppkey * 7 % 50 AS DOUBLE) AS cx, CAST(s_suppkey % 4 AS DOUBLE) AS cz, s_nationkey % 3 + 0.5 AS radius, 0.01 + s_nationkey / 1000.0 AS amplitude FROM supplier)"


def _absorbers(spark, d):
    return _table(spark, d, "supplier").select(
        F.col("s_name").alias("name"), (F.col("s_suppkey") * 7 % 50).cast("double").alias("cx"), (F.col("s_suppkey") % 4).cast("double").alias("cz"), (F.col("s_nationkey") % 3 + F.lit(0.5)).alias("radius"), (0.01 + F.col("s_nationkey") / 1000.0).alias("amplitude")
    )


_PIX = "g AS (SELECT p_partkey // 50 AS z, p_partkey % 50 AS x FROM part)"


@register(f"""WITH {_PIX}, {_ABSORBERS}, b AS (SELECT z, x, exp(-2 * (power(x - 24.5, 2) + power(z - 2, 2)) / 400) AS v FROM g)
 SELECT z, x, round(greatest(0, any_value(v) - sum(amplitude * exp(-(power(x - cx, 2) + power(z - cz, 2)) / (radius * radius)))), 8) AS value FROM b, o GROUP BY 1, 2""")
def phantom_image(spark, d):
    beam = generators.gaussian_beam(_grid(spark, d), 20.0, 24.5, 2.0)
    return generators.phantom(beam, _absorbers(spark, d)).select("z", "x", F.round("value", 8).alias("value"))


@register(f"WITH {_PIX}, {_ABSORBERS} SELECT name, z, x FROM g JOIN o ON power(x - cx, 2) + power(z - cz, 2) <= radius * radius")
def absorber_regions(spark, d):
    return generators.regions(_grid(spark, d), _absorbers(spark, d))


@register(f"""WITH {_PIX}, {_ABSORBERS}, m AS (SELECT z, x, x >= 10 AND x < 40 AND z >= 1 AND z < 3 AS inside FROM g),
 h AS (SELECT DISTINCT z, x FROM g JOIN o ON power(x - cx, 2) + power(z - cz, 2) <= radius * radius)
 SELECT m.z, m.x, CASE WHEN h.z IS NOT NULL THEN 343.0 WHEN inside THEN 1540.0 ELSE 1500.0 END AS speed, CASE WHEN h.z IS NOT NULL THEN 1.2 WHEN inside THEN 1050.0 ELSE 1000.0 END AS density FROM m LEFT JOIN h ON h.z = m.z AND h.x = m.x""".replace("343.0", "CAST(343 AS DOUBLE)").replace("1.2 ", "CAST(1.2 AS DOUBLE) "))
def bubble_medium(spark, d):
    medium = generators.box_medium(_grid(spark, d), (1540.0, 1050.0), (1500.0, 1000.0), (1, 3), (10, 40))
    return generators.bubble_medium(medium, _absorbers(spark, d))


@register()
def textured_medium(spark, d):
    grid = _grid(spark, d).select("z", "x")
    size = max(X, grid.agg(F.max("z")).first()[0] + 1)
    return generators.textured_medium(grid, 1500.0, 40.0, [1.0, 3.0], size, noise=0.001).select("z", "x", F.round("value", 6).alias("value"))


@register("""WITH e AS (SELECT p_partkey AS i, 0.5 + p_partkey * 0.3 AS lo, 0.5 + p_partkey * 0.3 + 0.25 AS hi FROM part), k AS (SELECT i, lo, hi, unnest(range(CAST(floor(lo / 0.2) AS BIGINT), CAST(floor(hi / 0.2) AS BIGINT) + 1)) AS x FROM e),
 w AS (SELECT i, x, (least(hi, (x + 1) * 0.2) - greatest(lo, x * 0.2)) / 0.2 AS weight FROM k) SELECT i, x, round(weight, 6) AS weight FROM w WHERE weight * 0.2 > 1e-9 AND x < (SELECT 2 * max(p_partkey) + 10 FROM part)""".replace("0.5 + p_partkey * 0.3", "CAST(0.5 AS DOUBLE) + p_partkey * CAST(0.3 AS DOUBLE)").replace("0.2", "CAST(0.2 AS DOUBLE)").replace("+ CAST(0.2 AS DOUBLE)5 AS hi", "+ CAST(0.25 AS DOUBLE) AS hi"))
def element_coverage(spark, d):
    """Elements of a probe as wide as there are parts, on a grid that holds it."""
    elements = _table(spark, d, "part").select(F.col("p_partkey").alias("i"))
    width = 2 * (elements.agg(F.max("i")).first()[0] or 0) + 10
    return generators.element_pixels(elements, 0.25, 0.3, 0.5, 0.2, width).select("i", "x", F.round("weight", 6).alias("weight"))


@register()
def ray_fields(spark, d):
    some = _codes(spark, d).select("n", "angle", patterns.hex_to_bits(F.col("code"), 16).alias("bits"))
    return generators.ray_field(some, 16, 2, 10, 12, 12, 1e-7, 2e-4, 1540.0, 3).select("n", "t", "z", "x", F.round("value", 8).alias("value"))


@register()
def noisy_signals(spark, d):
    """Normal, then Poisson noise on the order signals."""
    y = _signal(spark, d).select(F.floor(F.col("row_id") / T).alias("n"), (F.col("row_id") % T).alias("t"), "y")
    noisy = generators.gaussian_noise(y, 20.0, seed=1).select("n", "t", F.round("y", 4).alias("gaussian"))
    return noisy.join(generators.poisson_noise(y, 1e-3, seed=9).select("n", "t", F.round("y", 4).alias("poisson")), ["n", "t"])


@register(f"WITH {_P} SELECT code, angle FROM p")
def active_list_files(spark, d):
    """Scans written as text and read again."""
    path = f"{shared_folder(spark)}/scans-{uuid.uuid4().hex}"
    active_list.write(_codes(spark, d), path)
    return active_list.read(spark, path, 48).select("code", F.col("angle").cast("long").alias("angle"))


@register("""WITH y AS (SELECT l_orderkey // 50 AS n, l_orderkey % 50 AS t, sum(l_extendedprice) AS y FROM lineitem GROUP BY 1, 2), c AS (SELECT DISTINCT n FROM y)
 SELECT dense_rank() OVER (ORDER BY n) - 1 AS n, rpad(md5(CAST(n AS VARCHAR)), 48, '0') AS code, CAST(n % 41 - 20 AS INTEGER) AS angle, CAST(r.t AS INTEGER) AS t, round(CAST(CAST(coalesce(y, 0) AS FLOAT) AS DOUBLE), 2) AS y FROM c CROSS JOIN range(0, 50) r(t) LEFT JOIN y USING (n, t)""")
def listmode_files(spark, d):
    """Signals written in list mode and read again."""
    y = _signal(spark, d).select(F.floor(F.col("row_id") / T).alias("n"), (F.col("row_id") % T).alias("t"), "y")
    events = y.select("n").distinct().select("n", F.md5(F.col("n").cast("string")).alias("code"), (F.col("n") % 41 - 20).alias("angle"))
    folder = f"{shared_folder(spark)}/listmode-{uuid.uuid4().hex}"
    binary.write_listmode(y, events, folder, T, 1e6, 192)
    return binary.read_listmode(spark, f"{folder}/data", f"{folder}/header").select("n", "code", "angle", "t", F.round("y", 2).alias("y"))


@register("SELECT CAST(0 AS BIGINT) AS t, p_partkey // 50 AS z, CAST(p_partkey % 50 AS INTEGER) AS x, round(CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE), 2) AS value FROM part")
def image_files(spark, d):
    """The image written with a header and read again."""
    image = _grid(spark, d).withColumn("t", F.lit(0))
    folder = f"{shared_folder(spark)}/image-{uuid.uuid4().hex}"
    binary.write_image(image, folder, 1, image.agg(F.max("z")).first()[0] + 1, X)
    return binary.read_image(spark, f"{folder}/data", f"{folder}/header").select("t", "z", "x", F.round("value", 2).alias("value"))


@register("""WITH e AS (SELECT user_id AS n, time_bucket(INTERVAL 1 HOUR, ts) AS start, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 END AS phase, value AS y FROM events)
 SELECT n, start, round((sum(CASE WHEN phase = 0 THEN y ELSE 0 END) - sum(CASE WHEN phase = 2 THEN y ELSE 0 END)) * pi() / 2, 4) + 0.0 AS re, round((sum(CASE WHEN phase = 3 THEN y ELSE 0 END) - sum(CASE WHEN phase = 1 THEN y ELSE 0 END)) * pi() / 2, 4) + 0.0 AS im
 FROM e WHERE start + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""")
def stream_demodulation(spark, d):
    """The events as a stream: windows that the watermark has closed once all of it has been read."""
    schema = _table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parque[t]")
    phase = F.create_map(*[F.lit(x) for p in (("view", 0), ("click", 1), ("purchase", 2), ("signup", 3)) for x in p])[F.col("event_type")]
    events = stream.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("n"), phase.alias("phase"), F.col("value").alias("y"))
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    ingest.run_available(ingest.demodulated(events), f"{base}/out", f"{base}/state")
    found = spark.read.schema("n long, start timestamp, re double, im double").parquet(f"{base}/out")
    return found.select("n", F.col("start").cast("timestamp_ntz").alias("start"), (F.round("re", 4) + 0.0).alias("re"), (F.round("im", 4) + 0.0).alias("im"))


@register("""WITH f AS (SELECT l_orderkey // 50 AS n, l_orderkey % 50 AS t, l_partkey // 50 AS z, l_partkey % 50 AS x, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3, 4)
 SELECT n, t // 2 AS t, z // 2 AS z, x // 2 AS x, max(value) AS value FROM f GROUP BY 1, 2, 3, 4""")
def field_pooling(spark, d):
    row, col = F.col("l_orderkey"), F.col("l_partkey")
    f = _table(spark, d, "lineitem").groupBy(F.floor(row / T).alias("n"), (row % T).alias("t"), F.floor(col / X).alias("z"), (col % X).alias("x")).agg(F.sum("l_quantity").alias("value"))
    return signals.halve(f, "max")
