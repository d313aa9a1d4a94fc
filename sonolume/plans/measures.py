"""Registered queries: complex matrices, views, selections, repeats, histories of reconstructions, names and sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fourier, patterns
from ..operators import grids, metrics, scans, signals, smatrix, stencil
from . import solvers
from .acquisition import _codes
from .catalogue import _A, _BITS, _G, _GRAD, _I, _P, _S, T, X, _grid, _image, _matrix, _series, _table, register

_C = """a AS (SELECT l_orderkey AS row_id, l_partkey AS col_id, sum(l_quantity) AS vre, sum(l_discount * 100) AS vim FROM lineitem GROUP BY 1, 2),
 y AS (SELECT l_orderkey AS row_id, sum(l_extendedprice) AS yre, sum(l_tax * 1000) AS yim FROM lineitem GROUP BY 1)"""


def _complex(spark, d):
    rows = _table(spark, d, "lineitem")
    a = rows.groupBy(F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("col_id")).agg(F.sum("l_quantity").alias("vre"), F.sum(F.col("l_discount") * 100).alias("vim"))
    return a, rows.groupBy(F.col("l_orderkey").alias("row_id")).agg(F.sum("l_extendedprice").alias("yre"), F.sum(F.col("l_tax") * 1000).alias("yim"))


def _rounded(df, digits: int, *names):
    """df with the named columns rounded, minus zero as zero."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if c in names else c for c in df.columns))


@register(f"WITH {_C}, {_I} SELECT row_id, round(sum(vre * value), 4) AS qre, round(sum(vim * value), 4) + 0.0 AS qim FROM a JOIN i USING (col_id) GROUP BY 1")
def forward_projection_complex(spark, d):
    """Of the order lines as they stand: lines of one cell add up in the product."""
    lines = _table(spark, d, "lineitem")
    entries = lines.select(F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("col_id"), F.col("l_quantity").alias("vre"), (F.col("l_discount") * 100).alias("vim"))
    return _rounded(smatrix.forward_complex(entries, _image(spark, d)), 4, "qre", "qim")


@register(f"WITH {_C} SELECT col_id, round(greatest(sqrt(power(sum(vre), 2) + power(sum(vim), 2)), 1e-10), 6) AS sens FROM a GROUP BY 1")
def column_sensitivity_complex(spark, d):
    return _rounded(smatrix.sensitivity_complex(_complex(spark, d)[0]), 6, "sens")


def _mlem_sql(rounds: int) -> str:
    parts = [_C, "s AS (SELECT col_id, greatest(sqrt(power(sum(vre), 2) + power(sum(vim), 2)), 1e-10) AS sens FROM a GROUP BY 1)", "x0 AS (SELECT DISTINCT col_id, CAST(0.1 AS DOUBLE) AS value FROM a)"]
    for k in range(rounds):
        parts += [
            f"q{k} AS MATERIALIZED (SELECT row_id, sum(vre * value) AS qre, sum(vim * value) AS qim FROM a JOIN x{k} USING (col_id) GROUP BY 1)",
            f"r{k} AS MATERIALIZED (SELECT row_id, (yre * qre + yim * qim) / (qre * qre + qim * qim) AS re, (yim * qre - yre * qim) / (qre * qre + qim * qim) AS im FROM y JOIN q{k} USING (row_id))",
            f"c{k} AS MATERIALIZED (SELECT col_id, sum(vre * re + vim * im) AS c FROM a JOIN r{k} USING (row_id) GROUP BY 1)",
            f"x{k + 1} AS MATERIALIZED (SELECT col_id, greatest(0, value * c / sens) AS value FROM x{k} JOIN s USING (col_id) JOIN c{k} USING (col_id))",
        ]
    return f"WITH {', '.join(parts)} SELECT col_id, round(value, 4) AS value FROM x{rounds}"


@register(_mlem_sql(2))
def mlem_complex_2(spark, d):
    return _rounded(solvers.mlem_complex(*_complex(spark, d), 2), 4, "value")


def _gradient_sql(rounds: int, step: float, momentum: bool) -> str:
    parts, t = [_C, "x0 AS (SELECT DISTINCT col_id, CAST(0 AS DOUBLE) AS value, CAST(0 AS DOUBLE) AS ahead FROM a)"], 1.0
    for k in range(rounds):
        nxt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        push = (t - 1) / nxt if momentum else 0.0
        parts += [
            f"r{k} AS MATERIALIZED (SELECT row_id, sum(vre * ahead) - any_value(yre) AS re, sum(vim * ahead) - any_value(yim) AS im FROM a JOIN x{k} USING (col_id) JOIN y USING (row_id) GROUP BY 1)",
            f"n{k} AS MATERIALIZED (SELECT col_id, value AS old, greatest(0, ahead - {step} * c) AS value FROM x{k} JOIN (SELECT col_id, sum(vre * re + vim * im) AS c FROM a JOIN r{k} USING (row_id) GROUP BY 1) USING (col_id))",
            f"x{k + 1} AS MATERIALIZED (SELECT col_id, value, value + CAST({push!r} AS DOUBLE) * (value - old) AS ahead FROM n{k})",
        ]
        t = nxt
    return f"WITH {', '.join(parts)} SELECT col_id, round(value, 4) AS value FROM x{rounds}"


@register(_gradient_sql(2, 1e-6, False))
def gradient_complex_2(spark, d):
    return _rounded(solvers.gradient_complex(*_complex(spark, d), 2, 1e-6), 4, "value")


@register(_gradient_sql(3, 1e-6, True))
def fista_complex_3(spark, d):
    return _rounded(solvers.gradient_complex(*_complex(spark, d), 3, 1e-6, momentum=True), 4, "value")


_VIEW = smatrix.View(T, X, t_range=(5, 44), t_step=3, z_range=(1, 4), x_range=(10, 40))
_SEEN = "row_id % 50 >= 5 AND row_id % 50 < 44 AND row_id % 50 % 3 = 0 AND col_id // 50 >= 1 AND col_id // 50 < 4 AND col_id % 50 >= 10 AND col_id % 50 < 40"


@register(f"WITH {_A}, {_I} SELECT row_id // 50 * 13 + (row_id % 50 - 6) // 3 AS row_id, round(sum(v * value), 4) AS q FROM a JOIN i USING (col_id) WHERE {_SEEN} GROUP BY 1")
def view_projection(spark, d):
    """Forward projection through a view: the image is gathered, rows and columns are the effective ones."""
    a = _VIEW.of(_matrix(spark, d))
    a = a.select(_VIEW.effective_row(F.col("row_id")).alias("row_id"), _VIEW.effective_column(F.col("col_id")).alias("col_id"), "v")
    return _rounded(smatrix.forward(a, _VIEW.gather(_image(spark, d))), 4, "q")


@register(f"""WITH {_A}, y AS (SELECT l_orderkey AS row_id, sum(l_extendedprice) AS y FROM lineitem GROUP BY 1), {_I}, c AS (SELECT col_id, sum(v * y) AS c FROM a JOIN y USING (row_id) WHERE {_SEEN} GROUP BY 1)
 SELECT col_id, round(coalesce(c, 0), 3) AS value FROM i LEFT JOIN c USING (col_id)""")
def view_back_projection(spark, d):
    """Back-projection through a view, scattered into the whole image; pixels outside are zero."""
    a, y = _VIEW.of(_matrix(spark, d)), _table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(F.sum("l_extendedprice").alias("y"))
    small = smatrix.backward(a.withColumn("col_id", _VIEW.effective_column(F.col("col_id"))), y).withColumnRenamed("c", "value")
    pixels = _image(spark, d).select("col_id")
    return pixels.join(_VIEW.scatter(small), "col_id", "left").select("col_id", F.round(F.coalesce("value", F.lit(0.0)), 3).alias("value"))


_FIELDS = """f AS (SELECT event_id AS n, round((user_id % 3) / 7.0, 5) AS fs, round((user_id % 2) / 3.0, 5) AS theta, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 END AS phase,
 user_id % 5 AS t, user_id % 7 AS z, user_id % 11 AS x, value AS y FROM events WHERE event_type IN ('view', 'click', 'purchase', 'signup'))"""


@register(f"""WITH {_FIELDS}, p AS (SELECT fs, theta, t, z, x, phase, min(n) AS first, list_reduce(list(y ORDER BY n, y), lambda a, b: (a + b) / 2) AS y FROM f GROUP BY ALL)
 SELECT fs, theta, t, z, x, round(CASE WHEN fs = 0 THEN arg_min(y, first) ELSE (coalesce(sum(y) FILTER (WHERE phase = 0), 0) - coalesce(sum(y) FILTER (WHERE phase = 2), 0)) * pi() / 2 END, 6) + 0.0 AS re,
 round(CASE WHEN fs = 0 THEN 0 ELSE (coalesce(sum(y) FILTER (WHERE phase = 3), 0) - coalesce(sum(y) FILTER (WHERE phase = 1), 0)) * pi() / 2 END, 6) + 0.0 AS im FROM p GROUP BY 1, 2, 3, 4, 5""")
def field_demodulation(spark, d):
    phase = F.create_map(*[F.lit(x) for p in (("view", 0), ("click", 1), ("purchase", 2), ("signup", 3)) for x in p])[F.col("event_type")]
    u = F.col("user_id")
    fields = _table(spark, d, "events").select(
        F.col("event_id").alias("n"), ((u % 3) / 7.0).alias("fs"), ((u % 2) / 3.0).alias("theta"), phase.alias("phase"), (u % 5).alias("t"), (u % 7).alias("z"), (u % 11).alias("x"), F.col("value").alias("y")
    ).where("phase is not null")
    return _rounded(signals.demodulate_fields(fields), 6, "re", "im")


@register("WITH k AS (SELECT DISTINCT round((user_id % 13) / 7.0, 5) AS fs, round((user_id % 9) / 3.0, 5) AS theta FROM events) SELECT fs, theta, CAST(row_number() OVER (ORDER BY fs, theta) - 1 AS INTEGER) AS rank FROM k")
def emission_ranks(spark, d):
    keys = _table(spark, d, "events").select(F.round((F.col("user_id") % 13) / 7.0, 5).alias("fs"), F.round((F.col("user_id") % 9) / 3.0, 5).alias("theta"))
    return scans.key_ranks(keys, ["fs", "theta"])


@register(f"WITH {_P} SELECT n, code, CAST(angle AS INTEGER) AS angle FROM p WHERE angle IN (-10, 0, 10)")
def angle_selection(spark, d):
    return scans.having(_codes(spark, d), "angle", [-10, 0, 10])


@register(f"""WITH {_P}, {_BITS}, e AS (SELECT n, i, CAST(bits[i + 1] AS INTEGER) AS v FROM b, range(0, 48) r(i)), k AS (SELECT k FROM range(1, 24) r(k)),
 m AS (SELECT n, k, round(sqrt(power(sum(v * cos(2 * pi() * k * i / 48)), 2) + power(sum(v * sin(2 * pi() * k * i / 48)), 2)), 6) AS p FROM e, k GROUP BY 1, 2),
 o AS (SELECT n, CAST(first(k ORDER BY p DESC, k) AS INTEGER) AS decimation FROM m GROUP BY 1) SELECT n, decimation FROM o WHERE decimation IN (3, 7, 11)""")
def decimation_selection(spark, d):
    bins = _codes(spark, d).select("n", fourier.dominant_bin(patterns.hex_to_bits(F.col("code"), 48)).cast("int").alias("decimation"))
    return scans.having(bins, "decimation", [3, 7, 11])


_NAME = "'field_' || code || '_' || (CASE WHEN angle < 0 THEN '1' ELSE '0' END) || lpad(CAST(abs(angle) AS VARCHAR), 2, '0')"


@register(f"WITH {_P}, w AS (SELECT n, {_NAME} AS name FROM p) SELECT name, n FROM w WHERE n IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def name_selection(spark, d):
    named = _codes(spark, d).select("n", patterns.field_name(F.col("code"), F.col("angle")).alias("name"))
    wanted = _table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("n")).distinct()
    return scans.named(named, named.join(wanted, "n").select("name")).select("name", "n")


@register(f"WITH {_P}, w AS (SELECT n, code, angle, {_NAME} AS name FROM p) SELECT n, code AS pattern, CAST(angle AS INTEGER) AS angle, CASE WHEN angle = 0 THEN '000' WHEN angle < 0 THEN '0' || lpad(CAST(-angle AS VARCHAR), 2, '0') ELSE '1' || lpad(CAST(angle AS VARCHAR), 2, '0') END AS flipped FROM w")
def name_parts(spark, d):
    """Pattern, angle and the mirrored angle's code, all read from the path of a field."""
    path = F.concat(F.lit("some_folder/of_1/"), patterns.field_name(F.col("code"), F.col("angle")))
    named = _codes(spark, d).select("n", path.alias("path"))
    return named.select("n", patterns.pattern_of(F.col("path")).alias("pattern"), patterns.angle_of(F.col("path")).alias("angle"), patterns.flipped_code(F.element_at(F.split("path", "_"), -1)).alias("flipped"))


@register(f"WITH {_P}, k AS (SELECT n, code, unnest([-5, 0, 12]) AS angle FROM p) SELECT n, 'fields/' || {_NAME} || '.hdr' AS path FROM k")
def pattern_paths(spark, d):
    angles = F.array(*map(F.lit, (-5, 0, 12)))
    return _codes(spark, d).select("n", F.explode(patterns.pattern_paths("fields", F.col("code"), angles)).alias("path"))


@register("SELECT l_orderkey // 50 AS n, l_orderkey % 50 AS t, round(avg(l_quantity), 6) AS y FROM lineitem WHERE l_linenumber >= 2 AND l_linenumber < 5 GROUP BY 1, 2")
def repeats_mean(spark, d):
    """Line numbers as repeats of a signal, three of them from the second on."""
    k = F.col("l_orderkey")
    rows = _table(spark, d, "lineitem").select(F.floor(k / T).alias("n"), (k % T).alias("t"), F.col("l_linenumber").alias("repeat"), F.col("l_quantity").alias("y"))
    return _rounded(scans.mean_of_repeats(rows, 2, 3), 6, "y")


_LONG = "e AS (SELECT user_id % 20 AS n, CAST(floor(epoch(ts) / 3600) AS BIGINT) % 500 + user_id % 20 AS t, value AS y FROM events)"


@register(f"WITH {_LONG}, m AS (SELECT min(size) AS length FROM (SELECT n, max(t) + 1 AS size FROM e GROUP BY 1)) SELECT n, t, count(*) AS samples FROM e, m WHERE t < length GROUP BY 1, 2")
def aligned_signals(spark, d):
    u = F.col("user_id") % 20
    rows = _table(spark, d, "events").select(u.alias("n"), (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) % 500 + u).alias("t"), F.col("value").alias("y"))
    return scans.aligned(rows, rows).groupBy("n", "t").agg(F.count(F.lit(1)).alias("samples"))


@register("""WITH o AS (SELECT o_orderkey AS n, o_orderkey // 63 AS z, CASE WHEN o_orderkey // 63 % 2 = 0 THEN o_orderkey % 63 ELSE 62 - o_orderkey % 63 END AS p FROM orders)
 SELECT n, CASE WHEN p // 9 % 2 = 0 THEN p % 9 ELSE 8 - p % 9 END AS x, p // 9 AS y, z FROM o""")
def hydrophone_stops(spark, d):
    """Places of the stops of a hydrophone that scans planes of 9 x 7 points back and forth."""
    x, y, z = scans.serpentine_volume(F.col("o_orderkey"), 9, 7)
    return _table(spark, d, "orders").select(F.col("o_orderkey").alias("n"), x.alias("x"), y.alias("y"), z.alias("z"))


_ROUNDS = "i AS (SELECT k AS iter, p_partkey AS col_id, p_retailprice * (k + 1) / 5 + p_size AS value, p_retailprice AS truth FROM part, range(0, 4) r(k))"


def _rounds(spark, d):
    part = _table(spark, d, "part").withColumn("iter", F.explode(F.array(*[F.lit(k).cast("long") for k in range(4)])))
    images = part.select("iter", F.col("p_partkey").alias("col_id"), (F.col("p_retailprice") * (F.col("iter") + 1) / 5 + F.col("p_size")).alias("value"))
    return images, _image(spark, d).withColumnRenamed("value", "truth")


@register(f"WITH {_ROUNDS}, m AS (SELECT min(abs(value - truth)) AS least, max(abs(value - truth)) AS most FROM i WHERE iter > 0) SELECT iter, round(avg(power(value - truth, 2)), 4) AS mse, round(avg(abs(value - truth)), 5) AS noise, round(any_value(least), 6) AS least, round(any_value(most), 6) AS most FROM i, m GROUP BY 1")
def reconstruction_progress(spark, d):
    found = metrics.progress(*_rounds(spark, d))
    return _rounded(_rounded(_rounded(found, 4, "mse"), 5, "noise"), 6, "least", "most")


@register(f"WITH {_ROUNDS}, m AS (SELECT iter, avg(power(value - truth, 2)) AS mse FROM i GROUP BY 1) SELECT arg_min(iter, mse) AS iter, round(min(mse), 4) AS mse FROM m")
def best_round(spark, d):
    return _rounded(metrics.best_iteration(metrics.squared_error(*_rounds(spark, d))), 4, "mse")


@register("""WITH c AS (SELECT l_returnflag AS with_lesion, l_linenumber AS iter, sum(l_extendedprice) AS cost FROM lineitem GROUP BY 1, 2)
 SELECT with_lesion, iter, round(cost / max(cost) OVER (PARTITION BY with_lesion), 8) AS cost FROM c""")
def cost_curves(spark, d):
    costs = _table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("with_lesion"), F.col("l_linenumber").alias("iter")).agg(F.sum("l_extendedprice").alias("cost"))
    return _rounded(metrics.relative_costs(costs, "with_lesion"), 8, "cost")


@register("""WITH RECURSIVE h AS (SELECT p_size AS iter, avg(p_retailprice) AS noise FROM part GROUP BY 1), m AS (SELECT *, row_number() OVER (ORDER BY iter) AS k FROM h),
 s AS (SELECT k, iter, noise, noise AS last, true AS taken FROM m WHERE k = 1 UNION ALL
  SELECT m.k, m.iter, m.noise, CASE WHEN abs(m.noise - s.last) > 10 THEN m.noise ELSE s.last END, abs(m.noise - s.last) > 10 FROM s JOIN m ON m.k = s.k + 1)
 SELECT iter, round(noise, 6) AS noise FROM s WHERE taken""")
def noise_steps(spark, d):
    history = _table(spark, d, "part").groupBy(F.col("p_size").alias("iter")).agg(F.avg("p_retailprice").alias("noise"))
    return _rounded(metrics.apart_by_noise(history, 10.0), 6, "noise")


@register("SELECT round((avg(p_retailprice + p_size) / avg(p_retailprice) - 1) / (avg(2 * p_retailprice + p_size) / avg(p_retailprice + 1) - 1), 8) AS crc FROM part")
def contrast_recovered(spark, d):
    part = _table(spark, d, "part")
    col, price, size = F.col("p_partkey").alias("col_id"), F.col("p_retailprice"), F.col("p_size")
    truth = part.select(col, (2 * price + size).alias("truth_with"), (price + 1).alias("truth_without"))
    return _rounded(metrics.contrast_recovery(part.select(col, (price + size).alias("value")), part.select(col, price.alias("value")), truth), 8, "crc")


@register("""WITH f AS (SELECT user_id % 15 AS z, user_id % 12 AS x, max(value * value) AS v FROM events GROUP BY 1, 2)
 SELECT z, x, round(sqrt(v), 6) AS value, round(CASE WHEN v > 0 THEN 20 * log10(sqrt(v) / (SELECT max(sqrt(v)) FROM f)) END, 6) + 0.0 AS db FROM f""")
def peak_image(spark, d):
    field = _table(spark, d, "events").select((F.col("user_id") % 15).alias("z"), (F.col("user_id") % 12).alias("x"), (F.col("value") * F.col("value")).alias("value"))
    return _rounded(metrics.maximum_projection(field), 6, "value", "db")


@register(f"WITH {_ROUNDS}, w AS (SELECT *, col_id // 50 < 2 AND col_id % 50 < 20 AS inside FROM i) SELECT iter, round(avg(value) FILTER (WHERE inside), 6) AS inside, round(avg(value) FILTER (WHERE NOT inside), 6) AS outside, round(avg(value) FILTER (WHERE inside) / avg(value) FILTER (WHERE NOT inside) - 1, 8) AS contrast FROM w GROUP BY 1")
def region_contrast(spark, d):
    images = _rounds(spark, d)[0].select("iter", F.floor(F.col("col_id") / X).alias("z"), (F.col("col_id") % X).alias("x"), "value")
    region = _grid(spark, d).where("z < 2 AND x < 20").select("z", "x")
    return _rounded(_rounded(metrics.regional_contrast(images, region), 6, "inside", "outside"), 8, "contrast")


@register("SELECT l.p_partkey AS n, l.p_brand AS a, r.p_brand AS b FROM part l JOIN part r ON r.p_partkey = l.p_partkey + 1 WHERE l.p_brand <> r.p_brand UNION ALL SELECT p_partkey, p_brand, NULL FROM part WHERE p_partkey = (SELECT max(p_partkey) FROM part) UNION ALL SELECT p_partkey - 1, NULL, p_brand FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part)")
def list_differences(spark, d):
    lines = _table(spark, d, "part").select(F.col("p_partkey").alias("n"), F.col("p_brand").alias("line"))
    return scans.differing(lines, lines.withColumn("n", F.col("n") - 1))


@register(f"WITH {_S} SELECT n, t - 10 AS t, phase, round(y, 6) AS y FROM (SELECT n, t - (SELECT min(t) FROM s) AS t, phase, y FROM s) WHERE t >= 10 AND t < 200")
def signal_crop(spark, d):
    series = _series(spark, d)
    shifted = series.crossJoin(F.broadcast(series.agg(F.min("t").alias("least")))).select("n", (F.col("t") - F.col("least")).alias("t"), "phase", "y")
    return _rounded(signals.crop(shifted, 10, 200), 6, "y")


@register(f"WITH {_G} SELECT (z - 1) // 2 AS z, (x - 10) // 2 AS x, value FROM g WHERE z >= 1 AND z < 4 AND x >= 10 AND x < 40 AND (z - 1) % 2 = 0 AND (x - 10) % 2 = 0")
def image_crop(spark, d):
    return stencil.crop(_grid(spark, d), (1, 4), (10, 40), 2)


@register(f"WITH {_G} SELECT z, 49 - x AS x, value FROM g")
def field_flip(spark, d):
    return scans.flip_fields(_grid(spark, d), X).select("z", "x", "value")


@register("SELECT p_partkey AS n, CAST(power(2, ceil(log2(p_partkey + 1))) AS BIGINT) AS padded, CAST(greatest(2, floor(p_size * 0.3 / 0.7 + 1e-9)) AS BIGINT) AS samples FROM part")
def grid_sizes(spark, d):
    return _table(spark, d, "part").select(F.col("p_partkey").alias("n"), patterns.next_power_of_2(F.col("p_partkey") + 1).alias("padded"), patterns.target_size(F.col("p_size"), F.lit(0.3), F.lit(0.7)).cast("long").alias("samples"))


_WAYS = "w AS (SELECT p_partkey AS n, i, sqrt(power((i - 7.5) * 0.2 - (p_partkey % 7 - 3), 2) + power(10 + p_size, 2)) / 1.54 AS way FROM part, range(0, 16) r(i))"


@register(f"WITH {_WAYS} SELECT n, i, round(max(way) OVER (PARTITION BY n) - way, 8) + 0.0 AS delay FROM w")
def focus_delay_laws(spark, d):
    delays = patterns.focus_delays(16, 0.2, (F.col("p_partkey") % 7 - 3).cast("double"), (F.col("p_size") + 10).cast("double"), 1.54)
    laws = _table(spark, d, "part").select(F.col("p_partkey").alias("n"), F.posexplode(delays).alias("i", "delay"))
    return _rounded(laws.withColumn("i", F.col("i").cast("long")), 8, "delay")


@register(f"""WITH {_G}, p AS (SELECT z, x, abs(((x - 25) * 0.2 - z * 2 * tan(radians(10))) / (3 + z * 2 * tan(radians(0.5)))) AS r FROM g)
 SELECT z, x, CAST(round(CASE WHEN r <= 0.7 THEN 1.0 WHEN r <= 1 THEN 0.5 * (1 + cos(pi() * (r - 0.7) / 0.3)) ELSE 0.0 END, 6) AS DOUBLE) AS w FROM p""")
def beam_window(spark, d):
    return _grid(spark, d).select("z", "x", F.round(patterns.steered_window((F.col("x") - 25) * 0.2, F.col("z") * 2.0, F.lit(10.0), 6.0), 6).alias("w"))


@register("""WITH g AS (SELECT p_partkey // 50 AS z, p_partkey % 50 AS x, p_retailprice AS a, p_retailprice + p_size AS b FROM part),
 h AS (SELECT z, x, sum(a) OVER w AS a, sum(b) OVER w AS b, sum(a * a) OVER w AS aa, sum(b * b) OVER w AS bb, sum(a * b) OVER w AS ab, count(*) OVER w AS n FROM g WINDOW w AS (PARTITION BY z ORDER BY x RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
 v AS (SELECT z, x, sum(a) OVER w / 49 AS a, sum(b) OVER w / 49 AS b, sum(aa) OVER w / 49 AS aa, sum(bb) OVER w / 49 AS bb, sum(ab) OVER w / 49 AS ab, sum(n) OVER w AS n FROM h WINDOW w AS (PARTITION BY x ORDER BY z RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
 r AS (SELECT power(0.01 * (max(b) - min(b)), 2) AS c1, power(0.03 * (max(b) - min(b)), 2) AS c2 FROM g)
 SELECT round(avg((2 * a * b + c1) * (2 * 49 / 48 * (ab - a * b) + c2) / ((a * a + b * b + c1) * (49 / 48 * (aa - a * a + bb - b * b) + c2))), 7) AS ssim FROM v, r WHERE n = 49""")
def image_similarity_7(spark, d):
    part = _table(spark, d, "part").select(F.floor(F.col("p_partkey") / X).alias("z"), (F.col("p_partkey") % X).alias("x"), F.col("p_retailprice").alias("a"), (F.col("p_retailprice") + F.col("p_size")).alias("b"))
    found = metrics.structural_similarity(part.select("z", "x", F.col("a").alias("value")), part.select("z", "x", F.col("b").alias("value")))
    return _rounded(found, 7, "ssim")


_RULES = (("relative_change", 45.0, 3), ("gradient_norm", 40.0, 2), ("cost", 0.4, 2), ("squared_error", 0.6, 4), ("max_iterations", 5.0, 1))


def _stopping_sql() -> str:
    parts = []
    for kind, threshold, window in _RULES:
        if kind == "max_iterations":
            parts.append(f"SELECT '{kind}' AS rule, run, iter FROM k WHERE k = {threshold:g}")
            continue
        step = "value" if kind in ("relative_change", "gradient_norm") else "abs(value - before) / (abs(before) + 1e-10)"
        parts.append(f"""SELECT '{kind}' AS rule, run, min(iter) AS iter FROM (
            SELECT run, iter, k, avg(CASE WHEN k > 1 THEN {step} END) OVER (PARTITION BY run ORDER BY iter ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS mean FROM k
        ) WHERE k > 1 AND mean < {threshold} GROUP BY run""")
    return f"""
        WITH {_S}, h AS (SELECT n AS run, t AS iter, sum(y) AS value FROM s GROUP BY 1, 2),
        k AS (SELECT *, row_number() OVER w AS k, lag(value) OVER w AS before FROM h WINDOW w AS (PARTITION BY run ORDER BY iter))
        {" UNION ALL ".join(parts)}
    """


@register(_stopping_sql())
def stopping_rounds(spark, d):
    """Hours of each user's events as the rounds of a run: where each rule would have ended it."""
    history = _series(spark, d).groupBy(F.col("n").alias("run"), F.col("t").alias("iter")).agg(F.sum("y").alias("value"))
    found = [metrics.stopping_rounds(history, *rule, ["run"]).select(F.lit(rule[0]).alias("rule"), "run", "iter") for rule in _RULES]
    return found[0].unionAll(found[1]).unionAll(found[2]).unionAll(found[3]).unionAll(found[4])


def _complex_ratio(k: int) -> list[str]:
    """q, the ratio y / q and Re A^H of it, from the image x_k."""
    return [
        f"q{k} AS MATERIALIZED (SELECT row_id, sum(vre * value) AS qre, sum(vim * value) AS qim FROM a JOIN x{k} USING (col_id) GROUP BY 1)",
        f"r{k} AS MATERIALIZED (SELECT row_id, (yre * qre + yim * qim) / (qre * qre + qim * qim) AS re, (yim * qre - yre * qim) / (qre * qre + qim * qim) AS im FROM y JOIN q{k} USING (row_id))",
        f"c{k} AS MATERIALIZED (SELECT col_id, sum(vre * re + vim * im) AS c FROM a JOIN r{k} USING (row_id) GROUP BY 1)",
    ]


def _mapem_complex_sql(rounds: int, beta: float) -> str:
    parts = [_C, "s AS (SELECT col_id, greatest(sqrt(power(sum(vre), 2) + power(sum(vim), 2)), 1e-10) AS sens FROM a GROUP BY 1)", "x0 AS (SELECT DISTINCT col_id, CAST(0.1 AS DOUBLE) AS value FROM a)"]
    for k in range(rounds):
        parts += [
            *_complex_ratio(k),
            f"""p{k} AS MATERIALIZED (
                SELECT l.col_id, sum({beta} * (l.value - r.value)) AS grad FROM x{k} l JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dz, dx) ON true
                JOIN x{k} r ON r.col_id // {X} = l.col_id // {X} + o.dz AND r.col_id % {X} = l.col_id % {X} + o.dx GROUP BY 1
            )""",
            f"x{k + 1} AS MATERIALIZED (SELECT col_id, greatest(0, value * coalesce(c, 0) / greatest(sens + coalesce(grad, 0), 1e-10)) AS value FROM x{k} JOIN s USING (col_id) LEFT JOIN c{k} USING (col_id) LEFT JOIN p{k} USING (col_id))",
        ]
    return f"WITH {', '.join(parts)} SELECT col_id, round(value, 4) AS value FROM x{rounds}"


@register(_mapem_complex_sql(2, 0.01))
def mapem_complex_2(spark, d):
    return _rounded(solvers.reconstruct(*_complex(spark, d), "mapem", 2, prior=solvers.Prior(0.01, X)).image, 4, "value")


def _conjugate_complex_sql(rounds: int, step: float) -> str:
    parts = [_C, "x0 AS (SELECT DISTINCT col_id, CAST(0.1 AS DOUBLE) AS value, CAST(0 AS DOUBLE) AS d FROM a)"]
    for k in range(rounds):
        share = "0" if k == 0 else f"(SELECT sum(r * r) FROM r{k}) / ((SELECT sum(r * r) FROM r{k - 1}) + 1e-10)"
        parts += [
            f"e{k} AS MATERIALIZED (SELECT row_id, sum(vre * value) - any_value(yre) AS re, sum(vim * value) - any_value(yim) AS im FROM a JOIN x{k} USING (col_id) JOIN y USING (row_id) GROUP BY 1)",
            f"r{k} AS MATERIALIZED (SELECT col_id, -sum(vre * re + vim * im) AS r FROM a JOIN e{k} USING (row_id) GROUP BY 1)",
            f"d{k} AS MATERIALIZED (SELECT col_id, value, r + {share} * d AS d FROM x{k} JOIN r{k} USING (col_id))",
            f"x{k + 1} AS MATERIALIZED (SELECT col_id, greatest(0, value + {step} * d) AS value, d FROM d{k})",
        ]
    return f"WITH {', '.join(parts)} SELECT col_id, round(value, 4) AS value FROM x{rounds}"


@register(_conjugate_complex_sql(2, 1e-7))
def conjugate_complex_2(spark, d):
    return _rounded(solvers.reconstruct(*_complex(spark, d), "conjugate", 2, step_size=1e-7).image, 4, "value")


_LOW = "SELECT greatest(quantile_cont(t, 0.5) * 1e-6, 1e-12) FROM"


@register(f"""
    WITH {_C}, rt AS (SELECT row_id, sum(sqrt(vre * vre + vim * vim)) AS t FROM a GROUP BY 1), ct AS (SELECT col_id, sum(sqrt(vre * vre + vim * vim)) AS t FROM a GROUP BY 1),
    sg AS (SELECT row_id, 0.99 / greatest(t, ({_LOW} rt)) AS sigma FROM rt), last AS (SELECT max(col_id) // {X} AS z FROM ct),
    ta AS (
        SELECT col_id, 0.99 / (greatest(t, ({_LOW} ct)) + 4 - CAST(col_id // {X} = 0 AS INT) - CAST(col_id // {X} = last.z AS INT)
               - CAST(col_id % {X} = 0 AS INT) - CAST(col_id % {X} = {X} - 1 AS INT)) AS tau FROM ct, last
    ),
    d1 AS MATERIALIZED (SELECT row_id, sigma, yre, yim, -sigma * yre / (1 + sigma) AS dre, -sigma * yim / (1 + sigma) AS dim FROM sg JOIN y USING (row_id)),
    x1 AS MATERIALIZED (SELECT col_id, tau, greatest(0, -tau * sum(vre * dre + vim * dim)) AS u FROM a JOIN d1 USING (row_id) JOIN ta USING (col_id) GROUP BY 1, 2),
    d2 AS MATERIALIZED (
        SELECT row_id, (any_value(dre) + any_value(sigma) * (sum(vre * 2 * u) - any_value(yre))) / (1 + any_value(sigma)) AS dre,
               (any_value(dim) + any_value(sigma) * (sum(vim * 2 * u) - any_value(yim))) / (1 + any_value(sigma)) AS dim
        FROM a JOIN x1 USING (col_id) JOIN d1 USING (row_id) GROUP BY 1
    ),
    g AS (SELECT col_id // {X} AS z, col_id % {X} AS x, 2 * u AS value FROM x1), {_GRAD},
    n AS (SELECT z, x, 0.495 * gz AS gz, 0.495 * gx AS gx, sqrt(power(0.495 * gz, 2) + power(0.495 * gx, 2) + 1e-12) AS n FROM f),
    tv AS (SELECT z, x, gz * CASE WHEN n > 0.1 THEN 0.1 / n ELSE 1 END AS gz, gx * CASE WHEN n > 0.1 THEN 0.1 / n ELSE 1 END AS gx FROM n),
    dv AS (
        SELECT z, x, CASE WHEN lead(1) OVER v IS NULL THEN 0 ELSE gz END - coalesce(lag(gz) OVER v, 0)
               + CASE WHEN lead(1) OVER h IS NULL THEN 0 ELSE gx END - coalesce(lag(gx) OVER h, 0) AS div
        FROM tv WINDOW v AS (PARTITION BY x ORDER BY z), h AS (PARTITION BY z ORDER BY x)
    ),
    c2 AS (SELECT col_id, sum(vre * dre + vim * dim) AS c FROM a JOIN d2 USING (row_id) GROUP BY 1)
    SELECT col_id, round(greatest(0, u - tau * (c - div)), 4) + 0.0 AS value FROM x1 JOIN c2 USING (col_id) JOIN dv ON dv.z = col_id // {X} AND dv.x = col_id % {X}
""")
def primal_dual_complex_2(spark, d):
    a, y = _complex(spark, d)
    lines = a.agg(F.max("col_id")).first()[0] // X + 1
    return _rounded(solvers.reconstruct(a, y, "primal_dual", 2, beta=0.1, x_size=X, z_size=lines).image, 4, "value")


@register("""
    WITH s AS (SELECT max(p_partkey) // 50 + 1 AS depth FROM part),
    i AS (SELECT p_partkey // 50 AS z, p_partkey % 50 AS x, p_retailprice AS value FROM part),
    w AS (SELECT l_partkey // 50 AS z, l_partkey % 50 AS x, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2),
    t AS (
        SELECT z, x, (CAST(0.8 AS DOUBLE) * z - CAST(1.5 AS DOUBLE)) / CAST(0.5 AS DOUBLE) AS fz, (CAST(0.75 AS DOUBLE) * x - 7) / CAST(0.7 AS DOUBLE) AS fx
        FROM s, range(0, s.depth) a(z), range(0, 50) b(x)
    ),
    o AS (SELECT t.* FROM t, s WHERE fz >= 0 AND fz <= depth - 1 AND fx >= 0 AND fx <= 49),
    c AS (
        SELECT z, x, CAST(floor(fz) AS BIGINT) + dz AS cz, CAST(floor(fx) AS BIGINT) + dx AS cx,
               (CASE WHEN dz = 1 THEN fz - floor(fz) ELSE 1 - fz + floor(fz) END) * (CASE WHEN dx = 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END) AS weight
        FROM o, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(dz, dx)
    ),
    v AS (SELECT c.z, c.x, sum(c.weight * coalesce(i.value, 0)) AS value FROM c LEFT JOIN i ON i.z = c.cz AND i.x = c.cx GROUP BY 1, 2),
    f AS (SELECT min(z) AS z, min(x) AS x FROM o)
    SELECT v.z - f.z AS z, v.x - f.x AS x, round(v.value, 6) AS value, coalesce(w.value, 0) AS truth FROM v LEFT JOIN w ON w.z = v.z AND w.x = v.x, f
""")
def truth_on_grid(spark, d):
    """The image brought to the grid of another, whose ends differ on all four sides; both cut to what they share."""
    image = _grid(spark, d)
    depth = (image.agg(F.max("z")).first()[0] or 0) + 1
    truth = _table(spark, d, "lineitem").groupBy(F.floor(F.col("l_partkey") / X).alias("z"), (F.col("l_partkey") % X).alias("x")).agg(F.sum("l_quantity").alias("value"))
    source, target = (grids.Even(1.5, 0.5, depth), grids.Even(7.0, 0.7, X)), (grids.Even(0.0, 0.8, depth), grids.Even(0.0, 0.75, X))
    return _rounded(grids.with_truth(image, truth, source, target), 6, "value")


@register("""
    WITH p AS (SELECT p_partkey AS n, substr(md5(CAST(p_partkey AS VARCHAR)), 1, 12) AS code, p_partkey % 41 - 20 AS angle FROM part)
    SELECT n, code, CAST(angle AS INTEGER) AS angle FROM p
""")
def list_from_matrix(spark, d):
    """Scans from a matrix with a row for each element."""
    codes = _codes(spark, d)
    bits = codes.select("n", F.posexplode(F.split(patterns.hex_to_bits(F.col("code"), 48), "")).alias("i", "bit")).where("bit <> ''")
    return scans.from_matrix(bits.select("n", (47 - F.col("i")).alias("i"), F.col("bit").cast("double").alias("value")), codes, 48)


@register(f"""
    WITH {_P}, size AS (SELECT count(*) AS total FROM part),
    q AS (SELECT row_number() OVER (ORDER BY n) - 1 AS n, code, angle FROM p),
    {_BITS.replace("FROM p)", "FROM q)")},
    r AS (SELECT n, angle, array_to_string(list_transform(range(0, 12), lambda k: format('{{:x}}', CAST(list_reduce(list_transform(range(0, 4), lambda j: CAST(substr(reverse(bits), 4 * k + j + 1, 1) AS INTEGER) * (8 >> j)), lambda a, b: a + b) AS INTEGER))), '') AS code FROM b),
    y AS (SELECT l_partkey - (SELECT min(p_partkey) FROM part) AS n, l_linenumber AS t, sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2)
    SELECT total - 1 - y.n AS n, t, y, code, CAST(-angle AS BIGINT) AS angle, round(1e6 / 1540.0 * sin(radians(-angle)) * CAST(0.0003 AS DOUBLE), 9) + 0.0 AS slope
    FROM size, y JOIN r ON r.n = total - 1 - y.n
""")
def experiment_flip(spark, d):
    """The parts' patterns and the lines' quantities as their signals, seen by a mirrored probe."""
    codes = _codes(spark, d)
    listed, _ = scans.renumber(codes)
    least = codes.agg(F.min("n")).first()[0] or 0
    y = _table(spark, d, "lineitem").groupBy((F.col("l_partkey") - least).alias("n"), F.col("l_linenumber").alias("t")).agg(F.sum("l_quantity").alias("y"))
    turned, moved, _ = scans.flip_experiment(listed, y, None, 48, X, 0.0003, 1540.0)
    slope = (F.element_at("delays", 2) - F.element_at("delays", 1)) * 1e3
    return _rounded(moved.join(turned.select("n", "code", F.col("angle").cast("long").alias("angle"), slope.alias("slope")), "n"), 9, "slope")


@register("""
    WITH s AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(0, 64) r(i))
    SELECT vec_id, k, round(16 * sum(v * cos(2 * pi() * (k - 32) * (i - 32) / 64)), 5) + 0.0 AS re, round(-16 * sum(v * sin(2 * pi() * (k - 32) * (i - 32) / 64)), 5) + 0.0 AS im
    FROM s, range(0, 64) b(k) GROUP BY 1, 2
""")
def signal_transform(spark, d):
    """The spectrum of every vector as a signal with its zero in the middle, a sample each quarter."""
    samples = _table(spark, d, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "re")).select("vec_id", F.col("k").cast("long").alias("k"), "re", F.lit(0.0).alias("im"))
    return _rounded(fourier.centred_transform(samples, ["vec_id"], "k", 64, 0.25), 5, "re", "im")
