"""Registered queries: optimizers with priors, costs, direct reconstructions, image quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import generators, metrics, stencil
from ..session import cut
from . import analytic, focused, solvers
from .catalogue import _A, _G, _GRAD, _PRIOR, _Y, T, X, _grid, _image, _matrix, _signal, _table, register

def _rounded():
    return F.round("value", 4).alias("value")


_FOUR = "(VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dz, dx)"


def _expectation_sql(kind: str, rounds: int, beta: float) -> str:
    parts = [_A, _Y, "s AS (SELECT col_id, sum(v) AS sens FROM a GROUP BY 1)", "x0 AS (SELECT DISTINCT col_id, CAST(0.1 AS DOUBLE) AS value FROM a)"]
    new = {
        "mapem": "x.value * coalesce(c, 0) / greatest(sens + coalesce(grad, 0), 1e-10)",
        "depierro": "x.value + x.value * (coalesce(c, 0) - sens - coalesce(grad, 0)) / greatest(greatest(sens, 1e-10) + x.value * coalesce(hess, 0), 1e-10)",
        "ppgmlem": "x.value + x.value * (coalesce(c, 0) - sens - coalesce(grad, 0)) / greatest(greatest(sens, 1e-10) + x.value * coalesce(hess, 0), 1e-10)",
    }[kind]
    for k in range(rounds):
        parts += [
            f"q{k} AS MATERIALIZED (SELECT row_id, sum(v * value) AS q FROM a JOIN x{k} USING (col_id) GROUP BY 1)",
            f"c{k} AS MATERIALIZED (SELECT col_id, sum(v * y / greatest(q, 1e-10)) AS c FROM a JOIN y USING (row_id) JOIN q{k} USING (row_id) GROUP BY 1)",
            f"""p{k} AS MATERIALIZED (SELECT l.col_id, sum({beta} * (l.value - r.value)) AS grad, sum({beta}) AS hess FROM x{k} l JOIN {_FOUR} ON true
 JOIN x{k} r ON r.col_id // {X} = l.col_id // {X} + o.dz AND r.col_id % {X} = l.col_id % {X} + o.dx GROUP BY 1)""",
            f"x{k + 1} AS MATERIALIZED (SELECT x.col_id, greatest(0, {new}) AS value FROM x{k} x JOIN s USING (col_id) LEFT JOIN c{k} USING (col_id) LEFT JOIN p{k} USING (col_id))",
        ]
    return f"WITH {', '.join(parts)} SELECT col_id, round(value, 4) AS value FROM x{rounds}"


def _with_prior(kind: str):
    def query(spark, d):
        return solvers.reconstruct(_matrix(spark, d), _signal(spark, d), kind, 2, prior=solvers.Prior(0.01, X)).image.select("col_id", _rounded())

    query.__name__ = f"{kind}_2"
    register(_expectation_sql(kind, 2, 0.01))(query)


for _kind in ("mapem", "depierro", "ppgmlem"):
    _with_prior(_kind)


def _fista_sql(rounds: int, step: float) -> str:
    parts, t = [_A, _Y, "x0 AS (SELECT DISTINCT col_id, CAST(0 AS DOUBLE) AS value, CAST(0 AS DOUBLE) AS ahead FROM a)"], 1.0
    for k in range(rounds):
        nxt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        parts += [
            f"r{k} AS MATERIALIZED (SELECT row_id, sum(v * ahead) - any_value(y) AS r FROM a JOIN x{k} USING (col_id) JOIN y USING (row_id) GROUP BY 1)",
            f"n{k} AS MATERIALIZED (SELECT col_id, value AS old, greatest(0, ahead - {step} * c) AS value FROM x{k} JOIN (SELECT col_id, sum(v * r) AS c FROM a JOIN r{k} USING (row_id) GROUP BY 1) USING (col_id))",
            f"x{k + 1} AS MATERIALIZED (SELECT col_id, value, value + CAST({(t - 1) / nxt!r} AS DOUBLE) * (value - old) AS ahead FROM n{k})",
        ]
        t = nxt
    return f"WITH {', '.join(parts)} SELECT col_id, round(value, 4) AS value FROM x{rounds}"


@register(_fista_sql(3, 1e-6))
def fista_3(spark, d):
    return solvers.fista(_matrix(spark, d), _signal(spark, d), 3, 1e-6).select("col_id", _rounded())


def _conjugate_sql(rounds: int, step: float) -> str:
    parts = [_A, _Y, "x0 AS (SELECT DISTINCT col_id, CAST(0.1 AS DOUBLE) AS value, CAST(0 AS DOUBLE) AS d FROM a)"]
    for k in range(rounds):
        share = "0" if k == 0 else f"(SELECT sum(r * r) FROM r{k}) / ((SELECT sum(r * r) FROM r{k - 1}) + 1e-10)"
        parts += [
            f"e{k} AS MATERIALIZED (SELECT row_id, sum(v * value) - any_value(y) AS e FROM a JOIN x{k} USING (col_id) JOIN y USING (row_id) GROUP BY 1)",
            f"r{k} AS MATERIALIZED (SELECT col_id, -sum(v * e) AS r FROM a JOIN e{k} USING (row_id) GROUP BY 1)",
            f"d{k} AS MATERIALIZED (SELECT col_id, value, r + {share} * d AS d FROM x{k} JOIN r{k} USING (col_id))",
            f"x{k + 1} AS MATERIALIZED (SELECT col_id, greatest(0, value + {step} * d) AS value, d FROM d{k})",
        ]
    return f"WITH {', '.join(parts)} SELECT col_id, round(value, 4) AS value FROM x{rounds}"


@register(_conjugate_sql(2, 1e-6))
def conjugate_2(spark, d):
    return solvers.reconstruct(_matrix(spark, d), _signal(spark, d), "conjugate", 2, step_size=1e-6).image.select("col_id", _rounded())


_LEAST = "SELECT greatest(quantile_cont(t, 0.5) * 1e-6, 1e-12) FROM"


@register(f"""WITH {_A}, {_Y}, rt AS (SELECT row_id, sum(abs(v)) AS t FROM a GROUP BY 1), ct AS (SELECT col_id, sum(abs(v)) AS t FROM a GROUP BY 1),
 sg AS (SELECT row_id, 0.99 / greatest(t, ({_LEAST} rt)) AS sigma FROM rt), last AS (SELECT max(col_id) // {X} AS z FROM ct),
 ta AS (SELECT col_id, 0.99 / (greatest(t, ({_LEAST} ct)) + 4 - CAST(col_id // {X} = 0 AS INT) - CAST(col_id // {X} = last.z AS INT) - CAST(col_id % {X} = 0 AS INT) - CAST(col_id % {X} = {X} - 1 AS INT)) AS tau FROM ct, last),
 d1 AS MATERIALIZED (SELECT row_id, sigma, coalesce(y, 0) AS y, -sigma * coalesce(y, 0) / (1 + sigma) AS d FROM sg LEFT JOIN y USING (row_id)),
 x1 AS MATERIALIZED (SELECT col_id, tau, greatest(0, -tau * sum(v * d)) AS u FROM a JOIN d1 USING (row_id) JOIN ta USING (col_id) GROUP BY 1, 2),
 d2 AS MATERIALIZED (SELECT row_id, (any_value(d) + any_value(sigma) * (sum(v * 2 * u) - any_value(y))) / (1 + any_value(sigma)) AS d FROM a JOIN x1 USING (col_id) JOIN d1 USING (row_id) GROUP BY 1),
 g AS (SELECT col_id // {X} AS z, col_id % {X} AS x, 2 * u AS value FROM x1), {_GRAD},
 n AS (SELECT z, x, 0.495 * gz AS gz, 0.495 * gx AS gx, sqrt(power(0.495 * gz, 2) + power(0.495 * gx, 2) + 1e-12) AS n FROM f),
 tv AS (SELECT z, x, gz * CASE WHEN n > 0.1 THEN 0.1 / n ELSE 1 END AS gz, gx * CASE WHEN n > 0.1 THEN 0.1 / n ELSE 1 END AS gx FROM n),
 dv AS (SELECT z, x, CASE WHEN lead(1) OVER v IS NULL THEN 0 ELSE gz END - coalesce(lag(gz) OVER v, 0) + CASE WHEN lead(1) OVER h IS NULL THEN 0 ELSE gx END - coalesce(lag(gx) OVER h, 0) AS div FROM tv WINDOW v AS (PARTITION BY x ORDER BY z), h AS (PARTITION BY z ORDER BY x)),
 c2 AS (SELECT col_id, sum(v * d) AS c FROM a JOIN d2 USING (row_id) GROUP BY 1)
 SELECT col_id, round(greatest(0, u - tau * (c - div)), 4) + 0.0 AS value FROM x1 JOIN c2 USING (col_id) JOIN dv ON dv.z = col_id // {X} AND dv.x = col_id % {X}""")
def primal_dual_2(spark, d):
    a = cut(_matrix(spark, d), "matrix")
    lines = a.agg(F.max("col_id")).first()[0] // X + 1
    return solvers.reconstruct(a, _signal(spark, d), "primal_dual", 2, beta=0.1, x_size=X, z_size=lines).image.select("col_id", _rounded())


def _power_sql(rounds: int) -> str:
    """v0 is the random start; w_k holds (A^T A)^k v0, scaled to length 1 before each round."""
    parts = [_A, "w0 AS MATERIALIZED (SELECT col_id, CAST('0x' || substr(md5(col_id || ':0'), 1, 8) AS BIGINT) / 4294967296.0 - 0.5 AS w FROM (SELECT DISTINCT col_id FROM a))"]
    for k in range(rounds):
        parts += [
            f"n{k} AS MATERIALIZED (SELECT col_id, w / (SELECT sqrt(sum(w * w)) FROM w{k}) AS w FROM w{k})",
            f"f{k} AS MATERIALIZED (SELECT row_id, sum(v * w) AS q FROM a JOIN n{k} USING (col_id) GROUP BY 1)",
            f"w{k + 1} AS MATERIALIZED (SELECT col_id, sum(v * q) AS w FROM a JOIN f{k} USING (row_id) GROUP BY 1)",
        ]
    return ", ".join(parts) + f", power AS MATERIALIZED (SELECT sqrt(sum(w * w)) AS size FROM w{rounds})"


@register(f"WITH {_power_sql(20)} SELECT round(size / 1e3, 6) AS size FROM power")
def power_iteration(spark, d):
    """The square of the matrix's norm, in thousands."""
    size = solvers.lipschitz(cut(_matrix(spark, d), "matrix"))
    return spark.createDataFrame([(size / 1e3,)], "size double").select(F.round("size", 6).alias("size"))


@register(f"""
    WITH {_power_sql(20)}, {_Y}, p AS MATERIALIZED (SELECT 0.99 / sqrt(size + 8.0) AS s FROM power),
    d1 AS MATERIALIZED (SELECT row_id, coalesce(y, 0) AS y, -s * coalesce(y, 0) / (1 + s) AS d FROM (SELECT DISTINCT row_id FROM a) LEFT JOIN y USING (row_id), p),
    x1 AS MATERIALIZED (SELECT col_id, greatest(0, -any_value(s) * sum(v * d)) AS u FROM a JOIN d1 USING (row_id), p GROUP BY 1),
    d2 AS MATERIALIZED (
        SELECT row_id, (any_value(d) + any_value(s) * (sum(v * 2 * u) - any_value(y))) / (1 + any_value(s)) AS d
        FROM a JOIN x1 USING (col_id) JOIN d1 USING (row_id), p GROUP BY 1
    ),
    g AS (SELECT col_id // {X} AS z, col_id % {X} AS x, 2 * u AS value FROM x1), {_GRAD},
    n AS (SELECT z, x, s * gz AS gz, s * gx AS gx, sqrt(power(s * gz, 2) + power(s * gx, 2) + 1e-12) AS n FROM f, p),
    tv AS (SELECT z, x, gz * CASE WHEN n > 0.1 THEN 0.1 / n ELSE 1 END AS gz, gx * CASE WHEN n > 0.1 THEN 0.1 / n ELSE 1 END AS gx FROM n),
    dv AS (
        SELECT z, x, CASE WHEN lead(1) OVER v IS NULL THEN 0 ELSE gz END - coalesce(lag(gz) OVER v, 0)
                     + CASE WHEN lead(1) OVER h IS NULL THEN 0 ELSE gx END - coalesce(lag(gx) OVER h, 0) AS div
        FROM tv WINDOW v AS (PARTITION BY x ORDER BY z), h AS (PARTITION BY z ORDER BY x)
    ),
    c2 AS (SELECT col_id, sum(v * d) AS c FROM a JOIN d2 USING (row_id) GROUP BY 1)
    SELECT col_id, round(greatest(0, u - s * (c - div)), 4) + 0.0 AS value FROM x1 JOIN c2 USING (col_id) JOIN dv ON dv.z = col_id // {X} AND dv.x = col_id % {X}, p
""")
def primal_dual_scalar_2(spark, d):
    """Two rounds with one step for all columns and one for all rows."""
    a = cut(_matrix(spark, d), "matrix")
    lines = a.agg(F.max("col_id")).first()[0] // X + 1
    return solvers.reconstruct(a, _signal(spark, d), "primal_dual", 2, beta=0.1, x_size=X, z_size=lines, steps="scalar").image.select("col_id", _rounded())


@register()
def lbfgs_2(spark, d):
    return solvers.lbfgs(_matrix(spark, d), _signal(spark, d), 2, solvers.Prior(0.01, X)).select("col_id", _rounded())


@register(f"""WITH {_A}, {_Y}, i AS (SELECT p_partkey AS col_id, p_retailprice AS value FROM part),
 q AS (SELECT row_id, sum(v * value) AS q FROM a JOIN i USING (col_id) GROUP BY 1)
 SELECT round(sum(greatest(q, 1e-10) - coalesce(y, 0) * ln(greatest(q, 1e-10))) / 1e6, 3) AS poisson, round(sum((q - coalesce(y, 0)) * (q - coalesce(y, 0))) / 2e9, 3) AS squares FROM q LEFT JOIN y USING (row_id)""")
def reconstruction_costs(spark, d):
    a, y, image = _matrix(spark, d), _signal(spark, d), _image(spark, d)
    values = [(solvers.poisson_cost(a, y, image) / 1e6, solvers.squares_cost(a, y, image) / 1e9)]
    return spark.createDataFrame(values, "poisson double, squares double").select(F.round("poisson", 3).alias("poisson"), F.round("squares", 3).alias("squares"))


@register(f"""WITH {_G}, {_PRIOR.replace('a.value - b.value AS d', 'a.value AS u, b.value AS o, a.value - b.value AS d')}, e AS (SELECT z, x, d, u + o + 0.05 + 0.5 * abs(d) AS below FROM n)
 SELECT z, x, round(sum(0.3 * d * (2 * below - d * (1 + 0.5 * sign(d))) / (below * below)), 8) + 0.0 AS grad, round(sum(0.6 / below), 8) AS hess, round(sum(0.3 * d * d / below) / 2, 6) AS energy FROM e GROUP BY 1, 2""")
def prior_relative(spark, d):
    found = stencil.prior(_grid(spark, d), 0.3, "relative", 0.5)
    return found.select("z", "x", (F.round("grad", 8) + 0.0).alias("grad"), F.round("hess", 8).alias("hess"), F.round("energy", 6).alias("energy"))


@register(f"""WITH {_G}, {_GRAD}, w AS (SELECT *, coalesce(lag(gz) OVER (PARTITION BY x ORDER BY z), 0) AS bz, lead(1) OVER (PARTITION BY x ORDER BY z) IS NULL AS lz,
 coalesce(lag(gx) OVER (PARTITION BY z ORDER BY x), 0) AS bx, lead(1) OVER (PARTITION BY z ORDER BY x) IS NULL AS lx FROM f)
 SELECT z, x, round(CASE WHEN lz THEN bz ELSE bz - gz END + CASE WHEN lx THEN bx ELSE bx - gx END, 6) + 0.0 AS value FROM w""")
def gradient_adjoint(spark, d):
    return stencil.gradient_adjoint(stencil.gradient(_grid(spark, d))).select("z", "x", (F.round("value", 6) + 0.0).alias("value"))


@register(f"""WITH {_G}, p AS (SELECT z, x, -sin(0.1) * (x - 20.0) + cos(0.1) * (z - 3.0) + 3.0 AS fz, cos(0.1) * (x - 20.0) + sin(0.1) * (z - 3.0) + 20.0 AS fx FROM g),
 c AS (SELECT z, x, CAST(floor(fz) + i AS BIGINT) AS cz, CAST(floor(fx) + j AS BIGINT) AS cx, (CASE WHEN i = 1 THEN fz - floor(fz) ELSE 1 - (fz - floor(fz)) END) * (CASE WHEN j = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS w
  FROM p, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))
 SELECT c.z, c.x, round(sum(w * coalesce(g.value, 0)), 6) AS value FROM c LEFT JOIN g ON g.z = c.cz AND g.x = c.cx GROUP BY 1, 2""")
def image_rotate(spark, d):
    return stencil.rotate(_grid(spark, d), 0.1, 20.0, 3.0, 0.0, 1.0, 0.0, 1.0).select("z", "x", F.round("value", 6).alias("value"))


@register("""WITH g AS (SELECT p_partkey // 50 AS z, p_partkey % 50 AS x, p_retailprice AS a, p_retailprice + p_size AS b FROM part),
 h AS (SELECT z, x, sum(a) OVER w AS a, sum(b) OVER w AS b, sum(a * a) OVER w AS aa, sum(b * b) OVER w AS bb, sum(a * b) OVER w AS ab, count(*) OVER w AS n FROM g WINDOW w AS (PARTITION BY z ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
 v AS (SELECT z, x, sum(a) OVER w / 9 AS a, sum(b) OVER w / 9 AS b, sum(aa) OVER w / 9 AS aa, sum(bb) OVER w / 9 AS bb, sum(ab) OVER w / 9 AS ab, sum(n) OVER w AS n FROM h WINDOW w AS (PARTITION BY x ORDER BY z RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
 r AS (SELECT power(0.01 * (max(b) - min(b)), 2) AS c1, power(0.03 * (max(b) - min(b)), 2) AS c2 FROM g)
 SELECT round(avg((2 * a * b + c1) * (2 * 9 / 8 * (ab - a * b) + c2) / ((a * a + b * b + c1) * (9 / 8 * (aa - a * a + bb - b * b) + c2))), 8) AS ssim FROM v, r WHERE n = 9""")
def image_similarity(spark, d):
    part = _table(spark, d, "part").select(F.floor(F.col("p_partkey") / X).alias("z"), (F.col("p_partkey") % X).alias("x"), F.col("p_retailprice").alias("a"), (F.col("p_retailprice") + F.col("p_size")).alias("b"))
    found = metrics.structural_similarity(part.select("z", "x", F.col("a").alias("value")), part.select("z", "x", F.col("b").alias("value")), 3)
    return found.select(F.round("ssim", 8).alias("ssim"))


def _mirror(at: str, size: str) -> str:
    m = f"(({at}) % (2 * {size}) + 2 * {size}) % (2 * {size})"
    return f"CASE WHEN {m} < {size} THEN {m} ELSE 2 * {size} - 1 - {m} END"


@register(f"""WITH {_G}, n AS (SELECT max(z) + 1 AS n FROM g), kx AS (SELECT k, exp(-0.5 * power(k / 1.5, 2)) AS w FROM range(-6, 7) r(k)), kz AS (SELECT k, exp(-0.5 * power(k, 2)) AS w FROM range(-4, 5) r(k)),
 a AS MATERIALIZED (SELECT o.z, o.x, sum(w * i.value) / sum(w) AS value FROM (SELECT z, x, w, {_mirror("x + k", "50")} AS m FROM g, kx) o JOIN g i ON i.z = o.z AND i.x = o.m GROUP BY 1, 2)
 SELECT o.z, o.x, round(sum(w * i.value) / sum(w), 6) AS value FROM (SELECT z, x, w, {_mirror("z + k", "n")} AS m FROM a, kz, n) o JOIN a i ON i.x = o.x AND i.z = o.m GROUP BY 1, 2""")
def image_smooth(spark, d):
    """Gaussian filter along x, then z."""
    grid = _grid(spark, d)
    lines = grid.agg(F.max("z")).first()[0] + 1
    return stencil.gaussian(stencil.gaussian(grid, 1.5, "x", X), 1.0, "z", lines).select("z", "x", F.round("value", 6).alias("value"))


_SHOT = f"{_Y}, tr AS (SELECT row_id // {T} AS n, row_id // {T} % 4 AS k, row_id // {T} // 4 AS a, row_id % {T} AS z, CAST(y AS DOUBLE) AS re, y / (row_id // {T} + 1.0) AS im FROM y)"
_SHOTS = "s AS (SELECT count(*) * greatest(0.75 * count(*) FILTER (k <> 0), 0.25) AS n FROM (SELECT DISTINCT n, k FROM tr))"
_TILT = "radians((a * 24.72135955) % 40 - 20)"


def _traces(spark, d):
    """Complex traces: each 50 orders are an emission of its own; every four share an angle (-20 to 20), one for each frequency (0 to 3)."""
    y = _signal(spark, d).select(F.floor(F.col("row_id") / T).alias("n"), (F.col("row_id") % T).alias("z"), F.col("y").cast("double").alias("y"))
    angle = (F.floor(F.col("n") / 4) * F.lit(24.72135955)) % 40 - 20
    return y.select((F.col("n") % 4).cast("int").alias("decimation"), angle.alias("angle"), "z", F.col("y").alias("re"), (F.col("y") / (F.col("n") + 1)).alias("im"))


@register(f"""WITH {_SHOT}, {_SHOTS},
 c AS (SELECT a, z, k, re * CASE WHEN k = 0 THEN 0.5 ELSE 1 END AS re, im * CASE WHEN k = 0 THEN 0.5 ELSE 1 END AS im FROM tr UNION ALL SELECT a, z + 1, -k, re, -im FROM tr WHERE k <> 0 AND z < (SELECT max(z) FROM tr)),
 f AS MATERIALIZED (SELECT a, z, x, sum(re * cos(2 * pi() * k * (x - 25) / 50.0) - im * sin(2 * pi() * k * (x - 25) / 50.0)) / 0.2 AS v FROM c, range(0, {X}) r(x) GROUP BY 1, 2, 3),
 p AS (SELECT a, z, x, sin(t) * x + cos(t) * z AS fz, cos(t) * x - sin(t) * z AS fx FROM (SELECT a, z, x, {_TILT} AS t FROM f)),
 q AS (SELECT a, z, x, CAST(floor(fz) + i AS BIGINT) AS cz, CAST(floor(fx) + j AS BIGINT) AS cx, (CASE WHEN i = 1 THEN fz - floor(fz) ELSE 1 - (fz - floor(fz)) END) * (CASE WHEN j = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS w
  FROM p, (VALUES (0), (1)) u(i), (VALUES (0), (1)) v(j))
 SELECT q.z, q.x, round(sum(w * coalesce(f.v, 0)) * 0.2 / (SELECT n FROM s), 4) + 0.0 AS value FROM q LEFT JOIN f ON f.a = q.a AND f.z = q.cz AND f.x = q.cx GROUP BY 1, 2""")
def inverse_fourier_image(spark, d):
    return analytic.inverse_fourier(_traces(spark, d), X, 0.2, dz=0.2).select("z", "x", (F.round("value", 4) + 0.0).alias("value"))


@register(f"""WITH {_SHOT}, {_SHOTS}, m AS (SELECT m, m / 10.0 * exp(-2 * power(m / 20.0, 10)) AS w FROM range(0, 21) r(m)),
 h AS MATERIALIZED (SELECT e, sum(w * cos(2 * pi() * m * e / 50.0)) AS c, sum(w * sin(2 * pi() * m * e / 50.0)) AS s FROM m, range(-49, 50) r(e) GROUP BY 1),
 f AS MATERIALIZED (SELECT n, j, sum(re * c - im * s) AS re, sum(re * s + im * c) AS im FROM tr, range(0, {T}) r(j), h WHERE e = j - z GROUP BY 1, 2),
 t AS (SELECT DISTINCT n, k, {_TILT} AS t FROM tr),
 p AS (SELECT n, z, x, 2 * pi() * k * 0.1 * ((x * 0.2 - 4.9) * cos(t) - z * 0.2 * sin(t)) AS turn, (x * 0.2 * sin(t) + z * 0.2 * cos(t)) / 0.2 AS u FROM t, range(0, {T}) a(z), range(0, {X}) b(x)),
 q AS (SELECT *, CAST(greatest(0, least(floor(u), 49)) AS BIGINT) AS i0, CAST(greatest(0, least(floor(u) + 1, 49)) AS BIGINT) AS i1 FROM p),
 r AS (SELECT n, z, x, turn, i0 AS j, 1 - (u - i0) AS w FROM q UNION ALL SELECT n, z, x, turn, i1, u - i0 FROM q)
 SELECT z, x, round(sum(2 * w * (cos(turn) * re - sin(turn) * im)) * 0.2 / (SELECT n FROM s), 4) + 0.0 AS value FROM r JOIN f USING (n, j) GROUP BY 1, 2""")
def back_projected_image(spark, d):
    filtered = analytic.filtered_traces(_traces(spark, d), T, 0.2, 2.0, 0.1)
    pixels = generators.grid(spark, T, X)
    return analytic.back_project(filtered, pixels, T, X, 0.2, 0.2, 0.1).select("z", "x", (F.round("value", 4) + 0.0).alias("value"))


_FOCUS = dict(t_size=64, z_size=30, dx=1e-3, dz=1e-3, speed=1500.0, rate=2.98e6, frequency=1e6, cycles=2.0, focus=15e-3, aperture=10e-3)
_WAIST = "(1.028 * 1.5e-3 * 1.5 / (2 * sqrt(2 * ln(2))))"
_WIDTH = f"({_WAIST} * sqrt(1 + power((z * 1e-3 - 15e-3) / (pi() * power({_WAIST}, 2) / 1.5e-3), 2)) / 1e-3)"


@register(f"""WITH s AS (SELECT vec_id AS x, i - 5 AS t, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(5, 60) r(i)), n AS (SELECT count(*) AS n FROM embeddings),
 p AS (SELECT z, CAST(floor(z * 54 / 29.0) AS BIGINT) AS f, z * 54 / 29.0 - floor(z * 54 / 29.0) AS u FROM range(0, 30) r(z)),
 raw AS MATERIALIZED (SELECT z, x, sum(v * CASE WHEN t = f THEN 1 - u ELSE u END) AS v FROM p JOIN s ON t = f OR t = f + 1 GROUP BY 1, 2),
 lev AS MATERIALIZED (SELECT z, x, v - min(v) OVER (PARTITION BY x) AS v FROM raw),
 kz AS (SELECT k, exp(-0.5 * power(k / (3 / (2 * sqrt(2 * ln(2)))), 2)) AS w FROM range(-5, 6) r(k)),
 ax AS MATERIALIZED (SELECT o.z, o.x, sum(w * i.v) / sum(w) AS v FROM (SELECT z, x, w, {_mirror("z + k", "30")} AS m FROM lev, kz) o JOIN lev i ON i.x = o.x AND i.z = o.m GROUP BY 1, 2),
 kx AS (SELECT z AS line, k, exp(-0.5 * power(k / {_WIDTH}, 2)) AS w FROM range(0, 30) a(z), range(-40, 41) b(k) WHERE abs(k) <= floor(4 * {_WIDTH} + 0.5)),
 la AS MATERIALIZED (SELECT o.z, o.x, sum(w * i.v) / sum(w) AS v FROM (SELECT z, x, w, {_mirror("x + k", "n")} AS m FROM ax JOIN kx ON line = z, n) o JOIN ax i ON i.z = o.z AND i.x = o.m GROUP BY 1, 2)
 SELECT z, x, round((v - (SELECT min(v) FROM la)) / ((SELECT max(v) - min(v) FROM la) + 1e-9), 6) + 0.0 AS value FROM la""")
def focused_image(spark, d):
    """Vectors as the signals of a focused scan: one emission each, one lateral place each."""
    vectors = _table(spark, d, "embeddings")
    signals = vectors.select(F.col("vec_id").alias("n"), F.posexplode(F.col("embedding").cast("array<double>")).alias("t", "y"))
    n = vectors.count()
    return focused.focused_image(signals, n_size=n, x_size=n, **_FOCUS).select("z", "x", (F.round("value", 6) + 0.0).alias("value"))
