"""Registered queries over the test tables, each with its SQL.

lineitem gives matrix cells (order = row, part = column, quantity = value), its prices the signal, part the image of 50
pixels a line, events the time signals (user = emission, hour = sample, event type = phase), md5 of ids the patterns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns
from ..operators import metrics, signals, smatrix, stencil
from ..session import spread
from . import solvers

T, X = 50, 50
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "mlem_3"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _matrix(spark, sf_dir):
    return smatrix.from_entries(_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", "l_quantity")


def _entries(spark, sf_dir):
    """Its entries as they stand, for a single product: repeated cells add up there."""
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("col_id"), F.col("l_quantity").alias("v"))


def _signal(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(F.sum("l_extendedprice").alias("y"))


def _image(spark, sf_dir):
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("col_id"), F.col("p_retailprice").alias("value"))


def _grid(spark, sf_dir):
    return _image(spark, sf_dir).select(F.floor(F.col("col_id") / X).alias("z"), (F.col("col_id") % X).alias("x"), "value")


def _series(spark, sf_dir):
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    phase = F.create_map(*[F.lit(x) for p in (("view", 0), ("click", 1), ("purchase", 2), ("signup", 3)) for x in p])[F.col("event_type")]
    return _table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("n"), hour.alias("t"), phase.alias("phase")).agg(F.sum("value").alias("y"))


_A = "a AS (SELECT l_orderkey AS row_id, l_partkey AS col_id, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
_Y = "y AS (SELECT l_orderkey AS row_id, sum(l_extendedprice) AS y FROM lineitem GROUP BY 1)"
_I = "i AS (SELECT p_partkey AS col_id, p_retailprice AS value FROM part)"
_G = "g AS (SELECT p_partkey // 50 AS z, p_partkey % 50 AS x, p_retailprice AS value FROM part)"
_S = """s AS (SELECT user_id AS n, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS t,
    CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 END AS phase, sum(value) AS y FROM events GROUP BY 1, 2, 3)"""
_P = "p AS (SELECT p_partkey AS n, substr(md5(CAST(p_partkey AS VARCHAR)), 1, 12) AS code, p_partkey % 41 - 20 AS angle FROM part)"
_BITS = "b AS (SELECT n, code, angle, array_to_string(list_transform(string_split(code, ''), lambda c: lpad(bin(CAST('0x' || c AS INTEGER)), 4, '0')), '') AS bits FROM p)"


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@register(f"WITH {_A}, {_I} SELECT row_id, round(sum(v * value), 4) AS q FROM a JOIN i USING (col_id) GROUP BY 1")
def forward_projection(spark, d):
    return smatrix.forward(_entries(spark, d), _image(spark, d)).select("row_id", F.round("q", 4).alias("q"))


@register(f"WITH {_A}, {_Y} SELECT col_id, round(sum(v * y), 4) AS c FROM a JOIN y USING (row_id) GROUP BY 1")
def back_projection(spark, d):
    return smatrix.backward(_entries(spark, d), _signal(spark, d)).select("col_id", F.round("c", 4).alias("c"))


@register("""WITH a AS (SELECT l_orderkey AS row_id, l_partkey AS col_id, sum(l_quantity) AS vre, sum(l_discount * 100) AS vim FROM lineitem GROUP BY 1, 2),
 y AS (SELECT l_orderkey AS row_id, sum(l_extendedprice) AS yre, sum(l_tax) AS yim FROM lineitem GROUP BY 1)
 SELECT col_id, round(sum(vre * yre + vim * yim), 3) AS cre, round(sum(vre * yim - vim * yre), 3) AS cim FROM a JOIN y USING (row_id) GROUP BY 1""")
def back_projection_complex(spark, d):
    rows = _table(spark, d, "lineitem")
    a = rows.select(F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("col_id"), F.col("l_quantity").alias("vre"), (F.col("l_discount") * 100).alias("vim"))
    y = rows.groupBy(F.col("l_orderkey").alias("row_id")).agg(F.sum("l_extendedprice").alias("yre"), F.sum("l_tax").alias("yim"))
    return smatrix.backward_complex(a, y).select("col_id", F.round("cre", 3).alias("cre"), F.round("cim", 3).alias("cim"))


@register(f"WITH {_A}, m AS (SELECT *, max(abs(v)) OVER (PARTITION BY row_id) AS top FROM a) SELECT row_id, col_id, v FROM m WHERE abs(v) > 0.5 * top")
def row_threshold(spark, d):
    return smatrix.threshold_rows(_matrix(spark, d), 0.5)


@register(f"WITH {_A} SELECT col_id, greatest(sum(v), 1e-10) AS sens FROM a GROUP BY 1")
def column_sensitivity(spark, d):
    return smatrix.sensitivity(_matrix(spark, d))


def _norm(kind, formula):
    def query(spark, d):
        return smatrix.norm_factors(_matrix(spark, d), kind).select("col_id", F.round("norm", 8).alias("norm"))

    query.__name__ = f"norm_factors_{kind}"
    register(f"WITH {_A} SELECT col_id, round({formula}, 8) AS norm FROM a GROUP BY 1")(query)


_norm("dense", "1 / greatest(sum(v), 1e-6)")
_norm("csr", "1 / greatest(sum(abs(v)), 1e-6)")
_norm("sell", "1 / (sum(abs(v)) + 1e-10)")


@register(f"WITH {_A} SELECT row_id, sum(abs(v)) AS total FROM a GROUP BY 1")
def absolute_row_sums(spark, d):
    return smatrix.absolute_sums(_matrix(spark, d), "row_id")


@register(f"WITH {_A} SELECT col_id, sum(abs(v)) AS total FROM a GROUP BY 1")
def absolute_column_sums(spark, d):
    return smatrix.absolute_sums(_matrix(spark, d), "col_id")


@register(f"WITH {_A} SELECT col_id, sum(v * v) AS diagonal FROM a GROUP BY 1")
def hessian_diagonal(spark, d):
    return smatrix.hessian_diagonal(_matrix(spark, d))


@register(f"WITH {_A}, {_I}, h AS (SELECT col_id, sum(v * v) AS g FROM a GROUP BY 1) SELECT col_id, round(value / (g + 1e-3 * (SELECT max(g) FROM h)), 8) AS value FROM i JOIN h USING (col_id)")
def diagonal_preconditioner(spark, d):
    return smatrix.precondition(_matrix(spark, d), _image(spark, d)).select("col_id", F.round("value", 8).alias("value"))


@register(f"WITH {_A} SELECT row_id, col_id, round(v / (SELECT max(abs(v)) FROM a), 8) AS v FROM a")
def matrix_normalise(spark, d):
    return smatrix.normalise(_matrix(spark, d)).select("row_id", "col_id", F.round("v", 8).alias("v"))


@register(f"WITH {_A} SELECT count(*) AS cells, round(100.0 * count(*) / ((max(row_id) + 1) * (max(col_id) + 1)), 6) AS percent FROM a")
def matrix_density(spark, d):
    return smatrix.density(_matrix(spark, d)).select("cells", F.round("percent", 6).alias("percent"))


@register(f"""WITH {_A}, c AS (SELECT row_id, count(*) AS cells, row_id // 64 AS block FROM a GROUP BY 1)
 SELECT row_id, cells, block, CAST(row_number() OVER (PARTITION BY block ORDER BY cells DESC, row_id) - 1 AS INTEGER) AS place FROM c""")
def row_layout(spark, d):
    return smatrix.row_layout(_matrix(spark, d), 64).select("row_id", "cells", "block", "place")


@register(f"""WITH {_A} SELECT (row_id // 50) * 20 + (row_id % 50 - 5) // 2 AS row_id, (col_id // 50) // 2 * 15 + (col_id % 50 - 10) // 2 AS col_id, v FROM a
 WHERE row_id % 50 >= 5 AND row_id % 50 < 45 AND (row_id % 50 - 5) % 2 = 0 AND col_id % 50 >= 10 AND col_id % 50 < 40 AND (col_id % 50) % 2 = 0 AND (col_id // 50) % 2 = 0""")
def matrix_truncate(spark, d):
    return smatrix.truncate(_matrix(spark, d), T, X, t_range=(5, 45), t_step=2, x_range=(10, 40), space_step=2)


@register(f"WITH {_A} SELECT row_id, col_id, v * CASE WHEN col_id % 3 = 0 THEN 0.5 ELSE 1.0 END AS v FROM a")
def matrix_apodise(spark, d):
    a = _matrix(spark, d)
    w = a.select("col_id").distinct().where("col_id % 3 = 0").withColumn("w", F.lit(0.5))
    return smatrix.apodise(a, w)


def _mlem_sql(rounds: int) -> str:
    parts = [_A, _Y, "s AS (SELECT col_id, greatest(sum(v), 1e-10) AS sens FROM a GROUP BY 1)", "x0 AS (SELECT DISTINCT col_id, CAST(0.1 AS DOUBLE) AS value FROM a)"]
    for k in range(rounds):
        parts += [
            f"q{k} AS MATERIALIZED (SELECT row_id, sum(v * value) AS q FROM a JOIN x{k} USING (col_id) GROUP BY 1)",
            f"c{k} AS MATERIALIZED (SELECT col_id, sum(v * y / greatest(q, 1e-10)) AS c FROM a JOIN y USING (row_id) JOIN q{k} USING (row_id) GROUP BY 1)",
            f"x{k + 1} AS MATERIALIZED (SELECT col_id, greatest(0, value * coalesce(c, 0) / sens) AS value FROM x{k} JOIN s USING (col_id) LEFT JOIN c{k} USING (col_id))",
        ]
    return f"WITH {', '.join(parts)} SELECT col_id, round(value, 4) AS value FROM x{rounds}"


@register(_mlem_sql(3))
def mlem_3(spark, d):
    return solvers.mlem(_matrix(spark, d), _signal(spark, d), 3).select("col_id", F.round("value", 4).alias("value"))


_PRIOR = """n AS (SELECT a.z, a.x, a.value - b.value AS d FROM g a JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dz, dx) ON true
 JOIN g b ON b.z = a.z + o.dz AND b.x = a.x + o.dx)"""


@register(f"WITH {_G}, {_PRIOR} SELECT z, x, round(sum(0.3 * d), 6) + 0.0 AS grad, round(sum(0.15 * d * d) / 2, 4) AS energy FROM n GROUP BY 1, 2")
def prior_quadratic(spark, d):
    return stencil.prior(_grid(spark, d), 0.3).select("z", "x", (F.round("grad", 6) + 0.0).alias("grad"), F.round("energy", 4).alias("energy"))


@register(f"""WITH {_G}, {_PRIOR} SELECT z, x, round(sum(CASE WHEN abs(d) <= 0.5 THEN 0.3 * d / 0.5 ELSE 0.3 * sign(d) END), 6) + 0.0 AS grad,
 round(sum(CASE WHEN abs(d) <= 0.5 THEN 0.3 * d * d / 1.0 ELSE 0.3 * (abs(d) - 0.25) END) / 2, 4) AS energy FROM n GROUP BY 1, 2""")
def prior_huber(spark, d):
    return stencil.prior(_grid(spark, d), 0.3, "huber", 0.5).select("z", "x", (F.round("grad", 6) + 0.0).alias("grad"), F.round("energy", 4).alias("energy"))


_GRAD = """f AS (SELECT z, x, coalesce(lead(value) OVER (PARTITION BY x ORDER BY z) - value, 0) AS gz,
 coalesce(lead(value) OVER (PARTITION BY z ORDER BY x) - value, 0) AS gx FROM g)"""


@register(f"WITH {_G}, {_GRAD} SELECT z, x, round(gz, 6) AS gz, round(gx, 6) AS gx FROM f")
def image_gradient(spark, d):
    return stencil.gradient(_grid(spark, d)).select("z", "x", F.round("gz", 6).alias("gz"), F.round("gx", 6).alias("gx"))


@register(f"""WITH {_G}, {_GRAD}, w AS (SELECT *, coalesce(lag(gz) OVER (PARTITION BY x ORDER BY z), 0) AS bz, lead(1) OVER (PARTITION BY x ORDER BY z) IS NULL AS lz,
 coalesce(lag(gx) OVER (PARTITION BY z ORDER BY x), 0) AS bx, lead(1) OVER (PARTITION BY z ORDER BY x) IS NULL AS lx FROM f)
 SELECT z, x, round(CASE WHEN lz THEN -bz ELSE gz - bz END + CASE WHEN lx THEN -bx ELSE gx - bx END, 6) + 0.0 AS value FROM w""")
def image_divergence(spark, d):
    return stencil.divergence(stencil.gradient(_grid(spark, d))).select("z", "x", (F.round("value", 6) + 0.0).alias("value"))


@register(f"""WITH {_G}, {_GRAD}, m AS (SELECT *, sqrt(gz * gz + gx * gx + 1e-12) AS r FROM f)
 SELECT z, x, round(gz * CASE WHEN r > 2 THEN 2 / r ELSE 1 END, 6) AS gz, round(gx * CASE WHEN r > 2 THEN 2 / r ELSE 1 END, 6) AS gx FROM m""")
def ball_projection(spark, d):
    return stencil.project_ball(stencil.gradient(_grid(spark, d)), 2.0).select("z", "x", F.round("gz", 6).alias("gz"), F.round("gx", 6).alias("gx"))


@register(f"""WITH {_S} SELECT n, t, round((sum(CASE WHEN phase = 0 THEN y ELSE 0 END) - sum(CASE WHEN phase = 2 THEN y ELSE 0 END)) * pi() / 2, 4) + 0.0 AS re,
 round((sum(CASE WHEN phase = 3 THEN y ELSE 0 END) - sum(CASE WHEN phase = 1 THEN y ELSE 0 END)) * pi() / 2, 4) + 0.0 AS im FROM s GROUP BY 1, 2""")
def demodulation(spark, d):
    return signals.demodulate(_series(spark, d), ["n", "t"]).select("n", "t", (F.round("re", 4) + 0.0).alias("re"), (F.round("im", 4) + 0.0).alias("im"))


@register(f"WITH {_S} SELECT n, t, phase, round((y - (SELECT min(y) FROM s)) / (SELECT max(y) - min(y) FROM s), 8) AS y FROM s")
def signal_normalise(spark, d):
    return signals.normalise(_series(spark, d)).select("n", "t", "phase", F.round("y", 8).alias("y"))


@register(f"WITH {_P}, {_BITS} SELECT n, bits, length(bits) - length(replace(bits, '1', '')) AS active, list_max(list_transform(string_split(bits, '1'), lambda s: length(s))) AS zeros, list_max(list_transform(string_split(bits, '0'), lambda s: length(s))) AS ones, length(regexp_extract(bits, '^(0+|1+)')) AS first_run FROM b")
def pattern_bits(spark, d):
    p = spread(_table(spark, d, "part").select("p_partkey"), "p_partkey").select(F.col("p_partkey").alias("n"), F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 12).alias("code"))
    b = p.select("n", patterns.hex_to_bits(F.col("code"), 48).alias("bits"))
    long = lambda c: c.cast("long")
    return b.select("n", "bits", long(F.length(F.replace("bits", F.lit("0"), F.lit("")))).alias("active"), long(patterns.longest_run(F.col("bits"), "0")).alias("zeros"), long(patterns.longest_run(F.col("bits"), "1")).alias("ones"), long(patterns.first_run(F.col("bits"))).alias("first_run"))


@register(f"""WITH {_P}, {_BITS} SELECT n, array_to_string(list_transform(range(0, 12), lambda i: to_hex(CAST(list_sum(list_transform(range(0, 4), lambda j: CAST(substr(reverse(bits), i * 4 + j + 1, 1) AS INTEGER) * (8 >> j))) AS INTEGER))), '') AS mirrored FROM b""".replace("to_hex(", "lower(to_hex(").replace("AS INTEGER))), '') AS mirrored", "AS INTEGER)))), '') AS mirrored"))
def pattern_mirror(spark, d):
    p = spread(_table(spark, d, "part").select("p_partkey"), "p_partkey").select(F.col("p_partkey").alias("n"), F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 12).alias("code"))
    return p.select("n", patterns.bits_to_hex(patterns.mirrored(patterns.hex_to_bits(F.col("code"), 48))).alias("mirrored"))


@register(f"WITH {_P} SELECT n, (CASE WHEN angle < 0 THEN '1' ELSE '0' END) || lpad(CAST(abs(angle) AS VARCHAR), 2, '0') AS angle_code, angle AS angle FROM p")
def pattern_angles(spark, d):
    p = _table(spark, d, "part").select(F.col("p_partkey").alias("n"), (F.col("p_partkey") % 41 - 20).alias("angle"))
    code = patterns.angle_code(F.col("angle"))
    return p.select("n", code.alias("angle_code"), patterns.angle_of(F.concat(F.lit("ff00_"), code)).cast("long").alias("angle"))


@register(f"""WITH {_P}, {_BITS}, k AS (SELECT n, bits, angle FROM b) SELECT angle, count(*) AS scans, min(n) AS first_n FROM k GROUP BY 1""")
def angle_histogram(spark, d):
    p = _table(spark, d, "part").select(F.col("p_partkey").alias("n"), (F.col("p_partkey") % 41 - 20).alias("angle"))
    return p.groupBy("angle").agg(F.count(F.lit(1)).alias("scans"), F.min("n").alias("first_n"))


@register(_mlem_sql(2).replace("SELECT col_id, round(value, 4) AS value FROM x2", "") + """, t AS (SELECT p_partkey AS col_id, p_retailprice AS truth FROM part),
 m AS (SELECT 1 AS iter, * FROM x1 UNION ALL SELECT 2, * FROM x2)
 SELECT iter, round(avg((value - truth) * (value - truth)), 3) AS mse, round(greatest(avg(abs(value - truth)), 1e-10), 4) AS noise FROM m JOIN t USING (col_id) GROUP BY 1""")
def reconstruction_error(spark, d):
    a, y = _matrix(spark, d), _signal(spark, d)
    images = [solvers.mlem(a, y, k).withColumn("iter", F.lit(k)) for k in (1, 2)]
    truth = _image(spark, d).withColumnRenamed("value", "truth")
    return metrics.squared_error(images[0].unionByName(images[1]), truth).select("iter", F.round("mse", 3).alias("mse"), F.round("noise", 4).alias("noise"))


def _descent_sql(rounds: int, step: float) -> str:
    parts = [_A, _Y, "x0 AS (SELECT DISTINCT col_id, CAST(0 AS DOUBLE) AS value FROM a)"]
    for k in range(rounds):
        parts += [
            f"r{k} AS MATERIALIZED (SELECT row_id, sum(v * value) - any_value(y) AS r FROM a JOIN x{k} USING (col_id) JOIN y USING (row_id) GROUP BY 1)",
            f"x{k + 1} AS MATERIALIZED (SELECT col_id, greatest(0, value - {step} * c) AS value FROM x{k} JOIN (SELECT col_id, sum(v * r) AS c FROM a JOIN r{k} USING (row_id) GROUP BY 1) USING (col_id))",
        ]
    return f"WITH {', '.join(parts)} SELECT col_id, round(value, 4) AS value FROM x{rounds}"


@register(_descent_sql(2, 1e-6))
def gradient_descent_2(spark, d):
    return solvers.gradient_descent(_matrix(spark, d), _signal(spark, d), 2, 1e-6).select("col_id", F.round("value", 4).alias("value"))


from . import acquisition, files, measures, reconstruction  # noqa: E402, F401  they register their queries
