"""Registered queries: array files written by many tasks and read in ranges, recordings, hydrophone scans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import experiment, hdf5, npy
from .acquisition import _ANALYTIC, _vectors
from .catalogue import T, X, _grid, _table, register


def _path(spark, ending: str) -> str:
    return f"{shared_folder(spark)}/array-{uuid.uuid4().hex}/file.{ending}"


def _most(df, *columns: str) -> list[int]:
    return [v or 0 for v in df.agg(*(F.max(c) for c in columns)).first()]


@register("""
    WITH s AS (SELECT max(p_partkey) // 50 + 1 AS depth FROM part),
    g AS (SELECT z, x FROM s, range(0, s.depth) a(z), range(0, 50) b(x))
    SELECT g.z, g.x, coalesce(p.p_retailprice, 0) AS value
    FROM g LEFT JOIN part p ON p.p_partkey = 50 * g.z + g.x
""")
def npy_files(spark, d):
    """The image as one NPY file with the first axis the fastest, written and read again."""
    image, path = _grid(spark, d), _path(spark, "npy")
    npy.write_npy(image, path, ["z", "x"], (_most(image, "z")[0] + 1, X), fortran=True)
    return npy.read_npy(spark, path, ["z", "x"])


@register("""
    SELECT p_size AS t, p_partkey // 50 AS z, p_partkey % 50 AS x, p_retailprice AS value
    FROM part WHERE p_retailprice <> 0
""")
def hdf5_files(spark, d):
    """The image as a field over time (size of the part), written as HDF5 and read again."""
    field = _table(spark, d, "part").select(
        F.col("p_size").cast("long").alias("t"), F.floor(F.col("p_partkey") / X).alias("z"), (F.col("p_partkey") % X).alias("x"), F.col("p_retailprice").alias("value")
    )
    path, (t, z) = _path(spark, "h5"), _most(field, "t", "z")
    hdf5.write_hdf5(field, path, "data", ["t", "z", "x"], (t + 1, z + 1, X))
    return hdf5.read_hdf5(spark, path, "data", ["t", "z", "x"]).where("value <> 0").withColumn("t", F.col("t").cast("int"))


_RAW = """
    raw AS (
        SELECT l_orderkey // 50 AS n, l_linenumber - 1 AS repeat, l_orderkey % 50 AS t, sum(l_quantity) AS y
        FROM lineitem GROUP BY 1, 2, 3
    ),
    size AS (SELECT max(n) + 1 AS scans, max(repeat) + 1 AS repeats FROM raw)
"""


def _recording(spark, d) -> str:
    """A MAT file of all order lines: time by repeats and scans, and parameters from the other tables."""
    lines = _table(spark, d, "lineitem")
    lines = lines.select(F.floor(F.col("l_orderkey") / T).alias("n"), (F.col("l_linenumber") - 1).alias("repeat"), (F.col("l_orderkey") % T).alias("t"), "l_quantity")
    scans, repeats = (n + 1 for n in _most(lines, "n", "repeat"))
    raw = lines.groupBy("n", "repeat", "t").agg(F.sum("l_quantity").alias("value"))
    part, supplier = _table(spark, d, "part"), _table(spark, d, "supplier")
    sizes = sorted(r[0] for r in part.select("p_size").distinct().collect())
    facts = {
        "TypeOfSequence": part.agg(F.min("p_type")).first()[0], "NTrig": repeats, "NbElemts": supplier.count(), "FreqSonde": part.agg(F.max("p_size")).first()[0] / 8, "c": part.agg(F.max("p_retailprice")).first()[0],
        "Alphas": [float(s) for s in sizes],
    }
    path = _path(spark, "mat")
    cells = raw.select("t", (F.col("repeat") * F.lit(scans) + F.col("n")).alias("column"), "value")
    experiment.write_file(cells, path, ["t", "column"], (T, scans * repeats), experiment.RAW, facts=facts)
    return path


@register(f"""
    WITH {_RAW},
    g AS (SELECT n, t, scans, repeats FROM size, range(0, size.scans) a(n), range(0, {T}) b(t)),
    m AS (SELECT n, t, sum(y) AS y FROM raw WHERE repeat >= 1 AND repeat < 4 GROUP BY 1, 2)
    SELECT g.n, g.t, round(coalesce(m.y, 0) / (least(repeats, 4) - 1), 6) AS y FROM g LEFT JOIN m USING (n, t)
""")
def experiment_signals(spark, d):
    """The mean of three repeats of the signals in a recording."""
    return experiment.read_signals(spark, _recording(spark, d), 1, 3).select("n", "t", F.round("y", 6).alias("y"))


@register(f"""
    WITH {_RAW}
    SELECT (SELECT min(p_type) FROM part) AS sequence, CAST(repeats AS BIGINT) AS repeats, (SELECT count(*) FROM supplier) AS elements,
           (SELECT max(p_size) / 8 * 1e6 FROM part) AS frequency, (SELECT max(p_retailprice) FROM part) AS speed,
           (SELECT array_to_string(list(DISTINCT p_size ORDER BY p_size), ',') FROM part) AS angles
    FROM size
""")
def experiment_parameters(spark, d):
    """The parameters of a recording, in SI units."""
    found = experiment.read_parameters(spark, _recording(spark, d))
    angles = F.array_join(F.transform("AngleMatrix", lambda a: a.cast("int").cast("string")), ",")
    return found.select(F.col("TypeOfSequence").alias("sequence"), F.col("Naverage").alias("repeats"), F.col("Nelement").alias("elements"), F.col("FreqSonde").alias("frequency"), F.col("c").alias("speed"), angles.alias("angles"))


def _scan(spark, d, ending: str, names: str, plane: int):
    """All vectors as the stops of a scan, written in a format and read again; rows of stops that the scan has beyond them go."""
    samples = _vectors(spark, d).select("vec_id", F.posexplode("series").alias("t", "value"))
    last = _most(samples, "vec_id")[0]
    layers, path = last // plane + 1, _path(spark, ending)
    cells = samples.select(F.col("vec_id").alias("stop"), F.col("t").cast("long").alias("t"), "value")
    experiment.write_file(cells, path, ["stop", "t"], (layers * plane, 64))
    stops = experiment.read_file(spark, path, ["stop", "t"]).where(F.col("stop") <= last)
    axes = {"x": experiment.Even(-2.0, 0.25, 25 if len(names) == 2 else 5), "y": experiment.Even(1.0, 0.5, 25 if len(names) == 2 else 4)}
    found = experiment.hydrophone_scan(stops, **{n: axes[n] for n in names[:-1]}, z=experiment.Even(0.0, 0.2, layers))
    return found.select(*(F.round(f"{n}_mm", 4).alias(f"{n}_mm") for n in names), "t", F.round("value", 5).alias("value"))


def _scan_sql(places: str, columns: str) -> str:
    return f"""
        {_ANALYTIC}, w AS (SELECT DISTINCT vec_id, vec_id // 25 AS line, vec_id % 25 AS spot, vec_id // 20 AS layer, vec_id % 20 AS inside FROM a),
        o AS (SELECT *, CASE WHEN layer % 2 = 0 THEN inside ELSE 19 - inside END AS turned FROM w),
        p AS (SELECT vec_id, {places} FROM o)
        SELECT {columns}, CAST(i AS INTEGER) AS t, round(sqrt(re * re + im * im), 5) AS value FROM a JOIN p USING (vec_id)
    """


_FLAT = "CASE WHEN line % 2 = 0 THEN spot ELSE 24 - spot END AS u, line AS v"
_MM = "round(CAST({0} AS DOUBLE) + {1} * CAST({2} AS DOUBLE), 4)"


@register(_scan_sql(_FLAT, f"{_MM.format(-2, 'u', 0.25)} AS x_mm, {_MM.format(0, 'v', 0.2)} AS z_mm"))
def hydrophone_xz(spark, d):
    return _scan(spark, d, "npy", "xz", 25)


@register(_scan_sql(_FLAT, f"{_MM.format(1, 'u', 0.5)} AS y_mm, {_MM.format(0, 'v', 0.2)} AS z_mm"))
def hydrophone_yz(spark, d):
    return _scan(spark, d, "h5", "yz", 25)


@register(_scan_sql(
    "CASE WHEN turned // 5 % 2 = 0 THEN turned % 5 ELSE 4 - turned % 5 END AS u, turned // 5 AS r, layer AS v",
    f"{_MM.format(-2, 'u', 0.25)} AS x_mm, {_MM.format(1, 'r', 0.5)} AS y_mm, {_MM.format(0, 'v', 0.2)} AS z_mm",
))
def hydrophone_xyz(spark, d):
    return _scan(spark, d, "mat", "xyz", 20)
