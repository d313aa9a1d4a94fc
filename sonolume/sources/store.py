"""Parameters as JSON; matrices, media, fields and reconstructions as partitioned Parquet with a row of facts beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARAMETERS = """general struct<Xrange:array<double>,Yrange:array<double>,Zrange:array<double>,dx:double,dy:double,dz:double,ft:double,Nt:int>,
 acoustic struct<typeSim:string,dim:string,f_US:double,f_AQ:string,dx_sim:double,dz_sim:double,probe:struct<num_elements:int,element_width:double,element_kerf:double>,
  emission:struct<num_cycles:double,voltage:double,sensitivity:double,Foc:double,N_piezoFocal:int>,medium:struct<type:string,c0:double,density:double,width:double,height:double>>,
 optic struct<laser:struct<shape:string,center:string,w0:double>,absorbers:array<struct<name:string,type:string,center:array<double>,radius:double,amplitude:double>>>,
 reconstruction map<string,string>"""


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """One row a file; a top key Parameters is unwrapped. Nx and Nz follow from ranges and steps; ranges must rise and steps be positive."""
    raw = spark.read.schema(f"Parameters struct<{_nested()}>, {PARAMETERS}").option("multiLine", True).json(path)
    names = ("general", "acoustic", "optic", "reconstruction")
    flat = raw.select(*[F.coalesce(f"Parameters.{n}", n).alias(n) for n in names])
    g = lambda c: F.col(f"general.{c}")
    size = lambda r, d: F.rint((g(r)[1] - g(r)[0]) / g(d)).cast("int")
    sound = (g("dx") > 0) & (g("dz") > 0) & (g("Xrange")[1] > g("Xrange")[0]) & (g("Zrange")[1] > g("Zrange")[0])
    checked = F.when(F.coalesce(sound, F.lit(False)), size("Xrange", "dx")).otherwise(F.raise_error(F.lit("ranges must rise and steps be positive")).cast("int"))
    return flat.withColumns({"Nx": checked, "Nz": size("Zrange", "dz")})


def _nested() -> str:
    """PARAMETERS as fields of a struct (name:type)."""
    import re

    return re.sub(r"(^|,\s*)(general|acoustic|optic|reconstruction) ", r"\1\2:", PARAMETERS)


def write_parameters(parameters: DataFrame, path: str) -> None:
    parameters.drop("Nx", "Nz").write.json(path)


def write_matrix(a: DataFrame, path: str, layout: str, threshold: float, mode: str = "errorifexists") -> None:
    """Cells under path/cells, facts under path/facts."""
    a.write.mode(mode).parquet(f"{path}/cells")
    facts = a.agg(F.count(F.lit(1)).alias("cells"), F.max("row_id").alias("last_row"), F.max("col_id").alias("last_col"))
    kind = "complex" if "vre" in a.columns else "real"
    facts.select("*", F.lit(layout).alias("layout"), F.lit(kind).alias("kind"), F.lit(float(threshold)).alias("threshold")).write.mode(mode).parquet(f"{path}/facts")


def read_matrix(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """The cells; an error if they are not of the wanted kind (real or complex)."""
    facts = spark.read.parquet(f"{path}/facts").first()
    if kind and facts["kind"] != kind:
        raise ValueError(f"{path} holds a {facts['kind']} matrix, not a {kind} one")
    return spark.read.parquet(f"{path}/cells")


def write_reconstruction(images: DataFrame, path: str, optimizer: str, with_tumor: bool, overwrite: bool = False) -> None:
    """images (iter, col_id, value) in the partition of their optimizer and case; left alone if it exists unless overwrite."""
    images.write.mode("overwrite" if overwrite else "ignore").parquet(f"{path}/optimizer={optimizer}/with_tumor={str(with_tumor).lower()}")


def read_reconstruction(spark: SparkSession, path: str, optimizer: str | None = None, with_tumor: bool | None = None) -> DataFrame:
    """All stored images with columns optimizer and with_tumor; conditions prune folders."""
    found = spark.read.option("basePath", path).parquet(path)
    if optimizer is not None:
        found = found.where(F.col("optimizer") == optimizer)
    return found if with_tumor is None else found.where(F.col("with_tumor").cast("boolean") == with_tumor)


def write_medium(medium: DataFrame, path: str, facts: dict[str, str]) -> None:
    medium.write.parquet(f"{path}/pixels")
    medium.sparkSession.createDataFrame(sorted(facts.items()), "name string, value string").write.parquet(f"{path}/facts")


def read_medium(spark: SparkSession, path: str, expected: dict[str, str] | None = None) -> DataFrame:
    """The pixels; an error that names the facts that differ from the expected ones."""
    stored = {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/facts").collect()}
    wrong = {k: (stored.get(k), v) for k, v in (expected or {}).items() if stored.get(k) != v}
    if wrong:
        raise ValueError(f"stored medium differs: {wrong}")
    return spark.read.parquet(f"{path}/pixels")
