"""What a reconstruction may be asked for: rules of optimizers, priors and stopping rules as tables, joined to the requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .solvers import OPTIMIZERS

#: Parameters of each optimizer, their bounds ("auto" is allowed where it is named), and whether they must be given.
PARAMETERS = {
    "mlem": [("rounds", "> 0", False), ("eps", "> 0", True)],
    "gradient": [("step_size", "> 0 or auto", True), ("rounds", "> 0", False), ("step_rounds", "> 0", False)],
    "mapem": [("beta", ">= 0", True), ("delta", ">= 0", True), ("rounds", "> 0", False)],
    "depierro": [("beta", ">= 0", True), ("delta", "> 0", True), ("rounds", "> 0", False)],
    "ppgmlem": [("beta", ">= 0", True), ("delta", ">= 0", True), ("rounds", "> 0", False)],
    "conjugate": [("step_size", "> 0 or auto", True), ("beta", ">= 0", True), ("delta", ">= 0", True), ("rounds", "> 0", False), ("step_rounds", "> 0", False)],
    "primal_dual": [("beta", ">= 0", True), ("gamma", "> 0", True), ("theta", ">= 0", True), ("tau", "> 0 or auto", True), ("sigma", "> 0 or auto", True), ("rounds", "> 0", False)],
    "lbfgs": [("beta", ">= 0", True), ("delta", "> 0", True), ("rounds", "> 0", False)],
    "fista": [("step_size", "> 0 or auto", True), ("beta", ">= 0", True), ("delta", ">= 0", True), ("eta", "> 0", True), ("rounds", "> 0", False), ("step_rounds", "> 0", False)],
}
#: Optimizers that take each prior, and the parameters that it needs.
WITH_PRIOR = ("mapem", "depierro", "ppgmlem", "conjugate", "primal_dual", "lbfgs", "fista")
PRIORS = {"none": (tuple(OPTIMIZERS), ()), "quadratic": (WITH_PRIOR, ()), "huber": (WITH_PRIOR, ("delta",)), "relative": (WITH_PRIOR, ("beta", "delta")), "total_variation": (("primal_dual",), ("beta",))}
STOPS = ("max_iterations", "relative_change", "cost", "squared_error", "gradient_norm")


def rules(spark: SparkSession) -> DataFrame:
    """(optimizer, parameter, bound, needed)."""
    return spark.createDataFrame([(o, *r) for o, rs in PARAMETERS.items() for r in rs], "optimizer string, parameter string, bound string, needed boolean")


def _within(value, bound):
    number = value.try_cast("double")
    number = F.when(~F.isnan(number), number)
    fits = F.when(bound.startswith(">="), number >= 0).otherwise(number > 0)
    return F.coalesce(fits, F.lit(False)) | (bound.contains("auto") & (value == "auto"))


def breaches(requests: DataFrame) -> DataFrame:
    """(id, parameter, breach): everything that is wrong with each request, all at once; a request in order has no rows.

    requests: id, optimizer, prior (null: none), shape and radius of the prior, stop (null: max_iterations), has_truth,
    parameters (map<string, string>; rounds, subsets, stop_threshold and those of PARAMETERS). The rules are a table of some
    dozen rows, sent to the tasks; requests are neither shuffled nor gathered.
    """
    spark = requests.sparkSession
    asked = requests.select(
        "id", "optimizer", F.coalesce("prior", F.lit("none")).alias("prior"), F.col("shape"), F.col("radius"), F.coalesce("stop", F.lit("max_iterations")).alias("stop"),
        F.coalesce("has_truth", F.lit(False)).alias("has_truth"), F.coalesce("parameters", F.create_map().cast("map<string,string>")).alias("parameters"),
    )
    given = lambda name: F.try_element_at("parameters", F.lit(name) if isinstance(name, str) else name)
    ruled = asked.join(F.broadcast(rules(spark)), "optimizer").withColumn("value", given(F.col("parameter")))
    bounds = ruled.where(F.col("value").isNull() & F.col("needed")).select("id", "parameter", F.lit("is needed").alias("breach")).unionByName(
        ruled.where(F.col("value").isNotNull() & ~_within(F.col("value"), F.col("bound"))).select("id", "parameter", F.concat(F.lit("must be "), F.col("bound")).alias("breach"))
    )
    allowed = F.create_map(*(x for p, (o, _) in PRIORS.items() for x in (F.lit(p), F.array(*map(F.lit, o)))))
    takes = F.try_element_at(allowed, F.col("prior"))
    known = F.col("optimizer").isin(*OPTIMIZERS)
    checks = [
        ("optimizer", ~F.coalesce(known, F.lit(False)), F.lit("is unknown")),
        ("prior", takes.isNull(), F.lit("is unknown")),
        ("prior", known & takes.isNotNull() & ~F.array_contains(takes, F.col("optimizer")), F.lit("does not go with the optimizer")),
        ("shape", (F.col("prior") == "total_variation") & (~F.col("shape").eqNullSafe("cross") | ~F.col("radius").eqNullSafe(1)), F.lit("must be cross with radius 1")),
        ("subsets", given("subsets").isNotNull() & ~_within(given("subsets"), F.lit("> 0")), F.lit("must be > 0")),
        ("stop", ~F.col("stop").isin(*STOPS), F.lit("is unknown")),
        ("stop_threshold", (F.col("stop") != "max_iterations") & ~F.coalesce(_within(given("stop_threshold"), F.lit("> 0")), F.lit(False)), F.lit("must be > 0")),
        ("stop", (F.col("stop") == "squared_error") & ~F.col("has_truth"), F.lit("needs the truth")),
    ]
    for prior, (_, needs) in PRIORS.items():
        checks += [(n, (F.col("prior") == prior) & given(n).isNull(), F.lit("is needed")) for n in needs]
    found = F.array_compact(F.array(*(F.when(wrong, F.struct(F.lit(name).alias("parameter"), text.alias("breach"))) for name, wrong, text in checks)))
    return bounds.unionByName(asked.select("id", F.explode(found).alias("c")).select("id", "c.*")).distinct()
