"""Iterative reconstructions. The driver only loops over scalars; every vector is a table and lineage is cut after each iteration."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, metrics, smatrix, stencil
from ..session import cut, cut_bucketed, cut_path, discard, stored_table

State = dict[str, DataFrame]
#: A^H f(A x, y) of an image x, as blocks.puller gives it.
Pull = Callable[..., DataFrame]


@dataclass
class Prior:
    """Pair prior on the pixel grid; x_size is the number of pixels in a line."""

    beta: float
    x_size: int
    kind: str = "quadratic"
    delta: float = 1.0
    radius: int = 1
    shape: str = "cross"

    def grid(self, image: DataFrame, columns: list[str]) -> DataFrame:
        return image.select(F.floor(F.col("col_id") / self.x_size).alias("z"), (F.col("col_id") % self.x_size).alias("x"), *columns)

    def of(self, image: DataFrame, surrogate: bool = False) -> DataFrame:
        """(col_id, grad, hess, energy)."""
        found = stencil.prior(self.grid(image, ["value"]), self.beta, self.kind, self.delta, radius=self.radius, shape=self.shape, surrogate=surrogate)
        return found.select((F.col("z") * self.x_size + F.col("x")).alias("col_id"), "grad", "hess", "energy")

    def energy(self, image: DataFrame) -> float:
        return self.of(image).agg(F.sum("energy")).first()[0] or 0.0


    def curvature(self) -> float:
        """Bound of the prior's second derivative: eight times that of a pair, whose relative difference is damped by 0.05."""
        return {"quadratic": 8 * self.beta, "huber": 8 * self.beta, "relative": 8 * 2 * self.beta / 0.05}[self.kind]


@dataclass
class Stop:
    """Stopping rule on a scalar a round: relative_change, cost, squared_error or gradient_norm, averaged over the last
    ``window`` rounds, or over those seen where they are fewer: two rounds are enough to stop. metrics.stopping_rounds
    judges a stored history in the same way."""

    kind: str
    threshold: float
    window: int = 5
    seen: list[float] = field(default_factory=list)

    def done(self, value: float) -> bool:
        self.seen = [*self.seen, value][-(self.window + 1) :]
        if len(self.seen) < 2:
            return False
        if self.kind in ("relative_change", "gradient_norm"):
            steps = self.seen[1:]
        else:
            steps = [abs(b - a) / (abs(a) + 1e-10) for a, b in zip(self.seen, self.seen[1:])]
        return sum(steps) / len(steps) < self.threshold


def start_image(a: DataFrame, value: float) -> DataFrame:
    return a.select("col_id").distinct().withColumn("value", F.lit(value))


def saved_rounds(rounds: int, most: int) -> list[int]:
    """Every k-th round and the last one, about ``most`` of them."""
    return sorted({*range(0, rounds, max(1, rounds // most)), rounds - 1})


def _residual(a: DataFrame, y: DataFrame, image: DataFrame) -> DataFrame:
    q = smatrix.forward(a, image)
    return q.join(y, "row_id", "left").select("row_id", (F.col("q") - F.coalesce("y", F.lit(0.0))).alias("y"))


def poisson_cost(a: DataFrame, y: DataFrame, image: DataFrame) -> float:
    """Sum of q - y ln q."""
    q = F.greatest("q", F.lit(1e-10))
    return smatrix.forward(a, image).join(y, "row_id", "left").agg(F.sum(q - F.coalesce("y", F.lit(0.0)) * F.ln(q))).first()[0] or 0.0


def squares_cost(a: DataFrame, y: DataFrame, image: DataFrame) -> float:
    """Half the squared norm of Ax - y over all rows of A and y, real or complex."""
    if "vre" in a.columns:
        parts = [F.coalesce(q, F.lit(0.0)) - F.coalesce(v, F.lit(0.0)) for q, v in (("qre", "yre"), ("qim", "yim"))]
        return smatrix.forward_complex(a, image).join(y, "row_id", "full").agg(F.sum(sum((p * p for p in parts), F.lit(0.0))) / 2).first()[0] or 0.0
    r = F.coalesce("q", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))
    return smatrix.forward(a, image).join(y, "row_id", "full").agg(F.sum(r * r) / 2).first()[0] or 0.0


def _norm(df: DataFrame, value: Column) -> float:
    return df.agg(F.sqrt(F.sum(value * value))).first()[0] or 0.0


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


class Journal:
    """Whole rounds of a reconstruction: after each, its number, the folders of its tables and its scalars are one row in ``folder``.

    A row is written after the tables that it names, and these are deleted after the row of the next round only, so that
    there is always a whole round to go on from. The folder is one that all executors share.
    """

    def __init__(self, spark: SparkSession, folder: str, about: dict):
        self.spark, self.folder, self.about = spark, folder, json.dumps(about, sort_keys=True)

    def last(self) -> tuple[int, State, dict] | None:
        """The last whole round, its tables and scalars; an error if they are of other settings."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        rows = self.spark.read.schema("round int, about string, tables map<string, struct<path: string, schema: string>>, scalars string").parquet(self.folder)
        row = rows.orderBy(F.desc("round")).first()
        if row is None:
            return None
        if row["about"] != self.about:
            raise ValueError(f"{self.folder} holds rounds of other settings: {row['about']}")
        tables = {name: stored_table(self.spark, t["path"], t["schema"]) for name, t in row["tables"].items()}
        return row["round"], tables, json.loads(row["scalars"])

    def commit(self, k: int, state: State, scalars: dict) -> None:
        tables = {name: (cut_path(t), ", ".join(f"`{c}` {kind}" for c, kind in t.dtypes)) for name, t in state.items()}
        row = self.spark.createDataFrame([(k, self.about, tables, json.dumps(scalars))], "round int, about string, tables map<string, struct<path: string, schema: string>>, scalars string")
        row.coalesce(1).write.mode("append").parquet(self.folder)


def _run(state: State, rounds: int, step: Callable[[State, int], State], after: Callable[[int, State, State], bool] | None = None, kept: Callable[[int], bool] | None = None, first: int = 0, commit: Callable[[int, State], None] | None = None) -> State:
    """Apply the step. Tables of the state are written after each round but the last, unless the step has written them, and
    those of the round before, with what the step needed in between (step.spent), are then deleted, but for the images of
    ``kept`` rounds. ``after`` may end the loop; ``commit`` is told of each whole round."""
    spent: list[DataFrame] = getattr(step, "spent", [])
    for k in range(first, rounds):
        before, state = state, step(state, k)
        if k < rounds - 1 or after or commit:
            state = {name: table if cut_path(table) else cut(table, name) for name, table in state.items()}
            done = after and after(k, before, state)
            if commit:
                commit(k, state)
            for name, table in before.items():
                if cut_path(table) and not (name == "image" and kept and k > 0 and kept(k - 1)):
                    discard(table)
            while spent:
                discard(spent.pop())
            if done:
                break
    return state


def _expectation(kind: str, columns: DataFrame, pull: Pull, prior: Prior | None, start: float, eps: float):
    """mlem, mapem (prior one step late), depierro (surrogate), ppgmlem (preconditioned gradient)."""
    floor = F.lit(1e-10)

    def step(state: State, _: int) -> State:
        image = state["image"]
        c = pull(image, blocks.ratio, eps)
        joined = image.join(columns, "col_id").join(c, "col_id", "left")
        if prior:
            joined = joined.join(prior.of(image, surrogate=kind == "depierro"), "col_id", "left")
        x, back, sens = F.col("value"), _zero("c"), F.col("sens")
        grad, hess = (_zero("grad"), _zero("hess")) if prior else (F.lit(0.0), F.lit(0.0))
        new = {
            "mlem": lambda: x * back / F.greatest(sens, floor),
            "mapem": lambda: x * back / F.greatest(sens + grad, floor),
            # A^T((y - q) / q) = A^T(y / q) - A^T 1
            "depierro": lambda: x + x * (back - sens - grad) / F.greatest(F.greatest(sens, floor) + x * hess, floor),
            "ppgmlem": lambda: x + x * (back - F.greatest(sens, floor) - grad) / F.greatest(F.greatest(sens, floor) + x * (prior.delta if prior else 1.0) * hess, floor),
        }[kind]()
        return {"image": joined.select("col_id", F.greatest(F.lit(0.0), new).alias("value"))}

    step.spent = pull.spent
    return {"image": start_image(columns, start)}, step


def _descent(columns: DataFrame, pull: Pull, step_size: float, momentum: bool, prior: Prior | None, scale: DataFrame | None):
    """Projected gradient; with momentum t <- (1 + sqrt(1 + 4 t^2)) / 2. ``scale`` (col_id, diagonal) preconditions the data term."""
    ts = [1.0]

    def step(state: State, k: int) -> State:
        table = state["image"]
        at = table.select("col_id", F.col("ahead").alias("value"))
        c = pull(at, blocks.residual)
        joined = table.join(c, "col_id", "left")
        data = _zero("c")
        if scale is not None:
            joined, data = joined.join(scale, "col_id", "left"), _zero("c") / F.col("diagonal")
        if prior:
            joined, data = joined.join(prior.of(at), "col_id", "left"), data + _zero("grad")
        while len(ts) <= k + 1:  # a resumed run begins at a later round
            ts.append((1 + (1 + 4 * ts[-1] ** 2) ** 0.5) / 2)
        new = F.greatest(F.lit(0.0), F.col("ahead") - step_size * data)
        push = (ts[k] - 1) / ts[k + 1] if momentum else 0.0
        return {"image": joined.select("col_id", new.alias("value"), (new + push * (new - F.col("value"))).alias("ahead"))}

    step.spent = pull.spent
    return {"image": start_image(columns, 0.0).withColumn("ahead", F.col("value"))}, step


def _conjugate(columns: DataFrame, pull: Pull, step_size: float, prior: Prior | None, start: float):
    """Fletcher-Reeves directions with a fixed step, clipped at zero."""

    def step(state: State, k: int) -> State:
        table = state["image"]
        image = table.select("col_id", "value")
        joined = table.join(pull(image, blocks.residual), "col_id", "left")
        r = -_zero("c")
        if prior:
            joined, r = joined.join(prior.of(image), "col_id", "left"), r - _zero("grad")
        joined = cut(joined.select("col_id", "value", "d", r.alias("r")), "direction")
        step.spent.append(joined)
        size = joined.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
        share = size / (step.scalars["last"] + 1e-10) if k else 0.0
        step.scalars["last"] = size
        d = F.col("r") + share * F.col("d")
        return {"image": joined.select("col_id", F.greatest(F.lit(0.0), F.col("value") + step_size * d).alias("value"), d.alias("d"))}

    step.spent, step.scalars = pull.spent, {"last": 0.0}
    return {"image": start_image(columns, start).withColumn("d", F.lit(0.0))}, step


def primal_dual_steps(a: DataFrame, x_size: int, z_size: int, subsets: int = 1, rho: float = 0.99) -> tuple[DataFrame, DataFrame, float]:
    """Diagonal step sizes: (col_id, tau), (row_id, sigma), both written, and the one of the gradient's dual."""
    rows, cols = cut(smatrix.absolute_sums(a, "row_id"), "row_sums"), cut(smatrix.absolute_sums(a, "col_id"), "column_sums")
    low_row, low_col = (max((metrics.median(t, "total") or 0.0) * 1e-6, 1e-12) for t in (rows, cols))
    z, x = F.floor(F.col("col_id") / x_size), F.col("col_id") % x_size
    near = 4 - sum((F.when(c, 1).otherwise(0) for c in (z == 0, z == z_size - 1, x == 0, x == x_size - 1)), F.lit(0))
    tau = cut(cols.select("col_id", (rho / subsets / (F.greatest("total", F.lit(low_col)) + near)).alias("tau")), "tau")
    sigma = cut(rows.select("row_id", (rho / F.greatest("total", F.lit(low_row))).alias("sigma")), "sigma")
    discard(rows)
    discard(cols)
    return tau, sigma, rho / 2


def _primal_dual(columns: DataFrame, pull: Pull, beta: float, tau: DataFrame | float, sigma: float | None, sigma_p: float, x_size: int, theta: float, subsets: int, t_size: int):
    """Primal-dual splitting with total variation; with subsets each round updates the rows of one subset of emissions.
    sigma None: the signal of ``pull`` has the steps of the rows."""

    def moved(d, q, y, s):
        return (d + s * (q - y)) / (1 + s)

    def step(state: State, k: int) -> State:
        image, tv = state["image"], state["tv"]
        ahead = image.select("col_id", F.col("ahead").alias("value"))
        move = moved
        if subsets > 1:  # emissions are dealt anew each time all subsets have been used
            mine = F.pmod(F.xxhash64(F.floor(F.col("row_id") / t_size), F.lit(k // subsets)), F.lit(subsets)) == k % subsets
            move = lambda d, q, y, s: F.when(mine, moved(d, q, y, s)).otherwise(d)
        dual, back = pull.advanced(image, "ahead", state.get("dual"), move, sigma)
        grid = ahead.select(F.floor(F.col("col_id") / x_size).alias("z"), (F.col("col_id") % x_size).alias("x"), "value")
        g = stencil.gradient(grid).withColumnsRenamed({"gz": "dz", "gx": "dx"})
        raised = tv.join(g, ["z", "x"]).select("z", "x", (F.col("gz") + sigma_p * F.col("dz")).alias("gz"), (F.col("gx") + sigma_p * F.col("dx")).alias("gx"))
        tv = cut(stencil.project_ball(raised, beta), "tv")
        div = stencil.divergence(tv).select((F.col("z") * x_size + F.col("x")).alias("col_id"), F.col("value").alias("div"))
        joined = image.join(back, "col_id", "left").join(div, "col_id", "left")
        if isinstance(tau, DataFrame):
            joined = joined.join(tau, "col_id")
        # The adjoint of the gradient is minus the divergence.
        new = F.greatest(F.lit(0.0), F.col("value") - (F.col("tau") if isinstance(tau, DataFrame) else F.lit(tau)) * (_zero("c") - _zero("div")))
        return {"image": joined.select("col_id", new.alias("value"), (new + theta * (new - F.col("value"))).alias("ahead")), "dual": dual, "tv": tv}

    def resume(state: State) -> State:
        """Duals of a journal under the rows of this call."""
        step.spent.append(state["dual"])
        return state | {"dual": pull.dealt(state["dual"])}

    step.spent, step.resume = pull.spent, resume
    zero = start_image(columns, 0.0)
    grid = zero.select(F.floor(F.col("col_id") / x_size).alias("z"), (F.col("col_id") % x_size).alias("x"), F.lit(0.0).alias("gz"), F.lit(0.0).alias("gx"))
    return {"image": zero.withColumn("ahead", F.col("value")), "tv": grid}, step


def lbfgs(a: DataFrame, y: DataFrame, rounds: int, prior: Prior | None = None, start: float = 0.1, memory: int = 10) -> DataFrame:
    """Limited-memory BFGS on w with image = w^2.

    w, its gradient g and the pairs (s_i, u_i) are columns of one table. One aggregation gives all inner products; the two
    loops then run on the driver on the coefficients of the direction in these vectors, so no vector leaves Spark. The
    residual along a direction is r + t q1 + t^2 q2: the data cost of every trial step follows from six sums over the rows,
    which one pass over the cells gives.
    """
    a, y = stored(a, y)
    columns = cut(a.select("col_id").distinct(), "columns")
    pull = blocks.puller(a, y, columns)

    def along(w, d):
        return w * w, 2 * w * d, d * d

    def products(q, q1, q2, y):
        r = q - y
        return [r * r, r * q1, q1 * q1, r * q2, q1 * q2, q2 * q2]

    def gradient(w: DataFrame) -> DataFrame:
        """w (col_id, w, ..) with g."""
        image = cut(w.select("col_id", (F.col("w") * F.col("w")).alias("value")), "vector")
        pull.spent.append(image)
        joined, grad = w.join(pull(image, blocks.residual), "col_id", "left"), _zero("c")
        if prior:
            joined, grad = joined.join(prior.of(image), "col_id", "left"), grad + _zero("grad")
        return joined.select(*w.columns, (grad * 2 * F.col("w")).alias("g"))

    def energies(table: DataFrame, steps: list[float]) -> list[float]:
        if not prior:
            return [0.0] * len(steps)
        pairs = stencil.pairs(prior.grid(table, ["w", "d"]), ["w", "d"], prior.radius, prior.shape)
        at = lambda side, t: F.pow(F.col(f"{side}_w") + t * F.col(f"{side}_d"), F.lit(2))
        sums = [F.sum(stencil.pair_energy(prior.kind, at("a", t), at("b", t), F.col("w"), prior.beta, prior.delta)[2]) / 2 for t in steps]
        return [v or 0.0 for v in pairs.agg(*[s.alias(f"e{i}") for i, s in enumerate(sums)]).first()]

    def spend() -> None:
        while pull.spent:
            discard(pull.spent.pop())

    table = cut(gradient(start_image(columns, start**0.5).withColumnRenamed("value", "w")), "lbfgs")
    spend()
    kept: list[int] = []
    for k in range(rounds):
        names = [*[f"s{i}" for i in kept], *[f"u{i}" for i in kept], "g"]
        pairs_of = [(p, q) for i, p in enumerate(names) for q in names[i:]]
        sums = table.agg(*[F.sum(F.col(p) * F.col(q)).alias(f"d{i}") for i, (p, q) in enumerate(pairs_of)]).first()
        dot = {}
        for (p, q), v in zip(pairs_of, sums):
            dot[p, q] = dot[q, p] = v or 0.0

        def inner(coef: dict[str, float], name: str) -> float:
            return sum(c * dot[n, name] for n, c in coef.items())

        def direction() -> dict[str, float]:
            coef, alphas = dict.fromkeys(names, 0.0) | {"g": 1.0}, {}
            for i in reversed(kept):
                alphas[i] = inner(coef, f"s{i}") / dot[f"s{i}", f"u{i}"]
                coef[f"u{i}"] -= alphas[i]
            newest = kept[-1] if kept else None
            scale = 1 / (dot["g", "g"] ** 0.5 + 1e-5) if newest is None else dot[f"s{newest}", f"u{newest}"] / (dot[f"u{newest}", f"u{newest}"] + 1e-10)
            coef = {n: c * scale for n, c in coef.items()}
            for i in kept:
                coef[f"s{i}"] += alphas[i] - inner(coef, f"u{i}") / dot[f"s{i}", f"u{i}"]
            return {n: -c for n, c in coef.items()}

        coef = direction()
        if inner(coef, "g") >= 0:
            kept, coef = [], {"g": -1 / (dot["g", "g"] ** 0.5 + 1e-8)}
        slope = inner(coef, "g")
        before, table = table, cut(table.withColumn("d", sum((F.lit(c) * F.col(n) for n, c in coef.items()), F.lit(0.0))), "lbfgs")
        discard(before)
        c = lambda n: F.col(n)
        s = pull.totals(table, ["w", "d"], along, products)
        steps = [0.5**i for i in range(20)]
        here, *there = energies(table, [0.0, *steps])
        data = lambda t: 0.5 * (s[0] + 2 * t * s[1] + t * t * (s[2] + 2 * s[3]) + 2 * t**3 * s[4] + t**4 * s[5])
        size = next((t for t, e in zip(steps, there) if data(t) + e <= data(0) + here + 1e-4 * t * slope), None)
        if size is None:
            break
        moved = table.select("col_id", (c("w") + size * c("d")).alias("w"), *[n for i in kept for n in (f"s{i}", f"u{i}")], c("g").alias("old"), (size * c("d")).alias(f"s{k}"))
        before, table = table, cut(gradient(moved).withColumn(f"u{k}", c("g") - c("old")).drop("old"), "lbfgs")
        discard(before)
        spend()
        curvature = table.agg(F.sum(c(f"s{k}") * c(f"u{k}"))).first()[0] or 0.0
        kept = [*kept, k][-memory:] if curvature > 1e-10 else []
        table = table.select("col_id", "w", "g", *[n for i in kept for n in (f"s{i}", f"u{i}")])
    return table.select("col_id", (F.col("w") * F.col("w")).alias("value"))


def random_image(a: DataFrame, seed: int) -> DataFrame:
    """A vector of hashes of seed and column, between -1/2 and 1/2: the same whatever the partitions."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("col_id").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double")
    return a.select("col_id").distinct().withColumn("value", drawn / F.lit(float(1 << 32)) - 0.5)


def lipschitz(a: DataFrame, rounds: int = 20, scale: DataFrame | None = None, seed: int = 0, pull: Pull | None = None) -> float:
    """Largest eigenvalue of the real part of A^H A (divided by the diagonal ``scale``) by power iteration from a random vector; zero for a zero matrix.

    A random start has a part along the leading vector, which the constant one need not have.
    """
    if pull is None:
        nothing = ("yre", "yim") if "vre" in a.columns else ("y",)
        pull = blocks.puller(a, a.select("row_id", *(F.lit(0.0).alias(c) for c in nothing)).limit(0))
    image = cut(random_image(a, seed), "power")
    size = _norm(image, F.col("value"))
    for _ in range(rounds):
        # A is linear: its result is divided, and the image is read as it was written.
        back, value = pull(image, blocks.itself), F.col("c") / (size or 1.0)
        if scale is not None:
            back, value = back.join(scale, "col_id"), value / F.col("diagonal")
        before, image = image, cut(back.select("col_id", value.alias("value")), "power")
        discard(before)
        size = _norm(image, F.col("value"))
    discard(image)
    return size


def scalar_sizes(a: DataFrame, subsets: int = 1, rho: float = 0.99, rounds: int = 20, seed: int = 0, pull: Pull | None = None) -> tuple[float, float, float]:
    """One step for all of A's columns, one for all of its rows, and that of the gradient's dual.

    They follow from the norm of A, which counts once for each subset, and that of the gradient of a grid, whose square is below 8.
    """
    whole = (subsets * lipschitz(a, rounds, seed=seed, pull=pull) + 8.0) ** 0.5
    return rho / whole, rho * subsets / whole, rho / whole


def scalar_steps(a: DataFrame, subsets: int = 1, rho: float = 0.99, rounds: int = 20, seed: int = 0, pull: Pull | None = None) -> tuple[DataFrame, DataFrame, float]:
    """scalar_sizes as primal_dual_steps gives its steps."""
    tau, sigma, sigma_p = scalar_sizes(a, subsets, rho, rounds, seed, pull)
    return a.select("col_id").distinct().withColumn("tau", F.lit(tau)), a.select("row_id").distinct().withColumn("sigma", F.lit(sigma)), sigma_p


def stored(a: DataFrame, y: DataFrame, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Matrix and signal written once, before the rounds. Bucketed by row, the joins and sums by row of each round exchange
    no cells of the matrix (those by column only partial sums); a row with very many cells then stays in one task."""
    if buckets:
        return cut_bucketed(a, "row_id", "matrix", buckets), cut_bucketed(y, "row_id", "signal", buckets)
    return a if cut_path(a) else cut(a, "matrix"), y if cut_path(y) else cut(y, "signal")


@dataclass
class Result:
    image: DataFrame
    saved: DataFrame | None
    rounds: int
    costs: list[float]


EXPECTATION = ("mlem", "mapem", "depierro", "ppgmlem")
#: Optimizer: whether it takes a prior.
OPTIMIZERS = {"mlem": False, "mapem": True, "depierro": True, "ppgmlem": True, "gradient": False, "fista": True, "conjugate": True, "primal_dual": False, "lbfgs": True}


def reconstruct(
    a: DataFrame, y: DataFrame, optimizer: str, rounds: int, *, prior: Prior | None = None, step_size: float | None = None, start: float = 0.1, eps: float = 1e-10, precondition: bool = False,
    beta: float = 0.0, x_size: int = 0, z_size: int = 0, theta: float = 1.0, subsets: int = 1, t_size: int = 1, stop: Stop | None = None, truth: DataFrame | None = None, costs: bool = False, max_saves: int = 0,
    buckets: int | None = None, steps: str = "diagonal", journal: str | None = None,
) -> Result:
    """Run an optimizer of OPTIMIZERS; saved images come as (iter, col_id, value). step_size None: 1 / (Lipschitz constants of data and prior).

    a and y: real (v, y) or complex (vre, vim, yre, yim); images are real. A and y are stored in records of rows (see
    blocks.RowBlocks) unless A has very many columns. buckets: store them as tables bucketed by row instead (see stored).
    steps: of primal_dual, diagonal or scalar. journal: a folder for whole rounds (see Journal); a call with the same matrix,
    signal and settings goes on after the last one there. Saved images of rounds before are those that the folder's run saved.
    """
    if optimizer not in OPTIMIZERS:
        raise ValueError(f"unknown optimizer {optimizer}; one of {', '.join(OPTIMIZERS)}")
    if prior and not OPTIMIZERS[optimizer]:
        raise ValueError(f"{optimizer} takes no prior")
    if optimizer == "primal_dual" and not (x_size and z_size):
        raise ValueError("primal_dual needs x_size and z_size")
    if stop and stop.kind == "squared_error" and truth is None:
        raise ValueError("squared_error needs the truth")
    if "vre" in a.columns and (optimizer == "lbfgs" or (optimizer in EXPECTATION and (costs or (stop and stop.kind == "cost")))):
        raise ValueError(f"{optimizer} has no complex form" if optimizer == "lbfgs" else "the Poisson cost has no complex form")
    if optimizer == "lbfgs":
        if stop or costs or max_saves or journal:
            raise ValueError("lbfgs has its own stopping rule and saves no rounds")
        return Result(lbfgs(a, y, rounds, prior, start), None, rounds, [])
    if steps not in ("diagonal", "scalar"):
        raise ValueError(f"steps are diagonal or scalar, not {steps}")
    settings = {
        "optimizer": optimizer, "start": start, "eps": eps, "precondition": precondition, "beta": beta, "x_size": x_size, "z_size": z_size, "theta": theta, "subsets": subsets, "t_size": t_size, "steps": steps, "step_size": step_size,
    }
    book = Journal(a.sparkSession, journal, settings | {"prior": prior and vars(prior), "stop": stop and [stop.kind, stop.threshold, stop.window]}) if journal else None
    found = book.last() if book else None
    scalars = found[2] if found else {}
    a, y = stored(a, y, buckets)
    if optimizer == "primal_dual":
        # Spark deals the emissions of subsets, so their rows take the joins.
        by_joins = bool(buckets) or subsets > 1
        if steps == "diagonal":
            tau, sigmas, sigma_p = primal_dual_steps(a, x_size, z_size, subsets)
            columns, sigma = tau, None
            pull = blocks.puller(a, sigmas.join(y, "row_id", "left"), columns, by_joins)
            if pull.holds_signal:
                discard(sigmas)
        else:
            columns = cut(a.select("col_id").distinct(), "columns")
            pull = blocks.puller(a, y, columns, by_joins)
            tau, sigma, sigma_p = scalar_sizes(a, subsets, pull=pull)
    else:
        columns = cut(smatrix.sensitivity_complex(a) if "vre" in a.columns else a.groupBy("col_id").agg(F.sum("v").alias("sens")), "sensitivity")
        pull = blocks.puller(a, y, columns, by_joins=bool(buckets))
    scale = None
    if precondition:
        d = smatrix.hessian_diagonal(a)
        top = d.agg(F.max("diagonal")).first()[0] or 1.0
        scale = cut(d.withColumn("diagonal", F.col("diagonal") + 1e-3 * top), "diagonal")
    if optimizer in ("gradient", "fista", "conjugate") and step_size is None:
        step_size = scalars.get("step_size") or 1 / ((lipschitz(a, scale=scale, pull=pull) + (prior.curvature() if prior else 0.0)) or 1.0)
    if optimizer in EXPECTATION:
        state, step, cost = *_expectation(optimizer, columns, pull, prior, start, eps), poisson_cost
    elif optimizer == "conjugate":
        state, step, cost = *_conjugate(columns, pull, step_size, prior, start), squares_cost
    elif optimizer == "primal_dual":
        state, step, cost = *_primal_dual(columns, pull, beta, tau, sigma, sigma_p, x_size, theta, subsets, t_size), squares_cost
    else:
        state, step, cost = *_descent(columns, pull, step_size, optimizer == "fista", prior, scale), squares_cost
    keep = set(saved_rounds(rounds, max_saves)) if max_saves else set()
    saved: list[tuple[int, DataFrame]] = []
    history: list[float] = scalars.get("costs", [])
    done_rounds = [rounds]
    if found:
        state = step.resume(found[1]) if hasattr(step, "resume") else found[1]
        step.scalars = scalars.get("step", {})
        saved = [(k, stored_table(a.sparkSession, *where)) for k, *where in scalars["saved"]]
        if stop:
            stop.seen = scalars["seen"]
        if scalars["done"]:
            rounds = done_rounds[0] = found[0] + 1

    def after(k: int, before: State, now: State) -> bool:
        image = now["image"].select("col_id", "value")
        if k in keep:
            saved.append((k, now["image"]))
        if costs or (stop and stop.kind == "cost"):
            history.append(cost(a, y, image) + (prior.energy(image) if prior else 0.0))
        if stop is None:
            return False
        if stop.kind == "cost":
            value = history[-1]
        elif stop.kind == "squared_error":
            value = image.join(truth, "col_id").agg(F.avg(F.pow(F.col("value") - F.col("truth"), F.lit(2)))).first()[0]
        elif stop.kind == "relative_change":
            both = image.join(before["image"].select("col_id", F.col("value").alias("old")), "col_id")
            value = _norm(both, F.col("value") - F.col("old")) / (_norm(image, F.col("value")) + 1e-10)
        elif stop.kind == "gradient_norm":
            value = _norm(pull(image, blocks.residual), F.col("c"))
        else:
            raise ValueError(f"unknown stopping rule {stop.kind}")
        done_rounds[0] = k + 1
        return stop.done(value)

    ended = [False]

    def judged(k: int, before: State, now: State) -> bool:
        ended[0] = after(k, before, now)
        return ended[0]

    def commit(k: int, now: State) -> None:
        images = [(k, cut_path(t), ", ".join(f"{c} {kind}" for c, kind in t.dtypes)) for k, t in saved]
        book.commit(k, now, {"step": getattr(step, "scalars", {}), "step_size": step_size, "costs": history, "seen": stop.seen if stop else [], "saved": images, "done": ended[0]})

    state = _run(state, rounds, step, judged if (stop or costs or max_saves) else None, lambda k: any(k == j for j, _ in saved), found[0] + 1 if found else 0, commit if book else None)
    all_saved = None
    for k, image in saved:
        part = image.select(F.lit(k).alias("iter"), "col_id", "value")
        all_saved = part if all_saved is None else all_saved.unionByName(part)
    return Result(state["image"].select("col_id", "value"), all_saved, done_rounds[0], history)


def mlem(a: DataFrame, y: DataFrame, rounds: int, start: float = 0.1, eps: float = 1e-10) -> DataFrame:
    """x <- max(0, x * A^T(y / Ax) / A^T 1)."""
    return reconstruct(a, y, "mlem", rounds, start=start, eps=eps).image


def mapem(a: DataFrame, y: DataFrame, rounds: int, beta: float, x_size: int, start: float = 0.1, eps: float = 1e-10) -> DataFrame:
    """One step late: the prior's gradient joins the sensitivity."""
    return reconstruct(a, y, "mapem", rounds, prior=Prior(beta, x_size), start=start, eps=eps).image


def gradient_descent(a: DataFrame, y: DataFrame, rounds: int, step_size: float) -> DataFrame:
    """x <- max(0, x - s A^T(Ax - y)), from zero."""
    return reconstruct(a, y, "gradient", rounds, step_size=step_size).image


def fista(a: DataFrame, y: DataFrame, rounds: int, step_size: float) -> DataFrame:
    """gradient_descent with momentum."""
    return reconstruct(a, y, "fista", rounds, step_size=step_size).image


def mlem_complex(a: DataFrame, y: DataFrame, rounds: int, start: float = 0.1, eps: float = 1e-10) -> DataFrame:
    """MLEM of a real image from complex cells (vre, vim) and signals (yre, yim): x <- max(0, x Re(A^H(y / Ax)) / |A^H 1|)."""
    return reconstruct(a, y, "mlem", rounds, start=start, eps=eps).image


def gradient_complex(a: DataFrame, y: DataFrame, rounds: int, step_size: float, momentum: bool = False) -> DataFrame:
    """Projected gradient of a real image from complex cells and signals: x <- max(0, x - s Re(A^H(Ax - y))), with momentum as FISTA."""
    return reconstruct(a, y, "fista" if momentum else "gradient", rounds, step_size=step_size).image
