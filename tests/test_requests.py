import itertools

import pytest

from sonolume.plans import requests
from sonolume.plans.solvers import OPTIMIZERS

SCHEMA = "id long, optimizer string, prior string, shape string, radius int, stop string, has_truth boolean, parameters map<string,string>"
SOUND = {"rounds": "5", "eps": "1e-9", "step_size": "auto", "beta": "0", "delta": "0.5", "gamma": "1", "theta": "0", "tau": "auto", "sigma": "0.1", "eta": "1.5", "step_rounds": "3"}


def breaches(spark, rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], SCHEMA)
    out = [set() for _ in rows]
    for r in requests.breaches(df).collect():
        out[r.id].add((r.parameter, r.breach))
    return out


def test_every_pair_of_optimizer_and_prior(spark):
    pairs = list(itertools.product([*OPTIMIZERS, "other", None], [*requests.PRIORS, "strange", None]))
    got = breaches(spark, [(o, p, "cross", 1, None, None, SOUND) for o, p in pairs])
    for (o, p), found in zip(pairs, got):
        want = set()
        if o not in OPTIMIZERS:
            want.add(("optimizer", "is unknown"))
        if p == "strange":
            want.add(("prior", "is unknown"))
        elif o in OPTIMIZERS and p not in (None, "none"):
            takes = o == "primal_dual" if p == "total_variation" else o not in ("mlem", "gradient")
            if not takes:
                want.add(("prior", "does not go with the optimizer"))
        assert found == want, (o, p)


@pytest.mark.parametrize("optimizer", requests.PARAMETERS)
def test_every_parameter(spark, optimizer):
    rows, want = [], []
    for name, bound, needed in requests.PARAMETERS[optimizer]:
        for value in (None, "0", "-1", "1e-3", "auto", "nan", "much"):
            given = {k: v for k, v in SOUND.items() if k != name} | ({} if value is None else {name: value})
            rows.append((optimizer, None, None, None, None, None, given))
            fits = value == "auto" and "auto" in bound or value == "1e-3" or value == "0" and bound == ">= 0"
            want.append(({(name, "is needed")} if needed else set()) if value is None else set() if fits else {(name, f"must be {bound}")})
    assert breaches(spark, rows) == want


def test_all_breaches_at_once(spark):
    rows = [
        ("depierro", "relative", "cross", 1, "squared_error", False, {"rounds": "0"}), ("primal_dual", "total_variation", "square", 1, "cost", True, SOUND | {"stop_threshold": "0.1", "subsets": "0"}),
        ("mlem", "huber", None, None, "never", None, None), ("mlem", None, None, None, "gradient_norm", None, SOUND | {"stop_threshold": "1e-4"}),
    ]
    got = breaches(spark, rows)
    assert got[0] == {("rounds", "must be > 0"), ("beta", "is needed"), ("delta", "is needed"), ("stop_threshold", "must be > 0"), ("stop", "needs the truth")}
    assert got[1] == {("shape", "must be cross with radius 1"), ("subsets", "must be > 0")}
    assert got[2] == {("eps", "is needed"), ("delta", "is needed"), ("prior", "does not go with the optimizer"), ("stop", "is unknown"), ("stop_threshold", "must be > 0")}
    assert got[3] == set()
    assert requests.breaches(spark.createDataFrame([], SCHEMA)).count() == 0
