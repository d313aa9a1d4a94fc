import math
import random
from collections import Counter

from sonolume.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score long, v string"


def rows_for(rng, n=400, dims=12):
    rows = []
    for i in range(n):
        v = [rng.choice([0.0, rng.gauss(0, 0.2), rng.gauss(0, 0.2)]) for _ in range(dims)]
        rows.append((i, v, 0, None, "x"))
    rows[20] = (20, None, 0, None, "x")
    rows[21] = (21, [None] + [0.5] * (dims - 1), 0, None, "x")
    rows[22] = (22, [math.inf] * dims, 0, None, "x")
    rows[23] = (23, [math.nan] * dims, 0, None, "x")
    rows[30] = (30, [0.0] * dims, 0, None, "x")
    rows += [(31, rows[31][1], 1, 5, "y"), rows[10], (None, [1.0] * dims, 0, None, "x")]
    return rows


def brute(rows, k, every):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for q, e in {i: e for i, e in good if i % every == 0}.items():
        best = sorted(((-sum(a * b for a, b in zip(e, c)), i) for i, c in good if i != q))[:k]
        out.update((q, r + 1, i, -s) for r, (s, i) in enumerate(best))
    return out


def test_against_all_scores(spark):
    rows = spark.createDataFrame(rows_for(random.Random(3)), SCHEMA).collect()
    df = spark.createDataFrame(rows, SCHEMA)
    got = topk.top_k(df, every=10).collect()
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows, 5, 10)


def test_huge_components_stay_exact(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.randint(-900_000, 900_000)) for _ in range(3)], 0, None, "") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, every=10).collect()) == brute(rows, 5, 10)


def test_every_finite_component_counts(spark):
    rows = [(0, [1.0, 1.0], 0, None, ""), (1, [2e6, 1.0], 0, None, ""), (2, [1.0, 3.0], 0, None, ""), (3, [-3e12, 7.0], 0, None, "")]
    rows = spark.createDataFrame(rows, SCHEMA).collect()  # components are 32-bit floats
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows, 5, 50) and len(got) == 3


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0, None, ""), (3, [-1.0, 1.0], 0, None, "")], SCHEMA)
    assert [(r.query_id, r["rank"], r.vec_id) for r in topk.top_k(df).collect()] == [(0, 1, 3)]
    assert topk.top_k(df.where("false")).count() == 0
