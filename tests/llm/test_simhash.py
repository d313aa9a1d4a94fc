import random
import re
from collections import Counter

import xxhash

from sonolume.llm import simhash
from sonolume.llm.common import connected_components, group_ranks
from pyspark.sql import functions as F

from .fixtures import awkward_docs, no_docs


def brute_fp(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    label = list(range(len(nodes)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i], nodes[j]):
                label[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(nodes))]


def test_whole_operator(spark):
    df, rows = awkward_docs(spark)
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 99)}" for _ in range(120)]
    copies = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 99)}"
        copies.append((500 + i, " ".join(w)))
    more = spark.createDataFrame([(i, t, *[None] * 8) for i, t in copies], df.schema)
    rows = rows + copies
    fps = [brute_fp(t) for _, t in rows]
    label = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (i, _), c in zip(rows, label):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = Counter((i, f"{fp:016x}", least.get(c)) for (i, _), fp, c in zip(rows, fps, label))
    found = simhash.near_duplicates(df.union(more))
    got = found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("f"), "component_id").collect()
    assert Counter((r.doc_id, r.f, r.component_id) for r in got) == want


def test_links_on_dense_fingerprints(spark):
    """Chains and balls of near fingerprints, so that members lie outside their bucket's pivot."""
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        c = rng.getrandbits(64)
        for _ in range(40):
            fps.add(c)
            for _ in range(rng.randint(1, 4)):
                c ^= 1 << rng.randrange(64)
    fps |= {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    label = brute_components(fps, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)
    df = spark.createDataFrame([(f, 1) for f in fps], "fp long, weight long")
    got = {r.fp: r.component for r in simhash.link_fingerprints(df).collect()}
    classes = lambda pairs: {frozenset(f for f, c in pairs if c == k) for k in {c for _, c in pairs}}
    want = {s for s in classes(list(zip(fps, label))) if len(s) > 1}
    assert {s for s in classes(list(got.items())) if len(s) > 1} == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)] + [(7, None), (5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for a, b in edges if b is not None and a != b for x in (a, b)})
    have = {frozenset(e) for e in edges}
    want = brute_components(nodes, lambda a, b: frozenset((a, b)) in have)
    assert got == {n: nodes[c] for n, c in zip(nodes, want)}


def test_ranks(spark):
    df = spark.range(500).selectExpr("if(id % 3 > 0, 1, id % 7) as g", "id")
    got = group_ranks(df, "g", F.xxhash64("id"), ["id"], 8).collect()
    sizes = Counter(r.g for r in got)
    assert all(sorted(r["rank"] for r in got if r.g == g) == list(range(n)) for g, n in sizes.items())


def test_empty(spark):
    assert simhash.near_duplicates(no_docs(spark)).count() == 0


def test_pairs_tested_grow_with_the_rows():
    for n in (10**3, 10**6, 10**9, 2 * 10**10, 10**12):
        blocks = simhash.blocks_for(n, 4)
        assert blocks >= 6 and n >> (64 * (blocks - 4) // blocks) <= simhash.BUCKET
    assert simhash.blocks_for(10**6, 4) == 6


def test_number_of_blocks_changes_no_link(spark):
    rng = random.Random(12)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(6)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f, 1) for f in signed], "fp long, weight long")
    label = brute_components(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)
    groups = {}
    for f, c in zip(signed, label):
        groups.setdefault(c, set()).add(f)
    want = {frozenset(g) for g in groups.values() if len(g) > 1}
    for blocks in (6, 7, 8):
        got = {}
        for r in simhash.link_fingerprints(df, blocks=blocks).collect():
            got.setdefault(r.component, set()).add(r.fp)
        assert {frozenset(g) for g in got.values()} == want
