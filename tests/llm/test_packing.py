import random
from collections import Counter, defaultdict

from sonolume.llm.packing import attention_cost, pack, plan_bins

from .fixtures import awkward_docs, no_docs


def single_bin(left, capacities):
    """The next bin, filled piece after piece: the longest piece first, then always the longest that fits."""
    longest, best = max(left), None
    for c in sorted(capacities):
        if c < longest:
            continue
        have, room, items = Counter(left), c, []
        while fits := [n for n, k in have.items() if k > 0 and n <= room]:
            n = max(fits)
            items.append(n)
            have[n] -= 1
            room -= n
        size = min(x for x in capacities if x >= c - room)
        price = attention_cost(size) / (c - room)
        if best is None or price < best[0]:
            best = price, size, items
    return best[1], Counter(best[2])


def test_plan_follows_the_rule():
    rng = random.Random(0)
    for _ in range(60):
        capacities = sorted(rng.sample(range(10, 80), 3))
        left = Counter({rng.randint(1, capacities[-1]): rng.randint(1, 9) for _ in range(rng.randint(1, 12))})
        for size, times, uses in plan_bins(dict(left), capacities):
            assert (size, Counter(dict(uses))) == single_bin(left, capacities)
            left = left - Counter({n: k * times for n, k in uses})
        assert not left


def check(rows, got, capacities):
    bins, sizes = defaultdict(list), {}
    for r in got:
        bins[r.bin].append((r.offset, r.length))
        assert sizes.setdefault(r.bin, r.capacity) == r.capacity and r.capacity in capacities
    for b, items in bins.items():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= sizes[b] and not any(c >= at for c in capacities if c < sizes[b])
    assert sorted(bins) == list(range(len(bins)))
    want = Counter((i, len((t or "").encode().split()) + 1) for i, t in rows)
    docs = Counter()
    for r in got:
        docs[r.doc_id] += r.length
    total = Counter()
    for (i, n), k in want.items():
        total[i] += n * k
    assert docs == total


def test_bins_hold_everything(spark):
    df, rows = awkward_docs(spark)
    check(rows, pack(df, (32, 64, 200)).collect(), (32, 64, 200))


def test_one_common_length(spark):
    rows = [(i, "a b c") for i in range(900)] + [(900 + i, "x " * (i % 50)) for i in range(200)]
    check(rows, pack(spark.createDataFrame(rows, "doc_id long, text string"), (16, 64)).collect(), (16, 64))


def test_empty(spark):
    assert pack(no_docs(spark)).count() == 0
