import zlib
from collections import Counter, defaultdict

import xxhash

from sonolume.llm.sharding import bounded_ring_shards

from .fixtures import awkward_docs, no_docs


def position(s):
    return xxhash.xxh64_intdigest(s.encode(), 42) >> 4


def brute(ids, shards, virtual):
    """Keys go round the ring one at a time; a queue of keys waits for the next shard with room."""
    nodes = sorted((position(f"node:{i}"), i // virtual) for i in range(shards * virtual))
    keys = sorted(position("" if i is None else str(i)) for i in ids)
    room = [len(ids) // shards + (s < len(ids) % shards) for s in range(shards)]
    out, queue, k = Counter(), [], 0
    for lap in range(2):
        for p, s in nodes:
            while k < len(keys) and (lap or keys[k] <= p):
                queue.append(keys[k])
                k += 1
            while queue and room[s]:
                out[queue.pop(0), s] += 1
                room[s] -= 1
    return out


def test_matches_a_walk_over_single_keys(spark):
    df, rows = awkward_docs(spark)
    got = bounded_ring_shards(df, shards=7, virtual=5, cells=16).collect()
    want = brute([i for i, _ in rows], 7, 5)
    assert Counter((position("" if r.doc_id is None else str(r.doc_id)), r.shard) for r in got) == want
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    by = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_a_very_common_id_is_ranked_in_pieces(spark):
    ids = [None] * 700 + [5] * 400 + list(range(1000))
    df = spark.createDataFrame([(i, f"t {k % 3}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(5)
    got = bounded_ring_shards(df, shards=7, virtual=5, cells=16, crowd=40).collect()
    assert Counter((position("" if r.doc_id is None else str(r.doc_id)), r.shard) for r in got) == brute(ids, 7, 5)
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((i, zlib.crc32(f"t {k % 3}".encode())) for k, i in enumerate(ids))
    for s in range(7):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(300))


def test_one_more_shard_moves_little(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "'t' as text")
    a = {r.doc_id: r.shard for r in bounded_ring_shards(df, shards=12, cells=64).collect()}
    b = {r.doc_id: r.shard for r in bounded_ring_shards(df, shards=13, cells=64).collect()}
    assert sum(a[i] != b[i] for i in a) < 0.6 * len(a)


def test_empty(spark):
    assert bounded_ring_shards(no_docs(spark)).count() == 0
