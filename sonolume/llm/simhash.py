"""SimHash near-duplicates: pivot distance tables discard candidate pairs, survivors are verified, components formed."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize

SEED = 42
#: Shingles whose bits are counted at once.
CHUNK = 65_536
#: Distances to so many reference fingerprints are kept, nine to a long (seven bits each).
PIVOTS = 18
#: Fingerprints that a bucket holds by chance at most about.
BUCKET = 8


def fingerprint(text: bytes, width: int) -> int:
    """64-bit SimHash of a UTF-8 text as a signed long."""
    import xxhash

    words = text.lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    n = max(1, len(words) - width + 1)
    ends = [s - 1 for s in starts[width:]] + [len(joined)]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for k in range(0, n, CHUNK):
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + CHUNK], ends[k : k + CHUNK])])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (long, the fingerprint's 64 bits) and the longs named in carry of every row. Null and blank texts: 0."""
    names = ["doc_id", "fp", *carry]

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py() or b"", width) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64()), *batch.columns[2:]], names)

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *carry)
    return base.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pivot_table(fp: Column, pivots: int = PIVOTS) -> list[Column]:
    """Longs t0, t1, ... holding the distances of fp to the reference fingerprints xxhash64(0), xxhash64(1), ..."""
    longs = []
    for first in range(0, pivots, 9):
        parts = [F.shiftleft(_distance(fp, F.xxhash64(F.lit(first + k))).cast("long"), 7 * k) for k in range(min(9, pivots - first))]
        longs.append(reduce(lambda a, b: a + b, parts).alias(f"t{first // 9}"))
    return longs


def _near_all_pivots(a: str, b: str, max_bits: int, pivots: int) -> Column:
    """No coordinate of the two tables differs by more than max_bits (else the triangle inequality rules the pair out)."""

    def at(side: str, k: int) -> Column:
        return F.shiftright(F.col(f"{side}t{k // 9}"), 7 * (k % 9)).bitwiseAND(F.lit(127))

    return reduce(lambda x, y: x & y, [F.abs(at(a, k) - at(b, k)) <= max_bits for k in range(pivots)])


def blocks_for(n: int, max_bits: int) -> int:
    """Blocks to cut fingerprints into: pairs within max_bits leave blocks - max_bits of them equal, which makes the key of a
    bucket. The least number, two more than max_bits at least, for which n random fingerprints leave BUCKET or fewer in one,
    so that the pairs tested grow with n and not with its square."""
    blocks = max_bits + 2
    while blocks < 16 and n >> (64 * (blocks - max_bits) // blocks) > BUCKET:
        blocks += 1
    return blocks


def _block_keys(fp: Column, equal: int, blocks: int) -> Column:
    """A long for each choice of ``equal`` blocks: the choice's number and the bits of its blocks."""
    bounds = [64 * b // blocks for b in range(blocks + 1)]
    part = [F.shiftrightunsigned(F.shiftleft(fp, bounds[b]), 64 - bounds[b + 1] + bounds[b]) for b in range(blocks)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), equal)):
        key = F.lit(number).cast("long")
        for b in chosen:
            key = F.shiftleft(key, bounds[b + 1] - bounds[b]).bitwiseOR(part[b])
        keys.append(key)
    return F.array(*keys)


def link_fingerprints(fps: DataFrame, max_bits: int = 4, blocks: int | None = None, pivots: int = PIVOTS) -> DataFrame:
    """(fp, component) for every fingerprint with a link; component is some fingerprint of its class.

    fps: distinct fp (long) and weight, in a written table; blocks: by default blocks_for their number. Candidates share blocks - max_bits whole blocks (every linked pair does). In each
    bucket of candidates the fingerprint with most documents is a further pivot: all others are compared with it first.
    Members of one component need no more comparisons with one another, so what remains are the members outside the
    pivot's component, against their bucket. Pairs are made for those alone, never for a whole group of near copies.
    """
    blocks = blocks or blocks_for(fps.count(), max_bits)
    tables = [f"t{i}" for i in range((pivots + 8) // 9)]
    table = fps.select("fp", "weight", *pivot_table(F.col("fp"), pivots))
    keyed = table.select("fp", "weight", *tables, F.explode(_block_keys(F.col("fp"), blocks - max_bits, blocks)).alias("key"))
    heads = (
        keyed.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct(F.col("fp").alias("hfp"), *(F.col(t).alias("h" + t) for t in tables)), F.struct("weight", "fp")).alias("head"))
        .where("n > 1").select("key", "head.*")
    )
    members = materialize(keyed.join(heads, "key").drop("weight"), "members")
    near_head = _near_all_pivots("", "h", max_bits, pivots) & (_distance(F.col("fp"), F.col("hfp")) <= max_bits)
    star = members.where((F.col("fp") != F.col("hfp")) & near_head).select(F.col("fp").alias("a"), F.col("hfp").alias("b"))
    first = connected_components(star)
    labelled = (
        members.join(first.select(F.col("node").alias("fp"), F.col("component").alias("c")), "fp", "left")
        .join(first.select(F.col("node").alias("hfp"), F.col("component").alias("hc")), "hfp", "left")
        .select("key", "fp", *tables, F.coalesce("c", "fp").alias("c"), F.coalesce("hc", "hfp").alias("hc"))
    )
    labelled = materialize(labelled, "labelled")
    strays = labelled.where("c <> hc").select("key", F.col("fp").alias("sfp"), *(F.col(t).alias("s" + t) for t in tables), F.col("c").alias("sc"))
    pairs = labelled.join(
        strays,
        (labelled["key"] == strays["key"]) & (F.col("c") != F.col("sc")) & ((F.col("c") == F.col("hc")) | (F.col("fp") < F.col("sfp")))
        & _near_all_pivots("", "s", max_bits, pivots) & (_distance(F.col("fp"), F.col("sfp")) <= max_bits),
    ).select(F.col("c").alias("a"), F.col("sc").alias("b"))
    second = connected_components(pairs).select(F.col("node").alias("component"), F.col("component").alias("top"))
    ends = first.select(F.col("node").alias("fp"), "component").unionByName(second.select(F.col("component").alias("fp"), "component")).distinct()
    return ends.join(second, "component", "left").groupBy("fp").agg(F.min(F.coalesce("top", "component")).alias("component"))


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id for every row: the smallest doc_id reachable over fingerprints at most max_bits apart.

    Exact copies share a fingerprint and are one node, whatever their number. Null and blank texts have fingerprint 0 and
    link like others. Rows with a null id belong to their class; a class of such rows alone has a null component_id.
    Repeated rows: one result each. Empty table: no rows.
    """
    found = materialize(fingerprints(docs, width, id_col, text_col), "fingerprints")
    fps = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("weight")), "distinct")
    links = link_fingerprints(fps.select("fp", "weight"), max_bits)
    classed = fps.join(links, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("class"))
    # Written, so that the join deals both sides out anew and can split a very large class.
    smallest = materialize(classed.groupBy("class").agg(F.min("first").alias("component_id")), "smallest")
    answer = classed.join(smallest, "class").select("fp", "component_id")
    return found.join(answer, "fp").select("doc_id", "fp", "component_id")


def class_keepers(docs: DataFrame, carry: tuple[str, ...], width: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the longs named in carry of one row for each class of near_duplicates: the smallest of both, null ids last."""
    found = fingerprints(docs, width, id_col, text_col, carry)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *carry)
    fps = materialize(found.groupBy("fp").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("weight")), "distinct")
    links = link_fingerprints(fps.select("fp", "weight"), max_bits)
    classed = fps.join(links, "fp", "left").select("first", F.coalesce("component", "fp").alias("class"))
    return classed.groupBy("class").agg(F.min("first").alias("first")).select("first.doc_id", *(f"first.{c}" for c in carry))


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
