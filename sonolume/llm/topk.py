"""Exact top-k search by MaxScore over signed integer vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one shard and queries of one block at most about; every shard meets every block in a task of its own.
SHARD_ROWS = 16_384
BLOCK_QUERIES = 2_048
LEAST_SHARDS = 32
#: Rows scored at once to begin with a threshold.
FIRST_ROWS = 64


class Shard:
    """Postings of one shard. A term is a dimension and a sign: it holds the rows whose component has that sign."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.postings = []
        for column in self.rows.T:
            terms = []
            for sign in (1, -1):
                at = np.nonzero(column * sign > 0)[0]
                weights = np.abs(column[at])
                terms.append((at, weights, weights.max() if len(at) else 0))
            self.postings.append(terms)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k highest scores of rows with another id, as (ids, scores); ties to the smaller id."""
        terms = [(abs(w) * self.postings[d][int(w < 0)][2], abs(w), self.postings[d][int(w < 0)], d) for d, w in enumerate(query) if w]
        terms.sort(key=lambda t: -t[0])
        first = (self.rows[:FIRST_ROWS] @ query)[self.ids[:FIRST_ROWS] != own]
        least = np.sort(first)[-k] if len(first) >= k else None
        if least is None or least <= 0:
            # A row without any matching term may be among the best: nothing can be left out.
            found = np.arange(len(self.ids))
        else:
            # Bounds of what the terms from i on can add; those whose sum stays below the threshold are not essential.
            rest = np.append(np.cumsum([t[0] for t in terms][::-1])[::-1], 0)
            essential = int(np.argmax(rest < least))
            gathered = np.zeros(len(self.ids), self.rows.dtype)
            for _, w, (at, weights, _), _ in terms[:essential]:
                gathered[at] += w * weights
            found = np.nonzero(gathered + rest[essential] >= least)[0]
            # Probe the others while a row is competitive.
            middle = (essential + len(terms)) // 2
            for a, b in ((essential, middle), (middle, len(terms))):
                if b > a and len(found):
                    dims = [t[3] for t in terms[a:b]]
                    gathered[found] += np.maximum(self.rows[np.ix_(found, dims)] * query[dims], 0).sum(axis=1)
                    found = found[gathered[found] + rest[b] >= least]
        found = found[self.ids[found] != own]
        scores = self.rows[found] @ query
        by_id = np.argsort(self.ids[found], kind="stable")
        best = by_id[np.argsort(-scores[by_id], kind="stable")][:k]
        return self.ids[found][best], scores[best]


def _matrix(vectors: list, dims: int, dtype) -> np.ndarray:
    out = np.zeros((len(vectors), dims), dtype)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _scaled(scale: int):
    """floor(scale * x) as a double; doubles of 2**53 and more are whole already."""

    def of(x):
        y = x.cast("double") * scale
        return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)

    return of


def _cell(k: int):
    def run(table: pa.Table) -> pa.Table:
        ids, vectors = table["vec_id"].to_numpy(), table["v"].to_pylist()
        is_query = table["is_query"].to_numpy(zero_copy_only=False)
        dims = max(map(len, vectors), default=0)
        largest = max((max(map(abs, v), default=0) for v in vectors), default=0)
        dtype = np.float64 if largest * largest * max(dims, 1) < 1 << 53 else object
        if dtype is object:
            vectors = [[int(x) for x in v] for v in vectors]
        matrix = _matrix(vectors, dims, dtype)
        out_q, out_v, out_s = [], [], []
        if not is_query.all():
            shard = Shard(ids[~is_query], matrix[~is_query])
            for i in np.nonzero(is_query)[0]:
                found, scores = shard.search(matrix[i], ids[i], k)
                out_q += [int(ids[i])] * len(found)
                out_v += found.tolist()
                out_s += [int(s) for s in scores]
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.int64())})

    return run


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of floor(scale * x) for each query (id divisible by every).

    Rows are dealt by hash into shards and queries into blocks; each pair of a shard and a block is one group of bounded
    size, which keeps its own best k a query, and these are merged. Null vectors and vectors with null or non-finite
    components take no part, nor do null ids. Every finite component counts whole: groups in which a score may not be exact
    in doubles are scored in integers of any size, and a score that no long holds is an error. Shorter vectors count as
    padded with zeros. Rows with the query's own id are no candidates; other repeated rows are candidates each; a repeated query
    is answered once. No queries or no candidates: no rows.
    """
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    base = embeddings.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(~bad)
    base = base.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, _scaled(scale)).alias("v"))
    asked = base.where(F.col("vec_id") % every == 0)
    n, q = embeddings.select(F.count(F.lit(1)), F.count(F.when(F.col(id_col) % every == 0, 1))).first()
    shards, blocks = max(LEAST_SHARDS, -(-n // SHARD_ROWS)), max(1, -(-q // BLOCK_QUERIES))
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    rows = base.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), numbers(blocks).alias("block"), F.lit(False).alias("is_query"))
    queries = asked.dropDuplicates(["vec_id"]).select("vec_id", "v", numbers(shards).alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("is_query"))
    best = rows.unionByName(queries).groupBy("shard", "block").applyInArrow(_cell(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
