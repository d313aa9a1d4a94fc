"""A stored matrix in records of whole rows: A^H f(A x, y) in one pass over the cells, none of which is exchanged."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, cut_path
from ..sources.arrays import file_system, located
from . import smatrix

#: Cells of a record at least, and of a row at most; longer rows are kept as cells, spread over tasks.
BLOCK, LONGEST = 1 << 13, 1 << 20
#: Columns at most: each task reads a vector of so many (128 MB), and adds up one of its own.
MOST_COLUMNS = 1 << 24
#: Sums of neighbouring columns that tasks exchange as one row.
CHUNK = 1 << 15
#: Cells in one part of the rows, about: the numbers of its rows lie in one folder.
PART = 1 << 20
#: In place of a part: sums of columns, and rows that are kept as cells.
SUMS, LONG = -1, -2
_RECORD = "part int, local binary, place binary, v binary, y binary, row binary, sigma binary"
#: The sorted columns that this Python worker has read last, with their table's folder.
_last_names: list = [None, None]


def _columns_of(uri: str, names: list[str]):
    """Arrays of these columns, file by file of a stored table."""
    import pyarrow.parquet as pq

    files, at = file_system(uri)
    from pyarrow import fs

    for found in files.get_file_info(fs.FileSelector(at)):
        if found.base_name.endswith(".parquet") and not found.base_name.startswith(("_", ".")):
            with pq.ParquetFile(files.open_input_file(found.path)) as table:
                for batch in table.iter_batches(1 << 20, columns=names):
                    yield [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


class Places:
    """Places 0, 1, .. of the columns in rising order. Without gaps between them they follow from the first; else tasks read them."""

    def __init__(self, columns: DataFrame):
        """columns: (col_id, ..), distinct, a result of cut."""
        low, high, self.count = columns.agg(F.min("col_id"), F.max("col_id"), F.count("col_id")).first()
        self.low = low or 0
        self.uri = None if not self.count or high - low + 1 == self.count else located(columns.sparkSession, cut_path(columns))

    def names(self, first: int = 0, end: int | None = None) -> np.ndarray:
        """Columns at the places from first to end."""
        if self.uri is None:
            return self.low + np.arange(first, self.count if end is None else min(end, self.count), dtype=np.int64)
        if _last_names[0] != self.uri:
            found = np.sort(np.concatenate([ids for (ids,) in _columns_of(self.uri, ["col_id"])]).astype(np.int64))
            _last_names[:] = [self.uri, found]
        return _last_names[1][first:end]

    def of(self, ids: np.ndarray) -> np.ndarray:
        """Places of columns, -1 where there is none of the name."""
        if not self.count:
            return np.full(len(ids), -1)
        if self.uri is None:
            return np.where((ids >= self.low) & (ids < self.low + self.count), ids - self.low, -1)
        names = self.names()
        at = np.minimum(np.searchsorted(names, ids), self.count - 1)
        return np.where(names[at] == ids, at, -1)

    def vectors(self, uri: str | None, names: list[str]) -> list[np.ndarray]:
        """Columns of a stored image (col_id, names..) at their places, zero elsewhere."""
        found = [np.zeros(self.count) for _ in names]
        for ids, *values in _columns_of(uri, ["col_id", *names]) if uri else ():
            at = self.of(ids)
            for x, v in zip(found, values):
                x[at[at >= 0]] = v[at >= 0]
        return found


def ratio(q: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """y / q where the signal has the row; a q below eps counts as eps."""
    if np.iscomplexobj(q):
        out = y / np.where(np.abs(q) < eps, eps, q)
    else:
        out = y / np.maximum(q, eps)
    return np.where(np.isnan(y), 0, out)


def residual(q: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """q - y, the signal being zero where it lacks the row."""
    return q - np.where(np.isnan(y), 0, y)


def itself(q: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    return q


def ones(q: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    return np.ones(len(q))


def _complex_sum(at: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    if np.iscomplexobj(weights):
        return np.bincount(at, weights.real, n) + 1j * np.bincount(at, weights.imag, n)
    return np.bincount(at, weights, n)


class RowBlocks:
    """A (row_id, col_id, v) or (row_id, col_id, vre, vim) with its signal (row_id, y) or (row_id, yre, yim), stored once. The
    signal may have a column sigma, the steps of the rows' duals (see advanced).

    A record has some thousand cells of whole rows, as arrays, and the signal of these rows. Where x and y meet a row, its
    part of A x is complete inside the record, so f(A x, y) and its share of A^H follow at once: a pass reads each cell once
    and shuffles one number a column and core; no vector passes through the driver. Rows beyond LONGEST cells are few (under cells / LONGEST) and take the
    joins of smatrix instead, so that no task holds one.
    """

    def __init__(self, a: DataFrame, y: DataFrame, columns: DataFrame | None = None, longest: int = LONGEST):
        self.spark, self.complex = a.sparkSession, "vre" in a.columns
        #: Images written for a pass, to be discarded when its result has been used.
        self.spent: list[DataFrame] = []
        if columns is None or not cut_path(columns):
            columns = cut(a.select("col_id").distinct() if columns is None else columns.select("col_id"), "columns")
        self.places = Places(columns)
        values, signal = (["vre", "vim"], ["yre", "yim"]) if self.complex else (["v"], ["y"])
        signal += ["sigma"] if "sigma" in y.columns else []
        long_rows, cells = a.groupBy("row_id").count().where(F.col("count") > longest).select("row_id"), a.count()
        self.long = None
        if cells > longest and not long_rows.isEmpty():
            long_rows = cut(long_rows, "long_rows")
            self.long = cut(a.join(long_rows, "row_id", "left_semi"), "long_cells"), cut(y.join(long_rows, "row_id", "left_semi"), "long_signal")
            a = a.join(long_rows, "row_id", "left_anti")
        places, is_complex, has_steps = self.places, self.complex, "sigma" in signal
        self.parts = max(self.spark.sparkContext.defaultParallelism, cells // PART + 1)

        def numbers(batch, names) -> np.ndarray:
            parts = [batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names]
            return parts[0] + 1j * parts[1] if is_complex else parts[0]

        def build(batches):
            waiting: list[tuple] = []

            def record(part, rows, cols, v, y, sigma):
                first = np.concatenate([[True], rows[1:] != rows[:-1]])
                local = (np.cumsum(first) - 1).astype(np.int32)
                place = places.of(cols).astype(np.int32)
                arrays = (local, place, v, y[first], rows[first].astype(np.int64), sigma[first])
                return pa.RecordBatch.from_arrays([pa.array(part[:1], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)], ["part", "local", "place", "v", "y", "row", "sigma"])

            for batch in batches:
                sigma = batch.column("sigma").to_numpy() if has_steps else np.zeros(batch.num_rows)
                waiting.append((*(batch.column(n).to_numpy() for n in ("part", "row_id", "col_id")), numbers(batch, values), numbers(batch, signal), sigma))
                if sum(len(w[0]) for w in waiting) < BLOCK:
                    continue
                columns = [np.concatenate(x) for x in zip(*waiting)]
                part, rows = columns[:2]
                # The last row may go on in the next batch.
                starts = np.flatnonzero(rows[1:] != rows[:-1]) + 1
                at = 0
                for s in starts:
                    if s - at >= BLOCK or s == starts[-1] or part[s] != part[s - 1]:
                        yield record(*(x[at:s] for x in columns))
                        at = s
                waiting = [tuple(x[at:] for x in columns)]
            if waiting and sum(len(w[0]) for w in waiting):
                columns = [np.concatenate(x) for x in zip(*waiting)]
                cuts = np.flatnonzero(np.diff(columns[0])) + 1
                for at, s in zip([0, *cuts], [*cuts, len(columns[0])]):
                    yield record(*(x[at:s] for x in columns))

        cells = a.join(y, "row_id", "left").select(self._part(), "row_id", "col_id", *values, *signal)
        self.records = cut(cells.repartition(self.parts, "row_id").sortWithinPartitions("part", "row_id").mapInArrow(build, _RECORD), "blocks")

    def _part(self):
        return F.pmod(F.hash("row_id"), F.lit(self.parts)).alias("part")

    def _written(self, image: DataFrame, names: list[str]) -> str:
        """Where the columns of an image lie, in files that tasks can read: its own, or else new ones."""
        if not cut_path(image):
            image = cut(image.select("col_id", *(F.col(n).cast("double").alias(n) for n in names)), "vector")
            self.spent.append(image)
        return located(self.spark, cut_path(image))

    def _numbers(self):
        return np.complex128 if self.complex else np.float64

    def _added(self, sums: DataFrame) -> DataFrame:
        """(col_id, c) of the tasks' sums (chunk, sums)."""
        places, cores = self.places, self.spark.sparkContext.defaultParallelism

        def add(batches):
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                for chunk, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                    more = np.frombuffer(sums.as_buffer())
                    totals[chunk] = totals[chunk] + more if chunk in totals else more.copy()
            for chunk, c in totals.items():
                yield pa.RecordBatch.from_arrays([pa.array(places.names(chunk * CHUNK, (chunk + 1) * CHUNK)), pa.array(c)], ["col_id", "c"])

        return sums.repartition(min(cores, -(-places.count // CHUNK) or 1), "chunk").mapInArrow(add, "col_id long, c double")

    def pulled(self, image: DataFrame | None, f, eps: float = 0.0) -> DataFrame:
        """(col_id, c): the real part of A^H f(A x, y); without an image x is zero. f is ratio, residual, itself or ones.

        Tasks read the image (col_id, value) from its files, into which it is written unless it comes from there. There
        are as many tasks as cores: each sends its sums of all columns once, in chunks.
        """
        path = None if image is None else self._written(image, ["value"])
        places, number = self.places, self._numbers()

        def run(batches):
            total = x = None
            for batch in batches:
                if x is None:
                    (x,), total = places.vectors(path, ["value"]), np.zeros(places.count)
                for local, place, v, y in zip(*(batch.column(k) for k in range(4))):
                    local, place = (np.frombuffer(b.as_buffer(), np.int32) for b in (local, place))
                    v, y = (np.frombuffer(b.as_buffer(), number) for b in (v, y))
                    r = f(_complex_sum(local, v * x[place], len(y)), y, eps)
                    np.add.at(total, place, (np.conj(v) * r[local]).real)
            for first in range(0, 0 if total is None else places.count, CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([first // CHUNK]), pa.array([total[first : first + CHUNK].tobytes()], pa.binary())], ["chunk", "sums"])

        cores = self.spark.sparkContext.defaultParallelism
        sums = self.records.select("local", "place", "v", "y").coalesce(cores).mapInArrow(run, "chunk long, sums binary")
        parts = self._added(sums)
        if self.long is None:
            return parts
        return parts.unionByName(joined(*self.long, image, f, eps)).groupBy("col_id").agg(F.sum("c").alias("c"))

    def totals(self, table: DataFrame, names: list[str], vectors, products) -> list[float]:
        """Sums over all rows of products(q.., y), with one q = A u for each u of vectors(columns of the table); real matrices.

        Both take arrays and Columns alike. A task sends these sums only.
        """
        path, places = self._written(table, names), self.places
        count = _count(products, len(vectors(*map(F.col, names))))

        def run(batches):
            us, found = None, np.zeros(count)
            for batch in batches:
                if us is None:
                    us = vectors(*places.vectors(path, names))
                for local, place, v, y in zip(*(batch.column(k) for k in range(4))):
                    local, place = (np.frombuffer(b.as_buffer(), np.int32) for b in (local, place))
                    v, y = (np.frombuffer(b.as_buffer()) for b in (v, y))
                    found += [p.sum() for p in products(*(np.bincount(local, v * u[place], len(y)) for u in us), np.where(np.isnan(y), 0, y))]
            yield pa.RecordBatch.from_arrays([pa.array([float(s)]) for s in found], [f"s{k}" for k in range(count)])

        sums = self.records.select("local", "place", "v", "y").coalesce(self.spark.sparkContext.defaultParallelism).mapInArrow(run, ", ".join(f"s{k} double" for k in range(count)))
        found = [v or 0.0 for v in sums.agg(*(F.sum(c) for c in sums.columns)).first()]
        return found if self.long is None else [a + b for a, b in zip(found, joined_totals(*self.long, table, names, vectors, products))]

    def advanced(self, image: DataFrame, value: str, before: DataFrame | None, f, sigma: float | None = None) -> tuple[DataFrame, DataFrame]:
        """Duals f(dual, A x, y, sigma) of the rows, for the column ``value`` of an image as x, and with them (col_id, c), the real part of A^H.

        The duals are a written table (row_id, dual or dre and dim, .., part): a task reads those of its records from the
        folder of their part. It also holds the tasks' sums. before: that of the last round, else duals are zero. sigma:
        where the signal has no such column.
        """
        path, places, number, names = self._written(image, [value]), self.places, self._numbers(), dual_names(self.complex)
        old = before is not None and located(self.spark, cut_path(before))
        order = ["row_id", *names, "sums", "part"]

        def duals_of(part: int):
            pieces = list(_columns_of(f"{old}/part={part}", ["row_id", *names]))
            rows, *values = (np.concatenate(c) for c in zip(*pieces))
            rank = np.argsort(rows)
            return rows[rank], (values[0] + 1j * values[1] if len(names) == 2 else values[0])[rank]

        def run(batches):
            total = x = held = None
            for batch in batches:
                if x is None:
                    (x,), total = places.vectors(path, [value]), np.zeros(places.count)
                for part, local, place, v, y, rows, s in zip(batch.column(0).to_pylist(), *(batch.column(k) for k in range(1, 7))):
                    local, place = (np.frombuffer(b.as_buffer(), np.int32) for b in (local, place))
                    v, y = (np.frombuffer(b.as_buffer(), number) for b in (v, y))
                    rows, s = np.frombuffer(rows.as_buffer(), np.int64), np.frombuffer(s.as_buffer()) if sigma is None else sigma
                    if old and (held is None or held[0] != part):
                        held = part, *duals_of(part)
                    dual = held[2][np.searchsorted(held[1], rows)] if old else np.zeros(len(rows), number)
                    dual = f(dual, _complex_sum(local, v * x[place], len(y)), np.where(np.isnan(y), 0, y), s)
                    np.add.at(total, place, (np.conj(v) * dual[local]).real)
                    values = [dual.real, dual.imag] if len(names) == 2 else [dual]
                    yield pa.RecordBatch.from_arrays([pa.array(rows), *map(pa.array, values), pa.nulls(len(rows), pa.binary()), pa.array(np.full(len(rows), part, np.int32))], order)
            for first in range(0, 0 if total is None else places.count, CHUNK):
                sums = pa.array([total[first : first + CHUNK].tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([first // CHUNK]), *(pa.nulls(1, pa.float64()) for _ in names), sums, pa.array([SUMS], pa.int32())], order)

        kinds = f"row_id long, {', '.join(f'{n} double' for n in names)}, sums binary, part int"
        found = self.records.coalesce(self.spark.sparkContext.defaultParallelism).mapInArrow(run, kinds)
        if self.long is not None:
            mine = joined_duals(*self.long, image.select("col_id", F.col(value).alias("value")), before and before.where(F.col("part") == LONG), f, sigma)
            found = found.unionByName(mine.select("*", F.lit(None).cast("binary").alias("sums"), F.lit(LONG).alias("part")))
        duals = cut(found, "dual", by="part")
        back = self._added(duals.where(F.col("part") == SUMS).select(F.col("row_id").alias("chunk"), "sums"))
        if self.long is not None:
            back = back.unionByName(pulled_back(self.long[0], duals.where(F.col("part") == LONG))).groupBy("col_id").agg(F.sum("c").alias("c"))
        return duals, back

    def dealt(self, duals: DataFrame) -> DataFrame:
        """Duals of another call's rows in the folders of this one's parts."""
        rows = only_duals(duals, self.complex).select("*", F.lit(None).cast("binary").alias("sums"), self._part())
        if self.long is not None:
            long_rows = self.long[0].select("row_id").distinct().withColumn("_long", F.lit(LONG))
            rows = rows.join(long_rows, "row_id", "left").withColumn("part", F.coalesce("_long", "part")).drop("_long")
        return cut(rows, "dual", by="part")


def _count(products, vectors: int) -> int:
    return len(products(*(F.lit(0.0) for _ in range(vectors + 1))))


def dual_names(is_complex: bool) -> list[str]:
    """The dual of the signal has its real and its imaginary part where cells are complex."""
    return ["dre", "dim"] if is_complex else ["dual"]


def only_duals(duals: DataFrame, is_complex: bool) -> DataFrame:
    """(row_id, dual or dre and dim), without sums."""
    return (duals.where(F.col("part") != SUMS) if "part" in duals.columns else duals).select("row_id", *dual_names(is_complex))


def joined_totals(a: DataFrame, y: DataFrame, table: DataFrame, names: list[str], vectors, products) -> list[float]:
    """RowBlocks.totals by joins and sums of cells."""
    us = vectors(*map(F.col, names))
    q = a.join(table.select("col_id", *names), "col_id").groupBy("row_id").agg(*(F.sum(F.col("v") * u).alias(f"q{k}") for k, u in enumerate(us)))
    rows = q.join(y, "row_id", "left")
    sums = products(*(F.col(f"q{k}") for k in range(len(us))), F.coalesce(F.col("y"), F.lit(0.0)))
    return [v or 0.0 for v in rows.agg(*(F.sum(p).alias(f"s{k}") for k, p in enumerate(sums))).first()]


def joined_duals(a: DataFrame, y: DataFrame, image: DataFrame, before: DataFrame | None, f, sigma: float | None) -> DataFrame:
    """The duals of RowBlocks.advanced by joins and sums of cells: (row_id, dual or dre and dim)."""
    is_complex = "vre" in a.columns
    names, qs, ys = dual_names(is_complex), *((["qre", "qim"], ["yre", "yim"]) if is_complex else (["q"], ["y"]))
    rows = (smatrix.forward_complex(a, image) if is_complex else smatrix.forward(a, image)).join(y, "row_id", "left")
    if before is not None:
        rows = rows.join(only_duals(before, is_complex), "row_id", "left")
    step = F.col("sigma") if sigma is None else F.lit(sigma)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return rows.select("row_id", *(f(zero(d) if before is not None else F.lit(0.0), zero(q), zero(s), step).alias(d) for d, q, s in zip(names, qs, ys)))


def pulled_back(a: DataFrame, duals: DataFrame) -> DataFrame:
    """(col_id, c): the real part of A^H of duals, by a join of cells."""
    if "vre" in a.columns:
        return smatrix.backward_complex(a, duals.select("row_id", F.col("dre").alias("yre"), F.col("dim").alias("yim"))).select("col_id", F.col("cre").alias("c"))
    return smatrix.backward(a, duals.select("row_id", "dual"), "dual")


def joined(a: DataFrame, y: DataFrame, image: DataFrame | None, f, eps: float) -> DataFrame:
    """pulled by joins and sums of cells, for matrices and rows of any size."""
    is_complex = "vre" in a.columns
    q_columns, y_columns = (["qre", "qim"], ["yre", "yim"]) if is_complex else (["q"], ["y"])
    if image is None:
        q = a.select("row_id", *(F.lit(0.0).alias(c) for c in q_columns)).distinct()
    else:
        q = smatrix.forward_complex(a, image) if is_complex else smatrix.forward(a, image)
    rows = q.join(y, "row_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    if f is ones:
        found = [F.lit(1.0), F.lit(0.0)]
    elif f is itself:
        found = [F.col(c) for c in q_columns]
    elif f is residual:
        found = [F.col(a) - zero(b) for a, b in zip(q_columns, y_columns)]
    elif is_complex:
        size = F.col("qre") * F.col("qre") + F.col("qim") * F.col("qim")
        small = F.sqrt(size) < eps
        re, im = zero("yre") * F.col("qre") + zero("yim") * F.col("qim"), zero("yim") * F.col("qre") - zero("yre") * F.col("qim")
        found = [F.when(small, zero(b) / eps).otherwise(n / F.nullif(size, F.lit(0.0))) for b, n in zip(y_columns, (re, im))]
    else:
        found = [zero("y") / F.greatest("q", F.lit(eps))]
    moved = rows.select("row_id", *(v.alias(c) for v, c in zip(found, y_columns)))
    if is_complex:
        return smatrix.backward_complex(a, moved).select("col_id", F.col("cre").alias("c"))
    return smatrix.backward(a, moved)


def puller(a: DataFrame, y: DataFrame, columns: DataFrame | None = None, by_joins: bool = False):
    """pulled of a matrix and its signal: in records of rows where a vector of its columns (col_id, of a, in a written table)
    is small enough for a task, else by joins. Its ``spent`` are tables to be discarded when its results have been used;
    ``totals``, ``advanced`` and ``dealt`` are those of RowBlocks; ``holds_signal``: y is not read any more."""
    columns = cut(a.select("col_id").distinct(), "columns") if columns is None else columns
    if by_joins or columns.count() > MOST_COLUMNS:
        def pull(image, f, eps=0.0):
            return joined(a, y, image, f, eps)

        def advanced(image, value, before, f, sigma=None):
            duals = cut(joined_duals(a, y, image.select("col_id", F.col(value).alias("value")), before, f, sigma), "dual")
            return duals, pulled_back(a, duals)

        pull.holds_signal = False
        pull.spent, pull.totals, pull.advanced, pull.dealt = [], partial(joined_totals, a, y), advanced, lambda duals: only_duals(duals, "vre" in a.columns)
    else:
        rows = RowBlocks(a, y, columns)

        def pull(image, f, eps=0.0):
            return rows.pulled(image, f, eps)

        pull.holds_signal = True
        pull.spent, pull.totals, pull.advanced, pull.dealt = rows.spent, rows.totals, rows.advanced, rows.dealt
    return pull
