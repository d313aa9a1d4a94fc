"""MAT files of level 5: an index of the variables, and tasks that read ranges of them."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from . import arrays

#: Fixed values of the format: number types by data type, classes of arrays, the two containers.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
CLASSES = {4: "char", 6: "double", 7: "single", 8: "int8", 9: "uint8", 10: "int16", 11: "uint16", 12: "int32", 13: "uint32", 14: "int64", 15: "uint64"}
MATRIX, COMPRESSED = 14, 15
#: Bytes of a variable that hold all that stands before its values.
HEAD = 1 << 16


@dataclass
class Part:
    """Numbers in a row, ``at`` bytes behind the begin of the file or, in a compressed variable, of what it inflates to."""

    number: str
    at: int
    size: int


@dataclass
class Variable:
    name: str
    kind: str
    shape: tuple[int, ...]
    re: Part
    im: Part | None
    packed: tuple[int, int] | None = None


class _Inflated:
    """The bytes of a compressed variable, read in order; no more than a piece of it is held."""

    def __init__(self, f, at: int, size: int):
        self.f, self.at, self.end, self.zip, self.place = f, at, at + size, zlib.decompressobj(), 0
        self.ready = bytearray()

    def read(self, n: int) -> bytes:
        while len(self.ready) < n and not self.zip.eof:
            raw = self.zip.unconsumed_tail
            if not raw:
                raw = self.f.read_at(min(1 << 16, self.end - self.at), self.at)
                self.at += len(raw)
            more = self.zip.decompress(raw, 1 << 20)
            if not raw and not more:
                break
            self.ready += more
        out = bytes(self.ready[:n])
        del self.ready[:n]
        self.place += len(out)
        return out

    def read_at(self, n: int, at: int) -> bytes:
        while self.place < at and self.read(min(1 << 20, at - self.place)):
            pass
        return self.read(n)


def _tag(raw: bytes, at: int, order: str) -> tuple[int, int, int, int]:
    """Type, size, begin of the data and begin of the next element."""
    first = int.from_bytes(raw[at : at + 4], order)
    if first >> 16:
        return first & 0xFFFF, first >> 16, at + 4, at + 8
    size = int.from_bytes(raw[at + 4 : at + 8], order)
    return first, size, at + 8, at + 8 + -(-size // 8) * 8


def _variable(raw: bytes, base: int, order: str, later) -> Variable | None:
    """The variable whose matrix element's data begin ``raw``; base is added to places. later(at): the 8 bytes at a place behind raw. None: no numbers."""
    _, _, at, following = _tag(raw, 0, order)
    flags = int.from_bytes(raw[at : at + 4], order)
    _, size, at, following = _tag(raw, following, order)
    shape = tuple(int(n) for n in np.frombuffer(raw, ("<" if order == "little" else ">") + "i4", size // 4, at))
    _, size, at, following = _tag(raw, following, order)
    name = raw[at : at + size].decode("latin1")
    if flags & 0xFF not in CLASSES:
        return None
    sign = "<" if order == "little" else ">"

    def part(here: int) -> tuple[Part, int]:
        kind, size, at, following = _tag(raw, here, order) if here + 8 <= len(raw) else (lambda t: (*t[:2], t[2] + here, t[3] + here))(_tag(later(here), 0, order))
        return Part(sign + NUMBERS[kind], base + at, size), following

    re, following = part(following)
    return Variable(name, CLASSES[flags & 0xFF], shape, re, part(following)[0] if flags & 0x0800 else None)


def index(uri: str) -> list[Variable]:
    """The numeric and text variables of a file, in its order; cells, structures and sparse arrays are left out. Only tags and heads are read."""
    found = []
    with arrays.open_input(uri) as f:
        head = f.read(128)
        order = {b"IM": "little", b"MI": "big"}.get(head[126:128])
        if order is None:
            raise ValueError(f"{uri} is not a MAT file of level 5")
        at, end = 128, f.size()
        while at + 8 <= end:
            kind, size, begin, following = _tag(f.read_at(8, at), 0, order)
            begin, following = begin + at, following + at
            if begin + size > end:
                raise ValueError(f"{uri} ends inside a variable")
            if kind == COMPRESSED:
                following = begin + size  # these are not filled up to eight bytes
                inside = _Inflated(f, begin, size).read(HEAD)
                if _tag(inside, 0, order)[0] == MATRIX:
                    variable = _variable(inside[8:], 8, order, lambda here: _Inflated(f, begin, size).read_at(8, here + 8))
                    if variable is not None:
                        variable.packed = (begin, size)
                        found.append(variable)
            elif kind == MATRIX:
                variable = _variable(f.read_at(min(size, HEAD), begin), begin, order, lambda here: f.read_at(8, begin + here))
                if variable is not None:
                    found.append(variable)
            at = following
    return found


class _Reader(DataSourceReader):
    def __init__(self, uri: str, names: list[str], task: int):
        self.uri, self.names, self.task = uri, names, task

    def partitions(self):
        out = []
        for v in index(self.uri):
            if v.name in self.names or not self.names:
                total = math.prod(v.shape)
                # What is compressed can only be read from its begin.
                out += [arrays.Range(0, total, v)] if v.packed and total else arrays.ranges(total, v, self.task)
        return out or [arrays.Range(0, 0)]

    def read(self, partition):
        v: Variable = partition.what
        if v is None:
            return
        with arrays.open_input(self.uri) as f:
            sources = [_Inflated(f, *v.packed) if v.packed else f for _ in range(2)]
            for k in range(partition.first, partition.end, arrays.BATCH):
                n = min(arrays.BATCH, partition.end - k)
                re, im = (None if p is None else self._numbers(s, p, k, n) for s, p in zip(sources, (v.re, v.im)))
                yield arrays.batch_of(k, re, im, variable=v.name)

    def _numbers(self, source, part: Part, first: int, n: int) -> np.ndarray:
        number = np.dtype(part.number)
        raw = source.read_at(n * number.itemsize, part.at + first * number.itemsize)
        if len(raw) < n * number.itemsize:
            raise ValueError(f"{self.uri}: a variable is shorter than its shape")
        return np.frombuffer(raw, number, n)


class MatFile(DataSource):
    """Rows (variable string, position long, re double, im double) of a MAT file, position counting the values column by column."""

    @classmethod
    def name(cls):
        return "sonolume_mat"

    def schema(self):
        return "variable string, position long, re double, im double"

    def reader(self, schema):
        return _Reader(self.options["path"], [n for n in self.options.get("variables", "").split(",") if n], int(self.options["task"]))


def variables(spark: SparkSession, path: str) -> dict[str, Variable]:
    return {v.name: v for v in index(arrays.located(spark, path))}


def read_mat(spark: SparkSession, path: str, names: list[str] | None = None, task: int = arrays.TASK) -> DataFrame:
    """(variable, position, re, im) of the named variables or of all; text as character codes, integers beyond 2^53 rounded.

    A plain variable is read in ranges of ``task`` values, a compressed one by one task in pieces.
    """
    spark.dataSource.register(MatFile)
    return spark.read.format("sonolume_mat").options(variables=",".join(names or []), task=str(task)).load(arrays.located(spark, path))


def read_array(spark: SparkSession, path: str, name: str, axes: list[str], value: str = "value") -> DataFrame:
    """(axes.., value) of one variable, indices from 0."""
    about = variables(spark, path).get(name)
    if about is None:
        raise ValueError(f"{path} has no variable {name}")
    if len(about.shape) != len(axes):
        raise ValueError(f"{name} has {len(about.shape)} axes, {len(axes)} are named")
    return read_mat(spark, path, [name]).select(*arrays.indices(axes, about.shape, True), F.col("re").alias(value))


def _element(kind: int, data: bytes) -> bytes:
    return kind.to_bytes(4, "little") + len(data).to_bytes(4, "little") + data + b"\0" * (-len(data) % 8)


def _matrix_head(name: str, kind: int, shape, data_type: int, size: int) -> bytes:
    """All of a variable before its values."""
    inner = _element(6, kind.to_bytes(4, "little") + bytes(4)) + _element(5, np.asarray(shape, "<i4").tobytes()) + _element(1, name.encode("latin1"))
    whole = len(inner) + 8 + size + -size % 8
    if whole >= 1 << 31:
        raise ValueError(f"{name}: a variable of this format has less than 2 GB")
    return MATRIX.to_bytes(4, "little") + whole.to_bytes(4, "little") + inner + data_type.to_bytes(4, "little") + size.to_bytes(4, "little")


def _small(name: str, value) -> bytes:
    """A text, a number or a list of numbers (one column)."""
    if isinstance(value, str):
        data = value.encode("utf-16-le")
        return _matrix_head(name, 4, (1, len(data) // 2), 4, len(data)) + data + b"\0" * (-len(data) % 8)
    numbers = np.atleast_1d(np.asarray(value, "<f8"))
    return _matrix_head(name, 6, (len(numbers), 1), 9, 8 * len(numbers)) + numbers.tobytes()


def write_mat(cells: DataFrame, path: str, name: str, axes: list[str], shape, facts: dict[str, object] | None = None, value: str = "value") -> None:
    """cells (axes.., value) as a variable of doubles, behind small ones: texts, numbers and lists of numbers. Written by many tasks."""
    head = b"MATLAB 5.0 MAT-file".ljust(116) + bytes(8) + b"\x00\x01IM"
    head += b"".join(_small(k, v) for k, v in (facts or {}).items())
    shape = tuple(shape) if len(shape) > 1 else (*shape, 1)
    total = math.prod(shape)
    head += _matrix_head(name, 6, shape, 9, 8 * total)
    arrays.write_array(arrays.placed(cells, axes, shape[: len(axes)], True, value), path, "<f8", total, head)
