"""Arrays in HDF5 files: a walk from the superblock to the table of chunks, which tasks read, unpack and place."""

from __future__ import annotations

import itertools
import math
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from . import arrays

SIGNATURE = b"\x89HDF\r\n\x1a\n"
NOWHERE = (1 << 64) - 1
#: Fixed values of the format: kinds of header messages and of filters.
DATASPACE, DATATYPE, FILL, LAYOUT, FILTERS, CONTINUED, SYMBOLS = 0x01, 0x03, 0x05, 0x08, 0x0B, 0x10, 0x11
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3
#: Unpacked bytes of chunks for one task.
TASK_BYTES = 1 << 26


@dataclass
class Dataset:
    """An array: where its values lie is ``at`` (in a row), or ``chunks``: (place of the first value, byte, size, filters left out)."""

    number: str
    shape: tuple[int, ...]
    fill: bytes = b""
    at: int | None = None
    chunk: tuple[int, ...] = ()
    chunks: list[tuple[tuple[int, ...], int, int, int]] = field(default_factory=list)
    filters: list[tuple[int, tuple[int, ...]]] = field(default_factory=list)


class _File:
    def __init__(self, uri: str, f):
        self.uri, self.f = uri, f
        self.base = next((at for at in (0, *(512 << k for k in range(20))) if at + 8 <= f.size() and f.read_at(8, at) == SIGNATURE), None)
        if self.base is None:
            raise ValueError(f"{uri} is not an HDF5 file")
        head = self.take(0, 100)
        if head[8] > 1 or head[13] != 8 or head[14] != 8:
            raise ValueError(f"{uri}: only superblocks of version 0 and 1 with 8-byte places are read")
        # Behind the K of both kinds of nodes version 1 has four bytes more.
        self.root = self.number(head, 56 + 4 * head[8] + 8)

    def take(self, at: int, size: int) -> bytes:
        return self.f.read_at(size, self.base + at)

    @staticmethod
    def number(raw: bytes, at: int, size: int = 8) -> int:
        return int.from_bytes(raw[at : at + size], "little")

    def messages(self, address: int) -> list[tuple[int, bytes]]:
        """(kind, data) of every message of an object header, those in continued blocks included."""
        head = self.take(address, 16)
        if head[0] != 1:
            raise ValueError(f"{self.uri}: only object headers of version 1 are read")
        left, blocks, found = self.number(head, 2, 2), [(address + 16, self.number(head, 8, 4))], []
        while blocks and left:
            raw, at = self.take(*blocks[0]), 0
            del blocks[0]
            while at + 8 <= len(raw) and left:
                kind, size, left = self.number(raw, at, 2), self.number(raw, at + 2, 2), left - 1
                data = raw[at + 8 : at + 8 + size]
                if kind == CONTINUED:
                    blocks.append((self.number(data, 0), self.number(data, 8)))
                found.append((kind, data))
                at += 8 + size
        return found

    def leaves(self, address: int, key_size: int):
        """(key, address) of every entry of the lowest level of a B-tree."""
        waiting = [address]
        while waiting:
            at = waiting.pop()
            head = self.take(at, 24)
            if head[:4] != b"TREE":
                raise ValueError(f"{self.uri}: no B-tree at byte {at}")
            raw, one = self.take(at + 24, self.number(head, 6, 2) * (key_size + 8) + key_size), key_size + 8
            entries = [(raw[k * one : k * one + key_size], self.number(raw, k * one + key_size)) for k in range(self.number(head, 6, 2))]
            if head[5]:
                waiting += [a for _, a in reversed(entries)]
            else:
                yield from entries

    def members(self, address: int) -> dict[str, int]:
        """Names and object headers of a group."""
        data = next((d for kind, d in self.messages(address) if kind == SYMBOLS), None)
        if data is None:
            raise ValueError(f"{self.uri}: a step of the path is no group, or one of a newer form")
        heap = self.take(self.number(data, 8), 32)
        names = self.take(self.number(heap, 24), self.number(heap, 8))
        found = {}
        for _, node in self.leaves(self.number(data, 0), 8):
            count = self.number(self.take(node, 8), 6, 2)
            raw = self.take(node + 8, 40 * count)
            for k in range(count):
                at = self.number(raw, 40 * k)
                found[names[at : names.index(b"\0", at)].decode()] = self.number(raw, 40 * k + 8)
        return found

    def dataset(self, path: str) -> Dataset:
        address = self.root
        for name in filter(None, path.split("/")):
            inside = self.members(address)
            if name not in inside:
                raise ValueError(f"{self.uri} has no {path}; there are {sorted(inside)}")
            address = inside[name]
        parts = dict(reversed(self.messages(address)))
        if not {DATASPACE, DATATYPE, LAYOUT} <= parts.keys():
            raise ValueError(f"{self.uri}: {path} is no array")
        space, fill = parts[DATASPACE], parts.get(FILL, b"")
        at = 8 if space[0] == 1 else 4
        out = Dataset(self._number_type(parts[DATATYPE], path), tuple(self.number(space, at + 8 * k) for k in range(space[1])))
        size = np.dtype(out.number).itemsize
        if fill[:1] in (b"\1", b"\2") and fill[3]:
            out.fill = fill[8 : 8 + self.number(fill, 4, 4)]
        elif fill[:1] == b"\3" and fill[1] & 0x20:
            out.fill = fill[6 : 6 + self.number(fill, 2, 4)]
        out.filters = self._filters(parts.get(FILTERS, b""), path)
        layout = parts[LAYOUT]
        if layout[0] != 3 or layout[1] not in (1, 2):
            raise ValueError(f"{self.uri}: the layout of {path} is of a form that is not read")
        if layout[1] == 1:
            where = self.number(layout, 2)
            out.at = None if where == NOWHERE else self.base + where
        else:
            dims = layout[2]
            out.chunk = tuple(self.number(layout, 11 + 4 * k, 4) for k in range(dims - 1))
            tree = self.number(layout, 3)
            if tree != NOWHERE:
                for key, where in self.leaves(tree, 8 + 8 * dims):
                    first = tuple(self.number(key, 8 + 8 * k) for k in range(dims - 1))
                    out.chunks.append((first, self.base + where, self.number(key, 0, 4), self.number(key, 4, 4)))
            stored = {c[0] for c in out.chunks}
            steps = [range(0, n, c) for n, c in zip(out.shape, out.chunk)]
            if len(stored) < math.prod(map(len, steps)):  # the others hold the fill value
                out.chunks += [(first, -1, 0, 0) for first in itertools.product(*steps) if first not in stored]
            if self.number(layout, 11 + 4 * (dims - 1), 4) != size:
                raise ValueError(f"{self.uri}: {path} has values of two sizes")
        return out

    def _number_type(self, raw: bytes, path: str) -> str:
        kind, bits, size = raw[0] & 15, raw[1], self.number(raw, 4, 4)
        letter = {0: "i" if bits & 8 else "u", 1: "f"}.get(kind)
        if letter is None or size not in (1, 2, 4, 8):
            raise ValueError(f"{self.uri}: {path} holds no plain numbers")
        return f"{'>' if bits & 1 else '<'}{letter}{size}"

    def _filters(self, raw: bytes, path: str) -> list[tuple[int, tuple[int, ...]]]:
        found, at = [], 8 if raw[:1] == b"\1" else 2
        for _ in range(raw[1] if raw else 0):
            kind = self.number(raw, at, 2)
            named = raw[0] == 1 or kind >= 256
            name = self.number(raw, at + 2, 2) if named else 0
            values = self.number(raw, at + (6 if named else 4), 2)
            at += (8 if named else 6) + name + (-name % 8 if raw[0] == 1 else 0)
            found.append((kind, tuple(self.number(raw, at + 4 * k, 4) for k in range(values))))
            at += 4 * values + (4 if raw[0] == 1 and values % 2 else 0)
            if kind not in (DEFLATE, SHUFFLE, CHECKSUM):
                raise ValueError(f"{self.uri}: {path} is packed by filter {kind}, which is not read")
        return found


def unpacked(raw: bytes, filters, left_out: int) -> bytes:
    """The bytes of a chunk, its filters undone from the last to the first; left_out has a bit for each that was not used."""
    for k, (kind, values) in reversed(list(enumerate(filters))):
        if left_out >> k & 1:
            continue
        if kind == DEFLATE:
            raw = zlib.decompress(raw)
        elif kind == SHUFFLE:
            size = values[0]
            whole = len(raw) // size * size
            raw = np.frombuffer(raw[:whole], np.uint8).reshape(size, -1).T.tobytes() + raw[whole:]
        else:
            raw = raw[:-4]
    return raw


def describe(uri: str, path: str) -> Dataset:
    with arrays.open_input(uri) as f:
        return _File(uri, f).dataset(path)


class _Reader(DataSourceReader):
    def __init__(self, uri: str, path: str, task_bytes: int):
        self.uri, self.path, self.task_bytes = uri, path, task_bytes

    def partitions(self):
        data = describe(self.uri, self.path)
        total = math.prod(data.shape)
        if not data.chunk:
            return arrays.ranges(total, data) or [arrays.Range(0, 0)]
        several = max(1, self.task_bytes // (math.prod(data.chunk) * np.dtype(data.number).itemsize))
        chunks, data.chunks = data.chunks, []
        groups = [chunks[k : k + several] for k in range(0, len(chunks), several)] if total else []
        return [arrays.Range(0, 0, (data, g)) for g in groups] or [arrays.Range(0, 0)]

    def read(self, partition):
        if partition.what is None:
            return
        with arrays.open_input(self.uri) as f:
            if isinstance(partition.what, Dataset):
                yield from self._row(f, partition.what, partition.first, partition.end)
            else:
                for one in partition.what[1]:
                    yield from self._chunk(f, partition.what[0], *one)

    def _filled(self, data: Dataset, n: int) -> np.ndarray:
        number = np.dtype(data.number)
        return np.full(n, np.frombuffer(data.fill, number)[0] if len(data.fill) == number.itemsize else 0, number)

    def _row(self, f, data: Dataset, first: int, end: int):
        number = np.dtype(data.number)
        for k in range(first, end, arrays.BATCH):
            n = min(arrays.BATCH, end - k)
            if data.at is None:
                yield arrays.batch_of(k, self._filled(data, n)).drop_columns(["im"])
                continue
            raw = f.read_at(n * number.itemsize, data.at + k * number.itemsize)
            if len(raw) < n * number.itemsize:
                raise ValueError(f"{self.uri}: {self.path} is shorter than its shape")
            yield arrays.batch_of(k, np.frombuffer(raw, number)).drop_columns(["im"])

    def _chunk(self, f, data: Dataset, first, at: int, size: int, left_out: int):
        import pyarrow as pa

        whole = math.prod(data.chunk)
        if at < 0:
            values = self._filled(data, whole)
        else:
            values = np.frombuffer(unpacked(f.read_at(size, at), data.filters, left_out), data.number, whole)
        inside = tuple(slice(0, min(c, n - a)) for c, n, a in zip(data.chunk, data.shape, first))
        values = values.reshape(data.chunk)[inside]
        place = np.zeros(1, np.int64)
        for n, a, s in zip(values.shape, first, arrays.strides(data.shape, False)):
            place = (place[:, None] + (np.arange(a, a + n, dtype=np.int64) * s)[None]).ravel()
        values = values.ravel().astype(float)
        for k in range(0, len(values), arrays.BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(place[k : k + arrays.BATCH]), pa.array(values[k : k + arrays.BATCH])], ["position", "re"])


class Hdf5File(DataSource):
    """Rows (position long, re double) of one array of an HDF5 file, position counting in C order. Chunks are dealt to tasks."""

    @classmethod
    def name(cls):
        return "sonolume_hdf5"

    def schema(self):
        return "position long, re double"

    def reader(self, schema):
        return _Reader(self.options["path"], self.options["array"], int(self.options["task_bytes"]))


def read_hdf5(spark: SparkSession, path: str, array: str, axes: list[str], value: str = "value", task_bytes: int = TASK_BYTES) -> DataFrame:
    """(axes.., value) of one array (a path of names); contiguous, or in chunks with deflate, shuffle and checksum (not verified)."""
    uri = arrays.located(spark, path)
    shape = describe(uri, array).shape
    if len(shape) != len(axes):
        raise ValueError(f"{array} of {path} has {len(shape)} axes, {len(axes)} are named")
    spark.dataSource.register(Hdf5File)
    rows = spark.read.format("sonolume_hdf5").options(array=array, task_bytes=str(task_bytes)).load(uri)
    return rows.select(*arrays.indices(axes, shape, False), F.col("re").alias(value))


def _message(kind: int, data: bytes) -> bytes:
    data += b"\0" * (-len(data) % 8)
    return kind.to_bytes(2, "little") + len(data).to_bytes(2, "little") + bytes(4) + data


def _header(messages: list[bytes]) -> bytes:
    body = b"".join(messages)
    return b"\1\0" + len(messages).to_bytes(2, "little") + (1).to_bytes(4, "little") + len(body).to_bytes(4, "little") + bytes(4) + body


def head_of(name: str, shape, end: int) -> bytes:
    """All of a file with one array of doubles but its values, which follow; end: bytes of the values."""
    n8 = lambda *values: b"".join(v.to_bytes(8, "little") for v in values)
    root, tree, heap, names, node, data, first = 96, 136, 680, 712, 800, 1128, 2048
    super_block = SIGNATURE + bytes(5) + b"\x08\x08\0" + b"\x04\0\x10\0" + bytes(4) + n8(0, NOWHERE, first + end, NOWHERE)
    super_block += n8(0, root) + (1).to_bytes(4, "little") + bytes(4) + n8(tree, heap)
    group = _header([_message(SYMBOLS, n8(tree, heap))])
    text = bytes(8) + name.encode() + b"\0"
    text += b"\0" * (-len(text) % 8)
    if len(text) > node - names:
        raise ValueError("the name is too long")
    b_tree = b"TREE\0\0\1\0" + n8(NOWHERE, NOWHERE, 0, node, 8)
    local = b"HEAP" + bytes(4) + n8(len(text), 1, names)
    symbol = b"SNOD\1\0\1\0" + n8(8, data) + bytes(24)
    space = b"\1" + bytes([len(shape)]) + bytes(6) + n8(*shape)
    double = b"\x11\x20\x3f\0" + (8).to_bytes(4, "little") + b"\0\0\x40\0\x34\x0b\0\x34" + (1023).to_bytes(4, "little")
    array = _header([_message(DATASPACE, space), _message(DATATYPE, double), _message(FILL, b"\2\2\2\0"), _message(LAYOUT, b"\3\1" + n8(first, end))])
    out = bytearray(first)
    for at, part in ((0, super_block), (root, group), (tree, b_tree), (heap, local), (names, text), (node, symbol), (data, array)):
        out[at : at + len(part)] = part
    return bytes(out)


def write_hdf5(cells: DataFrame, path: str, name: str, axes: list[str], shape, value: str = "value") -> None:
    """cells (axes.., value) as one contiguous array of doubles in the root group, written by many tasks. Places without a row are zero."""
    total = math.prod(shape)
    arrays.write_array(arrays.placed(cells, axes, shape, False, value), path, "<f8", total, head_of(name, shape, 8 * total))
