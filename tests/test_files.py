"""Array files laid byte by byte, read back as rows; files that tasks write together."""

import io
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolume.sources import arrays, experiment, hdf5, mat, npy


def cells_of(spark, values, axes, parts=5):
    rows = [(*map(int, at), *((float(v.real), float(v.imag)) if np.iscomplexobj(values) else (float(v),))) for at, v in np.ndenumerate(values)] if values.ndim else []
    rows = [(*r[0], *r[1:]) if isinstance(r[0], tuple) else r for r in ((at, *rest) for at, *rest in (((tuple(r[: values.ndim])), *r[values.ndim :]) for r in rows))]
    kinds = ", ".join(f"{a} long" for a in axes) + (", re double, im double" if np.iscomplexobj(values) else ", value double")
    return spark.createDataFrame(rows, kinds).repartition(parts)


def array_of(df, shape, kind=float):
    out = np.full(shape, np.nan, kind)
    for r in df.collect():
        out[tuple(r[: len(shape)])] = r[len(shape)] if len(r) == len(shape) + 1 else complex(r[len(shape)], r[len(shape) + 1])
    return out


@pytest.mark.parametrize("fortran", [False, True])
@pytest.mark.parametrize("number, shape", [("<f8", (7, 5, 3)), (">f4", (11,)), ("<i2", (4, 6)), ("<c16", (3, 4)), ("|u1", (2, 2, 2, 3))])
def test_npy_written_by_tasks(spark, tmp_path, number, shape, fortran):
    rng = np.random.default_rng(3)
    values = (rng.integers(0, 100, shape) + (1j * rng.integers(0, 100, shape) if "c" in number else 0)).astype(number)
    axes = list("abcd")[: len(shape)]
    path = str(tmp_path / "out" / "field.npy")
    npy.write_npy(cells_of(spark, values, axes), path, axes, shape, number=number, fortran=fortran)
    assert os.listdir(tmp_path / "out") == ["field.npy"]
    want = io.BytesIO()
    np.save(want, np.asfortranarray(values) if fortran and len(shape) > 1 else values)
    stored = np.load(path)
    assert stored.dtype == np.dtype(number) and np.array_equal(stored, values)
    if len(shape) > 1:
        assert open(path, "rb").read() == want.getvalue()
    got = npy.read_npy(spark, path, axes, complex_values="c" in number)
    assert np.array_equal(array_of(got, shape, complex if "c" in number else float), values)


def test_npy_with_places_left_out_is_zero_there(spark, tmp_path):
    path = str(tmp_path / "some.npy")
    npy.write_npy(spark.createDataFrame([(1, 2, 5.0), (3, 0, 7.0)], "i long, j long, value double"), path, ["i", "j"], (4, 3))
    want = np.zeros((4, 3))
    want[1, 2], want[3, 0] = 5, 7
    assert np.array_equal(np.load(path), want)
    npy.write_npy(spark.createDataFrame([], "i long, value double"), str(tmp_path / "none.npy"), ["i"], (0,))
    assert np.load(tmp_path / "none.npy").shape == (0,)


def test_failed_writing_leaves_no_file(spark, tmp_path):
    df = spark.range(100, numPartitions=4).select(F.col("id").alias("i"), F.when(F.col("id") == 60, F.raise_error(F.lit("broken")).cast("double")).otherwise(1.0).alias("value"))
    for bad in (df, spark.range(100).select((F.col("id") + 1).alias("i"), F.lit(1.0).alias("value")), spark.range(100).select(F.expr("id div 2").alias("i"), F.lit(1.0).alias("value"))):
        with pytest.raises(Exception):
            npy.write_npy(bad, str(tmp_path / "f" / "a.npy"), ["i"], (100,))
        assert not os.path.exists(tmp_path / "f") or os.listdir(tmp_path / "f") == []
    (tmp_path / "here.npy").write_bytes(b"x")
    with pytest.raises(Exception, match="exists"):
        npy.write_npy(df, str(tmp_path / "here.npy"), ["i"], (100,))


def element(kind, data, order="<", small=False):
    if small:
        return struct.pack(order + "I", len(data) << 16 | kind) + data.ljust(4, b"\0")
    return struct.pack(order + "II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def variable(name, values, kind, data_type, number, order="<", small=False, flags=0):
    inner = element(6, struct.pack(order + "II", kind | flags, 0), order) + element(5, np.array(values.shape, order + "i4").tobytes(), order)
    inner += element(1, name.encode(), order, small=len(name) <= 4)
    inner += element(data_type, values.real.astype(order + number).tobytes("F"), order, small)
    if flags & 0x800:
        inner += element(data_type, values.imag.astype(order + number).tobytes("F"), order)
    return struct.pack(order + "II", 14, len(inner)) + inner


def packed(raw):
    data = zlib.compress(raw)
    return struct.pack("<II", 15, len(data)) + data


@pytest.mark.parametrize("order", ["<", ">"])
def test_mat_by_hand(spark, tmp_path, order):
    rng = np.random.default_rng(5)
    big, wave = rng.normal(size=(37, 11)), rng.normal(size=(3, 4, 5)) + 1j * rng.normal(size=(3, 4, 5))
    ints = rng.integers(-100, 100, (2, 3))
    text = np.array([[ord(c) for c in "Größe"]])
    tiny = np.array([[3]])
    cell = struct.pack(order + "II", 14, 48) + element(6, struct.pack(order + "II", 1, 0), order) + element(5, np.array([0, 0], order + "i4").tobytes(), order) + element(1, b"cells", order)
    body = [variable("big", big, 6, 9, "f8", order), variable("i", ints, 10, 3, "i2", order), cell, variable("wave", wave, 6, 7, "f4", order, flags=0x800), variable("name", text, 4, 4, "u2", order), variable("n", tiny, 6, 2, "u1", order, small=True), variable("empty", np.zeros((0, 3)), 6, 9, "f8", order)]
    if order == "<":
        body += [packed(variable("zbig", np.tile(big, (200, 3)), 6, 9, "f8")), packed(variable("zwave", wave, 6, 9, "f8", flags=0x800))]
    path = tmp_path / "by_hand.mat"
    path.write_bytes(b"MATLAB 5.0".ljust(124) + (b"\0\1IM" if order == "<" else b"\1\0MI") + b"".join(body))
    found = mat.variables(spark, str(path))
    assert list(found) == ["big", "i", "wave", "name", "n", "empty", *(["zbig", "zwave"] if order == "<" else [])]
    assert found["wave"].shape == (3, 4, 5) and found["name"].kind == "char" and found["i"].kind == "int16"
    assert np.array_equal(array_of(mat.read_array(spark, str(path), "big", ["i", "j"]), big.shape), big)
    assert mat.read_mat(spark, str(path), ["big"], task=50).rdd.getNumPartitions() == 9
    assert np.array_equal(array_of(mat.read_array(spark, str(path), "i", ["i", "j"]), (2, 3)), ints)
    everything = {}
    for r in mat.read_mat(spark, str(path), task=50).collect():
        everything.setdefault(r.variable, {})[r.position] = complex(r.re, r.im)
    flat = lambda name: np.array([everything[name][k] for k in range(len(everything[name]))])
    assert np.array_equal(flat("wave"), wave.astype(np.complex64).ravel("F"))
    assert "".join(chr(int(c.real)) for c in flat("name")) == "Größe" and flat("n").tolist() == [3] and "empty" not in everything
    if order == "<":
        assert np.array_equal(flat("zbig").real, np.tile(big, (200, 3)).ravel("F")) and np.array_equal(flat("zwave"), wave.ravel("F"))
    with pytest.raises(ValueError, match="no variable"):
        mat.read_array(spark, str(path), "other", ["i", "j"])


def test_mat_that_is_cut_or_none(spark, tmp_path):
    raw = b"MATLAB 5.0".ljust(124) + b"\0\1IM" + variable("a", np.ones((50, 2)), 6, 9, "f8")
    (tmp_path / "cut.mat").write_bytes(raw[:-100])
    (tmp_path / "no.mat").write_bytes(b"x" * 300)
    for name in ("cut", "no"):
        with pytest.raises(ValueError):
            mat.variables(spark, f"{tmp_path}/{name}.mat")


def test_recording_of_an_experiment(spark, tmp_path):
    rng = np.random.default_rng(8)
    raw = rng.normal(size=(6, 4 * 5))
    path = str(tmp_path / "rec.mat")
    facts = {"TypeOfSequence": "Tomo – 1", "NTrig": 4, "FreqSonde": 2.5, "c": 1540.0, "Alphas": [-5.0, 0.0, 5.0], "NbElemts": 192}
    mat.write_mat(cells_of(spark, raw, ["t", "k"]), path, "raw", ["t", "k"], raw.shape, facts)
    got = experiment.read_parameters(spark, path).first()
    assert (got.TypeOfSequence, got.Naverage, got.FreqSonde, got.c, got.AngleMatrix, got.Nelement, got.Foc, got.x) == ("Tomo – 1", 4, 2.5e6, 1540.0, [-5.0, 0.0, 5.0], 192, None, None)
    parted = raw.reshape(6, 4, 5)
    for first, count in ((0, None), (1, 2)):
        want = parted[:, first : 4 if count is None else first + count].mean(axis=1)
        assert np.allclose(array_of(experiment.read_signals(spark, path, first, count).select("t", "n", "y"), (6, 5)), want)


def hdf5_by_hand(values, chunk, deflate=True, shuffle=True, missing=(), fill=None, user_block=0, levels=1, number="<f8"):
    """A file with the array group/data in chunks; the B-tree has one or two levels."""
    q = lambda *v: struct.pack(f"<{len(v)}Q", *v)
    no = (1 << 64) - 1
    size = np.dtype(number).itemsize
    out = bytearray(4096)

    def put(at, raw):
        assert at + len(raw) <= 4096
        out[at : at + len(raw)] = raw

    def message(kind, raw):
        raw += b"\0" * (-len(raw) % 8)
        return struct.pack("<HHBxxx", kind, len(raw), 0) + raw

    def header(messages):
        body = b"".join(messages)
        return struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body

    keys = []
    nd = values.ndim
    for first in np.ndindex(*(-(-n // c) for n, c in zip(values.shape, chunk))):
        origin = tuple(f * c for f, c in zip(first, chunk))
        if origin in missing:
            continue
        block = np.zeros(chunk, number)
        part = values[tuple(slice(o, o + c) for o, c in zip(origin, chunk))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        raw = block.tobytes()
        if shuffle:
            raw = np.frombuffer(raw, np.uint8).reshape(-1, size).T.tobytes()
        skip = deflate and len(keys) == 1  # the second chunk is stored without deflate
        raw = zlib.compress(raw) if deflate and not skip else raw
        keys.append((origin, len(out), len(raw), (2 if shuffle else 1) if skip else 0))
        out += raw
    node = lambda level, entries: b"TREE" + struct.pack("<BBH", 1, level, len(entries)) + q(no, no) + b"".join(struct.pack("<II", s, m) + q(*o, 0) + q(a) for o, a, s, m in entries) + struct.pack("<II", 0, 0) + q(*values.shape, 0)
    if levels == 1:
        tree = len(out)
        out += node(0, keys)
    else:
        above = []
        for k in range(0, len(keys), 3):
            above.append((keys[k][0], len(out), 0, 0))
            out += node(0, keys[k : k + 3])
        tree = len(out)
        out += node(1, above)

    def group(at_header, at_tree, at_heap, at_names, at_node, name, target):
        put(at_header, header([message(0x11, q(at_tree, at_heap))]))
        put(at_tree, b"TREE" + struct.pack("<BBH", 0, 0, 1) + q(no, no, 0, at_node, 8))
        put(at_heap, b"HEAP" + bytes(4) + q(32, 1, at_names))
        put(at_names, bytes(8) + name.encode())
        put(at_node, b"SNOD" + struct.pack("<BxH", 1, 1) + q(8, target) + bytes(24))

    put(0, b"\x89HDF\r\n\x1a\n" + bytes(5) + b"\x08\x08\0\4\0\x10\0" + bytes(4) + q(user_block, no, user_block + len(out), no) + q(0, 96) + struct.pack("<II", 1, 0) + q(200, 800))
    group(96, 200, 800, 832, 880, "group", 1000)
    group(1000, 1100, 1700, 1732, 1780, "data", 2000)
    letter = np.dtype(number)
    if letter.kind == "f":
        kind = struct.pack("<BBBBI", 0x11, 0x20, size * 8 - 1, 0, size) + (struct.pack("<HHBBBBI", 0, 64, 52, 11, 0, 52, 1023) if size == 8 else struct.pack("<HHBBBBI", 0, 32, 23, 8, 0, 23, 127))
    else:
        kind = struct.pack("<BBBBI", 0x10, (8 if letter.kind == "i" else 0) | (letter.byteorder == ">"), 0, 0, size) + struct.pack("<HH", 0, 8 * size)
    filters = ([(2, b"shuffle\0", [size])] if shuffle else []) + ([(1, b"deflate\0", [6])] if deflate else [])
    pipeline = bytes([1, len(filters)]) + bytes(6) + b"".join(struct.pack("<HHHH", k, len(n), 1, len(v)) + n + struct.pack(f"<{len(v)}I", *v) + (bytes(4) if len(v) % 2 else b"") for k, n, v in filters)
    filled = b"\2\2\2\0" if fill is None else b"\2\2\2\1" + struct.pack("<I", size) + np.array(fill, number).tobytes()
    later = message(0x08, struct.pack("<BBB", 3, 2, nd + 1) + q(tree) + struct.pack(f"<{nd + 1}I", *chunk, size))
    first = [message(0x01, struct.pack("<BBBxI", 1, nd, 0, 0) + q(*values.shape)), message(0x03, kind), message(0x05, filled)]
    if filters:
        first.append(message(0x0B, pipeline))
    body = b"".join(first) + message(0x10, q(3000, len(later)))
    put(2000, struct.pack("<BxHII4x", 1, len(first) + 2, 1, len(body)) + body)  # the layout stands in a continued block
    put(3000, later)
    return bytes(user_block) + bytes(out)


@pytest.mark.parametrize(
    "options",
    [
        {}, {"shuffle": False}, {"deflate": False}, {"deflate": False, "shuffle": False, "number": ">i2"}, {"levels": 2, "number": "<f4"}, {"user_block": 512, "number": "<u4"}, {"missing": [(0, 0), (4, 3)], "fill": 7.0}, {"missing": [(4, 0)]},
    ],
)
def test_hdf5_in_chunks_by_hand(spark, tmp_path, options):
    number = options.get("number", "<f8")
    values = np.random.default_rng(2).integers(0, 1000, (9, 8)).astype(number)
    path = tmp_path / "by_hand.h5"
    path.write_bytes(hdf5_by_hand(values, (4, 3), **options))
    want = values.astype(float)
    for a, b in options.get("missing", ()):
        want[a : a + 4, b : b + 3] = options.get("fill", 0.0)
    got = hdf5.read_hdf5(spark, str(path), "group/data", ["i", "j"], task_bytes=200)
    assert got.count() == 72 and np.array_equal(array_of(got, (9, 8)), want)
    assert got.rdd.getNumPartitions() > 1
    with pytest.raises(ValueError, match="group"):
        hdf5.read_hdf5(spark, str(path), "other", ["i"])


def test_hdf5_contiguous_and_written_by_tasks(spark, tmp_path):
    values = np.random.default_rng(6).normal(size=(5, 4, 3))
    path = str(tmp_path / "deep" / "w.h5")
    hdf5.write_hdf5(cells_of(spark, values, list("tzx")), path, "data", list("tzx"), values.shape)
    assert os.listdir(tmp_path / "deep") == ["w.h5"] and os.path.getsize(path) == 2048 + 8 * 60
    assert np.array_equal(array_of(hdf5.read_hdf5(spark, path, "data", list("tzx")), values.shape), values)
    (tmp_path / "cut.h5").write_bytes(open(path, "rb").read()[:-20])
    with pytest.raises(Exception, match="shorter"):
        hdf5.read_hdf5(spark, str(tmp_path / "cut.h5"), "data", list("tzx")).count()
    (tmp_path / "no.h5").write_bytes(b"\0" * 5000)
    with pytest.raises(ValueError, match="not an HDF5 file"):
        hdf5.read_hdf5(spark, str(tmp_path / "no.h5"), "data", list("tzx"))


def envelope(v):
    f = np.fft.fft(v)
    h = np.zeros(len(v))
    h[0] = 1
    h[1 : (len(v) + 1) // 2] = 2
    if len(v) % 2 == 0:
        h[len(v) // 2] = 1
    return np.abs(np.fft.ifft(f * h))


@pytest.mark.parametrize("kind", ["npy", "h5", "mat"])
@pytest.mark.parametrize("names", ["xz", "yz", "xyz"])
def test_hydrophone_scans(spark, tmp_path, kind, names):
    rng = np.random.default_rng(11)
    axes = {n: (np.arange(s) * 0.2 - 0.4).tolist() for n, s in zip(names, (3, 4, 2))}
    sizes = [len(axes[n]) for n in names]
    stops, order = [], []
    for z in range(sizes[-1]):
        plane = [(x,) for x in range(sizes[0])] if len(sizes) == 2 else [(x, y) for y in range(sizes[1]) for x in (range(sizes[0]) if y % 2 == 0 else reversed(range(sizes[0])))]
        order += [(*p, z) for p in (plane if z % 2 == 0 else plane[::-1])]
    stops = rng.normal(size=(len(order), 10))
    path = f"{tmp_path}/stops.{kind}"
    cells = cells_of(spark, stops, ["stop", "t"])
    if kind == "npy":
        npy.write_npy(cells, path, ["stop", "t"], stops.shape)
    elif kind == "h5":
        hdf5.write_hdf5(cells, path, "data", ["stop", "t"], stops.shape)
    else:
        mat.write_mat(cells, path, "data", ["stop", "t"], stops.shape)
    got = {tuple(r[: len(names) + 1]): r.value for r in experiment.hydrophone_scan(experiment.read_file(spark, path, ["stop", "t"]), **axes).collect()}
    want = {(*(axes[n][i] for n, i in zip(names, at)), t): v for at, series in zip(order, stops) for t, v in enumerate(envelope(series))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    with pytest.raises(Exception, match="no stop"):
        experiment.hydrophone_scan(experiment.read_file(spark, path, ["stop", "t"]), **(axes | {"z": axes["z"][:-1]})).collect()


def test_paths_without_scheme_lie_on_the_default_file_system(spark, tmp_path):
    assert arrays.located(spark, str(tmp_path / "a b")) == f"file://{tmp_path}/a b"


def test_interfile_by_hand_and_other_endings(spark, tmp_path):
    values = np.random.default_rng(4).normal(size=(2, 3, 4)).astype("<f4")
    (tmp_path / "f.img").write_bytes(values.tobytes())
    text = "!INTERFILE :=\n!name of date file := /elsewhere/f.img\n!imagedata byte order := LITTLEENDIAN\n!matrix size [1] := 4\n!matrix size [2] := 3\n!matrix size [3] := 2\n!number format := short float\ndata rescale slope := 2\ndata rescale offset := -1\n"
    (tmp_path / "f.hdr").write_text(text)
    got = experiment.read_file(spark, f"{tmp_path}/f.hdr", ["t", "z", "x"])
    assert np.allclose(array_of(got, values.shape), values.astype(float) * 2 - 1)
    for name in ("a.txt", "noending"):
        with pytest.raises(ValueError, match="files are"):
            experiment.read_file(spark, f"{tmp_path}/{name}", ["t"])
        with pytest.raises(ValueError, match="files are"):
            experiment.write_file(got, f"{tmp_path}/{name}", ["t", "z", "x"], values.shape)


def test_listmode_by_hand(spark, tmp_path):
    from sonolume.sources import binary

    rng = np.random.default_rng(7)
    events = [(bytes(rng.integers(0, 256, 24, dtype=np.uint8)), int(rng.integers(-20, 21)), rng.normal(size=6).astype("<f4")) for _ in range(9)]
    os.mkdir(tmp_path / "data")
    for k in range(3):  # several files count as one behind the other
        (tmp_path / "data" / f"part-{k}.bin").write_bytes(b"".join(c + struct.pack("b", a) + v.tobytes() for c, a, v in events[3 * k : 3 * k + 3]))
    (tmp_path / "data" / "_hidden").write_bytes(b"123")
    (tmp_path / "header").write_text("Number of events: 9\nNumber of acquisitions per event: 6\n")
    got = binary.read_listmode(spark, f"{tmp_path}/data", f"{tmp_path}/header").collect()
    assert {(r.n, r.code, r.angle, r.t, r.y) for r in got} == {(n, c.hex(), a, t, float(y)) for n, (c, a, v) in enumerate(events) for t, y in enumerate(v)}
    assert binary.records(spark, f"{tmp_path}/data", 49, task=60).rdd.getNumPartitions() == 9
    (tmp_path / "data" / "part-1.bin").write_bytes(b"x" * 50)
    with pytest.raises(Exception, match="whole records"):
        binary.records(spark, f"{tmp_path}/data", 49).count()
