"""Arrays read by slices: files written here byte by byte, plain and compressed, against numpy."""

import struct
import zlib

import numpy as np
import pytest

from tidemark.sources.arrays import array_shape, find_variable, mat_slice, read_array, read_mat_graph

KINDS = {"i1": 1, "u1": 2, "i2": 3, "u2": 4, "i4": 5, "u4": 6, "f4": 7, "f8": 9, "i8": 12, "u8": 13}


def element(order, kind, data, short=True):
    if short and len(data) <= 4 and data:
        word = len(data) << 16 | kind
        return struct.pack(order + "I", word) + data.ljust(4, b"\0")
    return struct.pack(order + "II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def numbers(order, a, kind):
    return element(order, KINDS[kind], np.asarray(a).astype(order + kind).tobytes())


def variable(order, name, a, kind="f8", sparse=False, spare=0, cls=6, packed=False):
    a = np.asarray(a)
    body = element(order, 6, struct.pack(order + "II", 5 if sparse else cls, 0)) + numbers(order, a.shape, "i4") + element(order, 1, name.encode())
    if sparse:
        col, row = np.nonzero(a.T)
        starts = np.concatenate([[0], np.cumsum(np.bincount(col, minlength=a.shape[1]))])
        body += numbers(order, np.append(row, [0] * spare), "i4") + numbers(order, starts, "i4") + numbers(order, np.append(a[row, col], [9] * spare), kind)
    else:
        body += numbers(order, a.T.ravel(), kind)
    out = element(order, 14, body, short=False)
    if packed:
        z = zlib.compress(out)
        return struct.pack(order + "II", 15, len(z)) + z
    return out


def write_mat(path, order, *variables):
    head = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack(order + "H", 0x0100) + (b"IM" if order == "<" else b"MI")
    path.write_bytes(head + b"".join(variables))
    return str(path)


def matrix(df, shape):
    out, seen = np.zeros(shape), set()
    for r in df.collect():
        assert (r.row, r.col) not in seen
        seen.add((r.row, r.col))
        out[r.row, r.col] = r.value
    return out, len(seen)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("packed", [False, True])
def test_mat_by_slices(spark, tmp_path, order, packed):
    rng = np.random.default_rng(2)
    dense = rng.integers(-100, 100, (23, 7)).astype(float)
    links = (rng.random((19, 31)) < 0.1) * rng.normal(0, 1, (19, 31))
    links[:, [0, 5, 6, 30]] = 0
    file = write_mat(tmp_path / "a.mat", order, variable(order, "d", dense, "i1", packed=packed), variable(order, "text", [[65.0]], cls=4, packed=packed), variable(order, "s", links, sparse=True, spare=3, packed=packed), variable(order, "one", [[3.0]], "u1"))
    for name, want in (("d", dense), ("s", links), ("one", np.array([[3.0]]))):
        entries = want.size if name != "s" else np.count_nonzero(want)
        assert array_shape(file, name) == (*want.shape, entries)
        for size in (1 if name == "one" else 7, 1000):
            v, got = find_variable(file, name), np.zeros(want.shape)
            for first in range(0, entries, size):
                for row, col, value in mat_slice(file, v, first, min(first + size, entries)):
                    got[row, col] += value
            assert np.array_equal(got, want), (name, size)
    df = read_array(spark, file, "s", 13)
    assert df.rdd.getNumPartitions() == -(-np.count_nonzero(links) // 13) > 2
    got, n = matrix(df, links.shape)
    assert np.array_equal(got, links) and n == np.count_nonzero(links)
    with pytest.raises(ValueError):
        find_variable(file, "text")
    with pytest.raises(ValueError):
        find_variable(file, "none")


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_npz_by_slices(spark, tmp_path, save):
    x, y = np.arange(60, dtype=np.float32).reshape(12, 5), np.arange(12)
    path = str(tmp_path / "a.npz")
    save(path, x=x, f=np.asfortranarray(x), y=y, none=np.zeros((0, 3)))
    for name in ("x", "f"):
        df = read_array(spark, path, name, 8)
        assert df.rdd.getNumPartitions() == 8
        got, n = matrix(df, x.shape)
        assert np.array_equal(got, x) and n == 60
    assert [r.value for r in read_array(spark, f"file://{path}", "y").orderBy("row").collect()] == y.tolist()
    assert read_array(spark, path, "none").count() == 0


def test_graph_of_a_mat_file(spark, tmp_path):
    a = np.zeros((6, 6))
    a[0, 1] = a[1, 0] = a[2, 4] = a[3, 3] = 1
    b = np.zeros((6, 6))
    b[5, 2] = b[0, 1] = 1
    x = np.array([[1, 0], [0, 2], [0, 0], [3, 4], [0, 5], [6, 0]], float)
    file = write_mat(tmp_path / "g.mat", "<", variable("<", "features", x, sparse=True), variable("<", "label", [[0, 1, 0, 0, 1, 0]], "u1"), variable("<", "homo", a, sparse=True, packed=True), variable("<", "net", b, "u1", sparse=True))
    nodes, edges = read_mat_graph(spark, file, ("homo", "net"), slice_entries=2)
    rows = {r.node_id: r for r in nodes.collect()}
    assert [rows[i].x for i in range(6)] == x.tolist() and [rows[i].y for i in range(6)] == [0, 1, 0, 0, 1, 0]
    assert {tuple(r) for r in edges.collect()} == {(0, 1), (1, 0), (2, 4), (4, 2), (5, 2), (2, 5)}


def test_other_files_and_cut_files(spark, tmp_path):
    (tmp_path / "b.mat").write_bytes(b"x" * 300)
    with pytest.raises(ValueError):
        find_variable(str(tmp_path / "b.mat"), "d")
    whole = write_mat(tmp_path / "c.mat", "<", variable("<", "d", np.ones((50, 4))))
    short = tmp_path / "d.mat"
    short.write_bytes(open(whole, "rb").read()[:-64])
    v = find_variable(whole, "d")
    with pytest.raises(ValueError):
        list(mat_slice(str(short), v, 0, 200))
