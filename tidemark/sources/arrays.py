"""Arrays of MAT (level 5) and NPZ files as a Spark data source that reads by slices.

``spark.read.format("array_slices").option("variable", name).load(path)`` gives ``(row, col,
value)``: every entry of a dense array, the stored ones of a sparse one. The driver reads
headers only; each slice of ``sliceEntries`` entries (default 4,194,304) is a partition that
seeks to its bytes, so one large file is read by many tasks in bounded memory. Within a
compressed variable there is no seeking: a slice then inflates what lies before it, in
pieces, and keeps only its own entries. Paths are those that every executor can open,
with a scheme that Arrow's file systems know (``file:``, ``hdfs:``, ``s3:``) or none.

Defined cases: vectors of NPZ have column 0; an empty array gives no rows; whole numbers
beyond 2^53 are rounded to doubles; complex, text, cell and structure variables, arrays of
more than two dimensions, unknown names and other files raise ``ValueError``.
"""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .readers import from_coordinates, symmetric

PIECE = 1 << 20
SLICE = 1 << 22
# Fixed values of the format: storage types by number, and the array classes that hold numbers.
STORED = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED, SPARSE, NUMBERS = 14, 15, 5, range(5, 16)


def opened(path: str):
    if "://" in path or path.startswith("file:"):
        system, inner = pyarrow.fs.FileSystem.from_uri(path)
    else:
        system, inner = pyarrow.fs.LocalFileSystem(), path
    return system.open_input_file(inner)


class Plain:
    """Bytes of a file from ``base`` on."""

    def __init__(self, file, base: int):
        self.file, self.base = file, base

    def at(self, position: int, n: int) -> bytes:
        self.file.seek(self.base + position)
        return self.file.read(n)


class Inflated:
    """Bytes of a compressed variable; going back starts it again, going on inflates in pieces."""

    def __init__(self, file, base: int, length: int):
        self.file, self.base, self.length = file, base, length
        self._start()

    def _start(self) -> None:
        self.engine, self.used, self.position = zlib.decompressobj(), 0, 0

    def _next(self, most: int) -> bytes:
        while True:
            feed = self.engine.unconsumed_tail
            if not feed:
                self.file.seek(self.base + self.used)
                feed = self.file.read(min(PIECE, self.length - self.used))
                self.used += len(feed)
            out = self.engine.decompress(feed, most)
            if out or not feed or self.engine.eof:
                self.position += len(out)
                return out

    def at(self, position: int, n: int) -> bytes:
        if position < self.position:
            self._start()
        while self.position < position:
            if not self._next(min(PIECE, position - self.position)):
                return b""
        parts, have = [], 0
        while have < n and (got := self._next(n - have)):
            parts.append(got)
            have += len(got)
        return b"".join(parts)


@dataclass
class Block:
    """Numbers of one storage type: place of the first byte and how many."""

    kind: str
    start: int
    count: int

    def read(self, source: Plain | Inflated, first: int, n: int) -> np.ndarray:
        kind = np.dtype(self.kind)
        n = max(0, min(n, self.count - first))
        raw = source.at(self.start + first * kind.itemsize, n * kind.itemsize) if n else b""
        if len(raw) < n * kind.itemsize:
            raise ValueError("the file ends within an array")
        return np.frombuffer(raw, kind)


@dataclass
class Variable:
    """Where an array lies: ``base`` and ``length`` of its element, and its blocks within it."""

    name: str
    shape: tuple[int, int]
    base: int
    length: int
    packed: bool
    values: Block
    rows: Block | None = None
    starts: Block | None = None

    @property
    def entries(self) -> int:
        return self.values.count


def _tag(source: Plain | Inflated, at: int, order: str) -> tuple[int, int, int, int]:
    """Type, length, place of the data and place of the next element; short elements hold theirs in the tag."""
    raw = source.at(at, 8)
    if len(raw) < 8:
        raise ValueError("the file ends within an element")
    kind, n = struct.unpack(order + "II", raw)
    if kind >> 16:
        return kind & 0xFFFF, kind >> 16, at + 4, at + 8
    return kind, n, at + 8, at + 8 + -(-n // 8) * 8


def _block(source: Plain | Inflated, at: int, order: str) -> tuple[Block, int]:
    kind, n, data, after = _tag(source, at, order)
    if kind not in STORED:
        raise ValueError(f"no numbers of type {kind} are read")
    dtype = np.dtype(order + STORED[kind])
    return Block(dtype.str, data, n // dtype.itemsize), after


def mat_variables(file) -> Iterator[tuple[str, Variable | str]]:
    """Names of the variables with their places, or with the reason why one is not read; headers only."""
    file.seek(0, 2)
    size = file.tell()
    head = Plain(file, 0).at(0, 128)
    mark = head[126:128]
    if mark not in (b"IM", b"MI"):
        raise ValueError("not a MAT file of level 5")
    order, at = "<" if mark == b"IM" else ">", 128
    while at + 8 <= size:
        kind, n, data, after = _tag(Plain(file, 0), at, order)
        packed = kind == COMPRESSED
        source = Inflated(file, data, n) if packed else Plain(file, at)
        # Compressed elements are not padded.
        at, base = (data + n, data) if packed else (after, at)
        kind, _, inner, _ = _tag(source, 0, order)
        if kind != MATRIX:
            continue
        _, _, flags_at, dims_at = _tag(source, inner, order)
        flags = struct.unpack(order + "I", source.at(flags_at, 4))[0]
        dims, name_at = _block(source, dims_at, order)
        shape = tuple(int(d) for d in dims.read(source, 0, dims.count))
        _, length, text, body = _tag(source, name_at, order)
        name = source.at(text, length).decode("latin-1")
        if flags & 0xFF not in NUMBERS or flags & 0x0800 or len(shape) != 2:
            yield name, "no real numbers in two dimensions"
        elif flags & 0xFF == SPARSE:
            rows, body = _block(source, body, order)
            starts, body = _block(source, body, order)
            values, _ = _block(source, body, order)
            # Room for entries may be larger than their number, which the last start gives.
            used = int(starts.read(source, shape[1], 1)[0]) if starts.count > shape[1] else 0
            values.count = min(values.count, used)
            yield name, Variable(name, shape, base, n, packed, values, rows, starts)
        else:
            values, _ = _block(source, body, order)
            yield name, Variable(name, shape, base, n, packed, values)


def find_variable(path: str, name: str) -> Variable:
    with opened(path) as file:
        names = []
        for found, v in mat_variables(file):
            names.append(found)
            if found == name:
                if isinstance(v, str):
                    raise ValueError(f"variable {name!r} has {v}")
                return v
    raise ValueError(f"no variable {name!r}; known: {names}")


def mat_slice(path: str, v: Variable, first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and values of the entries ``first`` to ``last``."""
    with opened(path) as file:
        source = Inflated(file, v.base, v.length) if v.packed else Plain(file, v.base)
        n = last - first
        if v.rows is None:
            for a in range(first, last, PIECE):
                val = v.values.read(source, a, min(PIECE, last - a)).astype(np.float64)
                col, row = np.divmod(np.arange(a, a + len(val), dtype=np.int64), max(v.shape[0], 1))
                yield row, col, val
            return
        rows = v.rows.read(source, first, n).astype(np.int64)
        cols = np.zeros(n, np.int64)
        # An entry's column is the number of columns that end at or before it.
        for a in range(1, v.shape[1] + 1, PIECE):
            ends = v.starts.read(source, a, min(PIECE, v.shape[1] + 1 - a)).astype(np.int64)
            cols += np.searchsorted(ends, np.arange(first, last), side="right")
            if len(ends) and ends[-1] > last:
                break
        yield rows, cols, v.values.read(source, first, n).astype(np.float64)


def _npy(file, name: str) -> tuple[tuple[int, ...], bool, np.dtype, int, str]:
    """Shape, order, type, place of the data within the member, and the member."""
    with zipfile.ZipFile(file) as z:
        member = f"{name}.npy"
        if member not in z.namelist():
            raise ValueError(f"no variable {name!r}; known: {[m.removesuffix('.npy') for m in z.namelist()]}")
        with z.open(member) as f:
            version = np.lib.format.read_magic(f)
            shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
            if dtype.kind not in "biuf" or len(shape) not in (1, 2):
                raise ValueError(f"variable {name!r} has no real numbers in one or two dimensions")
            return shape, fortran, dtype, f.tell(), member


def npz_slice(path: str, name: str, first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    with opened(path) as file:
        shape, fortran, dtype, start, member = _npy(file, name)
        wide = shape[1] if len(shape) == 2 else 1
        with zipfile.ZipFile(file) as z, z.open(member) as f:
            f.seek(start + first * dtype.itemsize)
            for a in range(first, last, PIECE):
                n = min(PIECE, last - a)
                raw = f.read(n * dtype.itemsize)
                if len(raw) < n * dtype.itemsize:
                    raise ValueError("the file ends within an array")
                place = np.arange(a, a + n, dtype=np.int64)
                (col, row) = np.divmod(place, shape[0]) if fortran else np.divmod(place, wide)[::-1]
                yield row, col, np.frombuffer(raw, dtype).astype(np.float64)


def array_shape(path: str, name: str) -> tuple[int, int, int]:
    """Rows, columns and stored entries, from headers."""
    with opened(path) as file:
        if file.read(2) == b"PK":
            file.seek(0)
            shape = _npy(file, name)[0]
            return shape[0], shape[1] if len(shape) == 2 else 1, int(np.prod(shape))
    v = find_variable(path, name)
    return *v.shape, v.entries


@dataclass
class Slice(InputPartition):
    first: int
    last: int


class SliceReader(DataSourceReader):
    def __init__(self, path: str, name: str, most: int):
        self.path, self.name, self.most = path, name, most
        with opened(path) as file:
            self.packed_zip = file.read(2) == b"PK"
        self.variable = None if self.packed_zip else find_variable(path, name)
        self.entries = array_shape(path, name)[2] if self.packed_zip else self.variable.entries

    def partitions(self) -> list[Slice]:
        return [Slice(a, min(a + self.most, self.entries)) for a in range(0, self.entries, self.most)] or [Slice(0, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        parts = npz_slice(self.path, self.name, partition.first, partition.last) if self.packed_zip else mat_slice(self.path, self.variable, partition.first, partition.last)
        for row, col, value in parts:
            for a in range(0, len(value), 65536):
                cut = slice(a, a + 65536)
                yield pa.RecordBatch.from_arrays([pa.array(row[cut]), pa.array(col[cut]), pa.array(value[cut])], ["row", "col", "value"])


class ArraySlices(DataSource):
    """Options: ``path`` (or load's argument), ``variable``, ``sliceEntries``."""

    @classmethod
    def name(cls) -> str:
        return "array_slices"

    def schema(self) -> str:
        return "row long, col long, value double"

    def reader(self, schema) -> SliceReader:
        most = int(self.options.get("sliceEntries", SLICE))
        if most < 1 or not self.options.get("path") or not self.options.get("variable"):
            raise ValueError("a path, a variable and a positive sliceEntries are needed")
        return SliceReader(self.options["path"], self.options["variable"], most)


def read_array(spark: SparkSession, path: str, variable: str, slice_entries: int = SLICE) -> DataFrame:
    """``(row, col, value)`` of one variable of a MAT or NPZ file."""
    spark.dataSource.register(ArraySlices)
    return spark.read.format("array_slices").option("variable", variable).option("sliceEntries", str(slice_entries)).load(path)


def read_mat_graph(spark: SparkSession, path: str, relations: tuple[str, ...] = ("homo",), features: str = "features", label: str = "label", slice_entries: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(node_id, x, y)`` and both directions of the relations' edges, each once and without loops.

    Nodes are those with a label, whichever way the label vector lies; a node without stored
    features has zeros.
    """
    read = lambda v: read_array(spark, path, v, slice_entries)
    width = array_shape(path, features)[1]
    at: Column = F.col("row") + F.col("col")
    y = read(label).select(at.alias("node_id"), F.col("value").cast("int").alias("y"))
    zeros = F.array_repeat(F.lit(0.0), width)
    nodes = y.join(from_coordinates(read(features), width), "node_id", "left").select("node_id", F.coalesce("x", zeros).alias("x"), "y")
    edges = None
    for r in relations:
        part = read(r).where("value <> 0").select(F.col("row").alias("src"), F.col("col").alias("dst"))
        edges = part if edges is None else edges.unionByName(part)
    if edges is None:
        raise ValueError("at least one relation is needed")
    return nodes, symmetric(edges)
