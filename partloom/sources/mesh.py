"""Data sources for binary files of part geometry: `.npy` clouds and binary `.stl` meshes, read by ranges of a file."""

from __future__ import annotations

import os
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

ROWS = 65_536  # of one batch
TRIANGLE = np.dtype([("n", "<f4", 3), ("p", "<f4", (3, 3)), ("attribute", "<u2")])  # 50 bytes
STL_HEAD = 84  # bytes: a free header and the number of triangles


def _filesystem(path: str):
    """(file system, path in it): any store that Arrow reaches by its URI; a bare path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))


def _files(path: str, suffix: str) -> list[tuple[str, int]]:
    """Files and sizes under a path, or the file it names, in the order of their names."""
    from pyarrow import fs

    store, root = _filesystem(path)
    info = store.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
    scheme = path[: path.index("://") + 3] if "://" in path and not path.startswith("file://") else ""
    return sorted((scheme + f.path if scheme else f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix))


def _stem(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


class Range(InputPartition):
    """Rows `first` to `first + n` of a file."""

    def __init__(self, path: str, first: int, n: int, layout: tuple = ()):
        super().__init__((path, first, n))
        self.path, self.first, self.n, self.layout = path, first, n, layout


class RangedReader(DataSourceReader):
    """A file is cut into ranges of about `bytesPerPartition` bytes (64 MB by default); only headers are read for that. The
    columns of the schema that was asked for are made, no others."""

    suffix = ""

    def __init__(self, schema: StructType, options: dict):
        self.columns = schema.fieldNames()
        self.path = options["path"]
        self.most = int(options.get("bytesPerPartition", options.get("bytesperpartition", 64 << 20)))

    def head(self, file, path: str, size: int) -> tuple[int, int, tuple]:
        """(rows, bytes of a row, layout) of an open file; raises on a file that is none of its kind."""
        raise NotImplementedError

    def partitions(self):
        store, _ = _filesystem(self.path)
        out = []
        for path, size in _files(self.path, self.suffix):
            with store.open_input_file(_filesystem(path)[1]) as f:
                rows, width, layout = self.head(f, path, size)
            step = max(1, self.most // width)
            out += [Range(path, a, min(step, rows - a), layout) for a in range(0, rows, step)]
        return out or [Range("", 0, 0)]

    def columns_of(self, file, part: Range, first: int, n: int) -> dict:
        raise NotImplementedError

    def read(self, partition):
        if not partition.n:
            return
        store, path = _filesystem(partition.path)
        with store.open_input_file(path) as f:
            for a in range(partition.first, partition.first + partition.n, ROWS):
                n = min(ROWS, partition.first + partition.n - a)
                made = self.columns_of(f, partition, a, n)
                yield pa.RecordBatch.from_arrays([made[c]() for c in self.columns], names=self.columns)


class CloudReader(RangedReader):
    suffix = ".npy"

    def head(self, file, path, size):
        version = np.lib.format.read_magic(file)
        shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
        if len(shape) != 2 or shape[1] != 3 or kind.hasobject:
            raise ValueError(f"{path}: {shape} of {kind} is no cloud")
        if size < file.tell() + shape[0] * 3 * kind.itemsize:
            raise ValueError(f"{path}: shorter than its {shape[0]} points")
        return shape[0], 3 * kind.itemsize, (file.tell(), kind.str, fortran, shape[0])

    def columns_of(self, file, part, first, n):
        begin, kind, fortran, rows = part.layout
        width = np.dtype(kind).itemsize
        if fortran:
            xyz = {c: np.frombuffer(file.read_at(n * width, begin + (i * rows + first) * width), kind) for i, c in enumerate("xyz") if c in self.columns}
        else:
            block = np.frombuffer(file.read_at(3 * n * width, begin + 3 * first * width), kind).reshape(n, 3)
            xyz = {c: block[:, i] for i, c in enumerate("xyz")}
        out = {c: (lambda v=v: pa.array(v.astype(np.float64))) for c, v in xyz.items()}
        return out | {"cloud": lambda: pa.array([_stem(part.path)] * n), "pid": lambda: pa.array(np.arange(first, first + n))}


class MeshReader(RangedReader):
    suffix = ".stl"

    def head(self, file, path, size):
        raw = file.read(STL_HEAD)
        n = struct.unpack("<I", raw[80:84])[0] if len(raw) == STL_HEAD else 0
        if size != STL_HEAD + n * TRIANGLE.itemsize:
            raise ValueError(f"{path}: no binary mesh")
        if not n:
            raise ValueError(f"{path}: a mesh without triangles")
        return n, TRIANGLE.itemsize, ()

    def columns_of(self, file, part, first, n):
        t = np.frombuffer(file.read_at(n * TRIANGLE.itemsize, STL_HEAD + first * TRIANGLE.itemsize), TRIANGLE)
        point = lambda k: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(t["p"][:, k], np.float64).reshape(-1)), 3).cast(pa.list_(pa.float64()))
        out = {f"p{k + 1}": (lambda k=k: point(k)) for k in range(3)} | {f"n{c}": (lambda i=i: pa.array(t["n"][:, i].astype(np.float64))) for i, c in enumerate("xyz")}
        return out | {"mesh": lambda: pa.array([_stem(part.path)] * n), "tri_id": lambda: pa.array(np.arange(first, first + n))}


class Clouds(DataSource):
    """`spark.read.format("npy_cloud").load(path)`: rows of (N, 3) arrays of any number type and either memory order. A
    schema with some of the columns reads these only."""

    @classmethod
    def name(cls):
        return "npy_cloud"

    def schema(self):
        return "cloud string, pid long, x double, y double, z double"

    def reader(self, schema):
        return CloudReader(schema, self.options)


class Meshes(DataSource):
    """`spark.read.format("stl_mesh").load(path)`: triangles of binary meshes with their normals, in the order of the file."""

    @classmethod
    def name(cls):
        return "stl_mesh"

    def schema(self):
        return "mesh string, tri_id long, p1 array<double>, p2 array<double>, p3 array<double>, nx double, ny double, nz double"

    def reader(self, schema):
        return MeshReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make both formats known to the session."""
    spark.dataSource.register(Clouds)
    spark.dataSource.register(Meshes)
