"""Matrices in binary files as a data source: rows of fixed width, read in ranges of bytes.

Every vector, id and graph file is rows of one width after a header that the driver reads, so one reader serves all. A
file of any size is read by as many tasks as it has ranges, and a lost task reads its range again. Paths are what
pyarrow's file systems open: local or mounted ones, and URIs of object stores.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range that one task reads, and rows that it hands on at once.
RANGE_BYTES, BATCH_ROWS = 64 << 20, 4096
#: Spark's type of an element and Arrow's by numpy's.
ELEMENTS = {"<f4": ("float", pa.float32()), "<f8": ("double", pa.float64()), "<u4": ("bigint", pa.int64()), "<i4": ("int", pa.int32()), "|u1": ("smallint", pa.int16())}


@dataclass(frozen=True)
class Segment:
    """rows rows of dim elements from offset on, each after skip bytes; numbered from first, in part part."""

    path: str
    offset: int
    rows: int
    dim: int
    kind: str
    skip: int = 0
    first: int = 0
    part: int = 0

    @property
    def stride(self) -> int:
        return self.skip + self.dim * np.dtype(self.kind).itemsize


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def file_size(path: str) -> int:
    """Bytes of a file; -1 if there is none."""
    system, name = file_system(path)
    found = system.get_file_info(name)
    return found.size if found.type == fs.FileType.File else -1


def file_bytes(path: str, offset: int, size: int) -> bytes:
    system, name = file_system(path)
    with system.open_input_file(name) as f:
        f.seek(offset)
        return f.read(size)


def listed(path: str, suffix: str) -> list[str]:
    """A file itself, or the files of a folder with a suffix in order of their names."""
    system, name = file_system(path)
    if system.get_file_info(name).type == fs.FileType.File:
        return [path]
    found = sorted(x.path for x in system.get_file_info(fs.FileSelector(name)) if x.type == fs.FileType.File and x.path.endswith(f".{suffix}"))
    if not found:
        raise FileNotFoundError(f"no .{suffix} files in {path}")
    head = path[: -len(name)] if path.endswith(name) else ""
    return [f"{head}{x}" for x in found]


@dataclass
class Range(InputPartition):
    segment: Segment
    start: int
    rows: int


class MatrixReader(DataSourceReader):
    def __init__(self, segments: list[Segment]):
        self.segments = segments

    def partitions(self) -> list[Range]:
        out = []
        for segment in self.segments:
            step = max(1, RANGE_BYTES // max(1, segment.stride))
            out += [Range(segment, at, min(step, segment.rows - at)) for at in range(0, segment.rows, step)]
        return out or [Range(None, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        segment = partition.segment
        if segment is None:
            return
        arrow, kind = ELEMENTS[segment.kind][1], np.dtype(segment.kind)
        system, name = file_system(segment.path)
        with system.open_input_file(name) as f:
            f.seek(segment.offset + partition.start * segment.stride)
            for at in range(partition.start, partition.start + partition.rows, BATCH_ROWS):
                rows = min(BATCH_ROWS, partition.start + partition.rows - at)
                raw = f.read(rows * segment.stride)
                if len(raw) != rows * segment.stride:
                    raise ValueError(f"{segment.path} ends before row {at + rows}")
                table = np.frombuffer(raw, np.uint8).reshape(rows, segment.stride)
                if segment.skip and (np.ascontiguousarray(table[:, :4]).view("<u4") != segment.dim).any():
                    raise ValueError(f"{segment.path} has rows of different length")
                flat = np.ascontiguousarray(table[:, segment.skip :]).view(kind).reshape(-1)
                vec = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * segment.dim), pa.array(flat.astype(arrow.to_pandas_dtype(), copy=False)))
                numbers = pa.array(np.arange(segment.first + at, segment.first + at + rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, segment.part)), numbers, vec], names=["part", "id", "vec"])


class MatrixSource(DataSource):
    """Rows (part, id, vec) of segments, given as JSON."""

    @classmethod
    def name(cls) -> str:
        return "vecspark_matrices"

    def _segments(self) -> list[Segment]:
        return [Segment(**x) for x in json.loads(self.options["segments"])]

    def schema(self) -> str:
        return f"part bigint, id bigint, vec array<{ELEMENTS[self.options['kind']][0]}>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self._segments())


def read_segments(spark: SparkSession, segments: list[Segment], kind: str) -> DataFrame:
    """(part, id, vec) of all segments, which have one kind of elements."""
    if any(s.kind != kind for s in segments):
        raise ValueError("files of different types")
    spark.dataSource.register(MatrixSource)
    said = json.dumps([asdict(s) for s in segments])
    return spark.read.format(MatrixSource.name()).option("segments", said).option("kind", kind).load()


def posix(path: str) -> str:
    """A path that files can be written to at any place."""
    system, name = file_system(path)
    if not isinstance(system, fs.LocalFileSystem):
        raise ValueError(f"{path}: files are written on local or mounted file systems")
    return name


def create(path: str, head: bytes, size: int, tail: bytes = b"") -> None:
    """A file of a size with its first and last bytes; its rows are written afterwards."""
    from pathlib import Path

    target = Path(posix(path))
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.open("wb") as f:
        f.write(head)
        f.truncate(size)
        if tail:
            f.seek(size - len(tail))
            f.write(tail)


def write_rows(rows: DataFrame, files: dict[int, tuple[str, int, int]], kind: str, lead: bytes = b"") -> None:
    """Write rows(part, pos, vec) into created files: that of a part at offset + pos * stride; files has (path, offset,
    stride) by part, and lead stands before every row.

    Tasks write disjoint places, so a row that a lost task wrote is written again with the same bytes.
    """
    files = {part: (posix(path), offset, stride) for part, (path, offset, stride) in files.items()}

    def put(batches):
        for batch in batches:
            part, pos = batch.column("part").to_numpy(), batch.column("pos").to_numpy()
            vec = batch.column("vec")
            flat = vec.flatten().to_numpy(zero_copy_only=False).astype(kind)
            for p in np.unique(part):
                at = np.flatnonzero(part == p)
                path, offset, stride = files[int(p)]
                width = (stride - len(lead)) // np.dtype(kind).itemsize
                matrix = flat.reshape(len(part), width)[at]
                order = np.argsort(pos[at], kind="stable")
                own, matrix = pos[at][order], matrix[order]
                starts = np.flatnonzero(np.append(True, np.diff(own) != 1))
                with open(path, "r+b") as f:
                    for a, b in zip(starts, [*starts[1:], len(own)], strict=True):
                        f.seek(offset + int(own[a]) * stride)
                        if lead:
                            f.write(b"".join(lead + row.tobytes() for row in matrix[a:b]))
                        else:
                            f.write(matrix[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    rows.select("part", "pos", "vec").mapInArrow(put, "n long").agg({"n": "sum"}).collect()
