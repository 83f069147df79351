"""Vector matrices as a Spark data source: two little-endian integers, rows and columns, and the numbers row by row.

A folder holds one matrix a task and a manifest, which the driver writes last: a list of the parts of one
write, in order, with the pos of their rows beside them. A reader sees the parts of a manifest only, so a
write that fails or is lost leaves nothing to be read, and the parts of one that it replaces go after it.
Paths go through Arrow's file systems, which know local, HDFS, S3 and GCS paths.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MANIFEST = "_matrix.json"
SCHEMA = "pos bigint, v array<float>"
#: Rows that a reader hands on at a time.
ROWS = 4096


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def header(body) -> tuple[int, int]:
    """Rows and columns at the head of a matrix."""
    first = body.read(8)
    if len(first) < 8:
        raise ValueError("a matrix has a header of eight bytes")
    n, width = struct.unpack("<ii", first)
    if n < 0 or width < 0:
        raise ValueError("the matrix's header has a negative number")
    return n, width


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int
    width: int


class MatrixWriter(DataSourceArrowWriter):
    """A task writes its rows to a part of its own; commit() checks the widths and writes the manifest."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{self.run}"
        files, folder = _at(self.path)
        files.create_dir(folder, recursive=True)
        rows, width = 0, None
        keys: list[np.ndarray] = []
        with files.open_output_stream(f"{folder}/{name}.body") as out:
            for batch in iterator:
                vectors = batch.column("v")
                sizes = set(vectors.value_lengths().to_pylist())
                if vectors.null_count or vectors.flatten().null_count or batch.column("pos").null_count:
                    raise ValueError("a matrix holds no nulls")
                if len(sizes | ({width} if width is not None else set())) > 1:
                    raise ValueError("vectors must be of one length")
                width = sizes.pop() if sizes else width
                out.write(np.asarray(vectors.flatten(), "<f4").tobytes())
                keys.append(batch.column("pos").to_numpy().astype("<i8"))
                rows += batch.num_rows
        if rows:  # the header comes first, and is known last
            with files.open_output_stream(f"{folder}/{name}.bin") as out, files.open_input_stream(f"{folder}/{name}.body") as body:
                out.write(struct.pack("<ii", rows, width))
                while chunk := body.read(1 << 22):
                    out.write(chunk)
            with files.open_output_stream(f"{folder}/{name}.pos") as out:
                out.write(np.concatenate(keys).tobytes())
        files.delete_file(f"{folder}/{name}.body")
        return Part(name, rows, width or 0)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.name)
        if len({m.width for m in parts}) > 1:
            self.abort(messages)
            raise ValueError("vectors must be of one length")
        files, folder = _at(self.path)
        files.create_dir(folder, recursive=True)
        before = _manifest(files, folder)
        if not self.overwrite and before:
            parts = [Part(**m) for m in before] + parts
        with files.open_output_stream(f"{folder}/{MANIFEST}.{self.run}") as out:
            out.write(json.dumps([{"name": m.name, "rows": m.rows, "width": m.width} for m in parts]).encode())
        files.move(f"{folder}/{MANIFEST}.{self.run}", f"{folder}/{MANIFEST}")
        if self.overwrite:
            _drop(files, folder, [m["name"] for m in before or []])

    def abort(self, messages: list[Part | None]) -> None:
        files, folder = _at(self.path)
        _drop(files, folder, [m.name for m in messages if m is not None and m.rows])


def _manifest(files: pafs.FileSystem, folder: str) -> list[dict] | None:
    if files.get_file_info(f"{folder}/{MANIFEST}").type == pafs.FileType.NotFound:
        return None
    with files.open_input_stream(f"{folder}/{MANIFEST}") as f:
        return json.loads(f.read())


def _drop(files: pafs.FileSystem, folder: str, names: list[str]) -> None:
    for name in names:
        for end in ("bin", "pos"):
            if files.get_file_info(f"{folder}/{name}.{end}").type != pafs.FileType.NotFound:
                files.delete_file(f"{folder}/{name}.{end}")


@dataclass
class Piece(InputPartition):
    matrix: str
    keys: str | None


class MatrixReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Piece]:
        files, at = _at(self.path)
        kind = files.get_file_info(at).type
        if kind == pafs.FileType.File:
            return [Piece(self.path, None)]
        found = _manifest(files, at) if kind == pafs.FileType.Directory else None
        if found is None:
            raise FileNotFoundError(f"{self.path} holds no finished matrix")
        return [Piece(f"{self.path}/{m['name']}.bin", f"{self.path}/{m['name']}.pos") for m in found]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        files, at = _at(partition.matrix)
        with files.open_input_stream(at) as body:
            n, width = header(body)
            if files.get_file_info(at).size != 8 + 4 * n * width:
                raise ValueError("the matrix's header doesn't fit its length")
            keys = None
            if partition.keys:
                files, at = _at(partition.keys)
                keys = files.open_input_stream(at)
            for lo in range(0, n, ROWS):
                m = min(ROWS, n - lo)
                flat = np.frombuffer(body.read(4 * m * width), "<f4")
                pos = np.frombuffer(keys.read(8 * m), "<i8") if keys else np.arange(lo, lo + m, dtype=np.int64)
                edges = pa.array(np.arange(m + 1, dtype=np.int32) * width)
                yield pa.RecordBatch.from_arrays([pa.array(pos), pa.ListArray.from_arrays(edges, pa.array(flat))], names=["pos", "v"])


class MatrixSource(DataSource):
    """spark.read.format("vector_matrix").load(path) and df.write.format("vector_matrix").save(path), of (pos, v)."""

    @classmethod
    def name(cls) -> str:
        return "vector_matrix"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> MatrixWriter:
        if schema.names != ["pos", "v"]:
            raise ValueError("a matrix is written from (pos, v)")
        return MatrixWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MatrixSource)
