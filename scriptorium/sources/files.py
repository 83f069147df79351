"""Files: JSON lines, archived snapshots, vector matrices, artefacts, catalogues of projects."""

from __future__ import annotations

import io
import itertools
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import strip_version, year_month_of_id
from ..functions.text import squash, words
from . import matrix
from .decode import PAPER

SNAPSHOT = T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("abstract", T.StringType()), T.StructField("categories", T.StringType()), T.StructField("authors_parsed", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("versions", T.ArrayType(T.StructType([T.StructField("version", T.StringType()), T.StructField("created", T.StringType())])))])


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """Papers as JSON lines."""
    return spark.read.schema(PAPER).json(path)


def write_papers(papers: DataFrame, path: str) -> None:
    """Replaces a folder of JSON lines; Spark's committer makes the change in one step."""
    papers.write.mode("overwrite").json(path)


def snapshot_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of a snapshot. Of each .zip its first .json entry, unpacked by one task, a thousand lines at a time.

    Archives are read as Spark's binary files, from any file system that it knows; one has two gigabytes at
    most, as packed. An archive without such an entry is an error.
    """
    if not path.endswith(".zip"):
        return spark.read.text(path)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                with zipfile.ZipFile(io.BytesIO(memoryview(body.as_buffer()))) as z:
                    entry = next((n for n in z.namelist() if n.endswith(".json")), None)
                    if entry is None:
                        raise ValueError(f"{name} has no .json entry")
                    with z.open(entry) as f:
                        while held := [x.decode("utf-8", "replace") for x in itertools.islice(f, 1000)]:
                            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(unpack, "value string")


def snapshot_papers(lines: DataFrame) -> DataFrame:
    """Papers of a snapshot's lines(value); lines that aren't JSON are left out."""
    r = lines.select(F.from_json("value", SNAPSHOT).alias("r")).where("r.id is not null").select("r.*")
    created = F.regexp_replace(F.get("versions", F.lit(0))["created"], "^[A-Za-z]+, *", "")
    date = F.coalesce(F.to_date(F.try_to_timestamp(created, F.lit("d MMM yyyy HH:mm:ss z"))), year_month_of_id("id"))
    # last, first, suffix
    author = lambda a: squash(F.concat_ws(" ", F.get(a, F.lit(1)), F.get(a, F.lit(0)), F.get(a, F.lit(2))))
    made = r.select(strip_version("id").alias("id"), squash("title").alias("title"), squash("abstract").alias("abstract"), F.filter(F.transform("authors_parsed", author), lambda x: x != "").alias("authors"), words("categories").alias("categories"), date.alias("published"), F.lit(True).alias("openAccess"))
    return made.where("id <> '' and title <> '' and octet_length(abstract) > 200 and published is not null")


def write_vectors(path: str, rows: np.ndarray) -> None:
    """A small matrix of the driver's as two little-endian integers, rows and columns, and its numbers; tables go by save_vectors()."""
    matrix = np.asarray(rows, "<f4")
    if matrix.ndim != 2:
        raise ValueError("vectors must be of one length")
    with open(path, "wb") as f:
        f.write(struct.pack("<ii", *matrix.shape))
        f.write(matrix.tobytes())


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(pos, v) of matrix files, each read by a task."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("content").to_pylist():
                if len(body) < 8:
                    raise ValueError("a matrix has a header of eight bytes")
                n, width = struct.unpack_from("<ii", body)
                if n < 0 or width < 0 or len(body) != 8 + 4 * n * width:
                    raise ValueError("the matrix's header doesn't fit its length")
                flat = pa.array(np.frombuffer(body, "<f4", offset=8))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width or 1, dtype=np.int32)[: n + 1]), flat)], names=["pos", "v"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "pos bigint, v array<float>")


def save_vectors(vectors: DataFrame, path: str) -> None:
    """vectors(pos, v) as matrix files in a folder, one a task and in order of pos; what was there is replaced at the end."""
    matrix.register(vectors.sparkSession)
    ordered = vectors.select(F.col("pos").cast("bigint").alias("pos"), F.col("v").cast("array<float>").alias("v"))
    ordered.repartitionByRange("pos").sortWithinPartitions("pos").write.format("vector_matrix").mode("overwrite").save(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(pos, v) of a folder that save_vectors() has finished, or of one matrix file, its rows numbered from 0."""
    matrix.register(spark)
    return spark.read.format("vector_matrix").load(path)


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether save() has finished there: its last step leaves a mark."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """What save() has written; null if nothing is finished there."""
    return spark.read.parquet(path) if exists(spark, path) else None


def projects(spark: SparkSession, pattern: str) -> DataFrame:
    """(name, created_at, path) of the projects' meta.json files, newest first."""
    schema = "name string, createdAt timestamp"
    rows = spark.read.schema(schema).option("multiLine", True).json(pattern).select("name", F.col("createdAt").alias("created_at"), F.input_file_name().alias("path"))
    return rows.orderBy(F.desc("created_at"), "name")
