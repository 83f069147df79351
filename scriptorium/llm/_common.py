"""What the operators share: scratch tables, row helpers and byte-level text kernels."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; if unset, a temporary one on one machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if not found and context.getCheckpointDir().isDefined():
        found = context.getCheckpointDir().get()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver ends."""
    root = f"{shared_folder(spark)}/scriptorium-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS[root] = spark
        atexit.register(_drop, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _drop(root: str) -> None:
    """Deletes a scratch root, if Spark still runs."""
    with contextlib.suppress(Exception):
        context = _ROOTS.pop(root).sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: no lineage, and safe when executors go."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key with a share of 1 / OFTEN of the rows or more is joined by a broadcast; there are OFTEN such keys at most.
OFTEN = 10_000


def joined_by_share(rows: DataFrame, keyed: DataFrame, key: str, weight: str, total: int, often: int | None = None) -> DataFrame:
    """rows and keyed joined on key; keyed has a row for each key, and in weight how many of the total rows have it.

    No key of the shuffled join has a larger share of the rows than 1 / OFTEN. rows and keyed are read twice.
    """
    many = F.col(weight) * (OFTEN if often is None else often) >= total
    tagged = rows.join(F.broadcast(keyed.where(many)), key, "left")
    rest = tagged.where(F.col(weight).isNull()).select(rows.columns).join(keyed.where(~many), key)
    return tagged.where(F.col(weight).isNotNull()).unionByName(rest)


def fold(key: Column | str, parts: int) -> Column:
    """crc32 of a key written as text, modulo parts; null for a null key."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % parts


def byte_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


#: 1 for the six bytes that separate words: tab, line feed, vertical tab, form feed, carriage return, space.
SPACE = np.zeros(256, np.uint8)
SPACE[[9, 10, 11, 12, 13, 32]] = 1


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    gap = np.ones(len(data) + 2, np.int8)
    gap[1:-1] = SPACE[data]
    step = np.diff(gap)
    return np.flatnonzero(step == -1), np.flatnonzero(step == 1)


def code_points(data: np.ndarray) -> np.ndarray:
    """For each byte offset from 0 to len(data): the number of code points that begin before it."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


#: A megabyte.
SIEVE_BITS = 1 << 23


class Sieve:
    """A Bloom filter of a fixed number of bits, however many keys it holds.

    It only spares work: what it lets through by chance goes when the rows are joined with the keys. With more
    keys than it has bits for it lets ever more through and spares less.
    """

    def __init__(self, words: np.ndarray):
        self.words = words
        self.raw = words.astype("<u8").tobytes()
        self.most = 64 * len(words) - 1

    @classmethod
    def of(cls, keys: DataFrame, key: str, bits: int = SIEVE_BITS) -> Sieve:
        """The sieve of a bigint column of hashes; the driver gets bits / 64 rows at most."""
        places = F.explode(F.array(F.col(key).bitwiseAND(bits - 1), F.shiftrightunsigned(key, 32).bitwiseAND(bits - 1)))
        rows = keys.select(places.alias("at")).groupBy(F.expr("at >> 6").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("bits")).toArrow()
        words = np.zeros(bits // 64, np.int64)
        words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
        return cls(words.view(np.uint64))

    def __contains__(self, key: int) -> bool:
        a, b = key & self.most, (key >> 32) & self.most
        return bool(self.raw[a >> 3] >> (a & 7) & self.raw[b >> 3] >> (b & 7) & 1)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Whether each of an array of unsigned hashes is let through."""
        out = np.ones(len(keys), bool)
        for at in (keys & np.uint64(self.most), keys >> np.uint64(32) & np.uint64(self.most)):
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def text_hash(text: str) -> int:
    """Spark's xxhash64 of a text, unsigned."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), 42)


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
