"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of each text; the high bits of the hash depend on the last 32 bytes only,
so cuts fall at the same places of a passage wherever it stands, and an insertion moves only the cuts near
it. Chunks are deduplicated by a 64-bit digest over the whole corpus; a run holds several, so a chance
collision of two digests makes none. Neighbouring repeated chunks of a document make a run, and runs of at least MIN_WORDS words are reported. A chunk that holds the least
(doc_id, start) of its digest is the copy that stays.

Defined results: a null or empty text has no chunk, and texts of any length are cut whole; a null doc_id is
sorted before all others; repeated rows are copies of each other, and of rows with one doc_id the one read
first stays; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import SPACE, Sieve, byte_column, code_points, joined_by_share, mix, record_batch, stored, table

#: A cut follows a byte at which the top MASK_BITS bits of the hash are zero: one in 2 ** MASK_BITS bytes.
MASK_BITS = 4
MIN_BYTES, MAX_BYTES = 8, 1024
#: Words in a run of repeated chunks that is reported. The ends of a repeated passage lie in chunks that
#: reach beyond it, some 14 words together, so that passages of over 50 words hold such a run; of 1500
#: simulated ones of 51 words one had none.
MIN_WORDS = 20
#: Bits of the sieve of digests: eight megabytes.
SIEVE_OF_CHUNKS = 1 << 26
_CUT = "__spans_to_cut"
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def cuts(data: np.ndarray, bits: int = MASK_BITS, least: int = MIN_BYTES, most: int = MAX_BYTES) -> list[int]:
    """The ends of the chunks of an array of bytes, the array's length last."""
    if not len(data):
        return []
    rolled = GEAR[data]
    for reach in (1, 2, 4, 8, 16):  # after these the hash covers 2, 4, 8, 16, 32 bytes
        if len(rolled) > reach:
            rolled[reach:] = rolled[reach:] + (rolled[:-reach] << np.uint32(reach))
    out, last = [], 0
    for at in [*(np.flatnonzero(rolled >> np.uint32(32 - bits) == 0) + 1).tolist(), len(data)]:
        while at - last > most:
            last += most
            out.append(last)
        if at - last >= least:
            out.append(at)
            last = at
    if not out or out[-1] != len(data):
        out.append(len(data))
    return out


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _digests(text: bytes, edge: list[int]) -> list[int]:
    digest = xxhash.xxh3_64_intdigest
    return [digest(text[lo:hi]) for lo, hi in zip([0, *edge], edge, strict=False)]


def repeated_digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """(digest): the digests of more than one chunk."""
    schema = pa.schema([("digest", pa.int64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            found = [x for t in byte_column(batch, "text") for x in _digests(t, cuts(np.frombuffer(t, np.uint8)))]
            yield record_batch(schema, [np.array(found, np.uint64).view(np.int64)])

    return docs.select(F.col(text).alias("text")).mapInArrow(kernel, "digest bigint").groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")


def chunk_table(docs: DataFrame, key: str = "doc_id", text: str = "text", sieve: Sieve | None = None) -> DataFrame:
    """(doc_id, row, at, digest): the chunks of every text, those that the sieve lets through if there is one.

    at holds a chunk's start and length in code points and its words, 32, 16 and 16 bits (a chunk has MAX_BYTES
    at most): these rows are shuffled, and there are many.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("at", pa.int64()), ("digest", pa.int64())])
    held = docs.sparkSession.sparkContext.broadcast(sieve)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            counts, places, digests = [], [], []
            for text in byte_column(batch, "text"):
                data = np.frombuffer(text, np.uint8)
                edge = cuts(data)
                found = np.array(_digests(text, edge), np.uint64)
                good = held.value.holds(found) if held.value else np.ones(len(found), bool)
                counts.append(int(good.sum()))
                if not counts[-1]:
                    continue
                bounds = np.array([0, *edge])
                points = code_points(data)[bounds]
                begins = SPACE[data] == 0
                begins[1:] &= SPACE[data[:-1]] == 1
                words = np.diff(np.concatenate(([0], np.cumsum(begins)))[bounds])
                places.append((points[:-1] << 32 | np.diff(points) << 16 | words)[good])
                digests.append(found[good])
            take = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            whole = np.concatenate(places) if places else np.zeros(0, np.int64)
            digest = np.concatenate(digests) if digests else np.zeros(0, np.uint64)
            yield record_batch(schema, [batch.column("doc_id").take(take), batch.column("row").take(take), whole, digest.view(np.int64)])

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(kernel, "doc_id bigint, row bigint, at bigint, digest bigint")


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, row, start, end, n_words, n_chunks, copies, kept): runs of chunks that occur again in the corpus.

    Neighbouring chunks are in one run if both stay or both are later copies. copies is the largest number
    of occurrences of a chunk of the run; kept tells whether this run is the copy that stays.
    """
    # a sieve of the digests that repeat spares writing most of the others
    sieve = Sieve.of(repeated_digests(docs, text), "digest", SIEVE_OF_CHUNKS)
    # written once: the rows' numbers are the same wherever they are read
    chunks = stored(chunk_table(docs, key, text, sieve), "chunks")
    # counted before the shuffle, so a chunk that a third of all documents share is a row for each task
    shared = chunks.groupBy("digest").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "row", "at")).alias("first")).where("copies > 1")
    shared = stored(shared, "shared")
    found = joined_by_share(chunks, shared, "digest", "copies", chunks.count())
    found = found.select("doc_id", "row", "at", "copies", (F.col("first") == F.struct("doc_id", "row", "at")).alias("kept")).repartition("row")
    start = F.shiftright("at", 32)
    end = start + F.shiftright("at", 16).bitwiseAND(0xFFFF)
    found = found.select("doc_id", "row", start.cast("int").alias("start"), end.cast("int").alias("end"), F.col("at").bitwiseAND(0xFFFF).alias("words"), "copies", "kept")
    by = Window.partitionBy("row").orderBy("start")
    joined = (F.lag("end").over(by) == F.col("start")) & (F.lag("kept").over(by) == F.col("kept"))
    runs = found.withColumn("new", F.when(joined, 0).otherwise(1)).withColumn("run", F.sum("new").over(by))
    out = runs.groupBy("row", "run").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("n_words"), F.count("*").alias("n_chunks"), F.max("copies").alias("copies"), F.first("kept").alias("kept"))
    return out.where(F.col("n_words") >= min_words).drop("run")


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the reported later copies cut out of the text; doc_id must be unique."""
    cut = repeated_runs(docs, key, text, min_words).where("not kept").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(_CUT))
    joined = docs.join(cut, docs[key].eqNullSafe(cut["doc_id"]), "left").drop(cut["doc_id"])
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, x: F.struct(F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, x["start"] - a["at"])).alias("out"), x["end"].alias("at"))
    rest = lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, F.length(text)))
    return joined.withColumn(text, F.when(F.col(_CUT).isNull(), F.col(text)).otherwise(F.aggregate(_CUT, begin, step, rest))).drop(_CUT)


def op10_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = repeated_runs(table(spark, sf_dir, "documents"))
    return runs.select("doc_id", "start", "end", F.col("n_words").cast("bigint").alias("n_words"), "n_chunks", "copies", "kept")
