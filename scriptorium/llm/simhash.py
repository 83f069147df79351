"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, Hamming distances verified.

A fingerprint has a bit for each of 64 positions, 1 if over half of the text's shingle hashes have it.
Fingerprints cut into m blocks that differ in at most d bits agree in m - d blocks or more, so pairs are
sought among those that share some m - d blocks. m grows with the number of distinct fingerprints, so that
a choice of blocks singles out few of them; the links found are the same for every m.

Equal fingerprints are one node. Members of one block group stream through a task; a group of up to
GROUP fingerprints is compared there and leaves a spanning forest of its links. Members of larger groups
take an exact way that grows in proportion to them: each is put under all its variants with up to d/2 bits
turned. Two fingerprints at distance d or less share such a variant, and all fingerprints under one
variant are at distance d or less, so each variant needs links to its least member only.

Defined results: a null text or one without words has fingerprint 0, linked like any other; a null doc_id
keeps its row and takes the least non-null id of its component (null if there is none); repeated rows
stay; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import byte_column, joined_by_share, record_batch, stored, table
from .graph import components

SEED = 42
WORDS = 4
DISTANCE = 4
#: Fingerprints of a block group that are compared in one task.
GROUP = 4096


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The 64-bit fingerprint of a text in UTF-8."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    span = min(words, len(found))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(found) - span + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[span - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp): a row for each of docs; fp is the fingerprint as a signed bigint."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x, words) for x in byte_column(batch, "text")), np.uint64, batch.num_rows)
            yield record_batch(schema, [batch.column("doc_id"), pa.array(found.view(np.int64))])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(kernel, "doc_id bigint, fp bigint")


def block_masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """The masks, as signed 64-bit numbers, of every choice of blocks - distance out of so many blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [((x := sum(c)) ^ (1 << 63)) - (1 << 63) for c in combinations(each, blocks - distance)]


def blocks_for(nodes: int, distance: int = DISTANCE) -> int:
    """The least number of blocks for which chosen blocks have 3 bits more than the nodes' count."""
    for blocks in range(distance + 1, 2 * distance + 3):
        if 64 * (blocks - distance) // blocks >= math.log2(max(nodes, 1)) + 3:
            return blocks
    return 2 * distance + 2


def _forest(members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among members."""
    left, out = np.arange(len(members)), []
    while len(left):  # breadth first: each member is compared with those not reached yet
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(members[left] ^ members[at]) <= distance
            if near.any():
                hit = left[near]
                out += [(at, x) for x in hit.tolist()]
                queue += hit.tolist()
                left = left[~near]
    return out


def links(nodes: DataFrame, distance: int = DISTANCE, group: int = GROUP, blocks: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints of nodes(fp) that connect all those within the distance."""
    if distance % 2:
        raise ValueError("the distance must be even")
    masks = block_masks(blocks or blocks_for(nodes.count(), distance), distance)
    choice = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.lit(m).alias("mask")) for i, m in enumerate(masks)])).alias("x")
    keyed = nodes.select("fp", choice).select(F.xxhash64("x.c", F.col("fp").bitwiseAND(F.col("x.mask"))).alias("key"), "fp")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key. A member of a group beyond the limit leaves as (fp, null)."""
        held: list[np.ndarray] = []
        size, key, large = 0, None, False

        def close() -> tuple[list, list]:
            if size < 2 or not held:
                return [], []
            members = np.concatenate(held)
            if large:
                return members.view(np.int64).tolist(), [None] * len(members)
            found = _forest(members, distance)
            as_int = members.view(np.int64)
            return [int(as_int[x]) for x, _ in found], [int(as_int[y]) for _, y in found]

        a: list = []
        b: list = []
        for batch in batches:
            keys = batch.column("key").to_numpy()
            fps = batch.column("fp").to_numpy().view(np.uint64)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if lo == hi:
                    continue
                if keys[lo] != key:
                    x, y = close()
                    a += x
                    b += y
                    held, size, key, large = [], 0, keys[lo], False
                if lo + 1 == hi and not size:
                    held, size = [fps[lo:hi]], 1
                    continue
                held.append(fps[lo:hi])
                size += hi - lo
                if size > group or large:
                    large = True
                    x, y = close()
                    a += x
                    b += y
                    held, size = [], 2  # what follows of this key is large as well
            held = [x.copy() for x in held]
            yield record_batch(schema, [a, b])
            a, b = [], []
        if held:
            x, y = close()
            yield record_batch(schema, [x, y])

    found = stored(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(kernel, "a bigint, b bigint"), "links")
    # the exact way for large groups: variants with up to distance // 2 bits turned
    turned = [0, *(sum(1 << i for i in c) for n in range(1, distance // 2 + 1) for c in combinations(range(64), n))]
    signed = np.array(turned, np.uint64).view(np.int64).tolist()
    hot = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    if hot.isEmpty():
        return found.where("b is not null")
    variants = hot.select("fp", F.explode(F.transform(F.array(*[F.lit(x) for x in signed]), lambda x: x.bitwiseXOR(F.col("fp")))).alias("v"))
    stars = variants.join(variants.groupBy("v").agg(F.min("fp").alias("least")), "v").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return found.where("b is not null").union(stars)


def _classes(docs: DataFrame, key: str, text: str, words: int, distance: int, group: int) -> DataFrame:
    """(doc_id, fp, root, component_id) for every row of docs; root is a fingerprint that stands for the component."""
    marked = stored(fingerprints(docs, key, text, words), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "nodes")
    roots = components(links(nodes.select("fp"), distance, group))
    classes = stored(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "rows"), "classes")
    least = stored(classes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "roots")
    named = joined_by_share(classes, least, "root", "members", classes.count()).select("fp", "root", "component_id", "rows")
    return joined_by_share(marked, stored(named, "named"), "fp", "rows", marked.count()).select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    return _classes(docs, key, text, words, distance, group).select("doc_id", "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A pipeline stage: of each group of near duplicates one row with the least doc_id stays.

    Of rows with one doc_id that are no near duplicates of each other each stays; rows with a null doc_id stay.
    """
    found = _classes(docs, "doc_id", "text", WORDS, DISTANCE, GROUP).where("doc_id = component_id")
    kept = stored(found.groupBy("doc_id", "root").agg(F.min("fp").alias("fp")), "kept").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType), "fp")
    named, unnamed = docs.where("doc_id is not null"), docs.where("doc_id is null")
    repeated = named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    once = named.join(kept.select("doc_id").distinct(), "doc_id", "left_semi").join(repeated, "doc_id", "left_anti").select(docs.columns)
    # numbered names can't clash; of equal rows of one doc_id and fingerprint any stays
    plain = named.join(repeated, "doc_id", "left_semi").select(docs.columns).toDF(*[f"c{i}" for i in range(len(docs.columns))])
    key, text = (f"c{docs.columns.index(x)}" for x in ("doc_id", "text"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x) for x in byte_column(batch, text)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], names=[*batch.schema.names, "fp"])

    marked = plain.mapInArrow(kernel, T.StructType([*plain.schema.fields, T.StructField("fp", T.LongType())]))
    chosen = marked.join(kept.withColumnRenamed("doc_id", key), [key, "fp"], "left_semi").dropDuplicates([key, "fp"])
    return once.unionByName(chosen.select(plain.columns).toDF(*docs.columns)).unionByName(unnamed)
