"""Ranked search over many queries at once: (q, text) in, (q, rank, pos, score) out.

Scores are rounded to six places before ranking and ties go to the smaller pos, so that the order of
summation can't change a ranking.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import terms
from ..session import stored
from .blocks import _Best, _cells, best_products
from .index import Bm25, Inverted, TfIdf, only, query_counts, query_vector, weights_of

K1, B = 1.5, 0.75
RRF, DEPTH = 60, 100
SEED_DEPTH, DECAY = 10, 0.9


def top_k(scored: DataFrame, k: int, positive: bool = True) -> DataFrame:
    """(q, rank, pos, score): the best k of each q; k of 0 or less keeps all."""
    rounded = scored.select("q", "pos", F.round("score", 6).alias("score"))
    if positive:
        rounded = rounded.where("score > 0")
    ranked = rounded.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "pos")))
    return (ranked.where(F.col("rank") <= k) if k > 0 else ranked).select("q", "rank", "pos", "score")


def _best(queries: DataFrame, vectors: DataFrame, k: int, extra: Column | None = None) -> DataFrame:
    """top_k() of the products of queries(q, term, w) and vectors(pos, term, w), plus the vector's extra."""
    if k > 0:
        return top_k(best_products(queries, vectors, k, extra), k)
    own = vectors.select("pos", "term", F.col("w").alias("dw"), (F.lit(0.0) if extra is None else extra).alias("extra"))
    return top_k(queries.join(own, "term").groupBy("q", "pos").agg((F.sum(F.col("w") * F.col("dw")) + F.first("extra")).alias("score")), k)


def overlap_search(index: Inverted, queries: DataFrame, k: int) -> DataFrame:
    """The number of distinct query tokens in a document, plus less than one for a short document."""
    wanted = queries.select("q", F.explode(F.array_distinct(terms("text", 1))).alias("term"), F.lit(1.0).alias("w"))
    bonus = 1 / (1 + F.greatest("len", F.lit(1)) / 1000)
    return _best(wanted, only(index.postings, wanted).join(index.lengths, "pos").select("pos", "term", F.lit(1.0).alias("w"), "len"), k, bonus)


def tfidf_search(index: TfIdf, queries: DataFrame, k: int) -> DataFrame:
    """Cosine of the query's vector and each document's."""
    return _best(query_vector(index, queries), weights_of(index, query_counts(index, queries)), k)


def _bm25_part(idf: Column, tf: Column, length: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("avgdl")))


def _bm25_wanted(queries: DataFrame) -> DataFrame:
    return queries.select("q", F.explode(terms("text", 1)).alias("term")).groupBy("q", "term").agg(F.count("*").cast("double").alias("w"))


def bm25_search(index: Bm25, queries: DataFrame, k: int) -> DataFrame:
    """Okapi BM25; a token counts as often as the query has it."""
    wanted = _bm25_wanted(queries)
    found = only(index.postings, wanted).join(only(index.vocabulary, wanted), "term").join(index.lengths, "pos").join(F.broadcast(index.average))
    return _best(wanted, found.select("pos", "term", _bm25_part(F.col("idf"), F.col("tf").cast("double"), F.col("len")).alias("w")), k)


def bm25_matched(index: Bm25, queries: DataFrame) -> DataFrame:
    """(q) of the queries for which bm25_search() finds a document.

    Wherever a term occurs, its part of the score is at least that of one occurrence in the longest document.
    If that doesn't round to 0, one term is enough; queries that have no such term are searched.
    """
    longest = index.lengths.agg(F.max("len").alias("longest"))  # one row
    wanted = _bm25_wanted(queries)
    least = only(index.vocabulary, wanted).join(F.broadcast(index.average)).join(F.broadcast(longest)).select("term", _bm25_part(F.col("idf"), F.lit(1.0), F.col("longest")).alias("least"))
    known = stored(wanted.join(least, "term").groupBy("q").agg((F.max(F.col("w") * F.col("least")) > 1e-6).alias("sure")), "known")
    found, rest = known.where("sure").select("q"), known.where(~F.col("sure")).select("q")
    return found if rest.isEmpty() else found.union(bm25_search(index, queries.join(rest, "q", "left_semi"), 1).select("q"))


#: Vectors that are packed into one row of a grid.
PACKED = 2048


def _packed(rows: DataFrame, key: str) -> DataFrame:
    """(n, width, keys, matrix): up to PACKED vectors of rows(key, v) a row, packed where they lie, without a shuffle."""
    schema = pa.schema([("n", pa.int32()), ("width", pa.int32()), ("keys", pa.binary()), ("matrix", pa.binary())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        flat: list[np.ndarray] = []

        def packed() -> Iterator[pa.RecordBatch]:
            n = sum(map(len, keys))
            if n:
                size = sum(map(len, flat))
                if size % n:
                    raise ValueError("vectors differ in length")
                body = np.concatenate(flat).astype("<f8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([size // n], pa.int32()), pa.array([np.concatenate(keys).astype("<i8").tobytes()]), pa.array([body])], schema=schema)
            keys.clear()
            flat.clear()

        for batch in batches:
            for lo in range(0, batch.num_rows, PACKED):
                part = batch.slice(lo, PACKED)
                vectors = part.column("v")
                if len(set(vectors.value_lengths().to_pylist())) > 1 or vectors.null_count:
                    raise ValueError("vectors differ in length")
                keys.append(part.column(key).to_numpy())
                flat.append(np.asarray(vectors.flatten(), np.float64))
                if sum(map(len, keys)) >= PACKED:
                    yield from packed()
        yield from packed()

    return rows.select(F.col(key).cast("bigint").alias(key), "v").mapInArrow(kernel, "n int, width int, keys binary, matrix binary")


def dense_search(vectors: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """(q, rank, pos, score): dot products of queries(q, v) and vectors(pos, v), scores of any sign, the best k of each q.

    Both tables are packed into blocks and dealt over the rows and columns of a grid with about as many cells
    as there are shuffle partitions, so a block goes to one row or column of cells only. A pair of blocks is
    one matrix product, of which the best k a query leave; these meet at the query. Nothing passes through
    the driver. Vectors of different lengths raise an error.
    """
    side = max(1, round(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    line = lambda name: F.pmod(F.xxhash64("keys"), F.lit(side)).alias(name)
    every = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    asked = _packed(queries, "q").select(*(F.col(c).alias(f"q_{c}") for c in ("n", "width", "keys", "matrix")), line("row"), every.alias("column"))
    held = _packed(vectors, "pos").select(*(F.col(c).alias(f"v_{c}") for c in ("n", "width", "keys", "matrix")), line("column"), every.alias("row"))
    schema = pa.schema([("q", pa.int64()), ("pos", pa.int64()), ("score", pa.float64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                cell = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                if cell["q_width"] != cell["v_width"]:
                    raise ValueError("vectors and queries differ in length")
                (keys, left), (here, right) = ((np.frombuffer(cell[f"{x}_keys"], "<i8"), np.frombuffer(cell[f"{x}_matrix"], "<f8").reshape(cell[f"{x}_n"], -1)) for x in "qv")
                score = np.round(left @ right.T, 6)
                if exclude_self:
                    score[keys[:, None] == here[None]] = -np.inf
                if k <= 0 or k >= len(here):
                    rows, columns = np.indices(score.shape).reshape(2, -1)
                else:  # all that tie with the k-th best stay
                    least = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
                    rows, columns = np.nonzero(score >= least)
                value = score[rows, columns]
                good = np.isfinite(value)
                yield pa.RecordBatch.from_arrays([pa.array(keys[rows[good]]), pa.array(here[columns[good]]), pa.array(value[good])], schema=schema)

    pairs = asked.join(held.hint("shuffle_hash"), ["row", "column"]).drop("row", "column")
    return top_k(pairs.mapInArrow(kernel, "q bigint, pos bigint, score double"), k, positive=False)


#: Rows of a block that are scored at once.
SLICE = 512


def dense_pairs(vectors: DataFrame, k: int) -> DataFrame:
    """(q, pos, score) of vectors(pos, v) with each other, scores above 0: the best k of each q are among the rows.

    As nearest_pairs() of blocks.py: both directions come from one product, and a task keeps the best k of its
    rows over all its blocks, so that what is sent grows with the vectors, not with the pairs of blocks.
    """
    cells = _cells(vectors)
    lines = max(1, round((2 * cells) ** 0.5))
    parts = ("n", "width", "keys", "matrix")
    blocks = stored(_packed(vectors, "pos"), "vectors").withColumn("line", F.pmod(F.xxhash64("keys"), F.lit(lines)).cast("int"))
    side = lambda df, mark: df.select("row", "column", *(F.col(c).alias(f"{mark}_{c}") for c in parts)).repartition(2 * cells, "row", "column")
    above = side(blocks.select(F.col("line").alias("row"), F.explode(F.sequence(F.col("line"), F.lit(lines - 1))).alias("column"), *parts), "q")
    below = side(blocks.select(F.explode(F.sequence(F.lit(0), F.col("line"))).alias("row"), F.col("line").alias("column"), *parts), "v")
    # a pair of blocks of one line is met twice
    pairs = above.join(below.hint("merge"), ["row", "column"]).where("row < column or q_keys <= v_keys")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for batch in batches:
            for r in range(batch.num_rows):
                cell = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                if cell["q_width"] != cell["v_width"]:
                    raise ValueError("vectors differ in length")
                (keys, left), (here, right) = ((np.frombuffer(cell[f"{x}_keys"], "<i8"), np.frombuffer(cell[f"{x}_matrix"], "<f8").reshape(cell[f"{x}_n"], -1)) for x in "qv")
                same = cell["q_keys"] == cell["v_keys"]
                for lo in range(0, len(keys), SLICE):
                    score = left[lo : lo + SLICE] @ right.T
                    if not np.isfinite(score.sum()):
                        score[~np.isfinite(score)] = 0
                    if same:
                        score[keys[lo : lo + SLICE, None] == here[None]] = 0
                    best.add(keys, lo, score, here)
                    if not same:
                        best.add(here, 0, np.ascontiguousarray(score.T), keys[lo : lo + SLICE])
        yield from best.handed()

    return pairs.drop("row", "column").mapInArrow(kernel, "q bigint, pos bigint, score double")


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int) -> DataFrame:
    """The sum of 1 / (60 + rank) over rankings (q, rank, pos)."""
    all_ranks = rankings[0].select("q", "pos", "rank")
    for r in rankings[1:]:
        all_ranks = all_ranks.unionByName(r.select("q", "pos", "rank"))
    return top_k(all_ranks.groupBy("q", "pos").agg(F.sum(1 / (RRF + F.col("rank"))).alias("score")), k)


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, dst, w): edges(a, b, w) both ways."""
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").union(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))


def expand(seeds: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Rescores seeds (q, rank, pos) by rank; neighbours of the best ten inherit 0.9 of a score; the larger counts."""
    own = seeds.select("q", "pos", "rank", (1 / (RRF + F.col("rank"))).alias("score"))
    passed = own.where(F.col("rank") <= SEED_DEPTH).join(adjacency(edges), F.col("pos") == F.col("src")).select("q", F.col("dst").alias("pos"), (F.col("score") * DECAY).alias("score"))
    return top_k(own.select("q", "pos", "score").union(passed).groupBy("q", "pos").agg(F.max("score").alias("score")), k)


#: The order of fallbacks of each method.
LADDER = {"t0": ["t0"], "tfidf": ["tfidf", "t0"], "bm25": ["bm25", "tfidf", "t0"], "dense": ["dense", "tfidf", "t0"]}
DEFAULTS = {"T3": "dense", "T2": "tfidf", "T1": "tfidf", "T0": "t0"}


@dataclass
class Engine:
    """Whichever indexes there are, and the search methods that they allow."""

    inverted: Inverted
    tfidf: TfIdf | None = None
    bm25: Bm25 | None = None
    vectors: DataFrame | None = None  # (pos, v)
    edges: DataFrame | None = None  # (a, b, w)

    def tier(self) -> str:
        return "T3" if self.vectors is not None else "T2" if self.edges is not None else "T1" if self.tfidf is not None else "T0"

    def default_method(self) -> str:
        return DEFAULTS[self.tier()]

    def _one(self, method: str, queries: DataFrame, k: int) -> DataFrame:
        if method == "bm25":
            return bm25_search(self.bm25, queries, k)
        if method == "tfidf":
            return tfidf_search(self.tfidf, queries, k)
        if method == "dense":
            return dense_search(self.vectors, queries, k)
        return overlap_search(self.inverted, queries, k)

    def _has(self, method: str, queries: DataFrame) -> bool:
        return {"bm25": self.bm25 is not None, "tfidf": self.tfidf is not None, "dense": self.vectors is not None and "v" in queries.columns, "t0": True}[method]

    def fuse(self, queries: DataFrame, k: int) -> DataFrame:
        depth = max(DEPTH, 5 * k)
        found = [self._one(m, queries, depth) for m in ("tfidf", "bm25", "dense") if self._has(m, queries)]
        return reciprocal_rank_fusion(found, k) if found else self._one("t0", queries, k)

    def search(self, method: str, queries: DataFrame, k: int) -> DataFrame:
        """queries(q, text) or (q, text, v); an index that is missing falls back down the ladder."""
        if method == "hybrid":
            return self.fuse(queries, k)
        if method == "hybrid+graph":
            return expand(self.fuse(queries, 2 * k), self.edges, k) if self.edges is not None else self.fuse(queries, k)
        return next(self._one(m, queries, k) for m in LADDER.get(method, ["t0"]) if self._has(m, queries))
