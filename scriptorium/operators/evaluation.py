"""Evaluation: ranked-list metrics, pooled judgments, paired bootstrap, scaling fits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .index import TfIdf
from .search import tfidf_search


#: Draws of a round that are made at once.
DRAWN = 1 << 16


def hash48(*parts: Column) -> Column:
    """The first 48 bits of the MD5 of the parts joined by colons: the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("bigint")


def metrics(runs: DataFrame, qrels: DataFrame, queries: DataFrame, k: int, min_grade: int = 1) -> DataFrame:
    """(q, precision, recall, reciprocal_rank, ndcg) of runs(q, rank, pos) against qrels(q, pos, grade), for each of queries(q).

    Precision divides by k even if fewer were returned; a query without relevant documents has 0 throughout.
    """
    judged = runs.join(qrels.where("grade > 0"), ["q", "pos"]).select("q", "rank", "grade")
    inside = F.col("rank") <= k
    relevant = (F.col("grade") >= min_grade) & inside
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1.0)
    got = judged.groupBy("q").agg(F.sum(F.when(relevant, 1).otherwise(0)).alias("hits"), F.min("rank").alias("first"), F.sum(F.when(inside, gain).otherwise(0.0)).alias("dcg"))
    best = qrels.where("grade > 0").withColumn("i", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("grade"), "pos")))
    ideal = best.groupBy("q").agg(F.sum(F.when(F.col("grade") >= min_grade, 1).otherwise(0)).alias("total"), F.sum(F.when(F.col("i") <= k, (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("i") + 1.0)).otherwise(0.0)).alias("idcg"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return queries.select("q").join(got, "q", "left").join(ideal, "q", "left").select("q", zero(F.col("hits") / k).alias("precision"), zero(F.try_divide("hits", F.nullif("total", F.lit(0)))).alias("recall"), zero(1 / F.col("first")).alias("reciprocal_rank"), zero(F.try_divide("dcg", F.nullif("idcg", F.lit(0.0)))).alias("ndcg"))


def grade(a: Column, b: Column) -> Column:
    """How alike two lists of categories are: 3 same first and two shared, 2 same first, 1 two shared, else 0."""
    shared = F.size(F.filter(a, lambda x: F.array_contains(b, x)))
    same = F.get(a, F.lit(0)) == F.get(b, F.lit(0))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).when(same & (shared >= 2), 3).when(same, 2).when(shared >= 2, 1).otherwise(0)


def pool(runs: list[DataFrame], depth: int = 50, seeds: DataFrame | None = None) -> DataFrame:
    """(q, pos): what any run has in its first ranks; seeds(q, pos) are left out."""
    out = runs[0].where(F.col("rank") <= depth).select("q", "pos")
    for r in runs[1:]:
        out = out.union(r.where(F.col("rank") <= depth).select("q", "pos"))
    out = out.distinct()
    return out if seeds is None else out.join(seeds, ["q", "pos"], "left_anti")


def pooled_judgments(pooled: DataFrame, seeds: DataFrame, papers: DataFrame) -> DataFrame:
    """(q, pos, grade) of pooled(q, pos) by the categories of the seed, seeds(q, pos), and of the document."""
    own = seeds.join(papers.select("pos", F.col("categories").alias("ca")), "pos").select("q", "ca")
    other = papers.select("pos", F.col("categories").alias("cb"))
    return pooled.join(own, "q").join(other, "pos").select("q", "pos", grade(F.col("ca"), F.col("cb")).alias("grade"))


#: Documents of a gold set, and times as many that are looked through for them.
GOLD, DEEPER = 5, 8


def gold_set(index: TfIdf, seeds: DataFrame, papers: DataFrame, size: int = GOLD) -> DataFrame:
    """(q, rank, pos): documents near a seed by character n-grams that share its first category; seeds(q, pos, text)."""
    return gold_of(tfidf_search(index, seeds.select("q", "text"), size * DEEPER), seeds, papers, size)


def gold_of(near: DataFrame, seeds: DataFrame, papers: DataFrame, size: int = GOLD) -> DataFrame:
    """gold_set() from the ranking near(q, rank, pos)."""
    graded = pooled_judgments(near.select("q", "pos").join(seeds.select("q", "pos"), ["q", "pos"], "left_anti"), seeds.select("q", "pos"), papers).where("grade >= 2")
    kept = near.join(graded.select("q", "pos"), ["q", "pos"], "left_semi")
    ranked = kept.select("q", "pos", F.row_number().over(Window.partitionBy("q").orderBy("rank")).alias("rank"))
    return ranked.where(F.col("rank") <= size).select("q", "rank", "pos")


def sample(papers: DataFrame, n: int, seed: int) -> DataFrame:
    """Exactly n rows (or all) by a hash of pos and seed."""
    return papers.orderBy(hash48(F.col("pos"), F.lit(seed)), "pos").limit(n)


def known_items(papers: DataFrame, n: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Titles as queries(q, text), and each one's own paper as qrels(q, pos, grade)."""
    chosen = sample(papers, n, seed)
    return chosen.select(F.col("pos").alias("q"), F.col("title").alias("text")), chosen.select(F.col("pos").alias("q"), "pos", F.lit(1).alias("grade"))


def paired_bootstrap(pairs: DataFrame, rounds: int = 5000) -> DataFrame:
    """One row (n, diff, lo, hi, significant) over pairs(i, a, b): resampled mean differences b - a.

    In round r the j-th draw is the row number hash48(r, j) mod n. The rounds are rows, so they run in
    parallel, and a draw never becomes one: a task holds all differences, eight bytes each, and a round's draws.
    Bounds are the sorted means at .025 and .975 of the rounds. A bound of exactly 0 above a negative one
    counts as significant.
    """
    spark = pairs.sparkSession
    # one row each
    packed = pairs.select("i", (F.col("b") - F.col("a")).cast("double").alias("d")).groupBy().applyInArrow(_differences, "d binary")
    whole = pairs.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.col("b") - F.col("a")), F.lit(0.0)).alias("diff"))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    means = spark.range(0, tasks, 1, tasks).crossJoin(F.broadcast(packed)).mapInArrow(_means(rounds, tasks), "r bigint, mean double").select("r", F.round("mean", 9).alias("mean"))
    ranked = means.withColumn("i", F.row_number().over(Window.orderBy("mean", "r")) - 1)
    at = lambda share: F.max(F.when(F.col("i") == int(share * rounds), F.col("mean")))
    bounds = ranked.agg(at(0.025).alias("lo"), at(0.975).alias("hi"))
    return whole.crossJoin(bounds).select("n", "diff", "lo", "hi", F.coalesce(((F.col("lo") > 0) == (F.col("hi") > 0)) & (F.col("lo") != 0), F.lit(False)).alias("significant"))


def _differences(table: pa.Table) -> pa.Table:
    """All differences in order of i, NaN for one that is null."""
    found = table.sort_by("i").column("d").to_numpy()
    return pa.table({"d": pa.array([found.astype("<f8").tobytes()], pa.binary())})


def _means(rounds: int, tasks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(r, mean): the mean of each round's draws that are not null, of the rounds of each task of (task, d)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task, d in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(d.as_buffer(), "<f8")
                mine = np.arange(task, rounds, tasks)
                total, many = np.zeros(len(mine)), np.zeros(len(mine))
                for lo in range(0, len(own), DRAWN):
                    names = [b":%d" % j for j in range(lo, min(len(own), lo + DRAWN))]
                    for i, r in enumerate(mine.tolist()):
                        start, hashes = md5(b"%d" % r).copy, bytearray()
                        for name in names:
                            h = start()
                            h.update(name)
                            hashes += h.digest()
                        first = np.frombuffer(hashes, ">u8")[::2] >> np.uint64(16)
                        got = own[(first % np.uint64(len(own))).astype(np.int64)]
                        total[i] += np.nansum(got)
                        many[i] += np.count_nonzero(~np.isnan(got))
                drawn = many > 0
                yield pa.RecordBatch.from_arrays([pa.array(mine[drawn]), pa.array(total[drawn] / many[drawn])], names=["r", "mean"])

    return run


def loglog_slope(points: DataFrame) -> DataFrame:
    """One row (slope): the least-squares slope of ln y on ln x over points(x, y) above 0; 0 for fewer than two."""
    return points.where("x > 0 and y > 0").agg(F.coalesce(F.when(F.count("*") >= 2, F.regr_slope(F.log("y"), F.log("x"))), F.lit(0.0)).alias("slope"))
