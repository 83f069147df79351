"""How the stages of a build grow with the corpus: seconds at several sizes, recall of pruned edges, exponents."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import analytics as A
from . import evaluation as E
from . import graph as G
from . import index as I

#: Shares of a corpus that a sweep takes by default.
SHARES = (0.2, 0.4, 0.6, 0.8, 1.0)
FORM = "n bigint, index_s double, exact_s double, pruned_s double, communities_s double, trends_s double, total_s double, edge_recall double"


def _timed(run: Callable[[], DataFrame]) -> tuple[DataFrame, float]:
    """What run gives, written, and the seconds that took."""
    start = time.perf_counter()
    made = stored(run(), "stage")
    return made, time.perf_counter() - start


def sweep(papers: DataFrame, sizes: list[int] | None = None, seed: int = 7, clock: Callable = _timed) -> DataFrame:
    """A row of FORM for each size: papers(pos, abstract, year) are drawn by a hash, so that smaller ones lie in larger ones.

    Every stage reads what the one before has written and is written itself; the driver gets times and counts.
    """
    spark = papers.sparkSession
    whole = papers.count()
    rows = []
    for n in sorted({min(s, whole) for s in sizes or [max(1, int(whole * x)) for x in SHARES]}):
        drawn = stored(E.sample(papers, n, seed), "drawn")
        counts, index_s = clock(lambda drawn=drawn: I.term_counts(drawn))
        index = I.build_tfidf(drawn, counts=counts)
        exact, exact_s = clock(lambda index=index: G.mutual_edges(G.exact_arcs(index)))
        pruned, pruned_s = clock(lambda index=index: G.mutual_edges(G.pruned_arcs(index)))
        communities, communities_s = clock(lambda drawn=drawn, exact=exact: G.detect_communities(drawn, exact))
        _, trends_s = clock(lambda drawn=drawn, communities=communities: A.cube(drawn, communities))
        recall = G.edge_recall(exact, pruned).first()
        total = index_s + exact_s + pruned_s + communities_s + trends_s
        rows.append((n, index_s, exact_s, pruned_s, communities_s, trends_s, total, recall["recall"]))
    return spark.createDataFrame(rows, FORM)


def exponents(table: DataFrame) -> DataFrame:
    """(stage, slope): the least-squares slope of log seconds on log n of each stage of a sweep."""
    stages = [c.removesuffix("_s") for c in table.columns if c.endswith("_s")]
    out = None
    for s in stages:
        one = E.loglog_slope(table.select(F.col("n").cast("double").alias("x"), F.col(f"{s}_s").alias("y"))).select(F.lit(s).alias("stage"), "slope")
        out = one if out is None else out.unionByName(one)
    return out
