"""Vocabulary over time: the cube of terms by year and community, specificity, trends, bursts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored
from .index import gram_rows, spread
from .packs import mark_counts, names_of, packs

MAX_SPECIFICITY = 0.80


def cube(papers: DataFrame, communities: DataFrame, least: int | None = None, max_n: int = 2) -> DataFrame:
    """(term, year, community, docs, level): grouping sets over counts by term, year and community, level 'year', 'community' or 'total'.

    Documents without a community (-1) count to the year and the total. Terms in fewer than the least
    number of documents, max(5, N / 500) by default, are left out.
    """
    rows = gram_rows(spread(papers.select("pos", "year", "abstract")), ["pos", "year"], "abstract", max_n).select("pos", "year", "term").distinct().join(communities, "pos")
    # summed once by all three, so that all further sums read few rows
    cells = rows.groupBy("term", "year", "community").agg(F.count("*").alias("docs"))
    floor = F.lit(least) if least is not None else F.greatest(F.lit(5), F.floor(F.col("n") / 500))
    cells = cells.withColumn("total", F.sum("docs").over(Window.partitionBy("term"))).join(F.broadcast(papers.agg(F.count("*").alias("n")))).where(F.col("total") >= floor)
    return _levels(cells)


def packed_cube(papers: DataFrame, communities: int) -> DataFrame:
    """cube() of papers(pos, year, abstract, mark), marks as so many communities or -1, with the usual least number of documents.

    Terms that are too rare leave where they are counted; the others are read again in some documents that have them.
    """
    n = papers.count()
    width = communities + 1
    marked = papers.select("pos", "abstract", (F.col("year") * width + F.col("mark") + 1).cast("int").alias("mark"))
    found = stored(mark_counts(packs(marked, least=max(5, n // 500), rare=False, named=True)), "cells")
    kept = found.groupBy("term").agg(F.min("at").alias("at"))
    names = names_of(papers, kept).join(kept.select(F.col("term").alias("hash")), "hash", "left_semi")
    cells = found.withColumnRenamed("term", "hash").join(names, "hash")
    return _levels(cells.select("term", F.floor(F.col("mark") / width).cast("int").alias("year"), (F.pmod("mark", F.lit(width)) - 1).cast("int").alias("community"), "docs"))


def _levels(cells: DataFrame) -> DataFrame:
    """The cube of cells(term, year, community, docs)."""
    grouped = cells.groupingSets([["term", "year"], ["term", "community"], ["term"]], "term", "year", "community").agg(F.sum("docs").alias("docs"), F.grouping_id().alias("g"))
    # bits of grouping_id: term, year, community; 1 if summed over
    level = F.when(F.col("g") == 1, "year").when(F.col("g") == 2, "community").otherwise("total")
    return grouped.select("term", "year", "community", "docs", level.alias("level")).where((F.col("level") != "community") | (F.col("community") >= 0))


def specificity(cells: DataFrame, communities: DataFrame) -> DataFrame:
    """(term, specificity): normalised entropy of a term over communities; 1 spread evenly, 0 in one alone."""
    n = communities.where("community >= 0").agg(F.countDistinct("community").alias("c"))
    rows = cells.where("level = 'community'").select("term", F.col("docs").cast("double").alias("d"))
    # with S the sum: -sum(p ln p) = ln S - sum(d ln d) / S
    summed = rows.groupBy("term").agg(F.sum("d").alias("s"), F.sum(F.col("d") * F.log("d")).alias("dl"), F.count("*").alias("k")).join(F.broadcast(n))
    value = F.when((F.col("k") > 1) & (F.col("c") > 1), (F.log("s") - F.col("dl") / F.col("s")) / F.log(F.greatest(F.col("c"), F.lit(2)).cast("double"))).otherwise(0.0)
    found = summed.select("term", value.alias("specificity"))
    return cells.where("level = 'total'").select("term").join(found, "term", "left").select("term", F.coalesce("specificity", F.lit(0.0)).alias("specificity"))


def trends(by_year: DataFrame, totals: DataFrame, early: tuple[int, int], late: tuple[int, int], spread: DataFrame | None = None, most: float = MAX_SPECIFICITY) -> DataFrame:
    """(term, early, late, lift, log2_lift, prevalence): smoothed change between two inclusive windows of years.

    by_year(term, year, docs), totals(year, docs); spread(term, specificity) leaves out terms above the most.
    A window without documents gives an empty result.
    """
    inside = lambda w: F.col("year").between(*w)
    sums = lambda df: df.agg(F.sum(F.when(inside(early), F.col("docs")).otherwise(0)).alias("e"), F.sum(F.when(inside(late), F.col("docs")).otherwise(0)).alias("l"))
    whole = sums(totals).select(F.col("e").alias("de"), F.col("l").alias("dl")).where("de > 0 and dl > 0")
    counted = sums(by_year.groupBy("term")).where("e > 0 or l > 0").join(F.broadcast(whole))
    if spread is not None:
        counted = counted.join(spread.where(F.round("specificity", 9) <= most).select("term"), "term", "left_semi")
    lift = ((F.col("l") + 0.5) / F.col("dl")) / ((F.col("e") + 0.5) / F.col("de"))
    return counted.select("term", F.col("e").alias("early"), F.col("l").alias("late"), lift.alias("lift"), F.log2(lift).alias("log2_lift"), (F.col("l") / F.col("dl")).alias("prevalence"))


def rising_and_declining(found: DataFrame, n: int = 7) -> DataFrame:
    """(direction, rank, term, log2_lift): the strongest rises, and the strongest falls below 0."""
    rounded = found.select("term", F.round("log2_lift", 2).alias("log2_lift"), F.round("lift", 9).alias("lift"))
    up = rounded.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("lift"), "term"))).where(F.col("rank") <= n)
    down = rounded.where("lift < 1").withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("lift", F.desc("term")))).where(F.col("rank") <= n)
    out = lambda df, name: df.select(F.lit(name).alias("direction"), "rank", "term", "log2_lift")
    return out(up, "rising").union(out(down, "declining"))


def trajectory(by_year: DataFrame, totals: DataFrame) -> DataFrame:
    """(term, year, docs, prevalence) for every year of the corpus, 0 where a term is missing."""
    names = by_year.select("term").distinct()
    grid = names.crossJoin(F.broadcast(totals.select("year", F.col("docs").alias("all"))))
    filled = grid.join(by_year, ["term", "year"], "left")
    return filled.select("term", "year", F.coalesce("docs", F.lit(0)).alias("docs"), (F.coalesce("docs", F.lit(0)) / F.col("all")).alias("prevalence"))


def _cost(r: Column, d: Column, p: Column) -> Column:
    """-ln of the binomial likelihood of r of d at rate p, without its constant; 0 where d is 0."""
    r = F.least(r, d)
    return F.when(d > 0, -(r * F.log(p) + (d - r) * F.log(1 - p))).otherwise(0.0)


def bursts(by_year: DataFrame, totals: DataFrame) -> DataFrame:
    """(term, burst): the weight of a term's bursts under a two-state model, one fold over its years.

    State 1 has twice the term's base rate, at most .999; entering it costs the log of the number of
    years, leaving is free; the cheaper path wins and a tie stays in state 0. A forward fold keeps the
    two costs and the way back, a backward fold sums what the years in state 1 save.
    """
    grid = trajectory(by_year, totals).join(F.broadcast(totals.select("year", F.col("docs").alias("all"))), "year")
    series = grid.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("year", F.col("docs").cast("double").alias("r"), F.col("all").cast("double").alias("d")))).alias("s"), F.sum("docs").alias("rs"), F.sum("all").alias("ds"), F.count("*").alias("n"))
    p0 = F.col("rs") / F.col("ds")
    rates = series.withColumn("p0", p0).withColumn("p1", F.least(F.lit(0.999), 2 * p0)).withColumn("enter", F.log(F.col("n").cast("double")))
    valid = (F.col("n") >= 2) & (F.col("p1") > F.col("p0")) & (F.col("p0") > 0)
    costs = rates.withColumn("c", F.when(valid, F.transform("s", lambda x: F.struct(_cost(x["r"], x["d"], F.col("p0")).alias("c0"), _cost(x["r"], x["d"], F.col("p1")).alias("c1")))).otherwise(F.array().cast("array<struct<c0:double,c1:double>>")))
    begin = F.struct(F.lit(0.0).alias("s0"), F.lit(float("inf")).alias("s1"), F.array().cast("array<struct<f0:int,f1:int,gain:double>>").alias("way"))

    def forward(a: Column, x: Column) -> Column:
        stay, entered = a["s1"], a["s0"] + F.col("enter")
        f0 = F.when(a["s1"] < a["s0"], 1).otherwise(0)
        f1 = F.when(stay < entered, 1).otherwise(0)
        step = F.struct(f0.alias("f0"), f1.alias("f1"), (x["c0"] - x["c1"]).alias("gain"))
        return F.struct((F.least(a["s0"], a["s1"]) + x["c0"]).alias("s0"), (F.least(stay, entered) + x["c1"]).alias("s1"), F.concat(a["way"], F.array(step)).alias("way"))

    walked = costs.withColumn("f", F.aggregate("c", begin, forward))
    last = F.when(F.col("f.s1") < F.col("f.s0"), 1).otherwise(0)
    back = lambda a, x: F.struct(F.when(a["state"] == 1, x["f1"]).otherwise(x["f0"]).alias("state"), (a["sum"] + F.when(a["state"] == 1, x["gain"]).otherwise(0.0)).alias("sum"))
    weight = F.aggregate(F.reverse("f.way"), F.struct(last.alias("state"), F.lit(0.0).alias("sum")), back, lambda a: F.greatest(a["sum"], F.lit(0.0)))
    return walked.select("term", weight.alias("burst"))


REPORTED, BURSTS, GAPS = 7, 5, 5


def report(found: DataFrame, burst: DataFrame, gap_pairs: DataFrame) -> DataFrame:
    """(section, rank, label, value): what an analysis tells: the strongest rises and falls, bursts and gaps.

    found is of trends(), which has left unspecific terms out, burst(term, burst) of all terms, and
    gap_pairs(a, b, z, similarity). Falls are the end of the list of rises, whether or not a term fell;
    gaps are pairs with fewer links than chance has, the most similar first. Values are rounded to six
    places before they are ranked.
    """
    rises = found.select("term", F.round("lift", 6).alias("lift"), F.round("log2_lift", 6).alias("value"))
    weights = burst.select("term", F.round("burst", 6).alias("value")).join(rises.select("term", "lift"), "term")
    pairs = gap_pairs.where("z < -2").select(F.concat_ws(" <-> ", F.col("a").cast("string"), F.col("b").cast("string")).alias("term"), "a", "b", F.round("similarity", 6).alias("value"))
    parts = [("rising", rises, [F.desc("lift"), "term"], REPORTED), ("declining", rises, ["lift", F.desc("term")], REPORTED), ("burst", weights, [F.desc("value"), F.desc("lift"), "term"], BURSTS), ("gap", pairs, [F.desc("value"), "a", "b"], GAPS)]
    out = None
    for name, rows, order, most in parts:
        first = rows.orderBy(*order).limit(most)
        ranked = first.select(F.lit(name).alias("section"), F.row_number().over(Window.orderBy(*order)).alias("rank"), F.col("term").alias("label"), "value")
        out = ranked if out is None else out.unionByName(ranked)
    return out
