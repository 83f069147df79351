"""Records: ordered dedupe, quotas, categories of keywords, changes to a corpus, fingerprints."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.normalize import contains_word, in_categories, slug
from ..session import cut_lineage
from .ranks import numbered, quantile_range, ranges_for

MAX_CATEGORIES, MIN_SHARE = 8, 0.05


class Seen:
    """What an ordered harvest has kept: ids, and slugs of titles that have one."""

    def __init__(self) -> None:
        self.ids: set[str] = set()
        self.slugs: set[str] = set()

    def admit(self, identifier: str, title_slug: str) -> bool:
        if identifier in self.ids or (title_slug and title_slug in self.slugs):
            return False
        self.ids.add(identifier)
        if title_slug:
            self.slugs.add(title_slug)
        return True


def dedupe(papers: DataFrame, rounds: int = 50) -> DataFrame:
    """papers(pos, id, title, ...) in order of pos without those whose id or title slug an earlier kept one has.

    A row falls only to a kept row, so each round settles rows: one that is first by id and by slug among
    the open rows is kept, and open rows that share either with a kept one fall. Groups are never collected.
    """
    keyed = papers.select("pos", "id", slug("title").alias("slug"))
    keyed = keyed.withColumn("slug", F.when(F.col("slug") == "", F.concat(F.lit("\x00"), F.col("pos").cast("string"))).otherwise(F.col("slug")))
    kept, still = None, cut_lineage(keyed)
    for _ in range(rounds):
        first_id = still.groupBy("id").agg(F.min("pos").alias("pos"))
        first_slug = still.groupBy("slug").agg(F.min("pos").alias("pos"))
        now = cut_lineage(still.join(first_id.select("pos"), "pos", "left_semi").join(first_slug.select("pos"), "pos", "left_semi"))
        kept = now if kept is None else kept.unionByName(now)
        still = cut_lineage(still.join(now.select("id"), "id", "left_anti").join(now.select("slug"), "slug", "left_anti").select("pos", "id", "slug"))
        if still.isEmpty():
            return papers.join(kept.select("pos"), "pos", "left_semi")
    raise RuntimeError("dedupe did not settle")


def quota_select(papers: DataFrame, keywords: list[str], categories: list[str], first: int, last: int, most: int) -> DataFrame:
    """(keyword, rank, id): a local harvest with equal shares for keywords and, within each, for years.

    Candidates are ranked by year, newest first, and each keyword and year is trimmed to 2 * share rows before
    they meet in the ordered fold. The trim comes before duplicates are settled, so a keyword whose first rows
    other keywords have taken can fall short of its share. What a year leaves unfilled goes to older years, not
    to other keywords.
    """
    words = keywords or [""]
    share = math.ceil(most / len(words))
    wanted = papers.where(F.year("published").between(first, last) & in_categories("categories", categories))
    text = F.concat_ws(" ", "title", "abstract")
    hits = F.filter(F.array(*[F.when(F.lit(True) if not w else contains_word(text, w), F.lit(i)) for i, w in enumerate(words)]), lambda x: x.isNotNull())
    rows = wanted.select("id", slug("title").alias("slug"), "published", F.year("published").alias("year"), F.explode(hits).alias("k"))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("k", "year").orderBy(F.desc("published"), F.desc("id")))).where(F.col("r") <= 2 * share)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        seen, out = Seen(), []
        for k in range(len(words)):
            room, kept = share, 0
            years = list(range(last, first - 1, -1))
            for i, year in enumerate(years):
                quota = math.ceil(room / (len(years) - i))
                part = pdf[(pdf["k"] == k) & (pdf["year"] == year)].sort_values(["r"])
                for x in part.itertuples():
                    if quota <= 0 or len(out) >= most:
                        break
                    if seen.admit(x.id, x.slug):
                        quota, room, kept = quota - 1, room - 1, kept + 1
                        out.append((words[k], kept, x.id))
        return pd.DataFrame(out, columns=["keyword", "rank", "id"])

    return rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fold, "keyword string, rank int, id string")


def keep(seen: Seen, page: Iterable[dict], most: int, held: list[dict], slug_of=None) -> list[dict]:
    """Adds a page of records to those held, in order, up to the most."""
    for record in page:
        if len(held) >= most:
            break
        if seen.admit(record["id"], slug_of(record["title"]) if slug_of else plain_slug(record["title"])):
            held.append(record)
    return held


def plain_slug(label: str) -> str:
    """slug() for a driver-side record."""
    joined = "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in label)
    return "-".join(joined.split())


def year_quotas(most: int, years: Iterable[int]) -> Iterator[tuple[int, int]]:
    """(year, quota), newest first, for a harvest that fills every quota."""
    order = sorted(years, reverse=True)
    left = most
    for i, year in enumerate(order):
        quota = math.ceil(left / (len(order) - i))
        yield year, quota
        left -= quota


def infer_categories(samples: DataFrame, depth: int = 50) -> DataFrame:
    """(rank, category, weight) for samples(keyword, rank, category): each keyword's first results vote with weight 1 in all.

    Categories below a twentieth of the live keywords' weight go; fewer than two left give none.
    """
    counts = samples.where((F.col("rank") <= depth) & F.col("category").isNotNull()).groupBy("keyword", "category").agg(F.count("*").alias("n"))
    share = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("keyword")))
    live = counts.agg(F.countDistinct("keyword").alias("live"))
    votes = share.groupBy("category").agg(F.round(F.sum("share"), 9).alias("weight")).join(F.broadcast(live)).where(F.col("weight") >= MIN_SHARE * F.col("live"))
    ranked = votes.select(F.row_number().over(Window.orderBy(F.desc("weight"), "category")).alias("rank"), "category", "weight", F.count("*").over(Window.partitionBy()).alias("n"))
    return ranked.where((F.col("rank") <= MAX_CATEGORIES) & (F.col("n") >= 2)).select("rank", "category", "weight")


def add_records(papers: DataFrame, fresh: DataFrame) -> DataFrame:
    """The rows of fresh whose id isn't in papers."""
    return fresh.join(papers.select("id"), "id", "left_anti")


def without_weakest(papers: DataFrame, degrees: DataFrame, share: float = 0.1) -> DataFrame:
    """papers without that share of documents of the lowest degree, earlier ones first among equals.

    Degrees are counted, and whole ones below the cut go; of the degree at the cut the earliest, numbered in
    ranges of pos.
    """
    n = papers.agg(F.floor(F.count("*") * share).alias("drop"))
    sizes = degrees.groupBy("degree").agg(F.count("*").alias("c"))
    cut = sizes.withColumn("before", F.sum("c").over(Window.orderBy("degree")) - F.col("c")).join(F.broadcast(n)).where("before < drop").select("degree", "before", "c", "drop")
    whole, at = cut.where("before + c <= drop"), cut.where("before + c > drop").first()
    weak = degrees.join(whole.select("degree"), "degree", "left_semi").select("pos")
    if at is not None:  # one degree
        edge = degrees.where(F.col("degree") == at.degree).select("pos")
        first = numbered(edge, "i", [], quantile_range(edge, "pos", ranges_for(at.c)), ["pos"]).where(F.col("i") <= at["drop"] - at.before)
        weak = weak.unionByName(first.select("pos"))
    return papers.join(weak, "pos", "left_anti")


def fingerprint(papers: DataFrame) -> DataFrame:
    """One row (fingerprint): 32 hex digits of the SHA-256 of the sorted ids, each followed by NUL.

    The ids meet in one cell, as the digest is defined over their concatenation; corpus_digest() is the
    form for corpora whose ids don't fit one.
    """
    ids = F.array_sort(F.collect_list("id"))
    return papers.agg(F.substring(F.sha2(F.array_join(F.transform(ids, lambda x: F.concat(x, F.lit("\x00"))), ""), 256), 1, 32).alias("fingerprint"))


def corpus_digest(papers: DataFrame) -> DataFrame:
    """One row (n, digest): an order-independent digest summed over tasks."""
    return papers.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("a"), F.sum(F.crc32("id")).alias("b")).select("n", F.sha2(F.concat_ws(":", "n", "a", "b"), 256).alias("digest"))
