"""Context sets under a budget of words, and the conversation around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.normalize import squash_ends
from .search import RRF, adjacency

BUDGET = 1500
HOP_DECAY = 0.9
MAX_MESSAGES, MAX_CHARS = 40, 4000


def hop_scores(seeds: DataFrame, edges: DataFrame | None, hops: int) -> DataFrame:
    """(q, pos, score, via_graph) of seeds(q, rank, pos): each hop passes 0.9 of a score on, larger scores win."""
    score = seeds.select("q", "pos", F.round(1 / (RRF + F.col("rank")), 12).alias("score"), F.lit(False).alias("via_graph"))
    frontier = score.select("q", "pos", "score")
    for _ in range(hops if edges is not None else 0):
        passed = frontier.join(adjacency(edges), F.col("pos") == F.col("src")).groupBy("q", F.col("dst").alias("pos")).agg(F.round(F.max("score") * HOP_DECAY, 12).alias("got"))
        merged = score.join(passed, ["q", "pos"], "full")
        better = F.col("got").isNotNull() & (F.col("score").isNull() | (F.col("got") > F.col("score")))
        merged = merged.select("q", "pos", F.when(better, F.col("got")).otherwise(F.col("score")).alias("score"), F.coalesce("via_graph", F.lit(True)).alias("via_graph"), better.alias("fresh"))
        score, frontier = merged.drop("fresh"), merged.where("fresh").select("q", "pos", "score")
    return score


_ITEM = "array<struct<neg:double,pos:bigint,words:int,via_graph:boolean>>"


def _admitted(ordered: Column, budget: int, first_spent: Column, stop_early: bool) -> Column:
    """The items of an ordered array that fit, one after another."""
    begin = F.struct(first_spent.cast("bigint").alias("spent"), F.lit(False).alias("stopped"), F.array().cast(_ITEM).alias("picked"))

    def step(a: Column, x: Column) -> Column:
        over = a["spent"] + x["words"] > budget
        full = a["stopped"] | (over & (a["spent"] >= budget * 9 // 10)) if stop_early else a["stopped"]
        take = ~full & ~over
        return F.struct(F.when(take, a["spent"] + x["words"]).otherwise(a["spent"]).alias("spent"), full.alias("stopped"), F.when(take, F.concat(a["picked"], F.array(x))).otherwise(a["picked"]).alias("picked"))

    return F.aggregate(ordered, begin, step, lambda a: a["picked"])


def assemble(scores: DataFrame, words: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(q, ord, pos, words, via_graph): documents in order of score while they fit; words(pos, words).

    One that is too long is passed over, unless nine tenths of the budget are spent: then the set is full.
    A query's candidates are bounded by the depth of the search and its hops.
    """
    budget = budget if budget > 0 else BUDGET
    rows = scores.join(words, "pos").groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), F.col("pos").cast("bigint").alias("pos"), F.col("words").cast("int").alias("words"), "via_graph"))).alias("order"))
    picked = rows.select("q", F.posexplode(_admitted(F.col("order"), budget, F.lit(0), True)).alias("i", "x"))
    return picked.select("q", (F.col("i") + 1).alias("ord"), "x.pos", "x.words", "x.via_graph")


def pin(context: DataFrame, pins: DataFrame, words: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The context with pins(q, pos) in first place; the rest follows in order while it fits."""
    own = pins.select("q", F.col("pos").cast("bigint").alias("pinned")).join(words.select(F.col("pos").alias("pinned"), F.col("words").cast("int").alias("pw")), "pinned")
    rest = context.join(pins.select("q", "pos"), ["q", "pos"], "left_anti").groupBy("q").agg(F.array_sort(F.collect_list(F.struct(F.col("ord").cast("double").alias("neg"), F.col("pos").cast("bigint").alias("pos"), F.col("words").cast("int").alias("words"), "via_graph"))).alias("order"))
    both = own.join(rest, "q", "left").withColumn("order", F.coalesce("order", F.array().cast(_ITEM)))
    fits = F.concat(F.array(F.struct(F.lit(0.0).alias("neg"), F.col("pinned").alias("pos"), F.col("pw").alias("words"), F.lit(False).alias("via_graph"))), _admitted(F.col("order"), budget, F.col("pw"), False))
    return both.select("q", F.posexplode(fits).alias("i", "x")).select("q", (F.col("i") + 1).alias("ord"), "x.pos", "x.words", "x.via_graph")


def sources_block(context: DataFrame, papers: DataFrame) -> DataFrame:
    """(q, block): the numbered titles and abstracts of each context set."""
    rows = context.join(papers.select("pos", "title", "abstract"), "pos")
    line = F.format_string("[%d] %s\n%s\n\n", F.col("ord"), F.col("title"), F.col("abstract"))
    return rows.groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "").alias("block"))


def retrieval_queries(turns: DataFrame) -> DataFrame:
    """(conv_id, query): the last user turn; after an answered one, that turn and a line break come first.

    turns(conv_id, turn, role, text).
    """
    by = Window.partitionBy("conv_id").orderBy("turn")
    users = turns.withColumn("answers", F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).over(by)).where("role = 'user'")
    users = users.withColumn("before", F.lag("text").over(by)).withColumn("seen", F.lag("answers").over(by)).withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    follow = F.col("before").isNotNull() & (F.col("answers") > F.col("seen"))
    return users.where("r = 1").select("conv_id", F.when(follow, F.concat("before", F.lit("\n"), "text")).otherwise(F.col("text")).alias("query"))


def history(turns: DataFrame, n: int = 6) -> DataFrame:
    """(conv_id, turn, role, text): all turns but the last, the latest n of them."""
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("r", r).where(F.col("r").between(2, n + 1)).select("conv_id", "turn", "role", "text")


def valid_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, valid): 1 to 40 turns of user or assistant, each 1 to 4000 characters, the last the user's."""
    good = F.col("role").isin("user", "assistant") & (squash_ends(F.coalesce("text", F.lit(""))) != "") & (F.length("text") <= MAX_CHARS)
    found = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.min(F.coalesce(good, F.lit(False))).alias("good"), F.max_by("role", "turn").alias("last"))
    return found.select("conv_id", F.coalesce((F.col("n") <= MAX_MESSAGES) & F.col("good") & (F.col("last") == "user"), F.lit(False)).alias("valid"))
