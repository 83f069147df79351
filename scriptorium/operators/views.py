"""Views of the graph: snapshot nodes and edges, their batches, listings, adjacency and layout."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.normalize import slug
from .search import adjacency

LIMIT, CHUNK, FRAME, STREAMED = 4000, 25, 120, 400
MIN_FIELD = 400


def snapshot_nodes(papers: DataFrame, ranks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(pos, ord, id): the documents of the highest rank, each with a unique slug of its title.

    Equal slugs are numbered -2, -3, ... in order; a number that is some title's own slug is skipped by
    numbering again, at most limit rows being left by then.
    """
    r = ranks.select("pos", F.round("rank", 9).alias("rank")).orderBy(F.desc("rank"), "pos").limit(limit)
    top = papers.join(F.broadcast(r), "pos").withColumn("ord", F.row_number().over(Window.orderBy(F.desc("rank"), "pos")))
    named = top.select("pos", "ord", F.when(slug("title") == "", "untitled").otherwise(slug("title")).alias("slug"))
    own = named.select(F.col("slug").alias("taken")).distinct()
    numbered = named.withColumn("i", F.row_number().over(Window.partitionBy("slug").orderBy("ord")))
    # the i-th of a slug takes the (i-1)-th free number from 2 on
    most = numbered.groupBy("slug").agg(F.max("i").alias("m"))
    free = most.where("m > 1").join(own.select(F.regexp_extract("taken", "^(.*)-([0-9]+)$", 1).alias("slug"), F.try_to_number(F.regexp_extract("taken", "^(.*)-([0-9]+)$", 2), F.lit("999999999")).cast("int").alias("used")).where("slug <> '' and used is not null").groupBy("slug").agg(F.collect_set("used").alias("used")), "slug", "left")
    free = free.select("slug", F.filter(F.sequence(F.lit(2), F.col("m") + 1 + F.coalesce(F.size("used"), F.lit(0))), lambda x: ~F.coalesce(F.array_contains("used", x), F.lit(False))).alias("free"))
    out = numbered.join(free, "slug", "left")
    return out.select("pos", "ord", F.when(F.col("i") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", F.element_at("free", F.greatest(F.col("i") - 1, F.lit(1))).cast("string"))).alias("id"))


def snapshot_edges(nodes: DataFrame, edges: DataFrame, arcs: DataFrame, shared: DataFrame) -> DataFrame:
    """(src, dst, relation) between nodes(pos): similar-to, co-authored-with, and nearest-to for arcs not returned."""
    back = arcs.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    one_way = arcs.select("src", "dst").join(back, ["src", "dst"], "left_anti")
    every = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(0).alias("kind"))
    every = every.union(shared.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1).alias("kind"))).union(one_way.select("src", "dst", F.lit(2).alias("kind")))
    inside = nodes.select("pos")
    kept = every.join(inside.withColumnRenamed("pos", "src"), "src", "left_semi").join(inside.withColumnRenamed("pos", "dst"), "dst", "left_semi").where("src <> dst")
    # the first relation of a pair wins, but nearest-to has names of its own
    first = kept.withColumn("own", F.col("kind") == 2).withColumn("r", F.row_number().over(Window.partitionBy("src", "dst", "own").orderBy("kind"))).where("r = 1")
    names = F.array(F.lit("similar-to"), F.lit("co-authored-with"), F.lit("nearest-to"))
    return first.select("src", "dst", F.element_at(names, F.col("kind") + 1).alias("relation"))


def concept_members(nodes: DataFrame, communities: DataFrame, members: int = 12) -> DataFrame:
    """(community, rank, pos): the first members of each community among nodes(pos, ord)."""
    ranked = nodes.join(communities.where("community >= 0"), "pos").withColumn("rank", F.row_number().over(Window.partitionBy("community").orderBy("ord")))
    return ranked.where(F.col("rank") <= members).select("community", "rank", "pos")


def concept_nodes(nodes: DataFrame, terms: DataFrame, members: DataFrame) -> DataFrame:
    """(id, label, community): a node for each of terms(community, rank, term), six at most, whose community has members.

    An id is the term's slug, or that with the next number from 2 on that neither an id of nodes(id) nor
    another term's slug takes; numbers are given in order of community and rank, also to terms left out.
    """
    wanted = terms.where("rank <= 6").select("community", "rank", "term", F.when(slug("term") == "", "untitled").otherwise(slug("term")).alias("slug"))
    numbered = wanted.withColumn("i", F.row_number().over(Window.partitionBy("slug").orderBy("community", "rank")))
    most = numbered.groupBy("slug").agg(F.max("i").alias("m"))
    ids, slugs = nodes.select(F.col("id").alias("name")), most.select(F.col("slug").alias("name"))
    # ids that a slug may meet: its own and those with a number behind it
    met = ids.union(slugs).distinct().select(F.explode(F.array("name", F.regexp_extract("name", "^(.*)-[0-9]+$", 1))).alias("slug")).groupBy("slug").agg(F.count("*").alias("taken"))
    tries = most.join(met, "slug").select("slug", F.explode(F.sequence(F.lit(1), (F.col("m") + F.col("taken")).cast("int"))).alias("k"))
    tries = tries.withColumn("name", F.when(F.col("k") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", F.col("k").cast("string"))))
    free = tries.join(ids, "name", "left_anti").join(slugs.withColumn("k2", F.lit(True)), "name", "left").where("k = 1 or k2 is null")
    free = free.select("slug", F.col("name").alias("id"), F.row_number().over(Window.partitionBy("slug").orderBy("k")).alias("i"))
    return numbered.join(free, ["slug", "i"]).join(members.select("community"), "community", "left_semi").select("id", F.col("term").alias("label"), "community")


def appears_in(concepts: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst): an edge from each of concepts(id, community) to each document of members(community, pos), by ids of nodes(pos, id)."""
    named = members.select("community", "pos").join(nodes.select("pos", F.col("id").alias("dst")), "pos")
    return concepts.select(F.col("id").alias("src"), "community").join(named, "community").where("src <> dst").select("src", "dst")


def label_matches(labels: DataFrame, asked: str) -> DataFrame:
    """The rows of labels(label) whose label holds what is asked, in any case; a blank question matches all."""
    return labels.where(F.lower("label").contains(asked.strip().lower()))


def cooccurrence(concepts: DataFrame) -> DataFrame:
    """(a, b, weight): concepts(concept, pos) that share members, at most a dozen each."""
    one, two = concepts.select(F.col("concept").alias("a"), "pos"), concepts.select(F.col("concept").alias("b"), "pos")
    return one.join(two, "pos").where("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))


def delta_batches(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, batch, frame): edges(src, dst) with the chunk of nodes(pos, ord) after which they can be sent.

    An edge goes with its target's chunk, if the source's came no later; others are never sent.
    """
    chunk = nodes.where(F.col("ord") <= STREAMED).select("pos", F.floor((F.col("ord") - 1) / CHUNK).cast("int").alias("chunk"))
    one = chunk.select(F.col("pos").alias("src"), F.col("chunk").alias("cs"))
    two = chunk.select(F.col("pos").alias("dst"), F.col("chunk").alias("batch"))
    sent = edges.select("src", "dst").join(F.broadcast(one), "src").join(F.broadcast(two), "dst").where("cs <= batch")
    r = F.row_number().over(Window.partitionBy("batch").orderBy("src", "dst"))
    return sent.select("src", "dst", "batch", F.floor((r - 1) / FRAME).cast("int").alias("frame"))


def community_listing(communities: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(community, size, label, included): communities with how many of their members are in the snapshot."""
    inside = nodes.select("pos").join(communities.where("community >= 0"), "pos").groupBy("community").agg(F.count("*").alias("included"))
    return labels.join(inside, "community", "left").select("community", "size", "label", F.coalesce("included", F.lit(0)).alias("included"))


def adjacency_lists(edges: DataFrame) -> DataFrame:
    """(pos, rank, other, w): each node's neighbours, heaviest first."""
    rounded = adjacency(edges).select(F.col("src").alias("pos"), F.col("dst").alias("other"), F.round("w", 6).alias("w"))
    return rounded.withColumn("rank", F.row_number().over(Window.partitionBy("pos").orderBy(F.desc("w"), "other")))


def focus_roles(arcs: DataFrame) -> DataFrame:
    """(pos, other, role): what a neighbour is to a node: out, in, or mutual if it is both."""
    both = arcs.select(F.col("src").alias("pos"), F.col("dst").alias("other"), F.lit("out").alias("role")).union(arcs.select(F.col("dst").alias("pos"), F.col("src").alias("other"), F.lit("in").alias("role")))
    return both.groupBy("pos", "other").agg(F.when(F.countDistinct("role") > 1, "mutual").otherwise(F.min("role")).alias("role"))


def field_map(labels: DataFrame, links: DataFrame, least: int = MIN_FIELD) -> tuple[DataFrame, DataFrame]:
    """The large communities with their radius, and the links among them at the median count or above."""
    fields = labels.where(F.col("size") >= least).withColumn("radius", 12 + 34 * F.sqrt(F.col("size") / F.max("size").over(Window.partitionBy())))
    inside = fields.select("community")
    kept = links.join(inside.withColumnRenamed("community", "a"), "a", "left_semi").join(inside.withColumnRenamed("community", "b"), "b", "left_semi")
    ranked = kept.withColumn("i", F.row_number().over(Window.orderBy("n", "a", "b")) - 1).withColumn("half", F.floor(F.count("*").over(Window.partitionBy()) / 2))
    median = ranked.where("i = half").select(F.col("n").alias("median"))
    return fields.select("community", "size", "radius"), kept.join(F.broadcast(median)).where("n >= median").select("a", "b", "n")


# The circle that a map starts from, its steps, and the forces among its fields.
CIRCLE, STEPS, MARGIN, PUSH, PULL, LONGEST, PACE = 300.0, 400, 24.0, 60.0, 6.0, 40.0, 0.35
#: Fields of a map; a map of more can't be read, and its steps grow with their square.
MAX_FIELDS = 400


def field_layout(fields: DataFrame, links: DataFrame, steps: int = STEPS) -> DataFrame:
    """(community, x, y) of the fields(community, size, radius) and links(a, b, n) of a map.

    Fields start on a circle, the largest first; in every step all push each other apart, links pull, and the
    step grows shorter. The fields of one map, MAX_FIELDS at most, are one row, and the steps are a fold over it.
    """
    ordered = lambda name: F.transform("fields", lambda f: f[name])
    row = fields.agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("o"), F.col("community").cast("bigint").alias("community"), F.col("radius").alias("r")))).alias("fields"))
    row = row.where(F.size("fields") > 0).select(F.when(F.size("fields") > MAX_FIELDS, F.raise_error(F.lit(f"a map has {MAX_FIELDS} fields at most"))).otherwise(F.col("fields")).alias("fields"))
    tied = links.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")))).alias("links"))
    row = row.crossJoin(tied).select(ordered("community").alias("ids"), ordered("r").alias("r"), F.size("fields").alias("c"), "links")  # a row each
    place = lambda x: (F.array_position("ids", x) - 1).cast("int")
    most = F.greatest(F.lit(1), F.aggregate("links", F.lit(1).cast("bigint"), lambda a, e: F.greatest(a, -e["o"]))).cast("double")
    row = row.select("ids", "r", "c", F.transform("links", lambda e: F.struct(place(e["a"]).alias("s"), place(e["b"]).alias("t"), (-e["o"] / most).alias("share"))).alias("links"))
    row = row.withColumn("links", F.filter("links", lambda e: (e["s"] >= 0) & (e["t"] >= 0)))
    numbers = F.sequence(F.lit(0), F.col("c") - 1)
    turn = lambda i: (i / F.col("c")) * math.pi * 2
    spot = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    start = F.transform(numbers, lambda i: spot(F.cos(turn(i)) * CIRCLE, F.sin(turn(i)) * CIRCLE))

    def moved(spots: Column, step: Column) -> Column:
        cool = 1 - step / float(steps)

        def force(p: Column, i: Column) -> Column:
            def pushed(f: Column, j: Column) -> Column:
                q = F.get(spots, j)
                away = lambda v: F.get(F.transform(F.array(v), lambda d: spot(f["x"] + d["x"] / F.sqrt(d["d2"]) * d["push"], f["y"] + d["y"] / F.sqrt(d["d2"]) * d["push"])), F.lit(0))
                room = F.get("r", i) + F.get("r", j) + MARGIN
                gap = lambda d: (d["x"] * d["x"] + d["y"] * d["y"])
                apart = spot(p["x"] - q["x"], p["y"] - q["y"])
                # fields on one spot part along a fixed line
                nudged = F.transform(F.array(apart), lambda d: F.when(gap(d) < 1, F.struct((i - j).cast("double").alias("x"), F.when(i < j, 1.0).otherwise(-1.0).alias("y"), F.lit(2.0).alias("d2"))).otherwise(F.struct(d["x"].alias("x"), d["y"].alias("y"), gap(d).alias("d2"))))
                ready = F.get(F.transform(nudged, lambda d: F.struct(d["x"].alias("x"), d["y"].alias("y"), d["d2"].alias("d2"), (room * room * PUSH / d["d2"]).alias("push"))), F.lit(0))
                return F.when(i == j, f).otherwise(away(ready))

            def pulled(f: Column, e: Column) -> Column:
                a, b = F.get(spots, e["s"]), F.get(spots, e["t"])
                line = spot(b["x"] - a["x"], b["y"] - a["y"])
                far = lambda d: F.sqrt(d["x"] * d["x"] + d["y"] * d["y"])
                sized = F.transform(F.array(line), lambda d: F.struct(d["x"].alias("x"), d["y"].alias("y"), F.when(far(d) == 0, 1.0).otherwise(far(d)).alias("d")))
                tug = F.get(F.transform(sized, lambda d: spot(d["x"] / d["d"] * (d["d"] * e["share"] / PULL), d["y"] / d["d"] * (d["d"] * e["share"] / PULL))), F.lit(0))
                return F.when(e["s"] == i, spot(f["x"] + tug["x"], f["y"] + tug["y"])).when(e["t"] == i, spot(f["x"] - tug["x"], f["y"] - tug["y"])).otherwise(f)

            zero = spot(F.lit(0.0), F.lit(0.0))
            return F.aggregate("links", F.aggregate(numbers, zero, pushed), pulled)

        def stepped(p: Column, i: Column) -> Column:
            def go(f: Column) -> Column:
                size = F.sqrt(f["x"] * f["x"] + f["y"] * f["y"])
                length = F.least(F.lit(LONGEST), size) * cool * PACE
                unit = F.when(size == 0, 1.0).otherwise(size)
                return spot(p["x"] + f["x"] / unit * length, p["y"] + f["y"] / unit * length)

            return F.get(F.transform(F.array(force(p, i)), go), F.lit(0))

        return F.transform(spots, stepped)

    ended = row.select("ids", F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), start, moved).alias("spots"))
    return ended.select(F.explode(F.arrays_zip("ids", "spots")).alias("z")).select(F.col("z.ids").alias("community"), F.col("z.spots.x").alias("x"), F.col("z.spots.y").alias("y"))


def display_label(terms):
    """A community's name of two terms: the first, and the first other without a word of it."""
    head = F.element_at(terms, 1)
    unrelated = F.filter(F.slice(terms, 2, F.greatest(F.size(terms), F.lit(1))), lambda t: ~F.arrays_overlap(F.split(t, "[ -]"), F.split(head, "[ -]")) & ~t.contains(head) & ~head.contains(t))
    return F.when(F.size(unrelated) > 0, F.concat_ws(" / ", head, F.element_at(unrelated, 1))).otherwise(head)
