"""Document graphs: nearest neighbours, mutual edges, co-occurrence, communities, centrality, bridges."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage, stored
from .blocks import chosen_products, nearest_pairs
from .index import TfIdf
from .packs import Packs, mark_sums, names_of, nearest, nearest_of, packs
from .ranks import numbered, quantile_range, ranges_for
from .search import adjacency, dense_pairs

K = 8
PROBE_TERMS, CANDIDATES = 24, 400
MIN_HUB, MAX_HUB = 2, 60
DAMPING = 0.85


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    """(src, dst, w): the best k of pairs(src, dst, w) by w rounded to six places, then dst."""
    rounded = pairs.select("src", "dst", F.round("w", 6).alias("w")).where("w > 0")
    ranked = rounded.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst")))
    return ranked.where(F.col("r") <= k).drop("r")


def exact_arcs(index: TfIdf, k: int = K) -> DataFrame:
    """The k most similar documents of each, over all pairs.

    Pairs are scored block by block and never become rows (see blocks.py); the arcs are written once, as their
    readers join them with themselves. The time grows with the square of the documents; where that is too much,
    pruned_arcs() bounds it.
    """
    pairs = nearest_pairs(index.weights.select("pos", "term", "w"), k)
    return stored(_nearest(pairs.select(F.col("q").alias("src"), F.col("pos").alias("dst"), F.col("score").alias("w")), k), "arcs")


def packed_arcs(index: Packs, k: int = K) -> DataFrame:
    """exact_arcs() of documents in packs."""
    return stored(_nearest(nearest(index, k).select(F.col("q").alias("src"), F.col("pos").alias("dst"), F.col("score").alias("w")), k), "arcs")


def pruned_arcs(index: TfIdf, k: int = K, probes: int = PROBE_TERMS, candidates: int = CANDIDATES) -> DataFrame:
    """The k most similar among the first candidates that share one of a document's heaviest terms, rare terms first."""
    heavy = index.weights.withColumn("r", F.row_number().over(Window.partitionBy("pos").orderBy(F.desc(F.round("w", 9)), "term"))).where(F.col("r") <= probes)
    probe = heavy.join(index.vocabulary.select("term", "df"), "term").select(F.col("pos").alias("src"), "term", "df")
    # lists come rare terms first; behind one that holds enough candidates by itself none is read
    probe = probe.withColumn("before", F.lag("df").over(Window.partitionBy("src").orderBy("df", "term"))).where(F.coalesce(F.col("before") <= candidates, F.lit(True))).drop("before")
    # and of a list only its first, the document itself and those of the lists before it included
    postings = index.weights.select(F.col("pos").alias("dst"), "term").withColumn("p", F.row_number().over(Window.partitionBy("term").orderBy("dst"))).where(F.col("p") <= candidates + 1)
    lists = postings.groupBy("term").agg(F.array_sort(F.collect_list("dst")).alias("list"))
    met = probe.join(lists, "term").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("df", "term", "list"))).alias("met"))
    others = F.array_remove(F.array_distinct(F.flatten(F.transform("met", lambda x: x["list"]))), F.col("src"))
    chosen = met.select(F.col("src").cast("bigint").alias("key"), F.slice(others, 1, candidates).cast("array<bigint>").alias("others"))
    found = chosen_products(index.weights.select("pos", "term", "w"), chosen, k)
    return stored(_nearest(found.select(F.col("q").alias("src"), F.col("pos").alias("dst"), F.col("score").alias("w")), k), "arcs")


def dense_arcs(vectors: DataFrame, k: int = K) -> DataFrame:
    """The k nearest of each of vectors(pos, v) by dot product, over all pairs; written once, as exact_arcs()."""
    found = dense_pairs(vectors, k)
    return stored(_nearest(found.select(F.col("q").alias("src"), F.col("pos").alias("dst"), F.col("score").alias("w")), k), "arcs")


def mutual_edges(arcs: DataFrame) -> DataFrame:
    """(a, b, w): a < b in each other's lists; w as a's list has it."""
    back = arcs.select(F.col("src").alias("b"), F.col("dst").alias("a"))
    return arcs.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), "w").join(back, ["a", "b"], "left_semi")


def edges_around(index: Packs, nodes: DataFrame, hops: int = 1, k: int = K) -> DataFrame:
    """(a, b, w): those edges of mutual_edges(packed_arcs(index, k)) that so many hops from nodes(pos) can take, and perhaps more.

    An edge hangs on the lists of its two ends alone. So only the lists of the nodes and of whom these name are
    searched, hop by hop, each among all documents; where that comes to half of all documents, all lists are made.
    """
    if not index.whole:
        raise ValueError("edges need all terms of the documents")
    arcs, known, seen = None, None, 0
    frontier = stored(nodes.select("pos").distinct(), "nodes")
    for _ in range(hops):
        for named in (False, True):
            wanted = arcs.join(frontier.select(F.col("pos").alias("src")), "src", "left_semi").select(F.col("dst").alias("pos")).distinct() if named else frontier
            wanted = stored(wanted if known is None else wanted.join(known, "pos", "left_anti"), "wanted")
            seen += wanted.count()
            if 2 * seen > index.n:
                return stored(mutual_edges(packed_arcs(index, k)), "edges")
            found = nearest_of(index, wanted, k).select(F.col("q").alias("src"), F.col("pos").alias("dst"), F.col("score").alias("w"))
            found = stored(_nearest(found, k), "arcs")
            arcs, known = (found, wanted) if arcs is None else (arcs.union(found), known.union(wanted))
        links = adjacency(mutual_edges(arcs)).join(frontier.select(F.col("pos").alias("src")), "src", "left_semi")
        frontier = stored(links.select(F.col("dst").alias("pos")).distinct(), "nodes")
    return stored(mutual_edges(arcs), "edges")


def one_way_arcs(arcs: DataFrame) -> DataFrame:
    """The arcs that aren't returned."""
    back = arcs.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    return arcs.join(back, ["src", "dst"], "left_anti")


def shared_membership(rows: DataFrame, least: int = MIN_HUB, most: int = MAX_HUB) -> DataFrame:
    """(a, b), a < b: groups that share a member; rows(pos, member). Members in fewer or more rows are left out."""
    count = rows.groupBy("member").agg(F.count("*").alias("n")).where(F.col("n").between(least, most)).select("member")
    kept = rows.join(count, "member")
    return kept.select("member", F.col("pos").alias("a")).join(kept.select("member", F.col("pos").alias("b")), "member").where("a < b").select("a", "b").distinct()


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(pos, degree) of all nodes(pos)."""
    count = adjacency(edges).groupBy("src").agg(F.count("*").alias("degree"))
    return nodes.select("pos").join(count, F.col("pos") == F.col("src"), "left").select("pos", F.coalesce("degree", F.lit(0)).alias("degree"))


def bridge_scores(communities: DataFrame, edges: DataFrame) -> DataFrame:
    """(pos, bridge): the share of a node's edge weight that leaves its community; communities(pos, community), -1 for none."""
    here = communities.select(F.col("pos").alias("src"), F.col("community").alias("cs"))
    there = communities.select(F.col("pos").alias("dst"), F.col("community").alias("cd"))
    arcs = adjacency(edges).join(here, "src").join(there, "dst")
    share = arcs.groupBy("src").agg((F.sum(F.when(F.col("cs") != F.col("cd"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("bridge"))
    return communities.select("pos").join(share, F.col("pos") == F.col("src"), "left").select("pos", F.coalesce("bridge", F.lit(0.0)).alias("bridge"))


def community_links(communities: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, n): edges between each two communities."""
    ends = communities.where("community >= 0")
    one = ends.select(F.col("pos").alias("a"), F.col("community").alias("ca"))
    two = ends.select(F.col("pos").alias("b"), F.col("community").alias("cb"))
    both = edges.select("a", "b").join(one, "a").join(two, "b").where("ca <> cb")
    return both.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.count("*").alias("n"))


def edge_recall(exact: DataFrame, pruned: DataFrame) -> DataFrame:
    """(exact, pruned, shared, recall): how many exact edges the pruned ones have."""
    shared = exact.select("a", "b").join(pruned.select("a", "b"), ["a", "b"], "left_semi")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    one = count(exact, "exact").join(count(pruned, "pruned")).join(count(shared, "shared"))
    return one.select("exact", "pruned", "shared", F.when(F.col("exact") > 0, F.col("shared") / F.col("exact")).otherwise(0.0).alias("recall"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, cut_every: int = 5) -> DataFrame:
    """(pos, rank) after so many rounds: unweighted, both ways, nodes without edges hand their rank to all."""
    arcs = cut_lineage(adjacency(edges).select("src", "dst"))
    total = nodes.agg(F.count("*").alias("n"))
    out = arcs.groupBy("src").agg(F.count("*").alias("out"))
    base = nodes.select("pos").join(out, F.col("pos") == F.col("src"), "left").select("pos", "out").join(F.broadcast(total))
    ranks = base.select("pos", "out", "n", (1 / F.col("n")).alias("rank"))
    for i in range(rounds):
        loose = ranks.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0)).alias("loose"))
        sent = ranks.where("out is not null").join(arcs, F.col("pos") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        new = (1 - DAMPING) / F.col("n") + DAMPING * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / F.col("n"))
        ranks = base.join(sent, F.col("pos") == F.col("dst"), "left").join(F.broadcast(loose)).select("pos", "out", "n", new.alias("rank"))
        if (i + 1) % cut_every == 0:
            ranks = cut_lineage(ranks)
    return ranks.select("pos", "rank")


def _modularity_pass(graph: list[dict[int, float]], loops: list[float], total: float) -> list[int]:
    """Moves nodes in order to the neighbouring community of the largest gain until none moves."""
    n = len(graph)
    strength = [sum(x.values()) + 2 * loops[i] for i, x in enumerate(graph)]
    community, weight = list(range(n)), strength[:]
    moved = True
    while moved:
        moved = False
        for i in range(n):
            old = community[i]
            weight[old] -= strength[i]
            near: dict[int, float] = {}
            for j, w in graph[i].items():
                near[community[j]] = near.get(community[j], 0.0) + w
            best, gain = old, near.get(old, 0.0) - weight[old] * strength[i] / (2 * total)
            for c in sorted(near):
                now = near[c] - weight[c] * strength[i] / (2 * total)
                if now > gain + 1e-12:
                    best, gain = c, now
            weight[best] += strength[i]
            if best != old:
                community[i], moved = best, True
    return community


def louvain(edges: list[tuple[int, int, float]]) -> dict[int, int]:
    """Communities of a weighted undirected graph at resolution 1, in a fixed order of nodes."""
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    number = {x: i for i, x in enumerate(nodes)}
    graph: list[dict[int, float]] = [{} for _ in nodes]
    for a, b, w in edges:
        i, j = number[a], number[b]
        graph[i][j] = graph[i].get(j, 0.0) + w
        graph[j][i] = graph[j].get(i, 0.0) + w
    total = sum(w for _, _, w in edges)
    loops, member = [0.0] * len(nodes), list(range(len(nodes)))
    while graph and total > 0:
        found = _modularity_pass(graph, loops, total)
        names = {c: i for i, c in enumerate(dict.fromkeys(found))}
        found = [names[c] for c in found]
        member = [found[m] for m in member]
        if len(names) == len(graph):
            break
        joined: list[dict[int, float]] = [{} for _ in names]
        inner = [0.0] * len(names)
        for i, x in enumerate(graph):
            inner[found[i]] += loops[i]
            for j, w in x.items():
                if found[i] == found[j]:
                    inner[found[i]] += w / 2
                else:
                    joined[found[i]][found[j]] = joined[found[i]].get(found[j], 0.0) + w
        graph, loops = joined, inner
    return {x: member[i] for x, i in number.items()}


def modularity(edges: list[tuple[int, int, float]], community: dict[int, int]) -> float:
    total = sum(w for _, _, w in edges)
    inside, strength = 0.0, {}
    for a, b, w in edges:
        inside += w * (community[a] == community[b])
        for x in (a, b):
            strength[community[x]] = strength.get(community[x], 0.0) + w
    return inside / total - sum((s / (2 * total)) ** 2 for s in strength.values()) if total else 0.0


def detect_communities(nodes: DataFrame, edges: DataFrame, least: int | None = None) -> DataFrame:
    """(pos, community): 0 the largest, then by size and least member; -1 below the least size or without edges.

    Moving nodes one by one is sequential, so the backbone (at most K edges a node) is one group in one
    task; everything around it is relational.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = louvain(sorted(zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["w"].tolist(), strict=True)))
        return pd.DataFrame({"pos": list(found), "part": list(found.values())}, dtype="int64")

    parts = edges.select("a", "b", "w", F.lit(0).alias("all")).groupBy("all").applyInPandas(run, "pos bigint, part bigint")
    floor = F.lit(least) if least is not None else F.greatest(F.lit(10), F.floor(F.col("n") / 500))
    sizes = parts.groupBy("part").agg(F.count("*").alias("size"), F.min("pos").alias("first")).join(F.broadcast(nodes.agg(F.count("*").alias("n")))).where(F.col("size") >= floor)
    ranked = sizes.withColumn("community", (F.row_number().over(Window.orderBy(F.desc("size"), "first")) - 1).cast("int")).select("part", "community")
    return nodes.select("pos").join(parts.join(F.broadcast(ranked), "part").select("pos", "community"), "pos", "left").select("pos", F.coalesce("community", F.lit(-1)).alias("community"))


def centroids(index: TfIdf, communities: DataFrame) -> DataFrame:
    """(community, term, w): the mean vector of each community's members."""
    members = communities.where("community >= 0")
    sizes = members.groupBy("community").agg(F.count("*").alias("size"))
    summed = index.weights.join(members, "pos").groupBy("community", "term").agg(F.sum("w").alias("sum"))
    return summed.join(F.broadcast(sizes), "community").select("community", "term", (F.col("sum") / F.col("size")).alias("w"))


def packed_centroids(papers: DataFrame) -> DataFrame:
    """centroids() of papers(pos, abstract, mark) by their marks: (community, term, w, at), terms as hashes, at a paper that has the term."""
    sizes = papers.where("mark >= 0").groupBy("mark").agg(F.count("*").alias("size"))
    found = mark_sums(packs(papers, rare=False, named=True))
    return found.join(F.broadcast(sizes), "mark").select(F.col("mark").alias("community"), "term", (F.col("sum") / F.col("size")).alias("w"), "at")


def packed_top_terms(centroid: DataFrame, papers: DataFrame, n: int = 6) -> DataFrame:
    """top_terms() of packed_centroids(papers): terms that may be among the heaviest are read again where they stand."""
    rounded = centroid.select("community", F.col("term").alias("hash"), F.round("w", 6).alias("w"), "at")
    best = stored(rounded.withColumn("r", F.rank().over(Window.partitionBy("community").orderBy(F.desc("w")))).where(F.col("r") <= n).drop("r"), "best")
    return top_terms(best.join(names_of(papers, best), "hash"), n)


def top_terms(centroid: DataFrame, n: int = 6) -> DataFrame:
    """(community, rank, term, w): the heaviest terms of each."""
    rounded = centroid.select("community", "term", F.round("w", 6).alias("w"))
    ranked = rounded.withColumn("rank", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("w"), "term")))
    return ranked.where(F.col("rank") <= n).select("community", "rank", "term", "w")


def community_labels(centroid: DataFrame, communities: DataFrame) -> DataFrame:
    """(community, size, label): the first three terms name a community."""
    return labels_of(top_terms(centroid, 3), communities)


def labels_of(top: DataFrame, communities: DataFrame) -> DataFrame:
    """community_labels() from top_terms()."""
    label = top.where("rank <= 3").groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " ").alias("label"))
    sizes = communities.where("community >= 0").groupBy("community").agg(F.count("*").alias("size"))
    return sizes.join(label, "community", "left").select("community", "size", F.coalesce("label", F.lit("")).alias("label"))


def centroid_cosine(centroid: DataFrame) -> DataFrame:
    """(a, b, cosine) of all pairs of communities that share a term."""
    norm = centroid.groupBy("community").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = centroid.join(F.broadcast(norm), "community").where("norm > 0").select("community", "term", (F.col("w") / F.col("norm")).alias("w"))
    a = unit.select(F.col("community").alias("a"), "term", F.col("w").alias("wa"))
    b = unit.select(F.col("community").alias("b"), "term", F.col("w").alias("wb"))
    return a.join(b, "term").where("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))


def gaps(communities: DataFrame, edges: DataFrame, cosine: DataFrame, permutations: int = 200) -> DataFrame:
    """(a, b, observed, mean, std, z, similarity) of all pairs of communities.

    The null shuffles the communities over the nodes that have one: in each permutation the nodes are
    ordered by the first 48 bits of md5(pos:permutation) and take the labels in order of pos. The nodes'
    orders are made once and joined to the edges, a row for each edge and permutation.
    """
    spark = communities.sparkSession
    members = communities.where("community >= 0").select("pos", "community")
    inner = edges.select("a", "b").join(members.select(F.col("pos").alias("a")), "a", "left_semi").join(members.select(F.col("pos").alias("b")), "b", "left_semi")
    perms = spark.range(permutations).select(F.col("id").alias("p"))
    keyed = members.crossJoin(F.broadcast(perms)).withColumn("h", F.conv(F.substring(F.md5(F.concat_ws(":", F.col("pos").cast("string"), F.col("p").cast("string"))), 1, 12), 16, 10).cast("bigint"))
    # the hash is spread evenly, so its first bits are ranges of its order
    count = members.count()
    bits = (ranges_for(count) - 1).bit_length()
    place = numbered(keyed, "i", ["p"], F.shiftright("h", 48 - bits), ["h", "pos"]).select("p", "pos", "i")
    label = numbered(members, "i", [], quantile_range(members, "pos", ranges_for(count)), ["pos"]).select("community", "i")
    shuffled = place.join(label, "i").select("p", "pos", "community")
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    one = shuffled.select("p", F.col("pos").alias("a"), F.col("community").alias("ca"))
    two = shuffled.select(F.col("p").alias("p2"), F.col("pos").alias("b2"), F.col("community").alias("cb"))
    null = inner.join(one, "a").join(two, (F.col("p") == F.col("p2")) & (F.col("b") == F.col("b2"))).where("ca <> cb").groupBy("p", *pair(F.col("ca"), F.col("cb"))).agg(F.count("*").alias("c"))
    # a pair without edges in a permutation counts as 0
    moments = null.groupBy("a", "b").agg((F.sum("c") / permutations).alias("mean"), (F.sum(F.col("c") * F.col("c")) / permutations).alias("square"))
    names = members.select("community").distinct()
    pairs = names.select(F.col("community").alias("a")).join(names.select(F.col("community").alias("b")), F.col("a") < F.col("b"))
    observed = community_links(communities, edges).select("a", "b", F.col("n").alias("observed"))
    full = pairs.join(observed, ["a", "b"], "left").join(moments, ["a", "b"], "left").join(cosine, ["a", "b"], "left").na.fill(0, ["observed"]).na.fill(0.0, ["mean", "square", "cosine"])
    std = F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    full = full.withColumn("std", F.round(std, 9))
    z = F.when(F.col("std") > 0, (F.col("observed") - F.col("mean")) / F.col("std")).otherwise(0.0)
    return full.select("a", "b", "observed", "mean", "std", z.alias("z"), F.col("cosine").alias("similarity"))


def gap_nodes(gap_pairs: DataFrame, communities: DataFrame, bridge: DataFrame, pairs: int, limit: int) -> DataFrame:
    """(pos, bridge): bridging documents of the communities in the most similar gap pairs."""
    top = gap_pairs.where("z < -2").orderBy(F.desc(F.round("similarity", 6)), "a", "b").limit(pairs)
    wanted = top.select(F.explode(F.array("a", "b")).alias("community")).distinct()
    found = communities.join(F.broadcast(wanted), "community", "left_semi").join(bridge.select("pos", F.round("bridge", 6).alias("bridge")), "pos").where("bridge > 0")
    return found.orderBy(F.desc("bridge"), "pos").limit(limit).select("pos", "bridge")
