import hashlib
import math

import pytest
from helpers import rows
from pyspark.sql import functions as F

from scriptorium.operators import analytics as A
from scriptorium.operators import context as C
from scriptorium.operators import evaluation as E
from scriptorium.operators import graph as G
from scriptorium.operators import index as I
from scriptorium.operators import records as R
from scriptorium.operators import search as S


def corpus(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "pos bigint, abstract string")


def star(spark, hub, spokes):
    return spark.createDataFrame([(min(hub, s), max(hub, s), 1.0) for s in spokes], "a bigint, b bigint, w double")


def seeds(spark):
    return spark.createDataFrame([(0, i + 1, i) for i in range(20)], "q bigint, rank int, pos bigint")


def test_expansion_never_displaces_the_top(spark):
    got = [r.pos for r in S.expand(seeds(spark), star(spark, 0, [1, 2, 3, 4, 5, 15, 16, 17, 18, 19]), 10).orderBy("rank").collect()]
    assert got[0] == 0
    got = [r.pos for r in S.expand(seeds(spark), star(spark, 0, [99]), 10).orderBy("rank").collect()]
    assert got[0] == 0 and 99 in got


def test_ladder(spark):
    papers = corpus(spark, ["solar cells absorb light", "wind turbines turn", "solar wind"])
    e = S.Engine(I.build_inverted(papers))
    assert (e.tier(), e.default_method()) == ("T0", "t0")
    q = spark.createDataFrame([(1, "solar cells")], "q bigint, text string")
    assert rows(e.search("bm25", q, 5).select("pos")) == rows(e.search("t0", q, 5).select("pos"))
    assert S.Engine(e.inverted, I.build_tfidf(papers, min_df=1)).tier() == "T1"
    assert [r.pos for r in S.Engine(e.inverted, None, I.build_bm25(papers)).search("bm25", q, 1).collect()] == [0]


def test_dense_search(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "pos bigint, v array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "q bigint, v array<float>")
    assert [(r.pos, r.score) for r in S.dense_search(v, q, 3).orderBy("rank").collect()] == [(0, 1.0), (1, 0.0), (2, -1.0)]
    with pytest.raises(Exception, match="differ in length"):
        S.dense_search(v, spark.createDataFrame([(7, [1.0])], "q bigint, v array<float>"), 3).collect()


def test_knn_invariants(spark):
    words = "graph neural model query index rank solar wind cell light".split()
    texts = [" ".join(f"{words[(t * 2 + j) % 10]} {words[(t * 2 + (i + j) % 3) % 10]}" for j in range(5)) for i in range(10) for t in range(4)]
    index = I.build_tfidf(corpus(spark, texts))
    arcs = {(r.src, r.dst): r.w for r in G.exact_arcs(index).collect()}
    assert all(w > 0 and s != d for (s, d), w in arcs.items())
    assert max(sum(1 for s, _ in arcs if s == i) for i in range(40)) <= 8
    edges = {(r.a, r.b) for r in G.mutual_edges(G.exact_arcs(index)).collect()}
    assert edges == {(s, d) for s, d in arcs if s < d and (d, s) in arcs}
    pruned = {(r.src, r.dst) for r in G.pruned_arcs(index).collect()}
    assert pruned == set(arcs)  # nothing is cut at this size


def test_louvain_and_pagerank(spark):
    edges = [(a, b, 1.0) for base in (0, 10, 20) for a in range(base, base + 10) for b in range(a + 1, base + 10)] + [(0, 10, 0.1), (10, 20, 0.1)]
    found = G.louvain(edges)
    assert len(set(found.values())) == 3 and G.modularity(edges, found) > 0.6
    assert G.louvain([]) == {}
    nodes = spark.range(31).withColumnRenamed("id", "pos")
    frame = spark.createDataFrame(edges, "a bigint, b bigint, w double")
    got = {r.pos: r.community for r in G.detect_communities(nodes, frame).collect()}
    assert got[30] == -1 and {got[0], got[10], got[20]} == {0, 1, 2}
    ranks = {r.pos: r.rank for r in G.pagerank(nodes, frame, 6, 3).collect()}
    assert math.isclose(sum(ranks.values()), 1, rel_tol=1e-9) and ranks[10] > ranks[1] > ranks[30]


def test_bridge_and_links(spark):
    com = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, -1), (4, -1)], "pos bigint, community int")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 3.0), (3, 4, 1.0), (2, 3, 1.0)], "a bigint, b bigint, w double")
    assert {r.pos: r.bridge for r in G.bridge_scores(com, edges).collect()} == {0: 0.0, 1: 0.75, 2: 1.0, 3: 0.5, 4: 0.0}
    assert rows(G.community_links(com, edges)) == [(0, 1, 1)]


def test_gaps_follow_their_expectation(spark):
    com = spark.createDataFrame([(i, i % 2) for i in range(40)], "pos bigint, community int")
    edges = spark.createDataFrame([(i, (i + 2) % 40, 1.0) for i in range(38)], "a bigint, b bigint, w double")
    none = spark.createDataFrame([], "a int, b int, cosine double")
    r = G.gaps(com, edges, none, 200).first()
    want = 38 * 2 * 20 * 20 / (40 * 39)
    assert r.observed == 0 and abs(r["mean"] - want) < 0.8 and r.z < -2


def test_trends_specificity_burst(spark):
    years = spark.createDataFrame([("new thing", 2020, 20), ("steady", 2019, 20), ("steady", 2020, 20)], "term string, year int, docs bigint")
    totals = spark.createDataFrame([(2019, 100), (2020, 100)], "year int, docs bigint")
    got = {r.term: r for r in A.trends(years, totals, (2019, 2019), (2020, 2020)).collect()}
    assert math.isclose(got["new thing"].log2_lift, math.log2(41)) and math.isclose(got["steady"].log2_lift, 0, abs_tol=1e-12)
    assert [r.term for r in A.rising_and_declining(A.trends(years, totals, (2019, 2019), (2020, 2020))).where("direction = 'rising'").orderBy("rank").collect()] == ["new thing", "steady"]
    assert A.trends(years, totals, (2000, 2001), (2020, 2020)).count() == 0
    cells = []
    for name, counts in {"even": (10, 10, 10, 10), "one": (40, 0, 0, 0), "some": (30, 5, 3, 2)}.items():
        cells += [(name, None, i, c, "community") for i, c in enumerate(counts) if c] + [(name, None, None, sum(counts), "total")]
    frame = spark.createDataFrame(cells, "term string, year int, community int, docs bigint, level string")
    com = spark.createDataFrame([(i, i) for i in range(4)], "pos bigint, community int")
    spread = {r.term: r.specificity for r in A.specificity(frame, com).collect()}
    assert math.isclose(spread["even"], 1) and spread["one"] == 0 and 0 < spread["some"] < 1
    four = spark.createDataFrame([(y, 100) for y in range(4)], "year int, docs bigint")
    flat = spark.createDataFrame([("flat", y, 10) for y in range(4)] + [("late", y, 30) for y in (2, 3)], "term string, year int, docs bigint")
    burst = {r.term: r.burst for r in A.bursts(flat, four).collect()}
    assert burst["flat"] == 0 and burst["late"] > 0


def test_metrics(spark):
    qrels = spark.createDataFrame([(q, p, g) for q in range(4) for p, g in ((10, 3), (11, 2), (12, 1))], "q bigint, pos bigint, grade int")
    lists = [[10, 11, 12], [12, 11, 10], [99, 98], [99, 10]]
    runs = spark.createDataFrame([(q, i + 1, p) for q, x in enumerate(lists) for i, p in enumerate(x)], "q bigint, rank int, pos bigint")
    queries = spark.range(4).withColumnRenamed("id", "q")
    got = {r.q: r.ndcg for r in E.metrics(runs, qrels, queries, 3).collect()}
    assert got[0] == 1 and 0 < got[1] < 1 and got[2] == 0
    assert {r.q: r.ndcg for r in E.metrics(runs, qrels, queries, 1).collect()}[3] == 0
    qrels = spark.createDataFrame([(0, 1, 3), (0, 2, 2), (0, 3, 1), (0, 4, 0)], "q bigint, pos bigint, grade int")
    runs = spark.createDataFrame([(0, i + 1, p) for i, p in enumerate([4, 1, 2, 3])], "q bigint, rank int, pos bigint")
    r = E.metrics(runs, qrels, spark.range(1).withColumnRenamed("id", "q"), 4).first()
    assert (r.precision, r.reciprocal_rank) == (0.75, 0.5)
    assert E.metrics(runs, qrels, spark.range(1).withColumnRenamed("id", "q"), 4, 2).first().precision == 0.5
    assert math.isclose(E.metrics(runs, qrels, spark.range(1).withColumnRenamed("id", "q"), 2).first().recall, 1 / 3)


def test_grades(spark):
    cases = [(["IR", "CL"], ["IR", "CL"], 3), (["IR", "CL"], ["IR", "DB"], 2), (["DL", "IR", "CL"], ["SI", "IR", "CL"], 1), (["DL", "IR"], ["SI", "IR"], 0), (["DL"], ["DB"], 0), ([], [], 0)]
    frame = spark.createDataFrame(cases, "a array<string>, b array<string>, want int")
    assert all(r.got == r.want for r in frame.withColumn("got", E.grade(F.col("a"), F.col("b"))).collect())


def test_draws_of_a_bootstrap_never_become_rows(spark):
    """A table of draws looks small to Spark, which sent all of them through the driver."""
    d = [((i * 37) % 11 - 5) / 7 for i in range(23)]
    pairs = spark.createDataFrame([(i, 1.0, 1.0 + x) for i, x in enumerate(d)], "i bigint, a double, b double")
    found = E.paired_bootstrap(pairs, 200)
    assert "sequence(" not in found._jdf.queryExecution().toString()
    number = lambda r, j: int(hashlib.md5(f"{r}:{j}".encode()).hexdigest()[:12], 16) % len(d)
    means = sorted(round(sum(d[number(r, j)] for j in range(len(d))) / len(d), 9) for r in range(200))
    got = found.first()
    assert (got.n, round(got.diff, 9), round(got.lo, 9), round(got.hi, 9)) == (23, round(sum(d) / 23, 9), means[5], means[195])


def test_bootstrap_and_slope(spark):
    up = spark.createDataFrame([(i, 0.5, 0.55) for i in range(200)], "i bigint, a double, b double")
    r = E.paired_bootstrap(up, 200).first()
    assert math.isclose(r["diff"], 0.05) and r.significant
    same = spark.createDataFrame([(i, 0.5, 0.5) for i in range(50)], "i bigint, a double, b double")
    assert not E.paired_bootstrap(same, 100).first().significant
    points = spark.createDataFrame([(float(x), float(x * x)) for x in range(0, 9)], "x double, y double")
    assert math.isclose(E.loglog_slope(points).first().slope, 2)


def test_context_skips_then_stops(spark):
    scores = spark.createDataFrame([(0, p, 1.0 / (p + 1), False) for p in range(5)], "q bigint, pos bigint, score double, via_graph boolean")
    words = spark.createDataFrame([(0, 60), (1, 50), (2, 35), (3, 10), (4, 1)], "pos bigint, words int")
    got = [r.pos for r in C.assemble(scores, words, 100).orderBy("ord").collect()]
    assert got == [0, 2]  # 1 is passed over, 3 doesn't fit and the set is full
    context = C.assemble(scores, words, 100)
    pins = spark.createDataFrame([(0, 3)], "q bigint, pos bigint")
    assert [r.pos for r in C.pin(context, pins, words, 100).orderBy("ord").collect()] == [3, 0]


def test_dedupe_is_ordered(spark):
    data = [(0, "W1", "Fighter Jets!"), (1, "W2", "fighter jets"), (2, "W3", "戦闘機"), (3, "W4", "航空機"), (4, "W1", "Other"), (5, "W5", "Other")]
    papers = spark.createDataFrame(data, "pos bigint, id string, title string")
    assert [r.id for r in R.dedupe(papers).orderBy("pos").collect()] == ["W1", "W3", "W4", "W5"]


def test_quota(spark):
    made = [(f"a{i}", f"alpha {i}", f"2026-0{i + 1}-01") for i in range(5)] + [("a24", "alpha old", "2024-05-01"), ("both", "alpha beta", "2026-12-01"), ("b25", "beta", "2025-03-01")]
    papers = spark.createDataFrame([(i, t, "", ["cs.LG"], d) for i, t, d in made], "id string, title string, abstract string, categories array<string>, d string").withColumn("published", F.to_date("d"))
    got = R.quota_select(papers, ["alpha", "beta"], ["cs"], 2024, 2026, 6).where("keyword = 'beta'").collect()
    assert [r.id for r in got] == ["b25"]
    assert [i for i in [r.id for r in R.quota_select(papers, ["alpha", "beta"], [], 2024, 2026, 6).where("keyword = 'alpha'").orderBy("rank").collect()]][0] == "both"


def test_categories_and_subtract(spark):
    votes = spark.createDataFrame([("k", i, "cs.LG" if i % 2 else "cs.CL") for i in range(1, 11)] + [("m", 1, "cs.LG")], "keyword string, rank int, category string")
    assert [(r.category, r.weight) for r in R.infer_categories(votes).orderBy("rank").collect()] == [("cs.LG", 1.5), ("cs.CL", 0.5)]
    nodes = spark.range(20).withColumnRenamed("id", "pos")
    assert {r.pos for r in R.without_weakest(nodes, nodes.withColumn("degree", F.col("pos") % 10)).collect()} == set(range(20)) - {0, 10}


def test_numbers_by_ranges(spark, monkeypatch):
    from scriptorium.operators import ranks

    monkeypatch.setattr(ranks, "ROWS", 7)
    rows = spark.createDataFrame([(i % 3, (i * 37) % 100) for i in range(100)], "g int, x bigint").repartition(5)
    for groups in ([], ["g"]):
        part = ranks.quantile_range(rows, "x", ranks.ranges_for(100))
        got = ranks.numbered(rows, "i", groups, part, ["x"]).collect()
        seen = {}
        for r in sorted(got, key=lambda r: r.x):
            key = r.g if groups else 0
            seen[key] = seen.get(key, 0) + 1
            assert r.i == seen[key]
    assert ranks.ranges_for(100) == 15 and ranks.quantile_range(rows.where("false"), "x", 9) is not None
    degrees = spark.range(60).selectExpr("id AS pos", "id % 2 AS degree")
    assert {r.pos for r in R.without_weakest(degrees, degrees, 0.3).collect()} == set(range(60)) - set(range(0, 36, 2))
    assert {r.pos for r in R.without_weakest(degrees, degrees, 0.6).collect()} == set(range(60)) - set(range(0, 60, 2)) - {1, 3, 5, 7, 9, 11}


def test_report_ends_with_falls_that_are_none(spark):
    found = spark.createDataFrame([(f"t{i}", 0, 1, 1.0 + i / 10, i / 10, 0.1) for i in range(9)], "term string, early bigint, late bigint, lift double, log2_lift double, prevalence double")
    burst = spark.createDataFrame([("t1", 2.0), ("t2", 2.0), ("gone", 9.0), ("t3", 0.0)], "term string, burst double")
    pairs = spark.createDataFrame([(0, 1, -3.0, 0.5), (0, 2, -1.0, 0.9), (1, 2, -2.5, 0.5)], "a int, b int, z double, similarity double")
    got = {}
    for r in A.report(found, burst, pairs).orderBy("section", "rank").collect():
        got.setdefault(r.section, []).append(r.label)
    assert got == {"rising": [f"t{i}" for i in range(8, 1, -1)], "declining": [f"t{i}" for i in range(7)], "burst": ["t2", "t1", "t3"], "gap": ["0 <-> 1", "1 <-> 2"]}


def test_sweep_over_sizes(spark):
    from scriptorium.operators import scaling
    from scriptorium.session import stored

    words = "graph neural model query index rank solar wind cell light".split()
    texts = [f"{words[i % 10]} {words[(i * 3) % 10]} {words[(i // 2) % 10]} {words[(i * 7) % 10]}" for i in range(40)]
    papers = corpus(spark, texts).withColumn("year", (2020 + F.col("pos") % 3).cast("int"))
    ticks = iter(range(1, 100))

    def clock(run):
        return stored(run(), "stage"), float(next(ticks))

    got = scaling.sweep(papers, [20, 40, 99], clock=clock).orderBy("n").collect()
    assert [(r.n, r.index_s, r.total_s) for r in got] == [(20, 1.0, 15.0), (40, 6.0, 40.0)] and all(r.edge_recall == 1 for r in got)
    made = spark.createDataFrame([(10, *[float(10**2)] * 5, 1.0, 1.0), (100, *[float(100**2)] * 5, 1.0, 1.0)], scaling.FORM)
    slopes = {r.stage: round(r.slope, 6) for r in scaling.exponents(made).collect()}
    assert slopes == {"index": 2, "exact": 2, "pruned": 2, "communities": 2, "trends": 2, "total": 0}
