"""Products of sparse vectors by blocks, against sums over all pairs, and how many rows they send."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import blocks as K
from scriptorium.operators import graph as G
from scriptorium.operators import index as I
from scriptorium.operators import search as S


def sent(spark) -> int:
    """Rows that all stages so far have written to shuffles."""
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def vectors(n: int, seed: int) -> dict[int, dict[str, float]]:
    r = random.Random(seed)
    return {i: {f"t{int(r.random() ** 3 * 60)}": round(r.uniform(0.1, 1), 3) for _ in range(r.randint(1, 12))} for i in range(n)}


def frame(spark, found, key):
    return spark.createDataFrame([(i, t, w) for i, v in found.items() for t, w in v.items()], f"{key} bigint, term string, w double")


def best(asked, held, k, extra=None, exclude=False):
    out = set()
    for q, a in asked.items():
        scores = []
        for p, b in held.items():
            s = sum(w * b[t] for t, w in a.items() if t in b)
            if s > 0 and not (exclude and p == q):
                scores.append((-round(s + (extra(p) if extra else 0), 6), p))
        out |= {(q, p, -s) for s, p in sorted(scores)[:k]}
    return out


def ranked(df, k):
    return {(r.q, r.pos, r.score) for r in S.top_k(df, k).collect()}


@pytest.mark.parametrize("block", [7, 2048])
def test_products_equal_sums_over_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(K, "BLOCK", block)
    asked, held = vectors(30, 1), vectors(150, 2)
    got = K.best_products(frame(spark, asked, "q"), frame(spark, held, "pos").withColumn("len", F.col("pos") % 5), 4, F.col("len") / 10)
    assert ranked(got, 4) == best(asked, held, 4, lambda p: p % 5 / 10)
    assert ranked(K.nearest_pairs(frame(spark, held, "pos"), 3), 3) == best(held, held, 3, exclude=True)


def test_products_of_nothing(spark):
    none = frame(spark, vectors(5, 1), "q").where("q < 0")
    assert K.best_products(none, frame(spark, vectors(5, 1), "pos"), 3).count() == 0 and K.nearest_pairs(none.withColumnRenamed("q", "pos"), 3).count() == 0


def corpus(spark, n):
    return spark.createDataFrame([(i, f"alpine botany chemistry dialect rare{i % 50} rare{i % 7}") for i in range(n)], "pos bigint, abstract string")


def test_all_pairs_are_not_rows(spark):
    papers = corpus(spark, 600)
    before = sent(spark)
    assert G.exact_arcs(I.build_tfidf(papers, counts=I.term_table(papers))).count() == 600 * 8
    assert sent(spark) - before < 600 * 600 / 4  # each two documents share a term


def test_a_search_does_not_send_its_hits(spark):
    papers = corpus(spark, 600)
    queries = papers.select(F.col("pos").alias("q"), F.lit("alpine botany chemistry").alias("text"))
    index = I.build_bm25(papers, I.term_table(papers, 1))
    before = sent(spark)
    assert S.bm25_search(index, queries, 2).count() == 1200
    assert sent(spark) - before < 600 * 600 / 4  # each query finds each document


def test_whether_a_query_matches_needs_no_search(spark):
    papers = corpus(spark, 400)
    index = I.build_bm25(papers, I.term_table(papers, 1))
    queries = spark.createDataFrame([(1, "chemistry of nothing"), (2, "absent words"), (3, ""), (4, "rare3")] + [(i, "alpine botany") for i in range(10, 400)], "q bigint, text string")
    before = sent(spark)
    assert {r.q for r in S.bm25_matched(index, queries).collect()} == {1, 4, *range(10, 400)}
    assert sent(spark) - before < 390 * 400 / 4


def test_matches_that_round_to_nothing_are_searched(spark):
    """A term in every one of many documents: one is too little, and five of it are enough."""
    n = 3_000_000
    index = I.Bm25(
        spark.createDataFrame([("every", 1, 1), ("every", 2, 1)], "term string, pos bigint, tf bigint"),
        spark.createDataFrame([("every", n, 1e-7)], "term string, df bigint, idf double"),
        spark.createDataFrame([(1, 10), (2, 1000)], "pos bigint, len bigint"),
        spark.createDataFrame([(10.0, n)], "avgdl double, n bigint"),
    )
    queries = spark.createDataFrame([(1, "every"), (2, "every every every every every every")], "q bigint, text string")
    want = {r.q for r in S.bm25_search(index, queries, 1).collect()}
    assert {r.q for r in S.bm25_matched(index, queries).collect()} == want


def test_candidates_are_not_rows(spark):
    papers = corpus(spark, 600)
    before = sent(spark)
    assert G.pruned_arcs(I.build_tfidf(papers, counts=I.term_table(papers))).count() == 600 * 8
    assert sent(spark) - before < 600 * 400 / 4  # each document has 400 candidates


def test_candidates_come_in_order_of_rare_terms(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 9)
    held = vectors(80, 5)
    df = {t: sum(t in v for v in held.values()) for v in held.values() for t in v}
    index = I.TfIdf(frame(spark, held, "pos"), spark.createDataFrame(list(df.items()), "term string, df bigint"), None)
    for probes, candidates in ((3, 4), (2, 30), (24, 400)):
        want = set()
        for x, v in held.items():
            heavy = sorted(v, key=lambda t: (-v[t], t))[:probes]
            met = {}
            for t in sorted(heavy, key=lambda t: (df[t], t)):
                for y in sorted(held):
                    if y != x and t in held[y]:
                        met.setdefault(y, len(met))
            want |= best({x: v}, {y: held[y] for y in list(met)[:candidates]}, 3)
        assert {(r.src, r.dst, r.w) for r in G.pruned_arcs(index, 3, probes, candidates).collect()} == want
