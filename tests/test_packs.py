"""Packed indexes: their terms and searches against the row indexes, and how many rows they send."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_blocks import sent

from scriptorium.functions import text as T
from scriptorium.operators import graph as G
from scriptorium.operators import index as I
from scriptorium.operators import packs as K
from scriptorium.operators import search as S
from scriptorium.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
PARTS = ["foo", "Bar", "the", "a", "12", "x1", "é", "ÉÀ", "don't", "it’s", "-", "--", "a-b", "b--c", "-d", "e-", "_", "f_g", "\\alpha", "\\", "$", ".", ",", "—", "–", "“q”", "(", "[z]", "{", "|", "/", "\n", "\r", "\t", " ", "́", "İ", "ΑΣ", "🦊", "²", "½", "Ⅷ", "٣", "co-op's"]


def odd_texts(n):
    rng = random.Random(3)
    return [None, "", " "] + ["".join(rng.choice(PARTS) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def corpus(spark, n=300):
    texts = odd_texts(n)
    return spark.createDataFrame([(7 * i % len(texts), t) for i, t in enumerate(texts)], "pos bigint, abstract string").dropDuplicates(["pos"])


def ranks(df):
    return sorted(map(tuple, df.select("q", "rank", "pos", "score").collect()))


def test_terms_are_those_of_the_expressions(spark):
    texts = [t for t in odd_texts(500) if t]
    want = [sorted(r.y) for r in spark.createDataFrame(list(enumerate(texts)), "i int, x string").orderBy("i").select(T.terms("x", 2).alias("y")).collect()]
    tool = K.WordGrams(2)
    for text, terms in zip(texts, want, strict=True):
        row, hashes, length = tool.grams([tool.read(text)])
        names = tool.named(text)
        assert sorted(names[int(h)] for h in hashes) == terms and length[0] == sum(" " not in t for t in terms), text


@pytest.mark.parametrize("block", [7, 2048])
def test_searches_and_arcs_equal_those_over_rows(spark, monkeypatch, block):
    monkeypatch.setattr(K, "BLOCK", block)
    papers = corpus(spark).cache()
    queries = papers.where("pos % 4 = 0").select(F.col("pos").alias("q"), F.col("abstract").alias("text"))
    counts = I.term_table(papers)
    tfidf, bm25 = I.build_tfidf(papers, counts=counts), I.build_bm25(papers, counts)
    for whole in (False, True):
        index = K.packs(papers, queries, whole=whole)
        assert ranks(K.search(index, "tfidf", 5)) == ranks(S.tfidf_search(tfidf, queries, 5))
        assert ranks(K.search(index, "bm25", 5)) == ranks(S.bm25_search(bm25, queries, 5))
        assert ranks(K.search(index, "t0", 5)) == ranks(S.overlap_search(I.build_inverted(papers, counts), queries, 5))
    assert sorted(map(tuple, G.packed_arcs(index, 4).collect())) == sorted(map(tuple, G.exact_arcs(tfidf, 4).collect()))


def test_nothing_packed(spark):
    none = corpus(spark, 5).where("pos < 0")
    index = K.packs(none, none.select(F.col("pos").alias("q"), F.col("abstract").alias("text")))
    assert K.search(index, "bm25", 3).count() == 0 and G.packed_arcs(index).count() == 0


def test_character_windows(spark):
    tool = K.CharGrams()
    row, hashes, many = tool.grams([tool.read(t) for t in ("abc", "abcde", "bcde🦊")])
    assert row.tolist() == [1, 1, 2, 2] and hashes[1] == hashes[2] and len(np.unique(hashes)) == 3 and many.tolist() == [0, 2, 2]


@pytest.mark.parametrize("name", ["hybrid_graph_expand", "context_via_graph", "gold_set", "ladder", "context_coverage", "retrieval_table", "context_budget", "centroid_cosine", "display_labels", "concept_nodes", "trend_lift"])
def test_postings_are_not_rows(spark, name):
    """Each posting was a row of two shuffles or more."""
    postings = sum(len(set(r.t)) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select(T.terms("text", 2).alias("t")).collect())
    before = sent(spark)
    catalogue.QUERIES[name](spark, FOLDER).collect()
    assert sent(spark) - before < postings / 2


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_are_counted_before_they_are_rows(spark):
    assert "Generate" not in plan_of(catalogue.QUERIES["char4_gram_counts"](spark, FOLDER))


def test_typed_texts_are_read_once(spark):
    """Each of four kinds was a scan of all texts."""
    assert plan_of(catalogue.QUERIES["input_modes"](spark, FOLDER)).count("FileScan parquet") == 1


def test_dense_arcs_are_made_once(spark):
    """Readers that join the arcs with themselves went through all pairs again."""
    rng = random.Random(4)
    held = {i: [rng.gauss(0, 1) for _ in range(8)] for i in range(300)}
    arcs = G.dense_arcs(spark.createDataFrame(list(held.items()), "pos bigint, v array<double>"), 3)
    want = set()
    for i, v in held.items():
        near = sorted((-round(sum(x * y for x, y in zip(v, w, strict=True)), 6), j) for j, w in held.items() if j != i)[:3]
        want |= {(i, j, -s) for s, j in near if s < 0}
    assert {tuple(r) for r in arcs.select("src", "dst", "w").collect()} == want
    assert "ExistingRDD" not in plan_of(G.one_way_arcs(arcs)) and arcs.inputFiles()


def test_totals_send_no_posting_as_a_row(spark):
    texts = corpus(spark)
    want = I.build_tfidf(texts).weights.groupBy("pos").agg(F.count("*").alias("terms"), F.round(F.max("w"), 9).alias("heaviest"))
    got = K.tfidf_totals(texts).select("pos", "terms", F.round("heaviest", 9).alias("heaviest"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    before = sent(spark)
    catalogue.QUERIES["tfidf_norms"](spark, FOLDER).collect()
    assert sent(spark) - before < 3000


def topical(spark, n=240):
    rng = random.Random(5)
    return spark.createDataFrame([(3 * i, " ".join(f"w{int(rng.gauss(i, 6)) % n}x" for _ in range(20))) for i in range(n)], "pos bigint, abstract string")


def test_edges_around_nodes_are_those_of_all_lists(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 50)
    index = K.packs(topical(spark))
    every = {tuple(r) for r in G.mutual_edges(G.packed_arcs(index)).collect()}
    monkeypatch.setattr(G, "packed_arcs", None)  # all pairs of documents are not scored
    nodes = {3, 300, 303}
    for hops in (1, 2):
        got = {tuple(r) for r in G.edges_around(index, spark.createDataFrame([(x,) for x in nodes], "pos bigint"), hops).collect()}
        want = {e for e in every if nodes & {*e[:2]}}
        assert want <= got <= every and want
        nodes = nodes | {x for e in want for x in e[:2]}


def test_edges_need_all_terms(spark):
    rows = topical(spark, 40)
    index = K.packs(rows, rows.select(F.col("pos").alias("q"), F.col("abstract").alias("text")).limit(2))
    with pytest.raises(ValueError, match="all terms"):
        G.edges_around(index, rows.select("pos"))


def test_queries_fill_blocks(spark):
    rows = topical(spark, 60)
    queries = rows.select(F.col("pos").alias("q"), F.col("abstract").alias("text")).repartition(7)
    assert K.packs(rows, queries).asked().count() == 1


def test_exact_edges_of_the_recall_send_no_vector_as_rows(spark, monkeypatch):
    monkeypatch.setattr(G, "exact_arcs", None)
    assert catalogue.QUERIES["edge_recall"](spark, FOLDER).first().exact > 0
