from helpers import rows
from pyspark.sql import functions as F

from scriptorium.functions.normalize import input_mode
from scriptorium.operators import pages, views


def test_linked_concepts(spark):
    text = "# graph theory\nA Graph Theory of graph theory, `dense graph`, $graph$ and [[graph]]: graphs, graph.\n- graph\nDense graph"
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    link = pages.linked_concepts(["graph", "graph theory", "dense graph", "and"])
    want = "# graph theory\nA [[Graph Theory]] of graph theory, `dense graph`, $graph$ and [[graph]]: graphs, [[graph]].\n- graph\n[[Dense graph]]"
    assert rows(df.select(link("t"))) == [(want,), (None,), ("",)]
    assert rows(df.select(pages.linked_concepts(["graph", "graph theory"], 1)("t")))[0][0].count("[[") == 2
    assert rows(df.select(pages.linked_concepts([])("t")))[0][0] == text


def test_concept_ids_step_aside(spark):
    nodes = spark.createDataFrame([(1, 1, "graph"), (2, 2, "graph-2"), (3, 3, "other")], "pos bigint, ord int, id string")
    terms = spark.createDataFrame([(0, 1, "graph"), (0, 2, "Graph"), (1, 1, "graph"), (1, 2, "graph 3"), (1, 7, "late"), (2, 1, "!"), (3, 1, "empty")], "community int, rank int, term string")
    members = spark.createDataFrame([(0, 1, 1), (1, 1, 2), (2, 1, 3)], "community int, rank int, pos bigint")
    concepts = views.concept_nodes(nodes, terms, members)
    assert sorted(rows(concepts)) == [("graph-3", "graph 3", 1), ("graph-4", "graph", 0), ("graph-5", "Graph", 0), ("graph-6", "graph", 1), ("untitled", "!", 2)]
    assert sorted(rows(views.appears_in(concepts, members, nodes)))[:2] == [("graph-3", "graph-2"), ("graph-4", "graph")]
    assert views.concept_nodes(nodes, terms.where("false"), members).count() == 0


def test_input_mode(spark):
    cases = {None: ("empty", False, ""), " \n": ("empty", False, ""), "a,b, c ,d,e": ("keywords", True, "5 / 5 keywords"), "one two": ("keywords", False, "1 / 5 keywords"), "a b c d e f g": ("abstract", False, "7 / 100 words"), "a b c d e f g, h": ("abstract", False, "8 / 100 words"), "w " * 100: ("abstract", True, "100 / 100 words"), ",": ("abstract", False, "1 / 100 words")}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    assert [tuple(r.m) for r in df.orderBy("i").select(input_mode("t").alias("m")).collect()] == list(cases.values())


def test_label_matches(spark):
    df = spark.createDataFrame([("Deep Nets",), ("graphs",), (None,)], "label string")
    assert rows(views.label_matches(df, " NET ")) == [("Deep Nets",)]
    assert views.label_matches(df.where(F.col("label").isNotNull()), " ").count() == 2
