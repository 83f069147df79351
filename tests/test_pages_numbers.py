"""Numbers on pages are rounded by their exact value, as printf does."""

from pyspark.sql import functions as F

from scriptorium.functions.normalize import fixed
from scriptorium.operators import pages as P


def test_fixed_rounds_as_printf_does(spark):
    values = [0.125, 0.375, 0.345, 0.005, 1.005, 0.995, -0.125, 2.5, 0.0, 12345.675]
    got = spark.createDataFrame([(x,) for x in values], "x double").select("x", fixed("x", 2).alias("t"), fixed("x", 4).alias("u")).collect()
    assert [(r.t, r.u) for r in got] == [(f"{r.x:.2f}", f"{r.x:.4f}") for r in got]


def test_a_page_prints_ties_as_printf_does(spark):
    nodes = spark.createDataFrame([(0, "a", 0.125), (1, "b", 0.375)], "pos bigint, id string, bridge double").select("pos", "id", F.col("id").alias("title"), F.array(F.lit("A")).alias("authors"), F.lit(2024).alias("year"), F.lit("").alias("abstract"), F.lit("0").alias("cluster"), F.lit(0.25).alias("pagerank"), "bridge")
    page = {r.pos: r.page for r in P.reader_pages(nodes, spark.createDataFrame([(0, 1, 0.345)], "a bigint, b bigint, w double")).collect()}
    assert f"bridge score {0.125:.2f}\n" in page[0] and f"cos {0.345:.2f}\n" in page[0] and "PageRank 0.2500" in page[0]
