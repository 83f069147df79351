"""Index builds: every index is a table of (term, pos) rows with its statistics beside it.

A corpus is any DataFrame of (pos, abstract): pos is a bigint that breaks all ties.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import char_grams, counts, kept, terms, tokens
from ..session import stored

MAX_N, MIN_DF = 2, 2


def spread(rows: DataFrame, key: str = "pos") -> DataFrame:
    """rows dealt by their key over all cores and shuffle partitions, if they come in fewer parts than there are cores.

    A file of one row group is one task otherwise; and what is then counted by key and term stays where it
    is, so the text moves once and its terms do not. Rows that come in enough parts stay where they lie:
    their terms are summed up there, and the text doesn't move at all.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if rows._jdf.queryExecution().toRdd().getNumPartitions() >= 2 * cores:  # plans the scan, and runs nothing
        return rows
    return rows.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def gram_rows(rows: DataFrame, keys: list[str], text: str, most: int) -> DataFrame:
    """(keys, term, n): a row for each n-gram of up to most tokens, as terms() gives them.

    Tokens and those after them are laid side by side and become rows before anything is asked of them, so that
    all tests of a token are compiled.
    """
    every = rows.select(*keys, tokens(F.col(text)).alias("_tokens"))
    shifted = [F.col("_tokens")] + [F.slice("_tokens", i, F.greatest(F.size("_tokens"), F.lit(1))) for i in range(2, most + 1)]
    lined = every.select(*keys, F.explode(F.arrays_zip(*[c.alias(f"t{i}") for i, c in enumerate(shifted)])).alias("_t"))
    first = F.lower("_t.t0")
    lined = lined.where(counts(first)).select(*keys, first.alias("t0"), *[kept(F.col(f"_t.t{i}")).alias(f"t{i}") for i in range(1, most)])
    if most == 1:
        return lined.select(*keys, F.col("t0").alias("term"), F.lit(1).alias("n"))
    grams = [F.struct(F.when(_all(i), F.concat_ws(" ", *[F.col(f"t{j}") for j in range(i + 1)])).alias("term"), F.lit(i + 1).alias("n")) for i in range(most)]
    return lined.select(*keys, F.explode(F.array(*grams)).alias("_g")).select(*keys, "_g.term", "_g.n").where("term is not null")


def _all(last: int) -> Column:
    out = F.lit(True)
    for j in range(last + 1):
        out = out & F.col(f"t{j}").isNotNull()
    return out


def term_rows(papers: DataFrame, tokenizer: Callable[[Column], Column], text: str = "abstract") -> DataFrame:
    """(pos, term): a row for each occurrence."""
    return spread(papers.select("pos", text)).select("pos", F.explode(tokenizer(F.col(text))).alias("term"))


def term_counts(papers: DataFrame, tokenizer: Callable[[Column], Column] | int = MAX_N, text: str = "abstract") -> DataFrame:
    """(pos, term, tf, n) for n-grams of up to so many tokens, (pos, term, tf) for another tokenizer."""
    if isinstance(tokenizer, int):
        return gram_rows(spread(papers.select("pos", text)), ["pos"], text, tokenizer).groupBy("pos", "term", "n").agg(F.count("*").alias("tf"))
    return term_rows(papers, tokenizer, text).groupBy("pos", "term").agg(F.count("*").alias("tf"))


def term_table(papers: DataFrame, most: int = MAX_N, text: str = "abstract") -> DataFrame:
    """term_counts() as a written table, from which any of the indexes can be built."""
    return stored(term_counts(papers, most, text), "terms")


@dataclass(frozen=True)
class Inverted:
    postings: DataFrame  # (term, pos), distinct
    lengths: DataFrame  # (pos, len): tokens with repeats, 0 if none


@dataclass(frozen=True)
class TfIdf:
    weights: DataFrame  # (pos, term, w), each pos of length 1
    vocabulary: DataFrame  # (term, df, idf)
    tokenizer: Callable[[Column], Column]
    raw: DataFrame | None = None  # (pos, term, raw): the weights before they are scaled


@dataclass(frozen=True)
class Bm25:
    postings: DataFrame  # (term, pos, tf)
    vocabulary: DataFrame  # (term, df, idf)
    lengths: DataFrame  # (pos, len)
    average: DataFrame  # one row (avgdl, n)


def _lengths(papers: DataFrame, counts: DataFrame) -> DataFrame:
    return papers.select("pos").join(counts.groupBy("pos").agg(F.sum("tf").alias("len")), "pos", "left").select("pos", F.coalesce("len", F.lit(0)).alias("len"))


def _single(papers: DataFrame, counts: DataFrame | None) -> DataFrame:
    return term_counts(papers, 1) if counts is None else counts.where("n = 1")


def build_inverted(papers: DataFrame, counts: DataFrame | None = None) -> Inverted:
    """counts: a term_table() of papers, if there is one."""
    counts = _single(papers, counts)
    return Inverted(counts.select("term", "pos"), _lengths(papers, counts))


def build_tfidf(papers: DataFrame, tokenizer: Callable[[Column], Column] | None = None, max_n: int = MAX_N, min_df: int = MIN_DF, counts: DataFrame | None = None) -> TfIdf:
    """Sublinear tf times smoothed idf, each document scaled to length 1 over the terms that are kept.

    counts: a term_table() of papers with n-grams of max_n at least, if there is one.
    """
    if counts is None:
        counts = term_counts(papers, tokenizer or max_n)
    elif tokenizer is None:
        counts = counts.where(F.col("n") <= max_n)
    # one row: the number of documents, empty ones included
    total = papers.agg(F.count("*").alias("n"))
    df = counts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    vocabulary = df.join(F.broadcast(total)).select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = counts.select("pos", "term", "tf").join(vocabulary.hint("shuffle_hash"), "term").select("pos", "term", ((1 + F.log(F.col("tf").cast("double"))) * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("pos")))
    return TfIdf(raw.select("pos", "term", (F.col("raw") / norm).alias("w")), vocabulary, tokenizer or (lambda c: terms(c, max_n)), raw)


def build_char_tfidf(papers: DataFrame, n: int = 4, min_df: int = 3) -> TfIdf:
    return build_tfidf(papers, lambda c: char_grams(c, n), min_df=min_df)


def build_bm25(papers: DataFrame, counts: DataFrame | None = None) -> Bm25:
    """counts: a term_table() of papers, if there is one."""
    counts = _single(papers, counts)
    total = papers.agg(F.count("*").alias("n"))
    # one row each
    average = counts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("all")).join(total).select(F.try_divide("all", "n").alias("avgdl"), "n")
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return Bm25(counts.select("term", "pos", "tf"), df.join(F.broadcast(total)).select("term", "df", idf.alias("idf")), _lengths(papers, counts), average)


def only(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows of the terms of wanted(term): what is left is sent and sorted, not the whole index."""
    return rows.join(wanted.select("term").distinct(), "term", "left_semi")


def weights_of(index: TfIdf, wanted: DataFrame) -> DataFrame:
    """The index's weights of the terms of wanted(term): lengths are summed over all, other weights go no further."""
    if index.raw is None:
        return only(index.weights, wanted)
    norms = index.raw.groupBy("pos").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return only(index.raw, wanted).join(norms, "pos").select("pos", "term", (F.col("raw") / F.col("norm")).alias("w"))


def query_counts(index: TfIdf, queries: DataFrame, text: str = "text") -> DataFrame:
    """(q, term, tf) of queries(q, text)."""
    return queries.select("q", F.explode(index.tokenizer(F.col(text))).alias("term")).groupBy("q", "term").agg(F.count("*").alias("tf"))


def query_vector(index: TfIdf, queries: DataFrame, text: str = "text") -> DataFrame:
    """(q, term, w) of queries(q, text), of length 1 over the terms in the vocabulary."""
    asked = query_counts(index, queries, text)
    raw = asked.join(only(index.vocabulary, asked), "term").select("q", "term", ((1 + F.log(F.col("tf").cast("double"))) * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("q")))
    return raw.select("q", "term", (F.col("raw") / norm).alias("w"))


def normalize(vector: Column) -> Column:
    """An array scaled to length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
