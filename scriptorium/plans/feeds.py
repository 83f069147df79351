"""Queries over feeds that are made from the documents, and over what sinks have written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.normalize import slug
from ..session import scratch
from ..sources import feeds as X
from ..sources import files
from .base import PAPERS, papers, shaped, squash_sql, vectors

QUERIES, SQL = {}, {}


def _element(name: str, body: Column) -> Column:
    # characters that XML doesn't allow go
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "[\\x{0}-\\x{8}\\x{B}\\x{C}\\x{E}-\\x{1F}\\x{FFFE}\\x{FFFF}]", ""), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    return F.concat(F.lit(f"<{name}>"), safe, F.lit(f"</{name}>"))


_CLEAN = "regexp_replace({}, '[\\x{{0}}-\\x{{8}}\\x{{B}}\\x{{C}}\\x{{E}}-\\x{{1F}}\\x{{FFFE}}\\x{{FFFF}}]', '', 'g')"


def _day(spark, d):
    """The documents, with a day for each."""
    day = F.format_string("%d-%02d-%02d", "year", F.pmod("pos", F.lit(12)) + 1, F.pmod("pos", F.lit(28)) + 1)
    return papers(spark, d).withColumn("day", day)


def atom_feed_records(spark, d):
    """Feeds of some twenty documents each, every fifth without a date, decoded again."""
    rows = _day(spark, d)
    date = F.when(F.pmod("pos", F.lit(5)) == 0, F.lit("")).otherwise(F.concat(F.lit("<published>"), "day", F.lit("T10:00:00Z</published>")))
    term = lambda name, c: F.concat(F.lit(f"<{name} term=\""), F.coalesce(F.col(c), F.lit("")), F.lit("\"/>"))
    entry = F.concat(F.lit("<entry>"), _element("id", F.concat(F.lit("http://arxiv.org/abs/d"), "id", F.lit("v3"))), _element("title", F.col("title")), _element("summary", F.col("abstract")), date, F.lit("<author><name> A  B </name></author><author><name/></author>"), term("arxiv:primary_category", "source"), term("category", "lang"), term("category", "source"), F.lit("</entry>"))
    head = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">'
    feeds = rows.groupBy(F.floor(F.col("pos") / 20).alias("feed")).agg(F.concat(F.lit(head), F.array_join(F.collect_list(entry), ""), F.lit("</feed>")).alias("xml"))
    found = X.atom_records(feeds)
    return shaped(found.select("feed", "id", F.md5("abstract").alias("digest"), F.array_join("authors", "|").alias("authors"), F.array_join("categories", "|").alias("categories"), F.col("published").cast("string").alias("published")), "feed:bigint", "id:string", "digest:string", "authors:string", "categories:string", "published:string")


_KEPT = f"""k AS (SELECT pos, id, {squash_sql(_CLEAN.format('abstract'))} AS a, {squash_sql(_CLEAN.format('title'))} AS t, source, lang, printf('%d-%02d-%02d', year::INT, (pos % 12 + 1)::INT, (pos % 28 + 1)::INT) AS day, year FROM papers)"""
SQL["atom_feed_records"] = f"""WITH {PAPERS}, {_KEPT}
SELECT pos // 20 AS feed, 'd' || id AS id, md5(a) AS digest, 'A B' AS authors, CASE WHEN coalesce(source, '') = '' THEN lang WHEN coalesce(lang, '') IN ('', source) THEN source ELSE source || '|' || lang END AS categories, day AS published
FROM k WHERE pos % 5 <> 0 AND t <> '' AND strlen(a) > 200"""


def oai_list_records(spark, d):
    """Lists of some fifty documents each, every seventh deleted, decoded again; the month in an id goes before a date."""
    rows = _day(spark, d)
    number = F.when(F.pmod("pos", F.lit(2)) == 0, F.concat(F.lit("2407."), "id")).otherwise(F.concat(F.lit("old-"), "id"))
    head = F.when(F.pmod("pos", F.lit(7)) == 0, F.lit("<header status=\"deleted\"/>")).otherwise(F.lit("<header/>"))
    body = F.concat(F.lit("<metadata><arXiv xmlns=\"http://arxiv.org/OAI/arXiv/\">"), _element("id", number), _element("created", F.col("day")), _element("title", F.col("title")), _element("abstract", F.col("abstract")), _element("categories", F.concat_ws(" ", "source", "lang")), F.lit("<authors><author><keyname>Doe</keyname><forenames>J.</forenames></author><author><keyname>Roe</keyname></author></authors></arXiv></metadata>"))
    record = F.concat(F.lit("<record>"), head, body, F.lit("</record>"))
    lists = rows.groupBy(F.floor(F.col("pos") / 50).alias("list")).agg(F.concat(F.lit('<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords>'), F.array_join(F.collect_list(record), ""), F.lit("<resumptionToken>t</resumptionToken></ListRecords></OAI-PMH>")).alias("xml"))
    lists = lists.union(lists.limit(1).select(F.lit(-1).cast("bigint"), F.lit('<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><error code="noRecordsMatch"/></OAI-PMH>')))
    found = X.oai_records(lists)
    return shaped(found.select("list", "id", F.md5("abstract").alias("digest"), slug(F.array_join("authors", "|")).alias("authors"), F.array_join("categories", "|").alias("categories"), F.col("published").cast("string").alias("published")), "list:bigint", "id:string", "digest:string", "authors:string", "categories:string", "published:string")


SQL["oai_list_records"] = f"""WITH {PAPERS}, {_KEPT}
SELECT pos // 50 AS list, CASE WHEN pos % 2 = 0 THEN '2407.' ELSE 'old-' END || id AS id, md5(a) AS digest, 'j-doe-roe' AS authors, array_to_string(list_filter([source, lang], lambda x: coalesce(x, '') <> ''), '|') AS categories, CASE WHEN pos % 2 = 0 THEN '2024-07-01' ELSE day END AS published
FROM k WHERE pos % 7 <> 0 AND t <> '' AND strlen(a) > 200"""


def vector_matrix(spark, d):
    """The vectors written as matrix files by tasks, and read again."""
    path = scratch(spark, "matrix")
    files.save_vectors(vectors(spark, d), path)
    return shaped(files.load_vectors(spark, path).select("pos", F.posexplode("v").alias("i", "x")), "pos:bigint", "i:bigint", "x:double")


SQL["vector_matrix"] = "SELECT vec_id AS pos, unnest(range(len(embedding))) AS i, round(unnest(embedding)::DOUBLE, 6) AS x FROM embeddings"

for _f in (atom_feed_records, oai_list_records, vector_matrix):
    QUERIES[_f.__name__] = _f
