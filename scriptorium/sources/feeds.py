"""Feeds and lists of records in XML, decoded by Spark itself with fixed schemas: a row a feed in, a row a record out.

The same records as decode.py's, for feeds that lie in files or tables: what isn't asked for is never built, and no
Python takes part. Records that fail retention are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import retained, strip_version, year_month_of_id
from ..functions.text import squash, words

# The elements and attributes of the two formats.
ATOM = "entry array<struct<id: string, title: string, summary: string, published: string, author: array<struct<name: string>>, `arxiv:primary_category`: struct<_term: string>, category: array<struct<_term: string>>>>"
OAI = "error struct<_code: string, _VALUE: string>, ListRecords struct<record: array<struct<header: struct<_status: string>, metadata: struct<arXiv: struct<id: string, created: string, title: string, abstract: string, categories: string, authors: struct<author: array<struct<keyname: string, forenames: string, suffix: string>>>>>>>, resumptionToken: string>"
_READ = {"rowTag": "feed", "valueTag": "_VALUE", "attributePrefix": "_", "mode": "PERMISSIVE"}
_PAPER = ("id", "title", "abstract", "authors", "categories", "published", "openAccess")


def _day(text: Column) -> Column:
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def _records(rows: DataFrame, keys: list[str]) -> DataFrame:
    kept = rows.where(retained("id", "title", "abstract", "published"))
    names = F.filter(F.transform("authors", squash), lambda x: F.coalesce(x, F.lit("")) != "")
    tidy = kept.withColumns({"id": squash("id"), "title": squash("title"), "abstract": squash("abstract"), "authors": F.coalesce(names, F.array().cast("array<string>"))})
    return tidy.select(*keys, *_PAPER)


def atom_records(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """A record for each entry of the Atom feeds in column xml, beside the other columns; the primary category comes first."""
    keys = [c for c in feeds.columns if c != xml]
    entries = feeds.select(*keys, F.explode(F.from_xml(xml, ATOM, _READ)["entry"]).alias("_e"))
    first = F.coalesce(F.col("_e")["arxiv:primary_category"]["_term"], F.lit(""))
    others = F.filter(F.transform(F.coalesce(F.col("_e.category"), F.array()), lambda c: c["_term"]), lambda t: F.coalesce(t, F.lit("")) != "")
    categories = F.concat(F.when(first != "", F.array(first)).otherwise(F.array().cast("array<string>")), F.filter(others, lambda t: t != first))
    return _records(entries.select(*keys, strip_version(F.coalesce("_e.id", F.lit(""))).alias("id"), F.col("_e.title").alias("title"), F.col("_e.summary").alias("abstract"), F.transform("_e.author", lambda a: a["name"]).alias("authors"), categories.alias("categories"), _day(F.col("_e.published")).alias("published"), F.lit(True).alias("openAccess")), keys)


def oai_records(lists: DataFrame, xml: str = "xml") -> DataFrame:
    """A record for each live record of the OAI lists in column xml. An empty list gives none; other errors are raised."""
    keys = [c for c in lists.columns if c != xml]
    read = lists.select(*keys, F.from_xml(xml, OAI, _READ | {"rowTag": "OAI-PMH"}).alias("_l"))
    code = F.col("_l.error._code")
    bad = F.raise_error(F.concat_ws(": ", F.lit("oai"), code, squash(F.col("_l.error._VALUE"))))
    found = F.when(code.isNotNull() & (code != "noRecordsMatch"), bad.cast(read.select("_l.ListRecords.record").schema[0].dataType)).otherwise(F.col("_l.ListRecords.record"))
    rows = read.select(*keys, F.explode(found).alias("_r")).where(F.col("_r.metadata.arXiv").isNotNull() & (F.coalesce("_r.header._status", F.lit("")) != "deleted"))
    r = rows.select(*keys, "_r.metadata.arXiv.*")
    author = lambda a: F.concat_ws(" ", a["forenames"], a["keyname"], a["suffix"])
    published = F.coalesce(year_month_of_id("id"), _day(F.col("created")))
    return _records(r.select(*keys, strip_version(F.coalesce("id", F.lit(""))).alias("id"), "title", "abstract", F.transform("authors.author", author).alias("authors"), words("categories").alias("categories"), published.alias("published"), F.lit(True).alias("openAccess")), keys)
