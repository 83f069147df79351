"""Pages of the services as records: plain dicts in the order of PAPER."""

from __future__ import annotations

import datetime
import json
import re
from xml.etree import ElementTree

from pyspark.sql import types as T

PAPER = T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("abstract", T.StringType()), T.StructField("authors", T.ArrayType(T.StringType())), T.StructField("categories", T.ArrayType(T.StringType())), T.StructField("published", T.DateType()), T.StructField("openAccess", T.BooleanType())])
MIN_ABSTRACT_BYTES = 200
_VERSION = re.compile(r"^(.+)v[0-9]+$")


def squash(text: str | None) -> str:
    return " ".join((text or "").split())


def bare_id(identifier: str) -> str:
    tail = identifier.rsplit("/abs/", 1)[-1]
    return m[1] if (m := _VERSION.match(tail)) else tail


def day(text: str | None) -> datetime.date | None:
    try:
        return datetime.date.fromisoformat((text or "")[:10])
    except ValueError:
        return None


def month_of_id(identifier: str) -> datetime.date | None:
    """The month in an id that begins YYMM after any slash."""
    tail = identifier.rsplit("/", 1)[-1][:4]
    if not re.fullmatch("[0-9]{4}", tail) or not 1 <= int(tail[2:]) <= 12:
        return None
    return datetime.date((1900 if tail[:2] >= "91" else 2000) + int(tail[:2]), int(tail[2:]), 1)


def record(identifier: str, title: str | None, abstract: str | None, authors: list[str], categories: list[str], published: datetime.date | None, open_access: bool) -> dict | None:
    """A squashed record, or none if it lacks an id, a title, a date or an abstract of over 200 bytes."""
    made = {"id": squash(identifier), "title": squash(title), "abstract": squash(abstract), "authors": [a for a in map(squash, authors) if a], "categories": categories, "published": published, "openAccess": open_access}
    return made if made["id"] and made["title"] and published and len(made["abstract"].encode()) > MIN_ABSTRACT_BYTES else None


def _some(found) -> list[dict]:
    return [x for x in found if x]


def atom(body: bytes) -> tuple[list[dict], int]:
    """Records of an Atom feed, and how many entries it had."""
    a, x = "{http://www.w3.org/2005/Atom}", "{http://arxiv.org/schemas/atom}"
    entries = ElementTree.fromstring(body).findall(f"{a}entry")

    def one(e):
        first = (p.get("term") or "") if (p := e.find(f"{x}primary_category")) is not None else ""
        categories = ([first] if first else []) + [t for c in e.findall(f"{a}category") if (t := c.get("term") or "") and t != first]
        return record(bare_id(e.findtext(f"{a}id") or ""), e.findtext(f"{a}title"), e.findtext(f"{a}summary"), [n.text or "" for n in e.findall(f"{a}author/{a}name")], categories, day(e.findtext(f"{a}published")), True)

    return _some(map(one, entries)), len(entries)


def openalex(body: bytes) -> tuple[list[dict], str]:
    """Records of a page of works, and the cursor of the next, blank at the end."""
    page = json.loads(body)

    def one(w):
        placed = sorted((p, word) for word, places in (w.get("abstract_inverted_index") or {}).items() for p in places)
        doi = (w.get("doi") or "").lower()
        own = doi.rsplit("10.48550/arxiv.", 1)
        identifier = bare_id(own[1]) if len(own) == 2 else "openalex:" + (w.get("id") or "").rsplit("/", 1)[-1]
        topic = w.get("primary_topic") or {}
        categories = [n for k in ("subfield", "field") if (n := (topic.get(k) or {}).get("display_name"))]
        authors = [(x.get("author") or {}).get("display_name") or "" for x in w.get("authorships") or []]
        return record(identifier, w.get("display_name"), " ".join(word for _, word in placed), authors, categories, day(w.get("publication_date")), bool((w.get("open_access") or {}).get("is_oa")))

    found = page.get("results") or []
    return _some(map(one, found)), ((page.get("meta") or {}).get("next_cursor") or "") if found else ""


def semantic_scholar(body: bytes) -> tuple[list[dict], int]:
    """Records of a page, and the offset of the next, 0 at the end."""
    page = json.loads(body)

    def one(p):
        arxiv = (p.get("externalIds") or {}).get("ArXiv")
        identifier = bare_id(arxiv) if arxiv else "s2:" + (p.get("paperId") or "")
        published = day(p.get("publicationDate")) or (datetime.date(p["year"], 1, 1) if p.get("year") else None)
        return record(identifier, p.get("title"), p.get("abstract"), [a.get("name") or "" for a in p.get("authors") or []], p.get("fieldsOfStudy") or [], published, bool(p.get("isOpenAccess")))

    return _some(map(one, page.get("data") or [])), page.get("next") or 0


def oai(body: bytes) -> tuple[list[dict], str]:
    """Records of a list, and its resumption token. An empty list is no error; other errors are raised."""
    o, a = "{http://www.openarchives.org/OAI/2.0/}", "{http://arxiv.org/OAI/arXiv/}"
    root = ElementTree.fromstring(body)
    if (error := root.find(f"{o}error")) is not None:
        if error.get("code") == "noRecordsMatch":
            return [], ""
        raise OSError(f"oai: {error.get('code')}: {squash(error.text)}")

    def one(r):
        m = r.find(f"{o}metadata/{a}arXiv")
        if m is None or r.find(f"{o}header").get("status") == "deleted":
            return None
        names = [" ".join(x.findtext(a + k) or "" for k in ("forenames", "keyname", "suffix")) for x in m.findall(f"{a}authors/{a}author")]
        identifier = m.findtext(f"{a}id") or ""
        return record(identifier, m.findtext(f"{a}title"), m.findtext(f"{a}abstract"), names, (m.findtext(f"{a}categories") or "").split(), month_of_id(identifier) or day(m.findtext(f"{a}created")), True)

    return _some(map(one, root.iter(f"{o}record"))), squash(root.findtext(f"{o}ListRecords/{o}resumptionToken"))
