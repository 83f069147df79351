"""What a harvest asks for, and how each service is asked."""

from __future__ import annotations

import datetime
import json
from dataclasses import dataclass, field, replace
from urllib.parse import urlencode

# The services' addresses, page sizes and the fields that are read.
ARXIV, OPENALEX, S2, OAI = "https://export.arxiv.org/api/query", "https://api.openalex.org/works", "https://api.semanticscholar.org/graph/v1/paper/search", "https://oaipmh.arxiv.org/oai"
ARXIV_PAGE, OPENALEX_PAGE, S2_PAGE, S2_WINDOW = 200, 200, 100, 1000
OPENALEX_FIELDS = "id,doi,display_name,publication_date,authorships,abstract_inverted_index,primary_topic,open_access"
S2_FIELDS = "title,abstract,authors,year,publicationDate,externalIds,fieldsOfStudy,isOpenAccess"
TOP_ARCHIVES = {"cs", "math", "stat", "eess", "econ", "q-bio", "q-fin"}
MAX_RECORDS, MAX_CATEGORIES, MAX_NAME = 50_000, 16, 120
SOURCES = ("arxiv", "auto", "kaggle", "semanticscholar", "openalex", "oai")


@dataclass(frozen=True)
class Harvest:
    keywords: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    first: int = 0  # years; 0 for no bound
    last: int = 0
    most: int = 1000
    source: str = "arxiv"
    path: str = ""
    name: str = ""

    def span(self, keyword: str | None, year: int | None, most: int) -> Harvest:
        """The part of this harvest for one keyword and one year."""
        return replace(self, keywords=(keyword,) if keyword is not None else self.keywords, first=year or self.first, last=year or self.last, most=most)


@dataclass(frozen=True)
class Defaults:
    most: int = 1000
    years: int = 7
    today: datetime.date = field(default_factory=datetime.date.today)


def nonblank(parts: tuple[str, ...] | list[str]) -> list[str]:
    return [x.strip() for x in parts if x.strip()]


def validated(h: Harvest, defaults: Defaults | None = None) -> Harvest:
    """The harvest with its defaults, or an error that says what is wrong with it."""
    defaults = defaults or Defaults()
    source = (h.source or "arxiv").strip().lower()
    if source not in SOURCES:
        raise ValueError(f"unknown source {h.source!r}; there are {', '.join(SOURCES)}")
    if h.most < 0:
        raise ValueError("the number of records can't be negative")
    if len(h.categories) > MAX_CATEGORIES:
        raise ValueError(f"at most {MAX_CATEGORIES} categories")
    if len(h.name.encode()) > MAX_NAME:
        raise ValueError(f"a name has at most {MAX_NAME} bytes")
    if source == "oai" and not nonblank(h.categories):
        raise ValueError("oai needs a category")
    if source == "kaggle" and not h.path:
        raise ValueError("kaggle needs the path of a snapshot")
    last = h.last or defaults.today.year
    first = h.first or last - defaults.years
    if first > last:
        raise ValueError("the first year is after the last")
    return replace(h, source=source, most=min(h.most or defaults.most, MAX_RECORDS), first=first, last=last)


def search_string(h: Harvest, this_year: int | None = None) -> str:
    """Categories, keywords and years as one boolean search."""
    either = lambda parts: "(" + " OR ".join(parts) + ")"
    clauses = []
    if cats := nonblank(h.categories):
        clauses.append(either([f"cat:{c}" for c in cats]))
    if words := nonblank(h.keywords):
        clauses.append(either([f'all:"{w}"' for w in words]))
    if h.first > 0 or h.last > 0:
        clauses.append(f"submittedDate:[{h.first or 1991}01010000 TO {h.last or this_year or datetime.date.today().year}12312359]")
    return " AND ".join(clauses) or "all:*"


def year_range(h: Harvest) -> str:
    if h.first <= 0 and h.last <= 0:
        return ""
    if h.first == h.last:
        return str(h.first)
    return f"{h.first if h.first > 0 else ''}-{h.last if h.last > 0 else ''}"


def oai_set(category: str) -> str:
    archive, _, rest = category.strip().partition(".")
    return ":".join(x for x in (archive if archive in TOP_ARCHIVES else "physics", archive, rest) if x)


def arxiv_url(h: Harvest, start: int, base: str = ARXIV) -> str:
    return f"{base}?{urlencode({'search_query': search_string(h), 'start': start, 'max_results': min(ARXIV_PAGE, h.most), 'sortBy': 'submittedDate', 'sortOrder': 'descending'})}"


def openalex_url(h: Harvest, cursor: str = "*", base: str = OPENALEX, key: str = "") -> str:
    words = nonblank(h.keywords)
    filters = ["title_and_abstract.search:" + "|".join(json.dumps(w, ensure_ascii=False) for w in words)] if words else []
    filters += [f"publication_year:{years}"] if (years := year_range(h)) else []
    filters.append("type:article|preprint|review")
    asked = {"filter": ",".join(filters), "sort": "relevance_score:desc" if words else "publication_date:desc", "per_page": OPENALEX_PAGE, "select": OPENALEX_FIELDS, "cursor": cursor}
    return f"{base}?{urlencode(asked | ({'api_key': key} if key else {}))}"


def s2_url(h: Harvest, offset: int = 0, base: str = S2) -> str:
    asked = {"fields": S2_FIELDS, "limit": S2_PAGE, "offset": offset, "query": " ".join(nonblank(h.keywords))}
    return f"{base}?{urlencode(asked | ({'year': years} if (years := year_range(h)) else {}))}"


def oai_url(h: Harvest, name: str, token: str = "", base: str = OAI) -> str:
    if token:
        return f"{base}?{urlencode({'verb': 'ListRecords', 'resumptionToken': token})}"
    asked = {"verb": "ListRecords", "metadataPrefix": "arXiv", "set": name}
    return f"{base}?{urlencode(asked | ({'from': f'{h.first}-01-01'} if h.first > 0 else {}))}"
