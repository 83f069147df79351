"""Harvests: pages of a service, quotas of keywords and years, failover, and a Spark data source over them."""

from __future__ import annotations

import email.utils
import math
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..operators.records import Seen, keep
from . import decode as D
from . import requests as Q

Fetch = Callable[[str], bytes]
MAX_BODY = 64 << 20
KEYS = re.compile(r"((?:api_?key|token)=)[^&]+", re.IGNORECASE)


def redacted(url: str) -> str:
    return KEYS.sub(r"\1***", url)


def http(delay: float = 3.0, tries: int = 4, longest: float = 60.0, opened: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep) -> Fetch:
    """A polite fetcher: a pause before each request, more tries when a service is busy or slow."""

    def wait_told(headers) -> float | None:
        told = headers.get("Retry-After") if headers else None
        if not told:
            return None
        if told.isdigit():
            return float(told)
        parsed = email.utils.parsedate_to_datetime(told)
        return max(0.0, parsed.timestamp() - time.time())

    def fetch(url: str) -> bytes:
        for n in range(tries):
            sleep(delay)
            try:
                with opened(url, timeout=30) as answer:
                    body = answer.read(MAX_BODY + 1)
                if len(body) > MAX_BODY:
                    raise OSError(f"{redacted(url)}: an answer of over {MAX_BODY} bytes")
                return body
            except urllib.error.HTTPError as error:
                if error.code not in (429, 503) or n + 1 == tries:
                    raise OSError(f"{redacted(url)}: status {error.code}") from error
                pause = wait_told(error.headers)
            except TimeoutError as error:
                if n + 1 == tries:
                    raise OSError(f"{redacted(url)}: timed out") from error
                pause = None
            sleep(min(longest, pause) if pause is not None else 5 * delay * 2**n)
        raise OSError(redacted(url))

    return fetch


def pages(h: Q.Harvest, fetch: Fetch) -> Iterator[list[dict]]:
    """The pages of records of one span, until the service has no more."""
    if h.source == "arxiv":
        start, size = 0, min(Q.ARXIV_PAGE, h.most)
        while size:
            found, n = D.atom(fetch(Q.arxiv_url(h, start)))
            yield found
            if n < size:
                return
            start += n
    elif h.source == "openalex":
        cursor = "*"
        while cursor:
            found, cursor = D.openalex(fetch(Q.openalex_url(h, cursor)))
            yield found
    elif h.source == "semanticscholar":
        offset = 0
        while offset < Q.S2_WINDOW:
            found, following = D.semantic_scholar(fetch(Q.s2_url(h, offset)))
            yield found
            if following <= offset:
                return
            offset = following
    elif h.source == "oai":
        for name in dict.fromkeys(Q.oai_set(c) for c in Q.nonblank(h.categories)):
            token = ""
            while True:
                found, token = D.oai(fetch(Q.oai_url(h, name, token)))
                yield found
                if not token:
                    break
    else:
        raise ValueError(f"{h.source} has no pages")


Link = Callable[[Q.Harvest, Seen], tuple[list[dict], Exception | None]]


def link(source: str, fetch: Fetch) -> Link:
    """One service as a link: what it kept, and the error that ended it early, if any."""

    def run(h: Q.Harvest, seen: Seen) -> tuple[list[dict], Exception | None]:
        held: list[dict] = []
        try:
            for page in pages(Q.replace(h, source=source), fetch):
                keep(seen, page, h.most, held)
                if len(held) >= h.most:
                    break
        except (OSError, ValueError) as error:
            return held, error
        return held, None

    return run


class Router:
    """Links in order: what one leaves unfilled because it failed, the next one fills; a failed one stays out.

    A short answer is no failure.
    """

    def __init__(self, links: list[tuple[str, Link]]):
        self.links, self.errors = links, {}

    def __call__(self, h: Q.Harvest, seen: Seen) -> tuple[list[dict], Exception | None]:
        held: list[dict] = []
        for name, run in self.links:
            if name in self.errors:
                continue
            found, error = run(Q.replace(h, most=h.most - len(held)), seen)
            held += found
            if error is None:
                return held, None
            self.errors[name] = error
            if len(held) >= h.most:
                return held, None
        return held, OSError("; ".join(f"{n}: {e}" for n, e in self.errors.items()))


def harvest(h: Q.Harvest, run: Link) -> tuple[list[dict], Exception | None]:
    """All spans of a harvest. Keywords have equal shares; a year's unfilled records go to older years.

    A span that has records despite its error counts as done; one without ends the harvest.
    """
    seen, held = Seen(), []
    words = Q.nonblank(h.keywords) or [None]
    share = math.ceil(h.most / len(words))
    years = list(range(h.last, h.first - 1, -1)) if h.first and h.last and h.last > h.first else [None]
    for word in words:
        room = min(share, h.most - len(held))
        for i, year in enumerate(years):
            quota = math.ceil(room / (len(years) - i))
            if quota <= 0:
                continue
            found, error = run(h.span(word, year, quota), seen)
            held += found
            room -= len(found)
            if error and not found:
                return held, error
    return held, None


@dataclass
class Span(InputPartition):
    span: Q.Harvest


def narrowed(h: Q.Harvest, asked: Filter) -> Q.Harvest | None:
    """The harvest of what can pass a filter on published or primaryCategory; null if nothing can.

    Other filters leave it as it is. Years are whole: Spark applies every filter again to the records.
    """
    name, value = asked.attribute if hasattr(asked, "attribute") else (), getattr(asked, "value", None)
    if name == ("published",) and hasattr(value, "year"):
        first, last = h.first, h.last
        if isinstance(asked, EqualTo | GreaterThan | GreaterThanOrEqual):
            first = max(first, value.year)
        if isinstance(asked, EqualTo | LessThan | LessThanOrEqual):
            last = min(last or value.year, value.year)
        return None if last and first > last else Q.replace(h, first=first, last=last)
    if name == ("primaryCategory",) and isinstance(asked, EqualTo | In):
        wanted = tuple(x for x in (asked.value if isinstance(asked, In) else (asked.value,)) if isinstance(x, str))
        under = lambda x: any(x == c or x.startswith(c + ".") for c in h.categories)
        kept = tuple(x for x in wanted if not h.categories or under(x))
        return Q.replace(h, categories=kept) if kept else None
    return h


class HarvestSource(DataSource):
    """spark.read.format("harvest").options(source=, keywords=, categories=, first=, last=, most=).load()

    Papers, and the first of their categories as primaryCategory. One partition for each keyword, and for OAI
    for each set. Records of different partitions can repeat: operators.records.dedupe() settles them.
    """

    #: Replaced in tests; a fetcher waits before each of its own requests.
    fetch: Fetch = staticmethod(http())
    #: Another reader than HarvestReader.
    reads: type[DataSourceReader] | None = None

    @classmethod
    def name(cls) -> str:
        return "harvest"

    def schema(self):
        return T.StructType([*D.PAPER.fields, T.StructField("primaryCategory", T.StringType())])

    def reader(self, schema):
        split = lambda key: tuple(x for x in self.options.get(key, "").split(",") if x.strip())
        asked = Q.Harvest(split("keywords"), split("categories"), int(self.options.get("first", 0)), int(self.options.get("last", 0)), int(self.options.get("most", 1000)), self.options.get("source", "arxiv"))
        return (self.reads or HarvestReader)(asked, type(self).fetch)


class HarvestReader(DataSourceReader):
    def __init__(self, asked: Q.Harvest, fetch: Fetch):
        self.asked, self.fetch, self.none = asked, fetch, False

    def partitions(self):
        if self.none:
            return [Span(Q.replace(self.asked, most=0))]
        words = Q.nonblank(self.asked.keywords) or [None]
        share = math.ceil(self.asked.most / len(words))
        if self.asked.source == "oai":  # a partition a set, however many categories name it, with equal shares
            sets = {Q.oai_set(c): c for c in reversed(Q.nonblank(self.asked.categories))}
            return [Span(Q.replace(self.asked, categories=(c,), most=math.ceil(self.asked.most / len(sets)))) for c in sets.values()]
        return [Span(self.asked.span(w, None, share)) for w in words]

    def read(self, partition: Span):
        if not partition.span.most:
            return
        run = link(partition.span.source, self.fetch) if partition.span.source != "auto" else Router([(n, link(n, self.fetch)) for n in ("arxiv", "openalex", "semanticscholar")])
        found, error = harvest(partition.span, run)
        if error and not found:
            raise error
        for r in found:
            yield (*(r[f.name] for f in D.PAPER), next(iter(r["categories"]), None))


class PushingReader(HarvestReader):
    def pushFilters(self, filters):
        for asked in filters:
            found = narrowed(self.asked, asked)
            self.none |= found is None
            self.asked = found or self.asked
            yield asked  # Spark applies it too, as a request knows whole years


class PushedHarvestSource(HarvestSource):
    """The same, with filters on published and primaryCategory in the request, so that `most` counts records within them.

    Spark wants spark.sql.python.filterPushdown.enabled for it, which register() sets.
    """

    reads = PushingReader


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PushedHarvestSource)
