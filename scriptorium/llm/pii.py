"""Personal data: patterned entities, and the terms that give them away.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. The disclosure of a term t is
its pointwise mutual information with what it gives away, x, over the information content of x,
log2(p(x | t) / p(x)) / -log2 p(x): 1 if the term stands nowhere else. p(x) is the share of documents with x,
p(x | t) = n(t, x) / n(t) of those with t, counted over the whole corpus. A term discloses at MIN_DISCLOSURE or
more for one of these, if its support is MIN_ENTITIES or more:

* x a kind, t among the NEAR terms before or behind an entity of it; the support is the number of different entities;
* x a kind, t anywhere in the document; the support is the number of different texts;
* x one entity, t anywhere in the document; the support is the number of different texts.

It is a span of kind term wherever it stands, outside entities, in a document with x. In a sanitised text
entities are generalised to their kind and such terms are removed.

Defined results: a null text counts as empty; without entities there are no terms; a kind that every
document has discloses nothing; a null doc_id is kept as null; repeated rows give a row each, and count
each; an empty table gives an empty result; further columns are ignored (the pipeline's stage returns
them, with n_chars, if there is one, counted anew where a text changes).
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Sieve, record_batch, stored, table, text_hash

KINDS = ("email", "ip", "card", "phone", "term")
NEAR = 4
MIN_DISCLOSURE, MIN_ENTITIES = 0.8, 5
REMOVED = "[REMOVED]"
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match begins where its run of digits does; saying so keeps long runs of digits linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    values = [ord(x) - 48 for x in reversed(digits)]
    return sum(values[::2], sum(_DOUBLED[x] for x in values[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, sought from each @ so that long runs stay linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            done = found.end()
            yield start, done
            at = text.find("@", done)
        else:
            done = max(done, at + 1)  # no match reaches over an @ that fails
            at = text.find("@", at + 1)


def entities(text: str) -> list[tuple[int, int, int]]:
    """The base spans (start, kind, end) of a text, in order."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for kind, pattern, least, most in ((2, _CARD, 12, 19), (3, _PHONE, 9, 15)):
            for m in pattern.finditer(text):
                digits = "".join(_DIGIT.findall(m[0]))
                if least <= len(digits) <= most and (kind != 2 or luhn(digits)):
                    out.append((m.start(), kind, m.end()))
    return sorted(out)


def _placed(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, outside) of all terms of a text, in order; outside: whether it lies outside all entities."""
    out, at, reached = [], 0, 0
    for m in _TERM.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            reached = max(reached, spans[at][2])
            at += 1
        out.append((m.start(), m.end(), reached <= m.start()))
    return out


def neighbours(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str, int, str]]:
    """(start, end, term, kind, entity) of the terms among the NEAR before and behind an entity, outside all entities.

    Terms are counted one by one, however far they are.
    """
    placed = _placed(text, spans)
    begins, ends = [x[0] for x in placed], [x[1] for x in placed]
    out = set()
    for start, kind, end in spans:
        before, behind = bisect_right(ends, start), bisect_left(begins, end)
        for a, b, outside in placed[max(0, before - NEAR) : before] + placed[behind : behind + NEAR]:
            if outside:
                out.add((a, b, text[a:b].lower(), kind, text[start:end]))
    return sorted(out)


def terms(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, term) of the terms outside all entities, in order."""
    return [(a, b, text[a:b].lower()) for a, b, outside in _placed(text, spans) if outside]


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_INT, _LONG, _STRING = T.IntegerType(), T.LongType(), T.StringType()
_SPAN = _struct(start=_INT, kind=_INT, end=_INT)
_MARKS = _struct(
    _hash=_LONG,
    _row=_LONG,
    _spans=T.ArrayType(_SPAN),
    _near=T.ArrayType(_struct(term=_STRING, kind=_INT, entity=_STRING)),
    _found=T.ArrayType(_struct(kind=_INT, entity=_STRING)),
    _held=_STRING,
)
_ARROW = {
    "_spans": pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])),
    "_near": pa.list_(pa.struct([("term", pa.string()), ("kind", pa.int32()), ("entity", pa.string())])),
    "_found": pa.list_(pa.struct([("kind", pa.int32()), ("entity", pa.string())])),
}
#: Entries of a task's table of counts before it sends them.
SENT = 300_000


def _marked(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns to keep and _MARKS of every row, as a written table; _held is the text of rows with entities."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[str, list] = {name: [] for name in _ARROW}
            texts = []
            for value in batch.column("_text").to_pylist():
                found = entities(value or "")
                rows = {
                    "_spans": found,
                    "_near": sorted({x[2:] for x in neighbours(value, found)}) if found else [],
                    "_found": sorted({(k, value[a:b]) for a, k, b in found}),
                }
                texts.append(value if found else None)
                for name, kind in _ARROW.items():
                    names = [f.name for f in kind.value_type]
                    made[name].append([dict(zip(names, x, strict=True)) for x in rows[name]])
            held = [batch.column(c) for c in (*keep, "_hash", "_row")]
            yield pa.RecordBatch.from_arrays([*held, *(pa.array(made[n], k) for n, k in _ARROW.items()), pa.array(texts, pa.string())], names=[*keep, *_MARKS.names])

    rows = docs.select(*keep, F.xxhash64(text).alias("_hash"), F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"))
    schema = T.StructType([*(docs.schema[c] for c in keep), *_MARKS.fields])
    return stored(rows.mapInArrow(kernel, schema), "marked")


def term_documents(docs: DataFrame, text: str) -> DataFrame:
    """(term, docs): in how many documents each term stands; a task sums up before it sends."""
    schema = pa.schema([("term", pa.string()), ("docs", pa.int64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for value in batch.column("_text").to_pylist():
                if value:
                    counts.update(set(_TERM.findall(value.lower())))
                if len(counts) > SENT:
                    yield record_batch(schema, [list(counts), list(counts.values())])
                    counts = Counter()
        yield record_batch(schema, [list(counts), list(counts.values())])

    return docs.select(F.col(text).alias("_text")).mapInArrow(kernel, "term string, docs bigint").groupBy("term").agg(F.sum("docs").alias("docs"))


def _with_entities(marked: DataFrame) -> DataFrame:
    """(_row, _hash, _held, _spans, _kinds, _keys) of the rows with entities; _keys are the entities' hashes."""
    rows = marked.where(F.size("_found") > 0)
    keys = F.transform("_found", lambda x: F.xxhash64(x["kind"], x["entity"]))
    return rows.select("_row", "_hash", "_held", "_spans", F.transform("_found", lambda x: x["kind"]).alias("_kinds"), keys.alias("_keys"))


def _unsigned(key: int) -> int:
    return key & 0xFFFFFFFFFFFFFFFF


def _beside(marked: DataFrame, often: Sieve, least: int) -> DataFrame:
    """(term, kind, entity, both): terms in the documents of a kind (entity 0) or of an entity in so many different texts or more.

    A task sums up before it sends, with least different texts of each entry at most: if there are so many
    in the corpus, a task has so many, or the tasks send all they have.
    """
    schema = pa.schema([("term", pa.string()), ("kind", pa.int32()), ("entity", pa.int64()), ("n", pa.int64()), ("hash", pa.int64())])
    held = marked.sparkSession.sparkContext.broadcast(often)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int, int], int] = {}
        texts: dict[tuple[str, int, int], set[int]] = {}
        sieve = held.value

        def sent() -> Iterator[pa.RecordBatch]:
            rows = [(*key, n if not i else 0, x) for key, n in counts.items() for i, x in enumerate(texts[key])]
            counts.clear()
            texts.clear()
            for lo in range(0, len(rows), 100_000):
                yield record_batch(schema, [list(x) for x in zip(*rows[lo : lo + 100_000], strict=True)])

        for batch in batches:
            hashes = batch.column("_hash").to_pylist()
            for value, spans, kinds, keys, own in zip(*(batch.column(c).to_pylist() for c in ("_held", "_spans", "_kinds", "_keys")), hashes, strict=True):
                what = {(k, 0) for k in kinds} | {(k, x) for k, x in zip(kinds, keys, strict=True) if _unsigned(x) in sieve}
                for t in {x for _, _, x in terms(value, [tuple(s.values()) for s in spans])}:
                    for k, x in what:
                        key = (t, k, x)
                        if key in counts:
                            counts[key] += 1
                            seen = texts[key]
                            if len(seen) < least:
                                seen.add(own)
                        else:
                            counts[key] = 1
                            texts[key] = {own}
                    # within a text as well: a long one with many entities has many pairs
                    if len(counts) > SENT:
                        yield from sent()
        yield from sent()

    rows = _with_entities(marked).mapInArrow(kernel, "term string, kind int, entity bigint, n bigint, hash bigint").repartition("term", "kind", "entity")
    each = rows.groupBy("term", "kind", "entity", "hash").agg(F.sum("n").alias("n"))
    return each.groupBy("term", "kind", "entity").agg(F.sum("n").alias("both"), F.count("*").alias("texts")).where(F.col("texts") >= least).drop("texts")


def disclosing(docs: DataFrame, marked: DataFrame, text: str, least: float = MIN_DISCLOSURE, entities: int = MIN_ENTITIES) -> DataFrame:
    """(term, kind, entity) of the terms at the thresholds or above; entity is a hash, 0 for the whole kind."""
    near = marked.select("_row", F.explode("_near").alias("n")).select("_row", "n.term", "n.kind", F.xxhash64("n.entity").alias("entity"))
    # documents before entities, so that what a copied text repeats is summed up first
    documents = near.select("_row", "term", "kind").distinct().groupBy("term", "kind").agg(F.count("*").alias("both"))
    different = near.select("term", "kind", "entity").distinct().groupBy("term", "kind").agg(F.count("*").alias("entities")).where(F.col("entities") >= entities)
    found = marked.select(F.explode("_found").alias("x"), "_row", "_hash").select("x.kind", F.xxhash64("x.kind", "x.entity").alias("entity"), "_row", "_hash")
    kinds = found.select("kind", "_row").distinct().groupBy("kind").agg(F.count("*").alias("with")).select("kind", F.lit(0).cast("bigint").alias("entity"), "with")
    # beside entities in fewer texts no term has the support
    each = found.groupBy("kind", "entity", "_hash").agg(F.count("*").alias("n")).groupBy("kind", "entity").agg(F.sum("n").alias("with"), F.count("*").alias("texts"))
    each = stored(each.where(F.col("texts") >= entities).select("kind", "entity", "with"), "entities")
    beside = _beside(marked, Sieve.of(each, "entity"), entities)
    zero = F.lit(0).cast("bigint").alias("entity")
    pairs = documents.join(different, ["term", "kind"]).select("term", "kind", zero, "both").union(beside.select("term", "kind", "entity", "both"))
    pairs = stored(pairs.groupBy("term", "kind", "entity").agg(F.max("both").alias("both")).join(each.union(kinds), ["kind", "entity"]).select("term", "kind", "entity", "both", "with"), "pairs")
    # one row
    total = marked.agg(F.count("*").alias("all"))
    counted = pairs.join(term_documents(docs, text), "term").join(F.broadcast(total))
    share = F.col("with") / F.col("all")
    pmi = F.log2(F.col("both") / F.greatest("docs", "both") / share)
    return counted.where(share < 1).where(pmi / -F.log2(share) >= least).select("term", "kind", "entity")


def _added(marked: DataFrame, terms_found: DataFrame) -> DataFrame:
    """(_row, _added): the spans of the disclosing terms of the rows that have any, in order."""
    spark = marked.sparkSession
    wanted = stored(terms_found, "terms")
    sieve = spark.sparkContext.broadcast(Sieve.of(wanted.select(F.xxhash64("term").alias("key")), "key"))
    schema = pa.schema([("_row", pa.int64()), ("term", pa.string()), ("kind", pa.int32()), ("entity", pa.int64()), ("at", pa.list_(pa.int32()))])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe: dict[str, bool] = {}
        for batch in batches:
            out: list[tuple] = []
            for row, value, spans, kinds, keys in zip(*(batch.column(c).to_pylist() for c in ("_row", "_held", "_spans", "_kinds", "_keys")), strict=True):
                places: dict[str, list[int]] = {}
                for a, b, t in terms(value, [tuple(s.values()) for s in spans]):
                    if (good := maybe.get(t)) is None:
                        if len(maybe) > SENT:
                            maybe.clear()
                        good = maybe[t] = text_hash(t) in sieve.value
                    if good:
                        places.setdefault(t, []).extend((a, b))
                what = {(k, 0) for k in kinds} | set(zip(kinds, keys, strict=True))
                for t, at in places.items():
                    out += [(row, t, k, x, at) for k, x in what]
                    if len(out) > SENT:
                        yield record_batch(schema, [list(x) for x in zip(*out, strict=True)])
                        out = []
            yield record_batch(schema, [list(x) for x in zip(*out, strict=True)] or [[]] * 5)

    rows = _with_entities(marked).mapInArrow(kernel, "_row bigint, term string, kind int, entity bigint, at array<int>")
    hits = rows.join(wanted, ["term", "kind", "entity"]).groupBy("_row").agg(F.flatten(F.collect_set("at")).alias("at"))
    starts = F.filter("at", lambda _, i: i % 2 == 0)
    ends = F.filter("at", lambda _, i: i % 2 == 1)
    return hits.select("_row", F.array_sort(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), F.lit(KINDS.index("term")).alias("kind"), b.alias("end")))).alias("_added"))


def _none() -> Column:
    return F.array().cast(T.ArrayType(_SPAN))


def spelled(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(x) for x in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, added) for each row of docs: arrays of spans (start, kind, end), in order."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    marked = _marked(rows, "text", ["doc_id"])
    added = _added(marked, disclosing(rows, marked, "text"))
    plain = marked.where(F.size("_found") == 0).select("doc_id", F.col("_spans").alias("base"), _none().alias("added"))
    joined = marked.where(F.size("_found") > 0).join(added, "_row", "left").select("doc_id", F.col("_spans").alias("base"), F.coalesce("_added", _none()).alias("added"))
    return plain.union(joined)


def sanitise(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each entity, and what overlaps it, as its kind in brackets, and terms removed."""
    out, at, open_end = [], 0, 0
    for start, kind, end in sorted(spans, key=lambda x: (x[0], -x[2])):
        if start >= open_end:
            out += [text[at:start], REMOVED if KINDS[kind] == "term" else f"[{KINDS[kind].upper()}]"]
        open_end = max(open_end, end)
        at = open_end
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with sanitised texts, all their columns in order. Only rows with terms and entities are joined."""
    # numbered names can't clash with those made here
    plainly = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    count = f"c{docs.columns.index('n_chars')}" if "n_chars" in docs.columns else ""
    return _sanitised(plainly, f"c{docs.columns.index(text)}", count).toDF(*docs.columns)


def _sanitised(docs: DataFrame, text: str, count: str) -> DataFrame:
    marked = _marked(docs, text, docs.columns)
    added = _added(marked, disclosing(docs, marked, text))
    plain = marked.where(F.size("_found") == 0).select(*docs.columns, F.col("_spans").alias("_all"))
    joined = marked.where(F.size("_found") > 0).join(added, "_row", "left").select(*docs.columns, F.concat("_spans", F.coalesce("_added", _none())).alias("_all"))

    names = docs.columns

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("_all").to_pylist()
            texts = [sanitise(t, [(x["start"], x["kind"], x["end"]) for x in s]) if s else t for t, s in zip(batch.column(text).to_pylist(), spans, strict=True)]
            columns = {c: batch.column(c) for c in names} | {text: pa.array(texts, pa.string())}
            if count:
                old = columns[count]
                columns[count] = pa.array([len(t) if s else n for t, s, n in zip(texts, spans, old.to_pylist(), strict=True)], old.type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return plain.union(joined).mapInArrow(kernel, docs.schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.array_sort(F.concat("base", "added"))).alias("spans"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A pipeline stage: personal data in the texts gives way to its kind."""
    return sanitised(docs)
