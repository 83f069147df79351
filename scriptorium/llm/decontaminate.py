"""Benchmark decontamination: shared word pairs join training texts to test items, Smith-Waterman scores them.

Texts are lower-cased, ASCII punctuation counts as space. Smith-Waterman aligns the words (match 2, mismatch
-1, gap -1); the score is the best local alignment's over that of the whole item.

The search before it loses nothing. An alignment of k matched words in r unbroken runs scores at most
2 k - (r - 1), so one that reaches T has k + p >= T - 1, p = k - r the pairs of neighbouring matched words; of
an item of m words k <= m, hence p >= T - 1 - m, and all lie within 3 m - T words of text. Every pair of an
item is a seed, and a text is aligned where enough seeds lie that close and k + p is reached. Items so short
that no pair is sure to be shared (5 words or less at MIN_SCORE) are sought by single words, T / 2 of them.

The items are taken in blocks of at most BLOCK_WORDS words, each block broadcast; the size of a block, not
of the benchmark, bounds memory. Texts never leave their task.

Defined results: a null text, or one without words, has no match; nor has a null or empty item; a null
doc_id or item_id is returned as null; repeated rows give a row each; an empty table on either side gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import byte_column, mix, record_batch, table

MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.6
#: Words of the items in one broadcast block (some 100 MB of tables).
BLOCK_WORDS = 1_000_000
_CLEAR = bytes(32 if x < 48 or 58 <= x < 65 or 91 <= x < 97 or 123 <= x < 128 else x for x in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_CLEAR).split()


def _grams(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit code for each n ids in a row; 0 if an id is 0 (a word that no item has)."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(ids) - n + 1, np.uint64)
    known = np.ones(len(out), bool)
    for i in range(n):
        part = ids[i : len(ids) - n + 1 + i]
        known &= part > 0
        out = out * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64)
    out = mix(out) | np.uint64(1)
    out[~known] = 0
    return out


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """The best local alignment of two arrays of word ids: its score, and its start and end in text."""
    n = len(text)
    score, start = np.zeros(n + 1, np.int32), np.arange(n + 1, dtype=np.int32)
    best, place = 0, (0, 0)
    column = np.arange(n + 1, dtype=np.int32)
    for word in item.tolist():
        diagonal = np.empty(n + 1, np.int32)
        diagonal[0] = 0
        diagonal[1:] = score[:-1] + np.where(text == word, MATCH, MISMATCH)
        origin = column.copy()
        origin[1:] = start[:-1]
        up = score + GAP
        origin = np.where(up > diagonal, start, origin)
        here = np.maximum(diagonal, up)
        fresh = here <= 0
        here[fresh] = 0
        origin[fresh] = column[fresh]
        # gaps along the text: the running maximum of score less the cost of the way to it
        level = here - GAP * column
        top = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == top, column, 0))
        score, start = top + GAP * column, origin[source]
        at = int(score.argmax())
        if score[at] > best:
            best, place = int(score[at]), (int(start[at]), at)
    return best, *place


class Index:
    """A block of items: their words as ids and the items of every seed."""

    def __init__(self, items: list[tuple[int | None, str]], least: float = MIN_SCORE):
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.words = [], []
        for key, text in items:
            words = words_of(text)
            if words:
                self.ids.append(key)
                self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int32))
        m = np.array([len(w) for w in self.words], np.int64)
        self.goal = np.array([max(1, math.ceil(least * MATCH * n - 1e-9)) for n in m.tolist()], np.int64)
        self.reach = np.maximum(3 * m - self.goal, 1)
        pairs = self.goal - 1 - m
        self.need = np.where(pairs > 0, pairs, (self.goal + 1) // 2)
        self.distinct = [np.unique(w) for w in self.words]
        self.pairs = [np.unique(_grams(w, 2)) for w in self.words]
        self.seeds: dict[int, np.ndarray] = {}
        self.bounds: dict[int, np.ndarray] = {}
        self.owners: dict[int, np.ndarray] = {}
        for size in (1, 2):
            chosen = [i for i in range(len(m)) if (pairs[i] > 0) == (size == 2)]
            if chosen:
                grams = [self.pairs[i] if size == 2 else np.unique(_grams(self.words[i], 1)) for i in chosen]
                flat, owner = np.concatenate(grams), np.repeat(chosen, [len(g) for g in grams])
                order = np.argsort(flat, kind="stable")
                self.seeds[size], first = np.unique(flat[order], return_index=True)
                self.bounds[size] = np.append(first, len(flat))
                self.owners[size] = owner[order]

    def read(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in words), np.int32, len(words))

    def near(self, ids: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(item, [(first, last)]): the places of the item's seeds wherever enough of them lie within its reach."""
        for size, seeds in self.seeds.items():
            grams = _grams(ids, size)
            at = np.flatnonzero(grams)
            if not len(at):
                continue
            number = np.searchsorted(seeds, grams[at])
            found = seeds[np.minimum(number, len(seeds) - 1)] == grams[at]
            at, number = at[found], number[found]
            if not len(at):
                continue
            bounds = self.bounds[size]
            many = bounds[number + 1] - bounds[number]
            begin = np.repeat(bounds[number] - np.cumsum(many) + many, many)
            items, places = self.owners[size][begin + np.arange(len(begin))], np.repeat(at, many)
            order = np.argsort(items, kind="stable")  # places stay in order
            items, places = items[order], places[order]
            last = np.arange(len(items)) + self.need[items] - 1
            inside = np.minimum(last, len(items) - 1)
            hit = np.flatnonzero((last < len(items)) & (items[inside] == items) & (places[inside] - places < self.reach[items]))
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(items[hit])) + 1, [len(hit)])).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo < hi:
                    part = hit[lo:hi]
                    yield int(items[part[0]]), list(zip(places[part].tolist(), places[inside[part]].tolist(), strict=True))

    def _can(self, item: int, ids: np.ndarray) -> bool:
        """Whether words and pairs of the item within its reach are enough for its goal."""
        score = np.isin(ids, self.distinct[item]).astype(np.int64)
        score[:-1] += np.isin(_grams(ids, 2), self.pairs[item]) if len(ids) > 1 else 0
        total = np.concatenate(([0], np.cumsum(score)))
        reach = min(int(self.reach[item]), len(ids))
        return int((total[reach:] - total[: len(total) - reach]).max()) >= self.goal[item] - 1

    def matches(self, ids: np.ndarray, least: float) -> list[tuple[int, float, int, int]]:
        """(item, score, start, end) of each item aligned to ids at the least score or better; places in words."""
        out = []
        for item, clusters in self.near(ids):
            words, reach = self.words[item], int(self.reach[item])
            best = (0, 0, 0)
            spans: list[list[int]] = []
            for first, last in clusters:  # windows that overlap are one
                lo, hi = max(0, last - reach), min(len(ids), first + reach + 1)
                if spans and lo <= spans[-1][1] and hi - spans[-1][0] <= 8 * len(words) + 64:
                    spans[-1][1] = max(hi, spans[-1][1])
                else:
                    spans.append([lo, hi])
            for lo, hi in spans:
                if self._can(item, ids[lo:hi]):
                    score, a, b = align(words, ids[lo:hi])
                    if score > best[0]:
                        best = (score, lo + a, lo + b)
            if best[0] >= least * MATCH * len(words):
                out.append((item, best[0] / (MATCH * len(words)), best[1], best[2]))
        return out


def _blocks(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of at most so many words (an item beyond that is a block of its own)."""
    block, size = [], 0
    for row in benchmark.select(F.col(item).cast("bigint").alias("i"), F.col(text).alias("t")).where("t is not null").toLocalIterator():
        n = len(words_of(row.t))
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((row.i, row.t))
        size += n
    if block:
        yield block


def _indexes(docs: DataFrame, benchmark: DataFrame, item: str, item_text: str, least: float, block_words: int) -> Iterator[Broadcast[Index]]:
    """An index for each block of items, broadcast."""
    for items in _blocks(benchmark, item, item_text, block_words):
        index = Index(items, least)
        if index.ids:
            yield docs.sparkSession.sparkContext.broadcast(index)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: float = MIN_SCORE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, score, start, end): each item found in each text, its best place there in words."""
    form = "doc_id bigint, item_id bigint, score double, start int, end int"
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    out = docs.sparkSession.createDataFrame([], form)
    for held in _indexes(docs, benchmark, item, item_text, least, block_words):

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                found = [(d, index.ids[i], s, a, b) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for i, s, a, b in index.matches(index.read(t), least)]
                yield record_batch(schema, [list(x) for x in zip(*found, strict=True)] if found else [[]] * 5)

        out = out.unionByName(rows.mapInArrow(search, form))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", least: float = MIN_SCORE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that hold no item, all their columns unchanged; nothing is shuffled."""
    out = docs
    for held in _indexes(docs, benchmark, item, item_text, least, block_words):

        def sieve(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                yield batch.filter(pa.array([not index.matches(index.read(t), least) for t in batch.column(text).to_pylist()], pa.bool_()))

        out = out.mapInArrow(sieve, docs.schema)
    return out


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A pipeline stage: documents that hold a benchmark item go."""
    return clean(docs, table(spark, sf_dir, "benchmark"))
