"""Periodic runs of words by Karp-Miller-Rosenberg names: every stretch that repeats a period four times or more.

Words of a text get numbers; a name of level k stands for the 2**k words from a place on, made from two names
of level k - 1. A name that a text has once can't match, so only places with repeated names are named further,
and levels end with the last repeated name. For a period q with 2**k <= q < 2**(k+1) the grid of every q-th
place is laid over the stretches of repeated names of level k that are long enough; a cell whose q words
equal the next q words (two names of level k each) is matched, and a run has at least two neighbouring
matched cells. The first cell of each such row is extended to both sides by longest common extensions,
which go down through the levels of names. Runs found under a multiple of their period go: they cover
the same words as under the least one. No hashes of passages and no suffix array take part.

Texts are worked on whole, some CHUNK words of short texts at a time; a text of n words holds a few arrays of
4 n bytes for each level that still has repeated names.

Defined results: a null text or one without words has n = 0, no runs and the digests of empty texts; a null
doc_id changes no words; equal exponents go to the smaller start, then the smaller period; repeated rows
give a row each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import byte_column, record_batch, table

#: A run is at least so long, and at least so many periods.
MIN_LENGTH, MIN_PERIODS = 6, 4
#: Words of short texts that are worked on together.
CHUNK = 100_000


def repeated_at_will(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, of one document in ten with a periodic end: word i from a = g % n on is word a + (i - a) % p."""
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * (-(-(n - a) // p)))[: n - a]


def names(words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level the name of each place, and the places, in order, of names that occur twice or more.

    words: a number for each word; equal numbers are equal words. Places with a name of their own get n + place.
    """
    n = len(words)
    level: list[tuple[np.ndarray, np.ndarray]] = []
    at, left, right = np.arange(n, dtype=np.int64), words.astype(np.int64), np.zeros(n, np.int64)
    k = 0
    while len(at):
        key = left * (2 * n + 1) + right
        order = np.argsort(key, kind="stable")
        rank = np.zeros(len(at), np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], np.diff(key[order]) != 0)))
        many = np.bincount(rank)[rank] > 1
        name = n + np.arange(n, dtype=np.int32)
        name[at[many]] = rank[many]
        at = at[many]
        if not len(at):
            break
        level.append((name, at))
        half = 1 << k
        at = at[at < n - half]
        left, right = name[at].astype(np.int64), name[at + half].astype(np.int64)
        shared = right < n  # a half of its own can't be repeated
        at, left, right = at[shared], left[shared], right[shared]
        k += 1
    return level


def _same(name: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the names at i and j are equal; places outside of the words equal nothing."""
    n = len(name)
    ok = (i >= 0) & (j < n)
    out = np.zeros(len(i), bool)
    out[ok] = name[i[ok]] == name[j[ok]]
    return out


def extensions(level: list[tuple[np.ndarray, np.ndarray]], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words from i and j (i < j) on are equal, and how many before them, by descending levels."""
    ahead, behind = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for k in range(len(level) - 1, -1, -1):
        name, size = level[k][0], 1 << k
        ahead += np.where(_same(name, i + ahead, j + ahead), size, 0)
        behind += np.where(_same(name, i - behind - size, j - behind - size), size, 0)
    return ahead, behind


def _cells(lo: np.ndarray, hi: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid places i and periods q of level k, i a multiple of q in [lo, hi], for stretches [lo, hi] with room for three periods."""
    size = hi - lo + 1
    least, most = np.full(len(lo), 1 << k), np.minimum((2 << k) - 1, size // (MIN_PERIODS - 1))
    each = np.maximum(0, most - least + 1)
    of = np.repeat(np.arange(len(lo)), each)
    q = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each) + (1 << k)
    first, last = -(-lo[of] // q), hi[of] // q
    each = np.maximum(0, last - first + 1)
    j = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first, each)
    q = np.repeat(q, each)
    return j * q, q


def runs(words: np.ndarray) -> np.ndarray:
    """Rows (start, length, least period) of all runs, in order of start and period."""
    level = names(words)
    n = len(words)
    found = [np.zeros((0, 3), np.int64)]
    for k, (name, at) in enumerate(level):
        # of a run with period q the first length - 2**k places have repeated names: three periods and more
        cut = np.flatnonzero(np.diff(at) != 1)
        lo, hi = at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))]
        wide = hi - lo + 1 >= (MIN_PERIODS - 1) << k
        lo, hi = lo[wide], hi[wide]
        share = np.concatenate(([0], np.cumsum(hi - lo + 1)))
        for part in range(0, int(share[-1]), 1 << 21):  # stretches of some two million places at a time
            some = (share[:-1] >= part) & (share[:-1] < part + (1 << 21))
            i, q = _cells(lo[some], hi[some], k)
            back = 1 << k
            good = _same(name, i, i + q)
            i, q = i[good], q[good]
            good = _same(name, i + q - back, i + 2 * q - back)
            i, q = i[good], q[good]
            if not len(i):
                continue
            key = np.unique(q * (n + 1) + i)  # by period, then place
            q, i = key // (n + 1), key % (n + 1)
            after = np.concatenate(((q[1:] == q[:-1]) & (i[1:] == i[:-1] + q[:-1]), [False]))
            before = np.concatenate(([False], after[:-1]))
            i, q = i[after & ~before], q[after & ~before]
            ahead, behind = extensions(level, i, i + q)
            length = ahead + behind + q
            keep = length >= np.maximum(MIN_LENGTH, MIN_PERIODS * q)
            found.append(np.stack([(i - behind)[keep], length[keep], q[keep]], 1))
    all_runs = np.concatenate(found)
    all_runs = all_runs[np.lexsort((all_runs[:, 2], all_runs[:, 1], all_runs[:, 0]))]
    first = np.ones(len(all_runs), bool)
    first[1:] = (all_runs[1:, :2] != all_runs[:-1, :2]).any(1)
    all_runs = all_runs[first]  # the least period of each stretch came first
    return all_runs[np.lexsort((all_runs[:, 2], all_runs[:, 0]))]


def collapsed(n: int, found: np.ndarray) -> np.ndarray:
    """Whether each of n words is kept: those go that a run contains after its first period."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, found[:, 0] + found[:, 2], 1)
    np.add.at(cover, found[:, 0] + found[:, 1], -1)
    return np.cumsum(cover[:-1]) == 0


def examined(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each text, given as lists of words."""
    out: list[np.ndarray] = []
    lo = 0
    while lo < len(texts):
        hi, size = lo + 1, len(texts[lo])
        while hi < len(texts) and size + len(texts[hi]) <= CHUNK:
            size += len(texts[hi])
            hi += 1
        numbers: list[int] = []
        base = 0
        for words in texts[lo:hi]:  # numbers of one text, so that no name is repeated across texts
            seen: dict[bytes, int] = {}
            numbers += [base + seen.setdefault(w, len(seen)) for w in words]
            base += len(seen)
        found = runs(np.array(numbers, np.int64))
        edge = np.cumsum([0, *(len(x) for x in texts[lo:hi])])
        cuts = np.searchsorted(found[:, 0], edge)
        out += [found[a:b] - [e, 0, 0] for a, b, e in zip(cuts[:-1], cuts[1:], edge[:-1], strict=True)]
        lo = hi
    return out


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, runs, kept): the words' count, all runs and the text without repeated periods of every row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("kept", pa.binary())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            texts = [repeated_at_will(x.split(), d) for x, d in zip(byte_column(batch, "text"), keys, strict=True)]
            found = examined(texts)
            kept = [b" ".join(np.array(w, object)[collapsed(len(w), f)].tolist() if len(f) else w) for w, f in zip(texts, found, strict=True)]
            yield record_batch(schema, [batch.column("doc_id"), [len(w) for w in texts], [[{"start": a, "length": b, "period": c} for a, b, c in f.tolist()] for f in found], kept])

    form = "doc_id bigint, n bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, kept binary"
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(kernel, form)


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"))
    # the greatest exponent in whole numbers: a run beats one before it only if it is truly greater
    best = F.aggregate("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), lambda a, r: F.when(a.isNull() | (r.length * a.period > a.length * r.period), r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    return found.select("doc_id", "n", "runs", "kept", best.alias("b")).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("b.start").alias("start"), F.col("b.length").alias("length"), F.col("b.period").alias("period"),
        F.expr("b.length * 1000 div b.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
    )
