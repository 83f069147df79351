"""The best products of sparse vectors, block by block: sums of pairs stay in the task that makes them.

A join on terms makes a row for each term that two texts share, and a row for each pair. Here up to BLOCK
vectors are packed into one row and dealt over the cells of a grid; a pair of blocks is one matrix of scores,
of which the best k a vector leave. A cell goes through its pairs one by one, so that a task holds two blocks,
a slice of their scores and the best k so far, whatever the size of the tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Vectors and entries that are packed into one row.
BLOCK, ENTRIES = 2048, 1 << 19
#: Rows of a block that are scored at once, and products that are summed up at once.
SLICE, PRODUCTS = 512, 1 << 21
#: A term goes through the dense product if its postings' product is this share of all pairs at least.
DENSE, DENSE_TERMS = 1 / 128, 1024
#: Bytes of best rows that a task keeps before it hands them on.
KEPT = 64 << 20

_PARTS = {"keys": "<i8", "extra": "<f8", "terms": "<i8", "starts": "<i8", "rows": "<u2", "weights": "<f8"}
_CHOSEN = {"asking": "<u2", "others": "<i8"}


def packed(vectors: DataFrame, key: str, extra: Column | None = None, chosen: DataFrame | None = None) -> DataFrame:
    """Blocks of vectors(key, term, w): keys, and the entries in order of their terms.

    A term stands as its 64-bit hash. extra is a value a vector, the same in all its rows. With
    chosen(key, others), the keys that a vector is to be scored with, blocks hold these too, as rows and keys.
    """
    entry = F.struct(F.xxhash64("term").alias("t"), F.col("w").cast("double").alias("w"))
    rows = vectors.groupBy(F.col(key).cast("bigint").alias("key")).agg(F.collect_list(entry).alias("v"), F.first(F.lit(0.0) if extra is None else extra.cast("double")).alias("extra"))
    if chosen is not None:
        rows = rows.join(chosen.select("key", "others"), "key")
    picky = chosen is not None
    names = _PARTS | _CHOSEN if picky else _PARTS

    def block(keys: list[int], extras: list[float], parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        terms, weights = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        owner = np.repeat(np.arange(len(parts), dtype=np.uint16), [len(p[0]) for p in parts])
        order = np.argsort(terms, kind="stable")
        terms, first = np.unique(terms[order], return_index=True)
        found = {"keys": keys, "extra": extras, "terms": terms, "starts": np.append(first, len(order)), "rows": owner[order], "weights": weights[order]}
        if picky:
            found |= {"asking": np.repeat(np.arange(len(parts)), [len(p[2]) for p in parts]), "others": np.concatenate([p[2] for p in parts])}
        return pa.RecordBatch.from_arrays([pa.array([len(order)], pa.int64()), *(pa.array([np.asarray(found[c]).astype(t).tobytes()], pa.binary()) for c, t in names.items())], names=["entries", *names])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, extras, parts, size = [], [], [], 0
        for batch in batches:
            lists = batch.column("v")
            inner, offsets = lists.values, lists.offsets.to_numpy()
            t, w = inner.field("t").to_numpy(), inner.field("w").to_numpy()
            others = batch.column("others") if picky else None
            for i, (key_, extra_) in enumerate(zip(batch.column("key").to_pylist(), batch.column("extra").to_pylist(), strict=True)):
                n = int(offsets[i + 1] - offsets[i])
                if keys and (len(keys) == BLOCK or size + n > ENTRIES):
                    yield block(keys, extras, parts)
                    keys, extras, parts, size = [], [], [], 0
                keys.append(key_)
                extras.append(extra_)
                own = (t[offsets[i] : offsets[i + 1]].copy(), w[offsets[i] : offsets[i + 1]].copy())
                parts.append(own if others is None else (*own, others[i].values.to_numpy()))
                size += n
        if keys:
            yield block(keys, extras, parts)

    return rows.mapInArrow(kernel, "entries bigint, " + ", ".join(f"{c} binary" for c in names))


def _scores(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, scores) for slices of the rows of a against all of b."""
    _, ia, ib = np.intersect1d(a["terms"], b["terms"], assume_unique=True, return_indices=True)
    la, lb = a["starts"][ia + 1] - a["starts"][ia], b["starts"][ib + 1] - b["starts"][ib]
    n, m = len(a["keys"]), len(b["keys"])
    often = np.argsort(-(la * lb), kind="stable")[:DENSE_TERMS]
    often = often[(la * lb)[often] > n * m * DENSE]
    seldom = np.ones(len(ia), bool)
    seldom[often] = False

    def entries(x: dict[str, np.ndarray], start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which term, which entry) of all entries of the terms that start there."""
        which = np.repeat(np.arange(len(size)), size)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + start[which]

    def dense(x: dict[str, np.ndarray], i: np.ndarray, size: np.ndarray, rows: int) -> np.ndarray:
        which, at = entries(x, x["starts"][i], size)
        out = np.zeros((rows, len(i)))
        out[x["rows"][at], which] = x["weights"][at]
        return out

    left, right = dense(a, ia[often], la[often], n), dense(b, ib[often], lb[often], m)
    ja, jb, lb = ia[seldom], ib[seldom], lb[seldom]
    which, at = entries(a, a["starts"][ja], la[seldom])
    # in order of the rows of a, so that a slice of them is a range
    order = np.argsort(a["rows"][at], kind="stable")
    which, at = which[order], at[order]
    row, weight, first, size = a["rows"][at].astype(np.int64), a["weights"][at], b["starts"][jb][which], lb[which]
    many = np.append(0, np.cumsum(size))
    for lo in range(0, n, SLICE):
        hi = min(n, lo + SLICE)
        score = left[lo:hi] @ right.T if len(often) else np.zeros((hi - lo, m))
        flat = score.reshape(-1)
        e, stop = np.searchsorted(row, [lo, hi])
        while e < stop:  # as many entries as make so many products, one at least
            f = min(stop, max(e + 1, int(np.searchsorted(many, many[e] + PRODUCTS, "right")) - 1))
            which, at = entries(b, first[e:f], size[e:f])
            cell = (row[e:f] - lo)[which] * m + b["rows"][at]
            flat += np.bincount(cell, weight[e:f][which] * b["weights"][at], len(flat))
            e = f
        yield lo, score


def _chosen_scores(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, score) of the pairs that a has chosen."""
    order = np.argsort(b["keys"], kind="stable")
    spot = np.minimum(np.searchsorted(b["keys"], a["others"], sorter=order), len(order) - 1)
    hit = b["keys"][order[spot]] == a["others"]
    row, column = a["asking"][hit].astype(np.int64), order[spot[hit]]
    if not len(row):
        return row, column, np.zeros(0)
    _, ia, ib = np.intersect1d(a["terms"], b["terms"], assume_unique=True, return_indices=True)

    def by_row(x: dict[str, np.ndarray], i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where a row starts, terms, weights) of the terms that both blocks have."""
        name = np.full(len(x["terms"]), -1)
        name[i] = np.arange(len(i))
        term = np.repeat(name, np.diff(x["starts"]))
        held = np.flatnonzero(term >= 0)
        held = held[np.argsort(x["rows"][held], kind="stable")]
        return np.searchsorted(x["rows"][held], np.arange(len(x["keys"]) + 1)), term[held], x["weights"][held]

    (start_a, term_a, weight_a), (start_b, term_b, weight_b) = by_row(a, ia), by_row(b, ib)
    line, score, rows = np.zeros(len(ia)), np.zeros(len(row)), np.append(np.unique(row, return_index=True)[1], len(row))
    for lo, hi in zip(rows[:-1], rows[1:], strict=True):
        own = slice(start_a[row[lo]], start_a[row[lo] + 1])
        size = start_b[column[lo:hi] + 1] - start_b[column[lo:hi]]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(start_b[column[lo:hi]] - ends + size, size)
        line[term_a[own]] = weight_a[own]
        score[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo), size), line[term_b[at]] * weight_b[at], hi - lo)
        line[term_a[own]] = 0
    return row, column, score


class _Best:
    """The k best of each row of some blocks, by score rounded to six places, then position."""

    def __init__(self, k: int) -> None:
        self.k, self.held = k, {}

    def add(self, keys: np.ndarray, lo: int, score: np.ndarray, here: np.ndarray) -> None:
        """score: rows of the block of those keys from lo on, against the positions here."""
        value, pos = (x[lo : lo + len(score)] for x in self._of(keys))
        least = value.min(axis=1)
        # only rows that have no k best yet are looked through for them, and those that tie with the k-th best stay
        few = np.flatnonzero(least == 0)
        few = few[np.count_nonzero(score[few] > 0, axis=1) > self.k]
        if len(few):
            least[few] = -np.partition(-score[few], self.k - 1, axis=1)[:, self.k - 1] - 1e-6
        r, c = np.nonzero(score > np.maximum(least - 1e-6, 0)[:, None])
        self._merge(value, pos, r, here[c], score[r, c])

    def put(self, keys: np.ndarray, r: np.ndarray, found: np.ndarray, score: np.ndarray) -> None:
        """Rows r of the block of those keys, with positions and scores of their own."""
        self._merge(*self._of(keys), r, found, score)

    def _of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.held.setdefault(keys.tobytes(), (np.zeros((len(keys), self.k)), np.full((len(keys), self.k), -1, np.int64)))

    def _merge(self, value: np.ndarray, pos: np.ndarray, r: np.ndarray, found: np.ndarray, score: np.ndarray) -> None:
        got = np.round(score, 6)
        r, found, got = r[got > 0], found[got > 0], got[got > 0]
        if not len(r):
            return
        touched = np.unique(r)
        old_r, old_c = np.nonzero(value[touched] > 0)
        old_r = touched[old_r]
        rows, poses, values = np.concatenate([r, old_r]), np.concatenate([found, pos[touched][value[touched] > 0]]), np.concatenate([got, value[old_r, old_c]])
        order = np.lexsort((poses, -values, rows))
        rows, poses, values = rows[order], poses[order], values[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        top = rank < self.k
        value[touched], pos[touched] = 0, -1
        value[rows[top], rank[top]], pos[rows[top], rank[top]] = values[top], poses[top]

    def size(self) -> int:
        return sum(v.nbytes + p.nbytes for v, p in self.held.values())

    def handed(self) -> Iterator[pa.RecordBatch]:
        for keys, (value, pos) in self.held.items():
            r, c = np.nonzero(value > 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, "<i8")[r]), pa.array(pos[r, c]), pa.array(value[r, c])], names=["q", "pos", "score"])
        self.held.clear()


def _cells(df: DataFrame) -> int:
    """Three cells a core."""
    return 3 * df.sparkSession.sparkContext.defaultParallelism


def _kept(blocks: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Written blocks and the number of their entries; a page of the file holds a block, not a hundred."""
    out = stored(blocks, name, **{"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 4})
    return out, out.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]


def _joined(asked: DataFrame, held: DataFrame, k: int, cells: int, alike: bool) -> DataFrame:
    """(q, pos, score): asked(row, column, parts) against held(row, column, parts), the best k of each cell."""
    picky = "others" in asked.columns
    names = {"q": _PARTS | _CHOSEN if picky else _PARTS, "v": _PARTS}

    def side(df: DataFrame, mark: str) -> DataFrame:
        return df.select("row", "column", *(F.col(c).alias(f"{mark}_{c}") for c in names[mark])).repartition(2 * cells, "row", "column")

    pairs = side(asked, "q").join(side(held, "v").hint("merge"), ["row", "column"])
    if alike:  # a pair of blocks of one line is met twice
        pairs = pairs.where("row < column or q_keys <= v_keys")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for batch in batches:
            for r in range(batch.num_rows):
                a, b = ({c: np.frombuffer(batch.column(f"{x}_{c}")[r].as_buffer(), t) for c, t in names[x].items()} for x in "qv")
                if picky:
                    row, column, score = _chosen_scores(a, b)
                    best.put(a["keys"], row, b["keys"][column], score)
                    continue
                same = alike and np.array_equal(a["keys"], b["keys"])
                for lo, score in _scores(a, b):
                    if not alike:
                        score[score > 0] += np.broadcast_to(b["extra"], score.shape)[score > 0]
                    if same:
                        score[np.arange(len(score)), np.arange(lo, lo + len(score))] = 0
                    best.add(a["keys"], lo, score, b["keys"])
                    if alike and not same:
                        best.add(b["keys"], 0, np.ascontiguousarray(score.T), a["keys"][lo : lo + len(score)])
                if best.size() > KEPT:
                    yield from best.handed()
        yield from best.handed()

    return pairs.drop("row", "column").mapInArrow(kernel, "q bigint, pos bigint, score double")


def _line(lines: int) -> Column:
    return F.pmod(F.xxhash64("keys"), F.lit(lines)).cast("int")


def nearest_pairs(vectors: DataFrame, k: int) -> DataFrame:
    """(q, pos, score) of vectors(pos, term, w) with each other: the best k of each q are among the rows.

    The blocks are dealt over lines, and each two lines, or one with itself, are a cell: a block goes to one
    cell more than there are lines, and their number hangs on the cores alone. All pairs of blocks are scored,
    which takes time by the square of the vectors; both directions come from one product.
    """
    cells = _cells(vectors)
    lines = max(1, round((2 * cells) ** 0.5))
    blocks = _kept(packed(vectors, "pos"), "blocks")[0].withColumn("line", _line(lines))
    above = blocks.select(F.col("line").alias("row"), F.explode(F.sequence(F.col("line"), F.lit(lines - 1))).alias("column"), *_PARTS)
    below = blocks.select(F.explode(F.sequence(F.lit(0), F.col("line"))).alias("row"), F.col("line").alias("column"), *_PARTS)
    return _joined(above, below, k, cells, True)


def best_products(queries: DataFrame, vectors: DataFrame, k: int, extra: Column | None = None) -> DataFrame:
    """(q, pos, score) of queries(q, term, w) and vectors(pos, term, w): the best k of each q are among the rows.

    A score is the product, and the vector's extra if the product is above 0. A block of the smaller side goes
    to more cells than one of the larger, so that about as much of either is sent.
    """
    (asked, few), (held, many) = _kept(packed(queries, "q"), "asked"), _kept(packed(vectors, "pos", extra), "blocks")
    cells = _cells(vectors)
    rows = min(cells, max(1, round((cells * few / max(1, many)) ** 0.5)))
    columns = -(-cells // rows)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return _joined(asked.select(_line(rows).alias("row"), every(columns).alias("column"), *_PARTS), held.select(every(rows).alias("row"), _line(columns).alias("column"), *_PARTS), k, cells, False)


def chosen_products(vectors: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """(q, pos, score) of vectors(pos, term, w), each with those in others of chosen(key, others) alone.

    The pairs are scored where the blocks of both meet, so that neither a pair nor its terms become rows.
    """
    cells = _cells(vectors)
    lines = max(1, round(cells**0.5))
    asked, held = _kept(packed(vectors, "pos", None, chosen), "asked")[0], _kept(packed(vectors, "pos"), "blocks")[0]
    every = F.explode(F.sequence(F.lit(0), F.lit(lines - 1)))
    return _joined(asked.select(_line(lines).alias("row"), every.alias("column"), *_PARTS, *_CHOSEN), held.select(every.alias("row"), _line(lines).alias("column"), *_PARTS), k, cells, False)
