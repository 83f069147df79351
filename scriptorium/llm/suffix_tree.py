"""Language-model scores from a probabilistic suffix tree.

Symbols are the bytes of a text's words, ASCII letters lower-cased, joined by single spaces, and one end
symbol. Counts of all contexts of up to DEPTH bytes with the next symbol come from the whole training part
of the corpus. A context seen MIN_COUNT times or more is tested against its longest retained suffix: it is
retained if the divergence of its next symbols from that suffix's is at least MIN_DIVERGENCE (nats a symbol)
and, times its count, at least the number of its different next symbols. Distributions are smoothed by Witten
and Bell's rule towards that suffix, the root's by adding one to each of 256 bytes. A symbol is scored from
the longest retained suffix of the DEPTH bytes before it.

The tree is a table, and grows with the corpus: a row for each DEPTH bytes with their next symbol that occur in
any text, with the symbol's probability. It is made in tasks that hold all contexts with the same last two
bytes; those of one byte and the root are at most 65,536 numbers. The most frequent rows, HOT_CODES at most, go
to every task; the others are joined, a row for each text and such place. Neither way changes a score.

Base scores need the count of every word, in the same way: the most frequent words, at most HOT of at most
HOT_BYTES bytes together, go to every task, the rest are joined, a row for each document and word.

Defined results: a null text counts as empty and has the end token only; a null doc_id counts as training
and is kept as null; without training texts N and V are 0 and both scores follow from the smoothing alone;
texts of any length are scored whole; repeated rows are counted and returned each; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import byte_column, fold, record_batch, stored, table

DEPTH = 5
MIN_COUNT = 2
MIN_DIVERGENCE = 0.005
FOLDS, HELD_OUT = 7, 2
HOT, HOT_BYTES = 131_072, 8_388_608
HOT_CODES = 1_048_576
#: Ends a text, fills the context before its first byte, and stands for the end token: no word has it.
END = 10
#: Bytes of text that a task counts or scores at a time; entries of a task's table of counts before it sends them.
PIECE, SCORED, SENT = 4_000_000, 500_000, 3_000_000
#: Rows of whole groups of contexts that are worked on together.
ROWS = 200_000


def symbols(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def _pieces(batches: Iterator[pa.RecordBatch], size: int = PIECE) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches of about so many bytes, with their texts."""
    for batch in batches:
        texts, lo, held = byte_column(batch, "text"), 0, 0
        for hi, text in enumerate(texts, 1):
            held += len(text)
            if held >= size or hi == len(texts):
                yield batch.slice(lo, hi - lo), texts[lo:hi]
                lo, held = hi, 0


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols in a row, DEPTH ends before each text and one after; where each text's symbols begin and end."""
    pad, end = bytes([END]) * DEPTH, bytes([END])
    joined = [symbols(x) for x in texts]
    data = np.frombuffer(b"".join([pad + x + end for x in joined]), np.uint8)
    sizes = np.fromiter(map(len, joined), np.int64, len(joined)) + 1
    ends = np.cumsum(sizes + DEPTH)
    return data, ends - sizes, ends


def codes_of(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The (context, symbol) code of each symbol, eight bits a byte, and how many symbols each text has."""
    data, starts, ends = _laid_out(texts)
    code = np.zeros(len(data) - depth, np.uint64)
    for i in range(depth + 1):
        code = code << np.uint64(8) | data[i : len(data) - depth + i]
    valid = np.zeros(len(data) + 1, np.int8)
    valid[starts] += 1
    valid[ends] -= 1
    return code[np.cumsum(valid[:-1])[depth:] > 0], ends - starts


def gram_counts(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of some texts, and their counts."""
    return np.unique(codes_of(texts, depth)[0], return_counts=True)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.add.reduceat(counts, first)


def count_grams(rows: DataFrame) -> DataFrame:
    """(code, n) of all codes of rows(held_out, text), counted where not held out; tasks send sums."""
    schema = pa.schema([("code", pa.int64()), ("n", pa.int64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch, texts in _pieces(batches):
            out = batch.column("held_out").to_pylist()
            for held in (False, True):
                if some := [t for t, x in zip(texts, out, strict=True) if x == held]:
                    codes, counts = gram_counts(some)
                    parts.append((codes, counts * (not held)))
            if sum(len(x) for x, _ in parts) > SENT:
                parts = [_merge(parts)]
                if len(parts[0][0]) > SENT // 2:
                    yield record_batch(schema, [parts[0][0].view(np.int64), parts[0][1]])
                    parts = []
        if parts:
            codes, counts = _merge(parts)
            for lo in range(0, len(codes), 100_000):
                yield record_batch(schema, [codes[lo : lo + 100_000].view(np.int64), counts[lo : lo + 100_000]])

    return rows.mapInArrow(kernel, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def count_words(training: DataFrame) -> DataFrame:
    """(word, n) over training(text), the end token as a line end; tasks send sums."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for _, texts in _pieces(batches):
            for text in texts:
                counts.update(text.lower().split())
            counts[bytes([END])] += len(texts)
            if len(counts) > 400_000:
                yield record_batch(schema, [list(counts), list(counts.values())])
                counts = Counter()
        yield record_batch(schema, [list(counts), list(counts.values())])

    return training.mapInArrow(kernel, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def deepened(codes: np.ndarray, n: np.ndarray, p: np.ndarray, depths: Iterable[int], least: float, count: int) -> np.ndarray:
    """The probability of each distinct code's symbol after contexts of more and more bytes.

    p is the one from the longest retained suffix of fewer bytes than the first of the depths. All codes of each
    context of that depth must be there.
    """
    for d in depths:
        pair, of_pair = np.unique(codes & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
        hits = np.bincount(of_pair, n, len(pair))
        above = np.empty(len(pair))
        above[of_pair] = p
        _, of_context = np.unique(pair >> np.uint64(8), return_inverse=True)
        total = np.bincount(of_context, hits)
        seen = hits > 0
        kinds = np.bincount(of_context, seen)
        part = np.zeros(len(pair))
        part[seen] = hits[seen] * np.log(hits[seen] / total[of_context[seen]] / above[seen])
        gain = np.bincount(of_context, part)
        retained = (total >= max(count, 1)) & (gain >= least * total) & (gain >= kinds)
        total, kinds, retained = total[of_context], kinds[of_context], retained[of_context]
        smoothed = (above * kinds + hits) / np.maximum(total + kinds, 1)
        p = np.where(retained, smoothed, above)[of_pair]
    return p


def learned(rows: DataFrame, depth: int = DEPTH, least: float = MIN_DIVERGENCE, count: int = MIN_COUNT) -> DataFrame:
    """(code, n, log): the tree of rows(held_out, text), a written table; log is of base 10."""
    grams = stored(count_grams(rows), "grams")
    short = np.zeros(1 << 16)
    for r in grams.groupBy(F.col("code").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("n").alias("n")).collect():
        short[r.pair] = r.n
    root = short.reshape(256, 256).sum(0)
    pairs = np.arange(1 << 16, dtype=np.uint64)
    first = deepened(pairs, short, np.tile((root + 1) / (root.sum() + 256), 256), (1,), least, count)
    above = rows.sparkSession.sparkContext.broadcast(first)
    schema = pa.schema([("code", pa.int64()), ("n", pa.int64()), ("log", pa.float32())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by the last two bytes of their contexts; whole groups are worked on."""
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def done(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            whole = codes.view(np.uint64)
            p = deepened(whole, n, above.value[(whole & np.uint64(0xFFFF)).astype(np.int64)], range(2, depth + 1), least, count)
            return record_batch(schema, [codes, n, np.log10(p).astype(np.float32)])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column("code").to_numpy(), batch.column("n").to_numpy()))
            if sum(len(x) for x, _ in held) >= ROWS:
                codes, n = (np.concatenate(x) for x in zip(*held, strict=True))
                group = codes >> 8 & 0xFFFF
                whole = int(np.searchsorted(group, group[-1]))
                if whole:
                    yield done(codes[:whole], n[:whole])
                held = [(codes[whole:], n[whole:])]
        if held:
            yield done(*(np.concatenate(x) for x in zip(*held, strict=True)))

    group = F.shiftright("code", 8).bitwiseAND(0xFFFF)
    return stored(grams.repartition(group).sortWithinPartitions(group).mapInArrow(kernel, "code bigint, n bigint, log float"), "tree")


def _frequent(rows: DataFrame, most: int, size: Column | None = None, room: int = 0) -> DataFrame:
    """At most so many rows with the largest n, their sizes at most the room if one is given.

    The cut lies between steps of a scale of counts, which few rows describe however many there are; tasks
    send no row that isn't wanted.
    """
    steps = rows.withColumn("step", F.floor(F.log("n") / math.log(1.02))).where("n > 0")
    cut = None
    for step, count, taken in sorted((tuple(r) for r in steps.groupBy("step").agg(F.count("*"), F.sum(F.lit(0) if size is None else size)).collect()), reverse=True):
        most, room = most - count, room - taken
        if most < 0 or room < 0:
            break
        cut = step
    return steps.where(F.lit(False) if cut is None else F.col("step") >= cut).drop("step")


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs."""
    spark = docs.sparkSession
    out = F.coalesce(fold(key, folds) == held_out, F.lit(False))
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), out.alias("held_out"), F.col(text).alias("text"))
    tree = learned(rows.select("held_out", "text"))
    most = _frequent(tree, HOT_CODES).select("code", "log").toArrow().sort_by("code")
    known = spark.sparkContext.broadcast((most.column("code").to_numpy().view(np.uint64), most.column("log").to_numpy()))  # HOT_CODES at most
    words = stored(count_words(rows.where(~F.col("held_out")).select("text")), "words")
    ends = F.sum(F.when(F.col("word") == F.lit(bytes([END])), F.col("n")).otherwise(0))
    tokens, different, ended = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(ends, F.lit(0))).first()
    total = tokens + different + 1
    end = math.log10((ended + 1) / total)
    frequent = _frequent(words, HOT, F.octet_length("word"), HOT_BYTES).toArrow()
    hot = spark.sparkContext.broadcast({w: math.log10((n + 1) / total) for w, n in zip(frequent.column("word").to_pylist(), frequent.column("n").to_pylist(), strict=True)})  # HOT words, HOT_BYTES at most
    fields = [("row", pa.int64()), ("word", pa.binary()), ("code", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]
    schema = pa.schema(fields)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, nan = hot.value.get, float("nan")
        some, logs = known.value
        for batch, texts in _pieces(batches, SCORED):
            codes, sizes = codes_of(texts)
            distinct, place = np.unique(codes, return_inverse=True)
            at = np.minimum(np.searchsorted(some, distinct), max(len(some) - 1, 0))
            here = some[at] == distinct if len(some) else np.zeros(len(distinct), bool)
            log = np.zeros(len(distinct))
            log[here] = logs[at[here]]
            of_text = np.repeat(np.arange(len(texts)), sizes)
            scores = np.bincount(of_text, log[place], len(texts))
            tokens, in_training, base, owners, rare, times = [], [], [], [], [], []
            row = batch.column("row").to_pylist()
            for i, text in enumerate(texts):
                words = text.lower().split()
                value = np.fromiter(map(get, words, repeat(nan)), np.float64, len(words))
                other = np.flatnonzero(np.isnan(value)).tolist()
                tokens.append(len(words) + 1)
                in_training.append(len(words) - len(other) + (ended > 0))
                base.append(float(np.nansum(value)) + end)
                if other:
                    found = Counter(words[j] for j in other)
                    owners += [row[i]] * len(found)
                    rare += found
                    times += found.values()
            blank = [None] * len(texts)
            yield record_batch(schema, [batch.column("row"), blank, blank, batch.column("doc_id"), batch.column("held_out"), tokens, in_training, base, scores])
            if owners:
                blank = [None] * len(owners)
                yield record_batch(schema, [owners, rare, blank, blank, blank, times, blank, blank, blank])
            absent = ~here[place]
            if absent.any():
                pairs, n = np.unique(np.stack([of_text[absent].astype(np.uint64), codes[absent]]), axis=1, return_counts=True)
                blank = [None] * len(n)
                yield record_batch(schema, [np.array(row, np.int64)[pairs[0].astype(np.int64)], blank, pairs[1].view(np.int64), blank, blank, n, blank, blank, blank])

    found = stored(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(kernel, "row bigint, word binary, code bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double"), "scored")
    count = F.coalesce("n", F.lit(0))
    # words and codes beyond the most frequent: none of them is in many rows
    places = found.where("code is not null").select("row", "code", "n_tokens").join(tree.select("code", "log"), "code").groupBy("row").agg(F.sum(F.col("n_tokens") * F.col("log").cast("double")).alias("places"))
    rare = found.where("word is not null").select("row", "word", "n_tokens").join(words, "word", "left")
    rare = rare.groupBy("row").agg(F.sum(F.when(count > 0, F.col("n_tokens")).otherwise(0)).alias("more"), F.sum(F.col("n_tokens") * F.log10((count + 1) / F.lit(float(total)))).alias("rest"))
    whole = found.where("word is null and code is null").join(rare, "row", "left").join(places, "row", "left")
    return whole.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(tokens).cast("bigint").alias("train_tokens"), (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("places", F.lit(0.0))).alias("score"))


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
