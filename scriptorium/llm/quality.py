"""Quality rules: counts with fixed limits, then a calibrated logistic regression on hashed n-grams.

The regression is fitted on labelled rows (at most MAX_ROWS, the least by hash of doc_id): relative
frequencies of hashed words, word pairs, and character 3- and 5-grams, scaled by the square root of their
mean. It is solved in its dual form, and Platt scaling on out-of-fold scores calibrates its probabilities.
Texts are scored in Arrow batches; a text passes at MIN_PROBABILITY or better.

Defined results: a null text counts as empty; a text that fails the base rules is not kept; labels that
are null or contradict each other are not used; without labels of both kinds, or without any of their
texts, every probability is 1; a null doc_id is kept as null; repeated rows give a row each; an empty
table gives an empty result; further columns are ignored (the pipeline's stage returns them).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACE, mix, record_batch, table, word_bounds

MIN_WORDS, MAX_REPEATED_PERCENT, REPEAT = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
#: The classifier's fit: at most so many labelled rows.
MAX_ROWS = 1200
BITS = 11
FOLDS, RIDGE = 3, 1e-3
MIN_PROBABILITY = 0.5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CHARS = ((3, 0x85EBCA6B), (5, 0xC2B2AE35))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word: a polynomial over its bytes, scrambled."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))[: len(data)] if starts[0] == 0 else None
    if place is None:
        place = np.zeros(len(data), np.int64)
        place[starts[0] :] = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    power = np.cumprod(np.full(int((ends - starts).max()) + 1, _STEP, np.uint64))
    value = _BYTE[data]
    value *= power[np.minimum(place, len(power) - 1)]
    value[SPACE[data] == 1] = 0
    return mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))


def repeated_words(hashes: np.ndarray, data: bytes, window: int = REPEAT) -> int:
    """The number of words that lie in windows of so many words that the text has twice or more."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    rolled = np.zeros(n, np.uint64)
    for i in range(window):
        rolled = rolled * _STEP + hashes[i : i + n]
    rank = np.sort(rolled)
    double = rank[1:][rank[1:] == rank[:-1]]
    if not len(double):
        return 0
    places = np.flatnonzero(np.isin(rolled, double)).tolist()
    words = data.split()
    seen = Counter(tuple(words[i : i + window]) for i in places)  # equal hashes are checked word by word
    cover = np.zeros(len(hashes) + 1, np.int64)
    for i in places:
        if seen[tuple(words[i : i + window])] > 1:
            cover[i] += 1
            cover[i + window] -= 1
    return int((np.cumsum(cover) > 0).sum())


def base_counts(data: bytes) -> tuple[int, int, int, int, int, np.ndarray]:
    """Words, their code points, symbols, repeated lines, words in repeated windows, hashes of the words."""
    array = np.frombuffer(data, np.uint8)
    starts, ends = word_bounds(array)
    hashes = word_hashes(array, starts, ends)
    chars = int((((array & 0xC0) != 0x80) & (SPACE[array] == 0)).sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(starts), chars, int(_SYMBOL[array].sum()), len(lines) - len(set(lines)), repeated_words(hashes, data), hashes


def feature_places(hashes: np.ndarray, text: str, bits: int = BITS) -> list[np.ndarray]:
    """The hashed places of a text's features, a group each: words, word pairs, characters in threes and fives."""
    shift = np.uint64(64 - bits)
    out = [hashes >> shift, mix(hashes[:-1] * _STEP + hashes[1:]) >> shift if len(hashes) > 1 else hashes[:0]]
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    for n, factor in _CHARS:
        size = max(0, len(points) - n + 1)
        gram = np.zeros(size, np.uint32)
        for i in range(n):
            gram = gram * np.uint32(factor) + points[i : i + size] * np.uint32(0x9E3779B1)
        out.append((gram ^ (gram >> np.uint32(15))) * np.uint32(factor) >> np.uint32(32 - bits))
    return out


def features(hashes: np.ndarray, text: str, bits: int = BITS) -> np.ndarray:
    """The relative frequencies of a text's features, group after group."""
    return np.concatenate([np.bincount(x.astype(np.int64), minlength=1 << bits) / max(1, len(x)) for x in feature_places(hashes, text, bits)]).astype(np.float32)


def _logistic(kernel: np.ndarray, y: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Newton's method for kernel logistic regression: the dual weights and the intercept."""
    n = len(y)
    dual, bias = np.zeros(n), 0.0
    for _ in range(15):
        f = kernel @ dual + bias
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-5)
        system = np.zeros((n + 1, n + 1))
        system[:n, :n] = kernel
        system[np.arange(n), np.arange(n)] += n * ridge / w
        system[:n, n] = system[n, :n] = 1
        solved = np.linalg.solve(system, np.append(f + (y - p) / w, 0))
        moved = np.abs(solved[:n] - dual).max()
        dual, bias = solved[:n], float(solved[n])
        if moved < 1e-6 * max(1.0, np.abs(dual).max()):
            break
    return dual, bias


def _platt(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the calibrated log odds."""
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([f, np.ones(len(f))], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (target - p))
        theta = theta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def fit(x: np.ndarray, y: np.ndarray, folds: int = FOLDS, ridge: float = RIDGE) -> tuple[np.ndarray, float] | None:
    """Weights for feature frequencies and an intercept, so that their sum is a calibrated log odds."""
    if len(set(y.tolist())) < 2:
        return None
    y = y.astype(np.float64)
    scale = (1 / np.sqrt(x.mean(0) + 0.1 / x.shape[1])).astype(np.float32)
    scaled = x * scale
    kernel = (scaled @ scaled.T).astype(np.float64)
    unit = np.trace(kernel) / len(y)
    kernel /= unit
    out = np.zeros(len(y))
    fold = np.zeros(len(y), int)
    for kind in (0, 1):  # each fold gets its share of either kind
        at = np.flatnonzero(y == kind)
        fold[at] = np.arange(len(at)) % folds
    for k in range(folds):
        a, b = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(b) and len(set(y[a].tolist())) > 1:
            dual, bias = _logistic(kernel[np.ix_(a, a)], y[a], ridge)
            out[b] = kernel[np.ix_(b, a)] @ dual + bias
    slope, shift = _platt(out, y)
    dual, bias = _logistic(kernel, y, ridge)
    weights = scale * (scaled.T @ dual.astype(np.float32)) / unit
    return (slope * weights).astype(np.float32), slope * bias + shift


def fitted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS, bits: int = BITS) -> tuple[np.ndarray, float] | None:
    """The model of at most max_rows labelled rows of docs."""
    sure = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z")
    some = sure.select(F.col(key).alias("k"), "y").orderBy(F.xxhash64("k"), "k").limit(max_rows)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("k", pa.int64()), ("y", pa.int32()), ("x", pa.binary())])
        for batch in batches:
            found = []
            for value in batch.column("t").to_pylist():
                data = np.frombuffer((value or "").encode(), np.uint8)
                found.append(features(word_hashes(data, *word_bounds(data)), value or "", bits).tobytes())
            yield record_batch(schema, [batch.column("k"), batch.column("y"), found])

    # some has max_rows rows of two numbers, so its broadcast is bounded
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).join(F.broadcast(some), "k").select("k", F.col("y").cast("int").alias("y"), "t")
    sample = rows.mapInArrow(kernel, "k bigint, y int, x binary").groupBy("k").agg(F.first("y").alias("y"), F.min("x").alias("x")).collect()
    if not sample:
        return None
    sample.sort(key=lambda r: r.k)
    return fit(np.stack([np.frombuffer(r.x, np.float32) for r in sample]), np.array([r.y for r in sample]))


def score(hashes: np.ndarray, text: str, model: tuple[np.ndarray, float] | None, bits: int = BITS) -> float:
    """The probability that a text is good."""
    if model is None:
        return 1.0
    weights, odds = model
    for g, places in enumerate(feature_places(hashes, text, bits)):
        if len(places):
            odds += float(weights[g << bits :][places].mean(dtype=np.float64))
    return float(1 / (1 + np.exp(-np.clip(odds, -700, 700))))


_OUT = pa.schema([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("probability", pa.float64())])


def judge(text: str | None, model: tuple[np.ndarray, float] | None, least: float = MIN_PROBABILITY) -> tuple:
    text = text or ""
    *counts, hashes = base_counts(text.encode())
    failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEATED_PERCENT * counts[0]
    probability = score(hashes, text, model)
    return (*counts, failed, not failed and probability >= least, probability)


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs: doc_id, its counts, base_failed, kept and probability."""
    held = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, key, text))
    schema = pa.schema([("doc_id", pa.int64()), *_OUT])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(x, held.value) for x in batch.column("text").to_pylist()]
            yield record_batch(schema, [batch.column("doc_id"), *(list(zip(*found, strict=True)) or [[]] * len(_OUT))])

    form = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, probability double"
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(kernel, form)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A pipeline stage: documents that the rules reject go."""
    held = spark.sparkContext.broadcast(fitted(docs, table(spark, sf_dir, "labels")))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _OUT.get_field_index("kept")
        for batch in batches:
            yield batch.filter(pa.array([judge(x, held.value)[place] for x in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(kernel, docs.schema)
