"""Language identification by string kernels.

A text's profile is the set of its byte n-grams (N of them), lower-cased. The kernel of two texts is the
size of their profiles' intersection over the geometric mean of the profiles' sizes. LANDMARKS texts per
language give a Nystroem map; ridge regression, one language against the rest, is fitted on FIT texts per
language in the mapped space. Texts are scored by products of presence matrices with the landmarks'.

The fit takes the least different rows by hash of doc_id among those of at most MAX_BYTES bytes whose fold is not
HELD_OUT; its size is bounded by these parameters and the number of languages. Landmarks have LANDMARK_BYTES
bytes of text together (or one text a language, if that is more), and are broadcast as sparse n-gram lists of
at most 12 bytes for each n-gram of a text.

Defined results: texts of any length are read whole; null text or text without a letter is ``und`` with score 0, as is everything when no row
can be learned from; a null doc_id counts as held in; a null lang is never learned; ties go to the
language first in order; repeated rows give a row each and are learned from once; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import fold, record_batch, table

N = (2, 3, 4)
LANDMARKS, FIT = 32, 250
MAX_BYTES = 65536
RIDGE, SHARPNESS = 1e-2, 6.0
FOLDS, HELD_OUT = 4, 2
BATCH = 128
#: Cells of a presence matrix that a task lays out at a time; bytes of all landmarks' texts (a text a language at least).
CELLS, LANDMARK_BYTES = 1 << 22, 1 << 24
_LETTER = re.compile(r"[^\W\d_]")


def profile(text: str, sizes: tuple[int, ...] = N) -> np.ndarray:
    """The distinct byte n-grams of a lower-cased text, with their length in the high bits, in order."""
    data = np.frombuffer(" ".join(text.lower().split()).encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    out = []
    for n in sizes:
        if len(data) >= n:
            gram = np.zeros(len(data) - n + 1, np.uint32)
            for i in range(n):
                gram = gram << np.uint32(8) | data[i : len(data) - n + 1 + i]
            out.append(np.unique(gram).astype(np.uint64) | np.uint64(n << 32))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Kernels:
    """The landmarks, and the kernel of any profiles with them.

    What is broadcast is sparse: for each n-gram the landmarks that have it, in proportion to their texts.
    """

    def __init__(self, profiles: list[np.ndarray]):
        every = np.concatenate(profiles)
        self.grams = np.unique(every)
        owner = np.repeat(np.arange(len(profiles), dtype=np.int32), [len(x) for x in profiles])
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.starts = np.searchsorted(every[order], self.grams)
        self.starts = np.append(self.starts, len(every))
        self.scale = _scale(profiles)

    def of(self, profiles: list[np.ndarray]) -> np.ndarray:
        """Products of the presence matrices of the profiles and the landmarks, CELLS of a matrix at a time."""
        width = len(self.scale)
        shared = np.zeros((len(profiles), width), np.float32)
        if len(self.grams):
            every = np.concatenate(profiles)
            row = np.repeat(np.arange(len(profiles)), [len(x) for x in profiles])
            at = np.minimum(np.searchsorted(self.grams, every), len(self.grams) - 1)
            known = self.grams[at] == every
            row, at = row[known], at[known]
            order = np.argsort(at, kind="stable")
            row, at = row[order], at[order]
            step = max(1, CELLS // max(width, len(profiles)))
            for lo in range(0, len(self.grams), step):
                hi = min(lo + step, len(self.grams))
                a, b = np.searchsorted(at, (lo, hi))
                if a == b:
                    continue
                mine = self.starts[lo : hi + 1]
                landmarks = np.zeros((hi - lo, width), np.float32)
                landmarks[np.repeat(np.arange(hi - lo), np.diff(mine)), self.owner[mine[0] : mine[-1]]] = 1
                present = np.zeros((len(profiles), hi - lo), np.float32)
                present[row[a:b], at[a:b] - lo] = 1
                shared += present @ landmarks
        return shared * _scale(profiles)[:, None] * self.scale


def _scale(profiles: list[np.ndarray]) -> np.ndarray:
    """One over the root of each profile's size, 0 for an empty one."""
    sizes = np.array([len(x) for x in profiles], np.float64)
    return np.where(sizes > 0, 1 / np.sqrt(np.maximum(sizes, 1)), 0).astype(np.float32)


class Model:
    def __init__(self, kernels: Kernels, weights: np.ndarray, langs: list[str]):
        self.kernels, self.weights, self.langs = kernels, weights, langs

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        some = [i for i, x in enumerate(texts) if x and _LETTER.search(x)]
        for lo in range(0, len(some), BATCH):
            part = some[lo : lo + BATCH]
            k = self.kernels.of([profile(texts[i]) for i in part])
            z = np.hstack([k, np.ones((len(part), 1), np.float32)]) @ self.weights
            p = np.exp(SHARPNESS * (z - z.max(1, keepdims=True)))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            for i, b, row in zip(part, best.tolist(), p, strict=True):
                langs[i], scores[i] = self.langs[b], float(min(1.0, row[b]))
        return langs, scores


def solve(square: np.ndarray, k: np.ndarray, langs: list[str], ridge: float = RIDGE) -> tuple[np.ndarray, list[str]]:
    """Ridge regression in the Nystroem space, folded back to weights for kernel values and an intercept."""
    names = sorted(set(langs))
    value, vector = np.linalg.eigh(square.astype(np.float64))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    phi = np.hstack([k @ root, np.ones((len(k), 1))])
    y = np.where(np.array(langs)[:, None] == np.array(names)[None], 1.0, -1.0)
    weight = 1 / np.array([langs.count(x) for x in langs])  # each language counts alike
    gram = (phi * weight[:, None]).T @ phi
    gram[np.arange(phi.shape[1] - 1), np.arange(phi.shape[1] - 1)] += ridge
    inner = np.linalg.solve(gram + 1e-12 * np.eye(len(gram)), (phi * weight[:, None]).T @ y)
    return np.vstack([root @ inner[:-1], inner[-1:]]).astype(np.float32), names


def fitted(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = FOLDS, held_out: int = HELD_OUT) -> Model | None:
    """The model of the learnable rows of docs."""
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    rows = rows.where(F.col("l").isNotNull() & (F.coalesce(fold("k", folds), F.lit(-1)) != held_out) & F.octet_length("t").between(1, MAX_BYTES) & F.col("t").rlike(r"\p{L}"))
    # ranks need no texts; those of the few chosen rows are joined to them. A row that is repeated is one
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("k"), "k", "h"))
    chosen = rows.select("k", "l", F.xxhash64("t").alias("h")).distinct().withColumn("n", rank).where(F.col("n") <= FIT)
    chosen = chosen.select(F.col("k").alias("ck"), F.col("l").alias("cl"), F.col("h").alias("ch"), "n")
    sample = rows.join(F.broadcast(chosen), (F.col("l") == F.col("cl")) & F.col("k").eqNullSafe(F.col("ck")) & (F.xxhash64("t") == F.col("ch"))).groupBy("l", "n").agg(F.min("t").alias("t"))
    # each language has its share of the bytes: the first texts in order that fit, one at least
    size = F.sum(F.octet_length("t")).over(Window.partitionBy("l").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    few = sample.where(F.col("n") <= LANDMARKS).withColumn("size", size)
    share = LANDMARK_BYTES // max(1, few.select("l").distinct().count())
    landmarks = sorted({(r.l, r.n, r.t) for r in few.where((F.col("n") == 1) | (F.col("size") <= share)).collect()})
    if not landmarks:
        return None
    kernels = Kernels([profile(t) for _, _, t in landmarks])
    held = docs.sparkSession.sparkContext.broadcast(kernels)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("l", pa.string()), ("n", pa.int32()), ("x", pa.binary())])
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                k = held.value.of([profile(t) for t in part.column("t").to_pylist()])
                yield record_batch(schema, [part.column("l"), part.column("n"), [x.tobytes() for x in k]])

    fit = sorted({(r.l, r.n, r.x) for r in sample.mapInArrow(kernel, "l string, n int, x binary").collect()})
    weights, names = solve(kernels.of([profile(t) for _, _, t in landmarks]), np.stack([np.frombuffer(x, np.float32) for _, _, x in fit]).astype(np.float64), [x for x, _, _ in fit])
    return Model(kernels, weights, names)


def identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(fitted(docs, key, text, lang))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t").to_pylist()
            found = held.value.predict(texts) if held.value else (["und"] * len(texts), [0.0] * len(texts))
            yield record_batch(schema, [batch.column("doc_id"), batch.column("held_out"), *found])

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(fold(key, FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), F.col(text).alias("t"))
    return rows.mapInArrow(kernel, "doc_id bigint, held_out boolean, lang_pred string, score double")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))
