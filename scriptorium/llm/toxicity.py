"""Toxicity: a linear-chain conditional random field over words, its marginals aggregated to scores and offsets.

Words are runs of ASCII letters and digits and of characters beyond ASCII, in lower case. The chain has two
states, clean and toxic. Its potentials are weights of hashed features (the word, its first 3 to 8 and last 3
bytes, both neighbours) and transitions; forward and backward sums run over whole texts, however long.

Labelled tokens come from labelled documents: a word of a toxic document is a toxic token if the word or its
beginning is held significantly often by toxic documents (a log-likelihood ratio of MIN_RATIO or more in the
direction of label 1, of documents between different neighbours, as copies bear no witness of their own);
every other word is clean. The field is fitted to these tags by AdaGrad on its exact
gradient. The marginals of a text give its expected number of toxic words, the most certain one and its
length; a logistic regression on these, fitted on marginals of folds that the field has not seen, gives the
score. A word at SPAN_AT or more belongs to an offending span.

The fit reads at most MAX_ROWS labelled rows of either label (the least by hash of doc_id) of texts of up to
MAX_BYTES bytes. All texts are scored whole.

Defined results: a null text counts as empty; an empty text, or one without words, has no spans and the
score of no toxic word; labels that are null or contradict each other are not used; without usable labels of
both kinds every score is 0; a null doc_id is never learned from, is not held out and keeps its row;
repeated rows give a row each (their first copy is learned from); equal marginals stay in text order; an
empty table gives an empty result; further columns are ignored; very long texts are hashed slice by slice,
so that beyond the text itself some 100 bytes a word are held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import code_points, fold, mix, record_batch, table

#: The fit's bounds: rows of either label, and bytes of a text.
MAX_ROWS, MAX_BYTES = 1000, 4096
BITS = 18
PREFIXES, SUFFIX = (3, 4, 5, 6, 7, 8), 3
#: A word or a beginning of one is evidence from this log-likelihood ratio on and with this many toxic documents.
MIN_RATIO, MIN_DOCS = 12.0, 3
FOLDS, EPOCHS, PARTS, RATE, RIDGE = 2, 6, 8, 0.5, 1e-6
SPAN_AT = 0.5
#: Limits of potentials, by logarithm: eight words and moves stay within doubles.
FORCE, MOVE = 30.0, 20.0
#: Bytes that are hashed at a time.
SLICE = 1 << 20

_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_LETTER = np.zeros(256, np.int8)
_LETTER[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = 1
_CODE = mix(np.arange(1, 257, dtype=np.uint64))
_KINDS = 4 + len(PREFIXES)
_SALT = mix(np.arange(1, _KINDS + 1, dtype=np.uint64) * np.uint64(_STEP))


def lowered(text: str | None) -> bytes:
    """The text in lower case, code point for code point, in UTF-8."""
    return (text or "").replace("İ", "i").lower().encode("utf-8", "replace")


def bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _LETTER[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word the hashes of itself, its beginnings and its end; a beginning as long as the word or longer is 0."""
    out = np.zeros((2 + len(PREFIXES), len(starts)), np.uint64)
    lo = 0
    while lo < len(starts):  # words of about a slice of bytes
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + SLICE, "right")))
        base = starts[lo]
        part = data[base : ends[hi - 1]]
        power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(part), _STEP, np.uint64))))
        back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(part), _BACK, np.uint64))))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_CODE[part] * power[:-1], dtype=np.uint64)))
        a, b = starts[lo:hi] - base, ends[lo:hi] - base
        for k, (x, y, ok) in enumerate([(a, b, None), *((a, np.minimum(a + n, b), b - a > n) for n in PREFIXES), (np.maximum(a, b - SUFFIX), b, b - a > SUFFIX)]):
            value = mix((total[y] - total[x]) * back[x])
            out[k, lo:hi] = value if ok is None else np.where(ok, value, 0)
        lo = hi
    return out


def features(hashes: np.ndarray, doc: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of the features of each word; doc numbers the texts, and neighbours end with a text. Absent features are at 0."""
    word = hashes[0]
    joined = np.zeros(len(word) + 1, bool)  # whether a word and the next are in one text
    joined[1:-1] = doc[1:] == doc[:-1]
    rows = [*hashes, np.where(joined[:-1], np.roll(word, 1), 0), np.where(joined[1:], np.roll(word, -1), 0)]
    shift = np.uint64(64 - bits)
    return np.stack([np.where(x != 0, mix(x ^ s) >> shift, 0).astype(np.int32) for x, s in zip(rows, _SALT, strict=True)])


def _sweep(odds: np.ndarray, first: np.ndarray, step: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Scaled sums of a two-state chain up to each word, odds: its toxic potential; first: whether a text begins there.

    The words stand in a grid whose rows are stretches of the chain: the product of each row's matrices comes
    column by column for all rows at once, then the state before each row, then the state at each word.
    """
    n = len(odds)
    side = max(1, int(np.sqrt(n)))
    rows = -(-n // side)

    def laid(values: np.ndarray) -> np.ndarray:
        """One entry of each word's matrix, a row of the grid in a column; the last ones stay as if words were clean."""
        out = np.ones(rows * side)
        out[:n] = values
        return np.ascontiguousarray(out.reshape(rows, side).T)

    force = np.exp(np.clip(odds, -FORCE, FORCE))
    m00, m10 = (laid(np.where(first, begin[i, 0], step[i, 0])) for i in (0, 1))
    m01, m11 = (laid(np.where(first, begin[i, 1], step[i, 1]) * force) for i in (0, 1))

    def passed(a0: np.ndarray, a1: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        a0, a1 = a0 * m00[k] + a1 * m10[k], a0 * m01[k] + a1 * m11[k]
        if k % 8 == 7:  # eight factors can't leave the range of doubles
            most = np.maximum(a0, a1) if a0.ndim == 1 else np.maximum(a0, a1).max(0)
            a0, a1 = a0 / most, a1 / most
        return a0, a1

    left, right = (np.repeat(x, rows, 1) for x in (np.array([[1.0], [0.0]]), np.array([[0.0], [1.0]])))
    for k in range(side):
        left, right = passed(left, right, k)
    state0, state1 = np.empty(rows), np.empty(rows)
    x = y = 1.0
    for r, (p, q, u, v) in enumerate(zip(left[0].tolist(), left[1].tolist(), right[0].tolist(), right[1].tolist(), strict=True)):
        state0[r], state1[r] = x, y
        x, y = x * p + y * q, x * u + y * v
        most = max(x, y)
        x, y = x / most, y / most
    out = np.empty((2, side, rows))
    for k in range(side):
        state0, state1 = passed(state0, state1, k)
        out[0, k], out[1, k] = state0, state1
    out /= out.max(0)
    return np.stack([out[0].T.ravel()[:n], out[1].T.ravel()[:n]], 1)


def marginals(odds: np.ndarray, doc: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The probability that each word is toxic, and of each pair of states for a word and the one before it in its text.

    moves: a two by two matrix of transition weights; a text begins as if a clean word stood before it.
    """
    if not len(odds):
        return np.zeros(0), np.zeros((0, 2, 2))
    step = np.exp(moves)
    begin = np.stack([step[0], step[0]])
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    last = np.concatenate((doc[1:] != doc[:-1], [True]))
    ahead = _sweep(odds, first, step, begin)
    # backwards the potential of a word is part of what follows it
    own = np.exp(np.clip(odds, -FORCE, FORCE))
    behind = _sweep(odds[::-1], last[::-1], step.T, np.ones((2, 2)))[::-1]
    behind = np.stack([behind[:, 0], behind[:, 1] / own], 1)
    both = ahead * behind
    p = both[:, 1] / both.sum(1)
    here = np.stack([behind[1:, 0], behind[1:, 1] * own[1:]], 1)
    pairs = ahead[:-1, :, None] * step * here[:, None, :]
    pairs /= pairs.sum((1, 2), keepdims=True)
    pairs[first[1:]] = 0
    return p, pairs


def _tags(hashes: np.ndarray, doc: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Whether each word is a toxic token, from labels of documents."""
    kinds = hashes[:-1]  # words and their beginnings
    up = label[doc] == 1
    word = hashes[0]
    around = mix(np.roll(word, 1) + mix(np.roll(word, -1)))
    n1, n0 = float((label == 1).sum()), float((label == 0).sum())
    out = np.zeros(len(doc), bool)
    for k, row in enumerate(kinds):
        here = np.flatnonzero(row)
        key, place = np.unique(row[here], return_inverse=True)
        pair = np.unique(place.astype(np.int64) * len(label) + doc[here])  # each document counts once
        of, toxic = pair // len(label), label[pair % len(label)] == 1
        a = np.bincount(of[toxic], minlength=len(key)).astype(float)
        b = np.bincount(of[~toxic], minlength=len(key)).astype(float)
        # copies of a document are one witness: a word counts no more often than it has different neighbours
        held = np.flatnonzero(up[here])
        first = np.unique(mix(place[held].astype(np.uint64) + np.uint64(1)) + around[here[held]], return_index=True)[1]
        a = np.minimum(a, np.bincount(place[held[first]], minlength=len(key)))
        rate = (a + b) / (n1 + n0)
        with np.errstate(divide="ignore", invalid="ignore"):
            part = lambda x, e: np.where(x > 0, x * np.log(x / e), 0)
            ratio = 2 * (part(a, n1 * rate) + part(b, n0 * rate) + part(n1 - a, n1 * (1 - rate)) + part(n0 - b, n0 * (1 - rate)))
        # toxic documents must be the most of those that hold it, not only too many
        good = (ratio >= MIN_RATIO) & (a >= MIN_DOCS) & (a / n1 > 9 * b / n0) & (a > b)
        out[here] |= good[place]
    return out & up


def _odds(weights: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The sum of the weights of each word's features."""
    out = np.zeros(places.shape[1])
    for row in places:
        out += weights[row]
    return out


def _field(places: np.ndarray, doc: np.ndarray, tags: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features and transitions: AdaGrad on the gradient of the log likelihood of tags."""
    weights, moves = np.zeros(1 << bits), np.zeros((2, 2))
    moves[:, 1] = np.log((tags.sum() + 1) / len(tags))  # so that most words are clean from the start
    square, square_moves = np.ones(1 << bits), np.ones((2, 2))
    cuts = np.searchsorted(doc, np.arange(PARTS + 1) * (doc[-1] + 1) / PARTS)
    for _ in range(EPOCHS):
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            at, own, tag = places[:, lo:hi], doc[lo:hi], tags[lo:hi]
            p, pairs = marginals(_odds(weights, at), own, moves)
            slope = -RIDGE * (hi - lo) * weights
            for row in at:
                slope += np.bincount(row, tag - p, 1 << bits)
            slope[0] = 0  # the place of absent features
            square += slope * slope
            weights += RATE * slope / np.sqrt(square)
            seen = np.zeros((2, 2))
            inner = own[1:] == own[:-1]
            np.add.at(seen, (tag[:-1][inner].astype(int), tag[1:][inner].astype(int)), 1)
            slope = seen - pairs.sum(0)
            square_moves += slope * slope
            moves = np.clip(moves + RATE * slope / np.sqrt(square_moves), -MOVE, MOVE)
    return weights, moves


def _gathered(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts: logs of its expected toxic words and of its words, the log odds of the most certain, and 1."""
    most = np.zeros(n)
    np.maximum.at(most, doc, p)
    size = np.bincount(doc, minlength=n)
    odds = np.log((most + 1e-4) / (1 - most + 1e-4))
    return np.stack([np.log(np.bincount(doc, p, n) + 1e-3), np.log1p(size), odds, np.ones(n)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    theta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hess = (x * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        step = np.linalg.solve(hess, x.T @ (weight * (y - p)) - 0.1 * theta)
        theta = theta + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return theta


def prepared(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts: hashes, the number of their text, starts and ends in the texts joined by a line feed."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, ends = bounds(data)
    edge = np.cumsum([len(x) + 1 for x in texts])
    return _hashed(data, starts, ends), np.searchsorted(edge, starts, "right"), starts, ends


class Model:
    """The field's weights (null without usable labels), its transitions and the weights of the score."""

    def __init__(self, weights: np.ndarray | None, moves: np.ndarray, last: np.ndarray, bits: int = BITS):
        self.weights, self.moves, self.last, self.bits = weights, moves, last, bits

    @classmethod
    def fit(cls, texts: list[bytes], label: np.ndarray, prior: np.ndarray, bits: int = BITS) -> Model:
        """prior: how many labelled rows each row stands for."""
        if len(set(label.tolist())) < 2:
            return cls(None, np.zeros((2, 2)), np.zeros(4), bits)
        hashes, doc, _, _ = prepared(texts)
        places = features(hashes, doc, bits)
        part = np.zeros(len(label), int)
        for kind in (0, 1):
            at = np.flatnonzero(label == kind)
            part[at] = np.arange(len(at)) % FOLDS

        def fitted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            held = rows[doc]
            number = np.cumsum(rows) - 1
            own = number[doc[held]]
            if not len(own):
                return np.zeros(1 << bits), np.zeros((2, 2))
            return _field(places[:, held], own, _tags(hashes[:, held], own, label[rows]).astype(float), bits)

        x = np.zeros((len(label), 4))
        for k in range(FOLDS):
            weights, moves = fitted(part != k)
            held = (part == k)[doc]
            p, _ = marginals(_odds(weights, places[:, held]), doc[held], moves)
            x[part == k] = _gathered(p, doc[held], len(label))[part == k]
        return cls(*fitted(np.ones(len(label), bool)), _logistic(x, label.astype(float), prior), bits)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The marginal, text, start and end (in the joined texts) of each word."""
        hashes, doc, starts, ends = prepared(texts)
        if self.weights is None or not len(doc):
            return np.zeros(len(doc)), doc, starts, ends
        return marginals(_odds(self.weights, features(hashes, doc, self.bits)), doc, self.moves)[0], doc, starts, ends

    def scores(self, p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Of n texts with these marginals."""
        if self.weights is None:
            return np.zeros(n)
        return 1 / (1 + np.exp(-np.clip(_gathered(p, doc, n) @ self.last, -500, 500)))


def fitted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, bits: int = BITS) -> Model:
    """The model of at most max_rows labelled rows of docs of either label; the driver gets these alone."""
    sure = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).cast("bigint").alias("k")).agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("z")).where("y = z").select("k", "y")
    total = {r.y: r.n for r in sure.groupBy("y").agg(F.count("*").alias("n")).collect()}
    short = docs.where(F.col(key).isNotNull() & (F.octet_length(text) <= max_bytes)).select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    rows = []
    for y in (0, 1):  # more keys than rows are wanted, as texts beyond the bound have labels too
        some = sure.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(2 * max_rows)
        once = short.join(F.broadcast(some), "k").groupBy("k").agg(F.first("y").alias("y"), F.min("t").alias("t"))
        rows += once.orderBy(F.xxhash64("k"), "k").limit(max_rows).collect()
    rows.sort(key=lambda r: r.k)
    label_of = np.array([r.y for r in rows], int)
    share = np.array([total.get(y, 0) / max(1, (label_of == y).sum()) for y in (0, 1)])
    return Model.fit([lowered(r.t) for r in rows], label_of, share[label_of] if len(rows) else np.zeros(0), bits)


_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])))])
_FORM = "doc_id bigint, score double, spans array<struct<start: bigint, end: bigint, probability: double>>"


def offending(p: np.ndarray, starts: np.ndarray, ends: np.ndarray, points: np.ndarray) -> list[dict]:
    """Stretches of neighbouring words at SPAN_AT or more, in code points, with their greatest probability."""
    out: list[dict] = []
    before = -2
    for i in np.flatnonzero(p >= SPAN_AT).tolist():
        if i == before + 1:
            out[-1] |= {"end": int(points[ends[i]]), "probability": max(out[-1]["probability"], float(p[i]))}
        else:
            out.append({"start": int(points[starts[i]]), "end": int(points[ends[i]]), "probability": float(p[i])})
        before = i
    return out


def judged(texts: list[str | None], model: Model) -> list[tuple[float, list[dict]]]:
    """The score and the offending spans of each text."""
    out: list[tuple[float, list[dict]]] = []
    data = [lowered(x) for x in texts]
    lo = 0
    while lo < len(data):  # texts of about a slice of bytes at a time
        hi, size = lo + 1, len(data[lo])
        while hi < len(data) and size + len(data[hi]) <= SLICE:
            size += len(data[hi])
            hi += 1
        part = data[lo:hi]
        p, doc, starts, ends = model.words(part)
        score = model.scores(p, doc, len(part))
        cuts = np.searchsorted(doc, np.arange(len(part) + 1))
        base = 0
        for i, x in enumerate(part):
            a, b = cuts[i], cuts[i + 1]
            hot = a + np.flatnonzero(p[a:b] >= SPAN_AT)
            spans = offending(p[a:b], starts[a:b] - base, ends[a:b] - base, code_points(np.frombuffer(x, np.uint8))) if len(hot) else []
            out.append((float(score[i]), spans))
            base += len(x) + 1
        lo = hi
    return out


def toxic_spans(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, spans) of every row of docs; spans hold start and end in code points, end exclusive, and probability."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = judged(batch.column("text").to_pylist(), held.value)
            yield record_batch(_OUT, [batch.column("doc_id"), [x for x, _ in found], [x for _, x in found]])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(kernel, _FORM)


#: Rows with this remainder of crc32(doc_id) are held out.
PARTS_HELD, HELD = 5, 0


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fitted(docs, labels.where(fold("doc_id", PARTS_HELD) != HELD))
    held = F.coalesce(fold("doc_id", PARTS_HELD) == HELD, F.lit(False))
    return toxic_spans(docs, model).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "spans")
