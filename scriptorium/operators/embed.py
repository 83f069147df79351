"""Texts to unit vectors, in Arrow batches, by any encoder; and an encoder that needs no model."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts that an encoder gets at a time.
BATCH = 64
#: list of texts -> matrix with a row for each, in their order.
Encoder = Callable[[list[str]], np.ndarray]


class HashedProjection:
    """Each token adds 1 or -1 to one of so many components, both by its MD5: a random projection of token counts.

    Tokens are runs of ASCII letters and digits in lower case.
    """

    def __init__(self, dims: int = 256):
        self.dims = dims
        self._known: dict[str, tuple[int, int]] = {}

    def _place(self, token: str) -> tuple[int, int]:
        if len(self._known) > 100_000:
            self._known.clear()
        if token not in self._known:
            digest = hashlib.md5(token.encode()).hexdigest()
            self._known[token] = int(digest[:8], 16) % self.dims, 1 - 2 * (int(digest[8:10], 16) % 2)
        return self._known[token]

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, text in zip(out, texts, strict=True):
            for token in re.findall("[A-Za-z0-9]+", text):
                at, sign = self._place(token.lower())
                row[at] += sign
        return out


def embedded(texts: DataFrame, encoder: Encoder, key: str = "pos", text: str = "text", batch: int = BATCH) -> DataFrame:
    """(key, v): a vector of length 1 for each row of texts; a zero vector stays zero, a null text counts as empty.

    The encoder gets so many texts at a time. If it fails on any, or gives another number of rows, another
    width than before or a value that isn't finite, the whole call fails: no row is left out.
    """
    kind = texts.schema[key].dataType

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = None
        for rows in batches:
            found = []
            for lo in range(0, rows.num_rows, batch):
                part = [x or "" for x in rows.column("_text").slice(lo, batch).to_pylist()]
                made = np.asarray(encoder(part), np.float64)
                if made.ndim != 2 or len(made) != len(part) or (width is not None and made.shape[1] != width):
                    raise ValueError(f"the encoder gave {made.shape} for {len(part)} texts")
                if not np.isfinite(made).all():
                    raise ValueError("the encoder gave a value that isn't finite")
                width = made.shape[1]
                size = np.sqrt((made * made).sum(1, keepdims=True))
                found.append(made / np.where(size > 0, size, 1))
            if found:
                flat = np.concatenate(found)
                edges = pa.array(np.arange(0, (len(flat) + 1) * width, width, dtype=np.int32)) if width else pa.array(np.zeros(len(flat) + 1, np.int32))
                yield pa.RecordBatch.from_arrays([rows.column("_key"), pa.ListArray.from_arrays(edges, pa.array(flat.ravel()))], names=[key, "v"])

    return texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(kernel, f"{key} {kind.simpleString()}, v array<double>")
