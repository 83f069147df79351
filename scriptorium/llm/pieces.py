"""SentencePiece encoding and decoding by a shared-prefix Viterbi.

A text is marked with a leading space and cut into words: spaces with what follows them up to the next
space or line end. The distinct words of a batch are sorted, which lays out a trie depth first: each word
keeps the forward scores of the prefix that it shares with the word before and goes on from there. The
best path maximises the sum of the pieces' scores in the vocabulary file among the paths whose neighbouring
pieces are admitted; a character without a piece has the least score less UNKNOWN and becomes its bytes.
The vocabulary is one of merges, so a pair is admitted if the merges of its joint text give that pair: without
that condition the best path is not the vocabulary's encoding (README has figures). A sequence all of whose
pairs are admitted is the one that the merges of the whole word give; the ids are those of the vocabulary's own
encoder.

The cut is exact as long as no piece has a space after another character, or a line end beside one; a
vocabulary with such pieces raises an error. The sign U+2581 in a text is encoded as bytes, not as a space,
so decoding gives every text back.

Defined results: texts of any length are encoded whole; a null text gives no pieces, as does an empty one, and decodes to the empty text; a null
doc_id is kept as null; repeated rows give a row each; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import record_batch, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN = 10.0
#: Characters of the texts that are encoded together, and words whose pieces a task keeps.
CHARS, KEPT = 6_000_000, 400_000
#: Characters by whose last ones pieces are sought: short ones at once, longer ones by their possible lengths.
TAIL = 3
#: The piece before a word's first; no complement of a code point.
START = -(1 << 21)
_WORD = re.compile(r" +[^ \n]*|[^ \n]+|\n")


def cut_words(text: str | None) -> list[str]:
    """The words of a text with its leading space."""
    return _WORD.findall(" " + text) if text else []


class Pieces:
    """A vocabulary: the scores of its pieces, and the bytes of each id."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, tuple[float, int]] = {}
        self.byte = [0] * 256
        self.text: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
                self.text.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.text.append(b"")
            else:
                plain = piece.replace("▁", " ")
                if " " in plain.lstrip(" ") or ("\n" in plain and plain != "\n"):
                    raise ValueError(f"words can't be cut apart for the piece {piece!r}")
                self.score[plain] = (model.get_score(i), i)
                self.text.append(plain.encode())
        self.sizes = np.array([len(x) for x in self.text], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.all_bytes = np.frombuffer(b"".join(self.text), np.uint8)
        self.unknown = min(s for s, _ in self.score.values()) - UNKNOWN
        # The two parts that a piece's last merge joins, and when it is made: merges go by score, best first.
        self.parts: dict[str, tuple[str, str]] = {}
        self.when: dict[str, float] = {}
        for piece in sorted(self.score, key=len):
            if len(piece) > 1:
                parts = self.merged(piece, 2)
                if len(parts) == 2 and parts[0] + parts[1] in self.score:
                    self.parts[piece], self.when[piece] = (parts[0], parts[1]), -self.score[piece][0]
        #: Pieces that merges can give; no path has others.
        self.reached = {x: v for x, v in self.score.items() if len(x) == 1 or x in self.parts}
        self.name = {i: x for x, (_, i) in self.reached.items()}
        #: For the last TAIL characters of a text: the lengths of the longer pieces that may end there, longest first.
        self.lengths: dict[str, list[int]] = {}
        for n in sorted({len(x) for x in self.reached if len(x) > TAIL}, reverse=True):
            for tail in {x[-TAIL:] for x in self.reached if len(x) == n}:
                self.lengths.setdefault(tail, []).append(n)
        self.known_tails: dict[str, tuple[list[int], list[tuple[int, float, int]]]] = {}

    def merged(self, text: str, least: int = 1) -> list[str]:
        """A short text's pieces by merges, best score first, leftmost of equals, down to so many pieces."""
        parts = list(text)
        while len(parts) > least:
            found = [(self.score[x][0], -i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in self.score]
            if not found:
                break
            at = -max(found)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def admitted(self, left: str, right: str) -> bool:
        """Whether the merges of left + right give just these two.

        Merges are undone from the last on, the one next to the boundary that was made later first; if the
        pieces that meet there could have merged before the merge undone last, they would have.
        """
        when, parts, score = self.when, self.parts, self.score
        limit = float("inf")
        while True:
            over = score.get(left + right)
            if over is not None and -over[0] < limit:
                return False
            a, b = when.get(left), when.get(right)
            if a is not None and (b is None or a > b):
                limit, left = a, parts[left][1]
            elif b is not None:
                # of merges of one rank the leftmost comes first, and one over the boundary is further left
                limit, right = b + 0.5, parts[right][0]
            else:
                return True

    def fits(self, left: int, right: int) -> bool:
        """admitted() for ids; a character without a piece is the complement of its code point."""
        return left == START or self.admitted(self.name[left] if left >= 0 else chr(~left), self.name[right])

    def ending(self, tail: str) -> tuple[list[int], list[tuple[int, float, int]]]:
        """What may end in a text's last TAIL characters: lengths of longer pieces, and the others as (length, score, id)."""
        if len(self.known_tails) > KEPT:
            self.known_tails.clear()
        short = [(n, *self.reached[tail[-n:]]) for n in range(len(tail), 0, -1) if tail[-n:] in self.reached]
        found = self.known_tails[tail] = self.lengths.get(tail, []), short
        return found

    def encode_words(self, words: list[str], admitted: dict[int, bool] | None = None) -> dict[str, array]:
        """The ids of each of some distinct words; admitted keeps what is known of pairs from call to call."""
        out: dict[str, array] = {}
        score, tails, name, unknown = self.reached, self.known_tails, self.name, self.unknown
        admitted = {} if admitted is None else admitted
        best: list[float] = [0.0]  # for each end in the word before: the score of its path, and its last piece
        piece: list[int] = [START]
        last, floor = "", float("-inf")
        for word in sorted(words):
            same, most = 0, min(len(word), len(last))
            while same < most and word[same] == last[same]:
                same += 1
            del best[same + 1 :], piece[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                # the forward step: the best of the paths that end in a piece which their last one admits
                tail = word[end - TAIL : end] if end > TAIL else word[:end]
                long, short = tails.get(tail) or self.ending(tail)
                top, by = floor, START
                for n in long:
                    if n <= end and (found := score.get(word[end - n : end])):
                        if (total := best[end - n] + found[0]) > top:
                            pair = piece[end - n] << 32 | found[1]
                            if (fits := admitted.get(pair)) is None:
                                fits = admitted[pair] = self.fits(piece[end - n], found[1])
                            if fits:
                                top, by = total, found[1]
                for n, gain, right in short:
                    if (total := best[end - n] + gain) > top:
                        pair = piece[end - n] << 32 | right
                        if (fits := admitted.get(pair)) is None:
                            fits = admitted[pair] = self.fits(piece[end - n], right)
                        if fits:
                            top, by = total, right
                if by != START:
                    best.append(top)
                    piece.append(by)
                else:
                    best.append(best[end - 1] + unknown)
                    piece.append(score[word[end - 1]][1] if word[end - 1] in score else ~ord(word[end - 1]))
            ids = array("i")
            end = len(word)
            while end:
                if (step := piece[end]) >= 0:
                    ids.append(step)
                    end -= len(name[step])
                else:
                    ids.extend(self.byte[x] for x in reversed(word[end - 1].encode("utf-8", "replace")))
                    end -= 1
            ids.reverse()
            out[word] = ids
            last = word
        return out

    def encode(self, texts: list[str | None]) -> list[array]:
        """The ids of each text."""
        return self.encode_cut([cut_words(x) for x in texts])

    def encode_cut(self, cut: list[list[str]], known: dict[str, bytes] | None = None, admitted: dict[int, bool] | None = None) -> list[array]:
        """The ids of texts cut into words; known and admitted keep words (their ids as bytes) and pairs from call to call."""
        known = {} if known is None else known
        every = set().union(*cut)
        fresh = every.difference(known)
        if len(known) + len(fresh) > KEPT:
            # the words of these texts stay, the frequent ones among them
            for word in known.keys() - every:
                del known[word]
        if admitted is not None and len(admitted) > KEPT:
            admitted.clear()
        made = self.encode_words(list(fresh), admitted)
        for word, ids in made.items():
            known[word] = ids.tobytes()
        out = []
        for words in cut:
            ids = array("i")
            ids.frombytes(b"".join(map(known.__getitem__, words)))
            out.append(ids)
        return out

    def decoded_bytes(self, ids: np.ndarray) -> bytes:
        """What the pieces of an array of ids give, the leading space included."""
        size = self.sizes[ids]
        ends = np.cumsum(size, dtype=np.int64)
        if not len(ends):
            return b""
        return self.all_bytes[np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - size), size)].tobytes()

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join([self.text[i] for i in ids]).decode("utf-8", "replace")[1:]


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """(doc_id, n_pieces, round_trip, ids): the pieces of each text; round_trip tells that they decode to it."""
    # a vocabulary file's size bounds the broadcast
    held = docs.sparkSession.sparkContext.broadcast(Pieces(model))
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("round_trip", pa.bool_()), ("ids", pa.list_(pa.int32()))])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known, admitted = held.value, {}, {}
        for batch in batches:
            texts_of, lo, held_chars = batch.column("text").to_pylist(), 0, 0
            for hi, text in enumerate(texts_of, 1):
                held_chars += len(text or "")
                if held_chars < CHARS and hi < len(texts_of):
                    continue
                part, texts = batch.slice(lo, hi - lo), texts_of[lo:hi]
                lo, held_chars = hi, 0
                cut = [cut_words(x) for x in texts]
                ids = pieces.encode_cut(cut, known, admitted)
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.frombuffer(b"".join([x.tobytes() for x in ids]), np.int32)
                # the ids of each text are decoded, and give the text with its leading space
                same = [pieces.decoded_bytes(flat[a:b]) == f" {t}".encode("utf-8", "replace") if t else a == b for t, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield record_batch(schema, [part.column("doc_id"), np.diff(ends), same, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))])

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(kernel, "doc_id bigint, n_pieces bigint, round_trip boolean, ids array<int>")


def decoded(coded: DataFrame, key: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """(doc_id, text): the text of each row's pieces; null ids give the empty text."""
    held = coded.sparkSession.sparkContext.broadcast(Pieces(model))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield record_batch(schema, [batch.column("doc_id"), [held.value.decode(x or []) for x in batch.column("ids").to_pylist()]])

    return coded.select(F.col(key).cast("bigint").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(kernel, "doc_id bigint, text string")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: the pieces of each document."""
    return encoded(docs)
