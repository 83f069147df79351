import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from scriptorium.llm import suffix_tree as S


def contexts(texts, depth):
    out = {}
    for t in texts:
        data = bytes([S.END]) * depth + S.symbols(t) + bytes([S.END])
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                at = out.setdefault(data[i - d : i], {})
                at[data[i]] = at.get(data[i], 0) + 1
    return out


TEXTS = [b"the cat sat on the mat", b"the dog sat on a log", b"", b"cats and dogs and cats", "é è é".encode()] * 8


def test_counts():
    codes, counts = S.gram_counts(TEXTS)
    want = {k + bytes([x]): n for k, v in contexts(TEXTS, S.DEPTH).items() if len(k) == S.DEPTH for x, n in v.items()}
    assert {int(c).to_bytes(8, "big")[2:]: int(n) for c, n in zip(codes, counts, strict=True)} == want


class Tree:
    """The tree as its definition says, context by context."""

    def __init__(self, counts):
        root = counts.get(b"", {})
        self.retained = {b"": {x: (root.get(x, 0) + 1) / (sum(root.values()) + 256) for x in range(256)}}
        for context in sorted(counts, key=len):
            n, total = counts[context], sum(counts[context].values())
            parent = self.retained[self.longest(context[1:])]
            divergence = sum(c * math.log(c / total / parent[x]) for x, c in n.items()) / total
            if context and total >= S.MIN_COUNT and divergence >= S.MIN_DIVERGENCE and divergence * total >= len(n):
                self.retained[context] = {x: (parent[x] * len(n) + n.get(x, 0)) / (total + len(n)) for x in range(256)}

    def longest(self, context):
        while context not in self.retained:
            context = context[1:]
        return context

    def score(self, text):
        data = bytes([S.END]) * S.DEPTH + S.symbols(text) + bytes([S.END])
        return sum(math.log10(self.retained[self.longest(data[i - S.DEPTH : i])][data[i]]) for i in range(S.DEPTH, len(data)))


@pytest.mark.parametrize("hot", [S.HOT_CODES, 40, 0])
def test_scores_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT_CODES", hot)
    monkeypatch.setattr(S, "ROWS", 50)
    rows = list(enumerate([*TEXTS, b" ".join([b"the cat zq"] * 100), b"Unseen WORDS here", b""] * 3))
    training = [t for d, t in rows if zlib.crc32(str(d).encode()) % S.FOLDS != S.HELD_OUT]
    tree = Tree(contexts(training, S.DEPTH))
    assert 1 < len(tree.retained) < len(contexts(training, S.DEPTH))
    assert all(math.isclose(sum(p.values()), 1) for p in tree.retained.values())
    frame = spark.createDataFrame([(d, t.decode()) for d, t in rows], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in S.scored(frame).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        assert math.isclose(got[d], tree.score(t), rel_tol=1e-5), (d, t)


def test_the_tree_grows_with_the_corpus(spark):
    rng = random.Random(3)
    some = lambda n: [(False, "".join(rng.choice("abcdefgh") for _ in range(40))) for _ in range(n)]
    sizes = [S.learned(spark.createDataFrame(some(n), "held_out boolean, text string")).count() for n in (50, 500, 5000)]
    assert sizes[1] > 5 * sizes[0] and sizes[2] > 5 * sizes[1]


def brute(rows):
    tokens = lambda t: (t or "").encode().lower().split() + [bytes([S.END])]
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(w for d, t in rows if not out(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return sorted(((d if d is not None else -1), out(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for d, t in rows)


def shaped(frame):
    return sorted(((r.doc_id if r.doc_id is not None else -1), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in frame.collect())


@pytest.mark.parametrize("hot", [S.HOT, 2])
def test_base(spark, odd, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    found = S.scored(odd)
    assert shaped(found) == brute(rows)
    assert all(np.isfinite(r.score) and r.score < 0 for r in found.collect())


def test_empty_and_untrained(spark, odd, empty):
    assert S.scored(empty).count() == 0
    only = odd.where("doc_id is not null").limit(0).sparkSession.createDataFrame([(d, "a b") for d in range(60) if zlib.crc32(str(d).encode()) % 7 == 2], "doc_id bigint, text string")
    assert all((r.train_tokens, r.n_known, r.base_score) == (0, 0, 0.0) and math.isfinite(r.score) for r in S.scored(only).collect())
