import re
from collections import Counter

import numpy as np

from scriptorium.llm import quality as Q

FOLDER = "/root/testdata/sf0.01"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_base_counts(spark, odd):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["a", "b", "ä#", "c\nd", "\n", "\t"], 60)) for _ in range(60)] + ["", "\n \n", "x", " lead", "é" * 300]
    for t in texts:
        assert Q.base_counts(t.encode())[:5] == brute(t)
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    for r in Q.judged(odd, labels).join(odd.select("doc_id", "text"), "doc_id").collect():
        want = brute(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r.base_failed == failed and r.kept == (not failed)  # no labels: the model rejects nothing


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    learn = labels.where("doc_id % 3 > 0")
    truth = {r.doc_id: r.quality for r in labels.where("doc_id % 3 = 0").collect()}
    got = {r.doc_id: (r.base_failed, r.kept) for r in Q.judged(docs, learn).collect()}
    seen = [(truth[d], kept) for d, (failed, kept) in got.items() if d in truth and not failed]
    assert sum(q == k for q, k in seen) >= 0.97 * len(seen) and len(seen) > 50


def test_probabilities_are_calibrated():
    rng = np.random.default_rng(2)
    x = rng.random((400, 32)).astype(np.float32)
    y = (x[:, 0] + 0.3 * rng.standard_normal(400) > 0.5).astype(int)
    weights, odds = Q.fit(x, y)
    p = 1 / (1 + np.exp(-(x @ weights + odds)))
    assert abs(p.mean() - y.mean()) < 0.05 and ((p > 0.5) == y).mean() > 0.75
    assert Q.fit(x, np.ones(400, int)) is None


def test_odd_labels_and_empty(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1), (5, 0), (7, 1), (None, 1), (9, None), (8, 0), (8, 0), (3, 2)], "doc_id bigint, quality int")
    assert Q.judged(odd, labels).count() == odd.count() and Q.judged(empty, labels).count() == 0
