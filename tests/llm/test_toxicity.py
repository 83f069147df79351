import itertools
import zlib

import numpy as np

from scriptorium.llm import toxicity as T

FOLDER = "/root/testdata/sf0.01"


def test_marginals_equal_all_paths():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = int(rng.integers(1, 9))
        doc, odds, moves = np.sort(rng.integers(0, 3, n)), rng.normal(0, 2, n), rng.normal(0, 1, (2, 2))
        p, pairs = T.marginals(odds, doc, moves)
        total, want, both = 0.0, np.zeros(n), np.zeros((n - 1, 2, 2))
        for s in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(odds[i] * s[i] + moves[s[i - 1] if i and doc[i - 1] == doc[i] else 0, s[i]] for i in range(n)))
            total += w
            want += w * np.array(s)
            for i in range(1, n):
                if doc[i] == doc[i - 1]:
                    both[i - 1, s[i - 1], s[i]] += w
        assert np.allclose(p, want / total) and np.allclose(pairs, both / total)


def test_marginals_of_long_texts_stay_finite():
    rng = np.random.default_rng(1)
    odds = rng.choice([-900.0, -3.0, 0.0, 900.0], 20_000)
    p, pairs = T.marginals(odds, np.zeros(20_000, int), np.array([[T.MOVE, -T.MOVE], [-T.MOVE, T.MOVE]]))
    assert np.isfinite(p).all() and np.isfinite(pairs).all() and (p >= 0).all() and (p <= 1).all()


def test_gradient_equals_differences():
    """Expected counts against the slope of the log partition sum."""
    rng = np.random.default_rng(2)
    odds, moves, doc = rng.normal(0, 1, 6), rng.normal(0, 1, (2, 2)), np.array([0, 0, 0, 0, 1, 1])

    def log_sum(o):
        return np.log(sum(np.exp(sum(o[i] * s[i] + moves[s[i - 1] if i and doc[i - 1] == doc[i] else 0, s[i]] for i in range(6))) for s in itertools.product((0, 1), repeat=6)))

    p, _ = T.marginals(odds, doc, moves)
    for i in range(6):
        step = np.eye(6)[i] * 1e-5
        assert abs((log_sum(odds + step) - log_sum(odds - step)) / 2e-5 - p[i]) < 1e-6


def test_words_hash_alike_wherever_they_stand(monkeypatch):
    monkeypatch.setattr(T, "SLICE", 7)
    hashes, doc, starts, ends = T.prepared([b"idiotic x", b"", b"y  idiotic idiot \xc3\xa9"])
    assert doc.tolist() == [0, 0, 2, 2, 2, 2] and (hashes[:, 0] == hashes[:, 3]).all() and hashes[3, 0] == hashes[0, 4]
    places = T.features(hashes, doc)
    assert (places[-2][[0, 2]] == 0).all() and (places[-1][[1, 5]] == 0).all()  # neighbours end with a text


def test_held_out_documents(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = T.op12_toxicity(spark, FOLDER).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    seen = [(labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(y == (s >= 0.5) for y, s in seen) >= 0.95 * len(seen)
    up, down = [s for y, s in seen if y], [s for y, s in seen if not y]
    assert np.mean([[a > b for b in down] for a in up]) > 0.9
    tagged = [docs[r.doc_id][s.start : s.end].lower() for r in rows for s in r.spans]
    assert {"idiot", "stupid", "trash"} <= set(tagged)


def test_spans_are_code_points_of_the_text(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = T.fitted(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels)
    text = "İÉ der IDIOT*** ist 🦊 hier, und so weiter"
    ((score, spans),) = T.judged([text], model)
    assert [text[s["start"] : s["end"]] for s in spans] == ["IDIOT"] and score >= 0.5
    alone = T.judged(["nothing here", text, None, ""], model)
    assert alone[1] == (score, spans) and alone[2] == alone[3] == (alone[3][0], []) and alone[3][0] < 0.5


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1), (5, 0), (7, 1), (None, 1), (9, None), (8, 0), (8, 0), (3, 2)], "doc_id bigint, toxic int")
    model = T.fitted(odd, labels)
    got = T.toxic_spans(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert T.toxic_spans(empty, model).count() == 0
    one = T.fitted(odd, labels.where("doc_id = 7"))
    assert one.weights is None and {r.score for r in T.toxic_spans(odd, one).collect()} == {0.0}


def test_fit_is_bounded(spark, monkeypatch):
    docs = spark.range(50).selectExpr("id AS doc_id", "if(id % 2 = 0, 'you idiot there', 'a fine day') AS text")
    docs = docs.union(docs).union(spark.createDataFrame([(99, "x " * 9000)], "doc_id bigint, text string"))
    labels = spark.range(100).selectExpr("id AS doc_id", "cast(id % 2 = 0 AS int) AS toxic")
    seen = []
    monkeypatch.setattr(T.Model, "fit", classmethod(lambda cls, texts, y, prior, bits: seen.append((texts, y.tolist()))))
    T.fitted(docs, labels, max_rows=6)
    ((texts, y),) = seen
    assert len(texts) == 12 and sum(y) == 6 and max(map(len, texts)) < 100
