import math
import random
import zlib

import numpy as np

from scriptorium.llm import language as L

FOLDER = "/root/testdata/sf0.01"


def test_kernel_is_the_presence_kernel():
    a, b = L.profile("Abc abd"), L.profile("abc xyz")
    want = len(set(a.tolist()) & set(b.tolist())) / np.sqrt(len(a) * len(b))
    assert np.isclose(L.Kernels([a, b]).of([b])[0, 0], want) and np.isclose(L.Kernels([a]).of([a])[0, 0], 1)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in L.identified(docs).collect() if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in got) >= 0.98 * len(got) and len(got) > 200
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)


def test_labels_and_sources_of_held_out_rows_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.withColumn("lang", L.F.when(L.fold("doc_id", 4) == 2, "xx").otherwise(L.F.col("lang"))).withColumn("source", L.F.lit("s"))
    shape = lambda f: sorted((r.doc_id, r.lang_pred, round(r.score, 6)) for r in f.collect())
    assert shape(L.identified(docs)) == shape(L.identified(other))


def test_odd_rows(spark, odd, empty):
    got = {r.doc_id: r for r in L.identified(odd).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[0].score == 0
    assert L.identified(odd).count() == odd.count() and L.identified(empty).count() == 0
    assert {r.lang_pred for r in L.identified(odd.withColumn("lang", L.F.lit(None).cast("string"))).collect()} == {"und"}


def test_repeated_rows_do_not_unbound_the_fit(spark, monkeypatch):
    rows = [(1, "the same text over and over", "en")] * 2000 + [(i, f"another text {i}", "en" if i % 2 else "de") for i in range(2, 22)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    sizes = []
    collect = type(frame).collect
    monkeypatch.setattr(type(frame), "collect", lambda self: sizes.append(out := collect(self)) or out)
    assert L.fitted(frame) is not None
    assert sizes and max(map(len, sizes)) <= 21


def test_kernels_with_short_and_empty_profiles(monkeypatch):
    none = L.Kernels([L.profile("a"), L.profile("b")])
    assert none.of([L.profile("hello"), L.profile("")]).tolist() == [[0, 0], [0, 0]]
    monkeypatch.setattr(L, "CELLS", 7)  # many blocks
    texts = ["abc", "a", "abd abc", "", "zzzzzz", "Abc ABD xyz"]
    sets = [set(L.profile(t).tolist()) for t in texts]
    want = [[len(a & b) / np.sqrt(len(a) * len(b)) if a and b else 0 for b in sets] for a in sets]
    assert np.allclose(L.Kernels([L.profile(t) for t in texts]).of([L.profile(t) for t in texts]), want, atol=1e-6)


def test_predictions_equal_plain_kernel_ridge_regression(spark):
    """Landmarks, map and regression written out, with kernels from sets."""
    rng = random.Random(8)
    words = {"en": "the and that with from this have which".split(), "fr": "les des une dans pour avec sur qui".split(), "de": "der die und nicht mit auf ein von".split()}
    rows = [(i, " ".join(rng.choices(words[x], k=rng.randint(3, 12))), x) for i, x in enumerate(rng.choices(list(words), k=240))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    key = {r.doc_id: r.h for r in frame.select("doc_id", L.F.xxhash64("doc_id").alias("h")).collect()}
    learn = sorted((x, key[d], d, t) for d, t, x in rows if zlib.crc32(str(d).encode()) % 4 != 2)
    by = {x: [r for r in learn if r[0] == x] for x in words}
    fit = [r for x in sorted(by) for r in by[x][: L.FIT]]
    landmarks = [r for x in sorted(by) for r in by[x][: L.LANDMARKS]]
    grams = lambda t: {(n, (b := " ".join(t.lower().split()).encode())[i : i + n]) for n in L.N for i in range(len(" ".join(t.lower().split())) - n + 1)}
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    marks = [grams(r[3]) for r in landmarks]
    k = lambda texts: np.array([[kernel(grams(t), m) for m in marks] for t in texts])
    value, vector = np.linalg.eigh(k([r[3] for r in landmarks]))
    good = value > 1e-6 * value.max()
    mapped = lambda texts: np.hstack([k(texts) @ vector[:, good] / np.sqrt(value[good]), np.ones((len(texts), 1))])
    names = sorted(words)
    phi, target = mapped([r[3] for r in fit]), np.array([[1.0 if r[0] == x else -1.0 for x in names] for r in fit])
    weight = np.array([1 / sum(q[0] == r[0] for q in fit) for r in fit])
    root = np.sqrt(weight)[:, None]
    extra = np.sqrt(L.RIDGE) * np.eye(phi.shape[1])[:-1]  # the intercept is not shrunk
    beta = np.linalg.lstsq(np.vstack([phi * root, extra]), np.vstack([target * root, np.zeros((len(extra), len(names)))]), rcond=None)[0]
    z = mapped([t for _, t, _ in rows]) @ beta
    p = np.exp(L.SHARPNESS * z)
    p /= p.sum(1, keepdims=True)
    got = {r.doc_id: r for r in L.identified(frame).collect()}
    for (d, _, _), row in zip(rows, p, strict=True):
        assert got[d].lang_pred == names[row.argmax()] and abs(got[d].score - row.max()) < 1e-3
