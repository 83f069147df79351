import hashlib

import numpy as np
import pytest
from helpers import rows

from scriptorium.operators import embed as M
from scriptorium.operators import pages, views
from scriptorium.operators import search as S


def test_vectors_keep_their_texts(spark):
    data = [(i, None if i == 3 else f"word{i % 7} Common, common {i}") for i in range(300)] + [(300, "")]
    got = {r.pos: r.v for r in M.embedded(spark.createDataFrame(data, "pos bigint, text string").repartition(5), M.HashedProjection(32), batch=7).collect()}
    for i, text in data:
        want = np.zeros(32)
        for t in (text or "").replace(",", "").lower().split():
            h = hashlib.md5(t.encode()).hexdigest()
            want[int(h[:8], 16) % 32] += 1 - 2 * (int(h[8:10], 16) % 2)
        size = np.linalg.norm(want)
        assert np.allclose(got[i], want / (size or 1)) and (not size or abs(np.linalg.norm(got[i]) - 1) < 1e-12)


def test_a_batch_that_fails_fails_the_call(spark):
    df = spark.range(20).selectExpr("id AS pos", "cast(id AS string) AS text")

    def failing(texts):
        if "13" in texts:
            raise OSError("no answer")
        return np.ones((len(texts), 2))

    for encoder, message in ((failing, "no answer"), (lambda t: np.ones((len(t) - 1, 2)), "the encoder gave"), (lambda t: np.full((len(t), 2), np.nan), "finite"), (lambda t: np.ones((len(t), len(t))), "the encoder gave")):
        with pytest.raises(Exception, match=message):
            M.embedded(df.coalesce(1), encoder, batch=3).collect()


def test_grid_of_blocks_finds_what_a_full_product_finds(spark, monkeypatch):
    monkeypatch.setattr(S, "PACKED", 7)
    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (60, 4)).astype(float)  # many ties
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "pos bigint, v array<double>").repartition(6)
    got = {}
    for r in S.dense_search(df, df.selectExpr("pos AS q", "v"), 5, exclude_self=True).collect():
        got.setdefault(r.q, {})[r.rank] = (r.pos, r.score)
    score = v @ v.T
    for q in range(60):
        order = sorted((-score[q, p], p) for p in range(60) if p != q)[:5]
        assert [got[q][k + 1] for k in range(5)] == [(p, -s) for s, p in order]
    assert S.dense_search(df, df.selectExpr("pos AS q", "v").where("q < 3"), 0).count() == 180
    assert S.dense_search(df.where("false"), df.selectExpr("pos AS q", "v"), 3).count() == 0


def test_links_of_concepts(spark):
    cases = [
        ("deep net, Deep Net and deep nets: net", ["deep net", "nets", "deep"], "[[deep net]], Deep Net and [[deep]] [[nets]]: net"),
        ("over-fit over-fitting", ["over-fit", "over"], "[[over-fit]] [[over]]-fitting"),
        ("a `code graph` $$graph x$$ $graph$ [[graph]] ` graph", ["graph"], "a `code graph` $$graph x$$ $graph$ [[graph]] ` [[graph]]"),
        ("$$graph $ graph", ["graph"], "$$[[graph]] $ graph"),  # two signs with nothing between them are a run
        ("  > graph\n\ngraph\n| graph", ["graph"], "  > graph\n\n[[graph]]\n| graph"),
        ("élan graph_x graph", ["graph", "élan"], "élan graph_x [[graph]]"),
        ("C++11 x86", ["c++11", "x86"], "[[C++11]] x86"),
    ]
    for text, labels, want in cases:
        assert rows(spark.createDataFrame([(text,)], "t string").select(pages.linked_concepts(labels)("t"))) == [(want,)], text
    many = " ".join(f"term{i:02}" for i in range(20))
    got = rows(spark.createDataFrame([(many + " " + many,)], "t string").select(pages.linked_concepts([f"term{i:02}" for i in range(20)])("t")))[0][0]
    assert got.count("[[") == 8 and got.startswith("[[term00]] [[term01]]")


def layout(fields, links):
    """The same forces, pair by pair."""
    n = len(fields)
    xs = [300 * np.cos(i / n * np.pi * 2) for i in range(n)]
    ys = [300 * np.sin(i / n * np.pi * 2) for i in range(n)]
    most = max([1, *(w for _, _, w in links)])
    for step in range(400):
        force = np.zeros((n, 2))
        for i in range(n):
            for j in range(n):
                if i != j:
                    d = np.array([xs[i] - xs[j], ys[i] - ys[j]])
                    far = d @ d
                    if far < 1:
                        d, far = np.array([i - j, 1.0 if i < j else -1.0]), 2.0
                    force[i] += d / np.sqrt(far) * ((fields[i][2] + fields[j][2] + 24) ** 2 * 60 / far)
        for a, b, w in links:
            i, j = (next(k for k, f in enumerate(fields) if f[0] == x) for x in (a, b))
            pull = np.array([xs[j] - xs[i], ys[j] - ys[i]]) * (w / most) / 6
            force[i] += pull
            force[j] -= pull
        for i in range(n):
            size = np.hypot(*force[i])
            go = force[i] / (size or 1) * min(40, size) * (1 - step / 400) * 0.35
            xs[i], ys[i] = xs[i] + go[0], ys[i] + go[1]
    return {f[0]: (x, y) for f, x, y in zip(fields, xs, ys, strict=True)}


def test_field_layout(spark):
    fields = [(7, 900, 46.0), (2, 500, 37.3), (9, 450, 36.0), (4, 410, 35.0)]
    links = [(2, 7, 9), (7, 9, 4), (2, 4, 4)]
    one, two = spark.createDataFrame(fields, "community int, size bigint, radius double"), spark.createDataFrame(links, "a int, b int, n bigint")
    got = {r.community: (r.x, r.y) for r in views.field_layout(one, two).collect()}
    want = layout(fields, links)
    assert got.keys() == want.keys() and all(np.allclose(got[c], want[c], atol=1e-6) for c in want)
    assert [(r.x, r.y) for r in views.field_layout(one.where("community = 7"), two.where("false")).collect()] == [(300.0, 0.0)]
    assert views.field_layout(one.where("false"), two).count() == 0
    with pytest.raises(Exception, match="at most"):
        views.field_layout(spark.range(500).selectExpr("id AS community", "1L AS size", "1.0D AS radius"), two).collect()
