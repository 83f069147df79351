import hashlib

import numpy as np
import pytest
from helpers import duck, plain

from scriptorium.llm import centroids as C


def brute(rows, clusters, rounds):
    """Plain Lloyd in whole numbers over (id, components)."""
    seal = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    cents = [list(v) for _, v in sorted(rows, key=seal)[:clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for r in range(rounds + 1):
        own = [min(range(len(cents)), key=lambda c: (far(v, cents[c]), c)) for _, v in rows]
        if r < rounds:
            for c in range(len(cents)):
                held = [v for (_, v), o in zip(rows, own, strict=True) if o == c]
                if held:
                    cents[c] = [sum(x) // len(held) for x in zip(*held, strict=True)]
    d = [far(v, cents[o]) for (_, v), o in zip(rows, own, strict=True)]
    seals = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return [(i, o, x, sum(y for y, p in zip(d, own, strict=True) if p == o), sum(d), seals[o]) for (i, _), o, x in zip(rows, own, d, strict=True)]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, folder):
    got = C.op13_centroids(spark, folder).toPandas()
    want = duck(folder).sql(C.SQL).df()
    assert plain(got) == plain(want) and len(want) > 50 and got.cluster.nunique() > 5


def test_equals_plain_lloyd(spark):
    rng = np.random.default_rng(5)
    for size, clusters, spread in ((60, 4, 3), (40, 7, 1), (5, 8, 4)):  # ties, empty clusters, fewer vectors than clusters
        rows = [(i if i % 9 else None, rng.integers(-spread, spread + 1, 3).tolist()) for i in range(size)] + [(1, [0, 0, 0])] * 3
        df = spark.createDataFrame(rows, "vec_id bigint, v array<bigint>").repartition(3)
        got = sorted((tuple(r) for r in C.clustered(df, clusters, 4).collect()), key=repr)
        assert got == sorted(brute(rows, clusters, 4), key=repr)


def test_only_what_moved_is_compared():
    rng = np.random.default_rng(6)
    v, c = rng.integers(-50, 50, (500, 8)), rng.integers(-50, 50, (6, 8))
    owner, distance = C.assigned(v, np.full(500, -1), np.zeros(500, np.int64), c, np.ones(6, bool))
    after = c.copy()
    after[2] += 7
    changed = (after != c).any(1)
    kept = C.assigned(v, owner, distance, after, changed)
    fresh = C.assigned(v, np.full(500, -1), np.zeros(500, np.int64), after, np.ones(6, bool))
    assert (kept[0] == fresh[0]).all() and (kept[1] == fresh[1]).all() and (kept[0] != owner).any()
    big = np.array([[C.LARGEST, -C.LARGEST]])
    assert C.squared(big, -big).tolist() == [[8 * C.LARGEST**2]]


def test_transfers_keep_the_sums(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.integers(-9, 9, 4).tolist(), int(rng.integers(-1, 3)), int(rng.integers(0, 3)), 0) for i in range(200)]
    state = spark.createDataFrame(rows, C._FORM).repartition(5)
    got = {r.cluster: (r.n, r.total) for r in C.transfers(state, 3).collect()}
    for c in range(3):
        n = sum((o == c) - (w == c) for _, _, w, o, _ in rows)
        total = [sum(((o == c) - (w == c)) * v[k] for _, v, w, o, _ in rows) for k in range(4)]
        assert got.get(c, (0, [0] * 4)) == (n, total)


def test_odd_rows(spark):
    good = [0.5] * 63
    rows = [(1, [*good, 1.0], 0, "a"), (2, None, 0, "a"), (3, good, 0, "a"), (4, [*good, None], 0, "a"), (5, [*good, float("nan")], 0, "a"), (6, [*good, float("inf")], 0, "a"), (7, [*good, -0.01], None, None), (None, [*good, 0.0], 0, "a"), (1, [*good, 1.0], 0, "a"), (8, [], 1, "b")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, owner int, v string")
    kept = C.integer_vectors(df)
    assert sorted(((r.vec_id, r.v[63]) for r in kept.collect()), key=repr) == sorted([(1, 64), (7, -1), (None, 0), (1, 64)], key=repr)
    assert C.clustered(kept).count() == 4
    assert C.clustered(C.integer_vectors(df.where("false"))).count() == 0
    with pytest.raises(Exception, match="beyond"):
        C.integer_vectors(spark.createDataFrame([(1, [1e30] * 64)], "vec_id bigint, embedding array<float>")).collect()
