import hashlib
import random
import zlib

from scriptorium.llm import periods as P

FOLDER = "/root/testdata/sf0.001"


def brute_runs(w):
    """Every maximal stretch of each period, the period's least checked word by word."""
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            m = i - s + q
            if i > s and m >= max(6, 4 * q) and not any(all(w[x] == w[x + p] for x in range(s, s + m - p)) for p in range(1, q)):
                out.append((s, m, q))
            i = max(i, s + 1) if i == s else i
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = [x.decode() for x in (text or "").encode().split()]
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(600):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, letters = rng.randint(0, 60), rng.choice([1, 2, 3, 30])
            w = [rng.randrange(letters) for _ in range(n)]
            if n > 8 and rng.random() < 0.6:
                p, a = rng.randint(1, n // 4 + 1), rng.randrange(n)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append([b"%d" % x for x in w])
        assert [list(map(tuple, f.tolist())) for f in P.examined(texts)] == [brute_runs(w) for w in texts]


def test_runs_of_a_long_text_and_least_periods():
    words = [b"%d" % (i * i) for i in range(5000)]
    text = words[:1000] + words[2000:2700] * 5 + words[3000:3100]
    (found,) = P.examined([text])
    assert found.tolist() == [[1000, 3500, 700]]
    (found,) = P.examined([[b"a", b"b"] * 40])  # a run of period 4 and of 8, too, of which the least stays
    assert found.tolist() == [[0, 80, 2]]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in P.op11_periods(spark, FOLDER).collect()}
    assert len(got) == len(docs)
    short = [r for r in docs if len((r.text or "").split()) <= 1500]
    assert len(short) > 150 and all(got[r.doc_id] == brute_row(r.doc_id, r.text) for r in short)
    assert any(x[1] for x in got.values())


def test_odd_rows(spark, odd, empty, monkeypatch, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in P.op11_periods(spark, str(tmp_path)).collect()), key=repr)
    want = [brute_row(r.doc_id, r.text) if r.doc_id not in (5, 6) else None for r in odd.select("doc_id", "text").collect()]
    assert len(got) == len(want) and sorted((x for x in want if x), key=repr) == [x for x in got if x[0] not in (5, 6)]
    long = [x for x in got if x[0] in (5, 6)]
    assert len(long) == 2 and all(x[1] >= 1 for x in long)
    assert P.periodic_runs(empty).count() == 0
