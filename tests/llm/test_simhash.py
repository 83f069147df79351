import random
import re

import numpy as np
import xxhash

from scriptorium.llm import simhash
from scriptorium.llm.graph import components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps, distance=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    out = {}
    for f in fps:
        out.setdefault(find(f), set()).add(f)
    return {frozenset(x) for x in out.values()}


def test_fingerprints(spark, odd):
    got = simhash.fingerprints(odd).collect()
    texts = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in odd.select("doc_id", "text").collect() if r.text != "")
    by = {}
    for r in odd.select("doc_id", "text").collect():
        by[r.doc_id] = brute_fingerprint(r.text)
    assert len(texts) and all(by[r.doc_id] == r.fp % 2**64 for r in got)


def test_links_for_any_blocks_and_group_sizes(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base[:6]:  # crowded balls
        for _ in range(25):
            fps.add(b ^ sum(1 << i for i in rng.sample(range(12), rng.randint(0, 3))))
    for b in base[6:20]:
        fps.add(b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 6))))
    want = brute_classes(fps)
    nodes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp bigint")
    for group, blocks in ((4096, None), (4096, 6), (3, 5), (2, 8)):
        found = simhash.links(nodes, group=group, blocks=blocks)
        assert all(((r.a ^ r.b) % 2**64).bit_count() <= 4 for r in found.collect())
        classes = {}
        for r in components(found).collect():
            classes.setdefault(r.root, set()).add(r.node % 2**64)
        alone = fps - set().union(*classes.values(), set())
        assert {frozenset(x) for x in classes.values()} | {frozenset([x]) for x in alone} == want


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(5, 5), (3, 2)], "a bigint, b bigint")
    assert {r.root for r in components(edges).collect()} == {0} and components(edges).count() == 201


def test_odd_rows_and_empty(spark, odd, empty):
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(odd).collect()}
    assert {(0, 0), (1, 0), (2, 0), (5, 5), (6, 5)} <= got and simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(spark, odd, "")
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 0 in ids and 1 not in ids and 6 not in ids and ids.count(7) == 1 and None in ids


def test_repeated_ids_with_other_texts_stay(spark):
    rng = random.Random(4)
    a, b, c = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40)) for _ in range(3))
    rows = [(1, a, 0), (1, b, 1), (1, a, 2), (2, a, 3), (3, c, 4), (3, c, 4), (4, b, 5)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, fp int")
    got = simhash.keep_one(spark, frame, "")
    assert got.columns == frame.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted([(1, a), (1, b), (3, c)])
