import random

import numpy as np

from scriptorium.llm import decontaminate as D


def brute_align(item, text):
    h = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(text) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (D.MATCH if item[i - 1] == text[j - 1] else D.MISMATCH), h[i - 1][j] + D.GAP, h[i][j - 1] + D.GAP)
    return max(map(max, h))


def test_align():
    rng = random.Random(2)
    for _ in range(200):
        item = [rng.randint(1, 4) for _ in range(rng.randint(1, 12))]
        text = [rng.randint(0, 4) for _ in range(rng.randint(0, 20))]
        score, a, b = D.align(np.array(item), np.array(text, np.int32))
        assert score == brute_align(item, text)
        assert brute_align(item, text[a:b]) == score


def made(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    items = [[rng.choice(words) for _ in range(rng.randint(15, 40))] for _ in range(12)]
    docs = []
    for i in range(60):
        body = [rng.choice(words) for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            copy = list(rng.choice(items))
            for at in rng.sample(range(len(copy)), len(copy) // 9 * (i % 2)):
                copy[at] = rng.choice(words)
            if i % 4 == 0:
                copy.insert(len(copy) // 2, "extra")
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() + "," for w in copy]
        docs.append((i, " ".join(body)))
    return docs, [(i, " ".join(x)) for i, x in enumerate(items)]


def test_finds_what_brute_force_finds(spark):
    docs, items = made()
    want = set()
    for d, text in docs:
        for i, item in items:
            a, b = D.words_of(item), D.words_of(text)
            if brute_align(a, b) >= D.MIN_SCORE * D.MATCH * len(a):
                want.add((d, i))
    frame, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(frame, bench).collect()}
    assert got == want and len(want) >= 15
    assert {(r.doc_id, r.item_id) for r in D.contaminated(frame, bench, block_words=60).collect()} == want  # in blocks
    assert {r.doc_id for r in D.clean(frame, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_common_items_are_found(spark):
    item = "the same common passage that every single text of this corpus holds in full"
    frame = spark.createDataFrame([(i, f"w{i} {item} v{i}") for i in range(50)], "doc_id bigint, text string")
    assert D.contaminated(frame, spark.createDataFrame([(1, item)], "item_id bigint, text string")).count() == 50


def test_edited_copies_are_found_as_by_brute_force(spark):
    """One word in four, five or six replaced, words put in after every second, and items of 1 to 12 words."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    sizes = [1, 2, 3, 4, 5, 6, 7, *range(8, 13), *range(8, 13), 20, 30, 60]
    items = [[rng.choice(words) for _ in range(n)] for n in sizes]
    docs = []
    for item in items:
        copies = [[rng.choice(words) if j % every == every // 2 else w for j, w in enumerate(item)] for every in (4, 5, 6)]
        copies.append([x for j, w in enumerate(item) for x in ((w, "extra") if j % 2 else (w,))])
        copies += [[rng.choice(words) if rng.random() < 0.25 else w for w in item] for _ in range(6)]
        copies.append([w for w in item if rng.random() < 0.8])
        for copy in copies:
            docs.append((len(docs), " ".join([rng.choice(words) for _ in range(rng.randint(0, 30))] + copy + [rng.choice(words) for _ in range(rng.randint(0, 30))])))
    want = set()
    for d, text in docs:
        for i, item in enumerate(items):
            score = brute_align(item, text.split())
            if score >= D.MIN_SCORE * D.MATCH * len(item):
                want.add((d, i, score / (D.MATCH * len(item))))
    # intact copies elsewhere, so that broken n-grams are rarer than whole ones
    docs += [(1000 + i, " ".join(x)) for i, x in enumerate(items)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string")
    found = D.contaminated(frame, bench).collect()
    assert {(r.doc_id, r.item_id, r.score) for r in found if r.doc_id < 1000} == want
    assert {(1000 + i, i) for i in range(len(items))} <= {(r.doc_id, r.item_id) for r in found}


def test_odd(spark, odd, empty):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five six seven eight"), (None, "a b a b")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(odd, bench).collect()}
    assert got == {(7, 3), (None, 3), (9, None)}
    assert D.contaminated(odd, bench.where("false")).count() == 0 and D.contaminated(empty, bench).count() == 0
    assert D.clean(odd, bench).columns == odd.columns
