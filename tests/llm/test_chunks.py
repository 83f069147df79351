import hashlib
import random

import numpy as np

from scriptorium.llm import _common
from scriptorium.llm import chunks as C


def brute_cuts(data):
    out, h, last = [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(C.GEAR[b])) % 2**32
        while i + 1 - last > C.MAX_BYTES:
            last += C.MAX_BYTES
            out.append(last)
        if h >> (32 - C.MASK_BITS) == 0 and i + 1 - last >= C.MIN_BYTES:
            out.append(i + 1)
            last = i + 1
    if data and (not out or out[-1] != len(data)):
        out.append(len(data))
    return out


def test_cuts_roll():
    rng = random.Random(5)
    for n in (0, 1, 40, 500, 5000):
        data = bytes(rng.choice(b"abcdefgh ij\n") for _ in range(n))
        assert C.cuts(np.frombuffer(data, np.uint8)) == brute_cuts(data)
    assert C.cuts(np.frombuffer(b"a" * 5000, np.uint8)) == brute_cuts(b"a" * 5000)


def text(rng, words):
    return " ".join("".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randint(2, 9))) for _ in range(words))


def docs():
    rng = random.Random(6)
    passage, other = text(rng, 55), text(rng, 80)
    rows = [(i, text(rng, rng.randint(30, 200))) for i in range(30)]
    rows += [(100 + i, f"{text(rng, rng.randint(0, 40))} {passage} {text(rng, 30)}") for i in range(6)]
    rows += [(200, other), (201, other), (202, f"{other[:150]}inserted {other[150:]}")]
    return rows


def test_runs_equal_brute_force(spark):
    rows = docs()
    seen = {}
    pieces = {}
    for d, t in rows:
        data, lo = t.encode(), 0
        for hi in brute_cuts(data):
            digest = hashlib.blake2b(data[lo:hi], digest_size=16).digest()
            pieces.setdefault(d, []).append((len(data[:lo].decode(errors="ignore")), digest))
            seen.setdefault(digest, []).append(d)
            lo = hi
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    every = C.repeated_runs(frame, min_words=0).collect()
    assert sum(r.n_chunks for r in every) == sum(len(x) for x in seen.values() if len(x) > 1)
    found = C.repeated_runs(frame).collect()
    assert {r.doc_id for r in found} == {100, 101, 102, 103, 104, 105, 200, 201, 202}  # the passages, and no clean text
    assert {r.doc_id for r in found if r.kept} == {100, 200}
    cut = {r.doc_id: r.text for r in C.without_copies(frame).collect()}
    assert cut[201] == "" and cut[200] == dict(rows)[200] and all(cut[d] == t for d, t in rows if d < 100)


def test_spans_copies_and_kept_equal_brute_force(spark):
    rows = [*docs(), (200, dict(docs())[200]), (300, None), (301, "é " * 300)]
    places = {}
    for i, (d, t) in enumerate(rows):
        data, lo = (t or "").encode(), 0
        for hi in brute_cuts(data):
            # a cut may fall inside a character: its code point counts to the chunk where it begins
            start = sum(b & 0xC0 != 0x80 for b in data[:lo])
            places.setdefault(data[lo:hi], []).append((d, i, start, sum(b & 0xC0 != 0x80 for b in data[:hi])))
            lo = hi
    marks = {}
    for found in places.values():
        if len(found) > 1:
            for x in found:
                marks.setdefault(x[:2], []).append((x[2], x[3], len(found), x == min(found)))
    want = []
    for (d, _), spans in marks.items():
        runs = []
        for a, b, n, kept in sorted(spans):
            if runs and runs[-1][1] == a and runs[-1][3] == kept:
                runs[-1] = (runs[-1][0], b, max(n, runs[-1][2]), kept, runs[-1][4] + 1)
            else:
                runs.append((a, b, n, kept, 1))
        want += [(d, *x) for x in runs]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = [(r.doc_id, r.start, r.end, r.copies, r.kept, r.n_chunks) for r in C.repeated_runs(frame, min_words=0).collect()]
    assert sorted(got) == sorted(want) and len(want) >= 10


def test_frequent_digests_and_a_full_sieve_change_nothing(spark, monkeypatch):
    frame = spark.createDataFrame(docs(), "doc_id bigint, text string").coalesce(1)
    shape = lambda: sorted(tuple(r) for r in C.repeated_runs(frame).collect())
    want = shape()
    monkeypatch.setattr(_common, "OFTEN", 0)
    monkeypatch.setattr(C, "SIEVE_OF_CHUNKS", 64)
    assert shape() == want
    monkeypatch.setattr(_common, "OFTEN", 10**9)
    assert shape() == want


def test_passages_just_over_fifty_words_are_found(spark):
    rng = random.Random(12)
    rows = []
    for i in range(300):
        passage = text(rng, rng.choice((51, 51, 55, 60)))
        rows += [(2 * i + j, f"{text(rng, rng.randint(0, 60))} {passage} {text(rng, rng.randint(0, 60))}") for j in (0, 1)]
    found = {(r.doc_id, r.kept) for r in C.repeated_runs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    both = sum((2 * i, True) in found and (2 * i + 1, False) in found for i in range(300))
    assert both >= 298 and not C.repeated_runs(spark.createDataFrame(rows[::2], "doc_id bigint, text string")).count()


def test_odd_rows(spark, odd, empty):
    assert C.repeated_runs(empty).count() == 0
    got = C.repeated_runs(odd).collect()
    assert {r.doc_id for r in got} >= {5, 6, 7} and 0 not in {r.doc_id for r in got}
    by = {(r.doc_id, r.kept) for r in got}
    assert (6, False) in by
