import random

import pytest
import sentencepiece

from scriptorium.llm import pieces as P

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return P.Pieces()


def test_ids_are_the_library_s(spark, vocabulary):
    library = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    rng = random.Random(4)
    texts = ["".join(rng.choice("aabcdeeé ñ\n\t  theingß🦊\x00.,") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts += [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()]
    for text, ids in zip(texts, vocabulary.encode(texts), strict=True):
        assert list(ids) == library.encode(text) and vocabulary.decode(ids) == text


def test_admitted_pairs_are_those_of_the_merges(vocabulary):
    rng = random.Random(7)
    short = [x for x in vocabulary.reached if len(x) < 7]
    for _ in range(20_000):
        a, b = rng.choice(short), rng.choice(short)
        assert vocabulary.admitted(a, b) == (vocabulary.merged(a + b) == [a, b])


def test_each_word_alone_equals_the_shared_trie(vocabulary):
    words = [" the", " them", " theme", " thermal", "the", "x" * 40, " x▁y", "\n", "   a"]
    together = vocabulary.encode_words(words)
    assert all(vocabulary.encode_words([w])[w] == ids for w, ids in together.items())
    assert all(vocabulary.decode([vocabulary.score[" "][1], *ids]) == w for w, ids in together.items())


def test_the_path_is_the_best_of_all_admitted_ones(vocabulary):
    rng = random.Random(9)

    def paths(word):
        """All ways to cut a word into pieces whose pairs are admitted, with their scores."""
        if not word:
            yield [], 0.0
        for n in range(1, len(word) + 1):
            if (last := word[len(word) - n :]) in vocabulary.reached:
                for before, score in paths(word[: len(word) - n]):
                    if not before or vocabulary.admitted(before[-1], last):
                        yield [*before, last], score + vocabulary.reached[last][0]

    words = {"".join(rng.choice(" theinrsaolpdcm") for _ in range(rng.randint(1, 9))) for _ in range(300)}
    for word, ids in vocabulary.encode_words(list(words)).items():
        best, _ = max(paths(word), key=lambda x: x[1])
        assert [vocabulary.reached[x][1] for x in best] == list(ids)


def test_round_trip_of_odd_rows(spark, odd, empty, vocabulary):
    coded = P.encoded(odd)
    assert all(r.round_trip for r in coded.collect()) and coded.count() == odd.count()
    back = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in P.decoded(coded).collect())
    assert back == sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in odd.collect())
    assert P.encoded(empty).count() == 0
    sign = spark.createDataFrame([(1, "a ▁b")], "doc_id bigint, text string")
    assert P.encoded(sign).first().round_trip


def test_round_trip_decodes_the_ids(spark, vocabulary, monkeypatch):
    import numpy as np

    texts = ["a wide  \n world", "▁é🦊\x00", "", None, "x" * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in P.encoded(rows).collect()}
    for i, t in enumerate(texts):
        assert got[i].round_trip and vocabulary.decoded_bytes(np.array(got[i].ids, np.int64))[1:].decode() == (t or "")
    right = P.Pieces.encode_words
    # an encoder that gives other pieces is found out: its ids aren't what words say
    monkeypatch.setattr(P.Pieces, "encode_words", lambda self, words, admitted=None: {w: (x if w != " world" else right(self, [" word"])[" word"]) for w, x in right(self, words, admitted).items()})
    wrong = vocabulary.encode(["a wide world"])[0]
    assert vocabulary.decoded_bytes(np.array(wrong, np.int64)) != b" a wide world"
