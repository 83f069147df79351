import re
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import normalize as N
from scriptorium.functions import text as T


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first()[0]


def grams(spark, text, n=2):
    return one(spark, text, lambda c: T.terms(c, n))


def expected(text, n=2):
    """The rules character by character."""
    text = re.sub(r"\\[A-Za-z]*|\$", " ", text)
    runs, run, token, out = [], [], "", []

    def flush(end):
        nonlocal run, token
        word, token = token.strip("-"), ""
        if word:
            if len(word.encode()) >= 2 and word not in T.DROPPED and not re.fullmatch("[0-9]+", word):
                run.append(word)
            else:
                runs.append(run)
                run = []
        if end:
            runs.append(run)
            run = []

    for c in text:
        if c in "'’":
            continue
        kind = unicodedata.category(c)
        if kind[0] == "L" or kind == "Nd":
            token += c.lower()
        elif c in "-_":
            token += "-"
        else:
            flush(c in '.!?;:,()[]{}"“”—–/\\|\n\r')
    flush(True)
    for r in runs:
        for k in range(1, n + 1):
            out += [" ".join(r[i : i + k]) for i in range(len(r) - k + 1)]
    return sorted(out)


def test_terms_known(spark):
    got = grams(spark, "We evaluate large language models. LLMs have improved retrieval.")
    assert "large language" in got and "language models" in got and "models llms" not in got
    assert "retrieval documents" not in grams(spark, "retrieval of documents")
    assert {"retrieval-augmented", "retrieval-augmented generation"} <= set(grams(spark, "retrieval-augmented generation improves grounding"))
    assert not {"textbf", "alpha"} & set(grams(spark, r"\textbf{transformer} textbf $\alpha$"))
    assert not {"2023", "8"} & set(grams(spark, "in 2023 we scaled to 8 GPUs"))
    assert "neural language" not in grams(spark, "graph neural, language models")
    assert grams(spark, None) == [] and grams(spark, "") == []


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="abé éñ12 -_'’.,$\\|\nthe of Ü=\t", max_size=60), min_size=60, max_size=120))
def test_terms_follow_the_rules(spark, texts):
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("x", T.terms("x", 2).alias("y")).collect()
    for r in got:
        assert sorted(r.y) == expected(r.x), r.x


def test_char_grams(spark):
    assert one(spark, " Ab  cdé", lambda c: T.char_grams(c, 4)) == ["ab c", "b cd", " cdé"]
    assert one(spark, "abc", lambda c: T.char_grams(c, 4)) == []


def test_slug(spark):
    cases = {"Attention Is All You Need": "attention-is-all-you-need", "  Padded  Title  ": "padded-title", "LoRA: Low-Rank Adaptation of LLMs": "lora-low-rank-adaptation-of-llms", "BM25 (Okapi) & TF-IDF": "bm25-okapi-tf-idf", "---leading and trailing---": "leading-and-trailing", "Naïve Bayes": "na-ve-bayes", "!!!": "", "": "", "2013--2026": "2013-2026"}
    for given_, want in cases.items():
        assert one(spark, given_, N.slug) == want


def test_ids(spark):
    cases = {"2301.12345v2": "2301.12345", "2301.12345": "2301.12345", "http://arxiv.org/abs/2301.12345v11": "2301.12345", "cs/0501001v1": "cs/0501001", "1234v": "1234v"}
    for given_, want in cases.items():
        assert one(spark, given_, N.strip_version) == want
    for given_, want in {"2407.06437": "2024-07-01", "hep-ph/9901001": "1999-01-01", "math/0701001": "2007-01-01", "junk": None}.items():
        found = one(spark, given_, N.year_month_of_id)
        assert (found and str(found)) == want


def test_contains_word(spark):
    for text, phrase, want in [("a jet engine", "jet", True), ("jetty", "jet", False), ("the jetty and a jet", "jet", True), ("fighter jet.", "fighter jet", True), ("jet2", "jet", False), ("über jet", "jet", True)]:
        assert one(spark, text, lambda c: N.contains_word(c, phrase)) is want


def test_guard(spark):
    cases = {"Run a harvest": "execute", "How do I run a harvest?": "none", "please delete it": "execute", "can you run it": "execute", "sudo ls": "execute", "": "none", "$ ls": "execute", "Tell me more": "none", "```x```": "execute"}
    for given_, want in cases.items():
        assert one(spark, given_, N.asks_for_action) == want, given_


def test_lists(spark):
    assert one(spark, " a, ,b ,", N.split_list) == ["a", "b"]
    assert one(spark, "one two  three four", lambda c: T.first_words(c, 2)) == "one two…"
    assert one(spark, "Keywords: 'Solar Cells', perovskite; stability\n- interfaces, charge transport, doping", N.parse_keywords) == ["solar cells", "perovskite", "stability", "interfaces", "charge transport"]
    assert one(spark, "a, b", N.parse_keywords) == []
    assert one(spark, "3d printing, 5g networks\n1. 2d maps\n2) \"Wave.\"\n- * x, last", N.parse_keywords) == ["3d printing", "5g networks", "2d maps", "wave", "* x"]
    assert one(spark, "a b c d e f g, one, two, ONE, three, topics: four, 'five'", N.parse_keywords) == ["one", "two", "three", "four", "five"]
    made = spark.sql("select map('b', array(1), 'a', array(0, 2)) m").select(N.rebuilt_abstract("m")).first()[0]
    assert made == "a b a"


def test_gram_rows_equal_terms(spark):
    """Tokens found in one pass and those of the split text, over texts of the signs that matter."""
    import random

    from scriptorium.operators.index import gram_rows

    rng = random.Random(2)
    parts = ["foo", "Bar", "the", "a", "12", "x1", "é", "ÉÀ", "don't", "it’s", "-", "--", "a-b", "b--c", "-d", "e-", "_", "f_g", "\\alpha", "\\", "$", ".", ",", "—", "–", "“q”", "(", "[z]", "|", "/", "\n", "\r", "\t", " ", "́", "İ", "ΑΣ", "🦊", "²", "٣", "co-op's"]
    texts = [None, "", " "] + ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 30))) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(texts)), "pos int, x string")
    for n in (1, 2, 3):
        want = sorted((r.pos, t) for r in rows.select("pos", T.terms("x", n).alias("y")).collect() for t in r.y)
        got = sorted((r.pos, r.term) for r in gram_rows(rows, ["pos"], "x", n).collect())
        assert got == want
