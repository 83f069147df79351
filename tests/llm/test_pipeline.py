import corpus_pipeline
import numpy as np

from scriptorium.llm import decontaminate, pieces, pii, quality, simhash
from scriptorium.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


def test_equals_the_stages_by_hand(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    model = quality.fitted(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    left = {d: t for d, t in docs.items() if quality.judge(t, model)[6]}
    prints = {d: simhash.fingerprint((t or "").encode()) for d, t in left.items()}
    root = {d: d for d in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in left:
        for b in left:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    left = {d: t for d, t in left.items() if find(d) == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for d, t in list(left.items()):
        words = decontaminate.words_of(t)
        for _, item in items:
            wanted = decontaminate.words_of(item)
            if any(words[i] == wanted[0] or words[i] == wanted[-1] for i in range(len(words))):
                at = {w: i + 1 for i, w in enumerate(dict.fromkeys(wanted))}
                ids = np.array([at.get(w, 0) for w in words], np.int32)
                if decontaminate.align(np.array([at[w] for w in wanted], np.int32), ids)[0] >= decontaminate.MIN_SCORE * 2 * len(wanted):
                    left.pop(d, None)
                    break
    frame = spark.createDataFrame(list(left.items()), "doc_id bigint, text string")
    clean = {r.doc_id: pii.sanitise(left[r.doc_id] or "", [tuple(s) for s in (*r.base, *r.added)]) for r in pii.personal_data(frame).collect()}
    vocabulary = pieces.Pieces()
    want = {d: list(x) for d, x in zip(clean, vocabulary.encode(list(clean.values())), strict=True)}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == want and 100 < len(got) < 200


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "tokens"]
    empty = spark.read.parquet(f"{FOLDER}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, FOLDER)
        assert out.count() == 0
        assert name == "tokens" or out.columns == empty.columns


def test_registered():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())
    assert [sum(k.startswith(f"op{n}_") for k in QUERIES) for n in range(1, 11)] == [1] * 10
