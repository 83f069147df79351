import hashlib
import math
import re

from scriptorium.llm import pii as P

TEXTS = ["mail a.b@x.org_c@y.net.de, 1.2.3.4.5.6.7.8 and 300.1.1.1", "@ a@b @@x.y a@b..c a@-.-", "card 4111 1111 1111 1111 or 4111-1111-1111-1112 1-2-3", "+1 (743) 555-3824 ++44 20 7946 0958)( +12", "999999.1.1.1 0001.002.3.4 " + "9" * 400, "x" * 2000 + "@" + "y" * 2000, None, "", "é🦊 é@b.co ä.ö@x.yz +49-30-123456-7"]


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, least, most in ((2, r"[0-9]([\x20-]?[0-9])+", 12, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits)))
            if least <= len(digits) <= most and (kind == 3 or total % 10 == 0):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_entities(spark):
    for t in TEXTS:
        assert P.entities(t or "") == brute(t), t
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert all(P.entities(r.text or "") == brute(r.text) for r in docs.select("text").collect())


def corpus():
    """'callme' stands beside phones only, 'word' everywhere, 'rare' beside one phone that is copied."""
    rows = [f"please callme now +1 (743) 555-{1000 + i} word" for i in range(8)]
    rows += ["rare thing +1 (743) 555-9999 word"] * 10 + ["word please now thing"] * 60
    return [(i, t) for i, t in enumerate(rows)]


def brute_neighbours(text, spans):
    """Words counted outwards from each entity, one by one."""
    words = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", text)]
    free = [w for w in words if not any(a < w[1] and w[0] < b for a, _, b in spans)]
    out = set()
    for a, kind, b in spans:
        near = sorted((w for w in words if w[1] <= a), reverse=True)[: P.NEAR] + sorted(w for w in words if w[0] >= b)[: P.NEAR]
        out |= {(s, e, text[s:e].lower(), kind, text[a:b]) for s, e in near if (s, e) in free}
    return out


def test_neighbours_have_no_limit_of_characters():
    far = "callme " + "5 " * 80 + "a@b.org"
    assert [x[2] for x in P.neighbours(far, P.entities(far))] == ["callme"]
    texts = [far, "a@b.org", "one two three four five a@b.org six, x1@y.org seven eight nine ten eleven +1 (743) 555-3824 end", "é" * 300 + " a@b.org " + "ab " * 200 + "word"]
    for t in texts:
        assert set(P.neighbours(t, P.entities(t))) == brute_neighbours(t, brute(t))


def brute_terms(rows):
    near, df, kinds = {}, {}, {}
    for i, (_, text) in enumerate(rows):
        spans = brute(text)
        for t in set(re.findall(r"[^\W\d_]{3,}", text.lower())):
            df[t] = df.get(t, 0) + 1
        for k in {k for _, k, _ in spans}:
            kinds[k] = kinds.get(k, 0) + 1
        for _, _, term, kind, entity in brute_neighbours(text, spans):
            docs, different = near.setdefault((term, kind), (set(), set()))
            docs.add(i)
            different.add(entity)
    out = set()
    for (term, kind), (docs, different) in near.items():
        share = kinds[kind] / len(rows)
        if share < 1 and len(different) >= P.MIN_ENTITIES and math.log2(len(docs) / df[term] / share) / -math.log2(share) >= P.MIN_DISCLOSURE:
            out.add((term, kind))
    return out


def test_disclosing_terms(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_terms(rows)
    assert want == {("callme", 3)}
    got = {r.doc_id: r for r in P.personal_data(frame).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        spans = [(s["start"], s["end"]) for s in got[i].added]
        assert spans == ([(m.start(), m.end()) for m in re.finditer("callme", text)])
        assert [(s["start"], s["kind"], s["end"]) for s in got[i].base] == brute(text)
    clean = {r.doc_id: r.text for r in P.sanitised(frame).collect()}
    assert clean[0] == "please [REMOVED] now [PHONE] word" and clean[8] == "rare thing [PHONE] word" and clean[20] == rows[20][1]


def test_terms_that_disclose_one_entity(spark):
    """'zorro' stands far from one address in six texts and in three without it; most texts have an address."""
    filler = "many common words that each text holds again so that there is some way between " * 4
    rows = [f"zorro writes {i} {filler} to z@x.org and Zorro signs" for i in range(6)] + [f"zorro {filler} {i}" for i in range(3)]
    rows += [f"{filler} p{i}@y.org writes and signs" for i in range(54)] + [f"{filler} {i} writes and signs" for i in range(37)]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    clean = {r.doc_id: r.text for r in P.sanitised(frame).collect()}
    for i, text in enumerate(rows):
        want = re.sub("(?i)zorro", P.REMOVED, text) if i < 6 else text
        assert clean[i] == re.sub(r"[a-z0-9]+@[xy]\.org", "[EMAIL]", want)


def test_terms_of_a_kind_go_wherever_they_stand(spark):
    filler = "many common words that each text holds again so that there is some way between " * 4
    rows = [f"callme {filler} now +1 (743) 555-{1000 + i}" for i in range(8)] + [f"{filler} now {i}" for i in range(60)]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    clean = {r.doc_id: r.text for r in P.sanitised(frame).collect()}
    assert clean == {i: f"{P.REMOVED} {filler} now [PHONE]" if i < 8 else text for i, text in enumerate(rows)}


def test_sanitise():
    assert P.sanitise("ab cd ef", [(0, 0, 2), (3, 4, 5)]) == "[EMAIL] [REMOVED] ef"
    assert P.sanitise("abcdef", [(1, 1, 4), (2, 2, 6)]) == "a[IP]"  # what overlaps goes with it


def test_odd_rows(spark, odd, empty):
    assert P.personal_data(odd).count() == odd.count() and P.personal_data(empty).count() == 0
    out = P.sanitised(odd)
    assert out.schema.names == odd.schema.names and out.count() == odd.count() and P.sanitised(empty).count() == 0
    folder = "/root/testdata/sf0.001"
    for r in P.op9_pii(spark, folder).collect():
        assert len(r.base_sha256) == 64 and (r.spans or r.base_sha256 == hashlib.sha256(b"").hexdigest())
