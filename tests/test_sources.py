import datetime
import json
import sys
import urllib.parse
import zipfile

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from scriptorium.operators.records import Seen
from scriptorium.sources import decode as D
from scriptorium.sources import feeds as F1
from scriptorium.sources import files as X
from scriptorium.sources import harvest as H
from scriptorium.sources import requests as Q
from scriptorium.streaming import events as V

LONG = "word " * 60
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # its functions run in workers


def test_requests():
    assert Q.search_string(Q.Harvest(("fighter jet",))) == '(all:"fighter jet")'
    assert Q.search_string(Q.Harvest(("fighter jet",), ("eess.SY", "cs.RO"))) == '(cat:eess.SY OR cat:cs.RO) AND (all:"fighter jet")'
    assert Q.search_string(Q.Harvest(("radar",), (), 2025, 2026)) == '(all:"radar") AND submittedDate:[202501010000 TO 202612312359]'
    assert Q.search_string(Q.Harvest(("", "radar"), (" ",))) == '(all:"radar")'
    assert Q.search_string(Q.Harvest()) == "all:*"
    for category, want in {"cs.LG": "cs:cs:LG", "physics.flu-dyn": "physics:physics:flu-dyn", "astro-ph.GA": "physics:astro-ph:GA", "hep-ph": "physics:hep-ph", "q-bio.BM": "q-bio:q-bio:BM", "stat": "stat:stat"}.items():
        assert Q.oai_set(category) == want
    assert [Q.year_range(Q.Harvest(first=a, last=b)) for a, b in ((0, 0), (2024, 2024), (2019, 2026), (0, 2020), (2020, 0))] == ["", "2024", "2019-2026", "-2020", "2020-"]
    with pytest.raises(ValueError, match="unknown source"):
        Q.validated(Q.Harvest(source="x"))
    assert Q.validated(Q.Harvest(most=10**6)).most == 50_000


def feed(n):
    entries = "".join(f'<entry><id>http://arxiv.org/abs/2501.0000{i}v2</id><title>T {i}</title><summary>{LONG}</summary><published>2025-01-0{i + 1}T00:00:00Z</published><author><name>A</name></author><arxiv:primary_category term="cs.LG"/><category term="cs.LG"/><category term="cs.CL"/></entry>' for i in range(n))
    return f'<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">{entries}</feed>'.encode()


def test_decoders():
    found, n = D.atom(feed(2))
    assert n == 2 and found[0]["id"] == "2501.00000" and found[0]["categories"] == ["cs.LG", "cs.CL"]
    work = {"id": "https://openalex.org/W1", "display_name": "T", "publication_date": "2024-05-06", "abstract_inverted_index": {"word": list(range(1, 60)), "first": [0]}, "authorships": [{"author": {"display_name": "A"}}], "primary_topic": {"subfield": {"display_name": "S"}, "field": {"display_name": "F"}}, "open_access": {"is_oa": True}}
    found, cursor = D.openalex(json.dumps({"meta": {"next_cursor": "c"}, "results": [work]}).encode())
    assert found[0]["id"] == "openalex:W1" and found[0]["abstract"].startswith("first word") and cursor == "c" and found[0]["categories"] == ["S", "F"]
    found, following = D.semantic_scholar(json.dumps({"next": 100, "data": [{"paperId": "p", "externalIds": {"ArXiv": "2301.00001v3"}, "title": "T", "abstract": LONG, "year": 2023, "authors": [{"name": "A"}]}]}).encode())
    assert found[0]["id"] == "2301.00001" and found[0]["published"] == datetime.date(2023, 1, 1) and following == 100
    body = f'<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords><record><header status="deleted"/></record><record><header/><metadata><arXiv xmlns="http://arxiv.org/OAI/arXiv/"><id>2407.06437</id><created>2025-01-01</created><title>T</title><abstract>{LONG}</abstract><categories>cs.LG cs.CL</categories><authors><author><keyname>Doe</keyname><forenames>J.</forenames></author></authors></arXiv></metadata></record><resumptionToken>t</resumptionToken></ListRecords></OAI-PMH>'
    found, token = D.oai(body.encode())
    assert len(found) == 1 and found[0]["authors"] == ["J. Doe"] and found[0]["published"] == datetime.date(2024, 7, 1) and token == "t"
    assert D.oai(b'<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><error code="noRecordsMatch"/></OAI-PMH>') == ([], "")
    with pytest.raises(OSError, match="badArgument"):
        D.oai(b'<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><error code="badArgument">x</error></OAI-PMH>')


def scripted(answers):
    """A link that gives the answers in turn, each a list of ids and perhaps an error; calls are counted in its list."""
    calls = []

    def link(asked, seen):
        ids, error = answers[len(calls)]
        calls.append(asked)
        return [{"id": x, "title": x} for x in ids if seen.admit(x, x)], error

    return link, calls


def test_router():
    # of six records for two years the first service gives two and fails for good
    broken, tried = scripted([(["n1", "n2"], OSError("too busy"))])
    sound, asked = scripted([(["s1"], None), (["t1", "t2", "t3"], None)])
    got, error = H.harvest(Q.Harvest(("k",), first=2025, last=2026, most=6), H.Router([("one", broken), ("two", sound)]))
    assert [x["id"] for x in got] == ["n1", "n2", "s1", "t1", "t2", "t3"] and error is None and len(tried) == 1
    assert [(h.first, h.most) for h in asked] == [(2026, 1), (2025, 3)]
    # few records are no failure
    short, _ = scripted([(["n1"], None)])
    spare, asked = scripted([])
    got, error = H.harvest(Q.Harvest(("k",), most=5), H.Router([("one", short), ("two", spare)]))
    assert [x["id"] for x in got] == ["n1"] and not asked and error is None
    # what two services have in common counts once, and both errors are told
    left, _ = scripted([(["n1"], OSError("too busy"))])
    right, asked = scripted([(["n1"], OSError("gone"))])
    got, error = H.Router([("one", left), ("two", right)])(Q.Harvest(("k",), most=5), Seen())
    assert [x["id"] for x in got] == ["n1"] and asked[0].most == 4 and all(x in str(error) for x in ("one: too busy", "two: gone"))


def test_equal_shares():
    thin = {"k3": 6}
    run = lambda h, seen: ([{"id": f"{h.keywords[0]}-{i}"} for i in range(min(h.most, thin.get(h.keywords[0], 10**6)))], None)
    assert len(H.harvest(Q.Harvest(tuple(f"k{i}" for i in range(5)), most=500), run)[0]) == 406


def test_transport():
    import urllib.error

    waits, tries = [], []

    def opened(url, timeout):
        tries.append(url)
        if len(tries) < 3:
            raise urllib.error.HTTPError(url, 429, "", {"Retry-After": "7"}, None)
        return open("/dev/null", "rb")

    assert H.http(delay=1, opened=opened, sleep=waits.append)("http://x?api_key=s") == b"" and waits.count(7.0) == 2
    assert H.redacted("http://x?api_key=secret&a=1") == "http://x?api_key=***&a=1"


def test_data_source(spark):
    class Fake(H.HarvestSource):
        fetch = staticmethod(lambda url: feed(3))

        @classmethod
        def name(cls):
            return "fake_harvest"

    spark.dataSource.register(Fake)
    got = spark.read.format("fake_harvest").options(keywords="a,b", most=4).load()
    assert got.count() == 4 and got.select(F.countDistinct("id")).first()[0] == 2


def test_filters_reach_the_request(spark, tmp_path):
    log = str(tmp_path / "asked")

    class Logged(H.PushedHarvestSource):
        @staticmethod
        def fetch(url):
            with open(log, "a") as f:
                f.write(url + "\n")
            return feed(3)

        @classmethod
        def name(cls):
            return "logged_harvest"

    def asked(*where):
        open(log, "w").close()
        df = spark.read.format("logged_harvest").options(keywords="a", most=3, categories="cs,math.CO").load()
        for w in where:
            df = df.where(w)
        n = df.count()
        return n, [urllib.parse.parse_qs(x.split("?")[1])["search_query"][0] for x in open(log).read().split()]

    H.register(spark)
    spark.dataSource.register(Logged)
    assert asked() == (3, ['(cat:cs OR cat:math.CO) AND (all:"a")'])
    assert asked("published >= '2025-01-02' and published < '2025-06-01'") == (2, ['(cat:cs OR cat:math.CO) AND (all:"a") AND submittedDate:[202501010000 TO 202512312359]'])
    assert asked("primaryCategory = 'cs.LG'", "published = '2025-01-01'") == (1, ['(cat:cs.LG) AND (all:"a") AND submittedDate:[202501010000 TO 202512312359]'])
    assert asked("primaryCategory in ('cs.LG', 'stat.ML')", "title <> 'T 0'") == (2, ['(cat:cs.LG) AND (all:"a")'])
    assert asked("primaryCategory = 'stat.ML'") == (0, []) and asked("published > '2025-01-01'", "published < '2020-01-01'") == (0, [])


def test_snapshot(spark, tmp_path):
    line = lambda i, cat, date, title: json.dumps({"id": i, "title": title, "abstract": LONG, "categories": cat, "authors_parsed": [["Doe", "J.", ""]], "versions": [{"version": "v1", "created": date}]})
    lines = [line("2601.00001", "eess.SY", "Mon, 5 Jan 2026 10:00:00 GMT", "jet"), line("2502.00003", "physics.flu-dyn", "bad", "a jet"), "{broken"]
    (tmp_path / "s.json").write_text("\n".join(lines))
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.write(tmp_path / "s.json", "s.json")
    for name in ("s.json", "s.zip"):
        got = {r.id: r for r in X.snapshot_papers(X.snapshot_lines(spark, str(tmp_path / name))).collect()}
        assert set(got) == {"2601.00001", "2502.00003"} and got["2601.00001"].authors == ["J. Doe"]
        assert got["2601.00001"].published == datetime.date(2026, 1, 5) and got["2502.00003"].published == datetime.date(2025, 2, 1)
    X.write_papers(X.snapshot_papers(X.snapshot_lines(spark, str(tmp_path / "s.json"))), str(tmp_path / "p"))
    assert X.read_papers(spark, str(tmp_path / "p")).count() == 2


def test_archives(spark, tmp_path):
    for name, entries in {"a.zip": {"x.txt": "no", "s.json": "one\ntwo\n"}, "b.zip": {"t.json": "\n".join(map(str, range(2500)))}}.items():
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for entry, body in entries.items():
                z.writestr(entry, body)
    got = [r.value.rstrip("\n") for r in X.snapshot_lines(spark, f"file://{tmp_path}/*.zip").collect()]
    assert sorted(got) == sorted(["one", "two", *map(str, range(2500))])
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("x.txt", "no")
    with pytest.raises(Exception, match="no .json entry"):
        X.snapshot_lines(spark, str(tmp_path / "c.zip")).collect()


def test_matrices(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    made = [(i, [float(i), -0.5 * i]) for i in range(40)]
    df = spark.createDataFrame(made, "pos bigint, v array<float>").repartition(3)
    X.save_vectors(df, path)
    assert sorted(map(tuple, X.load_vectors(spark, path).collect())) == made
    X.save_vectors(df.where("pos < 5"), path)  # replaces the first, whose parts go
    assert sorted(map(tuple, X.load_vectors(spark, path).collect())) == made[:5]
    names = json.loads((tmp_path / "m" / "_matrix.json").read_text())
    assert {x.name for x in (tmp_path / "m").iterdir() if not x.name.startswith(".")} == {"_matrix.json", *(f"{n['name']}.{e}" for n in names for e in ("bin", "pos"))}
    for bad in ([(50, [1.0])] + made[:5], [(1, None)]):
        with pytest.raises(Exception, match="length|nulls"):
            X.save_vectors(spark.createDataFrame(bad, "pos bigint, v array<float>"), path)
    assert sorted(map(tuple, X.load_vectors(spark, path).collect())) == made[:5]  # a failed write changes nothing
    X.write_vectors(str(tmp_path / "one.bin"), np.arange(6).reshape(2, 3))
    assert [(r.pos, r.v) for r in X.load_vectors(spark, str(tmp_path / "one.bin")).collect()] == [(0, [0, 1, 2]), (1, [3, 4, 5])]
    with pytest.raises(Exception, match="finished"):
        X.load_vectors(spark, f"file://{tmp_path}").collect()


def test_feeds_equal_the_decoders(spark):
    odd = feed(2).decode().replace("<title>T 1</title>", "").encode()
    blank = b'<feed xmlns="http://www.w3.org/2005/Atom"/>'
    bodies = [feed(3), odd, blank]
    want = sorted(tuple(r[f.name] for f in D.PAPER) for b in bodies for r in D.atom(b)[0])
    got = F1.atom_records(spark.createDataFrame([(i, b.decode()) for i, b in enumerate(bodies)], "k int, xml string"))
    assert sorted(tuple(r)[1:] for r in got.collect()) == want and len(want) == 4
    lists = [f'<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords><record><header status="deleted"/></record><record><header/><metadata><arXiv xmlns="http://arxiv.org/OAI/arXiv/"><id>2407.06437</id><created>2025-01-01</created><title>T &amp; U</title><abstract>{LONG}</abstract><categories>cs.LG cs.CL</categories><authors><author><keyname>Doe</keyname><forenames>J.</forenames></author></authors></arXiv></metadata></record><record><header/><metadata><arXiv xmlns="http://arxiv.org/OAI/arXiv/"><id>hep-th/x</id><created>2025-01-01</created><title>T</title><abstract>{LONG}</abstract><categories>cs.LG</categories></arXiv></metadata></record></ListRecords></OAI-PMH>', '<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><error code="noRecordsMatch"/></OAI-PMH>']
    want = sorted(tuple(r[f.name] for f in D.PAPER) for b in lists for r in D.oai(b.encode())[0])
    got = F1.oai_records(spark.createDataFrame([(b,) for b in lists], "xml string"))
    assert sorted(map(tuple, got.collect())) == want and len(want) == 2
    with pytest.raises(Exception, match="badArgument"):
        F1.oai_records(spark.createDataFrame([(lists[1].replace("noRecordsMatch", "badArgument"),)], "xml string")).collect()


def test_vectors(spark, tmp_path):
    X.write_vectors(str(tmp_path / "m.bin"), np.arange(6).reshape(2, 3))
    assert [(r.pos, r.v) for r in X.read_vectors(spark, str(tmp_path / "m.bin")).collect()] == [(0, [0, 1, 2]), (1, [3, 4, 5])]
    (tmp_path / "bad.bin").write_bytes(b"\x01\x00\x00\x00\x09\x00\x00\x00")
    with pytest.raises(Exception, match="header"):
        X.read_vectors(spark, str(tmp_path / "bad.bin")).collect()


def test_cron(spark):
    frame = spark.sql("select timestamp'2026-08-31 06:00:00' t")
    due = lambda schedule, hours=0, minutes=0: frame.select(V.cron_matches(schedule, F.col("t") + F.make_interval(hours=F.lit(hours), mins=F.lit(minutes)))).first()[0]
    assert due("0 6 * * *") and not due("0 6 * * *", hours=1) and not due("0 6 * * *", minutes=1)
    assert [due(s) for s in ("0 6 * * 1", "0 6 * * 0", "0 6 31 * *", "0 6 1 * *", "0 6,18 * * *", "0 6 * *", "")] == [True, False, True, False, True, False, False]


def test_streams(spark, tmp_path):
    spark.sql("select 1L event_id, timestamp'2024-01-01 01:00:00' ts, 1L user_id, 'a' event_type, 2.0D value, '' props union all select 1L, timestamp'2024-01-01 02:00:00', 1L, 'a', 3.0D, ''").write.parquet(str(tmp_path / "in"))
    stream = V.read_events(spark, str(tmp_path / "in"))
    seen = []
    V.upsert_batches(V.distinct_records(stream, "event_id", "ts"), ["event_id"], lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert len(seen) == 1
    q = V.daily_counts(stream).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.event_type, r.n, r.total) for r in spark.table("days").collect()] == [("a", 2, 5.0)]


def test_artefacts(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    assert X.load(spark, path) is None
    X.save(spark.range(3), path)
    X.save(spark.range(5), path)
    assert X.exists(spark, path) and X.load(spark, path).count() == 5
    (tmp_path / "a" / "_SUCCESS").unlink()
    assert X.load(spark, path) is None
    for name, day in (("one", "2024-01-02"), ("two", "2024-03-01")):
        (tmp_path / "p" / name).mkdir(parents=True)
        (tmp_path / "p" / name / "meta.json").write_text(json.dumps({"name": name, "createdAt": f"{day}T00:00:00Z"}))
    assert [r.name for r in X.projects(spark, f"file://{tmp_path}/p/*/meta.json").collect()] == ["two", "one"]


def test_oai_sets_have_equal_shares():
    reader = H.HarvestReader(Q.Harvest(categories=("cs.LG", "stat", "cs.LG", " "), most=7, source="oai"), None)
    assert sorted((p.span.categories, p.span.most) for p in reader.partitions()) == [(("cs.LG",), 4), (("stat",), 4)]
