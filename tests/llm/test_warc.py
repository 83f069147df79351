import hashlib

import pytest
from helpers import duck, plain

from scriptorium.llm import warc
from scriptorium.llm._common import scratch


def archive(spark, rows):
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, address string")
    path = scratch(spark, "test")
    warc.write_archive(pages, path)
    return path


BIG, WIDE = "x" * 1000, "é" * 600
ROWS = [(1, "u1", BIG, "z"), (2, "u\r\nX: y", BIG, None), (3, None, BIG, "z"), (4, "u", "x" * 999, "z"), (5, "u", "x" * 999, "z"), (6, "u", None, "z"), (7, "u", "", "z"), (8, "u", WIDE, "z"), (8, "u", WIDE, "z"), (None, "u", BIG, "z")]


def test_round_trip(spark):
    path = archive(spark, ROWS)
    got = sorted((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archive(spark, path).collect())
    assert got == [(-1, 1000, "revisit", 3), (1, 1000, "revisit", 3), (2, 1000, "revisit", 3), (3, 1000, "response", None), (4, 999, "response", None), (5, 999, "response", None), (6, 0, "response", None), (7, 0, "response", None), (8, 1200, "response", None), (8, 1200, "response", None)]
    assert spark.read.parquet(f"{path}/payloads").count() == 4  # each payload once
    records = [bytes(r.record) for r in warc.records(spark, path).collect()]
    assert len(records) == len(ROWS)
    for record in records:
        head, _, rest = record.partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        body = rest[: int(fields[b"Content-Length"])]
        assert rest[len(body) :] == b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n")
        assert fields[b"WARC-Payload-Digest"] == b"sha1:" + hashlib.sha1(body).hexdigest().encode()


def test_damage_is_found(spark):
    path = archive(spark, ROWS)
    damaged = [(r.address, b"y" + bytes(r.body)[1:]) for r in spark.read.parquet(f"{path}/payloads").collect()]
    spark.createDataFrame(damaged, "address string, body binary").write.mode("append").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, path).collect()


def test_empty(spark):
    path = archive(spark, [])
    assert warc.read_archive(spark, path).count() == 0


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert plain(warc.op1_warc(spark, folder).toPandas()) == plain(duck(folder).sql(warc.SQL).df())
