import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from tunegauge.llm import warc

PAGES = [
    (1, "http://a/\r\nX: y", "a\r\n\r\nWARC/1.1\r\n\r\n"), (2, "http://a/", "a\r\n\r\nWARC/1.1\r\n\r\n"), (3, None, "same"), (9, "z", "same"),
    (9, "z", "same"), (4, "é", "é" * 300_000), (5, "e", ""), (None, None, None), (6, "f", "x"),
]


@pytest.fixture(scope="module")
def pages(spark):
    from tunegauge.llm.tables import share_code

    share_code(spark)
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def test_round_trip(pages):
    got = sorted(warc.round_trip(pages).collect(), key=lambda r: (r.page_id or 0, r.record_type))
    assert len(got) == len(PAGES)
    payloads = {i: (h or "").encode() for i, _, h in PAGES}
    for r in got:
        data = payloads[r.page_id]
        assert r.payload_length == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r.record_type == "response") == (r.refers_to is None)
        if r.record_type == "response":
            assert bytes(r.payload) == data
        else:
            assert r.payload is None
    assert {(r.page_id, r.refers_to) for r in got if r.refers_to} == {(1, 2), (3, 9), (None, 5)}
    assert sum(r.page_id == 9 and r.record_type == "response" for r in got) == 2


def test_small_payloads_can_be_left_alone(pages):
    got = warc.round_trip(pages, least=5).filter("record_type = 'revisit'").collect()
    assert [(r.page_id, r.refers_to) for r in got] == [(1, 2)]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_filters_reach_the_reader(spark, pages, tmp_path, compression):
    warc.register(spark)
    path = str(tmp_path / compression)
    rows = pages.select(F.concat(F.lit("urn:"), F.col("page_id").cast("string")).alias("record_id"), F.col("url").alias("target_uri"), F.col("html").cast("binary").alias("payload"))
    rows.coalesce(1).write.format("warc").mode("append").option("compression", compression).option("split_bytes", "1").save(path)
    (tmp_path / compression / "part-lost.warc").write_bytes(b"left by a lost task")
    source = spark.read.format("warc").option("partition_bytes", "1").schema(warc.SCHEMA).load(path)
    assert source.rdd.getNumPartitions() == len(PAGES)
    assert source.count() == len(PAGES)
    some = source.filter("record_id in ('urn:4', 'urn:6') and content_length > 100000")
    assert "Filter (" not in some._jdf.queryExecution().executedPlan().toString()
    assert [(r.record_id, len(r.payload)) for r in some.collect()] == [("urn:4", 600_000)]
    assert source.filter("record_type <> 'response'").count() == 0
    assert source.filter("target_uri is null").count() == 2


def test_payload_is_skipped_unless_asked(spark, pages, tmp_path):
    class Counting:
        def __init__(self, inner):
            self.inner, self.bytes = inner, 0

        def read(self, n):
            data = self.inner.read(n)
            self.bytes += len(data)
            return data

        def seek(self, n):
            return self.inner.seek(n)

    record = warc.record(b"x" * 50_000_000, "urn:1", None, None, "1970-01-01T00:00:00Z")
    (tmp_path / "big.warc").write_bytes(record + warc.record(b"y", "urn:2", None, None, "1970-01-01T00:00:00Z"))
    reader = warc.WarcReader({"path": str(tmp_path)}, warc.StructType.fromDDL("record_id string, payload_length long"))
    scans, plain = [], warc._Scan.__init__

    def counting(self, *a):
        plain(self, *a)
        self.raw = Counting(self.raw)
        scans.append(self)

    warc._Scan.__init__ = counting
    try:
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    finally:
        warc._Scan.__init__ = plain
    assert rows == [{"record_id": "urn:1", "payload_length": 50_000_000}, {"record_id": "urn:2", "payload_length": 1}]
    assert scans[0].raw.bytes < 2_000_000


def test_empty_table(pages):
    assert warc.round_trip(pages.limit(0)).count() == 0
