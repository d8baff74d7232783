"""WARC: round trips, push-down, and archives that others write."""

import gzip
import io
import random
import time

import pytest
from pyspark.sql import functions as F

from basalt.llm import warc
from basalt.llm._text import shared_dir


def page_rows():
    big = "é<p>" * 50_000
    return [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, None), (4, "http://d/\nX: y", ""), (5, "http://e/", big), (6, "http://f/", "\r\n\r\nWARC/1.1\r\n"), (None, "http://g/", "<p>x</p>"), (7, "http://h/", "unique")]


def brute(rows):
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        top = max((j for j, _, h in rows if (h or "") == (html or "") and j is not None), default=None)
        out.append((i, len(payload), warc.payload_digest(payload), "response" if i == top else "revisit", None if i == top else top))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, 1) for r in page_rows()], "page_id bigint, url string, html string, payload int")
    got = warc.archive_round_trip(pages.repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == brute(page_rows())


def test_repeated_rows_and_empty_tables(spark):
    kind = "page_id bigint, url string, html string"
    twice = warc.archive_round_trip(spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (2, "u", "b")], kind)).collect()
    assert [r.record_type for r in twice] == ["response"] * 3
    assert warc.archive_round_trip(spark.createDataFrame([], kind)).count() == 0


def test_source_reads_payloads_and_pushes_filters_down(spark):
    folder = shared_dir(spark, "warc-test")
    pages = spark.createDataFrame(page_rows(), "page_id bigint, url string, html string")
    manifest = warc.write(warc.with_revisits(pages), folder).collect()
    assert sum(r.records for r in manifest) == len(page_rows())
    everything = warc.read(spark, folder)
    assert everything.filter("record_type = 'warcinfo'").count() == len(manifest)
    one = everything.filter(F.col("record_type").isin("response", "revisit") & (F.col("target_uri") == "http://h/"))
    row = one.first()
    assert bytes(row.payload) == b"unique" and row.headers["X-Page-Id"] == "7"
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "Filter isnotnull" not in plan, plan
    assert everything.filter("record_type = 'revisit' AND payload IS NOT NULL").count() == 0


def test_unwanted_payloads_are_not_inflated(monkeypatch):
    data = warc.gzip_member(warc.page_record(1, "u", b"a" * 3_000_000, None)) + warc.gzip_member(warc.page_record(2, "v", b"b", None))
    steps = []
    plain = warc._Member.more
    monkeypatch.setattr(warc._Member, "more", lambda self, step=4096: (steps.append(self.at), plain(self, step))[1])
    got = list(warc.records(io.BufferedReader(io.BytesIO(data)), lambda h: h["X-Page-Id"] == "2"))
    assert [h["X-Page-Id"] for h, _ in got] == ["2"]
    assert steps.count(0) == 1


@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress], ids=["plain", "gzip"])
def test_archives_without_lengths(pack):
    data = b"".join(pack(warc.record("resource", {"WARC-Record-ID": f"<urn:{i}>", "Content-Type": "text/plain"}, b"z" * (i * 9000))) for i in range(5))
    got = [(h["WARC-Record-ID"], len(b)) for h, b in warc.records(io.BufferedReader(io.BytesIO(data)))]
    assert got == [(f"<urn:{i}>", i * 9000) for i in range(5)]
    odd = [h["WARC-Record-ID"] for h, _ in warc.records(io.BufferedReader(io.BytesIO(data)), lambda h: h["WARC-Record-ID"] == "<urn:3>")]
    assert odd == ["<urn:3>"]


def test_broken_archives():
    with pytest.raises(ValueError):
        list(warc.records(io.BufferedReader(io.BytesIO(b"no archive at all"))))
    cut = warc.record("resource", {"WARC-Record-ID": "<urn:1>"}, b"z" * 100)[:-50]
    with pytest.raises(ValueError):
        list(warc.records(io.BufferedReader(io.BytesIO(cut))))


def test_long_payloads_take_linear_time():
    def seconds(size):
        data = warc.gzip_member(warc.page_record(1, "u", bytes(size), None), level=1)
        began = time.perf_counter()
        ((_, block),) = warc.records(io.BufferedReader(io.BytesIO(data)))
        assert len(block) > size
        return time.perf_counter() - began

    seconds(1 << 20)
    assert seconds(64 << 20) < 16 * max(seconds(16 << 20), 0.02)


def test_headers_alone_inflate_no_payload(spark, monkeypatch):
    noise = random.Random(1).randbytes(3_000_000)
    data = b"".join(warc.gzip_member(warc.page_record(i, "u", noise, None)) for i in range(3))
    steps = []
    plain = warc._Member.more
    monkeypatch.setattr(warc._Member, "more", lambda self, step=4096: (steps.append(step), plain(self, step))[1])
    got = [warc.http_payload(h, b) for h, b in warc.records(io.BufferedReader(io.BytesIO(data)), payload=False)]
    assert got == [(b"", 3_000_000)] * 3 and sum(steps) < 100_000
    folder = shared_dir(spark, "warc-heads")
    pages = spark.createDataFrame(page_rows(), "page_id bigint, url string, html string")
    warc.write(warc.with_revisits(pages), folder)
    shown = ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    whole, heads = (warc.read(spark, folder, payload=p).filter("record_type != 'warcinfo'") for p in (True, False))
    assert sorted(map(str, heads.select(shown).collect())) == sorted(map(str, whole.select(shown).collect()))
    assert heads.filter("payload IS NOT NULL").count() == 0


def test_files_of_lost_tasks_are_not_read(spark):
    folder = shared_dir(spark, "warc-lost")
    pages = spark.createDataFrame(page_rows(), "page_id bigint, url string, html string")
    warc.write(warc.with_revisits(pages), folder)
    before = warc.read(spark, folder).count()
    fs, root = warc.file_system(folder)
    with fs.open_output_stream(f"{root}/lost.warc.gz", compression=None) as out:
        out.write(warc.gzip_member(warc.page_record(99, "u", b"x", None)))
    assert warc.read(spark, folder).count() == before


def test_groups_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    pages = spark.createDataFrame(page_rows(), "page_id bigint, url string, html string")
    assert sorted(map(tuple, warc.archive_round_trip(pages).collect()), key=str) == brute(page_rows())
