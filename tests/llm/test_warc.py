import hashlib
import io
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import warc
from loomgraph.llm.shared import scratch

BIG = "x" * 150


def archived(spark, rows, schema="page_id long, url string, html string", **options):
    path = scratch(spark, "warc-test")
    warc.write_archives(warc.archive_rows(spark.createDataFrame(rows, schema), "page_id", "url", "html"), path, **options)
    return path


def test_round_trip_against_brute_force(spark):
    rows = [(5, "http://a/", BIG), (3, "http://b/", BIG), (9, "http://c/", BIG), (1, "http://d/", "short"), (2, None, "short"), (4, "http://e/", None), (6, "http://f/\r\nX: y", "ä" * 60), (7, "", "")]
    got = {r["page_id"]: r for r in warc.archived_pages(spark, archived(spark, rows)).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        body = (html or "").encode()
        r = got[page]
        again = html == BIG and page != 3
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if again else ("response", None))


def test_null_and_repeated_ids(spark):
    got = warc.archived_pages(spark, archived(spark, [(None, "u", BIG), (2, "u", BIG), (2, "u", BIG), (None, "v", "z" * 200)])).collect()
    assert sorted((r["page_id"] or -1, r["record_type"], r["refers_to"] or -1) for r in got) == [(-1, "response", -1), (-1, "revisit", 2), (2, "response", -1), (2, "response", -1)]


def test_empty_table_and_clashing_columns(spark):
    assert warc.archived_pages(spark, archived(spark, [])).count() == 0
    rows = [(1, "u", BIG, "a", "b"), (2, "u", BIG, "a", "b")]
    got = warc.archived_pages(spark, archived(spark, rows, "page_id long, url string, html string, payload string, first_id string"))
    assert sorted(r["record_type"] for r in got.collect()) == ["response", "revisit"]


def test_long_payload_and_headers(spark):
    html, url = "wörter " * 300_000, "http://h/" + "p" * 20_000
    path = archived(spark, [(1, url, html)])
    r = warc.read_warc(spark, path).where("record_type = 'response'").first()
    assert (r["target_uri"], bytes(r["payload"])) == (url, html.encode())


def test_pushdown_skips_payloads(spark):
    rows = [(i, f"http://h{i}/", f"{i} {BIG}") for i in range(20)]
    path = archived(spark, rows, roll_bytes="1500")
    name = next(r["record_id"] for r in warc.read_warc(spark, path).collect() if r["target_uri"] == "http://h7/")
    plan_rows = warc.read_warc(spark, path).where(f"record_id = '{name}' AND record_type = 'response'").collect()
    assert [r["target_uri"] for r in plan_rows] == ["http://h7/"]
    assert warc.read_warc(spark, path).where("target_uri LIKE 'http://h1%'").count() == 11
    assert {r["payload"] for r in warc.read_warc(spark, path, payloads="false").collect()} == {None}
    assert warc.read_warc_through_spark(spark, path).where("record_type = 'response'").count() == 20


def stream_of(rows, gz, length=True):
    out = b""
    for r in rows:
        data = warc.record(r)
        member = warc.gzip_member(data, 6)
        if gz and not length:
            import gzip

            member = gzip.compress(data)
        out += member if gz else data
    return io.BytesIO(out)


@pytest.mark.parametrize(("gz", "length"), [(True, True), (True, False), (False, False)])
@pytest.mark.parametrize("chunk", [40, 1 << 16])
def test_parser(gz, length, chunk):
    rows = [{"record_type": "response", "record_id": f"urn:row:{i}", "date": None, "target_uri": f"http://h/{'q' * (i * 700)}", "refers_to": None, "payload_digest": None, "payload_length": 3 * i, "payload": b"abc" * i} for i in range(12)]
    got = list(warc.records(stream_of(rows, gz, length), lambda r: True, chunk=chunk))
    assert [(r["record_id"], r["payload"]) for r in got] == [(r["record_id"], r["payload"]) for r in rows]
    odd = list(warc.records(stream_of(rows, gz, length), lambda r: int(r["record_id"][8:]) % 2 == 1, chunk=chunk))
    assert [r["payload"] for r in odd] == [r["payload"] for r in rows[1::2]]


def sample(n=5, size=60_000):
    body = lambda i: random.Random(i).randbytes(size)
    return [{"record_type": "response", "record_id": f"urn:row:{i}", "date": None, "target_uri": None, "refers_to": None, "payload_digest": None, "payload_length": size, "payload": body(i)} for i in range(n)]


@pytest.mark.parametrize("chunk", [100, 1 << 16])
def test_archive_compressed_as_a_whole(chunk):
    import gzip

    rows = sample()
    data = gzip.compress(stream_of(rows, False).getvalue())
    for wanted in (lambda r: True, lambda r: r["record_id"] == "urn:row:3"):
        got = list(warc.records(io.BytesIO(data), wanted, chunk=chunk))
        assert [r["payload"] for r in got] == [r["payload"] for r in rows if wanted(r)]


@pytest.mark.parametrize(("gz", "length"), [(True, True), (True, False), (False, False)])
@pytest.mark.parametrize("keep", [True, False])
@pytest.mark.parametrize("cut", [20, 3_000, 30_000])
def test_cut_archives_are_errors(gz, length, keep, cut):
    """However it is compressed, and whether or not the last record is wanted."""
    data = stream_of(sample(2), gz, length).getvalue()
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(data[:-cut]), lambda r: keep))


def test_other_bytes_are_errors():
    good = stream_of(sample(1), True).getvalue()
    for data in (good + b"junk junk junk junk junk junk", b"no archive at all\r\n\r\n", good[:-1] + bytes([good[-1] ^ 1])):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.records(io.BytesIO(data), lambda r: True))
    assert len(list(warc.records(io.BytesIO(good + bytes(512)), lambda r: True))) == 1  # padding


def test_record_ids_are_unique_and_referred_to(spark):
    rows = [(1, "u", BIG)] * 3 + [(2, "u", BIG), (2, "u", BIG), (None, "u", "short"), (None, "u", "short")]
    got = warc.read_warc(spark, archived(spark, rows)).where("record_type <> 'warcinfo'").collect()
    ids = {r["record_id"] for r in got}
    assert len(ids) == len(rows) and {r["refers_to"] for r in got if r["record_type"] == "revisit"} < ids


def test_nothing_is_left_of_failed_jobs(spark):
    path = scratch(spark, "warc-failed")
    rows = spark.createDataFrame([(i, "u", f"{i} {BIG}") for i in range(40)], "page_id long, url string, html string")
    bad = warc.archive_rows(rows, "page_id", "url", "html").withColumn("record_type", F.when(F.col("target_uri") == "u", F.raise_error(F.lit("broken")).cast("string")))
    with pytest.raises(Exception, match="broken"):
        warc.write_archives(bad, path)
    warc.write_archives(warc.archive_rows(rows, "page_id", "url", "html"), path)
    names = os.listdir(path.removeprefix("file://"))
    # a task that Spark kills may leave its folder, but none of the archives are of the failed job
    assert all(n.endswith(".warc.gz") or not os.listdir(os.path.join(path.removeprefix("file://"), n)) for n in names)
    assert warc.archived_pages(spark, path).count() == 40


def test_staged_files_are_no_archives(spark, tmp_path):
    (tmp_path / "_staging-x").mkdir()
    (tmp_path / "_staging-x" / "part-1.warc.gz").write_bytes(b"half")
    (tmp_path / "a.warc").write_bytes(stream_of(sample(2, 10), False).getvalue())
    assert warc.read_warc(spark, str(tmp_path)).count() == 2


def test_cut_archive_is_an_error():
    data = stream_of([{"record_type": "response", "record_id": "a", "date": None, "target_uri": None, "refers_to": None, "payload_digest": None, "payload_length": 5, "payload": b"hello" * 99}], True).getvalue()
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(data[:-20]), lambda r: True))
