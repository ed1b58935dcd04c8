import pytest

from veilspark.llm import archive
from veilspark.llm.common import new_path


@pytest.mark.parametrize("version", [1, 2])
def test_arc_by_declared_length(version):
    records = [{"url": "http://a b/", "ip": "1.2.3.4", "date": "20010203040506", "mime": "text/html", "filename": "f", "payload": p} for p in (b"", b"x\n\nhttp://x 0 0 t 5\nhello", b"\xff\x00")]
    back = list(archive.parse_arc(archive.arc_file(records, version)))
    assert [r["payload"] for r in back] == [r["payload"] for r in records]
    assert back[0]["url"] == "http://a%20b/"
    with pytest.raises(ValueError):
        list(archive.parse_arc(archive.arc_file(records, version)[:-4]))


def test_warc_round_trip():
    record = {"url": "u", "ip": "0.0.0.0", "date": "20010203040506", "mime": "text/html", "filename": "f", "payload": b"WARC/1.1\r\n\r\nx"}
    data = archive.to_warc(record) + archive.to_warc(record, "g")
    (h1, b1), (h2, b2) = archive.parse_warc(data)
    assert b1.endswith(b"\r\n\r\n" + record["payload"]) and b1.startswith(b2) and b2.endswith(b"Content-Length: 13\r\n\r\n") and h2["WARC-Type"] == "revisit" and h1["WARC-Date"] == "2001-02-03T04:05:06Z"
    assert h1["WARC-Record-ID"] == h2["WARC-Record-ID"] != h2["WARC-Refers-To"]


def test_pages(spark):
    long = "é" * 60 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    rows = [(3, "u3", long), (1, "u1", long), (7, None, long), (None, "n", long), (4, "s", "short"), (5, "s", "short"), (6, "e", None), (8, "e", ""), (1, "u1", long), (9, "big", "z" * 3_000_000)]
    path = new_path(spark, "t")
    archive.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest_x"), path)
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in archive.read_archives(spark, path).collect()}
    n = len(long.encode())
    assert got == {(3, "revisit", 1, n), (1, "response", None, n), (7, "revisit", 1, n), (None, "revisit", 1, n), (4, "response", None, 5), (5, "response", None, 5), (6, "response", None, 0), (8, "response", None, 0), (9, "response", None, 3_000_000)}
    assert archive.read_archives(spark, path).count() == len(rows)


def test_empty(spark):
    path = new_path(spark, "t")
    archive.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert archive.read_archives(spark, path).count() == 0


def test_revisits_from_100_bytes_on_and_small_files(spark, monkeypatch):
    monkeypatch.setattr(archive, "CHUNK", 500)
    monkeypatch.setattr(archive, "FILE_CHUNKS", 2)
    rows = [(i, "u", "é" * 49 + "x" * n) for n in (1, 2) for i in range(40 * n, 40 * n + 40)]
    path = new_path(spark, "t")
    archive.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    got = archive.read_archives(spark, path).collect()
    assert len(got) == 80 and spark.read.format("binaryFile").load(path).count() > 5
    assert {r.page_id for r in got if r.record_type == "revisit"} == set(range(81, 120)) and {r.refers_to for r in got} == {None, 80}
    assert {r.payload_bytes for r in got} == {99, 100}
