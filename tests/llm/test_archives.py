import gzip
import io
import random

import pytest

from ionquill.llm import archives as ar


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    contents = [b"", b"HTTP/1.1 200 OK\r\n\r\n<p>\n\nhttp://x 1 2 3 4\n", b"\x00\xff\n" * 50, b"plain"]
    raw = ar.arc_version_block(version, "a.arc", "19990102030405")
    raw += b"".join(ar.arc_record(version, c, url=f"http://a/{k} b", ip_address="1.2.3.4", archive_date="19990102030405", content_type="text/html", result_code="200") for k, c in enumerate(contents))
    got = list(ar.read_arc(io.BytesIO(raw)))
    assert [r.content for r in got] == contents
    assert all(list(r.fields) == ar.ARC_FIELDS[version] for r in got)
    assert got[1].fields["URL"] == "http://a/1%20b" and got[1].fields["Archive-length"] == str(len(contents[1]))


def test_arc_urls_with_spaces_are_read():
    raw = ar.arc_version_block(1, "a.arc", "1999") + b"http://a/b c d 1.2.3.4 19990102 text/html 2\nhi\n"
    (got,) = ar.read_arc(io.BytesIO(raw))
    assert got.fields["URL"] == "http://a/b c d" and ar.iso_date(got.fields["Archive-date"]) == "1999-01-02T00:00:00Z"


@pytest.mark.parametrize("raw", [b"http://a 1.2.3.4 1999 text/html 2\nhi\n", ar.arc_version_block(1, "a", "1999") + b"http://a 0 0 x 9\nhi\n", ar.arc_version_block(2, "a", "1999") + b"http://a 0 0 x 2\nhi\n"])
def test_bad_arc_is_refused(raw):
    with pytest.raises(ValueError, match="ARC|cut off"):
        list(ar.read_arc(io.BytesIO(raw)))


def test_warc_record():
    record = ar.ArcRecord({"URL": "http://a/", "IP-address": "1.2.3.4", "Archive-date": "19990102030405", "Content-type": "text/html"}, b"HTTP/1.1 200 OK\r\nA: b\r\n\r\npay\r\n\r\nload")
    raw = ar.to_warc(record, ar.record_id("k")) + ar.END.encode() + ar.to_warc(record, ar.record_id("l"), ar.record_id("k")) + ar.END.encode()
    (h1, b1), (h2, b2) = ar.read_warc(io.BytesIO(raw))
    assert (h1["warc-type"], h1["warc-date"], b1) == ("response", "1999-01-02T03:04:05Z", record.content)
    assert (h2["warc-type"], h2["warc-refers-to"], b2) == ("revisit", h1["warc-record-id"], b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n")
    assert h1["warc-payload-digest"] == h2["warc-payload-digest"] == "sha1:" + ar.digest(b"pay\r\n\r\nload")
    with pytest.raises(ValueError, match="digest"):
        list(ar.read_warc(io.BytesIO(raw.replace(b"load", b"lost"))))


def plain(rows, least=0):
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        head = max(same, default=None)
        revisit = page_id != head and len(payload) >= least
        out.append((page_id, len(payload), ar.digest(payload), "revisit" if revisit else "response", head if revisit else None))
    return out


@pytest.mark.parametrize("least", [0, 5])
def test_pages(spark, least):
    rnd = random.Random(1)
    rows = [(k, f"http://h/{k % 7}", rnd.choice(["<p>a</p>", "", "x\r\n\r\nWARC/1.1\r\n", "äöü🙂" * 3, f"own {k}"])) for k in range(60)]
    rows += [(100, None, None), (101, "a b\nc", None), (None, "u", "<p>a</p>"), (None, "u", "no id"), (102, "u", "same"), (102, "u", "same"), (103, "u", "y" * 300_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, mark string").repartition(3)
    got = ar.round_trip(pages, least).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(rows, least), key=str)


def test_files_are_warc_files(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"<p>{k % 5}</p>") for k in range(30)], "page_id long, url string, html string").coalesce(1)
    ar.write_archives(pages, str(tmp_path / "out"), version=1, per_file=8)
    files = sorted((tmp_path / "out").glob("part-*"))
    assert len(files) > 1
    records = [(h, b) for f in files for h, b in ar.read_warc(gzip.open(f))]
    kinds = [h["warc-type"] for h, _ in records]
    assert kinds.count("response") == 5 and kinds.count("revisit") == 25 and kinds.count("warcinfo") >= 1
    assert all(b"Page" not in b for _, b in records)
    # a member a record, with an empty one after each
    members = files[0].read_bytes().split(ar.EMPTY_MEMBER)[:-1]
    assert [len(list(ar.read_warc(io.BytesIO(gzip.decompress(m))))) for m in members] == [1] * len(members)


def test_page_numbers_in_record_ids():
    for page in (0, 1, -1, 7, (1 << 63) - 1, -(1 << 63), None):
        assert ar.page_of(ar.page_record_id(page, ar.digest(b"x"))) == page
    assert ar.page_of(ar.record_id("k")) is None and ar.page_of(None) is None and ar.page_of("<urn:x>") is None


def test_other_writers_archives_are_read(spark, tmp_path):
    record = ar.ArcRecord({"URL": "http://a/", "IP-address": "1.2.3.4", "Archive-date": "19990102030405", "Content-type": "text/html"}, b"HTTP/1.1 200 OK\r\nContent-Length: 7\r\n\r\npayload")
    one, two = ar.record_id("k"), ar.record_id("l")
    raw = [ar.to_warc(record, one) + ar.END.encode(), ar.to_warc(record, two, one) + ar.END.encode()]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, raw)))
    (tmp_path / "b.warc").write_bytes(b"".join(raw))
    got = ar.read_records(spark, str(tmp_path)).select("record_id", "refers_to_record", "payload_bytes", "payload_digest").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(one, None, 7, ar.digest(b"payload")), (two, one, 7, ar.digest(b"payload"))] * 2))
    assert ar.read_archives(spark, str(tmp_path)).where("page_id is null").count() == 4


def test_many_revisits_are_joined(spark, monkeypatch):
    rows = [(k, "u", f"<p>{k % 7}</p>") for k in range(60)] + [(None, "u", "<p>1</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(ar, "FEW_REVISITS", 3)
    assert sorted(map(tuple, ar.round_trip(pages).collect()), key=str) == sorted(plain(rows), key=str)


def test_large_page(spark):
    html = "<p>" + "0123456789abcdef" * (1 << 21) + "</p>"
    pages = spark.createDataFrame([(1, "u")], "page_id long, url string").selectExpr("page_id", "url", "concat('<p>', repeat('0123456789abcdef', 1 << 21), '</p>') AS html")
    assert ar.round_trip(pages).collect() == [(1, len(html), ar.digest(html.encode()), "response", None)]


def test_empty_table(spark):
    assert ar.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
