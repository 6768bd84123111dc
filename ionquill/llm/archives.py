"""Web archives: a reader of legacy ARC records, their conversion to WARC, and a WARC reader.

An ARC file begins with a version block whose second line names the fields of
every record's header line; version 1 has five, version 2 has ten. A record is
its header line and as many bytes as that declares. The converter keeps the
captured bytes and makes up what WARC asks for and ARC lacks: record ids, ISO
timestamps, record types and digests.

Every record is a gzip member of its own. Archives are written by Spark's text
writer, one member a line, with an empty gzip member as the line separator, so
that each part file is a gzipped WARC file, committed like any other Spark output
in whatever store the shared folder is; and they are read again by the same
separator, record by record, so no file is ever held whole.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionquill.llm.storage import new_path, stored

END = "\r\n\r\n"
#: Names of the fields of an ARC record's header line, by version, as the version block lists them.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: A gzip member that holds nothing; it can't lie within another member's data, as the lengths of every record confirm.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
LINES = {"lineSep": EMPTY_MEMBER.decode("latin-1"), "encoding": "ISO-8859-1"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Revisits up to this many are sent to every task instead of joined.
FEW_REVISITS = 100_000


#: Nine bits that mark a UUID as one of ``page_record_id``, at the top of twelve.
PAGE_MARK = 0x5A8


class ArcRecord(NamedTuple):
    fields: dict[str, str]
    content: bytes


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 ionquill\n{' '.join(ARC_FIELDS[version])}\n".encode()
    head = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Archive-length": str(len(body))}
    return " ".join(head.get(f, "-") for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, content: bytes, **fields: str) -> bytes:
    """Bytes of one record; ``fields`` by lower-case name with underscores, "-" where one is missing."""
    given = {k.replace("_", "-").lower(): v for k, v in fields.items()} | {"archive-length": str(len(content))}
    values = [re.sub(r"\s", lambda m: quote(m[0]), given.get(f.lower()) or "-") for f in ARC_FIELDS[version]]
    return " ".join(values).encode() + b"\n" + content + b"\n"


def read_arc(stream: BinaryIO) -> Iterator[ArcRecord]:
    """Records of an ARC file after its version block, by that block's fields and each record's declared length."""
    names: list[str] | None = None
    while line := stream.readline():
        if line in (b"\n", b"\r\n"):
            continue
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        own = names
        if own is None:
            if not text.startswith("filedesc://"):
                raise ValueError("an ARC file begins with a version block")
            own = next((f for f in ARC_FIELDS.values() if len(f) == len(text.split(" "))), None)
            if own is None:
                raise ValueError(f"no ARC version has a header line like {text!r}")
        # addresses may hold spaces, so the other fields are counted from the end
        parts = text.rsplit(" ", len(own) - 1)
        if len(parts) != len(own) or not parts[-1].isdigit():
            raise ValueError(f"not an ARC header line: {text!r}")
        fields = dict(zip(own, parts, strict=True))
        content = stream.read(int(fields["Archive-length"]))
        if len(content) != int(fields["Archive-length"]):
            raise ValueError(f"the record of {fields['URL']} is cut off")
        if names is None:
            lines = content.decode("utf-8", "replace").splitlines()
            names = lines[1].split(" ") if len(lines) > 1 else own
            if names not in ARC_FIELDS.values():
                raise ValueError(f"unknown ARC fields {names}")
        else:
            yield ArcRecord(fields, content)


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def page_record_id(page_id: int | None, payload_digest: str) -> str:
    """A record's id that names its page: a UUID of version 8 with 48 bits of the payload's digest, a mark, and the page's number."""
    own = int.from_bytes(base64.b32decode(payload_digest)[:6], "big")
    number = 0 if page_id is None else page_id & ((1 << 64) - 1)
    mark = PAGE_MARK | (page_id is not None) << 2 | number >> 62
    return f"<urn:uuid:{uuid.UUID(int=own << 80 | 8 << 76 | mark << 64 | 2 << 62 | number & ((1 << 62) - 1))}>"


def page_of(record: str | None) -> int | None:
    """The number of the page that a record's id names; None for a page without number and for records of other writers."""
    found = re.fullmatch(r"<urn:uuid:([0-9a-f-]{36})>", record or "")
    bits = uuid.UUID(found[1]).int if found else 0
    mark = bits >> 64 & 0xFFF
    if bits >> 76 & 15 != 8 or mark >> 3 != PAGE_MARK >> 3 or not mark >> 2 & 1:
        return None
    number = (mark & 3) << 62 | bits & ((1 << 62) - 1)
    return number - (1 << 64) if number >> 63 else number


def iso_date(arc_date: str) -> str:
    """14 digits, or fewer, as a WARC timestamp."""
    d = arc_date.ljust(14, "0") if arc_date.isdigit() else "00010101000000"
    return f"{d[:4]}-{d[4:6] if d[4:6] > '00' else '01'}-{d[6:8] if d[6:8] > '00' else '01'}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END.encode() + block


def warc_info(name: str, date: str) -> bytes:
    block = b"software: ionquill\r\nformat: WARC File Format 1.1\r\n"
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(f"warcinfo:{name}")), ("WARC-Date", iso_date(date)), ("Content-Type", "application/warc-fields")], block)


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """Headers, with the empty line that ends them, and payload of an HTTP response."""
    head, gap, payload = content.partition(b"\r\n\r\n")
    return (head + gap, payload) if content.startswith(b"HTTP/") and gap else (b"", content)


def to_warc(record: ArcRecord, own_id: str, refers_to: str | None = None) -> bytes:
    """A WARC record, without its end, for one ARC record.

    ``own_id`` is the record's id; ``refers_to`` is that of the response with the
    same payload, which makes this one a revisit without payload.
    """
    head, payload = split_http(record.content)
    kind = "revisit" if refers_to is not None else "response" if head else "resource"
    headers = [
        ("WARC-Type", kind), ("WARC-Record-ID", own_id), ("WARC-Date", iso_date(record.fields["Archive-date"])),
        ("WARC-Target-URI", record.fields["URL"]), ("WARC-Payload-Digest", "sha1:" + digest(payload)),
        ("Content-Type", "application/http; msgtype=response" if head else record.fields["Content-type"]),
    ]
    if record.fields["IP-address"] not in ("-", "0.0.0.0"):
        headers.append(("WARC-IP-Address", record.fields["IP-address"]))
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers_to)]
    block = head if refers_to is not None else record.content
    return _record([*headers, ("WARC-Block-Digest", "sha1:" + digest(block))], block)


def read_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every record; declared lengths and block digests are held to."""
    while line := stream.readline():
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]) or stream.read(4) != END.encode():
            raise ValueError("a WARC record is cut off")
        if "warc-block-digest" in headers and headers["warc-block-digest"] != "sha1:" + digest(block):
            raise ValueError(f"a WARC record doesn't match its digest: {headers['warc-record-id']}")
        yield headers, block


def _captured(payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def _marked(rows: DataFrame, least_bytes: int) -> DataFrame:
    """``rows`` with ``refers_to``, the page that each revisit repeats.

    Which pages repeat others is settled on digests and ids alone, with partial
    aggregates, so that a payload which very many pages share is no hot key. The
    pages themselves are joined with the revisits by id and digest: where these
    are few, they are sent to every task and no page is moved.
    """
    mark = F.sha1(F.col("html").cast("binary"))
    narrow = rows.select("page_id", mark.alias("mark"), (F.octet_length("html") >= least_bytes).alias("large")).where("large")
    heads = narrow.groupBy("mark").agg(F.max("page_id").alias("head"))
    pairs = narrow.groupBy("mark", "page_id").agg(F.count(F.lit(1)).alias("n")).drop("n")
    revisits = stored(pairs.join(heads, "mark").where(~F.col("page_id").eqNullSafe(F.col("head"))), "revisits")
    found = revisits.select(F.col("page_id").alias("__page"), F.col("mark").alias("__mark"), F.col("head").alias("refers_to"))
    found = F.broadcast(found) if revisits.count() <= FEW_REVISITS else found
    return rows.withColumn("mark", mark).join(found, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("mark") == F.col("__mark")), "left").select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "20000101000000", version: int = 2, per_file: int = 65536, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes every page to gzipped WARC files under ``path``, by way of ARC records.

    Of pages whose payloads are equal and have ``least_bytes`` or more, the one
    with the largest id is a response and the others are revisits of it; with
    none but null ids, all are responses. Null html is an empty payload, a null
    url is written as "-". Repeated rows are written as often, under one record
    id. A page is held in memory by itself, whatever its length. An empty table
    gives no records of pages; other columns are not looked at.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def member(page_id: int | None, url: str | None, html: str, refers_to: int | None) -> bytes:
        payload = html.encode()
        arc = arc_record(version, _captured(payload), url=url, ip_address="0.0.0.0", archive_date=date, content_type="text/html", result_code="200")
        (record,) = read_arc(io.BytesIO(arc_version_block(version, "pages.arc", date) + arc))
        known = digest(payload)
        made = to_warc(record, page_record_id(page_id, known), None if refers_to is None else page_record_id(refers_to, known))
        return gzip.compress(made + END.encode(), 6, mtime=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, size = True, [], 0
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                if first:
                    held, first = [gzip.compress(warc_info("pages.warc", date) + END.encode(), mtime=0)], False
                held.append(member(*(x.as_py() for x in row)))
                size += len(held[-1])
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["member"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["member"])

    members = _marked(rows, least_bytes).mapInArrow(run, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.options(**LINES).option("maxRecordsPerFile", per_file).text(path)


#: Columns of a WARC record that ``read_records`` gives.
RECORD_COLUMNS = "record_id string, record_type string, target_uri string, date string, refers_to_record string, payload_bytes long, payload_digest string"


def _described(headers: dict[str, str], block: bytes) -> tuple:
    head, payload = split_http(block)
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    kind, known = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "revisit":
        size = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
    else:
        size, own = len(payload), digest(payload)
        if known is not None and own != known:
            raise ValueError(f"a payload doesn't match its digest: {headers['warc-record-id']}")
        known = own
    return headers["warc-record-id"], kind, headers.get("warc-target-uri"), headers.get("warc-date"), headers.get("warc-refers-to"), size, known


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record under ``path``, of any writer: ``RECORD_COLUMNS``, one row a record.

    Files that ``write_archives`` wrote are read record by record; files named
    ``.gz`` or ``.warc`` one file at a time. A payload's digest and length are
    worked out from it; a revisit has them in its headers, its length as that of
    its HTTP headers.
    """
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string()]
    names = [c.split()[0] for c in RECORD_COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cell in batch.column(0):
                raw = cell.as_py()
                with gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw) as stream:
                    rows += [_described(h, b) for h, b in read_warc(stream)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    own = spark.read.options(**LINES).option("pathGlobFilter", "part-*.txt").text(path).where(F.length("value") > 0).select(F.col("value").cast("binary").alias("content"))
    other = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(path).select("content")
    return own.mapInArrow(run, RECORD_COLUMNS).unionByName(other.mapInArrow(run, RECORD_COLUMNS))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """What the archives under ``path`` hold of each page: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.

    A record's id names its page, and ``WARC-Refers-To`` the record, and so the
    page, that a revisit repeats; both are null where another writer made the
    ids. Repeated records come back as often; other kinds of records are passed over.
    """
    numbered = lambda name: F.udf(page_of, "long", useArrow=True)(F.col(name))
    pages = read_records(spark, path).where(F.col("record_type").isin("response", "revisit"))
    return pages.select(numbered("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", numbered("refers_to_record").alias("refers_to"))


def round_trip(pages: DataFrame, least_bytes: int = 0, **columns: str) -> DataFrame:
    """Writes all pages to WARC files in the shared folder and reads them back.

    Null html is an empty payload; a null url is written as "-" and a null id
    comes back null, referring to, and never being, the response where another
    page has the same payload. Rows that repeat the largest id of equal payloads
    are each a response. An empty table gives no rows; pages of any length are
    kept whole; other columns are not looked at.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, least_bytes, **columns)
    return read_archives(spark, path)
