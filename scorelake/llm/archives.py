"""Legacy web archives: write ARC, convert ARC to WARC, read WARC back.

An ARC file opens with a version block that names the fields of its header
lines (five in version 1, ten in version 2); records follow, each one header
line, as many bytes as its last field declares, and a line end.  The converter
trusts only those lengths.  For every record it makes up what WARC wants:
a record id from file and offset, the date in ISO form, the type, block and
payload digests.  Records of equal payloads become revisits of one response.

Archives are rows of bounded size that Spark's text writer puts into gzip files
of their own in the shared folder, so any file system Spark knows will do; they
are read back as binary files.  Only ids and digests are compared; payloads move
once, from the old archives to the new.

Defined cases: a null or empty html is an empty payload; a page without an id
has no id header and ranks below all ids; a null url is written as ``-`` and
read back as null; of records alike in payload and id the one with the largest
record id is the response; payloads under ``min_revisit_bytes`` are always
responses; a length that overruns its file is an error; an empty table gives
an empty result; columns other than id, url and html are not archived.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import sys
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.common import col, staging_path

# Executors need no copy of this package: what Python workers run is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ARC_END, WARC_END = b"\n", b"\r\n\r\n"
ARCHIVE_BYTES = 8 << 20  # an archive is closed after the record that passes this
# Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
CRAWL_START = datetime(2020, 1, 1)


def _archives(records: Iterator[bytes], opening, end: bytes) -> Iterator[pa.RecordBatch]:
    """Rows of whole archives, each with an opening record, without the ``end`` that the text writer adds."""

    def row(parts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(parts).removesuffix(end).decode()])], names=["value"])

    parts: list[bytes] = []
    size = number = 0
    for record in records:
        if not parts:
            parts, size = [opening(number)], 0
            number += 1
        parts.append(record)
        size += len(record)
        if size >= ARCHIVE_BYTES:
            yield row(parts)
            parts = []
    if parts:
        yield row(parts)


def _save(archives: DataFrame, end: bytes) -> str:
    path = staging_path(archives.sparkSession)
    # The faster level costs a few hundredths of size and saves half of the compression.
    options = {"maxRecordsPerFile": 1, "compression": "gzip", "lineSep": end.decode(), "zlib.compress.level": "THREE"}
    archives.write.options(**options).text(path)
    return path


def _load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


# ---- ARC


def _arc_line(version: int, url: str, date: str, mime: str, status: str, length: int, offset: int, file: str) -> bytes:
    between = [] if version == 1 else [status, "-", "-", str(offset), file]
    return (" ".join([url, "0.0.0.0", date, mime, *between, str(length)]) + "\n").encode()


def _arc_records(batches: Iterator[pa.RecordBatch], version: int) -> Iterator[bytes]:
    for batch in batches:
        for number, url, html in zip(*(batch.column(i) for i in range(3)), strict=True):
            number, payload = number.as_py(), (html.as_py() or "").encode()
            date = (CRAWL_START + timedelta(seconds=(number or 0) % 86_400)).strftime("%Y%m%d%H%M%S")
            ident = "" if number is None else f"X-Page-Id: {number}\r\n"
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{ident}Content-Length: {len(payload)}\r\n\r\n"
            url = "-" if url.as_py() is None else quote(url.as_py(), safe="!#$&'()*+,/:;=?@[]~%") or "%"
            block = head.encode() + payload
            yield _arc_line(version, url, date, "text/html", "200", len(block), 0, "-") + block + b"\n"


def _write_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    version = 1 + part % 2

    def opening(number: int) -> bytes:
        name = f"pages-{part:06d}-{number:05d}.arc"
        body = f"{version} 0 Scorelake\n{ARC_FIELDS[version]}\n".encode()
        date = CRAWL_START.strftime("%Y%m%d%H%M%S")
        return _arc_line(version, f"filedesc://{name}", date, "text/plain", "200", len(body), 0, name) + body + b"\n"

    return _archives(_arc_records(batches, version), opening, ARC_END)


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """Fields by the names the version block declares, content and offset of every record after it."""
    names: list[str] | None = None
    at = 0
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at : len(data) if end < 0 else end].decode()
        if not line.strip() and at + 1 >= len(data):
            return  # nothing but the last line end
        values = line.split(" ")
        if end < 0 or not values[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {at}")
        content = data[end + 1 : end + 1 + int(values[-1])]
        if len(content) != int(values[-1]):
            raise ValueError(f"the ARC record at byte {at} is cut off")
        if names is None:
            version, fields = content.decode().split("\n")[:2]
            if fields != ARC_FIELDS.get(int(version.split(" ")[0])):
                raise ValueError(f"unknown ARC version {version!r}")
            names = fields.split(" ")
        else:
            if len(values) != len(names):
                raise ValueError(f"the ARC header at byte {at} has {len(values)} fields, not {len(names)}")
            yield dict(zip(names, values, strict=True)), content, at
        at = end + 1 + len(content) + 1


def http_message(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Head, header fields in lower case, and payload of an HTTP response."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    return head + gap, {k.lower(): v for k, v in fields.items()}, payload


_ARC_ROWS = "record_id string, page_id long, payload_digest string, payload_bytes long"


def _read_arc(with_block: bool):
    names = ["record_id", "page_id", "payload_digest", "payload_bytes"]

    def rows(file: str, data: bytes) -> Iterator[tuple]:
        for fields, block, offset in parse_arc(data):
            _, http, payload = http_message(block)
            ident = http.get("x-page-id")
            row = (
                str(uuid.uuid5(uuid.NAMESPACE_URL, f"{file}#{offset}")),
                None if ident is None else int(ident), hashlib.sha1(payload).hexdigest(), len(payload),
            )
            yield (*row, fields["URL"], fields["IP-address"], fields["Archive-date"], block.decode()) if with_block else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                found = list(rows(path.as_py().rsplit("/", 1)[-1], gzip.decompress(content.as_py())))
                if found:
                    columns = names + (["url", "ip", "date", "block"] if with_block else [])
                    types = [pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.string()] * 4
                    arrays = [pa.array(v, t) for v, t in zip(zip(*found, strict=True), types, strict=False)]
                    yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return run


# ---- WARC


def _warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"WARC/1.0\r\nWARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _digest(hexed: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode()


def _warc_records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        for i in range(batch.num_rows):
            ident, digest, url, ip, date, text, target = (batch.column(k)[i].as_py() for k in range(7))
            block = text.encode()
            kind = "response" if target is None else "revisit"
            if target is not None:
                block = http_message(block)[0]
            yield _warc_record(
                kind,
                [
                    ("WARC-Record-ID", f"<urn:uuid:{ident}>"),
                    ("WARC-Target-URI", url),
                    ("WARC-Date", datetime.strptime(date, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")),
                    ("WARC-IP-Address", ip),
                    ("Content-Type", "application/http; msgtype=response"),
                    ("WARC-Block-Digest", _digest(hashlib.sha1(block).hexdigest())),
                    ("WARC-Payload-Digest", _digest(digest)),
                    *([("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:uuid:{target}>")] if target else []),
                ],
                block,
            )


def _write_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()

    def opening(number: int) -> bytes:
        name = f"pages-{part:06d}-{number:05d}.warc"
        headers = [
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"),
            ("WARC-Date", CRAWL_START.strftime("%Y-%m-%dT%H:%M:%SZ")),
            ("WARC-Filename", name),
            ("Content-Type", "application/warc-fields"),
        ]
        return _warc_record("warcinfo", headers, b"software: Scorelake\r\nformat: WARC File Format 1.0\r\n")

    return _archives(_warc_records(batches), opening, WARC_END)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields and block of every record."""
    at = 0
    while data[at : at + 1] in (b"W",):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError(f"no end of the WARC header at byte {at}")
        fields = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        block = data[end + 4 : end + 4 + int(fields["Content-Length"])]
        if len(block) != int(fields["Content-Length"]):
            raise ValueError(f"the WARC record at byte {at} is cut off")
        yield fields, block
        at = end + 4 + len(block) + 4


_WARC_ROWS = "record_id string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, target string"


def _read_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(data: bytes) -> Iterator[tuple]:
        for fields, block in parse_warc(data):
            if fields["WARC-Type"] == "warcinfo":
                continue
            _, http, payload = http_message(block)
            declared = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
            if _digest(hashlib.sha1(block).hexdigest()) != fields["WARC-Block-Digest"] or (
                fields["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != declared
            ):
                raise ValueError(f"a digest of {fields['WARC-Record-ID']} does not match")
            ident, url, target = http.get("x-page-id"), fields["WARC-Target-URI"], fields.get("WARC-Refers-To")
            yield (
                fields["WARC-Record-ID"][10:-1], None if ident is None else int(ident), None if url == "-" else unquote(url),
                fields["WARC-Type"], int(http["content-length"]), declared, target and target[10:-1],
            )

    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    names = [part.split()[0] for part in _WARC_ROWS.split(", ")]
    for batch in batches:
        for content in batch.column(1):
            if found := list(rows(gzip.decompress(content.as_py()))):
                arrays = [pa.array(v, t) for v, t in zip(zip(*found, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)


# ---- the operators


def write_arc(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Write the pages as ARC files, version 1 or 2 by task; returns their folder."""
    rows = pages.select(
        col(id_col).cast("long").alias("page_id"), col(url_col).cast("string").alias("url"), col(html_col).cast("string").alias("html")
    )
    return _save(rows.mapInArrow(_write_arc, "value string"), ARC_END)


def convert_arc(spark: SparkSession, arc_folder: str, *, min_revisit_bytes: int = 1000) -> str:
    """Convert every ARC file of a folder to WARC; returns the folder of the WARC files."""
    files = _load(spark, arc_folder)
    brief = files.mapInArrow(_read_arc(with_block=False), _ARC_ROWS)
    same = ["payload_digest", "payload_bytes"]
    first = (
        brief.filter(F.col("payload_bytes") >= min_revisit_bytes)
        .groupBy(*same)
        .agg(F.max(F.struct("page_id", "record_id")).alias("best"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
    )
    revisits = brief.join(first.select(*same, F.col("best.record_id").alias("target")), same).filter("record_id <> target")
    full = files.mapInArrow(_read_arc(with_block=True), _ARC_ROWS + ", url string, ip string, date string, block string")
    decided = full.join(revisits.select("record_id", "target"), "record_id", "left")
    columns = ["record_id", "payload_digest", "url", "ip", "date", "block", "target"]
    return _save(decided.select(*columns).mapInArrow(_write_warc, "value string"), WARC_END)


def read_warc(spark: SparkSession, warc_folder: str) -> DataFrame:
    """One row per page record: ids, type, payload size and digest, and the page a revisit refers to."""
    read = _load(spark, warc_folder).mapInArrow(_read_warc, _WARC_ROWS)
    responses = read.filter("record_type = 'response'").select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"))
    referred = read.select("target").filter("target IS NOT NULL").distinct()
    return read.join(responses.join(referred, "target"), "target", "left").drop("target")
