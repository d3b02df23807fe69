"""Legacy web archives (ARC) converted to WARC, written and read by Spark.

An ARC file begins with a version block that names the fields of its header lines: version
1 has five, version 2 ten. Each record is a header line and as many bytes as it declares.
The converter parses these, and makes for each record a WARC record with an identifier, a
timestamp, a type and digests; of equal payloads one is a response and the others revisit it.

Files are written with Spark's text sink: a row is a record and the line separator is the
line end that closes it, so that lost tasks, commits and remote folders are Spark's matter.
A task starts a new file after a fixed number of records, each with its own first record.
Pages are written by classes of size, so that this number bounds a file's bytes too; equal
payloads are of one class.
"""

from __future__ import annotations

import functools
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, hinted, new_folder, schema_of, table

ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Records a file, its first record included, for pages of up to so many bytes: a file has 64 MB of payloads at most, or one page.
FILE_RECORDS = {64 << 10: 1000, 1 << 20: 65, 1 << 62: 2}
#: Payloads below this many bytes are never revisited.
LEAST_REVISITED = 100
#: Bytes of records handed to Spark at once.
BATCH_BYTES = 4 << 20
#: Of gzip, by the name that Hadoop has for it: pages are 4 % larger than at the default of six, for less than a third of the time.
GZIP_LEVEL = "FOUR"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURED = "20240101000000"


def _safe_uri(url: str | None) -> str:
    """A url for a header line: white space and controls are percent-encoded, nothing becomes an urn."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "urn:x-unknown"


def http_response(page_id: int | None, payload: bytes) -> bytes:
    own = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 trivalent\n{ARC_FIELDS[version]}\n".encode()
    middle = "text/plain" if version == 1 else f"text/plain 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {CAPTURED} {middle} {len(body)}\n".encode() + body


def arc_record(version: int, url: str, content: bytes, name: str) -> bytes:
    middle = "text/html" if version == 1 else f"text/html 200 - - 0 {name}"
    return f"{url} 0.0.0.0 {CAPTURED} {middle} {len(content)}\n".encode() + content


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and content of each record after the version block; the fields' names are the block's own."""
    at, fields = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end == at:  # the line feed between records
            at += 1
            continue
        if end < 0:
            raise ValueError("ARC file ends within a header line")
        line = data[at:end].decode("utf-8", "replace").split(" ")
        content = data[end + 1 : end + 1 + int(line[-1])]
        if len(content) < int(line[-1]):
            raise ValueError(f"ARC record of {len(content)} bytes declares {line[-1]}")
        at = end + 1 + len(content)
        if line[0].startswith("filedesc://"):
            fields = content.decode("utf-8", "replace").split("\n")[1].split(" ")
            continue
        if fields is None or len(line) != len(fields):
            raise ValueError(f"ARC header line has {len(line)} fields, its version {len(fields or ())}")
        yield dict(zip(fields, line)), content


def _unzipped(content: bytes) -> bytes:
    """A gzip file of one or more members, or a plain file."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        d = zlib.decompressobj(31)
        out.append(d.decompress(content) + d.flush())
        content = d.unused_data
    return b"".join(out)


def _headers(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """First line, fields by lower-case name, and what follows the empty line."""
    head, _, rest = block.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, rest


def _http(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """The response's head with its empty line, its fields, and the payload."""
    if not block.startswith(b"HTTP/"):
        return b"", {}, block
    _, fields, payload = _headers(block)
    return block[: len(block) - len(payload)], fields, payload


def _record_id(*parts) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}"


def _warc_date(arc_date: str) -> str:
    """14 digits, or fewer of older tools, as ISO 8601."""
    return datetime.strptime((arc_date + "19700101000000"[len(arc_date) :])[:14], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    """A record without the last line end, which the text sink adds."""
    fields = fields | {"WARC-Block-Digest": f"sha1:{hashlib.sha1(block).hexdigest()}", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n"


def _in_batches(values: Iterator[tuple], arrow: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for v in values:
        held.append(v)
        n += size(v)
        if n >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), arrow)], schema=arrow)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), arrow)], schema=arrow)


_VALUE = pa.schema([("value", pa.binary())])


def _with_first(records: Iterator[bytes], first, file_records: int) -> Iterator[tuple[bytes]]:
    for n, r in enumerate(records):
        if n % (file_records - 1) == 0:
            yield (first(n),)
        yield (r,)


def _write(records: DataFrame, folder: str, separator: str, file_records: int) -> None:
    """Binary values as text: they are UTF-8 wherever the payloads are, and Spark writes their bytes as they are."""
    records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", separator).option("compression", "gzip").option("zlib.compress.level", GZIP_LEVEL).option("maxRecordsPerFile", file_records).text(folder)


def write_arc(pages: DataFrame, folder: str, version: int = 2, page_id: str = "page_id", url: str = "url", html: str = "html", file_records: int = 1000) -> None:
    """pages as ARC files of the given version; null html is an empty payload, a null url a placeholder."""

    def run(batches):
        def records():
            for b in batches:
                for i, u, h in zip(*(c.to_pylist() for c in b.columns)):
                    yield arc_record(version, _safe_uri(u), http_response(i, h), "pages")

        yield from _in_batches(_with_first(records(), lambda n: arc_version_block(version, f"pages-{n}"), file_records), _VALUE, lambda v: len(v[0]))

    rows = pages.select(F.col(page_id).cast("long"), url, F.coalesce(F.col(html).cast("binary"), F.lit(b"")))
    _write(rows.mapInArrow(run, "value binary"), folder, "\n", file_records)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")


def _arc_entries(path: str, content: bytes) -> Iterator[tuple]:
    """n, record id, uri, date, page id, digest, payload bytes, http head, payload of each record of a file."""
    for n, (f, block) in enumerate(parse_arc(_unzipped(content))):
        head, http, payload = _http(block)
        page = http.get("x-page-id")
        digest = hashlib.sha256(payload).hexdigest()
        uri, date = f["URL"], _warc_date(f["Archive-date"])
        yield n, _record_id(uri, date, page, digest, n, path.rpartition("/")[2]), uri, date, int(page) if page else None, digest, len(payload), head, payload


def arc_index(files: DataFrame) -> DataFrame:
    """path, n, record_id, uri, date, page_id, digest, bytes of every record, without payloads."""
    ddl = "path string, n long, record_id string, uri string, date string, page_id long, digest string, bytes long"
    arrow = pa.schema([("path", pa.string()), ("n", pa.int64()), ("record_id", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("digest", pa.string()), ("bytes", pa.int64())])

    def run(batches):
        rows = ((p, *e[:7]) for b in batches for p, c in zip(*(x.to_pylist() for x in b.columns)) for e in _arc_entries(p, c))
        yield from _in_batches(rows, arrow, lambda r: 300)

    return files.mapInArrow(run, schema_of(ddl))


def revisits(index: DataFrame, least: int = LEAST_REVISITED) -> DataFrame:
    """path, marks: the records of each file that revisit another, with that one's identifier, uri and date.

    Of equal payloads of at least `least` bytes, the one with the smallest page_id is revisited (null ids last, then by place)."""
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "path", "n", "record_id", "uri", "date")
    large = index.where(F.col("bytes") >= least)
    first = large.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")
    first = hinted(checkpointed(first), 400)  # where these are many, the engine splits the rows of a very common payload
    others = large.join(first, "digest").where((F.col("path") != F.col("first.path")) | (F.col("n") != F.col("first.n")))
    mark = F.struct("n", F.col("first.record_id").alias("record_id"), F.col("first.uri").alias("uri"), F.col("first.date").alias("date"))
    return others.groupBy("path").agg(F.collect_list(mark).alias("marks"))  # a file has few records


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, least: int = LEAST_REVISITED, file_records: int = 1000) -> None:
    """ARC files of either version as WARC files. A damaged header line or length fails the job."""
    files = _files(spark, arc_folder)
    marks = checkpointed(revisits(checkpointed(arc_index(files)), least))

    def run(batches):
        def records():
            for b in batches:
                for path, content, marked in zip(*(c.to_pylist() for c in b.columns)):
                    seen = {m["n"]: m for m in marked or ()}
                    for n, record_id, uri, date, _, digest, _, head, payload in _arc_entries(path, content):
                        own = {"WARC-Type": "response", "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http;msgtype=response" if head else "application/octet-stream"}
                        if m := seen.get(n):
                            own |= {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": f"<{m['record_id']}>", "WARC-Refers-To-Target-URI": m["uri"], "WARC-Refers-To-Date": m["date"]}
                        elif not head:
                            own["WARC-Type"] = "resource"
                        yield warc_record(own, head if m else head + payload)

        def info(n):
            own = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<{_record_id('info', warc_folder, n)}>", "WARC-Date": _warc_date(CAPTURED), "Content-Type": "application/warc-fields"}
            return warc_record(own, b"software: trivalent\r\nformat: WARC File Format 1.1\r\n")

        yield from _in_batches(_with_first(records(), info, file_records), _VALUE, lambda v: len(v[0]))

    joined = files.join(marks, "path", "left").select("path", "content", "marks")
    _write(joined.mapInArrow(run, "value binary"), warc_folder, "\r\n", file_records)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, fields, _ = _headers(data[at:end] + b"\r\n\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        n = int(fields["content-length"])
        block = data[end + 4 : end + 4 + n]
        if data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError("WARC record does not end where it says")
        yield fields, block
        at = end + 8 + n


def read_warc(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """record_id, record_type, uri, date, page_id, payload_bytes, payload_digest, refers_to_id and, if asked for, payload of all
    records but warcinfo. Size and digest of a response are its payload's; a revisit has those that it declares."""
    ddl = "record_id string, record_type string, uri string, date string, page_id long, payload_bytes long, payload_digest string, refers_to_id string" + ", payload binary" * payloads
    kinds = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.string()] * 2 + [pa.binary()] * payloads
    arrow = pa.schema([(x.split(" ")[0], k) for x, k in zip(ddl.split(", "), kinds)])

    def run(batches):
        def rows():
            for b in batches:
                for _, content in zip(*(c.to_pylist() for c in b.columns)):
                    for f, block in parse_warc(_unzipped(content)):
                        kind = f["warc-type"]
                        if kind == "warcinfo":
                            continue
                        _, http, payload = _http(block)
                        page = http.get("x-page-id")
                        if kind == "revisit":
                            n, digest, payload = int(http.get("content-length", 0)), f["warc-payload-digest"].rpartition(":")[2], None
                        else:
                            n, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        yield (f["warc-record-id"].strip("<>"), kind, f["warc-target-uri"], f["warc-date"], int(page) if page else None, n, digest, f["warc-refers-to"].strip("<>") if kind == "revisit" else None) + ((payload,) if payloads else ())

        yield from _in_batches(rows(), arrow, lambda r: 300 + (len(r[-1] or b"") if payloads else 0))

    return _files(spark, folder).mapInArrow(run, schema_of(ddl))


def round_trip(pages: DataFrame, version: int = 2) -> DataFrame:
    """pages through ARC and WARC files in the shared folder, and back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null and empty html is an empty payload; each repeated row is a record; an empty table gives no record."""
    spark = pages.sparkSession
    size, last = F.octet_length(F.coalesce("html", F.lit(""))), F.lit(len(FILE_RECORDS) - 1)
    for n, bound in reversed([*enumerate(FILE_RECORDS)]):
        last = F.when(size <= bound, n).otherwise(last)
    found = []
    for n in sorted(r.n for r in pages.select(last.alias("n")).distinct().collect()):  # at most as many as classes
        arc, warc, records = new_folder(spark, "arc"), new_folder(spark, "warc"), [*FILE_RECORDS.values()][n]
        write_arc(pages.where(last == n), arc, version, file_records=records)
        convert(spark, arc, warc, file_records=records)
        found.append(checkpointed(read_warc(spark, warc)))
    if not found:
        return spark.createDataFrame([], schema_of("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"))
    records = functools.reduce(DataFrame.union, found)
    again = records.where("record_type = 'revisit'")
    wanted = again.select(F.col("refers_to_id").alias("record_id")).distinct()
    named = records.where("record_type <> 'revisit'").join(wanted, "record_id", "left_semi").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    again = again.join(hinted(checkpointed(named), 80), "refers_to_id", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    return records.where("record_type <> 'revisit'").select(*columns, F.lit(None).cast("long").alias("refers_to")).union(again.select(*columns, "refers_to"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record, by way of a version 2 ARC archive."""
    return round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"))


OP4_SQL = """
SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id > min(page_id) OVER (PARTITION BY coalesce(html, '')) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id > min(page_id) OVER (PARTITION BY coalesce(html, '')) THEN min(page_id) OVER (PARTITION BY coalesce(html, '')) END AS refers_to
FROM pages
"""
