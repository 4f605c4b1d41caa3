"""Legacy archive converter: pages to ARC files, ARC files to WARC files, and WARC files to rows.

ARC: a version block names the version, whose record lines have five fields (1) or ten (2); the
last field declares the content's length in bytes, by which records are cut. Each content is an
HTTP response. WARC 1.1: identifiers are synthesised from the payload digest, the page id, and the ARC
file and the place in it that a record comes from, so no two records share one; dates come from the
14-digit ARC dates, block and payload digests are SHA-256. Of records with equal payloads of at least
DEDUP_BYTES bytes the one with the least page id is a response, others are revisits that refer to it
by identifier, address and date.

Spark's text writer writes the archives, one gzipped file for about SEGMENT_BYTES of records (a
segment is one row), and its binary reader reads them, so any file system that Spark knows will do.
ARC files are parsed twice: first for digests alone, of which equal ones are found by small rows
(file, place, page id, digest) without payloads or those under DEDUP_BYTES; then each file is
converted as a whole, joined by its name to the places of its revisits, so no payload is shuffled
by digest and many equal payloads are no hot key.

Defined cases: a null html is an empty payload; a null URL is written as about:blank, white space
and control characters in URLs are percent-encoded; a null page id never becomes the one referred
to; rows that repeat the least page id are responses like it. Archives that don't follow their
declared lengths raise ValueError. Texts of any length are written whole.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise, shared_dir, table

DEDUP_BYTES = 100
SEGMENT_BYTES = 8 << 20
#: The record line's field names for each version.
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
ARC_ORIGIN = {1: "1 0 tessera", 2: "2 0 tessera"}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD_SCHEMA = "file string, place int, page_id long, payload_bytes long, payload_digest string, url string, date string"
PAGE_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, warc_date string"


def safe_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")


def http_head(page_id: int | None, size: int) -> bytes:
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {size}\r\n\r\n".encode()


def header_value(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*(.*?)\r?$", head)
    return found[1].decode() if found else None


def page_of(http: bytes) -> int | None:
    found = header_value(http, "X-Page-Id")
    return None if found is None else int(found)


def arc_record(version: int, page_id: int | None, url: str | None, payload: bytes, ip: str, date: str) -> bytes:
    content = http_head(page_id, len(payload)) + payload
    middle = f" 200 {hashlib.md5(content).hexdigest()} - 0 -" if version == 2 else ""
    return f"{safe_url(url)} {ip} {date} text/html{middle} {len(content)}\n".encode() + content


def arc_preamble(version: int, name: str, date: str) -> bytes:
    body = f"{ARC_ORIGIN[version]}\n{ARC_FIELDS[version]}\n"
    fields = " 200 - - 0 -" if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{fields} {len(body)}\n{body}".encode()


def read_arc(data: bytes):
    """Yield (version, url, ip, date, content) of an ARC file's records; an empty file, which Spark writes for no rows, has none."""
    if not data:
        return
    end = data.find(b"\n")
    if not data.startswith(b"filedesc://") or end < 0:
        raise ValueError("no ARC version block")
    size = int(data[:end].rsplit(b" ", 1)[1])
    body = data[end + 1 : end + 1 + size].split(b"\n")
    version = int(body[0].split(b" ")[0])
    if version not in ARC_FIELDS:
        raise ValueError(f"ARC version {version}")
    fields, at = len(ARC_FIELDS[version].split(" ")), end + 1 + size
    while True:
        while data[at : at + 1] == b"\n":
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        line = data[at:end].rsplit(b" ", fields - 1)
        if end < 0 or len(line) != fields or not line[-1].isdigit():
            raise ValueError(f"bad ARC record line at {at}")
        stop = end + 1 + int(line[-1])
        if stop > len(data):
            raise ValueError(f"ARC record at {at} is cut short")
        yield version, line[0].decode(), line[1].decode(), line[2].decode(), data[end + 1 : stop]
        at = stop


def record_uri(*origin) -> str:
    """An identifier from what a record is and where it comes from."""
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256('|'.join(map(str, origin)).encode()).hexdigest()[:32])}>"


def warc_date(arc_date: str) -> str:
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, fields: dict, block: bytes) -> bytes:
    lines = {"WARC-Type": kind, **fields, "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Length": len(block)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n" + block


def converted(file: str, place: int, url: str, ip: str, date: str, content: bytes, refers_to: dict | None) -> bytes:
    """The WARC record of one ARC record; refers_to tells page_id, file, place, url and date of the response, for a revisit."""
    head, _, payload = content.partition(b"\r\n\r\n")
    digest = hashlib.sha256(payload).hexdigest()
    fields = {"WARC-Record-ID": record_uri(digest, page_of(head), file, place), "WARC-Date": warc_date(date), "WARC-Target-URI": url, "WARC-IP-Address": ip, "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http; msgtype=response"}
    if refers_to is None:
        return warc_record("response", fields, content)
    r = refers_to
    refers = {"WARC-Profile": REVISIT, "WARC-Refers-To": record_uri(digest, r["page_id"], r["file"], r["place"]), "WARC-Refers-To-Target-URI": r["url"], "WARC-Refers-To-Date": warc_date(r["date"]), "WARC-Refers-To-Page": r["page_id"]}
    return warc_record("revisit", fields | refers, head + b"\r\n\r\n")


def read_warc(data: bytes):
    """Yield (headers, block) of a WARC file's records."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/1.", at) or end < 0:
            raise ValueError(f"no WARC record at {at}")
        head = data[at:end] + b"\r\n"
        stop = end + 4 + int(header_value(head, "Content-Length"))
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"WARC record at {at} doesn't end where it declares")
        yield head, data[end + 4 : stop]
        at = stop + 4


def inflate(content: bytes) -> bytes:
    out = []
    while content:
        tool = zlib.decompressobj(31)
        out.append(tool.decompress(content))
        content = tool.unused_data
    return b"".join(out)


def _segments(rows, first, limit: int, glue: bytes):
    """Join records (bytes) to rows of about limit bytes; first makes each segment's first record."""
    held, size, number = [], 0, 0
    for record in rows:
        if not held:
            held, size, number = [first(number)], 0, number + 1
        held.append(record)
        size += len(record)
        if size >= limit:
            yield glue.join(held)
            held = []
    if held:
        yield glue.join(held)


def _text_batches(segments):
    for s in segments:
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.large_binary()).cast(pa.large_string()).cast(pa.string())], names=["value"])


def write_files(segments: DataFrame, path: str, separator: str) -> None:
    """One gzipped file for each row of segments(value), ended by the separator, at the fastest level."""
    segments.write.option("lineSep", separator).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", 1).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of the archives in a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select(F.col("path").alias("file"), "content")


def write_arc(pages: DataFrame, path: str, ip: str = "0.0.0.0", date: str = "20240101000000", segment: int = SEGMENT_BYTES) -> None:
    """Write pages(page_id, url, html) as ARC files, of version 1 and 2 by turns."""

    def build(batches):
        def segments():
            number, held, size = 0, [], 0
            for batch in batches:
                for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                    version = 1 + number % 2
                    held = held or [arc_preamble(version, f"pages-{TaskContext.get().partitionId():05d}-{number:05d}.arc", date)]
                    held.append(arc_record(version, page_id, url, (html or "").encode(), ip, date))
                    size += len(held[-1])
                    if size >= segment:
                        yield b"\n".join(held)
                        number, held, size = number + 1, [], 0
            if held:
                yield b"\n".join(held)

        yield from _text_batches(segments())

    write_files(pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(build, "value string"), path, "\n")


def arc_heads(spark: SparkSession, path: str) -> DataFrame:
    """Where each record of the ARC files is, with its payload's size and digest."""

    def parse(batches):
        names = [f.split()[0] for f in HEAD_SCHEMA.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for place, (_, url, _, date, body) in enumerate(read_arc(inflate(content.as_py()))):
                    head, _, payload = body.partition(b"\r\n\r\n")
                    rows.append((file, place, page_of(head), len(payload), hashlib.sha256(payload).hexdigest(), url, date))
                columns = zip(*rows) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    return read_files(spark, path).mapInArrow(parse, HEAD_SCHEMA)


def revisits(heads: DataFrame) -> DataFrame:
    """(file, places): of each file the records that are revisits, and what they refer to; at most as many as its records."""
    heads = materialise(heads.where(f"payload_bytes >= {DEDUP_BYTES}").drop("payload_bytes"), "arc-heads")
    origin = F.struct("page_id", "file", "place", "url", "date")
    first = heads.groupBy("payload_digest").agg(F.min(F.when(F.col("page_id").isNotNull(), origin)).alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    other = heads.join(first.drop("n"), "payload_digest").where("not page_id <=> first.page_id")
    return other.groupBy("file").agg(F.collect_list(F.struct("place", "first")).alias("places"))


def convert(spark: SparkSession, arc_path: str, warc_path: str, segment: int = SEGMENT_BYTES) -> None:
    """Convert ARC files to WARC files with revisit records."""
    found = materialise(revisits(arc_heads(spark, arc_path)), "arc-revisits")
    joined = read_files(spark, arc_path).join(found, "file", "left").select("file", "content", "places")

    def build(batches):
        task = TaskContext.get().partitionId()

        def info(number):
            text = b"software: tessera\r\nformat: WARC file version 1.1\r\n"
            return warc_record("warcinfo", {"WARC-Record-ID": record_uri("warcinfo", warc_path, task, number), "WARC-Date": warc_date("20240101"), "Content-Type": "application/warc-fields"}, text)

        def records():
            for batch in batches:
                for file, content, places in zip(*batch.columns):
                    refers = {p["place"]: p["first"] for p in places.as_py() or []}
                    for i, (_, url, ip, date, body) in enumerate(read_arc(inflate(content.as_py()))):
                        yield converted(file.as_py(), i, url, ip, date, body, refers.get(i))

        yield from _text_batches(_segments(records(), info, segment, b"\r\n\r\n"))

    write_files(joined.mapInArrow(build, "value string"), warc_path, "\r\n\r\n")


def warc_pages(spark: SparkSession, path: str) -> DataFrame:
    """The responses and revisits of WARC files; payload digests are computed again and must agree."""

    def parse(batches):
        names = [f.split()[0] for f in PAGE_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for content in batch.column(1):
                rows = []
                for head, block in read_warc(inflate(content.as_py())):
                    kind = header_value(head, "WARC-Type")
                    if kind not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = header_value(head, "WARC-Payload-Digest").removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError("a payload doesn't have its digest")
                    refers = header_value(head, "WARC-Refers-To-Page")
                    size = len(payload) if kind == "response" else int(header_value(http, "Content-Length"))
                    rows.append((page_of(http), size, digest, kind, None if refers is None else int(refers), header_value(head, "WARC-Record-ID"), header_value(head, "WARC-Target-URI"), header_value(head, "WARC-Date")))
                columns = zip(*rows) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    return read_files(spark, path).mapInArrow(parse, PAGE_SCHEMA)


def op2_warc_converter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through ARC and WARC archives and back."""
    base = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_arc(table(spark, sf_dir, "pages"), f"{base}/arc")
    convert(spark, f"{base}/arc", f"{base}/warc")
    return warc_pages(spark, f"{base}/warc").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op2_warc_converter": op2_warc_converter}
ORACLES = {
    "op2_warc_converter": f"""
with p as (select page_id, coalesce(html, '') html from pages),
x as (select page_id, octet_length(encode(html)) payload_bytes, sha256(html) payload_digest from p),
f as (select payload_digest, min(page_id) first_id from x where payload_bytes >= {DEDUP_BYTES} group by 1)
select x.page_id, cast(x.payload_bytes as bigint) payload_bytes, x.payload_digest,
       case when f.first_id <> x.page_id then 'revisit' else 'response' end record_type,
       case when f.first_id <> x.page_id then f.first_id end refers_to
from x left join f on x.payload_digest = f.payload_digest and x.payload_bytes >= {DEDUP_BYTES}"""
}
