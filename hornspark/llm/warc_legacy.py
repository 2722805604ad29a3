"""Operator 2: WARC archives from legacy ARC archives.

ARC files start with a version block (``filedesc://``) whose second line names the version; each
record is a header line, the declared number of bytes, and a line feed. Version 1 lines have five
fields (URL, IP, date, content type, length); version 2 lines have ten (result code, checksum,
location, offset and file name before the length). The converter reads gzipped ARC files from storage, each header line by the version
of its block, takes exactly the declared bytes, splits HTTP headers from the payload, and
synthesises the WARC fields: a record id (a UUID from URL, date, digest and place), WARC-Date from the
14-digit date, the type, block and payload digests (sha256, hexadecimal).

Of records with equal payloads of at least MIN_REVISIT bytes, that with the smallest page_id is a
response and others are revisits without payload, which refer to it; smaller payloads are responses.

A first pass over the ARC files lists their records without payloads (file, place, page, url, size, digest). Digests with
several records have a winner; each file gets the list of its revisits, and the second pass converts
file by file. So no payload is ever shuffled or joined; a payload that a third of all records share is one
digest, counted with partial sums.

Archives are written by Spark's text writer, so they may live on any file system it knows: an archive
is one value of at most ARCHIVE_BYTES (or one larger record), and the bytes that close a record are the line separator.
They are gzip files; the readers hold one archive compressed and one record at a time.

``legacy_archives`` makes the ARC files of pages, of both versions, with the page's id in an HTTP header.

Cases: null html is an empty payload, null urls are ``urn:unknown``, page ids travel in an extension
field and may be null (a null id is never the smallest while another is there). Rows that repeat an id
and its payload are all responses; other repeated rows are separate records.
Payloads may hold anything, headers and blank lines included. An empty table has empty archives. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornspark.llm.common import Scratch, int64, small_batches

MIN_REVISIT = 100
#: Bytes of records in an archive, before compression; it bounds what one task holds.
ARCHIVE_BYTES = 16 << 20
#: The HTTP header in which legacy records carry the id of their page.
PAGE_HEADER = b"X-Page-ID: "
CRAWL_DATE = "20200101000000"
END = "\r\n\r\n"

#: The field lists of the two ARC versions.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}


def arc_block(version: int) -> bytes:
    """The version block that opens an ARC file."""
    body = f"{version} 0 hornspark\n{' '.join(FIELDS[version])}\n".encode()
    head = ["filedesc://legacy.arc", "0.0.0.0", CRAWL_DATE, "text/plain"] + (["200", "-", "-", "0", "legacy.arc"] if version == 2 else [])
    return f"{' '.join(head)} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, payload: bytes, page: int | None = None) -> bytes:
    """A record of a page as a crawler of that version wrote it."""
    known = b"" if page is None else PAGE_HEADER + str(page).encode() + b"\r\n"
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n".encode() + known + b"\r\n" + payload
    more = ["200", "-", "-", "0", "legacy.arc"] if version == 2 else []
    return " ".join([url.replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D") or "urn:unknown", "0.0.0.0", CRAWL_DATE, "text/html", *more, str(len(body))]).encode() + b"\n" + body + b"\n"


class Stream:
    """Bytes that come in chunks, of which only what is looked at is held."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, bytearray()

    def fill(self, n: int) -> bool:
        while len(self.held) < n:
            more = next(self.chunks, None)
            if more is None:
                return False
            self.held.extend(more)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the mark, which goes; None where no bytes are left."""
        at, seen = self.held.find(mark), 0
        while at < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self.fill(len(self.held) + 1):
                if self.held.strip():
                    raise ValueError("an archive ends inside a record")
                return None
            at = self.held.find(mark, seen)
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        if not self.fill(n):
            raise ValueError("an archive ends before a record's declared length")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def read_arc(chunks: Iterator[bytes]) -> Iterator[dict]:
    """The records of ARC files set one after another: header fields by name, and the declared bytes as ``body``."""
    stream, names = Stream(chunks), FIELDS[1]
    while (line := stream.until(b"\n")) is not None:
        parts = line.decode().split(" ")
        body = stream.take(int(parts[-1]))
        stream.take(1)
        if parts[0].startswith("filedesc://"):
            names = FIELDS[int(body.split(b" ", 1)[0])]
        elif len(parts) != len(names):
            raise ValueError(f"an ARC header line has {len(parts)} fields instead of {len(names)}")
        else:
            yield dict(zip(names, parts, strict=True)) | {"body": body}


def to_warc(record: dict, place: str, revisit_of: tuple[str, int] | None = None, page_id: int | None = None) -> bytes:
    """The WARC record of an ARC record, without the blank lines that close it. revisit_of: the response's record id and page."""
    head, _, payload = record["body"].partition(b"\r\n\r\n")
    head += b"\r\n\r\n"
    block = head if revisit_of else head + payload
    digest = hashlib.sha256(payload).hexdigest()
    d = record["Archive-date"]
    fields = [
        ("WARC-Type", "revisit" if revisit_of else "response"),
        ("WARC-Record-ID", record_id(record["URL"], d, digest, place)),
        ("WARC-Date", f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"),
        ("WARC-Target-URI", record["URL"]),
        ("WARC-IP-Address", record["IP-address"]),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if revisit_of:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", revisit_of[0]),
            ("X-Refers-To-Page-ID", str(revisit_of[1])),
            ("WARC-Truncated", "length"),
        ]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return lines.encode() + block


def record_id(url: str, date: str, digest: str, place: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {place}')}>"


def read_warc(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of the records in a stream, which holds one record at a time."""
    stream = Stream(chunks)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("no WARC record where one must start")
        fields = dict(x.split(": ", 1) for x in lines)
        block = stream.take(int(fields["Content-Length"]))
        stream.take(4)
        yield fields, block


def page_of(body: bytes) -> int | None:
    """The page id in a record's HTTP headers."""
    head = body.partition(b"\r\n\r\n")[0]
    return next((int(x[len(PAGE_HEADER) :]) for x in head.split(b"\r\n") if x.startswith(PAGE_HEADER)), None)


def _arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as ARC files of bounded size, their last line feed left to the writer; the versions take turns."""
    version, held, size = 1, [], 0

    def file() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join([arc_block(version), *held])[:-1]], pa.binary())], ["value"])

    for batch in batches:
        for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            record = arc_record(version, url or "", (html or "").encode("utf-8", "surrogatepass"), page)
            if held and size + len(record) > ARCHIVE_BYTES:
                yield file()
                version, held, size = 3 - version, [], 0
                record = arc_record(version, url or "", (html or "").encode("utf-8", "surrogatepass"), page)
            held.append(record)
            size += len(record)
    if held:
        yield file()


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, place, page_id, url, bytes, digest) of the records of ARC files."""
    names = ["path", "place", "page_id", "url", "bytes", "digest"]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = []
            for k, record in enumerate(read_arc(_inflated(content.as_buffer()))):
                payload = record["body"].partition(b"\r\n\r\n")[2]
                rows.append((path, k, page_of(record["body"]), record["URL"], len(payload), hashlib.sha256(payload).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("path", "url", "digest") else pa.int64()) for n, c in zip(names, cols, strict=True)], names)


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ARC files (path, content, revisits) as WARC files, the bytes that close the last record left to the writer."""
    for batch in batches:
        for content, again in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            source = {r["place"]: r for r in again or ()}
            out, size = [], 0
            for k, record in enumerate(read_arc(_inflated(content.as_buffer()))):
                page, r, of = page_of(record["body"]), source.get(k), None
                if r is not None:
                    of = (record_id(r["winner_url"], CRAWL_DATE, r["digest"], f"page {r['winner']}"), r["winner"])
                warc = to_warc(record, f"page {page}", of, page)
                if out and size + len(warc) > ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([END.encode().join(out)], pa.binary())], ["value"])
                    out, size = [], 0
                out.append(warc)
                size += len(warc)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([END.encode().join(out)], pa.binary())], ["value"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url"]
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for fields, block in read_warc(_inflated(content.as_buffer())):
                head, _, payload = block.partition(b"\r\n\r\n")
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response":
                    size = len(payload)
                    if hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not match its digest")
                else:
                    size = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                page, ref = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
                rows.append((None if page is None else int(page), size, digest, kind, None if ref is None else int(ref), fields["WARC-Record-ID"], fields["WARC-Target-URI"]))
                if len(rows) == 1000:
                    yield _batch(rows, names)
                    rows = []
            yield _batch(rows, names)


def _inflated(data) -> Iterator[bytes]:
    stream = zlib.decompressobj(31)
    view = memoryview(data)
    for k in range(0, len(view), 1 << 18):
        part = bytes(view[k : k + (1 << 18)])
        while part:
            yield stream.decompress(part)
            part = stream.unused_data
            if stream.eof:
                stream = zlib.decompressobj(31)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 7
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def write_archives(files: DataFrame, path: str, end: str) -> None:
    """One gzip file under ``path`` for each value; ``end`` closes each value."""
    text = files.select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", end).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the archives under ``path``."""
    small_batches(spark, 4)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


def legacy_archives(spark: SparkSession, pages: DataFrame, path: str) -> None:
    """ARC files of ``pages`` (page_id, url, html) under ``path``."""
    small_batches(spark, 200)
    write_archives(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_arcs, "value binary"), path, "\n")


def convert(spark: SparkSession, arcs: str, warcs: str, scratch: Scratch) -> None:
    """WARC files under ``warcs`` for the ARC files under ``arcs``."""
    index = scratch.keep(binary_files(spark, arcs).mapInArrow(_index, "path string, place long, page_id long, url string, bytes long, digest string"))
    large = index.filter(F.col("bytes") >= MIN_REVISIT)
    same = large.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")).alias("w"), F.count(F.lit(1)).alias("n"))
    winners = scratch.keep(same.filter("n > 1 and w.page_id is not null").select("digest", F.col("w.page_id").alias("winner"), F.col("w.url").alias("winner_url")))
    again = large.join(winners, "digest").filter(~F.col("page_id").eqNullSafe(F.col("winner")))
    lists = again.groupBy(F.col("path").alias("file")).agg(F.collect_list(F.struct("place", "digest", "winner", "winner_url")).alias("revisits"))  # bounded by an archive's records
    files = binary_files(spark, arcs)
    met = files.join(scratch.keep(lists), F.col("path") == F.col("file"), "left").select("path", "content", "revisits")
    write_archives(met.mapInArrow(_convert, "value binary"), warcs, END)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url of all records under ``path``."""
    files = binary_files(spark, path).select("content")
    return files.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string")


def legacy_to_warc(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """All pages written as ARC archives to the shared folder, converted to WARC archives there, and these read back."""
    scratch = Scratch(spark, "warc")
    arcs, warcs = scratch.path(), scratch.path()
    legacy_archives(spark, pages, arcs)
    convert(spark, arcs, warcs, scratch)
    return scratch.finish(read_archives(spark, warcs))


SQL = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages),
w AS (SELECT d, min(page_id) AS winner FROM p WHERE octet_length(b) >= 100 GROUP BY d)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN winner <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN winner <> page_id THEN winner END AS refers_to
FROM p LEFT JOIN w ON p.d = w.d AND octet_length(b) >= 100
"""
