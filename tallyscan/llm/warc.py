"""Web archives with a two-level capture index.

Pages are written as WARC 1.1 records, one gzip member each. Captures are sorted by a URL key with
reversed host; sorted lines are cut into gzip blocks (first level), and a sparse directory beside
each index part keeps the first key, place and length of every block (second level). A lookup finds
the part, then binary-searches the directory, reads one range of the part, searches the block, and reads one range of the archive.

Archives and index parts are files below the shared folder, opened through pyarrow's file systems.
A task attempt writes files of its own name, and only what Spark has committed names them, so a lost
executor or a second attempt leaves nothing that is read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyscan.llm.common import scratch_path, stored, table

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
ARCHIVE_BYTES = 1 << 30
READ_BYTES = 16 << 20
BLOCK_LINES = 1000
GZIP_LEVEL = 4
CAPTURE = "key binary, page bigint, file string, offset bigint, length bigint"


def url_key(url: str | None) -> str:
    """``http://a.Example.org:80/x?y#z`` -> ``org,example,a)/x?y``; empty for null."""
    if url is None:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url.strip()
    if not host:
        return url.strip()
    default = {"http": 80, "https": 443}.get(parts.scheme)
    where = ",".join(reversed(host.split("."))) + (f":{port}" if port and port != default else "")
    return f"{where}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record: HTTP headers and payload, or for a revisit the headers alone."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page} {url} {digest} {revisit}")
    lines = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if page is not None:
        lines.append(f"Page-Id: {page}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"Refers-To-Page-Id: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def parse_record(data: bytes) -> dict:
    """Headers (lower-case names), ``payload`` and ``http_length`` of one record; a damaged one is an error."""
    head, _, rest = data.partition(END)
    first, *lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    length = int(headers["content-length"])
    if first != VERSION or rest[length:] != END:
        raise ValueError("not a whole record")
    http, _, payload = rest[:length].partition(END)
    http_length = int(re.search(rb"(?im)^content-length: (\d+)", http)[1])
    return {**headers, "payload": payload, "http_length": http_length}


@lru_cache(maxsize=64)
def _open(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _read_range(uri: str, offset: int, length: int) -> bytes:
    file = _open(uri)
    file.seek(offset)
    return file.read(length)


def _create(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def mark_revisits(pages: DataFrame, id_col: str, html_col: str, url_col: str, min_bytes: int) -> DataFrame:
    """(page, url, payload, refers_to): the response a page revisits, or null if it is one itself.

    Only digests that several rows have are joined, not payloads with each other.
    """
    payload = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    digest = F.unhex(F.sha1("payload"))
    equal = stored(
        rows.where(F.length("payload") >= min_bytes).groupBy(digest.alias("same"))
        .agg(F.max("page").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1 and response is not null").drop("n"),
        "warc-equal",
    )
    joined = rows.join(equal, (digest == F.col("same")) & (F.length("payload") >= min_bytes), "left")
    other = F.col("response").isNotNull() & ~F.col("page").eqNullSafe(F.col("response"))
    return joined.select("page", "url", "payload", F.when(other, F.col("response")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, date: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``pages(page, url, payload, refers_to)``; the captures: key, page, file, offset and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, "", 0
        for batch in batches:
            captures = []
            for page, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    out = _create(name)
                data = gzip.compress(record(page, url, payload, refers_to, refers_to is not None, date), GZIP_LEVEL, mtime=0)
                out.write(data)
                captures.append((url_key(url).encode("utf-8", "surrogatepass"), page, name, at, len(data)))
                at += len(data)
            if out is not None:
                out.flush()
            yield _batch(captures)
        if out is not None:
            out.close()

    return pages.select("page", "url", "payload", "refers_to").mapInArrow(run, CAPTURE)


def _batch(captures: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    columns = list(zip(*captures)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "page", "file", "offset", "length"])


def _place(key: bytes, page: int | None) -> tuple[bytes, int]:
    """Order of captures: by key, then page, null first."""
    return key, -(1 << 63) - 1 if page is None else page


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes sorted index parts with their block directories; (part, key, page): the first capture of each part.

    Range partitioning is by key and page, so that a URL or host with very many captures is spread.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, at, directory, block = f"{folder}/{uuid.uuid4().hex}", None, 0, [], []

        def flush() -> int:
            data = gzip.compress("\n".join(json.dumps(line) for line in block).encode(), GZIP_LEVEL, mtime=0)
            out.write(data)
            directory.append([*block[0][:2], at, len(data)])
            return at + len(data)

        for batch in batches:
            for key, page, file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out = _create(f"{part}.index")
                block.append([key.decode("utf-8", "surrogatepass"), page, file, offset, length])
                if len(block) == block_lines:
                    at, block = flush(), []
        if out is not None:
            if block:
                at = flush()
            out.close()
            with _create(f"{part}.directory") as sparse:
                sparse.write("\n".join(json.dumps(entry) for entry in directory).encode())
            first = directory[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([first[0].encode("utf-8", "surrogatepass")]), pa.array([first[1]], pa.int64())],
                ["part", "key", "page"],
            )

    ordered = captures.repartitionByRange("key", "page").sortWithinPartitions("key", "page")
    return ordered.mapInArrow(run, "part string, key binary, page bigint")


def lookup(queries: DataFrame, parts: DataFrame) -> DataFrame:
    """The captures of each distinct ``queries(key, page)``; a query that has none gives no row.

    The list of index parts (one row each, as many as range partitions) is read in the driver;
    directories and blocks are read by the task that needs them.
    """
    firsts = sorted((*_place(bytes(r.key), r.page), r.part) for r in parts.collect())
    shared = queries.sparkSession.sparkContext.broadcast(firsts)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = [f[:2] for f in shared.value]
        for batch in batches:
            at = [bisect_right(places, _place(k, p)) - 1 for k, p in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], ["key", "page", "at"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, firsts_of, directory, held, number = None, [], [], [], -1
        for batch in batches:
            captures = []
            for key, page, at in zip(*(c.to_pylist() for c in batch.columns)):
                wanted = _place(key, page)
                if at != part:
                    part, number = at, -1
                    uri = shared.value[at][2]
                    system, path = fs.FileSystem.from_uri(f"{uri}.directory")
                    with system.open_input_stream(path, compression=None) as file:
                        directory = [json.loads(line) for line in file.read().decode().split("\n")]
                    firsts_of = [_place(d[0].encode("utf-8", "surrogatepass"), d[1]) for d in directory]
                # equal captures may begin at the end of the block before
                block = max(bisect_left(firsts_of, wanted) - 1, 0)
                while block < len(directory) and firsts_of[block] <= wanted:
                    if block != number:
                        lines = gzip.decompress(_read_range(f"{uri}.index", *directory[block][2:])).decode().split("\n")
                        held = [(_place((c := json.loads(x))[0].encode("utf-8", "surrogatepass"), c[1]), c) for x in lines]
                        number = block
                    line = bisect_left(held, wanted, key=lambda h: h[0])
                    while line < len(held) and held[line][0] == wanted:
                        captures.append((key, *held[line][1][1:]))
                        line += 1
                    block += 1
            yield _batch(captures)

    asked = queries.select("key", "page").distinct().mapInArrow(assign, "key binary, page bigint, at int").where("at >= 0")
    return asked.repartition("at").sortWithinPartitions("at", "key", "page").mapInArrow(find, CAPTURE)


def read_captures(captures: DataFrame) -> DataFrame:
    """(page, url, payload_bytes, payload_digest, record_type, refers_to, payload) of each capture, by one range read each.

    Payload bytes and digest of a response are worked out from what is read and must equal the
    headers; those of a revisit, whose payload is null, are the headers'.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = parse_record(zlib.decompress(_read_range(file, offset, length), wbits=31))
                digest, revisit = found["warc-payload-digest"].removeprefix("sha1:"), found["warc-type"] == "revisit"
                payload = None if revisit else found["payload"]
                if not revisit and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != found["http_length"]):
                    raise ValueError(f"damaged record at {offset} of {file}")
                page, other = found.get("page-id"), found.get("refers-to-page-id")
                rows.append((page and int(page), found.get("warc-target-uri"), found["http_length"], digest,
                             found["warc-type"], other and int(other), payload))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    schema = "page bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    names = StructType.fromDDL(schema).fieldNames()
    # rows are short but name long stretches: readers are dealt by the bytes they read, which no adaptive step sees
    readers = max(1, -(-(captures.agg(F.sum("length")).first()[0] or 0) // READ_BYTES))
    ordered = captures.select("file", "offset", "length").repartition(readers, "file", F.floor(F.col("offset") / READ_BYTES))
    ordered = ordered.sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, schema)


def archive(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
    folder: str | None = None,
    date: str = "1970-01-01T00:00:00Z",
    archive_bytes: int = ARCHIVE_BYTES,
    block_lines: int = BLOCK_LINES,
) -> tuple[DataFrame, DataFrame]:
    """Writes archives and index; (captures, index parts), both stored tables.

    Of pages with equal payloads of at least ``min_bytes`` bytes the one with the largest id is a
    response and the others revisit it; rows that repeat that id are all responses, and a group in
    which no row has an id has no revisits. A null payload is empty, a null URL has the empty key.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    marked = mark_revisits(pages, id_col, html_col, url_col, min_bytes)
    captures = stored(write_archives(marked, f"{folder}/archives", date, archive_bytes), "warc-captures")
    parts = stored(write_index(captures, f"{folder}/index", block_lines), "warc-parts")
    return captures, parts


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    captures, parts = archive(table(spark, folder, "pages"))
    found = read_captures(lookup(captures, parts))
    return found.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = r"""
with p as (
  select page_id, coalesce(encode(html), ''::blob) as payload from pages),
g as (
  select page_id, octet_length(payload) as payload_bytes, sha1(payload) as h, max(page_id) over (partition by payload) as last from p)
select page_id, payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((('0x' || substr(h, 1 + 5 * (i // 4), 5))::int >> (15 - 5 * (i % 4))) & 31 as int) + 1, 1)),
    lambda a, b: a || b) as payload_digest,
  case when page_id = last then 'response' else 'revisit' end as record_type,
  case when page_id <> last then last end as refers_to
from g
"""
