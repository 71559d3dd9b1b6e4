"""Web archives: records written with their transaction's identifiers, read back and joined to one row per capture."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import batches_of, shared_files
from trendloom.session import cut, cut_and_measure

LEAST_BYTES = 0  # payloads from this size on are stored once
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = pa.schema([
    ("file", pa.string()), ("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()),
    ("head", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("page_id", pa.int64()), ("payload", pa.binary()),
])
RECORD_DDL = "file string, record_id string, type string, concurrent_to string, target_uri string, head string, payload_bytes long, payload_digest string, page_id long, payload binary"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, record_id: str, block: bytes, content_type: str, extra: list[tuple[str, str]]) -> bytes:
    """One record as a gzip member of its own."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *extra, ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    lines = "".join(f"{name}: {value}\r\n" for name, value in head)
    return gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n", compresslevel=3, mtime=0)


def _capture(name: str, page_id: int | None, url: str | None, html: str | None, revisit: bool) -> Iterator[bytes]:
    """Request, response or revisit, and metadata of one page."""
    payload = (html or "").encode()
    main, request, metadata = (uuid.uuid5(uuid.NAMESPACE_URL, f"{name}/{part}").urn for part in ("main", "request", "metadata"))
    address = quote(url or "", safe="%/:=&?~#+!$,;'@()*[]-._")
    uri = [("WARC-Target-URI", address)] if address else []
    try:
        parts = urlsplit(address)
        path, host = (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), parts.netloc
    except ValueError:
        path, host = "/", ""
    with_main = [*uri, ("WARC-Concurrent-To", f"<{main}>")]
    yield _record("request", request, f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode(), "application/http; msgtype=request", with_main)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = ("WARC-Payload-Digest", f"sha1:{_digest(payload)}")
    if revisit:
        yield _record("revisit", main, head, "application/http; msgtype=response", [*uri, digest, ("WARC-Profile", PROFILE)])
    else:
        yield _record("response", main, head + payload, "application/http; msgtype=response", [*uri, digest])
    fields = f"page-id: {page_id}\r\n" if page_id is not None else ""
    yield _record("metadata", metadata, fields.encode(), "application/warc-fields", with_main)


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as gzipped WARC files to a shared folder; gives (path, captures).

    The payload is the html in UTF-8, empty for null. Of pages with equal payloads of at least ``least_bytes`` bytes the one
    with the largest page_id is written as response, the others as revisits without payload; smaller payloads are all responses.
    Rows that share that page_id are all responses, and so are those of a payload that has no page_id at all.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    own = pages.select("page_id", "url", "html", F.when(F.octet_length(body) >= least_bytes, F.sha1(body)).alias("digest"))
    groups = own.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first"))
    repeated = groups.where(F.col("n") > 1).select(F.col("digest").alias("of"), "first")
    marked = own.join(repeated, F.col("digest") == F.col("of"), "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    rows = marked.select("page_id", "url", "html", revisit.alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, stream, n = TaskContext.get(), None, 0
        system, root = shared_files(folder)
        path = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        for batch in batches:
            for row in batch.to_pylist():
                if stream is None:
                    system.create_dir(root, recursive=True)
                    stream = system.open_output_stream(path, compression=None)
                for record in _capture(f"{path}/{n}", **row):
                    stream.write(record)
                n += 1
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "captures": [n]})

    def capture_rows(batches):
        yield from write(b.rename_columns(["page_id", "url", "html", "revisit"]) for b in batches)

    return cut(rows.mapInArrow(capture_rows, "path string, captures long"))


def records_in(stream: io.BufferedIOBase, file: str, with_payload: bool) -> Iterator[dict]:
    """Records of a gzipped archive, one at a time."""
    plain = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)
    while line := plain.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = {}
        while (line := plain.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        block = plain.read(int(head.get("content-length", 0)))
        kind = head.get("warc-type")
        row = {"file": file, "record_id": head.get("warc-record-id"), "type": kind, "concurrent_to": head.get("warc-concurrent-to"), "target_uri": head.get("warc-target-uri")}
        if kind == "metadata":
            fields = dict(x.split(": ", 1) for x in block.decode().splitlines() if ": " in x)
            row["page_id"] = int(fields["page-id"]) if "page-id" in fields else None
        else:
            http, _, payload = block.partition(b"\r\n\r\n")
            row["head"] = http.decode()
            if kind == "response":
                row |= {"payload_bytes": len(payload), "payload_digest": _digest(payload), "payload": payload if with_payload else None}
            elif kind == "revisit":
                length = [x for x in row["head"].split("\r\n") if x.lower().startswith("content-length:")]
                row |= {"payload_bytes": int(length[0].split(":")[1]) if length else None, "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None}
        yield row


def read_records(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Every record of the archives that ``manifest`` names, one task or more per file; digests are of the payloads read."""
    files, seen = cut_and_measure(manifest.select("path"), files=F.count(F.lit(1)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = shared_files(folder)
        for rows in batches:
            for path in rows.column(0).to_pylist():
                with system.open_input_stream(path, compression=None) as stream:
                    yield from batches_of(records_in(stream, path, with_payload), RECORD, 256)

    return files.repartition(max(1, seen["files"])).mapInArrow(read, RECORD_DDL)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, request, response, metadata).

    The response or revisit names the capture; requests and metadata find it by the record they are concurrent to. A part that
    is not in the archive is null.
    """
    main = records.where(F.col("type").isin("response", "revisit"))
    response = F.struct("type", "target_uri", "head", "payload_bytes", "payload_digest", "payload").alias("response")
    request = records.where(F.col("type") == "request").select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "target_uri", "head").alias("request"))
    metadata = records.where(F.col("type") == "metadata").select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "page_id").alias("metadata"))
    named = main.select(F.col("record_id").alias("capture_id"), response)
    return named.join(request, "capture_id", "left").join(metadata, "capture_id", "left")


def resolved(found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every capture of ``captures``.

    refers_to is the page_id of the response that has the payload of a revisit, null for a response.
    """
    flat = found.select(
        F.col("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"),
    )
    originals = flat.where(F.col("record_type") == "response").groupBy("payload_digest").agg(F.max("page_id").alias("original"))
    joined = flat.join(originals, "payload_digest", "left")
    refers = F.when(F.col("record_type") == "revisit", F.col("original")).alias("refers_to")
    return joined.select("page_id", "payload_bytes", "payload_digest", "record_type", refers)


def archived(pages: DataFrame, folder: str) -> DataFrame:
    """``pages`` written as archives, read back, their transactions assembled and revisits resolved.

    Null html is an empty payload. A null url leaves the target address out, a null page_id the metadata field; the capture
    then has a null page_id. Repeated rows are captures of their own. An empty table writes no file and gives no row.
    """
    records = cut(read_records(write_archives(pages, folder), folder))
    return resolved(captures(records))


# The DuckDB twin of ``archived`` over ``pages``, for distinct ids; base32 takes five bits at a time from the hexadecimal digest.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS original FROM pages)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST(concat('0x', substr(x, i // 4 * 5 + 1, 5)) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> original THEN original END AS refers_to
FROM p"""
