"""WARC archives: one gzip member for each record, written by tasks and read in sequence.

Writing: records are routed by payload digest and a salt of the page id, so one very common payload spreads over many
tasks. Each task writes one archive file under a name of its own into the shared folder and reports it in a manifest;
readers open only files in the manifest, so what a lost or repeated attempt wrote is never read.

Reading: a reader streams the file in blocks through incremental zlib decompression, starts a new member where one
ends, frames the record by its header and Content-Length, and verifies the block's digest. Memory holds one block of
the file and one record. A response's payload is hashed again; a revisit's header names digest, length and response.
Records that others wrote are read, too: all record types, headers in any order and case, folded lines, digests as hex or
base32 of SHA-256, SHA-1 or MD5 (others are not verified), records without digests, truncated ones, chunked bodies.

Defined cases: null html is an empty payload; null url is written as an empty target; null page ids keep a record
(written without id; it revisits a page with an id that has the payload, and is a response where there is none); of
several rows of the response's page that with the least url is the response, of equal ones one, and the others revisit the
same id, wherever the rows are read; an empty table gives no records. Of
foreign records page_id and refers_to are null where the record id is no `urn:page`, and payload_digest is the SHA-256 of
the payload that is there; a revisit has the digest its header names (hex where that is SHA-256), or null.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaforge.session import cut, fresh_path, workers_see_package

LEAST_BYTES = 100
SALTS = 16
BLOCK = 1 << 16
LEVEL = 3
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, archive string, at long"
ALGORITHMS = {"sha256": 64, "sha1": 40, "md5": 32}  # names in WARC digests, and their hex digits
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit (refers_to is set) has the HTTP header alone as its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def header_fields(lines: list[str]) -> dict[str, str]:
    """Fields by lower-case name; a line that begins with white space goes on with the one before, of equal names the first counts."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out.setdefault(name, value.strip())
    return out


def stated(digest: str | None) -> tuple[str, str] | None:
    """(algorithm, hex digits) of a labelled digest in hex or base32; nothing for other algorithms."""
    label, _, value = (digest or "").partition(":")
    label, value = label.strip().lower().replace("-", ""), value.strip()
    digits = ALGORITHMS.get(label)
    if not digits or not value:
        return None
    if len(value) == digits:
        return label, value.lower()
    return label, base64.b32decode(value.upper() + "=" * (-len(value) % 8)).hex()


def agrees(digest: str | None, *bodies: bytes) -> bool:
    """Whether a stated digest is that of one of the bodies; what can't be verified agrees."""
    known = stated(digest)
    return known is None or any(hashlib.new(known[0], body).hexdigest() == known[1] for body in bodies)


def unchunked(body: bytes) -> bytes:
    """The content of a chunked HTTP body, as far as it is there."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].partition(b";")[0], 16)
        except ValueError:
            break
        if not size:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(out)


class WarcReader:
    """Records of a stream of gzip members, in order, as (offset of the member, headers, block)."""

    def __init__(self, stream, block: int = BLOCK) -> None:
        self.stream, self.block, self.left, self.offset = stream, block, b"", 0

    def _members(self) -> Iterator[tuple[int, Iterator[bytes]]]:
        while self.left or (more := self.stream.read(self.block)):
            if not self.left:
                self.left = more
            start, zipped = self.offset, zlib.decompressobj(31)

            def pieces(zipped=zipped) -> Iterator[bytes]:
                while True:
                    self.offset += len(self.left)
                    piece = zipped.decompress(self.left)
                    self.left = zipped.unused_data
                    self.offset -= len(self.left)
                    if piece:
                        yield piece
                    if zipped.eof:
                        return
                    self.left = self.stream.read(self.block)
                    if not self.left:
                        raise EOFError("the archive ends within a gzip member")

            yield start, pieces()

    def __iter__(self) -> Iterator[tuple[int, dict[str, str], bytes]]:
        for start, pieces in self._members():
            buffer = bytearray()
            end = -1
            for piece in pieces:
                buffer += piece
                if (end := buffer.find(b"\r\n\r\n")) >= 0:
                    break
            lines = bytes(buffer[: max(end, 0)]).decode("utf-8", "replace").split("\r\n")
            if end < 0 or not lines[0].startswith("WARC/"):
                raise ValueError(f"no record at byte {start}")
            headers = header_fields(lines[1:])
            size = int(headers["content-length"])
            body = buffer[end + 4 :]
            for piece in pieces:
                body += piece
            if len(body) != size + 4 or body[size:] != b"\r\n\r\n":
                raise ValueError(f"the record at byte {start} is not as long as it says")
            block = bytes(body[:size])
            if not agrees(headers.get("warc-block-digest"), block):
                raise ValueError(f"the block at byte {start} does not match its digest")
            yield start, headers, block


def _page(urn: str | None) -> int | None:
    kind, _, number = (urn or "").strip("<> ").rpartition(":")
    return int(number) if kind == "urn:page" and number.lstrip("-").isdigit() else None


def parsed(headers: dict[str, str], block: bytes) -> dict:
    """A record's row, with the payload's digest verified."""
    kind, digest = headers.get("warc-type", ""), headers.get("warc-payload-digest")
    payload, size = block, len(block)
    if headers.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        fields = header_fields(head.decode("latin-1").split("\r\n")[1:])
        length = fields.get("content-length", "")
        size = int(length) if length.isdigit() else len(payload)
        whole = kind == "response" and "warc-truncated" not in headers
        if whole and length.isdigit() and "transfer-encoding" not in fields and len(payload) != size:
            raise ValueError("the payload is not as long as its header says")
        if whole and not agrees(digest, payload, unchunked(payload)):
            raise ValueError("the payload does not match its digest")
    elif kind != "revisit" and "warc-truncated" not in headers and not agrees(digest, payload):
        raise ValueError("the payload does not match its digest")
    if kind == "revisit":
        known = stated(digest)
        named = known[1] if known and known[0] == "sha256" else digest
    else:
        size, named = len(payload), hashlib.sha256(payload).hexdigest()
    record_id = headers.get("warc-record-id")
    return {"page_id": _page(record_id), "url": headers.get("warc-target-uri"), "payload_bytes": size, "payload_digest": named, "record_type": kind, "refers_to": _page(headers.get("warc-refers-to")) if kind == "revisit" else None, "record_id": record_id}


def with_revisits(pages: DataFrame, least: int = LEAST_BYTES, salts: int = SALTS) -> DataFrame:
    """page_id, url, html, digest, size, first (the page that holds the payload, null where no other row shares it), own (this row
    is the response) and copies (as many equal rows; where own, all but one revisit)."""
    body = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("size"))
    same = rows.filter(F.col("size") >= least).groupBy("digest", "page_id", "url").agg(F.count("*").alias("m"))
    least_row = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "m")))
    firsts = same.groupBy("digest").agg(least_row.alias("f"), F.sum("m").alias("n")).filter((F.col("n") > 1) & F.col("f").isNotNull())
    firsts = cut(firsts.select("digest", F.col("f.page_id").alias("first"), F.col("f.url").alias("first_url"), F.col("f.m").alias("m")), "warc-firsts")
    spread = firsts.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(salts)).cast("int"))
    of_first = F.coalesce((F.col("page_id") == F.col("first")) & F.col("url").eqNullSafe(F.col("first_url")), F.lit(False))
    marked = salted.join(spread, ["digest", "salt"], "left").withColumn("own", of_first)
    columns = ["page_id", "url", "html", "digest", "size", "first", "own"]
    single = marked.select(*columns, F.lit(1).cast("long").alias("copies"))
    if not firsts.filter("m > 1").limit(1).count():
        return single
    # Equal rows of a response: counted by the task that reads them, and the first of these packs has the response.
    again = F.col("own") & (F.col("m") > 1)
    packs = cut(marked.filter(again).groupBy("digest", "page_id", "url", "size", "first", F.spark_partition_id().alias("pack")).agg(F.first("html").alias("html"), F.count("*").alias("copies")), "warc-packs")
    owners = packs.groupBy("digest").agg(F.min("pack").alias("owner"))
    packed = packs.join(owners, "digest").withColumn("own", F.col("pack") == F.col("owner"))
    return marked.filter(~F.coalesce(again, F.lit(False))).select(*columns, F.lit(1).cast("long").alias("copies")).unionByName(packed.select(*columns, "copies"))


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST_BYTES) -> DataFrame:
    """Write one archive for each task into `folder` (of a kind that pyarrow opens) and return the stored manifest."""
    spark = workers_see_package(pages.sparkSession)
    folder = folder or fresh_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        out, name, count = None, f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out = out or store.open_output_stream(f"{root}/{name}", compression=None)
                for page_id, url, html, digest, size, first, own, copies in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "size", "first", "own", "copies")), strict=True):
                    for i in range(copies):
                        out.write(record_bytes(page_id, url, html.encode(), digest, size, None if own and i == 0 else first))
                    count += copies
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([count], pa.int64())], names=["archive", "records"])

    return cut(with_revisits(pages, least).mapInArrow(write, "archive string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of every archive in the manifest, in file order within an archive."""
    workers_see_package(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("archive", pa.string()), ("at", pa.int64())])
        for batch in batches:
            for uri, records in zip(batch.column("archive").to_pylist(), batch.column("records").to_pylist(), strict=True):
                store, path = _open(uri)
                rows, seen = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for start, headers, block in WarcReader(stream):
                        rows.append(parsed(headers, block) | {"archive": uri, "at": start})
                        seen += 1
                        if len(rows) == 2048:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if seen != records:
                    raise ValueError(f"{uri} has {seen} records; {records} were written")
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = max(1, manifest.count())
    return manifest.repartition(min(files, 10_000)).mapInArrow(read, RECORDS)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: write all pages, read the archives back."""
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS f,
             row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST, url NULLS FIRST) AS nth FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND f IS NOT NULL AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND nth > 1 THEN f END AS refers_to
FROM q
"""
