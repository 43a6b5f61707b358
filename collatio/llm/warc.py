"""WARC: archives of pages, and a normaliser from monolithic gzip to one member a record with an offset index."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import file_system as _fs
from ._store import cut, new_path

#: Bytes of records after which a task starts its next archive.
ARCHIVE_BYTES = 64 << 20
BLOCK = 1 << 20
DATE = "2000-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def roles(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest, record_type and refers_to.

    Of rows with equal payloads of at least `least` bytes the one with the largest page_id is the response, the others
    revisit it. The largest id of a payload is a partial aggregate, so a payload that a third of all pages share
    isn't gathered; its join is one Spark can split.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    base = base.withColumn("digest", F.sha1("payload"))
    first = base.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("largest"))
    other = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return base.join(first, "digest", "left").select("page_id", "url", "payload", "digest", F.when(other, "revisit").otherwise("response").alias("record_type"), F.when(other, F.col("largest")).alias("refers_to"))


def _clean(s: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", s)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP header alone; its Content-Length still tells the payload's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    name = "none" if page_id is None else str(page_id)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {IDENTICAL}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:]) if k}


def write(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Each task writes its rows as monolithic .warc.gz archives, one gzip stream a file, to `folder`; returns (path, records).

    File names hold the task's attempt, and only what the successful attempt reports is read later, so a lost executor
    leaves at most a file that nothing names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(folder)
        fs.create_dir(base, recursive=True)
        ctx = TaskContext.get()
        stem = f"{base}/{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        done, out, size, n = [], None, 0, 0

        def close():
            if out is not None:
                out.write(z.flush())
                out.close()
                done.append((path, n))

        for b in batches:
            for page_id, url, payload, digest, kind, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "record_type", "refers_to")), strict=True):
                if out is None or size >= archive_bytes:
                    close()
                    path, size, n = f"{stem}-{len(done):04d}.warc.gz", 0, 0
                    out, z = fs.open_output_stream(path, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                data = record(page_id, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), kind, refers)
                out.write(z.compress(data))
                size, n = size + len(data), n + 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], ["path", "records"])

    return rows.mapInArrow(run, "path string, records bigint")


class Inflated:
    """The bytes of a gzip file, inflated once from start to end; holds a block and what the reader asks for."""

    def __init__(self, source):
        self.source, self.z, self.have = source, zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        data = self.z.unconsumed_tail or self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        if self.z.eof:  # the next member, if the file has several
            self.z = zlib.decompressobj(31)
        data = data or self.source.read(BLOCK)
        if not data:
            return False
        self.have += self.z.decompress(data, BLOCK)
        return True

    def head(self) -> bytes | None:
        """A record's header up to its empty line; None at the end."""
        while (at := self.have.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.have.strip():
                    raise ValueError("the archive ends within a record's header")
                return None
        got = bytes(self.have[:at])
        del self.have[: at + 4]
        return got

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.have and not self._more():
                raise ValueError("the archive ends within a record")
            part = bytes(self.have[:n])
            del self.have[: len(part)]
            n -= len(part)
            if part:
                yield part


def normalise(archives: DataFrame, level: int = 6) -> DataFrame:
    """Rewrite every record of every monolithic archive as its own gzip member, beside a sidecar index.

    Each archive is inflated once, as a stream, and each record is compressed as it comes, so a task holds a block, not
    a record or an archive. `x.warc.gz` becomes `x.members.warc.gz` and `x.members.warc.gz.idx`, whose lines are JSON with the record's
    id, type, offset and length. Returns (path, index, records).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        for b in batches:
            rows = []
            for path in b.column("path").to_pylist():
                fs, base = _fs(path)
                to = f"{base.removesuffix('.warc.gz')}.{attempt}.members.warc.gz"
                index, n = [], 0
                with fs.open_input_stream(base, compression=None) as source, fs.open_output_stream(to, compression=None) as out:
                    data = Inflated(source)
                    while (head := data.head()) is not None:
                        h, offset = headers(head), out.tell()
                        z = zlib.compressobj(level, zlib.DEFLATED, 31)
                        out.write(z.compress(head + b"\r\n\r\n"))
                        for part in data.take(int(h["content-length"]) + 4):
                            out.write(z.compress(part))
                        out.write(z.flush())
                        index.append(json.dumps({"id": h["warc-record-id"], "type": h["warc-type"], "offset": offset, "length": out.tell() - offset}))
                with fs.open_output_stream(f"{to}.idx", compression=None) as out:
                    out.write("".join(f"{x}\n" for x in index).encode())
                rows.append((to, f"{to}.idx", len(index)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["path", "index", "records"])

    return archives.mapInArrow(run, "path string, index string, records bigint")


RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string, offset bigint, length bigint"


def read(archives: DataFrame, verify: bool = True) -> DataFrame:
    """Every record of normalised archives, each found by its index line and inflated alone.

    A response's payload is measured and digested anew, and must agree with its header; a revisit has both from its headers.
    """

    def page(urn: str) -> int | None:
        name = urn.rpartition(":")[2].rstrip(">")
        return None if name == "none" else int(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        for b in batches:
            for path, index in zip(b.column("path").to_pylist(), b.column("index").to_pylist(), strict=True):
                fs, base = _fs(path)
                rows = []
                with fs.open_input_file(base) as data, fs.open_input_stream(_fs(index)[1], compression=None) as lines:
                    for line in io.TextIOWrapper(lines, "utf-8"):
                        x = json.loads(line)
                        data.seek(x["offset"])
                        head, _, rest = zlib.decompress(data.read(x["length"]), 31).partition(b"\r\n\r\n")
                        h = headers(head)
                        block = rest[: int(h["content-length"])]
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size, digest = int(headers(http)["content-length"]), h["warc-payload-digest"].removeprefix("sha1:")
                        if verify and h["warc-type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"{path} at {x['offset']}: the payload differs from its header")
                        refers = page(h["warc-refers-to"]) if h["warc-type"] == "revisit" else None
                        rows.append((page(h["warc-record-id"]), h.get("warc-target-uri"), size, digest, h["warc-type"], refers, path, x["offset"], x["length"]))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return archives.mapInArrow(run, RECORDS)


def archive(pages: DataFrame, folder: str | None = None, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages to monolithic archives, normalise these, and read the records back.

    A null html is an empty payload; a null url has no target header, and white space and control bytes in one are
    percent-encoded. A null page_id is archived under no id, and is a response unless another row with an id has its payload.
    Rows that repeat the largest id of a payload are each a response. An empty table writes no archive.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "op8-warc")
    written = cut(write(roles(pages, least), folder, archive_bytes), "op8-written")
    archives = cut(normalise(written.repartition(max(1, written.count()))), "op8-normalised")
    return read(archives.repartition(max(1, archives.count())))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: what the archives of all pages say of each page."""
    out = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
b AS (SELECT DISTINCT hex, (SELECT string_agg(substr(a, 1 + ((v >> 15) & 31), 1) || substr(a, 1 + ((v >> 10) & 31), 1) || substr(a, 1 + ((v >> 5) & 31), 1) || substr(a, 1 + (v & 31), 1), '' ORDER BY i)
      FROM (SELECT i, CAST('0x' || substr(hex, 1 + 5 * i, 5) AS BIGINT) AS v, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS a FROM (SELECT unnest(generate_series(0, 7)) AS i))) AS payload_digest FROM p),
m AS (SELECT hex, max(page_id) AS largest FROM p GROUP BY hex)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM p JOIN m USING (hex) JOIN b USING (hex)
"""
