"""WARC archives: a writer with revisit records and a splittable reader.

Files are concatenated gzip members, one record each. The reader does not
need an index: a task gets a byte range, looks for the gzip magic in it,
validates a candidate by decoding its first bytes (they must be a WARC
header), and then reads members one behind the other. It owns the records
that start inside its range and reads on past the end to finish the last.

Writing: each task writes files of its own under the shared folder, with
a name that no other attempt uses, and returns (path, bytes); the table of
these rows, written by Spark, is the manifest. Only files of successful
attempts are in it, so lost executors and repeated tasks leave no trace.

Revisits: among records with equal payloads (SHA-1) of at least ``min_bytes``
the one with the largest key is the response and the others refer to it.
Digests are grouped with partial aggregation; only groups of two or more are
joined back (by broadcast when counted small, else by a shuffle).

Edge cases: a null payload is empty; a null key is smaller than any other;
repeated rows that share the largest key are all responses; null URLs write
an empty target; line ends in URLs are percent-encoded; an empty table
gives an empty archive; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prodlens.llm.common import hint_small, materialise, pick, scratch

MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _uri(key) -> str:
    return "<urn:x-page:%s>" % ("" if key is None else key)


def record(key, url: str | None, payload: bytes, sha1_hex: str, refers_to) -> bytes:
    """One gzip member. ``refers_to`` None: a response, else a revisit."""
    digest = base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    block = HTTP + (payload if refers_to is None else b"")
    head = ["WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"),
            "WARC-Record-ID: " + _uri(key), "WARC-Date: " + DATE,
            "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
            "WARC-Payload-Digest: sha1:" + digest, "X-Payload-Length: %d" % len(payload),
            "Content-Type: application/http; msgtype=response", "Content-Length: %d" % len(block)]
    if refers_to is not None:
        head += ["WARC-Profile: " + PROFILE, "WARC-Refers-To: " + _uri(refers_to)]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write_warc(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url",
               payload: str = "html", min_bytes: int = 0, max_file_bytes: int = 1 << 30) -> DataFrame:
    """Write all rows; returns the manifest (path string, bytes long)."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    body = F.coalesce(pick(pages, payload, "string"), F.lit(""))
    d = pages.select(pick(pages, key, "long").alias("key"), pick(pages, url, "string").alias("url"),
                     body.alias("payload"), F.sha1(body).alias("sha1"))
    same = (d.where(F.octet_length("payload") >= min_bytes).groupBy("sha1")
            .agg(F.max("key").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    same = materialise(same)
    d = d.join(hint_small(same, same.count(), 80), "sha1", "left")
    ref = F.when((F.octet_length("payload") >= min_bytes) & F.col("top").isNotNull()
                 & (F.col("key").isNull() | (F.col("key") < F.col("top"))), F.col("top"))
    d = d.select("key", "url", "payload", "sha1", ref.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, size, done = None, 0, []
        try:
            for b in batches:
                for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                    if out is None:
                        name = "%s.warc.gz" % uuid.uuid4().hex
                        out, size = fs.open_output_stream("%s/%s" % (base, name), compression=None), 0
                    k, u, p, s, r = row
                    m = record(k, u, p.encode(), s, r)
                    out.write(m)
                    size += len(m)
                    if size >= max_file_bytes:
                        out.close()
                        out = None
                        done.append((name, size))
        finally:
            if out is not None:
                out.close()
                done.append((name, size))
        yield pa.RecordBatch.from_arrays(
            [pa.array(["%s/%s" % (folder, n) for n, _ in done], pa.string()),
             pa.array([s for _, s in done], pa.int64())], names=["path", "bytes"])

    return materialise(d.mapInArrow(write, "path string, bytes long"))


class _Window:
    """Bytes of a file from ``start`` on, read when asked for."""

    def __init__(self, f, start: int, first: int):
        self.f, self.base = f, start
        f.seek(start)
        self.buf = bytearray(f.read(first))

    def need(self, at: int, n: int) -> bytes:
        """``n`` bytes at file offset ``at`` (fewer at the end of the file)."""
        lack = at + n - self.base - len(self.buf)
        if lack > 0:
            self.buf += self.f.read(lack)
        return bytes(memoryview(self.buf)[at - self.base:at - self.base + n])

    def find(self, at: int, end: int) -> int:
        """First gzip magic that starts in [at, end), or -1."""
        self.need(at, end - at + len(MAGIC) - 1)
        p = self.buf.find(MAGIC, at - self.base, end - self.base + len(MAGIC) - 1)
        return -1 if p < 0 else p + self.base


def _is_record(w: _Window, at: int) -> bool:
    """Does a gzip member whose text begins with a WARC header start here?"""
    head = w.need(at, 4096)
    if not head.startswith(MAGIC) or len(head) < 18 or head[3] & 0xE0:
        return False
    try:
        return zlib.decompressobj(31).decompress(head, 64).startswith(b"WARC/")
    except zlib.error:
        return False


def _member(w: _Window, at: int, step: int = 1 << 16) -> tuple[bytes, int]:
    """The member's bytes and the offset behind it."""
    z, out = zlib.decompressobj(31), []
    while not z.eof:
        chunk = w.need(at, step)
        if not chunk:
            raise EOFError("an archive ends inside a record")
        out.append(z.decompress(chunk))
        at += len(chunk)
    return b"".join(out), at - len(z.unused_data)


def records_in(f, start: int, end: int) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of the records that start in [start, end) of a file."""
    w = _Window(f, start, end - start + 4096)
    at, known = start, False
    while at < end:
        if not known or not w.need(at, 3).startswith(MAGIC):
            at = w.find(at, end)
            if at < 0:
                return
        if not _is_record(w, at):
            at, known = at + 1, False
            continue
        raw, at = _member(w, at)
        known = True
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
        yield fields, rest[:int(fields["Content-Length"])]


READ = ("record_type string, record_id string, url string, payload binary, payload_bytes long, "
        "payload_digest string, refers_to string")


def read_warc(manifest: DataFrame, range_bytes: int = 16 << 20, payloads: bool = True) -> DataFrame:
    """All records of the manifest's files, read by byte ranges. ``payloads``
    False leaves the payload column empty (digests are still of the bytes)."""
    n = F.ceil(F.col("bytes") / range_bytes)
    r = manifest.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"))
    r = r.select("path", (F.col("i") * range_bytes).alias("start"),
                 F.least(F.col("bytes"), (F.col("i") + 1) * range_bytes).alias("end"))
    tasks = int(r.count())
    r = r.repartition(max(1, tasks), "path", "start") if tasks else r

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, s, e in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                fs, p = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(p) as f:
                    rows, held = [], 0
                    for h, block in records_in(f, s, e):
                        body = block.partition(b"\r\n\r\n")[2]
                        if h["WARC-Type"] == "response":
                            size, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                        else:
                            size, digest = int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:")
                        rows.append((h["WARC-Type"], h["WARC-Record-ID"], h["WARC-Target-URI"],
                                     body if payloads else None, size, digest, h.get("WARC-Refers-To")))
                        held += size if payloads else 0
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    return r.mapInArrow(read, READ)


def _batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      names=[x.split()[0] for x in READ.split(", ")])


def page_key(col: str):
    """The key inside a record id."""
    return F.regexp_extract(col, r"^<urn:x-page:(-?\d*)>$", 1).try_cast("long")


def page_report(pages: DataFrame, key: str = "page_id", **kw) -> DataFrame:
    """Write an archive of all pages and read it back: one row per record."""
    r = read_warc(write_warc(pages, key=key, **kw), payloads=False)
    return r.select(page_key("record_id").alias(key), "payload_bytes", "payload_digest", "record_type",
                    page_key("refers_to").alias("refers_to"))
