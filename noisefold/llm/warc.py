"""Operator 9: WARC archives, written by tasks and read back in splits.

Every record is a gzip member of its own. The reader cuts files into byte ranges; a task scans its range for the gzip magic, takes a candidate as a member only if it inflates to a WARC header (and to its end with a right checksum), and owns the records that start inside its range, reading past the end for the last one. So a file of any size is read by as many tasks as it has ranges.

A payload that other pages share is stored once: the page with the smallest id has the response, the others are revisit records that refer to it by payload digest.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noisefold.llm.common import cut, new_folder

REVISIT_FROM = 100  # bytes of payload
_MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def record_id(page_id: int | None) -> str:
    """A version 8 UUID that holds the page id: its upper half in front, its lower half at the end; a flag for none."""
    bits = (0x8 << 76) | (0x2 << 62)
    if page_id is None:
        return f"<urn:uuid:{uuid.UUID(int=bits | 1 << 80)}>"
    v = page_id & (1 << 64) - 1
    return f"<urn:uuid:{uuid.UUID(int=(v >> 32) << 96 | bits | v & 0xFFFFFFFF)}>"


def page_of(record: str) -> int | None:
    v = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    if v >> 80 & 1:
        return None
    n = (v >> 96) << 32 | v & 0xFFFFFFFF
    return n - (1 << 64) if n >> 63 else n


def _uri(url: str | None) -> str:
    """The URL as one header line: characters that can't stand there are percent-encoded."""
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    lines += [f"WARC-Target-URI: {_uri(url)}"] * (url is not None)
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from: int = REVISIT_FROM, file_bytes: int = 1 << 28, broadcast_digests: int = 500_000) -> DataFrame:
    """Write a record per row under folder; returns the manifest: path and bytes of each file, already written.

    A null payload counts as empty. Rows that repeat the smallest id of a payload are all responses. Rows without an id refer to the response like others, and are all responses where no row of their payload has an id. Which digests repeat is found first, from digests alone; they are broadcast if they are at most broadcast_digests (about 100 bytes each), so payloads aren't shuffled, else payloads are joined with them by a shuffle. File names are new for every attempt of a task, so what a lost or repeated attempt leaves is in no manifest.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    shared = own.where(F.octet_length("html") >= revisit_from).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    shared, _ = cut(shared, "digests")
    if shared.count() <= broadcast_digests:
        shared = F.broadcast(shared)
    rows = own.join(shared, "digest", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        out, name, size = None, "", 0
        try:
            for pdf in batches:
                for i, url, html, digest, first in zip(pdf["page_id"].array, pdf["url"], pdf["html"], pdf["digest"], pdf["first"].array):
                    i, first = (None if pd.isna(x) else int(x) for x in (i, first))
                    if out is None:
                        name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = where.open_output_stream(f"{base}/{name}", compression=None)
                    revisit = first is not None and i != first
                    data = member(i, url if isinstance(url, str) else None, html.encode(), digest, first, revisit)
                    out.write(data)
                    size += len(data)
                    if size >= file_bytes:
                        out.close()
                        out = None
                        yield pd.DataFrame({"path": [f"{folder}/{name}"], "bytes": [size]})
        finally:
            if out is not None:
                out.close()
        if out is not None:
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "bytes": [size]})

    # Ids go to pandas as strings: longs with nulls would become doubles there.
    text = F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", F.col("first").cast("string").alias("first")
    return cut(rows.select(*text).mapInPandas(run, "path string, bytes long"), "manifest")[0]


def members(read, size: int, start: int, end: int, step: int = 1 << 20) -> Iterator[bytes]:
    """The inflated members that start in [start, end) of a file of `size` bytes; read(offset, length) gives its bytes."""
    at, held, base = start, b"", start
    while at < end:
        if at + 2 >= base + len(held) and base + len(held) < size:
            held, base = held[at - base :] + read(base + len(held), step), at
        k = held.find(_MAGIC, at - base)
        if k < 0:
            if base + len(held) >= size:
                return
            at = max(at, base + len(held) - 2)
            continue
        at = base + k
        if at >= end:
            return
        inflate, data, bad, to = zlib.decompressobj(31), b"", False, at
        pieces: list[bytes] = []
        try:
            while not inflate.eof:
                chunk = held[to - base : to - base + step] if to < base + len(held) else read(to, step)
                if not chunk:
                    bad = True
                    break
                pieces.append(inflate.decompress(chunk))
                to += len(chunk)
                if sum(map(len, pieces[:9])) >= 5 and not b"".join(pieces[:9]).startswith(b"WARC/"):
                    bad = True
                    break
        except zlib.error:
            bad = True
        if not bad:
            data = b"".join(pieces)
            bad = not data.startswith(b"WARC/")
        if bad:
            at += 1
            continue
        yield data
        at = to - len(inflate.unused_data)
        if at > base + len(held):
            held, base = b"", at


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    return fields, rest[: int(fields["content-length"])]


def read(spark: SparkSession, manifest: DataFrame, with_payload: bool = False, split_bytes: int = 1 << 22) -> DataFrame:
    """A row per response or revisit record: page_id, url, record_type, payload_bytes, payload_digest (of the full payload, also for revisits), refers_to, and the payload (null for revisits) if asked. A response whose payload doesn't match its digest ends the job with an error."""
    ranges = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    n = max(1, ranges.count())
    dealt = ranges.repartition(min(n, 4 * spark.sparkContext.defaultParallelism + n // 16), F.xxhash64("path", "start"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            for path, size, start in zip(pdf["path"], pdf["bytes"], pdf["start"]):
                where, base = fs.FileSystem.from_uri(path)
                rows = []
                with where.open_input_file(base) as f:
                    for data in members(lambda at, k: f.read_at(max(0, min(k, size - at)), at), size, start, min(size, start + split_bytes)):
                        fields, block = parse(data)
                        if fields["warc-type"] not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        n = int(next(line for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")).split(b":")[1])
                        digest, revisit = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"] == "revisit"
                        if not revisit and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"damaged record {fields['warc-record-id']} in {path}")
                        rows.append((page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], n, digest, page_of(fields["warc-refers-to"]) if revisit else None, None if revisit or not with_payload else payload))
                if rows:
                    out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])
                    for c in ("page_id", "refers_to"):
                        out[c] = pd.array([pd.NA if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)) else int(x) for x in (r[0 if c == "page_id" else 5] for r in rows)], dtype="Int64")
                    yield out if with_payload else out.drop(columns="payload")

    return dealt.mapInPandas(run, RECORD + ", payload binary" * with_payload)


def archive_folder(spark: SparkSession) -> str:
    """A new folder in the shared storage, as a URL that tasks can open without Hadoop."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new_folder(spark, "warc"))
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + found.removeprefix("file:") if found.startswith("file:/") and not found.startswith("file://") else found
