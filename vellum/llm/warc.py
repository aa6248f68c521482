"""WARC records in ZIP packages: written by tasks, read back by byte ranges.

A package holds stored members: `archive/data.warc.gz` (one gzip member a record) and
`indexes/index.cdx` (one line a record: offset, length, page). The reader never extracts: it
parses the end record, its ZIP64 form and the central directory, finds the index members, and
turns their lines into byte ranges of the archive member; tasks then read those ranges, near
ones together, and parse and verify each record.

Packages are files in the shared folder, written through pyarrow's file systems (local, HDFS,
S3, GCS). A task's packages have names of their own for each attempt, and only those that the
stored manifest names are read, so a lost executor leaves no half-written package behind.

Cases: null payloads count as empty; of equal payloads of at least `least` bytes the largest
page_id is the response (all rows with that page_id, if repeated) and others revisit it;
smaller ones are all responses; payloads of any length are one record; null URLs have no target
header, control characters in URLs are percent-encoded; null page_ids are kept, and rank below
all others; an empty table gives no packages and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm import zips
from vellum.llm.secrets import slices
from vellum.plans.runtime import Scratch

LEAST_REVISIT = 1000
#: A package is closed at so many bytes; ranges up to READ bytes are read at once; a task reads about TASK bytes.
PACKAGE, READ, TASK = 64 << 20, 4 << 20, 32 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTROL = re.compile(r"[\x00-\x20\x7f]")


def planned(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is null for responses."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= least)
    shared = large.groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").select("digest", "owner")
    out = rows.join(shared, "digest", "left")
    revisit = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    return out.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("owner")).alias("refers_to"))


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'page {page_id}'.encode()).digest())}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, response or revisit; a revisit's block is the HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"X-Page: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields, checked against its own lengths and, for a response, its payload digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    length = int(fields["content-length"])
    if len(rest) != length + 4:
        raise ValueError("a record's block has another length than its header says")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    n = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a response's payload does not have its digest")
    number = lambda key: int(fields[key]) if key in fields else None
    return {"page_id": number("x-page"), "url": fields.get("warc-target-uri"), "payload_bytes": n, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": number("x-refers-to-page"), "payload": payload}


def write_packages(plan: DataFrame, folder: str, package: int = PACKAGE, zip64: bool | None = None) -> DataFrame:
    """Write the planned records; (path, n_records, n_bytes) of each package. To be stored at once: reading it writes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        pieces: list[bytes] = []
        lines: list[bytes] = []
        at = 0

        def close() -> pa.RecordBatch:
            nonlocal pieces, lines, at
            path = f"{root}/{uuid.uuid4().hex}.wacz"
            with fs.open_output_stream(path) as f:
                size = zips.write_stored(f, [(ARCHIVE, pieces), (INDEX, lines)], zip64)
            out = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(lines)], pa.int64()), pa.array([size], pa.int64())], names=["path", "n_records", "n_bytes"])
            pieces, lines, at = [], [], 0
            return out

        for batch in slices(batches, "payload"):
            payloads = batch.column(2).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
            for page_id, url, payload, digest, refers_to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), payloads, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                pack = zlib.compressobj(1, wbits=31)
                data = pack.compress(record(page_id, url, payload, digest, refers_to)) + pack.flush()
                lines.append(json.dumps({"offset": at, "length": len(data), "page": page_id, "filename": ARCHIVE}).encode() + b"\n")
                pieces.append(data)
                at += len(data)
                if at >= package:
                    yield close()
        if lines:
            yield close()

    return plan.mapInArrow(run, "path string, n_records long, n_bytes long")


def read_index(packages: DataFrame, folder: str) -> DataFrame:
    """(path, offset, length): the byte range of each record within its package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_file(path) as f:
                    listed = zips.members(f, f.size())
                    starts = {m.name: zips.data_offset(f, m) for m in listed if m.stored}
                    for m in listed:
                        if m.name.startswith("indexes/") and m.stored:
                            f.seek(starts[m.name])
                            rows = [json.loads(line) for line in f.read(m.size).splitlines()]
                            offsets = [starts[r["filename"]] + r["offset"] for r in rows]
                            yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(offsets, pa.int64()), pa.array([r["length"] for r in rows], pa.int64())], names=["path", "offset", "length"])

    return packages.select("path").mapInArrow(run, "path string, offset long, length long")


FIELDS = (("page_id", "long"), ("url", "string"), ("payload_bytes", "long"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "long"))


def read_records(ranges: DataFrame, folder: str, payloads: bool = True, tasks: int | None = None) -> DataFrame:
    """The records at the byte ranges, with their payloads (as text) unless told otherwise.

    tasks: by the archives' bytes; the ranges themselves are so small that Spark would put them
    all into one task.
    """
    fields = [*FIELDS, *([("payload", "string")] if payloads else [])]
    arrow = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        f, open_path, at, held = None, None, 0, b""
        for batch in batches:
            path, offset, length = (batch.column(i).to_pylist() for i in range(3))
            rows: dict[str, list] = {n: [] for n, _ in fields}
            size = 0
            for i in range(len(path)):
                if path[i] != open_path:
                    f, open_path, held = fs.open_input_file(path[i]), path[i], b""
                if not (at <= offset[i] and offset[i] + length[i] <= at + len(held)):
                    # This record and those that follow it closely, in one read.
                    end, j = offset[i] + length[i], i + 1
                    while j < len(path) and path[j] == path[i] and offset[j] >= offset[i] and offset[j] + length[j] - offset[i] <= READ and offset[j] - end <= READ // 16:
                        end, j = max(end, offset[j] + length[j]), j + 1
                    f.seek(offset[i])
                    at, held = offset[i], f.read(end - offset[i])
                got = parse(zlib.decompress(held[offset[i] - at : offset[i] - at + length[i]], wbits=31))
                for n, _ in fields:
                    rows[n].append(got[n].decode() if n == "payload" else got[n])
                size += len(got["payload"]) if payloads else 0
                if size > READ:
                    yield pa.RecordBatch.from_pydict(rows, schema=arrow)
                    rows, size = {n: [] for n, _ in fields}, 0
            yield pa.RecordBatch.from_pydict(rows, schema=arrow)

    blocks = ranges.withColumn("block", F.floor(F.col("offset") / (2 * READ)))
    dealt = (blocks.repartition(tasks, "path", "block") if tasks else blocks.repartition("path", "block")).sortWithinPartitions("path", "offset").drop("block")
    return dealt.mapInArrow(run, T.StructType([T.StructField(n, T.LongType() if t == "long" else T.StringType()) for n, t in fields]))


def round_trip(pages: DataFrame, scratch: Scratch, payloads: bool = False, zip64: bool | None = None) -> DataFrame:
    """Pages to packages and back: the records as they were read. The packages go once they are read."""
    folder = scratch.folder("packages")
    packages = scratch.save(write_packages(planned(pages), folder, zip64=zip64), "manifest")
    n_bytes = packages.agg(F.sum("n_bytes")).first()[0] or 0
    tasks = max(-(-n_bytes // TASK), pages.sparkSession.sparkContext.defaultParallelism)
    records = read_records(read_index(packages.repartition("path"), folder), folder, payloads, tasks)
    return scratch.finish(records, folders=[folder])
