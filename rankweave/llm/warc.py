"""Dictionary-compressed WARC archives.

An archive starts with a skippable frame that holds a Zstandard dictionary built from the archive's own
records, then has a warcinfo record and one record per page, each compressed as a frame of its own with
that dictionary, so any record can be read by itself. The dictionary is trained on whole records; where
an archive has too few for the trainer, pieces of its records serve as dictionary content as they are.
Pages whose payload (of at least `least_bytes`) equals that of another page become revisit records of
the page with the largest id; they keep the HTTP header with the payload's length, and the payload's
digest.

Archives are rows of a Parquet table (archive, content) that Spark writes to a shared folder, so a lost
executor's archives are written again by another; `content` is a complete .warc.zst file. Each archive
is bounded by ARCHIVE_BYTES plus one record. Only the digests of payloads that come more than once are
joined to the pages: broadcast up to BROADCAST_DIGESTS, else by a join that spreads each digest over
SALTS parts.

Null and empty pages are responses with an empty payload; null urls are written as an empty target. Of
repeated rows with the same page_id each is written: with the largest id they are all responses. A null
page_id refers to a copy with an id where there is one, else the page is a response; its record has no
page header. Record ids are unique in any case. An empty table gives no archive and an empty result.
Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm.shared import materialised, shared_folder

ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 48 << 10
SAMPLE_BYTES = 3 << 20
LEAST_BYTES = 1000
BROADCAST_DIGESTS = 1 << 17
SALTS = 32
#: Fixed values of the formats: the skippable frame's magic number and the revisit profile.
SKIPPABLE_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def classify(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html (null for revisits), payload_bytes, payload_digest, record_type, refers_to and
    refers_url of each row. Pages stay where they are as long as the copied digests can be broadcast."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html).alias("payload_digest"))
    large = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
    newest = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("r")
    copied = large.agg(newest, F.min("page_id").alias("low"), F.count("*").alias("n"), F.count("page_id").alias("named"))
    other = (F.col("low") < F.col("r.page_id")) | (F.col("named") < F.col("n"))
    first = materialised(copied.where(F.col("r").isNotNull() & other).select("payload_digest", F.col("r.page_id").alias("first"), F.col("r.url").alias("first_url")))
    if first.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        found = rows.join(F.broadcast(first), "payload_digest", "left")
    else:
        spread = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(spread, ["payload_digest", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return found.select(
        "page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"), F.when(revisit, F.col("first_url")).alias("refers_url"),
    )


def _line(name: str, value: object) -> str:
    text = str(value).replace("\r", "%0D").replace("\n", "%0A")
    return f"{name}: {text}"


def record(kind: str, page_id: int | None, url: str | None, digest_hex: str, length: int, refers_to: int | None, payload: bytes, refers_url: str | None = None, record_id: str | None = None) -> bytes:
    """One WARC record, uncompressed. Page-ID and Refers-To-Page-ID are headers of our own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http + (payload if kind == "response" else b"")
    digest = base64.b32encode(bytes.fromhex(digest_hex)).decode()
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id or uuid.uuid4().urn}>", _line("WARC-Target-URI", url or ""), f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", _line("WARC-Refers-To-Target-URI", refers_url or ""), f"WARC-Refers-To-Date: {_DATE}", f"Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """Trained on whole records spread evenly over the archive, about `sample_bytes` of them. Small archives
    get a dictionary of an eighth of their size. Where the trainer has too little to go by, that much of
    the spread records, evenly cut out of them, is the dictionary."""
    total = sum(map(len, records))
    size = max(256, min(size, total // 8))
    every = max(1, -(-total // sample_bytes))
    samples = records[::every]
    if len(samples) >= 16 and sum(map(len, samples)) >= 8 * size:
        try:
            return zstandard.train_dictionary(size, samples, k=min(512, size // 4), d=8).as_bytes()
        except zstandard.ZstdError:
            pass  # records too alike or too short for the trainer: their own bytes do as well
    each = max(8, size // len(samples))
    return b"".join(r[:each] for r in samples)[: max(size, 8)]


def archive(records: list[bytes], level: int = 3, name: str | None = None) -> bytes:
    """A complete .warc.zst file. `name` tells the archive from all others."""
    words = build_dictionary(records)
    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words))
    info_body = b"format: WARC File Format 1.1\r\n"
    urn = (uuid.uuid5(uuid.NAMESPACE_URL, name) if name else uuid.uuid4()).urn
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <%s>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n" % (urn.encode(), _DATE.encode(), len(info_body)) + info_body + b"\r\n\r\n"
    head = struct.pack("<II", SKIPPABLE_MAGIC, len(words)) + words
    return b"".join([head, *(packer.compress(r) for r in [info, *records])])


def read_archive(content: bytes, step: int = 1 << 12) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a .warc.zst file, frame by frame. A frame is fed in steps, so
    what lies behind its end is never copied beyond one step."""
    magic, size = struct.unpack_from("<II", content)
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("the archive doesn't begin with its dictionary")
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8 : 8 + size]))
    view, at = memoryview(content), 8 + size
    while at < len(content):
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            if at >= len(content):
                raise ValueError("the archive ends inside a record")
            parts.append(frame.decompress(view[at : at + step]))
            at += step
        at = min(at, len(content)) - len(frame.unused_data)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def _frames(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Page records only."""
    for headers, block in read_archive(content):
        if headers["WARC-Type"] != "warcinfo":
            yield headers, block


def _archive_rows(run: str):
    """Archives of a partition's records, closed at ARCHIVE_BYTES. Ids come from the run, the partition and
    the place in it, so that they are unique and a task that is run again writes the same."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, number = [], 0, 0
        task = f"{run}/{TaskContext.get().partitionId()}"

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([archive(waiting, name=f"{task}/{number}")], pa.binary()), pa.array([len(waiting)], pa.int64())], names=["content", "records"])

        for batch in batches:
            for row in batch.to_pylist():
                payload = (row["html"] or "").encode("utf-8", "surrogatepass")
                own = uuid.uuid5(uuid.NAMESPACE_URL, f"{task}/{number}/{len(waiting)}").urn
                waiting.append(record(row["record_type"], row["page_id"], row["url"], row["payload_digest"], row["payload_bytes"], row["refers_to"], payload, row["refers_url"], own))
                size += len(waiting[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    waiting, size, number = [], 0, number + 1
        if waiting:
            yield close()

    return write


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Writes all pages as archives to a Parquet table at a path that all executors share."""
    rows = classify(pages, least_bytes).mapInArrow(_archive_rows(uuid.uuid4().hex), "content binary, records long")
    rows.write.option("parquet.block.size", str(64 << 20)).parquet(path)


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the records of archives say, with the payload's digest and length checked where it is there."""
    import hashlib

    for batch in batches:
        for content in batch.column(0):
            out = []
            for headers, block in _frames(content.as_py()):
                http, _, payload = block.partition(b"\r\n\r\n")
                length = int(http.rsplit(b"Content-Length: ", 1)[1])
                digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                kind = headers["WARC-Type"]
                if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"{headers['WARC-Record-ID']}: the payload is not what was archived")
                refers = int(headers["Refers-To-Page-ID"]) if kind == "revisit" else None
                page = headers.get("Page-ID")
                out.append((None if page is None else int(page), length, digest, kind, refers))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of all records in archives."""
    archives = spark.read.schema("content binary, records long").parquet(path)
    return archives.select("content").mapInArrow(_index_rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived_index(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes archives to the shared folder and reads them back."""
    path = shared_folder(pages.sparkSession)
    write_archives(pages, path, least_bytes)
    return read_index(pages.sparkSession, path)
