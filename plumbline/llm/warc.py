"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding a group of
whole WARC records, then a skippable frame with the record index and last the
seek table of the public seekable format. A record is found by its identifier:
index -> frame number and offset inside the frame -> one frame is decompressed.

Bundles are made inside Spark tasks and written by Spark's own text writer,
one row per file. The writer ends each row with a line separator; that
separator is set to the four bytes which end a seek table, so a file is exactly
one bundle, and commits, retries and file systems are Spark's matter.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import HOT_SHARE, materialize, with_filter
from plumbline.shared import remove, shared_folder

#: Fixed values of the Zstandard and seekable formats.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SCHEMA = ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
          "url string, frame int, frame_offset bigint, record_bytes bigint, payload binary")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None,
           date: str) -> bytes:
    """One WARC/1.1 record. A revisit has no payload of its own but names digest, size and response."""
    name = "none" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>",
             f"WARC-Date: {date}", "Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha256:{digest}",
             f"X-Payload-Length: {size}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[:int(fields["Content-Length"])]


class BundleWriter:
    """Collects records into frames; ``close`` gives the bundle without its last four bytes."""

    def __init__(self, frame_bytes: int, level: int):
        import zstandard

        self.squeeze = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frame_bytes = frame_bytes
        self.out, self.sizes, self.index, self.now = bytearray(), [], [], bytearray()

    def add(self, page_id: int | None, raw: bytes) -> None:
        self.index.append((page_id, len(self.sizes), len(self.now), len(raw)))
        self.now += raw
        if len(self.now) >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.now:
            frame = self.squeeze.compress(bytes(self.now))
            self.sizes.append((len(frame), len(self.now)))
            self.out += frame
            self.now = bytearray()

    def close(self) -> bytes:
        self.flush()
        index = self.squeeze.compress(json.dumps(self.index).encode())
        self.out += struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IB", len(self.sizes), 0)
        self.out += struct.pack("<II", SKIPPABLE_SEEK, len(table) + 4) + table
        return bytes(self.out)


class BundleReader:
    """Random access into one bundle."""

    def __init__(self, raw: bytes):
        import zstandard

        self.expand = zstandard.ZstdDecompressor()
        self.raw = raw
        n, _, end = struct.unpack("<IBI", raw[-9:])
        if end != SEEK_END:
            raise ValueError("no seek table at the end of the bundle")
        at = len(raw) - 9 - 8 * n
        self.frames, where = [], 0
        for packed, plain in struct.iter_unpack("<II", raw[at:at + 8 * n]):
            self.frames.append((where, packed, plain))
            where += packed
        magic, size = struct.unpack("<II", raw[where:where + 8])
        if magic != SKIPPABLE_INDEX:
            raise ValueError("no record index after the frames")
        self.index = [tuple(x) for x in json.loads(self.expand.decompress(raw[where + 8:where + 8 + size]))]

    def frame(self, number: int) -> bytes:
        where, packed, plain = self.frames[number]
        return self.expand.decompress(self.raw[where:where + packed], max_output_size=plain)

    def records(self, wanted: set | None = None) -> Iterator[tuple[tuple, bytes]]:
        """(index entry, record) in file order; only frames that hold a wanted record are decompressed."""
        number, plain = -1, b""
        for entry in self.index:
            if wanted is None or entry[0] in wanted:
                if entry[1] != number:
                    number, plain = entry[1], self.frame(entry[1])
                yield entry, plain[entry[2]:entry[2] + entry[3]]


def with_record_types(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes, refers_to.

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with
    the smallest id is the response. A null html is an empty payload. Rows that
    repeat the smallest id are responses too; a row without an id is a revisit
    if an equal payload has an id. Digests that repeat often are broadcast, and
    so is a filter of all that repeat. Pages that are hot or do not pass the
    filter stay where they are; where the other digests are too many for Spark to
    broadcast them, their pages are shuffled by digest, payloads included.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("payload_digest", F.sha2("payload", 256))
    counted = materialize(rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(
        F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n_equal")).filter("n_equal > 1"))
    n_digests, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_equal"), F.lit(0))).first()
    hot = F.col("n_equal") > total * HOT_SHARE
    often = counted.filter(hot).select("payload_digest", F.col("first_id").alias("hot_id"), F.lit(True).alias("is_hot"))
    told = with_filter(rows, counted, ["payload_digest"], n_digests).join(F.broadcast(often), "payload_digest", "left")
    moves = F.col("_may") & F.col("is_hot").isNull()
    stay = told.filter(~moves).withColumn("first_id", F.col("hot_id"))
    moved = told.filter(moves).join(counted.filter(~hot).select("payload_digest", "first_id"), "payload_digest", "left")
    typed = stay.unionByName(moved)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return typed.select("page_id", "url", "payload", "payload_digest", "payload_bytes", refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 26, level: int = 3,
                   date: str = "2020-01-01T00:00:00Z") -> None:
    """Writes one bundle per file under ``path``: frames of about ``frame_bytes``, bundles of about ``bundle_bytes`` of records.

    No page gives an empty folder (of Spark's marker files only).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, size = None, 0
        for batch in batches:
            for page_id, url, payload, digest, n, refers in zip(*(batch.column(c) for c in (
                    "page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to")), strict=True):
                raw = record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), n.as_py(), refers.as_py(), date)
                writer = writer or BundleWriter(frame_bytes, level)
                writer.add(page_id.as_py(), raw)
                size += len(raw)
                if size >= bundle_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([writer.close()], pa.binary())], ["bundle"])
                    writer, size = None, 0
        if writer:
            yield pa.RecordBatch.from_arrays([pa.array([writer.close()], pa.binary())], ["bundle"])

    bundles = with_record_types(pages).mapInArrow(run, "bundle binary").select(F.col("bundle").cast("string").alias("value"))
    (bundles.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1")
     .option("lineSep", struct.pack("<I", SEEK_END).decode("latin-1")).text(path))


def read_archives(spark: SparkSession, path: str, page_ids: list[int] | None = None, with_payload: bool = True) -> DataFrame:
    """Every record of all bundles under ``path`` (``page_ids``: only these), with its place in its bundle.

    Digest and length of a response are computed from the payload read back;
    one that differs from its header raises an error.
    """
    wanted = None if page_ids is None else set(page_ids)

    def number(urn: str | None) -> int | None:
        return None if urn is None or urn == "<urn:page:none>" else int(urn[len("<urn:page:"):-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                cols: list[list] = [[] for _ in range(10)]
                for (_, frame, offset, size), raw in BundleReader(content.as_py()).records(wanted):
                    fields, payload = parse_record(raw)
                    digest, n = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
                    if fields["WARC-Type"] == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
                    for col, v in zip(cols, (
                            number(fields["WARC-Record-ID"]), n, digest, fields["WARC-Type"], number(fields.get("WARC-Refers-To")),
                            fields.get("WARC-Target-URI"), frame, offset, size, payload if with_payload else None), strict=True):
                        col.append(v)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                                 [f.split()[0] for f in SCHEMA.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")
    return files.mapInArrow(run, SCHEMA)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives of ``pages`` to a new shared folder and reads them back, without payloads; the archives go."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    rows = materialize(read_archives(spark, path, with_payload=False).drop("payload"))
    remove(spark, path)
    return rows
