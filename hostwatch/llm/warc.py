"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames of about ``FRAME_BYTES``, which are independent of one
another, so any record is read by a seek, one frame and a slice of it.  A bundle begins
with a frame of its warcinfo record and ends with a seek table in a skippable frame (per
frame: compressed and decompressed size, and a footer with their number).  The manifest
maps page_id to (bundle, frame, offset and length inside the decompressed frame), and
records are read back through it: the frame's place in the file is the seek table's.

Of records with equal payloads (SHA-1, SHA-256 and length) of ``MIN_REVISIT`` bytes or
more, that with the largest page_id is the response and the others revisit it; smaller
payloads are all responses.  A null html is an empty payload.  Pages without page_id are
responses with a record id of their own, as are repeated rows of the largest page_id, which
share one.  A url's white space is squeezed, none is left out.  Extra columns are ignored.
An empty table makes no bundle.

A task writes its bundles under names of its own attempt and tells their names in its
rows, so a lost or repeated task leaves at most a file that no manifest names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostwatch.llm.common import shared_dir, small_batches, table, written

MIN_REVISIT, FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1000, 256 << 10, 64 << 20, 3
#: What stands for the HTTP message of which only the payload is known.
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
MANIFEST = "page_id long, bundle string, frame int, offset int, length int"
RECORD = "page_id long, payload binary, record_type string, refers_to long, payload_digest string, target_uri string"


def payloads(pages: DataFrame) -> DataFrame:
    """``(page_id, url, payload, digest, record_type, refers_to)``."""
    p = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", p.alias("payload")).withColumns({"digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    # Small payloads have keys that nothing else has, and that don't fall together in one task as nulls would.
    large = (F.col("payload_bytes") >= MIN_REVISIT) & F.col("page_id").isNotNull()
    rows = rows.withColumn("__key", F.when(large, F.concat("digest", F.lit("-"), F.sha2("payload", 256))).otherwise(F.concat_ws("-", F.lit("small"), "page_id", "digest")))
    first = rows.where(large).select("__key", "page_id").groupBy("__key").agg(F.max("page_id").alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    both = rows.join(first, "__key", "left")
    revisit = F.col("__first").isNotNull() & (F.col("__first") != F.col("page_id"))
    return both.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("__first")).alias("refers_to"))


def record(row: dict, date: str) -> bytes:
    """One WARC/1.1 record.  A revisit has its payload's digest, and no payload."""
    revisit = row["record_type"] == "revisit"
    block = HTTP if revisit else HTTP + row["payload"]
    name = f"urn:uuid:{uuid.uuid4()}" if row["page_id"] is None else f"urn:page:{row['page_id']}"
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{row['digest']}"]
    head += [f"WARC-Target-URI: {' '.join(row['url'].split())}"] if row["url"] else []
    head += [f"WARC-Refers-To: <urn:page:{row['refers_to']}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(date: str) -> bytes:
    """A bundle's first record."""
    block = b"software: hostwatch\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(raw: bytes) -> tuple[dict, bytes]:
    """A record's fields and its payload (of a warcinfo record, its block)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2] if fields["Content-Type"].startswith("application/http") else block


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    body = entries + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """``(offset, compressed, decompressed)`` of each frame of an open bundle."""
    file.seek(file.size() - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    file.seek(file.size() - 9 - 8 * n)
    out, at = [], 0
    for c, d in struct.iter_unpack("<II", file.read(8 * n)):
        out.append((at, c, d))
        at += c
    return out


def write_bundles(rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write ``payloads`` rows as bundles in ``folder``; returns the manifest, written.
    date: when the pages were fetched, which the rows don't say."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        squeeze = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        out, frames, made, name, part, size, at = None, [], [], "", [], 0, 0

        def flush():
            nonlocal part, size, at
            if part:
                frame = squeeze.compress(b"".join(part))
                out.write(frame)
                frames.append((len(frame), size))
                part, size, at = [], 0, at + len(frame)

        def close():
            flush()
            out.write(seek_table(frames))
            out.close()
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], ["page_id", "bundle", "frame", "offset", "length"])

        for b in batches:
            for i in range(b.num_rows):
                row = {n: c[i].as_py() for n, c in zip(b.schema.names, b.columns)}
                if out is None:
                    name, frames, made, part, size, at = f"{uuid.uuid4().hex}.warc.zst", [], [], [], 0, 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    part, size = [raw := info(date)], len(raw)
                    flush()
                raw = record(row, date)
                made.append((row["page_id"], name, len(frames), size, len(raw)))
                part.append(raw)
                size += len(raw)
                if size >= FRAME_BYTES:
                    flush()
                if at >= BUNDLE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return written(rows.mapInArrow(run, MANIFEST), "warc-manifest")


def read_bundles(manifest: DataFrame, folder: str) -> DataFrame:
    """The manifest's records: each bundle's seek table and each frame is read once."""
    kinds = [pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.string()]
    names = ["page_id", "payload", "record_type", "refers_to", "payload_digest", "target_uri"]

    def number(x: str | None) -> int | None:
        return int(x[len("<urn:page:") : -1]) if x and x.startswith("<urn:page:") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        squeezed, file, bundle, frame, table_, text = zstandard.ZstdDecompressor(), None, None, None, [], b""
        rows, size = [], 0
        for b in batches:
            for name, number_of, at, n in zip(*(b.column(c).to_pylist() for c in ("bundle", "frame", "offset", "length"))):
                if name != bundle:
                    if file:
                        file.close()
                    file, bundle, frame = fs.open_input_file(f"{path}/{name}"), name, None
                    table_ = read_seek_table(file)
                if number_of != frame:
                    where, c, d = table_[number_of]
                    file.seek(where)
                    text, frame = squeezed.decompress(file.read(c), max_output_size=d), number_of
                fields, payload = read_record(text[at : at + n])
                rows.append((number(fields["WARC-Record-ID"]), payload, fields["WARC-Type"], number(fields.get("WARC-Refers-To")), fields["WARC-Payload-Digest"][5:], fields.get("WARC-Target-URI")))
                size += len(payload)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, size = [], 0
        if file:
            file.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A bundle's frames are dealt in runs, so that a bundle isn't one task's alone.
    dealt = manifest.repartition(n, "bundle", F.floor(F.col("frame") / 64)).sortWithinPartitions("bundle", "frame", "offset")
    return dealt.mapInArrow(run, RECORD)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write_bundles(payloads(table(spark, sf_dir, "pages")), folder)
    rows = read_bundles(manifest, folder).select("page_id", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha1"), "record_type", "refers_to", "payload_digest")
    rows = written(rows, "warc-read")  # small rows: the payloads end here
    # A revisit's payload is its response's: length and digest are those read there.
    full = rows.where("record_type = 'response'").select(F.col("page_id").alias("__of"), F.col("n").alias("__n"), F.col("sha1").alias("__sha1")).where("__of IS NOT NULL").dropDuplicates(["__of"])
    both = rows.join(full, rows["refers_to"] == full["__of"], "left")
    return both.select("page_id", F.coalesce("__n", "n").alias("payload_bytes"), F.coalesce("__sha1", "sha1").alias("payload_digest"), "record_type", "refers_to")


SQL = {
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, max(page_id) AS f FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN f.f <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN f.f <> page_id THEN f.f END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h"""
}
