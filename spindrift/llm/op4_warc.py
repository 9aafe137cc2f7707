"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames, so a reader can decompress one frame alone. Behind the frames stand two
skippable frames: the record index (identifier, frame, offset within the frame, length) and the seek table of the
seekable format (compressed and decompressed size of each frame, then the footer). A bundle is rotated at
``bundle_bytes``, so no file, and no row of a read, grows with the input.

Bundles are written to a folder that all executors share. A task writes under a name of its own attempt and moves the
file in place at its end; the manifest names the bundles of the attempts that succeeded, and only those are read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cells, shared_dir, stored, table, texts

#: Fixed values of the Zstandard seekable format.
SKIPPABLE_SEEK, SKIPPABLE_INDEX, SEEKABLE = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 20, 24 << 20, 3
MIN_REVISIT = 0


# --- one bundle ------------------------------------------------------------------------------------------------------


class BundleWriter:
    """Builds a bundle in memory, at most a little over its limit."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> None:
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.out, self.frames, self.index, self.held = bytearray(), [], [], bytearray()

    def add(self, identifier: str, record: bytes) -> None:
        self.index.append([identifier, len(self.frames), len(self.held), len(record)])
        self.held += record
        if len(self.held) >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.held:
            packed = self.packer.compress(bytes(self.held))
            self.frames.append((len(packed), len(self.held)))
            self.out += packed
            self.held.clear()

    def __len__(self) -> int:
        return len(self.out) + len(self.held)

    def finish(self) -> bytes:
        self._close_frame()
        index = zstandard.ZstdCompressor(level=LEVEL).compress(json.dumps(self.index).encode())
        self.out += struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index
        # The seek table covers the index frame too, as a frame of no decompressed bytes, so that sizes add up to the file's.
        entries = [*self.frames, (len(index) + 8, 0)]
        body = b"".join(struct.pack("<II", *e) for e in entries) + struct.pack("<IBI", len(entries), 0, SEEKABLE)
        self.out += struct.pack("<II", SKIPPABLE_SEEK, len(body)) + body
        return bytes(self.out)


class BundleReader:
    """Frames and records of a bundle by seek table and index."""

    def __init__(self, data: bytes) -> None:
        count, _, magic = struct.unpack("<IBI", data[-9:])
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end of the bundle")
        entries = list(struct.iter_unpack("<II", data[-9 - 8 * count : -9]))
        self.data, self.places, at = data, [], 0
        for packed, plain in entries:
            self.places.append((at, packed, plain))
            at += packed
        start, size, _ = self.places.pop()
        self.index = json.loads(zstandard.ZstdDecompressor().decompress(data[start + 8 : start + size]))
        self.by_id = {x[0]: x for x in self.index}

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.places[k]
        return zstandard.ZstdDecompressor().decompress(self.data[at : at + packed], max_output_size=plain)

    def record(self, identifier: str) -> bytes:
        _, k, at, size = self.by_id[identifier]
        return self.frame(k)[at : at + size]

    def records(self) -> Iterator[bytes]:
        now, held = -1, b""
        for _, k, at, size in self.index:
            if k != now:
                now, held = k, self.frame(k)
            yield held[at : at + size]


# --- one record ------------------------------------------------------------------------------------------------------


def payload_digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(identifier: str, page_id: int | None, url: str | None, digest: str, size: int, payload: bytes | None, refers_to: int | None) -> bytes:
    """A WARC record; payload None makes a revisit, whose HTTP header keeps the length of the payload it stands for."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: <{identifier}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {_line(url)}"] if url else []
    head += [f"X-Page-ID: {page_id}"] if page_id is not None else []
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{page_urn(refers_to)}>", f"X-Refers-To-Page: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_urn(page_id: int | None) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}").urn


def parsed(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """WARC headers, the HTTP header's content length and the payload that is there; a response's digest is verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    if fields["WARC-Type"] == "response" and (len(payload) != size or payload_digest(hashlib.sha1(payload).digest()) != fields["WARC-Payload-Digest"][5:]):
        raise ValueError("a payload does not fit its digest")
    return fields, size, payload


# --- tables ----------------------------------------------------------------------------------------------------------


def _put(folder: str, name: str, data: bytes) -> None:
    """Writes a file below a shared folder, whole or not at all."""
    where = urlparse(folder)
    if where.scheme in ("", "file"):
        path = unquote(where.path) if where.scheme else folder
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/.{name}.tmp", "wb") as f:
            f.write(data)
        os.replace(f"{path}/.{name}.tmp", f"{path}/{name}")
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/.{name}.tmp") as f:
            f.write(data)
        store.move(f"{path}/.{name}.tmp", f"{path}/{name}")


def _written(folder: str, frame_bytes: int, bundle_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stem, part, rows = f"part-{task.partitionId():06d}-{task.taskAttemptId()}", 0, 0
        bundle = BundleWriter(frame_bytes)

        def close() -> pa.RecordBatch:
            name = f"{stem}-{part:04d}.warc.zst"
            _put(folder, name, data := bundle.finish())
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(bundle.index)], pa.int64()), pa.array([len(data)], pa.int64())], names=["bundle", "n_records", "n_bytes"])

        for b in batches:
            columns = b.to_pydict() if b.num_rows else {}
            html = cells(b.column(b.schema.get_field_index("html")))
            for k in range(b.num_rows):
                page, sha1, size, best = (columns[c][k] for c in ("page_id", "sha1", "size", "refers_to"))
                identifier = page_urn(page) if best is None and page is not None else uuid.uuid5(uuid.NAMESPACE_OID, f"{stem}:{rows}").urn
                payload = None if best is not None else html[k] or b""
                bundle.add(identifier, record(identifier, page, columns["url"][k], payload_digest(bytes.fromhex(sha1)), size, payload, best))
                rows += 1
                if len(bundle) >= bundle_bytes:
                    yield close()
                    part, bundle = part + 1, BundleWriter(frame_bytes)
        if bundle.index:
            yield close()

    return run


def typed(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """pages (page_id, url, html) with sha1, size and refers_to: the response's page_id for a revisit, else null.

    Payloads are told apart by SHA-256 and length. The largest page_id of each comes from an aggregation combined on the
    map side; a revisit's html is dropped, as its record does not hold it.
    """
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", "html", F.sha1(body).alias("sha1"), F.octet_length(body).cast("long").alias("size"), F.sha2(body, 256).alias("key"))
    best = rows.groupBy("key").agg(F.max("page_id").alias("best"))
    refers = F.when((F.col("size") >= min_revisit) & (F.col("page_id") < F.col("best")), F.col("best"))
    joined = rows.join(best.hint("shuffle_hash"), "key").withColumn("refers_to", refers)
    return joined.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "sha1", "size", "refers_to")


def write(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes a record for each row of pages to bundles below folder; gives the manifest (bundle, n_records, n_bytes)."""
    rows = typed(pages, min_revisit).mapInArrow(_written(f"{folder}/bundles", frame_bytes, bundle_bytes), "bundle string, n_records long, n_bytes long")
    return stored(rows, folder, "manifest")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record in the manifest's bundles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in cells(b.column(0)):
                rows = []
                for x in BundleReader(data).records():
                    fields, size, _ = parsed(x)
                    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
                    rows.append((None if page is None else int(page), size, fields["WARC-Payload-Digest"][5:], fields["WARC-Type"], None if refers is None else int(refers)))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if manifest.isEmpty():
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(f"{folder}/bundles")
    named = files.select(F.substring_index("path", "/", -1).alias("bundle"), "content")
    return named.join(manifest.select("bundle"), "bundle", "left_semi").select("content").mapInArrow(run, schema)


def round_trip(pages: DataFrame, min_revisit: int = MIN_REVISIT, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) to archives in the shared folder and reads them back: a row for each row.

    Null html is an empty payload; a null page_id is a response of its own. Of repeated rows with the largest page_id
    each is a response. Other columns are not read. An empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = shared_dir(spark)
    return read(spark, folder, write(pages, folder, min_revisit, frame_bytes, bundle_bytes))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(texts(table(spark, sf_dir, "pages"), "page_id", "url", "html"))
