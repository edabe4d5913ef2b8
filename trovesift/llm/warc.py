"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that are compressed independently; the bundle ends with
a skippable frame that holds the sizes of all frames, after Zstandard's seekable format,
so one record is read by decompressing its frame alone. A manifest maps each record to
its bundle, frame and place in the frame. Of records with equal payloads the one with
the smallest page_id is a response and the others are revisits of it.

Tasks write bundles through the file system of the shared folder's address, each under
a fresh name; only the manifest's bundles count, so those of a failed attempt don't.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovesift.llm.shared import materialize, scratch, slices

# Marks of the seekable format, and the profile of a revisit of an equal payload.
SKIPPABLE, SEEK_TABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:trovesift:page:"
#: Bytes of records in a frame, and in a bundle, before compression.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 16 << 20
#: So many revisits (two numbers each) may be broadcast; beyond it they are joined by a shuffle.
TOLD_ROWS = 500_000
#: Hadoop's names of object stores, and pyarrow's.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "abfs": "abfss"}
#: A task for each bundle that is read, up to so many.
MOST_TASKS = 10_000


def digest_of(payload: bytes) -> str:
    """Base32 of the SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record; a revisit has the HTTP head of the full payload but not its bytes."""
    name = lambda x: f"<{URN}{'null' if x is None else x}>"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    target = " ".join((url or "about:blank").split())
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at `at`, and where the next begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    stop = end + 4 + int(headers["Content-Length"])
    return headers, data[end + 4 : stop], stop + 4


class Bundle:
    """Collects records into frames; `finish` gives the bytes of the bundle."""

    def __init__(self, level: int = 3) -> None:
        import zstandard

        self.compressor = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[bytes, int]] = []
        self.pending: list[bytes] = []
        self.held = self.size = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """The record's frame and its place in it."""
        if self.held and self.held + len(data) > FRAME_BYTES:
            self._flush()
        place = len(self.frames), self.held
        self.pending.append(data)
        self.held += len(data)
        self.size += len(data)
        return place

    def _flush(self) -> None:
        if self.pending:
            self.frames.append((self.compressor.compress(b"".join(self.pending)), self.held))
            self.pending, self.held = [], 0

    def finish(self) -> bytes:
        self._flush()
        table = b"".join(struct.pack("<II", len(data), size) for data, size in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0, SEEK_TABLE)
        return b"".join(x for x, _ in self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of each frame."""
    count, _, mark = struct.unpack("<IBI", bundle[-9:])
    if mark != SEEK_TABLE:
        raise ValueError("no seek table")
    out, at = [], 0
    for packed, size in struct.iter_unpack("<II", bundle[-9 - 8 * count : -9]):
        out.append((at, packed, size))
        at += packed
    return out


def read_frame(bundle: bytes, frame: int) -> bytes:
    import zstandard

    start, packed, size = seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + packed], max_output_size=size)


def read_record(bundle: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """Random access: only the record's frame is decompressed."""
    headers, block, _ = parse(read_frame(bundle, frame), offset)
    return headers, block


def frames(files, path: str):
    """The frames of a bundle one after another; one at a time is in memory."""
    import zstandard

    with files.open_input_file(path) as file:
        size = file.size()
        count = struct.unpack("<IBI", file.read_at(9, size - 9))[0]
        tail = file.read_at(9 + 8 * count, size - 9 - 8 * count)
        for start, packed, whole in seek_table(tail):
            yield zstandard.ZstdDecompressor().decompress(file.read_at(packed, start), max_output_size=whole)


def address_of(path: str) -> str:
    """A path of Spark's as pyarrow's file systems name it: Hadoop's schemes of object stores have other names there."""
    if "://" not in path and not path.startswith("file:"):
        return "file://" + path
    if path.startswith("file:/") and not path.startswith("file://"):
        return "file://" + path[len("file:") :]
    scheme, _, rest = path.partition("://")
    return f"{SCHEMES.get(scheme, scheme)}://{rest}"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(address_of(path))


def write_archives(pages: DataFrame, path: str | None = None, date: str = "1970-01-01T00:00:00Z", level: int = 9) -> tuple[str, DataFrame]:
    """Write a record of each row of `pages` (page_id, url, html); the folder, and the manifest (page_id, bundle, frame, offset, bytes).

    A null html is an empty payload. Rows that repeat a page_id are records of their own;
    with equal payloads each is a response. A null page_id can't be referred to, and is
    always a response. Extra columns are ignored; an empty table gives an empty folder.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digests = rows.select("page_id", F.sha1("html").alias("_digest")).where("page_id is not null")
    shared = digests.groupBy("_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("_n")).where("_n > 1")
    twins = digests.join(shared, "_digest").where("page_id > refers_to").select("page_id", "_digest", "refers_to").distinct()
    twins = materialize(twins.select("page_id", F.xxhash64("_digest").alias("_hash"), "refers_to"), "twins")
    told = F.broadcast(twins) if twins.count() <= TOLD_ROWS else twins
    dealt = rows.withColumn("_hash", F.xxhash64(F.sha1("html"))).join(told, ["page_id", "_hash"], "left").select("page_id", "url", "html", "refers_to")

    def run(batches):
        files, root = _open(path)
        files.create_dir(root, recursive=True)
        bundle, name, found = Bundle(level), uuid.uuid4().hex, []

        def close():
            with files.open_output_stream(f"{root}/{name}.warc.zst", compression=None) as out:
                out.write(bundle.finish())
            page, frame, offset, size = (list(x) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(page, pa.int64()), pa.array([name] * len(page)), pa.array(frame, pa.int32()), pa.array(offset, pa.int64()), pa.array(size, pa.int64())],
                ["page_id", "bundle", "frame", "offset", "bytes"],
            )

        for batch in batches:
            for part in slices(batch, "html"):
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    data = record(page_id, url, html.encode(), refers_to, date)
                    found.append((page_id, *bundle.add(data), len(data)))
                    if bundle.size >= BUNDLE_BYTES:
                        yield close()
                        bundle, name, found = Bundle(level), uuid.uuid4().hex, []
        if found:
            yield close()

    manifest = dealt.mapInArrow(run, "page_id long, bundle string, frame int, offset long, bytes long")
    return path, materialize(manifest, "manifest")


def read_archives(spark, path: str, manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of all records of the manifest's bundles; a revisit's payload is null."""
    names = manifest.select("bundle").distinct()
    count = names.count()
    if not count:
        return spark.createDataFrame([], "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")

    def number(text: str | None):
        tail = text.rstrip(">").rpartition(":")[2] if text else "null"
        return None if tail == "null" else int(tail)

    def run(batches):
        files, root = _open(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                for frame in frames(files, f"{root}/{name}.warc.zst"):
                    at, out = 0, []
                    while at < len(frame):
                        headers, block, at = parse(frame, at)
                        head, _, body = block.partition(b"\r\n\r\n")
                        size = int(head.decode().rpartition("Content-Length: ")[2].split("\r\n")[0])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = headers["WARC-Type"]
                        if kind == "response" and (len(body) != size or digest_of(body) != digest):
                            raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
                        out.append((number(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], size, digest, kind, number(headers.get("WARC-Refers-To")), body if kind == "response" else None))
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    dealt = names.repartition(min(count, MOST_TASKS))  # tasks open the bundles they are told, so no content is shuffled
    return dealt.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
