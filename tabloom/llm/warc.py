"""WARC archives in seekable Zstandard bundles.

Each row becomes a WARC/1.1 record. Of rows with equal payloads (of at least ``least`` bytes) the one with the largest
id is a response; the others are revisits that refer to it and carry no payload. Records are grouped into independent
Zstandard frames of about ``frame_bytes``; a bundle ends with a seek table in a skippable frame (the seekable format:
for each frame its compressed and its plain size, then the number of frames, a descriptor byte and the magic number).
An index maps each record to its bundle, frame, and offset within the plain frame, so that one record is read by
decompressing one frame.

Bundles are written to the shared folder under a name of their own for each attempt of a task; the index only has those of
attempts that succeeded. A null payload is empty; a null URL leaves its header out. Rows with equal payloads and ids
(repeated rows) are all responses if their id is the largest, else all revisits. A null id sorts before all others. An
empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import filesystem, join_on, scratch, width, written

#: Fixed values of the seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_DATE = "2000-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(key: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{key}')}>"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = _DATE) -> bytes:
    """A response, or a revisit of ``refers_to``; the block is an HTTP message."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {date}"]
    if url is not None:
        # A line break can't be part of a header.
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"X-Page-Id: {'' if key is None else key}", f"WARC-Payload-Digest: sha1:{base32(hashlib.sha1(payload).digest())}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], dict[str, str], bytes, int]:
    """(WARC headers, HTTP headers, payload, end) of the record at an offset."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no record here")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    begin = stop + 4
    end = begin + int(head["Content-Length"])
    cut = data.index(b"\r\n\r\n", begin, end)
    http = dict(x.split(": ", 1) for x in data[begin:cut].decode().split("\r\n")[1:])
    return head, http, data[cut + 4 : end], end + 4


class Bundle:
    """Writes frames and, at the end, the seek table."""

    def __init__(self, out, level: int) -> None:
        import zstandard

        self.out, self.zstd, self.sizes, self.at = out, zstandard.ZstdCompressor(level=level), [], 0

    def frame(self, plain: bytes) -> None:
        packed = self.zstd.compress(plain)
        self.out.write(packed)
        self.sizes.append((len(packed), len(plain)))
        self.at += len(packed)

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(f) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame, from the end of a bundle."""
    size = f.size()
    f.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    f.seek(size - 9 - 8 * n)
    raw, out, at = f.read(8 * n), [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", raw, 8 * i)
        out.append((at, packed, plain))
        at += packed
    return out


INDEX = "id long, record_id string, record_type string, bundle string, frame int, frame_offset long, frame_size long, record_offset long, record_length long"


def write(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 28, level: int = 3, folder: str | None = None) -> DataFrame:
    """Writes the bundles and returns the index, as a written table."""
    folder = folder or scratch(pages.sparkSession, "warc")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("long", F.octet_length("payload") >= least)
    # Only payloads that occur more than once need the join; each has one row here. Payloads are shuffled only if those rows are too many to broadcast.
    heads = rows.where("long").groupBy("digest").agg(F.max("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "head")
    rows = join_on(rows, written(heads, "heads"), "digest", 128, "left")
    revisit = F.col("long") & F.col("head").isNotNull() & ~F.col("id").eqNullSafe(F.col("head"))
    rows = rows.select("id", "url", "payload", F.when(revisit, F.col("head")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, top = filesystem(folder)
        fs.create_dir(top, recursive=True)
        bundle, name, number, plain, held, size = None, "", 0, [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal plain, held, size
            if held:
                at = bundle.at
                bundle.frame(b"".join(plain))
                frame, packed = len(bundle.sizes) - 1, bundle.sizes[-1][0]
                yield pa.RecordBatch.from_arrays([
                    pa.array([h[0] for h in held], pa.int64()), pa.array([record_id(h[0]) for h in held]), pa.array([h[1] for h in held]), pa.array([f"{folder}/{name}"] * len(held)),
                    pa.array([frame] * len(held), pa.int32()), pa.array([at] * len(held), pa.int64()), pa.array([packed] * len(held), pa.int64()), pa.array([h[2] for h in held], pa.int64()), pa.array([h[3] for h in held], pa.int64()),
                ], names=["id", "record_id", "record_type", "bundle", "frame", "frame_offset", "frame_size", "record_offset", "record_length"])
            plain, held, size = [], [], 0

        for batch in batches:
            for i in range(batch.num_rows):
                key, url, payload, refers_to = (batch.column(c)[i].as_py() for c in range(4))
                if bundle is None:
                    name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.zst"
                    bundle = Bundle(fs.open_output_stream(f"{top}/{name}", compression=None), level)
                    number += 1
                made = record(key, url, payload, refers_to)
                held.append((key, "response" if refers_to is None else "revisit", size, len(made)))
                plain.append(made)
                size += len(made)
                if size >= frame_bytes:
                    yield from flush()
                    if bundle.at >= bundle_bytes:
                        bundle.close()
                        bundle = None
        yield from flush()
        if bundle:
            bundle.close()

    return written(rows.mapInArrow(run, INDEX), "warc-index")


def read_record(bundle: str, frame_offset: int, frame_size: int, record_offset: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """One record, by its row of the index: reads and decompresses one frame."""
    import zstandard

    fs, path = filesystem(bundle)
    with fs.open_input_file(path) as f:
        f.seek(frame_offset)
        plain = zstandard.ZstdDecompressor().decompress(f.read(frame_size))
    return parse(plain, record_offset)[:3]


PAGES = "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read(spark: SparkSession, index: DataFrame, *, payloads: bool = True) -> DataFrame:
    """Every record of the bundles in the index; each bundle is read frame by frame, by its seek table. The digests of
    payloads are computed anew and held against the headers. ``payloads``: return their bytes (null for revisits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = filesystem(name)
                with fs.open_input_file(path) as f:
                    for at, packed, size in seek_table(f):
                        f.seek(at)
                        plain, k, out = unzip.decompress(f.read(packed), max_output_size=size), 0, []
                        while k < len(plain):
                            head, http, payload, k = parse(plain, k)
                            kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                            if kind == "response" and base32(hashlib.sha1(payload).digest()) != digest:
                                raise ValueError(f"{head['WARC-Record-ID']} of {name} isn't what was written")
                            key, to = head["X-Page-Id"], head.get("X-Refers-To-Page-Id")
                            out.append((int(key) if key else None, head.get("WARC-Target-URI"), int(http["Content-Length"]), digest, kind, int(to) if to else None, payload if payloads and kind == "response" else None))
                        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return index.select("bundle").distinct().repartition(width(spark), "bundle").mapInArrow(run, PAGES)
