"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; a bundle ends in the seek table of the public seekable format,
and an index table maps each record to its bundle, frame and offset within the frame's content.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, ship, stage

# fixed values: the seekable format's numbers
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 64 << 20
REVISIT_FROM = 100
BROADCAST_ROWS = 100_000
READ_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, bundle string, frame int, frame_at long, frame_bytes long, offset long, length long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; refers_to makes it a revisit without a payload of its own."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        # % and controls are escaped, so that any url comes back as it was
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c == "%" or ord(c) < 32 or ord(c) in (127, 133) else c for c in url))
    block = HTTP
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """A record's fields; a response's payload is checked against its digest and length."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
    payload = None
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    url = fields.get("WARC-Target-URI")
    if url is not None:
        parts = url.split("%")
        url = parts[0] + "".join(chr(int(p[:2], 16)) + p[2:] for p in parts[1:])
    page, ref = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
    return {
        "page_id": page and int(page),
        "url": url,
        "record_type": fields["WARC-Type"],
        "refers_to": ref and int(ref),
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload,
    }


class BundleWriter:
    """Writes frames to one bundle; finish() appends the seek table."""

    def __init__(self, path: str):
        fs, self.name = pa.fs.FileSystem.from_uri(path)
        fs.create_dir(self.name.rsplit("/", 1)[0], recursive=True)
        self.path, self.out = path, fs.open_output_stream(self.name, compression=None)
        self.frames: list[tuple[int, int]] = []
        self.at = 0

    def add(self, content: bytes) -> tuple[int, int, int]:
        """Frame number, place and compressed size."""
        packed = zstandard.ZstdCompressor(level=3, write_checksum=True).compress(content)
        self.out.write(packed)
        self.frames.append((len(packed), len(content)))
        at, self.at = self.at, self.at + len(packed)
        return len(self.frames) - 1, at, len(packed)

    def finish(self) -> None:
        table = b"".join(struct.pack("<II", *x) for x in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer)
        self.out.close()


def read_seek_table(data) -> list[tuple[int, int, int]]:
    """(place, compressed, content bytes) of each frame, from a seekable file's footer alone."""
    size = data.size()
    n, flags, magic = struct.unpack("<IBI", data.read_at(9, size - 9))
    if magic != SEEKABLE_MAGIC or flags:
        raise ValueError("no seek table")
    raw, frames, at = data.read_at(8 * n, size - 9 - 8 * n), [], 0
    for i in range(n):
        packed, content = struct.unpack_from("<II", raw, 8 * i)
        frames.append((at, packed, content))
        at += packed
    return frames


def _write_part(folder: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # Names differ between attempts: the index, which only successful attempts get into, is what counts.
    schema = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_at", pa.int64()), ("frame_bytes", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
    writer: BundleWriter | None = None
    waiting: list[tuple[int | None, bytes]] = []
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal writer, held
        if writer is None:
            writer = BundleWriter(f"{folder}/{uuid.uuid4().hex}.warc.zst")
        frame, at, packed = writer.add(b"".join(r for _, r in waiting))
        rows, offset = [], 0
        for page_id, r in waiting:
            rows.append((page_id, writer.path, frame, at, packed, offset, len(r)))
            offset += len(r)
        waiting.clear()
        held = 0
        if writer.at >= BUNDLE_BYTES:
            writer.finish()
            writer = None
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    for batch in batches:
        for i in range(batch.num_rows):
            page_id, url, html, digest, refers = (batch.column(k)[i].as_py() for k in range(5))
            record = make_record(page_id, url, (html or "").encode(), digest, refers)
            waiting.append((page_id, record))
            held += len(record)
            if held >= FRAME_BYTES:
                yield flush()
    if waiting:
        yield flush()
    if writer is not None:
        writer.finish()


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record for every page (page_id, url, html) and return the staged index.

    Of pages with equal payloads of at least 100 bytes, those with the smallest page_id are responses (more than one only if
    rows repeat) and the others revisits; smaller payloads are always responses. Null html is an empty
    payload; a null page_id is never referred to, and stays a response where no other page has the payload; a null url is left out of the
    header. Other columns are not looked at. An empty table gives an empty index. A frame holds whole records, 256 KiB or one record.
    """
    ship(pages.sparkSession)
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"))
    large = rows.where(F.octet_length("html") >= REVISIT_FROM)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("digest", "first")
    first = stage(first, "warc-repeats")
    # small tables of repeated payloads are broadcast, so that the html isn't shuffled; larger ones are joined by shuffle
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    rows = rows.join(first, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    return stage(rows.mapInArrow(lambda batches: _write_part(folder, batches), INDEX), "warc-index")


def _read_part(batches: Iterable[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    bundle, frame, data, content, table = None, None, None, b"", []
    rows: list[dict] = []
    held = 0
    for batch in batches:
        for at in batch.select(["bundle", "frame", "offset", "length"]).to_pylist():
            if at["bundle"] != bundle:
                bundle, frame = at["bundle"], None
                fs, name = pa.fs.FileSystem.from_uri(bundle)
                data = fs.open_input_file(name)
                table = read_seek_table(data)
            if at["frame"] != frame:
                frame = at["frame"]
                place, packed, size = table[frame]
                content = zstandard.ZstdDecompressor().decompress(data.read_at(packed, place), max_output_size=size)
            row = parse_record(content[at["offset"] : at["offset"] + at["length"]])
            held += row["payload_bytes"]
            if not payloads:
                row["payload"] = None
            rows.append(row)
            if len(rows) >= 5000 or payloads and held >= 16 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_archives(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that an index (or any selection of it) names: each frame is opened by its seek-table entry and read once a task.

    Tasks are as many as the frames' compressed bytes ask for (8 MiB each), and no fewer than the session's default, as an index itself is thin.
    payloads=False leaves the payload column null after checking it.
    """
    ship(index.sparkSession)
    frames = index.groupBy("bundle", "frame").agg(F.max("frame_bytes").alias("b"))
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-int(frames.agg(F.sum("b")).first()[0] or 0) // READ_BYTES))
    asked = index.repartition(tasks, "bundle", F.floor(F.col("frame") / 16)).sortWithinPartitions("bundle", "frame", "offset")
    return asked.mapInArrow(lambda batches: _read_part(batches, payloads), RECORDS)
