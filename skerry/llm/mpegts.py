"""Media columns in MPEG transport streams: payloads are multiplexed into one, and parsed back out of it."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

# fixed values of the transport stream format
SYNC, PACKET, BODY = 0x47, 188, 184
PAT_PID, PMT_PID, DATA_PID = 0x0000, 0x1000, 0x0100
PRIVATE_STREAM, PRIVATE_TYPE = 0xBD, 0x06
CRC_POLYNOMIAL = 0x04C11DB7

UNIT = 576
UNITS_PER_PES = 32
PTS_STEP = 3600
RANDOM_ACCESS_EVERY = 8
PES_HEAD = 14
BATCH_BYTES = 8 << 20


def crc_mpeg(data: bytes) -> int:
    """The sections' CRC-32: most significant bit first, no reflection."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (CRC_POLYNOMIAL if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def section_packet(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    length = len(body) + 9
    section = bytes([table_id, 0xB0 | length >> 8, length & 255]) + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    section += crc_mpeg(section).to_bytes(4, "big")
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return packet + b"\xff" * (PACKET - len(packet))


PAT = section_packet(PAT_PID, 0x00, 1, b"\x00\x01" + (0xE000 | PMT_PID).to_bytes(2, "big"))
PMT = section_packet(PMT_PID, 0x02, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")


def timestamp(prefix: int, pts: int) -> bytes:
    return bytes([prefix << 4 | (pts >> 30 & 7) << 1 | 1, pts >> 22 & 255, (pts >> 15 & 127) << 1 | 1, pts >> 7 & 255, (pts & 127) << 1 | 1])


def padded(data: bytes) -> bytes:
    """Bytes of value 255 up to a positive multiple of 576."""
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def mux(payload: bytes) -> bytes:
    """A transport stream: program tables, then elementary packets of 32 units with a timestamp, every eighth of them a random-access point."""
    out, counter = [PAT, PMT], 0
    for k, at in enumerate(range(0, len(payload), UNIT * UNITS_PER_PES)):
        data = payload[at : at + UNIT * UNITS_PER_PES]
        pts = k * PTS_STEP & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(data) + PES_HEAD - 6).to_bytes(2, "big") + b"\x84\x80\x05" + timestamp(2, pts) + data
        clock = pts << 15 | 0x7E << 8  # 33 bits, 6 reserved ones, 9 bits of extension
        field = bytes([7, 0x10 | (0x40 if k % RANDOM_ACCESS_EVERY == 0 else 0)]) + clock.to_bytes(6, "big")
        n = 1 + -(-max(0, len(pes) - BODY + len(field)) // BODY)
        packets = np.empty((n, PACKET), np.uint8)
        packets[:, 0] = SYNC
        packets[:, 1] = DATA_PID >> 8
        packets[:, 2] = DATA_PID & 255
        packets[:, 3] = 0x10 | (counter + np.arange(n)) % 16
        packets[0, 1] |= 0x40
        packets[0, 3] |= 0x20
        room = n * BODY - len(field)
        spare = room - len(pes)
        body = np.frombuffer(pes, np.uint8)
        if n == 1:
            field = bytes([field[0] + spare]) + field[1:] + b"\xff" * spare
            packets[0, 4:] = np.frombuffer(field, np.uint8).tolist() + body.tolist()
        else:
            head = BODY - len(field)
            packets[0, 4:] = np.concatenate([np.frombuffer(field, np.uint8), body[:head]])
            whole = n - 2
            packets[1:-1, 4:] = body[head : head + whole * BODY].reshape(whole, BODY)
            last = body[head + whole * BODY :]
            if spare:
                packets[-1, 3] |= 0x20
                packets[-1, 4] = spare - 1
                packets[-1, 5 : 4 + spare] = 0xFF
                if spare > 1:
                    packets[-1, 5] = 0
            packets[-1, 4 + spare :] = last
        counter = (counter + n) % 16
        out.append(packets.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    payload: bytes
    packets: int
    timestamps: list[int]
    random_access: list[int]
    continuity_errors: int
    stream_type: int
    pid: int


def _section(packet: bytes, table_id: int) -> bytes:
    start = 5 + packet[4]
    length = (packet[start + 1] & 15) << 8 | packet[start + 2]
    section = packet[start : start + 3 + length]
    if section[0] != table_id or crc_mpeg(section):
        raise ValueError("damaged program table")
    return section[8:-4]


def demux(media: bytes) -> Stream:
    """Parse a stream: tables lead to the elementary stream, counters are checked, packets put together again.

    Raises ValueError for lost sync, damaged tables and cut elementary packets; gaps in the continuity counter are counted.
    """
    if len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("lost sync")
    pids = (packets[:, 1] & 31).astype(np.int32) << 8 | packets[:, 2]
    pat = _section(packets[np.flatnonzero(pids == PAT_PID)[0]].tobytes(), 0)
    pmt_pid = (pat[2] & 31) << 8 | pat[3]
    pmt = _section(packets[np.flatnonzero(pids == pmt_pid)[0]].tobytes(), 2)
    skip = 4 + ((pmt[2] & 15) << 8 | pmt[3])
    kind, pid = pmt[skip], (pmt[skip + 1] & 31) << 8 | pmt[skip + 2]
    own = packets[pids == pid]
    counters = (own[:, 3] & 15).astype(np.int32)
    gaps = int((np.diff(counters) % 16 != 1).sum()) if len(own) else 0
    with_field = (own[:, 3] & 0x20) != 0
    start = np.where(with_field, 5 + own[:, 4].astype(np.int32), 4)
    body = own[np.arange(PACKET) >= start[:, None]].tobytes()
    ends = np.cumsum(PACKET - start)
    firsts = np.flatnonzero(own[:, 1] & 0x40)
    begins = (ends - (PACKET - start))[firsts].tolist() + [len(body)]
    random_access = with_field[firsts] & (own[firsts, 5] & 0x40 != 0)
    parts, times, points = [], [], []
    for k, (a, b) in enumerate(zip(begins, begins[1:])):
        pes = body[a:b]
        if pes[:3] != b"\x00\x00\x01" or int.from_bytes(pes[4:6], "big") != len(pes) - 6:
            raise ValueError("cut elementary packet")
        p = pes[9:14]
        pts = (p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1
        times.append(pts)
        if random_access[k]:
            points.append(pts)
        parts.append(pes[9 + pes[8] :])
    return Stream(b"".join(parts), len(packets), times, points, gaps, kind, pid)


def _batches(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
    rows, held = [], 0
    for batch in batches:
        for doc_id, data in zip(batch.column(0), batch.column(1)):
            data = data.as_py() or b""
            media = mux(padded(data))
            rows.append((doc_id.as_py(), len(data), media))
            held += len(media)
            if held >= BATCH_BYTES:
                yield _batches(rows, schema)
                rows, held = [], 0
    if rows:
        yield _batches(rows, schema)


def store_media(docs: DataFrame) -> DataFrame:
    """A media column for documents (doc_id, text): doc_id, n_bytes and media, a transport stream of the padded UTF-8 text.

    Null and empty texts give 576 bytes of value 255. Each row is stored by itself: repeated rows and null ids stay as they are,
    and other columns are not looked at. Equal texts give equal streams. An empty table gives an empty one.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("data"))
    return rows.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, timestamps array<long>, random_access array<long>, continuity_errors int"


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("timestamps", pa.list_(pa.int64())), ("random_access", pa.list_(pa.int64())), ("continuity_errors", pa.int32())])
    for batch in batches:
        rows = []
        for doc_id, n, media in zip(batch.column(0), batch.column(1), batch.column(2)):
            media = media.as_py()
            s = demux(media)
            feature = f"type={s.stream_type:#04x};pid={s.pid:#06x};packets={s.packets};pes={len(s.timestamps)};pts={s.timestamps[0]}-{s.timestamps[-1]};access={len(s.random_access)};gaps={s.continuity_errors}"
            rows.append((doc_id.as_py(), n.as_py(), len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, s.timestamps, s.random_access, s.continuity_errors))
        if rows:
            yield _batches(rows, schema)


def read_media(stored: DataFrame) -> DataFrame:
    """Parse a media column (doc_id, n_bytes, media): digests of payload and stream, timestamps, random-access points and counter gaps.

    A damaged stream raises; that is a fault of the storage and not a property of the text.
    """
    ship(stored.sparkSession)
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_features, FEATURES)
