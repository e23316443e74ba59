"""Media columns: payloads stored in MPEG transport streams and read back.

The writer cuts a payload into access units, wraps each in a packetised elementary stream (PES) packet with a
presentation timestamp, and multiplexes these with program tables into packets of 188 bytes. The parser takes any
such stream: it follows the program association and map tables, checks continuity counters, reassembles the PES
packets of the program's streams and reports timestamps with random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, column

# Fixed values of the format: packet size, sync byte, table identifiers, stream kinds, clock.
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID, PROGRAM = 0x0000, 0x0100, 0x0101, 1
PAT_TABLE, PMT_TABLE = 0x00, 0x02
PRIVATE_DATA, PRIVATE_STREAM = 0x06, 0xBD
CLOCK = 90_000

#: Payload lengths are multiples of BLOCK; a unit holds UNIT blocks at most; every GROUP-th unit is a random-access point.
BLOCK, UNIT, GROUP = 576, 32, 8
#: Timestamp ticks between units.
TICKS = CLOCK // 25


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        crc = byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
        out.append(crc)
    return out


_CRC = _crc_table()


def _crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _CRC[crc >> 24 ^ byte]
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    head = bytes([table, 0xB0 | length >> 8, length & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    return head + _crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return packet + b"\xff" * (PACKET - len(packet))


_PAT = _table_packet(PAT_PID, _section(PAT_TABLE, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(
    PMT_PID,
    _section(
        PMT_TABLE, PROGRAM,
        (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"
        + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00",
    ),
)


def _timestamp(value: int) -> bytes:
    value &= (1 << 33) - 1
    return bytes(
        [0x21 | (value >> 30) << 1, value >> 22 & 255, value >> 14 & 254 | 1, value >> 7 & 255, value << 1 & 254 | 1]
    )


def _clock(value: int) -> bytes:
    """A program clock reference of 90 kHz ticks."""
    value &= (1 << 33) - 1
    return bytes([value >> 25, value >> 17 & 255, value >> 9 & 255, value >> 1 & 255, (value & 1) << 7 | 0x7E, 0])


def _counted(packet: bytes, counter: int) -> bytes:
    return packet[:3] + bytes([packet[3] & 0xF0 | counter & 15]) + packet[4:]


def write_stream(payload: bytes) -> bytes:
    """A transport stream that carries payload as one program with one private data stream."""
    step = UNIT * BLOCK
    out, counter = [], 0
    for unit, at in enumerate(range(0, len(payload), step)):
        part = payload[at : at + step]
        size = len(part) + 8
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM, size >> 8, size & 255, 0x84, 0x80, 5]) + _timestamp(unit * TICKS) + part
        flags, clock = 0, b""
        if unit % GROUP == 0:
            # a reader may start here: tables and the clock come again
            flags, clock = 0x50, _clock(unit * TICKS)
            out += [_counted(_PAT, unit // GROUP), _counted(_PMT, unit // GROUP)]
        # the first packet has an adaptation field with flags; the last is stuffed to its full size
        first = 184 - 2 - len(clock)
        later = -(-max(0, len(pes) - first) // 184)
        packets = np.full((1 + later, PACKET), 0xFF, np.uint8)
        packets[:, 0] = SYNC
        packets[:, 1], packets[:, 2] = DATA_PID >> 8, DATA_PID & 255
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | (counter + np.arange(1 + later)) & 15
        counter += 1 + later
        data = np.frombuffer(pes, np.uint8)
        short = max(0, first - len(data))
        packets[0, 3] |= 0x20
        packets[0, 4], packets[0, 5] = 1 + len(clock) + short, flags
        packets[0, 6 : 6 + len(clock)] = np.frombuffer(clock, np.uint8)
        packets[0, 6 + len(clock) + short :] = data[: first - short]
        rest = data[first - short :]
        whole = len(rest) // 184
        packets[1 : 1 + whole, 4:] = rest[: whole * 184].reshape(whole, 184)
        tail = rest[whole * 184 :]
        if len(tail):
            stuffing = 184 - len(tail)
            packets[-1, 3] |= 0x20
            packets[-1, 4] = stuffing - 1
            if stuffing > 1:
                packets[-1, 5] = 0
            packets[-1, PACKET - len(tail) :] = tail
        out.append(packets.tobytes())
    return b"".join(out)


@dataclass
class Unit:
    pid: int
    pts: int | None
    random_access: bool
    data: bytes


@dataclass
class Stream:
    """What a transport stream holds: programs' streams, units in order, and what was wrong with it."""

    streams: dict[int, int] = field(default_factory=dict)  # pid -> stream kind
    units: list[Unit] = field(default_factory=list)
    clocks: list[int] = field(default_factory=list)  # clock references in 90 kHz ticks
    packets: int = 0
    lost: int = 0  # breaks of continuity
    damaged: int = 0  # bad sync bytes, error flags, bad sections


def _read_section(packet: bytes) -> tuple[int, bytes] | None:
    """(table, body) of the section that a packet's payload begins with; None if it is not whole and sound."""
    at = 4 if packet[3] & 0x20 == 0 else 5 + packet[4]
    if at >= PACKET:
        return None
    at += 1 + packet[at]
    if at + 3 > PACKET:
        return None
    length = (packet[at + 1] & 15) << 8 | packet[at + 2]
    section = packet[at : at + 3 + length]
    if length < 9 or len(section) < 3 + length or _crc32_mpeg(section):
        return None
    return section[0], section[8:-4]


def _read_pes(pid: int, data: bytes, random_access: bool) -> Unit | None:
    if len(data) < 9 or data[:3] != b"\x00\x00\x01":
        return None
    size, head = data[4] << 8 | data[5], 9 + data[8]
    pts = None
    if data[7] & 0x80 and len(data) >= 14:
        t = data[9:14]
        pts = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1
    return Unit(pid, pts, random_access, data[head : 6 + size] if size else data[head:])


def read_stream(media: bytes) -> Stream:
    """Parses a transport stream. Damage is counted and skipped, not raised; a part of a packet at the end is damage."""
    found = Stream(packets=len(media) // PACKET)
    found.damaged += len(media) % PACKET > 0
    grid = np.frombuffer(media, np.uint8)[: found.packets * PACKET].reshape(-1, PACKET)
    sound = (grid[:, 0] == SYNC) & (grid[:, 1] & 0x80 == 0)
    found.damaged += int((~sound).sum())
    pids = (grid[:, 1].astype(np.int64) & 31) << 8 | grid[:, 2]
    control, cc = grid[:, 3] >> 4 & 3, grid[:, 3] & 15
    for c in grid[sound & (control >= 2) & (grid[:, 4] >= 7) & (grid[:, 4] <= PACKET - 5) & (grid[:, 5] & 0x10 > 0)][:, 6:11].astype(np.int64):
        found.clocks.append(int(c[0] << 25 | c[1] << 17 | c[2] << 9 | c[3] << 1 | c[4] >> 7))
    maps: set[int] = set()
    for i in np.flatnonzero(sound & (pids == PAT_PID) & (grid[:, 1] & 0x40 > 0) & (control & 1 > 0)):
        packet = grid[i].tobytes()
        section = _read_section(packet)
        if section is None or section[0] != PAT_TABLE:
            found.damaged += 1
            continue
        maps |= {(b[2] & 31) << 8 | b[3] for k in range(0, len(section[1]) - 3, 4) if any((b := section[1][k : k + 4])[:2])}
    for i in np.flatnonzero(sound & np.isin(pids, sorted(maps)) & (grid[:, 1] & 0x40 > 0) & (control & 1 > 0)):
        packet = grid[i].tobytes()
        section = _read_section(packet)
        if section is None or section[0] != PMT_TABLE or len(section[1]) < 4:
            found.damaged += 1
            continue
        body = section[1]
        k = 4 + ((body[2] & 15) << 8 | body[3])
        while k + 5 <= len(body):
            found.streams[(body[k + 1] & 31) << 8 | body[k + 2]] = body[k]
            k += 5 + ((body[k + 3] & 15) << 8 | body[k + 4])
    units: list[tuple[int, Unit]] = []
    for pid in found.streams:
        rows = np.flatnonzero(sound & (pids == pid) & (control & 1 > 0))
        if not len(rows):
            continue
        # a packet may come twice, and a discontinuity may be announced
        step = (cc[rows][1:] - cc[rows][:-1]) & 15
        told = (control[rows] == 3) & (grid[rows, 4] > 0) & (grid[rows, 5] & 0x80 > 0)
        twice = np.append(False, (step == 0) & (grid[rows[1:], 4:] == grid[rows[:-1], 4:]).all(axis=1))
        broken = np.append(False, (step != 1) & ~told[1:]) & ~twice
        found.lost += int(broken.sum())
        broken = broken[~twice]
        rows = rows[~twice]
        adapted = control[rows] == 3
        begin = np.where(adapted, np.minimum(5 + grid[rows, 4].astype(np.int64), PACKET), 4)
        keep = np.arange(PACKET) >= begin[:, None]
        flat = grid[rows][keep]
        ends = np.cumsum(PACKET - begin)
        heads = np.flatnonzero(grid[rows, 1] & 0x40)
        bounds = [*(int(ends[h] - (PACKET - begin[h])) for h in heads), int(ends[-1])]
        for n, h in enumerate(heads):
            ready = bool(adapted[h] and grid[rows[h], 4] > 0 and grid[rows[h], 5] & 0x40)
            unit = _read_pes(pid, flat[bounds[n] : bounds[n + 1]].tobytes(), ready)
            # a unit that misses a packet is not whole
            if unit is None or broken[h + 1 : heads[n + 1] if n + 1 < len(heads) else len(rows)].any():
                found.damaged += 1
            else:
                units.append((int(rows[h]), unit))
    found.units = [u for _, u in sorted(units, key=lambda x: x[0])]
    return found


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 and bytes 255 up to a positive multiple of BLOCK; and the unpadded length."""
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw)), len(raw)


def describe(found: Stream) -> str:
    """Streams, units, timestamps and random-access points in one line."""
    stamps = [u.pts for u in found.units if u.pts is not None]
    ready = [u.pts for u in found.units if u.random_access and u.pts is not None]
    digest = zlib.crc32(np.array(ready, np.int64).tobytes())
    return (
        f"streams={','.join(f'{p:#x}:{k:#x}' for p, k in sorted(found.streams.items()))};packets={found.packets};"
        f"units={len(found.units)};pts={min(stamps, default='')}-{max(stamps, default='')};rap={len(ready)}:{digest:08x};"
        f"pcr={len(found.clocks)};lost={found.lost};damaged={found.damaged}"
    )


_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = column(batch, "doc_id"), column(batch, "text")
        size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < len(ids):
            # streams of a step have a bound in bytes; a longer text is a step of its own
            most = int(np.searchsorted(size, (size[low - 1] if low else 0) + STEP_BYTES, side="right"))
            high = min(max(low + 1, most), low + 256)
            rows = [padded(texts[d].as_py()) for d in range(low, high)]
            media = pa.array([write_stream(p) for p, _ in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([ids.slice(low, high - low), pa.array([n for _, n in rows], pa.int64()), media], schema=_MEDIA)
            low = high


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary transport stream): one row for each row of docs (doc_id long, text string).

    A null text counts as empty; its payload is one block of padding. Equal texts give equal streams. Rows that
    repeat a doc_id or have none stay rows of their own. Other columns are ignored. Empty tables give empty ones.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_write, "doc_id long, n_bytes long, media binary")


_FEATURES = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
        ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
        ("pts", pa.list_(pa.int64())), ("random_access", pa.list_(pa.int64())),
    ]
)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, n, media in zip(*(column(batch, c) for c in ("doc_id", "n_bytes", "media"))):
            media = media.as_py() or b""
            found = read_stream(media)
            payload = b"".join(u.data for u in found.units)
            rows.append(
                (
                    doc_id.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]),
                    len(media), hashlib.sha256(media).hexdigest(), describe(found),
                    [u.pts for u in found.units], [u.pts for u in found.units if u.random_access],
                )
            )
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _FEATURES)], schema=_FEATURES)


def media_features(media: DataFrame) -> DataFrame:
    """One row for each row of media (doc_id, n_bytes long, media binary), read back: payload and stream digests, a feature
    line, the timestamps and those of random-access points.

    A null stream counts as an empty one: no packets, units or streams, and the digests of nothing. Damage is counted in
    the feature line. Repeated rows stay rows of their own, equal streams give equal values; other columns are ignored
    and an empty table gives an empty one.
    """
    kinds = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string, pts array<long>, random_access array<long>"
    )
    return media.mapInArrow(_read, kinds)
