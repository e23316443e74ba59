"""Transport streams: no bytes raise, readers may start at any random-access point, and a writer of another make is read."""

import random
import zlib

import pytest

from strandlake.llm import transport_stream as ts


def payload(n):
    return bytes(random.Random(n).randrange(256) for _ in range(n)) + b"\xff" * (-n % ts.BLOCK or (0 if n else ts.BLOCK))


def test_fuzz():
    """Flipped, cut and inserted bytes, and packets dealt anew, are damage or loss, never an exception."""
    rng = random.Random(4)
    media = ts.write_stream(payload(20_000))
    for _ in range(1500):
        raw = bytearray(media[: rng.randrange(len(media))] if rng.random() < 0.3 else media)
        for _ in range(rng.choice([1, 3, 30])):
            if raw:
                # often in a header or a table
                at = rng.randrange(len(raw)) if rng.random() < 0.4 else min(len(raw) - 1, rng.randrange(0, 4) * 188 + rng.randrange(30))
                raw[at] = rng.randrange(256)
        ts.describe(ts.read_stream(bytes(raw)))
    for n in (0, 1, 187, 188, 189, 1000):
        ts.describe(ts.read_stream(bytes(rng.randrange(256) for _ in range(n))))


def table(pid, kind, number, body, adaptation=None):
    packet = bytearray(ts._table_packet(pid, ts._section(kind, number, body)))
    if adaptation is not None:
        packet[3] |= 0x20
        packet[4] = adaptation
    return bytes(packet)


def test_short_tables_and_long_adaptation_fields():
    first = (ts.PROGRAM).to_bytes(2, "big") + (0xE000 | ts.PMT_PID).to_bytes(2, "big")
    sound = table(ts.PAT_PID, ts.PAT_TABLE, 1, first)
    for length in (183, 184, 200, 255):
        found = ts.read_stream(table(ts.PAT_PID, ts.PAT_TABLE, 1, first, length) + table(ts.PMT_PID, ts.PMT_TABLE, 1, b""))
        assert found.damaged == 1 and not found.streams
    for body in (b"", b"\xe0", b"\xe1\x00\xf0"):
        found = ts.read_stream(sound + table(ts.PMT_PID, ts.PMT_TABLE, ts.PROGRAM, body))
        assert found.damaged == 1 and not found.streams


@pytest.mark.parametrize("n", [0, 576, 60_000, 300_000])
def test_start_anywhere(n):
    data = payload(n)
    media = ts.write_stream(data)
    whole = ts.read_stream(media)
    assert b"".join(u.data for u in whole.units) == data and not whole.damaged and not whole.lost
    tables = [k for k in range(0, len(media), 188) if media[k + 1] & 0x1F == 0 and media[k + 2] == ts.PAT_PID]
    ready = [u.pts for u in whole.units if u.random_access]
    assert len(tables) == len(ready) == len(whole.clocks) and whole.clocks == ready
    for at, pts in zip(tables, ready):
        late = ts.read_stream(media[at:])
        assert late.streams == whole.streams and late.units == [u for u in whole.units if u.pts >= pts]


def other_writer(units):
    """Packets byte by byte as the standard has them: another pid, sizes of 0, stuffing in every packet, no clock."""
    pid, out, count = 0x1ABC, [], 0
    pat = bytes([0, 0xB0, 13, 0, 1, 0xC1, 0, 0, 0, 9, 0xE0 | 0x12, 0x34])
    pmt = bytes([2, 0xB0, 18, 0, 9, 0xC1, 0, 0, 0xE0 | pid >> 8, pid & 255, 0xF0, 0, 6, 0xE0 | pid >> 8, pid & 255, 0xF0, 0])

    def crc(data):
        value = 0xFFFFFFFF
        for byte in data:
            for bit in range(7, -1, -1):
                top = value >> 31 ^ byte >> bit & 1
                value = value << 1 & 0xFFFFFFFF ^ (0x04C11DB7 if top else 0)
        return value.to_bytes(4, "big")

    for where, section in ((0, pat), (0x1234, pmt)):
        body = b"\x00" + section + crc(section)
        out.append(bytes([0x47, 0x40 | where >> 8, where & 255, 0x10]) + body + b"\xff" * (184 - len(body)))
    for pts, data in units:
        stamp = [0x21 | pts >> 29 & 14, pts >> 22 & 255, pts >> 14 & 254 | 1, pts >> 7 & 255, pts << 1 & 254 | 1]
        pes = b"\x00\x00\x01\xbd\x00\x00\x84\x80\x05" + bytes(stamp) + data
        for k in range(0, len(pes), 100):
            part = pes[k : k + 100]
            fill = 184 - len(part) - 1
            out.append(bytes([0x47, (0x40 if k == 0 else 0) | pid >> 8, pid & 255, 0x30 | count & 15, fill, 0]) + b"\xff" * (fill - 1) + part)
            count += 1
    return b"".join(out)


def test_other_writer():
    units = [(90_000 * k, bytes([k]) * (50 + 77 * k)) for k in range(9)]
    found = ts.read_stream(other_writer(units))
    assert found.streams == {0x1ABC: 6} and not found.damaged and not found.lost
    assert [(u.pts, zlib.crc32(u.data)) for u in found.units] == [(p, zlib.crc32(d)) for p, d in units]
