"""Streams made by hand, packet by packet, against a plain second parser."""

import random

import brute
import pytest

from tallymill.llm import transport_stream as ts


def packet(pid, cc, data=None, start=False, field=None, error=False):
    """One packet; ``field`` is what an adaptation field holds (flags first), stuffing fills the rest."""
    head = bytes([0x47, 0x80 * error | 0x40 * start | pid >> 8, pid & 255])
    if data is None:
        field = field or b"\x00"
        return head + bytes([0x20 | cc, 183]) + field + b"\xff" * (183 - len(field))
    if len(data) == 184 and field is None:
        return head + bytes([0x10 | cc]) + data
    field = field or b""
    room = 183 - len(data)
    body = (field or b"\x00") + b"\xff" * (room - max(1, len(field))) if room else b""
    return head + bytes([0x30 | cc, room]) + body + data


def section(table_id, number, body, part=0, last=0, version=0, current=1):
    head = bytes([table_id, 0xB0 | len(body) + 9 >> 8, len(body) + 9 & 255]) + number.to_bytes(2, "big") + bytes([0xC0 | version << 1 | current, part, last]) + body
    return head + brute.crc_mpeg(head).to_bytes(4, "big")


def pat(programs):
    return b"".join(n.to_bytes(2, "big") + (0xE000 | p).to_bytes(2, "big") for n, p in programs)


def pmt(streams, info=b""):
    listed = b"".join(bytes([t]) + (0xE000 | p).to_bytes(2, "big") + (0xF000 | len(d)).to_bytes(2, "big") + d for p, t, d in streams)
    return (0xE000 | 0x1FFF).to_bytes(2, "big") + (0xF000 | len(info)).to_bytes(2, "big") + info + listed


def in_packets(pid, sections, cc=0):
    """Sections one after the other, over as many packets as it takes."""
    data, out, begins = b"".join(sections), [], [sum(map(len, sections[:k])) for k in range(len(sections))]
    at = 0
    while at < len(data):
        first = next((b for b in begins if at <= b < at + (184 if b != at else 183)), None)
        room = 184 if first is None else 183
        if first is not None and first - at > 183 - 1:
            first, room = None, 184
        chunk = data[at : at + room]
        body = (bytes([first - at]) if first is not None else b"") + chunk
        out.append(packet(pid, cc % 16, body.ljust(184, b"\xff"), start=first is not None))
        at += len(chunk)
        cc += 1
    return out


def pes(data, pts=None, stream_id=0xBD, length=True):
    if stream_id in ts.PLAIN_IDS:
        return b"\x00\x00\x01" + bytes([stream_id]) + len(data).to_bytes(2, "big") + data
    stamp = b"" if pts is None else bytes([0x21 | pts >> 29 & 14, pts >> 22 & 255, 1 | pts >> 14 & 254, pts >> 7 & 255, 1 | pts << 1 & 254])
    head = bytes([0x80, 0x80 if stamp else 0, len(stamp)]) + stamp
    return b"\x00\x00\x01" + bytes([stream_id]) + ((len(head) + len(data)) if length else 0).to_bytes(2, "big") + head + data


def unit(pid, data, cc, field=None):
    """The packets of an elementary packet, and the next counter."""
    out, first = [], True
    while data or first:
        room = 184 if field is None or not first else 183 - len(field)
        part, data = data[:room], data[room:]
        out.append(packet(pid, cc % 16, part, first, field if first else None))
        cc, first = cc + 1, False
    return out, cc


TABLES = [*in_packets(0, [section(0, 1, pat([(0, 0x10), (7, 0x100), (9, 0x200)]))]), *in_packets(0x100, [section(2, 7, pmt([(0x101, 0x1B, b"\x0a\x04eng\x00"), (0x102, 0x0F, b"")], b"\x05\x04HDMV"))]), *in_packets(0x200, [section(2, 9, pmt([(0x201, 6, b"")]))])]


def agree(media):
    got = ts.demux_bytes(media)
    payload, times, points, errors, program, kind = brute.transport(media)
    assert (got["payload"], got["timestamps"], [(p["packet"], p["pts"]) for p in got["random_access"]], got["continuity_errors"], got["program"], got["stream_type"]) == (payload, times, points, errors, program, kind)
    return got


def stream(units, tables=TABLES, pid=0x101, cc=3):
    out = list(tables)
    for data, field in units:
        made, cc = unit(pid, data, cc, field)
        out += made
    return out


def test_several_programs_streams_and_descriptors():
    data = [bytes([k]) * (100 + 300 * k) for k in range(5)]
    packets = stream([(pes(x, 900 * k, 0xE0), b"\x40" if k % 2 == 0 else None) for k, x in enumerate(data)])
    other, _ = unit(0x102, pes(b"sound" * 50, 77, 0xC0), 0)
    third, _ = unit(0x201, pes(b"private" * 90, None, 0xBD), 9)
    mixed = packets[:6] + other + third + packets[6:]
    got = agree(b"".join(mixed))
    assert got["payload"] == b"".join(data) and got["timestamps"] == [0, 900, 1800, 2700, 3600] and len(got["random_access"]) == 3
    assert got["streams"] == [{"program": 7, "pid": 0x101, "stream_type": 0x1B}, {"program": 7, "pid": 0x102, "stream_type": 0x0F}, {"program": 9, "pid": 0x201, "stream_type": 6}]
    assert ts.demux_bytes(b"".join(mixed), pid=0x102)["payload"] == b"sound" * 50
    nine = ts.demux_bytes(b"".join(mixed), program=9)
    assert nine["payload"] == b"private" * 90 and nine["timestamps"] == []
    with pytest.raises(ValueError, match="no such"):
        ts.demux_bytes(b"".join(mixed), pid=0x300)


def test_length_zero_and_every_stream_id():
    data = bytes(range(256)) * 157
    got = agree(b"".join(stream([(pes(data[:40_320], 5, 0xE0, length=False), None), (pes(b"next", 9, 0xE0, length=False), None)])))
    assert got["payload"] == data[:40_320] + b"next" and got["damaged_units"] == 0
    for stream_id in (0xBC, 0xBD, 0xBE, 0xBF, 0xC0, 0xDF, 0xE0, 0xEF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFD, 0xFF):
        got = agree(b"".join(stream([(pes(b"abc" * 200, None, stream_id), None)])))
        assert got["payload"] == b"abc" * 200 and got["damaged_units"] == 0


def test_repeated_packets_and_packets_without_payload():
    packets = stream([(pes(bytes([k]) * 700, k, 0xE0), None) for k in range(4)])
    n = len(TABLES)
    twice = packets[: n + 2] + [packets[n + 1]] + packets[n + 2 :]
    assert agree(b"".join(twice))["continuity_errors"] == 0 and agree(b"".join(twice))["payload"] == b"".join(bytes([k]) * 700 for k in range(4))
    still = packets[: n + 2] + [packet(0x101, packets[n + 1][3] & 15)] * 3 + packets[n + 2 :]
    assert agree(b"".join(still))["continuity_errors"] == 0 and agree(b"".join(still))["payload"] == agree(b"".join(packets))["payload"]
    thrice = packets[: n + 2] + [packets[n + 1]] * 2 + packets[n + 2 :]
    assert ts.demux_bytes(b"".join(thrice))["continuity_errors"] == 1 and ts.demux_bytes(b"".join(thrice))["payload"] == agree(b"".join(packets))["payload"]
    points = packets[:n] + [packet(0x101, 2, None, field=b"\x40")] + packets[n:]
    assert ts.demux_bytes(b"".join(points))["random_access"] == [{"packet": n, "pts": 0}]


def test_gaps_and_announced_ones_and_the_error_flag():
    packets = stream([(pes(bytes([k]) * 700, k, 0xE0), None) for k in range(4)])
    n = len(TABLES)
    lost = packets[: n + 1] + packets[n + 2 :]
    got = agree(b"".join(lost))
    assert got["continuity_errors"] == 1 and got["damaged_units"] == 1 and len(got["payload"]) < 2800
    said = [*stream([(pes(b"a" * 300, 1, 0xE0), None)], cc=3), *stream([(pes(b"b" * 300, 2, 0xE0), b"\x80")], [], cc=11)]
    assert agree(b"".join(said))["continuity_errors"] == 0 and agree(b"".join(said))["payload"] == b"a" * 300 + b"b" * 300
    bad = bytearray(packets[n + 1])
    bad[1] |= 0x80
    got = agree(b"".join([*packets[: n + 1], bytes(bad), *packets[n + 2 :]]))
    assert got["transport_errors"] == 1 and got["continuity_errors"] == 1
    noise = [*packets[:n], packet(0x1FFF, 0, b"\x00" * 184), packet(0x101, 9, b"x" * 184, error=True), *packets[n:]]
    assert agree(b"".join(noise))["payload"] == agree(b"".join(packets))["payload"]


def test_a_stream_that_is_joined_late():
    packets = stream([(pes(bytes([k]) * 700, k, 0xE0), None) for k in range(3)])
    n = len(TABLES)
    got = agree(b"".join(packets[:n] + packets[n + 1 :]))
    assert got["payload"] == b"\x01" * 700 + b"\x02" * 700


def test_sections_over_packets_and_damaged_tables():
    many = [(k, 0x20 + k) for k in range(1, 100)]
    wide = in_packets(0, [section(0, 1, pat(many[:60]), 0, 1), section(0, 1, pat([*many[60:], (500, 0x100)]), 1, 1)])
    maps = in_packets(0x100, [section(2, 499, pmt([(0x300, 1, b"")])), section(2, 500, pmt([(0x101, 0x1B, b"\x0a" + bytes([250]) + b"d" * 250)], b"\x05\x04HDMV"))])
    media = stream([(pes(b"data" * 99, 4, 0xE0), None)], [*wide, *maps])
    assert len(wide) > 2 and len(maps) > 1
    assert agree(b"".join(media))["payload"] == b"data" * 99 and agree(b"".join(media))["program"] == 500
    # the first copy of the table is damaged, a later one is not; a table for later is passed over
    bad = bytearray(TABLES[0])
    bad[15] ^= 1
    later = in_packets(0, [section(0, 1, pat([(3, 0x55)]), current=0)], 1)
    again = [packet(0, 2, TABLES[0][4:], True)]
    got = ts.demux_bytes(b"".join([bytes(bad), *later, *again, *TABLES[1:], *stream([(pes(b"z", 1, 0xE0), None)], [])]))
    assert got["payload"] == b"z" and got["program"] == 7
    for broken, why in (([bytes(bad), *TABLES[1:]], "association"), (TABLES[:1], "map"), ([packet(0x50, 0, b"x" * 184)], "association")):
        assert why in ts.demux_row(b"".join(broken))["error"]


def test_damaged_units():
    packets = stream([(b"\x00\x00\x02" + b"junk" * 80, None), (pes(b"good" * 99, 4, 0xE0), None), (pes(b"short" * 99, 5, 0xE0)[:200], None), (b"\x00\x00\x01\xe0\x00\x00\x00\x00", None)])
    got = ts.demux_bytes(b"".join(packets))
    assert got["damaged_units"] == 3 and got["payload"].startswith(b"good" * 99) and got["timestamps"] == [4, 5]


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 9215, 9216, 50_000, 200_000])
def test_own_streams_by_the_plain_parser(n):
    data = random.Random(n).randbytes(n)
    media = ts.mux_bytes(ts.padded(data))
    got = agree(media)
    line = ts.digest_row(1, n, got)
    payload, times, points, errors, program, kind = brute.transport(media)
    assert payload == ts.padded(data) and line["media_bytes"] == len(media)
    assert line["feature"] == f"program={program};type={kind};packets={len(media) // 188};cc_errors={errors};units={len(times)};rap={len(points)};last_pts={times[-1]}"


def test_random_streams():
    rng = random.Random(12)
    for _ in range(60):
        units = [(pes(rng.randbytes(rng.randrange(0, 900)), rng.choice([None, rng.randrange(1 << 33)]), rng.choice([0xBD, 0xC0, 0xE0, 0xBF]), rng.random() < 0.7), rng.choice([None, b"\x40", b"\x00"])) for _ in range(rng.randrange(1, 6))]
        packets = stream(units)
        out = list(TABLES)
        for p in packets[len(TABLES) :]:
            out.append(p)
            if rng.random() < 0.1:
                out.append(p)
            if rng.random() < 0.1:
                out.append(packet(0x101, p[3] & 15))
            if rng.random() < 0.1:
                out.append(packet(0x1FFF, 0, rng.randbytes(184)))
        agree(b"".join(out))


def test_columns_of_the_operator(spark, docs):
    made = ts.mux(docs([(1, "a text"), (2, None)]))
    rows = {r["doc_id"]: r for r in ts.demux(made).collect()}
    assert bytes(rows[1]["payload"]) == ts.padded(b"a text") and rows[1]["streams"][0]["pid"] == ts.ES_PID and rows[2]["damaged_units"] == 0 and rows[1]["error"] is None
