"""MPEG transport streams as a media column.

``mux`` turns payload bytes into a transport stream: a program association
table, a program map table, then elementary packets of private data with
presentation times, clock references and random-access flags. ``demux`` parses
the program tables of stored streams (several programs and streams, sections over
several packets), checks continuity counters (repeated packets, packets without
payload, announced discontinuities and the error flag as the format has them),
reassembles the elementary packets of any stream id, also those of open length, and
gives payload, timestamps and random-access points of the first stream.
Both work on one row at a time; nothing is shuffled.

``round_trip`` does both and gives checksums, in one pass.

Null or empty text: a payload of padding alone. A stream that does not parse:
``error`` says why and the other columns are null (null media: "no media").
Equal texts give equal streams. Batches are cut by bytes, so many long texts in a
row are not held together; one very long text is held whole, with its stream. A null
doc_id stays null; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

PACKET, SYNC, HZ = 188, 0x47, 90_000
BLOCK = 576
UNIT = 16 * BLOCK
PMT_PID, ES_PID, PRIVATE_DATA = 0x1000, 0x0100, 0x06
NULL_PID = 0x1FFF
# Stream ids whose packets have no header beyond their length.
PLAIN_IDS = (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)
FRAME_TICKS = HZ // 25
RANDOM_ACCESS_EVERY = 4
#: Bytes of texts or streams that a task holds at once, beyond one row.
SLICE = 8 << 20

MUX_SCHEMA = "doc_id long, n_bytes long, media binary"
DEMUX_SCHEMA = (
    "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, program int, stream_type int, "
    "packets long, continuity_errors long, damaged_units long, transport_errors long, timestamps array<long>, random_access array<struct<packet:long,pts:long>>, "
    "streams array<struct<program:int,pid:int,stream_type:int>>, error string"
)


def padded(data: bytes) -> bytes:
    """``data`` and bytes 255 up to a positive multiple of 576."""
    short = -len(data) % BLOCK if data else BLOCK
    return data + b"\xff" * short


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _table(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    """One packet with a section of a program table."""
    head = bytes([table_id, 0xB0, len(body) + 9]) + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    section = b"\x00" + head + section_crc(head).to_bytes(4, "big")
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10]) + section).ljust(PACKET, b"\xff")


_TABLES = _table(0, 0x00, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")) + _table(
    PMT_PID, 0x02, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"
)


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 255, 0x01 | pts << 1 & 0xFE])


def mux_bytes(payload: bytes) -> bytes:
    out = [_TABLES]
    cc = 0
    for unit, at in enumerate(range(0, len(payload), UNIT)):
        data = payload[at : at + UNIT]
        pts = unit * FRAME_TICKS
        pes = b"\x00\x00\x01\xbd" + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts_bytes(pts) + data
        flags = 0x10 | 0x40 * (unit % RANDOM_ACCESS_EVERY == 0)
        clock = bytes([7, flags, pts >> 25 & 255, pts >> 17 & 255, pts >> 9 & 255, pts >> 1 & 255, (pts & 1) << 7 | 0x7E, 0])
        # the first packet carries the clock; a unit is longer than one packet
        out.append(bytes([SYNC, 0x40 | ES_PID >> 8, ES_PID & 255, 0x30 | cc]) + clock + pes[:176])
        middle = (len(pes) - 176) // 184
        packets = np.empty((middle, PACKET), np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
        packets[:, 3] = 0x10 | (np.arange(cc + 1, cc + 1 + middle) & 15)
        packets[:, 4:] = np.frombuffer(pes, np.uint8, middle * 184, 176).reshape(middle, 184)
        out.append(packets.tobytes())
        cc = cc + 1 + middle & 15
        if rest := pes[176 + middle * 184 :]:
            stuffing = 183 - len(rest)
            field = b"" if stuffing < 1 else b"\x00" + b"\xff" * (stuffing - 1)
            out.append(bytes([SYNC, ES_PID >> 8, ES_PID & 255, 0x30 | cc, stuffing]) + field + rest)
            cc = cc + 1 & 15
    return b"".join(out)


class _Packets:
    """A stream's packets as columns; ``ok`` are those that count: without the error flag, with a payload or an adaptation field."""

    def __init__(self, media: bytes):
        if not media or len(media) % PACKET:
            raise ValueError("not whole packets")
        self.a = a = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
        if (a[:, 0] != SYNC).any():
            raise ValueError("sync byte missing")
        self.pid = (a[:, 1].astype(np.int32) & 0x1F) << 8 | a[:, 2]
        adapted = a[:, 3] & 0x20 > 0
        self.solid = a[:, 3] & 0x10 > 0
        self.ok = (a[:, 1] & 0x80 == 0) & (adapted | self.solid) & (self.pid != NULL_PID)
        self.errors = int((a[:, 1] & 0x80 > 0).sum())
        self.begin = np.where(adapted, np.minimum(PACKET, 5 + a[:, 4].astype(np.int64)), 4)
        flags = np.where(adapted & (a[:, 4] > 0), a[:, 5], 0)
        self.broken, self.access = flags & 0x80 > 0, flags & 0x40 > 0

    def of(self, pid: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a pid: its packets that count, less repeated ones; which of them have a payload; and which follow a gap.

        The counter goes up by one with each payload and stays without one. A packet may come twice in a row. An
        announced discontinuity is no gap.
        """
        at = np.flatnonzero(self.ok & (self.pid == pid))
        solid = at[self.solid[at]]
        same = np.flatnonzero((np.diff(self.a[solid, 3].astype(np.int16)) & 15) == 0) + 1
        again = [k for k in same.tolist() if np.array_equal(self.payload(solid[k]), self.payload(solid[k - 1]))]
        thrice = set(again) & {k + 1 for k in again}
        kept = np.delete(solid, again)
        gap = np.zeros(len(kept), bool)
        gap[1:] = ((np.diff(self.a[kept, 3].astype(np.int16)) & 15) != 1) & ~self.broken[kept[1:]]
        self.repeats = len(thrice)
        drop = set(solid[again].tolist())
        return at[[x not in drop for x in at.tolist()]] if drop else at, kept, gap

    def payload(self, k: int) -> np.ndarray:
        return self.a[k, self.begin[k] :]


def _sections(packets: _Packets, pid: int, table_id: int, number: int | None = None) -> list[bytes] | None:
    """The bodies of the sections of a table (of a ``number``), in order, of its first version that comes whole; null without any."""
    _, solid, gap = packets.of(pid)
    found: dict[int, dict[int, bytes]] = {}
    held: bytes | None = None
    for k, after_gap in zip(solid.tolist(), gap.tolist(), strict=True):
        data = packets.payload(k).tobytes()
        if after_gap:
            held = None
        if packets.a[k, 1] & 0x40 and data:
            ends = [(held + data[1 : 1 + data[0]]) if held is not None else b"", data[1 + data[0] :]]
        else:
            ends = [held + data] if held is not None else []
        for held in ends:
            while len(held) >= 3 and held[0] != 0xFF and len(held) >= (size := 3 + ((held[1] & 0x0F) << 8 | held[2])):
                section, held = held[:size], held[size:]
                if section[0] == table_id and size >= 12 and section[5] & 1 and number in (None, int.from_bytes(section[3:5], "big")) and not section_crc(section):
                    own = found.setdefault(section[5] >> 1 & 31, {})
                    own[section[6]] = section[8:-4]
                    if len(own) == section[7] + 1:
                        return [own[n] for n in sorted(own)]
    return None


def programs(packets: _Packets) -> list[dict]:
    """program, pmt_pid and streams (pid, stream_type) of each program; a program whose map does not come whole has null streams."""
    table = _sections(packets, 0, 0x00)
    if table is None:
        raise ValueError("no whole program association table")
    out = []
    for body in table:
        for k in range(0, len(body) - 3, 4):
            program, pid = int.from_bytes(body[k : k + 2], "big"), int.from_bytes(body[k + 2 : k + 4], "big") & 0x1FFF
            if not program:  # the network's table
                continue
            maps = _sections(packets, pid, 0x02, program)
            streams = None if maps is None else []
            for m in maps or []:
                at = 4 + ((m[2] & 0x0F) << 8 | m[3])
                while at + 5 <= len(m):
                    streams.append((int.from_bytes(m[at + 1 : at + 3], "big") & 0x1FFF, m[at]))
                    at += 5 + ((m[at + 3] & 0x0F) << 8 | m[at + 4])
            out.append({"program": program, "pmt_pid": pid, "streams": streams})
    return out


def _time(head: bytes) -> int:
    return (head[0] & 0x0E) << 29 | head[1] << 22 | (head[2] & 0xFE) << 14 | head[3] << 7 | head[4] >> 1


def unit_data(unit: bytes) -> tuple[bytes, int | None, bool]:
    """Data, presentation time (null without one) and soundness of an elementary packet; one of length 0 goes to its end."""
    if len(unit) < 6 or unit[:3] != b"\x00\x00\x01":
        return b"", None, False
    size, at, time = int.from_bytes(unit[4:6], "big"), 6, None
    if unit[3] not in PLAIN_IDS:
        if len(unit) < 9 or unit[6] & 0xC0 != 0x80:
            return b"", None, False
        at = 9 + unit[8]
        if unit[7] & 0x80:
            if unit[8] < 5 or len(unit) < 14:
                return b"", None, False
            time = _time(unit[9:14])
    end = 6 + size if size else len(unit)
    return unit[at:end], time, at <= end <= len(unit)


def elementary(packets: _Packets, pid: int) -> dict:
    """Payload, timestamps and random-access points of an elementary stream, with its faults.

    What comes before its first unit, and units that do not begin as one, are left out. A unit with a gap in it keeps what it has.
    """
    at, solid, gap = packets.of(pid)
    repeats = packets.repeats
    rows, begin = packets.a[solid], packets.begin[solid]
    data = rows[np.arange(PACKET) >= begin[:, None]].tobytes()
    offset = np.concatenate([[0], np.cumsum(PACKET - begin)])
    starts = np.flatnonzero(rows[:, 1] & 0x40)
    ends = [*offset[starts[1:]].tolist(), len(data)]
    parts, times, damaged = [], [], 0
    time_of: list[int | None] = []
    for k, end in zip(starts.tolist(), ends, strict=False):
        part, time, sound = unit_data(data[int(offset[k]) : end])
        parts.append(part)
        time_of.append(time)
        damaged += not sound
        if time is not None:
            times.append(time)
    points = []
    for k in at[packets.access[at]].tolist():  # a point is the next unit that begins
        n = int(np.searchsorted(solid[starts], k))
        if n < len(time_of) and time_of[n] is not None and not any(p["pts"] == time_of[n] for p in points[-1:]):
            points.append({"packet": int(k), "pts": time_of[n]})
    return {"payload": b"".join(parts), "timestamps": times, "random_access": points, "units": len(parts), "continuity_errors": int(gap.sum()) + repeats, "damaged_units": damaged}


def demux_bytes(media: bytes, program: int | None = None, pid: int | None = None) -> dict:
    """What one elementary stream of a transport stream holds: by default the first one of the first program that has any."""
    packets = _Packets(media)
    every = programs(packets)
    if not every:
        raise ValueError("no program")
    if all(p["streams"] is None for p in every):
        raise ValueError("no whole program map table")
    streams = [(p["program"], s, kind) for p in every for s, kind in p["streams"] or []]
    found = [x for x in streams if program in (None, x[0]) and pid in (None, x[1])]
    if not found:
        raise ValueError("no such elementary stream")
    number, own, kind = found[0]
    return elementary(packets, own) | {
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "program": number, "stream_type": kind, "packets": len(packets.a), "transport_errors": packets.errors,
        "streams": [{"program": n, "pid": s, "stream_type": t} for n, s, t in streams], "error": None,
    }


def slices(batch, column: int):
    """Consecutive parts of a batch with about ``SLICE`` bytes in the column."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def mux(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the text as a stored transport stream."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                data = [(t or "").encode("utf-8", "replace") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array([len(d) for d in data], pa.int64()), pa.array([mux_bytes(padded(d)) for d in data], pa.binary())], ["doc_id", "n_bytes", "media"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, MUX_SCHEMA)


def demux_row(media: bytes | None) -> dict:
    try:
        if media is None:
            raise ValueError("no media")
        return demux_bytes(media)
    except (ValueError, IndexError) as e:
        return {"payload": None, "error": str(e) or "damaged stream"}


def demux(media: DataFrame) -> DataFrame:
    """Payload, timestamps, random-access points and checks of each stored stream (doc_id, n_bytes, media)."""
    fields = ["payload", "media_bytes", "media_sha256", "program", "stream_type", "packets", "continuity_errors", "damaged_units", "transport_errors", "timestamps", "random_access", "streams", "error"]
    types = [
        pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()),
        pa.list_(pa.struct([("packet", pa.int64()), ("pts", pa.int64())])), pa.list_(pa.struct([("program", pa.int32()), ("pid", pa.int32()), ("stream_type", pa.int32())])), pa.string(),
    ]

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2):
                rows = [demux_row(m) for m in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([r.get(f) for r in rows], t) for f, t in zip(fields, types, strict=True))], ["doc_id", "n_bytes", *fields])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, DEMUX_SCHEMA)


DIGEST_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "packets long, continuity_errors long, n_timestamps long, n_random_access long"
)


def digest_row(doc_id: int | None, n_bytes: int, r: dict) -> dict:
    """Checksums and a feature line of what ``demux`` read back."""
    p = r["payload"]
    if p is None:
        return {"doc_id": doc_id, "n_bytes": n_bytes, "feature": f"error={r['error']}"}
    t, ra = r["timestamps"], r["random_access"]
    feature = f"program={r['program']};type={r['stream_type']};packets={r['packets']};cc_errors={r['continuity_errors']};units={len(t)};rap={len(ra)};last_pts={t[-1] if t else -1}"
    return {
        "doc_id": doc_id, "n_bytes": n_bytes, "payload_bytes": len(p), "payload_sha256": hashlib.sha256(p).hexdigest(), "tail_crc32": zlib.crc32(p[-32:]),
        "media_bytes": r["media_bytes"], "media_sha256": r["media_sha256"], "feature": feature, "packets": r["packets"], "continuity_errors": r["continuity_errors"],
        "n_timestamps": len(t), "n_random_access": len(ra),
    }


def _digests(rows) -> pa.RecordBatch:
    names = [c.split(" ")[0] for c in DIGEST_SCHEMA.split(", ")]
    kinds = [pa.string() if c.endswith(" string") else pa.int64() for c in DIGEST_SCHEMA.split(", ")]
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)


def digest(streams: DataFrame) -> DataFrame:
    """Checksums and a feature line of each row that ``demux`` gave."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index("payload")):
                yield _digests(digest_row(r["doc_id"], r["n_bytes"], r) for r in part.to_pylist())

    return streams.mapInArrow(run, DIGEST_SCHEMA)


def round_trip(docs: DataFrame) -> DataFrame:
    """``digest`` of ``demux`` of ``mux`` of each text, a row at a time in one pass."""

    def rows(part):
        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            data = (text or "").encode("utf-8", "replace")
            yield digest_row(doc_id, len(data), demux_row(mux_bytes(padded(data))))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                yield _digests(rows(part))

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, DIGEST_SCHEMA)
