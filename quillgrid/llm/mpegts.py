"""MPEG transport streams as media columns: multiplexing, and an index of what a stream holds.

A stream is a run of 188-byte packets. `parse` reads any such bytes: it resynchronises on the sync byte, follows
program tables (PAT, then PMTs) over section boundaries, checks continuity counters (a repeated packet is a duplicate,
any other jump an error), reassembles elementary packets (PES) from their payloads, and keeps each one's time stamps and
whether it starts at a random-access point. `mux` writes the streams that the tables' texts are stored in: private data
of one program, one PES a 4096-byte access unit, 90 kHz time stamps, random access on every eighth unit.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, text_of

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID, NULL_PID = 0x0000, 0x1000, 0x0100, 0x1FFF
PROGRAM, PRIVATE_PES, PRIVATE_STREAM = 1, 0x06, 0xBD
UNIT_BYTES, UNIT_TICKS, RANDOM_ACCESS_EVERY = 4096, 3600, 8
ALIGN = 64


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32/MPEG-2 of a table section; 0 over a whole section with its own CRC."""
    c = 0xFFFFFFFF
    for x in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ x]
    return c


def _section(table_id: int, ext: int, body: bytes) -> bytes:
    s = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), ext, 0xC1, 0, 0) + body
    return s + struct.pack(">I", section_crc(s))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(PAT_PID, _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))) + _table_packet(
    PMT_PID, _section(2, PROGRAM, struct.pack(">HH", 0xE000 | DATA_PID, 0xF000) + struct.pack(">BHH", PRIVATE_PES, 0xE000 | DATA_PID, 0xF000))
)


def _stamp(ticks: int, mark: int = 2) -> bytes:
    t = ticks & 0x1FFFFFFFF
    return struct.pack(">BHH", mark << 4 | (t >> 30) << 1 | 1, (t >> 15 & 0x7FFF) << 1 | 1, (t & 0x7FFF) << 1 | 1)


def mux(payload: bytes) -> bytes:
    """A single-program transport stream that holds the payload losslessly."""
    out = [_TABLES]
    counter = 0
    for n, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        unit = payload[at : at + UNIT_BYTES]
        ticks = n * UNIT_TICKS
        pes = struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM, len(unit) + 8, 0x84, 0x80, 5) + _stamp(ticks) + unit
        # The first packet carries the clock and the random-access flag; the last one is stuffed to its size.
        flags = 0x10 | (0x40 if n % RANDOM_ACCESS_EVERY == 0 else 0)
        clock = bytes([7, flags]) + struct.pack(">IH", ticks >> 1 & 0xFFFFFFFF, (ticks & 1) << 15 | 0x7E00)
        done, first = 0, True
        while done < len(pes):
            field_ = clock if first else b""
            room = PACKET - 4 - len(field_)
            take = min(room, len(pes) - done)
            if take < room:
                pad = room - take
                if field_:
                    field_ = bytes([7 + pad]) + field_[1:] + b"\xff" * pad
                else:
                    field_ = b"\0" if pad == 1 else bytes([pad - 1, 0]) + b"\xff" * (pad - 2)
            out.append(struct.pack(">BHB", SYNC, (0x4000 if first else 0) | DATA_PID, (0x30 if field_ else 0x10) | counter) + field_ + pes[done : done + take])
            done += take
            counter = counter + 1 & 15
            first = False
    return b"".join(out)


@dataclass
class Pes:
    pid: int
    stream_id: int
    pts: int | None
    dts: int | None
    random_access: bool
    packet: int
    data: bytes
    complete: bool


@dataclass
class Stream:
    """What a transport stream holds."""

    packets: int = 0
    resyncs: int = 0
    programs: dict[int, int] = field(default_factory=dict)  # program number -> PID of its map
    streams: dict[int, tuple[int, int]] = field(default_factory=dict)  # PID -> program number, stream type
    duplicates: int = 0
    continuity_errors: int = 0
    table_errors: int = 0
    pes: list[Pes] = field(default_factory=list)


def _packets(data: bytes) -> tuple[np.ndarray, int]:
    """The packets as rows, and how often sync had to be found again."""
    a = np.frombuffer(data, dtype=np.uint8)
    n = len(a) // PACKET
    grid = a[: n * PACKET].reshape(n, PACKET)
    if n and (grid[:, 0] == SYNC).all():
        return grid, 0
    rows, at, lost = [], 0, 0
    while at + PACKET <= len(a):
        if a[at] == SYNC and (at + PACKET == len(a) or at + 2 * PACKET > len(a) or a[at + PACKET] == SYNC):
            rows.append(a[at : at + PACKET])
            at += PACKET
        else:
            nxt = np.flatnonzero(a[at + 1 :] == SYNC)
            lost += 1
            if not len(nxt):
                break
            at += 1 + int(nxt[0])
    return np.array(rows, dtype=np.uint8).reshape(-1, PACKET), lost


def _ticks(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | (b[1] << 7 | b[2] >> 1) << 15 | (b[3] << 7 | b[4] >> 1)


def _elementary(pid: int, raw: bytes, random_access: bool, packet: int, whole: bool) -> Pes | None:
    if len(raw) < 6 or raw[:3] != b"\0\0\1":
        return None
    stream_id, length = raw[3], raw[4] << 8 | raw[5]
    pts = dts = None
    body = 6
    if stream_id not in (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF) and len(raw) >= 9 and raw[6] >> 6 == 2:
        marks, body = raw[7] >> 6, 9 + raw[8]
        if marks & 2 and len(raw) >= 14:
            pts = _ticks(raw[9:14])
        if marks == 3 and len(raw) >= 19:
            dts = _ticks(raw[14:19])
    end = 6 + length if length else len(raw)  # a length of 0 leaves the end to the next unit
    return Pes(pid, stream_id, pts, dts, random_access, packet, raw[body:end], whole and len(raw) >= end)


class _Sections:
    """Collects the table sections of one PID across packets."""

    def __init__(self) -> None:
        self.buf = b""

    def feed(self, start: bool, payload: bytes) -> list[bytes]:
        if start and payload:
            skip = payload[0]
            out = self._take(payload[1 : 1 + skip]) if self.buf else []
            self.buf = b""
            return out + self._take(payload[1 + skip :], fresh=True)
        return self._take(payload) if self.buf else []

    def _take(self, more: bytes, fresh: bool = False) -> list[bytes]:
        self.buf += more
        out = []
        while len(self.buf) >= 3 and self.buf[0] != 0xFF:
            size = 3 + (self.buf[1] << 8 & 0xF00 | self.buf[2])
            if len(self.buf) < size:
                return out
            out.append(self.buf[:size])
            self.buf = self.buf[size:]
        if not self.buf or self.buf[0] == 0xFF:
            self.buf = b""
        return out


def _tables(s: Stream, section: bytes, pid: int) -> None:
    if len(section) < 12 or section_crc(section):
        s.table_errors += 1
        return
    body = section[8:-4]
    if pid == PAT_PID and section[0] == 0:
        for i in range(0, len(body) - 3, 4):
            number, at = struct.unpack(">HH", body[i : i + 4])
            if number:
                s.programs[number] = at & 0x1FFF
    elif section[0] == 2 and len(body) >= 4:
        number = section[3] << 8 | section[4]
        i = 4 + (body[2] << 8 & 0xF00 | body[3])
        while i + 5 <= len(body):
            kind, at, info = body[i], body[i + 1] << 8 & 0x1F00 | body[i + 2], body[i + 3] << 8 & 0xF00 | body[i + 4]
            s.streams[at] = (number, kind)
            i += 5 + info


def parse(data: bytes) -> Stream:
    """Index a transport stream; damage is counted, never raised."""
    grid, lost = _packets(data)
    s = Stream(packets=len(grid), resyncs=lost)
    if not len(grid):
        return s
    pids = (grid[:, 1].astype(np.int64) & 0x1F) << 8 | grid[:, 2]
    starts = (grid[:, 1] & 0x40) != 0
    control = grid[:, 3] >> 4 & 3
    counters = grid[:, 3] & 15
    broken = (grid[:, 1] & 0x80) != 0
    scrambled = (grid[:, 3] & 0xC0) != 0
    has_field, has_payload = (control & 2) != 0, (control & 1) != 0
    length = np.where(has_field, grid[:, 4].astype(np.int64), -1)
    begin = np.minimum(4 + length + 1, PACKET)
    flags = np.where(has_field & (length > 0), grid[:, 5], 0)
    raw = grid.tobytes()

    sections: dict[int, _Sections] = {}
    for i in np.flatnonzero((pids != NULL_PID) & has_payload).tolist():  # tables come first: they name the streams
        pid = int(pids[i])
        if pid == PAT_PID or pid in s.programs.values():
            for x in sections.setdefault(pid, _Sections()).feed(bool(starts[i]), raw[i * PACKET + int(begin[i]) : (i + 1) * PACKET]):
                _tables(s, x, pid)

    for pid in np.unique(pids).tolist():
        if pid == NULL_PID:
            continue
        own = np.flatnonzero(pids == pid)
        cc, pay, disc = counters[own].astype(np.int64), has_payload[own], (flags[own] & 0x80) != 0
        # A packet with payload counts one on; one without keeps the counter.
        step = (cc[1:] - cc[:-1]) % 16
        same = np.zeros(len(own), dtype=bool)
        for j in np.flatnonzero((step == 0) & pay[1:] & pay[:-1]).tolist():
            a, b = int(own[j]), int(own[j + 1])
            same[j + 1] = raw[a * PACKET : (a + 1) * PACKET] == raw[b * PACKET : (b + 1) * PACKET]
        bad = np.zeros(len(own), dtype=bool)
        bad[1:] = (step != pay[1:]) & ~same[1:] & ~disc[1:]
        s.duplicates += int(same.sum())
        s.continuity_errors += int(bad.sum())
        if pid not in s.streams:
            continue
        use = own[pay & ~same]
        use = use[~broken[use] & ~scrambled[use]]
        gaps = set(own[bad].tolist())
        heads = np.flatnonzero(starts[use])
        for h, e in zip(heads.tolist(), [*heads[1:].tolist(), len(use)], strict=True):
            idx = use[h:e].tolist()
            unit = b"".join([raw[i * PACKET + b : (i + 1) * PACKET] for i, b in zip(idx, begin[use[h:e]].tolist(), strict=True)])
            p = _elementary(pid, unit, bool(flags[idx[0]] & 0x40), idx[0], not (gaps and gaps.intersection(idx[1:])))
            if p is not None:
                s.pes.append(p)
    s.pes.sort(key=lambda p: p.packet)
    return s


def feature(s: Stream) -> str:
    """One line of what an index holds; equal streams give equal lines."""
    times = [p.pts for p in s.pes if p.pts is not None]
    access = [p for p in s.pes if p.random_access]
    programs = ",".join(f"{n}@{pid}" for n, pid in sorted(s.programs.items()))
    streams = ",".join(f"{pid}:{kind}" for pid, (_, kind) in sorted(s.streams.items()))
    points = hashlib.md5(",".join(f"{p.packet}:{p.pts}" for p in access).encode()).hexdigest()[:16]
    return f"programs={programs};streams={streams};packets={s.packets};pes={len(s.pes)};pts={min(times, default=None)}..{max(times, default=None)};random_access={len(access)}:{points};duplicates={s.duplicates};continuity_errors={s.continuity_errors}"


INDEX_SCHEMA = (
    "packets long, resyncs long, duplicates long, continuity_errors long, table_errors long, programs array<struct<number:int,map_pid:int>>, "
    "streams array<struct<pid:int,program:int,kind:int>>, pes array<struct<pid:int,stream_id:int,packet:int,pts:bigint,dts:bigint,random_access:boolean,bytes:int,complete:boolean>>, "
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
)


def index_row(data: bytes) -> dict:
    """What a stream holds: its index, and digests of the payload that its elementary packets carry and of the stream."""
    s = parse(data)
    payload = hashlib.sha256()
    tail, size = b"", 0
    for p in s.pes:
        payload.update(p.data)
        tail, size = (tail + p.data[-ALIGN:])[-ALIGN:], size + len(p.data)
    return {
        "packets": s.packets, "resyncs": s.resyncs, "duplicates": s.duplicates, "continuity_errors": s.continuity_errors, "table_errors": s.table_errors,
        "programs": [{"number": n, "map_pid": p} for n, p in sorted(s.programs.items())],
        "streams": [{"pid": p, "program": n, "kind": k} for p, (n, k) in sorted(s.streams.items())],
        "pes": [{"pid": p.pid, "stream_id": p.stream_id, "packet": p.packet, "pts": p.pts, "dts": p.dts, "random_access": p.random_access, "bytes": len(p.data), "complete": p.complete} for p in s.pes],
        "payload_bytes": size, "payload_sha256": payload.hexdigest(), "tail_crc32": zlib.crc32(tail), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(),
        "feature": feature(s),
    }


def index_streams(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df's columns and `ts`, the index of its media column: tables, continuity, every elementary packet's time stamps and
    random-access flag, and digests. A null stream has a null index, an empty one an index of no packets. A column named
    ts is replaced; rows are independent, so they may repeat."""

    @F.udf(returnType=INDEX_SCHEMA, useArrow=True)
    def index(data):
        return None if data is None else index_row(bytes(data))

    return df.withColumn("ts", index(F.col(media_col)))


def padded(payload: bytes) -> bytes:
    return payload.ljust(max(ALIGN, -(-len(payload) // ALIGN) * ALIGN), b"\0")


def store(df: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """df's columns with the padded UTF-8 of a text column stored as a transport stream in a binary one; null is the empty
    text. A column named like the binary one is replaced."""

    @F.udf(returnType="binary", useArrow=True)
    def media(text):
        return mux(padded((text or "").encode()))

    return df.withColumn(media_col, media(F.col(text_col)))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents through a stored transport stream: digests and time stamps of what its index reads back; a null
    text is empty, equal texts give equal values, repeated rows are rows of the result."""
    docs = text_of(table(spark, sf_dir, "documents"))
    media = store(docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")).drop("text")
    kept = stored(media, "media", compression="zstd")  # from here on, only the stored bytes count
    digests = [F.col(f"ts.{n}") for n in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "packets", "continuity_errors")]
    access = F.filter("ts.pes", lambda p: p["random_access"])
    stamps = F.size("ts.pes").cast("long").alias("units"), F.element_at("ts.pes", -1)["pts"].alias("last_pts"), F.transform(access, lambda p: p["pts"]).alias("random_access_pts")
    return index_streams(kept).select("doc_id", "n_bytes", *digests, *stamps)
