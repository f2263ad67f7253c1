"""Payloads in MPEG transport streams: a column of whole streams, written and read here.

A stream holds a program association table, a program map table with one private stream, and the payload in PES
packets of at most 16 KiB, cut into transport packets of 188 bytes. Each PES packet carries a presentation time stamp
(90 kHz; 8,000 payload bytes a second), and its first packet the random-access mark and the program's clock.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panemill.llm.common import table, utf8, written

#: Fixed values of the format (ISO/IEC 13818-1).
PACKET, SYNC, CLOCK = 188, 0x47, 90_000
PAT_PID, PAT_TABLE, PMT_TABLE = 0x0000, 0x00, 0x02
PRIVATE_STREAM, PRIVATE_TYPE = 0xBD, 0x06
CRC_POLYNOMIAL = 0x04C11DB7
#: This writer's choice.
PROGRAM, PMT_PID, MEDIA_PID = 1, 0x1000, 0x0100
UNIT, PES_BYTES, RATE = 64, 16_384, 8_000


@lru_cache(maxsize=1024)  # tables repeat all along
def section_crc(section: bytes) -> int:
    """CRC-32 of table sections: polynomial 0x04C11DB7, not reflected, from all ones; 0 over a section with its CRC."""
    crc = 0xFFFFFFFF
    for byte in section:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ CRC_POLYNOMIAL) & 0xFFFFFFFF if crc & 0x80000000 else crc << 1
    return crc


def _section_packet(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    section = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    section += section_crc(section).to_bytes(4, "big")
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


_TABLES = _section_packet(PAT_PID, PAT_TABLE, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")) + _section_packet(PMT_PID, PMT_TABLE, PROGRAM, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00")


def _stamp(ticks: int) -> bytes:
    """A presentation time stamp of 33 bits in its five bytes."""
    return bytes([0x21 | ticks >> 29 & 0x0E, ticks >> 22 & 0xFF, 0x01 | ticks >> 14 & 0xFE, ticks >> 7 & 0xFF, 0x01 | ticks << 1 & 0xFE])


def _clock(ticks: int) -> bytes:
    """A program clock of 33 bits of 90 kHz and none of 27 MHz in its six bytes."""
    return (ticks << 15 | 0x3F << 9).to_bytes(6, "big")


def write_stream(payload: bytes) -> bytes:
    """A transport stream that holds ``payload``."""
    out, counter = [_TABLES], 0
    for first in range(0, len(payload), PES_BYTES):
        part = payload[first : first + PES_BYTES]
        ticks = first * CLOCK // RATE % (1 << 33)
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(part) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(ticks) + part
        # the first packet has an adaptation field of eight bytes: length, marks and clock
        lead, middle = pes[: PACKET - 12], pes[PACKET - 12 :]
        full = len(middle) // (PACKET - 4)
        tail = middle[full * (PACKET - 4) :]
        count = 1 + full + (1 if tail else 0)
        packets = np.full((count, PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 0xFF
        packets[:, 3] = 0x10 | (counter + np.arange(count)) % 16
        packets[0, 1] |= 0x40
        packets[0, 3] |= 0x20
        stuffing = PACKET - 12 - len(lead)
        packets[0, 4:6] = (7 + stuffing, 0x50)
        packets[0, 6:12] = np.frombuffer(_clock(ticks), np.uint8)
        packets[0, 12 + stuffing :] = np.frombuffer(lead, np.uint8)
        if full:
            packets[1 : 1 + full, 4:] = np.frombuffer(middle, np.uint8, full * (PACKET - 4)).reshape(full, -1)
        if tail:
            spare = PACKET - 4 - len(tail)
            packets[-1, 3] |= 0x20
            packets[-1, 4] = spare - 1
            if spare > 1:
                packets[-1, 5] = 0
            packets[-1, 4 + spare :] = np.frombuffer(tail, np.uint8)
        counter = (counter + count) % 16
        out.append(packets.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds; ``payload`` is that of its first elementary stream."""

    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    payload: bytes = b""
    stamps: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)
    clocks: list[int] = field(default_factory=list)
    gaps: int = 0
    repeats: int = 0
    bad_tables: int = 0


def _sections(parts: list[tuple[bool, bytes]], table_id: int, found: Stream) -> Iterator[bytes]:
    """The bodies of a table's sections from the payloads of its packets, each with whether a section starts in it.

    A section may go over several packets and a packet may hold several; one with a wrong CRC is counted and left out.
    """
    held: bytes | None = None
    for starts, payload in parts:
        if starts:
            if not payload or 1 + payload[0] > len(payload):
                raise ValueError("a section begins beyond its packet")
            pieces = [payload[1 : 1 + payload[0]], payload[1 + payload[0] :]]
        else:
            pieces = [payload]
        for i, piece in enumerate(pieces):
            held = piece if i else None if held is None else held + piece
            while held and len(held) >= 3 and held[0] != 0xFF:
                size = 3 + (int.from_bytes(held[1:3], "big") & 0x0FFF)
                if len(held) < size:
                    break
                section, held = held[:size], held[size:]
                if section[0] == table_id:
                    if size < 12 or section_crc(section):
                        found.bad_tables += 1
                    else:
                        yield section[8:-4]


def _entries(body: bytes, first: int, size: int, extra: int) -> Iterator[bytes]:
    """The entries of a table: of ``size`` bytes each and, where ``extra`` tells their place, so many more."""
    while first < len(body):
        entry = body[first : first + size]
        if len(entry) < size:
            raise ValueError("a table ends within an entry")
        yield entry
        first += size + (int.from_bytes(entry[extra : extra + 2], "big") & 0x0FFF if extra else 0)


def read_stream(data: bytes) -> Stream:
    """Parse the program tables, check continuity counters and reassemble the elementary packets.

    ``stamps`` are the PES packets' time stamps (-1 where there is none); ``random_access`` the numbers of the
    transport packets that are marked as random-access points; ``clocks`` the program's clocks. A lost packet shows as a
    gap, unless its break is announced; a packet that is sent twice counts as a repeat and is read once; a section with a
    wrong CRC is left out. ValueError: a length that is no multiple of 188, a packet without sync byte, a field or section
    beyond its packet, a table or a PES packet that ends within a header.
    """
    if len(data) % PACKET:
        raise ValueError("a transport stream has packets of 188 bytes")
    every = np.frombuffer(data, np.uint8).reshape(-1, PACKET)
    found = Stream(packets=len(every))
    if (every[:, 0] != SYNC).any():
        raise ValueError("a packet lacks its sync byte")
    pids = (every[:, 1].astype(np.int64) & 0x1F) << 8 | every[:, 2]
    has_field = every[:, 3] & 0x20 > 0
    begin = np.where(has_field, 5 + every[:, 4].astype(np.int64), 4)
    if (begin > PACKET).any():
        raise ValueError("an adaptation field goes beyond its packet")
    filled = every[:, 3] & 0x10 > 0
    marks = np.where(has_field & (every[:, 4] > 0), every[:, 5], 0)

    def once(pid: int) -> np.ndarray:
        """A PID's packets with payload, without those that are sent twice; counts breaks of the counter."""
        own = np.flatnonzero((pids == pid) & filled)
        counters = every[own, 3].astype(np.int64) & 0x0F
        again = np.zeros(len(own), bool)
        again[1:] = (np.diff(counters) == 0) & (every[own[1:], 4:] == every[own[:-1], 4:]).all(axis=1)
        found.repeats += int(again.sum())
        own, counters = own[~again], counters[~again]
        found.gaps += int(((np.diff(counters) % 16 != 1) & (marks[own[1:]] & 0x80 == 0)).sum())
        return own

    def parts(pid: int) -> list[tuple[bool, bytes]]:
        return [(bool(every[at, 1] & 0x40), data[at * PACKET + begin[at] : (at + 1) * PACKET]) for at in once(pid).tolist()]

    for body in _sections(parts(PAT_PID), PAT_TABLE, found):
        for entry in _entries(body, 0, 4, 0):
            if number := int.from_bytes(entry[:2], "big"):  # 0 names no program
                found.programs[number] = int.from_bytes(entry[2:], "big") & 0x1FFF
    clock_pids = set()
    for pid in dict.fromkeys(found.programs.values()):
        for body in _sections(parts(pid), PMT_TABLE, found):
            if len(body) < 4:
                raise ValueError("a table ends within an entry")
            clock_pids.add(int.from_bytes(body[:2], "big") & 0x1FFF)
            for entry in _entries(body, 4 + (int.from_bytes(body[2:4], "big") & 0x0FFF), 5, 3):
                found.streams[int.from_bytes(entry[1:3], "big") & 0x1FFF] = entry[0]
    timed = np.flatnonzero(np.isin(pids, sorted(clock_pids)) & (marks & 0x10 > 0) & (every[:, 4] >= 7))
    found.clocks = [int.from_bytes(data[at * PACKET + 6 : at * PACKET + 12], "big") >> 15 for at in timed.tolist()]
    if not found.streams:
        return found
    own = once(next(iter(found.streams)))
    found.random_access = own[marks[own] & 0x40 > 0].tolist()
    used = np.arange(PACKET)[None, :] >= begin[own][:, None]
    whole = every[own][used]
    ends = np.cumsum(PACKET - begin[own])
    firsts = np.flatnonzero(every[own, 1] & 0x40 > 0)
    payload = []
    for k, n in enumerate(firsts):
        a = int(ends[n - 1]) if n else 0
        b = int(ends[firsts[k + 1] - 1]) if k + 1 < len(firsts) else int(ends[-1])
        pes = whole[a:b].tobytes()
        if len(pes) < 9 or pes[:3] != b"\x00\x00\x01" or pes[6] & 0xC0 != 0x80 or len(pes) < 9 + pes[8] or (pes[7] & 0x80 and pes[8] < 5):
            raise ValueError("a packet that should begin a PES packet does not")
        length = int.from_bytes(pes[4:6], "big")
        t = pes[9:14] if pes[7] & 0x80 else b""
        found.stamps.append((t[0] & 0x0E) << 29 | t[1] << 22 | (t[2] & 0xFE) << 14 | t[3] << 7 | t[4] >> 1 if t else -1)
        payload.append(pes[9 + pes[8] : 6 + length if length else len(pes)])
    found.payload = b"".join(payload)
    return found


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text, padded with zero bytes to a positive multiple of 64, as a stream.

    Null text counts as empty, and an empty text has a payload of 64 zero bytes. Equal texts give equal streams. Very
    long texts are coded whole; a stream is one value of its column, so that 2 GB is the most.
    Rows are coded one by one without a shuffle; extra columns are left out; an empty table gives an empty result.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, at = utf8(batch.column(1))
            sizes = np.diff(at).tolist()
            data = body.tobytes()
            streams = [write_stream(data[a : a + n].ljust(max(UNIT, -(-n // UNIT) * UNIT), b"\x00")) for a, n in zip(at.tolist(), sizes)]
            for first in range(0, len(sizes), 1000):
                some = slice(first, first + 1000)
                yield pa.RecordBatch.from_arrays([batch.column(0)[some], pa.array(sizes[some], pa.int64()), pa.array(streams[some], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """From (doc_id, n_bytes, media) what the stored streams hold.

    payload_bytes, payload_sha256 and tail_crc32 (of the last 64 bytes) come from the payload read back; stamps and
    random_access are the time stamps and the numbers of the packets that can be started from; feature sums them up.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, stamps array<long>, random_access array<int>"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(2).to_pylist():
                s = read_stream(data)
                histogram = np.bincount(np.frombuffer(s.payload, np.uint8), minlength=256)
                share = histogram[histogram > 0] / max(1, len(s.payload))
                entropy = float(-(share * np.log2(share)).sum())
                feature = f"packets={s.packets};programs={len(s.programs)};streams={len(s.streams)};pes={len(s.stamps)};gaps={s.gaps};repeats={s.repeats};bad_tables={s.bad_tables};clocks={len(s.clocks)};random_access={len(s.random_access)};last_stamp={max(s.stamps, default=-1)};mean={np.dot(histogram, np.arange(256)) / max(1, len(s.payload)):.4f};entropy={abs(entropy):.4f}"
                rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature, s.stamps, s.random_access))
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[c.split()[0] for c in schema.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(decode, schema)


def op5_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(written(media_column(table(spark, sf_dir, "documents")), "media"))
