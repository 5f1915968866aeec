"""MPEG transport streams (ISO/IEC 13818-1) as a media column.

:func:`mux` stores a payload of samples losslessly: one program (PAT, PMT, one
private elementary stream), one packetised elementary packet (PES) with a
timestamp and a clock reference (PCR) for each access unit, the random-access
flag on every ``gop``-th unit.  :func:`demux` reads any stream of packets: it
puts the sections of the program tables together, also over several packets,
follows the elementary streams they name, checks sync bytes, error flags, table
checksums and continuity counters, leaves a packet that is sent twice out once,
reassembles the elementary packets, and gives timestamps, clock references and
random-access points.  Both work on whole streams with numpy; only packets of
tables are looped over.

Defined results: an empty stream, or one that is no transport stream, gives
``ok = False`` and no units; damage is counted, never raised; an elementary
packet that lost a part is damaged and not delivered; a packet is legally sent
twice, a third copy is a loss; null text is empty; rows that repeat an id, and
rows with a null one, are rows of their own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from inkwell.llm._text import flat, ragged, slabs

PACKET, UNIT, GOP = 188, 576, 16
PAT_PID, PMT_PID, ES_PID = 0x0000, 0x1000, 0x0100
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data in elementary packets
TICKS = 3600  # of the 90 kHz clock between two access units
HEAD = 14  # bytes of an elementary packet's header with a timestamp
CLOCK = 8  # bytes of an adaptation field with a clock reference


def crc32_mpeg(data: bytes) -> int:
    """The checksum of table sections (polynomial 0x04C11DB7, not reflected)."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _table_packet(pid: int, table: int, number: int, body: bytes) -> bytes:
    size = len(body) + 9
    section = bytes([table, 0xB0 | size >> 8, size & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    section += crc32_mpeg(section).to_bytes(4, "big")
    head = bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


TABLES = np.frombuffer(
    _table_packet(PAT_PID, 0x00, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))
    + _table_packet(PMT_PID, 0x02, 1, bytes([0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0, STREAM_TYPE, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0])),
    np.uint8,
)


def _stamp(pts: np.ndarray) -> np.ndarray:
    """The five bytes of each 33-bit timestamp."""
    out = np.empty((len(pts), 5), np.uint8)
    out[:, 0] = 0x21 | (pts >> 29) & 0x0E
    out[:, 1] = pts >> 22 & 0xFF
    out[:, 2] = 0x01 | (pts >> 14) & 0xFE
    out[:, 3] = pts >> 7 & 0xFF
    out[:, 4] = 0x01 | (pts << 1) & 0xFE
    return out


def mux(payload: np.ndarray, unit: int = UNIT, gop: int = GOP) -> np.ndarray:
    """The transport stream of a payload whose length is a positive multiple of ``unit``."""
    units = payload.reshape(-1, unit)
    n = len(units)
    pes = np.zeros((n, HEAD + unit), np.uint8)
    pes[:, 2:9] = [1, STREAM_ID, (unit + HEAD - 6) >> 8, (unit + HEAD - 6) & 255, 0x84, 0x80, 5]
    pes[:, 9:14] = _stamp(np.arange(n, dtype=np.int64) * TICKS % (1 << 33))
    pes[:, HEAD:] = units
    size = HEAD + unit
    per = -(-(size + CLOCK) // (PACKET - 4))
    out = np.full((n, per, PACKET), 0xFF, np.uint8)
    out[:, :, 0] = 0x47
    out[:, :, 1] = ES_PID >> 8
    out[:, 0, 1] |= 0x40
    out[:, :, 2] = ES_PID & 255
    out[:, :, 3] = 0x30 | (np.arange(n)[:, None] * per + np.arange(per)) & 15
    at = 0
    for k in range(per):
        left = size - at
        room = PACKET - 4 - CLOCK * (k == 0)
        take = min(room, left) if k < per - 1 else left
        if take == PACKET - 4:
            out[:, k, 3] &= 0xDF
        else:
            out[:, k, 4] = PACKET - 5 - take
            if take < PACKET - 5:
                out[:, k, 5] = 0
        out[:, k, PACKET - take :] = pes[:, at : at + take]
        at += take
    out[:, 0, 5] = 0x10
    out[::gop, 0, 5] = 0x50
    base = np.arange(n, dtype=np.int64) * TICKS % (1 << 33)
    for i, shift in enumerate((25, 17, 9, 1)):
        out[:, 0, 6 + i] = base >> shift & 255
    out[:, 0, 10], out[:, 0, 11] = (base & 1) << 7 | 0x7E, 0
    return np.concatenate((TABLES, out.reshape(-1)))


@dataclass
class Stream:
    ok: bool = False
    packets: int = 0
    bad_sync: int = 0
    bad_tables: int = 0
    errors: int = 0
    discontinuities: int = 0
    duplicates: int = 0
    damaged: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    payload: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))
    unit_offsets: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    pts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    pcr: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    random_access: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))


_checked: dict[bytes, bool] = {}


def _sections(packets: np.ndarray, payload_at: np.ndarray, start: np.ndarray, which: np.ndarray, out: Stream) -> Iterator[bytes]:
    """The good sections on a table's PID, put together from its packets."""
    held, last = b"", None
    for i in which:
        if last is not None and packets[i, 3] & 15 == packets[last, 3] & 15 and (packets[i, 4:] == packets[last, 4:]).all():
            continue
        body = packets[i, payload_at[i] :].tobytes()
        if start[i]:
            pointer = body[0] if body else 0
            parts = [held + body[1 : 1 + pointer] if held else b"", body[1 + pointer :]]
        else:
            parts = [held + body] if held else []
        last, held = i, b""
        for k, part in enumerate(parts):
            while len(part) > 2 and part[0] != 0xFF:
                size = 3 + ((part[1] & 15) << 8 | part[2])
                if len(part) < size:
                    break
                section, part = part[:size], part[size:]
                if len(_checked) > 4096:
                    _checked.clear()
                if section not in _checked:
                    _checked[section] = len(section) >= 12 and crc32_mpeg(section) == 0
                if _checked[section]:
                    yield section
                else:
                    out.bad_tables += 1
            if k == len(parts) - 1 and part[:1] not in (b"", b"\xff"):
                held = part


def demux(media: np.ndarray) -> Stream:
    """What the stream holds; the payload is that of the first elementary stream of the first program."""
    out = Stream(packets=len(media) // PACKET)
    packets = media[: out.packets * PACKET].reshape(-1, PACKET)
    good = packets[:, 0] == 0x47
    out.bad_sync = int((~good).sum())
    broken = good & (packets[:, 1] & 0x80 > 0)
    out.errors = int(broken.sum())
    packets = packets[good & ~broken]
    if not len(packets):
        return out
    pid = (packets[:, 1].astype(np.int64) & 0x1F) << 8 | packets[:, 2]
    start = packets[:, 1] & 0x40 > 0
    control = packets[:, 3] >> 4 & 3
    has, adapts = control & 1 > 0, control & 2 > 0
    payload_at = np.minimum(np.where(adapts, 5 + packets[:, 4].astype(np.int64), 4), PACKET)
    flags = np.where(adapts & (packets[:, 4] > 0), packets[:, 5], 0)
    for pat in _sections(packets, payload_at, start, np.flatnonzero((pid == PAT_PID) & has), out):
        for i in range(8, len(pat) - 4, 4):
            if pat[0] == 0 and (number := pat[i] << 8 | pat[i + 1]):
                out.programs.setdefault(number, (pat[i + 2] & 0x1F) << 8 | pat[i + 3])
    for number, table in out.programs.items():
        for pmt in _sections(packets, payload_at, start, np.flatnonzero((pid == table) & has), out):
            if pmt[0] != 2 or pmt[3] << 8 | pmt[4] != number:
                continue
            i = 12 + ((pmt[10] & 15) << 8 | pmt[11])
            while i + 5 <= len(pmt) - 4:
                out.streams.setdefault((pmt[i + 1] & 0x1F) << 8 | pmt[i + 2], pmt[i])
                i += 5 + ((pmt[i + 3] & 15) << 8 | pmt[i + 4])
    if not out.streams:
        return out
    mine = pid == next(iter(out.streams))
    timed = np.flatnonzero(mine & (flags & 0x10 > 0) & (packets[:, 4] >= 7))
    clock = lambda k: packets[timed, 6 + k].astype(np.int64)
    out.pcr = ((clock(0) << 25 | clock(1) << 17 | clock(2) << 9 | clock(3) << 1 | clock(4) >> 7) * 300) + ((clock(4) & 1) << 8 | clock(5))
    which = np.flatnonzero(mine & has)
    counter = packets[which, 3] & 15
    again = np.zeros(len(which), bool)
    again[1:] = (counter[1:] == counter[:-1]) & (packets[which[1:], 4:] == packets[which[:-1], 4:]).all(1)
    again[1:] &= ~again[:-1]
    out.duplicates = int(again.sum())
    which, counter = which[~again], counter[~again]
    gap = np.zeros(len(which) + 1, bool)
    gap[1:-1] = (counter[1:] != counter[:-1] + 1 & 15) & ~(flags[which[1:]] & 0x80 > 0)
    out.discontinuities = int(gap.sum())
    first = np.flatnonzero(start[which])
    if not len(first):
        return out
    which, gap = which[first[0] :], gap[first[0] :]
    first = first - first[0]
    begin = which[first]
    base = payload_at[begin]
    cell = lambda k: packets[begin, np.minimum(base + k, PACKET - 1)].astype(np.int64)
    whole = (base + 9 <= PACKET) & (cell(0) == 0) & (cell(1) == 0) & (cell(2) == 1)
    header = np.where(whole, 9 + cell(8), 0)
    stamped = whole & (cell(7) & 0x80 > 0)
    pts = (cell(9) & 0x0E) << 29 | cell(10) << 22 | (cell(11) & 0xFE) << 14 | cell(12) << 7 | cell(13) >> 1
    from_ = payload_at[which].copy()
    from_[first] += header
    sizes = np.maximum(PACKET - from_, 0)
    total = np.add.reduceat(sizes, first)
    declared = cell(4) << 8 | cell(5)
    ends = np.append(first[1:], len(which))
    inner = gap[:-1].copy()
    inner[first] = False
    lost = np.add.reduceat(inner.astype(np.int64), first) > 0
    whole &= ~lost & np.where(declared > 0, declared + 6 - header == total, ~gap[ends])
    out.damaged = int((~whole).sum())
    out.pts = np.where(stamped, pts, -1)[whole]
    out.random_access = (flags[begin] & 0x40 > 0)[whole]
    kept = np.repeat(whole, ends - first)
    at, _ = ragged((which * PACKET + from_)[kept], sizes[kept])
    out.payload = packets.reshape(-1)[at]
    out.unit_offsets = np.concatenate(([0], np.cumsum(total[whole])))
    out.ok = bool(len(out.pts) and not (out.damaged or out.discontinuities or out.bad_sync or out.errors))
    return out


def feature(stream: Stream) -> str:
    """A short text of what was found: tables, continuity, units, timestamps, random-access points."""
    pts = stream.pts
    return (
        f"programs={len(stream.programs)};streams={','.join(f'{p:#06x}:{t:#04x}' for p, t in stream.streams.items())};packets={stream.packets}"
        f";lost={stream.discontinuities};twice={stream.duplicates};damaged={stream.damaged};units={len(pts)};clocks={len(stream.pcr)};pts={pts[0] if len(pts) else -1}..{pts[-1] if len(pts) else -1}"
        f";access={int(stream.random_access.sum())};mean={float(stream.payload.mean()) if len(stream.payload) else 0.0:.6f};ok={int(stream.ok)}"
    )


def pad(data: np.ndarray, unit: int = UNIT) -> np.ndarray:
    """Bytes 255 appended up to a positive multiple of ``unit``."""
    return np.concatenate((data, np.full(unit - len(data) % unit if len(data) % unit or not len(data) else 0, 255, np.uint8)))


def store(docs: DataFrame, keep: list[str] | None = None, media: bool = True, units: bool = True) -> DataFrame:
    """Each text as a transport stream, read back: digests and features; map-only.

    ``media`` adds the stream itself (binary), ``units`` its access units
    (array of struct: offset, pts, random_access).  Null text is empty text.
    Input columns of the names that are added are replaced.
    """
    new = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media", "units")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    extra = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    extra += ", media binary" * media + ", units array<struct<offset: long, pts: long, random_access: boolean>>" * units
    schema = StructType([*(docs.schema[c] for c in keep), *StructType.fromDDL(extra).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches):
            data, offs = flat(slab.column(slab.schema.get_field_index("text")))
            rows = []
            for a, b in zip(offs[:-1], offs[1:], strict=True):
                stored = mux(pad(data[a:b])).tobytes()
                got = demux(np.frombuffer(stored, np.uint8))
                payload = got.payload.tobytes()
                row = [int(b - a), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(got)]
                if media:
                    row.append(stored)
                if units:
                    row.append([{"offset": int(o), "pts": int(p), "random_access": bool(r)} for o, p, r in zip(got.unit_offsets, got.pts, got.random_access, strict=False)])
                rows.append(row)
            out = [slab.column(slab.schema.get_field_index(c)) for c in keep]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * media
            kinds += [pa.list_(pa.struct([("offset", pa.int64()), ("pts", pa.int64()), ("random_access", pa.bool_())]))] * units
            out += [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
