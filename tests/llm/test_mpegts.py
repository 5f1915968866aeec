import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm.mpegts import ES_PID, GOP, PACKET, TICKS, demux, mux, pad, store


@given(st.binary(max_size=20000))
@settings(max_examples=60, deadline=None)
def test_round_trip(raw):
    payload = pad(np.frombuffer(raw, np.uint8))
    assert len(payload) % 576 == 0 and len(payload) > 0
    got = demux(mux(payload))
    assert got.ok and got.payload.tobytes() == payload.tobytes()
    n = len(payload) // 576
    assert got.pts.tolist() == [i * TICKS for i in range(n)]
    assert got.random_access.tolist() == [i % GOP == 0 for i in range(n)]
    assert got.streams == {ES_PID: 6} and len(mux(payload)) % PACKET == 0


def test_damage_is_counted():
    media = mux(pad(np.arange(5000) .astype(np.uint8)))
    lost = np.delete(media.reshape(-1, PACKET), 5, 0).ravel()
    assert demux(lost).discontinuities == 1 and not demux(lost).ok
    bad = media.copy()
    bad[PACKET * 3] = 0
    assert demux(bad).bad_sync == 1 and demux(bad).damaged == 1
    bad = media.copy()
    bad[10] ^= 1
    assert demux(bad).bad_tables == 1 and not demux(bad).streams
    assert not demux(np.zeros(0, np.uint8)).ok and not demux(np.zeros(1000, np.uint8)).ok
    # an unrelated stream between the packets is skipped
    other = media.reshape(-1, PACKET)[2:3].copy()
    other[0, 2] = 0x55
    assert demux(np.concatenate((media[: 3 * PACKET], other[0], media[3 * PACKET :]))).ok


def test_operator(spark):
    rows = [(1, None, "z"), (2, "", "z"), (3, "héllo", "z"), (4, "x" * 100000, "z"), (5, "héllo", "z"), (6, "y" * 576, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = {r.doc_id: r for r in store(df).collect()}
    for i, text, _ in rows:
        raw = (text or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and len(r.units) == len(p) // 576
    assert got[3].feature == got[5].feature and got[3].media_sha256 == got[5].media_sha256
    assert store(df.limit(0)).count() == 0


def by_hand(pid, counter, payload, start, flags=0, pcr=None):
    """One packet, byte by byte; the rest is stuffing in the adaptation field."""
    room = 184 - len(payload)
    field = b""
    if room or flags or pcr is not None:
        body = bytes([flags | (0x10 if pcr is not None else 0)])
        if pcr is not None:
            base, more = divmod(pcr, 300)
            body += (base << 15 | 0x3F << 9 | more).to_bytes(6, "big")
        field = bytes([room - 1]) + (body.ljust(room - 1, b"\xff") if room > 1 else b"")
    out = bytes([0x47, 0x40 * start | pid >> 8, pid & 255, (0x30 if field else 0x10) | counter & 15]) + field + payload
    assert len(out) == 188
    return out


def section(table, number, body):
    raw = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    crc = 0xFFFFFFFF
    for bit in (b >> i & 1 for b in raw for i in range(7, -1, -1)):
        crc = (crc << 1 ^ (0x04C11DB7 if (crc >> 31) ^ bit else 0)) & 0xFFFFFFFF
    return raw + crc.to_bytes(4, "big")


def pes(data, pts):
    stamp = bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, 1 | pts >> 14 & 0xFE, pts >> 7 & 255, 1 | pts << 1 & 0xFE])
    return b"\0\0\1\xbd" + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\5" + stamp + data


def split(pid, blob, counter, start=True, **first):
    room = 184 - (8 if first else 0)
    parts = [blob[:room], *(blob[i : i + 184] for i in range(room, len(blob), 184))]
    return [by_hand(pid, counter + k, p, start and k == 0, **(first if k == 0 else {})) for k, p in enumerate(parts)]


def hand_stream():
    """Two programs, a program map over two packets, units of several sizes."""
    other = b"".join(bytes([0x1B, 0xE3, k, 0xF0, 2, 9, 9]) for k in range(40))
    pat = b"\0" + section(0, 1, bytes([0, 7, 0xE4, 0x00, 0, 9, 0xE5, 0x00]))
    pmt = b"\0" + section(2, 7, bytes([0xE2, 0, 0xF0, 3, 1, 2, 3, 6, 0xE2, 0, 0xF0, 0]) + other)
    last = b"\0" + section(2, 9, bytes([0xE2, 1, 0xF0, 0, 6, 0xE2, 1, 0xF0, 0]))
    data = [bytes((i * 7 + k) % 251 for k in range(n)) for i, n in enumerate((100, 900, 1, 2000))]
    rows = [by_hand(0, 0, pat.ljust(184, b"\xff"), True)]
    rows += [by_hand(0x400, k, pmt[184 * k : 184 * k + 184].ljust(184, b"\xff"), k == 0) for k in range(-(-len(pmt) // 184))]
    rows += [by_hand(0x500, 0, last.ljust(184, b"\xff"), True)]
    counter, units = 5, []
    for i, d in enumerate(data):
        packets = split(0x200, pes(d, 90000 * i + (1 << 32)), counter, flags=0x40 if i % 2 == 0 else 0, pcr=300 * 90000 * i + 17)
        counter += len(packets)
        units.append(packets)
    return rows, units, data


def test_stream_by_hand():
    rows, units, data = hand_stream()
    read = lambda packets: demux(np.frombuffer(b"".join(packets), np.uint8))
    flat = [p for u in units for p in u]
    got = read(rows + flat)
    assert got.ok and got.payload.tobytes() == b"".join(data) and got.programs == {7: 0x400, 9: 0x500} and len(got.streams) == 42
    assert got.pts.tolist() == [(1 << 32) + 90000 * i for i in range(4)] and got.random_access.tolist() == [True, False, True, False]
    assert got.pcr.tolist() == [300 * 90000 * i + 17 for i in range(4)] and got.unit_offsets.tolist() == [0, 100, 1000, 1001, 3001]
    twice = read(rows + [p for k, p in enumerate(flat) for _ in range(1 + (k == 3))])  # sent twice: legal
    assert twice.ok and twice.duplicates == 1 and twice.payload.tobytes() == b"".join(data)
    thrice = read(rows + [p for k, p in enumerate(flat) for _ in range(1 + 2 * (k == 3))])
    assert not thrice.ok and thrice.discontinuities == 1 and thrice.damaged == 1
    lost = read(rows + [p for k, p in enumerate(flat) if k != 3])  # of the second unit
    assert lost.damaged == 1 and lost.discontinuities == 1 and lost.payload.tobytes() == data[0] + data[2] + data[3]
    assert lost.pts.tolist() == [(1 << 32) + 90000 * i for i in (0, 2, 3)]
    tail = read(rows + flat[: len(units[0]) + len(units[1]) - 1] + units[2] + units[3])  # a unit's last packet
    assert tail.damaged == 1 and tail.payload.tobytes() == data[0] + data[2] + data[3]
    head = read(rows + units[0] + units[1][1:] + units[2] + units[3])  # a unit's first packet: what is left belongs to none
    assert not head.ok and head.payload.tobytes() == data[2] + data[3] and head.damaged == 1
    flagged = bytearray(flat[4])
    flagged[1] |= 0x80
    assert read(rows + flat[:4] + [bytes(flagged)] + flat[5:]).errors == 1
    cut = read(rows[:2] + rows[3:] + flat)  # the second packet of the program map
    assert 0x200 not in cut.streams and not cut.ok


def test_clock_references():
    got = demux(mux(pad(np.zeros(576 * 40, np.uint8))))
    assert got.pcr.tolist() == [300 * TICKS * i for i in range(40)]


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a"), (None, None), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_bytes) for r in store(df).collect()) == [(0, 0), (0, 1), (1, 1), (1, 1)]
