"""Media columns: MPEG transport streams written from and read back to payload bytes.

``mux`` stores a payload as an elementary stream of 8-bit samples: access units of up to
AU_BYTES become elementary packets with a presentation time (90 kHz), cut into 188-byte
packets with continuity counters. Every RANDOM_EVERY-th unit is a random-access point: it
carries the program tables before it and a clock reference in its adaptation field.

``demux`` finds the packets (also after junk or lost bytes), then a program's first stream
through the program tables (of one or more packets), checks table checksums and continuity
counters, reassembles the elementary packets, and gives payload, times and random-access
points. A packet may be sent twice in a row and is taken once; a counter may jump where the
stream says so. Other counter gaps, broken packets or tables and units whose length is not
the declared one are counted, not raised; what a unit has beyond its length is cut off.

Defined cases: null text is the empty text, which still fills one block; equal payloads
give equal streams; texts of any length are stored whole; an empty table gives an empty
result; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.arrow import map_arrow, texts
from scriptorium.session import table

BLOCK = 576
AU_BYTES = 8 * BLOCK
RANDOM_EVERY = 4
PACKET, SYNC = 188, 0x47
PMT_PID, ES_PID, PRIVATE_STREAM, STREAM_ID = 0x1000, 0x0100, 0x06, 0xBD
#: One sample is 1/8000 s, in ticks of the 90 kHz clock times 4.
TICKS_4 = 45
FIRST_PTS = 90_000


@cache
def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _crc_table()[c >> 24 ^ b]
    return c


@cache
def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | len(body) + 9 >> 8, len(body) + 9 & 255, number >> 8, number & 255, 0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


@cache
def _tables() -> tuple[bytes, bytes]:
    """Payloads of the program association and program map packets."""
    pat = _section(0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))
    pid = bytes([0xE0 | ES_PID >> 8, ES_PID & 255])
    pmt = _section(2, 1, pid + b"\xf0\0" + bytes([PRIVATE_STREAM]) + pid + b"\xf0\0")
    return tuple(b"\0" + s + b"\xff" * (PACKET - 5 - len(s)) for s in (pat, pmt))


def _pts_bytes(pts: int) -> bytes:
    p = pts & (1 << 33) - 1
    return bytes([0x21 | p >> 29 & 0x0E, p >> 22 & 255, 1 | p >> 14 & 0xFE, p >> 7 & 255, 1 | p << 1 & 0xFE])


def _pts_of(b: np.ndarray) -> int:
    a = [int(x) for x in b[:5]]
    return (a[0] >> 1 & 7) << 30 | a[1] << 22 | a[2] >> 1 << 15 | a[3] << 7 | a[4] >> 1


def _unit_packets(data: bytes, pts: int, random_access: bool, counter: int) -> tuple[bytes, int]:
    """The packets of one access unit and the next continuity counter."""
    length = len(data) + 8
    pes = b"\0\0\1" + bytes([STREAM_ID]) + (length if length < 65536 else 0).to_bytes(2, "big") + b"\x84\x80\x05" + _pts_bytes(pts) + data
    if random_access:
        clock = (pts & (1 << 33) - 1) << 15 | 0x3F << 9
        field = b"\x07\x50" + clock.to_bytes(6, "big")
        first = PACKET - 4 - len(field)
    else:
        field, first = b"", PACKET - 4
    n = 1 + max(0, -(-(len(pes) - first) // (PACKET - 4)))
    out = np.full((n, PACKET), 0xFF, dtype=np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
    out[0, 1] |= 0x40
    out[:, 3] = 0x10 | np.arange(counter, counter + n) & 15
    raw = np.frombuffer(pes, dtype=np.uint8)
    room = first if n == 1 else PACKET - 4
    tail = len(pes) - (0 if n == 1 else first + (n - 2) * (PACKET - 4))
    if n > 1:
        out[0, PACKET - first :] = raw[:first]
        if n > 2:
            out[1:-1, 4:] = raw[first : first + (n - 2) * (PACKET - 4)].reshape(n - 2, PACKET - 4)
    if field:
        out[0, 3] |= 0x20
        out[0, 4 : 4 + len(field)] = np.frombuffer(field, dtype=np.uint8)
    if pad := room - tail:  # stuffing lengthens or makes the last packet's adaptation field
        had = len(field) if n == 1 else 0
        out[-1, 3] |= 0x20
        out[-1, 4] = had + pad - 1
        if not had and pad > 1:
            out[-1, 5] = 0
    out[-1, PACKET - tail :] = raw[len(pes) - tail :]
    return out.tobytes(), counter + n & 15


def mux(payload: bytes) -> bytes:
    """A transport stream with one program of one private stream that holds ``payload``."""
    out, counter, psi = [], 0, 0
    pat, pmt = _tables()
    for k, at in enumerate(range(0, len(payload), AU_BYTES)):
        start = k % RANDOM_EVERY == 0
        if start:
            for pid, body in ((0, pat), (PMT_PID, pmt)):
                out.append(bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | psi & 15]) + body)
            psi += 1
        made, counter = _unit_packets(payload[at : at + AU_BYTES], FIRST_PTS + at * TICKS_4 // 4, start, counter)
        out.append(made)
    return b"".join(out)


def _aligned(stream: bytes) -> tuple[np.ndarray, int]:
    """The packets of a stream, and how many stretches before, between or after them are none.
    A packet starts with the sync byte; the first one, and the first after a stretch, is also
    followed by the end or another one, if need be after one whose sync byte is broken."""
    raw = np.frombuffer(stream, dtype=np.uint8)
    whole = raw[: len(raw) // PACKET * PACKET].reshape(-1, PACKET)
    if len(raw) == whole.size and (whole[:, 0] == SYNC).all():
        return whole, 0
    synced = lambda at: at >= len(raw) or raw[at] == SYNC
    found, broken, at, locked = [], 0, 0, False
    while at + PACKET <= len(raw):
        if raw[at] == SYNC and (locked or synced(at + PACKET) or synced(at + 2 * PACKET)):
            found.append(at)
            at, locked = at + PACKET, True
            continue
        broken += 1
        if locked and at + PACKET < len(raw) and synced(at + PACKET) and synced(at + 2 * PACKET):
            at += PACKET
            continue
        locked = False
        at = stream.find(SYNC, at + 1)
        while 0 <= at and at + PACKET <= len(raw) and not synced(at + PACKET):
            at = stream.find(SYNC, at + 1)
        if at < 0:
            at = len(raw)
    broken += at < len(raw)
    return raw[np.array(found, dtype=np.int64)[:, None] + np.arange(PACKET)], broken


def _payload_of(packet: np.ndarray) -> bytes:
    return packet[4 + (1 + int(packet[4]) if packet[3] & 0x20 else 0) :].tobytes()


def _sections(packets: np.ndarray, own: np.ndarray, starts: np.ndarray) -> Iterator[bytes | None]:
    """The tables that start in the packets ``own``, each from as many of these as it needs; None
    for one that is cut short or fails its checksum."""
    for n, k in enumerate(own.tolist()):
        if not starts[k]:
            continue
        body = _payload_of(packets[k])
        body, more = body[1 + body[0] :] if body else b"", n + 1
        while len(body) < 3 + ((body[1] & 15) << 8 | body[2] if len(body) > 2 else 0) and more < len(own) and not starts[own[more]]:
            body += _payload_of(packets[own[more]])
            more += 1
        length = 3 + ((body[1] & 15) << 8 | body[2]) if len(body) > 2 else 0
        yield _checked(body[:length]) if length and len(body) >= length else None


_known_sections: dict[bytes, bool] = {}


def _checked(section: bytes) -> bytes | None:
    """The section if its checksum holds; the few tables that streams repeat are remembered."""
    if section not in _known_sections:
        if len(_known_sections) > 1000:
            _known_sections.clear()
        _known_sections[section] = crc32_mpeg(section) == 0
    return section if _known_sections[section] else None


def _stream_pid(packets: np.ndarray, pids: np.ndarray, starts: np.ndarray, program: int | None) -> tuple[int | None, int]:
    """Packet id of the first stream of a program (default: the first one), and the number of
    broken tables before it."""
    broken = 0
    for pat in _sections(packets, np.flatnonzero(pids == 0), starts):
        if pat is None:
            broken += 1
            continue
        listed = [(pat[i] << 8 | pat[i + 1], (pat[i + 2] & 0x1F) << 8 | pat[i + 3]) for i in range(8, len(pat) - 7, 4)]
        pmt_pid = next((pid for number, pid in listed if number and program in (None, number)), None)
        for pmt in _sections(packets, np.flatnonzero(pids == pmt_pid), starts) if pmt_pid is not None else ():
            if pmt is None:
                broken += 1
                continue
            at = 12 + ((pmt[10] & 15) << 8 | pmt[11])
            if at + 5 <= len(pmt) - 4:
                return (pmt[at + 1] & 0x1F) << 8 | pmt[at + 2], broken
        break
    return None, broken


def demux(stream: bytes, program: int | None = None) -> dict:
    """Payload, presentation times, random-access points (packet number, time), the units
    whose length is not the declared one, and error counts."""
    good, lost = _aligned(stream)
    pids = (good[:, 1].astype(np.int32) & 0x1F) << 8 | good[:, 2]
    starts = (good[:, 1] & 0x40) != 0
    pid, broken = _stream_pid(good, pids, starts, program)
    where = np.flatnonzero((pids == pid) & ((good[:, 3] & 0x10) != 0)) if pid is not None else np.zeros(0, dtype=np.int64)
    step = np.diff((good[where, 3] & 15).astype(np.int16)) % 16
    twice = np.flatnonzero(step == 0) + 1
    twice = twice[(good[where[twice]] == good[where[twice - 1]]).all(1)]
    twice = twice[~np.isin(twice - 1, twice)]  # a third one is no legal copy
    where = np.delete(where, twice)
    own = good[where]
    adapted = (own[:, 3] & 0x20) != 0
    fields = np.where(adapted & (own[:, 4] > 0), own[:, 5], 0)
    step = np.diff((own[:, 3] & 15).astype(np.int16)) % 16
    gaps = int(np.count_nonzero((step != 1) & ((fields[1:] & 0x80) == 0)))
    begin = np.minimum(np.where(adapted, 5 + own[:, 4].astype(np.int32), 4), PACKET)
    random_access = (fields & 0x40) != 0
    body = own[np.arange(PACKET)[None, :] >= begin[:, None]]
    offsets = np.concatenate([[0], np.cumsum(PACKET - begin)])
    heads = np.flatnonzero(starts[where])
    parts, times, points, odd = [], [], [], []
    for n, h in enumerate(heads):
        pes = body[offsets[h] : offsets[heads[n + 1]] if n + 1 < len(heads) else offsets[-1]]
        if len(pes) < 14 or pes[0] or pes[1] or pes[2] != 1:
            broken += 1
            continue
        declared = 6 + (int(pes[4]) << 8 | int(pes[5]))
        if declared > 6 and len(pes) != declared:
            odd.append(len(times))
            pes = pes[:declared]
        times.append(_pts_of(pes[9:14]) if pes[7] & 0x80 else -1)
        parts.append(pes[9 + int(pes[8]) :].tobytes())
        if random_access[h]:
            points.append((int(where[h]), times[-1]))
    return {
        "payload": b"".join(parts),
        "times": times,
        "points": points,
        "odd_units": odd,
        "gaps": gaps,
        "twice": len(twice),
        "broken": broken + lost,
        "packets": len(good),
    }


def padded(text: bytes) -> bytes:
    """The text and bytes 255 up to a positive multiple of BLOCK."""
    return text + b"\xff" * (-len(text) % BLOCK or (0 if text else BLOCK))


def store(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text of ``documents(doc_id, text)`` as a transport stream."""

    def step(batch: pa.RecordBatch) -> dict:
        own = texts(batch)
        return {"doc_id": batch.column("doc_id"), "n_bytes": [len(t) for t in own], "media": [mux(padded(t)) for t in own]}

    return map_arrow(documents.select("doc_id", "text"), "doc_id long, n_bytes long, media binary", step)


READ_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, timestamps array<long>, random_access array<struct<packet:long,pts:long>>"
)


def read(media: DataFrame) -> DataFrame:
    """What ``demux`` finds in each stored stream, with digests of payload and stream."""

    def step(batch: pa.RecordBatch) -> dict:
        streams = [x or b"" for x in batch.column("media").to_pylist()]
        found = [demux(s) for s in streams]
        feature = []
        for f in found:
            samples = np.frombuffer(f["payload"], dtype=np.uint8)
            mean = int(samples.sum(dtype=np.int64)) * 1000 // max(1, len(samples))
            moves = int(np.abs(np.diff(samples.astype(np.int16))).sum(dtype=np.int64)) * 1000 // max(1, len(samples) - 1)
            last = max(f["times"], default=-1)
            feature.append(
                f"packets={f['packets']};units={len(f['times'])};random={len(f['points'])};last_pts={last};gaps={f['gaps']};twice={f['twice']};odd={len(f['odd_units'])};broken={f['broken']};mean={mean};moves={moves}"
            )
        return {
            "doc_id": batch.column("doc_id"),
            "n_bytes": batch.column("n_bytes"),
            "payload_bytes": [len(f["payload"]) for f in found],
            "payload_sha256": [hashlib.sha256(f["payload"]).hexdigest() for f in found],
            "tail_crc32": [zlib.crc32(f["payload"][-32:]) for f in found],
            "media_bytes": [len(s) for s in streams],
            "media_sha256": [hashlib.sha256(s).hexdigest() for s in streams],
            "feature": feature,
            "timestamps": [f["times"] for f in found],
            "random_access": [[{"packet": p, "pts": t} for p, t in f["points"]] for f in found],
        }

    return map_arrow(media, READ_SCHEMA, step, column="media")


def op6_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a transport stream, read back and described."""
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return read(store(documents))
