"""MPEG-2 transport streams as a media column: writing a payload, parsing it back, features.

A stream holds a program association table, a program map table and one private elementary
stream.  The payload is cut into access units of 32 blocks of 192 bytes; each is one packetised
elementary packet with a presentation time stamp of 3000 ticks (90 kHz) after the last, and
every eighth is marked as a random-access point.  The tables are repeated before
each random-access point.  Reading trusts nothing but the bytes: it finds the tables by their
fixed packet ids, checks their CRC and every packet's continuity counter, and reassembles
the elementary packets.  All packets of a text are handled as one numpy matrix.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import save, small_batches

BLOCK = 192
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, ES_PID, PROGRAM, STREAM_TYPE = 0, 0x100, 0x101, 1, 0x06
UNIT, TICKS, RAP_EVERY = 32 * BLOCK, 3000, 8
PES_HEADER = 14
#: Bytes of the payload's end that tail_crc32 covers.
TAIL = 16
#: Bytes of streams that are passed on at once.
FLUSH = 1 << 23


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else (c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32 of program tables (most significant bit first); 0 over a section with its own CRC."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    raw = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return np.frombuffer(raw.ljust(PACKET, b"\xff"), dtype=np.uint8).copy()


_PAT = _table_packet(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(PMT_PID, _section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _time_stamp(t: int) -> bytes:
    return bytes([0x21 | (t >> 29) & 0x0E, t >> 22 & 255, 1 | t >> 14 & 0xFE, t >> 7 & 255, 1 | t << 1 & 0xFE])


def pad(text: bytes) -> bytes:
    """Spaces up to a positive multiple of 192 bytes."""
    return text.ljust(max(1, -(-len(text) // BLOCK)) * BLOCK, b" ")


def write_stream(payload: bytes) -> bytes:
    """A transport stream with the payload as its elementary stream."""
    parts, counter, tables = [], 0, 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit = payload[at : at + UNIT]
        rap, stamp = k % RAP_EVERY == 0, k * TICKS % (1 << 33)
        if rap:
            for packet in (_PAT.copy(), _PMT.copy()):
                packet[3] |= tables % 16
                parts.append(packet[None])
            tables += 1
        pes = b"\x00\x00\x01\xbd" + (len(unit) + PES_HEADER - 6).to_bytes(2, "big") + b"\x84\x80\x05" + _time_stamp(stamp) + unit
        # the first packet carries the program clock, the last one is filled up in its adaptation field
        lead = bytes([7, 0x50 if rap else 0x10]) + (stamp << 15 | 0x7E00).to_bytes(6, "big")
        room = PACKET - 4 - len(lead)
        n = 1 + max(0, -(-(len(pes) - room) // (PACKET - 4)))
        m = np.zeros((n, PACKET), dtype=np.uint8)
        m[:, 0], m[:, 1], m[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
        m[0, 1] |= 0x40
        m[:, 3] = 0x10 | (counter + np.arange(n)) % 16
        counter += n
        raw = np.frombuffer(pes, dtype=np.uint8)
        if n == 1:
            fill = room - len(raw)
            field = bytes([7 + fill]) + lead[1:] + b"\xff" * fill
            m[0, 3] |= 0x20
            m[0, 4 : 4 + len(field)] = np.frombuffer(field, dtype=np.uint8)
            m[0, 4 + len(field) :] = raw
        else:
            m[0, 3] |= 0x20
            m[0, 4:12] = np.frombuffer(lead, dtype=np.uint8)
            m[0, 12:] = raw[:room]
            middle, left = raw[room : room + (n - 2) * (PACKET - 4)], raw[room + (n - 2) * (PACKET - 4) :]
            m[1 : n - 1, 4:] = middle.reshape(n - 2, PACKET - 4)
            fill = PACKET - 4 - len(left)
            if fill:
                m[-1, 3] |= 0x20
                field = bytes([fill - 1]) + (b"\x00" + b"\xff" * (fill - 2) if fill > 1 else b"")
                m[-1, 4 : 4 + fill] = np.frombuffer(field, dtype=np.uint8)
            m[-1, 4 + fill :] = left
        parts.append(m)
    return np.concatenate(parts).tobytes()


def read_stream(stream: bytes) -> dict:
    """Parse a transport stream of one program: its tables, payload, time stamps, random-access points and errors.

    Raises ValueError if packets are out of sync or a table or elementary packet is damaged;
    breaks of a continuity counter are counted, as a receiver would."""
    if len(stream) % PACKET or not stream:
        raise ValueError("not a whole number of packets")
    m = np.frombuffer(stream, dtype=np.uint8).reshape(-1, PACKET)
    if (m[:, 0] != SYNC).any():
        raise ValueError("a packet is out of sync")
    pid = (m[:, 1].astype(np.int32) & 0x1F) << 8 | m[:, 2]
    breaks = 0
    for p in np.unique(pid):
        c = m[pid == p, 3] & 15
        breaks += int(((c[1:].astype(np.int32) - c[:-1]) % 16 != 1).sum())

    def section(p: int, table_id: int) -> bytes:
        rows = m[pid == p]
        if not len(rows):
            raise ValueError("a program table is missing")
        for row in {r.tobytes() for r in rows[:, 4:]}:
            raw = row[1 + row[0] :]
            body = raw[: 3 + (int.from_bytes(raw[1:3], "big") & 0xFFF)]
            if body[0] != table_id or section_crc(body):
                raise ValueError("a program table is damaged")
        return body

    pat = section(PAT_PID, 0)
    program, pmt_pid = int.from_bytes(pat[8:10], "big"), int.from_bytes(pat[10:12], "big") & 0x1FFF
    pmt = section(pmt_pid, 2)
    at = 12 + (int.from_bytes(pmt[10:12], "big") & 0xFFF)
    stream_type, es_pid = pmt[at], int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF
    es = m[pid == es_pid]
    adapted = (es[:, 3] & 0x20) > 0
    offset = np.where(adapted, 5 + es[:, 4].astype(np.int64), 4)
    starts = np.flatnonzero(es[:, 1] & 0x40)
    rap = adapted & (es[:, 4] > 0) & ((es[:, 5] & 0x40) > 0)
    data = es[np.arange(PACKET)[None, :] >= offset[:, None]].tobytes()
    ends = np.concatenate(([0], np.cumsum(PACKET - offset)))
    stamps, raps, payload = [], [], []
    for i, first in enumerate(starts):
        stop = starts[i + 1] if i + 1 < len(starts) else len(es)
        pes = data[ends[first] : ends[stop]]
        if pes[:3] != b"\x00\x00\x01" or int.from_bytes(pes[4:6], "big") != len(pes) - 6:
            raise ValueError("an elementary packet is damaged")
        if pes[7] & 0x80:
            t = pes[9:14]
            stamps.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1)
            if rap[first]:
                raps.append(stamps[-1])
        payload.append(pes[9 + pes[8] :])
    return {"program": program, "pmt_pid": pmt_pid, "stream_type": stream_type, "es_pid": es_pid, "packets": len(m), "continuity_errors": breaks, "pts": stamps, "random_access": raps, "payload": b"".join(payload)}


def feature(read: dict) -> str:
    """Short description of a parsed stream."""
    stamps, raps = read["pts"], read["random_access"]
    return f"program={read['program']};pmt={read['pmt_pid']};stream={read['stream_type']}@{read['es_pid']};packets={read['packets']};breaks={read['continuity_errors']};units={len(stamps)};pts={stamps[0]}-{stamps[-1]};access={len(raps)}@{raps[0]}-{raps[-1]}"


def _write_rows(columns: tuple[str, ...]):
    def rows(batches):
        for batch in batches:
            data, bounds = tc.column_bytes(batch.column("text"))
            sent, sizes, streams, held = 0, [], [], 0
            for i in range(len(bounds) - 1):
                text = data[bounds[i] : bounds[i + 1]].tobytes()
                sizes.append(len(text))
                streams.append(write_stream(pad(text)))
                held += len(streams[-1])
                if held > FLUSH or i == len(bounds) - 2:
                    yield pa.RecordBatch.from_arrays([batch.column(c).slice(sent, len(sizes)) for c in columns] + [pa.array(sizes, pa.int64()), pa.array(streams, pa.binary())], names=[*columns, "n_bytes", "media"])
                    sent, sizes, streams, held = i + 1, [], [], 0

    return rows


_FOUND = (("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pts", pa.list_(pa.int64())), ("random_access", pa.list_(pa.int64())))


def _read_rows(columns: tuple[str, ...]):
    def rows(batches):
        for batch in batches:
            out = []
            for media in batch.column("media"):
                media = media.as_buffer().to_pybytes()
                read = read_stream(media)
                back = read["payload"]
                out.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), feature(read), read["pts"], read["random_access"]))
            found = list(zip(*out, strict=True)) or [()] * len(_FOUND)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(v, kind) for v, (_, kind) in zip(found, _FOUND, strict=True)], names=[*columns, *(n for n, _ in _FOUND)])

    return rows


def _kinds(df: DataFrame, columns: tuple[str, ...]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def to_transport_streams(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each text as a transport stream: `columns`, n_bytes (of the text) and media.

    A null text is empty, and stored as one block of spaces; an empty table gives no rows.  A text of any
    length becomes one stream, and a batch is passed on when its streams fill 8 MB, so memory holds one text and its
    stream beyond that.  Equal texts give equal streams; rows are handled one by one, so repeats
    are each stored, and other columns, whatever their names, are ignored."""
    small_batches(docs.sparkSession)
    return docs.select(*(F.col(f"`{c}`") for c in columns), F.col("text")).mapInArrow(tc.releasing(_write_rows(columns)), f"{_kinds(docs, columns)}, n_bytes long, media binary")


def describe_transport_streams(stored: DataFrame, columns: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """What reading each stream of the column media finds: `columns`, payload_bytes, payload_sha256, tail_crc32 (of the
    payload's last 16 bytes), media_bytes, media_sha256, feature, pts and random_access (time stamps in ticks of 90 kHz).

    A damaged or null stream raises ValueError; an empty table gives no rows; repeated rows are each described."""
    return stored.select(*(F.col(f"`{c}`") for c in columns), F.coalesce("media", F.lit(b"")).alias("media")).mapInArrow(tc.releasing(_read_rows(columns)), f"{_kinds(stored, columns)}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<long>")


def store_transport_streams(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Store each text as a transport stream in a table in the shared folder, and describe what reading the stored bytes finds.

    Columns and odd rows: see to_transport_streams and describe_transport_streams."""
    return describe_transport_streams(save(to_transport_streams(docs, columns), compression="zstd"), (*columns, "n_bytes"))
