"""MPEG transport streams as a media column: write, parse, check, reassemble.

A payload is cut into access units, each one elementary packet (PES) with a
presentation timestamp; units that begin a group are random-access points and
carry a clock reference. Program tables precede each group. The parser puts
sections together over any number of packets, follows every version of the
association table to the map tables to the elementary streams, checks sync
bytes, section checksums and continuity counters (a break that a packet
announces is none), drops repeated packets, and puts the elementary packets
together again.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_in_arrow, stored, table

PACKET, PMT_PID, ES_PID, PRIVATE_DATA, PRIVATE_STREAM = 188, 0x1000, 0x100, 0x06, 0xBD
#: Bytes of an access unit, units of a group, ticks (of 90 kHz) of a unit.
UNIT, GROUP, TICKS = 8192, 16, 3003


@functools.cache
def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c >> 31 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


def crc32_mpeg(data: bytes) -> int:
    c, t = 0xFFFFFFFF, _crc_table()
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ t[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    """A section with its checksum, behind a pointer field."""
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255]) + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return b"\x00" + head + body + crc32_mpeg(head + body).to_bytes(4, "big")


@functools.cache
def _tables() -> tuple[bytes, bytes]:
    """Payloads of the association and the map table, filled up to a packet."""
    pat = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    es = bytes([PRIVATE_DATA]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"
    pmt = _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + es)
    return pat.ljust(184, b"\xff"), pmt.ljust(184, b"\xff")


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, pts >> 14 & 254 | 1, pts >> 7 & 255, pts << 1 & 254 | 1])


def mux(payload: bytes) -> bytes:
    """A transport stream that holds ``payload`` (not empty)."""
    pat, pmt = _tables()
    out, cc, tables = [], 0, 0
    es = [bytes([0x47, ES_PID >> 8, ES_PID & 255]), bytes([0x47, 0x40 | ES_PID >> 8, ES_PID & 255])]
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit, pts, point = payload[at : at + UNIT], k * TICKS & (1 << 33) - 1, k % GROUP == 0
        if point:
            for pid, body in ((0, pat), (PMT_PID, pmt)):
                out.append(bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10 | tables]) + body)
            tables = tables + 1 & 15
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + unit
        # the first packet of a random-access point says so and has the clock: base, six reserved bits, no extension
        field_ = b"\x50" + (pts << 15 | 0x7E00).to_bytes(6, "big") if point else b""
        begin, first = 0, 1
        while begin < len(pes):
            room = 184 - (len(field_) + 1 if field_ else 0)
            chunk = pes[begin : begin + room]
            begin += len(chunk)
            fill = room - len(chunk)
            if field_ or fill:
                if not field_ and fill == 1:
                    extra = b"\x00"
                else:
                    own = field_ or b"\x00"
                    fill -= 0 if field_ else 2
                    extra = bytes([len(own) + fill]) + own + b"\xff" * fill
                out.append(es[first] + bytes([0x30 | cc]) + extra + chunk)
            else:
                out.append(es[first] + bytes([0x10 | cc]) + chunk)
            cc, first, field_ = cc + 1 & 15, 0, b""
    return b"".join(out)


@dataclass
class Stream:
    """An elementary stream: type, packets, counter breaks, units as (timestamp or None, random access, offset, length), data."""

    pid: int
    kind: int
    packets: int = 0
    repeated: int = 0
    breaks: int = 0
    units: list[tuple[int | None, bool, int, int]] = field(default_factory=list)
    data: bytes = b""


def _sections(pk: np.ndarray, body_at: np.ndarray, start: np.ndarray, rows: np.ndarray, table_id: int) -> Iterator[bytes]:
    """Bodies of the current sections with ``table_id`` in packets ``rows``, in order; sections may share packets and go on in later ones."""
    held = None
    for i in rows.tolist():
        data = pk[i, body_at[i] :].tobytes()
        if start[i]:
            # the pointer says where the first new section begins; what is ahead of it ends the one before
            data, tail = data[1 + data[0] :], data[1 : 1 + data[0]]
            if held:
                yield from _whole(held + tail, table_id)[0]
            held = b""
        elif held is None:
            continue
        found, held = _whole(held + data, table_id)
        yield from found


def _whole(data: bytes, table_id: int) -> tuple[list[bytes], bytes]:
    """Bodies of the whole sections that ``data`` begins with, and the rest."""
    out, at = [], 0
    while len(data) - at >= 3 and data[at] != 0xFF:
        end = at + 3 + (int.from_bytes(data[at + 1 : at + 3], "big") & 0xFFF)
        if end > len(data):
            break
        if crc32_mpeg(data[at:end]):
            raise ValueError("a section's checksum is wrong")
        if data[at] == table_id and data[at + 5] & 1:  # it applies now
            out.append(data[at + 8 : end - 4])
        at = end
    return out, b"" if data[at : at + 1] == b"\xff" else data[at:]


def demux(ts: bytes) -> list[Stream]:
    """The elementary streams that the program tables name, in the order in which they do. Raises ValueError on lost sync, missing tables, bad checksums or packets."""
    if not ts or len(ts) % PACKET:
        raise ValueError("not a whole number of packets")
    pk = np.frombuffer(ts, np.uint8).reshape(-1, PACKET)
    if (pk[:, 0] != 0x47).any():
        raise ValueError("a packet has no sync byte")
    pid = (pk[:, 1].astype(np.int64) & 0x1F) << 8 | pk[:, 2]
    start, control, counter = pk[:, 1] >> 6 & 1, pk[:, 3] >> 4 & 3, pk[:, 3].astype(np.int64) & 15
    field_size = np.where(control & 2, pk[:, 4].astype(np.int64) + 1, 0)
    if (field_size > PACKET - 4).any():
        raise ValueError("an adaptation field is longer than its packet")
    body_at = 4 + field_size
    flags = np.where((control & 2).astype(bool) & (pk[:, 4] > 0), pk[:, 5], 0)

    def rows_of(p: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Packets with a payload without repeated ones, the counter breaks among them, how many are repeated, how many there were."""
        rows = np.flatnonzero((pid == p) & (control & 1 == 1))
        if not len(rows):
            return rows, rows, 0, 0
        step = np.diff(counter[rows], prepend=counter[rows[0]] - 1) % 16
        again = (step == 0) & np.append(False, (pk[rows[1:], 4:] == pk[rows[:-1], 4:]).all(axis=1))
        broken = ~again & (step != 1) & (flags[rows] & 0x80 == 0)
        return rows[~again], rows[broken], int(again.sum()), len(rows)

    def tables(p: int, table_id: int) -> list[bytes]:
        found = list(dict.fromkeys(_sections(pk, body_at, start, rows_of(p)[0], table_id)))
        if not found:
            raise ValueError(f"no table in packets of id {p}")
        return found

    maps: dict[int, None] = {}
    for pat in tables(0, 0):
        for i in range(0, len(pat), 4):
            if int.from_bytes(pat[i : i + 2], "big"):
                maps[int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF] = None
    streams: dict[int, Stream] = {}
    for pmt in maps:
        for body in tables(pmt, 2):
            at = 4 + (int.from_bytes(body[2:4], "big") & 0xFFF)
            while at + 5 <= len(body):
                es = int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF
                streams.setdefault(es, Stream(es, body[at])).kind = body[at]
                at += 5 + (int.from_bytes(body[at + 3 : at + 5], "big") & 0xFFF)
    for s in streams.values():
        rows, broken, s.repeated, s.packets = rows_of(s.pid)
        s.breaks = len(broken)
        body = pk[rows][np.arange(PACKET) >= body_at[rows][:, None]].tobytes()
        ends = np.cumsum(PACKET - body_at[rows])
        begins = np.flatnonzero(start[rows])
        edges = [*(ends[begins] - (PACKET - body_at[rows[begins]])).tolist(), len(body)]
        pieces, offset = [], 0
        for i, at, end in zip(begins.tolist(), edges[:-1], edges[1:], strict=True):
            if body[at : at + 3] != b"\x00\x00\x01" or end - at < 9:
                raise ValueError("an elementary packet has no start code")
            size = int.from_bytes(body[at + 4 : at + 6], "big")
            if size and size != end - at - 6:
                raise ValueError(f"an elementary packet of {end - at - 6} bytes says {size}")
            pts = None
            if body[at + 7] & 0x80:
                b = body[at + 9 : at + 14]
                pts = (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1
            data = body[at + 9 + body[at + 8] : end]
            s.units.append((pts, bool(flags[rows[i]] & 0x40), offset, len(data)))
            offset += len(data)
            pieces.append(data)
        s.data = b"".join(pieces)
    return list(streams.values())


def padded(text: str | bytes | None) -> bytes:
    """UTF-8 and zeros up to a positive multiple of 64."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))


def media_column(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` of ``docs`` and media, the transport stream of the text (null: empty), whole and padded to 64 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = [mux(padded(t)) for t in b.column(len(keep)).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(media, pa.binary())], [*keep, "media"])

    rows = docs.select(*keep, F.col("text").alias("loomtext_text"))
    return rows.transform(map_in_arrow, run, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1]) + ", media binary")


def access_units(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row for each access unit of the column's streams: key, pid, unit, pts, random_access, start, size, breaks (of its stream). Null media have none."""

    schema = pa.schema([("pid", pa.int32()), ("unit", pa.int32()), ("pts", pa.int64()), ("random_access", pa.bool_()), ("start", pa.int64()), ("size", pa.int64()), ("breaks", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, ts in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                rows = [(s.pid, i, *u, s.breaks) for s in (demux(ts) if ts else []) for i, u in enumerate(s.units)]
                out = table(rows, schema)
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(rows), b.schema.field(0).type), *out.columns], [key, *schema.names])

    kind = dict(media.dtypes)[key]
    return media.select(key, column).transform(map_in_arrow, run, f"`{key}` {kind}, pid int, unit int, pts bigint, random_access boolean, start bigint, size bigint, breaks bigint")


def media_digests(docs: DataFrame) -> DataFrame:
    """What reading the stored streams of ``docs`` (doc_id, text) gives, one row for each.

    doc_id, n_bytes (of the text), payload_bytes, payload_sha256, tail_crc32 (the
    last 64 bytes), media_bytes, media_sha256, feature: the stream's id and type,
    packets, counter breaks, units, random-access points, last timestamp, and the
    CRC-32 of all units as timestamp:random access:offset. The streams are
    written as a table with a media column, and all but n_bytes comes from
    reading that table. A null or empty text is 64 zero bytes; null ids and
    repeated rows come back as given; other columns aren't read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, n_bytes, ts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                (s,) = demux(ts)
                points = sum(u[1] for u in s.units)
                units = zlib.crc32(",".join(f"{pts}:{point:d}:{at}" for pts, point, at, _ in s.units).encode())
                feature = f"pid={s.pid};type={s.kind};packets={s.packets};breaks={s.breaks};units={len(s.units)};points={points};last_pts={s.units[-1][0]};units_crc32={units}"
                rows.append((doc, n_bytes, len(s.data), hashlib.sha256(s.data).hexdigest(), zlib.crc32(s.data[-64:]), len(ts), hashlib.sha256(ts).hexdigest(), feature))
            yield table(rows, schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    media = stored(media_column(rows, keep=("doc_id", "n_bytes")), compression="zstd")
    kinds = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return media.transform(map_in_arrow, run, kinds)
