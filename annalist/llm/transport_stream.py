"""MPEG transport streams as a media column: 8-bit samples in 188-byte packets.

Writing. A program association table and a program map table (with CRC-32/MPEG-2) lead and come again before every random-access point; samples go
into elementary packets (PES, private stream 1) of UNIT bytes, each with a presentation time stamp at
RATE samples a second on the 90 kHz clock; every RAP_EVERY-th unit is a random-access point,
announced by a packet with a clock reference and marked in the adaptation field.

Reading. Packets are found by their sync bytes, and where those are lost the next place is looked for that has one
and another a packet later; tables are parsed and checked; per PID the
continuity counters are checked, repeated packets skipped; elementary packets are reassembled and
their time stamps and random-access points listed. Broken input does not raise: `errors` counts
what was wrong, and what can be read is read.

Columns. `encode_column` makes the media column; `probe_column` reads one and gives samples, time stamps, random-access
points (stamp and packet) and counters as columns; `store_and_read` derives digests from both.

Packets of a stream are handled as one numpy matrix. Defined results: an empty sample string is a
stream of the two tables; null text = empty (the payload is then its padding); repeated rows are
stored row by row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import map_rows, ship, whole

PACKET, UNIT, RATE, RAP_EVERY = 188, 4032, 8000, 8
PMT_PID, MEDIA_PID, PROGRAM, STREAM_TYPE, STREAM_ID = 0x100, 0x101, 1, 0x06, 0xBD
TICKS = 90_000


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_crc = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _crc[(c >> 24) ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc32_mpeg(head + body))


_PAT = _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
_PMT = _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | MEDIA_PID, 0xF000, STREAM_TYPE, 0xE000 | MEDIA_PID, 0xF006) + b"\x05\x04RAW8")


def _tables(counter: int) -> bytes:
    return b"".join((struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10 | counter & 15) + b"\x00" + section).ljust(PACKET, b"\xff") for pid, section in ((0, _PAT), (PMT_PID, _PMT)))


def _stamp(mark: int, pts: int) -> bytes:
    pts &= (1 << 33) - 1
    return struct.pack(">BHH", mark << 4 | (pts >> 30) << 1 | 1, (pts >> 15 & 0x7FFF) << 1 | 1, (pts & 0x7FFF) << 1 | 1)


def _pes(unit: bytes, pts: int) -> bytes:
    return b"\x00\x00\x01" + struct.pack(">BHBBB", STREAM_ID, len(unit) + 8, 0x80, 0x80, 5) + _stamp(2, pts) + unit


def _clock(pts: int, counter: int) -> bytes:
    base = pts & ((1 << 33) - 1)
    return (struct.pack(">BHBBB", 0x47, MEDIA_PID, 0x20 | counter, 183, 0x50) + struct.pack(">IH", base >> 1, (base & 1) << 15 | 0x7E00)).ljust(PACKET, b"\xff")


def mux(samples: bytes) -> bytes:
    out, counter = [] if samples else [_tables(0)], -1
    for k, at in enumerate(range(0, len(samples), UNIT)):
        pts, rap = at * TICKS // RATE, k % RAP_EVERY == 0
        if rap:
            out.append(_tables(k // RAP_EVERY))
            out.append(_clock(pts, counter & 15))
        pes = _pes(samples[at : at + UNIT], pts)
        first = 182
        n = 1 + max(0, -(-(len(pes) - first) // 184))
        flags = 0x40 if rap else 0
        if n == 1:  # the whole unit in one packet, stuffed
            pad = 183 - len(pes)
            counter += 1
            out.append(struct.pack(">BHBBB", 0x47, 0x4000 | MEDIA_PID, 0x30 | counter & 15, pad, flags) + b"\xff" * (pad - 1) + pes)
            continue
        body = np.zeros((n, PACKET), np.uint8)
        body[:, 0] = 0x47
        body[:, 1], body[0, 1] = MEDIA_PID >> 8, 0x40 | MEDIA_PID >> 8
        body[:, 2] = MEDIA_PID & 255
        body[:, 3] = 0x10 | (np.arange(counter + 1, counter + 1 + n) & 15)
        counter += n
        body[0, 3] |= 0x20
        body[0, 4:6] = 1, flags
        data = np.frombuffer(pes, np.uint8)
        body[0, 6:] = data[:first]
        last = len(pes) - first - 184 * (n - 2)
        body[1 : n - 1, 4:] = data[first : first + 184 * (n - 2)].reshape(-1, 184)
        pad = 184 - last
        if pad:
            body[n - 1, 3] |= 0x20
            body[n - 1, 4] = pad - 1
            if pad > 1:
                body[n - 1, 5] = 0
                body[n - 1, 6 : 4 + pad] = 255
        body[n - 1, PACKET - last :] = data[len(pes) - last :]
        out.append(body.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    samples: bytes = b""
    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    stamps: list[int] = field(default_factory=list)
    random_access: list[tuple[int, int]] = field(default_factory=list)
    clocks: int = 0
    discontinuities: int = 0
    duplicates: int = 0
    errors: int = 0


def _parse_section(packet: np.ndarray, table: int) -> bytes | None:
    raw = packet.tobytes()
    at = 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
    if at >= PACKET or at + 1 + raw[at] + 3 > PACKET:
        return None
    at += 1 + raw[at]
    size = (raw[at + 1] & 15) << 8 | raw[at + 2]
    section = raw[at : at + 3 + size]
    if raw[at] != table or size < 9 or len(section) < 3 + size or crc32_mpeg(section):
        return None
    return section[8:-4]


def _packets(data: bytes) -> tuple[np.ndarray, int]:
    """All packets as a matrix, and how often the sync was lost or bytes were left over.

    A single wrong head is one broken packet. Where two in a row are wrong, bytes were lost or added in the packet
    before: it is left out, and reading goes on at the next byte that begins three packets (or the last ones).
    """
    x = np.frombuffer(data, np.uint8)
    head = x == 0x47
    ahead = lambda k: np.concatenate([head[k:], np.ones(min(k, len(x)), bool)])
    sync = np.flatnonzero(head & ahead(PACKET) & ahead(2 * PACKET))
    sync = sync[sync + PACKET <= len(x)]
    parts, at, lost = [], 0, 0
    while at < len(x):
        k = int(np.searchsorted(sync, at))
        if k == len(sync):
            lost += 1
            break
        start = int(sync[k])
        lost += start != at
        bad = ~head[start::PACKET]
        gone = np.flatnonzero(bad & np.append(bad[1:], True))
        n = max(1, int(gone[0]) - 1) if len(gone) else (len(x) - start) // PACKET
        parts.append(x[start : start + n * PACKET].reshape(-1, PACKET))
        at = start + n * PACKET
    return np.concatenate(parts) if parts else np.zeros((0, PACKET), np.uint8), lost


def demux(data: bytes) -> Stream:
    s = Stream()
    m, s.errors = _packets(data)
    good = (m[:, 0] == 0x47) & (m[:, 1] & 0x80 == 0)
    s.errors += int((~good).sum()) + (not len(m))
    m = m[good]
    s.packets = len(m)
    pid = (m[:, 1].astype(np.int32) & 0x1F) << 8 | m[:, 2]
    for p in m[pid == 0]:
        if (body := _parse_section(p, 0)) is None:
            s.errors += 1
            continue
        for k in range(0, len(body) - 3, 4):
            number, to = struct.unpack(">HH", body[k : k + 4])
            s.programs[number] = to & 0x1FFF
    for to in s.programs.values():
        for p in m[pid == to]:
            if (body := _parse_section(p, 2)) is None:
                s.errors += 1
                continue
            k = 4 + ((body[2] & 15) << 8 | body[3])
            while k + 5 <= len(body):
                kind, own, size = struct.unpack(">BHH", body[k : k + 5])
                s.streams[own & 0x1FFF] = kind
                k += 5 + (size & 0xFFF)
    parts = [_elementary(m[pid == own], s) for own in sorted(s.streams)]
    s.samples = b"".join(parts)
    return s


def _elementary(m: np.ndarray, s: Stream) -> bytes:
    if not len(m):
        return b""
    control = m[:, 3]
    has_field, has_data = (control & 0x20) > 0, (control & 0x10) > 0
    size = np.where(has_field, m[:, 4].astype(np.int32), -1)
    flags = np.where(size > 0, m[:, 5], 0)
    clock = flags & 0x10 > 0
    s.clocks += int(clock.sum())
    d = np.flatnonzero(has_data)
    if not len(d):
        return b""
    counter = control[d] & 15
    step = (counter[1:].astype(np.int16) - counter[:-1]) % 16
    same = (step == 0) & (m[d[1:], 4:] == m[d[:-1], 4:]).all(axis=1) if (step == 0).any() else np.zeros(len(step), bool)
    s.duplicates += int(same.sum())
    s.discontinuities += int(((step != 1) & ~same).sum())
    d = d[np.concatenate([[True], ~same])]
    begin = np.minimum(5 + size[d], PACKET)  # without a field: 4
    starts = (m[d, 1] & 0x40) > 0
    flat = m[d][np.arange(PACKET) >= begin[:, None]].tobytes()
    at = np.concatenate([[0], np.cumsum(PACKET - begin)])
    heads = np.flatnonzero(starts)
    if not len(heads) or heads[0]:
        s.errors += 1  # data without a head
    out = []
    for i, k in enumerate(heads):
        a, b = int(at[k]), int(at[heads[i + 1]]) if i + 1 < len(heads) else int(at[-1])
        pes = flat[a:b]
        if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
            s.errors += 1
            continue
        size_, head = struct.unpack(">H", pes[4:6])[0], 9 + pes[8]
        if size_ and size_ + 6 > len(pes):
            s.errors += 1
        if pes[7] & 0x80 and len(pes) >= 14:
            x, y, z = struct.unpack(">BHH", pes[9:14])
            pts = (x >> 1 & 7) << 30 | (y >> 1) << 15 | z >> 1
            s.stamps.append(pts)
            if flags[d[k]] & 0x40:
                s.random_access.append((pts, int(k)))
        out.append(pes[head : size_ + 6] if size_ else pes[head:])
    return b"".join(out)


def payload_of(text: str, block: int = 192) -> tuple[bytes, int]:
    """The text as UTF-8, padded by blanks to a positive multiple of block; the length without padding."""
    raw = text.encode()
    return raw.ljust(max(block, -(-len(raw) // block) * block), b" "), len(raw)


def encode_column(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, n_bytes (of the text as UTF-8) and media: the transport stream of each text's payload."""
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))

    def run(texts: list[str]) -> list[tuple]:
        return [(n, mux(payload)) for payload, n in map(payload_of, texts)]

    return map_rows(src, run, f"id {kind}, n_bytes long, media binary", ["n_bytes", "media"]).withColumnRenamed("id", id_col)


PROBED = {
    "packets": "bigint", "samples": "binary", "stamps": "array<bigint>", "random_access": "array<struct<stamp:bigint,packet:bigint>>", "clocks": "bigint",
    "programs": "bigint", "streams": "bigint", "discontinuities": "bigint", "duplicates": "bigint", "errors": "bigint", "level_sum": "bigint", "level_squares": "bigint",
}


def probe_column(media: DataFrame, media_col: str) -> DataFrame:
    """media, all columns, and what each stream holds: those of PROBED, in place of columns so named. Null media = empty.

    random_access: stamp and place among the stream's media packets. level_sum and level_squares: of the samples.
    """
    keep = [c for c in media.columns if c not in PROBED]
    fields = [f for f in media.schema.fields if f.name in keep]
    place = keep.index(media_col)
    ship(media.sparkSession)
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.struct([("stamp", pa.int64()), ("packet", pa.int64())])), *[pa.int64()] * 8]

    def row(data: bytes | None) -> tuple:
        s = demux(data or b"")
        levels = np.bincount(np.frombuffer(s.samples, np.uint8), minlength=256)
        return s.packets, s.samples, s.stamps, [{"stamp": p, "packet": k} for p, k in s.random_access], s.clocks, len(s.programs), len(s.streams), s.discontinuities, s.duplicates, s.errors, int(levels @ np.arange(256)), int(levels @ np.arange(256) ** 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, len(whole_batch), 256):
                b = whole_batch.slice(at, 256)
                rows = [row(x) for x in b.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=[*keep, *PROBED])

    schema = StructType(fields + StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in PROBED.items())).fields)
    return media.select(*(F.col(f"`{c}`") for c in keep)).mapInArrow(run, schema)


def feature() -> Column:
    """What a stream shows when read, from the columns of probe_column: structure, timing and the samples' level."""
    raps = F.array_join(F.transform("random_access", lambda r: r["stamp"].cast("string")), ",")
    parts = {
        "packets": F.col("packets"), "units": F.size("stamps"), "first": F.coalesce(F.get("stamps", F.lit(0)), F.lit(-1)), "last": F.coalesce(F.get("stamps", F.size("stamps") - 1), F.lit(-1)),
        "raps": F.size("random_access"), "rap_crc": F.crc32(raps), "clocks": F.col("clocks"), "gaps": F.col("discontinuities"), "errors": F.col("errors"),
        "samples": F.octet_length("samples"), "sum": F.col("level_sum"), "square": F.col("level_squares"),
    }
    return F.concat_ws(";", *(F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in parts.items()))


def store_and_read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Digests of each text's payload, stored as a stream in a media column and read back from it, with its stamps and random-access points."""
    d = probe_column(encode_column(docs, id_col, text_col), "media")
    tail = F.substring(F.col("samples"), F.greatest(F.octet_length("samples") - 15, F.lit(1)), F.lit(16))
    return d.select(
        id_col, "n_bytes", F.octet_length("samples").cast("bigint").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature().alias("feature"), "stamps", F.transform("random_access", lambda r: r["stamp"]).alias("random_access"),
    )
