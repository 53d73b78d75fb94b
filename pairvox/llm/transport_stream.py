"""Operator 2: payloads as MPEG transport streams (ISO/IEC 13818-1), and a reader that checks and reassembles them.

Written: a program association and a program map section before every random-access point, packetised elementary
stream (PES) packets of private data with presentation timestamps, program clock references and random-access flags in
adaptation fields, and a continuity counter for each packet identifier (PID). Read: all of that, verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairvox.llm.common import named, table

# Fixed values of the format.
PACKET, SYNC, PAT_PID, STREAM_ID, PRIVATE_PES = 188, 0x47, 0x0000, 0xBD, 0x06
CLOCK_HZ = 90_000

#: Bytes in a PES packet; how many PES packets from one random-access point to the next; 90 kHz ticks between timestamps.
UNIT_BYTES, UNITS_PER_POINT, TICKS = 8192, 4, 3600
PMT_PID, MEDIA_PID, PROGRAM = 0x0100, 0x0101, 1

#: Output rows are handed on once they hold this many bytes, however many rows an input batch has.
FLUSH_BYTES = 8 << 20

MEDIA_SCHEMA = "media binary"
READ_SCHEMA = (
    "payload binary, program int, stream_type int, media_pid int, packets long, sync_errors long, section_errors long, continuity_errors long, "
    "pcrs long, access_points array<struct<pts: long, byte_offset: long, random_access: boolean>>"
)


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def section_crc(section: bytes) -> int:
    """CRC-32/MPEG-2; over a section with its own CRC it is 0."""
    c = 0xFFFFFFFF
    for b in section:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF]) + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section).ljust(PACKET, b"\xff")


PAT = _table_packet(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
PMT = _table_packet(PMT_PID, _section(2, PROGRAM, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_PES]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _timestamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | t >> 29 & 0x0E | 1, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def write_stream(payload: bytes) -> bytes:
    """A transport stream that carries payload; an empty one has its tables alone."""
    out, media_count, table_count = [], 0, 0
    for k, at in enumerate(range(0, max(len(payload), 1), UNIT_BYTES)):
        point = k % UNITS_PER_POINT == 0
        if point:
            for packet in (PAT, PMT):
                packet = bytearray(packet)
                packet[3] |= table_count & 15
                out.append(bytes(packet))
            table_count += 1
        if at >= len(payload):
            break
        unit, pts = payload[at : at + UNIT_BYTES], k * TICKS
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(2, pts) + unit
        rows, media_count = _unit_packets(pes, pts, point, media_count)
        out.append(rows)
    return b"".join(out)


def _unit_packets(pes: bytes, pts: int, point: bool, count: int) -> tuple[bytes, int]:
    first_room, room = PACKET - 12, PACKET - 4
    first = pes[:first_room]
    middle = max(0, len(pes) - first_room) // room
    tail = pes[first_room + middle * room :]
    n = 1 + middle + bool(tail)
    p = np.full((n, PACKET), 0xFF, np.uint8)
    p[:, 0], p[:, 1], p[:, 2] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 0xFF
    p[:, 3] = 0x10 | (count + np.arange(n)) & 15
    p[0, 1] |= 0x40
    p[0, 3] |= 0x20
    p[0, 4] = PACKET - 5 - len(first)
    p[0, 5] = 0x10 | 0x40 * point
    p[0, 6:12] = list((pts << 15 | 0x7E00).to_bytes(6, "big"))  # program clock reference: base, six reserved bits, extension 0
    p[0, PACKET - len(first) :] = np.frombuffer(first, np.uint8)
    if middle:
        p[1 : 1 + middle, 4:] = np.frombuffer(pes, np.uint8, middle * room, first_room).reshape(middle, room)
    if tail:
        p[-1, 3] |= 0x20
        p[-1, 4] = room - 1 - len(tail)
        if len(tail) < room - 1:
            p[-1, 5] = 0
        p[-1, PACKET - len(tail) :] = np.frombuffer(tail, np.uint8)
    return p.tobytes(), (count + n) & 15


def _program_tables(p: np.ndarray, pid: np.ndarray, start: np.ndarray) -> tuple[dict, int]:
    """What the sections say: program, its map's PID, stream type and media PID; and how many sections fail their CRC."""
    found: dict[str, int] = {}
    bad = 0

    def sections(of: int, table_id: int) -> Iterator[bytes]:
        nonlocal bad
        kinds = {p[i, 5 + p[i, 4] :].tobytes(): 0 for i in np.flatnonzero((pid == of) & start)}
        for raw in kinds:
            section = raw[: 3 + ((raw[1] & 0x0F) << 8 | raw[2])]
            if raw[0] != table_id or section_crc(section):
                bad += 1
            else:
                yield section

    for s in sections(PAT_PID, 0):
        for i in range(8, len(s) - 4, 4):
            if number := s[i] << 8 | s[i + 1]:
                found |= {"program": number, "map": (s[i + 2] & 0x1F) << 8 | s[i + 3]}
    if "map" in found:
        for s in sections(found["map"], 2):
            i = 12 + ((s[10] & 0x0F) << 8 | s[11])
            if i + 5 <= len(s) - 4:
                found |= {"stream_type": s[i], "media": (s[i + 1] & 0x1F) << 8 | s[i + 2]}
    return found, bad


def read_stream(media: bytes) -> tuple:
    """A row of READ_SCHEMA. Packets that lost their sync byte are counted and left out; bytes after the last whole packet too."""
    p = np.frombuffer(media, np.uint8, len(media) // PACKET * PACKET).reshape(-1, PACKET)
    lost = int((p[:, 0] != SYNC).sum()) + bool(len(media) % PACKET)
    if lost:
        p = p[p[:, 0] == SYNC]
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    start, control, count = p[:, 1] & 0x40 > 0, p[:, 3] >> 4 & 3, p[:, 3] & 15
    tables, bad = _program_tables(p, pid, start)
    gaps = 0
    for k in np.unique(pid):
        c = count[(pid == k) & (control & 1 > 0)].astype(np.int8)
        gaps += int(((np.diff(c) & 15) != 1).sum())
    own = np.flatnonzero((pid == tables.get("media", -1)) & (control & 1 > 0))
    m, field = p[own], control[own] & 2 > 0
    offset = 4 + np.where(field, 1 + m[:, 4].astype(np.int32), 0)
    flags = np.where(field & (m[:, 4] > 0), m[:, 5], 0)
    data = m[np.arange(PACKET) >= offset[:, None]]
    ends = np.cumsum(PACKET - offset)
    begins = np.append((ends - (PACKET - offset))[start[own]], ends[-1] if len(ends) else 0)
    raw, parts, points, done = data.tobytes(), [], [], 0
    for at, end, flag in zip(begins[:-1].tolist(), begins[1:].tolist(), flags[start[own]].tolist(), strict=True):
        if raw[at : at + 3] != b"\x00\x00\x01":
            gaps += 1
            continue
        h = raw[at : at + 14]
        size = h[4] << 8 | h[5]
        body = raw[at + 9 + h[8] : min(end, at + 6 + size)]
        pts = (h[9] & 0x0E) << 29 | h[10] << 22 | (h[11] & 0xFE) << 14 | h[12] << 7 | h[13] >> 1 if h[7] & 0x80 else None
        points.append((pts, done, bool(flag & 0x40)))
        parts.append(body)
        done += len(body)
    return (
        b"".join(parts), tables.get("program"), tables.get("stream_type"), tables.get("media"), len(p), lost, bad, gaps, int((flags & 0x10 > 0).sum()), points,
    )


def mux(df: DataFrame, payload: str = "payload") -> DataFrame:
    """df with `payload` turned into a transport stream in a binary column `media`, which replaces one of that name; other columns pass through.

    A null counts as empty and gives the tables alone. Payloads of any length are cut into packets of their own row;
    repeated rows are rows of their own, and equal payloads give equal streams. No rows give no rows.
    """
    rest = [c for c in df.columns if c not in (payload, "media")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _parts(pdf, "body"):
                yield part[names].assign(media=[write_stream(bytes(x or b"")) for x in part["body"]])

    slim, names = _slim(df, rest, payload)
    return slim.mapInPandas(run, f"{_ddl(slim, names)}{MEDIA_SCHEMA}").toDF(*rest, "media")


def demux(df: DataFrame, media: str = "media") -> DataFrame:
    """df with the columns of READ_SCHEMA read from the streams in `media`; columns of these names are replaced.

    A null counts as an empty stream. Streams are read whole, at any length; repeated rows are read each.
    """
    own = [x.split()[0] for x in READ_SCHEMA.replace("struct<pts: long, byte_offset: long, random_access: boolean>", "x").split(", ")]
    rest = [c for c in df.columns if c not in own]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _parts(pdf, "body"):
                rows = [read_stream(bytes(x or b"")) for x in part["body"]]
                out = pd.DataFrame({n: [r[i] for r in rows] for i, n in enumerate(own[:-1])}, index=part.index)
                out[own[-1]] = [[{"pts": a, "byte_offset": b, "random_access": c} for a, b, c in r[-1]] for r in rows]
                yield pd.concat([part[names], out], axis=1)

    slim, names = _slim(df, rest, media)
    return slim.mapInPandas(run, f"{_ddl(slim, names)}{READ_SCHEMA}").toDF(*rest, *own)


def _slim(df: DataFrame, rest: list[str], body: str) -> tuple[DataFrame, list[str]]:
    """`body` and the columns `rest` under neutral names, as a name with a dot can't go through pandas; and these names."""
    names = [f"c{i}" for i in range(len(rest))]
    return df.select(*(named(c).alias(n) for c, n in zip(rest, names, strict=True)), named(body).alias("body")), names


def _ddl(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name in names)


def _parts(pdf: pd.DataFrame, column: str) -> Iterator[pd.DataFrame]:
    """Row runs of about FLUSH_BYTES, so that a batch of very long rows isn't held in several forms at once."""
    if len(pdf):
        sizes = pdf[column].map(lambda x: len(x) if x is not None else 0).cumsum() // FLUSH_BYTES
        for _, part in pdf.groupby(sizes.to_numpy(), sort=True):
            yield part


def padded_payload(text: str = "text"):
    """The UTF-8 bytes of a text (null: empty) and zero bytes up to a positive multiple of 64."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    missing = F.when(F.octet_length(body) == 0, F.lit(64)).otherwise(F.pmod(-F.octet_length(body), F.lit(64)))
    return F.concat(body, F.unhex(F.repeat(F.lit("00"), missing.cast("int"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    read = demux(mux(docs.select("doc_id", n_bytes, padded_payload().alias("payload"))))
    points = F.col("access_points")
    feature = F.concat_ws(
        ";",
        F.format_string("program=%d,%d,%d", "program", "stream_type", "media_pid"),
        F.format_string("packets=%d", "packets"),
        F.format_string("errors=%d,%d,%d", "sync_errors", "section_errors", "continuity_errors"),
        F.format_string("pcr=%d", "pcrs"),
        F.format_string("random_access=%d/%d", F.size(F.filter(points, lambda x: x["random_access"])), F.size(points)),
        F.format_string("pts=%d-%d", F.get(points, F.lit(0))["pts"], F.get(points, F.size(points) - 1)["pts"]),
    )
    return read.select(
        "doc_id", "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
