"""MPEG audio columns: stores bytes in valid frames, and reads streams: tags, variable-bitrate tables, checksums, offsets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from candlewick.llm import textops as X

#: Fixed values of the MPEG audio formats: kbit/s by (version 1 or not, layer), Hz by version bits, index 1 and on.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {0: (11025, 12000, 8000), 2: (22050, 24000, 16000), 3: (44100, 48000, 32000)}

#: What this module writes: MPEG-1 layer III, 32 kHz, mono; a payload is padded with spaces to a multiple of UNIT.
RATE, SIDE, UNIT = 32000, 17, 192
_LEAD = 4 + 2 + SIDE


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ (0x8005 if c & 0x8000 else 0)) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    """The checksum of a frame's protected bytes: polynomial 0x8005, from 0xFFFF."""
    c = 0xFFFF
    for b in data:
        c = (c << 8 ^ _CRC[c >> 8 ^ b]) & 0xFFFF
    return c


@dataclass(frozen=True)
class Header:
    version: int  # bits: 3 is MPEG-1, 2 MPEG-2, 0 MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    length: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of layer III's side information."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)

    def kind(self) -> tuple:
        return self.version, self.layer, self.rate


_headers: dict[bytes, Header | None] = {}


def header(four: bytes) -> Header | None:
    """A frame header, or None. Free-format frames, whose length the header doesn't tell, aren't taken."""
    if four in _headers:
        return _headers[four]
    made = None
    if len(four) == 4 and four[0] == 0xFF and four[1] & 0xE0 == 0xE0:
        version, layer, rate, bits = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3), four[2] >> 2 & 3, four[2] >> 4
        if version != 1 and layer != 4 and rate != 3 and 0 < bits < 15:
            kbps, hz, pad = BITRATES[version == 3, layer][bits - 1], RATES[version][rate], four[2] >> 1 & 1
            samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
            length = (12000 * kbps // hz + pad) * 4 if layer == 1 else samples * 125 * kbps // hz + pad
            made = Header(version, layer, not four[1] & 1, kbps, hz, four[3] >> 6 == 3, length, samples)
    if len(_headers) < 1 << 14:
        _headers[four] = made
    return made


def _frame(kbps: int, body: bytes, protect: bool = True) -> bytes:
    """A silent frame with body in its ancillary bytes."""
    four = bytes([0xFF, 0xFA if protect else 0xFB, BITRATES[True, 3].index(kbps) + 1 << 4 | 2 << 2, 0xC0])
    check = crc16(four[2:] + bytes(SIDE)).to_bytes(2, "big") if protect else b""
    return (four + check + bytes(SIDE) + body).ljust(header(four).length, b"\0")


_empty_frames: dict[int, bytes] = {}


def _led(kbps: int) -> bytes:
    """The bytes of a protected frame before its ancillary bytes."""
    if kbps not in _empty_frames:
        _empty_frames[kbps] = _frame(kbps, b"")[:_LEAD]
    return _empty_frames[kbps]


_CAPACITY = {kbps: 144 * kbps * 1000 // RATE - _LEAD for kbps in BITRATES[True, 3]}
_MOST = max(_CAPACITY.values())


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def store(payload: bytes) -> bytes:
    """A variable-bitrate MPEG stream that holds payload: an ID3v2.3 tag, a Xing frame, then frames with checksums."""
    frames = []
    for at in range(0, len(payload), _MOST):
        body = payload[at : at + _MOST]
        kbps = next(k for k, room in _CAPACITY.items() if room >= len(body))
        frames.append((_led(kbps) + body).ljust(_CAPACITY[kbps] + _LEAD, b"\0"))
    first = 144 * 32000 // RATE
    total = first + sum(map(len, frames))
    ends, at = [], first
    for f in frames:
        ends.append(at)
        at += len(f)
    seek = bytes(min(255, 256 * ends[i * len(frames) // 100] // total) for i in range(100)) if frames else bytes(100)
    xing = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + seek
    texts = [(b"TLEN", str(len(frames) * 1152 * 1000 // RATE).encode()), (b"TXXX", b"payload_bytes\0" + str(len(payload)).encode())]
    tag = b"".join(k + (len(v) + 1).to_bytes(4, "big") + b"\0\0\0" + v for k, v in texts)
    return b"ID3\3\0\0" + _syncsafe(len(tag)) + tag + _frame(32, xing, protect=False) + b"".join(frames)


@dataclass
class Stream:
    """What a stream holds. offsets: where each frame begins, without the one that carries a table."""

    tags: dict[str, str] = field(default_factory=dict)
    table: str | None = None
    told_frames: int | None = None
    told_bytes: int | None = None
    seek: bytes = b""
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    version: int = 0
    layer: int = 0
    bitrates: set[int] = field(default_factory=set)
    checked: int = 0
    bad: int = 0
    skipped: int = 0  # bytes outside tags and frames
    resyncs: int = 0
    audio_bytes: int = 0
    payload: bytes = b""


def _read_id3(data: bytes, out: Stream) -> int:
    """Reads a tag at the start; where audio may begin."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0
    size = data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]
    end, at = min(len(data), 10 + size), 10
    while at + 10 <= end and data[at] and data[3] >= 3:
        raw = data[at + 4 : at + 8]
        n = int.from_bytes(raw, "big") if data[3] == 3 else raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]
        body = data[at + 10 : min(end, at + 10 + n)]
        if data[at : at + 1] == b"T" and body:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            text = body[1:].decode(code, "replace").rstrip("\0")
            key = data[at : at + 4].decode("latin-1")
            if key == "TXXX" and "\0" in text:
                key, text = text.split("\0", 1)
            out.tags[key] = text
        at += 10 + n
    return 10 + size


def _read_table(frame: bytes, h: Header, out: Stream) -> bool:
    """Whether a frame carries a Xing, Info or VBRI table; reads it."""
    for at in (4 + h.side, 6 + h.side):
        if frame[at : at + 4] in (b"Xing", b"Info"):
            flags, p = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
            out.table = frame[at : at + 4].decode()
            for bit, name in ((1, "told_frames"), (2, "told_bytes")):
                if flags & bit:
                    setattr(out, name, int.from_bytes(frame[p : p + 4], "big"))
                    p += 4
            out.seek = frame[p : p + 100] if flags & 4 else b""
            return True
    if frame[36:40] == b"VBRI":
        out.table, out.told_bytes, out.told_frames = "VBRI", int.from_bytes(frame[46:50], "big"), int.from_bytes(frame[50:54], "big")
        entries, width = int.from_bytes(frame[54:56], "big"), int.from_bytes(frame[58:60], "big")
        out.seek = frame[62 : 62 + entries * width]
        return True
    return False


_checks: dict[bytes, int] = {}


def _protected_bytes(frame: bytes, h: Header) -> bytes | None:
    """What the checksum covers; of layer II it depends on tables that aren't kept here."""
    if h.layer == 3:
        return frame[2:4] + frame[6 : 6 + h.side]
    if h.layer == 1:
        joint = frame[3] >> 6 == 1
        bits = 4 * (32 if h.mono else 32 + 4 * ((frame[3] >> 4 & 3) + 1) if joint else 64)
        return frame[2:4] + frame[6 : 6 + bits // 8] if bits % 8 == 0 else None
    return None


def read(data: bytes) -> Stream:
    """Reads a stream; bytes that aren't frames are skipped to the next header that another one, or the end, confirms.

    The last 128 bytes are an ID3v1 tag if they begin like one, unless frames go on to the very end without one that ends
    before them: then they are bytes of frames.
    """
    end, tag = len(data), len(data) - 128
    out, ends = _read_to(data, end, tag)
    if data[-128:-125] == b"TAG" and (tag in ends or end not in ends):
        at = _read_id3(data, Stream())
        if tag >= at:
            out, _ = _read_to(data, tag, tag)
            out.tags.setdefault("TIT2", data[-125:-95].rstrip(b"\0 ").decode("latin-1"))
    return out


def _read_to(data: bytes, end: int, since: int) -> tuple[Stream, set[int]]:
    """What a stream holds before end, and where frames end from since on."""
    out, ends = Stream(), set()
    at = _read_id3(data, out)
    if at == since:
        ends.add(at)
    bodies, synced = [], True
    while at + 4 <= end:
        h = header(data[at : at + 4])
        fits = h is not None and at + h.length <= end and (not out.rate or h.kind() == (out.version, out.layer, out.rate))
        if fits and not (synced and out.rate):
            follow = header(data[at + h.length : at + h.length + 4])
            fits = at + h.length == end or (follow is not None and follow.kind() == h.kind())
        if not fits:
            out.resyncs += synced
            synced = False
            n = data.find(b"\xff", at + 1, end)
            out.skipped += (n if n >= 0 else end) - at
            at = n if n >= 0 else end
            continue
        synced = True
        frame = data[at : at + h.length]
        if at + h.length >= since:
            ends.add(at + h.length)
        out.version, out.layer, out.rate = h.kind()
        out.audio_bytes += h.length
        if not (out.offsets or out.table) and h.layer == 3 and _read_table(frame, h, out):
            at += h.length
            continue
        if h.protected and (covered := _protected_bytes(frame, h)) is not None:
            if covered not in _checks:
                if len(_checks) >= 1 << 14:
                    _checks.clear()
                _checks[covered] = crc16(covered)
            out.checked += 1
            out.bad += _checks[covered] != int.from_bytes(frame[4:6], "big")
        out.offsets.append(at)
        out.samples += h.samples
        out.bitrates.add(h.kbps)
        if h.layer == 3:
            bodies.append(frame[(6 if h.protected else 4) + h.side :])
        at += h.length
    out.skipped += end - at if at < end else 0
    out.payload = b"".join(bodies)
    if out.tags.get("payload_bytes", "").isdigit():
        out.payload = out.payload[: int(out.tags["payload_bytes"])]
    return out, ends


def _feature(s: Stream) -> str:
    name = {3: "1", 2: "2", 0: "2.5"}[s.version]
    parts = [f"mpeg{name}-layer{s.layer}" if s.rate else "none", f"rate={s.rate}", f"frames={len(s.offsets)}", f"samples={s.samples}"]
    seconds = f"{s.samples // s.rate}.{s.samples % s.rate * 10**6 // s.rate:06d}" if s.rate else "0.000000"
    rates = "/".join(map(str, sorted(s.bitrates)))
    middle = s.offsets[len(s.offsets) // 2] if s.offsets else 0
    return ";".join([*parts, f"seconds={seconds}", f"kbps={rates}", f"table={s.table}:{s.told_frames}", f"crc={s.checked - s.bad}/{s.checked}", f"resyncs={s.resyncs}", f"middle={middle}"])


def padded(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT)


def store_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes (of the text as UTF-8), media (binary, an MPEG stream).

    The text, padded with spaces to a positive multiple of 192 bytes, lies in the ancillary bytes of valid silent frames.
    A null text is stored as an empty one, a long one whole; equal texts have equal streams; ids may be null or repeated;
    other columns don't matter. No shuffle.
    """
    few = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch.column(1)):
                raw = [part.text(i) for i in range(len(part))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.rows[0], len(part)), pa.array(map(len, raw), pa.int64()), X.binaries([store(padded(x)) for x in raw])], [id_col, "n_bytes", "media"])

    return few.mapInArrow(run, f"{id_col} {few.schema[id_col].dataType.simpleString()}, n_bytes bigint, media binary")


READ = (
    ("payload", "binary", pa.binary(), lambda s: s.payload),
    ("sample_rate", "int", pa.int32(), lambda s: s.rate),
    ("samples", "bigint", pa.int64(), lambda s: s.samples),
    ("frame_offsets", "array<bigint>", pa.list_(pa.int64()), lambda s: s.offsets),
    ("tags", "map<string,string>", pa.map_(pa.string(), pa.string()), lambda s: list(s.tags.items())),
    ("vbr_table", "string", pa.string(), lambda s: s.table),
    ("told_frames", "bigint", pa.int64(), lambda s: s.told_frames),
    ("told_bytes", "bigint", pa.int64(), lambda s: s.told_bytes),
    ("seek_table", "binary", pa.binary(), lambda s: s.seek),
    ("crc_checked", "bigint", pa.int64(), lambda s: s.checked),
    ("crc_bad", "bigint", pa.int64(), lambda s: s.bad),
    ("resyncs", "bigint", pa.int64(), lambda s: s.resyncs),
    ("skipped_bytes", "bigint", pa.int64(), lambda s: s.skipped),
    ("feature", "string", pa.string(), _feature),
)


def read_audio(media: DataFrame, media_col: str = "media") -> DataFrame:
    """The rows of media with what each stream holds (columns of ``READ``, which replace columns of these names).

    The exact duration is samples / sample_rate seconds; frame_offsets are the seek offsets of all frames. Bytes that
    are no frames are skipped; a stream without frames, empty or null has none and zero samples. No shuffle.
    """
    held = media.drop(*(name for name, *_ in READ))
    at, names = held.columns.index(media_col), [*held.columns, *(name for name, *_ in READ)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [read(x or b"") for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([f(s) for s in found], kind) for _, _, kind, f in READ)], names=names)

    read_fields = T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind, *_ in READ)).fields
    return held.mapInArrow(run, T.StructType([*held.schema.fields, *read_fields]))
