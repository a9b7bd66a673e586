"""Media columns: payloads kept losslessly in MPEG audio, and a scanner for such streams.

A stream is an ID3v2 tag, a frame with the variable-bitrate table (Xing: frame
count, byte count, 100 seek points), audio frames and an ID3v1 tag.  The audio
frames are MPEG-1 Layer III, mono, 32 kHz, with checksums; their side information
declares no main data (silence), and the payload is their ancillary data: two
units of 576 bytes in a frame of 320 kbit/s, one in a frame of 160 kbit/s.

The scanner skips tags, resynchronises on frame headers (a header counts if its
fields are valid and the stream ends or another header, or a tag, follows at its
length), reads variable-bitrate tables, and finds the exact duration in samples and
every frame's byte offset.  It verifies the checksums of Layers I and III; those of
Layer II cover tables that it does not decode, and are counted as not verified.

Defined cases: null and empty texts have one unit of padding; equal texts have
equal streams; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mixlode.llm.common import small_batches, stored

UNIT = 576
PAD = 255

# Fixed values of the MPEG audio format: kbit/s by (version 1?, layer) and Hz by version (1, 2, 2.5).
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
TAGS = (b"TAG", b"ID3", b"APETAGEX", b"LYRICSBEGIN")
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    mode: int  # 0: stereo, 1: joint, 2: two channels, 3: mono
    extension: int
    length: int
    samples: int

    @property
    def mono(self) -> bool:
        return self.mode == 3

    @property
    def covered(self) -> int | None:
        """Bytes behind the checksum that it covers, besides half of the header; None where that takes decoding."""
        if self.layer == 3:
            return self.side_info
        if self.layer == 2:
            return None
        # Layer I: four bits for each of 32 subbands and channel, from the joint bound on for both channels at once
        bound = 4 * (self.extension + 1) if self.mode == 1 else 32
        return 16 if self.mono else (32 + bound) // 2

    @property
    def side_info(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


def header(data: bytes, at: int) -> Header | None:
    """The frame header at this place, or None."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = data[at + 1] >> 3 & 3, 4 - (data[at + 1] >> 1 & 3)
    bits, hz, pad = data[at + 2] >> 4, data[at + 2] >> 2 & 3, data[at + 2] >> 1 & 1
    if version == 1 or layer == 4 or bits in (0, 15) or hz == 3:
        return None
    kbps, rate = BITRATES[version == 3, layer][bits], RATES[version][hz]
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    length = (12000 * kbps // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate + pad
    return Header(version, layer, not data[at + 1] & 1, kbps, rate, data[at + 3] >> 6, data[at + 3] >> 4 & 3, length, samples)


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    """The format's checksum: polynomial 0x8005 from 0xFFFF."""
    c = 0xFFFF
    for b in data:
        c = (c << 8 ^ _CRC[(c >> 8 ^ b) & 255]) & 0xFFFF
    return c


_BIG, _SMALL, _VBR = b"\xff\xfa\xe8\xc0", b"\xff\xfa\xa8\xc0", b"\xff\xfb\x58\xc0"  # 320, 160 and 64 kbit/s at 32 kHz, mono
_LENGTH = {_BIG: 1440, _SMALL: 720, _VBR: 288}
_SIDE = 17
_DATA = 4 + 2 + _SIDE
_SUM = {h: struct.pack(">H", crc16(h[2:] + bytes(_SIDE))) for h in (_BIG, _SMALL)}


def _id3v2(text: str) -> bytes:
    body = b"\x03payload\x00" + text.encode()
    frame = b"TXXX" + struct.pack(">I", len(body)) + b"\x00\x00" + body
    n = len(frame)
    return b"ID3\x04\x00\x00" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + frame


def padded(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8")
    return raw + bytes([PAD]) * (UNIT - len(raw) if not raw else -len(raw) % UNIT)


def encode(payload: bytes) -> bytes:
    """The stream that holds this payload (a positive multiple of UNIT)."""
    units = len(payload) // UNIT
    if units < 1 or len(payload) % UNIT:
        raise ValueError(f"payloads are positive multiples of {UNIT} bytes")
    pairs, single = divmod(units, 2)
    frames = np.zeros((pairs, _LENGTH[_BIG]), np.uint8)
    frames[:, :6] = np.frombuffer(_BIG + _SUM[_BIG], np.uint8)
    frames[:, _DATA : _DATA + 2 * UNIT] = np.frombuffer(payload, np.uint8, pairs * 2 * UNIT).reshape(pairs, 2 * UNIT)
    audio = frames.tobytes()
    if single:
        audio += (_SMALL + _SUM[_SMALL] + bytes(_SIDE) + payload[-UNIT:]).ljust(_LENGTH[_SMALL], b"\0")
    count, size = pairs + single, _LENGTH[_VBR] + len(audio)
    starts = _LENGTH[_VBR] + _LENGTH[_BIG] * (np.arange(100) * count // 100)
    toc = (starts * 256 // size).astype(np.uint8).tobytes()
    table = _VBR + bytes(_SIDE) + b"Xing" + struct.pack(">III", 7, count, size) + toc
    return _id3v2("utf-8 text") + table.ljust(_LENGTH[_VBR], b"\0") + audio + b"TAG".ljust(128, b"\0")


@dataclass
class Scan:
    """What a stream holds.  Offsets are of audio frames; the table frame is not one."""

    rate: int = 0
    samples: int = 0
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    protected: int = 0
    good: int = 0
    unverified: int = 0
    resyncs: int = 0
    declared_frames: int | None = None
    declared_bytes: int | None = None
    toc: bytes = b""
    tags: list[str] = field(default_factory=list)
    payload: bytes = b""

    @property
    def seconds(self) -> float:
        return self.samples / self.rate if self.rate else 0.0


def scan(data: bytes) -> Scan:
    """Reads a stream."""
    out, at, end, parts, synced = Scan(), 0, len(data), [], True
    if data[:3] == b"ID3" and end >= 10:
        a, b, c, d = data[6:10]
        at = 10 + (a << 21 | b << 14 | c << 7 | d) + (10 if data[5] & 16 else 0)
        out.tags.append(f"ID3v2.{data[3]}")
    if end >= 128 and data[-128:-125] == b"TAG":
        end -= 128
        out.tags.append("ID3v1")
    first = True
    while at + 4 <= end:
        h = header(data, at)
        stop = at + h.length if h else at
        fits = h is not None and stop <= end and (stop + 4 > end or header(data, stop) is not None or data.startswith(TAGS, stop))
        if not fits:
            if synced:
                out.resyncs += 1
                synced = False
            at = data.find(b"\xff", at + 1)
            if at < 0:
                break
            continue
        synced = True
        body = at + 4 + 2 * h.protected
        if first and h.layer == 3:
            first = False
            x = at + 4 + h.side_info
            if data[x : x + 4] in (b"Xing", b"Info"):
                flags, x = struct.unpack(">I", data[x + 4 : x + 8])[0], x + 8
                if flags & 1:
                    out.declared_frames, x = struct.unpack(">I", data[x : x + 4])[0], x + 4
                if flags & 2:
                    out.declared_bytes, x = struct.unpack(">I", data[x : x + 4])[0], x + 4
                if flags & 4:
                    out.toc = data[x : x + 100]
                at += h.length
                continue
            if data[at + 36 : at + 40] == b"VBRI":
                out.declared_bytes, out.declared_frames = struct.unpack(">II", data[at + 46 : at + 54])
                at += h.length
                continue
        good = True
        if h.protected:
            out.protected += 1
            if h.covered is None:
                out.unverified += 1
            else:
                good = crc16(data[at + 2 : at + 4] + data[body : body + h.covered]) == int.from_bytes(data[at + 4 : at + 6], "big")
                out.good += good
        out.rate = out.rate or h.rate
        out.samples += h.samples
        out.offsets.append(at)
        out.sizes.append(h.length)
        if good and h.protected and h.layer == 3:
            start = body + h.side_info
            parts.append(data[start : start + (at + h.length - start) // UNIT * UNIT])
        at += h.length
    out.payload = b"".join(parts)
    return out


def feature(s: Scan) -> str:
    seek = zlib.crc32(np.array(s.offsets, "<u8").tobytes())
    declared = s.declared_frames == len(s.offsets)
    return f"mpeg1-layer3 rate={s.rate} frames={len(s.offsets)} samples={s.samples} seconds={s.seconds:.3f} crc={s.good}/{s.protected - s.unverified} unverified={s.unverified} resyncs={s.resyncs} vbr={'ok' if declared else 'bad'} seek={seek:08x} tags={'+'.join(s.tags)}"


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id and media (binary): every whole text's stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):  # small output batches: long texts make long streams
                part = b.slice(i, 64)
                media = [encode(padded(t)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, media binary")


_FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_samples long, n_frames long, last_frame_offset long"
)


def features(media: DataFrame, seek: bool = False) -> DataFrame:
    """Reads doc_id, media back: digests of the payload, exact duration and (seek=True) all frame offsets; null media gives nulls."""
    schema = _FEATURES + (", frame_offsets array<long>" if seek else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def row(key, data: bytes | None) -> tuple:
        if data is None:
            return (key,) + (None,) * (len(names) - 1)
        s = scan(data)
        p = s.payload
        out = (
            key, len(p.rstrip(bytes([PAD]))), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(s),
            s.samples, len(s.offsets), s.offsets[-1] if s.offsets else None,
        )
        return out + ((s.offsets,) if seek else ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [row(k, m) for k, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)

    plain = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    kinds = [plain[f.split()[1]] for f in schema.split(", ")]
    return media.select("doc_id", "media").mapInArrow(run, schema)


def op6_media(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document's stream, stored, and read back from the store, with all frame offsets."""
    small_batches(spark)
    media = stored(with_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    return features(media, seek=True)
