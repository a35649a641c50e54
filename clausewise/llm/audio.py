"""MPEG audio columns: writing payloads as Layer III streams, and reading streams into columns."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clausewise.session import map_batches
from clausewise.llm._shared import batches, small_slices

# MPEG audio header fields (ISO 11172-3, ISO 13818-3), kbit/s by (lsf, layer) and Hz by version
_KBPS = {
    (0, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (0, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (0, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (1, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (1, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (1, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_HZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
UNIT = 576


def crc16(data: bytes) -> int:
    """The frame checksum: polynomial 0x8005, initial value 0xFFFF."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1) ^ 0x8005 if crc & 0x8000 else crc << 1
            crc &= 0xFFFF
    return crc


# Layer II bit allocation fields (ISO 11172-3 tables 3-B.2, ISO 13818-3 table B.1): widths by subband
_WIDE = (4,) * 11 + (3,) * 12 + (2,) * 7
_NARROW = (4,) * 2 + (3,) * 10
_LOW = (4,) * 4 + (3,) * 7 + (2,) * 19


def crc16_bits(data: bytes, bits: int) -> int:
    """The checksum of the first ``bits`` bits."""
    whole, rest = divmod(bits, 8)
    crc = crc16(data[:whole])
    for k in range(rest):
        bit = (data[whole] >> (7 - k) ^ crc >> 15) & 1
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if bit else 0)
    return crc


@dataclass(frozen=True)
class Header:
    layer: int
    version: int
    guarded: bool
    hz: int
    samples: int
    size: int
    side: int
    kbps: int = 0
    channels: int = 1
    bound: int = 32

    def covered(self, body: bytes) -> int:
        """How many bits behind the checksum it covers: Layer III's side information, else the bit allocation and, in Layer II, the selection of scale factors."""
        if self.layer == 3:
            return 8 * self.side
        if self.layer == 1:
            return 4 * (self.bound * self.channels + 32 - self.bound)
        each = self.kbps // self.channels
        if self.version != 3:
            widths = _LOW
        elif each in (32, 48):
            widths = _NARROW[: 12 if self.hz == 32000 else 8]
        else:
            widths = _WIDE[: 30 if self.hz != 48000 and each >= 96 else 27]
        value, at, picked = int.from_bytes(body[:64].ljust(64, b"\0"), "big"), 0, 0
        for k, width in enumerate(widths):
            fields = self.channels if k < self.bound else 1
            for _ in range(fields):
                at += width
                if value >> (512 - at) & ((1 << width) - 1):
                    picked += self.channels // fields
        return at + 2 * picked


_headers: dict[bytes, Header | None] = {}


def header(four: bytes) -> Header | None:
    """The frame header in ``four`` bytes, or None if they are none (free format counts as none)."""
    if four in _headers:
        return _headers[four]
    found = None
    if len(four) == 4 and four[0] == 0xFF and four[1] & 0xE0 == 0xE0:
        version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
        rate, hz = four[2] >> 4, four[2] >> 2 & 3
        if version != 1 and layer < 4 and 0 < rate < 15 and hz < 3 and four[3] & 3 != 2:
            lsf, pad = int(version != 3), four[2] >> 1 & 1
            kbps, freq = _KBPS[lsf, layer][rate], _HZ[version][hz]
            samples = 384 if layer == 1 else 1152 if layer == 2 or not lsf else 576
            size = (12000 * kbps // freq + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // freq + pad
            mode, extension = four[3] >> 6, four[3] >> 4 & 3
            mono = mode == 3
            bound = 4 + 4 * extension if mode == 1 and layer < 3 else 32
            side = (17 if mono else 32, 9 if mono else 17)[lsf] if layer == 3 else 0
            found = Header(layer, version, not four[1] & 1, freq, samples, size, side, kbps, 1 if mono else 2, bound)
    if len(_headers) < 4096:
        _headers[four] = found
    return found


@dataclass
class Stream:
    """What a byte string holds: frames in order, what tags and tables say, what was skipped."""

    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    bodies: list[int] = field(default_factory=list)
    samples: int = 0
    hz: int = 0
    bad_crc: int = 0
    skipped: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes = b""

    @property
    def duration(self) -> tuple[int, int]:
        """Samples and samples a second: exact, unlike a float."""
        return self.samples, self.hz


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes, out: Stream) -> int:
    """Reads an ID3v2.3 or 2.4 tag's text frames; returns where audio starts."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0
    major, end, at = data[3], 10 + _synchsafe(data[6:10]), 10
    while at + 10 <= min(end, len(data)) and data[at] != 0:
        name = data[at : at + 4].decode("latin-1")
        size = _synchsafe(data[at + 4 : at + 8]) if major >= 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : at + 10 + size]
        if name.startswith("T") and body:
            text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(body[0], 3)], "replace").rstrip("\0")
            if name == "TXXX":
                name, _, text = text.partition("\0")
            out.tags[name] = text
        at += 10 + size
    return end + 10 * bool(data[5] & 16)


def _table(data: bytes, at: int, h: Header, out: Stream) -> bool:
    """Reads a Xing, Info or VBRI table in the frame at ``at``; True if it holds one instead of audio."""
    x = at + 4 + 2 * h.guarded + h.side
    if data[x : x + 4] in (b"Xing", b"Info"):
        flags, x = int.from_bytes(data[x + 4 : x + 8], "big"), x + 8
        if flags & 1:
            out.table_frames, x = int.from_bytes(data[x : x + 4], "big"), x + 4
        if flags & 2:
            out.table_bytes, x = int.from_bytes(data[x : x + 4], "big"), x + 4
        if flags & 4:
            out.toc = data[x : x + 100]
        return True
    if data[at + 36 : at + 40] == b"VBRI":
        out.table_bytes, out.table_frames = struct.unpack(">II", data[at + 46 : at + 54])
        return True
    return False


def parse(data: bytes) -> Stream:
    """Walks a stream frame by frame and never raises on damage.

    A place counts as a frame if its header is valid and another valid header of
    the same layer, version and rate (or the end, or an ID3v1 tag) follows where
    the frame ends; otherwise the walk moves on to the next sync byte.  A frame
    with a checksum that doesn't hold is counted and kept in the time line.
    """
    out, crcs = Stream(), {}
    end, tag = len(data), len(data) - 128 if data[-128:-125] == b"TAG" else -1
    at, first = _id3v2(data, out), True
    if at:
        out.skipped = 0
    kind = None
    while at + 4 <= end:
        if at == tag:  # only where a frame ends: payloads may hold these letters, too
            break
        four = data[at : at + 4]
        h = header(four)
        stop = at + h.size if h else 0
        if h and stop <= end and (kind is None or kind == (h.layer, h.version, h.hz)):
            follow = header(data[stop : stop + 4]) if stop + 4 <= end else None
            if stop in (end, tag) or follow and (follow.layer, follow.version, follow.hz) == (h.layer, h.version, h.hz):
                kind = (h.layer, h.version, h.hz)
                if first and _table(data, at, h, out):
                    first, at = False, stop
                    continue
                first = False
                if h.guarded:
                    bits = h.covered(data[at + 6 : at + 70])
                    covered = four[2:] + data[at + 6 : at + 6 + (bits + 7) // 8]
                    want = crcs.get((covered, bits))
                    if want is None:
                        want = crc16_bits(covered, 16 + bits).to_bytes(2, "big") if len(covered) * 8 >= 16 + bits else b""
                        if len(crcs) < 4096:
                            crcs[covered, bits] = want
                    out.bad_crc += want != data[at + 4 : at + 6]
                out.offsets.append(at)
                out.sizes.append(h.size)
                out.bodies.append(4 + 2 * h.guarded + h.side)
                out.samples += h.samples
                out.hz, at = h.hz, stop
                continue
        again = data.find(b"\xff", at + 1, end)
        again = end if again < 0 else again
        if at < tag < again:
            again = tag
        out.skipped += again - at
        at = again
    return out


_FRAME = b"\xff\xfa\xc4\xc0"  # MPEG-1 Layer III, checksum, 224 kbit/s, 48 kHz, mono: 672 bytes
_INFO = b"\xff\xfb\xc4\xc0"  # the same without a checksum
_SIDE = bytes(17)  # no main data: a decoder plays silence and ignores what follows, the ancillary data
_HEAD = _FRAME + crc16(_FRAME[2:] + _SIDE).to_bytes(2, "big") + _SIDE
_SIZE = 672


def encode(payload: bytes, tags: dict[str, str] | None = None) -> bytes:
    """``payload`` (a multiple of 576 bytes) as a playable, silent Layer III stream.

    Each frame carries 576 bytes as ancillary data.  An ID3v2.4 tag and a Xing
    table with frame count, byte count and seek points come first.
    """
    if len(payload) % UNIT:
        raise ValueError(f"a payload is a multiple of {UNIT} bytes")
    n = len(payload) // UNIT
    frames = np.zeros((n, _SIZE), np.uint8)
    frames[:, : len(_HEAD)] = np.frombuffer(_HEAD, np.uint8)
    frames[:, len(_HEAD) : len(_HEAD) + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    total = (n + 1) * _SIZE
    toc = bytes(min(255, (1 + i * n // 100) * _SIZE * 256 // total) for i in range(100))
    info = (_INFO + _SIDE + b"Xing" + struct.pack(">III", 7, n, total) + toc).ljust(_SIZE, b"\0")
    body = b""
    for name, text in (tags or {}).items():
        value = b"\x03" + name.encode() + b"\0" + text.encode()
        body += b"TXXX" + bytes(len(value) >> s & 127 for s in (21, 14, 7, 0)) + b"\0\0" + value
    head = b"ID3\x04\0\0" + bytes(len(body) >> s & 127 for s in (21, 14, 7, 0)) + body if body else b""
    return head + info + frames.tobytes()


def payload_of(data: bytes, stream: Stream) -> bytes:
    """The ancillary bytes of all frames, in order, without a copy of each frame."""
    if not stream.offsets:
        return b""
    sizes, offsets = set(stream.sizes), stream.offsets
    if sizes == {_SIZE} and offsets[-1] - offsets[0] == _SIZE * (len(offsets) - 1):
        block = np.frombuffer(data, np.uint8, _SIZE * len(offsets), offsets[0]).reshape(-1, _SIZE)
        return block[:, stream.bodies[0] : stream.bodies[0] + UNIT].tobytes()
    return b"".join(data[o + b : o + b + UNIT] for o, b in zip(offsets, stream.bodies, strict=True))


def store_as_audio(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's UTF-8 bytes as an MPEG audio stream: ``doc_id, media``.  Repeated rows give repeated streams; a text of any length is one stream.

    The bytes are filled up with 255 to a positive multiple of 576; the tag
    ``bytes`` holds their number before.  Null texts count as empty and make one
    frame.  Equal texts make equal streams.  Ids are passed on as they are, so null
    and repeated ones are fine; further columns are ignored; an empty table gives
    an empty table.
    """
    source = docs.selectExpr(f"`{id}` AS doc_id", f"`{text}` AS text")
    make = batches({"doc_id": pa.int64(), "media": pa.binary()})

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(stream, "text"):
            media = []
            for t in batch.column("text").to_pylist():
                raw = (t or "").encode()
                fill = -len(raw) % UNIT or UNIT * (not raw)
                media.append(encode(raw + b"\xff" * fill, {"bytes": str(len(raw))}))
            yield make({"doc_id": batch.column("doc_id").to_pylist(), "media": media})

    return map_batches(source, run, "doc_id long, media binary")


def audio_columns(media: DataFrame, *, id: str = "doc_id", column: str = "media") -> DataFrame:
    """Columns read from MPEG audio streams.

    Per row: ``doc_id, frames, samples, hz, bad_crc, skipped`` (bytes outside frames),
    ``table_frames, table_bytes`` (what the variable-bitrate table claims, or null),
    ``tags`` (map), ``seek`` (array of the byte offset of every frame), ``payload``
    (binary, the ancillary bytes), ``media_bytes``, ``media_sha256``.  Null, empty
    and damaged streams give rows with what could be read, never an error.  Repeated
    rows are read once each, a stream of any length is read whole, and other columns
    are ignored, whatever their names.
    """
    source = media.selectExpr(f"`{id}` AS doc_id", f"`{column}` AS media")
    ints = ("frames", "samples", "hz", "bad_crc", "skipped", "table_frames", "table_bytes", "media_bytes")
    make = batches(
        {"doc_id": pa.int64()}
        | {n: pa.int64() for n in ints}
        | {"tags": pa.map_(pa.string(), pa.string()), "seek": pa.list_(pa.int64()), "payload": pa.binary(), "media_sha256": pa.string()}
    )

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(stream, "media"):
            out: dict[str, list] = {k: [] for k in ("doc_id", *ints, "tags", "seek", "payload", "media_sha256")}
            out["doc_id"] = batch.column("doc_id").to_pylist()
            for data in batch.column("media").to_pylist():
                data = data or b""
                s = parse(data)
                values = (len(s.offsets), s.samples, s.hz, s.bad_crc, s.skipped, s.table_frames, s.table_bytes, len(data))
                for k, v in zip(ints, values, strict=True):
                    out[k].append(v)
                out["tags"].append(list(s.tags.items()))
                out["seek"].append(s.offsets)
                out["payload"].append(payload_of(data, s))
                out["media_sha256"].append(hashlib.sha256(data).hexdigest())
            yield make(out)

    kinds = ", ".join(f"{n} long" for n in ("doc_id", *ints))
    return map_batches(source, run, f"{kinds}, tags map<string,string>, seek array<long>, payload binary, media_sha256 string")


def tail_crc32(payload: bytes) -> int:
    return zlib.crc32(payload[-32:])
