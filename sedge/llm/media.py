"""Media columns: MPEG audio that holds texts, and a reader of MPEG audio.

``to_audio`` writes a tag, a frame with a variable-bitrate table, and MPEG-1
layer III frames: valid mono frames of silence whose data area carries the
payload, with the standard checksum over header and side information.
``read_audio`` reads any MPEG audio stream: it parses ID3 tags, Xing and VBRI
tables with their seek points, finds frame headers again behind damage (a header
counts only if another of its stream, or the end, follows where its length says,
or, before damage, if its own checksum holds), verifies the checksums of all
three layers, and gives the exact duration and each frame's offset.  ``seek``
finds the frame of a moment by these, ``table_seek`` about where a table puts it.

Defined results: a null text is the empty text, whose payload is 64 zero bytes;
repeated rows give repeated rows; other columns of the input are not read; an
empty table gives an empty table; a stream without frames has duration 0.
Texts are stored whole.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256

from pyspark.sql import DataFrame

from .common import map_rows

UNIT = 64

#: Fixed values of the format: kbit/s by (version 1?, layer), sample rates by
#: version, samples in a frame.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 25: (11025, 12000, 8000)}
VERSIONS = {3: 1, 2: 2, 0: 25}
CRC_POLYNOMIAL, CRC_START = 0x8005, 0xFFFF

# What the writer uses: version 1, layer III, 32 kHz, one channel.
RATE_INDEX, RATE, SAMPLES, SIDE = 2, 32000, 1152, 17
HEAD = 4 + 2 + SIDE


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    bitrate: int
    rate: int
    padded: bool
    #: 0 stereo, 1 joint stereo, 2 two channels, 3 one channel.
    mode: int
    extension: int

    @property
    def mono(self) -> bool:
        return self.mode == 3

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 1152 if self.layer == 2 or self.version == 1 else 576

    @property
    def length(self) -> int:
        if self.layer == 1:
            return (12 * self.bitrate * 1000 // self.rate + self.padded) * 4
        return self.samples // 8 * self.bitrate * 1000 // self.rate + self.padded

    @property
    def side(self) -> int:
        """Bytes of layer III side information."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)

    @property
    def stream(self) -> tuple:
        return self.version, self.layer, self.rate


@lru_cache(4096)
def header(data: bytes) -> Header | None:
    """The frame header in four bytes, or None."""
    if len(data) < 4 or data[0] != 0xFF or data[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(data[1] >> 3 & 3), 4 - (data[1] >> 1 & 3)
    bits, rate = data[2] >> 4, data[2] >> 2 & 3
    if version is None or layer == 4 or bits in (0, 15) or rate == 3 or data[3] & 3 == 2:
        return None
    kbit = BITRATES[version == 1, layer][bits]
    return Header(version, layer, not data[1] & 1, kbit, RATES[version][rate], bool(data[2] & 2), data[3] >> 6, data[3] >> 4 & 3)


@lru_cache(1)
def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = crc << 1 ^ (CRC_POLYNOMIAL if crc & 0x8000 else 0)
        table.append(crc & 0xFFFF)
    return table


@lru_cache(4096)
def crc16(data: bytes, bits: int | None = None) -> int:
    """The checksum of all of ``data``, or of its first ``bits``."""
    table, crc = _crc_table(), CRC_START
    whole, rest = (len(data), 0) if bits is None else divmod(bits, 8)
    for b in data[:whole]:
        crc = crc << 8 & 0xFFFF ^ table[crc >> 8 ^ b]
    for k in range(rest):
        high = crc >> 15 ^ data[whole] >> 7 - k & 1
        crc = crc << 1 & 0xFFFF ^ (CRC_POLYNOMIAL if high else 0)
    return crc


def allocation_widths(h: Header) -> list[int]:
    """Bits of the allocation of each subband of a layer II frame."""
    if h.version != 1:
        return [4] * 4 + [3] * 7 + [2] * 19
    each = h.bitrate / (1 if h.mono else 2)
    if each <= 48:
        return [4] * 2 + [3] * (10 if h.rate == 32000 else 6)
    return [4] * 11 + [3] * 12 + [2] * (4 if each <= 80 or h.rate == 48000 else 7)


def protected_bits(frame: bytes, h: Header) -> int | None:
    """Bits behind the checksum that it covers; None if the frame ends before."""
    if h.layer == 3:
        return 8 * h.side
    channels, bound = 1 if h.mono else 2, 4 * (h.extension + 1) if h.mode == 1 else 32
    if h.layer == 1:
        return 4 * (bound * channels + 32 - bound)
    at, chosen, end = 8 * 6, 0, 8 * len(frame)
    for band, width in enumerate(allocation_widths(h)):
        own = channels if band < bound else 1
        for _ in range(own):
            if at + width > end:
                return None
            value = int.from_bytes(frame[at // 8 : at // 8 + 2].ljust(2, b"\0"), "big") >> 16 - at % 8 - width & (1 << width) - 1
            chosen += (value > 0) * (channels // own)
            at += width
    return at - 8 * 6 + 2 * chosen


# ------------------------------------------------------------------- writing


@lru_cache(32)
def _frame_head(bits: int) -> tuple[bytes, int]:
    """Header, checksum and side information of a frame, and its length."""
    top = bytes([0xFF, 0xFA, bits << 4 | RATE_INDEX << 2, 0xC0])
    side = bytes(SIDE)
    return top + crc16(top[2:] + side).to_bytes(2, "big") + side, header(top).length


@lru_cache(1)
def _rooms() -> list[tuple[int, int]]:
    """(data bytes of a frame, bitrate index), from the smallest."""
    return [(_frame_head(b)[1] - HEAD, b) for b in range(1, 15)]


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _text_frame(name: str, value: int) -> bytes:
    body = b"\x00" + name.encode() + b"\x00" + str(value).encode()
    return b"TXXX" + len(body).to_bytes(4, "big") + b"\x00\x00" + body


def payload_of(text: str) -> bytes:
    data = text.encode("utf-8", "surrogatepass")
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def to_audio(payload: bytes, n_bytes: int) -> bytes:
    """The payload as a tagged MPEG stream; ``n_bytes`` of it are not padding."""
    rooms, frames, at = _rooms(), [], 0
    while at < len(payload):
        left = len(payload) - at
        room, bits = next((r for r in rooms if r[0] >= left), rooms[-1])
        part = payload[at : at + room]
        frames.append(_frame_head(bits)[0] + part + bytes(room - len(part)))
        at += room
    # The table's frame: no checksum, table right behind the side information.
    top = bytes([0xFF, 0xFB, 4 << 4 | RATE_INDEX << 2, 0xC0])
    length, total = header(top).length, sum(map(len, frames))
    ends, at = [], 0
    for f in frames:
        ends.append(at)
        at += len(f)
    whole = length + total
    toc = bytes(min(255, 256 * (length + ends[k * len(frames) // 100]) // whole) for k in range(100))
    table = b"Xing" + (15).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + whole.to_bytes(4, "big") + toc + bytes(4)
    first = (top + bytes(SIDE) + table).ljust(length, b"\x00")
    tags = _text_frame("payload_bytes", len(payload)) + _text_frame("text_bytes", n_bytes)
    return b"".join([b"ID3\x03\x00\x00", _syncsafe(len(tags)), tags, first, *frames])


# ------------------------------------------------------------------- reading


@dataclass
class Audio:
    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, int] = field(default_factory=dict)
    #: Offsets that the table gives for equal parts of the duration.
    points: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    duration_us: int = 0
    checked: int = 0
    broken: int = 0
    resyncs: int = 0
    skipped: int = 0
    kbits: set[int] = field(default_factory=set)
    stream: tuple | None = None


def _tags(data: bytes, audio: Audio) -> int:
    """Parse an ID3v2 tag at the start; the place behind it."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    size = data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]
    end, at = min(len(data), 10 + size), 10
    while at + 10 <= end and data[at] >= 0x41:
        raw = data[at + 4 : at + 8]
        n = int.from_bytes(raw, "big") if data[3] < 4 else raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]
        body = data[at + 10 : min(end, at + 10 + n)]
        if data[at : at + 4] == b"TXXX":
            name, _, value = body[1:].partition(b"\x00")
            audio.tags[name.decode("latin-1")] = value.decode("latin-1")
        elif data[at : at + 1] == b"T":
            audio.tags[data[at : at + 4].decode("latin-1")] = body[1:].decode("latin-1").rstrip("\x00")
        at += 10 + n
    return 10 + size


def _bitrate_table(frame: bytes, h: Header, at: int) -> tuple[dict[str, int], list[int]]:
    """A Xing, Info or VBRI table in the frame at ``at``, and the offsets of its
    seek points; or nothing."""
    place = 4 + 2 * h.protected + h.side
    if frame[place : place + 4] in (b"Xing", b"Info"):
        flags, place, out = int.from_bytes(frame[place + 4 : place + 8], "big"), place + 8, {}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(frame[place : place + 4], "big")
                place += 4
        points = [at + b * out.get("bytes", 0) // 256 for b in frame[place : place + 100]] if flags & 4 else []
        return out | {"toc": len(points)}, points
    if frame[36:40] == b"VBRI":
        n = lambda a, b: int.from_bytes(frame[36 + a : 36 + b], "big")
        entries, scale, width, points = n(18, 20), n(20, 22), n(22, 24), [at]
        for k in range(entries):
            points.append(points[-1] + scale * n(26 + k * width, 26 + (k + 1) * width))
        return {"bytes": n(10, 14), "frames": n(14, 18), "toc": entries}, points[:-1] if entries else []
    return {}, []


def _sound(frame: bytes, h: Header) -> bool:
    bits = protected_bits(frame, h)
    if bits is None or 48 + bits > 8 * len(frame):
        return False
    return crc16(frame[2:4] + frame[6 : 6 + (bits + 7) // 8], 16 + bits) == int.from_bytes(frame[4:6], "big")


def seek(audio: Audio, us: int) -> int | None:
    """The offset of the frame that sounds at a moment; None where none does."""
    if not audio.offsets or not 0 <= us < audio.duration_us:
        return None
    each = audio.samples // len(audio.offsets)
    return audio.offsets[us * audio.stream[2] // (1_000_000 * each)]


def table_seek(audio: Audio, us: int) -> int | None:
    """About where the table's seek points put a moment."""
    if not audio.points or not 0 <= us < audio.duration_us:
        return None
    return audio.points[us * len(audio.points) // audio.duration_us]


def read_audio(data: bytes) -> tuple[Audio, list[bytes]]:
    """What the stream holds, and the data areas of its layer III frames."""
    audio, parts = Audio(), []
    at, end = _tags(data, audio), len(data) - 128 * (data[-128:-125] == b"TAG")
    lost = False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        stop = at + h.length if h else 0
        follows = h and stop <= end and (stop == end or (g := header(data[stop : stop + 4])) and g.stream == h.stream)
        # Before damage, a frame where one is due may prove itself.
        if not follows and h and stop <= end and not lost and audio.stream == h.stream and h.protected:
            follows = _sound(data[at:stop], h)
        if not follows:
            if not lost:
                audio.resyncs += 1
            lost, near = True, data.find(b"\xff", at + 1, end)
            audio.skipped += (end if near < 0 else near) - at
            at = end if near < 0 else near
            continue
        lost = False
        frame = data[at:stop]
        if audio.stream is None:
            audio.stream = h.stream
            audio.table, audio.points = _bitrate_table(frame, h, at)
            if audio.table:
                at = stop
                continue
        if h.protected:
            audio.checked += 1
            audio.broken += not _sound(frame, h)
        audio.offsets.append(at)
        audio.samples += h.samples
        audio.kbits.add(h.bitrate)
        parts.append(frame[4 + 2 * h.protected + h.side :])
        at = stop
    if audio.stream:
        audio.duration_us = audio.samples * 1_000_000 // audio.stream[2]
    return audio, parts


def feature(a: Audio) -> str:
    """The stream in short; the offsets of all frames stand as a checksum."""
    rate = a.stream[2] if a.stream else 0
    offsets = zlib.crc32(",".join(map(str, a.offsets)).encode())
    return (
        f"rate={rate};frames={len(a.offsets)};samples={a.samples};us={a.duration_us};kbit={min(a.kbits, default=0)}-{max(a.kbits, default=0)};"
        f"table={a.table.get('frames', -1)}/{a.table.get('bytes', -1)}/{len(a.points)};crc={a.checked - a.broken}/{a.checked};resyncs={a.resyncs};offsets={offsets:08x}"
    )


def _write():
    def step(ids, texts):
        out = []
        for i, text in zip(ids, texts):
            payload = payload_of(text or "")
            out.append((i, to_audio(payload, len((text or "").encode("utf-8", "surrogatepass")))))
        return out

    return step


def store_as_audio(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, media): each whole text as an MPEG stream."""
    schema = f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, media binary"
    return map_rows(docs, [id_column, text_column], schema, _write)


def _read():
    def step(ids, streams):
        out = []
        for i, data in zip(ids, streams):
            audio, parts = read_audio(bytes(data or b""))
            size = int(audio.tags.get("payload_bytes", 0))
            payload = b"".join(parts)[:size]
            out.append(
                (
                    i, int(audio.tags.get("text_bytes", 0)), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]),
                    len(data or b""), sha256(data or b"").hexdigest(), feature(audio), audio.duration_us, audio.offsets,
                )
            )
        return out

    return step


def read_stored(media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """What each stream of the column ``media`` holds."""
    schema = (
        f"`{id_column}` {media.schema[id_column].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, "
        "tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, duration_us bigint, frame_offsets array<bigint>"
    )
    return map_rows(media, [id_column, "media"], schema, _read)
