"""MPEG audio columns: payloads kept in Layer III frames, and a reader that survives damage.

Writing: a payload goes into the ancillary part of silent MPEG-1 Layer III frames (32 kHz, mono), each
with its CRC-16; the last frame takes the smallest bitrate that holds the rest, so the stream is of
variable bitrate and opens with a table frame.  A tag in front names the payload's size and checksum.

Reading works on any MPEG 1, 2 or 2.5 stream of layers I to III: tags are parsed, frames are followed
by their computed lengths, checksums of protected frames are verified in all layers, and after damage the next
place with two consistent headers is sought.  Frames of free format name no length, so they count as damage.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, prepare, stored, text_of

# Fixed values of the MPEG audio standards: kbit/s by (version 1 or 2, layer), Hz by version, samples.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

OWNER = b"payload-in-frames\0"
UNIT = 64


@dataclass(frozen=True)
class Header:
    """What the four bytes of a frame header say."""

    version: int
    layer: int
    protected: bool
    bitrate: int
    rate: int
    mono: bool
    length: int
    samples: int
    side: int
    mode: int
    extension: int


@lru_cache(maxsize=4096)
def read_header(word: bytes) -> Header | None:
    """The frame header in ``word`` (4 bytes), or None if no such frame exists."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    bits, rates = word[2] >> 4, word[2] >> 2 & 3
    if version == 1 or layer == 4 or bits in (0, 15) or rates == 3 or word[3] & 3 == 2:
        return None
    one = version == 3
    bitrate, rate, pad = BITRATES[1 if one else 2, layer][bits], RATES[version][rates], word[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or one else 576
    if layer == 1:
        length = (12_000 * bitrate // rate + pad) * 4
    else:
        length = samples // 8 * 1000 * bitrate // rate + pad
    mono = word[3] >> 6 == 3
    side = 0 if layer < 3 else (17 if mono else 32) if one else (9 if mono else 17)
    return Header(version, layer, not word[1] & 1, bitrate, rate, mono, length, samples, side, word[3] >> 6, word[3] >> 4 & 3)


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """The checksum of protected frames: polynomial 0x8005, started at 0xFFFF, high bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _allocation(head: Header) -> list[int]:
    """Bits of the allocation of each subband of a layer I or II frame; fixed values of the standards."""
    if head.layer == 1:
        return [4] * 32
    if head.version != 3:
        return [4] * 4 + [3] * 7 + [2] * 19
    each = head.bitrate // (1 if head.mono else 2)
    if each <= 48:
        return [4] * 2 + [3] * (10 if head.rate == 32000 else 6)
    return [4] * 11 + [3] * 12 + [2] * (4 if each <= 80 or head.rate == 48000 else 7)


def _checked_bits(head: Header, inside: bytes) -> int:
    """How many bits after the checksum it covers: the allocation and, in layer II, the choice of scale factors."""
    widths = _allocation(head)
    channels = 1 if head.mono else 2
    bound = min(4 * (head.extension + 1), len(widths)) if head.mode == 1 else len(widths)
    value, size, at, more = int.from_bytes(inside, "big"), 8 * len(inside), 0, 0
    for band, n in enumerate(widths):
        apart = channels if band < bound else 1
        for _ in range(apart):
            at += n
            if head.layer == 2 and at <= size and value >> size - at & (1 << n) - 1:
                more += 2 * channels // apart
    return at + more


def _checksum_holds(head: Header, media: bytes, at: int) -> bool:
    """Whether the checksum of the protected frame at ``at`` is right."""
    stated, inside = int.from_bytes(media[at + 4 : at + 6], "big"), at + 6
    if head.layer == 3:
        return stated == crc16(media[at + 2 : at + 4] + media[inside : inside + head.side])
    # 32 subbands of 2 channels have at most 32 bytes of allocation and 16 of choices.
    own = media[inside : min(inside + 48, at + head.length)]
    n = _checked_bits(head, own)
    crc = crc16(media[at + 2 : at + 4] + own[: n // 8])
    for k in range(n // 8 * 8, n):
        top = crc >> 15 ^ (own[k // 8] >> 7 - k % 8 & 1 if k // 8 < len(own) else 0)
        crc = crc << 1 & 0xFFFF ^ (0x8005 if top else 0)
    return stated == crc


def _frame_head(bits: int) -> bytes:
    """Header, checksum and empty side information of a protected MPEG-1 Layer III mono frame, 32 kHz."""
    header = bytes([0xFF, 0xFA, bits << 4 | 2 << 2, 0xC0])
    side = bytes(17)
    return header + crc16(header[2:] + side).to_bytes(2, "big") + side


HEADS = [b"", *(_frame_head(b) for b in range(1, 15))]
LENGTHS = [0, *(read_header(h[:4]).length for h in HEADS[1:])]
ROOM = [n - len(HEADS[1]) for n in LENGTHS]


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _from_syncsafe(data: bytes) -> int:
    n = 0
    for b in data:
        n = n << 7 | b & 0x7F
    return n


def pad(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % UNIT if data else UNIT)


def encode(data: bytes) -> bytes:
    """An MPEG audio file that holds ``data`` and its padding; the same bytes for the same data."""
    payload = pad(data)
    top = len(HEADS) - 1
    full, rest = divmod(len(payload), ROOM[top])
    frames = np.empty((full, LENGTHS[top]), np.uint8)
    frames[:, : len(HEADS[top])] = np.frombuffer(HEADS[top], np.uint8)
    frames[:, len(HEADS[top]) :] = np.frombuffer(payload, np.uint8, full * ROOM[top]).reshape(full, ROOM[top])
    body = [frames.tobytes()]
    starts = [LENGTHS[top] * k for k in range(full)]
    if rest:
        bits = next(b for b in range(1, top + 1) if ROOM[b] >= rest)
        starts.append(full * LENGTHS[top])
        body.append(HEADS[bits] + payload[full * ROOM[top] :] + bytes(ROOM[bits] - rest))
    stream = b"".join(body)

    bits = next(b for b in range(1, top + 1) if ROOM[b] >= 116)
    total = LENGTHS[bits] + len(stream)
    count = len(starts)
    toc = bytes(min(255, 256 * (LENGTHS[bits] + starts[p * count // 100]) // total) for p in range(100))
    table = b"Xing" + struct.pack(">III", 7, count, total) + toc
    opening = HEADS[bits] + table + bytes(ROOM[bits] - len(table))

    private = OWNER + struct.pack(">QQI", len(data), len(payload), zlib.crc32(payload))
    frame = b"PRIV" + _syncsafe(len(private)) + b"\0\0" + private
    return b"ID3\4\0\0" + _syncsafe(len(frame)) + frame + opening + stream


@dataclass
class Audio:
    """What a reader found: tags, table, frames, damage, and the bytes kept in the frames."""

    tags: dict[str, bytes] = field(default_factory=dict)
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes = b""
    offsets: list[int] = field(default_factory=list)
    rates: dict[int, int] = field(default_factory=dict)
    bitrates: set[int] = field(default_factory=set)
    bad_checksums: int = 0
    gaps: list[tuple[int, int]] = field(default_factory=list)
    data: bytes = b""

    @property
    def duration_us(self) -> int:
        """Exact duration of the frames, each at its own rate, in whole microseconds, rounded down."""
        return int(sum((Fraction(n * 1_000_000, rate) for rate, n in self.rates.items()), Fraction(0)))

    @property
    def rate(self) -> int:
        """Rate of the first frame."""
        return next(iter(self.rates), 0)


def _read_tags(media: bytes, audio: Audio) -> tuple[int, int]:
    """Tags at both ends; returns where the frames may begin and must end."""
    at, end = 0, len(media)
    while media[at : at + 3] == b"ID3" and at + 10 <= end:
        size = _from_syncsafe(media[at + 6 : at + 10])
        stop, p = min(end, at + 10 + size), at + 10
        wide = media[at + 3] >= 4
        while p + 10 <= stop and media[p] != 0:
            name = media[p : p + 4].decode("latin-1")
            raw = media[p + 4 : p + 8]
            n = _from_syncsafe(raw) if wide else int.from_bytes(raw, "big")
            audio.tags.setdefault(name, media[p + 10 : min(stop, p + 10 + n)])
            p += 10 + n
        at = stop
    if end - at >= 128 and media[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93), ("TYER", 93, 97)):
            audio.tags.setdefault(name, media[end + a : end + b].rstrip(b"\0 "))
    return at, end


def _frame_at(media: bytes, at: int, end: int) -> Header | None:
    head = read_header(media[at : at + 4])
    return head if head and at + head.length <= end else None


def _resync(media: bytes, at: int, end: int) -> int:
    """The next place from ``at`` with a frame that another frame of its kind, or the end, follows."""
    while 0 <= (at := media.find(b"\xff", at, end)):
        head = _frame_at(media, at, end)
        if head:
            after = at + head.length
            again = read_header(media[after : after + 4])
            if after == end or (again and (again.version, again.layer, again.rate) == (head.version, head.layer, head.rate)):
                return at
        at += 1
    return end


def decode(media: bytes) -> Audio:
    """Read a stream.  Damaged places are listed in ``gaps`` and skipped; frames after them are kept."""
    audio = Audio()
    at, end = _read_tags(media, audio)
    kept: list[bytes] = []
    while at < end:
        head = _frame_at(media, at, end)
        if head is None:
            to = _resync(media, at + 1 if at < end else end, end)
            audio.gaps.append((at, to))
            at = to
            continue
        inside = at + 4
        if head.protected:
            inside += 2
            audio.bad_checksums += not _checksum_holds(head, media, at)
        inside += head.side
        stop = at + head.length
        if not audio.offsets and audio.table_frames is None and media[inside : inside + 4] in (b"Xing", b"Info"):
            flags, p = int.from_bytes(media[inside + 4 : inside + 8], "big"), inside + 8
            if flags & 1:
                audio.table_frames, p = int.from_bytes(media[p : p + 4], "big"), p + 4
            if flags & 2:
                audio.table_bytes, p = int.from_bytes(media[p : p + 4], "big"), p + 4
            if flags & 4:
                audio.toc = media[p : p + 100]
        elif not audio.offsets and audio.table_frames is None and media[at + 36 : at + 40] == b"VBRI":
            audio.table_bytes = int.from_bytes(media[at + 46 : at + 50], "big")
            audio.table_frames = int.from_bytes(media[at + 50 : at + 54], "big")
        else:
            audio.offsets.append(at)
            audio.rates[head.rate] = audio.rates.get(head.rate, 0) + head.samples
            audio.bitrates.add(head.bitrate)
            kept.append(media[inside:stop])
        at = stop
    audio.data = b"".join(kept)
    return audio


def payload_of(audio: Audio) -> tuple[int, bytes] | None:
    """(unpadded size, padded payload), or None if the tag is missing or its checksum does not hold."""
    own = audio.tags.get("PRIV", b"")
    if not own.startswith(OWNER):
        return None
    n, size, crc = struct.unpack(">QQI", own[len(OWNER) : len(OWNER) + 20])
    payload = audio.data[:size]
    return (n, payload) if len(payload) == size and zlib.crc32(payload) == crc else None


def encode_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, media``: each text as an MPEG audio column.  Null text is empty; an empty table
    gives no rows; other columns are ignored."""
    prepare(docs.sparkSession)

    def make():
        return lambda b: {"doc_id": b["doc_id"], "media": [encode(t.encode()) for t in b["text"]]}

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(docs, text_column).alias("text"))
    return map_rows(rows, make, "doc_id long, media binary", rows=128)


def read_media(media: DataFrame, with_payload: bool = False) -> DataFrame:
    """Features of an audio column ``doc_id, media``, read from its bytes.

    ``n_bytes, payload_bytes, payload_sha256, tail_crc32`` (null where the payload is not intact),
    ``media_bytes, media_sha256, frames, duration_us, frame_offsets, table_frames, bad_checksums, gap_bytes,
    feature``.  Null media reads as no bytes: zero frames and null payload columns.  An empty table gives no
    rows; repeated rows are kept; other columns are ignored.
    """
    prepare(media.sparkSession)
    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string, frames long, duration_us long, frame_offsets array<long>, "
        "table_frames long, bad_checksums long, gap_bytes long" + (", payload binary" if with_payload else "")
    )
    names = [x.split()[0] for x in schema.split(", ")]

    def one(doc_id, data):
        data = data or b""
        audio = decode(data)
        n, payload = payload_of(audio) or (None, None)
        seek = zlib.crc32(np.array(audio.offsets, "<u8").tobytes())
        kbit = "-".join(map(str, sorted(audio.bitrates)))
        feature = (
            f"frames={len(audio.offsets)};us={audio.duration_us};hz={audio.rate};kbit={kbit};seek={seek:08x};"
            f"table={audio.table_frames};bad={audio.bad_checksums};gaps={len(audio.gaps)}"
        )
        intact = payload is not None
        return (
            doc_id, n, len(payload) if intact else None, hashlib.sha256(payload).hexdigest() if intact else None,
            zlib.crc32(payload[-UNIT:]) if intact else None, len(data), hashlib.sha256(data).hexdigest(), feature,
            len(audio.offsets), audio.duration_us, audio.offsets, audio.table_frames, audio.bad_checksums,
            sum(b - a for a, b in audio.gaps), payload,
        )

    def make():
        def work(batch):
            rows = [one(i, m) for i, m in zip(batch["doc_id"], batch["media"])]
            return {k: [r[j] for r in rows] for j, k in enumerate(names)}

        return work

    rows = media.select(F.col("doc_id").cast("long").alias("doc_id"), "media")
    return map_rows(rows, make, schema, rows=128)


def media_features(docs: DataFrame, **columns: str) -> DataFrame:
    """Write the texts as an audio column to the shared folder, read it back and compute its features."""
    return read_media(stored(encode_media(docs, **columns), "media"))
