"""Media columns: MPEG audio.

`write_mpeg` stores a payload of 8-bit samples losslessly as MPEG-2 layer III
audio, 576 samples a frame (16 kHz, mono, with checksums, variable bitrate): a
frame's coded part is empty (silence), and its samples stand in the ancillary
part. A frame whose samples end in bytes 255 is stored shorter; the reader fills
its block of 576 up with 255 again. An ID3v2 tag with the title and a frame with
the variable-bitrate table come first, as usual.

`read_mpeg` reads streams of MPEG-1, 2 and 2.5, layers I to III, one or two channels, of any bitrates but the free format: it skips
and parses tags (ID3 1, 2.2, 2.3 and 2.4), finds the frame
headers again after foreign bytes (a header counts if the frame it announces is
followed by another header of the same kind, or by the end), verifies the checksums of layer III (other layers' are not looked at),
parses the variable-bitrate tables of both customary kinds (Xing or Info, VBRI), and gives the seek
offset of each frame and the exact duration: whole frames, less the encoder's delay and padding where the table tells them.

A null text counts as empty; an empty text has one block, all of bytes 255. Texts of any length are stored whole.
Equal texts, and so repeated rows, give equal values. An empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftstone.llm.common import id_and_text

SAMPLES = 576
#: Bitrates in kbit/s by header index, of MPEG-1 layers I, II and III, and of MPEG-2 and 2.5 layer I, and II and III. Fixed values.
ONE_I = (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448)
ONE_II = (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384)
ONE_III = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
TWO_I = (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256)
BITRATES = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
#: Sampling rates of MPEG-2; twice as much in MPEG-1, half as much in MPEG-2.5. Fixed values.
RATES = (22050, 24000, 16000)
RATE_INDEX = 2
#: Header (4), checksum (2) and side information of one channel (9).
HEAD = 15
LENGTHS = np.array([72 * 1000 * b // RATES[RATE_INDEX] for b in BITRATES])


def _crc_table() -> np.ndarray:
    """CRC-16 with polynomial 0x8005, high bit first."""
    crc = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        crc = np.where(crc & 0x8000, (crc << 1) ^ 0x8005, crc << 1) & 0xFFFF
    return crc


CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """Checksum of each row of bytes."""
    crc = np.full(len(rows), 0xFFFF, np.uint32)
    for k in range(rows.shape[1]):
        crc = (crc << 8 & 0xFF00) ^ CRC[(crc >> 8) ^ rows[:, k]]
    return crc


def _heads() -> np.ndarray:
    """For each bitrate index the 15 bytes before a frame's samples."""
    out = np.zeros((15, HEAD), np.uint8)
    for i in range(1, 15):
        out[i, :4] = 0xFF, 0xF2, i << 4 | RATE_INDEX << 2, 0xC0  # MPEG-2, layer III, protected, mono
        checked = np.r_[out[i, 2:4], out[i, 6:]]
        out[i, 4:6] = list(struct.pack(">H", int(crc16(checked[None])[0])))
    return out


HEADS = _heads()


def padded(text: bytes) -> bytes:
    """The text with bytes 255 up to a positive multiple of 576."""
    return text + b"\xff" * (max(1, -(-len(text) // SAMPLES)) * SAMPLES - len(text))


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def write_mpeg(payload: bytes, title: str = "payload") -> bytes:
    """The stream that stores `payload`, whose length is a positive multiple of 576."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, SAMPLES)
    used = SAMPLES - np.argmax(blocks[:, ::-1] != 255, axis=1)
    used[(blocks == 255).all(axis=1)] = 0
    index = np.searchsorted(LENGTHS[1:], HEAD + used) + 1
    size = LENGTHS[index]
    frames = np.full((len(blocks), int(size.max())), 255, np.uint8)
    frames[:, :HEAD] = HEADS[index]
    room = frames.shape[1] - HEAD
    frames[:, HEAD : HEAD + min(SAMPLES, room)] = blocks[:, : min(SAMPLES, room)]
    body = frames[np.arange(frames.shape[1]) < size[:, None]].tobytes()
    # the table: frames, bytes, and where each hundredth of the duration begins, in 256ths of the bytes
    table_size = int(LENGTHS[10])
    offsets = table_size + np.cumsum(size) - size
    total = table_size + int(size.sum())
    toc = np.minimum(255, offsets[np.arange(100) * len(blocks) // 100] * 256 // total).astype(np.uint8)
    table = HEADS[10].tobytes() + b"Xing" + struct.pack(">III", 7, len(blocks), total) + toc.tobytes()
    frame_text = b"\x03" + title.encode()
    tag = b"TIT2" + struct.pack(">I", len(frame_text)) + b"\0\0" + frame_text
    return b"ID3\x03\0\0" + _syncsafe(len(tag)) + tag + table.ljust(table_size, b"\0") + body


@dataclass(frozen=True)
class Header:
    """What a frame's first four bytes say."""

    version: str
    layer: int
    bitrate: int
    rate: int
    channels: int
    samples: int
    length: int
    side: int  # bytes of side information in layer III


@cache
def header(b1: int, b2: int, b3: int) -> Header | None:
    """The header 255, b1, b2, b3, or None if it is none that a frame can have."""
    version, layer = (b1 >> 3) & 3, 4 - ((b1 >> 1) & 3)
    bits, at = b2 >> 4, (b2 >> 2) & 3
    if b1 >> 5 != 7 or version == 1 or layer == 4 or at == 3 or not 0 < bits < 15:
        return None
    one = version == 3
    bitrate = ((ONE_I, ONE_II, ONE_III) if one else (TWO_I, BITRATES, BITRATES))[layer - 1][bits]
    rate = RATES[at] * 2 if one else RATES[at] if version == 2 else RATES[at] // 2
    pad = (b2 >> 1) & 1
    samples = (384, 1152, 1152 if one else 576)[layer - 1]
    length = (12000 * bitrate // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * bitrate // rate + pad
    mono = b3 >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if one else (9 if mono else 17)
    return Header({3: "1", 2: "2", 0: "2.5"}[version], layer, bitrate, rate, 1 if mono else 2, samples, length, side)


@dataclass
class Stream:
    """What a stream holds; offsets and lengths in bytes, without the frame of the table."""

    offsets: np.ndarray
    lengths: np.ndarray
    bitrates: np.ndarray
    rate: int
    samples: int
    crc_ok: int
    skipped: int
    version: str = ""
    layer: int = 0
    channels: int = 0
    delay: int = 0
    padding: int = 0
    tags: dict = field(default_factory=dict)
    table: dict = field(default_factory=dict)

    @property
    def heard(self) -> int:
        """Samples without the encoder's delay and padding."""
        return max(0, self.samples - self.delay - self.padding)


def _size(b: bytes, safe: bool) -> int:
    return sum((x & 127) << s for x, s in zip(b, (21, 14, 7, 0), strict=True)) if safe else int.from_bytes(b, "big")


def _text(b: bytes) -> str:
    kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(b[0] if b else 0, "latin-1")
    return b[1:].decode(kind, "replace").rstrip("\0")


def _tags(data: bytes) -> tuple[dict, int, int]:
    """ID3 tags, and where the audio between them begins and ends."""
    tags, begin, end = {}, 0, len(data)
    while data[begin : begin + 3] == b"ID3" and begin + 10 <= end:
        version, flags = data[begin + 3], data[begin + 5]
        size = _size(data[begin + 6 : begin + 10], True)
        at, stop = begin + 10, min(end, begin + 10 + size)
        body = data[at:stop]
        if flags & 128 and version < 4:
            body = body.replace(b"\xff\0", b"\xff")
        here = 0
        if flags & 64 and version > 2 and len(body) >= 4:
            here = _size(body[:4], version == 4) + (4 if version == 3 else 0)
        name, head = (3, 6) if version == 2 else (4, 10)
        while here + head <= len(body) and body[here : here + name].isalnum():
            n = int.from_bytes(body[here + 3 : here + 6], "big") if version == 2 else _size(body[here + 4 : here + 8], version == 4)
            if body[here : here + 1] == b"T":
                tags[body[here : here + name].decode("latin-1")] = _text(body[here + head : here + head + n])
            here += head + n
        begin = begin + 10 + size + (10 if flags & 16 and version == 4 else 0)
    if end - begin >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        tags["v1"] = data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    return tags, min(begin, end), end


def _frame_at(data: bytes, at: int, end: int) -> Header | None:
    """The header that stands here, if its frame ends within the audio."""
    if at + 4 > end or data[at] != 255:
        return None
    found = header(data[at + 1], data[at + 2], data[at + 3])
    return found if found and found.length >= 4 and at + found.length <= end else None


def _table_at(data: bytes, at: int, found: Header) -> tuple[str, int]:
    """The kind of variable-bitrate table that the frame at `at` holds, and where it begins behind its mark."""
    here = at + (4 if data[at + 1] & 1 else 6) + found.side
    if data[here : here + 4] in (b"Xing", b"Info"):
        return "xing", here + 4
    # some writers leave out the checksum's bytes; VBRI stands at a fixed place
    if data[at + 4 + found.side : at + 8 + found.side] in (b"Xing", b"Info"):
        return "xing", at + 8 + found.side
    return ("vbri", at + 40) if data[at + 36 : at + 40] == b"VBRI" else ("", 0)


def _table(data: bytes, kind: str, here: int) -> dict:
    """frames, bytes, toc, delay and padding, as far as the table has them."""
    table: dict = {}
    if kind == "vbri":
        _, table["delay"], _, table["bytes"], table["frames"], entries, scale, width, table["frames_each"] = struct.unpack(">HHHIIHHHH", data[here : here + 22].ljust(22, b"\0"))
        cells = data[here + 22 : here + 22 + entries * width]
        table["toc"] = [int.from_bytes(cells[k : k + width], "big") * scale for k in range(0, len(cells), width)] if width else []
        return table
    flags = int.from_bytes(data[here : here + 4], "big")
    here += 4
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit:
            table[name] = int.from_bytes(data[here : here + 4], "big")
            here += 4
    if flags & 4:
        table["toc"] = list(data[here : here + 100])
        here += 100
    here += 4 if flags & 8 else 0
    if data[here : here + 4] in (b"LAME", b"Lavf", b"Lavc", b"L3.9"):
        both = int.from_bytes(data[here + 21 : here + 24], "big")
        table["encoder"] = data[here : here + 9].decode("latin-1").rstrip("\0 ")
        table["delay"], table["padding"] = both >> 12, both & 0xFFF
    return table


def read_mpeg(data: bytes) -> Stream:
    tags, at, end = _tags(data)
    offsets, heads, skipped, last = [], [], 0, None
    while at < end:
        found = _frame_at(data, at, end)
        if found:
            kind = (found.version, found.layer, found.rate)
            after = None if kind == last or at + found.length == end or _table_at(data, at, found)[0] else _frame_at(data, at + found.length, end)
            # a header out of step must hold the table, or be followed by another of the same kind
            if kind == last or at + found.length == end or _table_at(data, at, found)[0] or (after and (after.version, after.layer, after.rate) == kind):
                offsets.append(at), heads.append(found)
                at, last = at + found.length, kind
                continue
        place = data.find(b"\xff", at + 1, end)
        place = end if place < 0 else place
        skipped += place - at
        at, last = place, None
    table = {}
    if heads:
        kind, here = _table_at(data, offsets[0], heads[0])
        if kind:
            table = _table(data, kind, here)
            offsets, heads = offsets[1:], heads[1:]
    raw = np.frombuffer(data, np.uint8)
    places = np.array(offsets, np.int64)
    protected = raw[places + 1] & 1 == 0 if len(places) else np.zeros(0, bool)
    side = np.array([h.side if h.length >= 6 + h.side else 0 for h in heads], np.int64)
    crc_ok = 0
    for n in np.unique(side[(side > 0) & protected]):
        rows = raw[places[(side == n) & protected][:, None] + np.arange(6 + n)]
        crc_ok += int((crc16(np.c_[rows[:, 2:4], rows[:, 6:]]) == (rows[:, 4].astype(np.uint32) << 8 | rows[:, 5])).sum())
    first = heads[0] if heads else None
    return Stream(
        places,
        np.array([h.length for h in heads], np.int64),
        np.array([h.bitrate for h in heads], np.int64),
        first.rate if first else 0,
        sum(h.samples for h in heads),
        crc_ok,
        skipped,
        first.version if first else "",
        first.layer if first else 0,
        first.channels if first else 0,
        table.get("delay", 0),
        table.get("padding", 0),
        tags,
        table,
    )


def payload_of(data: bytes, stream: Stream) -> bytes:
    """The samples that `write_mpeg` stored."""
    if not len(stream.offsets):
        return b""
    raw = np.r_[np.frombuffer(data, np.uint8), np.full(SAMPLES + HEAD, 255, np.uint8)]
    blocks = raw[stream.offsets[:, None] + (HEAD + np.arange(SAMPLES))]
    blocks[np.arange(SAMPLES) >= (stream.lengths - HEAD)[:, None]] = 255
    return blocks.tobytes()


def duration_us(stream: Stream) -> int:
    return stream.heard * 1_000_000 // stream.rate if stream.rate else 0


def features(stream: Stream, media_bytes: int) -> str:
    """Exact values only, so that equal streams give equal text."""
    kinds, n = np.unique(stream.bitrates, return_counts=True)
    offsets = stream.offsets.astype("<i8")
    return json.dumps(
        {
            "frames": len(offsets),
            "samples": stream.samples,
            "rate": stream.rate,
            "duration_us": duration_us(stream),
            "version": stream.version,
            "layer": stream.layer,
            "channels": stream.channels,
            "delay": stream.delay,
            "padding": stream.padding,
            "bitrates": {str(k): int(c) for k, c in zip(kinds, n, strict=True)},
            "mean_bitrate": int(stream.lengths.sum()) * 8 * stream.rate // stream.samples if stream.samples else 0,
            "crc_ok": stream.crc_ok,
            "skipped": stream.skipped,
            "tags": stream.tags,
            "table_frames": stream.table.get("frames"),
            "table_bytes": stream.table.get("bytes"),
            "table_matches": stream.table.get("frames") == len(offsets),
            "first_offset": int(offsets[0]) if len(offsets) else None,
            "last_offset": int(offsets[-1]) if len(offsets) else None,
            "offsets_crc32": zlib.crc32(offsets.tobytes()),
            "media_bytes": media_bytes,
        },
        sort_keys=True,
    )


def media_table(docs: DataFrame) -> DataFrame:
    """The stored form itself: (doc_id, media binary, duration_us, seek_offsets)."""

    def run(batches):
        for batch in batches:
            media = [write_mpeg(padded(t or b"")) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            streams = [read_mpeg(m) for m in media]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(media, pa.binary()), pa.array([duration_us(s) for s in streams], pa.int64()), pa.array([s.offsets for s in streams], pa.list_(pa.int64()))], ["doc_id", "media", "duration_us", "seek_offsets"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, media binary, duration_us long, seek_offsets array<long>")


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(docs: DataFrame) -> DataFrame:
    """Store each text as audio, read it back, and give digests of both; no shuffle."""

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                text = text or b""
                media = write_mpeg(padded(text))
                stream = read_mpeg(media)
                back = payload_of(media, stream)
                rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(stream, len(media))))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [c.split()[0] for c in SCHEMA.split(", ")])

    return id_and_text(docs).mapInArrow(run, SCHEMA)
