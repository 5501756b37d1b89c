"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums, durations, seek offsets.

``parse`` reads any MPEG-1/2/2.5 stream of layers I to III: it reads ID3v2 (2.2 to 2.4) and
ID3v1 tags, resynchronises on frame headers (two in a row must agree), reads Xing/Info and VBRI
tables, verifies the CRC-16 of protected frames of every layer, and gives the exact duration
(samples over the sampling rate) with the byte offset of every frame.  ``store`` writes bytes losslessly into
such a stream: silent layer III frames whose ancillary data, the part after empty granules,
holds 576 payload bytes each.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_slices, strings

# Fixed values of ISO/IEC 11172-3 and 13818-3: bit rates in kbit/s by (version 1?, layer), and sampling rates.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
VERSIONS = {0: 2.5, 2: 2, 3: 1}
# Bits of a layer II subband's allocation, as (subbands, bits) runs, by table.
ALLOCATIONS = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "lsf": ((4, 4), (7, 3), (19, 2)),
}


@dataclass
class Header:
    version: float
    layer: int
    protected: bool
    bitrate: int
    rate: int
    channels: int
    size: int
    samples: int
    bound: int = 32  # subbands below it have an allocation for each channel

    def agrees(self, other: Header | None) -> bool:
        """Frames of one stream: what can't change from frame to frame is the same."""
        return other is not None and (self.version, self.layer, self.rate) == (other.version, other.layer, other.rate)

    @property
    def side_bytes(self) -> int:
        """Of layer III side information."""
        return (17 if self.channels == 1 else 32) if self.version == 1 else (9 if self.channels == 1 else 17)


def header(data: bytes, at: int) -> Header | None:
    """The frame header at a byte offset, or None; free-format streams count as none."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2, b3 = data[at + 1], data[at + 2], data[at + 3]
    version, layer = VERSIONS.get(b1 >> 3 & 3), 4 - (b1 >> 1 & 3)
    if version is None or layer == 4 or b2 >> 4 in (0, 15) or b2 >> 2 & 3 == 3 or b3 & 3 == 2:
        return None
    bitrate, rate = BITRATES[version == 1, layer][b2 >> 4] * 1000, RATES[version][b2 >> 2 & 3]
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    pad = b2 >> 1 & 1
    size = (12 * bitrate // rate + pad) * 4 if layer == 1 else samples // 8 * bitrate // rate + pad
    bound = 4 * (b3 >> 4 & 3) + 4 if b3 >> 6 == 1 else 32
    return Header(version, layer, not b1 & 1, bitrate, rate, 1 if b3 >> 6 == 3 else 2, size, samples, bound)


def crc_table() -> np.ndarray:
    """CRC-16 with polynomial 0x8005, most significant bit first, by byte."""
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, table << 1 ^ 0x8005, table << 1) & 0xFFFF
    return table


CRC = crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 of each row of a byte matrix, started from 0xFFFF."""
    crc = np.full(len(rows), 0xFFFF, dtype=np.uint32)
    for column in rows.T:
        crc = (crc << 8 & 0xFFFF) ^ CRC[crc >> 8 ^ column]
    return crc


def allocation_bits(h: Header) -> list[int]:
    """Bits of each subband's allocation in a frame of layer I or II."""
    if h.layer == 1:
        return [4] * 32
    each = h.bitrate // h.channels // 1000
    if h.version != 1:
        name = "lsf"
    elif each <= 48:
        name = "d" if h.rate == 32000 else "c"
    else:
        name = "a" if each <= 80 or h.rate == 48000 else "b"
    return [bits for count, bits in ALLOCATIONS[name] for _ in range(count)]


def checksum_holds(frame: bytes, h: Header) -> bool:
    """Whether a protected frame of layer I or II has the CRC-16 of its header's end, allocations and, in layer II, selectors."""
    value, total, at = int.from_bytes(frame[6:], "big"), 8 * (len(frame) - 6), 0
    taken = chosen = 0
    for band, width in enumerate(allocation_bits(h)):
        shared = band >= h.bound
        for _ in range(1 if shared else h.channels):
            used = value >> max(0, total - at - width) & ((1 << width) - 1)
            chosen += (h.channels if shared else 1) * bool(used)
            at += width
    taken = at + (2 * chosen if h.layer == 2 else 0)
    if taken > total:
        return False
    crc = 0xFFFF
    bits = int.from_bytes(frame[2:4], "big") << taken | value >> total - taken
    for k in range(16 + taken - 1, -1, -1):
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if (crc >> 15) ^ (bits >> k & 1) else 0)
    return crc == int.from_bytes(frame[4:6], "big")


@dataclass
class Stream:
    """What a parse found; offsets are those of audio frames, without the table's frame."""

    frames: int = 0
    samples: int = 0
    rate: int = 0
    offsets: list[int] = field(default_factory=list)
    checked: int = 0
    bad: int = 0
    skipped: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, int] = field(default_factory=dict)
    first: Header | None = None

    @property
    def duration(self) -> Fraction:
        return Fraction(self.samples, self.rate) if self.rate else Fraction(0)

    def seek(self, seconds: Fraction) -> int | None:
        """The byte offset of the frame that holds a moment; None outside the stream."""
        if not self.offsets or seconds < 0 or seconds >= self.duration:
            return None
        return self.offsets[int(seconds * self.rate) // self.first.samples]


def syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def tags(data: bytes) -> tuple[int, dict[str, str]]:
    """(end of ID3v2 tags, their text frames)."""
    at, found = 0, {}
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        major, flags, end = data[at + 3], data[at + 5], at + 10 + syncsafe(data[at + 6 : at + 10])
        p = at + 10
        label, head = (3, 6) if major == 2 else (4, 10)  # bytes of a frame's name, and of its header
        while major >= 2 and p + head <= end and data[p : p + 1].isalpha():
            name = data[p : p + label].decode("latin-1")
            stated = data[p + label : p + 2 * label]
            size = syncsafe(stated) if major == 4 and len(stated) == 4 else int.from_bytes(stated, "big")
            body = data[p + head : min(end, p + head + size)]
            if name[0] == "T" and body:
                found[name] = body[1:].decode({1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace").rstrip("\0")
            p += head + size
        at = end + (10 if flags & 0x10 else 0)
    return min(at, len(data)), found


def last_tag(data: bytes) -> dict[str, str]:
    """Fields of the ID3v1 tag in the last 128 bytes, those that aren't empty."""
    b = data[-128:]
    text = lambda x: x.split(b"\0")[0].decode("latin-1").rstrip()
    out = {"title": text(b[3:33]), "artist": text(b[33:63]), "album": text(b[63:93]), "year": text(b[93:97]), "comment": text(b[97:127])}
    if b[125] == 0 and b[126]:
        out["track"] = str(b[126])
    return {f"v1.{k}": v for k, v in out.items() if v} | {"v1.genre": str(b[127])}


def rate_table(data: bytes, at: int, h: Header) -> dict[str, int]:
    """Fields of a Xing, Info or VBRI table in the frame at ``at``; empty if it has none."""
    p = at + 4 + 2 * h.protected + h.side_bytes
    kind = data[p : p + 4]
    if h.layer == 3 and kind in (b"Xing", b"Info"):
        flags = int.from_bytes(data[p + 4 : p + 8], "big")
        out, p = {"kind": kind.decode()}, p + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(data[p : p + 4], "big")
                p += 4
        if flags & 4:
            out["toc"] = list(data[p : p + 100])
        return out
    p = at + 36
    if h.layer == 3 and data[p : p + 4] == b"VBRI":
        count, scale, width, step = struct.unpack(">4H", data[p + 18 : p + 26].ljust(8, b"\0"))
        entries = [int.from_bytes(data[p + 26 + k * width : p + 26 + (k + 1) * width], "big") * scale for k in range(count)]
        return {"kind": "VBRI", "bytes": int.from_bytes(data[p + 10 : p + 14], "big"), "frames": int.from_bytes(data[p + 14 : p + 18], "big"), "toc": entries, "step": step}
    return {}


def frames_to_end(data: bytes, at: int, like: Header) -> bool:
    """Frames of one kind follow each other from ``at`` to the very end."""
    while at < len(data):
        h = header(data, at)
        if not like.agrees(h):
            return False
        at += h.size
    return at == len(data)


def parse(data: bytes) -> Stream:
    """Read a stream.  Bytes that belong to no frame count as skipped; an empty one has no frames.

    Out of step, a header counts if one that agrees with it stands where its frame ends, or if
    the stream ends there.

    The last 128 bytes are an ID3v1 tag if they begin with TAG, unless whole frames reach over
    their start to the very end: then they are what the frames hold.
    """
    s = Stream()
    at, s.tags = tags(data)
    end = len(data) - (128 if data[-128:-125] == b"TAG" and len(data) >= at + 128 else 0)
    held = end < len(data)  # what may be an ID3v1 tag
    synced = False
    protected: dict[int, list[int]] = {}  # offsets of protected layer III frames by header and side bytes
    while at < end:
        h = header(data, at)
        if s.first is not None and not s.first.agrees(h):
            h = None
        after = at + h.size if h is not None else 0
        if after > end and end < len(data) and frames_to_end(data, after, h):
            end = len(data)
        if h is None or after > end or not synced and after < end and not h.agrees(header(data, after)):
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            s.skipped += nxt - at
            at, synced = nxt, False
            continue
        synced = True
        if s.first is None:
            s.first, s.rate = h, h.rate
            s.table = rate_table(data, at, h)
            if s.table:
                at = after
                continue
        s.offsets.append(at)
        s.samples += h.samples
        if h.protected and h.layer == 3:
            protected.setdefault(h.side_bytes, []).append(at)
        elif h.protected:
            s.checked += 1
            s.bad += not checksum_holds(data[at:after], h)
        at = after
    s.frames = len(s.offsets)
    if held and end < len(data):
        s.tags |= last_tag(data)
    raw = np.frombuffer(data, dtype=np.uint8)
    for side, where in protected.items():
        # the checksum covers the header's last two bytes and the side information
        w = np.array(where)[:, None]
        covered = raw[w + np.array([2, 3, *range(6, 6 + side)])]
        stored = raw[w + np.array([4, 5])].astype(np.uint32)
        s.checked += len(where)
        s.bad += int((crc16(covered) != (stored[:, 0] << 8 | stored[:, 1])).sum())
    return s


# -- storing bytes ------------------------------------------------------------------------

UNIT = 576
HEAD = bytes([0xFF, 0xFA, 0xC4, 0xC0])  # version 1, layer III, protected, 224 kbit/s, 48 kHz, one channel
FRAME, SIDE = 672, 17
BODY = 4 + 2 + SIDE


def pad(payload: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of 576."""
    return payload + b"\xff" * ((-len(payload)) % UNIT or (0 if payload else UNIT))


def store(payload: bytes) -> bytes:
    """A layer III stream that holds ``payload`` (a positive multiple of 576 bytes): an ID3v2
    tag with the length, an Info frame with counts and table of contents, then a frame for
    each 576 bytes, with its checksum.
    """
    n = len(payload) // UNIT
    empty = HEAD + int(crc16(np.frombuffer(HEAD[2:] + bytes(SIDE), dtype=np.uint8)[None, :])[0]).to_bytes(2, "big") + bytes(SIDE)
    body = np.zeros((n, FRAME), dtype=np.uint8)
    body[:, :BODY] = np.frombuffer(empty, dtype=np.uint8)
    body[:, BODY : BODY + UNIT] = np.frombuffer(payload, dtype=np.uint8).reshape(n, UNIT)
    length = b"\0" + str(n * 24).encode()  # milliseconds: 1152 samples at 48 kHz are 24
    text = b"TLEN" + struct.pack(">IH", len(length), 0) + length
    size = len(text)
    tag = b"ID3\x03\x00\x00" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + text
    total = FRAME * (n + 1)
    info = empty + b"Info" + struct.pack(">III", 7, n, total) + bytes(256 * (FRAME + FRAME * (n * k // 100)) // total for k in range(100))
    return tag + info.ljust(FRAME, b"\0") + body.tobytes()


def read_back(data: bytes, s: Stream) -> bytes:
    """The payload from the ancillary data of a parsed stream of :func:`store`."""
    if not s.offsets:
        return b""
    raw = np.frombuffer(data, dtype=np.uint8)
    if s.skipped == 0 and len(s.offsets) * FRAME == len(data) - s.offsets[0]:
        return raw[s.offsets[0] :].reshape(-1, FRAME)[:, BODY : BODY + UNIT].tobytes()
    return b"".join(data[o + BODY : o + BODY + UNIT] for o in s.offsets)


def runs(offsets: list[int]) -> str:
    """All offsets, exactly: the first, then the distances, each with how often it comes in a row."""
    if not offsets:
        return ""
    step = np.diff(np.array(offsets, dtype=np.int64))
    edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(step)] if len(step) else [0]
    return "+".join([str(offsets[0]), *(f"{step[a]}*{z - a}" for a, z in zip(edges, edges[1:]))])


def feature(s: Stream) -> str:
    """A stream's features as one string."""
    d = s.duration
    h = s.first
    kind = f"mpeg{h.version:g}-layer{h.layer};{h.rate}Hz;{h.channels}ch;{h.bitrate}bps" if h else "none"
    table = f"{s.table.get('kind', '-')}:{s.table.get('frames', 0)}:{s.table.get('bytes', 0)}"
    return f"{kind};frames={s.frames};samples={s.samples};duration={d.numerator}/{d.denominator};table={table};crc={s.checked - s.bad}/{s.checked};skipped={s.skipped};seek={runs(s.offsets)};tags={','.join(f'{k}={v}' for k, v in sorted(s.tags.items()))}"


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_bytes and media, the stream that stores the text's UTF-8.

    Null texts count as empty (576 bytes of padding); ids may be null or repeated; other
    columns aren't read; an empty table gives an empty result.  A text of any length is stored
    whole, in time and memory in proportion to its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            data = [t.encode("utf-8", "surrogatepass") for t in strings(b.column(1))]
            media = [store(pad(x)) for x in data]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

        yield from map_slices(batches, "text", work)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


PARSED = "frames long, samples long, rate int, duration_num long, duration_den long, crc_checked long, crc_bad long, skipped_bytes long, seek_offsets array<long>, tags map<string,string>"


def parse_column(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per input row: what :func:`parse` finds in ``media_col``.

    The duration is the exact fraction duration_num / duration_den in seconds; seek_offsets
    has the byte offset of every audio frame.  A null or foreign value has no frames.  A stream
    of any length is read whole, in linear time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            found = [parse(x or b"") for x in b.column(1).to_pylist()]
            columns = [
                pa.array([s.frames for s in found], pa.int64()),
                pa.array([s.samples for s in found], pa.int64()),
                pa.array([s.rate for s in found], pa.int32()),
                pa.array([s.duration.numerator for s in found], pa.int64()),
                pa.array([s.duration.denominator for s in found], pa.int64()),
                pa.array([s.checked for s in found], pa.int64()),
                pa.array([s.bad for s in found], pa.int64()),
                pa.array([s.skipped for s in found], pa.int64()),
                pa.array([s.offsets for s in found], pa.list_(pa.int64())),
                pa.array([list(s.tags.items()) for s in found], pa.map_(pa.string(), pa.string())),
            ]
            return pa.RecordBatch.from_arrays([b.column(0), *columns], ["id", *(f.split()[0] for f in PARSED.replace("map<string,string>", "map").split(", "))])

        yield from map_slices(batches, "media", work)

    kind = media.schema[id_col].dataType.simpleString()
    rows = media.select(media[id_col].alias("id"), media[media_col].alias("media"))
    return rows.mapInArrow(run, f"id {kind}, {PARSED}").withColumnRenamed("id", id_col)


DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text, read the stored bytes back and compute features, in one pass; nulls, repeats and long texts as in :func:`encode_column`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib
        from hashlib import sha256

        def row(text: str) -> tuple:
            data = text.encode("utf-8", "surrogatepass")
            media = store(pad(data))
            s = parse(media)
            payload = read_back(media, s)
            return len(data), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), sha256(media).hexdigest(), feature(s)

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            kinds = [pa.string() if f.endswith("string") else pa.int64() for f in DIGESTS.split(", ")]
            columns = zip(*(row(t) for t in strings(b.column(1))))
            return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["id", *(f.split()[0] for f in DIGESTS.split(", "))])

        yield from map_slices(batches, "text", work)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {kind}, {DIGESTS}").withColumnRenamed("id", id_col)
