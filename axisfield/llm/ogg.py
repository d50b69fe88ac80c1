"""Ogg media columns: write and read pages, packets and logical streams.

`mux` stores 8-bit samples as an Ogg file of several interleaved logical streams;
`demux` verifies every page's checksum, rebuilds packets from lacing values (also
across pages), separates the logical streams by serial number and derives packet
timestamps from granule positions.

A page's granule position is that of the last packet that ends on it. The positions of the packets
before it follow from their durations where the packets state them (the samples of `mux`, Opus,
FLAC), counted on from the page before, else back from the page's own. Where they don't
(Vorbis, whose durations need its setup tables, and unknown codecs) they are null. Seconds are
positions by the rate of the identification header (Vorbis, Opus less its pre-skip, FLAC,
`mux`), null without one.

Defined results: a null or empty medium has no streams; bytes that are not a page
are skipped to the next capture pattern and counted; a page whose checksum fails is
counted and its packets are left out, as is a packet whose beginning or end is lost; a
page that begins a stream whose serial number was in use before begins a new one (a chained
file: `link` counts them). Equal media give equal rows; extra columns are kept by `demux`.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
_HEAD = struct.Struct("<4sBBqIIIB")
_MAGIC = b"\x80pcm8\0\0\0"
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))

#: Samples of a block, blocks of a packet, streams, and samples a second of `mux`.
BLOCK, PACKET_BLOCKS, STREAMS, RATE = 576, 4, 2, 8000


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 04c11db7, unreflected, from zero; zlib's is the reflected form from all ones."""
    reflected = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(CAPTURE, 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    crc = page_checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


class _Writer:
    """Pages of one logical stream."""

    def __init__(self, serial: int, header: bytes):
        self.serial, self.sequence = serial, 1
        self.pages = [_page(FIRST, 0, serial, 0, bytes([len(header)]), header)]
        self.lacing, self.body, self.granule, self.done, self.continued = bytearray(), bytearray(), 0, -1, 0

    def flush(self, last: int = 0) -> None:
        self.pages.append(_page(self.continued | last, self.done, self.serial, self.sequence, bytes(self.lacing), bytes(self.body)))
        self.continued = CONTINUED if self.lacing and self.lacing[-1] == 255 else 0
        self.sequence, self.done = self.sequence + 1, -1
        self.lacing, self.body = bytearray(), bytearray()

    def packet(self, data: bytes) -> None:
        self.granule += len(data)
        for at in range(0, len(data) + 1, 255):
            if len(self.lacing) == 255:
                self.flush()
            part = data[at : at + 255]
            self.lacing.append(len(part))
            self.body += part
        self.done = self.granule


def mux(samples: bytes, streams: int = STREAMS, rate: int = RATE) -> bytes:
    """Samples dealt in blocks to the logical streams in turn, as one Ogg file; all streams' first pages lead."""
    writers = [_Writer(k + 1, _MAGIC + struct.pack("<IHH", rate, streams, k)) for k in range(streams)]
    size = BLOCK * PACKET_BLOCKS
    for n, at in enumerate(range(0, len(samples), size)):
        writers[n % streams].packet(samples[at : at + size])
    for w in writers:
        w.flush(LAST)
    pages = [w.pages[0] for w in writers]
    for k in range(1, max(len(w.pages) for w in writers)):
        pages += [w.pages[k] for w in writers if k < len(w.pages)]
    return b"".join(pages)


class Demuxed:
    def __init__(self) -> None:
        self.pages = self.bad_pages = self.skipped = 0
        #: By serial number and by how often it began before: pages of finished packets.
        self.streams: dict[tuple[int, int], dict] = {}


def read_pages(media: bytes) -> Demuxed:
    """All complete packets by logical stream and page, in file order."""
    out, at, end = Demuxed(), 0, len(media)
    link: dict[int, int] = {}
    while at < end:
        if media[at : at + 4] != CAPTURE or at + 27 > end:
            to = media.find(CAPTURE, at + 1)
            out.skipped += (to if to > 0 else end) - at
            if to < 0:
                break
            at = to
            continue
        _, version, flags, granule, serial, sequence, crc, segments = _HEAD.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + segments]
        size = 27 + segments + sum(lacing)
        page = media[at : at + size]
        out.pages += 1
        if version or len(lacing) < segments or len(page) < size or page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            out.bad_pages += 1
            at += 4
            to = media.find(CAPTURE, at)
            at = to if to > 0 else end
            continue
        if serial not in link or flags & FIRST:
            link[serial] = link.get(serial, -1) + 1
        s = out.streams.setdefault((serial, link[serial]), {"next": sequence, "part": None, "pages": [], "ended": False})
        whole = sequence == s["next"]  # nothing is lost between the page before and this one
        if not whole or not flags & CONTINUED:
            s["part"] = None  # its other part is lost
        s["next"], s["ended"] = sequence + 1, bool(flags & LAST)
        part, body, finished = s["part"], 27 + segments, []
        lost = bool(flags & CONTINUED) and part is None
        part = part if part is not None else []
        for n in lacing:
            part.append(page[body : body + n])
            body += n
            if n < 255:
                if not lost:
                    finished.append(b"".join(part))
                part, lost = [], False
        s["part"] = part if lacing and lacing[-1] == 255 and not lost else None
        if finished or not whole:
            s["pages"].append((granule, whole, finished))
        at += size
    return out


def _opus_samples(packet: bytes) -> int | None:
    """Samples at 48 kHz, by the first byte's configuration and frame count."""
    if not packet:
        return 0
    mode, code = packet[0] >> 3, packet[0] & 3
    # fixed values: frame lengths in samples of SILK, hybrid and CELT configurations
    frame = (480, 960, 1920, 2880)[mode & 3] if mode < 12 else (480, 960)[mode & 1] if mode < 16 else (120, 240, 480, 960)[mode & 3]
    if code == 3:
        return frame * (packet[1] & 63) if len(packet) > 1 else None
    return frame * (1 if code == 0 else 2)


def _flac_samples(packet: bytes) -> int | None:
    """Samples of a FLAC frame by its header; none for metadata blocks."""
    if len(packet) < 6 or packet[0] != 0xFF or packet[1] & 0xFC != 0xF8:
        return 0
    code = packet[2] >> 4
    if code == 1:
        return 192
    if 2 <= code <= 5:
        return 576 << (code - 2)
    if code >= 8:
        return 256 << (code - 8)
    # the size follows the coded frame number, whose length its leading ones tell
    first = packet[4]
    ones = 8 - (first ^ 0xFF).bit_length()
    at, n = 4 + max(1, ones), code - 5
    return int.from_bytes(packet[at : at + n], "big") + 1 if code in (6, 7) and len(packet) >= at + n else None


def codec(head: bytes) -> tuple[str | None, int, int, object]:
    """Name, rate, samples before the first and the duration function of a stream, by its first packet."""
    if head.startswith(_MAGIC) and len(head) >= 12:
        return "pcm8", struct.unpack_from("<I", head, 8)[0], 0, lambda x: 0 if x.startswith(_MAGIC) else len(x)
    if head.startswith(b"OpusHead") and len(head) >= 19:
        return "opus", 48000, struct.unpack_from("<H", head, 10)[0], lambda x: 0 if x.startswith((b"OpusHead", b"OpusTags")) else _opus_samples(x)
    if head.startswith(b"\x01vorbis") and len(head) >= 30:
        return "vorbis", struct.unpack_from("<I", head, 12)[0], 0, lambda x: None
    if head.startswith(b"\x7fFLAC") and len(head) >= 51:
        return "flac", int.from_bytes(head[27:30], "big") >> 4, 0, _flac_samples
    return None, 0, 0, lambda x: None


def stamped(pages: list[tuple[int, bool, list[bytes]]], duration) -> list[tuple[bytes, int | None]]:
    """Packets with their granule positions, null where neither a page nor durations tell."""
    out, before = [], None
    for granule, whole, packets in pages:
        before = before if whole else None
        if not packets:
            continue
        lengths = [duration(x) for x in packets]
        known = granule != -1 and None not in lengths
        # the last page of a stream may be cut short, so counting on is the safer way
        if known and before is not None:
            places = [before + sum(lengths[: k + 1]) for k in range(len(packets))]
        elif known:
            places = [granule - sum(lengths[k + 1 :]) for k in range(len(packets))]
        else:
            places = [None] * len(packets)
        places[-1] = granule if granule != -1 else None
        out += zip(packets, places, strict=True)
        before = places[-1]
    return out


_PACKET = T.StructType([T.StructField("data", T.BinaryType()), T.StructField("granule", T.LongType()), T.StructField("seconds", T.DoubleType())])
_STREAM = T.StructType([T.StructField("serial", T.LongType()), T.StructField("link", T.LongType()), T.StructField("codec", T.StringType()), T.StructField("rate", T.LongType()), T.StructField("ended", T.BooleanType()), T.StructField("packets", T.ArrayType(_PACKET))])
DEMUXED = T.StructType([T.StructField("pages", T.LongType()), T.StructField("bad_pages", T.LongType()), T.StructField("skipped_bytes", T.LongType()), T.StructField("streams", T.ArrayType(_STREAM))])


def _demuxed(media: bytes | None) -> dict:
    got = read_pages(media or b"")
    streams = []
    for (serial, link), s in sorted(got.streams.items()):
        head = next((x[0] for _, _, x in s["pages"] if x), b"")
        name, rate, skip, duration = codec(head)
        packets = stamped(s["pages"], duration)
        packets = packets[1:] if name == "pcm8" else packets
        seconds = lambda g: max(0, g - skip) / rate if rate and g is not None else None  # noqa: B023, E731
        streams.append({"serial": serial, "link": link, "codec": name, "rate": rate, "ended": s["ended"], "packets": [{"data": d, "granule": g, "seconds": seconds(g)} for d, g in packets]})
    return {"pages": got.pages, "bad_pages": got.bad_pages, "skipped_bytes": got.skipped, "streams": streams}


def _pieces(batch: pa.RecordBatch, column: str, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `size` bytes in the column."""
    from axisfield.llm.common import row_groups, text_buffer

    _, offsets = text_buffer(batch.column(column))
    for a, b in row_groups(offsets, size):
        yield batch.slice(a, b - a)


def _mapped(df: DataFrame, source: str, target: str, kind: T.DataType, make) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    kept = [c for c in df.columns if c != target]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, source) if batch.num_rows else ():
                made = pa.array([make(x.as_py()) for x in piece.column(source)], arrow)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), made], names=[*kept, target])

    return df.select(*{*kept, source}).select(*kept, *([source] if source not in kept else [])).mapInArrow(run, T.StructType([*(df.schema[c] for c in kept), T.StructField(target, kind)]))


def with_media(df: DataFrame, samples: str, media: str = "media") -> DataFrame:
    """Adds the Ogg file that holds a binary column's samples (null: an empty payload)."""
    return _mapped(df, samples, media, T.BinaryType(), lambda x: mux(x or b""))


def demux(df: DataFrame, media: str = "media", into: str = "ogg") -> DataFrame:
    """Adds what the Ogg file in a binary column holds: page counts, and the packets of each logical stream."""
    return _mapped(df, media, into, DEMUXED, _demuxed)


def demux_samples(df: DataFrame, ogg: str = "ogg") -> DataFrame:
    """Adds the samples that `mux` dealt to the streams, in order, and a line on what was read; drops the packets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            samples, features = [], []
            for got in batch.column(ogg):
                got = got.as_py()
                packets = [s["packets"] for s in got["streams"]]
                turns = max(map(len, packets), default=0)
                samples.append(b"".join(p[n]["data"] for n in range(turns) for p in packets if n < len(p)))
                last = max((p[-1]["seconds"] or 0.0 for p in packets if p), default=0.0)
                features.append(f"streams={len(packets)};pages={got['pages']};bad={got['bad_pages']};packets={sum(map(len, packets))};rate={'/'.join(str(s['rate']) for s in got['streams'])};seconds={last:.6f}")
            kept = [c for c in batch.schema.names if c != ogg]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(samples, pa.binary()), pa.array(features, pa.string())], names=[*kept, "samples", "feature"])

    kept = [f for f in df.schema if f.name not in (ogg, "samples", "feature")]
    return df.select(*(F.col(f"`{f.name}`") for f in kept), ogg).mapInArrow(run, T.StructType([*kept, T.StructField("samples", T.BinaryType()), T.StructField("feature", T.StringType())]))
