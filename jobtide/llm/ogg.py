"""Texts as Ogg media: 8-bit samples in two logical streams, written page by page, read back and verified.

The payload of a text (its UTF-8 bytes, zero-padded to a positive multiple of 64) is cut into packets of ``PACKET``
samples that alternate between two logical streams. Each stream opens with a header packet on a page of its own (BOS)
and closes with EOS; the granule position of a page is the number of samples of its stream that end on it. The reader
verifies page checksums, sequence numbers and stream ends, reassembles packets from lacing values (also across pages),
demultiplexes the streams, and derives packet times from granule positions.

The checksum of a page is the CRC with polynomial 0x04C11DB7, not reflected, zero at the start. It is the bit-reversed
reflected CRC of the bit-reversed bytes, so zlib's reflected routine serves.

Defined results: null and empty texts store 64 zero bytes; equal texts give equal media; a damaged file raises
``OggError`` that names the fault; an empty table gives an empty result; further columns are ignored.
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

from jobtide.llm.textvec import slices

PACKET = 4096
RATE = 8000
UNIT = 64
SERIALS = (1, 2)
MAGIC = b"PCM8\x00\x01"
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """A page or stream that isn't valid."""


def page_crc(page: bytes) -> int:
    """Checksum of a page whose checksum field is zero."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def _pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one stream; the first packet is its header. ``packets``: bytes and granule position at their end."""
    pages = [_page(2 | 4 * (len(packets) == 1), packets[0][1], serial, 0, *_laced([packets[0][0]])[0])]
    lacing, body, granule, continued = bytearray(), bytearray(), -1, False
    for packet, end in packets[1:]:
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        at = 0
        while values:
            room = 255 - len(lacing)
            part, values = values[:room], values[room:]
            lacing += part
            size = sum(part)
            body += packet[at : at + size]
            at += size
            if not values:
                granule = end
            if len(lacing) == 255:
                pages.append(_page(int(continued), granule, serial, len(pages), bytes(lacing), bytes(body)))
                lacing, body, granule, continued = bytearray(), bytearray(), -1, bool(values)
    if lacing:
        pages.append(_page(int(continued), granule, serial, len(pages), bytes(lacing), bytes(body)))
    if len(pages) > 1:  # the last page ends the stream
        last = bytearray(pages[-1])
        last[5] |= 4
        last[22:26] = b"\x00\x00\x00\x00"
        last[22:26] = page_crc(bytes(last)).to_bytes(4, "little")
        pages[-1] = bytes(last)
    return pages


def _laced(packets: list[bytes]) -> list[tuple[bytes, bytes]]:
    lacing = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets)
    return [(lacing, b"".join(packets))]


def write(payload: bytes) -> bytes:
    """An Ogg file that holds the payload in two interleaved logical streams."""
    chunks = [payload[k : k + PACKET] for k in range(0, len(payload), PACKET)]
    streams = []
    for k, serial in enumerate(SERIALS):
        packets, end = [(MAGIC + struct.pack("<II", RATE, k), 0)], 0
        for chunk in chunks[k :: len(SERIALS)]:
            end += len(chunk)
            packets.append((chunk, end))
        streams.append(_pages(serial, packets))
    out = [s[0] for s in streams]
    rest = [s[1:] for s in streams]
    for k in range(max(map(len, rest))):
        out += [r[k] for r in rest if k < len(r)]
    return b"".join(out)


@dataclass
class Stream:
    """A logical stream as read: packets, and for each its time in seconds (None where no granule position tells)."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    seconds: list[float | None] = field(default_factory=list)
    pages: int = 0
    granule: int = 0
    ended: bool = False
    open: bytes | None = None


def read(media: bytes, rate: int = RATE) -> dict[int, Stream]:
    """The logical streams of an Ogg file by serial number; raises OggError on any fault."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(media):
        if len(media) - at < 27:
            raise OggError("truncated page")
        magic, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise OggError("no page here")
        lacing = media[at + 27 : at + 27 + n]
        size = 27 + n + sum(lacing)
        page = media[at : at + size]
        if len(page) < size:
            raise OggError("truncated page")
        if page_crc(page[:22] + b"\x00\x00\x00\x00" + page[26:]) != crc:
            raise OggError("checksum")
        if bool(flags & 2) != (serial not in streams):
            raise OggError("stream start")
        s = streams.setdefault(serial, Stream(serial))
        if s.ended or number != s.pages:
            raise OggError("page order")
        if bool(flags & 1) != (s.open is not None):
            raise OggError("continuation")
        where, parts, done = 27 + n, [s.open] if s.open is not None else [], []
        for k, value in enumerate(lacing):
            parts.append(page[where : where + value])
            where += value
            if value < 255:
                done.append(b"".join(parts))
                parts = []
        s.open = b"".join(parts) if parts else None
        if done and granule >= 0:
            back, times = granule, []
            for packet in reversed(done):  # the granule position is that of the last packet that ends here
                times.append(back / rate)
                back -= len(packet)
            s.seconds += reversed(times)
            s.granule = granule
        else:
            s.seconds += [None] * len(done)
        s.packets += done
        s.pages += 1
        s.ended = bool(flags & 4)
        at += size
    for s in streams.values():
        if not s.ended or s.open is not None:
            raise OggError("stream end")
    return streams


def payload_of(streams: dict[int, Stream]) -> bytes:
    """The payload: packets of the streams in turn, after each stream's header packet."""
    order = sorted(streams.values(), key=lambda s: struct.unpack_from("<I", s.packets[0], len(MAGIC) + 4)[0])
    for s in order:
        if not s.packets[0].startswith(MAGIC):
            raise OggError("header packet")
    rows = [s.packets[1:] for s in order]
    return b"".join(r[k] for k in range(max(map(len, rows))) for r in rows if k < len(r))


def features(payload: bytes, streams: dict[int, Stream]) -> str:
    """Level, power, peak, crossings of the level (all of the samples read back), length and container counts."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    low = x * len(x) < x.sum()
    crossings = int(np.count_nonzero(low[1:] != low[:-1]))
    seconds = max((t for s in streams.values() for t in s.seconds if t is not None), default=0.0)
    return (
        f"level={int(x.sum()) // len(x)};power={int((x * x).sum()) // len(x)};peak={int(np.abs(x).max())};crossings={crossings};"
        f"seconds={seconds:.6f};streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={sum(len(s.packets) for s in streams.values())}"
    )


def media(docs: DataFrame, text: str = "text", ident: str = "doc_id", keep_media: bool = False) -> DataFrame:
    """Per row: ident, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    ``keep_media`` adds the stored form itself as ``media``.
    """
    kind = docs.schema[ident].dataType.simpleString()
    schema = f"{ident} {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    schema += ", media binary" if keep_media else ""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            raw, rows = data.tobytes(), []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                size = max(UNIT, -(-(b - a) // UNIT) * UNIT)
                stored = write(raw[a:b].ljust(size, b"\x00"))
                streams = read(stored)
                back = payload_of(streams)
                row = (b - a, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), features(back, streams))
                rows.append((*row, stored) if keep_media else row)
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in columns]], names)

    return docs.select(docs[ident], docs[text].alias("text")).mapInArrow(run, schema)
