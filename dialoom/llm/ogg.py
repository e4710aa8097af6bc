"""Texts as Ogg media: page checksums, lacing, logical streams and granule times.

``mux`` stores a payload of 8-bit mono samples in one physical Ogg bitstream
of two logical streams: the samples and a small description. ``demux`` reads
any such bitstream back: it verifies each page's checksum and sequence number,
reassembles packets from the lacing values, keeps the logical streams apart
and derives times from the granule positions.
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
from pyspark.sql import functions as F

from .scratch import text_bytes

RATE = 8000
PACKET = 2048
UNIT = 64
SAMPLES, NOTES = 0x53414D50, 0x4E4F5445  # serial numbers of the two logical streams
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def ogg_crc(data: bytes) -> int:
    """Checksum of polynomial 0x04C11DB7, not reflected, from 0: zlib's over reversed bits."""
    mirrored = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = bytearray(_HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing)
    head[22:26] = struct.pack("<I", ogg_crc(bytes(head) + body))
    return bytes(head) + body


def _pages(packets: list[tuple[bytes, int]], serial: int) -> Iterator[bytes]:
    """Pages of one logical stream; packets are (data, granule position at their end)."""
    values: list[tuple[int, int, int]] = []  # lacing value, packet, place of its segment
    for p, (data, _) in enumerate(packets):
        whole = len(data) // 255
        values += [(255, p, i * 255) for i in range(whole)] + [(len(data) - whole * 255, p, whole * 255)]
    number, last = 0, len(values)
    for at in range(0, max(1, last), 255):
        own = values[at : at + 255]
        ended = [p for v, p, _ in own if v < 255]
        body = b"".join(packets[p][0][i : i + v] for v, p, i in own)
        flags = (1 if at and values[at - 1][0] == 255 else 0) | (2 if not at else 0) | (4 if at + 255 >= last else 0)
        yield _page(flags, packets[ended[-1]][1] if ended else -1, serial, number, bytes(v for v, _, _ in own), body)
        number += 1


def mux(payload: bytes, n_bytes: int) -> bytes:
    """One physical bitstream: the first pages of both streams, then the rest in turn."""
    cuts = range(0, len(payload), PACKET)
    samples = [(b"samples8" + struct.pack("<IQ", RATE, len(payload)), 0)]
    samples += [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in cuts]
    notes = [(b"textsize" + struct.pack("<Q", n_bytes), 0)]
    own, other = list(_pages(samples, SAMPLES)), list(_pages(notes, NOTES))
    return b"".join([own[0], other[0], *own[1:], *other[1:]])


@dataclass
class Stream:
    """A logical stream as read: its packets and the granule position known at each page's end."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[tuple[int, int]] = field(default_factory=list)  # packets ended so far, granule position
    pages: int = 0
    ended: bool = False


def demux(media: bytes) -> tuple[dict[int, Stream], list[str]]:
    """The logical streams by serial number, and what is wrong with the bitstream.

    A page with a wrong checksum is reported and left out, and with it the packets that
    it holds a part of; reading goes on at the next capture pattern.
    """
    streams: dict[int, Stream] = {}
    parts: dict[int, bytearray | None] = {}
    wrong: list[str] = []
    expect: dict[int, int] = {}
    at = 0
    while at < len(media):
        if media[at : at + 4] != b"OggS" or len(media) - at < 27:
            wrong.append(f"no page at {at}")
            at = media.find(b"OggS", at + 1)
            if at < 0:
                break
            continue
        _, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + n]
        size = 27 + n + sum(lacing)
        page = media[at : at + size]
        if len(page) < size or len(lacing) < n or ogg_crc(page[:22] + b"\0\0\0\0" + page[26:]) != crc or version:
            wrong.append(f"bad checksum at {at}")
            at = media.find(b"OggS", at + 4)
            if at < 0:
                break
            continue
        stream = streams.setdefault(serial, Stream())
        if number != expect.get(serial, 0):
            wrong.append(f"page {expect.get(serial, 0)} of stream {serial:x} is missing")
            parts[serial] = None
        expect[serial] = number + 1
        open_ = parts.get(serial)
        if not flags & 1:
            open_ = bytearray()
        place = at + 27 + n
        for value in lacing:
            if open_ is not None:
                open_ += media[place : place + value]
            place += value
            if value < 255:
                if open_ is not None:
                    stream.packets.append(bytes(open_))
                open_ = bytearray()
        parts[serial] = open_
        if granule >= 0:
            stream.granules.append((len(stream.packets), granule))
        stream.pages += 1
        stream.ended |= bool(flags & 4)
        at += size
    return streams, wrong


def read_payload(media: bytes) -> tuple[bytes, int, Stream, list[str]]:
    """Payload, unpadded size, the stream of samples and what is wrong."""
    streams, wrong = demux(media)
    stream, notes = streams.get(SAMPLES, Stream()), streams.get(NOTES, Stream())
    for kind, x in (("samples", stream), ("description", notes)):
        if not x.packets or not x.ended:
            wrong.append(f"the stream of {kind} is incomplete")
    size = struct.unpack_from("<Q", notes.packets[0], 8)[0] if notes.packets else 0
    return b"".join(stream.packets[1:]), size, stream, wrong


def describe(payload: bytes, stream: Stream, wrong: list[str]) -> str:
    """Features of the samples as read: time from the granule positions, level, crossings and spread."""
    x = np.frombuffer(payload, dtype=np.uint8)
    seconds = (stream.granules[-1][1] if stream.granules else 0) / RATE
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / max(1, len(x))
    above = x >= 128
    return (
        f"t={seconds:.6f};packets={len(stream.packets) - 1};pages={stream.pages};mean={x.mean() if len(x) else 0:.6f};"
        f"crossings={int(np.count_nonzero(above[1:] != above[:-1]))};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.6f};faults={len(wrong)}"
    )


def pad(raw: bytes) -> bytes:
    """The bytes with zeros appended up to a positive multiple of 64."""
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")


_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Store each text as Ogg media, read it back and describe it.

    Needs ``doc_id`` and ``text``; other columns are ignored. Null and empty
    texts are 64 zero samples; null ids stay null; repeated rows give
    repeated rows with equal values; an empty table gives an empty result; a text of
    any length takes as many pages as it needs. ``keep_media`` adds the stored bytes
    as ``media``. The digests are of the bytes read back, never of the input.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                media = mux(pad(raw), len(raw))
                payload, size, stream, wrong = read_payload(media)
                tail = zlib.crc32(payload[-UNIT:])
                feature = describe(payload, stream, wrong)
                rows.append((doc_id, size, len(payload), hashlib.sha256(payload).hexdigest(), tail, len(media), hashlib.sha256(media).hexdigest(), feature, *([media] if keep_media else [])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    i, s = pa.int64(), pa.string()
    types = [i, i, i, s, i, i, s, s] + [pa.binary()] * keep_media
    schema = _SCHEMA + ", media binary" * keep_media
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes("text").alias("text")).mapInArrow(store, schema)
