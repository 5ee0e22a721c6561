"""Ogg as a media column: multiplexing, and a reader that verifies, reassembles, demultiplexes and times packets.

A payload of 8-bit samples is cut into packets of 576 samples, dealt in turn to two logical streams. Each stream
begins with a header packet on a page of its own; granule positions count the samples up to the end of a packet in
the whole payload. Reading checks the page checksums, sequence numbers and the flags of a stream's first and last
page, so that a cut stream is no shorter payload; it joins lacing values into packets (across pages too), splits
streams by serial number and orders packets by their time.

Files are stored in a written table and described from what is read back. An empty table gives an empty one. Null
texts are empty. The stored form depends on the text alone, so equal texts and repeated rows give equal values. Any
length works. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmask.llm.common import keyed, real_id, shared_dir, text_chunks, written

PACKET = 576
RATE = 8000
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """A stream that doesn't hold together."""


def page_crc(page: bytes) -> int:
    """CRC-32, polynomial 0x04C11DB7, most significant bit first, zero start and no final inversion: zlib's with bits reversed."""
    value = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{value:032b}"[::-1], 2)


def lacing(n: int) -> bytes:
    return b"\xff" * (n // 255) + bytes([n % 255])


def page(flags: int, granule: int, serial: int, sequence: int, lace: bytes, body: bytes) -> bytes:
    blank = _HEAD.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lace)) + lace + body
    return blank[:22] + struct.pack("<I", page_crc(blank)) + blank[26:]


class _Writer:
    """One logical stream; pages are filled to 255 segments, so packets may continue on the next page."""

    def __init__(self, serial: int):
        self.serial, self.sequence = serial, 0
        self.lace, self.body, self.granule, self.continued = bytearray(), bytearray(), -1, 0

    def flush(self, out: bytearray, flags: int, continues: bool = False) -> None:
        out += page(flags | self.continued | 2 * (not self.sequence), self.granule, self.serial, self.sequence, bytes(self.lace), bytes(self.body))
        self.sequence += 1
        self.continued = int(continues)
        self.lace, self.body, self.granule = bytearray(), bytearray(), -1

    def packet(self, out: bytearray, data: bytes, granule: int) -> None:
        at = 0
        for i, value in enumerate(lacing(len(data))):
            if len(self.lace) == 255:
                self.flush(out, 0, continues=i > 0)
            self.lace.append(value)
            self.body += data[at : at + value]
            at += value
        self.granule = granule


def mux(payload: bytes) -> bytes:
    """The payload as an Ogg file of two logical streams."""
    serial = zlib.crc32(payload) & 0xFFFFFFFE
    writers = [_Writer(serial), _Writer(serial | 1)]
    out = bytearray()
    for w in writers:
        w.packet(out, b"\x01pcm8" + struct.pack("<II", RATE, PACKET), 0)
        w.flush(out, 0)
    view = memoryview(payload)
    for i, at in enumerate(range(0, len(payload), PACKET)):
        piece = view[at : at + PACKET]
        writers[i % 2].packet(out, bytes(piece), at + len(piece))
    for w in writers:
        w.flush(out, 4)
    return bytes(out)


def pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(flags, granule, serial, sequence, lacing values, body) of each page, its checksum verified."""
    at = 0
    while at < len(data):
        if len(data) - at < 27 or data[at : at + 4] != b"OggS":
            raise OggError(f"no page at byte {at}")
        _, version, flags, granule, serial, sequence, crc, n = _HEAD.unpack_from(data, at)
        lace = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lace)
        if version or len(lace) < n or end > len(data):
            raise OggError(f"broken page at byte {at}")
        if page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"wrong checksum at byte {at}")
        yield flags, granule, serial, sequence, lace, data[at + 27 + n : end]
        at = end


def demux(data: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """Packets of each logical stream with the granule position at their end (-1: not stated on that page)."""
    streams: dict[int, list[tuple[bytes, int]]] = {}
    open_packets: dict[int, bytearray] = {}
    expected: dict[int, int] = {}
    ended: set[int] = set()
    for flags, granule, serial, sequence, lace, body in pages(data):
        if bool(flags & 2) != (serial not in expected) or serial in ended:
            raise OggError(f"stream {serial}: page {sequence} before its first or after its last page")
        if flags & 4:
            ended.add(serial)
        if expected.get(serial, 0) != sequence:
            raise OggError(f"stream {serial}: page {sequence} where {expected.get(serial, 0)} is due")
        expected[serial] = sequence + 1
        packets, part = streams.setdefault(serial, []), open_packets.pop(serial, bytearray())
        if bool(flags & 1) != bool(part):
            raise OggError(f"stream {serial}: continuation flag and packets disagree")
        at, first = 0, len(packets)
        for value in lace:
            part += body[at : at + value]
            at += value
            if value < 255:
                packets.append((bytes(part), -1))
                part = bytearray()
        if part:
            open_packets[serial] = part
        if len(packets) > first:
            packets[-1] = (packets[-1][0], granule)
    if open_packets or ended != expected.keys():
        raise OggError("a packet or a stream doesn't end")
    return streams


def timed(packets: list[tuple[bytes, int]], step: int) -> list[tuple[int, bytes]]:
    """(end time in samples, packet), times of unstated packets counted back from the next stated one."""
    out, due = [], None
    for data, granule in reversed(packets):
        if granule < 0 and due is None:
            raise OggError("the last packet has no time")
        due = granule if granule >= 0 else due - step
        out.append((due, data))
    return out[::-1]


def read_payload(data: bytes) -> tuple[bytes, dict[str, int]]:
    """The samples in time order, and what the container said."""
    streams = demux(data)
    pieces = [p for packets in streams.values() for p in timed(packets[1:], PACKET * len(streams))]
    pieces.sort(key=lambda p: p[0])
    payload = b"".join(p[1] for p in pieces)
    if pieces and pieces[-1][0] != len(payload):
        raise OggError("granule positions don't cover the samples")
    return payload, {"streams": len(streams), "packets": len(pieces), "samples": pieces[-1][0] if pieces else 0}


def padded(text: bytes) -> bytes:
    return text + b"\xff" * ((-len(text)) % PACKET if text else PACKET)


def features(samples: bytes, said: dict[str, int]) -> str:
    """Duration in ms, streams, packets, mean, spread and sign changes around mid-scale of 8-bit samples."""
    x = np.frombuffer(samples, dtype=np.uint8)
    total, squares = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    mean = total / len(x)
    high = x >= 128
    crossings = int((high[1:] != high[:-1]).sum())
    return f"ms={1000 * said['samples'] // RATE};streams={said['streams']};packets={said['packets']};mean={mean:.4f};sd={max(0.0, squares / len(x) - mean * mean) ** 0.5:.4f};crossings={crossings}"


_FIELDS = [("doc", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
_SCHEMA = "doc long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored(docs: DataFrame) -> DataFrame:
    """doc, n_bytes, media: each text as an Ogg file in a written table."""

    def rows(batches):
        for keys, texts in text_chunks(batches):
            yield pa.record_batch([pa.array([k[0] for k in keys], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], names=["doc", "n_bytes", "media"])

    return written(keyed(docs).mapInArrow(rows, "doc long, n_bytes long, media binary"), shared_dir(docs.sparkSession), "media", compression="zstd")


def described(media: DataFrame, with_media: bool = False) -> DataFrame:
    """What reading the stored files gives. ``with_media`` adds the file as ``media``."""
    fields = _FIELDS + [("media", pa.binary())] * with_media

    def rows(batches):
        for batch in batches:
            out = []
            for doc, n, file in zip(*(batch.column(i) for i in range(3)), strict=True):
                file = file.as_py()
                payload, said = read_payload(file)
                out.append([doc.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), features(payload, said), *([file] if with_media else [])])
            if out:
                yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    out = media.mapInArrow(rows, _SCHEMA + ", media binary" * with_media)
    return out.select(real_id().alias("doc_id"), *[n for n, _ in fields[1:]])


def media_column(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Store each text as Ogg, read it back, describe it. Two narrow steps: no shuffle."""
    return described(stored(docs), with_media)
