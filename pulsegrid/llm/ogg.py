"""Media columns: Ogg bitstreams.

Encoding lays a payload down as 8-bit samples in packets of one logical stream, with a second stream that says how
many of the samples are meant, and multiplexes both into pages. Decoding walks the pages, verifies each checksum,
joins packets over lacing values and page borders, separates the streams, and derives times from granule positions.
Damage is reported, never passed over: bad checksums, gaps in page numbers, packets cut off.

Defined results: null and empty texts give one block of zero bytes; equal texts give equal bytes; a media value that is
null or holds no page gives no streams; an empty table gives an empty result; other columns are not used.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table

#: Fixed values of the container format.
CAPTURE, HEAD = b"OggS", struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
NO_PACKET_ENDS = -1

BLOCK, RATE, PACKET, SEGMENTS = 64, 8000, 40_000, 128  # bytes to pad to; samples a second; bytes a packet; segments a page
SAMPLES, NOTES = 1, 2  # serial numbers
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC (polynomial 04c11db7, most significant bit first, from 0) by way of the mirrored one that zlib has."""
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def pages_of(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """One logical stream's pages. packets: bytes and the granule position at their end."""
    out, lacing, body, granule, carried = [], [], [], NO_PACKET_ENDS, False

    def close(last: bool) -> None:
        nonlocal lacing, body, granule
        flags = CONTINUED * carried | FIRST * (not out) | LAST * last
        data = HEAD.pack(CAPTURE, 0, flags, granule, serial, len(out), 0, len(lacing)) + bytes(lacing) + b"".join(body)
        out.append(data[:22] + checksum(data).to_bytes(4, "little") + data[26:])
        lacing, body, granule = [], [], NO_PACKET_ENDS

    for i, (packet, end) in enumerate(packets):
        at, ended = 0, False
        while not ended:
            if len(lacing) == SEGMENTS:
                close(False)
                carried = at > 0
            some = packet[at : at + 255]
            lacing.append(len(some))
            body.append(some)
            at, ended = at + len(some), len(some) < 255
        granule = end
        if i == 0 or i == len(packets) - 1:  # a header stands on a page of its own
            close(i == len(packets) - 1)
            carried = False
    return out


def pad(raw: bytes) -> bytes:
    return raw + bytes(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def encode(raw: bytes) -> bytes:
    """An Ogg file whose first stream holds raw, padded with zeros, as samples."""
    payload = pad(raw)
    samples = [(b"pcm8" + struct.pack("<II", RATE, BLOCK), 0)]
    samples += [(payload[a : a + PACKET], min(a + PACKET, len(payload))) for a in range(0, len(payload), PACKET)]
    notes = [(b"note" + struct.pack("<I", SAMPLES), 0), (struct.pack("<QI", len(raw), zlib.crc32(payload)), len(payload))]
    a, b = pages_of(samples, SAMPLES), pages_of(notes, NOTES)
    return b"".join([a[0], b[0], *a[1:-1], *b[1:], *a[-1:]])


@dataclass
class Stream:
    serial: int
    packets: list[tuple[bytes, float | None]] = field(default_factory=list)  # bytes, seconds at the end where a page says
    pages: int = 0
    gaps: int = 0
    cut: int = 0
    granule: int = 0
    ended: bool = False
    next_page: int | None = None
    open: list[bytes] | None = None


def decode(media: bytes | None, rate: int = RATE) -> tuple[dict[int, Stream], int, int]:
    """Streams by serial number, pages with a wrong checksum (left out), and bytes that belong to no page."""
    streams: dict[int, Stream] = {}
    bad = stray = at = 0
    media = media or b""
    while at < len(media):
        start = media.find(CAPTURE, at)
        if start < 0 or len(media) < start + HEAD.size:
            stray += len(media) - at
            break
        stray += start - at
        _, version, flags, granule, serial, number, crc, segments = HEAD.unpack_from(media, start)
        lacing = media[start + HEAD.size : start + HEAD.size + segments]
        body = start + HEAD.size + segments
        end = body + sum(lacing)
        page = media[start:end]
        if version or len(lacing) < segments or len(media) < end or checksum(page[:22] + bytes(4) + page[26:]) != crc:
            bad, stray, at = bad + 1, stray + 4, start + 4  # look for the next page inside
            continue
        s = streams.setdefault(serial, Stream(serial))
        if s.next_page is not None and number != s.next_page:
            s.gaps += 1
            if s.open is not None:
                s.open, s.cut = None, s.cut + 1
        skip = bool(flags & CONTINUED) and s.open is None  # the rest of a packet whose beginning is lost
        if not flags & CONTINUED and s.open is not None:
            s.open, s.cut = None, s.cut + 1
        ended_here = []
        for n in lacing:
            part = media[body : body + n]
            body += n
            if not skip:
                s.open = s.open if s.open is not None else []
                s.open.append(part)
            if n < 255:
                if skip:
                    s.cut += 1
                else:
                    ended_here.append(b"".join(s.open or []))
                s.open, skip = None, False
        for i, x in enumerate(ended_here):
            s.packets.append((x, granule / rate if i == len(ended_here) - 1 and granule >= 0 else None))
        s.pages, s.next_page, s.ended = s.pages + 1, number + 1, s.ended or bool(flags & LAST)
        s.granule = max(s.granule, granule)
        at = end
    for s in streams.values():
        s.cut += s.open is not None
    return streams, bad, stray


def features(streams: dict[int, Stream], bad: int, stray: int, payload: bytes) -> str:
    """What the stored bytes show, as key=value pairs in fixed order."""
    x = np.frombuffer(payload, dtype=np.uint8)
    own = streams.get(SAMPLES, Stream(SAMPLES))
    hist = np.bincount(x, minlength=256)
    total, squares = int((hist * np.arange(256)).sum()), int((hist * np.arange(256) ** 2).sum())
    times = [t for _, t in own.packets[1:] if t is not None]
    shown = {
        "streams": len(streams), "pages": sum(s.pages for s in streams.values()), "packets": sum(len(s.packets) for s in streams.values()), "bad": bad, "stray": stray, "gaps": sum(s.gaps for s in streams.values()),
        "cut": sum(s.cut for s in streams.values()), "ms": round(own.granule * 1000 / RATE), "timed": len(times), "sum": total, "squares": squares, "peak": int(x.max()) if len(x) else 0, "silent": int(hist[0]),
    }
    return ";".join(f"{k}={v}" for k, v in shown.items())


def _encoded(batches):
    for batch in batches:
        media = [encode((x.as_py() or "").encode("utf-8", "surrogatepass")) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(media, pa.binary())], ["doc_id", "media"])


def encode_texts(docs: DataFrame) -> DataFrame:
    """doc_id and media, an Ogg file with the text's bytes as samples."""
    return docs.select("doc_id", "text").mapInArrow(_encoded, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, media binary")


PACKETS = "serial long, packet long, seconds double, data binary"


def _packets(batches):
    for batch in batches:
        for i, x in enumerate(batch.column("media")):
            streams, _, _ = decode(x.as_py())
            rows = [(s.serial, k, t, data) for s in streams.values() for k, (data, t) in enumerate(s.packets)]
            own = batch.column("doc_id").slice(i, 1).take(pa.array([0] * len(rows), pa.int64()))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([own, *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.binary()), strict=True))], ["doc_id", "serial", "packet", "seconds", "data"])


def packets(media: DataFrame) -> DataFrame:
    """The packets of media (doc_id, media), demultiplexed: one row to a packet, with its time where a page gives one."""
    return media.select("doc_id", "media").mapInArrow(_packets, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, {PACKETS}")


READ = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def _read(batches):
    for batch in batches:
        rows = []
        for x in batch.column("media"):
            media = x.as_py() or b""
            streams, bad, stray = decode(media)
            payload = b"".join(p for p, _ in streams[SAMPLES].packets[1:]) if SAMPLES in streams else b""
            noted = streams[NOTES].packets[1:] if NOTES in streams else []
            n_bytes, crc = struct.unpack("<QI", noted[0][0]) if noted else (None, None)
            if crc is not None and crc != zlib.crc32(payload):
                bad += 1
            rows.append((n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), features(streams, bad, stray, payload)))
        columns = zip(*rows, strict=True) if rows else [[]] * len(READ)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, (_, k) in zip(columns, READ, strict=True))], ["doc_id", *(n for n, _ in READ)])


def read_payloads(media: DataFrame) -> DataFrame:
    """What media (doc_id, media) holds, read from its bytes alone: lengths, digests and features."""
    kinds = "".join(f", {n} {'string' if k == pa.string() else 'long'}" for n, k in READ)
    return media.select("doc_id", "media").mapInArrow(_read, f"doc_id {media.schema['doc_id'].dataType.simpleString()}{kinds}")


def op3_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = stash(encode_texts(table(spark, sf_dir, "documents")), "ogg")
    return read_payloads(stored).select("doc_id", *(F.col(n) for n, _ in READ))
