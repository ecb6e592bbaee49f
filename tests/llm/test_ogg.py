import hashlib
import random
import zlib

import pytest

from pulsegrid.llm import ogg

from .helpers import clashing, folder


def slow_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    rng = random.Random(0)
    for n in (0, 1, 27, 300):
        data = rng.randbytes(n)
        assert ogg.checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 254, 255, 256, 40_000, 40_001, 100_000, 255 * 128, 255 * 128 * 3 + 1])
def test_round_trip(n):
    raw = random.Random(n).randbytes(n)
    streams, bad, stray = ogg.decode(ogg.encode(raw))
    payload = b"".join(p for p, _ in streams[ogg.SAMPLES].packets[1:])
    assert payload == ogg.pad(raw) and len(payload) % 64 == 0 and payload and not bad and not stray
    assert all(s.ended and not s.gaps and not s.cut for s in streams.values())
    assert streams[ogg.SAMPLES].packets[-1][1] == len(payload) / ogg.RATE


def test_damage_is_found():
    media = bytearray(ogg.encode(random.Random(1).randbytes(200_000)))
    at = media.find(b"OggS", 70_000)
    media[at + 500] ^= 1
    streams, bad, stray = ogg.decode(bytes(media))
    s = streams[ogg.SAMPLES]
    assert bad == 1 and stray and s.gaps == 1 and s.cut
    assert ogg.decode(b"no pages here") == ({}, 0, 13) and ogg.decode(None) == ({}, 0, 0)
    streams, bad, _ = ogg.decode(ogg.encode(b"abc")[:-10])
    assert bad == 1 and not streams[ogg.SAMPLES].ended


@pytest.mark.parametrize("query", ["sf", "odd", "clash", "none"])
def test_op3_against_the_text(spark, sf, tmp_path, query):
    path = {"sf": lambda: sf, "odd": lambda: folder(spark, tmp_path), "clash": lambda: folder(spark, tmp_path, *clashing(["media", "n_bytes"])), "none": lambda: folder(spark, tmp_path, [])}[query]()
    want, by = [], {}
    for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect():
        raw = (r.text or "").encode()
        p = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        media = ogg.encode(raw)
        want.append((r.doc_id, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media), hashlib.sha256(media).hexdigest()))
    rows = ogg.op3_ogg(spark, path).collect()
    assert sorted((tuple(r)[:-1] for r in rows), key=repr) == sorted(want, key=repr)
    for r in rows:
        assert by.setdefault(r.payload_sha256 + str(r.n_bytes), r.feature) == r.feature and "bad=0;stray=0;gaps=0;cut=0" in r.feature


def test_packets_are_rows(spark):
    docs = spark.createDataFrame([(1, "x" * 90_000), (2, None)], "doc_id long, text string")
    rows = ogg.packets(ogg.encode_texts(docs)).collect()
    assert [(r.packet, len(r.data)) for r in rows if r.doc_id == 1 and r.serial == ogg.SAMPLES] == [(0, 12), (1, 40_000), (2, 40_000), (3, 10_048)]
    assert {r.serial for r in rows if r.doc_id == 2} == {1, 2}
