from __future__ import annotations

import hashlib
import math
import struct
import zlib

import pytest
from evidentia.llm import media

KINDS = ("image/png", "audio/wav", "image/bmp")


@pytest.mark.parametrize("mime", KINDS)
def test_round_trip_and_sniffing(mime):
    for data in (b"", b"x", bytes(range(256)) * 9, b"BM" * 400):
        payload = media.padded(data)
        blob = media.encode(payload, mime)
        assert media.decode(blob, mime) == payload
        assert media.sniff(blob)[0] == (0, len(blob), mime)


def test_carves_and_rejects():
    png, wav = (media.encode(media.padded(b"abc" * 500), k) for k in ("image/png", "audio/wav"))
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + bytes(9) + b"\xff\xda" + struct.pack(">H", 2) + b"data\xff\xd9"
    blob = b"junk BM GIF8 RIFF" + png + b"--" + gif + jpeg + b"\x89PNG\r\n\x1a\n" + wav
    found = media.sniff(blob)
    assert [m for _, _, m in found] == ["image/png", "image/gif", "image/jpeg", "audio/wav"]
    assert [blob[o : o + n] for o, n, _ in found] == [png, gif, jpeg, wav]
    broken = bytearray(png)
    broken[60] ^= 1
    assert not media.sniff(bytes(broken)) and not media.sniff(png[:-1]) and not media.sniff(b"") and not media.sniff(None)


def test_odd_rows(spark, odd, none):
    got = media.sniff_media(media.store_media(odd)).collect()
    want = {}
    for r in odd.collect():
        want.setdefault(r.doc_id, []).append(media.padded((r.text or "").encode()))
    assert len(got) == odd.count()
    for r in got:
        payload = want[r.doc_id][0]
        assert r.payload_bytes == len(payload) and r.payload_bytes % media.UNIT == 0
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        # what sniffing tells, brute force tells too
        kind, wrapped = KINDS[zlib.crc32(payload) % 3], zlib.crc32(payload) >> 8 & 3 == 0
        assert r.true_type == (media.UNKNOWN if wrapped else kind) and [e.type for e in r.embedded] == [kind] * wrapped
        assert r.corrected == (r.true_type != KINDS[(zlib.crc32(payload) >> 16) % 3])
        p = [payload.count(bytes([v])) / len(payload) for v in range(256)]
        mean = sum(v * q for v, q in enumerate(p))
        std, bits = sum(q * (v - mean) ** 2 for v, q in enumerate(p)) ** 0.5, -sum(q * math.log2(q) for q in p if q)
        said = dict(x.split("=") for x in r.feature.split(";")[1:])
        assert r.feature.split(";")[0] == kind and int(said["rows"]) == len(payload) // media.UNIT
        assert [float(said[n]) for n in ("mean", "std", "bits")] == pytest.approx([mean, std, bits], abs=1e-4)
    assert {r.corrected for r in got} == {True, False} and {len(r.embedded) for r in got} == {0, 1}
    assert media.sniff_media(media.store_media(none)).count() == 0
    raw = spark.createDataFrame([(1, None, "image/png"), (2, bytearray(b"xx" + media.encode(media.padded(b"q"), "audio/wav")), None)], "doc_id long, media binary, declared_type string")
    a, b = sorted(media.sniff_media(raw, extra=()).collect())
    assert (a.true_type, a.embedded, a.media_bytes) == (media.UNKNOWN, [], 0)
    assert (b.true_type, b.embedded[0].offset, b.embedded[0].type) == (media.UNKNOWN, 2, "audio/wav")
