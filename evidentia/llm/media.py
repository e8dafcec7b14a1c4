"""Media columns: signature sniffing, validation and carving (operator 9).

Aho-Corasick finds the magic bytes of all known formats in one pass over a
blob. Each hit is only a suspicion: a validator of its format walks the
structure (chunk lengths, checksums, header sizes) and gives the exact length,
or rejects it. What starts at byte 0 decides the blob's true type, whatever
type was declared; valid media further in are carved.

Defined results: a null or empty blob has no type and no media; a blob with no
valid media is ``application/octet-stream``; repeated rows give repeated
results; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Magic bytes of the formats.
MAGIC = {
    "image/png": b"\x89PNG\r\n\x1a\n",
    "audio/wav": b"RIFF",
    "image/bmp": b"BM",
    "image/gif": b"GIF8",
    "image/jpeg": b"\xff\xd8\xff",
}
UNKNOWN = "application/octet-stream"
UNIT = 576
ENVELOPE = b"\x00envelope\x00"
PIECE = 512


def _png(b: bytes, at: int) -> int:
    end = at + 8
    first = True
    while end + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, end)
        stop = end + 12 + size
        if stop > len(b) or (first and (kind != b"IHDR" or size != 13)):
            return 0
        if zlib.crc32(memoryview(b)[end + 4 : stop - 4]) != struct.unpack_from(">I", b, stop - 4)[0]:
            return 0
        if kind == b"IEND":
            return stop - at
        end, first = stop, False
    return 0


def _wav(b: bytes, at: int) -> int:
    if len(b) < at + 44 or b[at + 8 : at + 16] != b"WAVEfmt ":
        return 0
    size = struct.unpack_from("<I", b, at + 4)[0] + 8
    if size < 44 or at + size > len(b):
        return 0
    end, data = at + 12, False
    while end + 8 <= at + size:
        kind, n = struct.unpack_from("<4sI", b, end)
        data |= kind == b"data"
        end += 8 + n + n % 2
    return size if data and end == at + size else 0


def _bmp(b: bytes, at: int) -> int:
    if len(b) < at + 54:
        return 0
    size, _, start, head, width, height, planes, bits, packed, bytes_ = struct.unpack_from("<IIIIiiHHII", b, at + 2)
    if head not in (40, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or packed or width <= 0 or not height:
        return 0
    body = (width * bits + 31) // 32 * 4 * abs(height)
    ok = size == start + body and bytes_ in (0, body) and start >= 14 + head and at + size <= len(b)
    return size if ok else 0


def _gif(b: bytes, at: int) -> int:
    if b[at + 4 : at + 6] not in (b"7a", b"9a") or len(b) < at + 14:
        return 0
    flags = b[at + 10]
    end = at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)
    while end < len(b):
        kind = b[end]
        if kind == 0x3B:
            return end + 1 - at
        if kind == 0x2C and end + 10 < len(b):
            local = b[end + 9]
            end += 11 + (3 << ((local & 7) + 1) if local & 128 else 0)
        elif kind == 0x21:
            end += 2
        else:
            return 0
        while end < len(b) and b[end]:
            end += 1 + b[end]
        end += 1
    return 0


def _jpeg(b: bytes, at: int) -> int:
    end = at + 2
    while end + 4 <= len(b):
        if b[end] != 0xFF:
            return 0
        kind = b[end + 1]
        size = struct.unpack_from(">H", b, end + 2)[0]
        if size < 2 or not 0xC0 <= kind <= 0xFE:
            return 0
        end += 2 + size
        if kind == 0xDA:
            stop = b.find(b"\xff\xd9", end)
            return stop + 2 - at if stop >= 0 else 0
    return 0


VALID = {"image/png": _png, "audio/wav": _wav, "image/bmp": _bmp, "image/gif": _gif, "image/jpeg": _jpeg}


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for mime, magic in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (len(magic), mime))
    a.make_automaton()
    return a


def sniff(blob: bytes | None) -> list[tuple[int, int, str]]:
    """(offset, length, type) of all valid media in the blob that lie in no earlier one, by offset."""
    found: list[tuple[int, int, str]] = []
    end = 0
    for last, (size, mime) in _automaton().iter((blob or b"").decode("latin-1")):
        at = last + 1 - size
        if at >= end and (length := VALID[mime](blob, at)):
            found.append((at, length, mime))
            end = at + length
    return found


def encode(payload: bytes, mime: str) -> bytes:
    """The payload, whose length is a multiple of UNIT, as 8-bit samples."""
    rows = len(payload) // UNIT
    if mime == "audio/wav":
        head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(payload))
        return head + payload
    if mime == "image/bmp":
        table = b"".join(bytes((i, i, i, 0)) for i in range(256))
        start = 54 + len(table)
        head = b"BM" + struct.pack("<IIIIiiHHIIiiII", start + len(payload), 0, start, 40, UNIT, -rows, 1, 8, 0, len(payload), 2835, 2835, 256, 0)
        return head + table + payload
    if mime == "image/png":
        lines = np.zeros((rows, UNIT + 1), np.uint8)
        lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, UNIT)
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        return MAGIC[mime] + chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")
    raise ValueError(f"no writer for {mime}")


def decode(blob: bytes, mime: str) -> bytes:
    """The samples of media that encode() wrote."""
    if mime == "audio/wav":
        end = 12
        while True:
            kind, n = struct.unpack_from("<4sI", blob, end)
            if kind == b"data":
                return blob[end + 8 : end + 8 + n]
            end += 8 + n + n % 2
    if mime == "image/bmp":
        start, _, width, height = struct.unpack_from("<IIii", blob, 10)
        return blob[start : start + width * abs(height)]
    if mime == "image/png":
        width, rows = struct.unpack_from(">II", blob, 16)
        packed, end = [], 8
        while end < len(blob):
            n, kind = struct.unpack_from(">I4s", blob, end)
            if kind == b"IDAT":
                packed.append(blob[end + 8 : end + 8 + n])
            end += 12 + n
        return np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(rows, width + 1)[:, 1:].tobytes()
    raise ValueError(f"no reader for {mime}")


def padded(data: bytes) -> bytes:
    """data with bytes 255 up to a positive multiple of UNIT."""
    return data + b"\xff" * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            yield batch.slice(at, PIECE)


def store_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's payload stored as media: (key, n_bytes, media, declared_type).

    The format follows from the payload's checksum, so equal texts are stored
    alike. Of declared types, as from a careless producer, two thirds are wrong
    for sniff_media() to correct, and a quarter of the media lie in an envelope
    of other bytes, from which they must be carved.
    """
    kinds = ("image/png", "audio/wav", "image/bmp")

    def stored(p: bytes) -> tuple[bytes, str]:
        mark = zlib.crc32(p)
        blob = encode(p, kinds[mark % 3])
        if mark >> 8 & 3 == 0:
            blob = ENVELOPE + struct.pack("<I", len(blob)) + blob + ENVELOPE[::-1]
        return blob, kinds[(mark >> 16) % 3]

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            media, said = zip(*[stored(padded(x)) for x in texts], strict=True) if texts else ((), ())
            yield pa.record_batch([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary()), pa.array(said, pa.string())], ["k", "n_bytes", "media", "declared_type"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(store, f"k {kind}, n_bytes long, media binary, declared_type string")
    return out.withColumnRenamed("k", key)


def feature(samples: bytes, mime: str) -> str:
    """Type, rows of UNIT samples, mean, deviation and entropy of the samples."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    p = counts / max(1, counts.sum())
    v = np.arange(256)
    mean = float((p * v).sum())
    some = p[p > 0]
    return f"{mime};rows={len(samples) // UNIT};mean={mean:.4f};std={max(0.0, float((p * v * v).sum()) - mean * mean) ** 0.5:.4f};bits={-float((some * np.log2(some)).sum()):.4f}"


def sniff_media(df: DataFrame, key: str = "doc_id", media: str = "media", declared: str = "declared_type", extra: tuple[str, ...] = ("n_bytes",)) -> DataFrame:
    """Corrects the declared types and carves: (key, extra..., true_type, corrected, embedded, payload digests, feature).

    true_type is that of the medium at byte 0, else unknown. embedded: spans
    (offset, length, type) of the valid media further in. The payload is what
    is read back from the medium at byte 0, or else from the first that is
    carved, or else the blob itself; media_bytes and media_sha256 are the
    whole blob's.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 1 + len(extra)
        for b in _pieces(batches):
            out: list[list] = [[] for _ in range(9)]
            for blob, said in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True):
                blob = blob or b""
                found = sniff(blob)
                mime = found[0][2] if found and found[0][0] == 0 else UNKNOWN
                at, size, kind = found[0] if found else (0, len(blob), UNKNOWN)
                own = blob[at : at + size]
                samples = decode(own, kind) if kind in ("image/png", "audio/wav", "image/bmp") else own
                spans = [{"offset": o, "length": s, "type": m} for o, s, m in found if o or mime == UNKNOWN]
                for col, v in zip(out, (mime, mime != said, spans, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), feature(samples, kind)), strict=True):
                    col.append(v)
            span = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))
            types = (pa.string(), pa.bool_(), span, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([b.column(i) for i in range(n)] + [pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[f"k{i}" for i in range(n)] + NAMES)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    keys = [key, *extra]
    schema = ", ".join(f"k{i} {kinds[c]}" for i, c in enumerate(keys)) + ", true_type string, corrected boolean, embedded array<struct<offset:bigint,length:bigint,type:string>>, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    out = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], F.col(media), F.col(declared)).mapInArrow(read, schema)
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keys)})


NAMES = ["true_type", "corrected", "embedded", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
