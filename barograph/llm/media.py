"""Media columns: signature sniffing over binary columns.

One Aho-Corasick pass finds every magic number in a blob; a validator of that format then walks the
structure from there and either gives the media's length or refuses the hit. Confirmed spans are carved, the
first one's type replaces a wrong declared type. Formats: PNG, BMP, WAV, AU, GIF, JPEG, gzip and PDF.

The query stores each text as 8-bit samples in a media file (PNG, BMP, WAV or AU by its checksum), half of
them inside a foreign wrapper and most under a wrong or vague declared type, as a binary column in Parquet;
it reads the column back, sniffs, carves and decodes it.

Defined cases: null and empty texts are one unit of padding; a text of any length is one media; repeated rows and
equal texts give equal media; rows without doc_id keep their null; other columns are ignored; no rows give none.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.llm.common import in_pandas, materialise, table

UNIT, WIDTH, PAD = 576, 24, 255
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    size = max(UNIT, -(-len(raw) // UNIT) * UNIT)
    return len(raw), raw + bytes([PAD]) * (size - len(raw))


# Writers and readers of 8-bit samples


def _png_chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(samples: bytes) -> bytes:
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    raw = np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes()
    return PNG_MAGIC + _png_chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _png_chunk(b"IDAT", zlib.compress(raw, 1)) + _png_chunk(b"IEND", b"")


def read_png(media: bytes) -> bytes:
    width, height, depth, color = struct.unpack(">IIBB", media[16:26])
    at, data = 8, b""
    while at < len(media):
        n = struct.unpack(">I", media[at : at + 4])[0]
        if media[at + 4 : at + 8] == b"IDAT":
            data += media[at + 8 : at + 8 + n]
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    if (depth, color) != (8, 0) or rows[:, 0].any():
        raise ValueError("only unfiltered 8-bit grey images hold samples here")
    return rows[:, 1:].tobytes()


def write_bmp(samples: bytes) -> bytes:
    height = len(samples) // WIDTH
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
    start = 54 + len(palette)
    return b"BM" + struct.pack("<IHHI", start + len(samples), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, WIDTH, -height, 1, 8, 0, len(samples), 0, 0, 256, 0) + palette + samples


def read_bmp(media: bytes) -> bytes:
    return media[struct.unpack("<I", media[10:14])[0] :]


def write_wav(samples: bytes) -> bytes:
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


def read_wav(media: bytes) -> bytes:
    at = 12
    while media[at : at + 4] != b"data":
        at += 8 + (struct.unpack("<I", media[at + 4 : at + 8])[0] + 1) // 2 * 2
    return media[at + 8 : at + 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]]


def write_au(samples: bytes) -> bytes:
    return b".snd" + struct.pack(">IIIII", 24, len(samples), 2, 8000, 1) + samples


def read_au(media: bytes) -> bytes:
    return media[struct.unpack(">I", media[4:8])[0] :]


# Validators: blob and start -> length of the confirmed media, or None


def check_png(b: bytes, s: int) -> int | None:
    at, first = s + 8, True
    while at + 12 <= len(b):
        n, kind = struct.unpack(">I4s", b[at : at + 8])
        end = at + 12 + n
        if end > len(b) or first != (kind == b"IHDR") or zlib.crc32(b[at + 4 : end - 4]) != struct.unpack(">I", b[end - 4 : end])[0]:
            return None
        if kind == b"IEND":
            return end - s
        at, first = end, False
    return None


def check_bmp(b: bytes, s: int) -> int | None:
    if len(b) < s + 54:
        return None
    size, r1, r2, start, dib, width, height, planes, depth = struct.unpack("<IHHIIiiHH", b[s + 2 : s + 30])
    row = (width * depth + 31) // 32 * 4
    ok = not r1 and not r2 and dib in (40, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and width > 0 and start >= 14 + dib
    return size if ok and s + size <= len(b) and start + row * abs(height) <= size else None


def check_wav(b: bytes, s: int) -> int | None:
    if b[s + 8 : s + 12] != b"WAVE" or len(b) < s + 12:
        return None
    size = struct.unpack("<I", b[s + 4 : s + 8])[0] + 8
    at, seen = s + 12, []
    if s + size > len(b):
        return None
    while at + 8 <= s + size:
        n = struct.unpack("<I", b[at + 4 : at + 8])[0]
        seen.append(b[at : at + 4])
        at += 8 + n + n % 2
        if at > s + size + 1:
            return None
    return size if b"fmt " in seen and b"data" in seen else None


def check_au(b: bytes, s: int) -> int | None:
    if len(b) < s + 24:
        return None
    start, size, code, rate, channels = struct.unpack(">IIIII", b[s + 4 : s + 24])
    return start + size if 24 <= start <= 4096 and 1 <= code <= 27 and 0 < rate <= 768_000 and 1 <= channels <= 64 and s + start + size <= len(b) else None


def check_gif(b: bytes, s: int) -> int | None:
    if len(b) < s + 14:
        return None
    flags = b[s + 10]
    at = s + 13 + (3 * 2 ** ((flags & 7) + 1) if flags & 128 else 0)
    while at < len(b):
        kind = b[at]
        if kind == 0x3B:
            return at + 1 - s
        if kind == 0x21:
            at += 2
        elif kind == 0x2C and at + 10 < len(b):
            local = b[at + 9]
            at += 11 + (3 * 2 ** ((local & 7) + 1) if local & 128 else 0)
        else:
            return None
        while at < len(b) and b[at]:
            at += b[at] + 1
        at += 1
    return None


def check_jpeg(b: bytes, s: int) -> int | None:
    at, scan = s + 2, False
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            return None
        kind = b[at + 1]
        n = struct.unpack(">H", b[at + 2 : at + 4])[0]
        if kind in (0x00, 0xFF) or n < 2:
            return None
        at += 2 + n
        if kind == 0xDA:
            scan = True
            while 0 <= (at := b.find(b"\xff", at)) < len(b) - 1 and (b[at + 1] == 0 or 0xD0 <= b[at + 1] <= 0xD7):
                at += 2
            if at < 0:
                return None
        if b[at : at + 2] == b"\xff\xd9":
            return at + 2 - s if scan else None
    return None


def check_gzip(b: bytes, s: int) -> int | None:
    z, total = zlib.decompressobj(31), 0
    data = b[s:]
    try:
        while not z.eof and data:
            z.decompress(data, 1 << 16)  # bounded output, checked and dropped
            data = z.unconsumed_tail
            total += 1
    except zlib.error:
        return None
    return len(b) - s - len(z.unused_data) if z.eof else None


def check_pdf(b: bytes, s: int) -> int | None:
    following = b.find(b"%PDF-", s + 5)
    end = b.rfind(b"%%EOF", s, following if following > 0 else len(b))
    return end + 5 - s if end > 0 and b.find(b"startxref", s, end) > 0 else None


#: Magic bytes, media type and validator.
FORMATS: list[tuple[bytes, str, Callable[[bytes, int], int | None]]] = [
    (PNG_MAGIC, "image/png", check_png), (b"BM", "image/bmp", check_bmp), (b"RIFF", "audio/wav", check_wav), (b".snd", "audio/basic", check_au),
    (b"GIF87a", "image/gif", check_gif), (b"GIF89a", "image/gif", check_gif), (b"\xff\xd8\xff", "image/jpeg", check_jpeg), (b"\x1f\x8b\x08", "application/gzip", check_gzip), (b"%PDF-", "application/pdf", check_pdf),
]
READERS = {"image/png": read_png, "image/bmp": read_bmp, "audio/wav": read_wav, "audio/basic": read_au}
WRITERS = [write_png, write_bmp, write_wav, write_au]
DECLARED = ["application/octet-stream", "image/jpeg", "image/png", "audio/wav", "text/plain"]


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, kind, check in FORMATS:
        a.add_word(magic.decode("latin-1"), (len(magic), kind, check))
    a.make_automaton()
    return a


def sniff(blob: bytes | None, magics: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(offset, length, type) of every confirmed media, in order, none inside another."""
    found, free = [], 0
    for end, (n, kind, check) in magics.iter((blob or b"").decode("latin-1")):
        start = end - n + 1
        if start >= free and (size := check(blob, start)):
            found.append((start, size, kind))
            free = start + size
    return found


def sniff_column(df: DataFrame, blob: str, declared: str) -> DataFrame:
    """Adds `media`: array of (offset, length, type, bytes), and `true_type`: the first media's type where it differs from `declared` or that is null, else `declared`.

    Null and empty blobs, and blobs with no confirmed media, give an empty array and keep their declared type.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        magics = automaton()
        for b in batches:
            spans = [sniff(x, magics) for x in b[blob]]
            b["media"] = [[{"offset": s, "length": n, "type": k, "bytes": x[s : s + n]} for s, n, k in y] for x, y in zip(b[blob], spans, strict=True)]
            b["true_type"] = [y[0][2] if y else d for y, d in zip(spans, b[declared], strict=True)]
            yield b

    from pyspark.sql import types as T

    return df.mapInPandas(run, T.StructType(df.schema.fields + T._parse_datatype_string("media array<struct<offset:long,length:long,type:string,bytes:binary>>, true_type string").fields))


def text_blobs(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, declared, blob: each text's samples in one of four formats, wrapped or bare."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                n, payload = payload_of(text)
                c = zlib.crc32(payload)
                media = WRITERS[c % 4](payload)
                wrapper = (b"WRAP" + struct.pack("<I", len(media)), b"PARW") if c >> 2 & 1 else (b"", b"")
                rows.append((doc_id, n, DECLARED[(c >> 3) % len(DECLARED)], wrapper[0] + media + wrapper[1]))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "declared", "blob"])

    return in_pandas(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, n_bytes long, declared string, blob binary", ["doc_id"])


def features(blobs: DataFrame) -> DataFrame:
    """Sniff, carve and decode stored samples; the digests of the query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        magics = automaton()
        for b in batches:
            rows = []
            for doc_id, n, declared, blob in zip(b["doc_id"], b["n_bytes"], b["declared"], b["blob"], strict=True):
                offset, size, kind = sniff(blob, magics)[0]
                media = blob[offset : offset + size]
                payload = READERS[kind](media)
                p = np.bincount(np.frombuffer(payload, np.uint8), minlength=256) / len(payload)
                entropy = -float((p[p > 0] * np.log2(p[p > 0])).sum())
                feature = f"type={kind};declared={declared};corrected={int(kind != declared)};offset={offset};carved={len(blob) - size};mean={float((p * np.arange(256)).sum()):.4f};entropy={entropy:.4f}"
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), size, hashlib.sha256(media).hexdigest(), feature))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return in_pandas(blobs, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", ["doc_id"])


def op2_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(materialise(text_blobs(table(spark, sf_dir, "documents")), "blobs"))


QUERIES = {"op2_signature_sniffing": op2_signature_sniffing}
ORACLES: dict[str, str] = {}
