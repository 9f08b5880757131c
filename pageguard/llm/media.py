"""Operator 5: media columns checked by signature sniffing.

`store` packs payloads into 8-bit media of several formats. `sniff` finds magic bytes in any binary column with one
Aho-Corasick automaton, confirms each hit with the format's validator (structure and lengths), corrects the declared type
and carves every confirmed medium, embedded ones included. `payload_of` reads the samples back.

Formats: WAV (8-bit unsigned mono), AU (8-bit linear), PGM, BMP (8-bit grey) and PNG (8-bit grey, no filter).
Defined results: a null or empty binary has no media and the type `unknown`; hits that overlap a confirmed medium are
part of it; bytes that no validator confirms are never carved. payload_digests has a null payload, crc and feature and the
type `unknown` where no medium is found (null, empty or damaged data), and a null media hash for null data.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Samples in a row of an image; payload lengths are multiples of it.
WIDTH = 192


def padded(data: bytes) -> bytes:
    """data and spaces up to a positive multiple of WIDTH."""
    return data + b" " * (-len(data) % WIDTH if data else WIDTH)


def _wav(p: bytes) -> bytes:
    pad = len(p) % 2
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(p) + pad, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(p)) + p + b"\0" * pad


def _au(p: bytes) -> bytes:
    return struct.pack(">4s5I", b".snd", 24, len(p), 2, 8000, 1) + p


def _pgm(p: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(p) // WIDTH) + p


def _bmp(p: bytes) -> bytes:
    grey = b"".join(bytes((i, i, i, 0)) for i in range(256))
    at = 54 + len(grey)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", at + len(p), 0, 0, at, 40, WIDTH, -(len(p) // WIDTH), 1, 8, 0, len(p), 2835, 2835, 256, 0) + grey + p


def _png_chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _png(p: bytes) -> bytes:
    rows = np.zeros((len(p) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(p, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _png_chunk(b"IHDR", head) + _png_chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _png_chunk(b"IEND", b"")


# Validators take the data and a hit's place, and return the medium's end and its samples, or None.
Found = tuple[int, bytes] | None


def _read_wav(d: bytes, at: int) -> Found:
    if len(d) < at + 44 or d[at + 8 : at + 16] != b"WAVEfmt ":
        return None
    end = at + 8 + struct.unpack_from("<I", d, at + 4)[0]
    size, coding, channels = struct.unpack_from("<IHH", d, at + 16)
    if end > len(d) or size < 16 or coding != 1 or channels < 1 or struct.unpack_from("<H", d, at + 34)[0] != 8:
        return None
    p = at + 20 + size
    while p + 8 <= end:
        kind, n = d[p : p + 4], struct.unpack_from("<I", d, p + 4)[0]
        if p + 8 + n > end:
            return None
        if kind == b"data":
            return end, d[p + 8 : p + 8 + n]
        p += 8 + n + n % 2
    return None


def _read_au(d: bytes, at: int) -> Found:
    if len(d) < at + 24:
        return None
    start, n, coding, rate, channels = struct.unpack_from(">5I", d, at + 4)
    if start < 24 or coding != 2 or not rate or not 1 <= channels <= 64 or at + start + n > len(d):
        return None
    return at + start + n, d[at + start : at + start + n]


_PGM_HEAD = re.compile(rb"P5\s(?:#[^\n]*\n)*(\d{1,9})\s+(\d{1,9})\s+255\s")


def _read_pgm(d: bytes, at: int) -> Found:
    m = _PGM_HEAD.match(d, at)
    n = int(m[1]) * int(m[2]) if m else 0
    return (m.end() + n, d[m.end() : m.end() + n]) if n and m.end() + n <= len(d) else None


def _read_bmp(d: bytes, at: int) -> Found:
    if len(d) < at + 54:
        return None
    total, _, _, start, head, w, h, planes, bits, packed = struct.unpack_from("<IHHIIiiHHI", d, at + 2)
    stride = (w + 3) // 4 * 4
    if head < 40 or planes != 1 or bits != 8 or packed or w <= 0 or not h or start < 14 + head or start + stride * abs(h) > total or at + total > len(d):
        return None
    rows = np.frombuffer(d, np.uint8, stride * abs(h), at + start).reshape(-1, stride)[:, :w]
    return at + total, (rows if h < 0 else rows[::-1]).tobytes()


def _read_png(d: bytes, at: int) -> Found:
    p, shape, packed = at + 8, None, []
    while p + 12 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, p)
        if p + 12 + n > len(d) or zlib.crc32(d[p + 4 : p + 8 + n]) != struct.unpack_from(">I", d, p + 8 + n)[0]:
            return None
        if kind == b"IHDR" and n == 13:
            shape = struct.unpack_from(">IIBBBBB", d, p + 8)
        elif kind == b"IDAT":
            packed.append(d[p + 8 : p + 8 + n])
        p += 12 + n
        if kind == b"IEND":
            break
    else:
        return None
    if not shape or shape[2:] != (8, 0, 0, 0, 0):
        return None
    size = shape[1] * (shape[0] + 1)
    unpacker = zlib.decompressobj()
    try:
        raw = unpacker.decompress(b"".join(packed), size + 1)  # never more than the header declares
        rest = b"" if len(raw) > size else unpacker.decompress(unpacker.unconsumed_tail, 1)
    except zlib.error:
        return None
    if len(raw) != size or rest or not unpacker.eof or unpacker.unused_data:
        return None
    rows = np.frombuffer(raw, np.uint8).reshape(shape[1], shape[0] + 1)
    return None if rows[:, 0].any() else (p, rows[:, 1:].tobytes())


#: Format -> magic bytes, writer, validator.
FORMATS: dict[str, tuple[bytes, Callable[[bytes], bytes], Callable[[bytes, int], Found]]] = {
    "wav": (b"RIFF", _wav, _read_wav),
    "au": (b".snd", _au, _read_au),
    "pgm": (b"P5", _pgm, _read_pgm),
    "bmp": (b"BM", _bmp, _read_bmp),
    "png": (b"\x89PNG\r\n\x1a\n", _png, _read_png),
}

_AUTOMATON: list[ahocorasick.Automaton] = []


def _automaton() -> ahocorasick.Automaton:
    if not _AUTOMATON:
        made = ahocorasick.Automaton()
        for name, (magic, _, _) in FORMATS.items():
            made.add_word(magic.decode("latin-1"), (name, len(magic)))
        made.make_automaton()
        _AUTOMATON.append(made)
    return _AUTOMATON[0]


def carve(data: bytes | None) -> list[tuple[str, int, int, bytes]]:
    """Confirmed media in data that do not lie in one another: format, start, end, samples, in order of place."""
    out: list[tuple[str, int, int, bytes]] = []
    for last, (name, n) in _automaton().iter((data or b"").decode("latin-1")):
        at = last - n + 1
        if out and at < out[-1][2]:
            continue
        if found := FORMATS[name][2](data, at):
            out.append((name, at, found[0], found[1]))
    return out


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, declared (a type that may be wrong) and media: each text's padded UTF-8 bytes as 8-bit samples.

    Format and declared type follow from the payload alone, so equal texts are stored alike.
    """
    names = list(FORMATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            media, declared = [], []
            for t in texts:
                payload = padded(t)
                h = zlib.crc32(payload)
                media.append(FORMATS[names[h % len(names)]][1](payload))
                declared.append(names[h // 8 % len(names)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(declared), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "declared", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, n_bytes long, declared string, media binary")


def sniff(media: DataFrame, media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """media's columns, without the binary one, and detected, corrected (true if the declared type was wrong), carved.

    carved holds every confirmed medium: format, start, length and samples. detected is the first one's format if it
    starts the data, else `unknown`.
    """
    keep = [c for c in media.columns if c != media_col]
    kinds = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in keep)
    carved_type = pa.list_(pa.struct([("format", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("samples", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [carve(d) for d in batch.column(len(keep)).to_pylist()]
            detected = [f[0][0] if f and f[0][1] == 0 else "unknown" for f in found]
            declared = batch.column(keep.index(declared_col)).to_pylist()
            carved = pa.array([[{"format": n, "start": a, "length": e - a, "samples": s} for n, a, e, s in f] for f in found], carved_type)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(detected), pa.array([a != b for a, b in zip(detected, declared)]), carved], names=[*keep, "detected", "corrected", "carved"])

    return media.select(*keep, media_col).mapInArrow(tidy(run), f"{kinds}, detected string, corrected boolean, carved array<struct<format: string, start: long, length: long, samples: binary>>")


def payload_digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of stored media, with payloads read back through the sniffer."""

    digest = hashlib.sha256
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "declared", "detected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, declared, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found = carve(data)
                if not found:
                    rows.append((n, None, None, None, None if data is None else len(data), None if data is None else digest(data).hexdigest(), None, declared, "unknown"))
                    continue
                name, _, _, payload = found[0]
                counts = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16)
                share = counts / max(counts.sum(), 1)
                entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
                feature = f"{name};{len(payload)};{entropy:.4f};" + ",".join(f"{x:.4f}" for x in share)
                rows.append((n, len(payload), digest(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), digest(data).hexdigest(), feature, declared, name))
            cols = list(zip(*rows)) if rows else [[]] * 9
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), t) for c, t in zip(cols, types)]], names=names)

    kind = media.schema[id_col].dataType.simpleString()
    out = media.select(id_col, "n_bytes", "declared", "media").mapInArrow(tidy(run), f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared string, detected string")
    return out.withColumn("corrected", F.col("declared") != F.col("detected"))
