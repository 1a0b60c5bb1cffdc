"""Media columns: signature sniffing, structure validation, type correction and carving.

An Aho-Corasick automaton finds every signature in a blob in one pass; a validator for each format walks its structure, checks its
lengths and checksums, and says where the media ends, so a signature in ordinary bytes is not taken for media. Whole media are carved
out of the blob wherever they stand in it, and a declared type that does not hold is corrected.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

# File signatures.
SIGNATURES = {
    "audio/wav": [b"RIFF"],
    "image/bmp": [b"BM"],
    "image/gif": [b"GIF87a", b"GIF89a"],
    "image/jpeg": [b"\xff\xd8\xff"],
    "image/png": [b"\x89PNG\r\n\x1a\n"],
    "application/gzip": [b"\x1f\x8b\x08"],
}
ROWS = 64  # blobs whose media are copied out at a time
CHUNK = 1 << 16  # bytes that are copied or unpacked at a time
ROW = 192  # bytes of a payload row: 64 pixels of three 8-bit samples


class Found(NamedTuple):
    offset: int
    length: int
    type: str


def _wav(b: memoryview) -> int:
    if len(b) < 44 or bytes(b[8:12]) != b"WAVE":
        return 0
    end, at, seen = 8 + int.from_bytes(b[4:8], "little"), 12, set()
    if end > len(b):
        return 0
    while at + 8 <= end:
        seen.add(bytes(b[at : at + 4]))
        at += 8 + int.from_bytes(b[at + 4 : at + 8], "little")
        at += at & 1
    return end if at in (end, end + 1) and {b"fmt ", b"data"} <= seen else 0


def _bmp(b: memoryview) -> int:
    if len(b) < 54:
        return 0
    size, reserved, start, header, width, height, planes, depth, packed = struct.unpack_from("<IIIIiiHHI", b, 2)
    if reserved or header != 40 or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or packed or width <= 0 or not 54 <= start <= size <= len(b):
        return 0
    return size if start + (width * depth + 31) // 32 * 4 * abs(height) <= size else 0


def _png(b: memoryview) -> int:
    at, first = 8, True
    while at + 12 <= len(b):
        n, kind = int.from_bytes(b[at : at + 4], "big"), bytes(b[at + 4 : at + 8])
        if at + 12 + n > len(b) or first and (kind != b"IHDR" or n != 13) or zlib.crc32(b[at + 4 : at + 8 + n]) != int.from_bytes(b[at + 8 + n : at + 12 + n], "big"):
            return 0
        at, first = at + 12 + n, False
        if kind == b"IEND":
            return at
    return 0


def _gif(b: memoryview) -> int:
    def blocks(at: int) -> int:
        while at < len(b) and b[at]:
            at += b[at] + 1
        return at + 1

    if len(b) < 14:
        return 0
    at = 13 + (3 << (b[10] & 7) + 1 if b[10] & 128 else 0)
    while at < len(b):
        if b[at] == 0x3B:
            return at + 1
        if b[at] == 0x21:
            at = blocks(at + 2)
        elif b[at] == 0x2C and at + 10 < len(b):
            at = blocks(at + 11 + (3 << (b[at + 9] & 7) + 1 if b[at + 9] & 128 else 0))
        else:
            return 0
    return 0


def _jpeg(b: memoryview) -> int:
    at = 2
    while at + 4 <= len(b) and b[at] == 0xFF:
        kind = b[at + 1]
        if kind == 0xD9:
            return at + 2
        if kind < 0xC0 or 0xD0 <= kind <= 0xD7:
            return 0
        at += 2 + int.from_bytes(b[at + 2 : at + 4], "big")
        if kind == 0xDA:
            for lo in range(at, len(b), CHUNK):
                if (end := bytes(b[lo : lo + CHUNK + 1]).find(b"\xff\xd9")) >= 0:
                    return lo + end + 2
            return 0
    return 0


def _gzip(b: memoryview) -> int:
    d, at = zlib.decompressobj(31), 0
    try:
        while at < len(b) and not d.eof:
            d.decompress(b[at : at + CHUNK], CHUNK)
            while d.unconsumed_tail and not d.eof:
                d.decompress(d.unconsumed_tail, CHUNK)
            at += CHUNK
    except zlib.error:
        return 0
    return min(at, len(b)) - len(d.unused_data) if d.eof else 0


VALID = {"audio/wav": _wav, "image/bmp": _bmp, "image/gif": _gif, "image/jpeg": _jpeg, "image/png": _png, "application/gzip": _gzip}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, magic in SIGNATURES.items():
        for m in magic:
            a.add_word(m.decode("latin-1"), (len(m), kind))
    a.make_automaton()
    return a


def sniff(blob: bytes, a: ahocorasick.Automaton) -> list[Found]:
    """Valid media in the blob, leftmost first, none inside another."""
    out, end, view, closed = [], 0, memoryview(blob), blob.rfind(b"\xff\xd9")
    for last, (n, kind) in a.iter(blob.decode("latin-1")):
        at = last + 1 - n
        if kind == "image/jpeg" and at > closed:  # no end follows, so there is nothing to look through
            continue
        if at >= end and (length := VALID[kind](view[at:])):
            out.append(Found(at, length, kind))
            end = at + length
    return out


def encode(payload: bytes, kind: str) -> bytes:
    """A payload of whole rows as 8-bit samples of the format."""
    rows = len(payload) // ROW
    if kind == "audio/wav":
        return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(payload)) + payload
    if kind == "image/bmp":
        up = np.frombuffer(payload, np.uint8).reshape(rows, ROW)[::-1].tobytes()
        return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + len(payload), 0, 54, 40, ROW // 3, rows, 1, 24, 0, len(payload), 2835, 2835, 0, 0) + up
    if kind == "image/png":
        lines = np.zeros((rows, ROW + 1), np.uint8)
        lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, ROW)
        chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
        return SIGNATURES[kind][0] + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW // 3, rows, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")
    raise ValueError(f"no encoder for {kind}")


def decode(media: bytes, kind: str) -> bytes:
    """The samples of a medium that encode() made, read from its bytes."""
    if kind == "audio/wav":
        at = 12
        while media[at : at + 4] != b"data":
            at += 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        return media[at + 8 : at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")]
    if kind == "image/bmp":
        start, rows = int.from_bytes(media[10:14], "little"), int.from_bytes(media[22:26], "little")
        return np.frombuffer(media, np.uint8, rows * ROW, start).reshape(rows, ROW)[::-1].tobytes()
    if kind == "image/png":
        at, data = 8, b""
        while (k := media[at + 4 : at + 8]) != b"IEND":
            n = int.from_bytes(media[at : at + 4], "big")
            data += media[at + 8 : at + 8 + n] if k == b"IDAT" else b""
            at += 12 + n
        return np.frombuffer(zlib.decompress(data), np.uint8).reshape(-1, ROW + 1)[:, 1:].tobytes()
    raise ValueError(f"no decoder for {kind}")


MADE = ("audio/wav", "image/bmp", "image/png")
DECLARED = (*MADE, "application/octet-stream")


def store(text: bytes | None) -> tuple[int, bytes, str]:
    """(bytes unpadded, blob, declared type) of a text: its payload as a medium among foreign bytes, under a type that may be wrong.

    Format, foreign bytes (none to 63 before and after it, of values that begin no signature) and type are set by the payload's checksum.
    """
    raw = text or b""
    payload = raw + b" " * (-len(raw) % ROW or (0 if raw else ROW))
    key = zlib.crc32(payload)
    noise = [bytes((key >> i % 29) + i & 15 for i in range(key >> s & 63)) for s in (8, 14)]
    return len(raw), noise[0] + encode(payload, MADE[key % len(MADE)]) + noise[1], DECLARED[key >> 20 & 3]


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, blob (binary), declared: each text written down as a media column."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                rows = [store(t) for t in part.column(1).cast(pa.binary()).to_pylist()]
                columns = zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.string()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in columns)], names=["doc_id", "n_bytes", "blob", "declared"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(write, "doc_id long, n_bytes long, blob binary, declared string")


def carved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, blob, declared) -> the rows of sniffed()."""
    a = automaton()
    kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            part, rows = b.slice(lo, ROWS), []
            for i, (blob, declared) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                found = sniff(blob, a) if blob else []
                rows += [(i, declared, f.type, f.type != declared, f.offset, f.length, blob[f.offset : f.offset + f.length]) for f in found]
                if not found:
                    rows.append((i, declared, declared, False, None, 0, None))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True))], names=["id", "declared", "type", "corrected", "offset", "length", "media"])


def sniffed(df: DataFrame, id_col: str, blob_col: str, type_col: str) -> DataFrame:
    """id, declared, type, corrected, offset, length, media: one row for each medium carved out of the blob column.

    A blob without media, empty or null, gives one row with the declared type, offset and media null and length 0. corrected: the
    declared type is not the type found. Repeated rows give repeated results; other columns are not looked at.
    """
    schema = df.select(F.col(id_col).alias("id")).schema.add("declared", "string").add("type", "string").add("corrected", "boolean").add("offset", "long").add("length", "long").add("media", "binary")

    return df.select(F.col(id_col).alias("id"), F.col(blob_col).alias("blob"), F.col(type_col).alias("declared")).mapInArrow(carved, schema)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as a media column (staged), whose media are sniffed, corrected, carved and read back.

    media_bytes and media_sha256 are of the stored blob. feature: type found, declared type, offset and length in the blob, rows, sum and
    greatest sample. Equal texts have equal rows but for the id; null and empty texts are one row of blanks; a text that holds signatures
    or whole media itself does not change what is carved, which is the first and only medium of its blob. Repeated rows give repeated
    rows; an empty table has none. A text's blob is one row and has to fit in a worker.
    """
    blobs = staged(stored(docs, id_col, text_col), "media")
    key = F.struct("doc_id", "n_bytes", F.octet_length("blob").cast("long").alias("media_bytes"), F.sha2("blob", 256).alias("media_sha256"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in carved(batches):  # in the same worker
            rows = []
            for key, declared, kind, offset, length, medium in zip(*(b.column(c).to_pylist() for c in ("id", "declared", "type", "offset", "length", "media")), strict=True):
                payload = decode(medium, kind)
                s = np.frombuffer(payload, np.uint8)
                feature = f"{kind};{declared};{offset};{length};{len(s) // ROW};{int(s.sum(dtype=np.int64))};{int(s.max())}"
                rows.append((key["doc_id"], key["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), key["media_bytes"], key["media_sha256"], feature))
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 8, kinds, strict=True)], names=[x.split()[0] for x in DIGEST.split(", ")])

    return blobs.select(key.alias("id"), "blob", "declared").mapInArrow(digest, DIGEST)
