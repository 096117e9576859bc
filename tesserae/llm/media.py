"""Types, structure and embedded parts of binary columns, from the bytes themselves.

One Aho-Corasick automaton finds every magic number in a single pass; a validator for each
format then walks its headers and lengths.  What validates at the start gives the column's
type, whatever was declared; what validates further in is an embedded part and is carved.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, StringType

from tesserae.llm.frames import free_name

UNKNOWN, TEXT = "application/octet-stream", "text/plain"
#: Magic number: (format, bytes before it that belong to the file).  Fixed values of the formats.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": ("image/png", 0),
    b"GIF87a": ("image/gif", 0),
    b"GIF89a": ("image/gif", 0),
    b"\xff\xd8\xff": ("image/jpeg", 0),
    b"BM": ("image/bmp", 0),
    b"RIFF": ("riff", 0),
    b"PK\x03\x04": ("application/zip", 0),
    b"\x1f\x8b\x08": ("application/gzip", 0),
    b"%PDF-": ("application/pdf", 0),
    b"OggS": ("application/ogg", 0),
    b"fLaC": ("audio/flac", 0),
    b"ftyp": ("video/mp4", 4),
}
FORMS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}
PART = "struct<type:string,start:bigint,length:bigint,data_start:bigint,data_length:bigint>"
FOUND = f"struct<type:string,declared_ok:boolean,whole:{PART},embedded:array<{PART}>>"


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, (kind, before) in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (kind, len(magic) + before - 1))
    found.make_automaton()
    return found


def _png(b: bytes, at: int) -> tuple | None:
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        size, = struct.unpack_from(">I", b, pos)
        kind, stop = b[pos + 4:pos + 8], pos + 12 + size
        if stop > len(b) or not kind.isalpha() or first != (kind == b"IHDR") or zlib.crc32(b[pos + 4:stop - 4]) != struct.unpack_from(">I", b, stop - 4)[0]:
            return None
        if kind == b"IEND":
            return "image/png", stop - at, 0, 0
        pos, first = stop, False
    return None


def _gif(b: bytes, at: int) -> tuple | None:
    pos = at + 13
    if pos > len(b):
        return None
    flags = b[at + 10]
    pos += 3 << ((flags & 7) + 1) if flags & 128 else 0
    while pos < len(b):
        mark = b[pos]
        if mark == 0x3B:
            return "image/gif", pos + 1 - at, 0, 0
        if mark == 0x2C and pos + 10 < len(b):
            flags = b[pos + 9]
            pos += 10 + (3 << ((flags & 7) + 1) if flags & 128 else 0) + 1
        elif mark == 0x21:
            pos += 2
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += b[pos] + 1
        pos += 1
    return None


def _jpeg(b: bytes, at: int) -> tuple | None:
    pos, scanned = at + 2, False
    while pos + 4 <= len(b) or b[pos:pos + 2] == b"\xff\xd9":
        if b[pos] != 0xFF:
            return None
        mark = b[pos + 1]
        if mark == 0xD9:
            return ("image/jpeg", pos + 2 - at, 0, 0) if scanned else None
        if mark < 0xC0 or mark == 0xFF:
            return None
        size, = struct.unpack_from(">H", b, pos + 2)
        if size < 2:
            return None
        pos += 2 + size
        if mark == 0xDA:
            scanned = True
            while True:
                pos = b.find(b"\xff", pos)
                if pos < 0 or pos + 1 >= len(b):
                    return None
                if b[pos + 1] and not 0xD0 <= b[pos + 1] <= 0xD7:
                    break
                pos += 2
    return None


def _bmp(b: bytes, at: int) -> tuple | None:
    if at + 26 > len(b):
        return None
    size, spare, data, header = struct.unpack_from("<IIII", b, at + 2)
    if spare or header not in (12, 40, 52, 56, 64, 108, 124) or not 14 + header <= data <= size or at + size > len(b):
        return None
    return "image/bmp", size, data, size - data


def _riff(b: bytes, at: int) -> tuple | None:
    if at + 12 > len(b):
        return None
    size, = struct.unpack_from("<I", b, at + 4)
    kind, stop = FORMS.get(b[at + 8:at + 12]), at + 8 + size
    if kind is None or stop > len(b):
        return None
    pos, seen, data = at + 12, set(), (0, 0)
    while pos + 8 <= stop:
        name, (n,) = b[pos:pos + 4], struct.unpack_from("<I", b, pos + 4)
        if pos + 8 + n > stop:
            return None
        seen.add(name)
        if name == b"data":
            data = (pos + 8 - at, n)
        pos += 8 + n + (n & 1)
    if kind == "audio/wav" and not {b"fmt ", b"data"} <= seen or not seen:
        return None
    return kind, 8 + size + (size & 1 if stop + (size & 1) <= len(b) else 0), *data


def _zip(b: bytes, at: int) -> tuple | None:
    end = at
    while (end := b.find(b"PK\x05\x06", end + 1)) >= 0 and end + 22 <= len(b):
        size, start, note = struct.unpack_from("<IIH", b, end + 12)
        if at + start + size == end and end + 22 + note <= len(b) and (not size or b[at + start:at + start + 4] == b"PK\x01\x02"):
            return "application/zip", end + 22 + note - at, 0, 0
    return None


def _gzip(b: bytes, at: int) -> tuple | None:
    run, pos = zlib.decompressobj(31), at
    try:
        while not run.eof and pos < len(b):
            part = b[pos:pos + 65536]
            pos += len(part)
            run.decompress(part, 1 << 20)
            while run.unconsumed_tail and not run.eof:      # bounded output, however far it unpacks
                run.decompress(run.unconsumed_tail, 1 << 20)
    except zlib.error:
        return None
    return ("application/gzip", pos - len(run.unused_data) - at, 0, 0) if run.eof else None


def _pdf(b: bytes, at: int) -> tuple | None:
    if not re.match(rb"%PDF-\d\.\d", b[at:at + 8]):
        return None
    limit = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, limit if limit >= 0 else len(b))
    if end < 0 or b.rfind(b"startxref", at, end) < 0:
        return None
    end += 5
    end += len(re.match(rb"\r?\n?", b[end:end + 2])[0])
    return "application/pdf", end - at, 0, 0


def _ogg(b: bytes, at: int) -> tuple | None:
    pos = at
    while b[pos:pos + 5] == b"OggS\0" and pos + 27 <= len(b):
        table = b[pos + 27:pos + 27 + b[pos + 26]]
        last = b[pos + 5] & 4
        pos += 27 + b[pos + 26] + sum(table)
        if pos > len(b):
            return None
        if last:
            return "application/ogg", pos - at, 0, 0
    return None


def _flac(b: bytes, at: int) -> tuple | None:
    pos, first = at + 4, True
    while pos + 4 <= len(b):
        head, size = b[pos], int.from_bytes(b[pos + 1:pos + 4], "big")
        if first and (head & 127 or size != 34):
            return None
        pos, first = pos + 4 + size, False
        if pos > len(b):
            return None
        if head & 128:
            return "audio/flac", len(b) - at, pos - at, len(b) - pos   # frames carry no total length: up to the end
    return None


def _mp4(b: bytes, at: int) -> tuple | None:
    pos, seen = at, set()
    while pos + 8 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, pos)
        head = 8
        if size == 1 and pos + 16 <= len(b):
            size, head = struct.unpack_from(">Q", b, pos + 8)[0], 16
        if size < head or pos + size > len(b) or not re.fullmatch(rb"[A-Za-z0-9 \xa9_-]{4}", kind):
            break
        seen.add(kind)
        pos += size
    return ("video/mp4", pos - at, 0, 0) if {b"ftyp"} < seen and seen & {b"moov", b"mdat", b"moof"} else None


_CHECKS = {
    "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "riff": _riff, "application/zip": _zip, "application/gzip": _gzip,
    "application/pdf": _pdf, "application/ogg": _ogg, "audio/flac": _flac, "video/mp4": _mp4,
}


def parts(content: bytes) -> tuple[dict | None, list[dict]]:
    """The part that begins at the first byte, and the outermost valid parts behind it; starts count from the content's first byte."""
    whole, inside, until = None, [], 0
    for end, (kind, back) in automaton().iter(content.decode("latin-1")):
        at = end - back
        if at < 0 or at and at < until:
            continue
        found = _CHECKS[kind](content, at)
        if not found:
            continue
        part = {"type": found[0], "start": at, "length": found[1], "data_start": at + found[2], "data_length": found[3]}
        if at == 0:
            whole = whole or part
        else:
            inside.append(part)
            until = at + found[1]
    return whole, inside


def sniff(content: bytes | None, declared: str | None) -> dict:
    """Type, whether the declared one was right, the whole part and the embedded ones."""
    content = content or b""
    whole, inside = parts(content)
    kind = whole["type"] if whole else UNKNOWN
    if not whole and content and b"\0" not in content:
        try:
            content.decode("utf-8")
            kind = TEXT
        except UnicodeDecodeError:
            pass
    return {"type": kind, "declared_ok": (declared or "").lower() == kind, "whole": whole, "embedded": inside}


def inspect(df: DataFrame, content_col: str, declared_col: str | None = None) -> DataFrame:
    """``df`` with ``media_type`` (from the bytes), ``declared_ok``, ``media_whole`` and ``media_embedded`` (parts with start and length).

    Null and empty contents are of unknown type without parts; contents that only look like
    a format, or end before its structure does, are text or unknown.  Columns of those names
    are replaced; rows and other columns stay; an empty table stays empty.
    """

    @pandas_udf(FOUND)
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for contents, declared in batches:
            yield pd.DataFrame([sniff(c, d) for c, d in zip(contents, declared)], columns=["type", "declared_ok", "whole", "embedded"])

    found = free_name(df, "found")
    declared = F.col(declared_col) if declared_col else F.lit(None).cast("string")
    named = {"media_type": F.col(f"{found}.type"), "declared_ok": F.col(f"{found}.declared_ok"), "media_whole": F.col(f"{found}.whole"), "media_embedded": F.col(f"{found}.embedded")}
    return df.withColumn(found, of(F.col(content_col), declared)).withColumns(named).drop(found)


def carve(df: DataFrame, content_col: str) -> DataFrame:
    """One row per embedded part of an inspected table: its columns, ``part`` and the part's bytes as ``part_bytes``."""
    part = F.col("part")
    return df.withColumn("part", F.explode("media_embedded")).withColumn("part_bytes", F.substring(F.col(content_col), (part["start"] + 1).cast("int"), part["length"].cast("int")))


def wav(payload: bytes, rate: int = 8000) -> bytes:
    """A one-channel WAV file with ``payload`` as its unsigned 8-bit samples."""
    odd = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * odd


def padded(text: str | None, block: int = 64) -> bytes:
    """UTF-8 bytes of ``text`` with zeros up to a positive multiple of ``block``."""
    raw = (text or "").encode("utf-8")
    return raw + b"\0" * (block if not raw else -len(raw) % block)


@pandas_udf(BinaryType())
def store_text(texts: pd.Series) -> pd.Series:
    """Each text as a WAV file of its padded bytes."""
    return pd.Series([wav(padded(t)) for t in texts], dtype=object)


@pandas_udf(StringType())
def sample_feature(samples: pd.Series) -> pd.Series:
    """Mean, deviation, range and level crossings of 8-bit samples."""

    def one(raw: bytes) -> str:
        x = np.frombuffer(raw, dtype=np.uint8)
        if not len(x):
            return "n=0"
        high = x >= 128
        return f"n={len(x)};mean={x.mean():.4f};std={x.std():.4f};min={x.min()};max={x.max()};crossings={int((high[1:] != high[:-1]).sum())}"

    return pd.Series([one(s) for s in samples])
