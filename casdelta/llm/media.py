"""Media columns: signature sniffing.

An Aho-Corasick automaton over the magic bytes of known formats finds every place where a medium may begin, in one pass over the
bytes. A validator for each format then confirms structure and lengths from the header's own fields; what it rejects was chance.
A valid medium at offset 0 gives the true type of the column, whatever type was declared; valid media further on are carved.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casdelta.llm.common import slices

#: Magic bytes of the formats, with the distance of the magic from the start of the medium.
MAGIC = [
    ("au", b".snd", 0),
    ("bmp", b"BM", 0),
    ("flac", b"fLaC", 0),
    ("gif", b"GIF87a", 0),
    ("gif", b"GIF89a", 0),
    ("pgm", b"P5 ", 0),
    ("pgm", b"P5\n", 0),
    ("png", b"\x89PNG\r\n\x1a\n", 0),
    ("wav", b"WAVEfmt ", 8),
]
FORMATS = ("wav", "bmp", "au", "pgm")
#: Width in samples of the pictures that hold a payload; payloads are a multiple of it.
UNIT = 192
#: Bytes of texts or media that a task holds at once, unless a single one has more.
SLICE_BYTES = 4 << 20


def valid_wav(b: memoryview, at: int) -> tuple[int, int, int] | None:
    """(payload start, payload length, end of the medium) of 8-bit PCM, or None."""
    if at < 0 or at + 44 > len(b) or bytes(b[at : at + 4]) != b"RIFF":
        return None
    size, fmt = struct.unpack_from("<I", b, at + 4)[0], struct.unpack_from("<IHHIIHH", b, at + 16)
    end = at + 8 + size
    if fmt[0] != 16 or fmt[1] != 1 or fmt[6] != 8 or fmt[5] != fmt[2] or fmt[4] != fmt[3] * fmt[5] or end > len(b):
        return None
    pos = at + 36
    while pos + 8 <= end:
        n = struct.unpack_from("<I", b, pos + 4)[0]
        if pos + 8 + n > end:
            return None
        if bytes(b[pos : pos + 4]) == b"data":
            return pos + 8, n, end
        pos += 8 + n + n % 2
    return None


def valid_bmp(b: memoryview, at: int) -> tuple[int, int, int] | None:
    """As valid_wav, of an uncompressed picture of 8-bit samples whose rows need no filling."""
    if at + 54 > len(b):
        return None
    size, _, start, head, wide, high, planes, bits, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if head != 40 or planes != 1 or bits != 8 or packed or wide <= 0 or wide % 4 or high >= 0 or at + size > len(b) or start < 54 or start - wide * high != size:
        return None
    return at + start, -wide * high, at + size


def valid_au(b: memoryview, at: int) -> tuple[int, int, int] | None:
    """As valid_wav, of 8-bit linear PCM with a stated length."""
    if at + 24 > len(b):
        return None
    head, n, code, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    if head < 24 or code != 2 or not rate or not 1 <= channels <= 8 or at + head + n > len(b):
        return None
    return at + head, n, at + head + n


def valid_pgm(b: memoryview, at: int) -> tuple[int, int, int] | None:
    """As valid_wav, of a binary grey picture with samples of one byte."""
    fields = bytes(b[at : at + 64]).split(None, 4)
    if len(fields) < 4 or not all(x.isdigit() and len(x) < 12 for x in fields[1:4]) or int(fields[3]) != 255:
        return None
    head = bytes(b[at : at + 64])
    pos = 0
    for x in fields[:4]:
        pos = head.index(x, pos) + len(x)
    n = int(fields[1]) * int(fields[2])
    return (at + pos + 1, n, at + pos + 1 + n) if n and at + pos + 1 + n <= len(b) else None


def valid_png(b: memoryview, at: int) -> tuple[int, int, int] | None:
    """The chunks up to IEND, each with the right checksum; the payload is the whole medium."""
    pos = at + 8
    while pos + 12 <= len(b):
        n = struct.unpack_from(">I", b, pos)[0]
        if pos + 12 + n > len(b) or zlib.crc32(b[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", b, pos + 8 + n)[0]:
            return None
        if bytes(b[pos + 4 : pos + 8]) == b"IEND":
            return at, pos + 12 + n - at, pos + 12 + n
        pos += 12 + n
    return None


def valid_gif(b: memoryview, at: int) -> tuple[int, int, int] | None:
    """The blocks up to the trailer; the payload is the whole medium."""
    if at + 13 > len(b):
        return None
    table = lambda flags: 3 << (flags & 7) + 1 if flags & 128 else 0
    pos = at + 13 + table(b[at + 10])
    while pos < len(b):
        kind = b[pos]
        if kind == 0x3B:
            return at, pos + 1 - at, pos + 1
        if kind == 0x21:
            pos += 2
        elif kind == 0x2C and pos + 10 < len(b):
            pos += 11 + table(b[pos + 9])
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        pos += 1
    return None


def valid_flac(b: memoryview, at: int) -> tuple[int, int, int] | None:
    """A stream-information block of the right length comes first; frames have no stated length, so it runs to the end."""
    if at + 42 > len(b) or b[at + 4] & 127 or int.from_bytes(b[at + 5 : at + 8], "big") != 34:
        return None
    return at, len(b) - at, len(b)


VALID = {"au": valid_au, "bmp": valid_bmp, "flac": valid_flac, "gif": valid_gif, "pgm": valid_pgm, "png": valid_png, "wav": valid_wav}


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, magic, back in MAGIC:
        found.add_word(magic.decode("latin-1"), (kind, len(magic) - 1 + back))
    found.make_automaton()
    return found


def sniff_bytes(media: bytes) -> list[tuple[str, int, int, int, int]]:
    """Valid media as (kind, start, end, payload start, payload length), leftmost first; one inside an earlier one's bytes doesn't count."""
    view, found, free = memoryview(media), [], 0
    starts = sorted((end - back, kind) for end, (kind, back) in automaton().iter(media.decode("latin-1")))
    for at, kind in starts:
        if at >= free and (ok := VALID[kind](view, at)):
            found.append((kind, at, ok[2], ok[0], ok[1]))
            free = ok[2]
    return found


def pack(payload: bytes, kind: str) -> bytes:
    """The payload as the samples of a medium; its length is a positive multiple of UNIT."""
    n = len(payload)
    if kind == "wav":
        return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n) + payload
    if kind == "bmp":
        grey = b"".join(bytes((i, i, i, 0)) for i in range(256))
        return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 1078 + n, 0, 1078, 40, UNIT, -(n // UNIT), 1, 8, 0, n, 2835, 2835, 256, 0) + grey + payload
    if kind == "au":
        return struct.pack(">4sIIIII", b".snd", 24, n, 2, 8000, 1) + payload
    if kind == "pgm":
        return b"P5\n%d %d\n255\n" % (UNIT, n // UNIT) + payload
    raise ValueError(kind)


def store(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Return (id_col, n_bytes, declared, media): each whole text's UTF-8 bytes, filled with spaces, as the samples of a medium.

    The format follows from the text's checksum, so equal texts are stored alike. The declared type is the next format of the list
    for every third text: declarations are not to be trusted, and sniff() must correct them. A null text is as an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 500, SLICE_BYTES):
                size, declared, media = [], [], []
                for t in part.column(1).to_pylist():
                    raw = (t or "").encode("utf-8")
                    k = zlib.crc32(raw)
                    size.append(len(raw))
                    payload = raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")
                    media.append(pack(payload, FORMATS[k % len(FORMATS)]))
                    declared.append(FORMATS[(k + (k // 7 % 3 == 0)) % len(FORMATS)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(declared), pa.array(media, pa.binary())], ["id", "n_bytes", "declared", "media"])

    out = docs.select(docs[id_col].alias("id"), docs[text].cast("string").alias("text"))
    return out.mapInArrow(run, f"id {out.schema['id'].dataType.simpleString()}, n_bytes long, declared string, media binary").withColumnRenamed("id", id_col)


def sniff(df: DataFrame, media: str = "media", declared: str = "declared", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Return keep, media and declared, with type, corrected, payload, and carved.

    type: that of a valid medium at offset 0, else 'unknown'; corrected: whether it differs from the declared type (a null
    declaration counts as different); payload: that medium's samples, null if unknown; carved: array of (kind, start, end) of
    valid media after it. Null media are unknown and have nothing carved. Each row stands alone.
    """
    fields = [df.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keep, "media", "declared", "type", "corrected", "payload", "carved"]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in slices(batch, len(keep), 500, SLICE_BYTES):
                types, fixed, payloads, carved = [], [], [], []
                for m, d in zip(part.column(len(keep)).to_pylist(), part.column(len(keep) + 1).to_pylist(), strict=True):
                    found = sniff_bytes(m) if m else []
                    head = found[0] if found and found[0][1] == 0 else None
                    types.append(head[0] if head else "unknown")
                    fixed.append(types[-1] != d)
                    payloads.append(m[head[3] : head[3] + head[4]] if head else None)
                    carved.append([{"kind": k, "start": a, "end": b} for k, a, b, *_ in found[bool(head) :]])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(types, pa.string()), pa.array(fixed), pa.array(payloads, pa.binary()), pa.array(carved, kind)], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return df.select(*keep, df[media].alias("media"), df[declared].cast("string").alias("declared")).mapInArrow(run, f"{schema}, media binary, declared string, type string, corrected boolean, payload binary, carved array<struct<kind:string,start:bigint,end:bigint>>")


def feature(payload: Column) -> Column:
    """Type, whether the declaration was corrected, media carved, and a checksum of the samples."""
    carved = F.array_join(F.transform("carved", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return F.concat_ws("|", F.col("type"), F.col("corrected").cast("string"), carved, F.lower(F.hex(F.crc32(payload))))
