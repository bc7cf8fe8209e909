"""Sniffing media by signature: what bytes are, whatever they are declared to be.

An Aho-Corasick automaton finds all magic numbers in one pass; a validator for each format walks
the structure that follows (sizes, chunks, checksums) and tells the length, or that it is none.
The value's own type is that of a valid signature at its start, everything valid further in is
embedded media, which can be carved out. Also here: lossless storage of bytes as 8-bit sound.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeweave.llm.common import stage, tune

RATE = 8000
PAD = 64

# --- validators: (bytes, offset) -> length, or 0 ---------------------------------------------
# What lies anywhere further on is looked up in an index of the value, made once, so that a text full
# of magic numbers is not searched to its end for each.


def _places(d: bytes, mark: bytes) -> array:
    return array("q", (m.start() for m in re.finditer(re.escape(mark), d)))


@lru_cache(maxsize=1)
def _pdf_marks(d: bytes) -> tuple[array, array]:
    return _places(d, b"%%EOF"), _places(d, b"startxref")


@lru_cache(maxsize=1)
def _zip_ends(d: bytes) -> dict[int, int]:
    """Where an archive must begin for a closing record to be its own, and where the first such archive ends."""
    out: dict[int, int] = {}
    for end in _places(d, b"PK\x05\x06"):
        if end + 22 > len(d):
            break
        size, start = struct.unpack_from("<II", d, end + 12)
        note = struct.unpack_from("<H", d, end + 20)[0]
        i = end - size - start
        if i >= 0 and end + 22 + note <= len(d) and (not size or d[i + start : i + start + 4] == b"PK\x01\x02"):
            out.setdefault(i, end + 22 + note)
    return out


@lru_cache(maxsize=1)
def _gif_dead(d: bytes) -> set[int]:
    """Sub-blocks known to lead past the end of the value; filled as they are met."""
    return set()


def _riff(d: bytes, i: int, form: bytes, need: set[bytes]) -> int:
    if len(d) < i + 12 or d[i + 8 : i + 12] != form:
        return 0
    end = i + 8 + struct.unpack_from("<I", d, i + 4)[0]
    if end > len(d):
        return 0
    at, seen = i + 12, set()
    while at + 8 <= end:
        size = struct.unpack_from("<I", d, at + 4)[0]
        seen.add(d[at : at + 4])
        at += 8 + size + (size & 1)
    return end - i if at in (end, end + 1) and seen & need else 0


def _wav(d: bytes, i: int) -> int:
    return _riff(d, i, b"WAVE", {b"data"})


def _webp(d: bytes, i: int) -> int:
    return _riff(d, i, b"WEBP", {b"VP8 ", b"VP8L", b"VP8X"})


def _avi(d: bytes, i: int) -> int:
    return _riff(d, i, b"AVI ", {b"LIST"})


def _png(d: bytes, i: int) -> int:
    at, first = i + 8, True
    while at + 12 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, at)
        if at + 12 + n > len(d) or first != (kind == b"IHDR") or zlib.crc32(d[at + 4 : at + 8 + n]) != struct.unpack_from(">I", d, at + 8 + n)[0]:
            return 0
        at, first = at + 12 + n, False
        if kind == b"IEND":
            return at - i
    return 0


def _gif(d: bytes, i: int) -> int:
    if len(d) < i + 13:
        return 0
    flags = d[i + 10]
    at = i + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)

    def skip(at: int) -> int:
        dead, met = _gif_dead(d), array("q")
        while at < len(d) and d[at] and at not in dead:
            met.append(at)
            at += 1 + d[at]
        if at < len(d) and not d[at]:
            return at + 1
        dead.update(met)
        return len(d)

    while at < len(d):
        if d[at] == 0x3B:
            return at + 1 - i
        if d[at] == 0x21:
            at = skip(at + 2)
        elif d[at] == 0x2C and at + 10 < len(d):
            local = d[at + 9]
            at = skip(at + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0))
        else:
            return 0
    return 0


def _jpeg(d: bytes, i: int) -> int:
    at, scan = i + 2, False
    while at + 2 <= len(d):
        if d[at] != 0xFF:
            if not scan:
                return 0
            at = d.find(b"\xff", at)
            if at < 0:
                return 0
            continue
        kind = d[at + 1]
        if kind == 0xD9:
            return at + 2 - i if scan else 0
        if kind == 0xFF:
            at += 1
        elif kind == 0 or 0xD0 <= kind <= 0xD7:
            if not scan:
                return 0
            at += 2
        elif kind < 0xC0 or at + 4 > len(d):
            return 0
        else:
            size = struct.unpack_from(">H", d, at + 2)[0]
            if size < 2:
                return 0
            scan = scan or kind == 0xDA
            at += 2 + size
    return 0


def _bmp(d: bytes, i: int) -> int:
    if len(d) < i + 30:
        return 0
    size, reserved, start, head = struct.unpack_from("<IIII", d, i + 2)
    ok = not reserved and head in (12, 40, 52, 56, 64, 108, 124) and 14 + head <= start <= size and i + size <= len(d)
    return size if ok else 0


def _pdf(d: bytes, i: int) -> int:
    if not d[i + 5 : i + 6].isdigit():
        return 0
    ends, tables = _pdf_marks(d)
    e, t = bisect_left(ends, i), bisect_left(tables, i)
    return ends[e] + 5 - i if e < len(ends) and t < len(tables) and tables[t] + 9 <= ends[e] else 0


def _zip(d: bytes, i: int) -> int:
    return _zip_ends(d).get(i, i) - i


def _gzip(d: bytes, i: int) -> int:
    z, at = zlib.decompressobj(31), i
    try:
        while not z.eof and at < len(d):
            z.decompress(d[at : at + 65536], 1 << 20)
            while z.unconsumed_tail:
                z.decompress(z.unconsumed_tail, 1 << 20)
            at = min(len(d), at + 65536)
    except zlib.error:
        return 0
    return at - len(z.unused_data) - i if z.eof else 0


def _ogg(d: bytes, i: int) -> int:
    at = i
    while d[at : at + 4] == b"OggS" and at + 27 <= len(d):
        table = d[at + 27 : at + 27 + d[at + 26]]
        end = at + 27 + len(table) + sum(table)
        if end > len(d) or d[at + 4]:
            return 0
        last, at = d[at + 5] & 4, end
        if last:
            return at - i
    return 0


def _flac(d: bytes, i: int) -> int:
    """Metadata blocks are confirmed; the frames run to the end of the value."""
    at = i + 4
    while at + 4 <= len(d):
        head, size = d[at], int.from_bytes(d[at + 1 : at + 4])
        if at == i + 4 and (head & 0x7F or size != 34) or at + 4 + size > len(d):
            return 0
        at += 4 + size
        if head & 0x80:
            return len(d) - i if d[at : at + 1] in (b"\xff", b"") else 0
    return 0


def _mp4(d: bytes, i: int) -> int:
    """The magic number is the kind of the first box, after its size."""
    at, seen = i, set()
    while at + 8 <= len(d):
        size, kind = struct.unpack_from(">I4s", d, at)
        if size == 1 and at + 16 <= len(d):
            size = struct.unpack_from(">Q", d, at + 8)[0]
        if size < 8 or at + size > len(d) or not kind.isalnum():
            break
        seen.add(kind)
        at += size
    return at - i if seen & {b"moov", b"moof", b"mdat"} else 0


#: Name, media type, magic number, where the value begins before it, validator.
FORMATS = [
    ("wav", "audio/wav", b"RIFF", 0, _wav),
    ("webp", "image/webp", b"RIFF", 0, _webp),
    ("avi", "video/x-msvideo", b"RIFF", 0, _avi),
    ("png", "image/png", b"\x89PNG\r\n\x1a\n", 0, _png),
    ("gif", "image/gif", b"GIF87a", 0, _gif),
    ("gif", "image/gif", b"GIF89a", 0, _gif),
    ("jpeg", "image/jpeg", b"\xff\xd8\xff", 0, _jpeg),
    ("bmp", "image/bmp", b"BM", 0, _bmp),
    ("pdf", "application/pdf", b"%PDF-", 0, _pdf),
    ("zip", "application/zip", b"PK\x03\x04", 0, _zip),
    ("gzip", "application/gzip", b"\x1f\x8b\x08", 0, _gzip),
    ("ogg", "audio/ogg", b"OggS", 0, _ogg),
    ("flac", "audio/flac", b"fLaC", 0, _flac),
    ("mp4", "video/mp4", b"ftyp", 4, _mp4),
]
TYPES = {name: kind for name, kind, *_ in FORMATS}


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for k, (_, _, magic, _, _) in enumerate(FORMATS):
        word = magic.decode("latin-1")
        out.add_word(word, [*out.get(word, []), k])
    out.make_automaton()
    return out


_FIND = _automaton()
#: Bytes searched at a time.
_SLICE = 1 << 20


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """All valid media in data: (name, offset, length), by offset, none within one of the same kind
    of signature that has been found before it (the pages of an Ogg stream, say)."""
    found: list[tuple[str, int, int]] = []
    ends: dict[str, int] = {}
    longest = max(len(m) for _, _, m, _, _ in FORMATS)
    for low in range(0, len(data), _SLICE):
        part = data[max(0, low - longest + 1) : low + _SLICE]
        base = max(0, low - longest + 1)
        for last, which in _FIND.iter(part.decode("latin-1")):
            for k in which:
                name, _, magic, before, valid = FORMATS[k]
                stop = base + last + 1
                at = stop - len(magic) - before
                if at < 0 or (low and stop <= low) or at < ends.get(name, 0):
                    continue
                if n := valid(data, at):
                    found.append((name, at, n))
                    ends[name] = at + n
    return sorted(found, key=lambda x: (x[1], -x[2]))


def describe(data: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """(media type, embedded): the type of data, application/octet-stream if no signature at its
    start holds, and what valid media it holds further in."""
    found = sniff(data)
    own = next((x for x in found if x[1] == 0), None)
    rest = [x for x in found if x is not own]
    return (TYPES[own[0]] if own else "application/octet-stream"), rest


def inspect(rows: DataFrame, *, media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """rows with media_type, corrected (whether declared_col says otherwise) and embedded, an array
    of (media_type, offset, length). A null value has null results, an empty one the unknown type.

    New columns replace older ones of their names.
    """
    tune(rows.sparkSession)
    rest = [c for c in rows.columns if c not in ("media_type", "corrected", "embedded")]
    base = rows.select(*[F.col(f"`{c}`") for c in rest])
    at = rest.index(media_col)
    part = pa.struct([("media_type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, inner = [], []
            for x in b.column(at):
                kind, found = describe(x.as_py()) if x.is_valid else (None, None)
                kinds.append(kind)
                inner.append(None if found is None else [(TYPES[n], o, k) for n, o, k in found])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kinds, pa.string()), pa.array(inner, pa.list_(part))], names=[*rest, "media_type", "embedded"])

    inner_type = T.ArrayType(T.StructType().add("media_type", "string").add("offset", "long").add("length", "long"))
    schema = T.StructType([*base.schema.fields]).add("media_type", "string").add("embedded", inner_type)
    return base.mapInArrow(run, schema).withColumn("corrected", ~F.col("media_type").eqNullSafe(F.col(declared_col)))


def carve(rows: DataFrame, *, media_col: str = "media") -> DataFrame:
    """One row per embedded value of inspected rows: their columns but media, and media_type, offset, media."""
    item = rows.withColumn("__e", F.explode("embedded"))
    cut = F.expr(f"substring(`{media_col}`, cast(__e.offset + 1 as int), cast(__e.length as int))")
    others = [F.col(f"`{c}`") for c in rows.columns if c not in (media_col, "embedded", "media_type", "corrected", "offset")]
    return item.select(*others, F.col("__e.media_type").alias("media_type"), F.col("__e.offset").alias("offset"), cut.alias(media_col))


# --- bytes as sound --------------------------------------------------------------------------


def pad(raw: bytes) -> bytes:
    """raw with zeros to a positive multiple of PAD bytes."""
    return raw + b"\0" * (-len(raw) % PAD or (PAD if not raw else 0))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file whose 8-bit samples are the bytes of payload."""
    odd = len(payload) & 1
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload + b"\0" * odd


def from_wav(data: bytes) -> bytes:
    """The samples of a mono 8-bit PCM WAV file."""
    if not _wav(data, 0):
        raise ValueError("not a whole WAV file")
    at, kind = 12, None
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"fmt ":
            kind = struct.unpack_from("<HHIIHH", data, at + 8)
        if name == b"data":
            if kind is None or kind[0] != 1 or kind[1] != 1 or kind[5] != 8:
                raise ValueError("not mono 8-bit PCM")
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, declared, media): every text in UTF-8, padded, as a WAV file, under an unknown declared type."""
    tune(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 200):
                c = b.slice(low, 200)
                raw = [x or b"" for x in pc.cast(c.column(1), pa.binary()).to_pylist()]
                cols = [c.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(["application/octet-stream"] * len(raw)), pa.array([to_wav(pad(x)) for x in raw], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n_bytes", "declared", "media"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, n_bytes long, declared string, media binary")


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, from its text stored as sound and read back.

    id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (the
    sniffed type and length and every embedded medium), media_type (sniffed), corrected (whether that
    is another than declared at storing, which knew none), carved (type, offset, length and SHA-256
    of every medium cut out). Null and empty texts are 64 zeros. Repeated rows and null ids each give a row; other columns are not looked at; an empty
    table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    stored = stage(store(docs, id_col=id_col, text_col=text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, cut = [], []
            for media, found_type, inner in zip(b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                data = media.as_py()
                cut.append([x | {"sha256": hashlib.sha256(data[x["offset"] : x["offset"] + x["length"]]).hexdigest()} for x in inner])
                payload = from_wav(data)
                text = ";".join([f"{found_type}+0:{len(data)}", *(f"{x['media_type']}+{x['offset']}:{x['length']}" for x in inner)])
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(data), hashlib.sha256(data).hexdigest(), text))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            names = ["i", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "corrected", "carved"]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols, b.column(3), b.column(5), pa.array(cut, carved)], names=names)

    carved = pa.list_(pa.struct([("media_type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("sha256", pa.string())]))
    seen = inspect(stored).select("id", "n_bytes", "media", "media_type", "embedded", "corrected")
    out = seen.mapInArrow(run, f"i {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, corrected boolean, carved array<struct<media_type:string,offset:long,length:long,sha256:string>>")
    return out.withColumnRenamed("i", id_col)
