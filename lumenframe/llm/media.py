"""Media columns: types told from the bytes themselves.

An Aho-Corasick automaton finds all magic bytes in one pass. A validator for each format then follows the structure from
there and returns its length, or nothing if the bytes only look like a header. So a wrong declared type is corrected, and
media that lie inside other data are carved out. The validators read headers and lengths only, never pixels or samples.

The same pass finds the end marks, so that no validator searches ahead; chains of blocks, which many headers may share, are
followed once. So time grows with the bytes, not with headers times bytes. Checksums alone (PNG, gzip) are made for each header.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 576
RATE = 8000


class Bytes:
    """A text's bytes, where its end marks are, and what chains of blocks have been followed to."""

    def __init__(self, b: bytes, marks: dict[bytes, list[int]]) -> None:
        self.b, self.marks, self.known = b, marks, defaultdict(dict)

    def next_mark(self, mark: bytes, at: int) -> int | None:
        places = self.marks.get(mark, ())
        k = bisect_left(places, at)
        return places[k] if k < len(places) else None

    def follow(self, chain: str, at: int, step: Callable[[bytes, int], tuple[bool, int | None]]) -> int | None:
        """Where the chain of blocks from ``at`` ends: ``step`` gives (False, the next block) or (True, the end or None)."""
        known, path, done = self.known[chain], [], False
        while not done and at not in known:
            path.append(at)
            done, at = step(self.b, at)
        end = at if done else known[at]
        known.update(dict.fromkeys(path, end))
        return end


def _wav(x: Bytes, at: int) -> int | None:
    b = x.b
    if at + 12 > len(b) or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    k, seen = at + 12, set()
    while k + 8 <= end:
        seen.add(b[k : k + 4])
        n = struct.unpack_from("<I", b, k + 4)[0]
        k += 8 + n + n % 2
    return end - at if k == end and {b"fmt ", b"data"} <= seen else None


def _png_chunk(b: bytes, k: int) -> tuple[bool, int | None]:
    if k + 12 > len(b):
        return True, None
    n = struct.unpack_from(">I", b, k)[0]
    if k + 12 + n > len(b) or zlib.crc32(memoryview(b)[k + 4 : k + 8 + n]) != struct.unpack_from(">I", b, k + 8 + n)[0]:
        return True, None
    return b[k + 4 : k + 8] == b"IEND", k + 12 + n


def _png(x: Bytes, at: int) -> int | None:
    if x.b[at + 8 : at + 16] != b"\0\0\0\x0dIHDR":
        return None
    end = x.follow("png", at + 8, _png_chunk)
    return end and end - at


def _gif_data(b: bytes, k: int) -> tuple[bool, int | None]:
    """Past the next run of data blocks; each says its length."""
    if k >= len(b):
        return True, None
    return (True, k + 1) if not b[k] else (False, k + b[k] + 1)


def _gif(x: Bytes, at: int) -> int | None:
    if at + 13 > len(x.b):
        return None

    def block(b: bytes, k: int) -> tuple[bool, int | None]:
        if k >= len(b):
            return True, None
        if b[k] == 0x3B:
            return True, k + 1
        if b[k] == 0x21:
            k += 2
        elif b[k] == 0x2C and k + 10 <= len(b):
            k += 10 + (3 << (b[k + 9] & 7) + 1 if b[k + 9] & 128 else 0) + 1
        else:
            return True, None
        k = x.follow("gif data", k, _gif_data)
        return k is None, k

    end = x.follow("gif", at + 13 + (3 << (x.b[at + 10] & 7) + 1 if x.b[at + 10] & 128 else 0), block)
    return end and end - at


def _bmp(x: Bytes, at: int) -> int | None:
    b = x.b
    if at + 26 > len(b):
        return None
    size, zero, start, head = struct.unpack_from("<IIII", b, at + 2)
    return size if not zero and head in (12, 40, 108, 124) and 14 + head <= start < size <= len(b) - at else None


def _jpeg_segment(b: bytes, k: int) -> tuple[bool, int | None]:
    if k + 4 > len(b) or b[k] != 0xFF or not 0xC0 <= b[k + 1] <= 0xFE:
        return True, None
    return (True, k) if b[k + 1] == 0xDA else (False, k + 2 + max(2, struct.unpack_from(">H", b, k + 2)[0]))


def _jpeg(x: Bytes, at: int) -> int | None:
    scan = x.follow("jpeg", at + 2, _jpeg_segment)
    end = None if scan is None else x.next_mark(b"\xff\xd9", scan)
    return None if end is None else end + 2 - at


def _pdf(x: Bytes, at: int) -> int | None:
    end, table = x.next_mark(b"%%EOF", at), x.next_mark(b"startxref", at)
    return end + 5 - at if x.b[at + 5 : at + 6].isdigit() and end is not None and table is not None and table < end else None


def _gzip(x: Bytes, at: int) -> int | None:
    b = x.b
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    d = zlib.decompressobj(31)
    try:
        for k in range(at, len(b), 1 << 16):
            rest = b[k : k + (1 << 16)]
            while rest and not d.eof:
                d.decompress(rest, 1 << 20)
                rest = d.unconsumed_tail
            if d.eof:
                return min(k + (1 << 16), len(b)) - len(d.unused_data) - at
    except zlib.error:
        pass
    return None


def _zip(x: Bytes, at: int) -> int | None:
    end = x.next_mark(b"PK\x05\x06", at)
    if end is None or end + 22 > len(x.b):
        return None
    size, start, note = struct.unpack_from("<IIH", x.b, end + 12)
    return end + 22 + note - at if start + size == end - at and end + 22 + note <= len(x.b) else None


def _flac_block(b: bytes, k: int) -> tuple[bool, int | None]:
    if k + 4 > len(b) or b[k] & 127 == 127:
        return True, None
    return b[k] >= 128, k + 4 + int.from_bytes(b[k + 1 : k + 4], "big")


def _flac(x: Bytes, at: int) -> int | None:
    """Its header blocks, and the frames behind them up to the next such file: a frame's length is not told by its header."""
    b = x.b
    if b[at + 4 : at + 5] not in (b"\0", b"\x80") or b[at + 5 : at + 8] != b"\0\0\x22":
        return None
    frames = x.follow("flac", at + 4, _flac_block)
    if frames is None or b[frames : frames + 1] != b"\xff" or b[frames + 1 : frames + 2] not in (b"\xf8", b"\xf9"):
        return None
    after = x.next_mark(b"fLaC", frames)
    return (len(b) if after is None else after) - at


#: Magic bytes, media type, validator.
FORMATS: list[tuple[bytes, str, Callable[[Bytes, int], int | None]]] = [
    (b"RIFF", "audio/wav", _wav),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"BM", "image/bmp", _bmp),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"%PDF-", "application/pdf", _pdf),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"fLaC", "audio/flac", _flac),
]
#: End marks, and what begins the next of a kind.
MARKS = [b"\xff\xd9", b"%%EOF", b"startxref", b"PK\x05\x06", b"fLaC"]
_automaton = ahocorasick.Automaton()
for _word in {m for m, _, _ in FORMATS} | set(MARKS):
    _automaton.add_word(_word.decode("latin-1"), _word)
_automaton.make_automaton()
_checks = {magic: (kind, check) for magic, kind, check in FORMATS}


def sniff(b: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of all confirmed media, by offset, of equal ones the longest first; media inside others are told too."""
    marks, heads = defaultdict(list), []
    for end, word in _automaton.iter(b.decode("latin-1")):
        at = end + 1 - len(word)
        if word in MARKS:
            marks[word].append(at)
        if word in _checks:
            heads.append((at, word))
    x, out = Bytes(b, marks), []
    for at, word in heads:
        kind, check = _checks[word]
        if (length := check(x, at)) is not None:
            out.append((at, length, kind))
    return sorted(out, key=lambda m: (m[0], -m[1]))


def to_wav(payload: bytes) -> bytes:
    """Bytes as unsigned 8-bit samples of one channel; the payload's length is even."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def wav_samples(b: bytes, at: int, length: int) -> bytes:
    k = at + 12
    while k < at + length:
        n = struct.unpack_from("<I", b, k + 4)[0]
        if b[k : k + 4] == b"data":
            return b[k + 8 : k + 8 + n]
        k += 8 + n + n % 2
    raise ValueError("no samples")


def feature(payload: bytes, media: list[tuple[int, int, str]]) -> str:
    """Kind and place of each medium, then mean, root mean square, sign changes and the 8 shares of a coarse histogram of the samples."""
    x = np.frombuffer(payload, dtype=np.uint8)
    counts = np.bincount(x, minlength=256)
    levels = np.arange(256)
    mean = int((counts * levels).sum()) / len(x)
    power = int((counts * (levels - 128) ** 2).sum()) / len(x)
    loud = x >= 128
    shares = counts.reshape(8, 32).sum(axis=1)
    turns = int((loud[1:] != loud[:-1]).sum())
    return "|".join([",".join(f"{k}@{a}+{n}" for a, n, k in media), f"{mean:.6f}", f"{power**0.5:.6f}", str(turns), ",".join(map(str, shares))])


def type_media(rows: DataFrame, content: str, declared: str | None = None) -> DataFrame:
    """``rows`` with ``media_type`` (by the bytes at the start; else the declared one), ``type_corrected`` and ``media``, the carved list.

    Null or empty bytes carry no media; very long ones are looked through whole, in time that grows with them; rows that
    repeat are told alike; an empty table gives none. Columns of these names are replaced, others pass through, whatever
    their names.
    """
    rows = rows.drop("media_type", "media", "type_corrected")

    @F.pandas_udf("struct<kind:string,media:array<struct<at:long,length:long,type:string>>>")
    def told(b: pd.Series) -> pd.DataFrame:
        found = [sniff(x or b"") for x in b]
        return pd.DataFrame({"kind": [next((k for a, n, k in m if a == 0), None) for m in found], "media": [[{"at": a, "length": n, "type": k} for a, n, k in m] for m in found]})

    said = F.col(declared) if declared else F.lit(None).cast("string")
    out = rows.select(F.struct("*").alias("row"), said.alias("said"), told(F.col(content)).alias("told"))
    corrected = F.coalesce(F.col("told.kind") != F.col("said"), F.lit(False))
    return out.select("row.*", F.coalesce("told.kind", "said").alias("media_type"), corrected.alias("type_corrected"), F.col("told.media").alias("media"))


def _store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        raw = [(t or "").encode("utf-8") for t in batch["text"]]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": [len(x) for x in raw], "stored": [to_wav(x + b"\xff" * (max(1, -(-len(x) // UNIT)) * UNIT - len(x))) for x in raw]})


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id (as text), n_bytes and stored: each text padded with bytes 255 to whole units, as sound."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(_store, "doc_id string, n_bytes long, stored binary")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for stored, found in zip(batch["stored"], batch["media"], strict=True):
            media = [(int(m["at"]), int(m["length"]), m["type"]) for m in found]
            at, length, _ = next(m for m in media if m[2] == "audio/wav" and m[0] == 0)
            back = wav_samples(stored, at, length)
            rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(back, media)))
        out = pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
        yield pd.concat([batch[["doc_id", "n_bytes"]].reset_index(drop=True), out, batch[["media_type", "type_corrected"]].reset_index(drop=True)], axis=1)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: its text stored as sound under the wrong type, found and typed by its bytes and read back.

    A null text counts as empty; very long ones are stored whole; rows that repeat give equal rows; an empty table gives
    none. Further columns are not read, whatever their names.
    """
    typed = type_media(store_texts(docs).withColumn("declared", F.lit("text/plain")), "stored", "declared")
    schema = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, type_corrected boolean"
    return typed.drop("declared").mapInPandas(_read, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
