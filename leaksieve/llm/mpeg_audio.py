"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums, exact durations and seek offsets.

``describe`` reads any MPEG-1/2/2.5 stream of layers I to III: it skips and parses an ID3v2 tag and an ID3v1 trailer,
looks for frame headers byte by byte wherever the stream is broken (a header counts if the next one agrees with it, or the
stream ends there), reads a Xing/Info or VBRI table and compares its count with the frames, verifies the CRC-16 of protected
frames (one of layer II that ends before its allocation bits do counts as unverified), and returns the exact duration as
samples over rate and the byte offset of every frame.

``store`` writes bytes losslessly as a variable-bitrate layer III stream: silent frames (an all-zero side information)
carry the bytes as ancillary data, the tag says how many they are, and every frame is protected.

Defined results: null or empty media, or bytes without a frame, give zero frames and an empty payload; a null text is
empty; repeated rows each give a row; other columns are ignored by the query and kept by the general functions.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaksieve.llm.tables import text_of

# Fixed values of the format: bitrates in kbit/s by index, for MPEG-1 layers I, II, III and MPEG-2 layers I, II and III.
_RATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_SAMPLE_RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
_VERSION = {0: 2.5, 2: 2, 3: 1}
_LAYER = {1: 3, 2: 2, 3: 1}


def crc16(data: bytes) -> int:
    """Polynomial 0x8005 from 0xFFFF, most significant bit first."""
    crc = 0xFFFF
    for byte in data:
        crc = (crc << 8 & 0xFFFF) ^ _crc_table()[crc >> 8 ^ byte]
    return crc


@functools.cache
def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = c << 1 & 0xFFFF ^ (0x8005 if c & 0x8000 else 0)
        table.append(c)
    return table


_protected = functools.lru_cache(maxsize=4096)(crc16)


@functools.lru_cache(maxsize=65536)
def header(word: int) -> tuple | None:
    """(version, layer, rate, samples, frame bytes, protected, side bytes, channels) of a 32-bit header, None if it isn't one."""
    version, layer = _VERSION.get(word >> 19 & 3), _LAYER.get(word >> 17 & 3)
    bitrate, rate, padding, mode = word >> 12 & 15, word >> 10 & 3, word >> 9 & 1, word >> 6 & 3
    if word >> 21 != 0x7FF or version is None or layer is None or bitrate in (0, 15) or rate == 3 or word & 3 == 2:
        return None
    hz = _SAMPLE_RATES[version][rate]
    bps = _RATES[1 if version == 1 else 2, layer][bitrate] * 1000
    channels = 1 if mode == 3 else 2
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    size = (12 * bps // hz + padding) * 4 if layer == 1 else samples // 8 * bps // hz + padding
    if layer == 3:
        side = (17 if channels == 1 else 32) if version == 1 else (9 if channels == 1 else 17)
    elif layer == 1:
        bound = 4 * ((word >> 4 & 3) + 1) if mode == 1 else 32
        side = (bound * channels + (32 - bound if channels == 2 else 0)) // 2 if channels == 2 else 16
    else:
        side = 0
    return version, layer, hz, samples, size, not word >> 16 & 1, side, channels


#: Fixed values of layer II: bits of a subband's allocation, as (bits, subbands) runs from the lowest, by table.
_ALLOCATION = {
    "27": ((4, 3), (4, 8), (3, 12), (2, 4)),
    "30": ((4, 3), (4, 8), (3, 12), (2, 7)),
    "8": ((4, 2), (3, 6)),
    "12": ((4, 2), (3, 10)),
    "low": ((4, 4), (3, 7), (2, 19)),
}


def _allocation_bits(word: int, hz: int, channels: int) -> list[int]:
    version, bitrate = _VERSION[word >> 19 & 3], word >> 12 & 15
    each = _RATES[1 if version == 1 else 2, 2][bitrate] // channels
    if version != 1:
        table = "low"
    elif each <= 48:
        table = "12" if hz == 32000 else "8"
    else:
        table = "27" if hz == 48000 or each <= 80 else "30"
    return [bits for bits, n in _ALLOCATION[table] for _ in range(n)]


def layer2_protected(frame: bytes, hz: int, channels: int) -> int | None:
    """Checksum of a layer II frame over its header's second half, allocation and selection bits; None where the frame ends before them."""
    word = int.from_bytes(frame[:4], "big")
    bound = 4 * ((word >> 4 & 3) + 1) if word >> 6 & 3 == 1 else 32
    bits, size, at = int.from_bytes(frame[6:], "big"), 8 * max(0, len(frame) - 6), 0
    used = 0
    for band, n in enumerate(_allocation_bits(word, hz, channels)):
        own = channels if band < bound else 1
        for _ in range(own):
            if at + n > size:
                return None
            used += (bits >> (size - at - n) & ((1 << n) - 1) > 0) * (channels if own < channels else 1)
            at += n
    at += 2 * used
    if at > size:
        return None
    value, c = (word & 0xFFFF) << at | bits >> (size - at), 0xFFFF
    for k in range(at + 15, -1, -1):
        c = c << 1 & 0xFFFF ^ (0x8005 if (c >> 15) ^ (value >> k & 1) else 0)
    return c


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _unsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def id3v2(data: bytes, at: int = 0) -> tuple[int, dict[str, str]]:
    """Bytes of the tag at this place (0: none), and its text frames; user text is keyed by its description."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10:
        return 0, {}
    major, flags, end = data[at + 3], data[at + 5], at + 10 + _unsafe(data[at + 6 : at + 10])
    body, tags = data[at + 10 : end], {}
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    p = (_unsafe(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4], "big")) if flags & 0x40 and len(body) > 4 else 0
    width = 3 if major == 2 else 4
    while p + 10 <= len(body) and body[p] != 0:
        name = body[p : p + width].decode("latin-1")
        raw = body[p + width : p + 2 * width]
        size = _unsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        p += 6 if major == 2 else 10
        value = body[p : p + size]
        p += size
        if name.startswith("T") and value:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(value[0], "latin-1")
            fields = value[1:].decode(code, "replace").rstrip("\0").split("\0")
            tags[fields[0] if name in ("TXXX", "TXX") and len(fields) > 1 else name] = fields[-1]
    return end - at + (10 if flags & 0x10 else 0), tags


_SYNC = re.compile(rb"\xff[\xe0-\xff]")


def _agrees(data: bytes, at: int, end: int, h: tuple) -> bool:
    """Whether the frame at this place is followed by a like one or by the end."""
    after = at + h[4]
    if after >= end:
        return after == end
    n = header(int.from_bytes(data[after : after + 4], "big")) if after + 4 <= end else None
    return n is not None and n[:3] == h[:3]


def describe(data: bytes) -> dict:
    """What a stream holds. frames: offsets of all audio frames; payload: their ancillary bytes behind side information."""
    out = {"frames": [], "samples": 0, "rate": 0, "resyncs": 0, "skipped": 0, "crc_ok": 0, "crc_bad": 0, "crc_unverified": 0, "unprotected": 0, "vbr": None, "table_agrees": None, "tags": {}, "version": None, "layer": None, "channels": 0, "duration": Fraction(0), "payload": b""}
    at, out["tags"] = id3v2(data)
    end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, n in (("title", 3, 30), ("artist", 33, 30), ("album", 63, 30), ("year", 93, 4)):
            if value := data[end + a : end + a + n].split(b"\0")[0].decode("latin-1").strip():
                out["tags"].setdefault(name, value)
    body, known, locked = [], None, False
    while at + 4 <= end:
        h = header(int.from_bytes(data[at : at + 4], "big"))
        if h is None or known is not None and h[:3] != known[:3] or at + h[4] > end or not locked and not _agrees(data, at, end, h):
            start = at
            m = _SYNC.search(data, at + 1, end)
            at = m.start() if m else end
            out["skipped"] += at - start
            out["resyncs"] += locked or start == 0 or known is None and not out["resyncs"]
            locked = False
            continue
        version, layer, hz, samples, size, protected, side, channels = h
        locked, skip = True, 4 + 2 * protected
        if known is None:
            known = h
            out |= {"version": version, "layer": layer, "rate": hz, "channels": channels}
        if not protected:
            out["unprotected"] += 1
        elif layer == 2 and (crc := layer2_protected(data[at : at + size], hz, channels)) is None:
            out["crc_unverified"] += 1
        else:
            good = (crc if layer == 2 else _protected(data[at + 2 : at + 4] + data[at + 6 : at + 6 + side])) == data[at + 4] << 8 | data[at + 5]
            out["crc_ok" if good else "crc_bad"] += 1
        if not out["frames"] and out["vbr"] is None and (vbr := _vbr(data[at : at + size], skip + side)):
            out["vbr"] = vbr
        else:
            out["frames"].append(at)
            out["samples"] += samples
            body.append(data[at + skip + side : at + size])
        at += size
    if out["rate"]:
        out["duration"] = Fraction(out["samples"], out["rate"])
    if out["vbr"]:
        out["table_agrees"] = out["vbr"].get("frames", len(out["frames"])) == len(out["frames"])
    payload = b"".join(body)
    stated = out["tags"].get("PAYLOAD_BYTES", "")
    out["payload"] = payload[: int(stated)] if re.fullmatch("[0-9]{1,18}", stated) else payload
    return out


def _vbr(frame: bytes, at: int) -> dict | None:
    """A Xing/Info or VBRI table: the frames and bytes it states, and its table of contents."""
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, p, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"kind": frame[at : at + 4].decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(frame[p : p + 4], "big")
                p += 4
        if flags & 4:
            out["toc"] = list(frame[p : p + 100])
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        n_bytes, n_frames, entries, scale, width = struct.unpack(">IIHHH", frame[46:60])
        toc = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(entries)]
        return {"kind": "VBRI", "frames": n_frames, "bytes": n_bytes, "toc": toc}
    return None


@functools.cache
def _frames_of(rate_index: int) -> tuple[tuple[int, bytes], ...]:
    """(capacity, head) of the protected mono layer III frames at this sample rate, smallest first; head ends with the side information."""
    out = []
    for b in range(1, 15):
        word = 0xFFFA0000 | b << 12 | rate_index << 10 | 3 << 6
        size, side = header(word)[4], bytes(17)
        raw = word.to_bytes(4, "big")
        out.append((size - 23, raw + crc16(raw[2:] + side).to_bytes(2, "big") + side))
    return tuple(out)


def store(payload: bytes, rate_index: int = 2) -> bytes:
    """The bytes as ancillary data of a variable-bitrate stream with an ID3v2 tag, a Xing table and an ID3v1 trailer."""
    kinds = _frames_of(rate_index)
    most, head = kinds[-1]
    frames, whole = [], len(payload) - len(payload) % most
    for at in range(0, whole, most):
        frames.append(head + payload[at : at + most])
    if whole < len(payload) or not frames:
        rest = payload[whole:]
        size, first = next(k for k in kinds if k[0] >= len(rest))
        frames.append(first + rest.ljust(size, b"\0"))
    space, first = next(k for k in kinds if k[0] >= 120)
    ends = np.cumsum([len(first) + space, *map(len, frames)])
    toc = bytes(min(255, int(256 * ends[min(len(frames) * i // 100, len(frames))] // ends[-1])) for i in range(100))
    xing = b"Xing" + struct.pack(">III", 7, len(frames), int(ends[-1])) + toc
    text = b"\x03PAYLOAD_BYTES\0" + str(len(payload)).encode()
    tag = b"TXXX" + _syncsafe(len(text)) + b"\0\0" + text
    return b"".join([b"ID3\x04\0\0", _syncsafe(len(tag)), tag, first, xing.ljust(space, b"\0"), *frames, b"TAG".ljust(128, b"\0")])


FEATURES = "n_frames long, samples long, rate int, seconds double, vbr string, table_agrees boolean, crc_ok long, crc_bad long, resyncs long, skipped long, tags map<string,string>, seek array<long>, payload binary"


def with_audio_columns(df: DataFrame, media: str, name: str = "audio") -> DataFrame:
    """Adds a struct with frame counts, exact samples and rate, seconds, checks, tags, seek offsets and the payload."""

    @F.arrow_udf(FEATURES_TYPE(FEATURES))
    def read(column: pa.Array) -> pa.Array:
        rows = []
        for data in column.to_pylist():
            d = describe(data or b"")
            rows.append({"n_frames": len(d["frames"]), "samples": d["samples"], "rate": d["rate"], "seconds": float(d["duration"]), "vbr": d["vbr"] and d["vbr"]["kind"], "table_agrees": d["table_agrees"], "crc_ok": d["crc_ok"], "crc_bad": d["crc_bad"], "resyncs": d["resyncs"], "skipped": d["skipped"], "tags": list(d["tags"].items()), "seek": d["frames"], "payload": d["payload"]})
        return pa.array(rows, _ARROW)

    return df.withColumn(name, read(F.col(media)))


def FEATURES_TYPE(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


_ARROW = pa.struct([("n_frames", pa.int64()), ("samples", pa.int64()), ("rate", pa.int32()), ("seconds", pa.float64()), ("vbr", pa.string()), ("table_agrees", pa.bool_()), ("crc_ok", pa.int64()), ("crc_bad", pa.int64()), ("resyncs", pa.int64()), ("skipped", pa.int64()), ("tags", pa.map_(pa.string(), pa.string())), ("seek", pa.list_(pa.int64())), ("payload", pa.binary())])


def with_media(df: DataFrame, payload: str, name: str = "media") -> DataFrame:
    """Adds the bytes of a binary column as an MPEG audio stream."""

    @F.arrow_udf("binary")
    def write(column: pa.Array) -> pa.Array:
        return pa.array([store(p or b"") for p in column.to_pylist()], pa.binary())

    return df.withColumn(name, write(F.col(payload)))


def _round_trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
            media = store(text.ljust(max(64, -(-len(text) // 64) * 64), b"\0"))
            d = describe(media)
            seek = zlib.crc32(np.array(d["frames"], "<i8").tobytes())
            feature = f"layer={d['layer']};frames={len(d['frames'])};samples={d['samples']}/{d['rate']};table={d['vbr']['frames']};crc_ok={d['crc_ok']};crc_bad={d['crc_bad']};skipped={d['skipped']};seek={seek:08x}"
            rows.append((doc_id, len(text), len(d["payload"]), hashlib.sha256(d["payload"]).hexdigest(), zlib.crc32(d["payload"][-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def media_digests(df: DataFrame) -> DataFrame:
    """Stores every whole text as audio, reads it back, and returns sizes, digests and features."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return df.select(F.col("doc_id").cast("long"), text_of(df).alias("text")).mapInArrow(_round_trip, schema)
