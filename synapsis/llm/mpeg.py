"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums, exact durations and seek offsets.

`parse` reads any MPEG-1/2/2.5 stream of layers I to III. `store` keeps arbitrary bytes losslessly in such a stream:
Layer III frames whose side information is all zero (silence) and whose main data are ancillary bytes.
"""

from __future__ import annotations

import contextlib
import hashlib
import re
import struct
import zlib
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_binary, map_rows

# Fixed values of the format: kbit/s by (version 1, layer), then (versions 2 and 2.5, layer); Hz; samples a frame.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}


@lru_cache(4096)
def header(word: int) -> tuple | None:
    """(version bits, layer, checked, bytes, Hz, samples, channels, bytes of side information), or None."""
    version, layer, protection = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 16 & 1
    rate_at, index, mode = word >> 10 & 3, word >> 12 & 15, word >> 6 & 3
    if word >> 21 != 0x7FF or version == 1 or layer == 4 or rate_at == 3 or index in (0, 15) or word & 3 == 2:
        return None
    family = 1 if version == 3 else 2
    rate, bits, pad = RATES[version][rate_at], BITRATES[family, layer][index] * 1000, word >> 9 & 1
    samples, channels = SAMPLES[family, layer], 1 if mode == 3 else 2
    size = (12 * bits // rate + pad) * 4 if layer == 1 else samples // 8 * bits // rate + pad
    side = (32 if channels == 2 else 17) if family == 1 else (17 if channels == 2 else 9)
    return version, layer, not protection, size, rate, samples, channels, side if layer == 3 else 0


@lru_cache(4096)
def crc16(data: bytes, bits: int | None = None) -> int:
    """CRC of polynomial 0x8005 from 0xFFFF over ``data``, or its first ``bits`` bits, as frames carry it."""
    crc, left = 0xFFFF, 8 * len(data) if bits is None else bits
    for byte in data:
        for k in range(7, 7 - min(8, left), -1):
            crc = (crc << 1 ^ (0x8005 if (crc >> 15 ^ byte >> k) & 1 else 0)) & 0xFFFF
        left -= 8
        if left <= 0:
            break
    return crc


# Fixed values of the format, Layer II: bits of a subband's allocation as (subbands, bits), lowest subband first.
ALLOCATION = {"low": ((2, 4), (10, 3)), "high": ((11, 4), (12, 3), (7, 2)), "lsf": ((4, 4), (7, 3), (19, 2))}


def _protected(frame: bytes, word: int, h: tuple) -> tuple[bytes, int] | None:
    """(bytes, bits) that the checksum of a frame covers, header first; None if the frame ends before."""
    version, layer, _, _, rate, _, channels, side = h
    if layer == 3:
        return (frame[2:4] + frame[6 : 6 + side], 16 + 8 * side) if len(frame) >= 6 + side else None
    joint, body = word >> 6 & 3 == 1, frame[6:]
    bound = 4 * (word >> 4 & 3) + 4 if joint else 32
    if layer == 1:
        bits = 4 * (32 + min(bound, 32) if channels == 2 else 32)
        return (frame[2:4] + body, 16 + bits) if 8 * len(body) >= bits else None
    if version != 3:
        table, bands = "lsf", 30
    else:
        each = BITRATES[1, 2][word >> 12 & 15] // channels
        table = "low" if each < 56 else "high"
        bands = (12 if rate == 32000 else 8) if each < 56 else 30 if each >= 96 and rate != 48000 else 27
    widths = [w for n, w in ALLOCATION[table] for _ in range(n)][:bands]
    bits, at, number, size = 0, 0, int.from_bytes(body[:64]), 8 * len(body[:64])
    for band, w in enumerate(widths):
        for _ in range(channels if band < bound else 1):
            at += w
            if at > size:
                return None
            if number >> size - at & (1 << w) - 1:  # two bits of scale-factor selection for each channel in use
                bits += 2 * (1 if band < bound else channels)
    return (frame[2:4] + body, 16 + at + bits) if 8 * len(body) >= at + bits else None


def _holds(frame: bytes, word: int, h: tuple) -> bool:
    """Whether the checksum of a protected frame fits what it covers."""
    part = _protected(frame, word, h)
    return part is not None and crc16(part[0][: -(-part[1] // 8)], part[1]) == int.from_bytes(frame[4:6])


def _synchsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _id3v2(raw: bytes, at: int) -> tuple[int, list[tuple[str, bytes]]] | None:
    """(end, frames) of the tag at ``at``."""
    head = raw[at : at + 10]
    if len(head) < 10 or head[:3] != b"ID3" or head[3] not in (3, 4) or max(head[6:10]) > 127:
        return None
    end, frames, x = at + 10 + _synchsafe(head[6:10]), [], at + 10
    while x + 10 <= min(end, len(raw)) and raw[x]:
        size = _synchsafe(raw[x + 4 : x + 8]) if head[3] == 4 else int.from_bytes(raw[x + 4 : x + 8])
        frames.append((raw[x : x + 4].decode("latin-1"), raw[x + 10 : x + 10 + size]))
        x += 10 + size
    return min(end, len(raw)), frames


def _vbr(frame: bytes, side: int) -> dict | None:
    """The table of a first frame: Xing/Info behind the side information, VBRI at a fixed place."""
    for at in (4 + side, 6 + side):
        if frame[at : at + 4] in (b"Xing", b"Info"):
            flags, x, out = int.from_bytes(frame[at + 4 : at + 8]), at + 8, {"kind": frame[at : at + 4].decode()}
            for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100)):
                if flags & bit:
                    part = frame[x : x + size]
                    out[name], x = (list(part) if name == "toc" else int.from_bytes(part)), x + size
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        _, _, _, size, frames, entries, scale, width, per = struct.unpack(">HHHIIHHHH", frame[40:62])
        entries = min(entries, (len(frame) - 62) // width) if width else 0  # those that the frame holds
        toc = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width]) * scale for i in range(entries)]
        return {"kind": "VBRI", "bytes": size, "frames": frames, "toc": toc, "frames_per_entry": per}
    return None


#: Where a frame or a tag may begin: four bytes that make a valid header, or an ID3 tag of a known version.
SYNC = re.compile(
    b"\xff[" + bytes(0xE0 | v << 3 | x for v in (0, 2, 3) for x in range(2, 8)).replace(b"\\", b"\\\\") + b"]["
    + b"".join(b"\\x%02x-\\x%02x" % (i << 4, i << 4 | 11) for i in range(1, 15)) + b"][\\x00-\\xff]|ID3[\\x03\\x04]", re.S,
)


def parse(raw: bytes) -> dict:
    """Everything about a stream.

    tags; vbr (table or None); frames: (offset, bytes, checked, checksum holds) of each audio frame; skipped bytes that
    belong to no frame or tag (a checksum that is not there holds); samples and rate; duration, an exact Fraction of seconds over all frames. A header
    counts where the frame it announces is followed by another header of the same version, layer and rate, a tag, or
    the end; else the search goes on at the next byte. Empty input has no frames.
    """
    out = {"tags": {}, "vbr": None, "frames": [], "skipped": 0, "samples": 0, "rate": 0, "channels": 0, "layer": 0, "duration": Fraction(0)}
    at, last, n = 0, None, len(raw)

    def fits(x: int, like: tuple | None) -> tuple | None:
        h = header(int.from_bytes(raw[x : x + 4])) if x + 4 <= n else None
        return h if h and x + h[3] <= n and (like is None or (h[0], h[1], h[4]) == (like[0], like[1], like[4])) else None

    while at < n:
        if raw[at] == 0x49 and (tag := _id3v2(raw, at)):
            for name, body in tag[1]:
                out["tags"].setdefault(name, []).append(body)
            at, last = tag[0], None
            continue
        if raw[at] == 0x54 and at == n - 128 and raw[at : at + 3] == b"TAG":
            out["tags"]["TAG"] = [raw[at:]]
            break
        h = fits(at, last) if raw[at] == 0xFF else None
        if h:
            end = at + h[3]
            if not (last or end == n or fits(end, h) or raw[end : end + 3] in (b"ID3", b"TAG")):
                h = None
        if not h:
            # resynchronise at the next header or tag: every byte is looked at once
            found, end_tag = SYNC.search(raw, at + 1), n - 128 if n - 128 > at and raw[n - 128 : n - 125] == b"TAG" else n
            nxt = min(found.start() if found else n, end_tag)
            out["skipped"] += nxt - at
            at, last = nxt, None
            continue
        good = not h[2] or _holds(raw[at:end], int.from_bytes(raw[at : at + 4]), h)
        table = None if out["frames"] or out["vbr"] or h[1] != 3 else _vbr(raw[at:end], h[7])
        if table:
            out["vbr"] = table
        else:
            out["frames"].append((at, h[3], h[2], good))
            out["samples"] += h[5]
            out["duration"] += Fraction(h[5], h[4])
        out["rate"], out["channels"], out["layer"] = h[4], h[6], h[1]
        at, last = end, h
    return out


RATE, PRIVATE = 32000, b"synapsis.payload"
#: Bytes of a protected mono Layer III frame at 32 kHz by bitrate index: those of 32 kHz need no padding.
SIZES = {i: 144 * k * 1000 // RATE for i, k in enumerate(BITRATES[1, 3]) if i}
HEAD = 4 + 2 + 17


@lru_cache(16)
def _head(index: int) -> bytes:
    """Header, checksum and silent side information: MPEG-1 Layer III, protected, 32 kHz, mono."""
    first = bytes([0xFF, 0xFA, index << 4 | 2 << 2, 0xC0])
    side = bytes(17)
    return first + crc16(first[2:] + side).to_bytes(2) + side


def store(payload: bytes) -> bytes:
    """An MPEG stream with ``payload`` in its ancillary bytes: tag (length and checksum), Xing table, frames."""
    room = {i: s - HEAD for i, s in SIZES.items()}
    frames, at = [], 0
    while at < len(payload):
        left = len(payload) - at
        index = next((i for i in room if room[i] >= left), max(room))
        part = payload[at : at + room[index]]
        frames.append(_head(index) + part.ljust(room[index], b"\0"))
        at += len(part)
    total, seek, offset = SIZES[5] + sum(map(len, frames)), [], SIZES[5]
    for f in frames:
        seek.append(offset)
        offset += len(f)
    toc = bytes(min(255, 256 * seek[k * len(seek) // 100] // total) if seek else 0 for k in range(100))
    xing = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    body = PRIVATE + b"\0" + struct.pack(">QI", len(payload), zlib.crc32(payload))
    frame = b"PRIV" + len(body).to_bytes(4) + b"\0\0" + body
    tag = b"ID3\x03\0\0" + bytes(len(frame) >> s & 127 for s in (21, 14, 7, 0)) + frame
    return tag + (_head(5) + xing).ljust(SIZES[5], b"\0") + b"".join(frames)


def load(raw: bytes, info: dict | None = None) -> bytes:
    """The payload that `store` put in; ValueError if the stream or its checksum is damaged."""
    info = info or parse(raw)
    own = [b for b in info["tags"].get("PRIV", []) if b.startswith(PRIVATE + b"\0")]
    if not own:
        raise ValueError("no payload in this stream")
    if len(own[0]) != len(PRIVATE) + 13:
        raise ValueError("the payload's tag is damaged")
    size, crc = struct.unpack(">QI", own[0][len(PRIVATE) + 1 :])
    payload = b"".join(raw[x + HEAD : x + n] for x, n, _, _ in info["frames"])[:size]
    if len(payload) != size or zlib.crc32(payload) != crc:
        raise ValueError("payload is damaged")
    return payload


INFO_SQL = "duration_num bigint, duration_den bigint, samples bigint, rate int, channels int, layer int, n_frames bigint, n_bad_crc bigint, skipped bigint, vbr string, tags array<string>, frame_offsets array<bigint>"
INFO = pa.schema([("duration_num", pa.int64()), ("duration_den", pa.int64()), ("samples", pa.int64()), ("rate", pa.int32()), ("channels", pa.int32()), ("layer", pa.int32()), ("n_frames", pa.int64()), ("n_bad_crc", pa.int64()), ("skipped", pa.int64()), ("vbr", pa.string()), ("tags", pa.list_(pa.string())), ("frame_offsets", pa.list_(pa.int64()))])


def _columns(infos: list[dict]) -> list[pa.Array]:
    rows = [
        (i["duration"].numerator, i["duration"].denominator, i["samples"], i["rate"], i["channels"], i["layer"], len(i["frames"]), sum(not f[3] for f in i["frames"]), i["skipped"],
         i["vbr"]["kind"] if i["vbr"] else None, sorted(i["tags"]), [f[0] for f in i["frames"]])
        for i in infos
    ]
    return [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(INFO)]


def media_columns(media: DataFrame, media_col: str = "media", keys: list[str] | None = None) -> DataFrame:
    """``keys`` (all other columns by default) and what `parse` finds in the stream of each row.

    Duration is exact: duration_num / duration_den seconds; frame_offsets has the byte offset of every audio frame.
    A null or empty stream has no frames and a duration of 0/1; bytes that are no stream are all skipped, and damaged
    ones never fail. Rows stand alone, so repeated rows give equal results, and an empty table gives an empty one. A
    key that has an output's name is left out.
    """
    keys = [c for c in (keys or [c for c in media.columns if c != media_col]) if c not in INFO.names]
    return map_rows(media, keys, as_binary(F.col(f"`{media_col}`")), INFO_SQL, lambda raws: _columns([parse(r) for r in raws]))


def payload(raw: bytes) -> bytes:
    """``raw`` with zero bytes up to a positive multiple of 64."""
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as an MPEG stream. Null is empty; equal texts give equal streams; each row stands alone."""
    def of(raws):
        return [pa.array([len(r) for r in raws], pa.int64()), pa.array([store(payload(r)) for r in raws], pa.binary())]

    return map_rows(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), ["doc_id"], as_binary(F.col("text")), "n_bytes bigint, media binary", of)


def _feature(i: dict) -> str:
    """What `parse` found, as one line."""
    vbr = f"{i['vbr']['kind']}:{i['vbr'].get('frames')}:{i['vbr'].get('bytes')}" if i["vbr"] else ""
    seek = zlib.crc32(struct.pack(f">{len(i['frames'])}Q", *(f[0] for f in i["frames"])))
    return (
        f"layer={i['layer']};rate={i['rate']};channels={i['channels']};frames={len(i['frames'])};samples={i['samples']};seconds={i['duration']};"
        f"bad_crc={sum(not f[3] for f in i['frames'])};skipped={i['skipped']};vbr={vbr};tags={','.join(sorted(i['tags']))};seek={seek:08x}"
    )


BACK = pa.schema([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def read_back(stored: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, then payload, media digests and features of each ``media``, all from the stored bytes.

    A null stream has nulls throughout; one that holds no whole payload of `store` has nulls for the payload. Rows
    stand alone, so repeated rows give equal results, and an empty table gives an empty one.
    """

    def one(raw: bytes | None) -> tuple:
        if raw is None:
            return (None,) * 6
        info, found = parse(raw), None
        with contextlib.suppress(ValueError):
            found = load(raw, info)
        own = (None,) * 3 if found is None else (len(found), hashlib.sha256(found).hexdigest(), zlib.crc32(found[-64:]))
        return (*own, len(raw), hashlib.sha256(raw).hexdigest(), _feature(info))

    def of(raws):
        rows = [one(r) for r in raws]
        return [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(BACK)]

    return map_rows(stored, keys, F.col("media"), "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string", of)
