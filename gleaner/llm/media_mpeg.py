"""MPEG audio as a media column: write, resynchronise, verify and index Layer III streams.

``encode`` stores payload bytes losslessly as the ancillary bytes of silent MPEG-1 Layer III
frames (each granule's part2_3_length is 0, so no decoder reads them as audio), behind an ID3v2 tag
and an Info frame with a variable-bitrate table.  ``parse`` reads any stream: it skips tags,
resynchronises on frame headers (a header counts when it stands where the frame before ends, or its CRC is
right, or the next one stands where it must, or the stream ends there), checks each frame's CRC-16 (of all three layers), reads Xing/Info and VBRI tables, and returns exact
durations (without the encoder's delay and padding, where a stream states them) and seek offsets.
Tags are ID3v2.2, 2.3 and 2.4 (text frames of any encoding, unsynchronised, compressed or grouped), ID3v1 and APEv2.

Defined cases: null payload is the empty payload; an empty stream or one without any frame has 0
frames and duration 0; bytes between frames are counted as ``skipped``; a frame cut off at the end
is not counted; a stream that is not ours has no payload sizes (0) and fails no read; a damaged or
encrypted tag frame is left out; repeated rows are stored and read alike; an empty table gives an empty
result; columns but id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import small_batches, text_of, tidy

# Fixed values of ISO/IEC 11172-3 and 13818-3: bit rates in kbit/s and sample rates in Hz by header index.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Our streams: MPEG-1 Layer III, mono, 32 kHz, CRC on.  Header, CRC and side information take 23 bytes.
RATE, SAMPLES, HEAD = 32000, 1152, 4 + 2 + 17
TOC_ENTRIES = 100


def _crc_table(poly: int, reflected: bool) -> np.ndarray:
    out = np.zeros(256, np.uint16)
    for i in range(256):
        c = i if reflected else i << 8
        for _ in range(8):
            if reflected:
                c = (c >> 1) ^ (poly if c & 1 else 0)
            else:
                c = ((c << 1) ^ (poly if c & 0x8000 else 0)) & 0xFFFF
        out[i] = c
    return out


_MPEG, _ARC = _crc_table(0x8005, False), _crc_table(0xA001, True)
_MPEG_LIST = _MPEG.tolist()


@lru_cache(4096)
def frame_crc(protected: bytes) -> int:
    """CRC-16 (x^16 + x^15 + x^2 + 1, from 0xFFFF) of the header's second half and the side information."""
    c = 0xFFFF
    for b in protected:
        c = ((c << 8) & 0xFFFF) ^ _MPEG_LIST[(c >> 8) ^ b]
    return c


def _shift(table: np.ndarray) -> np.ndarray:
    """From the table that advances a CRC by k bytes to the one for 2k bytes."""
    return table[table]


def _arc_tables(block: int) -> tuple[np.ndarray, np.ndarray]:
    every = np.arange(65536, dtype=np.uint32)
    one = ((every >> 8) ^ _ARC[every & 255]).astype(np.uint16)
    places = np.empty((block, 256), np.uint16)
    places[block - 1] = _ARC
    for i in range(block - 2, -1, -1):
        places[i] = one[places[i + 1]]
    return places, one


_BLOCK = 64
_PLACES, _ONE = _arc_tables(_BLOCK)
_LEVELS = [_ONE]
for _ in range(6):
    _LEVELS.append(_shift(_LEVELS[-1]))
_LEVELS = [_LEVELS[6]]  # advances by one block; longer ones are made when asked for


def music_crc(data: np.ndarray) -> int:
    """CRC-16/ARC from 0 of ``data``: blocks by table, then joined in pairs (zeros in front change nothing)."""
    pad = -len(data) % _BLOCK
    blocks = np.concatenate([np.zeros(pad, np.uint8), data]).reshape(-1, _BLOCK)
    if not len(blocks):
        return 0
    crc = np.zeros(len(blocks), np.uint16)
    for i in range(_BLOCK):
        crc ^= _PLACES[i][blocks[:, i]]
    level = 0
    while len(crc) > 1:
        if level == len(_LEVELS):
            _LEVELS.append(_shift(_LEVELS[-1]))
        if len(crc) % 2:
            crc = np.concatenate([np.zeros(1, np.uint16), crc])
        crc = _LEVELS[level][crc[0::2]] ^ crc[1::2]
        level += 1
    return int(crc[0])


@lru_cache(256)
def frame_header(head: int) -> tuple[int, int, int, int, bool, int] | None:
    """Bytes, samples, rate, layer, protection and side information bytes of a header word; None if it is none."""
    version, layer, bitrate, rate = head >> 19 & 3, 4 - (head >> 17 & 3), head >> 12 & 15, head >> 10 & 3
    if head >> 21 != 0x7FF or version == 1 or layer == 4 or bitrate in (0, 15) or rate == 3 or head & 3 == 2:
        return None
    kbit, hz, pad = BITRATES[1 if version == 3 else 2, layer][bitrate], SAMPLE_RATES[version][rate], head >> 9 & 1
    if layer == 1:
        size, samples = (12000 * kbit // hz + pad) * 4, 384
    else:
        samples = 576 if layer == 3 and version != 3 else 1152
        size = samples // 8 * 1000 * kbit // hz + pad
    mono = head >> 6 & 3 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if version == 3 else (9 if mono else 17)
    return size, samples, hz, layer, not head >> 16 & 1, side


def _header(index: int) -> int:
    return 0xFFFA0000 | index << 12 | 2 << 10 | 3 << 6


_ROOM = [(SAMPLES // 8 * 1000 * kbit // RATE - HEAD, i) for i, kbit in enumerate(BITRATES[1, 3]) if i]


@lru_cache(16)
def _opening(index: int) -> bytes:
    """Header, CRC and silent side information of a frame with this bitrate index."""
    head = struct.pack(">I", _header(index))
    side = bytes(17)
    return head + struct.pack(">H", frame_crc(head[2:] + side)) + side


def _syncsafe(n: int) -> bytes:
    return bytes((n >> s) & 127 for s in (21, 14, 7, 0))


def encode(payload: bytes, n_bytes: int) -> bytes:
    """An MPEG stream that holds ``payload``; ``n_bytes`` (the length before padding) goes to a tag."""
    frames, sizes, at = [], [], 0
    while at < len(payload):
        left = len(payload) - at
        room, index = next((x for x in _ROOM if x[0] >= left), _ROOM[-1])
        part = payload[at : at + room]
        at += len(part)
        frames.append(_opening(index) + part + bytes(room - len(part)))
        sizes.append(HEAD + room)
    audio = b"".join(frames)
    info_index = next(i for room, i in _ROOM if room >= 160)
    info_size = dict((i, room) for room, i in _ROOM)[info_index] + HEAD
    total = info_size + len(audio)
    ends = info_size + np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(TOC_ENTRIES) * len(sizes) // TOC_ENTRIES
    toc = np.minimum(255, ends[at] * 256 // total).astype(np.uint8).tobytes()
    body = b"Xing" + struct.pack(">III", 0b0111, len(frames), total) + toc
    # The encoder's extension: name, revision, gapless fields, the CRC of the audio and that of the tag.
    extension = b"gleaner01" + bytes(19) + struct.pack(">IH", total, music_crc(np.frombuffer(audio, np.uint8)))
    opening = _opening(info_index)
    tagged = opening + body + extension
    info = tagged + struct.pack(">H", music_crc(np.frombuffer(tagged, np.uint8)))
    info += bytes(info_size - len(info))
    text = b"\x03payload\x00%d" % n_bytes + b" %d" % len(payload)
    tag = b"TXXX" + _syncsafe(len(text)) + bytes(2) + text
    return b"ID3\x04\x00\x00" + _syncsafe(len(tag)) + tag + info + audio


def _plain(b: bytes) -> int:
    return int.from_bytes(b, "big")


def _safe(b: bytes) -> int:
    """A number of seven bits a byte."""
    out = 0
    for x in b:
        out = out << 7 | (x & 127)
    return out


#: Fixed values of ID3v2: encodings by their number, with the bytes that end a string.
ENCODINGS = (("latin-1", b"\x00"), ("utf-16", b"\x00\x00"), ("utf-16-be", b"\x00\x00"), ("utf-8", b"\x00"))


def _strings(value: bytes) -> list[str]:
    """The strings of a text frame, by the encoding that its first byte names."""
    if not value or value[0] >= len(ENCODINGS):
        return []
    (name, stop), body, out, wide = ENCODINGS[value[0]], value[1:], [], len(ENCODINGS[value[0]][1])
    while body:
        at = next((i for i in range(0, len(body) - wide + 1, wide) if body[i : i + wide] == stop), len(body))
        out.append(body[:at].decode(name, "replace").lstrip("\ufeff"))
        body = body[at + wide :]
    return out


def id3v2(tag: bytes) -> dict[str, str]:
    """Text frames of one ID3v2 tag (header and all); user-defined ones under their description."""
    version, flags, body, out = tag[3], tag[5], tag[10:], {}
    if version < 4 and flags & 0x80:
        body = body.replace(b"\xff\x00", b"\xff")
    head, number = (6, _plain) if version == 2 else (10, _plain if version == 3 else _safe)
    p = 0
    if version > 2 and flags & 0x40:
        p = 4 + _plain(body[:4]) if version == 3 else _safe(body[:4])
    while p + head <= len(body) and body[p]:
        name = body[p : p + (3 if version == 2 else 4)].decode("latin-1")
        size = _plain(body[p + 3 : p + 6]) if version == 2 else number(body[p + 4 : p + 8])
        kind = body[p + 9] if version > 2 else 0
        value = body[p + head : p + head + size]
        p += head + size
        value = _unwrapped(value, version, kind)
        if value is None or name[:1] != "T":
            continue
        strings = _strings(value)
        if name in ("TXXX", "TXX"):
            if strings:
                out[strings[0]] = "/".join(strings[1:])
        else:
            out[name] = "/".join(strings).rstrip("/")
    return out


def _unwrapped(value: bytes, version: int, kind: int) -> bytes | None:
    """A frame's data without grouping, compression and unsynchronisation; None where it cannot be read."""
    if version == 3:
        packed, locked, grouped, loose, sized = kind & 0x80, kind & 0x40, kind & 0x20, 0, kind & 0x80
    else:
        packed, locked, grouped, loose, sized = kind & 0x08, kind & 0x04, kind & 0x40, kind & 0x02, kind & 0x01
    if version == 2 or not kind:
        return value
    if locked:
        return None
    value = value[bool(grouped) + 4 * bool(sized) :]
    if loose:
        value = value.replace(b"\xff\x00", b"\xff")
    if packed:
        try:
            value = zlib.decompress(value)
        except zlib.error:
            return None
    return value


def id3v1(tag: bytes) -> dict[str, str]:
    parts = (("id3v1", 3, 33), ("id3v1 artist", 33, 63), ("id3v1 album", 63, 93), ("id3v1 year", 93, 97))
    return {name: text for name, x, y in parts if (text := tag[x:y].split(b"\x00")[0].decode("latin-1").strip())}


def apev2(tag: bytes, items: int) -> dict[str, str]:
    out, p = {}, 0
    for _ in range(items):
        stop = tag.find(b"\x00", p + 8)
        if stop < 0:
            break
        size = int.from_bytes(tag[p : p + 4], "little")
        if not tag[p + 4] & 6:  # text, neither binary nor a link
            out[tag[p + 8 : stop].decode("latin-1")] = tag[stop + 1 : stop + 1 + size].replace(b"\x00", b"/").decode("utf-8", "replace")
        p = stop + 1 + size
    return out


def tags_of(media: bytes) -> tuple[dict[str, str], int, int]:
    """All tags, and where the audio between them begins and ends."""
    at, end, tags = 0, len(media), {}
    while media[at : at + 3] == b"ID3" and at + 10 <= end and media[at + 3] in (2, 3, 4):
        stop = min(end, at + 10 + _safe(media[at + 6 : at + 10]))
        tags |= id3v2(media[at:stop])
        at = min(end, stop + (10 if media[at + 5] & 16 else 0))
    if end - at >= 128 and media[end - 128 : end - 125] == b"TAG":
        end -= 128
        tags |= id3v1(media[end : end + 128])
    if end - at >= 32 and media[end - 32 : end - 24] == b"APETAGEX":
        size, items, flags = (int.from_bytes(media[end - x : end - x + 4], "little") for x in (20, 16, 12))
        start = max(at, end - size)
        tags |= apev2(media[start : end - 32], items)
        end = max(at, start - (32 if flags >> 31 else 0))
    return tags, at, end


# Fixed values of ISO/IEC 11172-3 tables B.2a to B.2d and 13818-3 table B.1: (bits of an allocation, subbands), in order.
ALLOCATIONS = {
    "a": ((4, 11), (3, 12), (2, 4)),
    "b": ((4, 11), (3, 12), (2, 7)),
    "c": ((4, 2), (3, 6)),
    "d": ((4, 2), (3, 10)),
    "low": ((4, 4), (3, 7), (2, 19)),
}


def _allocation(head: int, hz: int) -> list[int]:
    """Bits of each subband's allocation in a Layer II frame."""
    if head >> 19 & 3 != 3:
        name = "low"
    else:
        each = BITRATES[1, 2][head >> 12 & 15] // (1 if head >> 6 & 3 == 3 else 2)
        if each <= 48:
            name = "d" if hz == 32000 else "c"
        else:
            name = "a" if each <= 80 or hz == 48000 else "b"
    return [bits for bits, n in ALLOCATIONS[name] for _ in range(n)]


def protected_bits(head: int, layer: int, hz: int, body: bytes) -> int:
    """How many bits after the CRC it covers in a Layer I or II frame: the allocations, and what Layer II says of its scale factors."""
    mode = head >> 6 & 3
    channels = 1 if mode == 3 else 2
    widths = [4] * 32 if layer == 1 else _allocation(head, hz)
    bound = min(len(widths), 4 * ((head >> 4 & 3) + 1)) if mode == 1 else len(widths)
    plain = sum(w * (channels if i < bound else 1) for i, w in enumerate(widths))
    if layer == 1:
        return plain
    bits, at, chosen = int.from_bytes(body[: -(-plain // 8)].ljust(-(-plain // 8), b"\x00"), "big") >> -plain % 8, plain, 0
    for i, w in enumerate(widths):
        for _ in range(channels if i < bound else 1):
            at -= w
            if bits >> at & ((1 << w) - 1):
                chosen += 1 if i < bound else channels
    return plain + 2 * chosen


def bits_crc(data: bytes, bits: int) -> int:
    """The frame CRC of the first ``bits`` bits."""
    c = 0xFFFF
    for b in data[: bits // 8]:
        c = ((c << 8) & 0xFFFF) ^ _MPEG_LIST[(c >> 8) ^ b]
    for i in range(bits // 8 * 8, bits):
        top = (c >> 15) ^ (data[i // 8] >> (7 - i % 8) & 1)
        c = ((c << 1) & 0xFFFF) ^ (0x8005 if top else 0)
    return c


def crc_right(media: bytes, at: int, size: int, layer: int, hz: int, side: int) -> bool:
    """Whether the CRC of the protected frame at ``at`` is that of what it covers."""
    stated, covered = media[at + 4] << 8 | media[at + 5], media[at + 2 : at + 4]
    if layer == 3:
        return frame_crc(covered + media[at + 6 : at + 6 + side]) == stated
    body = media[at + 6 : at + size]
    bits = protected_bits(_plain(media[at : at + 4]), layer, hz, body)
    return bits <= 8 * len(body) and bits_crc(covered + body, 16 + bits) == stated


def parse(media: bytes) -> dict:
    """Frames, seek offsets, durations, tags, checks and ancillary payload of an MPEG stream."""
    tags, at, end = tags_of(media)
    out = {"tags": tags, "vbr": None, "offsets": [], "samples": 0, "rate": 0, "crc_bad": 0, "crc_checked": 0, "skipped": 0, "trimmed": 0, "music_crc_ok": None, "tag_crc_ok": None}
    parts, first, first_end, audio_from = [], True, 0, at
    expected, kind_before = -1, None
    while at + 4 <= end:
        found = frame_header(int.from_bytes(media[at : at + 4], "big"))
        if found is None or at + found[0] > end:
            nxt = media.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out["skipped"] += nxt - at
            at = nxt
            continue
        size, samples, hz, layer, protected, side = found
        follow = frame_header(int.from_bytes(media[at + size : at + size + 4], "big")) if at + size + 4 <= end else True
        chained = at == expected and (hz, layer) == kind_before
        checked = protected and size >= 6 + side
        right = checked and crc_right(media, at, size, layer, hz, side)
        if not (chained or right) and (not follow or (follow is not True and follow[2:4] != (hz, layer))):
            out["skipped"] += 1
            at += 1
            continue
        expected, kind_before = at + size, (hz, layer)
        head = 4 + 2 * protected
        out["crc_checked"] += checked
        out["crc_bad"] += checked and not right
        body = at + head + side
        if first:
            first = False
            kind = media[body : body + 4]
            if kind in (b"Xing", b"Info"):
                flags = int.from_bytes(media[body + 4 : body + 8], "big")
                p, vbr = body + 8, {"kind": kind.decode()}
                for bit, key in ((1, "frames"), (2, "bytes")):
                    if flags & bit:
                        vbr[key] = int.from_bytes(media[p : p + 4], "big")
                        p += 4
                if flags & 4:
                    vbr["toc"] = media[p : p + TOC_ENTRIES]
                    p += TOC_ENTRIES
                p += 4 * bool(flags & 8)
                if p + 36 <= at + size and media[p : p + 4].strip(b"\x00"):
                    vbr["encoder"] = media[p : p + 9].decode("latin-1")
                    gaps = _plain(media[p + 21 : p + 24])  # samples before and after the sound
                    out["trimmed"] = (gaps >> 12) + (gaps & 0xFFF)
                    vbr["music_crc"] = int.from_bytes(media[p + 32 : p + 34], "big")
                    out["tag_crc_ok"] = music_crc(np.frombuffer(media[at : p + 34], np.uint8)) == int.from_bytes(media[p + 34 : p + 36], "big")
                out["vbr"] = vbr
            elif media[at + 36 : at + 40] == b"VBRI":
                out["vbr"] = {"kind": "VBRI", "bytes": int.from_bytes(media[at + 46 : at + 50], "big"), "frames": int.from_bytes(media[at + 50 : at + 54], "big")}
            if out["vbr"]:
                at += size
                first_end = audio_from = at
                continue
        out["offsets"].append(at)
        out["samples"] += samples
        out["rate"] = hz
        parts.append(media[body : at + size])
        at += size
    out["skipped"] += max(0, end - at)
    out["played"] = max(0, out["samples"] - out["trimmed"])
    if first_end and "music_crc" in out["vbr"]:
        out["music_crc_ok"] = music_crc(np.frombuffer(media[audio_from:end], np.uint8)) == out["vbr"]["music_crc"]
    out["ancillary"] = b"".join(parts)
    return out


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column(0), b.column(1).cast(pa.binary())
        lengths, media = [], []
        for i in range(len(texts)):
            raw = texts[i].as_py() or b""
            lengths.append(len(raw))
            media.append(encode(raw + bytes(-len(raw) % 64 or 64 * (not raw)), len(raw)))
            if sum(map(len, media)) > 1 << 22 or i == len(texts) - 1:
                a = i + 1 - len(media)
                yield pa.RecordBatch.from_arrays([ids.slice(a, len(media)), pa.array(lengths, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
                lengths, media = [], []


_PAYLOAD = re.compile(r"([0-9]{1,18}) ([0-9]{1,18})")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i in range(len(b)):
            media = b.column(2)[i].as_py() or b""
            x = parse(media)
            stated = _PAYLOAD.fullmatch(x["tags"].get("payload", ""))
            n, padded = map(int, stated.groups()) if stated else (0, 0)
            table_frames = (x["vbr"] or {}).get("frames")
            payload, offsets = x["ancillary"][:padded], np.array(x["offsets"], np.int64)
            rows.append({
                "doc_id": b.column(0)[i].as_py(), "n_bytes": n, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]),
                "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "frames": len(offsets), "samples": x["samples"], "sample_rate": x["rate"],
                "duration_s": x["played"] / x["rate"] if x["rate"] else 0.0, "seek_offsets": offsets, "crc_bad": x["crc_bad"], "skipped": x["skipped"],
                "table_frames": table_frames, "checks_ok": x["crc_bad"] == 0 and x["skipped"] == 0 and bool(x["music_crc_ok"]) and bool(x["tag_crc_ok"]) and table_frames == len(offsets),
            })
        yield pa.RecordBatch.from_pylist(rows, FEATURES_ARROW)


FEATURES_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()),
    ("frames", pa.int64()), ("samples", pa.int64()), ("sample_rate", pa.int64()), ("duration_s", pa.float64()), ("seek_offsets", pa.list_(pa.int64())), ("crc_bad", pa.int64()), ("skipped", pa.int64()),
    ("table_frames", pa.int64()), ("checks_ok", pa.bool_()),
])
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long, samples long, sample_rate long, duration_s double, seek_offsets array<long>, crc_bad long, skipped long, table_frames long, checks_ok boolean"


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as an MPEG stream."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text"))
    return rows.mapInArrow(tidy(_encoded), "doc_id long, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """Features of each stored stream, from its bytes alone (``FEATURES``)."""
    small_batches(stored.sparkSession)
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(tidy(_read), FEATURES)
