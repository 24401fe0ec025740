import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.llm import license_scan, media_mpeg, queries, winnow
from gleaner.llm.license_texts import TEMPLATES

DOCS = "doc_id long, text string, media string, place string"


def padded(raw):
    return raw + bytes(-len(raw) % 64 or 64 * (not raw))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000))
def test_any_payload_comes_back(raw):
    """Even bytes that look like frame headers."""
    x = media_mpeg.parse(media_mpeg.encode(padded(raw), len(raw)))
    assert x["ancillary"][: len(padded(raw))] == padded(raw) and x["tags"]["payload"] == f"{len(raw)} {len(padded(raw))}"
    assert x["crc_bad"] == x["skipped"] == 0 and x["music_crc_ok"] and x["tag_crc_ok"] and x["vbr"]["frames"] == len(x["offsets"])
    assert x["samples"] == 1152 * len(x["offsets"]) and x["rate"] == 32000


def crc_arc(data):
    c = 0
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (0xA001 if c & 1 else 0)
    return c


@given(st.binary(max_size=400))
def test_music_crc(data):
    assert media_mpeg.music_crc(np.frombuffer(data, np.uint8)) == crc_arc(data)


def test_published_checksums():
    assert media_mpeg.music_crc(np.frombuffer(b"123456789", np.uint8)) == 0xBB3D
    assert media_mpeg.frame_crc(b"123456789") == 0xAEE7


def test_headers():
    size, samples, rate, layer, protected, side = media_mpeg.frame_header(0xFFFB9064)  # 128 kbit/s, 44.1 kHz, joint stereo
    assert (size, samples, rate, layer, protected, side) == (417, 1152, 44100, 3, False, 32)
    assert media_mpeg.frame_header(0xFFFD8404)[:4] == (384, 1152, 48000, 2)
    assert media_mpeg.frame_header(0xFFF3C064)[:4] == (417, 576, 22050, 3)
    assert media_mpeg.frame_header(0xFFFB0064) is None and media_mpeg.frame_header(0x12345678) is None


def safe(n):
    return bytes((n >> x) & 127 for x in (21, 14, 7, 0))


def id3(version, frames, flags=0):
    body = b""
    for name, value, kind in frames:
        if version == 2:
            body += name + struct.pack(">I", len(value))[1:] + value
        else:
            body += name + (struct.pack(">I", len(value)) if version == 3 else safe(len(value))) + bytes([0, kind]) + value
    return b"ID3" + bytes([version, 0, flags]) + safe(len(body)) + body


@pytest.mark.parametrize("version", [2, 3, 4])
def test_tags_of_every_version(version):
    title, user, other = (b"TT2", b"TXX", b"COM") if version == 2 else (b"TIT2", b"TXXX", b"COMM")
    long = "long " * 100  # a size above 127 tells plain numbers from syncsafe ones
    frames = [(title, b"\x01" + "Grüße 音".encode("utf-16"), 0), (other, b"\x00engxx", 0), (user, b"\x00key\x00" + long.encode(), 0), (user, b"\x01" + "ключ\x00".encode("utf-16") + "да".encode("utf-16"), 0), (b"TAL" if version == 2 else b"TALB", b"\x02" + "Ä\x00".encode("utf-16-be"), 0), (b"TPE" if version == 2 else b"TPE1", b"\x09bad", 0)]
    raw = padded(b"text")
    audio = media_mpeg.encode(raw, 4)
    got = media_mpeg.parse(id3(version, frames) + audio)
    assert got["tags"][title.decode()] == "Grüße 音" and got["tags"]["key"] == long and got["tags"]["ключ"] == "да"
    assert got["tags"]["TAL" if version == 2 else "TALB"] == "Ä" and got["tags"]["payload"] == "4 64"
    assert got["ancillary"][:64] == raw and got["skipped"] == 0


def test_wrapped_tags():
    loose = (b"TIT2", b"\x03a\xff\x00\xe0", 0)
    assert media_mpeg.id3v2(id3(3, [(b"TIT2", b"\x01" + b"\xff\x00\xfeA\x00", 0)], 0x80)) == {"TIT2": "A"}
    assert media_mpeg.id3v2(id3(4, [(*loose[:2], 0x02)]))["TIT2"].startswith("a")
    packed = zlib.compress(b"\x03squeezed")
    assert media_mpeg.id3v2(id3(3, [(b"TIT2", struct.pack(">I", 9) + packed, 0x80)])) == {"TIT2": "squeezed"}
    assert media_mpeg.id3v2(id3(4, [(b"TIT2", b"G" + safe(9) + packed, 0x49), (b"TALB", b"\x03x", 0x04), (b"TPE1", b"junk", 0x09)])) == {"TIT2": "squeezed"}
    v1 = (b"TAG" + b"Title".ljust(30, b"\x00") + b"Artist".ljust(30) + bytes(30) + b"1999" + bytes(31))[:128]
    item = lambda k, v, kind=0: struct.pack("<II", len(v), kind) + k + b"\x00" + v
    ape = item(b"Genre", "Läm".encode()) + item(b"Cover", b"\xff\xfa", 2)
    ape += b"APETAGEX" + struct.pack("<IIII", 2000, len(ape) + 32, 2, 0) + bytes(8)
    got = media_mpeg.parse(media_mpeg.encode(padded(b"x"), 1) + ape + v1)
    assert got["tags"]["id3v1"] == "Title" and got["tags"]["id3v1 artist"] == "Artist" and got["tags"]["id3v1 year"] == "1999"
    assert got["tags"]["Genre"] == "Läm" and "Cover" not in got["tags"] and got["skipped"] == 0


def crc_of_bits(bits):
    c = 0xFFFF
    for bit in bits:
        c = (c << 1) & 0xFFFF ^ (0x8005 if (c >> 15) ^ bit else 0)
    return c


def bits_of(data):
    return [x >> (7 - k) & 1 for x in data for k in range(8)]


@pytest.mark.parametrize(("mode", "extension"), [(3, 0), (0, 0), (1, 0), (1, 2), (2, 0)])
@pytest.mark.parametrize("layer", [1, 2])
def test_checksums_of_layers_one_and_two(layer, mode, extension):
    """Against a bit-by-bit reading of allocations: 32 subbands of 4 bits, or table B.2a / B.2b with scale factor selections."""
    rng = random.Random(layer * 10 + mode)
    head = 0xFFFC0000 | (4 - layer) << 17 & 0x60000 | 10 << 12 | mode << 6 | extension << 4  # 44.1 kHz, protected
    size, samples, hz, *_ = media_mpeg.frame_header(head)
    channels = 1 if mode == 3 else 2
    widths = [4] * 32 if layer == 1 else [4] * 11 + [3] * 12 + [2] * 7  # 96 kbit/s a channel and more at 44.1 kHz
    bound = 4 * (extension + 1) if mode == 1 else len(widths)
    frames = b""
    for _ in range(3):
        body = rng.randbytes(size - 6)
        bits, at, chosen = bits_of(body), 0, 0
        for i, w in enumerate(widths):
            for _ in range(channels if i < bound else 1):
                chosen += any(bits[at : at + w]) * (1 if i < bound else channels)
                at += w
        covered = at + (2 * chosen if layer == 2 else 0)
        first = struct.pack(">I", head)
        frames += first + struct.pack(">H", crc_of_bits(bits_of(first[2:]) + bits[:covered])) + body
    x = media_mpeg.parse(frames)
    assert (len(x["offsets"]), x["crc_checked"], x["crc_bad"], x["samples"]) == (3, 3, 0, 3 * samples)
    bad = bytearray(frames)
    bad[size + 7] ^= 16
    assert media_mpeg.parse(bytes(bad))["crc_bad"] == 1


def test_exact_durations_leave_out_the_padding():
    raw = padded(b"y" * 20000)
    media = media_mpeg.encode(raw, len(raw))
    at = media.index(b"gleaner01")
    x = media_mpeg.parse(media[: at + 21] + bytes([0x24, 0x04, 0x80]) + media[at + 24 :])  # 576 before, 1152 after
    assert x["trimmed"] == 576 + 1152 and x["played"] == x["samples"] - 1728 and media_mpeg.parse(media)["trimmed"] == 0


def test_foreign_streams_are_read(spark):
    own = media_mpeg.encode(padded(b"z"), 1)
    no_count = own.replace(b"Xing" + struct.pack(">I", 7), b"Xing" + struct.pack(">I", 6))
    odd = own.replace(b"payload\x001 64", b"payload\x00one 6")
    rows = [(1, 0, own), (2, 0, no_count), (3, 0, odd), (4, 0, b""), (5, 0, None), (6, 0, b"ID3\x03"), (7, 0, b"\xff" * 50), (7, 0, b"\xff" * 50)]
    got = {r["doc_id"]: r for r in media_mpeg.read_media(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1]["checks_ok"] and got[1]["payload_bytes"] == 64 and not got[2]["checks_ok"] and got[3]["payload_bytes"] == got[3]["n_bytes"] == 0
    assert all(got[i]["frames"] == 0 and got[i]["duration_s"] == 0 for i in (4, 5, 6, 7))
    empty = spark.createDataFrame([], DOCS)
    assert media_mpeg.read_media(media_mpeg.store_media(empty)).count() == 0


def test_resynchronises_and_finds_faults():
    raw = padded(bytes(range(256)) * 40)
    good = media_mpeg.encode(raw, len(raw))
    clean = media_mpeg.parse(good)
    first, second = clean["offsets"][:2]
    junk = good[:first] + b"\xff\xfb\x90junk\xff" * 5 + good[first:] + b"tail"
    x = media_mpeg.parse(junk)
    assert len(x["offsets"]) == len(clean["offsets"]) and x["skipped"] == 44 and x["ancillary"][: len(raw)] == raw
    broken = bytearray(good)
    broken[first + 10] ^= 1
    x = media_mpeg.parse(bytes(broken))
    assert x["crc_bad"] == 1 and not x["music_crc_ok"]
    cut = media_mpeg.parse(good[:-10])
    assert len(cut["offsets"]) == len(clean["offsets"]) - 1 and cut["skipped"] > 0
    assert media_mpeg.parse(b"")["offsets"] == [] and media_mpeg.parse(b"no audio here")["skipped"] == 13
    old = media_mpeg.parse(good + b"TAG" + b"A title".ljust(125, b"\0"))
    assert old["tags"]["id3v1"] == "A title" and len(old["offsets"]) == len(clean["offsets"])


def test_vbri_table():
    frame = media_mpeg._opening(9) + bytes(media_mpeg.frame_header(media_mpeg._header(9))[0] - 23)
    first = bytearray(frame)
    first[36:58] = b"VBRI" + struct.pack(">HHHII", 1, 0, 75, 9999, 3) + bytes(4)
    x = media_mpeg.parse(bytes(first) + frame * 3)
    assert x["vbr"] == {"kind": "VBRI", "bytes": 9999, "frames": 3} and len(x["offsets"]) == 3


TEXTS = [(1, "plain text", None, "x"), (2, None, None, None), (3, "", None, None), (4, "é😀" * 5000, None, None), (5, "plain text", None, None), (None, "x" * 64, None, None), (1, "plain text", None, "x")]


def test_media_table(spark, tmp_path):
    spark.createDataFrame(TEXTS, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op1_mpeg_media(spark, str(tmp_path)).collect()
    want = {}
    for i, t, *_ in TEXTS:
        raw = (t or "").encode()
        want[i] = (len(raw), len(padded(raw)), hashlib.sha256(padded(raw)).hexdigest(), zlib.crc32(padded(raw)[-64:]))
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == want[r["doc_id"]] and "ok=true" in r["feature"]
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["media_sha256"] == by[5]["media_sha256"] and by[1]["feature"] == by[5]["feature"]


def brute_fingerprint(text):
    n = len(text) - winnow.GRAM + 1
    h = [int(winnow.fingerprints([text[i : i + winnow.GRAM]])[0][0][0]) for i in range(n)]
    out = []
    for i in range(n - winnow.WINDOW + 1):
        part = h[i : i + winnow.WINDOW]
        p = i + max(k for k, v in enumerate(part) if v == min(part))
        if not out or out[-1] != (h[p], p):
            out.append((h[p], p))
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab é😀", min_size=47, max_size=150), min_size=1, max_size=4))
def test_winnowing(texts):
    for text, (hashes, places) in zip(texts, winnow.fingerprints(texts), strict=True):
        assert list(zip(hashes.tolist(), places.tolist(), strict=True)) == brute_fingerprint(text)


def test_short_texts_and_the_guarantee():
    short = winnow.fingerprints(["", "a", "b", "x" * 16, "x" * 30])
    assert [len(h) for h, _ in short] == [0, 1, 1, 1, 1] and short[1][0] != short[2][0] and short[4][1].tolist() == [14]
    rng = np.random.default_rng(1)
    shared = "".join(rng.choice(list("abcdefgh"), winnow.GRAM + winnow.WINDOW - 1))
    for seed in range(20):
        r = np.random.default_rng(seed)
        a, b = ("".join(r.choice(list("ijklmnop"), 100)) + shared + "".join(r.choice(list("ijklmnop"), 90)) for _ in range(2))
        (x, _), (y, _) = winnow.fingerprints([a, b])
        assert set(x.tolist()) & set(y.tolist())
    assert winnow.likeness(*[np.zeros(0)] * 2) == 1.0


@pytest.mark.parametrize("n", [0, 1, 2, 150])
def test_along_the_ids(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(i) * 7, None if i % 11 == 3 else "".join(rng.choice(list("abc é"), rng.integers(0, 300))), None, None) for i in rng.permutation(n)]
    got = {r["doc_id"]: r for r in winnow.compare_along(spark.createDataFrame(rows, DOCS)).collect()}
    texts = {i: t or "" for i, t, *_ in rows}
    ids = sorted(texts)
    assert sorted(got) == ids
    for k, i in enumerate(ids):
        t, after = texts[i], texts[ids[(k + 1) % n]]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        f, g, h = (set(winnow.fingerprints([x])[0][0].tolist()) for x in (t, edited, after))
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["fingerprint"] == winnow.digest(winnow.fingerprints([t])[0]) and got[i]["edited_fingerprint"] == winnow.digest(winnow.fingerprints([edited])[0])
        assert got[i]["near_edited"] == pytest.approx(len(f & g) / len(f | g) if f | g else 1.0)
        assert got[i]["near_next"] == pytest.approx(len(f & h) / len(f | h) if f | h else 1.0)


def test_repeated_and_null_ids(spark):
    rows = [(1, "a" * 100, None, None)] * 3 + [(None, "b" * 90, None, None), (2, "c", None, None)]
    got = winnow.compare_along(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 5 and sorted(r["near_next"] for r in got) == [0, 0, 0, 1, 1]


def test_licences(spark):
    mit, notice = TEMPLATES["MIT"], TEMPLATES["Apache-2.0-notice"]
    broken = " ".join(w for i, w in enumerate(mit.split()) if i % 20)
    noisy = "wort " * 50 + "&&& ".join(notice.upper().split()) + " wort" * 50
    rows = [
        (1, f"start {mit} end", None, None), (2, f"é x {broken} y", None, None), (3, noisy, None, None), (4, f"{notice} and {notice}", None, None), (5, "no licence at all", None, None), (6, None, None, None), (7, "", None, None),
        (8, " ".join(mit.split()[:30]), None, None), (None, notice, None, None), (9, "filler words " * 20000 + notice, None, None),
    ]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()
    by: dict = {}
    for r in sorted(got, key=lambda r: r["start_word"]):
        by.setdefault(r["doc_id"], []).append(r)
    assert {k: [r["license"] for r in v] for k, v in by.items()} == {1: ["MIT"], 2: ["MIT"], 3: ["Apache-2.0-notice"], 4: ["Apache-2.0-notice"] * 2, None: ["Apache-2.0-notice"], 9: ["Apache-2.0-notice"]}
    assert by[1][0]["coverage"] == 1.0 and 0.9 < by[2][0]["coverage"] < 1 and (by[3][0]["start_word"], by[3][0]["end_word"]) == (50, 58)
    text = rows[0][1].encode()
    assert text[by[1][0]["start_byte"] : by[1][0]["end_byte"]].startswith(b"Permission is hereby")


def full_alignment(template, words):
    """Plain local alignment over everything: the best score."""
    h = np.zeros((len(template) + 1, len(words) + 1), int)
    for i, x in enumerate(template, 1):
        for j, y in enumerate(words, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (license_scan.MATCH if x == y else license_scan.MISMATCH), h[i - 1, j] + license_scan.GAP, h[i, j - 1] + license_scan.GAP)
    return int(h.max())


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=15), st.lists(st.integers(0, 5), max_size=25))
def test_a_wide_band_is_the_whole_alignment(template, words):
    got = license_scan.align(np.array(template, np.uint64), np.array(words, np.uint64), -40, 40)
    assert got[0] == full_alignment(template, words)
    score, matched, covered, start, end = got
    assert 0 <= start <= end <= len(words) and matched <= min(covered, end - start)
    gaps = abs(covered - (end - start))
    assert score <= 2 * matched - gaps  # matches count two, a word left out or put in and a change one


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), max_size=20), st.integers(-9, 9), st.integers(0, 9))
def test_a_band_is_the_alignment_inside_it(template, words, low, wide):
    h = {(-1, None): 0}
    best = 0
    cell = lambda i, j: h.get((i, j), 0)
    for i, x in enumerate(template):
        for j in range(max(0, i + low), min(len(words), i + low + wide + 1)):
            h[i, j] = max(0, cell(i - 1, j - 1) + (2 if x == words[j] else -1), cell(i - 1, j) - 1, cell(i, j - 1) - 1)
            if x == words[j]:
                best = max(best, h[i, j])
    assert license_scan.align(np.array(template, np.uint64), np.array(words, np.uint64), low, low + wide)[0] == best


def scanned(index, text, min_coverage=0.75):
    raw = np.frombuffer(text.encode(), np.uint8)
    return license_scan.find(index, license_scan.scan_words(raw, np.array([0, len(raw)]))[0], min_coverage)


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_each_template_is_found_anywhere(name):
    """Exact, and with as many changed words as the coverage leaves, whatever words stand around it."""
    index, rng = license_scan.Index(TEMPLATES), np.random.default_rng(len(name))
    template = [w for w in re.split(r"[^a-z0-9]+", TEMPLATES[name].lower()) if w]
    n = len(template)
    changed = max(c for c in range(n) if (n - c) / n >= 0.75)
    apart = [round((i + 1) * (n - changed) / (changed + 1)) + i for i in range(changed)]
    for k in range(40):
        before, after = ([f"w{x}" for x in rng.integers(0, 10**9, m)] for m in ((0, 0), (0, 9), (9, 0), (9, 9))[k % 4])
        found = scanned(index, " ".join([*before, *template, *after]))
        assert (name, n, 1.0, len(before), len(before) + n) in found
        if n <= 8:
            for at in [[x] for x in range(n) if changed] + [apart]:
                other = [f"x{k}" if i in at else w for i, w in enumerate(template)]
                got = {(r[0], r[1]) for r in scanned(index, " ".join([*before, *other, *after]))}
                assert (name, n - len(at)) in got or any(m >= n - len(at) for _, m in got), (at, got)


def brute_scan(templates, text, min_coverage=0.75):
    """Every template against the whole text without an index or a band, again where one was found; then the same choice among overlaps."""
    raw = np.frombuffer(text.encode(), np.uint8)
    words = license_scan.scan_words(raw, np.array([0, len(raw)]))[0]
    places = []
    for t, name in enumerate(sorted(templates)):
        own = np.frombuffer(templates[name].encode(), np.uint8)
        template, left = license_scan.scan_words(own, np.array([0, len(own)]))[0], words.copy()
        while True:
            _, matched, _, a, b = license_scan.align(template, left, -len(template), len(words))
            if not matched or matched / len(template) < min_coverage:
                break
            places.append((-matched, -matched / len(template), a, t, b))
            left[a:b] = license_scan.FOUND
    taken = []
    for m, c, a, t, b in sorted(places):
        if all(b <= x or a >= y for _, _, _, x, y in taken):
            taken.append((sorted(templates)[t], -m, -c, a, b))
    return sorted(taken, key=lambda x: (x[3], x[0]))


def test_scans_against_brute_force():
    """Whole texts with several notices, words changed, put in and left out, among other words and halves of notices."""
    names = sorted(TEMPLATES)
    index = license_scan.Index(TEMPLATES)
    for seed in range(40):
        r = random.Random(seed)
        text = []
        for _ in range(r.randint(1, 3)):
            text += [f"w{r.randrange(500)}" for _ in range(r.randint(0, 30))]
            notice = TEMPLATES[r.choice(names)].split()
            if r.random() < 0.2:
                notice = notice[: len(notice) // 2]
            for _ in range(r.randrange(1 + len(notice) // 8)):
                at = r.randrange(len(notice))
                notice[at : at + r.choice([0, 1, 1])] = r.choice([[], ["other"], ["other"]])
            text += notice
        text = " ".join(text)
        assert scanned(index, text) == brute_scan(TEMPLATES, text), seed


def test_licenses_of_odd_rows(spark, tmp_path):
    (tmp_path / "Own-1.txt").write_text("do what you like with this odd work and tell nobody of it")
    own = license_scan.templates_in(str(tmp_path))
    assert list(own) == ["Own-1"]
    text = f"x {own['Own-1']} y"
    rows = [(1, text, "m", "p"), (1, text, "m", "p"), (None, text, None, None), (2, None, None, None), (3, "", None, None), (4, f"{text} " * 3000, None, None)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, DOCS), own).collect()
    assert [sum(r["doc_id"] == i for r in got) for i in (1, None, 2, 3, 4)] == [2, 1, 0, 0, 3000]
    assert {(r["matched_words"], r["coverage"]) for r in got} == {(13, 1.0)}
    # equal matches: the first template by name
    twins = {"B": own["Own-1"], "A": own["Own-1"]}
    assert [r["license"] for r in license_scan.scan_licenses(spark.createDataFrame(rows[:1], DOCS), twins).collect()] == ["A"]
    assert license_scan.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0


def test_fingerprints_of_odd_rows(spark, monkeypatch):
    """Very long texts, one id with several texts, repeated rows and null ids, in buckets of a few rows."""
    r = random.Random(3)
    long = "".join(r.choice("abcdefgh ") for _ in range(400_000))
    rows = [(i, "".join(r.choice("abc ") for _ in range(r.randrange(90))), None, None) for i in range(60)]
    rows += [(7, f"text {i} " * 9, None, None) for i in range(40)] + [(None, f"no id {i}", None, None) for i in range(30)] + [(70, long, None, None), (71, long, None, None), (8, "twice", None, None), (8, "twice", None, None)]
    monkeypatch.setattr(winnow, "SPREAD", 16)
    keys = spark.createDataFrame(rows, DOCS)
    got = winnow.compare_along(keys).collect()
    order = [(row["doc_id"], row["text"]) for row in keys.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()]
    want = []
    for i, (doc_id, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want.append((doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest(), winnow.digest(winnow.fingerprints([t])[0]), winnow.digest(winnow.fingerprints([edited])[0])))
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    assert sorted((tuple(x)[:5] for x in got), key=key) == sorted(want, key=key)
    by = {x["doc_id"]: x for x in got}
    assert by[70]["near_next"] == 1.0 and by[70]["fingerprint"] == by[71]["fingerprint"]
    assert winnow.compare_along(keys.limit(0)).count() == 0


def test_buckets_against_sorting():
    rng = np.random.default_rng(1)
    ids, orders = rng.integers(0, 9, 500), rng.integers(-50, 50, 500)
    place = np.lexsort((orders, ids))
    cut = place[[50, 130, 131, 260, 400]]
    got = winnow.bucket_of(ids, orders, ids[cut], orders[cut])
    want = [sum((a, b) <= (x, y) for a, b in zip(ids[cut], orders[cut], strict=True)) for x, y in zip(ids, orders, strict=True)]
    assert got.tolist() == want
