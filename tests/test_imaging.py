import struct
import zlib

import numpy as np
import pytest

from gleaner.functions.imaging import ADAM7, PNG_SIGNATURE, Broken, Unsupported, decode, difference_hash, encode_png, facts, grey, resample
from tests.conftest import near, textured


def png(width, height, depth, kind, lines, interlace=0, palette=None, crc_ok=True):
    def chunk(name, body):
        crc = zlib.crc32(name + body) ^ (0 if crc_ok or name != b"IDAT" else 1)
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", crc)

    out = PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, interlace))
    if palette is not None:
        out += chunk(b"PLTE", palette)
    return out + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def filtered(px, kind, bpp):
    """Scan lines of H x S bytes, all with one PNG filter."""
    out, up = b"", np.zeros(px.shape[1], int)
    for row in px.astype(int):
        left = np.concatenate([np.zeros(bpp, int), row[:-bpp]])
        corner = np.concatenate([np.zeros(bpp, int), up[:-bpp]])
        p = left + up - corner
        d = np.abs(np.stack([p - left, p - up, p - corner]))
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], up, corner))
        guess = (0, left, up, (left + up) // 2, paeth)[kind]
        out += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        up = row
    return out


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    px = textured(1, 13)
    mode, got = decode(png(13, 13, 8, 2, filtered(px.reshape(13, -1), kind, 3)))
    assert mode == "RGB" and (got == px).all()


def test_png_kinds():
    row = np.arange(16, dtype=np.uint8)
    assert decode(png(16, 1, 8, 0, b"\0" + row.tobytes()))[0] == "L"
    mode, px = decode(png(16, 1, 1, 0, b"\0\xaa\xaa"))
    assert mode == "1" and px[0, :4, 0].tolist() == [255, 0, 255, 0]
    mode, px = decode(png(3, 1, 16, 0, b"\0" + struct.pack(">3H", 7, 300, 65535)))
    assert mode == "I;16" and px[0, :, 0].tolist() == [7, 300, 65535] and grey(mode, px).tolist() == [[7, 255, 255]]
    mode, px = decode(png(4, 1, 2, 3, b"\0\x1b", palette=bytes(range(12))))
    assert mode == "P" and px[0].tolist() == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11]]
    assert decode(png(1, 1, 8, 6, b"\0abcd"))[0] == "RGBA" and decode(png(1, 1, 8, 4, b"\0ab"))[0] == "LA"


def test_png_interlaced():
    px, lines = textured(2, 9), b""
    for x0, y0, dx, dy in ADAM7:
        part = px[y0::dy, x0::dx]
        if part.size:
            lines += filtered(part.reshape(len(part), -1), 2, 3)
    assert (decode(png(9, 9, 8, 2, lines, interlace=1))[1] == px).all()


def test_broken_files_are_told_apart():
    good = encode_png(textured(3))
    for bad in (b"", b"junk" * 20, good[: len(good) // 3], good[:-14], PNG_SIGNATURE + b"garbage", b"BM", b"\xff\xd8\xff\xe0", b"II*\0zz"):
        with pytest.raises(Broken):
            decode(bad)
    wrong = png(1, 1, 8, 0, b"\0a", crc_ok=False)
    f = facts(wrong)
    assert not f["ok"] and "checksum" in f["error"] and f["decodable"]  # loads, but does not verify
    with pytest.raises(Unsupported):
        decode(b"RIFF\0\0\0\0WEBPVP8 ")


def test_bmp_and_tiff():
    px = textured(4, 5)
    stride = (5 * 24 + 31) // 32 * 4
    lines = b"".join(bytes(r[:, ::-1].tobytes()).ljust(stride, b"\0") for r in px[::-1])
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(lines), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 5, 5, 1, 24, 0, len(lines), 0, 0, 0, 0) + lines
    assert decode(bmp)[0] == "RGB" and (decode(bmp)[1] == px).all()
    with pytest.raises(Broken):
        decode(bmp[:-9])
    for packing, data in ((1, px.tobytes()), (8, zlib.compress(px.tobytes()))):
        tags = [(256, 3, 1, 5), (257, 3, 1, 5), (258, 3, 1, 8), (259, 3, 1, packing), (262, 3, 1, 2), (273, 4, 1, 8), (277, 3, 1, 3), (279, 4, 1, len(data))]
        ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        assert (decode(b"II*\0" + struct.pack("<I", 8 + len(data)) + data + ifd)[1] == px).all()


def jvm_image(spark, px):
    image = spark.sparkContext._jvm.java.awt.image.BufferedImage(px.shape[1], px.shape[0], 1)
    for j in range(px.shape[0]):
        for i in range(px.shape[1]):
            image.setRGB(i, j, int(px[j, i, 0]) << 16 | int(px[j, i, 1]) << 8 | int(px[j, i, 2]))
    return image


def jvm_file(spark, px, kind, change=lambda parameters: None):
    """The picture as the JVM's own encoder writes it."""
    jvm = spark.sparkContext._jvm
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName(kind).next()
    parameters = writer.getDefaultWriteParam()
    change(parameters)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(jvm_image(spark, px), None, None), parameters)
    stream.flush()
    return bytes(out.toByteArray())


@pytest.fixture(scope="module")
def ramp():
    y, x = np.mgrid[:41, :59]
    return np.stack([x * 4, y * 6, 255 - x * 4], 2).astype(np.uint8)


@pytest.mark.parametrize("progressive", [False, True])
def test_jpeg_from_the_jvm(spark, ramp, progressive):
    data = jvm_file(spark, ramp, "jpg", lambda p: p.setProgressiveMode(1 if progressive else 0))
    mode, got = decode(data)
    assert (b"\xff\xc2" in data) == progressive
    assert mode == "RGB" and got.shape == ramp.shape and np.abs(got.astype(int) - ramp).mean() < 6
    stream = spark.sparkContext._jvm.java.io.ByteArrayInputStream(data)
    theirs = spark.sparkContext._jvm.javax.imageio.ImageIO.read(stream)
    for i, j in ((0, 0), (30, 20), (58, 40)):
        rgb = theirs.getRGB(i, j)
        assert max(abs(int(a) - b) for a, b in zip(got[j, i], (rgb >> 16 & 255, rgb >> 8 & 255, rgb & 255), strict=True)) < 24
    with pytest.raises(Broken):
        decode(data[: len(data) // 2])


@pytest.mark.parametrize("packing", ["LZW", "Deflate", "PackBits"])
def test_tiff_from_the_jvm(spark, ramp, packing):
    def change(p):
        p.setCompressionMode(2)
        p.setCompressionType(packing)

    for px in (ramp, np.random.default_rng(1).integers(0, 256, (40, 90, 3), dtype=np.uint8)):
        mode, got = decode(jvm_file(spark, px, "tiff", change))
        assert mode == "RGB" and (got == px).all()


@pytest.mark.parametrize("packing", [None, "LZW", "Deflate"])
def test_tiled_tiff_from_the_jvm(spark, ramp, packing):
    def change(p):
        if packing:
            p.setCompressionMode(2)
            p.setCompressionType(packing)
        p.setTilingMode(2)
        p.setTiling(32, 16, 0, 0)

    data = jvm_file(spark, ramp, "tiff", change)
    mode, got = decode(data)
    assert mode == "RGB" and (got == ramp).all()
    with pytest.raises(Broken):
        decode(data[: len(data) // 3])


def test_grey_and_resample():
    assert grey("RGB", np.array([[[255, 255, 255], [255, 0, 0], [0, 0, 0]]], np.uint8)).tolist() == [[255, 76, 0]]
    flat = np.full((31, 17), 93, np.uint8)
    assert (resample(flat, 9, 8) == 93).all()
    px = textured(5)[:, :, 0]
    assert (resample(px, 48, 48) == px).all()


def test_difference_hash():
    a = textured(6)[:, :, 0]
    base = difference_hash(a)
    assert base == difference_hash(a.copy())

    def apart(other):
        return bin((base ^ difference_hash(other)) & (1 << 64) - 1).count("1")

    assert apart(near(a, 1)) <= 5 < apart(textured(7)[:, :, 0])
    assert difference_hash(np.tile(np.arange(96, dtype=np.uint8), (96, 1))) == -1
    with pytest.raises(ValueError):
        difference_hash(a, 9)
