"""A small image kernel in numpy: sniff, verify, decode, grey, resample, hash.

Formats by content, not by name: PNG (all colour types, depths and interlacing), BMP (uncompressed),
Huffman-coded JPEG (sequential and progressive), TIFF (strips and tiles: uncompressed, LZW, PackBits, Deflate).  Others, WebP among them, are decoded with Pillow
where it is installed and raise ``Unsupported`` where it is not.
"""

from __future__ import annotations

import io
import struct
import zlib
from functools import lru_cache

import numpy as np


class Broken(ValueError):
    """The bytes are not a whole image."""


class Unsupported(ValueError):
    """The format has no decoder here."""


PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples per pixel by PNG colour type, and Adam7's (x0, y0, dx, dy).
PNG_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _png_mode(depth: int, kind: int) -> str:
    if kind == 0:
        return {1: "1", 16: "I;16"}.get(depth, "L")
    return {2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}[kind]


def _chunks(data: bytes, strict: bool):
    at = 8
    while True:
        if at + 12 > len(data):
            raise Broken("PNG ends before its end chunk")
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data):
            raise Broken("PNG chunk is cut off")
        body = data[at + 8 : at + 8 + size]
        if (strict or kind in (b"IHDR", b"PLTE")) and zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            raise Broken(f"PNG checksum of {kind.decode('latin-1')} is wrong")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size


def _unfilter(raw: memoryview, rows: int, stride: int, bpp: int) -> np.ndarray:
    if len(raw) < rows * (stride + 1):
        raise Broken("PNG pixel data is short")
    lines = np.frombuffer(raw[: rows * (stride + 1)], np.uint8).reshape(rows, stride + 1)
    out = np.zeros((rows + 1, stride), np.uint8)
    for y in range(rows):
        kind, line, up = lines[y, 0], lines[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            padded = np.zeros(-(-stride // bpp) * bpp, np.uint8)
            padded[:stride] = line
            out[y + 1] = np.cumsum(padded.reshape(-1, bpp), axis=0, dtype=np.uint8).ravel()[:stride]
        elif kind == 2:
            out[y + 1] = line + up
        elif kind in (3, 4):
            cur, a_line, b_line = bytearray(stride), line.tolist(), up.tolist()
            for x in range(stride):
                a = cur[x - bpp] if x >= bpp else 0
                b = b_line[x]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = b_line[x - bpp] if x >= bpp else 0
                    p = a + b - c
                    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if da <= db and da <= dc else b if db <= dc else c
                cur[x] = (a_line[x] + guess) & 255
            out[y + 1] = np.frombuffer(cur, np.uint8)
        else:
            raise Broken("PNG filter is unknown")
    return out[1:]


def _samples(lines: np.ndarray, width: int, count: int, depth: int) -> np.ndarray:
    if depth == 16:
        flat = lines.reshape(len(lines), -1, 2).astype(np.uint16)
        flat = flat[:, :, 0] << 8 | flat[:, :, 1]
    elif depth == 8:
        flat = lines
    else:
        bits = np.unpackbits(lines, axis=1).reshape(len(lines), -1, depth)
        flat = bits.dot(1 << np.arange(depth - 1, -1, -1)).astype(np.uint8)
    return flat[:, : width * count].reshape(len(lines), width, count)


def _png(data: bytes, strict: bool) -> tuple[str, np.ndarray]:
    header, palette, packed, ended = None, None, [], False
    for kind, body in _chunks(data, strict):
        if kind == b"IHDR":
            if len(body) != 13:
                raise Broken("PNG header has a wrong size")
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
    if header is None or not ended or not packed:
        raise Broken("PNG lacks its header, data or end")
    width, height, depth, kind, _, _, interlace = header
    if not width or not height or kind not in PNG_SAMPLES or depth not in (1, 2, 4, 8, 16):
        raise Broken("PNG header is not valid")
    try:
        raw = memoryview(zlib.decompressobj().decompress(b"".join(packed)))
    except zlib.error as e:
        raise Broken("PNG data does not inflate") from e
    n = PNG_SAMPLES[kind]
    bpp = max(1, n * depth // 8)
    if not interlace:
        stride = -(-width * n * depth // 8)
        px = _samples(_unfilter(raw, height, stride, bpp), width, n, depth)
    else:
        px, at = np.zeros((height, width, n), np.uint16 if depth == 16 else np.uint8), 0
        for x0, y0, dx, dy in ADAM7:
            w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
            if w > 0 and h > 0:
                stride = -(-w * n * depth // 8)
                px[y0::dy, x0::dx] = _samples(_unfilter(raw[at:], h, stride, bpp), w, n, depth)
                at += h * (stride + 1)
    mode = _png_mode(depth, kind)
    if kind == 3:
        if palette is None:
            raise Broken("PNG palette is missing")
        full = np.zeros((256, 3), np.uint8)
        full[: len(palette)] = palette
        px = full[px[:, :, 0]]
    elif depth == 16 and kind != 0:
        px = (px >> 8).astype(np.uint8)
    elif depth < 8:
        px = (px * (255 // ((1 << depth) - 1))).astype(np.uint8)
    return mode, px


def _bmp(data: bytes) -> tuple[str, np.ndarray]:
    if len(data) < 54:
        raise Broken("BMP header is cut off")
    start, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<IiiHHI", data, 14)
    size, width, height, _, depth, packing = head
    if size < 40 or packing not in (0, 3) or depth not in (1, 4, 8, 24, 32):
        raise Unsupported("BMP variant")
    stride, rows = (width * depth + 31) // 32 * 4, abs(height)
    if width <= 0 or not rows or len(data) < start + stride * rows:
        raise Broken("BMP pixel data is short")
    lines = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    lines = lines[::-1] if height > 0 else lines
    if depth <= 8:
        palette = np.frombuffer(data[14 + size : start], np.uint8)
        palette = palette[: len(palette) // 4 * 4].reshape(-1, 4)[:, 2::-1]
        index = _samples(lines, width, 1, depth)[:, :, 0]
        if index.max(initial=0) >= len(palette):
            raise Broken("BMP palette is short")
        grey = (palette == np.arange(len(palette))[:, None]).all() and depth == 8
        return ("L", index[:, :, None]) if grey else ("P", palette[index])
    return "RGB", lines[:, : width * depth // 8].reshape(rows, width, depth // 8)[:, :, 2::-1]


def _tiff(data: bytes) -> tuple[str, np.ndarray]:
    e = "<" if data[:2] == b"II" else ">"
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}
    codes = {1: "B", 2: "B", 3: "H", 4: "I"}
    try:
        at = struct.unpack_from(e + "I", data, 4)[0]
        tags = {}
        for i in range(struct.unpack_from(e + "H", data, at)[0]):
            tag, kind, n = struct.unpack_from(e + "HHI", data, at + 2 + 12 * i)
            if kind in codes:
                place = at + 10 + 12 * i if sizes[kind] * n <= 4 else struct.unpack_from(e + "I", data, at + 10 + 12 * i)[0]
                tags[tag] = struct.unpack_from(f"{e}{n}{codes[kind]}", data, place)
        width, height, packing = tags[256][0], tags[257][0], tags.get(259, (1,))[0]
        depth, n, photo = tags.get(258, (1,))[0], tags.get(277, (1,))[0], tags[262][0]
        predictor = tags.get(317, (1,))[0]
        if packing not in (1, 5, 8, 32946, 32773) or depth not in (1, 8, 16) or tags.get(284, (1,))[0] != 1 or predictor not in (1, 2) or (predictor == 2 and depth != 8) or photo not in (0, 1, 2, 3):
            raise Unsupported("TIFF variant")
        unpack = {1: bytes, 5: _lzw, 32773: _packbits}.get(packing, zlib.decompress)
        parts = []
        for start, count in zip(tags[324 if 322 in tags else 273], tags[325 if 322 in tags else 279], strict=True):
            if start + count > len(data):
                raise Broken("TIFF strip or tile is cut off")
            parts.append(unpack(data[start : start + count]))
    except (struct.error, KeyError, zlib.error) as x:
        raise Broken("TIFF is not whole") from x
    if not width or not height:
        raise Broken("TIFF has no pixels")
    if 322 in tags:
        wide, tall = tags[322][0], tags[323][0]
        across, down = (-(-width // wide), -(-height // tall)) if wide and tall else (0, 0)
        if not across or len(parts) < across * down:
            raise Broken("TIFF lacks tiles")
        tiles = [_tiff_pixels(x, wide, tall, n, depth, e, predictor) for x in parts[: across * down]]
        rows = [np.concatenate(tiles[y * across : (y + 1) * across], 1) for y in range(down)]
        px = np.concatenate(rows, 0)[:height, :width]
    else:
        px = _tiff_pixels(b"".join(parts), width, height, n, depth, e, predictor)
    if photo == 3:
        table = (np.array(tags[320]).reshape(3, -1).T >> 8).astype(np.uint8)
        return "P", table[px[:, :, 0]]
    px = px * 255 if depth == 1 else px
    px = (1 << max(8, depth)) - 1 - px if photo == 0 else px
    if n == 1:
        return ("1" if depth == 1 else "I;16" if depth == 16 else "L"), px
    return ("RGB" if n == 3 else "RGBA"), (px >> 8 if depth == 16 else px).astype(np.uint8)


def _tiff_pixels(raw: bytes, width: int, height: int, n: int, depth: int, e: str, predictor: int) -> np.ndarray:
    """Pixels (height x width x samples) of unpacked strips, or of one tile."""
    stride = -(-width * n * depth // 8)
    if len(raw) < stride * height:
        raise Broken("TIFF pixel data is short")
    if depth == 16:
        return np.frombuffer(raw, e + "u2", width * n * height).reshape(height, width, n)
    px = _samples(np.frombuffer(raw, np.uint8, stride * height).reshape(height, stride), width, n, depth)
    return np.cumsum(px, axis=1, dtype=np.uint8) if predictor == 2 else px


def _packbits(part: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(part):
        n = part[at]
        if n < 128:
            out += part[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += part[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def _lzw(part: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; 256 clears the table and 257 ends."""
    out, held, count, width, before, table = bytearray(), 0, 0, 9, b"", []
    for byte in part:
        held, count = held << 8 | byte, count + 8
        while count >= width:
            code = held >> (count - width) & ((1 << width) - 1)
            count -= width
            held &= (1 << count) - 1
            if code == 256:
                table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
                continue
            if code == 257:
                return bytes(out)
            if not table or code > len(table) or (code == len(table) and not before):
                raise Broken("TIFF code is out of its table")
            entry = table[code] if code < len(table) else before + before[:1]
            out += entry
            if before:
                table.append(before + entry[:1])
            before = entry
            width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return bytes(out)


@lru_cache(1)
def _zigzag() -> np.ndarray:
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


@lru_cache(1)
def _cosines() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.where(k == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)


def _code_table(counts: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    """For each 16 bits that may come: how many of them are the code (0: none is), and its symbol."""
    sizes, values, at = [], [], 0
    for n, count in enumerate(counts, 1):
        for symbol in symbols[at : at + count]:
            sizes += [n] * (1 << (16 - n))
            values += [symbol] * (1 << (16 - n))
        at += count
    if len(sizes) > 65536 or at > len(symbols):
        raise Broken("JPEG code table is wrong")
    rest = 65536 - len(sizes)
    return sizes + [0] * rest, values + [0] * rest


class _Bits:
    """The entropy-coded bits of one scan; codes are looked up 16 bits at a time."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.count, self.end = data + bytes(4), 0, 0, 0, len(data) + 4

    def need(self, n: int) -> None:
        while self.count < n:
            if self.at >= self.end:
                raise Broken("JPEG data is cut off")
            self.held = (self.held << 8 | self.data[self.at]) & 0xFFFFFFFF
            self.at += 1
            self.count += 8

    def drop(self, n: int) -> None:
        """``n`` bits are used; the four zero bytes behind the data must not be."""
        self.count -= n
        if self.at * 8 - self.count > (self.end - 4) * 8:
            raise Broken("JPEG data is cut off")

    def take(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        self.drop(n)
        return self.held >> self.count & ((1 << n) - 1)

    def symbol(self, table: tuple) -> int:
        self.need(16)
        ahead = self.held >> (self.count - 16) & 0xFFFF
        n = table[0][ahead]
        if not n:
            raise Broken("JPEG code is unknown")
        self.drop(n)
        return table[1][ahead]

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


_NO_CODES = ([0] * 65536, [0] * 65536)


class _Scan:
    """One scan's way to read a block: sequential, or a band of coefficients at some precision."""

    def __init__(self, bits: _Bits, progressive: bool, first: int, last: int, done: int, low: int):
        self.bits, self.first, self.last, self.low, self.zig, self.run = bits, first, last, low, _zigzag().tolist(), 0
        if not progressive:
            self.read = self.sequential
        elif first == 0:
            self.read = self.dc_more if done else self.dc_first
        else:
            self.read = self.ac_more if done else self.ac_first

    def sequential(self, out, before: int, dc: tuple, ac: tuple) -> int:
        before = out[0] = before + self.bits.signed(self.bits.symbol(dc))
        k = 1
        while k < 64:
            rs = self.bits.symbol(ac)
            if rs == 0:
                break
            k += rs >> 4
            if k > 63:
                break
            out[self.zig[k]] = self.bits.signed(rs & 15)
            k += 1
        return before

    def dc_first(self, out, before: int, dc: tuple, ac: tuple) -> int:
        before += self.bits.signed(self.bits.symbol(dc))
        out[0] = before * (1 << self.low)
        return before

    def dc_more(self, out, before: int, dc: tuple, ac: tuple) -> int:
        out[0] += self.bits.take(1) << self.low
        return before

    def ac_first(self, out, before: int, dc: tuple, ac: tuple) -> int:
        if self.run:
            self.run -= 1
            return before
        k = self.first
        while k <= self.last:
            rs = self.bits.symbol(ac)
            r, n = rs >> 4, rs & 15
            if not n and r < 15:
                self.run = (1 << r) - 1 + self.bits.take(r)
                break
            k += r
            if k > 63:
                raise Broken("JPEG coefficient is out of its block")
            if n:
                out[self.zig[k]] = self.bits.signed(n) * (1 << self.low)
            k += 1
        return before

    def ac_more(self, out, before: int, dc: tuple, ac: tuple) -> int:
        """Known coefficients gain a bit each; new ones come between runs of zeros."""
        step, k = 1 << self.low, self.first

        def refine(place: int) -> None:
            if self.bits.take(1) and not int(abs(out[place])) & step:
                out[place] += step if out[place] > 0 else -step

        while k <= self.last and not self.run:
            rs = self.bits.symbol(ac)
            zeros, n, value = rs >> 4, rs & 15, 0
            if n:
                value = step if self.bits.take(1) else -step
            elif zeros < 15:
                self.run = (1 << zeros) + self.bits.take(zeros)
                break
            while k <= self.last:
                place = self.zig[k]
                k += 1
                if out[place]:
                    refine(place)
                elif zeros == 0:
                    if value:
                        out[place] = value
                    break
                else:
                    zeros -= 1
        if self.run:
            for place in self.zig[k : self.last + 1]:
                if out[place]:
                    refine(place)
            self.run -= 1
        return before


def _entropy_end(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The parts between restart markers, without stuffing, and where the next marker is."""
    parts, start, p = [], at, at
    while True:
        p = data.find(b"\xff", p)
        if p < 0 or p + 1 >= len(data):
            raise Broken("JPEG data is cut off")
        if data[p + 1] == 0:
            p += 2
        elif data[p + 1] == 0xFF:
            p += 1
        elif 0xD0 <= data[p + 1] <= 0xD7:
            parts.append(data[start:p].replace(b"\xff\x00", b"\xff"))
            start = p = p + 2
        else:
            return [*parts, data[start:p].replace(b"\xff\x00", b"\xff")], p


def _jpeg(data: bytes) -> tuple[str, np.ndarray]:
    """Huffman-coded JPEG, sequential or progressive, in any number of scans."""
    at, quant, codes, frame, restart, progressive, scanned, adobe = 2, {}, {}, None, 0, False, set(), None
    while True:
        at = data.find(b"\xff", at)
        while 0 <= at < len(data) and data[at] == 0xFF:
            at += 1
        if at < 0 or at >= len(data):
            raise Broken("JPEG ends before its end marker")
        mark = data[at]
        if mark == 0xD9:
            break
        if at + 3 > len(data):
            raise Broken("JPEG ends within a segment")
        size = int.from_bytes(data[at + 1 : at + 3], "big")
        body, at = data[at + 3 : at + 1 + size], at + 1 + size
        if at > len(data):
            raise Broken("JPEG segment is cut off")
        if mark == 0xDB:
            p = 0
            while p < len(body):
                wide, which = body[p] >> 4, body[p] & 15
                table = np.frombuffer(body, ">u2" if wide else np.uint8, 64, p + 1).astype(float)
                quant[which] = np.zeros(64)
                quant[which][_zigzag()] = table
                p += 65 + 64 * bool(wide)
        elif mark == 0xC4:
            p = 0
            while p + 17 <= len(body):
                counts = body[p + 1 : p + 17]
                codes[body[p]] = _code_table(counts, body[p + 17 : p + 17 + sum(counts)])
                p += 17 + sum(counts)
        elif mark in (0xC0, 0xC1, 0xC2):
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            progressive = mark == 0xC2
            frame = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
            if depth != 8 or not width or not height or n not in (1, 3, 4) or len(frame) != n:
                raise Unsupported("JPEG variant")
            hmax, vmax = max(c[0] for c in frame.values()), max(c[1] for c in frame.values())
            across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
            blocks = {name: np.zeros((down * v, across * h, 64)) for name, (h, v, _) in frame.items()}
        elif 0xC3 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            raise Unsupported("JPEG coding")
        elif mark == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            adobe = body[11]
        elif mark == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif mark == 0xDA:
            if frame is None:
                raise Broken("JPEG data comes before its frame")
            n = body[0]
            use = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(n)]
            low, high, precision = body[1 + 2 * n : 4 + 2 * n]
            parts, at = _entropy_end(data, at)
            units = []  # for each unit of the scan, the blocks it holds
            if n == 1:
                h, v, _ = frame[use[0][0]]
                wide, tall = -(-(-(-width * h // hmax)) // 8), -(-(-(-height * v // vmax)) // 8)
                units = [[(use[0], y, x)] for y in range(tall) for x in range(wide)]
            else:
                for m in range(across * down):
                    my, mx = divmod(m, across)
                    units.append([(u, my * frame[u[0]][1] + y, mx * frame[u[0]][0] + x) for u in use for y in range(frame[u[0]][1]) for x in range(frame[u[0]][0])])
            done = 0
            for part in parts:
                scan, last = _Scan(_Bits(part), progressive, low, high, precision >> 4, precision & 15), dict.fromkeys(frame, 0)
                for unit in units[done : done + restart] if restart else units[done:]:
                    for (name, tables), y, x in unit:
                        last[name] = scan.read(blocks[name][y, x], last[name], codes.get(tables >> 4, _NO_CODES), codes.get(16 | tables & 15, _NO_CODES))
                    done += 1
            if done < len(units):
                raise Broken("JPEG data is cut off")
            scanned |= {u[0] for u in use}
    if frame is None or scanned != set(frame):
        raise Broken("JPEG lacks data of a component")
    planes, basis = [], _cosines()
    for name, (h, v, q) in frame.items():
        if q not in quant:
            raise Broken("JPEG lacks a table")
        b = (blocks[name] * quant[q]).reshape(*blocks[name].shape[:2], 8, 8)
        b = np.einsum("yu,abyx,xv->abuv", basis, b, basis) + 128
        plane = b.transpose(0, 2, 1, 3).reshape(b.shape[0] * 8, -1)
        planes.append(np.repeat(np.repeat(plane, vmax // v, 0), hmax // h, 1)[:height, :width])
    px = np.stack(planes, 2)
    if len(frame) >= 3 and adobe != 0 and (len(frame) == 3 or adobe == 2):
        y, cb, cr = px[:, :, 0], px[:, :, 1] - 128, px[:, :, 2] - 128
        px = np.concatenate([np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2), px[:, :, 3:]], 2)
    px = np.clip(np.rint(px), 0, 255).astype(np.uint8)
    if len(frame) == 4 and adobe is not None:
        px = 255 - px  # such files hold inverted inks
    return {1: "L", 3: "RGB", 4: "CMYK"}[len(frame)], px


def _pillow(data: bytes, strict: bool) -> tuple[str, np.ndarray]:
    try:
        from PIL import Image
    except ImportError as e:
        raise Unsupported("no decoder for this format") from e
    try:
        if strict:
            with Image.open(io.BytesIO(data)) as image:
                image.verify()
        image = Image.open(io.BytesIO(data))
        image.load()
        return image.mode, np.asarray(image.convert("L"))[:, :, None]
    except Exception as e:  # any failure of the library means a broken file
        raise Broken(f"{type(e).__name__}") from e


def decode(data: bytes, strict: bool = True) -> tuple[str, np.ndarray]:
    """(mode, height x width x samples); ``strict`` also verifies checksums.  Raises Broken or Unsupported."""
    try:
        if data[:8] == PNG_SIGNATURE:
            return _png(data, strict)
        if data[:2] == b"BM":
            return _bmp(data)
        if data[:3] == b"\xff\xd8\xff":
            try:
                return _jpeg(data)
            except Unsupported:
                return _pillow(data, strict)
        if data[:4] in (b"II*\x00", b"MM\x00*"):
            try:
                return _tiff(data)
            except Unsupported:
                return _pillow(data, strict)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return _pillow(data, strict)
    except (struct.error, IndexError, KeyError, ValueError) as e:
        if isinstance(e, (Broken, Unsupported)):
            raise
        raise Broken(f"{type(e).__name__} while decoding") from e
    raise Broken("no image format is recognised")


def grey(mode: str, px: np.ndarray) -> np.ndarray:
    """8-bit luma (ITU-R 601, 16-bit fixed point); alpha is ignored, 16-bit grey saturates."""
    if px.shape[2] in (1, 2):
        return np.minimum(px[:, :, 0], 255).astype(np.uint8)
    x = px.astype(np.uint32)
    if mode == "CMYK":
        x = 255 - np.minimum(255, x[:, :, :3] + x[:, :, 3:])
    return ((19595 * x[:, :, 0] + 38470 * x[:, :, 1] + 7471 * x[:, :, 2] + 0x8000) >> 16).astype(np.uint8)


@lru_cache(4096)
def _lanczos(n: int, size: int) -> np.ndarray:
    """size x n weights of the three-lobed filter, widened when it shrinks, in 22-bit fixed point."""
    scale = n / size
    wide = max(scale, 1.0)
    center = (np.arange(size) + 0.5) * scale
    low = np.maximum((center - 3 * wide + 0.5).astype(int), 0)
    high = np.minimum((center + 3 * wide + 0.5).astype(int), n)
    at = np.arange(n)[None, :]
    x = (at + 0.5 - center[:, None]) / wide
    w = np.where((np.abs(x) < 3) & (at >= low[:, None]) & (at < high[:, None]), np.sinc(x) * np.sinc(x / 3), 0)
    w /= w.sum(1, keepdims=True)
    return np.trunc(w * (1 << 22) + np.copysign(0.5, w)).astype(np.int64)


def resample(px: np.ndarray, width: int, height: int) -> np.ndarray:
    """Lanczos: first along rows, then along columns, rounded to 8 bits after each."""
    half = 1 << 21
    across = np.clip((px.astype(np.int64) @ _lanczos(px.shape[1], width).T + half) >> 22, 0, 255)
    return np.clip((_lanczos(px.shape[0], height) @ across + half) >> 22, 0, 255).astype(np.uint8)


def difference_hash(px: np.ndarray, size: int = 8) -> int:
    """Bits 'right is brighter' of a (size + 1) x size reduction, row by row, first bit highest; as a signed long."""
    if not 1 <= size <= 8:
        raise ValueError("a hash of more than 64 bits does not fit a long")
    small = resample(px, size + 1, size).astype(int)
    value = int("".join("1" if b else "0" for b in (small[:, 1:] > small[:, :-1]).ravel()), 2)
    return value - (1 << 64) if value >> 63 else value


def encode_png(px: np.ndarray, mode: str = "RGB") -> bytes:
    """A PNG of height x width (x samples) 8-bit pixels."""
    kind = {"L": 0, "RGB": 2, "LA": 4, "RGBA": 6}[mode]
    px = np.ascontiguousarray(px, np.uint8).reshape(px.shape[0], px.shape[1], -1)
    lines = np.concatenate([np.zeros((len(px), 1), np.uint8), px.reshape(len(px), -1)], 1)

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", px.shape[1], px.shape[0], 8, kind, 0, 0, 0)
    return PNG_SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def facts(data: bytes, thumb: int = 16, hash_size: int = 8) -> dict:
    """What one pass over a file's bytes tells: everything later checks need, without its pixels.

    ``decodable`` is null where the format has no decoder here, so that nobody takes the file for broken.
    """
    out = {"ok": False, "error": None, "width": None, "height": None, "mode": None, "pmin": None, "pmax": None, "dhash": None, "thumb": None, "decodable": False}
    try:
        mode, px = decode(data)
        out["ok"] = True
    except (Broken, Unsupported) as e:
        out["error"] = f"{'UnsupportedFormat' if isinstance(e, Unsupported) else 'CorruptImage'}: {e}"
        if isinstance(e, Unsupported):
            return out | {"decodable": None}
        try:
            mode, px = decode(data, strict=False)
        except (Broken, Unsupported):
            return out
    g = grey(mode, px)
    out["decodable"] = True
    out["thumb"] = (resample(g, thumb, thumb).astype(np.float32).ravel() / np.float32(255)).tolist()
    if out["ok"]:
        out |= {"height": px.shape[0], "width": px.shape[1], "mode": mode, "pmin": int(g.min()), "pmax": int(g.max())}
        if out["pmin"] != out["pmax"]:
            out["dhash"] = difference_hash(g, hash_size)
    return out
