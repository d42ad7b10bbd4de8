"""Media columns: payloads in progressive JPEG files, and their RGB tensors (operator 2).

Storing. A text's UTF-8 bytes, padded with spaces to a positive multiple of UNIT, become the quantised DCT coefficients of a
4:2:0 image, the format's own lossless unit: DC coefficients hold a byte b as b, AC coefficients as b + 256, so none is 0. The
file has the scans of a progressive JPEG: DC first and DC refinement over all components, then per component spectral bands,
each with a first scan of all bits but the last and a refinement scan of the last. A comment marker holds the payload's length.

Reading. The decoder takes any Huffman-coded progressive JPEG of 8 bits with 1 or 3 components (DC and AC, first and
refinement scans, bands, successive approximation, runs of empty blocks, restart intervals, any sampling of 1 and 2). Scans are
accumulated in coefficient arrays; numpy transforms the blocks strip by strip, chroma is upsampled by repetition, and the
result is a full-resolution uint8 RGB tensor. Two frequent patterns are decoded in bulk: scans of symbols of one fixed length,
and the correction bits of a run of blocks. Everything else goes symbol by symbol.

Null texts are empty; the least payload is one unit of spaces. Equal texts give equal files and features. Repeated rows
are stored each; very long texts make larger images (up to 65,520 pixels a side). Bits, transforms and colours are expanded
a bounded number of blocks at a time, so what grows with a text is about 12 times its bytes: itself, its file and the
coefficients, which as 32-bit numbers are four of them. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, need, table

UNIT = 192
MCU = 384
#: Blocks, and about as many pixels of a strip, that are expanded at once: a multiple of 8, so that they begin at a byte.
STEP, PIXELS = 1 << 12, 1 << 18
BANDS = {0: ((1, 5), (6, 63)), 1: ((1, 63),), 2: ((1, 63),)}


def _zigzag() -> np.ndarray:
    """Natural position of each zigzag index: diagonals in turn, their direction alternating."""
    order = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * y + x for y, x in order])


ZIGZAG = _zigzag()


def _basis() -> np.ndarray:
    """64 x 64: natural coefficients to natural samples."""
    c = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
    return np.einsum("vy,ux->vuyx", c, c).reshape(64, 64)


_BASIS = _basis()


# --- writing ---------------------------------------------------------------------------------------------------------


def _marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def _table(kind: int, number: int, symbols: list[int], length: int) -> bytes:
    """Huffman table whose symbols all have codes of one length."""
    counts = [len(symbols) if k == length else 0 for k in range(1, 17)]
    return _marker(0xC4, bytes([kind << 4 | number, *counts, *symbols]))


def _scan(components: list[int], ss: int, se: int, ah: int, al: int) -> bytes:
    head = bytes([len(components)]) + b"".join(bytes([c + 1, 0x00]) for c in components)
    return _marker(0xDA, head + bytes([ss, se, ah << 4 | al]))


def _pack(bits: np.ndarray) -> bytes:
    """Bits, padded with ones to whole bytes, with a 0 after each 255."""
    if r := -len(bits) % 8:
        bits = np.concatenate([bits, np.ones(r, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


_DC_LENGTH = 4
_DC_TABLE = _table(0, 0, list(range(10)), _DC_LENGTH)
_FIRST_TABLE = _table(1, 0, [0x08], 1)
_RUN_TABLE = _table(1, 0, [r << 4 for r in range(15)], 4)
_HEAD = b"\xff\xd8" + _marker(0xDB, b"\x00" + bytes([1] * 64))
_PLANES = np.arange(7, -1, -1, dtype=np.uint8)


def _dc_bits(values: np.ndarray) -> np.ndarray:
    """Huffman codes and amplitudes of differences."""
    size = np.zeros(len(values), np.int64)
    mag = np.abs(values)
    for k in range(10):
        size += mag >= 1 << k
    amp = np.where(values < 0, values + (1 << size) - 1, values)
    word, n = size << size | amp, size + _DC_LENGTH
    ends = np.cumsum(n)
    shift = np.repeat(ends, n) - 1 - np.arange(ends[-1])
    return (np.repeat(word, n) >> shift & 1).astype(np.uint8)


def _run_bits(blocks: int, width: int, low: np.ndarray) -> np.ndarray:
    """Refinement of blocks without zeros: an end-of-band run for up to 2**14 blocks, then their correction bits."""
    out, at = [], 0
    while at < blocks:
        k = min(14, (blocks - at).bit_length() - 1)
        n = min(blocks - at, (2 << k) - 1)
        extra = n - (1 << k)
        head = [k >> b & 1 for b in (3, 2, 1, 0)] + [extra >> b & 1 for b in range(k - 1, -1, -1)]
        out += [np.array(head, np.uint8), low[at * width : (at + n) * width]]
        at += n
    return np.concatenate(out)


def _first_words(band: np.ndarray) -> bytes:
    """First scan of non-zero coefficients: for each the code 0, then the 8 bits of (b + 256) >> 1."""
    out = []
    for at in range(0, len(band), 1 << 16):  # a multiple of 8 words fills whole bytes
        part = band[at : at + (1 << 16)]
        word = np.empty((len(part), 9), np.uint8)
        word[:, 0] = 0
        word[:, 1] = 1
        word[:, 2:] = part[:, None] >> _PLANES[None, :7] & 1
        bits = word.ravel()
        if r := -len(bits) % 8:
            bits = np.concatenate([bits, np.ones(r, np.uint8)])
        out.append(np.packbits(bits).tobytes())
    return b"".join(out).replace(b"\xff", b"\xff\x00")


def store(payload: bytes) -> bytes:
    """Progressive JPEG file of a payload, a multiple of UNIT long."""
    mcus = -(-len(payload) // MCU)
    cols = max(1, int(np.ceil(np.sqrt(mcus))))
    rows = -(-mcus // cols)
    raw = np.zeros(cols * rows * MCU, np.uint8)
    raw[: len(payload)] = np.frombuffer(payload, np.uint8)
    units = raw.reshape(rows, cols, 6, 64)
    dc = units[..., 0].astype(np.int64)
    out = [_HEAD, _marker(0xFE, b"payload %d" % len(payload)), _marker(0xC2, struct.pack(">BHHB", 8, rows * 16, cols * 16, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00"), _DC_TABLE, _scan([0, 1, 2], 0, 0, 0, 1)]
    diff = np.empty_like(dc.reshape(-1, 6))
    high = dc.reshape(-1, 6) >> 1
    luma = high[:, :4].ravel()
    diff[:, :4] = np.diff(luma, prepend=0).reshape(-1, 4)
    diff[:, 4:] = np.diff(high[:, 4:], axis=0, prepend=0)
    out += [_pack(_dc_bits(diff.ravel())), _scan([0, 1, 2], 0, 0, 1, 0), _pack((dc.ravel() & 1).astype(np.uint8))]
    # a scan of one component goes block row by block row, not MCU by MCU
    luma = units[:, :, :4].reshape(rows, cols, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    for c, plane in ((0, luma), (1, units[:, :, 4].reshape(-1, 64)), (2, units[:, :, 5].reshape(-1, 64))):
        for ss, se in BANDS[c]:
            band = np.ascontiguousarray(plane[:, ss : se + 1]).ravel()
            out += [_FIRST_TABLE, _scan([c], ss, se, 0, 1), _first_words(band), _RUN_TABLE, _scan([c], ss, se, 1, 0), _pack(_run_bits(len(plane), se - ss + 1, band & 1))]
    return b"".join(out) + b"\xff\xd9"


# --- reading ---------------------------------------------------------------------------------------------------------


class _Bits:
    """Bits of one entropy-coded segment with a cursor; never unpacked as a whole. Behind the end there are ones."""

    def __init__(self, segment: bytes):
        self.raw = segment.replace(b"\xff\x00", b"\xff")
        self.at, self.size = 0, 8 * len(self.raw)

    def part(self, a: int, b: int) -> np.ndarray:
        """Bits a to b, as bytes of 0 and 1."""
        low = a >> 3
        return np.unpackbits(np.frombuffer(self.raw[low : b + 7 >> 3], np.uint8))[a - 8 * low : b - 8 * low]

    def peek(self, n: int) -> int:
        low, high = self.at >> 3, self.at + n + 7 >> 3
        got = self.raw[low:high].ljust(high - low, b"\xff")
        return int.from_bytes(got, "big") >> (8 * high - self.at - n) & (1 << n) - 1

    def take(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        return v

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        word = self.peek(16)
        for n in range(1, 17):
            if (s := codes.get((n, word >> 16 - n))) is not None:
                self.at += n
                return s
        raise ValueError("no such Huffman code")


def _extend(v: int, size: int) -> int:
    return v if not size or v >> (size - 1) else v - (1 << size) + 1


class Frame:
    """A progressive frame: components with coefficient arrays (block rows, block columns, 64 in zigzag order)."""

    def __init__(self, body: bytes):
        bits, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if bits != 8 or n not in (1, 3):
            raise ValueError("8 bits and 1 or 3 components only")
        self.parts = [{"id": body[6 + 3 * k], "h": body[7 + 3 * k] >> 4, "v": body[7 + 3 * k] & 15, "q": body[8 + 3 * k]} for k in range(n)]
        self.hmax, self.vmax = max(p["h"] for p in self.parts), max(p["v"] for p in self.parts)
        self.mcux, self.mcuy = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for p in self.parts:
            p["coef"] = np.zeros((self.mcuy * p["v"], self.mcux * p["h"], 64), np.int32)
            # blocks that a scan of this component alone has
            p["bx"] = -(-(-(-self.width * p["h"] // self.hmax)) // 8)
            p["by"] = -(-(-(-self.height * p["v"] // self.vmax)) // 8)

    def order(self, which: list[int]) -> list[np.ndarray]:
        """Flat block numbers of each component, in scan order; of several components, MCU by MCU."""
        if len(which) == 1:
            p = self.parts[which[0]]
            return [(np.arange(p["by"])[:, None] * p["coef"].shape[1] + np.arange(p["bx"])).ravel()]
        out = []
        for k in which:
            p = self.parts[k]
            at = np.arange(self.mcuy * p["v"])[:, None] * p["coef"].shape[1] + np.arange(self.mcux * p["h"])
            out.append(at.reshape(self.mcuy, p["v"], self.mcux, p["h"]).transpose(0, 2, 1, 3).reshape(-1, p["v"] * p["h"]))
        return out


def _codes(body: bytes, tables: dict) -> None:
    at = 0
    while at < len(body):
        key, counts, symbols = body[at], body[at + 1 : at + 17], body[at + 17 : at + 17 + sum(body[at + 1 : at + 17])]
        code, k, table = 0, 0, {}
        for n in range(1, 17):
            for _ in range(counts[n - 1]):
                table[(n, code)] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        tables[key] = table
        at += 17 + k


def _dc_scan(frame: Frame, which: list[int], tables: list[dict], ah: int, al: int, segments: list[bytes], every: int) -> None:
    order = frame.order(which)
    flats = [frame.parts[k]["coef"].reshape(-1, 64) for k in which]
    if len(which) == 1:
        order = [o[:, None] for o in order]
    for s, segment in enumerate(segments):
        part = [o[s * every : (s + 1) * every] if every else o for o in order]
        bits = _Bits(segment)
        if ah:
            width = sum(o.shape[1] for o in part)
            for begin in range(0, len(part[0]), STEP):
                some = [o[begin : begin + STEP] for o in part]
                got = bits.part(begin * width, (begin + len(some[0])) * width).reshape(-1, width).astype(np.int32) << al
                at = 0
                for o, flat in zip(some, flats):
                    flat[o, 0] |= got[:, at : at + o.shape[1]]
                    at += o.shape[1]
            continue
        last, values = [0] * len(which), [[] for _ in which]
        seq = [k for k, o in enumerate(part) for _ in range(o.shape[1])]
        lengths = {n for k in range(len(which)) for n, _ in tables[k]}
        if len(lengths) == 1:  # codes of one length: a loop over one list
            n0 = lengths.pop()
            flat_codes = [[t.get((n0, c), 0) for c in range(1 << n0)] for t in tables]
            text, at = "".join(map(str, bits.part(0, bits.size).tolist())), 0
            for _ in range(len(part[0])):
                for k in seq:
                    size = flat_codes[k][int(text[at : at + n0], 2)]
                    at += n0
                    if size:
                        last[k] += _extend(int(text[at : at + size], 2), size)
                        at += size
                    values[k].append(last[k])
        else:
            for _ in range(len(part[0])):
                for k in seq:
                    size = bits.symbol(tables[k])
                    last[k] += _extend(bits.take(size), size)
                    values[k].append(last[k])
        for o, flat, v in zip(part, flats, values):
            flat[o.ravel(), 0] = np.array(v, np.int32) << al


def _ac_first(flat: np.ndarray, blocks: np.ndarray, codes: dict, ss: int, se: int, al: int, bits: _Bits) -> None:
    width = se - ss + 1
    if len(codes) == 1:
        (length, _), symbol = next(iter(codes.items()))
        size = symbol & 15
        each = width * (length + size)
        if size and not symbol >> 4 and bits.size >= len(blocks) * each:
            for begin in range(0, len(blocks), STEP):
                some = blocks[begin : begin + STEP]
                word = bits.part(begin * each, (begin + len(some)) * each).reshape(-1, length + size)
                if size == 8:
                    v = np.packbits(word[:, length:], axis=1)[:, 0].astype(np.int32)
                else:
                    v = word[:, length:].astype(np.int32) @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
                v = np.where(word[:, length] == 1, v, v - (1 << size) + 1)
                flat[some, ss : se + 1] = (v << al).reshape(-1, width)
            return
    run = 0
    for b in blocks.tolist():
        if run:
            run -= 1
            continue
        k = ss
        while k <= se:
            symbol = bits.symbol(codes)
            r, size = symbol >> 4, symbol & 15
            if not size:
                if r < 15:
                    run = (1 << r) - 1 + bits.take(r)
                    break
                k += 16
                continue
            k += r
            flat[b, k] = _extend(bits.take(size), size) << al
            k += 1


def _ac_refine(flat: np.ndarray, blocks: np.ndarray, codes: dict, ss: int, se: int, al: int, bits: _Bits) -> None:
    one, n = 1 << al, 0
    while n < len(blocks):
        row, k, run = flat[blocks[n]], ss, 0
        while k <= se:
            symbol = bits.symbol(codes)
            r, size = symbol >> 4, symbol & 15
            value = 0
            if size:
                value = one if bits.take(1) else -one
            elif r < 15:
                run = (1 << r) + bits.take(r)
                break
            while k <= se:
                if row[k]:
                    if bits.take(1) and not abs(int(row[k])) & one:
                        row[k] += one if row[k] > 0 else -one
                elif r == 0:
                    break
                else:
                    r -= 1
                k += 1
            if value and k <= se:
                row[k] = value
            k += 1
        if not run:
            n += 1
            continue
        # the rest of this block and the next run - 1 blocks have only correction bits
        for begin in range(n, min(n + run, len(blocks)), STEP):
            many = blocks[begin : min(begin + STEP, n + run)]
            part = flat[many, ss : se + 1]
            live = part != 0
            if k > ss and begin == n:
                live[0, : k - ss] = False
            count = int(live.sum())
            got = bits.part(bits.at, bits.at + count)
            bits.at += count
            old = part[live]
            part[live] = np.where((got == 1) & (np.abs(old) & one == 0), old + np.sign(old) * one, old)
            flat[many, ss : se + 1] = part
        n += run


_ENDS = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def read_coefficients(data: bytes) -> tuple[Frame, dict[int, np.ndarray], list[bytes]]:
    """The frame with all scans accumulated, the quantisation tables (zigzag order) and the comments."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, frame, tables, quant, comments, interval = 2, None, {}, {}, [], 0
    while at < len(data):
        while data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        code = data[at + 1]
        if code == 0xD9:
            break
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if code == 0xC2:
            frame = Frame(body)
        elif 0xC0 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only Huffman-coded progressive frames")
        elif code == 0xC4:
            _codes(body, tables)
        elif code == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                n = 128 if wide else 64
                quant[body[k] & 15] = np.frombuffer(body[k + 1 : k + 1 + n], ">u2" if wide else np.uint8).astype(np.float64)
                k += 1 + n
        elif code == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif code == 0xFE:
            comments.append(body)
        elif code == 0xDA:
            n = body[0]
            ids = [p["id"] for p in frame.parts]
            which = [ids.index(body[1 + 2 * k]) for k in range(n)]
            chosen = [body[2 + 2 * k] for k in range(n)]
            ss, se, ah, al = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            end = m.start() if (m := _ENDS.search(data, at)) else len(data)
            segments = _RESTART.split(data[at:end]) if interval else [data[at:end]]
            at = end
            if ss == 0:
                _dc_scan(frame, which, [tables.get(c >> 4, {}) for c in chosen], ah, al, segments, interval)
            else:
                flat = frame.parts[which[0]]["coef"].reshape(-1, 64)
                blocks = frame.order(which)[0]
                for s, segment in enumerate(segments):
                    part = blocks[s * interval : (s + 1) * interval] if interval else blocks
                    (_ac_refine if ah else _ac_first)(flat, part, tables[0x10 | chosen[0] & 15], ss, se, al, _Bits(segment))
    return frame, quant, comments


def strips(frame: Frame, quant: dict[int, np.ndarray]) -> Iterator[np.ndarray]:
    """The picture from top to bottom in strips of whole block rows, each height x width x 3, uint8."""
    many = max(1, PIXELS // (frame.mcux * 64 * frame.hmax * frame.vmax))
    for first in range(0, frame.mcuy, many):
        planes = []
        tall = min(frame.height, (first + many) * 8 * frame.vmax) - first * 8 * frame.vmax
        for p in frame.parts:
            coef = p["coef"][first * p["v"] : (first + many) * p["v"]]
            by, bx = coef.shape[:2]
            natural = np.zeros((by * bx, 64))
            natural[:, ZIGZAG] = coef.reshape(-1, 64) * quant[p["q"]]
            samples = natural @ _BASIS + 128.5 + 1e-6  # halves round up, whatever the last bits of the products are
            samples = np.clip(np.floor(samples), 0, 255).reshape(by, bx, 8, 8).transpose(0, 2, 1, 3).reshape(by * 8, bx * 8)
            full = samples.repeat(frame.vmax // p["v"], axis=0).repeat(frame.hmax // p["h"], axis=1)
            planes.append(full[:tall, : frame.width].astype(np.float32))
        if len(planes) == 1:
            yield np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, axis=2)
            continue
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        # the factors are exact in binary to 2**-16, so float32 sums of them and 8-bit values are exact
        k = [np.float32(round(v * 65536) / 65536) for v in (1.402, 0.344136, 0.714136, 1.772)]
        rgb = np.stack([y + k[0] * cr, y - k[1] * cb - k[2] * cr, y + k[3] * cb], axis=2)
        yield np.clip(np.floor(rgb + np.float32(0.5)), 0, 255).astype(np.uint8)


def to_rgb(frame: Frame, quant: dict[int, np.ndarray]) -> np.ndarray:
    """Height x width x 3, uint8."""
    return np.concatenate(list(strips(frame, quant)))


def read_payload(frame: Frame, comments: list[bytes]) -> bytes:
    """The bytes that ``store`` kept in the coefficients."""
    size = next(int(c[8:]) for c in comments if c.startswith(b"payload "))
    rows, cols = frame.mcuy, frame.mcux
    units = np.empty((rows, cols, 6, 64), np.uint8)
    low = [p["coef"].astype(np.uint8) for p in frame.parts]  # b and b + 256 have the same low byte
    units[:, :, :4] = low[0].reshape(rows, 2, cols, 2, 64).transpose(0, 2, 1, 3, 4).reshape(rows, cols, 4, 64)
    units[:, :, 4], units[:, :, 5] = low[1], low[2]
    return units.tobytes()[:size]


def feature(parts: Iterator[np.ndarray]) -> str:
    """Size, mean of each channel and mean step between neighbouring columns, in hundredths (integer sums), of a picture's strips."""
    h = step = w = 0
    sums = np.zeros(3, np.int64)
    for rgb in parts:
        h, w = h + rgb.shape[0], rgb.shape[1]
        sums += rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
        if w > 1:
            step += int(np.abs(np.diff(rgb[:, :, 1].astype(np.int16), axis=1)).sum(dtype=np.int64))
    return f"{h}x{w}:" + ",".join(str(int(s) * 100 // (h * w)) for s in sums) + f":{step * 100 // (h * max(1, w - 1))}"


def pad(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


# --- operators -------------------------------------------------------------------------------------------------------


def with_media(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, media (binary): the stored form of every text."""

    def run(batches):
        for b in batches:
            for at in range(0, len(b[key]), 100):
                pads = [pad(t) for t in b[text][at : at + 100]]
                yield {key: b[key][at : at + 100], "n_bytes": [n for n, _ in pads], "media": [store(p) for _, p in pads]}

    return map_batches(need(df, key, text), run, f"{key} {df.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def rgb_tensors(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """key, height, width, rgb (binary, row by row, 3 bytes a pixel) of stored files; null files give nulls."""

    def run(batches):
        for b in batches:
            for k, m in zip(b[key], b[media]):
                rgb = None if m is None else to_rgb(*read_coefficients(m)[:2])
                yield {key: [k], "height": [rgb.shape[0] if m else None], "width": [rgb.shape[1] if m else None], "rgb": [rgb.tobytes() if m else None]}

    return map_batches(need(df, key, media), run, f"{key} {df.schema[key].dataType.simpleString()}, height int, width int, rgb binary")


def media_digests(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """key, n_bytes and what is read back from the stored files: payload and file digests and the tensor's feature."""

    def run(batches):
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        for b in batches:
            rows = []
            for m in b[media]:
                frame, quant, comments = read_coefficients(m)
                p = read_payload(frame, comments)
                rows.append((len(p), hashlib.sha256(p).hexdigest(), crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(strips(frame, quant))))
            yield {key: b[key], "n_bytes": b["n_bytes"]} | dict(zip(names, zip(*rows)))

    kind = df.schema[key].dataType.simpleString()
    return map_batches(need(df, key, "n_bytes", media), run, f"{key} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op2_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(with_media(table(spark, sf_dir, "documents")))
