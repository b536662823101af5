"""Progressive JPEG columns: lossless payloads as coefficients, and a vectorised decoder.

The format's unit is the quantised coefficient.  A payload of 576-byte units
becomes an image with one MCU for each unit: nine blocks of 64 coefficients
(3 x 2 of Y, 1 x 2 of Cb, one of Cr), each byte less 128 a coefficient, written in
spectral-selection and successive-approximation scans.  Entropy coding keeps
coefficients exactly, so the payload is read back from them.

Scans have a restart interval of one MCU, so entropy-coded segments are
independent and all segments of many images are coded and decoded side by side,
one symbol of each at a time.  The decoder also takes other intervals, none at
all, other samplings, tables, and scan scripts; files of like structure are
decoded together.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 576
SAMPLING = ((3, 2), (1, 2), (1, 1))
BLOCKS = tuple(h * v for h, v in SAMPLING)
WIDTH = 2048  # MCUs in a row at most
#: (components, first and last coefficient, high and low bit) of each scan.
SCRIPT = ((((0, 1, 2), 0, 0, 0, 1),) + tuple(((c,), a, b, 0, 1) for c in range(3) for a, b in ((1, 5), (6, 63))) + tuple(((c,), 1, 63, 1, 0) for c in range(3)) + (((0, 1, 2), 0, 0, 1, 0),))
LANES = 1 << 14
ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
#: Code lengths: sizes of DC differences; short codes for coefficients without a run, and the end of a block.
DC_SYMBOLS = list(range(12))
AC_SHORT = [0x00, *range(1, 9)]
AC_SYMBOLS = AC_SHORT + [s for s in (r << 4 | n for r in range(16) for n in range(11)) if s not in AC_SHORT and (s & 15 or s == 0xF0)]
DC_COUNTS = [0, 0, 0, 12] + [0] * 12
AC_COUNTS = [0, 0, 0, 9, 0, 0, 0, 0, 0, len(AC_SYMBOLS) - 9] + [0] * 6
SIZE = np.array([int(i).bit_length() for i in range(4096)], np.uint64)
U = np.uint64


def codes_of(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a canonical Huffman table."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _by_symbol(counts, symbols):
    code, length = np.zeros(256, np.uint64), np.zeros(256, np.uint64)
    for s, c, n in codes_of(counts, symbols):
        code[s], length[s] = c, n
    return code, length


DC_CODE, DC_LENGTH = _by_symbol(DC_COUNTS, DC_SYMBOLS)
AC_CODE, AC_LENGTH = _by_symbol(AC_COUNTS, AC_SYMBOLS)

# ---------------------------------------------------------------- writing


def pack(columns) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, size of each lane) of lanes whose codewords are given column by column as (codes, lengths); lanes are filled up with ones."""
    columns = list(columns)
    total = sum(n for _, n in columns)
    sizes = (total + U(7)) >> U(3)
    begin = np.append(U(0), np.cumsum(sizes)[:-1]) if len(sizes) else sizes
    out = np.zeros(int(sizes.sum()) + 16, np.uint8)
    pos = begin * U(8)

    def put(code, length):
        nonlocal pos
        word = code << (U(64) - length - (pos & U(7)))
        at = (pos >> U(3)).astype(np.int64)
        for i in range(8):
            out[at + i] |= (word >> U(56 - 8 * i)).astype(np.uint8)
        pos = pos + length

    acc, size, most = None, None, 0
    pad = sizes * U(8) - total
    for code, length in [*columns, ((U(1) << pad) - U(1), pad)]:
        longest = int(length.max(initial=0))
        if not longest:
            continue
        if acc is None:
            acc, size, most = code, length, longest
        elif most + longest > 56:
            _put_lanes(put, acc, size)
            acc, size, most = code, length, longest
        else:
            acc, size, most = acc << length | code, size + length, most + longest
    if acc is not None:
        _put_lanes(put, acc, size)
    return out[: int(sizes.sum())], sizes.astype(np.int64)


def _put_lanes(put, code, length):
    # A lane without bits would share its neighbour's byte; a zero shifted by 64 is undefined.
    put(np.where(length > 0, code, U(0)), np.where(length > 0, length, U(0)) if (length == 0).any() else length)


def coded(value: np.ndarray, run: np.ndarray, code: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and value bits of coefficients (or differences)."""
    size = SIZE[np.abs(value)]
    symbol = (run.astype(np.uint64) << U(4) | size).astype(np.int64)
    bits = np.where(value >= 0, value, value + (1 << size.astype(np.int64)) - 1).astype(np.uint64)
    return code[symbol] << size | bits, length[symbol] + size


def dc_first(blocks: np.ndarray, owners: list[int], low: int):
    """``blocks`` (lanes, blocks of an MCU): differences within the MCU, one component after another."""
    value = blocks.astype(np.int64) >> low
    for i, c in enumerate(owners):
        before = value[:, i - 1] if i and owners[i - 1] == c else 0
        yield coded(value[:, i] - before, np.zeros(len(value), np.int64), DC_CODE, DC_LENGTH)


def ac_first(band: np.ndarray, low: int):
    """``band`` (lanes, coefficients)."""
    value = (np.sign(band) * (np.abs(band) >> low)).T.astype(np.int64)
    left = (value != 0)[::-1].cumsum(0)[::-1] > 0
    run = np.zeros(value.shape[1], np.int64)
    for k in range(len(value)):
        v, some = value[k], value[k] != 0
        code, length = coded(v, run & 15, AC_CODE, AC_LENGTH)
        run = np.where(some, 0, run + 1)
        long = ~some & (run % 16 == 0) & left[k]
        yield np.where(some, code, np.where(long, AC_CODE[0xF0], U(0))), np.where(some, length, np.where(long, AC_LENGTH[0xF0], U(0)))
    end = value[-1] == 0
    yield np.where(end, AC_CODE[0], U(0)), np.where(end, AC_LENGTH[0], U(0))


def ac_refined(band: np.ndarray, low: int):
    """One more bit of each coefficient: corrections follow the symbol that passes over them."""
    size = np.abs(band) >> low
    old, new = size > 1, size == 1
    zero = ~old & ~new
    lanes, n = band.shape
    if not new.any():
        yield np.full(lanes, AC_CODE[0]), np.full(lanes, AC_LENGTH[0])
        for k in range(n):
            yield np.where(old[:, k], size[:, k] & 1, 0).astype(np.uint64), old[:, k].astype(np.uint64)
        return
    last = np.where(new.any(1), n - 1 - new[:, ::-1].argmax(1), -1)
    run, zrl, skipped = np.zeros(lanes, np.int64), np.zeros(band.shape, bool), np.zeros(band.shape, np.int64)
    for k in range(n):
        skipped[:, k] = run & 15
        run = np.where(new[:, k], 0, run + zero[:, k])
        zrl[:, k] = zero[:, k] & (run > 0) & (run % 16 == 0) & (k < last)
    event = new | zrl
    group = np.cumsum(event, 1) - event
    code, length = np.zeros((lanes, n + 1), np.uint64), np.zeros((lanes, n + 1), np.uint64)
    order = np.zeros((lanes, n + 1), np.int64)
    symbol = np.where(new, skipped << 4 | 1, 0xF0)
    code[:, :n] = np.where(new, AC_CODE[symbol] << U(1) | (band > 0).astype(np.uint64), np.where(zrl, AC_CODE[0xF0], np.where(old, size & 1, 0).astype(np.uint64)))
    length[:, :n] = np.where(new, AC_LENGTH[symbol] + U(1), np.where(zrl, AC_LENGTH[0xF0], old.astype(np.uint64)))
    order[:, :n] = group * 4 * n + np.where(event, 0, 2 * n + np.arange(n))
    end = last < n - 1
    code[:, n], length[:, n] = np.where(end, AC_CODE[0], U(0)), np.where(end, AC_LENGTH[0], U(0))
    order[:, n] = event.sum(1) * 4 * n
    order = np.argsort(order, 1, kind="stable")
    code, length = np.take_along_axis(code, order, 1), np.take_along_axis(length, order, 1)
    for k in range(n + 1):
        yield code[:, k], length[:, k]


def segments(data: np.ndarray, sizes: np.ndarray, ends: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stuffs lanes and puts restart markers between them; ``ends``: lanes that end a scan.  Returns bytes and the lanes' end offsets."""
    full = data == 0xFF
    lane = np.repeat(np.arange(len(sizes)), sizes)
    marks = np.append(0, np.cumsum(np.where(ends, 0, 2)))
    stuffed = np.cumsum(full)
    at = np.arange(len(data)) + (stuffed - full) + marks[lane]
    total = len(data) + int(full.sum()) + int(marks[-1])
    out = np.zeros(total, np.uint8)
    out[at] = data
    last = np.cumsum(sizes)
    finish = last + np.append(0, stuffed)[last] + marks[:-1]
    here = finish[~ends]
    out[here] = 0xFF
    out[here + 1] = 0xD0 + number[~ends] % 8
    return out, finish


def marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


TABLES = marker(0xDB, b"\0" + b"\1" * 64) + marker(0xC4, b"\0" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS)) + marker(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_SYMBOLS)) + marker(0xDD, struct.pack(">H", 1))


def head(width: int, height: int, n_bytes: int) -> bytes:
    frame = struct.pack(">BHHB", 8, height * 16, width * 24, 3) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(SAMPLING))
    return b"\xff\xd8" + marker(0xFE, b"bytes=%d" % n_bytes) + TABLES[:69] + marker(0xC2, frame) + TABLES[69:]


def scan_head(parts, first, last, high, low) -> bytes:
    return marker(0xDA, bytes([len(parts)]) + b"".join(bytes([c + 1, 0]) for c in parts) + bytes([first, last, high << 4 | low]))


def grid(units: int) -> tuple[int, int]:
    """Width and height in MCUs."""
    height = -(-units // WIDTH)
    return -(-units // height), height


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % UNIT or (0 if text else UNIT))


def encode(texts: list[bytes]) -> list[bytes]:
    """Texts to files; each text is filled up to a positive multiple of 576 bytes and keeps its length in a comment."""
    sizes = [len(t) for t in texts]
    shapes = [grid(-(-max(n, 1) // UNIT)) for n in sizes]
    units = np.array([w * h for w, h in shapes])
    data = np.full(int(units.sum()) * UNIT, 128, np.uint8)
    base = np.append(0, np.cumsum(units))
    for text, at in zip(texts, base.tolist(), strict=False):
        payload = padded(text)
        data[at * UNIT : at * UNIT + len(payload)] = np.frombuffer(payload, np.uint8)
    coefficients = (data.astype(np.int16) - 128).reshape(-1, 9, 64)
    starts = np.append(0, np.cumsum(BLOCKS))
    planes = []
    for c, (h, v) in enumerate(SAMPLING):  # scans of one component go by rows of blocks of the whole image
        own = coefficients[:, starts[c] : starts[c + 1]]
        if all(hh == 1 for _, hh in shapes) and v == 1:
            planes.append(own.reshape(-1, 64))
        else:
            planes.append(np.concatenate([own[a : a + w * hh].reshape(hh, w, v, h, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64) for a, (w, hh) in zip(base.tolist(), shapes, strict=False)]))
    parts: list[list[bytes]] = [[head(w, h, n)] for (w, h), n in zip(shapes, sizes, strict=True)]
    for components, first, last, high, low in SCRIPT:
        lanes = units if len(components) > 1 else units * BLOCKS[components[0]]
        ends_at = np.cumsum(lanes)
        count, data, own = int(ends_at[-1]), [], []
        for a in range(0, count, LANES):
            b = min(a + LANES, count)
            if len(components) > 1:
                dc = coefficients[a:b, :, 0]
                columns = [(((dc[:, i].astype(np.int64) >> low) & 1).astype(np.uint64), np.ones(b - a, np.uint64)) for i in range(9)] if high else dc_first(dc, [c for c, n in enumerate(BLOCKS) for _ in range(n)], low)
            else:
                band = planes[components[0]][a:b, first : last + 1]
                columns = (ac_refined if high else ac_first)(band, low)
            packed, lengths = pack(columns)
            data.append(packed)
            own.append(lengths)
        is_end = np.zeros(count, bool)
        is_end[ends_at - 1] = True
        number = np.arange(count) - np.repeat(ends_at - lanes, lanes)
        stream, finish = segments(np.concatenate(data), np.concatenate(own), is_end, number)
        stream, begin, prefix = stream.tobytes(), 0, scan_head(components, first, last, high, low)
        for part, end in zip(parts, finish[ends_at - 1].tolist(), strict=True):
            part += [prefix, stream[begin:end]]
            begin = end
    return [b"".join([*p, b"\xff\xd9"]) for p in parts]


# ---------------------------------------------------------------- reading


@dataclass
class File:
    """Structure of a file, and where its entropy-coded data lie."""

    width: int = 0
    height: int = 0
    comment: bytes = b""
    components: list = field(default_factory=list)  # (id, h, v, table)
    quantisers: dict = field(default_factory=dict)
    scans: list = field(default_factory=list)  # (components, first, last, high, low, DC tables, AC table, interval)
    data: list = field(default_factory=list)  # (begin, end) of each scan

    def like(self):
        return (tuple(self.components), tuple(sorted(self.quantisers.items())), tuple(self.scans))


BEHIND_SCAN = re.compile(rb"\xff[^\x00\xd0-\xd7]")


def parse(data: bytes) -> File:
    out, tables, interval, at = File(), {}, 0, 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while True:
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        code = data[at + 1]
        if code == 0xD9:
            return out
        if code == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if code == 0xFE:
            out.comment = body
        elif code == 0xDB:
            while body:
                n = 128 if body[0] >> 4 else 64
                out.quantisers[body[0] & 15] = tuple(np.frombuffer(body[1 : n + 1], ">u2" if n == 128 else np.uint8).tolist())
                body = body[n + 1 :]
        elif code == 0xC2:
            _, out.height, out.width, n = struct.unpack(">BHHB", body[:6])
            out.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif code in (0xC0, 0xC1, *range(0xC3, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC)):
            raise ValueError("not a progressive Huffman-coded frame")
        elif code == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = bytes(body[1 : 17 + n])
                body = body[17 + n :]
        elif code == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif code == 0xDA:
            n, ids = body[0], [c[0] for c in out.components]
            chosen = tuple(ids.index(body[1 + 2 * i]) for i in range(n))
            selectors = [body[2 + 2 * i] for i in range(n)]
            first, last, bits = body[1 + 2 * n : 4 + 2 * n]
            dc = tuple(tables.get(s >> 4, b"") for s in selectors) if first == 0 and not bits >> 4 else ()
            ac = tables[16 | selectors[0] & 15] if first else b""
            out.scans.append((chosen, first, last, bits >> 4, bits & 15, dc, ac, interval))
            found = BEHIND_SCAN.search(data, at)
            if not found:
                raise ValueError("the file ends within a scan")
            end = found.start()
            out.data.append((at, end))
            at = end


_LOOKUPS: dict[bytes, np.ndarray] = {}


def lookup(table: bytes) -> np.ndarray:
    """16 bits to length << 8 | symbol; length 0 where there is no code."""
    if table not in _LOOKUPS:
        out = np.zeros(1 << 16, np.uint64)
        for symbol, code, length in codes_of(list(table[:16]), list(table[16:])):
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
        _LOOKUPS[table] = out
    return _LOOKUPS[table]


class Bits:
    """Bit positions of many lanes in one buffer without stuffing."""

    def __init__(self, data: np.ndarray):
        padded_data = np.concatenate([data, np.zeros(16, np.uint8)])
        self.words = np.ndarray((len(data) + 8,), ">u8", padded_data, strides=(1,))
        self.data = padded_data

    def word(self, pos: np.ndarray) -> np.ndarray:
        """At least 57 bits from each position on, left-aligned."""
        return self.words[(pos >> U(3)).astype(np.int64)].astype(np.uint64) << (pos & U(7))

    def symbol(self, pos: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, the bits behind them left-aligned, positions behind them)."""
        word = self.word(pos)
        found = table[(word >> U(48)).astype(np.int64)]
        length = found >> U(8)
        if not length.all():
            raise ValueError("a code that the table doesn't have")
        return found & U(255), word << length, pos + length

    def single(self, pos: np.ndarray) -> np.ndarray:
        return self.data[(pos >> U(3)).astype(np.int64)] >> (U(7) - (pos & U(7))).astype(np.uint8) & 1


def extended(word: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Signed value of the first ``size`` (1 to 16) bits."""
    value = (word >> (U(64) - size)).astype(np.int64)
    return np.where(value >> (size.astype(np.int64) - 1) & 1, value, value - (1 << size.astype(np.int64)) + 1)


def unstuffed(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of a scan of several files (``sizes`` bytes each) without stuffing and markers, and where segments begin in them."""
    full = np.flatnonzero(data[:-1] == 0xFF)
    nxt = data[full + 1]
    keep = np.ones(len(data), bool)
    keep[full[nxt == 0] + 1] = False
    rst = full[(nxt >= 0xD0) & (nxt <= 0xD7)]
    keep[rst] = keep[rst + 1] = False
    cut = np.append(0, np.cumsum(keep))
    return data[keep], cut[np.sort(np.concatenate([np.cumsum(sizes) - sizes, rst]))]


class Decoder:
    """Files of like structure."""

    def __init__(self, files: list[File], blobs: list[bytes]):
        self.files, self.blobs, self.rgb, f = files, blobs, None, files[0]
        self.hmax, self.vmax = max(c[1] for c in f.components), max(c[2] for c in f.components)
        self.wide = np.array([-(-x.width // (8 * self.hmax)) for x in files])
        self.tall = np.array([-(-x.height // (8 * self.vmax)) for x in files])
        self.units = np.append(0, np.cumsum(self.wide * self.tall))
        self.base = [self.units * (h * v) for _, h, v, _ in f.components]
        self.coefficients = [np.zeros((int(base[-1]), 64), np.int16) for base in self.base]
        for i, scan in enumerate(f.scans):
            self._scan(i, *scan)

    def _scan(self, i, chosen, first, last, high, low, dc, ac, interval):
        data, begin = unstuffed(np.frombuffer(b"".join([blob[f.data[i][0] : f.data[i][1]] for f, blob in zip(self.files, self.blobs, strict=True)]), np.uint8), np.array([f.data[i][1] - f.data[i][0] for f in self.files]))
        order, sizes = self.order(chosen)
        per = np.full(len(sizes), interval) if interval else sizes
        lanes = -(-sizes // per)
        if len(begin) != lanes.sum():
            raise ValueError("restart markers don't agree with the interval")
        within = np.arange(len(begin)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        count = np.minimum(np.repeat(per, lanes), np.repeat(sizes, lanes) - within * np.repeat(per, lanes))
        bits, start = Bits(data), np.cumsum(count) - count
        by = np.argsort(-count, kind="stable")
        for a in range(0, len(by), LANES):
            own = by[a : a + LANES]
            self._lanes(bits, begin[own].astype(np.uint64) * U(8), start[own], count[own], order, chosen, first, last, high, low, dc, ac)

    def order(self, chosen: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Indices of all files' blocks in the order of a scan, and how many rows of them each file has: a row for each MCU of several components, one index for each block of a single one."""
        f = self.files[0]
        if len(chosen) == 1:
            c = chosen[0]
            _, h, v, _ = f.components[c]
            wide = np.array([-(-(-(-x.width * h // self.hmax)) // 8) for x in self.files])
            tall = np.array([-(-(-(-x.height * v // self.vmax)) // 8) for x in self.files])
            sizes, every = wide * tall, np.arange(int(self.base[c][-1]))
            if (sizes == np.diff(self.base[c])).all():
                return every[:, None], sizes
            file = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            return (self.base[c][file] + at // wide[file] * self.wide[file] * h + at % wide[file])[:, None], sizes
        return np.concatenate([self._of_mcus(c) for c in chosen], 1), np.diff(self.units)

    def _lanes(self, bits, pos, start, count, order, chosen, first, last, high, low, dc, ac):
        owners = [c for c in chosen for _ in range(self.files[0].components[c][1] * self.files[0].components[c][2] if len(chosen) > 1 else 1)]
        before = {c: np.zeros(len(pos), np.int64) for c in chosen}
        ends = np.zeros(len(pos), np.int64)
        for step in range(int(count[0])):
            n = int(np.searchsorted(-count, -step, "left"))
            rows = order[start[:n] + step]
            if first == 0:
                for k, c in enumerate(owners):
                    target = self.coefficients[c]
                    if high:
                        target[rows[:, k], 0] |= bits.single(pos[:n]).astype(np.int16) << low
                        pos[:n] += U(1)
                    else:
                        size, word, pos[:n] = bits.symbol(pos[:n], lookup(dc[chosen.index(c)]))
                        before[c][:n] += np.where(size > 0, extended(word, np.maximum(size, U(1))), 0)
                        pos[:n] += size
                        target[rows[:, k], 0] = before[c][:n] << low
            elif high:
                self._refine(bits, pos, ends, n, rows[:, 0], self.coefficients[chosen[0]], first, last, low, lookup(ac))
            else:
                self._first(bits, pos, ends, n, rows[:, 0], self.coefficients[chosen[0]], first, last, low, lookup(ac))

    @staticmethod
    def _first(bits, pos, ends, n, rows, target, first, last, low, table):
        waiting = ends[:n] > 0
        ends[:n] -= waiting
        lanes = np.flatnonzero(~waiting)
        p, k, row = pos[lanes], np.full(len(lanes), first), rows[lanes]
        flat = target.reshape(-1)
        while len(lanes):
            symbol, word, p = bits.symbol(p, table)
            run, size = (symbol >> U(4)).astype(np.int64), symbol & U(15)
            if size.all():
                k = k + run
                if (k > last).any():
                    raise ValueError("a run beyond the band")
                flat[row * 64 + k] = extended(word, size) << low
                p, k = p + size, k + 1
                done = k > last
            else:
                some, stop = size > 0, (size == 0) & (run < 15)
                k = k + np.where(stop, 0, run)
                at = np.flatnonzero(some)
                if (k[at] > last).any():
                    raise ValueError("a run beyond the band")
                flat[row[at] * 64 + k[at]] = extended(word[at], size[at]) << low
                extra = np.where(stop, run, 0).astype(np.uint64)
                more = np.where(extra > 0, word >> (U(64) - np.maximum(extra, U(1))), U(0)).astype(np.int64)
                ends[lanes[stop]] = (1 << run[stop]) + more[stop] - 1
                p, k = p + np.where(stop, extra, size), k + 1
                done = stop | (k > last)
            if done.any():
                pos[lanes[done]] = p[done]
                keep = ~done
                lanes, p, k, row = lanes[keep], p[keep], k[keep], row[keep]

    @staticmethod
    def _correct(bits, p, values, mask, low):
        """Reads a bit for each masked coefficient, in order; returns the positions behind them."""
        upto = np.cumsum(mask, 1)
        at = p[:, None] + (upto - 1).astype(np.uint64)
        got = bits.single(np.where(mask, at, p[:, None])).astype(bool) & mask & (values >> low & 1 == 0)
        values += (np.where(got, np.sign(values), 0) << low).astype(values.dtype)
        return p + upto[:, -1].astype(np.uint64)

    @classmethod
    def _refine(cls, bits, pos, ends, n, rows, target, first, last, low, table):
        values = target[rows, first : last + 1].astype(np.int32)
        width = last - first + 1
        columns = np.arange(width)
        waiting = ends[:n] > 0
        k = np.zeros(n, np.int64)
        lanes = np.flatnonzero(~waiting)
        p = pos[:n].copy()
        while len(lanes):
            symbol, word, p[lanes] = bits.symbol(p[lanes], table)
            run, size = (symbol >> U(4)).astype(np.int64), symbol & U(15)
            stop = (size == 0) & (run < 15)
            extra = np.where(stop, run, 0).astype(np.uint64)
            more = np.where(extra > 0, word >> (U(64) - np.maximum(extra, U(1))), U(0)).astype(np.int64)
            ends[lanes[stop]] = (1 << run[stop]) + more[stop]
            p[lanes] += np.where(stop, extra, size)
            go = np.flatnonzero(~stop)
            if len(go):
                own, r, s = lanes[go], run[go], size[go]
                sign = np.where(word[go] >> U(63) > 0, 1, -1) << low
                now = values[own]
                ahead = columns >= k[own][:, None]
                zero = (now == 0) & ahead
                seen = np.cumsum(zero, 1)
                hit = zero & (seen == (r + 1)[:, None])
                place = np.where(hit.any(1), hit.argmax(1), width)
                p[own] = cls._correct(bits, p[own], now, (now != 0) & ahead & (columns < place[:, None]), low)
                put = (s > 0) & (place < width)
                now[np.flatnonzero(put), place[put]] = sign[put]
                values[own] = now
                k[own] = place + 1
            lanes = lanes[~stop & (k[lanes] < width)]
        rest = np.flatnonzero(ends[:n] > 0)
        if len(rest):
            now = values[rest]
            p[rest] = cls._correct(bits, p[rest], now, (now != 0) & (columns >= k[rest][:, None]), low)
            values[rest] = now
            ends[rest] -= 1
        pos[:n] = p
        target[rows, first : last + 1] = values

    def tiles(self, chunk: int = 2048) -> np.ndarray:
        """RGB of all MCUs of all files (MCU, height, width, 3)."""
        f = self.files[0]
        out = np.empty((int(self.units[-1]), 8 * self.vmax, 8 * self.hmax, 3), np.uint8)
        orders = [self._of_mcus(c) for c in range(len(f.components))]
        # Whole numbers in doubles: sums are exact, whatever their order.
        kernels = [KERNEL * np.array(f.quantisers[table], np.float64)[:, None] for _, _, _, table in f.components]
        for a in range(0, len(out), chunk):
            planes = []
            for c, (_, h, v, _) in enumerate(f.components):
                index = orders[c][a : a + chunk]
                sums = self.coefficients[c][index.reshape(-1)].astype(np.float64) @ kernels[c]
                samples = np.clip(np.floor(sums / (1 << 13) + 0.5) + 128, 0, 255).astype(np.uint8)
                plane = samples.reshape(len(index), v, h, 8, 8).transpose(0, 1, 3, 2, 4).reshape(len(index), v * 8, h * 8)
                for axis, times in ((1, self.vmax // v), (2, self.hmax // h)):
                    plane = plane.repeat(times, axis) if times > 1 else plane
                planes.append(plane)
            out[a : a + chunk] = to_rgb(*planes) if len(planes) == 3 else planes[0][..., None]
        return out

    def _of_mcus(self, c: int) -> np.ndarray:
        """(MCU, block) indices of a component."""
        _, h, v, _ = self.files[0].components[c]
        sizes = np.diff(self.units)
        file = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(int(self.units[-1])) - self.units[file]
        x, y = at % self.wide[file], at // self.wide[file]
        return np.stack([self.base[c][file] + (y * v + j) * self.wide[file] * h + x * h + i for j in range(v) for i in range(h)], 1)

    def pixels(self, n: int) -> np.ndarray:
        """RGB tensor (height, width, 3) of a file."""
        if self.rgb is None:
            self.rgb = self.tiles()
        own, f = self.rgb[self.units[n] : self.units[n + 1]], self.files[n]
        _, th, tw, _ = own.shape
        w, hh = int(self.wide[n]), int(self.tall[n])
        return own.reshape(hh, w, th, tw, 3).transpose(0, 2, 1, 3, 4).reshape(hh * th, w * tw, 3)[: f.height, : f.width]


def _kernel() -> np.ndarray:
    """Coefficients in zigzag order to samples, times 2 ** 13, in whole numbers."""
    x = np.arange(8)
    basis = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x == 0, np.sqrt(0.5), 1)[:, None] / 2
    both = np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)
    return np.round(both[ZIGZAG] * (1 << 13))


KERNEL = _kernel()


def to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    y, cb, cr = y.astype(np.int32) << 16, cb.astype(np.int32) - 128, cr.astype(np.int32) - 128
    out = np.empty((*y.shape, 3), np.uint8)
    half = 1 << 15
    out[..., 0] = np.clip((y + 91881 * cr + half) >> 16, 0, 255)
    out[..., 1] = np.clip((y - 22554 * cb - 46802 * cr + half) >> 16, 0, 255)
    out[..., 2] = np.clip((y + 116130 * cb + half) >> 16, 0, 255)
    return out


def decode(blobs: list[bytes]) -> list[tuple[Decoder, int]]:
    """(decoder, number in it) of each file; like files share a decoder."""
    files, groups = [parse(b) for b in blobs], {}
    for i, f in enumerate(files):
        groups.setdefault(f.like(), []).append(i)
    out: list = [None] * len(blobs)
    for own in groups.values():
        decoder = Decoder([files[i] for i in own], [blobs[i] for i in own])
        for n, i in enumerate(own):
            out[i] = (decoder, n)
    return out


def payload(decoder: Decoder, n: int) -> tuple[bytes, int]:
    """The stored bytes of a file that ``encode`` made, and the text's length."""
    w, hh, f = int(decoder.wide[n]), int(decoder.tall[n]), decoder.files[n]
    size = int(f.comment.partition(b"=")[2])
    parts = []
    for c, (_, h, v, _) in enumerate(f.components):
        own = decoder.coefficients[c][decoder.base[c][n] : decoder.base[c][n + 1]]
        parts.append(own.reshape(hh, v, w, h, 64).transpose(0, 2, 1, 3, 4).reshape(hh * w, v * h, 64))
    data = (np.concatenate(parts, 1) + 128).astype(np.uint8).tobytes()
    return data[: max(1, -(-size // UNIT)) * UNIT], size


def described(rgb: np.ndarray) -> str:
    """Shape, channel means and checksum of a tensor."""
    height, width, _ = rgb.shape
    sums = rgb.sum((0, 1), dtype=np.int64).tolist()
    return f"{width}x{height}:{','.join(f'{s / (width * height):.4f}' for s in sums)}:{zlib.crc32(rgb.tobytes()):08x}"


MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _batches(batch, most: int):
    """(ids, items) of about ``most`` bytes together."""
    ids, items, begin = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
    while begin < len(items):
        end, size = begin, 0
        while end < len(items) and (size < most or end == begin):
            size += len(items[end])
            end += 1
        yield ids[begin:end], items[begin:end]
        begin = end


def store(docs: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(doc_id, media): each text (null: empty) of ``docs`` as a progressive JPEG file.

    A text of any length is one file; repeated rows and null ids give a file each,
    equal texts equal files; an empty table gives none; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            for ids, texts in _batches(batch, most):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(encode(texts), pa.binary())], names=["doc_id", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, media binary")


def tensors(media: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(doc_id, height, width, rgb): full-resolution RGB tensors, row by row, of progressive JPEG files (doc_id, media); of null files null."""

    def run(batches):
        for batch in batches:
            for ids, blobs in _batches(batch, most):
                found = [d.pixels(n) for d, n in decode(blobs)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x.shape[0] for x in found], pa.int32()), pa.array([x.shape[1] for x in found], pa.int32()), pa.array([x.tobytes() for x in found], pa.binary())], names=["doc_id", "height", "width", "rgb"])

    rows = media.select(F.col("doc_id").cast("long").alias("doc_id"), "media")
    return rows.filter("media IS NOT NULL").mapInArrow(run, "doc_id long, height int, width int, rgb binary").unionByName(rows.filter("media IS NULL").select("doc_id", *(F.lit(None).cast(t).alias(k) for k, t in (("height", "int"), ("width", "int"), ("rgb", "binary")))))


def digests(media: DataFrame, most: int = 1 << 20) -> DataFrame:
    """A row for each file of ``media`` (doc_id, media), as ``store`` makes them: lengths and digests of the payload read back from it, and of the file; a feature of its RGB tensor.

    The media of a null or empty text hold one unit of filling; null media are left
    out; files of any length are read whole, repeated rows give repeated rows of equal values; an
    empty table gives none; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            for ids, blobs in _batches(batch, most):
                out = []
                for doc_id, blob, (decoder, n) in zip(ids, blobs, decode(blobs), strict=True):
                    data, size = payload(decoder, n)
                    out.append((doc_id, size, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), described(decoder.pixels(n))))
                kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in MEDIA.split(", ")])

    return media.filter("media IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(run, MEDIA)
