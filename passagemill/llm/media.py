"""Media columns: payloads as progressive JPEG images and back, at the level of coefficients.

The unit of the format is the quantised coefficient.  A payload's 64 bytes are
one 8x8 block: its first byte is the DC coefficient less 128, each other byte an
AC coefficient of nine bits whose magnitude bits are the byte.  Blocks fill the
Y, Cb and Cr planes (4:2:0) in raster order; a comment segment keeps the payload
length.  Scans: DC and AC (bands 1-5 and 6-63) without their lowest bit, then
refinements of all; restart markers every few blocks.

The decoder reads any progressive 4:2:0 image with restart markers, or without:
it accumulates spectral-selection and successive-approximation scans into
coefficient arrays.  Entropy-coded segments of all images of a batch advance in
step, one symbol (or one coefficient, when refining) of each at a time, on numpy
arrays.  The inverse transform works on scaled integers, exactly, so equal
images have equal pixels wherever they stand in a batch.

Cases: null and empty texts are one block of zeros; repeated rows give equal
values; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import parts_of, ragged, text_bytes
from passagemill.session import materialize

RESTART = 8  # MCUs between restart markers
PART_BYTES = 3 << 20
SHIFT = 13
LEVELS = 8  # bins of the luminance histogram
TENSOR_GROUP_BYTES = 32 << 20  # of a row group of stored tensors

# Order of the coefficients in a block (the format's zigzag).
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21,
    28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54,
    47, 55, 62, 63,
])

# Huffman tables as (codes per length, symbols in order).
DC_TABLE = ([0, 0, 0, 12] + [0] * 12, list(range(12)))
AC_TABLE = ([1, 1, 0, 0, 0, 0, 0, 10] + [0] * 8, [0x07, 0x30, 0x00, 0x10, 0x20, 0x40, 0x01, 0x11, 0xF0, 0x08, 0x06, 0x05])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, table: tuple[list[int], list[int]]) -> bytes:
    return _segment(0xC4, bytes([kind, *table[0], *table[1]]))


def _scan(parts: list[int], tables: int, band: tuple[int, int], bits: tuple[int, int]) -> bytes:
    body = bytes([len(parts)]) + b"".join(bytes([c, tables]) for c in parts)
    return _segment(0xDA, body + bytes([*band, bits[0] << 4 | bits[1]]))


def grid(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """MCUs across and down for a number of blocks, six in an MCU."""
    mcus = -(-blocks // 6)
    across = np.where(mcus <= 64, mcus, 64 * -(-mcus // (64 * 4095)))
    return across, -(-mcus // across)


def _stuffed(data: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Entropy-coded rows (bytes in a row, length of each) with zeros after 0xFF."""
    full = np.flatnonzero(data == 0xFF)
    ends = np.cumsum(lengths)
    if len(full):
        lengths = lengths + np.bincount(np.searchsorted(ends, full, side="right"), minlength=len(lengths))
        data = np.insert(data, full + 1, 0)
        ends = np.cumsum(lengths)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist())]


def _bit_rows(values: np.ndarray, widths: np.ndarray, rows: np.ndarray, number: int) -> list[bytes]:
    """Codes of each row in a row of bits, filled up with ones to whole bytes."""
    size = np.bincount(rows, weights=widths, minlength=number).astype(np.int64)
    bytes_of = -(-size // 8)
    begin = (np.cumsum(bytes_of) - bytes_of) * 8
    before = np.cumsum(widths) - widths
    row_first = np.r_[0, np.cumsum(size)[:-1]]
    place = begin[rows] + before - row_first[rows]
    bits = np.ones(int(bytes_of.sum()) * 8, np.uint8)
    at = ragged(place, widths)
    down = np.repeat(widths + place, widths) - 1 - at
    bits[at] = (np.repeat(values, widths) >> down) & 1
    return _stuffed(np.packbits(bits), bytes_of)


def _joined(pieces: list[bytes], first: int, number: int) -> bytes:
    """Restart intervals of one scan with their markers between them."""
    out = []
    for i in range(number):
        out.append(pieces[first + i])
        if i + 1 < number:
            out.append(bytes([0xFF, 0xD0 + i % 8]))
    return b"".join(out)


def encode(payloads: list[bytes]) -> list[bytes]:
    """Images whose coefficients are the payloads (each a positive multiple of 64 bytes)."""
    blocks = np.array([len(p) // 64 for p in payloads])
    across, down = grid(blocks)
    mcus = across * down
    total = mcus * 6
    buffer = np.zeros((int(total.sum()), 64), np.uint8)
    starts = np.cumsum(total) - total
    buffer[ragged(starts, blocks)] = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 64)
    intervals = -(-mcus // RESTART)

    # DC, interleaved: MCU order is two by two Y blocks, Cb, Cr
    doc = np.repeat(np.arange(len(payloads)), mcus)
    m = ragged(np.zeros(len(payloads), np.int64), mcus)
    row, col = m // across[doc], m % across[doc]
    corner = starts[doc] + row * 4 * across[doc] + col * 2
    order = np.stack([
        corner, corner + 1, corner + 2 * across[doc], corner + 2 * across[doc] + 1,
        starts[doc] + 4 * mcus[doc] + m, starts[doc] + 5 * mcus[doc] + m,
    ], axis=1)
    dc = buffer[order, 0].astype(np.int64) - 128
    high = dc >> 1
    before = np.empty_like(high)
    before[:, 1:4] = high[:, :3]
    fresh = m % RESTART == 0
    previous = np.roll(high, 1, axis=0)
    before[:, 0] = np.where(fresh, 0, previous[:, 3])
    before[:, 4:] = np.where(fresh[:, None], 0, previous[:, 4:])
    difference = (high - before).ravel()
    size = np.zeros(len(difference), np.int64)
    left = np.abs(difference)
    while left.any():
        size += left > 0
        left >>= 1
    extra = np.where(difference < 0, difference + (1 << size) - 1, difference)
    interval = np.repeat((np.cumsum(intervals) - intervals)[doc] + m // RESTART, 6)
    pieces = {"dc": _bit_rows(size << size | extra, 4 + size, interval, int(intervals.sum()))}
    low = (dc & 1).ravel()
    pieces["dc1"] = _bit_rows(low, np.ones(len(low), np.int64), interval, int(intervals.sum()))

    # AC, one component at a time
    firsts, counts = {}, {}
    for c, (skip, factor) in enumerate(((0, 4), (4, 1), (5, 1))):
        number = mcus * factor
        rows = buffer[ragged(starts + skip * mcus, number)]
        own = ragged(np.zeros(len(payloads), np.int64), number) // RESTART
        counts[c] = -(-number // RESTART)
        firsts[c] = np.cumsum(counts[c]) - counts[c]
        line = np.repeat(firsts[c], number) + own
        per = np.bincount(line, minlength=int(counts[c].sum()))
        for name, low_k, high_k in (("a", 1, 5), ("b", 6, 63)):
            # the code of (0, 7) is one zero bit, so a coefficient is the byte without its lowest bit
            half = rows[:, low_k : high_k + 1] >> 1
            pieces[name, c] = _stuffed(half.ravel(), per * (high_k - low_k + 1))
        bits = np.where(rows[:, 1:] >= 128, rows[:, 1:] & 1, 1 - (rows[:, 1:] & 1)).astype(np.int64)
        # end of band for all blocks of the interval: a run of 2 ** r + extra blocks
        rank = np.floor(np.log2(per)).astype(np.int64)
        symbol = np.array([AC_CODES[r << 4][0] for r in rank])
        width = np.array([AC_CODES[r << 4][1] for r in rank])
        head = symbol << rank | per - (1 << rank)
        values = np.insert(bits.ravel(), (np.cumsum(per) - per) * 63, head)
        widths = np.insert(np.ones(bits.size, np.int64), (np.cumsum(per) - per) * 63, width + rank)
        pieces["r", c] = _bit_rows(values, widths, np.repeat(np.arange(len(per)), per * 63 + 1), len(per))

    first = np.cumsum(intervals) - intervals
    out = []
    for n, payload in enumerate(payloads):
        frame = struct.pack(">BHHB", 8, int(down[n]) * 16, int(across[n]) * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        parts = [
            b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(payload))), _segment(0xDB, bytes([0] + [1] * 64)),
            _segment(0xC2, frame), _table(0x00, DC_TABLE), _table(0x10, AC_TABLE), _segment(0xDD, struct.pack(">H", RESTART)),
            _scan([1, 2, 3], 0, (0, 0), (0, 1)), _joined(pieces["dc"], first[n], intervals[n]),
        ]
        for name, band in (("a", (1, 5)), ("b", (6, 63))):
            for c in range(3):
                parts += [_scan([c + 1], 0, band, (0, 1)), _joined(pieces[name, c], firsts[c][n], counts[c][n])]
        parts += [_scan([1, 2, 3], 0, (0, 0), (1, 0)), _joined(pieces["dc1"], first[n], intervals[n])]
        for c in range(3):
            parts += [_scan([c + 1], 0, (1, 63), (1, 0)), _joined(pieces["r", c], firsts[c][n], counts[c][n])]
        out.append(b"".join(parts) + b"\xff\xd9")
    return out


def _codes(table: tuple[list[int], list[int]]) -> dict[int, tuple[int, int]]:
    """Symbol to (code, width)."""
    out, code, at = {}, 0, 0
    for width, number in enumerate(table[0], 1):
        for _ in range(number):
            out[table[1][at]] = (code, width)
            code, at = code + 1, at + 1
        code <<= 1
    return out


AC_CODES = _codes(AC_TABLE)


def _lookup(table: tuple[tuple[int, ...], tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and width for every 16 bits that may come next."""
    symbol, width = np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int64)
    for s, (code, bits) in _codes(table).items():
        low = code << (16 - bits)
        symbol[low : low + (1 << (16 - bits))], width[low : low + (1 << (16 - bits))] = s, bits
    return symbol, width


class Image:
    """Headers and scans of one file."""

    def __init__(self, data: bytes, base: int):
        self.scans: list[tuple] = []  # (components, band, bits, tables, restart, start, end)
        self.comment = b""
        tables: dict[int, tuple] = {}
        self.quant: dict[int, np.ndarray] = {}
        restart, at = 0, 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG image")
        while True:
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if marker == 0xD9:
                break
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                while body:
                    wide = 64 * (1 + (body[0] >> 4))
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + wide], ">u2" if wide > 64 else np.uint8).astype(np.int64)
                    body = body[1 + wide :]
            elif marker == 0xC2:
                self.height, self.width = struct.unpack(">HH", body[1:5])
                self.parts = [tuple(body[6 + 3 * i : 9 + 3 * i]) for i in range(body[5])]
                if [p[1] for p in self.parts] != [0x22, 0x11, 0x11]:
                    raise ValueError("only 4:2:0 images of three components")
            elif marker == 0xC4:
                while body:
                    number = sum(body[1:17])
                    tables[body[0]] = (tuple(body[1:17]), tuple(body[17 : 17 + number]))
                    body = body[17 + number :]
            elif marker == 0xDD:
                restart = int.from_bytes(body, "big")
            elif marker == 0xDA:
                names = [p[0] for p in self.parts]
                used = [(names.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
                low, high, bits = body[1 + 2 * body[0] :][:3]
                own = tuple(tables.get((t & 15) | 0x10 if low else t >> 4) for _, t in used)
                end = at
                while True:
                    end = data.index(b"\xff", end)
                    if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                        end += 2
                        continue
                    break
                self.scans.append((tuple(c for c, _ in used), (low, high), (bits >> 4, bits & 15), own, restart, base + at, base + end))
                at = end
            elif marker in (0xC0, 0xC1, 0xC3):
                raise ValueError("only progressive images")
        self.across, self.down = -(-self.width // 16), -(-self.height // 16)


class Bits:
    """Bit readers of many segments, advanced together."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        lengths = ends - starts
        data = raw[ragged(starts, lengths)]
        stuffed = np.flatnonzero((data[1:] == 0) & (data[:-1] == 0xFF)) + 1
        if len(stuffed):
            lengths = lengths - np.bincount(np.searchsorted(np.cumsum(lengths), stuffed, side="right"), minlength=len(lengths))
            data = np.delete(data, stuffed)
        padded = np.full(int(lengths.sum()) + 8 * len(lengths), 0xFF, np.uint8)
        begin = np.cumsum(lengths + 8) - lengths - 8
        padded[ragged(begin, lengths)] = data
        wide = padded.astype(np.uint32)
        self.words = np.zeros(len(padded), np.uint32)
        self.words[:-3] = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
        self.at = begin * 8

    def peek(self, who: np.ndarray, shift: int = 0) -> np.ndarray:
        """The next 16 bits of each segment."""
        at = self.at[who]
        return (self.words[at >> 3] >> (16 - (at & 7)).astype(np.uint32)).astype(np.int64) & 0xFFFF

    def take(self, who: np.ndarray, width) -> np.ndarray:
        """The next ``width`` bits (up to 16) of each."""
        value = self.peek(who) >> (16 - width)
        self.at[who] += width
        return value

    def symbol(self, who: np.ndarray, table) -> np.ndarray:
        bits = self.peek(who)
        self.at[who] += table[1][bits]
        return table[0][bits]


def _signed(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)


def _dc(bits: Bits, blocks: np.ndarray, counts: np.ndarray, kinds: np.ndarray, tables, coefs, step) -> None:
    """DC scan; ``blocks`` are block numbers in scan order, ``kinds`` their components, by segment."""
    begin = np.cumsum(counts) - counts
    last = np.zeros((len(counts), 3), np.int64)
    for n in range(int(counts.max())):
        who = np.flatnonzero(counts > n)
        block = blocks[begin[who] + n]
        if step[0]:
            coefs[block, 0] |= (bits.take(who, 1) << step[1]).astype(np.int16)
            continue
        kind = kinds[begin[who] + n]
        size = np.zeros(len(who), np.int64)
        for c, table in tables.items():
            if len(own := np.flatnonzero(kind == c)):
                size[own] = bits.symbol(who[own], table)
        last[who, kind] += _signed(bits.take(who, size), size)
        coefs[block, 0] = last[who, kind] << step[1]


def _ac_first(bits: Bits, blocks: np.ndarray, counts: np.ndarray, table, coefs, band, step) -> None:
    begin = np.cumsum(counts) - counts
    n = np.zeros(len(counts), np.int64)
    k = np.full(len(counts), band[0], np.int64)
    who = np.flatnonzero(counts > 0)
    while len(who):
        symbol = bits.symbol(who, table)
        run, size = symbol >> 4, symbol & 15
        value = bits.take(who, np.where((size == 0) & (run < 15), run, size))
        place = k[who] + run
        put = size > 0
        if put.all():
            coefs[blocks[begin[who] + n[who]], place] = _signed(value, size) << step[1]
            k[who] = place + 1
            jump = None
        else:
            w = who[put]
            coefs[blocks[begin[w] + n[w]], place[put]] = _signed(value[put], size[put]) << step[1]
            k[who] = place + 1
            end = ~put & (run < 15)
            jump = np.where(end, (1 << np.minimum(run, 14)) + value, 0)
        over = k[who] > band[1]
        if jump is not None:
            n[who] += jump
            over = np.where(jump > 0, False, over)
            k[who[jump > 0]] = band[0]
        if over.any() or jump is not None:
            done = who[over]
            n[done] += 1
            k[done] = band[0]
            who = who[n[who] < counts[who]]


def _ac_refine(bits: Bits, blocks: np.ndarray, counts: np.ndarray, table, coefs, band, step) -> None:
    """One coefficient of each segment at a time: correct it, skip it, or place a new one."""
    begin = np.cumsum(counts) - counts
    n = np.zeros(len(counts), np.int64)
    k = np.full(len(counts), band[0], np.int64)
    end_run = np.zeros(len(counts), np.int64)  # blocks left in an end-of-band run, this one included
    skip = np.full(len(counts), -1, np.int64)  # zeros still to skip; -1: a symbol comes next
    fresh = np.zeros(len(counts), np.int64)
    one = 1 << step[1]
    who = np.flatnonzero(counts > 0)
    while len(who):
        ask = who[(end_run[who] == 0) & (skip[who] < 0)]
        if len(ask):
            symbol = bits.symbol(ask, table)
            run, size = symbol >> 4, symbol & 15
            ends = (size == 0) & (run < 15)
            value = bits.take(ask, np.where(ends, run, size))
            end_run[ask] = np.where(ends, (1 << run) + value, 0)
            skip[ask] = np.where(ends, -1, run)
            fresh[ask] = np.where(size > 0, np.where(value > 0, one, -one), 0)
        block = blocks[begin[who] + n[who]]
        now = coefs[block, k[who]]
        old = now != 0
        if old.any():
            w = who[old]
            bit = bits.take(w, 1)
            c = now[old]
            coefs[block[old], k[w]] = c + np.where(c > 0, one, -one).astype(np.int16) * bit.astype(np.int16)
        if not old.all():
            zero = ~old & (end_run[who] == 0)
            here = zero & (skip[who] == 0)
            w = who[here]
            coefs[block[here], k[w]] = fresh[w]
            skip[who[zero]] -= 1
        k[who] += 1
        over = k[who] > band[1]
        if over.any():
            done = who[over]
            n[done] += 1
            k[done] = band[0]
            skip[done] = -1
            end_run[done] = np.maximum(end_run[done] - 1, 0)
            who = who[n[who] < counts[who]]


def coefficients(media: list[bytes]) -> tuple[list[Image], np.ndarray, np.ndarray]:
    """Images, all their coefficients (blocks x 64, zigzag order) and each image's first block."""
    offsets = np.cumsum([0, *map(len, media)])
    images = [Image(data, int(base)) for data, base in zip(media, offsets)]
    raw = np.frombuffer(b"".join(media), np.uint8)
    restarts = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7))
    mcus = np.array([i.across * i.down for i in images])
    firsts = np.cumsum(mcus * 6) - mcus * 6
    coefs = np.zeros((int(mcus.sum()) * 6, 64), np.int16)
    waiting = [0] * len(images)
    lookups: dict = {}
    while True:
        # scans with equal settings go together; an image's own scans keep their order where they touch
        groups: dict[tuple, list[tuple[int, tuple]]] = {}
        for n, image in enumerate(images):
            if waiting[n] == len(image.scans):
                continue
            kind = image.scans[waiting[n]][1:5]
            many = len(image.scans[waiting[n]][0])
            while waiting[n] < len(image.scans):
                scan = image.scans[waiting[n]]
                if scan[1:5] != kind or len(scan[0]) != many:
                    break
                groups.setdefault((kind, many), []).append((n, scan))
                waiting[n] += 1
        if not groups:
            return images, coefs, firsts
        for ((band, step, tables, restart), many), scans in groups.items():
            starts, ends, blocks, counts, kinds = [], [], [], [], []
            for n, (parts, _, _, _, _, start, end) in scans:
                low, high = np.searchsorted(restarts, [start, end])
                cuts = restarts[low:high]
                starts.append(np.r_[start, cuts + 2])
                ends.append(np.r_[cuts, end])
                image = images[n]
                if many == 1:
                    c = parts[0]
                    number = mcus[n] * (4 if c == 0 else 1)
                    own = firsts[n] + mcus[n] * (0, 4, 5)[c] + np.arange(number)
                    per, kind = restart or number, np.full(number, c)
                else:
                    m = np.arange(mcus[n])
                    corner = firsts[n] + m // image.across * 4 * image.across + m % image.across * 2
                    chroma = firsts[n] + 4 * mcus[n] + m
                    own = np.stack(
                        [corner, corner + 1, corner + 2 * image.across, corner + 2 * image.across + 1, chroma, chroma + mcus[n]],
                        axis=1,
                    ).ravel()
                    number, per, kind = len(own), 6 * (restart or mcus[n]), np.tile([0, 0, 0, 0, 1, 2], mcus[n])
                count = np.full(-(-number // per), per)
                count[-1] = number - per * (len(count) - 1)
                if len(count) != len(cuts) + 1:
                    raise ValueError("restart markers do not fit the image")
                blocks.append(own)
                counts.append(count)
                kinds.append(kind)
            bits = Bits(raw, np.concatenate(starts), np.concatenate(ends))
            table = [None if t is None else lookups.setdefault(t, _lookup(t)) for t in tables]
            blocks, counts = np.concatenate(blocks), np.concatenate(counts)
            if band[0] == 0:
                own = {c: table[i] for i, c in enumerate(scans[0][1][0])} if many > 1 else {c: table[0] for c in range(3)}
                _dc(bits, blocks, counts, np.concatenate(kinds), own, coefs, step)
            elif step[0] == 0:
                _ac_first(bits, blocks, counts, table[0], coefs, band, step)
            else:
                _ac_refine(bits, blocks, counts, table[0], coefs, band, step)


def _inverse() -> np.ndarray:
    """Scaled integer basis: pixels of a block from its coefficients in zigzag order."""
    u = np.arange(8)
    one = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) / 2
    one[:, 0] /= np.sqrt(2)
    basis = np.einsum("yv,xu->vuyx", one, one).reshape(64, 64)
    return np.round(basis[ZIGZAG] * (1 << SHIFT))


def pixels(images: list[Image], coefs: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """RGB tiles (MCUs x 16 x 16 x 3) of all images; chroma is repeated to full resolution."""
    basis = _inverse()
    scale = np.concatenate([np.repeat(
        np.stack([i.quant[p[2]] for p in i.parts]), np.array([4, 1, 1]) * i.across * i.down, axis=0
    ) for i in images]) if any((q != 1).any() for i in images for q in i.quant.values()) else 1
    planes = np.empty((len(coefs), 64), np.int32)
    for low in range(0, len(coefs), 8192):
        part = coefs[low : low + 8192] * (scale if np.isscalar(scale) else scale[low : low + 8192])
        flat = part.astype(np.float64) @ basis  # whole numbers below 2 ** 53: exact in any order
        planes[low : low + 8192] = np.clip(((flat.astype(np.int64) + (1 << SHIFT - 1)) >> SHIFT) + 128, 0, 255)
    mcus = np.array([i.across * i.down for i in images])
    across = np.repeat(np.array([i.across for i in images]), mcus)
    m = ragged(np.zeros(len(images), np.int64), mcus)
    first, own = np.repeat(firsts, mcus), np.repeat(mcus, mcus)
    corner = first + m // across * 4 * across + m % across * 2
    tiles = planes[np.stack([corner, corner + 1, corner + 2 * across, corner + 2 * across + 1], 1)]
    y = tiles.reshape(-1, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 16, 16)
    cb, cr = (planes[first + f * own + m].reshape(-1, 8, 8).repeat(2, 1).repeat(2, 2) - 128 for f in (4, 5))
    rgb = np.empty((*y.shape, 3), np.uint8)
    for c, shade in enumerate((91881 * cr, -22554 * cb - 46802 * cr, 116130 * cb)):
        rgb[..., c] = np.clip(y + ((shade + (1 << 15)) >> 16), 0, 255)
    return rgb


def tensor(image: Image, tiles: np.ndarray) -> np.ndarray:
    """Height x width x 3 of one image from its tiles."""
    full = tiles.reshape(image.down, image.across, 16, 16, 3).transpose(0, 2, 1, 3, 4)
    return full.reshape(image.down * 16, image.across * 16, 3)[: image.height, : image.width]


def payload(coefs: np.ndarray, size: int) -> bytes:
    """The bytes whose coefficients these are."""
    data = np.where(coefs < 0, coefs + 255, coefs)
    data[:, 0] = coefs[:, 0] + 128
    return data.astype(np.uint8).tobytes()[:size]


def encode_media(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: every whole text as an image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, "text", PART_BYTES):
                texts = part.column(1).to_pylist()
                padded = [t + bytes(-len(t) % 64 if t else 64) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(encode(padded), pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, media binary"
    )


def feature(rgb: np.ndarray) -> str:
    """Height, width, sums of the channels and a histogram of the second one."""
    sums = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    light = np.bincount((rgb[..., 1] >> 5).ravel(), minlength=LEVELS)
    return ",".join(map(str, [*rgb.shape[:2], *sums, *light]))


DECODED = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, height int, width int, feature string"


def decode_media(media: DataFrame, tensors: bool = False, features: bool = True) -> DataFrame:
    """Reads stored images back: payload digests, size and a feature string of the RGB tensor.

    With ``tensors`` the tensor itself (``rgb``, height x width x 3 bytes) too; without
    ``features`` the feature string is left null.
    """
    names = [f.split()[0] for f in DECODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, "media", PART_BYTES):
                files = part.column(2).to_pylist()
                images, coefs, firsts = coefficients(files)
                tiles = pixels(images, coefs, firsts)
                ends, rows, rgb = np.r_[firsts, len(coefs)] // 6, [], []
                for n, (image, data) in enumerate(zip(images, files)):
                    own = tiles[ends[n] : ends[n + 1]]
                    back = payload(coefs[ends[n] * 6 : ends[n + 1] * 6], struct.unpack(">Q", image.comment)[0])
                    full = tensor(image, own)
                    rows.append((
                        len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(data),
                        hashlib.sha256(data).hexdigest(), image.height, image.width, feature(full) if features else None,
                    ))
                    if tensors:
                        rgb.append(full.tobytes())
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                more = [pa.array(rgb, pa.binary())] if tensors else []
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *columns, *more],
                    names=["doc_id", "n_bytes", *names, *(["rgb"] if tensors else [])],
                )

    schema = f"doc_id long, n_bytes long, {DECODED}" + (", rgb binary" if tensors else "")
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def store_media(docs: DataFrame) -> DataFrame:
    """The images as a stored table, compressed once more by it."""
    return materialize(encode_media(docs), "media", compression="zstd")


def store_tensors(media: DataFrame) -> DataFrame:
    """Images decoded to full-resolution RGB tensors, as a stored table; features come from what is read back."""
    decoded = decode_media(media, tensors=True, features=False).drop("feature")
    return materialize(decoded, "tensors", compression="zstd", **{"parquet.block.size": str(TENSOR_GROUP_BYTES)})


def with_features(tensors: DataFrame) -> DataFrame:
    """The rows of stored tensors with their ``feature`` in place of ``rgb``."""
    kept = [c for c in tensors.columns if c != "rgb"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = zip(*(batch.column(n).to_pylist() for n in ("height", "width")))
            found = [
                feature(np.frombuffer(rgb.as_buffer(), np.uint8).reshape(height, width, 3))
                for rgb, (height, width) in zip(batch.column("rgb"), shapes)
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(found, pa.string())], names=[*kept, "feature"])

    return tensors.select(*kept, "rgb").mapInArrow(run, tensors.select(*kept).schema.add("feature", "string"))
