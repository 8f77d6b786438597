"""A progressive JPEG codec for many pictures at once, in numpy.

Coefficients are kept as rows of 64, in zigzag order, for all blocks of all pictures of a batch; scans add to them. Entropy-coded data is cut at restart
markers into lanes, which can be coded independently: coding takes one numpy step for one symbol, or one run of correction bits, of every lane at once.
Scans may select spectral bands, and approximate successively: first scans give the upper bits, refining scans a lower bit of each coefficient.
"""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

RESTART, LANES = 2, 1500
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


# Huffman tables


def _code_lengths(weights: dict[int, float]) -> dict[int, int]:
    """Code lengths of a Huffman code; one code of the longest kind, all ones, is left out, as the format asks for."""
    heap = [(w, s, (s,)) for s, w in weights.items()] + [(min(weights.values()) / 2, 1 << 10, (-1,))]
    heapq.heapify(heap)
    length = dict.fromkeys([*weights, -1], 0)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            length[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    del length[-1]
    return length


def _table_bytes(weights: dict[int, float]) -> bytes:
    length = _code_lengths(weights)
    order = sorted(length, key=lambda s: (length[s], -weights[s], s))
    return bytes(sum(length[s] == n for s in order) for n in range(1, 17)) + bytes(order)


@lru_cache(64)
def _codes(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code and length by symbol."""
    code, at, codes, lengths = 0, 16, np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for n in range(1, 17):
        for s in table[at : at + table[n - 1]]:
            codes[s], lengths[s] = code, n
            code += 1
        at += table[n - 1]
        code <<= 1
    return codes, lengths


@lru_cache(64)
def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length by the next 16 bits; length 0 where no code fits."""
    codes, lengths = _codes(table)
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for s in np.nonzero(lengths)[0]:
        first, n = int(codes[s]) << (16 - int(lengths[s])), 1 << (16 - int(lengths[s]))
        symbol[first : first + n], length[first : first + n] = s, lengths[s]
    return symbol, length


_SLOW = 1 << 22


@lru_cache(64)
def _valued(table: bytes) -> np.ndarray:
    """By the next 16 bits, where they hold a code and its whole value: the value plus 2048, the coefficients passed and the bits used; otherwise _SLOW."""
    symbol, length = _lookup(table)
    size = symbol & 15
    used = length + size
    good = (length > 0) & (size > 0) & (used <= 16) & (size <= 11)
    value = (np.arange(1 << 16) >> np.clip(16 - used, 0, 16)) & ((1 << size) - 1)
    value = np.where(value < (1 << np.maximum(size - 1, 0)), value - (1 << size) + 1, value)
    return np.where(good, (value + 2048) | ((symbol >> 4) + 1) << 12 | used << 17, _SLOW).astype(np.int32)


#: DC differences by size; AC (run, size) with short runs and middling sizes the commonest; refining scans, where ends of blocks are.
DC_TABLE = _table_bytes({s: 2.0 ** -abs(s - 4) for s in range(12)})
AC_TABLE = _table_bytes({0: 0.05, **{(r << 4) | s: max(3e-4, 4.0**-r * 2.0 ** -abs(s - 3.4)) for r in range(16) for s in range(1, 11)}, 0xF0: 1e-3, **{r << 4: 3e-4 for r in range(1, 15)}})
REFINE_TABLE = _table_bytes({0: 1.0, **{(r << 4) | 1: 0.2 * 0.8**r for r in range(16)}, 0xF0: 0.02, **{r << 4: 0.002 for r in range(1, 15)}})


# Encoding


def _size_of(x: np.ndarray) -> np.ndarray:
    """Number of bits of each number."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def _pack(codes: np.ndarray, lengths: np.ndarray, lane: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all lanes, filled up with ones and with zero bytes stuffed after 0xFF, and the number of bytes of each. Items are in order; each has 32 bits at most."""
    bits = np.bincount(lane, lengths, lanes).astype(np.int64)
    size = (bits + 7) >> 3
    byte_start = np.cumsum(size) - size
    start = np.cumsum(lengths) - lengths
    bit_start = np.cumsum(bits) - bits
    start += (byte_start * 8 - bit_start)[lane]
    total = int(size.sum())
    out = np.zeros(total // 4 + 3, np.uint64)
    if len(codes):
        word, off = start >> 5, (start & 31).astype(np.uint64)
        value = codes << (np.uint64(64) - off - lengths.astype(np.uint64))
        first = np.nonzero(np.concatenate([[True], word[1:] != word[:-1]]))[0]
        merged = np.bitwise_or.reduceat(value, first)
        out[word[first]] |= merged >> np.uint64(32)
        out[word[first] + 1] |= merged & np.uint64(0xFFFFFFFF)
    data = out.astype(">u4").view(np.uint8)[:total].copy()
    short = np.nonzero(bits & 7)[0]
    data[byte_start[short] + size[short] - 1] |= ((1 << (8 - (bits[short] & 7))) - 1).astype(np.uint8)
    full = data == 255
    if full.any():
        ends = np.cumsum(full)
        upto = np.concatenate([[0], ends])
        stuffed = np.zeros(total + int(ends[-1]), np.uint8)
        stuffed[np.arange(total) + ends - full] = data
        size = size + upto[byte_start + size] - upto[byte_start]
        data = stuffed
    return data, size


def _dc_items(v: np.ndarray, lane: np.ndarray, refine: bool):
    if refine:
        return (v & 1).astype(np.uint64), np.ones(len(v), np.int64), lane
    same = np.concatenate([[False], lane[1:] == lane[:-1]])
    diff = v - np.where(same, np.concatenate([[0], v[:-1]]), 0)
    size = _size_of(np.abs(diff))
    codes, lengths = _codes(DC_TABLE)
    low = np.where(diff < 0, diff + (1 << size) - 1, diff).astype(np.uint64)
    return (codes[size] << size.astype(np.uint64)) | low, lengths[size] + size, lane


def _ac_items(c: np.ndarray, lane: np.ndarray, low_bit: int, refine: bool):
    """Items of a band of coefficients, a row a block. In a segment, which ends with a symbol's coefficient or the block, the symbol comes first, then the
    correction bits of the coefficients that it passes."""
    n, width = c.shape
    magnitude = np.abs(c) >> low_bit
    old = magnitude > 1 if refine else None
    new = magnitude == 1 if refine else magnitude != 0
    zero = magnitude == 0
    event = new
    symbol_run = None
    if zero.any():
        seen = np.cumsum(zero, 1, dtype=np.int16)
        run = seen - np.maximum.accumulate(np.where(new, seen, 0), 1)
        before = np.where(new, 0, 0)
        shifted = np.concatenate([np.zeros((n, 1), np.int16), np.maximum.accumulate(np.where(new, seen, 0), 1)[:, :-1]], 1)
        before = seen - shifted
        symbol_run = np.where(new, before & 15, 15)
        if (long := zero & (run > 0) & (run & 15 == 0)).any():
            later = np.cumsum(new[:, ::-1], 1, dtype=np.int16)[:, ::-1] > 0
            event = new | (long & later)
    end = ~event[:, -1]
    codes, lengths = _codes(REFINE_TABLE if refine else AC_TABLE)
    rows, cols = np.nonzero(event)
    is_new = new[rows, cols]
    run = symbol_run[rows, cols].astype(np.int64) if symbol_run is not None else np.zeros(len(rows), np.int64)
    m, sign = magnitude[rows, cols].astype(np.int64), c[rows, cols] < 0
    size = np.where(is_new, _size_of(m), 0)
    symbol = (run << 4) | size
    low = np.where(sign, ((1 << size) - 1) & ~m, m).astype(np.uint64)
    if refine:
        low = np.where(is_new, ~sign, 0).astype(np.uint64)
    low = np.where(size > 0, low, np.uint64(0))
    value, bits = (codes[symbol] << size.astype(np.uint64)) | low, lengths[symbol] + size
    events = np.bincount(rows, minlength=n)
    start_of = np.cumsum(events) - events
    within = np.arange(len(rows)) - start_of[rows]
    if old is None or not old.any():
        total = events + end
        base = np.cumsum(total) - total
        out_v, out_n = np.zeros(int(total.sum()), np.uint64), np.zeros(int(total.sum()), np.int64)
        at = base[rows] + within
        out_v[at], out_n[at] = value, bits
        at = (base + events)[end]
    else:
        # Correction bits of a segment go in items of up to 24.
        r, k = np.nonzero(old)
        done = np.cumsum(event, 1, dtype=np.int16)[r, k] if len(rows) else np.zeros(len(r), np.int64)
        segment = r * 64 + done
        index = np.arange(len(r))
        opens = np.concatenate([[True], segment[1:] != segment[:-1]])
        place = (index - np.maximum.accumulate(np.where(opens, index, 0))) % 24
        first = np.nonzero(place == 0)[0]
        chunk = np.bitwise_or.reduceat((magnitude[r, k] & 1) << (23 - place), first)
        size = np.diff(np.concatenate([first, [len(r)]]))
        segment = segment[first]
        chunks_before = np.searchsorted(segment, np.arange(n) * 64)
        chunks = np.diff(np.concatenate([chunks_before, [len(first)]]))
        total = events + end + chunks
        base = np.cumsum(total) - total
        out_v, out_n = np.zeros(int(total.sum()), np.uint64), np.zeros(int(total.sum()), np.int64)
        at = base[rows] + within + np.searchsorted(segment, rows * 64 + within) - chunks_before[rows]
        out_v[at], out_n[at] = value, bits
        row = segment >> 6
        at = base[row] + np.arange(len(first)) - chunks_before[row] + (segment & 63) + 1
        out_v[at], out_n[at] = chunk >> (24 - size), size
        at = (base + events + np.searchsorted(segment, np.arange(n) * 64 + events) - chunks_before)[end]
    out_v[at], out_n[at] = codes[0], lengths[0]
    return out_v, out_n, np.repeat(lane, total)


#: (first, last, high, low) of each component's scans.
SCRIPT = [(0, 0, 0, 1), (1, 5, 0, 1), (6, 63, 0, 1), (0, 0, 1, 0), (1, 63, 1, 0)]


def _scan(blocks: np.ndarray, lane: np.ndarray, first: int, last: int, high: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Stuffed bytes of all lanes, and bytes of each."""
    if not first:
        return _pack(*_dc_items(blocks[:, 0] >> low, lane, high > 0), int(lane[-1]) + 1)
    return _pack(*_ac_items(blocks[:, first : last + 1], lane, low, high > 0), int(lane[-1]) + 1)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode(pictures: list[tuple[int, int, np.ndarray, bytes]], ones: bool = True) -> list[bytes]:
    """Files of pictures (MCUs across, MCUs down, int16 blocks of Y, then Cb, then Cr in zigzag order, comment). Chroma has half of luma's resolution each way."""
    counts = np.array([[4 * w * h, w * h, w * h] for w, h, _, _ in pictures])
    at = [[(0, 4 * k), (4 * k, 5 * k), (5 * k, 6 * k)] for k in (w * h for w, h, _, _ in pictures)]
    parts: list[list[bytes]] = [[] for _ in pictures]
    for component in range(3):
        blocks = np.concatenate([b[s:e] for (_, _, b, _), ((s, e)) in zip(pictures, (x[component] for x in at))]).astype(np.int32)
        n = counts[:, component]
        lanes = -(-n // RESTART)
        first_lane = np.cumsum(lanes) - lanes
        owner = np.repeat(np.arange(len(pictures)), n)
        lane = first_lane[owner] + (np.arange(len(owner)) - (np.cumsum(n) - n)[owner]) // RESTART
        starts = np.searchsorted(lane, np.arange(0, int(lane[-1]) + 2, LANES))
        for first, last, high, low in SCRIPT:
            made = [_scan(blocks[a:b], lane[a:b] - lane[a], first, last, high, low) for a, b in zip(starts, [*starts[1:], len(lane)]) if b > a]
            data, size = np.concatenate([d for d, _ in made]), np.concatenate([s for _, s in made])
            # A restart marker before each lane of a picture but the first.
            rank = np.arange(len(size)) - np.repeat(first_lane, lanes)
            room = size + 2 * (rank > 0)
            place = np.cumsum(room) - room
            out = np.empty(int(room.sum()), np.uint8)
            marks = place[rank > 0]
            out[marks] = 0xFF
            out[marks + 1] = 0xD0 + ((rank[rank > 0] - 1) & 7)
            shift = place + 2 * (rank > 0) - (np.cumsum(size) - size)
            out[np.arange(len(data)) + np.repeat(shift, size)] = data
            cut = np.concatenate([place[first_lane], [len(out)]])
            text = out.tobytes()
            head = _segment(0xDA, bytes([1, component + 1, 0x01 if first and high else 0x00, first, last, (high << 4) | low]))
            for i in range(len(pictures)):
                parts[i].append(head + text[cut[i] : cut[i + 1]])
    tables = _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC4, b"\x00" + DC_TABLE + b"\x10" + AC_TABLE + b"\x11" + REFINE_TABLE) + _segment(0xDD, struct.pack(">H", RESTART))
    files = []
    for (w, h, _, comment), scans in zip(pictures, parts):
        frame = _segment(0xC2, struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        files.append(b"\xff\xd8" + _segment(0xFE, comment) + frame + tables + b"".join(scans[k * len(SCRIPT) + s] for s in range(len(SCRIPT)) for k in range(3)) + b"\xff\xd9")
    return files


# Decoding


@dataclass
class Picture:
    width: int = 0
    height: int = 0
    comment: bytes = b""
    components: list = field(default_factory=list)  # (id, h, v, quantisation table)
    quantisation: dict = field(default_factory=dict)
    scans: list = field(default_factory=list)
    blocks: list = field(default_factory=list)  # an array for each component: blocks down, blocks across, 64

    @property
    def mcus(self) -> tuple[int, int]:
        h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(data: bytes) -> Picture:
    raw = np.frombuffer(data, np.uint8)
    follows = raw[1:]
    marks = np.nonzero((raw[:-1] == 255) & (follows != 0) & (follows != 255) & ((follows < 0xD0) | (follows > 0xD7)))[0]
    out, at, tables, restart = Picture(), 2, {}, 0
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while True:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xD9:
            return out
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            out.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out.quantisation[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = body[1:n]
                body = body[n:]
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xC2:
            _, out.height, out.width, n = struct.unpack(">BHHB", body[:6])
            out.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker in (0xC0, 0xC1, *range(0xC3, 0xD0)) and marker not in (0xC8, 0xCC):
            raise ValueError("not a progressive Huffman-coded file")
        elif marker == 0xDA:
            n = body[0]
            ids = [c[0] for c in out.components]
            of = [(ids.index(body[1 + 2 * i]), tables.get(body[2 + 2 * i] >> 4), tables.get(0x10 | (body[2 + 2 * i] & 15))) for i in range(n)]
            first, last, approx = body[1 + 2 * n : 4 + 2 * n]
            end = marks[np.searchsorted(marks, at)]
            out.scans.append((of, first, last, approx >> 4, approx & 15, restart, raw[at:end]))
            at = int(end)


@lru_cache(4096)
def _order(width: int, height: int, components: tuple, of: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Places, among a picture's blocks, of the blocks of a scan in order; and which of the scan's components the blocks of an MCU belong to."""
    hm, vm = max(c[1] for c in components), max(c[2] for c in components)
    across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
    sizes = [across * h * down * v for _, h, v, _ in components]
    start = [sum(sizes[:i]) for i in range(len(sizes))]
    if len(of) == 1:
        c = of[0]
        _, h, v, _ = components[c]
        w, t = -(-(-(-width * h // hm)) // 8), -(-(-(-height * v // vm)) // 8)
        rows, cols = np.divmod(np.arange(w * t), w)
        return start[c] + rows * across * h + cols, np.zeros(1, np.int64)
    my, mx = np.divmod(np.arange(across * down), across)
    unit = [(i, c, y, x) for i, c in enumerate(of) for y in range(components[c][2]) for x in range(components[c][1])]
    places = [start[c] + (my * components[c][2] + y) * across * components[c][1] + mx * components[c][1] + x for _, c, y, x in unit]
    return np.stack(places, 1).reshape(-1), np.array([i for i, _, _, _ in unit])


class _Bits:
    """Unstuffed bytes of lanes, readable at any bit."""

    def __init__(self, data: np.ndarray):
        self.raw = np.concatenate([data, np.full(16, 255, np.uint8)])
        padded = self.raw.astype(np.uint32)
        n = len(data) + 4
        self.words = (padded[:n] << np.uint32(24) | padded[1 : n + 1] << np.uint32(16) | padded[2 : n + 2] << np.uint32(8) | padded[3 : n + 3]).astype(np.int64)

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The next 16 bits."""
        return (self.words.take(at >> 3) >> (16 - (at & 7))) & 0xFFFF

    def bit(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 3] >> (31 - (at & 7))) & 1


def _split(data: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes without restart markers and stuffing, the lanes' first bytes, and the number of lanes of each part, of which the first bytes are given."""
    full = np.nonzero(data[:-1] == 255)[0]
    code = data[full + 1]
    marker = full[(code >= 0xD0) & (code <= 0xD7)]
    keep = np.ones(len(data), bool)
    keep[full[code == 0] + 1] = False
    keep[marker] = keep[marker + 1] = False
    starts = np.sort(np.concatenate([parts, marker + 2]))
    upto = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], upto[starts], np.diff(np.searchsorted(starts, np.concatenate([parts, [len(data) + 1]])))


def _read_dc(bits: _Bits, at: np.ndarray, start: np.ndarray, count: np.ndarray, table: list[bytes], unit: int, of: np.ndarray, out: np.ndarray, low: int, refine: bool) -> None:
    """out: a value for each block in order. start and count: a lane's first block and number of blocks. of: the components of an MCU's blocks."""
    lane = np.arange(len(at))
    last = np.zeros((len(at), int(of.max()) + 1), np.int64)
    for i in range(int(count.max(initial=0))):
        if len(live := lane[count[lane] > i]) < len(lane):
            lane = live
        p, c = at[lane], int(of[i % unit])
        if refine:
            out[start[lane] + i] |= bits.bit(p) << low
            at[lane] += 1
            continue
        symbol, length = _lookup(table[c])
        peek = bits.peek(p)
        size = symbol[peek]
        p = p + length[peek]
        v = bits.peek(p) >> (16 - size)
        v = np.where((size > 0) & (v < (1 << np.maximum(size - 1, 0))), v - (1 << size) + 1, v)
        last[lane, c] += v
        out[start[lane] + i] = last[lane, c] << low
        at[lane] = p + size


def _read_ac(bits: _Bits, at: np.ndarray, start: np.ndarray, count: np.ndarray, table: bytes, out: np.ndarray, first: int, last: int, low: int) -> None:
    """A first scan. out: rows of 64 for the blocks in order."""
    (symbol, length), valued = _lookup(table), _valued(table)
    flat = out.reshape(-1)
    row, end = start * 64, (start + count) * 64
    k = np.full(len(at), first)
    while len(at):
        entry = valued.take(bits.peek(at))
        slow = np.nonzero(entry >= _SLOW)[0]
        at += (entry >> 17) & 31
        k += (entry >> 12) & 31
        value = ((entry & 4095) - 2048) * (1 << low)
        if not len(slow):
            flat[row + (k - 1)] = value
        else:
            good = np.nonzero(entry < _SLOW)[0]
            flat[row[good] + (k[good] - 1)] = value[good]
            p, of, kk = at[slow], row[slow], k[slow]
            peek = bits.peek(p)
            s = symbol[peek]
            p += length[peek]
            run, size = s >> 4, s & 15
            has = size > 0
            n = np.where(has, size, np.where(run < 15, run, 0))
            v = bits.peek(p) >> (16 - n)
            at[slow] = p + n
            closed = ~has & (run < 15)
            k[slow] = np.where(closed, first, kk + run + 1)
            row[slow] = of + np.where(closed, 64 * ((1 << run) + v), 0)
            hit, half = np.nonzero(has)[0], 1 << np.maximum(size - 1, 0)
            flat[of[hit] + kk[hit] + run[hit]] = np.where(v < half, v - 2 * half + 1, v)[hit] * (1 << low)
        over = np.nonzero(k > last)[0]
        if len(over):
            row[over] += 64
            k[over] = first
        if len(over) or len(slow):
            live = row < end
            if not live.all():
                at, row, end, k = at[live], row[live], end[live], k[live]


def _read_refining(bits: _Bits, at: np.ndarray, start: np.ndarray, count: np.ndarray, table: bytes, out: np.ndarray, first: int, last: int, low: int) -> None:
    symbol, length = _lookup(table)
    block, end = start.copy(), start + count
    k, ends = np.full(len(at), first), np.zeros(len(at), np.int64)
    places = np.arange(first, last + 1, dtype=np.int16)
    window = np.arange(9)
    while len(at):
        ask = ends == 0
        peek = bits.peek(at)
        s = np.where(ask, symbol.take(peek), 0)
        at = at + np.where(ask, length.take(peek), 0)
        run, new = s >> 4, (s & 15) > 0
        closing = ask & ~new & (run < 15)
        n = np.where(closing, run, np.where(new, 1, 0))
        v = bits.peek(at) >> (16 - n)
        at = at + n
        ends = np.where(closing, (1 << run) + v, ends)
        whole = ends > 0
        c = out[block, first : last + 1]
        old = c != 0
        part = np.nonzero(~whole)[0]
        target = np.full(len(at), last + 1)
        if (k > first).any():
            old &= places >= k[:, None].astype(np.int16)
        if len(part):
            zeros = np.cumsum((c[part] == 0) & (places >= k[part][:, None]), 1, dtype=np.int16)
            found = zeros >= (run[part] + 1)[:, None]
            target[part] = np.where(found.any(1), first + found.argmax(1), last + 1)
            old[part] &= places < target[part][:, None]
        rank = np.cumsum(old, 1, dtype=np.int32)
        spread = np.unpackbits(bits.raw[(at >> 3)[:, None] + window], axis=1).reshape(-1)
        rank += (np.arange(len(at)) * 72 + (at & 7) - 1).astype(np.int32)[:, None]
        total = rank[:, -1] - (np.arange(len(at)) * 72 + (at & 7) - 1)
        bit = spread.take(rank, mode="clip").view(np.bool_) & old
        out[block, first : last + 1] = c + np.where(bit, np.sign(c) * (1 << low), 0).astype(c.dtype)
        at = at + total
        placed = part[new[part] & (target[part] <= last)]
        out[block[placed], target[placed]] = np.where(v[placed] == 1, 1, -1) * (1 << low)
        k = target + 1
        ends = np.where(whole, ends - 1, ends)
        over = k > last
        block = block + over
        k[over] = first
        live = block < end
        if not live.all():
            at, block, end, k, ends = at[live], block[live], end[live], k[live], ends[live]


def decode(files: list[bytes]) -> list[Picture]:
    """Pictures with the coefficients that all scans add up to."""
    pictures = [parse(f) for f in files]
    # One array of blocks for the batch; a component's blocks fill its MCUs.
    base, total = [], 0
    for p in pictures:
        across, down = p.mcus
        base.append([])
        for _, h, v, _ in p.components:
            base[-1].append((total, across * h, down * v))
            total += across * h * down * v
    held = np.zeros((total, 64), np.int32)
    for number in range(max((len(p.scans) for p in pictures), default=0)):
        groups: dict[tuple, list[int]] = {}
        for i, p in enumerate(pictures):
            if number < len(p.scans):
                of, first, last, high, low, _, _ = p.scans[number]
                unit = tuple(p.components[c][1:3] for c, _, _ in of) if len(of) > 1 else ()
                groups.setdefault((tuple(of), first, last, high, low, unit), []).append(i)
        for (of, first, last, high, low, _), members in groups.items():
            _read_scan(pictures, base, held, members, number, list(of), first, last, high, low)
    for i, p in enumerate(pictures):
        p.blocks = [held[s : s + w * h].reshape(h, w, 64) for s, w, h in base[i]]
    return pictures


def _read_scan(pictures, base, held, members, number, of, first, last, high, low) -> None:
    orders = [_order(p.width, p.height, tuple(p.components), tuple(o[0] for o in of)) for p in (pictures[i] for i in members)]
    components = orders[0][1]
    sizes = np.array([len(o) for o, _ in orders])
    restart = np.array([pictures[i].scans[number][5] for i in members])
    per = np.where(restart > 0, restart * len(components), sizes)
    lanes = -(-sizes // per)
    raws = [pictures[i].scans[number][6] for i in members]
    lengths = np.array([len(x) for x in raws])
    data, at, found = _split(np.concatenate(raws), np.cumsum(lengths) - lengths)
    if (found != lanes).any():
        raise ValueError("restart markers are missing")
    bits, at = _Bits(data), at * 8
    rank = np.arange(len(at)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    start = np.repeat(np.cumsum(sizes) - sizes, lanes) + rank * np.repeat(per, lanes)
    count = np.minimum(np.repeat(per, lanes), np.repeat(sizes, lanes) - rank * np.repeat(per, lanes))
    index = np.concatenate([o for o, _ in orders]) + np.repeat(np.array([base[i][0][0] for i in members]), sizes)
    for a in range(0, len(at), LANES):
        lanes = slice(a, a + LANES)
        b0, b1 = int(start[lanes][0]), int(start[lanes][-1] + count[lanes][-1])
        rows = index[b0:b1]
        if not first:
            values = held[rows, 0].astype(np.int64)
            _read_dc(bits, at[lanes].copy(), start[lanes] - b0, count[lanes], [o[1] for o in of], len(components), components, values, low, high > 0)
            held[rows, 0] = values
        else:
            part = held[rows]
            (_read_refining if high else _read_ac)(bits, at[lanes].copy(), start[lanes] - b0, count[lanes], of[0][2], part, first, last, low)
            held[rows] = part


# Pictures

_x = np.arange(8)
_cosine = np.cos((2 * _x[:, None] + 1) * _x[None, :] * np.pi / 16) * np.where(_x == 0, np.sqrt(0.125), 0.5)[None, :]
#: Samples of each coefficient in zigzag order, as integers. With integer coefficients the products below are whole numbers under 2**53, so that the sums are
#: exact, and the same whatever order a matrix product takes.
SCALE = 1 << 14
BASIS = np.rint(np.einsum("yv,xu->vuyx", _cosine, _cosine).reshape(64, 64)[ZIGZAG] * SCALE)


def samples(blocks: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A component's samples, 0 to 255, from its coefficients."""
    down, across, _ = blocks.shape
    x = (blocks.reshape(-1, 64) * table).astype(np.float64) @ BASIS
    x = np.clip(np.floor(x / SCALE + 128.5), 0, 255).astype(np.uint8)
    return x.reshape(down, across, 8, 8).swapaxes(1, 2).reshape(down * 8, across * 8)


def rgb(picture: Picture) -> np.ndarray:
    """The full-resolution tensor: height, width, 3. Chroma samples are repeated up to the resolution of luma."""
    hm, vm = max(c[1] for c in picture.components), max(c[2] for c in picture.components)
    planes = []
    for (_, h, v, q), blocks in zip(picture.components, picture.blocks):
        plane = samples(blocks, picture.quantisation[q])
        if (hm, vm) != (h, v):
            plane = plane.repeat(vm // v, 0).repeat(hm // h, 1)
        planes.append(plane[: picture.height, : picture.width])
    if len(planes) == 1:
        return np.stack(planes * 3, 2)
    y, cb, cr = planes[0].astype(np.int32) << 16, planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    # 1.402, 0.344136, 0.714136 and 1.772 times 2**16
    out = np.stack([y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb], 2)
    return np.clip((out + 32768) >> 16, 0, 255).astype(np.uint8)
