"""Lossless WebP (VP8L): encoder, decoder and columns of images that hold bytes as 8-bit grey samples."""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fernspark.llm.common import slices

# Fixed values of the format (RFC 9649).
SIGNATURE, LENGTH_CODES, DISTANCE_CODES, MOST_CODE_BITS = 0x2F, 24, 40, 15
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_MULTIPLIER = 0x1E35A7BD
BLACK = 0xFF000000
#: Pixel offsets (left, up) of the 120 short distance codes, in the format's order.
NEIGHBOURS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
MOST_SIDE = 1 << 14

#: Bytes of a stream whose codes are looked up at a time.
CHUNK = 1 << 16
#: Shortest and longest back-reference that the encoder makes.
LEAST_MATCH, MOST_MATCH = 16, 4096
#: The greatest distance that the distance symbols reach; the neighbours' codes come before it.
FARTHEST = (1 << 20) - len(NEIGHBOURS)


# --- pixels -----------------------------------------------------------------------------------------------------------


def channels(argb: np.ndarray) -> np.ndarray:
    """uint32 pixels as (..., 4) bytes: blue, green, red, alpha."""
    return np.ascontiguousarray(argb.astype("<u4")).view(np.uint8).reshape(*argb.shape, 4)


def pixels(parts: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(parts, np.uint8).view("<u4")[..., 0]


def predicted(mode: int, left, top, right, corner):
    """The prediction of a mode from the neighbours left, top, top right and top left; (..., 4) integers."""
    half = lambda a, b: (a + b) >> 1
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return half(half(left, right), top)
    if mode == 6:
        return half(left, corner)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(corner, top)
    if mode == 9:
        return half(top, right)
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:  # the one nearer to the gradient; p - left is top - corner
        nearer = np.abs(top - corner).sum(axis=-1) < np.abs(left - corner).sum(axis=-1)
        return np.where(nearer[..., None], left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        a = half(left, top)
        return np.clip(a + np.trunc((a - corner) / 2).astype(a.dtype), 0, 255)
    black = np.zeros_like(left)
    black[..., 3] = 255
    return black


#: Modes whose prediction needs nothing of the row that is being decoded, but for its first pixel.
ROW_FREE = {0, 2, 3, 4, 8, 9, 14, 15}


def neighbours(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Left, top, top right and top left of all pixels but the first row and column; the row's first pixel is the last one's top right."""
    return x[1:, :-1], x[:-1, 1:], np.concatenate([x[:-1, 2:], x[1:, :1]], axis=1), x[:-1, :-1]


def apply_predictor(argb: np.ndarray, bits: int, modes: np.ndarray) -> np.ndarray:
    """Pixels less their predictions."""
    x = channels(argb).astype(np.int16)
    p = np.zeros_like(x)
    p[0, 0, 3] = 255
    p[0, 1:], p[1:, 0] = x[0, :-1], x[:-1, 0]
    if x.shape[0] > 1 and x.shape[1] > 1:
        near = neighbours(x)
        full = np.repeat(np.repeat(modes, 1 << bits, 0), 1 << bits, 1)[1 : x.shape[0], 1 : x.shape[1]]
        for mode in np.unique(full).tolist():
            p[1:, 1:] = np.where((full == mode)[..., None], predicted(mode, *near), p[1:, 1:])
    return pixels((x - p) & 255)


def invert_predictor(argb: np.ndarray, bits: int, modes: np.ndarray) -> np.ndarray:
    x = channels(argb).copy()
    h, w = argb.shape
    x[0, 0, 3] += np.uint8(255)
    x[0] = np.cumsum(x[0], axis=0, dtype=np.uint8)
    x[:, 0] = np.cumsum(x[:, 0], axis=0, dtype=np.uint8)
    only = modes.flat[0] if (modes == modes.flat[0]).all() else None
    if only == 1:
        x[1:] = np.cumsum(x[1:], axis=1, dtype=np.uint8)
        return pixels(x)
    if only == 2:
        x[:, 1:] = np.cumsum(x[:, 1:], axis=0, dtype=np.uint8)
        return pixels(x)
    for y in range(1, h):
        row = modes[y >> bits]
        above = x[y - 1].astype(np.int16)
        after = np.concatenate([above[1:], x[y, :1].astype(np.int16)])
        tile = 0
        while tile < len(row):
            end = tile + 1
            while end < len(row) and row[end] == row[tile]:
                end += 1
            mode, a, b = int(row[tile]), max(1, tile << bits), min(w, end << bits)
            tile = end
            if a >= b:
                continue
            if mode == 1:
                x[y, a:b] = x[y, a - 1] + np.cumsum(x[y, a:b], axis=0, dtype=np.uint8)
            elif mode in ROW_FREE:
                x[y, a:b] += predicted(mode, above[a:b], above[a:b], after[a:b], above[a - 1 : b - 1]).astype(np.uint8)
            else:
                for i in range(a, b):
                    x[y, i] += predicted(mode, x[y, i - 1].astype(np.int16), above[i], after[i], above[i - 1]).astype(np.uint8)
    return pixels(x)


def _delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (t.astype(np.int8).astype(np.int16) * c.astype(np.int8).astype(np.int16)) >> 5


def cross_colour(argb: np.ndarray, bits: int, elements: np.ndarray, *, invert: bool) -> np.ndarray:
    """Adds (or takes away) what red owes to green, and blue to green and red; multipliers by tile are in blue, green and red of ``elements``."""
    x = channels(argb).copy()
    e = channels(np.repeat(np.repeat(elements, 1 << bits, 0), 1 << bits, 1)[: x.shape[0], : x.shape[1]])
    b, g, r = x[..., 0], x[..., 1], x[..., 2]
    new_r = r + (_delta(e[..., 0], g) * (1 if invert else -1)).astype(np.uint8)
    true_r = new_r if invert else r
    change = _delta(e[..., 1], g) + _delta(e[..., 2], true_r)
    x[..., 0] = b + (change * (1 if invert else -1)).astype(np.uint8)
    x[..., 2] = new_r
    return pixels(x)


def green_shift(argb: np.ndarray, sign: int) -> np.ndarray:
    x = channels(argb).copy()
    g = x[..., 1] if sign > 0 else np.uint8(0) - x[..., 1]
    x[..., 0] += g
    x[..., 2] += g
    return pixels(x)


def bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def to_palette(argb: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Indices in the ascending ``table``, several to a pixel's green where colours are few."""
    index = np.searchsorted(table, argb).astype(np.uint32)
    bits = bundle_bits(len(table))
    per, each = 1 << bits, 8 >> bits
    h, w = index.shape
    wide = np.zeros((h, -(-w // per) * per), np.uint32)
    wide[:, :w] = index
    packed = np.zeros((h, wide.shape[1] // per), np.uint32)
    for i in range(per):
        packed |= wide[:, i::per] << np.uint32(i * each)
    return packed << np.uint32(8) | np.uint32(BLACK)


def from_palette(argb: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    bits = bundle_bits(len(table))
    per, each = 1 << bits, 8 >> bits
    green = argb >> np.uint32(8) & np.uint32(255)
    index = np.stack([green >> np.uint32(i * each) & np.uint32((1 << each) - 1) for i in range(per)], axis=-1).reshape(len(argb), -1)[:, :width]
    return np.concatenate([table, np.zeros(256, np.uint32)])[index]


# --- prefix codes -----------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, most: int = MOST_CODE_BITS) -> np.ndarray:
    """Huffman code lengths of at most ``most`` bits; a lone symbol gets 1."""
    counts = counts.astype(np.int64).copy()
    used = np.flatnonzero(counts).tolist()
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    first = True  # where codes get too long, rare symbols are first counted as of the least share that fits, then all counts come nearer to each other
    while True:
        heap = [(int(counts[s]), s) for s in used]
        heapq.heapify(heap)
        up, nxt = {}, len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            up[a[1]] = up[b[1]] = nxt
            heapq.heappush(heap, (a[0] + b[0], nxt))
            nxt += 1
        depth = {nxt - 1: 0}
        for node in range(nxt - 2, len(counts) - 1, -1):
            depth[node] = depth[up[node]] + 1
        for s in used:
            out[s] = depth[up[s]] + 1
        if out.max() <= most:
            return out
        counts[used] = np.maximum(counts[used], (int(counts[used].sum()) >> (most - 1)) + 1) if first else counts[used] // 2 + 1
        first = False


_reversed: list[np.ndarray] = []


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes, bits reversed as the stream has them; a lone symbol's code has no bits."""
    if not _reversed:
        n = np.arange(1 << MOST_CODE_BITS)
        _reversed.append(sum((n >> i & 1) << (MOST_CODE_BITS - 1 - i) for i in range(MOST_CODE_BITS)))
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    size = lengths[used]
    # Left-aligned, the codes in order are the running sums of the shares of the code space before them.
    share = 1 << (MOST_CODE_BITS - size)
    codes = np.zeros(len(lengths), np.int64)
    codes[used] = _reversed[0][np.minimum(np.cumsum(share) - share, (1 << MOST_CODE_BITS) - 1)]
    return codes


class Code:
    """Lookup of the next symbol by the next ``bits`` bits of the stream; the table is made when it is first needed."""

    def __init__(self, lengths: np.ndarray | None, lone: int = 0):
        self.lengths, self.bits, self.lone = lengths, 0, lone
        self._table: tuple[np.ndarray, np.ndarray] | None = None
        if lengths is None:
            return
        used = np.flatnonzero(lengths)
        if not len(used):
            raise ValueError("a prefix code without symbols")
        if len(used) == 1:
            self.lone = int(used[0])
            return
        size = lengths[used]
        if int((1 << (MOST_CODE_BITS - size)).sum()) != 1 << MOST_CODE_BITS:
            raise ValueError("a prefix code that isn't complete")
        self.bits = int(size.max())

    @property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and length by the next bits."""
        if self._table is None:
            both = np.full(1 << self.bits, self.lone << 4, np.int32)
            if self.bits:
                used = np.flatnonzero(self.lengths)
                for s, c, n in zip(used.tolist(), canonical(self.lengths)[used].tolist(), self.lengths[used].tolist(), strict=True):
                    both[c :: 1 << n] = s << 4 | n
            self._table = both >> 4, both & 15
        return self._table

    def next(self, bits: Bits) -> int:
        if not self.bits:
            return self.lone
        symbol, length = self.table
        i = bits.peek(self.bits)
        bits.at += int(length[i])
        return int(symbol[i])


class Bits:
    """Reader of bits, the lowest of a byte first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data, at, 8 * len(data)

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 5], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        x = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise ValueError("the image ends early")
        return x


#: Steps through code lengths by the code that they are written in; as many are kept as encoders use often.
_steps: dict[bytes, tuple[list[tuple[int, int]], int]] = {}
MOST_STEPS = 256


def steps_of(of_lengths: np.ndarray) -> tuple[list[tuple[int, int]], int]:
    """By the next bits of code lengths: a symbol and its length; and the mask of these bits."""
    key = of_lengths.tobytes()
    if key not in _steps:
        code = Code(of_lengths)
        if len(_steps) >= MOST_STEPS:
            _steps.clear()
        symbol, length = code.table
        _steps[key] = list(zip(symbol.tolist(), length.tolist(), strict=True)), (1 << code.bits) - 1
    return _steps[key]


def read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        if not two:
            return Code(None, first)
        lengths = np.zeros(max(256, size), np.int64)
        lengths[[first, bits.read(8)]] = 1
        return Code(lengths)
    # What follows takes at most 14 bits for each symbol; it is read from one number that is shifted on.
    byte = bits.at >> 3
    x = int.from_bytes(bits.data[byte : byte + 2 * size + 64], "little") >> (bits.at & 7)
    used = 4
    shown = 4 + (x & 15)
    x >>= 4
    of_lengths = np.zeros(19, np.int64)
    for i in range(shown):
        of_lengths[CODE_LENGTH_ORDER[i]] = x & 7
        x >>= 3
    used += 3 * shown + 1
    limited, left = x & 1, size
    x >>= 1
    if limited:
        n = 2 + 2 * (x & 7)
        x >>= 3
        left = 2 + (x & ((1 << n) - 1))
        x >>= n
        used += 3 + n
    steps, mask = steps_of(of_lengths)
    found, last = [], 8
    while len(found) < size and left:
        left -= 1
        s, n = steps[x & mask]
        x >>= n
        used += n
        if s < 16:
            found.append(s)
            last = s or last
        else:
            least, n = ((3, 2), (3, 3), (11, 7))[s - 16]
            found += [last if s == 16 else 0] * (least + (x & ((1 << n) - 1)))
            x >>= n
            used += n
    bits.at += used
    if len(found) > size or bits.at > bits.end:
        raise ValueError("wrong code lengths")
    lengths = np.zeros(size, np.int64)
    lengths[: len(found)] = found
    return Code(lengths)


def read_value(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def split_value(value: int) -> tuple[int, int, int]:
    """Prefix symbol, number of extra bits and their value for a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    return 2 * top + second, top - 1, v & ((1 << (top - 1)) - 1)


def distance(code: int, width: int) -> int:
    if code > len(NEIGHBOURS):
        return code - len(NEIGHBOURS)
    x, y = NEIGHBOURS[code - 1]
    return max(1, x + y * width)


# --- decoder ----------------------------------------------------------------------------------------------------------


class Image:
    """An entropy-coded image whose codes have been read; only the main one of a file can have several groups of codes."""

    def __init__(self, bits: Bits, width: int, height: int, *, main: bool):
        self.bits, self.width, self.height = bits, width, height
        self.cache_bits = bits.read(4) if bits.read(1) else 0
        if self.cache_bits > 11:
            raise ValueError("too large a colour cache")
        groups, self.tile_bits, self.tiles = 1, 0, None
        if main and bits.read(1):
            self.tile_bits = bits.read(3) + 2
            self.tiles = Image(bits, -(-width >> self.tile_bits), -(-height >> self.tile_bits), main=False).read() >> np.uint32(8) & np.uint32(0xFFFF)
            groups = int(self.tiles.max()) + 1
        sizes = (256 + LENGTH_CODES + (1 << self.cache_bits if self.cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
        self.codes = [[read_code(bits, n) for n in sizes] for _ in range(groups)]
        #: Only green varies.
        self.grey = groups == 1 and not self.cache_bits and not any(c.bits for c in self.codes[0][1:4])
        #: Pixels read so far, if only green varies.
        self.at, self.green = 0, np.zeros(0, np.uint8)

    def read(self) -> np.ndarray:
        """Its pixels."""
        if self.grey:
            self.green = np.zeros(self.width * self.height, np.uint8)
            read_green(self)
            return self.pixels()
        bits, width, codes, cache_bits, tiles = self.bits, self.width, self.codes, self.cache_bits, self.tiles
        total = width * self.height
        put, cache, at, seen = [0] * total, [0] * (1 << cache_bits), 0, 0
        while at < total:
            group = codes[int(tiles[(at // width) >> self.tile_bits, (at % width) >> self.tile_bits])] if tiles is not None else codes[0]
            s = group[0].next(bits)
            if s < 256:
                red, blue, alpha = group[1].next(bits), group[2].next(bits), group[3].next(bits)
                put[at] = alpha << 24 | red << 16 | s << 8 | blue
                at += 1
            elif s < 256 + LENGTH_CODES:
                n = read_value(bits, s - 256)
                d = distance(read_value(bits, group[4].next(bits)), width)
                if d > at or at + n > total:
                    raise ValueError("a back-reference to outside the image")
                for i in range(at, at + n):
                    put[i] = put[i - d]
                at += n
            else:
                if cache_bits:
                    for p in put[seen:at]:
                        cache[(p * CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - cache_bits)] = p
                seen = at
                put[at] = cache[s - 256 - LENGTH_CODES]
                at += 1
            if bits.at > bits.end:
                raise ValueError("the image ends early")
        return np.array(put, np.uint32).reshape(self.height, width)

    def event(self) -> None:
        """Reads one symbol of an image where only green varies."""
        green, bits, at = self.codes[0][0], self.bits, self.at
        if bits.at >= bits.end and green.bits:
            raise ValueError("the image ends early")
        s = green.next(bits)
        if s < 256:
            self.green[at] = s
            self.at = at + 1
            return
        n = read_value(bits, s - 256)
        d = distance(read_value(bits, self.codes[0][4].next(bits)), self.width)
        if d > at or at + n > self.width * self.height:
            raise ValueError("a back-reference to outside the image")
        self.green[at : at + n] = self.green[at - d : at - d + n] if d >= n else np.resize(self.green[at - d : at], n)
        self.at = at + n

    def pixels(self) -> np.ndarray:
        rest = np.uint32(self.codes[0][3].lone << 24 | self.codes[0][1].lone << 16 | self.codes[0][2].lone)
        return (self.green[: self.width * self.height].astype(np.uint32).reshape(self.height, self.width) << np.uint32(8)) | rest


#: Symbols that one lookup gives at most.
AT_ONCE = 4


def symbol_table(code: Code, index_bits: int) -> list[int]:
    """By the next ``index_bits`` bits, the literals that they hold whole: up to four bytes, from bit 32 their number, from bit 36 their bits;
    0 where the first symbol isn't a literal or doesn't fit."""
    window = np.arange(1 << index_bits)
    symbol, size = code.table
    both, mask = symbol.astype(np.int64) << 4 | size, (1 << code.bits) - 1
    at, packed, n = np.zeros_like(window), np.zeros_like(window), np.zeros_like(window)
    alive = np.ones(len(window), np.int64)
    for k in range(AT_ONCE):
        x = both[window >> at & mask]
        length = x & 15
        alive &= (length <= index_bits - at) & (x < 256 << 4)
        packed |= (x >> 4) * alive << 8 * k
        at += length * alive
        n += alive
        if not alive.any():
            break
    return ((packed | n << 32 | at << 36) * (n > 0)).tolist()


def read_green(image: Image) -> None:
    """The rest of an image where only green varies: several literals by one lookup, until a back-reference or the end comes near."""
    bits, green, total, out = image.bits, image.codes[0][0], image.width * image.height, image.green
    if not green.bits:
        if green.lone >= 256:
            raise ValueError("a back-reference to outside the image")
        out[image.at : total], image.at = green.lone, total
        return
    left = total - image.at
    index_bits = 10 if left < 1 << 12 else 11 if left < 1 << 13 else 12
    mask, table = (1 << index_bits) - 1, symbol_table(green, index_bits) if left > 16 else []
    data = np.frombuffer(bits.data[bits.at >> 3 :] + b"\0\0\0", np.uint8).astype(np.int32)
    origin, column = bits.at >> 3, np.arange(AT_ONCE)
    base, window = 0, []
    while image.at < total:
        if table and not base <= bits.at < base + 8 * len(window):
            first = bits.at >> 3
            some = data[first - origin : first - origin + CHUNK + 2]
            if len(some) < 3:
                raise ValueError("the image ends early")
            base, window = first << 3, (some[:-2] | some[1:-1] << 8 | some[2:] << 16).tolist()
        p = bits.at - base
        got: list[int] = []
        steps = min((total - image.at) // AT_ONCE, (8 * len(window) - p) // index_bits) if table else 0
        keep = got.append
        for _ in range(steps):
            v = table[window[p >> 3] >> (p & 7) & mask]
            if not v:  # another kind of symbol
                break
            p += v >> 36
            keep(v)
        else:
            steps = 0
        bits.at = base + p
        if got:
            v = np.array(got, np.int64)
            literals = v.astype(np.uint32).view(np.uint8).reshape(-1, AT_ONCE)[column < (v >> 32 & 15)[:, None]]
            out[image.at : image.at + len(literals)] = literals
            image.at += len(literals)
            if total - image.at >= AT_ONCE and not steps:
                continue
        if image.at < total:
            image.event()
    if bits.at > bits.end:
        raise ValueError("the image ends early")


#: Bits by which images in lockstep look up their next symbols, symbols that one lookup gives at most, and images from which on lockstep pays.
STEP_BITS, STEP_SYMBOLS, FEW = 10, 3, 48


def step_tables(codes: list[Code]) -> np.ndarray:
    """For each code by the next ``STEP_BITS`` bits the literals that they hold whole: three bytes, then from bit 24 their number, from bit 26 their bits;
    0 where the first symbol isn't a literal or doesn't fit."""
    size = 1 << STEP_BITS
    lengths = np.stack([c.lengths for c in codes])
    which, symbol = np.nonzero(lengths)
    n = lengths[which, symbol]
    fits = n <= STEP_BITS
    which, symbol, n = which[fits], symbol[fits], n[fits]
    share = 1 << (STEP_BITS - n)
    # Read from the highest bit on, a code's table is its symbols by length, each as often as its share of the code space; what longer codes take is left.
    rest = size - np.bincount(which, share, len(codes)).astype(np.int64)
    order = np.argsort(np.concatenate([which, np.arange(len(codes))]) << 5 | np.concatenate([n, np.full(len(codes), 31)]), kind="stable")
    entry = np.concatenate([np.where(symbol < 256, symbol << 4 | n, 0), np.zeros(len(codes), np.int64)])[order]
    first = np.repeat(entry.astype(np.int32), np.concatenate([share, rest])[order]).reshape(len(codes), size)
    canonical(np.ones(2, np.int64))  # makes the table of reversed bits
    first = first[:, _reversed[0][:size] >> (MOST_CODE_BITS - STEP_BITS)]
    at = first & 15
    packed, number, good = first >> 4, (first > 0).astype(np.int32), first > 0
    window = np.arange(size, dtype=np.int32)
    for k in range(1, STEP_SYMBOLS):
        more = np.take_along_axis(first, window >> at, 1)
        good = good & (more > 0) & (at + (more & 15) <= STEP_BITS)
        packed |= np.where(good, more >> 4 << 8 * k, 0)
        at += np.where(good, more & 15, 0)
        number += good
    return np.where(number > 0, packed | number << 24 | at << 26, 0).ravel()


def read_greens(images: list[Image]) -> None:
    """Many images where only green varies, in lockstep: each step looks up the next symbols of all of them."""
    images = [i for i in images if i.codes[0][0].bits]
    if len(images) < FEW:
        return
    table = step_tables([i.codes[0][0] for i in images])
    data = np.frombuffer(b"".join(i.bits.data for i in images) + bytes(4), np.uint8).astype(np.int32)
    window = data[:-2] | data[1:-1] << 8 | data[2:] << 16
    size = np.array([len(i.bits.data) for i in images], np.int64)
    total = np.array([i.width * i.height for i in images], np.int64)
    start = 8 * (np.cumsum(size) - size)
    room = total + STEP_SYMBOLS  # the last step may go beyond an image's end
    place = np.cumsum(room) - room
    out = np.zeros(int(room.sum()), np.uint8)
    for i, a, n in zip(images, place.tolist(), room.tolist(), strict=True):
        i.green = out[a : a + n]
    last = 8 * len(window) - 1
    lane, pos, at, end = np.arange(len(images)), start + [i.bits.at for i in images], place.copy(), place + total
    base = lane << STEP_BITS
    while len(lane) >= FEW:
        e = table[base + (window[pos >> 3] >> (pos & 7) & ((1 << STEP_BITS) - 1))]
        out[at] = e & 255
        out[at + 1] = e >> 8 & 255
        out[at + 2] = e >> 16 & 255
        at += e >> 24 & 3
        pos += e >> 26
        halt = (e == 0) | (at >= end) | (pos > last)
        if halt.any():
            for k in np.flatnonzero(halt).tolist():
                i = int(lane[k])
                image = images[i]
                image.at, image.bits.at = int(at[k] - place[i]), int(pos[k] - start[i])
                if image.at < total[i]:
                    image.event()
                elif image.at > total[i] and image.bits.at <= image.bits.end + STEP_BITS:  # symbols beyond the end were looked up
                    image.at, image.bits.at = int(total[i]), min(image.bits.at, image.bits.end)
                if image.bits.at > image.bits.end:
                    raise ValueError("the image ends early")
                at[k], pos[k] = place[i] + image.at, start[i] + image.bits.at
            keep = at < end
            if not keep.all():
                lane, pos, at, end, base = lane[keep], pos[keep], at[keep], end[keep], base[keep]
    for k, i in enumerate(lane.tolist()):
        images[i].at, images[i].bits.at = int(at[k] - place[i]), int(pos[k] - start[i])


class File:
    """A lossless WebP file, read up to its main image's codes."""

    def __init__(self, data: bytes):
        if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
            raise ValueError("not a lossless WebP file")
        bits = Bits(data[20 : 20 + struct.unpack("<I", data[16:20])[0]])
        if bits.read(8) != SIGNATURE:
            raise ValueError("not a lossless WebP image")
        width, height = bits.read(14) + 1, bits.read(14) + 1
        bits.read(1)
        if bits.read(3):
            raise ValueError("an unknown version")
        self.todo, inner = [], width
        while bits.read(1):
            kind = bits.read(2)
            if kind in [t[0] for t in self.todo]:
                raise ValueError("a transform twice")
            if kind in (PREDICTOR, CROSS_COLOUR):
                n = bits.read(3) + 2
                self.todo.append((kind, n, Image(bits, -(-inner >> n), -(-height >> n), main=False).read()))
            elif kind == PALETTE:
                size = bits.read(8) + 1
                table = Image(bits, size, 1, main=False).read()
                self.todo.append((kind, inner, pixels(np.cumsum(channels(table)[0], axis=0, dtype=np.uint8))))
                inner = -(-inner >> bundle_bits(size))
            else:
                self.todo.append((kind,))
        self.image = Image(bits, inner, height, main=True)

    def pixels(self) -> np.ndarray:
        """The main image, read to its end, with the transforms undone."""
        image = self.image
        if len(image.green):
            read_green(image)
            x, image.green = image.pixels(), image.green[:0]
        else:
            x = image.read()
        for kind, *more in reversed(self.todo):
            if kind == PREDICTOR:
                x = invert_predictor(x, more[0], more[1] >> np.uint32(8) & np.uint32(15))
            elif kind == CROSS_COLOUR:
                x = cross_colour(x, more[0], more[1], invert=True)
            elif kind == SUBTRACT_GREEN:
                x = green_shift(x, 1)
            else:
                x = from_palette(x, more[1], more[0])
        return x


def decode(data: bytes) -> np.ndarray:
    """The image's pixels, alpha in the highest byte: (height, width) uint32."""
    return File(data).pixels()


def decode_all(files: list[bytes]) -> Iterator[np.ndarray]:
    """The pixels of each file, as :func:`decode` gives them; images where only green varies are read in lockstep. What is held is the samples of all files, so callers bound these."""
    opened = [File(f) for f in files]
    read_greens([f.image for f in opened if f.image.grey])
    for f in opened:
        yield f.pixels()


# --- encoder ----------------------------------------------------------------------------------------------------------


class Writer:
    """Collects bits, the lowest of a value first."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.few, self.held = 0, 0  # bits not yet in parts, and their number

    def put(self, value: int, n: int) -> None:
        self.few |= value << self.held
        self.held += n

    def put_bits(self, bits: np.ndarray) -> None:
        if self.held:
            raw = np.frombuffer(self.few.to_bytes((self.held + 7) // 8, "little"), np.uint8)
            self.parts.append(np.unpackbits(raw, count=self.held, bitorder="little"))
            self.few = self.held = 0
        self.parts.append(bits)

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Values of their own numbers of bits, in order."""
        for i in range(0, len(values), 1 << 20):
            v, n = values[i : i + (1 << 20)], sizes[i : i + (1 << 20)]
            end = np.cumsum(n)
            start = end - n
            word, v = start >> 5, (v & ((1 << n) - 1)).astype(np.int64) << (start & 31)
            total = int(end[-1])
            # Bits of different values never meet, so sums of the shifted values by word are their union; floats hold 32 bits exactly.
            words = np.bincount(word, v & 0xFFFFFFFF, (total >> 5) + 2)
            words[1:] += np.bincount(word, v >> 32, (total >> 5) + 2)[:-1]
            self.put_bits(np.unpackbits(words.astype("<u4").view(np.uint8), count=total, bitorder="little"))

    def put_symbols(self, symbols: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> None:
        """Codes of symbols."""
        for i in range(0, len(symbols), 1 << 20):
            some = symbols[i : i + (1 << 20)]
            self.put_all(codes[some], sizes[some])

    def bytes(self) -> bytes:
        self.put_bits(np.empty(0, np.uint8))
        return np.packbits(np.concatenate(self.parts), bitorder="little").tobytes()


#: The code in which the encoder writes code lengths 0 to 15, and runs: bits of each.
LENGTH_CODE = (2, 7, 7, 4, 4, 4, 4, 4, 4, 4, 4, 5, 5, 6, 7, 7, 6, 4, 4)
_codes_of_lengths: list[tuple[int, int]] = []


def write_code(w: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if not used:
        used = [0]
    if len(used) <= 2 and used[-1] < 256:
        w.put(1, 1), w.put(len(used) - 1, 1), w.put(1, 1), w.put(used[0], 8)
        if len(used) == 2:
            w.put(used[1], 8)
        return
    # Code lengths and runs of them, all in one code that suits lists of lengths, so that it is made but once, here and in a reader.
    codes, few, held, number, end = _length_codes(), 0, 0, 0, used[-1] + 1
    for value, run in groupby(lengths[:end].tolist()):
        left = len(list(run))
        if value:
            few, held, number, left = few | codes[value][0] << held, held + codes[value][1], number + 1, left - 1
        while left:
            n = left
            if value and n >= 3:
                n, symbol, extra = min(n, 6), 16, 2
                more = n - 3
            elif not value and n >= 3:
                n = min(n, 138)
                symbol, extra, more = (17, 3, n - 3) if n < 11 else (18, 7, n - 11)
            else:
                n, symbol, extra, more = 1, value, 0, 0
            code, size = codes[symbol]
            few, held, number, left = few | (code | more << size) << held, held + size + extra, number + 1, left - n
    if number == 1:  # the format counts from two on
        few, held, number = few | codes[0][0] << held, held + codes[0][1], 2
    w.put(0, 1), w.put(19 - 4, 4)
    for k in CODE_LENGTH_ORDER:
        w.put(LENGTH_CODE[k], 3)
    w.put(1, 1), w.put(6, 3), w.put(number - 2, 14), w.put(few, held)


def _length_codes() -> list[tuple[int, int]]:
    """Codes and sizes of code lengths and their runs."""
    if not _codes_of_lengths:
        _codes_of_lengths.extend(zip(canonical(np.array(LENGTH_CODE)).tolist(), LENGTH_CODE, strict=True))
    return _codes_of_lengths


def matches(x: np.ndarray) -> list[tuple[int, int, int]]:
    """Back-references (place, length, distance) of at least ``LEAST_MATCH`` pixels: each place's candidate is the last one before it with equal ``LEAST_MATCH`` pixels, if it is within ``FARTHEST``."""
    n = len(x) - LEAST_MATCH + 1
    if n < 2:
        return []
    if x.dtype == np.uint8:
        eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, 8)).view("<u8")[:, 0]
        key = eight[:n] * np.uint64(0x9E3779B97F4A7C15) ^ (eight[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7))
        key = key * np.uint64(0x9E3779B97F4A7C15)
    else:
        key = np.zeros(n, np.uint64)
        for i in range(LEAST_MATCH):
            key = key * np.uint64(0x9E3779B97F4A7C15) + x[i : i + n].astype(np.uint64) + np.uint64(1)
    # Sorted by the hash's upper bits, then by place, so that neighbours with one hash are a place and the one before.
    low = max(1, n.bit_length())
    mixed = np.sort(key >> np.uint64(low) << np.uint64(low) | np.arange(n, dtype=np.uint64))
    order = (mixed & np.uint64((1 << low) - 1)).astype(np.int64)
    same = mixed[1:] >> np.uint64(low) == mixed[:-1] >> np.uint64(low)
    before = np.full(n, -1, np.int64)
    before[order[1:][same]] = order[:-1][same]
    places = np.flatnonzero(before >= 0)
    if n > FARTHEST:
        places = places[places - before[places] <= FARTHEST]
    out, at = [], 0
    k = 0
    while True:
        k += int(np.searchsorted(places[k:], at))
        if k >= len(places):
            return out
        p = int(places[k])
        b = int(before[p])
        most = min(MOST_MATCH, len(x) - p)
        size = 0
        while size < most:  # most matches are short
            step = min(64 if size < 64 else most, most - size)
            differ = x[p + size : p + size + step] != x[b + size : b + size + step]
            k_first = int(differ.argmax())
            if differ[k_first]:
                size += k_first
                break
            size += step
        if size >= LEAST_MATCH:
            out.append((p, size, p - b))
            at = p + size
        else:  # equal keys of different pixels
            at = p + 1


def write_grey(w: Writer, green: np.ndarray, rest: int, references: bool) -> None:
    """The codes and data of an image where only green varies."""
    found = matches(green) if references else []
    split = [(p, n, split_value(n), split_value(d + len(NEIGHBOURS))) for p, n, d in found]
    starts, ends = [0, *[p + n for p, n, _, _ in split]], [*[p for p, _, _, _ in split], len(green)]
    runs = [green[a:b] for a, b in zip(starts, ends, strict=True)]
    counts = np.zeros(256 + LENGTH_CODES, np.int64)
    counts[:256] = np.bincount(np.concatenate(runs), minlength=256)
    far = np.zeros(DISTANCE_CODES, np.int64)
    for _, _, n, d in split:
        counts[256 + n[0]] += 1
        far[d[0]] += 1
    sizes, far_sizes = code_lengths(counts, STEP_BITS), code_lengths(far)  # a reader in lockstep needs no more bits
    write_code(w, sizes)
    for shift in (16, 0, 24):
        w.put(1, 1), w.put(0, 1), w.put(1, 1), w.put(rest >> shift & 255, 8)
    write_code(w, far_sizes)
    codes, far_codes = canonical(sizes), canonical(far_sizes)
    sizes, far_sizes = (x if np.count_nonzero(x) > 1 else np.zeros_like(x) for x in (sizes, far_sizes))
    w.put_symbols(runs[0], codes[:256], sizes[:256])
    for run, (_, _, (ns, nn, nv), (ds, dn, dv)) in zip(runs[1:], split, strict=True):
        w.put(int(codes[256 + ns]), int(sizes[256 + ns])), w.put(nv, nn), w.put(int(far_codes[ds]), int(far_sizes[ds])), w.put(dv, dn)
        if len(run):
            w.put_symbols(run, codes[:256], sizes[:256])


def write_image(w: Writer, argb: np.ndarray, *, main: bool, cache_bits: int = 0, references: bool = False, group_bits: int = 0, groups: np.ndarray | None = None) -> None:
    """An entropy-coded image. ``groups``: by tile of 2^``group_bits`` pixels the group of codes to use; only for the main image."""
    flat = argb.ravel().astype(np.uint32)
    height, width = argb.shape
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0 if groups is None else 1, 1)
        if groups is not None:
            w.put(group_bits - 2, 3)
            write_image(w, groups.astype(np.uint32) << np.uint32(8), main=False)
    rest = flat & np.uint32(0xFFFF00FF)
    if not cache_bits and groups is None and (rest == rest[0]).all():
        write_grey(w, (flat >> np.uint32(8)).astype(np.uint8), int(rest[0]), references)
        return
    found = matches(flat) if references else []
    copied = np.zeros(len(flat), bool)
    for p, n, _ in found:
        copied[p : p + n] = True
    part = channels(flat).astype(np.int64)
    symbol = part[:, 1].copy()
    hit = np.zeros(len(flat), bool)
    if cache_bits:
        cache: dict[int, int] = {}
        for i, p in enumerate(flat.tolist()):
            h = (p * CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - cache_bits)
            if not copied[i] and cache.get(h, 0) == p:
                symbol[i], hit[i] = 256 + LENGTH_CODES + h, True
            cache[h] = p
    of = np.zeros(len(flat), np.int64)
    if groups is not None:
        of = np.repeat(np.repeat(groups, 1 << group_bits, 0), 1 << group_bits, 1)[:height, :width].ravel().astype(np.int64)
    literal = ~copied & ~hit
    number = int(of.max()) + 1
    sizes = (256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    codes = []
    split = [(p, split_value(n), split_value(d + len(NEIGHBOURS))) for p, n, d in found]
    for g in range(number):
        mine = of == g
        counts = [np.bincount(symbol[mine & ~copied], minlength=sizes[0])] + [np.bincount(part[mine & literal, c], minlength=256) for c in (2, 0, 3)] + [np.zeros(sizes[4], np.int64)]
        for p, n, d in split:
            if of[p] == g:
                counts[0][256 + n[0]] += 1
                counts[4][d[0]] += 1
        five = []
        for c in counts:
            lengths = code_lengths(c)
            write_code(w, lengths)
            five.append((canonical(lengths), np.zeros_like(lengths) if np.count_nonzero(lengths) < 2 else lengths))
        codes.append(five)
    if number == 1 and not any(x[1].any() for x in codes[0][1:4]):
        value, size = codes[0][0][0][symbol], codes[0][0][1][symbol]
        rows = (value[:, None], size[:, None])
    else:
        value, size = np.zeros((len(flat), 4), np.int64), np.zeros((len(flat), 4), np.int64)
        for g in range(number):
            mine = of == g
            for k, c in enumerate((1, 2, 0, 3)):
                s = symbol[mine] if k == 0 else part[mine, c]
                value[mine, k], size[mine, k] = codes[g][k][0][s], codes[g][k][1][s]
        size[hit, 1:] = 0
        rows = (value, size)
    at = 0
    for p, (ls, ln, lv), (ds, dn, dv) in split:
        if p > at:
            w.put_all(rows[0][at:p].ravel(), rows[1][at:p].ravel())
        five = codes[of[p]]
        w.put(int(five[0][0][256 + ls]), int(five[0][1][256 + ls])), w.put(lv, ln), w.put(int(five[4][0][ds]), int(five[4][1][ds])), w.put(dv, dn)
        at = p + _value(ls, lv)
    if at < len(flat):
        w.put_all(rows[0][at:].ravel(), rows[1][at:].ravel())


def _value(prefix: int, extra: int) -> int:
    return prefix + 1 if prefix < 4 else ((2 + (prefix & 1)) << ((prefix - 2) >> 1)) + extra + 1


def encode(argb: np.ndarray, transforms: list[tuple] = (), *, cache_bits: int = 0, references: bool = True, group_bits: int = 0, groups: np.ndarray | None = None) -> bytes:
    """A lossless WebP file of (height, width) uint32 pixels.

    ``transforms``, in the order in which they are applied: ``(PREDICTOR, bits, modes)``, ``(CROSS_COLOUR, bits, elements)``, ``(SUBTRACT_GREEN,)``,
    ``(PALETTE,)``; bits 2 to 9 is the size of a tile, arrays have a value per tile.
    """
    height, width = argb.shape
    if not 0 < height <= MOST_SIDE or not 0 < width <= MOST_SIDE:
        raise ValueError("an image's sides are 1 to 16384 pixels")
    w = Writer()
    w.put(SIGNATURE, 8), w.put(width - 1, 14), w.put(height - 1, 14), w.put(int((argb >> np.uint32(24) != 255).any()), 1), w.put(0, 3)
    x = argb.astype(np.uint32)
    for kind, *more in transforms:
        w.put(1, 1), w.put(kind, 2)
        if kind == PREDICTOR:
            w.put(more[0] - 2, 3)
            write_image(w, more[1].astype(np.uint32) << np.uint32(8) | np.uint32(BLACK), main=False)
            x = apply_predictor(x, more[0], more[1])
        elif kind == CROSS_COLOUR:
            w.put(more[0] - 2, 3)
            write_image(w, more[1], main=False)
            x = cross_colour(x, more[0], more[1], invert=False)
        elif kind == SUBTRACT_GREEN:
            x = green_shift(x, -1)
        else:
            table = np.unique(x)
            if len(table) > 256:
                raise ValueError("a palette has at most 256 colours")
            steps = channels(table)
            steps = np.concatenate([steps[:1], steps[1:] - steps[:-1]])
            w.put(len(table) - 1, 8)
            write_image(w, pixels(steps)[None, :], main=False)
            x = to_palette(x, table)
    w.put(0, 1)
    write_image(w, x, main=True, cache_bits=cache_bits, references=references, group_bits=group_bits, groups=groups)
    body = w.bytes()
    body += b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", len(body) + 12) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body


# --- bytes as images --------------------------------------------------------------------------------------------------


def _cost(n: np.ndarray) -> float:
    """Bits that ideal codes take for bytes that occur so often."""
    n = n[n > 0]
    return float(n.sum() * np.log2(n.sum()) - (n * np.log2(n)).sum())


def store(payload: bytes) -> bytes:
    """Bytes, a positive multiple of 64, as grey pixels of lossless WebP files, one for each 2^28 samples.

    Rows have 64 samples, or a multiple of it where rows would be over 16384; the last row is then filled up with zeros. Up to 16 different
    bytes become a palette; otherwise the cheapest of no, left and upper prediction is taken, then green is subtracted, so that
    red and blue vanish. Repeats become back-references.
    """
    if not payload or len(payload) % 64:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    out = []
    for k in range(0, len(payload), MOST_SIDE * MOST_SIDE):
        x = np.frombuffer(payload[k : k + MOST_SIDE * MOST_SIDE], np.uint8)
        width = 64 * -(-len(x) // (64 * MOST_SIDE))
        height = -(-len(x) // width)
        if width * height > len(x):
            x = np.concatenate([x, np.zeros(width * height - len(x), np.uint8)])
        grey = x.reshape(height, width)
        argb = grey.astype(np.uint32) * np.uint32(0x010101) | np.uint32(BLACK)
        often = np.bincount(x, minlength=256)
        if np.count_nonzero(often) <= 16:
            out.append(encode(argb, [(PALETTE,)]))
            continue
        up, left = grey.copy(), grey.copy()
        up[1:] -= grey[:-1]
        left[:, 1:] -= grey[:, :-1]
        mode = int(np.argmin([_cost(often), _cost(np.bincount(left.ravel(), minlength=256)), _cost(np.bincount(up.ravel(), minlength=256))]))
        bits = 9
        tiles = np.full((-(-height >> bits), -(-width >> bits)), mode)
        out.append(encode(argb, ([(PREDICTOR, bits, tiles)] if mode else []) + [(SUBTRACT_GREEN,)]))
    return b"".join(out)


def files(data: bytes) -> Iterator[bytes]:
    """Concatenated files apart."""
    at = 0
    while at < len(data):
        n = 8 + struct.unpack("<I", data[at + 4 : at + 8])[0]
        yield data[at : at + n]
        at += n


def images(data: bytes) -> Iterator[np.ndarray]:
    """The pixels of concatenated files."""
    return map(decode, files(data))


#: Samples that are read back together, about.
TOGETHER_BYTES = 6 << 20


def features(samples: np.ndarray, shape: tuple[int, int]) -> str:
    """Size, mean, standard deviation and the mean of each of 16 equal bands of the samples, from the pixel array; their number is a multiple of 16."""
    count = np.bincount(samples, minlength=256)
    value, n = np.arange(256), len(samples)
    mean = float(count @ value) / n
    deviation = (float(count @ (value * value)) / n - mean * mean) ** 0.5 if count.max() < n else 0.0
    bands = samples.reshape(16, -1).sum(axis=1, dtype=np.int64) / (n // 16)
    return f"{shape[1]}x{shape[0]};{mean:.4f};{deviation:.4f};" + bytes(np.rint(bands).astype(np.uint8)).hex()


def media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_bytes long, payload_bytes long, media binary`` per row: the whole text in UTF-8, zeros up to a positive multiple of 64, as WebP.

    A null text is empty and so 64 zeros. Null ids and repeated rows stay, other columns aren't read, an empty table gives an empty table.
    """
    src = docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias("_text"))
    kind = src.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in part.column("_text").to_pylist()]
                full = [r + b"\0" * (-len(r) % 64 if r else 64) for r in raw]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(map(len, full), pa.int64()), pa.array(map(store, full), pa.binary())], [id_col, "n_bytes", "payload_bytes", "media"]
                )

    return src.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, media binary")


def samples(stored: DataFrame) -> DataFrame:
    """Decodes a table of :func:`media`: its columns and ``samples binary`` (the payload, read back), ``feature string``."""
    names = stored.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", TOGETHER_BYTES, 1 << 14, sizes=batch.column("payload_bytes").to_numpy()):
                payloads, found = [], []
                apart = [list(files(x)) for x in part.column("media").to_pylist()]
                together = decode_all([f for x in apart for f in x])
                for x, n in zip(apart, part.column("payload_bytes").to_pylist(), strict=True):
                    all_pixels = [next(together) for _ in x]
                    grey = (np.concatenate([channels(p)[..., 1].ravel() for p in all_pixels]) if len(x) > 1 else channels(all_pixels[0])[..., 1].ravel())[:n]
                    payloads.append(grey.tobytes()), found.append(features(grey, all_pixels[0].shape))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(payloads, pa.binary()), pa.array(found, pa.string())], [*names, "samples", "feature"])

    return stored.mapInArrow(run, f"{schema}, samples binary, feature string")


def pixel_arrays(files: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Any lossless WebP files: ``<id_col>, width int, height int, pixels binary`` (blue, green, red, alpha by pixel); a null file gives nulls."""
    src = files.select(files[id_col].alias(id_col), files[media_col].alias("media"))
    kind = src.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", 1 << 20):
                x = [None if d is None else decode(d) for d in part.column("media").to_pylist()]
                size = lambda k: pa.array([None if p is None else p.shape[k] for p in x], pa.int32())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([part.column(0), size(1), size(0), pa.array([None if p is None else channels(p).tobytes() for p in x], pa.binary())], [id_col, "width", "height", "pixels"])

    return src.mapInArrow(run, f"`{id_col}` {kind}, width int, height int, pixels binary")
