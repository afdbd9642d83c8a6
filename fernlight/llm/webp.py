"""Lossless WebP (VP8L): a decoder for the whole format and an encoder for its parts, in numpy and plain Python.

Pixels are 32-bit integers, alpha highest, then red, green and blue. Bits are read from the lowest of each byte; prefix
codes are canonical and read from their highest bit.
"""

from __future__ import annotations

import struct
from functools import cached_property, lru_cache

import numpy as np

# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Distance codes of the pixels near by: columns to the left and rows up, the nearest first.
NEAR = sorted(((dx, dy) for dx in range(-7, 9) for dy in range(8) if dy or dx > 0), key=lambda d: (d[0] ** 2 + d[1] ** 2, abs(d[0]), -d[0]))
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
CACHE_FACTOR = 0x1E35A7BD
SIDE = 16_384  # most pixels of a side
BLACK = 0xFF000000


# Prefix codes


@lru_cache(maxsize=16)
def turned(bits: int) -> np.ndarray:
    """All numbers of so many bits with their bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


def _canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Used symbols in the order of their codes, shorter codes first, and their lengths."""
    used = np.flatnonzero(lengths)
    order = np.argsort(lengths[used], kind="stable")
    return used[order], lengths[used][order]


def reversed_codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes of symbols with these lengths, first bit lowest."""
    out = np.zeros(len(lengths), np.int64)
    used, n = _canonical(lengths)
    if len(used):
        most = int(n[-1])
        spans = 1 << (most - n)
        out[used] = turned(most)[np.cumsum(spans) - spans]  # codes as wide as the longest one, reversed: the low bits stay
    return out


class Code:
    """A prefix code to read with: for each value of the next `bits` bits a symbol and its length."""

    def __init__(self, lengths: tuple[int, ...]):
        used, n = _canonical(np.array(lengths, np.int64))
        if len(used) <= 1:  # the one symbol takes no bits
            self.bits, self.symbol, self.length = 0, np.array(used if len(used) else [0]), np.zeros(1, np.int64)
        else:
            if int(np.sum(1 << (15 - n))) != 1 << 15:
                raise ValueError("a prefix code is not complete")
            self.bits = int(n[-1])
            at = turned(self.bits)
            self.symbol, self.length = np.repeat(used, 1 << (self.bits - n))[at], np.repeat(n, 1 << (self.bits - n))[at]

    @cached_property
    def symbols(self) -> list[int]:
        return self.symbol.tolist()

    @cached_property
    def lengths(self) -> list[int]:
        return self.length.tolist()


@lru_cache(maxsize=64)
def code_of(lengths: tuple[int, ...]) -> Code:
    return Code(lengths)


class Bits:
    """Reads bits; what lies beyond the end is 0, and reading far beyond it is an error."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(8), 0, 8 * len(data)

    def peek(self) -> int:
        if self.at > self.end:
            raise ValueError("the image ends early")
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 5], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        value = self.peek() & ((1 << n) - 1)
        self.at += n
        return value

    def symbol(self, code: Code) -> int:
        if not code.bits:
            return code.symbols[0]
        i = self.peek() & ((1 << code.bits) - 1)
        self.at += code.lengths[i]
        return code.symbols[i]

    def code(self, alphabet: int) -> Code:
        if self.read(1):
            two = self.read(1)
            symbols = [self.read(8 if self.read(1) else 1)]
            if two:
                symbols.append(self.read(8))
            lengths = [0] * alphabet
            for s in symbols:
                if s >= alphabet:
                    raise ValueError("a simple prefix code names a symbol that there isn't")
                lengths[s] = 1
            return code_of(tuple(lengths))
        of_lengths = [0] * 19
        for k in LENGTH_ORDER[: 4 + self.read(4)]:
            of_lengths[k] = self.read(3)
        reader = code_of(tuple(of_lengths))
        left = 2 + self.read(2 + 2 * self.read(3)) if self.read(1) else alphabet
        lengths, before, at, data = [], 8, self.at, self.data
        symbols, sizes, mask = reader.symbols, reader.lengths, (1 << reader.bits) - 1
        window, used = 0, 64
        while len(lengths) < alphabet and left:
            left -= 1
            if used > 40:  # a length takes at most 14 bits
                if at > self.end:
                    raise ValueError("the image ends early")
                window, used = int.from_bytes(data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7), at & 7
            s = symbols[window & mask]
            n = sizes[window & mask]
            if s < 16:
                lengths.append(s)
                before = s or before
            elif s == 16:
                lengths += [before] * (3 + (window >> n & 3))
                n += 2
            elif s == 17:
                lengths += [0] * (3 + (window >> n & 7))
                n += 3
            else:
                lengths += [0] * (11 + (window >> n & 127))
                n += 7
            window >>= n
            used += n
            at += n
        self.at = at
        if len(lengths) > alphabet:
            raise ValueError("a prefix code has too many lengths")
        return code_of(tuple(lengths + [0] * (alphabet - len(lengths))))

    def amount(self, prefix: int) -> int:
        """A length or distance code with its extra bits."""
        if prefix < 4:
            return prefix + 1
        extra = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << extra) + self.read(extra) + 1


# Decoding


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width) of one lossless image."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP image")
    (size,) = struct.unpack_from("<I", data, 16)
    bits = Bits(data[20 : 20 + size])
    if bits.read(8) != 0x2F:
        raise ValueError("the image lacks its signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    alpha, version = bits.read(1), bits.read(3)
    if version:
        raise ValueError("unknown version")
    transforms, seen, across = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            transforms.append((kind, block, _pixels(bits, -(-across >> block), -(-height >> block), False), across))
        elif kind == SUBTRACT_GREEN:
            transforms.append((kind, 0, None, across))
        else:
            n = bits.read(8) + 1
            palette = _add_all(_pixels(bits, n, 1, False)[0])
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, packed, palette, across))
            across = -(-across >> packed)
    out = _pixels(bits, across, height, True)
    for kind, size, image, wide in reversed(transforms):
        out = (_unpredict, _uncross, _add_green, _unindex)[kind](out, size, image, wide)
    return out if alpha else out | np.uint32(BLACK)


def _pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image (height, width)."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, which, block = 1, None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        which = (_pixels(bits, -(-width >> block), -(-height >> block), False) >> np.uint32(8)) & np.uint32(0xFFFF)
        groups = int(which.max()) + 1
        which = which.tolist()
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [[bits.code(n) for n in (280 + cache_size, 256, 256, 256, 40)] for _ in range(groups)]
    total = width * height
    if which is None and not cache_size and not any(c.bits for c in codes[0][1:4]):
        return _one_channel(bits, codes[0], width, total).reshape(height, width)
    out, cache, cached, n = [0] * total, [0] * cache_size, 0, 0
    shift = 32 - cache_bits
    while n < total:
        green, red, blue, alpha, distance = codes[which[n // width >> block][n % width >> block] if which else 0]
        s = bits.symbol(green)
        if s < 256:
            out[n] = bits.symbol(red) << 16 | s << 8 | bits.symbol(blue) | bits.symbol(alpha) << 24
            n += 1
        elif s < 280:
            length = bits.amount(s - 256)
            back = _distance(bits.amount(bits.symbol(distance)), width)
            if back > n or n + length > total:
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                out[n] = out[n - back]
                n += 1
        else:
            while cached < n:
                cache[(CACHE_FACTOR * out[cached] & 0xFFFFFFFF) >> shift] = out[cached]
                cached += 1
            out[n] = cache[s - 280]
            n += 1
    return np.array(out, np.uint32).reshape(height, width)


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    dx, dy = NEAR[code - 1]
    return max(1, dx + dy * width)


def _amounts(prefix: np.ndarray, peek, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distance codes of these prefixes, whose extra bits begin at the given places; and where they end."""
    extra = np.maximum(0, (prefix - 2) >> 1)
    return np.where(prefix < 4, prefix, (2 + (prefix & 1) << extra) + (peek(at) & ((1 << extra) - 1))) + 1, at + extra


#: Bytes of a stream that are looked at at once, and steps that are taken at once within them.
STRETCH, HOP = 1 << 15, 4


@lru_cache(maxsize=16)
def _near_by(width: int) -> np.ndarray:
    """How many pixels the near distance codes go back, from 1."""
    return np.array([0, *(max(1, dx + dy * width) for dx, dy in NEAR)])


def _one_channel(bits: Bits, codes: list[Code], width: int, total: int) -> np.ndarray:
    """Pixels of which only green varies.

    At every bit position of a stretch the symbol there is looked up, with the length and distance of a back-reference,
    and so where the next symbol would begin. Joining such steps gives steps of 2, 4, ... symbols; the symbols that are
    really there are found by the longest steps and filled in by the shorter ones.
    """
    green, red, blue, alpha, distance = codes
    fixed = red.symbols[0] << 16 | blue.symbols[0] | alpha.symbols[0] << 24
    if not green.bits and green.symbols[0] < 256:
        return np.full(total, fixed | green.symbols[0] << 8, np.uint32)
    out, n = np.empty(total, np.uint32), 0
    near, entry = _near_by(width), green.symbol << 4 | green.length
    whole = np.frombuffer(bits.data + bytes(32), np.uint8)
    while n < total:
        origin = bits.at >> 3
        data = whole[origin : origin + STRETCH + 24].astype(np.int64)
        inner = 8 * max(1, min(STRETCH, len(data) - 24))  # positions at which a symbol may begin here
        words = data[:-7].copy()
        for k in range(1, 7):
            words |= data[k : k - 7] << (8 * k)

        def peek(at: np.ndarray, words: np.ndarray = words) -> np.ndarray:
            return words[at >> 3] >> (at & 7)

        value = (words[: inner // 8, None] >> np.arange(8)).ravel() & ((1 << green.bits) - 1)
        found = entry.take(value)  # the symbol, and its length in the low bits
        step = found & 15
        size, back = np.ones(inner, np.int64), np.zeros(inner, np.int64)
        refs = np.flatnonzero(found >= 256 << 4)
        if len(refs):
            size[refs], at = _amounts((found[refs] >> 4) - 256, peek, refs + step[refs])
            key = peek(at) & ((1 << distance.bits) - 1)
            code, at = _amounts(distance.symbol[key], peek, at + distance.length[key])
            back[refs] = np.where(code > 120, code - 120, near[np.minimum(code, 120)])
            step[refs] = at - refs
        # Places beyond the stretch stay where they are.
        ends = np.arange(inner) + step
        hops = [np.minimum(np.append(ends, inner), inner)]
        for _ in range(HOP):
            hops.append(hops[-1].take(hops[-1]))
        heads, p, longest = [], bits.at & 7, hops[HOP]
        while p < inner:
            heads.append(p)
            p = int(longest[p])
        at = np.array(heads, np.int64)
        for k in range(HOP - 1, -1, -1):
            at = np.stack([at, hops[k].take(at)], axis=1).ravel()
        at = at[at < inner]
        begins = n + np.cumsum(size[at]) - size[at]
        at, begins = at[begins < total], begins[begins < total]
        n = int(begins[-1] + size[at[-1]])
        bits.at = 8 * origin + int(ends[at[-1]])
        if n > total:
            raise ValueError("a back-reference leaves the image")
        if bits.at > bits.end:
            raise ValueError("the image ends early")
        far = np.flatnonzero(back[at])
        plain = np.delete(np.arange(len(at)), far) if len(far) else slice(None)
        out[begins[plain]] = (found[at[plain]] >> 4).astype(np.uint32) << np.uint32(8) | np.uint32(fixed)
        for to, d, k in zip(begins[far].tolist(), back[at[far]].tolist(), size[at[far]].tolist(), strict=True):
            if d > to:
                raise ValueError("a back-reference leaves the image")
            out[to : to + k] = out[to - d : to - d + k] if d >= k else np.resize(out[to - d : to], k)
    return out


def _split(pixels: np.ndarray) -> list[np.ndarray]:
    """Alpha, red, green and blue, each as integers."""
    return [(pixels >> np.uint32(s) & np.uint32(255)).astype(np.int64) for s in (24, 16, 8, 0)]


def _join(alpha: np.ndarray, red: np.ndarray, green: np.ndarray, blue: np.ndarray) -> np.ndarray:
    return ((alpha & 255) << 24 | (red & 255) << 16 | (green & 255) << 8 | blue & 255).astype(np.uint32)


def _add_all(pixels: np.ndarray) -> np.ndarray:
    """Running sums of a palette's channels."""
    return _join(*(np.cumsum(c) for c in _split(pixels)))


def _add_green(pixels: np.ndarray, _size: int, _image: None, _wide: int, sign: int = 1) -> np.ndarray:
    a, r, g, b = _split(pixels)
    return _join(a, r + sign * g, g, b + sign * g)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x + 128 & 255) - 128


def _uncross(pixels: np.ndarray, block: int, image: np.ndarray, wide: int, sign: int = 1) -> np.ndarray:
    rows, columns = np.arange(pixels.shape[0]) >> block, np.arange(wide) >> block
    _, red_blue, green_blue, green_red = _split(image[rows][:, columns])
    a, r, g, b = _split(pixels)
    by = lambda m, c: _signed(m) * _signed(c) >> 5
    new_red = r + sign * by(green_red, g)
    # Blue follows the true red: the decoder has it after, the encoder before its own change.
    return _join(a, new_red, g, b + sign * (by(green_blue, g) + by(red_blue, (new_red if sign > 0 else r) & 255)))


def _unindex(pixels: np.ndarray, packed: int, palette: np.ndarray, wide: int) -> np.ndarray:
    index = (pixels >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    if packed:
        width = 8 >> packed
        index = ((index[:, :, None] >> (np.arange(1 << packed) * width)) & ((1 << width) - 1)).reshape(len(pixels), -1)[:, :wide]
    table = np.zeros(256, np.uint32)
    table[: len(palette)] = palette
    return table[index]


def _channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _mean(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _clamp(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def _pack(c) -> int:
    a, r, g, b = c
    return a << 24 | r << 16 | g << 8 | b


def predict(mode: int, left: int, top: int, top_right: int, top_left: int) -> int:
    if mode == 0:
        return BLACK
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _mean(_mean(left, top_right), top)
    if mode <= 9:
        return _mean(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return _mean(_mean(left, top_left), _mean(top, top_right))
    l, t, c = _channels(left), _channels(top), _channels(top_left)
    if mode == 11:  # of the two, the one nearer to left + top - top left
        return left if sum(abs(y - z) for y, z in zip(t, c, strict=True)) < sum(abs(x - z) for x, z in zip(l, c, strict=True)) else top
    if mode == 12:
        return _pack(_clamp(x + y - z) for x, y, z in zip(l, t, c, strict=True))
    if mode == 13:
        half = _channels(_mean(left, top))
        return _pack(_clamp(m + int((m - z) / 2)) for m, z in zip(half, c, strict=True))
    return BLACK


def _predictions(row: int, column: int, width: int, p: list[int], modes: list[list[int]], block: int) -> int:
    n = row * width + column
    if n == 0:
        return BLACK
    if row == 0:
        return p[n - 1]
    if column == 0:
        return p[n - width]
    # To the right of the last column comes the first pixel of this row.
    return predict(modes[row >> block][column >> block], p[n - 1], p[n - width], p[n - width + 1], p[n - width - 1])


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _unpredict(pixels: np.ndarray, block: int, image: np.ndarray, wide: int) -> np.ndarray:
    modes = (image >> np.uint32(8) & np.uint32(15)).tolist()
    p = pixels.ravel().tolist()
    for row in range(pixels.shape[0]):
        for column in range(wide):
            n = row * wide + column
            p[n] = _add(p[n], _predictions(row, column, wide, p, modes, block))
    return np.array(p, np.uint32).reshape(pixels.shape)


# Encoding


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Lengths of an optimal prefix code, made flatter until none exceeds `most`."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weight = np.asarray(counts, np.int64)[used]
    order = np.argsort(weight, kind="stable")
    while True:
        # The two lightest trees are joined: leaves and joined trees are each taken in the order of their weight.
        leaves, joined, parent = weight[order].tolist(), [], [0] * (2 * len(used) - 1)
        i = j = 0
        for k in range(len(used) - 1):
            total = 0
            for _ in (0, 1):
                if i < len(leaves) and (j >= len(joined) or leaves[i] <= joined[j]):
                    total += leaves[i]
                    parent[i] = len(used) + k
                    i += 1
                else:
                    total += joined[j]
                    parent[len(used) + j] = len(used) + k
                    j += 1
            joined.append(total)
        depth = [0] * len(parent)
        for k in range(len(parent) - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        lengths[used[order]] = depth[: len(used)]
        if lengths.max() <= most:
            return lengths
        weight = (weight + 1) // 2


def amount_code(value: int) -> tuple[int, int, int]:
    """Prefix, extra bits and their number of a length or distance code."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    return 2 * high + second, v & ((1 << (high - 1)) - 1), high - 1


class Writer:
    def __init__(self):
        self.fields: list[tuple[int, int]] = []

    def put(self, value: int, n: int) -> None:
        self.fields.append((value, n))

    def put_code(self, lengths: np.ndarray) -> None:
        used = np.flatnonzero(lengths).tolist()
        if len(used) <= 2 and all(s < 256 for s in used):
            used = used or [0]
            self.put(1, 1)
            self.put(len(used) - 1, 1)
            self.put(1, 1)
            for s in used:
                self.put(s, 8)
            return
        self.put(0, 1)
        runs: list[tuple[int, int, int]] = []
        before, listed = -1, lengths.tolist()
        for i in [*used, len(listed)]:
            zeros = i - before - 1
            while zeros >= 3:
                n = min(zeros, 138)
                runs.append((17, n - 3, 3) if n <= 10 else (18, n - 11, 7))
                zeros -= n
            runs += [(0, 0, 0)] * zeros
            if i < len(listed):
                runs.append((listed[i], 0, 0))
            before = i
        own = code_lengths(np.bincount([r[0] for r in runs], minlength=19), 7)
        if np.count_nonzero(own) == 1:
            own[np.flatnonzero(own == 0)[0]] = 1  # a code needs two symbols to take bits
        self.put(15, 4)
        self.fields += [(int(own[k]), 3) for k in LENGTH_ORDER]
        self.put(0, 1)
        codes, own = reversed_codes(own).tolist(), own.tolist()
        self.fields += [(codes[s] | extra << own[s], own[s] + n) for s, extra, n in runs]

    def columns(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array(x, np.int64) for x in zip(*self.fields, strict=True)) if self.fields else (np.zeros(0, np.int64),) * 2


def packed_bits(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Values of at most 24 bits, lowest bits first, one after another. No two share a bit, so that bytes are sums."""
    at = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    place, shifted = at >> 3, values << (at & 7)
    out = np.zeros(total // 8 + 5, np.int64)
    for k in range(4):
        out += np.bincount(place + k, shifted >> (8 * k) & 255, len(out)).astype(np.int64)
    return out[: -(-total // 8)].astype(np.uint8).tobytes()


def _container(columns: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    body = packed_bits(*(np.concatenate(x) for x in zip(*columns, strict=True)))
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def _header(width: int, height: int, alpha: bool) -> Writer:
    out = Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (alpha, 1), (0, 3)):
        out.put(int(value), n)
    return out


def _matches(pixels: list[int], longest: int = 4096) -> list[tuple[int, int]]:
    """(length, distance) of greedy back-references; length 1 and distance 0 is a literal."""
    seen: dict[tuple, int] = {}
    out, n = [], 0
    while n < len(pixels):
        key = tuple(pixels[n : n + 3])
        at, length = seen.get(key, -1), 0
        if at >= 0 and len(key) == 3:
            while n + length < len(pixels) and length < longest and pixels[at + length] == pixels[n + length]:
                length += 1
        seen[key] = n
        out.append((length, n - at) if length >= 3 else (1, 0))
        n += out[-1][0]
    return out


def _entropy(out: Writer, pixels: np.ndarray, cache_bits: int = 0, references: bool = True, main: bool = False, groups: np.ndarray | None = None, block: int = 0) -> None:
    """Writes an entropy-coded image. groups: the number of the code group of each block of the main image."""
    height, width = pixels.shape
    flat = pixels.ravel().tolist()
    out.put(bool(cache_bits), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(groups is not None, 1)
        if groups is not None:
            out.put(block - 2, 3)
            _entropy(out, groups.astype(np.uint32) << np.uint32(8), references=False)
    cache = [0] * (1 << cache_bits if cache_bits else 0)
    near = {}
    for code, (dx, dy) in enumerate(NEAR, 1):
        near.setdefault(max(1, dx + dy * width), code)
    events, n, cached = [], 0, 0
    for length, back in _matches(flat) if references else [(1, 0)] * len(flat):
        group = int(groups[n // width >> block, n % width >> block]) if groups is not None else 0
        p = flat[n]
        if back:
            lp, le, lb = amount_code(length)
            dp, de, db = amount_code(near.get(back, back + 120))
            events.append((group, [(0, 256 + lp)], (le, lb), [(4, dp)], (de, db)))
        else:
            while cached < n and cache:
                cache[(CACHE_FACTOR * flat[cached] & 0xFFFFFFFF) >> (32 - cache_bits)] = flat[cached]
                cached += 1
            key = (CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)
            if cache and cache[key] == p and n:
                events.append((group, [(0, 280 + key)], (0, 0), [], (0, 0)))
            else:
                events.append((group, [(0, p >> 8 & 255), (1, p >> 16 & 255), (2, p & 255), (3, p >> 24)], (0, 0), [], (0, 0)))
        n += length
    count = int(groups.max()) + 1 if groups is not None else 1
    sizes = (280 + len(cache), 256, 256, 256, 40)
    found = [[np.zeros(s, np.int64) for s in sizes] for _ in range(count)]
    for group, first, _, second, _ in events:
        for channel, s in first + second:
            found[group][channel][s] += 1
    lengths = [[code_lengths(c) for c in g] for g in found]
    for g in lengths:
        for c in g:
            out.put_code(c)
    codes = [[reversed_codes(c) for c in g] for g in lengths]
    for group, first, (le, lb), second, (de, db) in events:
        for part, extra, n_extra in ((first, le, lb), (second, de, db)):
            for channel, s in part:
                if np.count_nonzero(lengths[group][channel]) > 1:
                    out.put(int(codes[group][channel][s]), int(lengths[group][channel][s]))
            if n_extra:
                out.put(extra, n_extra)


def encode(pixels: np.ndarray, *, predictor: np.ndarray | None = None, cross_colour: np.ndarray | None = None, subtract_green: bool = False, palette: bool = False, block: int = 2, cache_bits: int = 0, references: bool = True, groups: np.ndarray | None = None) -> bytes:
    """A lossless image of pixels (height, width) with the given transforms.

    predictor: the mode, and cross_colour: the packed multipliers, of each block of 2**block pixels squared.
    """
    height, width = pixels.shape
    out, wide = _header(width, height, bool(np.any(pixels >> np.uint32(24) != 255))), width
    now = pixels.astype(np.uint32)
    if palette:
        colours = np.unique(now)
        if len(colours) > 256:
            raise ValueError("too many colours for a palette")
        for value, n in ((1, 1), (PALETTE, 2), (len(colours) - 1, 8)):
            out.put(value, n)
        steps = _join(*(np.diff(c, prepend=0) for c in _split(colours)))
        _entropy(out, steps[None, :], references=False)
        index = np.searchsorted(colours, now)
        packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        if packed:
            index = np.pad(index, ((0, 0), (0, -wide % (1 << packed)))).reshape(height, -1, 1 << packed)
            index = (index << (np.arange(1 << packed) * (8 >> packed))).sum(2)
        now, wide = index.astype(np.uint32) << np.uint32(8) | np.uint32(BLACK), index.shape[1]
    if subtract_green:
        out.put(1, 1)
        out.put(SUBTRACT_GREEN, 2)
        now = _add_green(now, 0, None, wide, -1)
    if cross_colour is not None:
        for value, n in ((1, 1), (CROSS_COLOUR, 2), (block - 2, 3)):
            out.put(value, n)
        _entropy(out, cross_colour, references=False)
        now = _uncross(now, block, cross_colour, wide, -1)
    if predictor is not None:
        for value, n in ((1, 1), (PREDICTOR, 2), (block - 2, 3)):
            out.put(value, n)
        _entropy(out, predictor.astype(np.uint32) << np.uint32(8), references=False)
        flat, modes = now.ravel().tolist(), predictor.tolist()
        guess = np.array([_predictions(r, c, wide, flat, modes, block) for r in range(height) for c in range(wide)], np.uint32).reshape(now.shape)
        now = _join(*(x - y for x, y in zip(_split(now), _split(guess), strict=True)))
    out.put(0, 1)
    _entropy(out, now, cache_bits, references, True, groups, block)
    return _container([out.columns()])


# Bytes as images of one channel

#: Bytes that a back-reference has at least, and pixels that it goes back at most.
MATCH, FARTHEST = 8, (1 << 20) - 128


def _repeats(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and distances of back-references, in order: each takes the latest place of its first MATCH bytes.

    Where that place is equally far back for one byte after another, the reference goes on.
    """
    n = len(data) - MATCH + 1
    if n < 2:
        return (np.zeros(0, np.int64),) * 3
    key = data[:n].astype(np.uint64)
    for k in range(1, MATCH):
        key |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = np.flatnonzero(ordered[1:] == ordered[:-1])
    back = np.zeros(n, np.int64)
    back[order[same + 1]] = order[same + 1] - order[same]
    back[back > FARTHEST] = 0
    first = np.flatnonzero((back > 0) & (np.diff(back, prepend=0) != 0))
    change = np.append(np.flatnonzero(np.diff(back)) + 1, n)
    last = change[np.searchsorted(change, first, "right")]
    out, at = [], 0
    for a, b, d in zip(first.tolist(), last.tolist(), back[first].tolist(), strict=True):
        a, end = max(a, at), b + MATCH - 1
        if a < b:
            out += [(k, min(4096, end - k), d) for k in range(a, end, 4096)]
            at = end
    return tuple(np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


@lru_cache(maxsize=4)
def _near_codes(width: int) -> np.ndarray:
    """The smallest distance code for so many pixels back, 0 where there is none."""
    out, codes = np.zeros(9 * width, np.int64), _near_by(width)
    out[codes[:0:-1]] = np.arange(len(NEAR), 0, -1)
    return out


def _amount_codes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """amount_code of many values."""
    v = np.maximum(values - 1, 1)
    high = np.frexp(v.astype(np.float64))[1] - 1
    extra = np.where(values > 4, high - 1, 0)
    return np.where(values > 4, 2 * high + (v >> np.maximum(high - 1, 0) & 1), values - 1), v & ((1 << extra) - 1), extra


def encode_bytes(data: np.ndarray, width: int = 64) -> bytes:
    """One image whose green channel is data, in rows of `width`. Equal data give equal images.

    At every size: at most 16 different values become a palette, with several values to a pixel; else runs that occurred
    before are back-references, and prefix codes follow the data. Other transforms and the colour cache save nothing
    where two channels are empty and neighbours don't predict.
    """
    height = len(data) // width
    if np.count_nonzero(np.bincount(data, minlength=256)) <= 16:
        return encode((data.astype(np.uint32) << np.uint32(8) | np.uint32(BLACK)).reshape(height, width), palette=True)
    begins, size, back = _repeats(data)
    literal = np.ones(len(data), bool)
    covered = np.arange(int(size.sum())) + np.repeat(begins - (np.cumsum(size) - size), size)
    literal[covered] = False
    literal[begins] = True  # stands for the whole reference
    token = np.flatnonzero(literal)
    ref = np.searchsorted(token, begins)
    near = _near_codes(width)
    found = near[np.minimum(back, len(near) - 1)] * (back < len(near))
    length_code, length_extra, length_bits = _amount_codes(size)
    distance_code, distance_extra, distance_bits = _amount_codes(np.where(found > 0, found, back + 120))
    symbol = data[token].astype(np.int64)
    symbol[ref] = 256 + length_code
    lengths, far = code_lengths(np.bincount(symbol, minlength=280)), code_lengths(np.bincount(distance_code, minlength=40))
    start = _header(width, height, False)
    for value in (0, 0, 0):  # no transform, no colour cache, one group of codes
        start.put(value, 1)
    start.put_code(lengths)
    for only in (0, 0, 255):  # red, blue, alpha
        one = np.zeros(256, np.int64)
        one[only] = 1
        start.put_code(one)
    start.put_code(far)
    fields = np.ones(len(token), np.int64)
    fields[ref] = 4
    at = np.cumsum(fields) - fields
    values, sizes = np.zeros(int(fields.sum()), np.int64), np.zeros(int(fields.sum()), np.int64)
    values[at], sizes[at] = reversed_codes(lengths)[symbol], lengths[symbol]
    distance_size = far[distance_code] if np.count_nonzero(far) > 1 else np.zeros(len(ref), np.int64)
    more = ((length_extra, length_bits), (reversed_codes(far)[distance_code] * (distance_size > 0), distance_size), (distance_extra, distance_bits))
    for k, (v, n) in enumerate(more, 1):
        values[at[ref] + k], sizes[at[ref] + k] = v, n
    return _container([start.columns(), (values, sizes)])


def green(pixels: np.ndarray) -> np.ndarray:
    return (pixels >> np.uint32(8)).astype(np.uint8).ravel()


def images(data: bytes):
    """The images of several containers, one after another."""
    at = 0
    while at < len(data):
        (size,) = struct.unpack_from("<I", data, at + 4)
        yield data[at : at + 8 + size]
        at += 8 + size


