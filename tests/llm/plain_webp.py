"""A reader of lossless WebP that follows the format's text step by step, a bit and a pixel at a time."""

from __future__ import annotations

from itertools import product


def distances():
    """The 120 near distances, as columns to the left and rows up, by how far they are."""
    near = [(x, y) for x, y in product(range(-7, 9), range(8)) if y > 0 or x > 0]
    return sorted(near, key=lambda p: (p[0] * p[0] + p[1] * p[1], abs(p[0]), p[0] < 0))


class Reader:
    def __init__(self, data):
        self.bits = [b >> i & 1 for b in data for i in range(8)]
        self.at = 0

    def n(self, k):
        out = sum(self.bits[self.at + i] << i for i in range(k))
        self.at += k
        return out

    def code(self, alphabet):
        lengths = {}
        if self.n(1):
            two = self.n(1)
            lengths[self.n(8 if self.n(1) else 1)] = 1
            if two:
                lengths[self.n(8)] = 1
        else:
            order = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
            own = {}
            for k in range(4 + self.n(4)):
                own[order[k]] = self.n(3)
            inner = table(own)
            most = 2 + self.n(2 + 2 * self.n(3)) if self.n(1) else alphabet
            at, before = 0, 8
            while at < alphabet and most > 0:
                most -= 1
                s = self.symbol(inner)
                if s < 16:
                    lengths[at] = s
                    before = s if s else before
                    at += 1
                elif s == 16:
                    for _ in range(3 + self.n(2)):
                        lengths[at] = before
                        at += 1
                else:
                    at += 3 + self.n(3) if s == 17 else 11 + self.n(7)
        return table(lengths)

    def symbol(self, codes):
        if len(codes) == 1:
            return next(iter(codes.values()))
        word = ""
        while word not in codes:
            word += str(self.bits[self.at])
            self.at += 1
        return codes[word]

    def amount(self, prefix):
        if prefix < 4:
            return prefix + 1
        extra = (prefix - 2) // 2
        return (2 + prefix % 2) * 2**extra + self.n(extra) + 1


def table(lengths):
    out, code, before = {}, 0, 0
    for length, s in sorted((n, s) for s, n in lengths.items() if n):
        code <<= length - before
        out[f"{code:0{length}b}"] = s
        code, before = code + 1, length
    return out


def pixels(r, width, height, main):
    cache = [0] * 2 ** r.n(4) if r.n(1) else []
    groups, block = [0], None
    if main and r.n(1):
        block = r.n(3) + 2
        across = -(-width // 2**block)
        groups = [p >> 8 & 0xFFFF for p in pixels(r, across, -(-height // 2**block), False)]
    codes = [[r.code(280 + len(cache)), r.code(256), r.code(256), r.code(256), r.code(40)] for _ in range(max(groups) + 1)]
    out = []
    key = lambda p: (0x1E35A7BD * p % 2**32) >> (33 - len(cache).bit_length())

    def put(p):
        out.append(p)
        if cache:
            cache[key(p)] = p

    while len(out) < width * height:
        x, y = len(out) % width, len(out) // width
        own = codes[groups[(y >> block) * across + (x >> block)] if block else 0]
        s = r.symbol(own[0])
        if s < 256:
            red, blue, alpha = r.symbol(own[1]), r.symbol(own[2]), r.symbol(own[3])
            put(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            length = r.amount(s - 256)
            far = r.amount(r.symbol(own[4]))
            if far <= 120:
                dx, dy = distances()[far - 1]
                far = max(1, dx + dy * width)
            else:
                far -= 120
            for _ in range(length):
                put(out[-far])
        else:
            put(cache[s - 280])
    return out


def parts(p):
    return [p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255]


def whole(c):
    return c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3]


def mean(p, q):
    return whole([(a + b) // 2 for a, b in zip(parts(p), parts(q), strict=True)])


def guess(mode, left, top, right, corner):
    limit = lambda v: min(255, max(0, v))
    if mode == 11:
        along = [a + b - c for a, b, c in zip(parts(left), parts(top), parts(corner), strict=True)]
        to = lambda p: sum(abs(a - b) for a, b in zip(along, parts(p), strict=True))
        return left if to(left) < to(top) else top
    if mode == 12:
        return whole([limit(a + b - c) for a, b, c in zip(parts(left), parts(top), parts(corner), strict=True)])
    if mode == 13:
        half = parts(mean(left, top))
        toward_zero = lambda v: -(-v // 2) if v < 0 else v // 2
        return whole([limit(a + toward_zero(a - c)) for a, c in zip(half, parts(corner), strict=True)])
    plain = {
        0: 0xFF000000, 1: left, 2: top, 3: right, 4: corner, 5: mean(mean(left, right), top), 6: mean(left, corner), 7: mean(left, top), 8: mean(corner, top), 9: mean(top, right),
        10: mean(mean(left, corner), mean(top, right)),
    }
    return plain[mode]


def add(p, q):
    return whole([(a + b) % 256 for a, b in zip(parts(p), parts(q), strict=True)])


def small(v):
    return v - 256 if v > 127 else v


def read(data):
    """Width, height and pixels, row after row."""
    r = Reader(data[20:])
    assert data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8L" and r.n(8) == 0x2F
    width, height = r.n(14) + 1, r.n(14) + 1
    alpha = r.n(1)
    assert r.n(3) == 0
    done, across = [], width
    while r.n(1):
        kind = r.n(2)
        if kind < 2:
            block = r.n(3) + 2
            wide = -(-across // 2**block)
            done.append((kind, across, block, wide, pixels(r, wide, -(-height // 2**block), False)))
        elif kind == 2:
            done.append((kind, across, 0, 0, []))
        else:
            colours = pixels(r, r.n(8) + 1, 1, False)
            for k in range(1, len(colours)):
                colours[k] = add(colours[k], colours[k - 1])
            bundle = 8 if len(colours) <= 2 else 4 if len(colours) <= 4 else 2 if len(colours) <= 16 else 1
            done.append((kind, across, bundle, 0, colours))
            across = -(-across // bundle)
    out = pixels(r, across, height, True)
    for kind, wide, block, blocks, image in reversed(done):
        new = []
        for n in range(wide * height):
            x, y = n % wide, n // wide
            if kind == 0:
                if n == 0:
                    g = 0xFF000000
                elif y == 0:
                    g = new[n - 1]
                elif x == 0:
                    g = new[n - wide]
                else:
                    g = guess(image[(y >> block) * blocks + (x >> block)] >> 8 & 15, new[n - 1], new[n - wide], new[n - wide + 1], new[n - wide - 1])
                new.append(add(out[n], g))
            elif kind == 1:
                _, red_blue, green_blue, green_red = map(small, parts(image[(y >> block) * blocks + (x >> block)]))
                a, red, green, blue = parts(out[n])
                red = (red + (green_red * small(green) >> 5)) % 256
                blue = (blue + (green_blue * small(green) >> 5) + (red_blue * small(red) >> 5)) % 256
                new.append(whole([a, red, green, blue]))
            elif kind == 2:
                a, red, green, blue = parts(out[n])
                new.append(whole([a, (red + green) % 256, green, (blue + green) % 256]))
            else:
                held = out[y * -(-wide // block) + x // block] >> 8 & 255
                at = held >> (x % block * (8 // block)) & (2 ** (8 // block) - 1)
                new.append(image[at] if at < len(image) else 0)
        out = new
    return width, height, out if alpha else [p | 0xFF000000 for p in out]
