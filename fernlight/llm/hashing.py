"""Words and runs of words as 64-bit hashes, and fixed-size bitmaps that narrow what a pass over the texts emits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap: EACH for a key, from a megabyte to 64, whatever the input. A fuller bitmap lets more rows pass, all of
#: which are then joined or looked at exactly.
EACH, LEAST, MOST = 16, 1 << 23, 1 << 29
_BLOCK = 4096  # bytes of a block of Spark's bitmap functions
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


#: A random number for each byte, and the same with A-Z as a-z.
_BYTES = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
_FOLDED = _BYTES.copy()
_FOLDED[0x41:0x5B] = _BYTES[0x61:0x7B]
_BASE = 0x2545F4914F6CDD1B  # 3 modulo 8, so that its powers differ in as many bits as they can


def mix(h: np.ndarray) -> np.ndarray:
    out = h >> np.uint64(32)
    out ^= h
    out *= _A
    out ^= out >> np.uint64(29)
    out *= _B
    return out


class Powers:
    """Powers of a number modulo 2**64; as many are kept as were last asked for, up to KEPT."""

    KEPT = 1 << 20

    def __init__(self, of: int):
        self.of, self.held = np.uint64(of), np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if n <= len(self.held):
            return self.held[:n]
        out = np.full(n, self.of)
        out[0] = 1
        out = np.cumprod(out)
        if n <= self.KEPT:
            self.held = out
        return out


_PLACES, _BACK = Powers(_BASE), Powers(pow(_BASE, -1, 1 << 64))


def hashed_words(texts: list[bytes], fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (between ASCII white space), and where each text's begin and the last one's end.

    A word's hash is a polynomial of its bytes' random numbers: all words are hashed at once, from the sums of one
    polynomial over all bytes.
    """
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    inner = (data - np.uint8(0x09) > 4) & (data != 0x20)
    edges = np.flatnonzero(inner[1:] != inner[:-1]) + 1
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    at = np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in texts)]))
    if not len(starts):
        return np.zeros(0, np.uint64), at
    sums = (_FOLDED if fold else _BYTES)[data]
    sums *= _PLACES(len(data))
    np.cumsum(sums, out=sums)
    h = (sums[edges[1::2] - 1] - sums[starts - 1]) * _BACK(len(data))[starts]  # a space comes before the first word
    return mix(h + lengths.astype(np.uint64) * _B), at


def shingle_sets(texts: list[bytes], size: int, fold: bool = False) -> list[np.ndarray]:
    """Of each text the distinct hashes of all runs of `size` words, sorted; of fewer words, the whole sequence as one; of
    none, none."""
    h, at = hashed_words(texts, fold)
    n = max(0, len(h) - size + 1)
    runs = h[:n].copy()
    for k in range(1, size):
        runs = mix(runs) + h[k : k + n]
    runs, out = mix(runs), []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        else:
            whole = np.array([b - a], np.uint64)
            for k in range(a, b):
                whole = mix(whole + h[k : k + 1])
            out.append(whole if b > a else h[:0])
    return out


def bitmap(keys: DataFrame, key: str) -> bytes:
    """Which hashes occur in a column of longs. Spark merges the bitmap's blocks; only the map, of at most MOST bits, is
    collected. keys are read twice, so they should be a written table."""
    size = 1 << min(MOST.bit_length() - 1, max(LEAST.bit_length() - 1, (EACH * keys.count()).bit_length()))
    place = F.pmod(F.col(key), F.lit(size)) + 1  # Spark counts bits and blocks from 1
    blocks = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    out = bytearray(size // 8)
    for b, m in blocks.collect():
        out[(b - 1) * _BLOCK : (b - 1) * _BLOCK + len(m)] = m
    return bytes(out)


def in_bitmap(found: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether signed 64-bit keys may be in a bitmap (its bytes as an array)."""
    place = keys.astype(np.int64) & (8 * len(found) - 1)
    return found[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1
