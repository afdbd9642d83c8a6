"""A factorisation machine for text quality.

Inputs are hashed words, statistics of a text's structure, and its metadata (lengths, and the share of distinct words and
lines). Pairwise interactions have rank `RANK`; the sum-of-squares identity scores them in time linear in the number of
inputs: half of the squared sum less the sum of squares, for each factor.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import id_and_text, id_fold, rows_of, slices
from .labelled import SAMPLE, sample

BUCKETS, RANK = 1 << 15, 8
EPOCHS, BATCH, RATE, DECAY = 8, 128, 0.02, 1e-4
WORDS = 300_000
_WORD = re.compile(r"[^\W_]+")
# Classes of characters: 0 lower-case and other letters, 1 upper case, 2 digits, 3 blanks, 4 line ends, 5 sentence
# punctuation, 6 other marks.
_CLASS = np.zeros(0x250, np.uint8)
for _c in range(0x250):
    _s = chr(_c)
    _CLASS[_c] = 4 if _s in "\n\r" else 3 if _s.isspace() else 1 if _s.isupper() else 0 if _s.isalpha() else 2 if _s.isdigit() else 5 if _s in ".,;:!?'\"-()" else 6
STATISTICS = 18


def statistics(text: str, found: list[str]) -> list[float]:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = max(1, len(codes))
    classes = _CLASS[np.minimum(codes, 0x24F)]
    share = np.bincount(classes, minlength=7) / n
    turns = np.count_nonzero(classes[1:] != classes[:-1]) / n
    same = np.count_nonzero(codes[1:] == codes[:-1]) / n
    lines = text.split("\n")
    chunks = text.split()
    k, c = max(1, len(found)), max(1, len(chunks))
    length = sum(map(len, found))
    return [
        *share.tolist(), turns, same, np.log1p(n), np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(c / len(lines)),
        len(set(found)) / k, length / k, sum(1 for x in chunks if len(x) == 1 and not x.isalnum()) / c, sum(map(str.isupper, chunks)) / c,
        sum(map(str.__eq__, chunks, chunks[1:])) / c,
    ]


class Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS:
            self.clear()
        found = self[word] = zlib.crc32(word.encode()) % BUCKETS
        return found


_BUCKETS = Buckets()


def inputs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts as document, bucket and value (of length 1 for each document), and the statistics."""
    docs, at, stats = [], [], []
    for i, text in enumerate(texts):
        found = _WORD.findall(text)
        stats.append(statistics(text, found))
        bucket = list(map(_BUCKETS.__getitem__, map(str.lower, found)))
        at += bucket
        docs.append(len(bucket))
    key, n = np.unique(np.repeat(np.arange(len(texts)), docs) * BUCKETS + np.array(at, np.int64), return_counts=True)
    doc, bucket, value = key // BUCKETS, key % BUCKETS, np.log1p(n)
    norm = np.sqrt(np.bincount(doc, value**2, len(texts)))
    return doc, bucket, value / norm[doc], np.array(stats).reshape(len(texts), STATISTICS)


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def sums(self, doc: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores before the logistic function, the sum of each factor, and the scaled statistics."""
        z = np.clip((stats - self.mean) / self.scale, -4, 4) / np.sqrt(STATISTICS)
        n, w, v = len(stats), self.weights, self.factors
        linear = self.bias + np.bincount(doc, w[bucket] * value, n) + z @ w[BUCKETS:]
        total, squares = z @ v[BUCKETS:], (z**2) @ (v[BUCKETS:] ** 2)
        for f in range(v.shape[1]):
            x = v[bucket, f] * value
            total[:, f] += np.bincount(doc, x, n)
            squares[:, f] += np.bincount(doc, x * x, n)
        return linear + 0.5 * (total**2 - squares).sum(1), total, z

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.sums(*inputs(texts))[0], -30, 30)))


def fit(doc: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray, label: np.ndarray, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss; the same inputs give the same machine."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + STATISTICS
    rate = np.clip(label.mean() if len(label) else 0.5, 1e-3, 1 - 1e-3)
    mean = stats.mean(0) if len(stats) else np.zeros(STATISTICS)
    m = Machine(float(np.log(rate / (1 - rate))), np.zeros(size), rng.normal(0, 0.05, (size, RANK)), mean, (stats.std(0) if len(stats) else np.ones(STATISTICS)) + 1e-6)
    if not 0 < label.sum() < len(label):
        m.factors[:] = 0
        return m
    gw, gv, gb = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
    ends = np.searchsorted(doc, np.arange(len(label) + 1))
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(label)), max(1, len(label) // BATCH)):
            take = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in part])
            d = np.repeat(np.arange(len(part)), ends[part + 1] - ends[part])
            b, x = bucket[take], value[take]
            score, total, z = m.sums(d, b, x, stats[part])
            error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - label[part]) / len(part)
            own, where = np.unique(b, return_inverse=True)
            e = error[d] * x
            dw = np.bincount(where, e, len(own)) + DECAY * m.weights[own]
            dv = np.stack([np.bincount(where, e * (total[d, f] - m.factors[b, f] * x), len(own)) for f in range(RANK)], 1) + DECAY * m.factors[own]
            tail = slice(BUCKETS, None)
            sw, sv = z.T @ error, z.T @ (error[:, None] * total) - ((z**2).T @ error)[:, None] * m.factors[tail]
            for at, g, s, p in ((own, dw, gw, m.weights), (own, dv, gv, m.factors), (tail, sw, gw, m.weights), (tail, sv, gv, m.factors)):
                s[at] += (g * BATCH) ** 2
                p[at] -= RATE * g * BATCH / np.sqrt(s[at])
            g = float(error.sum()) * BATCH
            gb += g * g
            m.bias -= RATE * g / np.sqrt(gb)
    return m


def train(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", label: str = "quality", folds: int = 3, held_out: int = 1, most: int = SAMPLE) -> Machine:
    """A machine fitted on at most `most` labelled documents outside the held-out fold."""
    schema = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("buckets", pa.list_(pa.int32())), ("values", pa.list_(pa.float32())), ("stats", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            doc, bucket, value, stats = inputs(batch.column("text").to_pylist())
            cut = np.searchsorted(doc, np.arange(1, batch.num_rows))
            yield rows_of({"id": batch.column("id").to_pylist(), "label": batch.column("label").to_pylist(), "buckets": np.split(bucket, cut), "values": np.split(value, cut), "stats": stats.tolist()}, schema)

    taken = sample(docs, labels, label, id_col=id_col, text_col=text_col, folds=folds, held_out=held_out, most=most).select("id", "text", "label")
    rows = taken.mapInArrow(run, "id long, label int, buckets array<int>, values array<float>, stats array<double>").toArrow().sort_by("id")
    count = [len(b) for b in rows.column("buckets")]
    flat = lambda name: rows.column(name).combine_chunks().flatten().to_numpy() if len(rows) else np.zeros(0)
    stats = np.array(rows.column("stats").to_pylist()).reshape(len(rows), STATISTICS)
    return fit(np.repeat(np.arange(len(rows)), count), flat("buckets").astype(np.int64), flat("values").astype(np.float64), stats, rows.column("label").to_numpy().astype(np.float64))


def score(docs: DataFrame, machine: Machine, *, text_col: str = "text", id_col: str = "doc_id", folds: int = 3, held_out: int = 1, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; only the text is looked at.

    A null text counts as empty and gets the score of a text without words. Null ids aren't held out; equal texts get
    equal scores; an empty table gives no rows. Without labels of both kinds every score is the share of ones.
    """
    held = docs.sparkSession.sparkContext.broadcast(machine)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = held.value.scores(batch.column("text").to_pylist())
            yield rows_of({"doc_id": batch.column("id").to_pylist(), "held_out": batch.column("held_out").to_pylist(), "score": s, "predicted": (s >= threshold).astype(np.int32)}, schema)

    fold = F.coalesce(id_fold(id_col, folds) == held_out, F.lit(False)).alias("held_out")
    return id_and_text(docs, id_col, text_col, fold).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
