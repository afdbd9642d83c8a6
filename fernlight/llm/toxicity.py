"""A linear-chain conditional random field that tags toxic words.

The tables label documents, not tokens, so the tokens of the fitting sample are labelled from their documents: a word is
toxic if its document is labelled toxic and the word, or one of its beginnings, keeps almost wholly to such documents,
more than chance allows. The field has two tags; a word's inputs are hashes of itself, its beginnings and end, and its
neighbours. Forward-backward gives the marginals of words and of pairs of tags, from which the likelihood's gradient
follows; a logistic function of a document's marginals is its score, and runs of likely words its spans.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import id_and_text, id_fold, rows_of, slices, staged
from .labelled import SAMPLE, sample

BUCKETS = 1 << 18
STEMS = (4, 5, 6, 7, 8)
WINDOW, BATCH, EPOCHS, RATE, DECAY = 24, 256, 6, 0.3, 1e-5
#: A marker keeps to toxic documents at this share at least, with a log-likelihood ratio beyond this bound.
PURE, RATIO = 0.85, 30.0
WORDS = 200_000
#: Documents whose chains are walked side by side.
SIDE_BY_SIDE = 1024
_WORD = re.compile(r"[^\W_]+")
_OWN, _BEFORE, _AFTER = range(3)


def words(text: str) -> list[str]:
    return list(map(str.lower, _WORD.findall(text)))


def stems(word: str) -> list[str]:
    """The word and its beginnings, as they are looked up and hashed."""
    return [word, *(f"{word[:n]}-" for n in STEMS if len(word) > n)]


def features(word: str) -> tuple[list[int], list[int], list[int]]:
    """Buckets of a word's inputs to its own tag, to the tag after it and to the tag before it."""
    own = [zlib.crc32(f"w {s}".encode()) % BUCKETS for s in stems(word)]
    own.append(zlib.crc32(f"e {word[-3:]}".encode()) % BUCKETS)
    return own, [zlib.crc32(f"b {word}".encode()) % BUCKETS], [zlib.crc32(f"a {word}".encode()) % BUCKETS]


def telling(a: float, b: float, share: float) -> bool:
    """Whether what lies in a toxic and b other documents keeps to toxic ones, whose share is given, beyond chance."""
    if a < PURE * (a + b) or not 0 < share < 1:
        return False
    p = a / (a + b)
    return p > share and 2 * (a * np.log(p / share) + (b * np.log((1 - p) / (1 - share)) if b else 0.0)) > RATIO


def markers(counted: Iterable[tuple[str, float, float]], share: float) -> set[str]:
    """Words and beginnings that keep to toxic documents. counted: each with its numbers of toxic and other documents."""
    return {s for s, a, b in counted if telling(a, b, share)}


def _occurrences(texts: list[list[str]], toxic: Iterable[float]) -> tuple[Counter, Counter]:
    """In how many toxic documents, and in how many others, words and beginnings occur."""
    with_it, without = Counter(), Counter()
    for found, label in zip(texts, toxic, strict=True):
        (with_it if label else without).update({s for w in set(found) for s in stems(w)})
    return with_it, without


@dataclass
class Field:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    bias: float = 0.0
    #: Scores of a tag after a tag: rows before, columns after; 0 clean, 1 toxic.
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    #: Of a document's evidence: intercept first.
    logistic: np.ndarray = field(default_factory=lambda: np.array([0.0, 0, 0, 0]))


def forward_backward(emission: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odds of toxic against clean of every token: by what comes before it and itself, by what comes after it; and e.

    emission: log-odds of each token, chains one after another.
    """
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths = lengths[order]
    starts = (np.cumsum(lengths) - lengths)[order]
    e = np.exp(np.clip(emission, -30, 30))
    t = np.exp(transitions)
    forward, backward = np.empty(len(e)), np.ones(len(e))
    longest = int(sorted_lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-sorted_lengths, -np.arange(longest), side="left")  # chains longer than each step
    odds = np.zeros(0)
    for k in range(longest):
        at = starts[: active[k]] + k
        odds = e[at] if k == 0 else e[at] * (t[0, 1] + odds[: active[k]] * t[1, 1]) / (t[0, 0] + odds[: active[k]] * t[1, 0])
        forward[at] = odds
    for k in range(longest - 1, 0, -1):
        at = starts[: active[k]] + k
        x = e[at] * backward[at]
        backward[at - 1] = (t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x)
    return forward, backward, e


def marginals(emission: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """P(toxic) of every token. emission: log-odds of each token, chains one after another."""
    forward, backward, _ = forward_backward(emission, lengths, transitions)
    odds = forward * backward
    return odds / (1 + odds)


def pair_marginals(forward: np.ndarray, backward: np.ndarray, e: np.ndarray, after: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """P(tag before, tag) of each token in `after`, none of which begins a chain: (n, 2, 2)."""
    before, x = forward[after - 1], e[after] * backward[after]
    out = np.empty((len(after), 2, 2))
    out[:, 0, 0], out[:, 0, 1], out[:, 1, 0], out[:, 1, 1] = 1, x, before, before * x
    out *= np.exp(transitions)
    return out / out.sum((1, 2), keepdims=True)


def evidence(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each document: 1, log-odds of its likeliest token, and logarithms of the expected number and share of toxic tokens."""
    out = np.zeros((len(lengths), 4))
    out[:, 0] = 1
    doc = np.repeat(np.arange(len(lengths)), lengths)
    total = np.bincount(doc, p, len(lengths))
    top = np.full(len(lengths), 1e-6)
    some = lengths > 0
    if some.any():
        top[some] = np.maximum.reduceat(p, (np.cumsum(lengths) - lengths)[some])
    top = np.clip(top, 1e-6, 1 - 1e-6)
    out[:, 1] = np.log(top / (1 - top)) / 4
    out[:, 2] = np.log1p(total)
    out[:, 3] = np.log1p(100 * total / np.maximum(lengths, 1))
    return out


class Tagger:
    """Tags texts; keeps the weights of words."""

    def __init__(self, crf: Field):
        self.crf = crf
        self.reset()

    def reset(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, 3))

    def tag(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.at) > WORDS:
            self.reset()
        at, found, fresh = self.at, [], []
        for text in texts:
            for w in text:
                i = at.get(w)
                if i is None:
                    i = at[w] = len(at)
                    fresh.append(w)
                found.append(i)
        if fresh:
            w = self.crf.weights
            self.rows = np.concatenate([self.rows, [[sum(w[b] for b in part) for part in features(x)] for x in fresh]])
        lengths = np.array([len(t) for t in texts], np.int64)
        if not len(found):
            return np.zeros(0), lengths
        taken = self.rows[np.array(found)]
        score = taken[:, _OWN] + self.crf.bias
        inner = np.ones(len(found), bool)
        inner[(np.cumsum(lengths) - lengths)[lengths > 0]] = False  # first tokens have none before them
        score[inner] += taken[np.flatnonzero(inner) - 1, _BEFORE]
        score[np.flatnonzero(inner) - 1] += taken[inner, _AFTER]
        return marginals(score, lengths, self.crf.transitions), lengths

    def scores(self, p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence(p, lengths) @ self.crf.logistic, -30, 30)))


def windows_of(found: list[str], label: float, marks: set[str]) -> list[tuple[list[str], np.ndarray]]:
    """A document's words in windows, with their tags: around a few toxic words, and one anywhere; short documents whole.

    The tags are the labels of tokens: toxic is what holds a marker in a document labelled toxic.
    """
    if not found:
        return []
    mark = np.array([bool(label) and any(s in marks for s in stems(w)) for w in found], np.float64)
    if len(found) <= WINDOW:
        return [(found, mark)]
    hits = np.flatnonzero(mark)
    centres = {int(hits[int(k)]) for k in np.linspace(0, len(hits) - 1, min(4, len(hits)))} if len(hits) else set()
    out = []
    for c in [*sorted(centres), zlib.crc32(" ".join(found).encode()) % len(found)]:
        a = max(0, min(c - WINDOW // 2, len(found) - WINDOW))
        out.append((found[a : a + WINDOW], mark[a : a + WINDOW]))
    return out


def places(windows: list[list[str]], cache: dict[str, tuple[list[int], list[int], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that are inputs, and the tokens (counted through all windows) whose inputs they are."""
    at, token, start = [], [], 0
    for window in windows:
        for k, w in enumerate(window):
            if w not in cache:
                cache[w] = features(w)
            own, before, after = cache[w]
            at += own
            token += [start + k] * len(own)
            if k + 1 < len(window):
                at += before
                token.append(start + k + 1)
            if k:
                at += after
                token.append(start + k - 1)
        start += len(window)
    return np.array(at, np.int64), np.array(token, np.int64)


def gradient(crf: Field, at: np.ndarray, token: np.ndarray, lengths: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Of the negative log-likelihood of the tags: buckets, the weights' derivatives there, the bias's, the transitions'.

    Expected inputs come from the tokens' marginals, expected transitions from the marginals of pairs.
    """
    score = np.bincount(token, crf.weights[at], lengths.sum()) + crf.bias
    forward, backward, e = forward_backward(score, lengths, crf.transitions)
    odds = forward * backward
    error = odds / (1 + odds) - gold
    own, where = np.unique(at, return_inverse=True)
    inner = np.ones(len(gold), bool)
    inner[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
    after = np.flatnonzero(inner)
    pairs = pair_marginals(forward, backward, e, after, crf.transitions).sum(0) if len(after) else np.zeros((2, 2))
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[after - 1].astype(int), gold[after].astype(int)), 1)
    return own, np.bincount(where, error[token], len(own)), float(error.sum()), pairs - seen


def fit_windows(windows: list[tuple[list[str], np.ndarray]], seed: int = 11) -> Field:
    """The field's weights by Adagrad; its logistic function is still to be fitted."""
    crf, rng = Field(), np.random.default_rng(seed)
    cache: dict[str, tuple[list[int], list[int], list[int]]] = {}
    squares, trans_sq = np.full(BUCKETS, 1e-2), np.full((2, 2), 1e-2)
    for _ in range(EPOCHS if windows else 0):
        for part in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // BATCH)):
            lengths = np.array([len(windows[i][0]) for i in part])
            gold = np.concatenate([windows[i][1] for i in part])
            own, g, g_bias, g_pairs = gradient(crf, *places([windows[i][0] for i in part], cache), lengths, gold)
            g += DECAY * crf.weights[own]
            squares[own] += g * g
            crf.weights[own] -= RATE * g / np.sqrt(squares[own])
            crf.bias -= RATE * g_bias / len(gold)
            g = g_pairs / max(1, len(gold) - len(part)) + 1e-3 * crf.transitions
            trans_sq += g * g
            crf.transitions -= 0.1 * g / np.sqrt(trans_sq)
    return crf


def _prior(share: float) -> np.ndarray:
    """The logistic function of a field that knows no toxic word, and tags none: the share of toxic documents."""
    p = float(np.clip(share, 1e-3, 1 - 1e-3))
    return np.array([np.log(p / (1 - p)), 0, 0, 0])


def fit(texts: list[list[str]], toxic: np.ndarray, seed: int = 11) -> Field:
    """What train() does, of documents in memory. texts: words of each. The same inputs give the same field."""
    share = float(toxic.mean()) if len(toxic) else 0.5
    with_it, without = _occurrences(texts, toxic)
    marks = markers(((s, a, without[s]) for s, a in with_it.items()), share)
    if not marks:
        return Field(bias=-30.0, logistic=_prior(share))
    crf = fit_windows([w for found, label in zip(texts, toxic, strict=True) for w in windows_of(found, label, marks)], seed)
    tagger = Tagger(crf)
    x = np.concatenate([evidence(*tagger.tag(texts[i : i + SIDE_BY_SIDE])) for i in range(0, len(texts), SIDE_BY_SIDE)])
    crf.logistic = logistic(x, toxic)
    return crf


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method; the intercept is not shrunk."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", label: str = "toxic", folds: int = 4, held_out: int = 2, most: int = SAMPLE) -> Field:
    """A field fitted on at most `most` labelled documents outside the held-out fold.

    Without labels, or with labels of one kind alone, no word is known as toxic and every text scores the share of toxic
    documents (one half without labels). Whole texts stay on the executors: the driver gets markers, at most five windows
    of a document, and its evidence.
    """
    rows = staged(sample(docs, labels, label, id_col=id_col, text_col=text_col, folds=folds, held_out=held_out, most=most).select("id", "text", "label"), "labelled")
    n, share = rows.agg(F.count(F.lit(1)), F.avg("label")).first()
    share = 0.5 if not n else float(share)
    counts = pa.schema([("stem", pa.string()), ("a", pa.int64()), ("b", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SIDE_BY_SIDE):
            a, b = _occurrences([words(t) for t in batch.column("text").to_pylist()], batch.column("label").to_pylist())
            found = list(a | b)
            yield rows_of({"stem": found, "a": [a[s] for s in found], "b": [b[s] for s in found]}, counts)

    counted = rows.mapInArrow(count, "stem string, a long, b long").groupBy("stem").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    marks = markers((tuple(r) for r in counted.where(F.col("a") >= PURE * (F.col("a") + F.col("b"))).toLocalIterator()), share)
    if not marks:
        return Field(bias=-30.0, logistic=_prior(share))
    spoken = docs.sparkSession.sparkContext.broadcast(marks)
    cut = pa.schema([("id", pa.int64()), ("words", pa.list_(pa.string())), ("tags", pa.list_(pa.float64()))])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [(i, *w) for i, t, y in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "label")), strict=True) for w in windows_of(words(t), y, spoken.value)]
            yield rows_of({"id": [r[0] for r in out], "words": [r[1] for r in out], "tags": [r[2] for r in out]}, cut)

    held = sorted(map(tuple, rows.mapInArrow(windows, "id long, words array<string>, tags array<double>").collect()))
    crf = fit_windows([(w, np.array(tags)) for _, w, tags in held])
    fitted = docs.sparkSession.sparkContext.broadcast(crf)
    evident = pa.schema([("id", pa.int64()), ("label", pa.float64()), ("x", pa.list_(pa.float64()))])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(fitted.value)
        for batch in slices(batches, SIDE_BY_SIDE):
            x = evidence(*tagger.tag([words(t) for t in batch.column("text").to_pylist()]))
            yield rows_of({"id": batch.column("id").to_pylist(), "label": [float(y) for y in batch.column("label").to_pylist()], "x": x.tolist()}, evident)

    known = sorted(map(tuple, rows.mapInArrow(gather, "id long, label double, x array<double>").collect()))
    crf.logistic = logistic(np.array([x for _, _, x in known]), np.array([y for _, y, _ in known]))
    return crf


_SPANS = "array<struct<start:long,end:long,probability:double>>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])


def runs(text: str, p: np.ndarray, threshold: float) -> list[dict]:
    """Runs of words whose marginals p reach the threshold, as offsets with the run's largest marginal."""
    hits = np.flatnonzero(p >= threshold)
    if not len(hits):
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [{"start": at[r[0]][0], "end": at[r[-1]][1], "probability": float(p[r].max())} for r in np.split(hits, np.flatnonzero(np.diff(hits) > 1) + 1)]


def score(docs: DataFrame, crf: Field, *, text_col: str = "text", id_col: str = "doc_id", folds: int = 4, held_out: int = 2, threshold: float = 0.3, tagged: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, spans of every row; only the text is looked at.

    spans are (start, end, probability) of runs of words whose marginal reaches `tagged`; offsets count code points, end
    exclusive. A null text counts as empty and gets the score of a text without words, and no spans. Null ids aren't held
    out; equal texts get equal scores; an empty table gives no rows. Texts are tagged whole.
    """
    held = docs.sparkSession.sparkContext.broadcast(crf)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("spans", pa.list_(_SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(held.value)
        for batch in slices(batches, SIDE_BY_SIDE):
            texts = batch.column("text").to_pylist()
            p, lengths = tagger.tag([words(t) for t in texts])
            s = tagger.scores(p, lengths)
            spans = [runs(t, own, tagged) for t, own in zip(texts, np.split(p, np.cumsum(lengths)[:-1]), strict=True)]
            yield rows_of({"doc_id": batch.column("id").to_pylist(), "held_out": batch.column("held_out").to_pylist(), "score": s, "predicted": (s >= threshold).astype(np.int32), "spans": spans}, schema)

    fold = F.coalesce(id_fold(id_col, folds) == held_out, F.lit(False)).alias("held_out")
    return id_and_text(docs, id_col, text_col, fold).mapInArrow(run, f"doc_id long, held_out boolean, score double, predicted int, spans {_SPANS}")
