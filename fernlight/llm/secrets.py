"""Secret scans: fixed patterns, and a character convolutional network over every other long token.

A candidate is what the fixed patterns leave of a maximal run of `[A-Za-z0-9+/_.=-]`, of at least `SHORTEST` characters;
shorter ones are too short for a token of their own and are left to the patterns. The network reads `INSIDE` characters
with the text around the run; longer runs are read whole, in overlapping windows and in their parts between separators,
each as if it stood alone in the run's place. It is trained on labelled findings: values that the fixed patterns find in a
bounded sample of documents are secrets and the other candidates there are not, and findings generated from public token
shapes stand beside them. Its threshold is the highest calibrated probability that keeps a recall of `RECALL` on findings
kept aside.
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import merge
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import id_and_text, rows_of, slices

KINDS = ("assign", "access", "hex", "model")
SHORTEST = 16
#: Documents (about) and candidates (at most) from which findings are labelled.
SAMPLE_DOCS, SAMPLE_RUNS = 20_000, 6_000
BEFORE, INSIDE, AFTER = 16, 40, 8
#: Steps between the windows of a long run.
STEP = 8
WIDTH, FILTERS, KERNEL, CHANNELS = BEFORE + INSIDE + AFTER, 24, 5, 12
RECALL = 0.98
EPOCHS, BATCH, RATE = 6, 128, 0.01
#: Windows that are held at a time, a multiple of what the network reads at once.
HELD = 4096

_LETTERS = {c: f"[{c}{c.upper()}]" for c in string.ascii_lowercase}
_KEY = "".join(_LETTERS.get(c, c) for c in r"password|passwd|secret|token|api_?key")
_ASSIGN = re.compile(rf"""({_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_NAMES = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{SHORTEST},}}")
_PART = re.compile(r"[^/.=]+")
Span = tuple[int, int, int]  # start, kind's number, end


def runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _RUN.finditer(text)]


def base_spans(text: str, found: list[tuple[int, int]]) -> list[Span]:
    """Findings of the fixed patterns, by start and kind. found: the text's candidate runs, which hold all long tokens."""
    out: list[Span] = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    for a, b in found:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text, a, b) if m.end() - m.start() >= 16]
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text, a, b)]
    return sorted(out)


def label(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# The network. Characters fall into CHANNELS classes that keep what tells random tokens from words and paths.
_CLASSES = np.full(128, 11, np.int64)
for _i, _group in enumerate(("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789", "+/", "_-.", "=:", " \t\n\r", "\"'`", ",;()[]{}<>|")):
    for _c in _group:
        _CLASSES[ord(_c)] = _i


def pieces(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """What is read of a candidate, by start: all of it, or of a long one every window and the parts between separators."""
    if b - a <= INSIDE:
        return iter([(a, b)])
    whole = ((c, c + INSIDE) for c in chain(range(a, b - INSIDE, STEP), [b - INSIDE]))
    parts = (m.span() for m in _PART.finditer(text, a, b) if SHORTEST <= m.end() - m.start() <= INSIDE)
    return (piece for piece, _ in groupby(merge(whole, parts)))


def uncovered(a: int, b: int, spans: list[Span]) -> list[tuple[int, int]]:
    """Parts of a candidate of at least `SHORTEST` characters that findings, sorted by start, leave."""
    out = []
    for x, _, y in [*spans, (b, 0, b)]:
        if y > a or x >= b:
            if min(x, b) - a >= SHORTEST:
                out.append((a, min(x, b)))
            a = max(a, y)
    return out


def widened(text: str, a: int, b: int, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pieces of the candidate, out to the separators around them, since a window may cut a token; those that meet as one."""
    ends = [a, *(m for x in _PART.finditer(text, a, b) for m in x.span()), b]
    out: list[tuple[int, int]] = []
    for c, d in sorted(found):
        c, d = ends[bisect_right(ends, c) - 1], ends[bisect_left(ends, d)]
        if out and c <= out[-1][1]:
            out[-1] = (out[-1][0], max(d, out[-1][1]))
        else:
            out.append((c, d))
    return out


def window(text: str, a: int, b: int, piece: tuple[int, int] | None = None) -> str:
    """The piece of the candidate, by default its first characters, with what is around the candidate; blanks where there is nothing."""
    c, d = piece or (a, b)
    return text[max(0, a - BEFORE) : a].rjust(BEFORE) + text[c : min(d, c + INSIDE)].ljust(INSIDE) + text[b : b + AFTER].ljust(AFTER)


def classes(windows: list[str]) -> np.ndarray:
    codes = np.frombuffer("".join(windows).encode("utf-32-le"), np.uint32).reshape(-1, WIDTH)
    return _CLASSES[np.minimum(codes, 127)]


def features(windows: list[str]) -> np.ndarray:
    """Of each candidate's characters: shares of digits, capitals and small letters, distinct characters, changes of class."""
    out = []
    for w in windows:
        inside = w[BEFORE : BEFORE + INSIDE].rstrip()
        n = max(1, len(inside))
        kinds = [("d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o") for c in inside]
        out.append([kinds.count("d") / n, kinds.count("u") / n, kinds.count("l") / n, len(set(inside)) / n, sum(x != y for x, y in zip(kinds, kinds[1:], strict=False)) / n, n / INSIDE])
    return np.array(out).reshape(-1, 6)


@dataclass
class Network:
    kernel: np.ndarray  # (KERNEL, CHANNELS, FILTERS)
    shift: np.ndarray
    dense: np.ndarray  # of the largest and the mean answer of each filter, the features and 1
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 1.0

    @classmethod
    def random(cls, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.25, (KERNEL, CHANNELS, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS + 7))

    def answers(self, x: np.ndarray) -> np.ndarray:
        """A one-hot convolution is a sum of looked-up kernel rows."""
        places = WIDTH - KERNEL + 1
        return sum(self.kernel[k][x[:, k : k + places]] for k in range(KERNEL)) + self.shift

    def forward(self, x: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.maximum(self.answers(x), 0)
        pooled = np.concatenate([h.max(1), h.mean(1), f, np.ones((len(x), 1))], 1)
        return pooled @ self.dense, h, pooled

    def gradient(self, x: np.ndarray, f: np.ndarray, secret: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Derivatives of the weighted logistic loss."""
        z, h, pooled = self.forward(x, f)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - secret) * weight
        into = error[:, None] * self.dense[None, : 2 * FILTERS]
        places = h.shape[1]
        dh = np.repeat(into[:, None, FILTERS:] / places, places, 1)
        rows, columns = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
        dh[rows, h.argmax(1), columns] += into[:, :FILTERS]
        dh *= h > 0
        dk = np.zeros_like(self.kernel)
        for k in range(KERNEL):
            at = x[:, k : k + places].ravel()
            one = np.zeros((len(at), CHANNELS))
            one[np.arange(len(at)), at] = 1
            dk[k] = one.T @ dh.reshape(-1, FILTERS)
        return {"kernel": dk, "shift": dh.sum((0, 1)), "dense": pooled.T @ error}

    def probability(self, windows: list[str]) -> np.ndarray:
        out = [self.forward(classes(windows[i : i + 512]), features(windows[i : i + 512]))[0] for i in range(0, len(windows), 512)]
        z = self.slope * np.concatenate(out or [np.zeros(0)]) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(windows: list[str], secret: np.ndarray, seed: int = 5) -> Network:
    """Adam on the logistic loss with a fifth of the findings kept aside for calibration and the threshold."""
    net, rng = Network.random(seed), np.random.default_rng(seed)
    if not 0 < secret.sum() < len(secret):
        return net
    x, f = classes(windows), features(windows)
    aside = rng.random(len(secret)) < 0.2
    part = np.flatnonzero(~aside)
    weight = np.where(secret == 1, 0.5 / max(1, secret[part].sum()), 0.5 / max(1, (1 - secret[part]).sum())) * len(part)
    state = {n: [np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))] for n in ("kernel", "shift", "dense")}
    step = 0
    for _ in range(EPOCHS):
        for own in np.array_split(rng.permutation(part), max(1, len(part) // BATCH)):
            slopes = net.gradient(x[own], f[own], secret[own], weight[own] / len(own))
            step += 1
            slopes["dense"] += 1e-4 * net.dense
            for name, g in slopes.items():
                m, v = state[name]
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                getattr(net, name)[...] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    held = np.flatnonzero(aside)
    z, y = net.forward(x[held], f[held])[0], secret[held]
    a, b = 1.0, 0.0
    for _ in range(200):  # Platt's calibration by gradient steps
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        a -= 0.5 * float(((p - y) * z).mean()) / (1 + float((z * z).mean()))
        b -= 0.5 * float((p - y).mean())
    net.slope, net.offset = max(a, 1e-3), b
    p = 1 / (1 + np.exp(-np.clip(net.slope * z + net.offset, -30, 30)))
    # The lower of two neighbours, so that at least RECALL of the findings reach it.
    net.threshold = float(np.quantile(p[y == 1], 1 - RECALL, method="lower")) if y.any() else 1.0
    return net


def generated(n: int = 1500, seed: int = 3) -> tuple[list[str], list[int]]:
    """Findings from public token shapes and from what looks alike but isn't secret."""
    rng = np.random.default_rng(seed)
    pick = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    alnum, low, hexa, b64 = string.ascii_letters + string.digits, string.ascii_lowercase, "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    syllables = ["ba", "con", "de", "er", "ing", "la", "men", "ro", "sta", "ti", "un", "ver", "ion", "ex", "pro"]
    word = lambda k: "".join(syllables[i] for i in rng.integers(0, len(syllables), k))
    secret = [lambda: "ghp_" + pick(alnum, 36), lambda: "sk_live_" + pick(alnum, 24), lambda: "xoxb-" + pick("0123456789", 12) + "-" + pick(alnum, 24), lambda: "AIza" + pick(alnum + "_-", 35)]
    secret += [lambda: pick(b64, 40), lambda: pick(hexa, int(rng.integers(24, 64))), lambda: "eyJ" + pick(alnum, 20) + "." + pick(alnum, 30), lambda: pick(alnum, int(rng.integers(20, 40)))]
    plain = [lambda: word(8), lambda: word(3) + "-" + word(3) + "-" + word(2), lambda: "/".join(word(2) for _ in range(4)), lambda: ".".join(word(2) for _ in range(4)), lambda: "=" * 20, lambda: "-" * 24]
    plain += [lambda: "202" + pick("0123456789", 1) + "-" + pick("01", 2) + "-" + pick("012", 2) + "." + pick("0123456789", 6), lambda: word(2).upper() + "_" + word(3).upper() + "_" + word(1).upper(), lambda: word(3) + "." + word(3) + ".com", lambda: pick("0123456789", 16), lambda: word(4) + "_" + pick("0123456789", 3)]
    windows, labels = [], []
    for i in range(n):
        kind = secret if i % 2 else plain
        token = kind[int(rng.integers(len(kind)))]()
        before, after = word(4) + [" ", ": ", " = ", ' "', "\n"][int(rng.integers(5))], [" ", "\n", '" ', ", "][int(rng.integers(4))] + word(2)
        text = before + token + after
        windows.append(window(text, len(before), len(before) + len(token)))
        labels.append(i % 2)
    return windows, labels


def train(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS, sample_runs: int = SAMPLE_RUNS) -> Network:
    """A network fitted on generated findings and on at most sample_runs candidates of about sample_docs documents."""
    schema = pa.schema([("window", pa.string()), ("secret", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            windows, labels = [], []
            for text in batch.column("text").to_pylist():
                found = runs(text)
                base = base_spans(text, found)
                for a, b in found:
                    own = [(max(a, x), min(b, y)) for x, _, y in base if x < b and a < y]
                    for c, d in own or [(a, b)]:
                        for piece in pieces(text, c, d) if d - c >= SHORTEST else ():
                            windows.append(window(text, a, b, piece))
                            labels.append(int(bool(own)))
                            if len(windows) == HELD:
                                yield rows_of({"window": windows, "secret": labels}, schema)
                                windows, labels = [], []
            yield rows_of({"window": windows, "secret": labels}, schema)

    share = min(1.0, sample_docs / max(1, docs.count()))
    part = docs.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(share * (1 << 30)))
    # One copy of each finding, spread by a hash: copies of one document would otherwise fill the sample.
    rows = id_and_text(part, id_col, text_col).mapInArrow(run, "window string, secret int").groupBy("window").agg(F.max("secret").alias("secret")).orderBy(F.xxhash64("window"), "window").limit(sample_runs).toArrow().to_pydict()
    windows, labels = generated()
    return fit(windows + rows["window"], np.array(labels + rows["secret"], np.float64))


def all_spans(texts: list[str], net: Network) -> list[tuple[list[Span], list[Span]]]:
    """For each text the findings of the fixed patterns, and those with the network's, by start and kind.

    At most HELD windows are held at a time, and of a candidate's flagged pieces, which come by start, only their unions,
    so that a run of megabytes takes little more memory than its text.
    """
    base, windows, places, hits = [], [], [], {}

    def score() -> None:
        for (i, a, b, c, d), p in zip(places, net.probability(windows), strict=True):
            if p >= net.threshold:
                flagged = hits.setdefault((i, a, b), [])
                if flagged and c <= flagged[-1][1]:
                    flagged[-1] = (flagged[-1][0], max(d, flagged[-1][1]))
                else:
                    flagged.append((c, d))
        windows.clear()
        places.clear()

    for i, text in enumerate(texts):
        found = runs(text)
        base.append(base_spans(text, found))
        for a, b in found:
            for c, d in uncovered(a, b, base[-1]):
                for piece in pieces(text, c, d):
                    windows.append(window(text, a, b, piece))
                    places.append((i, c, d, *piece))
                    if len(windows) == HELD:
                        score()
    if windows:
        score()
    whole = [list(b) for b in base]
    for (i, a, b), found in hits.items():
        whole[i] += [(c, 3, d) for c, d in widened(texts[i], a, b, found)]
    return [(b, sorted(w)) for b, w in zip(base, whole, strict=True)]


def scan(docs: DataFrame, net: Network, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row.

    spans lists kind:start:end of all findings by start, then kind; offsets count code points, end exclusive. A null text
    counts as empty and has no findings. Null ids and repeated rows pass through; other columns are ignored; an empty
    table gives no rows; texts are scanned whole.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)
    names = {"n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(), "spans": pa.string()}
    schema = pa.schema([("doc_id", pa.int64()), *names.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for base, whole in all_spans(batch.column("text").to_pylist(), held.value):
                count = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((*count, hashlib.sha256(label(base).encode()).hexdigest(), label(whole)))
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield rows_of({"doc_id": batch.column("id").to_pylist()} | {n: list(c) for n, c in zip(names, columns, strict=True)}, schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask(text: str, spans: list[Span], by: str) -> str:
    """The text with every finding replaced; findings that overlap are replaced as one."""
    out, at, end = [], 0, -1
    for a, _, b in spans:
        if a >= end or end < 0:
            if end >= 0:
                out += [text[at:start], by]
                at = end
            start, end = a, b
        else:
            end = max(end, b)
    if end >= 0:
        out += [text[at:start], by]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, net: Network, *, text_col: str = "text", length_col: str = "n_chars", by: str = "[secret]") -> DataFrame:
    """docs with every finding in the text replaced; length_col, where there is one, follows.

    Null texts stay null and empty ones empty; rows without findings, rows with null ids and repeated rows stay as they
    are, each by itself; an empty table gives no rows.
    """
    held, at = docs.sparkSession.sparkContext.broadcast(net), docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            found = all_spans([t or "" for t in texts], held.value)
            new = [None if t is None else mask(t, w, by) if w else t for t, (_, w) in zip(texts, found, strict=True)]
            columns = batch.columns
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if length is not None:
                old = columns[length].to_pylist()
                columns[length] = pa.array([o if not w else len(n) for o, n, (_, w) in zip(old, new, found, strict=True)], batch.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
