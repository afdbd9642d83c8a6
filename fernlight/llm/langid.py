"""Language identification by interpolated Kneser-Ney character models, one per language.

Counts come from every training document: each partition counts the n-grams of its words, and Spark adds them up and
derives all orders' counts and contexts from every n-gram. They are laid out as sorted arrays of 64-bit hashes that are
broadcast, or, where they are too large for that, sent to the executors as a file that workers map into memory. A
document gets the language of lowest cross-entropy per character. Words, runs of letters and combining marks, are bounded
by marks and scored once per worker; n-grams do not cross words.

A fixed share of the training documents is kept out of the counts: on all of them, at every size, the score and the
rejection are calibrated. Only languages with few documents count every one, and take the others' usual spread.
"""

from __future__ import annotations

import os
import re
import tempfile
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import id_and_text, id_fold, rows_of, slices, staged

ORDER = 5
#: Bytes of arrays that are broadcast; more are mapped from a file, so that memory doesn't bound the model.
BROADCAST = 128 << 20
#: Of a language's training documents one in so many calibrates and isn't counted, where it has at least FEW of them.
ASIDE, FEW = 8, 64
#: Words whose scores a worker keeps, and distinct words of a language a partition counts at a time.
WORDS = 200_000
#: A text is rejected beyond MARGIN times the deviation that this share of the calibrating documents stays within,
REJECT, MARGIN = 0.999, 1.5
#: if it also costs at least so much of the way from its language's usual cost to that of characters drawn evenly.
NEAR_EVEN = 0.6
#: Temperatures among which the score's is chosen.
TEMPERATURES = np.geomspace(1, 200, 40)
NO_LANGUAGE = "und"
_WORD, _WORD_OR_MARK = re.compile(r"[^\W\d_]+"), regex.compile(r"[\p{L}\p{M}]+")
_PAD, _END = "\x02" * (ORDER - 1), "\x03"


def _hash(of: np.ndarray | int, char: np.ndarray) -> np.ndarray:
    h = (of ^ char.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _suffix_hashes(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the last 1, 2, ... characters; columns: characters, the last first."""
    out, h = [], np.uint64(0x51ED270B)
    for c in columns:
        h = _hash(h, c)
        out.append(h)
    return out


def words(text: str) -> list[str]:
    low = text.lower()
    try:
        low.encode("latin-1")
    except UnicodeEncodeError:
        return _WORD_OR_MARK.findall(low)
    return _WORD.findall(low)  # Latin-1 has no combining marks


def grams(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character n-grams (n, ORDER) of all words, in order, and the number of n-grams of each word."""
    chars = np.frombuffer("".join(f"{_PAD}{w}{_END}" for w in found).encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    starts = np.cumsum(lengths + ORDER - 1) - lengths
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    return np.stack([chars[at - k] for k in range(ORDER - 1, -1, -1)], axis=1), lengths


def _parts() -> list[tuple[int, int]]:
    """Each order's two parts, n-grams (2 n) and contexts (2 n + 1), with the values they hold beside the hash."""
    return [(2 * n + k, 1 + k) for n in range(1, ORDER + 1) for k in (0, 1)]


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    #: Sorted hashes and values of every part, one after another; or the name of the file that Spark sent with them.
    data: np.ndarray | str = field(default_factory=lambda: np.zeros(0, np.int64))
    #: For each language and order: where n-grams' hashes and counts, contexts' hashes, totals and followers start and end.
    places: list[list[list[tuple[int, int]]]] = field(default_factory=list)
    #: For each language and order: what is taken off a count.
    discounts: list[list[float]] = field(default_factory=list)
    temperature: float = 20.0
    #: For each language: mean cross-entropy and variance a + b / characters; and the most standard deviations above it.
    usual: list[tuple[float, float, float]] = field(default_factory=list)
    reject_beyond: float = float("inf")
    #: The documents that calibrated it.
    calibrated_on: int = 0

    @classmethod
    def laid_out(cls, sizes: dict[tuple[str, int], tuple[int, int, int]]) -> Model:
        """A model without data. sizes: language and part -> rows, and how many of them have a count of one and of two."""
        self, at = cls(sorted({k for k, _ in sizes})), 0
        for language in self.languages:
            orders: list[list[tuple[int, int]]] = [[] for _ in range(ORDER)]
            for part, values in _parts():
                n = sizes[language, part][0]
                for _ in range(1 + values):
                    orders[part // 2 - 1].append((at, at + n))
                    at += n
            self.places.append(orders)
            seen = [sizes[language, 2 * n][1:] for n in range(1, ORDER + 1)]
            self.discounts.append([float(np.clip(ones / max(1, ones + 2 * twos), 0.1, 0.95)) for ones, twos in seen])
        return self

    @property
    def size(self) -> int:
        return self.places[-1][-1][-1][1] if self.places else 0

    @classmethod
    def of(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
        """counts: language -> n-grams (n, ORDER) and their counts."""
        held, sizes = {}, {}
        for language, (top, count) in counts.items():
            now, c = [top[:, k] for k in range(ORDER - 1, -1, -1)], count.astype(np.int64)
            for n in range(ORDER, 0, -1):
                h = _suffix_hashes(now)[-1].view(np.int64)
                context = _suffix_hashes(now[1:])[-1].view(np.int64) if n > 1 else np.zeros(len(c), np.int64)
                order = np.argsort(h)
                kinds, where = np.unique(context, return_inverse=True)
                held[language, 2 * n] = [h[order], c[order]]
                held[language, 2 * n + 1] = [kinds, np.bincount(where, c).astype(np.int64), np.bincount(where)]
                sizes |= {(language, 2 * n): (len(h), np.sum(c == 1), np.sum(c == 2)), (language, 2 * n + 1): (len(kinds), 0, 0)}
                if n > 1:  # lower orders count the distinct characters that come before
                    _, first, c = np.unique(_suffix_hashes(now[: n - 1])[-1], return_index=True, return_counts=True)
                    now = [x[first] for x in now[: n - 1]]
        self = cls.laid_out(sizes)
        self.data = np.concatenate([np.zeros(0, np.int64), *(x for k in self.languages for part, _ in _parts() for x in held[k, part])])
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tables"}

    @cached_property
    def tables(self) -> list[list[list[np.ndarray]]]:
        data = np.memmap(SparkFiles.get(self.data), np.int64, "r") if isinstance(self.data, str) else self.data
        return [[[np.asarray(data[a:b]) for a, b in order] for order in orders] for orders in self.places]

    @property
    def unknown(self) -> list[float]:
        """For each language: the probability of a character it has never seen."""
        return [float(d[0] * t[0][4][0] / t[0][3][0] / (len(t[0][0]) + 1)) for t, d in zip(self.tables, self.discounts, strict=True)]

    def log_p(self, of: np.ndarray) -> np.ndarray:
        """Natural logarithms (n, languages) of the last character given the others."""
        columns = [of[:, k] for k in range(ORDER - 1, -1, -1)]
        h, before = ([x.view(np.int64) for x in _suffix_hashes(c)] for c in (columns, columns[1:]))
        out = np.empty((len(of), len(self.languages)))
        for k, tables in enumerate(self.tables):
            p = np.full(len(of), 1 / (len(tables[0][0]) + 1))
            for n, ((grams_h, count, contexts, total, followers), discount) in enumerate(zip(tables, self.discounts[k], strict=True), 1):
                context = before[n - 2] if n > 1 else np.zeros(len(of), np.int64)
                at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
                all_of = total[at]
                p = np.where(contexts[at] == context, p * discount * followers[at] / all_of, p)
                at = np.minimum(np.searchsorted(grams_h, h[n - 1]), len(grams_h) - 1)
                p += np.where(grams_h[at] == h[n - 1], np.maximum(count[at] - discount, 0) / all_of, 0)
            out[:, k] = np.log(p)
        return out


class Scorer:
    """Scores texts; keeps the scores of words."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.at: dict[str, int] = {}
        #: For each word: cost by language, characters, letters.
        self.rows = np.zeros((0, len(self.model.languages) + 2))

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cost in nats by language, characters and letters of each text."""
        if len(self.at) > WORDS:
            self.reset()
        at, found, ends = self.at, [], []
        fresh: dict[str, int] = {}
        for text in texts:
            for w in words(text):
                i = at.get(w)
                if i is None:
                    i = at[w] = fresh[w] = len(at)
                found.append(i)
            ends.append(len(found))
        if fresh:
            new = list(fresh)
            rows = np.zeros((len(new), self.rows.shape[1]))
            of, lengths = grams(new)
            _, first, where = np.unique(_suffix_hashes([of[:, k] for k in range(ORDER)])[-1], return_index=True, return_inverse=True)
            cost = -self.model.log_p(of[first])
            starts = np.cumsum(lengths) - lengths
            for k in range(cost.shape[1]):
                rows[:, k] = np.add.reduceat(cost[where, k], starts)
            rows[:, -2] = lengths
            rows[:, -1] = [len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in new]
            self.rows = np.concatenate([self.rows, rows])
        doc = np.repeat(np.arange(len(texts)), np.diff([0, *ends]))
        taken = self.rows[np.array(found, np.int64)]
        out = np.stack([np.bincount(doc, taken[:, k], len(texts)) for k in range(taken.shape[1])], axis=1)
        return out[:, :-2], out[:, -2], out[:, -1]


def count_grams(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, gram, n over every row with a language."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])

    def out(lang: str, counted: Counter) -> pa.RecordBatch:
        found = list(counted)
        of, lengths = grams(found)
        _, first, where = np.unique(_suffix_hashes([of[:, k] for k in range(ORDER)])[-1], return_index=True, return_inverse=True)
        n = np.bincount(where, np.repeat(np.fromiter(counted.values(), np.float64, len(found)), lengths)).astype(np.int64)
        text = np.ascontiguousarray(of[first], "<u4").tobytes().decode("utf-32-le")
        return rows_of({"lang": [lang] * len(n), "gram": [text[i : i + ORDER] for i in range(0, len(text), ORDER)], "n": n}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)
        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held[lang].update(words(text))
            for lang in [k for k, c in held.items() if len(c) > WORDS]:
                yield out(lang, held.pop(lang))
        for lang, counted in held.items():
            if counted:
                yield out(lang, counted)

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _entries(counted: DataFrame) -> DataFrame:
    """lang, part, gram, x, y: every order's n-grams with their counts, and contexts with totals and followers."""
    level, levels = counted.withColumnRenamed("n", "x"), []
    for n in range(ORDER, 0, -1):
        level = staged(level, "grams")
        levels.append(level.withColumn("part", F.lit(2 * n)))
        # Lower orders count the distinct characters that come before.
        level = level.groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("x"))
    rows = levels[0]
    for more in levels[1:]:
        rows = rows.unionByName(more)
    context = F.expr("substring(gram, 1, length(gram) - 1)").alias("gram")
    contexts = rows.groupBy("lang", (F.col("part") + 1).alias("part"), context).agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("y"))
    return rows.withColumn("y", F.lit(0).cast("long")).unionByName(contexts).select("lang", "part", "gram", "x", "y")


def _chunks(entries: DataFrame) -> DataFrame:
    """lang, part, first, size, ones, twos, columns: sorted stretches of each part, ordered by their first hashes."""
    hashed = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("hash", pa.int64()), ("x", pa.int64()), ("y", pa.int64())])
    names = [("lang", pa.string()), ("part", pa.int32()), ("first", pa.int64()), ("size", pa.int64()), ("ones", pa.int64()), ("twos", pa.int64()), ("columns", pa.list_(pa.binary()))]
    schema = pa.schema(names)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("gram").to_pylist()
            lengths, h = np.fromiter(map(len, found), np.int64, len(found)), np.zeros(len(found), np.uint64)
            for n in set(lengths.tolist()) - {0}:
                of = np.flatnonzero(lengths == n)
                chars = np.frombuffer("".join(found[i] for i in of).encode("utf-32-le"), np.uint32).reshape(-1, n)
                h[of] = _suffix_hashes([chars[:, k] for k in range(n - 1, -1, -1)])[-1]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("part"), pa.array(h.view(np.int64)), batch.column("x"), batch.column("y")], schema=hashed)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, part = np.array(batch.column("lang").to_pylist(), object), batch.column("part").to_numpy()
            own = [batch.column(c).to_numpy() for c in ("hash", "x", "y")]
            starts = np.flatnonzero(np.r_[True, (lang[1:] != lang[:-1]) | (part[1:] != part[:-1])]) if len(lang) else []
            out = []
            for a, b in zip(starts, [*starts[1:], len(lang)], strict=True):
                x = own[1][a:b]
                out.append((lang[a], part[a], own[0][a], b - a, np.sum(x == 1), np.sum(x == 2), [c[a:b].tobytes() for c in own[: 2 + part[a] % 2]]))
            yield rows_of({k: [r[i] for r in out] for i, (k, _) in enumerate(names)}, schema)

    # Written before, since range partitioning reads its input twice.
    rows = staged(entries.mapInArrow(hashes, "lang string, part int, hash long, x long, y long"), "hashes")
    order = ("lang", "part", "hash")
    return staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, "lang string, part int, first long, size long, ones long, twos long, columns array<binary>"), "chunks")


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """A model of the rows of docs that have a language and a text; without such rows it knows no language.

    Every n-gram of the documents that don't calibrate is kept. The driver copies the arrays stretch by stretch, and holds
    no more than `BROADCAST` bytes of them.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    many = [r[0] for r in labelled.groupBy(F.col(lang_col)).count().where(F.col("count") >= FEW).select(lang_col).collect()]
    aside = F.coalesce((F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit("aside")), F.lit(ASIDE)) == 0) & F.col(lang_col).isin(many), F.lit(False))
    chunks = _chunks(_entries(count_grams(labelled.where(~aside), text_col=text_col, lang_col=lang_col)))
    known = sorted((tuple(r) for r in chunks.drop("columns").collect()), key=lambda r: r[:3])
    sizes: dict[tuple[str, int], tuple[int, int, int]] = {}
    before = {}
    for lang, part, first, *own in known:
        held = sizes.get((lang, part), (0, 0, 0))
        before[lang, part, first] = held[0]
        sizes[lang, part] = tuple(a + b for a, b in zip(held, own, strict=True))
    model = Model.laid_out(sizes)
    if not model.languages:
        return model
    path = None
    if 8 * model.size > BROADCAST:
        path = f"{tempfile.mkdtemp(prefix='fernlight-grams-')}/grams-{os.urandom(8).hex()}"
        model.data = np.memmap(path, np.int64, "w+", shape=(model.size,))
    else:
        model.data = np.empty(model.size, np.int64)
    for r in chunks.select("lang", "part", "first", "columns").toLocalIterator():
        place = model.places[model.languages.index(r.lang)][r.part // 2 - 1][2 * (r.part % 2) :]
        for (start, _), column in zip(place, r.columns):
            at = start + before[r.lang, r.part, r.first]
            model.data[at : at + len(column) // 8] = np.frombuffer(column, np.int64)
    if path:
        model.data.flush()
        docs.sparkSession.sparkContext.addFile(path)
        model.data = os.path.basename(path)
    _calibrate(model, labelled.where(aside), text_col, lang_col, id_col)
    return model


def _calibrate(model: Model, aside: DataFrame, text_col: str, lang_col: str, id_col: str) -> None:
    """Temperature, usual costs and rejection from documents that weren't counted; Spark adds up all of them."""
    rows = _costs(aside.where(F.col(lang_col).isin(model.languages)), model, text_col, id_col, F.col(lang_col).alias("lang")).where("chars > 0")
    rows = staged(rows.withColumn("ce", F.transform("costs", lambda c: c / F.col("chars"))).withColumn("gold", F.array_position(F.array(*map(F.lit, model.languages)), F.col("lang")).cast("int")).withColumn("own", F.element_at("ce", F.col("gold"))), "calibration")
    schema = pa.schema([("k", pa.int32()), ("loss", pa.float64())])

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(TEMPERATURES))
        for batch in slices(batches, 4096):
            gold = batch.column("gold").to_numpy() - 1
            z = -batch.column("ce").flatten().to_numpy().reshape(len(gold), -1)
            z -= z.max(1, keepdims=True, initial=-np.inf)
            for k, t in enumerate(TEMPERATURES):
                total[k] += np.sum(np.log(np.exp(t * z).sum(1)) - t * z[np.arange(len(z)), gold])
        yield rows_of({"k": list(range(len(total))), "loss": total}, schema)

    # One job: losses of the temperatures, and each language's median and number.
    middle = F.percentile_approx("own", 0.5, 10_000)
    medians = {r.gold: (r.m, r.n) for r in rows.groupBy("gold").agg(middle.alias("m"), F.count(F.lit(1)).alias("n")).collect()}
    model.calibrated_on = sum(n for _, n in medians.values())
    if not model.calibrated_on:
        return
    found = {r.k: r.loss for r in rows.select("gold", "ce").mapInArrow(losses, "k int, loss double").groupBy("k").agg(F.sum("loss").alias("loss")).collect()}
    model.temperature = float(TEMPERATURES[min(found, key=lambda k: (found[k], k))])
    mean = F.element_at(F.create_map(*(F.lit(x) for k, (m, _) in sorted(medians.items()) for x in (k, m))), F.col("gold"))
    d, u = F.pow(F.col("own") - mean, 2), 1 / F.col("chars")
    sums = {r.gold: r for r in rows.groupBy("gold").agg(F.avg(d).alias("d"), F.avg(u).alias("u"), F.avg(d * u).alias("du"), F.avg(u * u).alias("uu")).collect()}
    everyone = sum(medians[k][0] * medians[k][1] for k in medians) / model.calibrated_on
    spread = sum(sums[k].d * medians[k][1] for k in medians) / model.calibrated_on
    for k in range(1, len(model.languages) + 1):
        if k not in sums:  # few documents, all of them counted
            model.usual.append((everyone, spread + 1e-3, 1.0))
            continue
        r = sums[k]
        varied = r.uu - r.u * r.u
        b = (r.du - r.d * r.u) / varied if varied > 1e-12 else 0.0  # of the squares' regression on 1 / characters
        model.usual.append((medians[k][0], max(r.d - b * r.u, 1e-3), max(b, 0.05)))
    of = lambda i: F.element_at(F.array(*(F.lit(x[i]) for x in model.usual)), F.col("gold"))
    deviation = (F.col("own") - of(0)) / F.sqrt(of(1) + of(2) / F.col("chars"))
    model.reject_beyond = MARGIN * float(rows.agg(F.percentile_approx(deviation, REJECT, 10_000)).first()[0])


def _decide(model: Model, costs: np.ndarray, chars: np.ndarray, letters: np.ndarray) -> dict[str, list]:
    n, some = len(chars), len(model.languages)
    known = (letters > 0) & (some > 0)
    ce = costs / np.maximum(chars, 1)[:, None]
    if not some:
        return {"lang_pred": [NO_LANGUAGE] * n, "score": [0.0] * n, "cross_entropy": [None] * n, "rejected": (letters == 0).tolist()}
    z = -model.temperature * ce
    z = np.exp(z - z.max(1, keepdims=True))
    z /= z.sum(1, keepdims=True)
    best = np.argmin(ce, axis=1)
    rows = np.arange(n)
    far = np.zeros(n, bool)
    if model.usual:
        usual = np.array(model.usual)[best]
        far = (ce[rows, best] - usual[:, 0]) / np.sqrt(usual[:, 1] + usual[:, 2] / np.maximum(chars, 1)) > model.reject_beyond
        even = np.log([len(t[0][0]) + 1 for t in model.tables])[best]  # the cost of characters drawn evenly
        far &= ce[rows, best] > usual[:, 0] + NEAR_EVEN * (even - usual[:, 0])
    return {
        "lang_pred": [model.languages[b] if k else NO_LANGUAGE for b, k in zip(best, known, strict=True)],
        "score": np.where(known, z[rows, best], 0.0).tolist(),
        "cross_entropy": [float(c) if k else None for c, k in zip(ce[rows, best], known, strict=True)],
        "rejected": (far | ~known).tolist(),
    }


def _costs(docs: DataFrame, model: Model, text_col: str, id_col: str, *extra: Column) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("costs", pa.list_(pa.float64())), ("chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in slices(batches):
            costs, chars, _ = scorer.texts(batch.column("text").to_pylist())
            yield rows_of({"id": batch.column("id").to_pylist(), "lang": batch.column("lang").to_pylist(), "costs": costs.tolist(), "chars": chars.astype(np.int64)}, schema)

    return id_and_text(docs, id_col, text_col, *extra).mapInArrow(run, "id long, lang string, costs array<double>, chars long")


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", id_col: str = "doc_id", folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected of every row; only the text is looked at.

    A null text and one without a letter are `und` with score 0 and rejected. Under a model without languages every text is
    `und` with score 0, and only those without a letter are rejected, since there is nothing to tell the others by. Ties go
    to the first language by name. Null ids are not held out; repeated rows are scored alike; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("rejected", pa.bool_())]
    schema = pa.schema(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in slices(batches):
            found = _decide(scorer.model, *scorer.texts(batch.column("text").to_pylist()))
            yield rows_of({"doc_id": batch.column("id").to_pylist(), "held_out": batch.column("held_out").to_pylist()} | found, schema)

    fold = F.coalesce(id_fold(id_col, folds) == held_out, F.lit(False)).alias("held_out")
    return id_and_text(docs, id_col, text_col, fold).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that `identify` doesn't reject.

    Null and empty texts and those without a letter go; null ids and repeated rows stay as they are; a model without
    languages (a corpus without labels) keeps every text with a letter; an empty table gives no rows.
    """
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in slices(batches):
            found = _decide(scorer.model, *scorer.texts([t or "" for t in batch.column(at).to_pylist()]))
            yield batch.filter(~pa.array(found["rejected"]).to_numpy(zero_copy_only=False))

    return docs.mapInArrow(run, docs.schema)


def train_fold(docs: DataFrame, *, id_col: str = "doc_id", folds: int = 4, held_out: int = 2, **more) -> Model:
    """train() on the rows outside the held-out fold; null ids belong to no fold and aren't learned from."""
    return train(docs.where(id_fold(id_col, folds) != held_out), id_col=id_col, **more)
