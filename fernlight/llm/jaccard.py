"""A similarity join of documents on their sets of word n-grams, partitioned vertically.

All n-grams have one global order: rare ones first by the counts of a broadcast sketch of fixed size, and by hash. Equal
sets are one class. Two sets as alike as the threshold share an n-gram among their first few in that order; the classes
that share one are first compared with the one of the most common n-grams, and only those that are still in different
components with each other. A pair whose n-grams before the shared one, in either set, are more than alike sets may have
apart isn't compared at all, and an n-gram whose sets all differ too much in size isn't even gathered. Of every set there
are one or two bits for an n-gram, which tell whether an odd number of n-grams fall on them. Two sets' bits differ in no
more places than the sets do: pairs that differ in more than alike sets may are done. For every other pair the global order
is cut into fragments of about equal weight, and the overlap is counted, with all 64 bits of every n-gram, in each fragment
by itself and summed.

No join brings all rows of a heavy key to one task: see joins.py.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import free_name, id_and_text, rows_of, slices, staged
from .components import components
from .hashing import bitmap, in_bitmap, mix, shingle_sets
from .joins import Heavy, heavy_keys, spread_join

FRAGMENTS = 8
#: Counters of the sketch and counters in one of its blocks. A broadcast counter is one byte: 4 MB.
COUNTERS, BLOCK = 1 << 22, 1 << 16
#: Sketches of partitions that one task adds up, and classes of one n-gram whose pairs one task looks at.
ADDED, PAIRED = 256, 512
#: Keys of first n-grams that are held against each other at once (a power of two), and that a task gathers and then sends.
HELD, GATHERED = 1 << 18, 1 << 20


def _sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The n-grams of each text: words between ASCII white space, A-Z in lower case."""
    return shingle_sets([t.encode() for t in texts], size, fold=True)


def _sum(found: np.ndarray) -> int:
    """A hash of a set, which names its class; not 0."""
    with np.errstate(over="ignore"):
        total = mix(np.array([mix(found).sum(dtype=np.uint64) + np.uint64(len(found))], np.uint64))
    return int(total.view(np.int64)[0]) or 1


def _survey(rows: DataFrame, size: int) -> DataFrame:
    """Two kinds of rows: id, n, node of every document (node 0 for an empty set), and blocks of each partition's sketch."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int32)
        for batch in slices(batches):
            found = _sets(batch.column("text").to_pylist(), size)
            np.add.at(counts, _counter(np.concatenate(found)), 1)
            k = batch.num_rows
            yield rows_of({"id": batch.column("id").to_pylist(), "n": list(map(len, found)), "node": [_sum(f) if len(f) else 0 for f in found], "block": [None] * k, "counts": [None] * k}, schema)
        full = [(i, c) for i, c in enumerate(counts.reshape(-1, BLOCK)) if c.any()]
        none = [None] * len(full)
        yield rows_of({"id": none, "n": none, "node": none, "block": [i for i, _ in full], "counts": [packed(c) for _, c in full]}, schema)

    return rows.mapInArrow(run, "id long, n long, node long, block int, counts binary")


def packed(counts: np.ndarray) -> bytes:
    """A block's counters in as few bytes each as hold them, compressed. They follow no pattern, only some are commoner."""
    kind = next((k for k in (np.uint8, np.int32) if counts.max() <= np.iinfo(k).max), np.int64)
    by = zlib.compressobj(1, strategy=zlib.Z_HUFFMAN_ONLY if kind is np.uint8 else zlib.Z_DEFAULT_STRATEGY)
    return by.compress(counts.astype(kind).tobytes()) + by.flush()


def unpacked(counts: bytes) -> np.ndarray:
    raw = zlib.decompress(counts)
    return np.frombuffer(raw, {1: np.uint8, 4: np.int32, 8: np.int64}[len(raw) // BLOCK])


def _counter(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(7)) & np.uint64(COUNTERS - 1)


def _sketch(blocks: DataFrame) -> np.ndarray:
    """Blocks added up by tasks that hold the sums of a block alone, first in groups where there are very many; counters as
    logarithms in a byte."""

    def add(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in slices(batches, 64):
                for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                    own = total.setdefault(block, np.zeros(BLOCK, np.int64))
                    own += unpacked(counts)
            out = [np.minimum(255, np.round(7 * np.log2(1 + t))).astype(np.uint8).tobytes() if last else packed(t) for t in total.values()]
            yield rows_of({"block": list(total), "counts": out}, pa.schema([("block", pa.int32()), ("counts", pa.binary())]))

        return run

    number = COUNTERS // BLOCK
    groups = 1 + blocks.count() // (number * ADDED)
    if groups > 1:
        dealt = blocks.withColumn("group", F.pmod(F.xxhash64("counts"), F.lit(groups)))
        blocks = dealt.repartition(number * groups, "block", "group").select("block", "counts").mapInArrow(add(False), "block int, counts binary")
    out = np.zeros(COUNTERS, np.uint8)
    for block, levels in blocks.repartition(number, "block").mapInArrow(add(True), "block int, counts binary").collect():
        out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(levels, np.uint8)
    return out


def boundaries(levels: np.ndarray) -> np.ndarray:
    """Where the global order is cut into FRAGMENTS parts of about equal weight, as places (see _ordered)."""
    kinds = np.bincount(levels, minlength=256).astype(np.float64)
    weight = np.cumsum(kinds * (2.0 ** (np.arange(256) / 7) - 1))
    out = []
    for k in range(1, FRAGMENTS):
        goal = weight[-1] * k / FRAGMENTS
        level = min(255, int(np.searchsorted(weight, goal)))
        before = weight[level - 1] if level else 0.0
        share = (goal - before) / (weight[level] - before) if weight[level] > before else 0.0
        out.append(level << 56 | int(min(share, 1 - 1e-9) * (1 << 56)))  # hashes are even within a level
    return np.array(out, np.uint64)


def _ordered(found: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes in the global order, and their places in it: the level, then the hash."""
    place = levels[_counter(found)].astype(np.uint64) << np.uint64(56) | found >> np.uint64(8)
    order = np.argsort(place, kind="stable")
    return found[order], place[order]


def fragments(found: np.ndarray, levels: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
    """The n-grams of a set, cut where the global order is."""
    ordered, place = _ordered(found, levels)
    return np.split(ordered, np.searchsorted(place, cuts))


def _held(batch: pa.RecordBatch, wanted) -> np.ndarray:
    """Which documents a bitmap of ids holds; those without an id too."""
    ids = batch.column("id")
    return in_bitmap(np.frombuffer(wanted.value, np.uint8), ids.fill_null(0).to_numpy()) | ids.is_null().to_numpy(zero_copy_only=False)


def shortened(found: np.ndarray, bits: int = 1 << 16) -> np.ndarray:
    """Those of `bits` places (a power of two) that an odd number of hashes fall on. Two sets of these differ in no more
    places than the hashes themselves do, and so do the sets modulo a smaller power of two, odd ones kept."""
    place = (found >> np.uint64(20)).astype(np.int64) & (bits - 1)
    return np.flatnonzero(np.bincount(place, minlength=bits) & 1)


def parities(found: np.ndarray) -> bytes:
    """The shortened hashes of a set as a bitmap of one to two bits for each."""
    bits = max(64, 1 << (len(found) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[shortened(found, bits)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _heads(rows: DataFrame, size: int, percent: int, sketch, wanted) -> DataFrame:
    """node, n, score, first, probe of one document of each class: how common its n-grams are, the first of them in order,
    and the parities of all."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("score", pa.int32()), ("first", pa.list_(pa.int64())), ("probe", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = sketch.value
        for batch in slices(batches):
            node, count, score, first, probe = [], [], [], [], []
            for found in _sets(batch.column("text").filter(pa.array(_held(batch, wanted))).to_pylist(), size):
                if len(found):
                    ordered, place = _ordered(found, levels)
                    node.append(_sum(found))
                    count.append(len(found))
                    score.append(int(1000 * (place >> np.uint64(56)).mean()))
                    first.append(ordered[: len(found) - -(-percent * len(found) // 100) + 1].view(np.int64))
                    probe.append(np.frombuffer(parities(found), np.int64))
            yield rows_of({"node": node, "n": count, "score": score, "first": first, "probe": probe}, schema)

    return rows.mapInArrow(run, "node long, n long, score int, first array<long>, probe array<long>")


def steps(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The step of each size, and the size at which the next step begins. Sizes that may link lie in one step or in two that
    follow each other."""
    if percent >= 100:
        return n, n + 1
    begins = [1]
    while begins[-1] <= n.max(initial=0):
        begins.append(begins[-1] * 100 // percent + 1)
    step = np.searchsorted(begins, n, side="right")
    return step, np.array(begins)[step]


def _firsts(batch: pa.RecordBatch, percent: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all first n-grams in a batch: their set's row, their place in its order, and keys of n-gram and step of sizes: the
    set's own, the next, and whether sets of the next step may be alike to this one with that n-gram as the first in common.
    Two sets that link have a key of their first common n-gram in common."""
    column, n = batch.column("first"), batch.column("n").to_numpy()
    offsets = column.offsets.to_numpy()
    row = np.repeat(np.arange(len(n)), np.diff(offsets))
    at = np.arange(len(row)) - (offsets[:-1] - offsets[0])[row]
    gram = column.flatten().to_numpy().view(np.uint64)
    step, begins = steps(n, percent)
    n, step, begins = n[row], step[row].astype(np.uint64), begins[row]
    own, over = (mix(gram ^ mix(s)) & np.uint64((1 << bits) - 1) for s in (step, step + np.uint64(1)))
    return row, at, own, over, (n - at) * (100 + percent) // percent - n >= begins


def sparse(keys: np.ndarray, bits: int) -> bytes:
    """Sorted numbers of so many bits by Elias and Fano: their low bits, and a bitmap of what the others grow by."""
    low = max(0, bits - len(keys).bit_length())
    lows = np.unpackbits(keys.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :low]
    high = np.zeros(len(keys) + (1 << (bits - low)), np.uint8)
    high[(keys >> np.uint64(low)).astype(np.int64) + np.arange(len(keys))] = 1
    return np.packbits(np.concatenate([lows.ravel(), high])).tobytes()


def dense(coded: bytes, number: int, bits: int) -> np.ndarray:
    """What sparse() has coded."""
    low = max(0, bits - number.bit_length())
    every = np.unpackbits(np.frombuffer(coded, np.uint8))
    lows = np.zeros((number, 64), np.uint8)
    lows[:, :low] = every[: number * low].reshape(number, low)
    high = (np.flatnonzero(every[number * low :]) - np.arange(number)).astype(np.uint64)
    return np.packbits(lows, axis=1, bitorder="little").view("<u8").ravel() | high << np.uint64(low)


def _twice(heads: DataFrame, percent: int, total: int) -> tuple[DataFrame, int]:
    """key: those keys of first n-grams that several sets have, or few sets with keys alike, and a second hash of each (see
    _known); and the bits of a key. total: about how many there are.

    Keys have eight bits more than tell all of them apart, and are sent as sorted lists, some two bytes a key.
    """
    bits = min(48, total.bit_length() + 8)
    tail = min(bits, bits - total.bit_length() + HELD.bit_length() - 1)  # bits of a key within its range

    def sent(keys: np.ndarray) -> pa.RecordBatch:
        keys = np.sort(keys)
        kept = np.ones(len(keys), bool)
        kept[2:] = keys[2:] != keys[:-2]  # two of a kind are enough
        keys = keys[kept]
        part, begins = np.unique(keys >> np.uint64(tail), return_index=True)
        pieces = np.split(keys & np.uint64((1 << tail) - 1), begins[1:]) if len(keys) else []
        return rows_of({"part": part.astype(np.int32), "number": list(map(len, pieces)), "coded": [sparse(p, tail) for p in pieces]}, pa.schema([("part", pa.int32()), ("number", pa.int32()), ("coded", pa.binary())]))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, number = [], 0
        for batch in slices(batches, 512):
            _, _, own, over, both = _firsts(batch, percent, bits)
            found += [own, over[both]]
            number += len(own) + int(both.sum())
            if number > GATHERED:
                yield sent(np.concatenate(found))
                found, number = [], 0
        if found:
            yield sent(np.concatenate(found))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("part", "number", "coded")), strict=True))
        for part, lists in groupby(rows, key=lambda row: row[0]):
            keys = np.sort(np.concatenate([dense(coded, number, tail) for _, number, coded in lists]))
            keys = np.unique(keys[1:][keys[1:] == keys[:-1]]) | np.uint64(part << tail)
            yield rows_of({"key": np.concatenate([keys, mix(keys)]).view(np.int64)}, pa.schema([("key", pa.int64())]))

    lists = heads.select("n", "first").mapInArrow(gather, "part int, number int, coded binary")
    return lists.repartition("part").sortWithinPartitions("part").mapInArrow(match, "key long"), bits


def _known(some: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether a bitmap holds both hashes of keys: with as many bits, far fewer others pass than with one hash."""
    return in_bitmap(some, keys) & in_bitmap(some, mix(keys))


def _shared(heads: DataFrame, percent: int, bits: int, wanted) -> DataFrame:
    """gram, node, n, at, score: first n-grams with a key that the bitmap holds, with their places in the order."""
    schema = pa.schema([("gram", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("at", pa.int32()), ("score", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = np.frombuffer(wanted.value, np.uint8)
        for batch in slices(batches, 512):
            row, at, own, over, both = _firsts(batch, percent, bits)
            hit = _known(some, own) | (both & _known(some, over))
            each = {c: batch.column(c).to_numpy()[row[hit]] for c in ("node", "n", "score")}
            yield rows_of({"gram": batch.column("first").flatten().to_numpy()[hit], "at": at[hit].astype(np.int32)} | each, schema)

    return heads.select("node", "n", "score", "first").mapInArrow(run, "gram long, node long, n long, at int, score int")


def _probes(heads: DataFrame, wanted) -> DataFrame:
    """node, n, probe of the classes that a bitmap holds, and of few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(some, batch.column(0).to_numpy())))

    return heads.select("node", "n", "probe").mapInArrow(run, "node long, n long, probe array<long>")


def _near(pairs: DataFrame, percent: int) -> DataFrame:
    """a, b of those pairs (with n_a, probe_a, n_b, probe_b) whose sizes and parities let them be as alike as the threshold."""

    # Spark's own functions: Python here would keep two more workers in every executor, beside those of the probes.
    words = F.least(F.size("probe_a"), F.size("probe_b"))

    def folded(probe: str):
        each = lambda i: F.aggregate(F.sequence(i, F.size(probe) - 1, words), F.lit(0).cast("long"), lambda x, k: x.bitwiseXOR(F.get(F.col(probe), k)))
        return F.transform(F.sequence(F.lit(0), words - 1), each)

    apart = F.aggregate(F.zip_with(folded("probe_a"), folded("probe_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return pairs.where(sizes & (apart * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))).select("a", "b")


def _may_link(n, at, n_b, at_b, percent: int):
    """Whether sets that share the n-gram at these places, and none before, can be as alike as the threshold."""
    sizes = F.least(n, n_b) * 100 >= F.greatest(n, n_b) * percent
    return sizes & ((F.least(n - at, n_b - at_b)) * (100 + percent) >= (n + n_b) * percent)


def _fragments(rows: DataFrame, size: int, sketch, cuts: np.ndarray, as_a, as_b) -> DataFrame:
    """node, n, part, grams, as_a, as_b: the fragments of one document of each class that either bitmap of ids holds, and
    which of them does."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("part", pa.int32()), ("grams", pa.list_(pa.int64())), ("as_a", pa.bool_()), ("as_b", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            a, b = _held(batch, as_a), _held(batch, as_b)
            out = []
            for found, *sides in zip(_sets(batch.column("text").filter(pa.array(a | b)).to_pylist(), size), a[a | b].tolist(), b[a | b].tolist(), strict=True):
                own = _sum(found) if len(found) else 0
                out += [(own, len(found), k, piece.view(np.int64), *sides) for k, piece in enumerate(fragments(found, sketch.value, cuts)) if len(piece)]
            yield rows_of(dict(zip(schema.names, zip(*out, strict=True), strict=True)) if out else {c: [] for c in schema.names}, schema)

    return rows.mapInArrow(run, "node long, n long, part int, grams array<long>, as_a boolean, as_b boolean")


class _Join:
    """What the steps of one join share."""

    def __init__(self, rows: DataFrame, size: int, percent: int):
        self.rows, self.size, self.percent = rows, size, percent
        share = rows.sparkSession.sparkContext.broadcast
        surveyed = staged(_survey(rows, size), "survey")
        self.sets = surveyed.where("block IS NULL").select("id", "n", "node")
        levels = _sketch(surveyed.where("block IS NOT NULL").select("block", "counts"))
        self.sketch, self.cuts = share(levels), boundaries(levels)
        self.classes = staged(self.sets.where("node <> 0").groupBy("node").agg(F.min("id").alias("id")), "classes")
        self.heads = staged(_heads(rows, size, percent, self.sketch, share(bitmap(self.classes.where("id IS NOT NULL"), "id"))), "heads")
        # Rows that repeat an id and a text, or have no id, may speak for one class several times.
        number, grams = self.heads.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.firsts = number + grams * (100 - percent) // 100
        self.repeated = number > self.classes.count()
        if self.repeated:
            self.heads = staged(self.heads.dropDuplicates(["node"]), "heads")

    def shared(self) -> tuple[DataFrame, Heavy]:
        """gram, node, n, at, leader, nodes: first n-grams of several classes, with the class they are compared with; and the
        heavy ones of these n-grams."""
        twice, bits = _twice(self.heads, self.percent, self.firsts)
        wanted = bitmap(staged(twice, "twice"), "key")
        # Every class has an n-gram once, so that rows are classes.
        found = staged(_shared(self.heads, self.percent, bits, self.rows.sparkSession.sparkContext.broadcast(wanted)), "shared")
        heavy = heavy_keys(found, "gram")
        best, own = F.max(F.struct("score", "node", "n", "at")), Window.partitionBy("gram")
        both = found.where(~heavy.holds("gram")).select("*", best.over(own).alias("leader"), F.count(F.lit(1)).over(own).alias("nodes")).where("nodes > 1")
        if heavy:  # their leaders are fewer than joins.SHARE and broadcast; the other rows are dealt once
            hot = found.where(heavy.holds("gram"))
            leaders = hot.groupBy("gram").agg(best.alias("leader"), F.count(F.lit(1)).alias("nodes"))
            both = both.unionByName(hot.join(F.broadcast(leaders), "gram").select(*both.columns))
        return staged(both.select("gram", "node", "n", "at", "leader", "nodes"), "shared"), heavy

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) that are as alike as the threshold. pairs: a written table."""
        percent = self.percent
        share = self.rows.sparkSession.sparkContext.broadcast
        ends = staged(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "ends")
        probes = _probes(self.heads, share(bitmap(ends, "node")))
        one = probes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("probe").alias("probe_a"))
        two = probes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("probe").alias("probe_b"))
        heavy_a, heavy_b = heavy_keys(pairs, "a"), heavy_keys(pairs, "b")
        both = spread_join(spread_join(pairs, one, "a", F.col("b"), heavy=heavy_a), two, "b", F.col("a"), heavy=heavy_b)
        left = staged(_near(both, percent), "pairs")
        sides = left.select(F.col("a").alias("node"), F.lit(True).alias("as_a")).unionByName(left.select(F.col("b").alias("node"), F.lit(False).alias("as_a")))
        sides = sides.groupBy("node").agg(F.max("as_a").alias("as_a"), F.max(~F.col("as_a")).alias("as_b"))
        spokesmen = staged(self.classes.join(sides, "node").where("id IS NOT NULL").select("id", "as_a", "as_b"), "spokesmen")
        as_a, as_b = (share(bitmap(spokesmen.where(side), "id")) for side in ("as_a", "as_b"))
        parts = staged(_fragments(self.rows, self.size, self.sketch, self.cuts, as_a, as_b), "parts")
        if self.repeated:
            parts = staged(parts.dropDuplicates(["node", "part"]), "parts")
        one = parts.where("as_a").select(F.col("node").alias("a"), F.col("n").alias("n_a"), "part", F.col("grams").alias("grams_a"))
        two = parts.where("as_b").select(F.col("node").alias("b"), F.col("n").alias("n_b"), "part", F.col("grams").alias("grams_b"))
        whole = spread_join(left, one, "a", F.col("b"), heavy=heavy_a)
        each = spread_join(whole, two, "b", F.col("a"), also=("part",), heavy=heavy_b).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("common"))
        both = each.groupBy("a", "b", "n_a", "n_b").agg(F.sum("common").alias("common"))
        return both.where(F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * percent).select("a", "b")


def similar(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id that links lead to.

    Sets are of n-grams of `size` words; documents link when 100 * intersection >= percent * union. A null or empty text
    has an empty set and no links: its component is its own id. Rows with equal sets link; repeated rows repeat in the
    result. A null id passes through and is smaller than no other; other columns are ignored; an empty table gives no
    rows. N-grams and sets are told apart by 64-bit hashes.
    """
    join = _Join(id_and_text(docs, id_col, text_col), size, percent)
    (shared, heavy), lead = join.shared(), F.col("leader")
    pairs = shared.where((F.col("node") != lead["node"]) & _may_link(F.col("n"), F.col("at"), lead["n"], lead["at"], percent))
    pairs = staged(pairs.select(F.col("node").alias("a"), lead["node"].alias("b")).distinct(), "pairs")
    found = components(staged(join.links(pairs), "links"))
    rest = staged(_unsettled(shared, heavy, found, pairs, percent), "rest")
    if not rest.isEmpty():
        more = staged(join.links(rest), "links")
        if not more.isEmpty():
            found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    rooted = staged(join.classes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("id").alias("component"))
    named = spread_join(rooted.select("node", "root"), smallest, "root", F.col("node")).select("node", "component")
    full = join.sets.where("node <> 0")
    rows = spread_join(full, named, "node", F.col("id")).select("id", "n", "component")
    rows = rows.unionByName(join.sets.where("node = 0").select("id", "n", F.col("id").alias("component")))
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _unsettled(shared: DataFrame, heavy: Heavy, found: DataFrame, done: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that share a first n-gram, may link, lie in different components and weren't compared.

    Classes of an n-gram meet only where their sizes are near: a class meets the smaller ones (of equal sizes the smaller
    nodes) in its own step of sizes, which grow by 100 / percent, and in the step before. Of n-grams with very many classes,
    parts of PAIRED classes meet all others in tasks of their own.
    """
    several = shared.where("nodes > 2").select("gram", "node", "n", "at", "nodes")
    grams = several.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least, most, own = F.min("root"), F.max("root"), Window.partitionBy("gram")
    mixed = grams.where(~heavy.holds("gram")).withColumns({"low": least.over(own), "high": most.over(own)})
    if heavy:  # fewer than joins.SHARE
        hot = grams.where(heavy.holds("gram"))
        mixed = mixed.unionByName(hot.join(F.broadcast(hot.groupBy("gram").agg(least.alias("low"), most.alias("high"))), "gram").select(*mixed.columns))
    # A hair wider than the ratio, so that rounding keeps sizes that may link within one step.
    step = F.floor(F.log(F.col("n")) / F.lit(float(np.log(100 / percent)) * (1 + 1e-6))) if percent < 100 else F.col("n")
    parts = (F.col("nodes") / PAIRED).cast("long") + 1
    grams = staged(mixed.where("low <> high").select("gram", "node", "n", "at", "root", step.cast("int").alias("step"), parts.cast("int").alias("parts")), "grams")
    dealt = grams.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts")
    other = grams.select("gram", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), F.col("root").alias("root_b"), F.explode(F.array(F.col("step"), F.col("step") + 1)).alias("step"), "parts")
    other = other.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    larger = (F.col("n") > F.col("n_b")) | ((F.col("n") == F.col("n_b")) & (F.col("node") > F.col("b")))
    fit = larger & (F.col("root") != F.col("root_b")) & _may_link(F.col("n"), F.col("at"), F.col("n_b"), F.col("at_b"), percent)
    pairs = dealt.join(other, ["gram", "step", "part"]).where(fit).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    return pairs.join(done.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")


def drop_similar(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, whose id is the smallest of its component; rows with a null id stay.

    An id of several rows goes only if all of them are in components of smaller ids. Null and empty texts stay; columns of
    any name pass through; an empty table gives no rows.
    """
    found = similar(docs, text_col=text_col, id_col=id_col, size=size, percent=percent)
    mark = free_name(docs, "gone")
    # Written first, so that its size is known when the join is planned.
    gone = staged(found.groupBy("doc_id").agg(F.max("component_id").alias("c")).where("c < doc_id").select(F.col("doc_id").alias(mark)), "gone")
    return docs.join(gone, F.col(id_col).cast("long") == F.col(mark), "left_anti")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) >= 3 THEN list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')))
                      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS grams FROM w
), n AS (
  SELECT doc_id, len(grams) AS n_shingles, md5(array_to_string(list_sort(grams), chr(10))) AS m FROM s
), classes AS (
  SELECT m, n_shingles, min(doc_id) AS c FROM n WHERE n_shingles > 0 GROUP BY m, n_shingles
), g AS (
  SELECT c, n_shingles AS k, md5_number(gram) AS gram FROM classes JOIN s ON s.doc_id = classes.c, unnest(s.grams) AS u(gram)
), links AS MATERIALIZED (
  SELECT a.c AS a, b.c AS b FROM g AS a JOIN g AS b ON a.gram = b.gram AND a.c <> b.c AND 100 * least(a.k, b.k) >= 90 * greatest(a.k, b.k)
  GROUP BY a.c, b.c, a.k, b.k HAVING 100 * count(*) >= 90 * (a.k + b.k - count(*))
), reach AS (
  SELECT c, c AS other FROM classes UNION SELECT reach.c, links.b FROM reach JOIN links ON links.a = reach.other
), named AS (
  SELECT c, min(other) AS component_id FROM reach GROUP BY c
)
SELECT n.doc_id, n.n_shingles, coalesce(named.component_id, n.doc_id) AS component_id
FROM n LEFT JOIN classes USING (m, n_shingles) LEFT JOIN named USING (c)
"""
