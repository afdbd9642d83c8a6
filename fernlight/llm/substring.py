"""Substring deduplication with suffix automata of reference shards.

Every window of `size` words has an anchor, the word run of `GRAM` words in it whose hash is smallest; consecutive
windows with one anchor make a piece. Windows with the same words have the same anchor, so only pieces with the same
anchor can share one. First the pieces are counted by anchor and content, combined where they lie. Of the anchors that
lie in several documents one document for each kind of piece sends the words; shards of anchors build a suffix automaton
of their pieces, whose states know the smallest document they occur in, and every kind of piece is streamed through it:
where the matching statistic reaches `size` words, the state gives the window's first document. Every window that occurs
in two documents is settled in this way. An anchor with very many kinds of pieces has several shards, to which its windows
are dealt. Shards are sent to the pieces that can match rather than broadcast to all documents,
since all documents against all shards would grow with the square of the input. At last every document joins what is
known of its pieces and drops the words of windows that occur in a smaller document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import id_and_text, rows_of, slices, staged
from .hashing import Powers, bitmap, hashed_words, in_bitmap, mix
from .joins import spread_join

GRAM = 6
#: Words of pieces from which one automaton takes no further anchor (a few thousand states stay in a core's cache), and
#: pieces that are combined before they are sent.
SHARD_WORDS, COMBINED = 2_000, 1_000_000
#: Texts whose pieces are found at once: their arrays stay in a core's cache.
TEXTS = 64
#: Bits of a word's hash that automata tell words by: a window of 13 is told from others by 390, beside its anchor's 64.
SYMBOL = 30
#: Kinds of pieces of one anchor that one shard holds at most; and a bound on the anchors that have several shards.
KINDS, CROWDS = 2_000, 1 << 18
NONE = np.iinfo(np.int64).max
_B = 0x9E3779B97F4A7C15
_POWERS, _INVERSES = Powers(_B), Powers(pow(_B, -1, 1 << 64))


class Automaton:
    """A suffix automaton of several sequences; states know the smallest number of a sequence they occur in."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [NONE]
        self.last = 0

    def _state(self, length: int, link: int, edges: dict[int, int], first: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, p: int, q: int, symbol: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), self.first[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, symbols: list[int], owner: int) -> None:
        edges, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for s in symbols:
            q = edges[last].get(s, -1)
            if q >= 0:  # an earlier sequence had this already
                last = q if length[q] == length[last] + 1 else self._split(last, q, s)
                if owner < first[last]:
                    first[last] = owner
                continue
            now, p = len(edges), last
            edges.append({})
            link.append(0)
            length.append(length[last] + 1)
            first.append(owner)
            while p >= 0 and s not in edges[p]:
                edges[p][s] = now
                p = link[p]
            if p >= 0:
                q = edges[p][s]
                link[now] = q if length[q] == length[p] + 1 else self._split(p, q, s)
            last = now

    def close(self) -> None:
        """A state occurs wherever the states that link to it do."""
        link, first = self.link, self.first
        for s in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            if first[s] < first[link[s]]:
                first[link[s]] = first[s]

    def windows(self, symbols: list[int], size: int) -> list[int]:
        """For each window of `size` symbols the smallest sequence it occurs in, NONE where it occurs in none."""
        edges, link, length, first = self.next, self.link, self.length, self.first
        state, matched, out = 0, 0, []
        for s in symbols:
            while state and s not in edges[state]:
                state = link[state]
                matched = length[state]
            state = edges[state].get(s, 0)
            matched = matched + 1 if state else 0
            while state and length[link[state]] >= size:
                state = link[state]
                matched = length[state]
            out.append(first[state] if matched >= size else NONE)
        return out[size - 1 :]


class Pieces:
    """Pieces of several documents: document, first window, number of windows, anchor and content of each.

    All documents' words are one array, so that the work is done for many documents at once; windows that would reach
    from one document into the next are left out. Anchor and content together, 128 bits, name a kind of piece.
    """

    def __init__(self, texts: list[bytes], size: int):
        self.size = size
        self.hash, self.offset = hashed_words(texts)
        self.lengths = np.diff(self.offset)
        total = len(self.hash)
        n = total - size + 1
        if n <= 0:
            self.doc = self.at = self.count = self.anchor = self.content = np.zeros(0, np.int64)
            return
        owner = np.repeat(np.arange(len(texts)), self.lengths)
        inside = owner[:n] == owner[size - 1 :]
        grams = total - GRAM + 1
        best = self.hash[:grams].copy()
        for k in range(1, GRAM):
            best = mix(best) + self.hash[k : k + grams]
        best, place = mix(best), np.arange(grams)
        # The place of the smallest hash among each window's runs; the first of equal ones. Spans double until they reach.
        runs, span = size - GRAM + 1, 1
        while span < runs:
            step = min(span, runs - span)
            less = best[step:] < best[:-step]
            best, place = np.where(less, best[step:], best[:-step]), np.where(less, place[step:], place[:-step])
            span += step
        place[~inside] = -1
        first = np.flatnonzero(np.diff(place, prepend=-2))
        count = np.diff(first, append=n)
        some = inside[first]
        self.at, self.count = first[some], count[some]
        self.doc = owner[self.at]
        # A polynomial over 64 bits gives the content of any run of words.
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.hash) * _INVERSES(total))])
        end = self.at + self.count + size - 1
        content = (sums[end] - sums[self.at]) * _POWERS(total)[self.at]
        anchor = best[self.at]
        self.anchor = anchor.view(np.int64)
        self.content = mix(content + (end - self.at).astype(np.uint64) + mix(anchor)).view(np.int64)

    @property
    def start(self) -> np.ndarray:
        """First windows, counted within the documents."""
        return self.at - self.offset[self.doc]


def _pieces(batch: pa.RecordBatch, size: int) -> Pieces:
    return Pieces([t.encode() for t in batch.column("text").to_pylist()], size)


def _count(rows: DataFrame, size: int) -> DataFrame:
    """anchor, content, low, high, kinds: kinds of pieces of anchors that lie in several documents.

    Each kind has its smallest and its largest document, each anchor its number of kinds. One shuffle, by anchor; copies
    are combined before it, COMBINED pieces at a time, so that a common passage sends few rows.
    """
    schema = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("doc", pa.int64())])

    def combined(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        """Of copies only the smallest and the largest document matter."""
        anchor, content, doc = map(np.concatenate, zip(*held, strict=True))
        held.clear()
        order = np.lexsort((doc, content))
        anchor, content, doc = anchor[order], content[order], doc[order]
        new = np.ones(len(doc), bool)
        new[1:] = (content[1:] != content[:-1]) | (anchor[1:] != anchor[:-1])
        ends = new | np.append(new[1:], True)
        return pa.RecordBatch.from_arrays([pa.array(x[ends]) for x in (anchor, content, doc)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in slices(batches, TEXTS):
            found = _pieces(batch, size)
            held.append((found.anchor, found.content, batch.column("id").to_numpy()[found.doc]))
            n += len(found.doc)
            if n >= COMBINED:
                yield combined(held)
                n = 0
        if held:
            yield combined(held)

    dealt = rows.mapInArrow(run, "anchor long, content long, doc long").repartition("anchor")
    kinds = dealt.groupBy("anchor", "content").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    own = Window.partitionBy("anchor")
    kinds = kinds.select("*", F.count(F.lit(1)).over(own).alias("kinds"), F.min("low").over(own).alias("least"), F.max("high").over(own).alias("most"))
    return kinds.where("least <> most").drop("least", "most")


def _send(rows: DataFrame, size: int, wanted, copied) -> DataFrame:
    """anchor, content, doc, several, words of pieces that the first bitmap asks for; several: whether the second has it."""
    schema = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("doc", pa.int64()), ("several", pa.bool_()), ("words", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, more = np.frombuffer(wanted.value, np.uint8), np.frombuffer(copied.value, np.uint8)
        for batch in slices(batches, TEXTS):
            found = _pieces(batch, size)
            doc = batch.column("id").to_numpy()[found.doc]
            hit = np.flatnonzero(in_bitmap(some, found.content ^ doc))
            hit = hit[np.lexsort((found.content[hit], found.doc[hit]))]  # of a document's copies the first
            hit = hit[(np.diff(found.doc[hit], prepend=-1) != 0) | (np.diff(found.content[hit], prepend=0) != 0)]
            several = in_bitmap(more, found.content[hit])
            ends = np.cumsum(found.count[hit] + size - 1)
            at = np.arange(int(ends[-1]) if len(hit) else 0)
            at += np.repeat(found.at[hit] - np.append(0, ends[:-1])[: len(hit)], found.count[hit] + size - 1)
            words = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array((found.hash[at] >> np.uint64(64 - SYMBOL)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(found.anchor[hit]), pa.array(found.content[hit]), pa.array(doc[hit]), pa.array(several), words], schema=schema)

    return rows.mapInArrow(run, "anchor long, content long, doc long, several boolean, words array<int>")


_ANSWER = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("at", pa.int32()), ("doc", pa.int64()), ("several", pa.bool_()), ("first", pa.int64()), ("firsts", pa.list_(pa.int64()))])


def _match(sent: DataFrame, crowded: DataFrame, size: int, tasks: int) -> DataFrame:
    """anchor, content and first (of all windows) or firsts (one for each): pieces streamed through their shards' automata.

    A crowded anchor's pieces are taken apart into windows, which are dealt to its shards by a hash of their words, so that
    equal windows meet. What a shard holds comes sorted by anchor, kind and document: of a kind that several documents
    sent, the smallest one's counts. Anchors share an automaton until it holds SHARD_WORDS words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group, kind, words = None, None, 0

        def answers(out: list[tuple]) -> None:
            automaton = Automaton()
            for *_, doc, _, own in held:
                automaton.add(own, doc)
            automaton.close()
            for anchor, content, at, doc, several, own in held:
                firsts = automaton.windows(own, size)
                least = min(firsts)
                # Of a piece that no other document has only what is smaller elsewhere matters; of windows all are put together.
                if several or least < doc or at >= 0:
                    same = max(firsts) == least
                    out.append((anchor, content, at, doc, several, least if same else None, None if same else firsts))
            held.clear()

        def packed(out: list[tuple]) -> pa.RecordBatch:
            return rows_of({name: [r[k] for r in out] for k, name in enumerate(_ANSWER.names)}, _ANSWER)

        for batch in slices(batches, 4096):
            listed, out = batch.column("words"), []
            ends, flat = (listed.offsets.to_numpy() - listed.offsets[0].as_py()).tolist(), listed.flatten().to_numpy().tolist()
            for k, (*row, shard) in enumerate(zip(*(batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("anchor", "content", "at", "doc", "several", "shard")), strict=True)):
                if (row[0], shard) != group:
                    group, kind = (row[0], shard), None
                    if words >= SHARD_WORDS:
                        answers(out)
                        words = 0
                if (row[1], row[2]) != kind:
                    kind = (row[1], row[2])
                    held.append((*row, flat[ends[k] : ends[k + 1]]))
                    words += ends[k + 1] - ends[k]
            if out:
                yield packed(out)
        if held:
            answers(out := [])
            yield packed(out)

    some = not crowded.isEmpty()
    whole = F.array(F.struct(F.lit(-1).alias("at"), "words"))
    dealt = sent.withColumns({"at": F.lit(-1), "shard": F.lit(0).cast("long")})
    if some:  # one pass over what was sent, crowded or not
        windows = F.expr(f"transform(sequence(1, size(words) - {size - 1}), i -> struct(i - 1 AS at, slice(words, i, {size}) AS words))")
        dealt = sent.join(F.broadcast(crowded), "anchor", "left").select("anchor", "content", "doc", "several", "shards", F.inline(F.when(F.col("shards").isNull(), whole).otherwise(windows)))
        dealt = dealt.withColumn("shard", F.when(F.col("at") < 0, F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("words"), F.col("shards")))).drop("shards")
    dealt = dealt.repartition(tasks, "anchor", "shard").sortWithinPartitions("anchor", "shard", "content", "at", "doc")
    found = staged(dealt.mapInArrow(run, "anchor long, content long, at int, doc long, several boolean, first long, firsts array<long>"), "matched")
    if some:
        listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "first"))), lambda x: x["first"])
        merged = found.where("at >= 0").groupBy("anchor", "content", "doc", "several").agg(listed.alias("firsts")).where("several OR array_min(firsts) < doc")
        found = staged(found.where("at < 0").select("anchor", "content", "first", "firsts").unionByName(merged.select("anchor", "content", F.lit(None).cast("long").alias("first"), "firsts")), "answers")
    return found.select("anchor", "content", "first", "firsts")


def _ask(rows: DataFrame, size: int, wanted) -> DataFrame:
    """doc, n_words, kept_sha256 (null if pieces may repeat), packed text, and those pieces: anchor, content, windows."""
    piece = pa.struct([("anchor", pa.int64()), ("content", pa.int64()), ("start", pa.int32()), ("count", pa.int32())])
    schema = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("packed", pa.binary()), ("pieces", pa.list_(piece))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = np.frombuffer(wanted.value, np.uint8)
        for batch in slices(batches, TEXTS):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            found = Pieces(texts, size)
            hit = np.flatnonzero(in_bitmap(some, found.content))
            ends = np.searchsorted(found.doc[hit], np.arange(len(texts) + 1))
            columns = [found.anchor[hit], found.content[hit], found.start[hit].astype(np.int32), found.count[hit].astype(np.int32)]
            pieces = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(piece)))
            sha, packed = [], []
            for text, own in zip(texts, (ends[1:] > ends[:-1]).tolist(), strict=True):
                joined = b" ".join(text.split())
                sha.append(None if own else hashlib.sha256(joined).hexdigest())
                packed.append(zlib.compress(joined, 1) if own else None)
            arrays = [batch.column("id"), batch.column("row"), pa.array(found.lengths), pa.array(sha, pa.string()), pa.array(packed, pa.binary()), pieces]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, "doc long, row long, n_words long, sha string, packed binary, pieces array<struct<anchor:long,content:long,start:int,count:int>>")


def _cover(starts: list[int], size: int, n: int) -> np.ndarray:
    """Which of n words a window at one of the starts covers."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.array(starts, np.int64) + size, -1)
    return np.cumsum(change)[:n] > 0


def remove_repeats(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", size: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept of every row; kept (the remaining words, joined by one space) is
    null where it equals all words of the text.

    A word goes if a window of `size` words covers it whose words also begin somewhere in a document with a smaller id.
    Null and empty texts have no words. Rows with one id are one document's: none is smaller than the other; rows with a
    null id keep everything and nothing repeats them. Other columns are ignored; an empty table gives no rows.
    """
    rows = id_and_text(docs, id_col, text_col)
    share = docs.sparkSession.sparkContext.broadcast
    known = rows.where("id IS NOT NULL")
    answers = _settled(known, size)
    told = staged(_ask(rows, size, share(bitmap(answers, "content"))), "told")
    window = "filter(transform(sequence(0, count - 1), i -> if(coalesce(firsts[i], first) < doc, start + i, -1)), x -> x >= 0)"
    pieces = told.select("row", "doc", F.inline("pieces"))
    starts = spread_join(pieces, answers, "content", F.col("row"), also=("anchor",)).select("row", F.expr(window).alias("starts")).where("size(starts) > 0").groupBy("row").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    open_rows = told.where("sha IS NULL").select("row", "doc", "n_words", "packed").join(starts, "row", "left")
    closed = told.where("sha IS NOT NULL").select(F.col("doc").alias("doc_id"), "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept"))
    return closed.unionByName(_remove(open_rows, size))


def _settled(known: DataFrame, size: int) -> DataFrame:
    """anchor, content, first, firsts of the pieces that remove words from some document."""
    spark = known.sparkSession
    share = spark.sparkContext.broadcast
    shared = staged(_count(known, size), "pieces")
    asked = bitmap(shared.select(F.col("content").bitwiseXOR(F.col("low")).alias("k")), "k")
    copied = bitmap(shared.where("low < high"), "content")
    sent = _send(known, size, share(asked), share(copied))
    most = max(KINDS, shared.count() // CROWDS)  # so that crowded anchors are fewer than CROWDS
    crowded = staged(shared.where(F.col("kinds") > most).select("anchor", (F.col("kinds") / most).cast("long").alias("shards")).distinct(), "crowded")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return _match(sent, crowded.withColumn("shards", F.col("shards") + 1), size, tasks)


def _remove(rows: DataFrame, size: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            removed, sha, kept = [], [], []
            for packed, starts in zip(batch.column("packed").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                joined = zlib.decompress(packed)
                if starts:
                    words = joined.split(b" ")
                    gone = _cover(starts, size, len(words))
                    joined = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                    removed.append(int(gone.sum()))
                else:
                    removed.append(0)
                sha.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode() if starts else None)
            yield rows_of({"doc_id": batch.column("doc").to_pylist(), "n_words": batch.column("n_words").to_pylist(), "n_removed": removed, "kept_sha256": sha, "kept": kept}, schema)

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), win AS (
  SELECT doc_id, i, hash(array_to_string(words[i:i + 12], ' ')) AS h, md5(array_to_string(words[i:i + 12], ' ')) AS m FROM w, unnest(range(1, len(words) - 11)) AS r(i)
), least_doc AS (
  SELECT h, m, min(doc_id) AS d FROM win GROUP BY h, m
), gone AS (
  SELECT DISTINCT doc_id, i + k AS place FROM win JOIN least_doc USING (h, m), unnest(range(0, 13)) AS r(k) WHERE d < doc_id
), gone_list AS (
  SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id
)
SELECT w.doc_id, len(words) AS n_words, len(words) - len(kept) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM (SELECT w.*, CASE WHEN g.places IS NULL THEN words ELSE list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(g.places, i)), lambda i: words[i]) END AS kept FROM w LEFT JOIN gone_list g USING (doc_id)) AS w
"""
