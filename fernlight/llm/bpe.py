"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming UTF-8 decoder.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours stay apart when their joined bytes are
merged. So after each byte there is one last token of the encoding of what has been read: the longest token ending here
that stays apart from the last token where it begins. The transducer's states are the longest suffixes that some token
may still continue; their failure transitions are determinised when first taken. Beside its state it holds the last
tokens at the boundaries within reach, at most as many as the longest token has bytes, and emits what all of those
boundaries share.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from .base import id_and_text, rows_of, slices
from .pieces import split

#: Pieces and pairs of tokens that a worker keeps; beyond, it starts afresh.
PIECES, PAIRS = 300_000, 1_000_000
#: Transitions beyond the vocabulary's own, likewise: 100 MB.
TRANSITIONS = 1_000_000
#: Bytes after which a long piece emits.
EMIT = 512


class Vocabulary:
    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.bytes = {i: b for b, i in self.ranks.items()}
        self.size = max(self.bytes) + 1
        self.plain = max(self.ranks[bytes([b])] for b in range(256)) < min(i for w, i in self.ranks.items() if len(w) > 1)
        self.trie: dict[int, int] = {}
        self.token, self.depth, self.edge = [-1], [0], [0]
        self._apart: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int]] = {}
        for word, i in self.ranks.items():
            if len(word) > 1 and self.merge(word) != [i]:
                continue  # no merges lead to it: only a whole piece can be this token
            node = 0
            for b in word:
                edge = node << 8 | b
                node = self.trie.get(edge, -1)
                if node < 0:
                    node = self.trie[edge] = len(self.token)
                    self.token.append(-1)
                    self.depth.append(self.depth[edge >> 8] + 1)
                    self.edge.append(edge)
            self.token[node] = i

    def merge(self, word: bytes, down_to: int = 1) -> list[int]:
        """Merges the neighbours of lowest rank, the leftmost first, until none is in the vocabulary."""
        parts = [word[i : i + 1] for i in range(len(word))]
        ranks = self.ranks
        while len(parts) > down_to:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made this one."""
        found = self._halves.get(token)
        if found is None:
            found = self._halves[token] = tuple(self.merge(self.bytes[token], 2))
        return found

    def apart(self, left: int, right: int) -> bool:
        """Whether the two stay themselves side by side.

        Takes back the merges next to the seam, the latest first: they would have joined if the pair at the seam came
        before the merge that was taken back. Of equal ranks the one further left comes first.
        """
        key = left * self.size + right
        found = self._apart.get(key)
        if found is not None:
            return found
        if len(self._apart) > PAIRS:
            self._apart.clear()
        if self.plain:
            ranks, text, following, found = self.ranks, self.bytes, self.size, True
            while found:
                found = ranks.get(text[left] + text[right], following) >= following
                if left > right and len(text[left]) > 1:
                    following, left = left, self.halves(left)[1]
                elif len(text[right]) > 1:
                    following, right = right + 1, self.halves(right)[0]
                elif len(text[left]) > 1:
                    following, left = left, self.halves(left)[1]
                else:
                    break
        else:
            found = self.merge(self.bytes[left] + self.bytes[right]) == [left, right]
        self._apart[key] = found
        return found


class Transducer:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.reset()

    def reset(self) -> None:
        """Only what the vocabulary holds: failures and endings are of its states, so that they stay bounded."""
        self.goto = dict(self.vocabulary.trie)
        self.fail: dict[int, int] = {0: 0}
        self.ends: dict[int, tuple] = {0: ()}

    def follow(self, node: int, byte: int) -> int:
        """The state after a byte, determinised on first use."""
        key = node << 8 | byte
        found = self.goto.get(key)
        if found is None:
            found = self.goto[key] = self.follow(self.failure(node), byte) if node else 0
        return found

    def failure(self, node: int) -> int:
        found = self.fail.get(node)
        if found is None:
            parent, byte = self.vocabulary.edge[node] >> 8, self.vocabulary.edge[node] & 255
            found = self.fail[node] = self.follow(self.failure(parent), byte) if parent else 0
        return found

    def endings(self, node: int) -> tuple:
        """Tokens that end here with their lengths, longest first."""
        found = self.ends.get(node)
        if found is None:
            own = self.vocabulary.token[node]
            found = self.endings(self.failure(node))
            if own >= 0:
                found = ((own, self.vocabulary.depth[node]), *found)
            self.ends[node] = found
        return found

    def run(self, word: bytes) -> list[int]:
        if len(self.goto) > len(self.vocabulary.trie) + TRANSITIONS:
            self.reset()
        goto, ends, size, known, apart = self.goto, self.ends, self.vocabulary.size, self.vocabulary._apart, self.vocabulary.apart
        node, at, base, out = 0, 0, 0, []
        last, width = [-1], [0]  # of each boundary since the last emission
        for b in word:
            key = node << 8 | b
            node = goto[key] if key in goto else self.follow(node, b)
            at += 1
            for token, n in ends[node] if node in ends else self.endings(node):
                before = at - n - base
                if before < 0:
                    continue
                left = last[before]
                if left < 0 or (known[left * size + token] if left * size + token in known else apart(left, token)):
                    last.append(token)
                    width.append(n)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            if at - base >= EMIT:
                base = self.emit(at, base, self.vocabulary.depth[node], last, width, out)
        self.emit(at, base, 0, last, width, out)
        return out

    def emit(self, at: int, base: int, reach: int, last: list[int], width: list[int], out: list[int]) -> int:
        """Emits up to the boundary that all boundaries within reach come through, and forgets what lies before it."""
        live = {*range(max(base, at - reach), at + 1)}
        while len(live) > 1:
            latest = max(live)
            live.remove(latest)
            live.add(latest - width[latest - base])
        (to,) = live
        path, here = [], to
        while here > base:
            path.append(last[here - base])
            here -= width[here - base]
        out += reversed(path)
        del last[: to - base], width[: to - base]
        return to


class Encoder(dict):
    """Piece of a text -> its ids."""

    def __init__(self, path: str):
        super().__init__()
        self.vocabulary = Vocabulary(path)
        self.transducer = Transducer(self.vocabulary)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= PIECES:
            self.clear()
        word = piece.encode()
        whole = self.vocabulary.ranks.get(word)
        found = self[piece] = tuple(self.transducer.run(word)) if whole is None else (whole,)
        return found

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, split(text))))


#: Well-formed UTF-8: first byte's range -> ranges of the second byte and number of bytes (fixed values of the standard).
_LEADS = (
    (0x00, 0x7F, 0x00, 0x00, 1),
    (0xC2, 0xDF, 0x80, 0xBF, 2),
    (0xE0, 0xE0, 0xA0, 0xBF, 3),
    (0xE1, 0xEC, 0x80, 0xBF, 3),
    (0xED, 0xED, 0x80, 0x9F, 3),
    (0xEE, 0xEF, 0x80, 0xBF, 3),
    (0xF0, 0xF0, 0x90, 0xBF, 4),
    (0xF1, 0xF3, 0x80, 0xBF, 4),
    (0xF4, 0xF4, 0x80, 0x8F, 4),
)
_LEAD = {b: (low, high, n) for first, last, low, high, n in _LEADS for b in range(first, last + 1)}


def utf8_step(pending: bytes, data: bytes) -> tuple[bytes, bytes]:
    """Feeds data to a decoder that holds `pending`; gives whole characters and what is pending now.

    Ill-formed sequences become U+FFFD, one for each maximal part that could have begun a character.
    """
    out, held = bytearray(), bytearray(pending)
    for b in data:
        while True:
            if not held:
                if b not in _LEAD:
                    out += b"\xef\xbf\xbd"
                elif _LEAD[b][2] == 1:
                    out.append(b)
                else:
                    held.append(b)
                break
            low, high, n = _LEAD[held[0]]
            if (low if len(held) == 1 else 0x80) <= b <= (high if len(held) == 1 else 0xBF):
                held.append(b)
                if len(held) == n:
                    out += held
                    held.clear()
                break
            out += b"\xef\xbf\xbd"  # the pending part ends here; b is looked at again
            held.clear()
    return bytes(out), bytes(held)


class Decoder:
    """Ids in, UTF-8 out as soon as characters are whole. Transitions are kept by token."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.whole: dict[int, bytes] = {}
        self.steps: dict[tuple[bytes, int], tuple[bytes, bytes]] = {}
        for i, b in vocabulary.bytes.items():
            out, held = utf8_step(b"", b)
            if out == b and not held:
                self.whole[i] = b
        self.pending = b""

    def feed(self, ids: list[int]) -> bytes:
        if not self.pending:
            parts = list(map(self.whole.get, ids))
            if None not in parts:
                return b"".join(parts)
        out = []
        for i in ids:
            key = (self.pending, i)
            step = self.steps.get(key)
            if step is None:
                if len(self.steps) > PAIRS:
                    self.steps.clear()
                known = self.vocabulary.bytes.get(i)
                # An id that there isn't ends what is pending and is one ill-formed character itself.
                step = self.steps[key] = (b"\xef\xbf\xbd" * (1 + bool(self.pending)), b"") if known is None else utf8_step(self.pending, known)
            out.append(step[0])
            self.pending = step[1]
        return b"".join(out)

    def start(self) -> None:
        """Forgets what an interrupted text left."""
        self.pending = b""

    def end(self) -> bytes:
        """What is still pending can't become a character."""
        left, self.pending = self.pending, b""
        return b"\xef\xbf\xbd" if left else b""


_ENCODERS: dict[str, tuple[Encoder, Decoder]] = {}


def codec(path: str) -> tuple[Encoder, Decoder]:
    if path not in _ENCODERS:
        encoder = Encoder(path)
        _ENCODERS[path] = encoder, Decoder(encoder.vocabulary)
    return _ENCODERS[path]


def _vocabulary(path: str | None) -> str:
    return path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encode(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of every row. A null text counts as empty and has no ids; a null id passes through."""
    path, schema = _vocabulary(vocabulary), pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = codec(path)
        for batch in slices(batches):
            yield rows_of({"doc_id": batch.column("id").to_pylist(), "ids": [encoder.encode(t) for t in batch.column("text").to_pylist()]}, schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, *, ids_col: str = "ids", id_col: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """doc_id and text of every row; null or empty ids give an empty text, ill-formed bytes U+FFFD.

    An id that the vocabulary lacks, or a null in place of one, is U+FFFD too. Null doc_ids and repeated rows pass through;
    an empty table gives no rows.
    """
    from pyspark.sql import functions as F

    path, schema = _vocabulary(vocabulary), pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = codec(path)
        decoder.start()
        for batch in slices(batches):
            texts = [(decoder.feed(i or []) + decoder.end()).decode() for i in batch.column("ids").to_pylist()]
            yield rows_of({"doc_id": batch.column("id").to_pylist(), "text": texts}, schema)

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of the ids and of what they decode to, in one pass.

    A null text counts as empty: no ids, and the digests of nothing. Null ids and repeated rows pass through; other
    columns are ignored; an empty table gives no rows; long texts are encoded whole.
    """
    path = _vocabulary(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = codec(path)
        decoder.start()
        names = [str(i) for i in range(encoder.vocabulary.size)].__getitem__
        for batch in slices(batches):
            n, ids_sha, text_sha = [], [], []
            for text in batch.column("text").to_pylist():
                ids = encoder.encode(text)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(names, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoder.feed(ids) + decoder.end()).hexdigest())
            yield rows_of({"doc_id": batch.column("id").to_pylist(), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}, schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
