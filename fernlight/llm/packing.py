"""Sum-of-squares online packing of tokenised documents into fixed-length sequences.

Every partition packs its own rows in one streaming pass: no shuffle, and memory bounded by the open sequences.
A document is cut into whole sequences and a remainder; the remainder goes to the fill level that leaves the
smallest sum of squared counts of partially filled sequences, kept in a level array. Where that would open a sequence
beyond `open_limit`, the remainder is cut so that its first part closes a sequence of the fullest level, and its rest is
placed anew. At a partition's end the emptiest sequences are placed onto the fullest levels in the same way, until what
is left is cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .base import id_and_text, rows_of, slices
from .pieces import split

#: Pieces whose ids a worker keeps.
CACHE = 300_000
END = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


class TokenBytes(dict):
    """Piece of a text -> its ids as little-endian 32-bit integers.

    Ids are those of the tokenizer file. Where merging by rank is proven to give the same ids (see same_by_rank), single
    pieces are merged so, at a tenth of the time; otherwise the tokenizer itself encodes them.
    """

    def __init__(self, path: str, by_rank: bool):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = _ranked(_merges(path)[0]) if by_rank else None

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        if self.ranked:
            ids = self.ranked.encode_single_piece(piece.encode())
            found = self[piece] = struct.pack(f"<{len(ids)}I", *ids)
        else:
            found = self[piece] = self.whole(piece)
        return found

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.__getitem__, split(text)))


def _merges(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """The file's tokens that are bytes or made by merges, with their ids; and its merges, in order."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocab = model["vocab"]
    # Byte-level files write a byte as itself where it is printable, and the others as U+0100 onwards.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
    raw = lambda token: bytes(map(letters.__getitem__, token))
    pairs = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    made = {a + b for a, b in pairs}
    return {raw(t): i for t, i in vocab.items() if all(c in letters for c in t) and (len(t) == 1 or raw(t) in made)}, pairs


def _ranked(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("ranked", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})._core_bpe


def merged(word: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """Joins the neighbours whose token has the lowest rank, while that is below the given one."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def same_by_rank(path: str) -> bool:
    """Whether merging by rank, any two neighbours that make a token, gives the same ids as the file's list of merges.

    That is so if ids rise in the order of merges, every byte has an id, each token has one merge, and merging the bytes
    of a token by lower ranks alone ends with exactly the two halves of that merge: before two neighbours are joined, all
    joins of lower rank have been made within them, and none across their ends, so that they are these halves.
    """
    ranks, pairs = _merges(path)
    order = [ranks.get(a + b, -1) for a, b in pairs]
    if order != sorted(set(order)) or -1 in order or not all(bytes([b]) in ranks for b in range(256)):
        return False
    return all(merged(a + b, ranks, i) == [a, b] for (a, b), i in zip(pairs, order, strict=True))


_SAME: dict[str, bool] = {}
_TOKENS: dict[str, TokenBytes] = {}


def tokens(path: str, by_rank: bool | None = None) -> TokenBytes:
    """The file's encoder; the driver proves by_rank once and tells its workers."""
    if path not in _TOKENS:
        _TOKENS[path] = TokenBytes(path, _proven(path) if by_rank is None else by_rank)
    return _TOKENS[path]


def _proven(path: str) -> bool:
    if path not in _SAME:
        _SAME[path] = same_by_rank(path)
    return _SAME[path]


class SumOfSquares:
    """Packs pieces (doc_id, start, ids, doc_tokens) and yields closed sequences as lists of pieces."""

    def __init__(self, length: int, open_limit: int):
        self.length, self.open_limit = length, open_limit
        self.count = np.zeros(length + 1, np.int64)
        self.bins: list[deque] = [deque() for _ in range(length)]
        self.open = 0

    def level(self, size: int) -> int:
        """The level to put a piece on; 0 opens a sequence. Ties go to the fullest level."""
        top = self.length - size
        now, then = self.count[1 : top + 1], self.count[size + 1 : self.length + 1]
        change = 2 * (then - now) + 2
        change[-1:] -= 1  # a sequence that becomes full is no longer counted
        change = np.where(now > 0, change, np.iinfo(np.int64).max)
        if top == 0:
            return 0
        best = top - 1 - int(np.argmin(change[::-1]))
        return best + 1 if change[best] <= 2 * self.count[size] + 1 else 0

    def add(self, piece: tuple) -> Iterator[list[tuple]]:
        doc, start, ids, total = piece
        width = 4 * self.length
        whole = len(ids) // width * width
        for at in range(0, whole, width):
            yield [(doc, start + at // 4, ids[at : at + width], total)]
        rest = (doc, start + whole // 4, ids[whole:], total)
        while len(rest[2]):
            size = len(rest[2]) // 4
            level = self.level(size)
            if level or self.open < self.open_limit:
                yield from self.put(self.take(level) if level else [], level, rest)
                return
            rest = yield from self.close_fullest(rest)

    def take(self, level: int) -> list[tuple]:
        self.count[level] -= 1
        self.open -= 1
        return self.bins[level].popleft()

    def put(self, held: list[tuple], level: int, piece: tuple) -> Iterator[list[tuple]]:
        """Adds the piece to a sequence of this level."""
        held.append(piece)
        level += len(piece[2]) // 4
        if level == self.length:
            yield held
        else:
            self.bins[level].append(held)
            self.count[level] += 1
            self.open += 1

    def close_fullest(self, piece: tuple):
        """Puts what fits of the piece onto the fullest level; gives back its rest."""
        level = int(np.flatnonzero(self.count)[-1])
        doc, start, ids, total = piece
        n = min(len(ids) // 4, self.length - level)
        yield from self.put(self.take(level), level, (doc, start, ids[: 4 * n], total))
        return doc, start + n, ids[4 * n :], total

    def finish(self) -> Iterator[list[tuple]]:
        """Places the pieces of the emptiest sequences onto the fullest; cuts what then is left at powers of two."""
        while self.open > 1:
            for piece in self.take(int(np.flatnonzero(self.count)[0])):
                while len(piece[2]):
                    if not self.open:
                        yield from self.put([], 0, piece)
                        break
                    piece = yield from self.close_fullest(piece)
        queue = deque(p for level in self.bins for b in level for p in b)
        left = sum(len(p[2]) for p in queue) // 4
        while left:
            target = 1 << (left.bit_length() - 1)
            sequence, filled = [], 0
            while filled < target:
                doc, start, ids, total = queue.popleft()
                take = min(len(ids) // 4, target - filled)
                sequence.append((doc, start, ids[: 4 * take], total))
                filled += take
                if 4 * take < len(ids):
                    queue.appendleft((doc, start + take, ids[4 * take :], total))
            yield sequence
            left -= target


def pack(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", length: int = 2048, open_limit: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone; a null id passes through; repeated rows are packed each by itself; an
    empty table gives no rows; other columns are ignored. Long texts are cut into many sequences.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    by_rank = _proven(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = tokens(path, by_rank).encode, SumOfSquares(length, open_limit)
        number, end = TaskContext.get().partitionId() << 40, END.to_bytes(4, "little")
        out: list[tuple] = []

        def put(sequences: Iterator[list[tuple]]) -> None:
            nonlocal number
            for sequence in sequences:
                offset = 0
                for doc, start, ids, total in sequence:
                    n = len(ids) // 4
                    out.append((doc, start, n, zlib.crc32(ids), total, number, offset))
                    offset += n
                number += 1

        def rows() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * len(_ARROW)
            out.clear()
            return rows_of({n: list(c) for n, c in zip(_ARROW.names, cols, strict=True)}, _ARROW)

        for batch in slices(batches):
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text) + end
                put(packer.add((doc, 0, ids, len(ids) // 4)))
            yield rows()
        put(packer.finish())
        yield rows()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
