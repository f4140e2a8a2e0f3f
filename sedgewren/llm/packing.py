"""Hierarchical packing of token sequences into several context sizes.

A document's tokens are cut into full windows of the longest size; what remains is routed to the smallest context size
that holds it and waits in that size's pool. A pool that is full closes a window of its own size, begun by its oldest
piece: the gap is filled from the same and ever shorter tiers, best fit first, and at last by cutting a piece to the gap.
A tier lends to longer ones no more than it packs itself, so windows of every size come about. At the end of a partition the longest windows are closed first; the sizes are powers of two, so only the last sequence of
a partition is padded. Closed sequences are dealt into step groups of like cost.

Each partition packs its own documents in one pass with a bounded pool, so nothing is shuffled and a lost task is simply
run again, with the same result for the same input partition.

Defined results: a null text counts as empty and packs as the end id alone; every id lies in exactly one piece. Repeated
rows are packed each by itself. Very long texts are encoded whole, whatever they consist of. Pieces of equal length wait and
leave in the order they came. Other columns aren't read; an empty table packs to none.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from sedgewren.llm.bpe import byte_alphabet
from sedgewren.llm.common import prepare, schema_of, tidy
from sedgewren.session import table

#: Context sizes, longest first; all powers of two.
SIZES = (1024, 512, 256, 128, 64)
END = 0
#: Pieces that wait for a window, at most (an equal share for each size), and sequences that are dealt into step groups at once.
POOL, DEAL, GROUP = 256, 64, 8

DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Piece:
    """Ids of one document from a place on."""

    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def __len__(self) -> int:
        return len(self.ids)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:n], self.total), Piece(self.doc, self.start + n, self.ids[n:], self.total)


class Packer:
    """Takes documents, gives sequences: lists of pieces with their tier."""

    def __init__(self, sizes: tuple[int, ...] = SIZES) -> None:
        self.sizes = sizes
        self.most = max(1, POOL // len(sizes))
        self.tiers: list[list[tuple[int, int, Piece]]] = [[] for _ in sizes]  # waiting pieces of each size, by length
        self.lent, self.packed = [0] * len(sizes), [0] * len(sizes)  # ids that each size gave to longer windows, and closed
        self.ending = False
        self.n = 0

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple[int, list[Piece]]]:
        top, total = self.sizes[0], len(ids)
        full = total // top * top
        for at in range(0, full, top):
            yield top, [Piece(doc, at, ids[at : at + top], total)]
        if total == full:
            return
        self._wait(Piece(doc, full, ids[full:], total))
        while (t := next((k for k, pool in enumerate(self.tiers) if len(pool) > self.most), None)) is not None:
            yield self._close(t)

    def _tier(self, n: int) -> int:
        """The smallest size that holds n ids."""
        return max(t for t, size in enumerate(self.sizes) if size >= n)

    def _wait(self, piece: Piece) -> None:
        self.n += 1
        insort(self.tiers[self._tier(len(piece))], (len(piece), self.n, piece), key=lambda x: x[:2])

    def _close(self, t: int) -> tuple[int, list[Piece]]:
        """Fills one window of tier t, begun by the tier's oldest piece: the longest piece of this or a shorter tier that
        fits, again and again, then a cut of the shortest of the shorter tiers, or else of the tier's own."""
        pool = self.tiers[t]
        piece = pool.pop(min(range(len(pool)), key=lambda i: pool[i][1]))[2]
        gap, pieces = self.sizes[t] - len(piece), [piece]
        lenders = [k for k in range(t, len(self.tiers)) if k == t or self.ending or self.lent[k] <= self.packed[k]]
        while gap:
            for k in lenders:
                if i := bisect_right(self.tiers[k], gap, key=lambda x: x[0]):
                    piece = self.tiers[k].pop(i - 1)[2]
                    break
            else:
                k = next((k for k in reversed(lenders) if self.tiers[k]), None)
                if k is None:
                    break
                piece, rest = self.tiers[k].pop(0)[2].cut(gap)
                self._wait(rest)
            if k != t:
                self.lent[k] += len(piece)
            pieces.append(piece)
            gap -= len(piece)
        self.packed[t] += self.sizes[t] - gap
        return self.sizes[t], pieces

    def finish(self) -> Iterator[tuple[int, list[Piece]]]:
        """Closes what is open, longest tier first; a last part window is cut into the shorter sizes."""
        self.ending = True
        while any(self.tiers):
            size, pieces = self._close(next(t for t, pool in enumerate(self.tiers) if pool))
            filled = sum(map(len, pieces))
            if filled == size:
                yield size, pieces
                continue
            for tier in self.sizes:
                while filled >= tier:
                    yield tier, self._take(pieces, tier)
                    filled -= tier
            if pieces:
                yield self.sizes[-1], pieces

    @staticmethod
    def _take(pieces: list[Piece], n: int) -> list[Piece]:
        out = []
        while n:
            piece = pieces.pop(0)
            if len(piece) > n:
                piece, rest = piece.cut(n)
                pieces.insert(0, rest)
            out.append(piece)
            n -= len(piece)
        return out


def deal(sequences: list[tuple[int, list[Piece]]], groups: int) -> list[int]:
    """A group for each sequence: costliest first, always to the group of least cost with room (cost: squared lengths)."""
    room = -(-len(sequences) // groups)
    cost, size, out = [0] * groups, [0] * groups, [0] * len(sequences)
    price = [sum(len(p) ** 2 for p in pieces) for _, pieces in sequences]
    for i in sorted(range(len(sequences)), key=lambda i: (-price[i], i)):
        k = min((g for g in range(groups) if size[g] < room), key=lambda g: (cost[g], g))
        out[i], cost[k], size[k] = k, cost[k] + price[i], size[k] + 1
    return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """The byte-level tokenizer of a vocabulary file, whose ids rise with the merge ranks, run by tiktoken. What its regular
    expressions have no stack for (very long white space) goes through the tokenizers library."""
    import regex
    import tiktoken
    from tokenizers import Tokenizer

    spec = json.loads(open(path, encoding="utf-8").read())
    of_char = {c: b for b, c in enumerate(byte_alphabet())}
    special = {a["content"]: a["id"] for a in spec["added_tokens"]}
    ranks = {bytes(of_char[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    coder = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    surrogate = regex.compile("[\ud800-\udfff]")
    library = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(path))

    def encode(text: str) -> np.ndarray:
        text = surrogate.sub("�", text)
        try:
            return coder.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return np.array(library().encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def pack(docs: DataFrame, path: str, sizes: tuple[int, ...] = SIZES, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece, see DDL."""
    prepare(docs.sparkSession)
    schema = schema_of(DDL)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path), Packer(sizes)
        base = TaskContext.get().partitionId() << 36
        closed: list[tuple[int, list[Piece]]] = []
        rows: list[tuple] = []
        counts = [0, 0]  # sequences and step groups so far

        def flush() -> None:
            groups = -(-len(closed) // GROUP)
            for (tier, pieces), group in zip(closed, deal(closed, groups), strict=True):
                offset = 0
                for p in pieces:
                    ids = np.ascontiguousarray(p.ids, "<u4")
                    rows.append((p.doc, p.start, len(p), zlib.crc32(ids), p.total, base + counts[0], offset, tier, base + counts[1] + group))
                    offset += len(p)
                counts[0] += 1
            counts[1] += groups
            closed.clear()

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
            rows.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text), np.uint32(end)) if text else np.array([end], np.uint32)
                for sequence in packer.add(doc, ids):
                    closed.append(sequence)
                    if len(closed) == DEAL:
                        flush()
            if rows:
                yield batch_of()
        for sequence in packer.finish():
            closed.append(sequence)
            if len(closed) == DEAL:
                flush()
        if closed:
            flush()
        if rows:
            yield batch_of()

    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
