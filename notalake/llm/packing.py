"""Packing: vector bin packing of training pieces by the dot-product heuristic.

Every sequence has three limits at once: tokens, segments (pieces in it) and loss-bearing tokens. A
piece goes where it fits under all three. While a sequence is open, the next piece is the one whose
need, in shares of the limits, has the largest dot product with what the sequence has left, so the
scarcest room steers the choice. When nothing fits whole and cutting is allowed, a piece is cut to
fill what is left. A partition's last, part-filled sequence is cut into sequences whose lengths are
powers of two, which need no padding.

The work is one pass over each partition with a bounded pool of waiting pieces: no shuffle, no group,
and a lost task is repeated alone. Sequences are numbered by partition and place.

Defined results: null text is empty and still has its end id; equal rows are packed each on its own;
documents longer than a sequence give full sequences and a rest; an empty table gives no rows; other
columns are not used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .arrow_text import slices
from .common import table
from .registry import query
from .token_pieces import REMEMBERED, SLICE_BYTES, encoder, release

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, ids binary"


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 64
    loss_tokens: int = 1024
    pool: int = 1024  # pieces that wait at a time
    cut: bool = True  # pieces may be cut to fill a sequence

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss_tokens, self.pool) < 1:
            raise ValueError("every limit must be at least 1")


@dataclass
class Piece:
    """Some ids of one document. `loss` marks the loss-bearing ones."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    loss: np.ndarray
    doc_tokens: int

    def head(self, n: int) -> Piece:
        return Piece(self.doc_id, self.start, self.ids[:n], self.loss[:n], self.doc_tokens)

    def tail(self, n: int) -> Piece:
        return Piece(self.doc_id, self.start + n, self.ids[n:], self.loss[n:], self.doc_tokens)


class Packer:
    """Takes pieces, gives finished sequences (lists of pieces)."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.cap = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        self.slots: list[Piece | None] = [None] * (2 * limits.pool)
        self.need = np.full((2 * limits.pool, 3), np.inf)
        self.free = list(range(2 * limits.pool))
        self.waiting = 0
        self.room_for_loss = limits.loss_tokens >= limits.tokens

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Full-length parts leave at once; the rest waits until the pool is full."""
        while len(piece.ids):
            fit = self._fits(piece, self.cap)
            if fit < len(piece.ids) and not self.limits.cut:
                raise ValueError(f"document {piece.doc_id} has a piece over the limits and may not be cut")
            part = piece.head(fit)
            piece = piece.tail(fit)
            if fit == self.limits.tokens:
                yield [part]
                continue
            slot = self.free.pop()
            self.slots[slot] = part
            self.need[slot] = (fit, 1, int(part.loss.sum()))
            self.waiting += 1
            if self.waiting >= 2 * self.limits.pool:
                while self.waiting > self.limits.pool:
                    yield self._fill()

    def _fits(self, piece: Piece, left: np.ndarray) -> int:
        """How many of its first ids fit into what is left."""
        if left[1] < 1:
            return 0
        most = int(min(len(piece.ids), left[0]))
        if self.room_for_loss and left[2] >= most:
            return most
        return int(np.searchsorted(np.cumsum(piece.loss[:most]), left[2], "right"))

    def _take(self, slot: int) -> Piece:
        piece = self.slots[slot]
        self.slots[slot] = None
        self.need[slot] = np.inf
        self.free.append(slot)
        self.waiting -= 1
        return piece

    def _fill(self) -> list[Piece]:
        """One sequence from the waiting pieces."""
        left, out = self.cap.copy(), []
        scaled = self.need / self.cap
        while left[0] >= 1 and left[1] >= 1 and self.waiting:
            fits = (self.need <= left).all(axis=1)
            if not fits.any():
                if not self.limits.cut or not self._cut_into(out, left):
                    break
                scaled = self.need / self.cap
                continue
            score = np.where(fits, np.where(np.isinf(scaled), 0, scaled) @ (left / self.cap), -1.0)
            slot = int(np.argmax(score))
            left -= self.need[slot]
            scaled[slot] = np.inf
            out.append(self._take(slot))
        return out

    def _cut_into(self, out: list[Piece], left: np.ndarray) -> bool:
        """Fills what is left with the start of the longest piece that can give any; its rest keeps waiting."""
        for slot in np.argsort(np.where(np.isinf(self.need[:, 0]), -1, self.need[:, 0]))[::-1].tolist():
            piece = self.slots[slot]
            if piece is None:
                return False
            n = self._fits(piece, left)
            if n:
                part, rest = piece.head(n), piece.tail(n)
                out.append(part)
                left -= (n, 1, int(part.loss.sum()))
                self.slots[slot] = rest
                self.need[slot] = (len(rest.ids), 1, int(rest.loss.sum()))
                return True
        return False

    def finish(self) -> Iterator[list[Piece]]:
        """Everything that still waits; the last, part-filled sequence in lengths that are powers of two."""
        while self.waiting:
            sequence = self._fill()
            size = sum(len(p.ids) for p in sequence)
            if self.waiting or not self.limits.cut or size & (size - 1) == 0:
                yield sequence
                continue
            for bit in reversed(range(size.bit_length())):
                want, part = (1 << bit) & size, []
                while want:
                    take = min(want, len(sequence[0].ids))
                    part.append(sequence[0].head(take))
                    want -= take
                    sequence[0] = sequence[0].tail(take)
                    if not len(sequence[0].ids):
                        sequence.pop(0)
                if part:
                    yield part


def _rows(sequences: Iterator[list[Piece]], first: int, with_ids: bool, some: int = 4096) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in PIECE.split(", ")]
    kinds = [pa.int64()] * 8 + [pa.binary()]

    def batch(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    columns: list[list] = [[] for _ in names]
    for number, sequence in enumerate(sequences, first):
        offset = 0
        for p in sequence:
            raw = p.ids.astype("<u4").tobytes()
            row = (p.doc_id, p.start, len(p.ids), zlib.crc32(raw), p.doc_tokens, number, offset, int(p.loss.sum()), raw if with_ids else None)
            for column, value in zip(columns, row):
                column.append(value)
            offset += len(p.ids)
        if len(columns[0]) >= some:
            yield batch(columns)
            columns = [[] for _ in names]
    if columns[0]:
        yield batch(columns)


def _packed(pieces: Iterator[Piece], limits: Limits, with_ids: bool) -> Iterator[pa.RecordBatch]:
    packer = Packer(limits)

    def sequences() -> Iterator[list[Piece]]:
        for piece in pieces:
            yield from packer.add(piece)
        yield from packer.finish()

    yield from _rows(sequences(), TaskContext.get().partitionId() << 33, with_ids)


def pack(examples: DataFrame, limits: Limits, *, with_ids: bool = True) -> DataFrame:
    """Packs examples: doc_id long, ids array<int>, loss array<boolean> (null: all ids bear loss)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[Piece]:
            for batch in batches:
                for doc, ids, loss in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("loss")):
                    values = np.array(ids.as_py() or [], np.uint32)
                    marks = np.ones(len(values), bool) if loss.as_py() is None else np.array(loss.as_py(), bool)
                    if len(marks) != len(values):
                        raise ValueError(f"document {doc} has {len(values)} ids and {len(marks)} loss marks")
                    yield Piece(doc, 0, values, marks, len(values))

        yield from _packed(pieces(), limits, with_ids)

    return examples.select("doc_id", "ids", "loss").mapInArrow(run, PIECE)


def pack_documents(docs: DataFrame, tokenizer: str, cuts: str, end: int, limits: Limits, *, with_ids: bool = True, lean: bool = False) -> DataFrame:
    """Tokenizes and packs whole documents in one pass; every id bears loss.

    `lean` takes less memory for more time, and leaves none taken: for a job whose other stages run in
    the same workers. The rows are the same.
    """
    some, remembered = (SLICE_BYTES // 4, REMEMBERED // 3) if lean else (SLICE_BYTES, REMEMBERED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[Piece]:
            encode = encoder(tokenizer, cuts, remembered)
            for part in slices(batches, "text", some):
                ids, counts = encode(part.column("text"), end)
                edges = [0, *np.cumsum(counts).tolist()]
                every = np.ones(int(counts.max()), bool)
                for doc, a, b in zip(part.column("doc_id").to_pylist(), edges, edges[1:]):
                    yield Piece(doc, 0, ids[a:b], every[: b - a], b - a)

        yield from _packed(pieces(), limits, with_ids)
        if lean:
            release()

    return docs.select("doc_id", "text").mapInArrow(run, PIECE)


def _byte_packed(docs: DataFrame, with_ids: bool, lean: bool) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), "spaces", 0, Limits(), with_ids=with_ids, lean=lean)


def pack_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: the sequences' pieces with their ids, instead of the documents."""
    return _byte_packed(docs, True, True)


@query("op7_packing")
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return _byte_packed(table(spark, folder, "documents"), False, False).drop("ids", "loss_tokens")
