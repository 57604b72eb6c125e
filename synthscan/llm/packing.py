"""Packing of documents into fixed-length token sequences, online and in bounded space.

Each map partition keeps `open_windows` open sequences. A document's ids (and an end id) are cut into whole sequences
as long as they fill them; the rest goes best-fit into an open sequence. When none has room and no more may be opened,
the fullest is topped up with the head of the rest and emitted, so sequences leave full. At the end of a partition its
open sequences are merged into full ones; the ids left over (less than one sequence a partition) go on, and the left-overs of
`merged` partitions at a time are merged likewise. What then remains is cut at powers of two, which need no padding.

Memory: the open sequences and one chunk of texts. Shuffled: only the left-overs, at most `length` ids a partition, in
groups of bounded size. Pieces are written to the shared folder before the merge, so texts are encoded once.

Defined cases: a null text counts as empty, an empty text is the end id alone; a null id is carried along; equal rows
are packed each; an empty table gives an empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, stored, tidy
from .tokens import encoder

LENGTH, END_ID, OPEN_WINDOWS, MERGED = 2048, 1, 32, 256
CHUNK_BYTES = 2 << 20
PIECE = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, part long, place long"
NAMES = [x.split()[0] for x in PIECE.split(", ")]
TYPES = [pa.binary() if x.endswith("binary") else pa.int64() for x in PIECE.split(", ")]


class Piece:
    """Some consecutive ids of a document."""

    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc: int | None, start: int, ids: np.ndarray, total: int) -> None:
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:n], self.total), Piece(self.doc, self.start + n, self.ids[n:], self.total)


def joined(pieces: Iterable[Piece], sizes: Iterator[int]) -> Iterator[list[Piece]]:
    """Sequences of just these sizes from the pieces in a row, as far as they go; the last may be short."""
    now, room = [], next(sizes)
    for piece in pieces:
        while len(piece.ids) >= room:
            head, piece = piece.cut(room)
            yield [*now, head]
            now, room = [], next(sizes)
        if len(piece.ids):
            now.append(piece)
            room -= len(piece.ids)
    if now:
        yield now


class Packer:
    """Places pieces; emit(pieces) is called for every full sequence."""

    def __init__(self, length: int, open_windows: int, emit) -> None:
        self.length, self.most, self.emit = length, open_windows, emit
        self.open: list[list[Piece]] = []
        self.room: list[int] = []

    def put(self, piece: Piece) -> None:
        while len(piece.ids) >= self.length:
            head, piece = piece.cut(self.length)
            self.emit([head])
        while n := len(piece.ids):
            fits = [r for r in self.room if r >= n]
            if fits:
                i = self.room.index(min(fits))
                rest = None
            elif len(self.open) < self.most:
                self.open.append([piece])
                self.room.append(self.length - n)
                return
            else:
                i = self.room.index(min(self.room))
                piece, rest = piece.cut(self.room[i])
            self.open[i].append(piece)
            self.room[i] -= len(piece.ids)
            if not self.room[i]:
                self.emit(self.open.pop(i))
                self.room.pop(i)
            if rest is None:
                return
            piece = rest

    def finish(self) -> list[Piece]:
        """Merge what is open; the pieces that don't fill a sequence."""
        order = sorted(range(len(self.open)), key=lambda i: self.room[i])

        def sizes() -> Iterator[int]:
            while True:
                yield self.length

        left: list[Piece] = []
        for window in joined((x for i in order for x in self.open[i]), sizes()):
            if sum(len(x.ids) for x in window) == self.length:
                self.emit(window)
            else:
                left = window
        self.open, self.room = [], []
        return left


class Rows:
    """Collects piece rows into record batches."""

    def __init__(self, with_ids: bool) -> None:
        self.rows: list[tuple] = []
        self.with_ids = with_ids

    def add(self, window: list[Piece], sequence: int) -> None:
        offset = 0
        for x in window:
            raw = x.ids.astype("<u4").tobytes()
            self.rows.append((x.doc, x.start, len(x.ids), zlib.crc32(raw), x.total, sequence, offset, raw if self.with_ids else None, None, None))
            offset += len(x.ids)

    def left(self, pieces: list[Piece], part: int) -> None:
        for i, x in enumerate(pieces):
            self.rows.append((x.doc, x.start, len(x.ids), None, x.total, None, None, x.ids.astype("<u4").tobytes(), part, i))

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [()] * len(NAMES)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, TYPES, strict=True)], NAMES)


def _pack(length: int, end_id: int, open_windows: int, vocabulary: str | None, with_ids: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, n = TaskContext.get().partitionId(), Rows(with_ids), 0

        def emit(window: list[Piece]) -> None:
            nonlocal n
            rows.add(window, (part << 32) + n)
            n += 1

        packer, encode = Packer(length, open_windows, emit), encoder(vocabulary).encode
        end = np.array([end_id], np.uint32)
        for batch in by_size(batches, "text", CHUNK_BYTES):
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = np.concatenate((encode(text or ""), end))
                packer.put(Piece(doc, 0, own, len(own)))
            if rows.rows:
                yield rows.take()
        rows.left(packer.finish(), part)
        yield rows.take()

    return run


def _merge(length: int, with_ids: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        pieces = [Piece(r["id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]) for r in table.sort_by([("part", "ascending"), ("place", "ascending")]).to_pylist()]
        total = sum(len(x.ids) for x in pieces)

        def sizes() -> Iterator[int]:
            left = total
            while left:
                size = length if left >= length else 1 << (left.bit_length() - 1)
                yield size
                left -= size
            yield length

        rows = Rows(with_ids)
        for i, window in enumerate(joined(pieces, sizes())):
            rows.add(window, (1 << 62) + (key[0].as_py() << 32) + i)
        return pa.Table.from_batches([rows.take()])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, open_windows: int = OPEN_WINDOWS, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, as little-endian unsigned 32-bit)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    packed = stored(texts.mapInArrow(tidy(_pack(length, end_id, open_windows, vocabulary, with_ids)), PIECE), "pieces")
    left = packed.where("part IS NOT NULL").withColumn("group", F.expr(f"part div {MERGED}"))
    merged = left.groupBy("group").applyInArrow(_merge(length, with_ids), PIECE)
    columns = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    return packed.where("part IS NULL").union(merged).select(F.col("id").alias(id_col), *columns)
