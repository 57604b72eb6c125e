"""Removal of repeated runs of lines, found by winnowing over line hashes.

Lines are split at newlines; lines without a word are blank and not counted. A run is `run` consecutive counted lines of
one document, or one counted line of `long` words or more; with `short`, as op9 and the pipeline have it, also any
fewer than `run` lines that have `long` words or more together, so no repeat of so many words stays. Every line of a run that also starts earlier (smaller
document id, or the same document and an earlier line) goes, with the blank lines after it. Repeats of fewer lines and
words than that stay.

Fingerprints: in each run, of `run` lines or fewer, the line of the smallest hash (the rightmost of equals). Equal
stretches select equal lines, so runs that repeat always share a fingerprint. Fingerprints that occur
twice are joined by hash and extended both ways: the runs around them are compared by 128-bit hashes, run by run.

At scale this uses the packed exchange of substring_dedup: a line that a third of all documents share costs one entry a
map chunk, buckets have bounded size, and only lines near repeated fingerprints are compared.

Defined cases: a null text stays null (no lines), an empty one empty; rows with a null id are kept as they are; rows
that share an id count as one document at one place, so equal rows don't remove each other; an empty table gives an
empty result; other columns pass through, those named n_lines or n_removed are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .common import by_size, byte_texts, tidy
from .substring_dedup import CHUNK_BYTES, _flushed, bucket_bits, repeats

RUN, LONG = 3, 50


class Lines:
    """Counted lines of several texts: their hashes, words and, for text t, numbers first[t]..first[t+1]."""

    def __init__(self, texts: list[bytes]) -> None:
        words = kernel.words(texts)
        raw = np.frombuffer(words.data, np.uint8)
        ends = np.flatnonzero(raw == 10)
        starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        n = np.searchsorted(words.starts, ends) - np.searchsorted(words.starts, starts)
        begin = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))
        self.counted = n > 0  # of all lines
        self.all_first = np.searchsorted(starts, begin)
        starts, ends, self.words = starts[self.counted], ends[self.counted], n[self.counted]
        self.lines = kernel.Words(words.data, starts, ends, begin)
        self.hashes = self.lines.hashes()
        self.first = np.searchsorted(starts, begin)
        self.text_of = np.repeat(np.arange(len(texts)), np.diff(self.first))


def minima(h: np.ndarray, first: np.ndarray, run: int, among: np.ndarray | None = None) -> np.ndarray:
    """Which lines are the smallest, the rightmost of equals, in some stretch of run lines of one text; among: which stretches count."""
    inside = kernel.inside(first, run, len(h))
    ok = np.flatnonzero(inside if among is None else inside & among)
    out = np.zeros(len(h), bool)
    if len(ok):
        stretch = np.stack([h[ok + i] for i in range(run - 1, -1, -1)])
        out[ok + run - 1 - np.argmin(stretch, axis=0)] = True
    return out


def _full(lines: Lines, n: int, run: int, long: int) -> np.ndarray | None:
    """Which stretches of n lines are runs: all if n is run, those of long words or more if it is less."""
    total = np.concatenate(([0], np.cumsum(lines.words)))
    return None if n == run else total[n:] - total[:-n] >= long


def _lengths(run: int, short: bool) -> list[int]:
    """How many lines runs have."""
    return [*range(1, run + 1)] if short else sorted({1, run})


def _fingerprints(run: int, long: int, short: bool, bits: int):
    def steps(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in by_size(batches, "body", CHUNK_BYTES):
            lines = Lines(byte_texts(batch.column("body")))
            at = np.flatnonzero(np.logical_or.reduce([minima(lines.hashes, lines.first, n, _full(lines, n, run, long)) for n in _lengths(run, short)]))
            text = lines.text_of[at]
            yield lines.hashes[at], np.zeros(len(at), np.uint64), batch.column("id").to_numpy(zero_copy_only=False)[text], (at - lines.first[text]).astype(np.int32)

    return lambda batches: _flushed(steps(batches), bits)


def _runs(run: int, long: int, short: bool, bits: int):
    """Runs near repeated fingerprints. The place of a stretch of n lines is run times its first line, and n if less than run."""

    def steps(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in by_size(batches, "body", CHUNK_BYTES):
            lines, places = Lines(byte_texts(batch.column("body"))), batch.column("places")
            h, again, total = lines.hashes, lines.lines.hashes(1), len(lines.hashes)
            marked = np.zeros(total, bool)
            marked[np.repeat(lines.first[:-1], np.diff(places.offsets.to_numpy())) + places.flatten().to_numpy(zero_copy_only=False)] = True
            near = np.concatenate(([0], np.cumsum(marked)))
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for n in _lengths(run, short):
                size, full = max(0, total - n + 1), _full(lines, n, run, long)
                chosen = (near[np.arange(size) + n] > near[:size]) & kernel.inside(lines.first, n, total)
                at = np.flatnonzero(chosen if full is None else chosen & full)
                text = lines.text_of[at]
                yield kernel.windows(h, n, 2)[at], kernel.windows(again, n, 3)[at], ids[text], (run * (at - lines.first[text]) + n % run).astype(np.int32)

    return lambda batches: _flushed(steps(batches), bits)


def _kept(text_col: str, run: int):
    def one(text: bytes, places: np.ndarray, lines: Lines, i: int) -> tuple[bytes, int]:
        n = int(lines.first[i + 1] - lines.first[i])
        gone = np.zeros(n, bool)
        for size in range(1, run + 1):
            marks = np.zeros(max(0, n - size + 1), bool)
            marks[places[places % run == size % run] // run] = True
            gone |= kernel.covered(marks, size, n)
        counted = lines.counted[lines.all_first[i] : lines.all_first[i + 1]]
        before = np.cumsum(counted)  # counted lines up to each line; blank ones follow the last
        stays = ~np.concatenate(([False], gone))[before]
        return b"\n".join(compress(text.split(b"\n"), stays.tolist())), int(gone.sum())

    def run_(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, text_col, CHUNK_BYTES):
            places, column = batch.column("__line_places"), batch.column(text_col)
            texts = byte_texts(column)
            lines = Lines(texts)
            removed = [0] * len(texts)
            for i, own in enumerate(places):
                if own.is_valid and len(own.values):
                    texts[i], removed[i] = one(texts[i], own.values.to_numpy(), lines, i)
            valid = column.is_valid().to_pylist()
            kept = pa.array([x if ok else None for x, ok in zip(texts, valid, strict=True)], pa.binary()).cast(pa.string())
            names = [x for x in batch.schema.names if x != "__line_places"]
            columns = [kept if x == text_col else batch.column(x) for x in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(lines.first), pa.int64()), pa.array(removed, pa.int64())], [*names, "n_lines", "n_removed"])

    return run_


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, long: int = LONG, short: bool = False) -> DataFrame:
    """docs with repeated runs taken out of the text, n_lines (counted, before) and n_removed."""
    docs = docs.drop("n_lines", "n_removed")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    bits = bucket_bits(texts)
    removed = repeats(texts.where("id IS NOT NULL"), _fingerprints(run, long, short, bits), _runs(run, long, short, bits), bits).withColumnsRenamed({"id": "__line_id", "places": "__line_places"})
    if len(docs.columns) == 2:  # then both joins share the exchange of the texts
        known = texts.where("id IS NOT NULL").join(removed.withColumnRenamed("__line_id", "id"), "id", "left")
        out = known.select(*(F.col("id").cast(docs.schema[id_col].dataType).alias(c) if c == id_col else F.col("body").alias(c) for c in docs.columns), "__line_places")
    else:
        known = docs.where(F.col(id_col).isNotNull())
        out = known.join(removed, F.col(id_col).cast("long") == F.col("__line_id"), "left").drop("__line_id")
    out = out.union(docs.where(F.col(id_col).isNull()).withColumn("__line_places", F.lit(None).cast("array<int>")))
    return out.mapInArrow(tidy(_kept(text_col, run)), T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]))
