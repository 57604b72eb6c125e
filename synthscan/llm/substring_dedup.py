"""Removal of repeated word sequences, found with difference-cover anchors.

A window is `window` consecutive words of one document. Every word covered by a window whose word sequence also
starts earlier (smaller document id, or the same document and an earlier start) is removed.

Anchors: only positions p with p mod `period` in `cover` are hashed, over `window - period + 1` words. As the cover
is a difference cover, two equal windows at any two starts have an anchor at one common offset, so equal windows are
never missed. Anchors that occur twice are then extended to the full windows around them, which are compared by
128-bit hashes.

At scale: both comparisons send one packed row for each (map chunk, hash bucket), and send back one for each (hash
bucket, id bucket). A hash that recurs within a chunk is settled there: only its first place goes to the hash's bucket,
the others straight to the buckets of their ids. So a sequence that a third of all documents share costs its bucket one
entry a chunk. Buckets grow in number with the input, so a bucket's size is bounded, and each is a partition of its own.
The document shuffle is the same exchange in both joins, and Spark reuses it.

Defined cases: a null or empty text has no words, nothing removed and an empty kept text; texts shorter than a window
are kept whole; rows with a null id never match anything; rows that share an id count as one document at one place, so
equal rows don't remove each other; an empty table gives an empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import by_size, byte_texts, parts, text_bytes, tidy

WINDOW, PERIOD, COVER = 20, 13, (0, 1, 3, 9)
CHUNK_BYTES, FLUSH, BUCKET_BYTES = 2 << 20, 1 << 19, 16 << 20
#: Rows for hash buckets have all columns; rows for id buckets, which are numbered after those, have ids and starts alone.
PAYLOAD = "bucket int, hashes binary, again binary, ids binary, starts binary, repeated binary"
FOUND = "part int, ids binary, starts binary"
PLACES = "id long, places array<int>"


def check_cover(period: int, cover: tuple[int, ...]) -> None:
    """Every difference modulo the period is one of two cover positions; otherwise matches would be missed."""
    if {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError(f"{cover} is no difference cover modulo {period}")


def _pack(x: np.ndarray) -> bytes:
    """Differences with their bytes transposed: long runs of zeros, which the shuffle's codec shrinks."""
    return np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(kind).ravel(), dtype=kind)


def _groups(h: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal 128-bit hashes together and keeps the given order within them; where groups begin."""
    order = np.argsort(h, kind="stable")
    a, b = h[order], again[order]
    if len(a) and np.any((a[1:] == a[:-1]) & (b[1:] != b[:-1])):
        order = np.lexsort((again, h))
        a, b = h[order], again[order]
    return order, np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)


def _payloads(found: list[tuple[np.ndarray, ...]], bits: int) -> Iterator[pa.RecordBatch]:
    """The first place of each hash for the hash's bucket, and the places that follow it in this chunk for their ids' buckets."""
    h, again, ids, starts = (np.concatenate(x) for x in zip(*found, strict=True))
    by_place = np.lexsort((starts, ids))
    h, again, ids, starts = h[by_place], again[by_place], ids[by_place], starts[by_place]
    order, begins = _groups(h, again)
    lead = order[begins]
    sizes = np.diff(np.append(np.flatnonzero(begins), len(order)))
    first = np.zeros(len(h), bool)
    first[lead] = True
    same = np.repeat(lead, sizes)
    tied = np.zeros(len(h), bool)
    tied[order] = (ids[order] == ids[same]) & (starts[order] == starts[same])
    repeated = np.zeros(len(h), bool)
    repeated[lead] = sizes > 1
    bucket = (h >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(h), np.int32)
    at = np.flatnonzero(first)
    at = at[np.argsort(bucket[at], kind="stable")]
    rows = [
        (number, h[one].tobytes(), again[one].tobytes(), _pack(ids[one]), _pack(starts[one]), np.packbits(repeated[one]).tobytes())
        for number, one in enumerate(np.split(at, np.searchsorted(bucket[at], np.arange(1, 1 << bits)))) if len(one)
    ]
    more = _found(ids[~first & ~tied], starts[~first & ~tied], bits)
    rows += [(r["part"] + (1 << bits), None, None, r["ids"], r["starts"], None) for r in more.to_pylist()]
    names = [x.split()[0] for x in PAYLOAD.split(", ")]
    kinds = [pa.int32()] + [pa.binary()] * 5
    for row in rows:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)


def _found(ids: np.ndarray, starts: np.ndarray, bits: int) -> pa.Table:
    """Places dealt by their ids, packed."""
    part = (kernel.mix(ids.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(ids), np.int32)
    order = np.lexsort((starts, ids, part))
    part, ids, starts = part[order], ids[order], starts[order]
    numbers, begin = np.unique(part, return_index=True)
    slices = [slice(a, b) for a, b in zip(begin, np.append(begin, len(part))[1:], strict=True)]
    return pa.table({"part": pa.array(numbers, pa.int32()), "ids": pa.array([_pack(ids[x]) for x in slices], pa.binary()), "starts": pa.array([_pack(starts[x]) for x in slices], pa.binary())})


def _places(part: pa.Table) -> pa.Table:
    """A row for each id with all its places."""
    ids, starts = (np.concatenate([_unpack(x, kind) for x in part.column(name).to_pylist()]) for name, kind in (("ids", np.int64), ("starts", np.int32)))
    order = np.lexsort((starts, ids))
    ids, starts = ids[order], starts[order]
    begin = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    offsets = np.append(begin, len(ids)).astype(np.int32)
    return pa.table({"id": pa.array(ids[begin], pa.int64()), "places": pa.ListArray.from_arrays(pa.array(offsets), pa.array(starts, pa.int32()))})


def _compared(later_only: bool, bits: int):
    """Of a hash bucket: all places whose hash has two, or those of them that aren't the earliest; of an id bucket: all places."""

    def reduce(bucket: pa.Table) -> pa.Table:
        every = bucket.to_pylist()
        rows, known = [r for r in every if r["hashes"] is not None], [r for r in every if r["hashes"] is None]
        out_ids, out_starts = [_unpack(r["ids"], np.int64) for r in known], [_unpack(r["starts"], np.int32) for r in known]
        if rows:
            h = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows])
            again = np.concatenate([np.frombuffer(r["again"], np.uint64) for r in rows])
            ids = np.concatenate([_unpack(r["ids"], np.int64) for r in rows])
            starts = np.concatenate([_unpack(r["starts"], np.int32) for r in rows])
            repeated = np.concatenate([np.unpackbits(np.frombuffer(r["repeated"], np.uint8), count=len(r["hashes"]) // 8) for r in rows]).astype(bool)
            order, begins = _groups(h, again)
            sizes = np.diff(np.append(np.flatnonzero(begins), len(order)))
            several = np.repeat(sizes > 1, sizes)
            group = np.cumsum(begins)[several]
            order = order[several]
            if later_only:
                inner = np.lexsort((starts[order], ids[order], group))
                order, group = order[inner], group[inner]
                lead = order[np.searchsorted(group, group)]
                out = order[(ids[order] != ids[lead]) | (starts[order] != starts[lead])]
            else:
                out = kernel.distinct(np.concatenate((order, np.flatnonzero(repeated))))
            out_ids.append(ids[out])
            out_starts.append(starts[out])
        return _found(np.concatenate(out_ids), np.concatenate(out_starts), bits)

    return reduce


def in_partitions(sent: DataFrame, number: str, count: int, reduce, schema: str) -> DataFrame:
    """reduce of the rows with each number, every number below count in a partition of its own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = [b for b in batches if b.num_rows]
        if full:
            yield from reduce(pa.Table.from_batches(full)).to_batches()

    return sent.repartitionById(count, number).mapInArrow(tidy(run), schema)


def _flushed(steps: Iterable[tuple[np.ndarray, ...]], bits: int) -> Iterator[pa.RecordBatch]:
    """Payloads of (hashes, second hashes, ids, places) steps, gathered to chunks of bounded size."""
    found, n = [], 0
    for step in steps:
        found.append(step)
        n += len(step[0])
        if n >= FLUSH:
            yield from _payloads(found, bits)
            found, n = [], 0
    if n:
        yield from _payloads(found, bits)


def _anchors(window: int, period: int, cover: tuple[int, ...], bits: int):
    is_cover = np.isin(np.arange(period), cover)
    length = window - period + 1

    def steps(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in by_size(batches, "body", CHUNK_BYTES):
            words = kernel.words(byte_texts(batch.column("body")))
            total = len(words.starts)
            hashes = kernel.windows(words.hashes(), length)
            at = np.arange(len(hashes)) - np.repeat(words.first[:-1], np.diff(words.first))[: len(hashes)]
            long_enough = np.repeat(np.diff(words.first) >= window, np.diff(words.first))[: len(hashes)]
            chosen = np.flatnonzero(is_cover[at % period] & long_enough & kernel.inside(words.first, length, total))
            ids = batch.column("id").to_numpy(zero_copy_only=False)[words.text_of[chosen]]
            yield hashes[chosen], np.zeros(len(chosen), np.uint64), ids, at[chosen].astype(np.int32)

    return lambda batches: _flushed(steps(batches), bits)


def _extended(window: int, period: int, bits: int):
    """Hashes of all windows that hold an anchor which occurs twice."""

    def steps(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in by_size(batches, "body", CHUNK_BYTES):
            words = kernel.words(byte_texts(batch.column("body")))
            total, places = len(words.starts), batch.column("places")
            anchors = np.zeros(total, bool)
            own = np.diff(places.offsets.to_numpy())
            anchors[np.repeat(words.first[:-1], own) + places.flatten().to_numpy(zero_copy_only=False)] = True
            hashes = kernel.windows(words.hashes(), window)
            near = np.concatenate(([0], np.cumsum(anchors)))
            size = len(hashes)
            chosen = np.flatnonzero((near[np.minimum(np.arange(size) + period, total)] > near[:size]) & kernel.inside(words.first, window, total))
            text = words.text_of[chosen]
            ids = batch.column("id").to_numpy(zero_copy_only=False)[text]
            yield hashes[chosen], kernel.windows(words.hashes(1), window, seed=1)[chosen], ids, (chosen - words.first[text]).astype(np.int32)

    return lambda batches: _flushed(steps(batches), bits)


def _kept(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "body", CHUNK_BYTES):
            kept, n, removed = [], [], []
            places = batch.column("places")
            for text, own in zip(byte_texts(batch.column("body")), places, strict=True):
                words = text.split()
                n.append(len(words))
                if own.is_valid and len(own.values):
                    marks = np.zeros(max(0, len(words) - window + 1), bool)
                    marks[own.values.to_numpy()] = True
                    gone = kernel.covered(marks, window, len(words))
                    removed.append(int(gone.sum()))
                    words = compress(words, (~gone).tolist())
                else:
                    removed.append(0)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept_text"])

    return run


def bucket_bits(texts: DataFrame) -> int:
    return (parts(text_bytes(texts, "body"), BUCKET_BYTES) - 1).bit_length()


def repeats(known: DataFrame, anchors, extended, bits: int) -> DataFrame:
    """(id, places): the places of all windows that also start earlier, of texts (id, body).

    anchors and extended map texts to payloads; extended gets the places of anchors that occur twice, too.
    """

    def places(sent: DataFrame, later: bool) -> DataFrame:
        found = in_partitions(sent, "bucket", 2 << bits, _compared(later, bits), FOUND)
        return in_partitions(found, "part", 1 << bits, _places, PLACES)

    twice = places(known.mapInArrow(tidy(anchors), PAYLOAD), False)
    near = known.join(twice, "id").select("id", "body", "places")
    return places(near.mapInArrow(tidy(extended), PAYLOAD), True)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """One row per document: its id, n_words, n_removed, kept_text (the words left, joined by one space)."""
    check_cover(period, cover)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    bits = bucket_bits(texts)
    known = texts.where("id IS NOT NULL")
    removed = repeats(known, _anchors(window, period, cover, bits), _extended(window, period, bits), bits)
    out = known.join(removed, "id", "left").select("id", "body", "places")
    out = out.union(texts.where("id IS NULL").withColumn("places", F.lit(None).cast("array<int>")))
    return out.mapInArrow(tidy(_kept(window)), "id long, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)
