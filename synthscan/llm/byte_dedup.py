"""Removal of repeated byte strings, found by run-length indexes of the places where texts may agree.

A window is `window` consecutive bytes of one document. Every byte covered by a window that also starts earlier (smaller
document id, or the same document and an earlier start) is removed.

Anchors: of the `anchor`-byte strings in a window, the one of the smallest hash (the leftmost of equals) is its anchor. Equal
windows have equal anchors, so only windows whose anchor occurs twice can be repeats. Consecutive windows with the same
anchor make a segment. Segments go to buckets by their anchor; there a run-length index is built of groups of them, of
bounded size, and streamed for its matching statistics: stretches in which a window is found elsewhere, exactly. Of all
places of a window the first one stays.

At scale: anchors are compared first, by hash and place alone, in the packed exchange of substring_dedup; only segments of
repeated anchors are sent with their bytes. Equal segments of a map chunk are settled there: the first goes to the
bucket, the others are later repeats of it. So a passage that a third of all documents share costs its bucket an entry a
chunk. Where many different segments have one anchor, as at the ends of such a passage, the anchor is `hot`: its windows go
each to a bucket of its own hash instead, so no group of segments that must be indexed together is large. Hot anchors are
those with a share of 2^-20 of all segments or more, hence fewer than 2^20 of them, and 1,000 segments at least, where equal
ones of a chunk count once; their hashes are sent to all tasks. Buckets grow in number with the input.

Defined cases: a null or empty text has no bytes and an empty kept text; texts shorter than a window are kept whole; rows
with a null id never match anything; rows that share an id count as one document at one place, so equal rows don't remove
each other; an empty table gives an empty result; columns besides id and text are ignored. What is kept may end in the
middle of a character, so it is binary.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import by_size, byte_texts, stored, tidy
from .run_index import RunIndex, classes
from .substring_dedup import FOUND, PAYLOAD, PLACES, _compared, _flushed, _pack, _places, _unpack, bucket_bits, in_partitions

WINDOW, ANCHOR = 100, 32
CHUNK_BYTES, SEND_BYTES, GROUP_BYTES, HOT_LEAST, HOT_SHARE = 1 << 20, 24 << 20, 48 << 10, 1000, 1 << 20
SEGMENTS = "bucket int, keys binary, ids binary, starts binary, sizes binary, body binary"
RUNS = "part int, ids binary, starts binary, sizes binary"
U = np.uint64


def _minima(h: np.ndarray, n: int) -> np.ndarray:
    """For each stretch of n hashes, how far in its smallest is, the leftmost of equals; by the hashes' upper bits."""
    bits = int(n).bit_length()
    keys, have = (h >> U(32)).astype(np.uint32) >> np.uint32(bits) << np.uint32(bits), 1
    while have < n:  # the lower bits say how far in; ever longer stretches
        step = min(have, n - have)
        keys = np.minimum(keys[: len(keys) - step], keys[step:] + np.uint32(step))
        have += step
    return keys & np.uint32((1 << bits) - 1)


class Segments:
    """Segments of several texts: windows first[i]..last[i] (offsets in data) of text of[i] share an anchor, of hash keys[i]."""

    def __init__(self, texts: list[bytes], window: int, anchor: int) -> None:
        self.data = b"\n".join(texts) + b"\n"
        n, self.window = len(self.data), window
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.concatenate(([0], np.cumsum(sizes + 1)))
        count = np.maximum(0, sizes - window + 1)
        self.first = self.last = self.of = np.zeros(0, np.int64)
        self.keys = self.digests = np.zeros(0, U)
        if not count.any():
            return
        blocks, span = np.ndarray((n - 7,), "<u8", self.data, strides=(1,)), n - anchor + 1
        h = np.zeros(span, U)
        for i, at in enumerate([*range(0, anchor - 7, 8), *([anchor - 8] if anchor % 8 else [])]):
            h += blocks[at : at + span] * U(kernel._factors(64, 5)[i])
        off = _minima(h, window - anchor + 1)
        chosen = np.arange(len(off), dtype=np.int64 if n >> 31 else np.int32) + off.astype(np.int32)
        edges = np.concatenate((np.flatnonzero(chosen[1:] != chosen[:-1]) + 1, self.begin[:-1], self.begin[:-1] + count))
        edges = kernel.distinct(edges)
        of = np.searchsorted(self.begin, edges, side="right") - 1
        real = np.flatnonzero((of < len(texts)) & (edges < (self.begin[:-1] + count)[np.minimum(of, len(texts) - 1)]))
        self.first, self.last, self.of = edges[real], edges[real + 1] - 1, of[real]
        self.keys = kernel.mix(h[chosen[self.first]] + U(1))  # minima are small: buckets go by a hash of them
        digests, end = (self.last - self.first).astype(U), self.last + window - anchor
        for at in range(0, 2 * window - anchor, anchor):  # hashes of anchor bytes each that cover the segment
            digests = kernel.mix(digests * U(0x9E3779B97F4A7C15) + h[np.minimum(self.first + at, end)])
        self.digests = digests

    def starts(self) -> np.ndarray:
        return (self.first - self.begin[self.of]).astype(np.int32)


def _anchors(window: int, anchor: int, bits: int):
    """Places of anchors; a segment's place is its first window's start."""

    def steps(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in by_size(batches, "body", CHUNK_BYTES):
            s = Segments(byte_texts(batch.column("body")), window, anchor)
            yield s.keys, s.digests, batch.column("id").to_numpy(zero_copy_only=False)[s.of], s.starts()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _flushed(steps(batches), bits):  # a row for each different segment of a chunk; what differs is not asked later
            at = row.schema.get_field_index("again")
            yield row.set_column(at, "again", pa.array([x and bytes(len(x)) for x in row.column(at).to_pylist()], pa.binary()))

    return run


def _heavy(least: int):
    """Anchors of a bucket with so many segments, equal ones of a chunk counted once."""

    def reduce(bucket: pa.Table) -> pa.Table:
        rows = [x for x in bucket.column("hashes").to_pylist() if x is not None]
        keys, n = np.unique(np.concatenate([np.frombuffer(x, U) for x in rows]) if rows else np.zeros(0, U), return_counts=True)
        return pa.table({"key": pa.array(keys[n >= least].view(np.int64)), "n": pa.array(n[n >= least].astype(np.int64))})

    return reduce


def _marked(s: Segments, places: pa.Array) -> np.ndarray:
    """Which segments begin at one of their text's places."""
    own = np.diff(places.offsets.to_numpy())
    width = np.int64(1 << 32)
    listed = np.repeat(np.arange(len(own)), own) * width + places.flatten().to_numpy(zero_copy_only=False)
    return kernel.among(s.of * width + s.starts(), np.sort(listed))


def _candidates(window: int, anchor: int, hot: np.ndarray, bits: int):
    """Segments of repeated anchors by bucket, each once a chunk, and what the others repeat, by id."""

    def send(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, h, again, ids, starts, sizes = (np.concatenate([x[i] for x in found]) for i in range(6))
        bodies, begin = b"".join(x[6] for x in found), np.concatenate(([0], np.cumsum(sizes)))
        order = np.lexsort((starts, ids, again, h))
        same = (h[order][1:] == h[order][:-1]) & (again[order][1:] == again[order][:-1]) & (sizes[order][1:] == sizes[order][:-1])
        lead_at = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(order)), 0))
        lead, rest = order[lead_at], order
        later = rest[(lead != rest) & ((ids[rest] != ids[lead]) | (starts[rest] != starts[lead]))]
        yield from _runs(ids[later], starts[later], sizes[later] - window + 1, bits, SEGMENTS)
        own = order[np.concatenate(([True], ~same))]
        bucket = (keys[own] >> U(64 - bits)).astype(np.int32) if bits else np.zeros(len(own), np.int32)
        own = own[np.lexsort((keys[own], bucket))]
        bucket = (keys[own] >> U(64 - bits)).astype(np.int32) if bits else np.zeros(len(own), np.int32)
        for number, rows in zip(*_cuts(own, bucket), strict=True):
            body = b"".join([bodies[a:b] for a, b in zip(begin[rows].tolist(), begin[rows + 1].tolist(), strict=True)])
            columns = [pa.array([int(number)], pa.int32()), *(pa.array([x], pa.binary()) for x in (keys[rows].tobytes(), _pack(ids[rows]), _pack(starts[rows]), sizes[rows].astype(np.int32).tobytes(), body))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SEGMENTS.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for batch in by_size(batches, "body", CHUNK_BYTES):
            s = Segments(byte_texts(batch.column("body")), window, anchor)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            keep = _marked(s, batch.column("places"))
            burning = keep & kernel.among(s.keys, hot)
            plain = np.flatnonzero(keep & ~burning)
            first, last, of, keys = s.first[plain], s.last[plain], s.of[plain], s.keys[plain]
            at = np.flatnonzero(burning)
            each = s.last[at] - s.first[at] + 1
            single = np.repeat(s.first[at] - np.concatenate(([0], np.cumsum(each)[:-1]))[: len(each)], each) + np.arange(int(each.sum()))
            for low in range(0, max(1, len(single)), CHUNK_BYTES // window):  # windows of hot anchors, some at a time
                part = single[low : low + CHUNK_BYTES // window]
                owner = np.repeat(s.of[at], each)[low : low + len(part)]
                if low == 0:
                    first, last, of = np.concatenate((first, part)), np.concatenate((last, part)), np.concatenate((of, owner))
                    keys = np.concatenate((keys, np.zeros(len(part), U)))
                    own = len(plain)
                else:
                    first, last, of, keys, own = part, part, owner, np.zeros(len(part), U), 0
                ends = last + window
                h, again = kernel.spans(s.data, first, ends), kernel.spans(s.data, first, ends, 1)
                keys[own:] = again[own:]
                bodies = b"".join([s.data[a:b] for a, b in zip(first.tolist(), ends.tolist(), strict=True)])
                found.append((keys, h, again, ids[of], (first - s.begin[of]).astype(np.int32), ends - first, bodies))
                n += len(bodies) + 40 * len(keys)
                if n >= SEND_BYTES:
                    yield from send(found)
                    found, n = [], 0
        if n:
            yield from send(found)

    return run


def _cuts(rows: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """rows cut where the sorted keys change."""
    numbers, begin = np.unique(sorted_keys, return_index=True)
    return numbers, np.split(rows, begin[1:]) if len(rows) else []


def _runs(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bits: int, schema: str = RUNS) -> Iterator[pa.RecordBatch]:
    """Runs of removed windows, dealt by their ids; numbered after the buckets where they are sent beside segments."""
    part = (kernel.mix(ids.view(U)) >> U(64 - bits)).astype(np.int32) if bits else np.zeros(len(ids), np.int32)
    order = np.lexsort((starts, ids, part))
    for number, rows in zip(*_cuts(order, part[order]), strict=True):
        row = {"ids": _pack(ids[rows]), "starts": _pack(starts[rows].astype(np.int32)), "sizes": sizes[rows].astype(np.int32).tobytes()}
        name, number = ("part", int(number)) if schema == RUNS else ("bucket", int(number) + (1 << bits))
        kinds = [x.split() for x in schema.split(", ")]
        arrays = [pa.array([number if x == name else row.get(x)], pa.int32() if kind == "int" else pa.binary()) for x, kind in kinds]
        yield pa.RecordBatch.from_arrays(arrays, [x for x, _ in kinds])


def _indexed(window: int, bits: int):
    """Of a bucket of segments: the runs of windows that start earlier, too; runs sent along go on as they are."""

    def group(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bodies: list[bytes]) -> tuple[np.ndarray, ...]:
        order = np.lexsort((starts, ids))
        ids, starts, sizes = ids[order], starts[order], sizes[order]
        text = np.frombuffer(b"\0".join(bodies[i] for i in order.tolist()) + b"\0", np.uint8)
        begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        several, first = classes(RunIndex.built(text, begins, begins + sizes), window)
        of, lead = (np.searchsorted(begins, x, side="right") - 1 for x in (several, first))
        at, lead_at = several - begins[of] + starts[of], first - begins[lead] + starts[lead]
        gone = (ids[of] != ids[lead]) | (at != lead_at)
        own, at = ids[of[gone]], at[gone]
        new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)))) if len(at) else np.zeros(0, np.int64)
        return own[new], at[new], np.diff(np.append(new, len(at)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        out = [[_unpack(r["ids"], np.int64), _unpack(r["starts"], np.int32).astype(np.int64), np.frombuffer(r["sizes"], np.int32).astype(np.int64)] for r in rows if r["keys"] is None]
        rows = [r for r in rows if r["keys"] is not None]
        if rows:
            keys = np.concatenate([np.frombuffer(r["keys"], U) for r in rows])
            ids, starts, sizes = np.concatenate([_unpack(r["ids"], np.int64) for r in rows]), np.concatenate([_unpack(r["starts"], np.int32) for r in rows]).astype(np.int64), np.concatenate([np.frombuffer(r["sizes"], np.int32) for r in rows]).astype(np.int64)
            body = b"".join(r["body"] for r in rows)
            del rows
            begin = np.concatenate(([0], np.cumsum(sizes)))
            order = np.argsort(keys, kind="stable")
            edges = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
            upto = np.concatenate(([0], np.cumsum(sizes[order])))
            low = 0
            while low < len(edges):
                high = max(low + 1, int(np.searchsorted(upto[edges], upto[edges[low]] + GROUP_BYTES)))
                own = order[edges[low] : edges[high] if high < len(edges) else len(order)]
                if len(own) > 1:
                    out.append(group(ids[own], starts[own], sizes[own], [body[a:b] for a, b in zip(begin[own].tolist(), begin[own + 1].tolist(), strict=True)]))
                low = high
        if out:
            yield from _runs(*(np.concatenate(x) for x in zip(*out, strict=True)), bits)

    return run


def _merged(window: int):
    """A row for each id with the byte runs to remove, apart from each other."""

    def reduce(part: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        ids, starts, sizes = (np.concatenate(x) for x in zip(*((_unpack(r["ids"], np.int64), _unpack(r["starts"], np.int32).astype(np.int64), np.frombuffer(r["sizes"], np.int32).astype(np.int64)) for r in rows), strict=True))
        order = np.lexsort((starts, ids))
        ids, starts, ends = ids[order], starts[order], (starts + sizes + window - 1)[order]
        number = np.cumsum(np.concatenate(([False], ids[1:] != ids[:-1])))
        far = np.int64(1 << 33)
        reach = np.maximum.accumulate(ends + number * far)
        new = np.flatnonzero(np.concatenate(([True], (starts + number * far)[1:] > reach[:-1])))
        last = np.append(new[1:], len(ids)) - 1
        begins, ends, of = starts[new], (reach - number * far)[last], ids[new]
        own = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        offsets = pa.array(np.append(own, len(of)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (begins, ends)]
        return pa.table({"id": pa.array(of[own]), "begins": lists[0], "ends": lists[1]})

    return reduce


def _kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_size(batches, "body", CHUNK_BYTES):
        kept, n, removed, spans = [], [], [], []
        for text, begins, ends in zip(byte_texts(batch.column("body")), batch.column("begins").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            n.append(len(text))
            cuts = [(a, min(b, len(text))) for a, b in zip(begins or [], ends or [], strict=True) if a < len(text)]
            removed.append(sum(b - a for a, b in cuts))
            spans.append(len(cuts))
            kept.append(b"".join(text[a:b] for a, b in zip([0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(text)], strict=True)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])


def byte_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row per document: its id, n_bytes, n_removed, n_spans (runs removed), kept (the bytes left)."""
    if not 8 <= anchor <= window:
        raise ValueError("an anchor has 8 bytes at least and no more than a window")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    bits = bucket_bits(texts)
    known = texts.where("id IS NOT NULL")
    sent = stored(known.mapInArrow(tidy(_anchors(window, anchor, bits)), PAYLOAD), "anchors")
    total = sent.agg(F.sum(F.octet_length("hashes") / 8)).first()[0] or 0
    heavy = in_partitions(sent.where("hashes IS NOT NULL").select("bucket", "hashes"), "bucket", 1 << bits, _heavy(max(HOT_LEAST, int(total // HOT_SHARE))), "key long, n long")
    hot = np.sort(np.array([r.key for r in heavy.select("key").collect()], np.int64).view(U))  # fewer than HOT_SHARE
    found = in_partitions(sent, "bucket", 2 << bits, _compared(False, bits), FOUND)
    near = known.join(in_partitions(found, "part", 1 << bits, _places, PLACES), "id").select("id", "body", "places")
    segments = near.mapInArrow(tidy(_candidates(window, anchor, hot, bits)), SEGMENTS).repartitionById(2 << bits, "bucket")
    runs = segments.mapInArrow(tidy(_indexed(window, bits)), RUNS)
    removed = in_partitions(runs, "part", 1 << bits, _merged(window), "id long, begins array<int>, ends array<int>")
    out = known.join(removed, "id", "left").select("id", "body", "begins", "ends")
    none = F.lit(None).cast("array<int>")
    out = out.union(texts.where("id IS NULL").select("id", "body", none, none))
    return out.mapInArrow(tidy(_kept), "id long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", id_col)
