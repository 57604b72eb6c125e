"""Texts scored given another one each, under the word counts of the texts themselves, by chunks: no row stands for a word of a text.

A chunk holds, for each text, its distinct words, how often it and its source have each, and the source's size. It asks for each of its
distinct words once, in a row for each bucket of words with how often its texts have them; so counts are made where they are asked for.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.overlap import _SPACED
from ..plans.tables import stored
from . import chunked
from .chunked import LONGS, _flat, _lists, _mix, _values
from .perturbed import _Numbers

ARRAYS = ("sizes", "source_sizes", "at", "n", "own")
SLICE = 64


def _words(text: str | None) -> list[bytes]:
    """Those of functions.overlap.tokens."""
    return text.lower().encode(errors="replace").translate(_SPACED).split() if text else []


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row_id, source, target) as chunks."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    words, ids, found, size = _Numbers(), [], {x: [] for x in ARRAYS}, 0

    def chunk() -> pa.RecordBatch:
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        columns = [one(pa.array(found[x], pa.int32())) for x in ARRAYS]
        known = pa.array(list(words), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array([number]), one(pa.concat_arrays(ids)), one(known), *columns], ["chunk", "ids", "words", *ARRAYS])

    for batch in batches:
        for begin in range(0, batch.num_rows, SLICE):
            part = batch.slice(begin, SLICE)
            ids.append(part.column("row_id"))
            for source, target in zip(part.column("source").to_pylist(), part.column("target").to_pylist(), strict=True):
                mine, other = Counter(_words(target)), _words(source)
                theirs = Counter(other)
                found["sizes"].append(len(mine))
                found["source_sizes"].append(len(other))
                found["at"] += map(words.__getitem__, mine)
                found["n"] += mine.values()
                found["own"] += [theirs.get(x, 0) for x in mine]
                size += len(mine) + 1
            if size >= chunked.CHUNK:
                yield chunk()
                number, words, ids, found, size = number + 1, _Numbers(), [], {x: [] for x in ARRAYS}, 0
    if ids:
        yield chunk()


def _order(words: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The words' order by buckets, and their buckets in it."""
    bucket = (_mix(words) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def _asked(buckets: int):
    """A row for each bucket of a chunk: words, and how often the chunk's texts have them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, at, n = _values(batch, i, "words", "at", "n")
                c = np.bincount(at, n, len(words)).astype(np.int64)
                order, bucket = _order(words, buckets)
                numbers, first = np.unique(bucket, return_index=True)
                sizes = np.diff(np.append(first, len(bucket)))
                chunk = np.full(len(numbers), batch.column("chunk")[i].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(numbers), _lists(words[order], sizes, LONGS), _lists(c[order], sizes, LONGS)], ["chunk", "bucket", "w", "n"])

    return run


def _answers(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Of a bucket, a row for each chunk: its words' counts; the first one has the numbers of different words and of all, too."""
    words, at = np.unique(_flat(rows.column("w")), return_inverse=True)
    c = np.bincount(at, _flat(rows.column("n")), len(words)).astype(np.int64)
    size, total = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
    size[0], total[0] = len(words), c.sum()
    return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "c": _lists(c[at], rows.column("w").combine_chunks().value_lengths().to_numpy(), LONGS), "size": size, "total": total})


def _texts(buckets: int, k: float, total: float):
    """Of a chunk and its answers: (row_id, n, logprob), the words of each text and the sum of their log-probabilities."""

    def run(key: tuple[pa.Scalar, ...], chunk: pa.Table, answers: pa.Table) -> pa.Table:
        words, sizes, source_sizes, at, n, own = _values(chunk, 0, "words", *ARRAYS)
        c = np.empty(len(words))
        c[_order(words, buckets)[0]] = _flat(answers.sort_by("bucket").column("c"))
        of = np.repeat(np.arange(len(sizes)), sizes)
        p = 0.5 * (c[at] + k) / total + 0.5 * (own / np.maximum(source_sizes, 1)[of])
        n, logprob = (np.bincount(of, x, len(sizes)).astype(np.float64) for x in (n, n * np.log(p)))
        return pa.table({"row_id": chunk.column("ids").combine_chunks()[0].values, "n": n, "logprob": logprob})

    return run


def own_sequence_scores(pairs: DataFrame, k: float) -> DataFrame:
    """(row_id, revise-detect) of pairs (row_id, source, target): as NGramModel.sequence_scores of a model counted on the targets."""
    kind = dict(pairs.dtypes)["row_id"]
    read = pairs.select("row_id", "source", "target").mapInArrow(_read, f"chunk long, ids array<{kind}>, words array<string>, " + ", ".join(f"{x} array<int>" for x in ARRAYS))
    chunks = stored(read.withColumn("words", F.transform("words", lambda x: F.xxhash64(x))), "sequences", wide=True)
    words = chunks.agg(F.sum(F.size("words"))).first()[0] or 0  # different ones of each chunk
    buckets = max(1, -(-words // chunked.BUCKET))
    asked = chunks.select("chunk", "words", "at", "n").mapInArrow(_asked(buckets), "chunk long, bucket int, w array<long>, n array<long>")
    answers = stored(asked.groupBy("bucket").applyInArrow(_answers, "chunk long, bucket int, c array<long>, size long, total long"), "counts")
    size, total = answers.agg(F.sum("size"), F.sum("total")).first()
    total = float((total or 0) + k * max(1, size or 0))
    found = chunks.groupBy("chunk").cogroup(answers.select("chunk", "bucket", "c").groupBy("chunk")).applyInArrow(_texts(buckets, k, total), f"row_id {kind}, n double, logprob double")
    return found.where("n > 0").groupBy("row_id").agg((F.sum("logprob") / F.sum("n")).alias("revise-detect"))
