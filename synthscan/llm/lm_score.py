"""Cross-entropy difference of two bigram models, after Moore and Lewis (2010).

A background model is counted over all documents, a target model over texts of the wanted kind. Both are bigram models
over the same vocabulary, the words of both corpora with A-Z lower-cased, smoothed alike:

  p(w | v) = (c(v w) + prior q(w)) / (c(v) + prior), v a word or the beginning of a text,
  q(w) = (c(w) + 1) / (words + size of the vocabulary)

A document's score is its mean loss per word under the target model less that under the background model, in nats:
the lower, the more it is like the target. Words are told apart by 64-bit hashes.

At scale: counts are exact over all texts, and no table of words or bigrams is held, gathered or broadcast. Every
occurrence of a word goes, with the word before it, packed by (map chunk, bucket), to the word's own bucket: all that its
loss takes meets there, c(w) and c(v w) for its own turn and, as the losses' parts add up, c(w) of the next word's
context; the bucket sends back a partial loss for each document it has words of. Words so common that they would fill a
bucket (`heavy`: those with a share of 2^-19 of the input's bytes or more, so fewer than 2^19 of them whatever the input,
and by the lengths of words and their distribution some ten thousand) are dealt by the whole bigram instead; only their
counts and totals are sent to all tasks. The number of buckets grows with the input, and each is a partition of its own.

Defined cases: null and wordless texts have 0 words, null losses and a null score; null ids take no part and have a null
score; rows that share an id are scored as one document, each with that score; an empty target makes every word
equally likely under it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import by_size, byte_texts, parts, stored, text_bytes, tidy
from .substring_dedup import _pack, _unpack, in_partitions

PRIOR, CHUNK_BYTES, FLUSH, BUCKET_BYTES, HEAVY_SHARE = 10.0, 2 << 20, 1 << 20, 16 << 20, 1 << 19
BEGIN = np.uint64(1)
LOSSES = "bucket int, part int, ids binary, words binary, target_loss binary, background_loss binary"


def _word_keys(words: kernel.Words) -> np.ndarray:
    return np.maximum(words.hashes(), np.uint64(2))


def _bucket(x: np.ndarray, bits: int) -> np.ndarray:
    return (kernel.mix(x) >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(x), np.int32)


def _dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    numbers, begin = np.unique(bucket[order], return_index=True)
    return zip(numbers.tolist(), np.split(order, begin[1:]) if len(order) else [], strict=True)


def _word_counts(bits: int):
    """Words of a chunk by bucket, with how often they occur and how often before another word; a text's beginning is one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "text", CHUNK_BYTES):
            target = batch.column("target")[0].as_py()
            words = kernel.words(byte_texts(batch.column("text")), lower=True)
            full = np.diff(words.first) > 0
            keys, which = np.unique(np.concatenate((_word_keys(words), np.full(int(full.sum()), BEGIN))), return_inverse=True)
            first = np.ones(len(which), bool)
            first[words.first[1:][full] - 1] = False
            times, before = np.bincount(which, minlength=len(keys)), np.bincount(which[first], minlength=len(keys))
            for number, rows in _dealt((keys >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)):
                columns = [pa.array([number], pa.int32()), pa.array([target]), *(pa.array([_pack(x[rows])], pa.binary()) for x in (keys, times, before))]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "target", "words", "times", "before"])

    return run


def _totals(least: int):
    """Of a bucket: its distinct words (kind 0), all their occurrences (1), texts (2), and the heavy words (3)."""

    def reduce(bucket: pa.Table) -> pa.Table:
        rows = bucket.to_pylist()
        keys = np.concatenate([_unpack(r["words"], np.uint64) for r in rows])
        target = np.repeat([r["target"] for r in rows], [len(r["words"]) // 8 for r in rows]).astype(bool)
        unique, which = np.unique(keys, return_inverse=True)
        times, before = (np.stack([np.bincount(which[on], n[on], len(unique)) for on in (target, ~target)]).astype(np.int64) for n in (np.concatenate([_unpack(r[x], np.int64) for r in rows]) for x in ("times", "before")))
        real = unique > BEGIN
        heavy = np.flatnonzero(real & (times.sum(axis=0) >= least))
        kinds = np.repeat(np.arange(4, dtype=np.int32), [1, 1, 1, len(heavy)])
        key = np.concatenate((np.zeros(3, np.uint64), unique[heavy])).view(np.int64)
        sums = [np.concatenate(([real.sum(), times[i][real].sum(), times[i][~real].sum()], times[i][heavy])).astype(np.int64) for i in (0, 1)]
        befores = [np.concatenate(([0, 0, 0], before[i][heavy])).astype(np.int64) for i in (0, 1)]
        return pa.table([pa.array(kinds), pa.array(key), *map(pa.array, sums + befores)], names=["kind", "key", "target", "background", "target_before", "background_before"])

    return reduce


def _occurrences(bits: int, heavy: np.ndarray):
    """Occurrences of words by bucket: which of the row's words, the word before, whether a text ends there; in the order of texts."""
    names = ["bucket", "target", "words", "which", "before", "last", "ids", "counts"]

    def send(found: list[tuple[np.ndarray, ...]], target: bool) -> Iterator[pa.RecordBatch]:
        own, before, last, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        words, which = np.unique(own, return_inverse=True)
        bucket = _bucket(words, bits)[which]
        common = np.flatnonzero(kernel.among(words, heavy)[which])
        bucket[common] = _bucket(own[common] ^ kernel.mix(before[common]), bits)
        for number, rows in _dealt(bucket):
            local, index = np.unique(which[rows], return_inverse=True)
            index = index.astype(np.uint16 if len(local) <= 1 << 16 else np.uint32)
            of = ids[rows]
            begin = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            sizes = np.diff(np.append(begin, len(of))).astype(np.int32)
            packed = (_pack(words[local]), index.tobytes(), before[rows].tobytes(), np.packbits(last[rows]).tobytes(), _pack(of[begin]), _pack(sizes))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([target]), *(pa.array([x], pa.binary()) for x in packed)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n, before_target = [], 0, None
        for batch in by_size(batches, "text", CHUNK_BYTES):
            target = batch.column("target")[0].as_py()
            if n >= FLUSH or n and target != before_target:
                yield from send(found, before_target)
                found, n = [], 0
            words = kernel.words(byte_texts(batch.column("text")), lower=True)
            own = _word_keys(words)
            full = np.diff(words.first) > 0
            before = np.concatenate(([BEGIN], own[:-1])) if len(own) else own
            before[words.first[:-1][full]] = BEGIN
            last = np.zeros(len(own), bool)
            last[words.first[1:][full] - 1] = True
            found.append((own, before, last, batch.column("id").to_numpy(zero_copy_only=False)[words.text_of]))
            n, before_target = n + len(own), target
        if n:
            yield from send(found, before_target)

    return run


def _word_losses(prior: float, mass: np.ndarray, texts: np.ndarray, heavy: np.ndarray, heavy_counts: np.ndarray, bits: int):
    """mass (words + vocabulary) and texts: of the target and of the background; heavy_counts: those of _totals."""

    def reduce(bucket: pa.Table) -> pa.Table:
        rows = sorted(bucket.to_pylist(), key=lambda r: (r["target"], r["ids"], r["before"]))
        number = rows[0]["bucket"]
        lengths = [len(r["before"]) // 8 for r in rows]
        scored = sum(n for n, r in zip(lengths, rows, strict=True) if not r["target"])  # these come first
        ids = np.concatenate([np.zeros(0, np.int64), *(_unpack(r["ids"], np.int64) for r in rows if not r["target"])])
        sizes = np.concatenate([np.zeros(0, np.int32), *(_unpack(r["counts"], np.int32) for r in rows if not r["target"])])
        own = [_unpack(r["words"], np.uint64) for r in rows]
        names = kernel.distinct(np.concatenate(own))
        index = (np.frombuffer(r["which"], np.uint16 if len(r["which"]) == 2 * n else np.uint32) for n, r in zip(lengths, rows, strict=True))
        word = np.concatenate([np.searchsorted(names, x).astype(np.int32)[i] for x, i in zip(own, index, strict=True)])
        last = np.concatenate([np.unpackbits(np.frombuffer(r["last"], np.uint8), count=n) for n, r in zip(lengths, rows, strict=True)]).astype(bool)
        grams = np.concatenate([np.frombuffer(r["before"], np.uint64) for r in rows])
        begins = grams[:scored] == BEGIN
        grams = kernel.mix(grams + kernel.mix(names)[word])
        order = np.argsort(grams)
        grams = grams[order]
        begin = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
        del grams
        n = np.diff(np.append(begin, len(order)))
        t = np.add.reduceat((order >= scored).astype(np.int64), begin)
        second = word[order[begin]]
        at = np.clip(np.searchsorted(heavy, names), 0, max(0, len(heavy) - 1))
        common = heavy[at] == names if len(heavy) else np.zeros(len(names), bool)
        loss = []
        for column, (count, mine) in enumerate(((t, slice(scored, None)), (n - t, slice(0, scored)))):
            times = np.bincount(second, count, len(names))
            before = np.bincount(word[mine][~last[mine]], minlength=len(names)).astype(float)
            times[common], before[common] = heavy_counts[at[common], column], heavy_counts[at[common], 2 + column]
            each = np.empty(len(order))
            each[order] = np.repeat(-np.log(count + prior * ((times + 1) / mass[column])[second]), n)
            each = each[:scored]
            each += np.where(last[:scored], 0.0, np.log(before + prior)[word[:scored]])
            each[begins] += np.log(texts[column] + prior)
            loss.append(np.add.reduceat(each, np.cumsum(sizes) - sizes) if scored else np.zeros(0))
        out = [(number, part, _pack(ids[x]), _pack(sizes[x]), loss[0][x].tobytes(), loss[1][x].tobytes()) for part, x in _dealt(_bucket(ids.view(np.uint64), bits))] if scored else []
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 4
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["bucket", "part", "ids", "words", "target_loss", "background_loss"])

    return reduce


def _losses(both: DataFrame, prior: float, size: int, bits: int) -> DataFrame:
    counted = both.mapInArrow(tidy(_word_counts(bits)), "bucket int, target boolean, words binary, times binary, before binary")
    counted = in_partitions(counted, "bucket", 1 << bits, _totals(max(1024, size // HEAVY_SHARE)), "kind int, key long, target long, background long, target_before long, background_before long")
    summed = stored(counted, "vocabulary").groupBy("kind", "key").agg(*(F.sum(x).alias(x) for x in ("target", "background", "target_before", "background_before"))).toPandas()
    number, words, texts = (summed.loc[summed["kind"] == i, ["target", "background"]].to_numpy(np.int64).sum(axis=0) for i in range(3))
    common = summed[summed["kind"] == 3]
    heavy = common["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(heavy)
    heavy, counts = heavy[order], common[["target", "background", "target_before", "background_before"]].to_numpy(np.int64)[order]
    sent = both.mapInArrow(tidy(_occurrences(bits, heavy)), "bucket int, target boolean, words binary, which binary, before binary, last binary, ids binary, counts binary")
    return in_partitions(sent, "bucket", 1 << bits, _word_losses(prior, words + np.maximum(1, number), texts, heavy, counts, bits), LOSSES)


def _summed(part: pa.Table) -> pa.Table:
    rows = part.sort_by("bucket").to_pylist()
    ids = np.concatenate([_unpack(r["ids"], np.int64) for r in rows])
    unique, which = np.unique(ids, return_inverse=True)
    words = np.bincount(which, np.concatenate([_unpack(r["words"], np.int32) for r in rows])).astype(np.int64)
    loss = (np.bincount(which, np.concatenate([np.frombuffer(r[x]) for r in rows])) for x in ("target_loss", "background_loss"))
    return pa.table([pa.array(unique), pa.array(words), *map(pa.array, loss)], names=["id", "n_words", "target_loss", "background_loss"])


def cross_entropy_difference(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR) -> DataFrame:
    """One row per document: id, n_words, target_loss and background_loss (sums), score. target needs a column text_col."""
    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    both = ids.where("id IS NOT NULL").withColumn("target", F.lit(False)).union(target.select(F.lit(0).cast("long"), F.col(text_col), F.lit(True)))
    both = both.where("text IS NOT NULL")
    size = text_bytes(both)
    bits = (parts(size, BUCKET_BYTES) - 1).bit_length()
    losses = _losses(both, prior, size, bits)
    summed = in_partitions(losses, "part", 1 << bits, _summed, "id long, n_words long, target_loss double, background_loss double")
    out = ids.select("id").join(summed, "id", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_words", F.lit(0)).alias("n_words"), "target_loss", "background_loss", ((F.col("target_loss") - F.col("background_loss")) / F.col("n_words")).alias("score"))
