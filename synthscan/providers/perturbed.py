"""Log-ranks of texts and of their perturbations by the bigram model counted on the texts, without the perturbed texts.

A perturbation is its text but for some spans with pieces in their place. So a chunk of texts holds their tokens once, and of each
perturbation where its spans lie and the numbers of their pieces. Pairs of tokens in what is kept are the text's own; new ones are
those where a kept run and a piece meet, and those in pieces. A chunk asks for each of its distinct pairs once, as in `chunked`.

Words of pieces that no text has are found first (2^20 of them at most; others are asked for): a pair ending in one has the rank
after all that are seen, so only the number of these is asked for, and one beginning with it has rank 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import perturb
from ..plans.tables import stored
from . import chunked
from .chunked import ASKED, INTS, Chunks, Heavy, Sums, _counted, _flat, _last, _lists, _mix, _ranks, _values

UNKNOWN = 1 << 20
ANSWER = "chunk long, bucket int, rank array<int>, seen array<int>"
ARRAYS = ("sizes", "at", "masks", "gap", "cut", "piece", "piece_sizes", "piece_at")
#: Bytes of words stay, as do spaces; all others are breaks.
_BREAKS = bytes(x if chr(x) in "abcdefghijklmnopqrstuvwxyz0123456789 " else 10 for x in range(256))


class _Numbers(dict):
    """Numbers of keys in the order of their first lookup."""

    def __missing__(self, key) -> int:
        number = self[key] = len(self)
        return number


class _Reading:
    """A chunk that is being read."""

    def __init__(self) -> None:
        self.words, self.pieces, self.piece_at, self.size = _Numbers(), {}, [], 0
        self.ids, self.arrays = [], {x: [] for x in ("sizes", "at", "masks", "gap", "cut", "piece")}

    def _tokens(self, text: str) -> tuple[np.ndarray, bytes]:
        """Numbers of the text's tokens, those of `functions.overlap.tokens`, and its bytes, lower-cased."""
        raw = text.lower().encode(errors="replace").translate(_BREAKS)
        words = raw.split()
        return np.fromiter(map(self.words.__getitem__, words), np.int32, len(words)), raw

    def _piece(self, piece: str | None, whole: str = "") -> int:
        """The number of a piece; None is a whole text's, which has one of its own."""
        number = self.pieces.get(piece) if piece is not None else None
        if number is None:
            number = len(self.piece_at)
            self.piece_at.append(self._tokens(whole if piece is None else piece)[0])
            self.size += len(self.piece_at[-1])
            if piece is not None:
                self.pieces[piece] = number
        return number

    def add(self, text: str | None, found: list, span: int) -> None:
        """A text with its perturbations, as of perturb.tries."""
        at, raw = self._tokens(text or "")
        if perturb.n_masks(text or ""):  # its own words may stand for masks: perturbed texts as a whole
            starts = [[0] for _ in found]
            pieces = [[self._piece("") if x is None else self._piece(None, perturb.filled(*x[1:]))] for x in found]
            upto, span = np.array([0, len(at)]), 1
        else:
            bytes_ = np.frombuffer(raw, np.uint8)
            begins = bytes_ > 32
            begins[1:] &= bytes_[:-1] <= 32
            spaces = np.flatnonzero(bytes_ == 32)
            upto = np.concatenate(([0], np.searchsorted(np.flatnonzero(begins), spaces), [len(at)]))  # tokens before each word
            starts = [[0] if x is None else x[0] for x in found]
            pieces = [[self._piece("")] if x is None else [self.pieces[p] if p in self.pieces else self._piece(p) for p in x[2][: len(x[0])]] for x in found]
        masks = np.array([len(x) for x in starts], np.int64)
        total = int(masks.sum())
        start = np.fromiter(chain.from_iterable(starts), np.int64, total)
        begin, end = upto[start], upto[np.minimum(start + span, len(upto) - 1)]
        first = np.cumsum(masks) - masks
        for i, x in enumerate(found):
            if x is None:  # nothing is left
                end[first[i]] = len(at)
        before = np.concatenate(([0], end[:-1]))[:total]
        before[first[masks > 0]] = 0
        self.size += len(at) + total
        piece = np.fromiter(chain.from_iterable(pieces), np.int64, total)
        for x, y in zip(self.arrays, ([len(at)], at, masks, begin - before, end - begin, piece), strict=True):
            self.arrays[x].append(y)

    def chunk(self, number: int) -> pa.RecordBatch:
        flat = {x: np.concatenate(y).astype(np.int32) for x, y in self.arrays.items()}
        flat["piece"] = np.diff(flat["piece"], prepend=np.int32(0))
        flat["piece_sizes"] = np.array([len(x) for x in self.piece_at], np.int32)
        flat["piece_at"] = np.concatenate(self.piece_at) if self.piece_at else np.zeros(0, np.int32)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        words = pa.array(list(self.words), pa.binary()).cast(pa.string())
        columns = [pa.array([number]), one(pa.concat_arrays(self.ids)), one(words), *(one(pa.array(flat[x])) for x in ARRAYS)]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "ids", "words", *ARRAYS])


def _read(n: int, fill: Callable[[list[str]], list[str]], span: int, options: dict):
    """Rows (row_id, text, _seeds) as chunks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, reading = TaskContext.get().partitionId() << 32, _Reading()
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            seeds = batch.column("_seeds").flatten().to_numpy(zero_copy_only=False).reshape(-1, n + 1)
            for begin, end in perturb.slices(sizes * (n + 1)):
                texts = batch.column("text").slice(begin, end - begin).to_pylist()
                reading.ids.append(batch.column("row_id").slice(begin, end - begin))
                for text, found in zip(texts, perturb.tries(texts, list(seeds[begin:end]), fill, span, **options), strict=True):
                    reading.add(text, found, span)
                if reading.size >= chunked.CHUNK:
                    yield reading.chunk(number)
                    number, reading = number + 1, _Reading()
        if reading.ids:
            yield reading.chunk(number)

    return run


def _words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, n, known): a chunk's words, how often each comes before another in texts, and whether texts have it."""
    for batch in batches:
        for i in range(batch.num_rows):
            sizes, words, at = _values(batch, i, "sizes", "words", "at")
            n = np.bincount(at[~_last(sizes)], minlength=len(words))
            known = np.bincount(at, minlength=len(words)) > 0
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n.astype(np.int64)), pa.array(known)], ["w", "n", "known"])


class _Chunk:
    """A chunk's pairs: those in texts, those in pieces, and those where parts of perturbations meet."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, i: int, meeting: bool = True) -> None:
        self.words, self.sizes, self.at, masks, gap, cut, piece, psizes, pat = _values(batch, i, "words", *ARRAYS)
        self.last = _last(np.concatenate((self.sizes, psizes)))
        codes = np.concatenate((self.at, pat)).astype(np.int64)
        inner = np.flatnonzero(~self.last)
        self.ctx, self.tok, self.counted = codes[inner], codes[inner + 1], int(np.searchsorted(inner, len(self.at)))
        if not meeting:
            return
        n, total = len(masks), len(cut)
        each = n // max(1, len(self.sizes))
        first, of = np.cumsum(masks) - masks, np.repeat(np.arange(n), masks)
        upto = np.cumsum(gap.astype(np.int64) + cut)
        end = upto - np.concatenate(([0], upto))[first][of]
        base, piece = np.repeat(np.cumsum(self.sizes, dtype=np.int64) - self.sizes, each), np.cumsum(piece, dtype=np.int64)
        # parts in order: what is kept before a variant's first piece, the piece, what is kept after it, and so on
        var = np.repeat(np.arange(n), 2 * masks.astype(np.int64) + 1)
        head, at = 2 * first + np.arange(n), 2 * np.arange(total) + of + 1
        begin, upto = base[var], np.zeros(len(var), np.int64)
        begin[at + 1] += end
        upto[at - 1] = base[of] + end - cut
        upto[head + 2 * masks] = base + np.repeat(self.sizes, each)
        place = len(self.at) + np.cumsum(psizes, dtype=np.int64) - psizes
        begin[at], upto[at] = place[piece], place[piece] + psizes[piece]
        on = upto > begin
        self.begin, self.upto, self.var, self.variants = begin[on], upto[on], var[on], n
        same = np.flatnonzero(self.var[1:] == self.var[:-1])
        self.met = self.var[same]
        self.ctx, self.tok = np.concatenate((self.ctx, codes[self.upto[same] - 1])), np.concatenate((self.tok, codes[self.begin[same + 1]]))

    def asked(self, buckets: int, heavy: Heavy, unknown: np.ndarray) -> None:
        """Its distinct pairs by buckets and contexts, the runs of equal contexts, and each pair's place among the distinct ones: -1 for
        those after which all seen ones come, -2 for those of unknown contexts."""
        new = Heavy(unknown).among(self.words)
        common = heavy.among(self.words)
        place = np.where(new[self.ctx], -2, np.where(new[self.tok], -1, 0))
        known = np.flatnonzero(place == 0)
        key, which = np.unique(self.ctx[known] << 32 | self.tok[known], return_inverse=True)
        n = np.bincount(which[known < self.counted], minlength=len(key))
        ctx, tok = key >> 32, key & 0xFFFFFFFF
        own = (_mix(self.words) % np.uint64(buckets)).astype(np.int32)
        bucket, dealt = own[ctx], common[ctx]
        bucket[dealt] = (_mix(self.words[ctx[dealt]].view(np.uint64) + _mix(self.words[tok[dealt]])) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        to = np.empty(len(order), np.int64)
        to[order] = np.arange(len(order))
        place[known] = to[which]
        bucket, ctx, self.pair_tok, self.n = bucket[order], ctx[order], tok[order], n[order]
        begin = np.flatnonzero(np.concatenate(([True], (ctx[1:] != ctx[:-1]) | (bucket[1:] != bucket[:-1]))))[: len(ctx)]
        size = np.diff(np.append(begin, len(ctx)))
        wanted = np.bincount(self.ctx[place == -1], minlength=len(self.words)) > 0
        wanted[common] = False  # all know these
        wanted[ctx[begin]] = False
        alone = np.flatnonzero(wanted)
        run_bucket, run_ctx = np.concatenate((bucket[begin], own[alone])), np.concatenate((ctx[begin], alone))
        order = np.argsort(run_bucket, kind="stable")
        self.bucket, self.run_ctx, self.size = run_bucket[order], run_ctx[order], np.concatenate((size, 0 * alone))[order]
        self.place, self.common = place, common


def _asked(buckets: int, heavy: Heavy, unknown: np.ndarray, only: bool = False):
    """A row for each bucket of a chunk; only: no other pairs than those of texts with heavy contexts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                p = _Chunk(batch, i, not only)
                p.asked(buckets, heavy, unknown)
                bucket, ctx, size, tok, n = p.bucket, p.run_ctx, p.size, p.pair_tok, p.n
                if only:
                    of = np.repeat(np.arange(len(ctx)), size)
                    pair = p.common[ctx][of] & (n > 0)
                    size = np.bincount(of[pair], minlength=len(ctx))
                    on, tok, n = size > 0, tok[pair], n[pair]
                    bucket, ctx, size = bucket[on], ctx[on], size[on]
                numbers, first = np.unique(bucket, return_index=True)
                runs = np.diff(np.append(first, len(bucket)))
                pairs = np.add.reduceat(size, first) if len(first) else size
                chunk = np.full(len(numbers), batch.column("chunk")[i].as_py(), np.int64)
                longs = chunked.LONGS
                columns = [pa.array(chunk), pa.array(numbers.astype(np.int32)), _lists(p.words[ctx], runs, longs), _lists(size.astype(np.int32), runs, INTS), _lists(p.words[tok], pairs, longs), _lists(n.astype(np.int32), pairs, INTS)]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "bucket", "ctx", "size", "tok", "n"])

    return run


def _answers(heavy: Heavy):
    """Of a bucket, a row for each chunk: the ranks of its pairs, and how many pairs of its runs' contexts are seen."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        ctx, of_run, at, c, which = _counted(rows)
        rank, common = _ranks(at, c), heavy.among(ctx)
        if common.any():
            on = np.flatnonzero(common[at])
            rank[on] = heavy.rank[np.searchsorted(heavy.key, np.searchsorted(heavy.ctx, ctx)[at[on]] << 40 | c[on])]
        seen = np.bincount(at[c > 0], minlength=len(ctx))
        runs, pairs = (rows.column(x).combine_chunks().value_lengths().to_numpy() for x in ("ctx", "tok"))
        return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "rank": _lists(rank[which], pairs, INTS), "seen": _lists(seen[of_run], runs, INTS)})

    return run


def _texts(buckets: int, heavy: Heavy, unknown: np.ndarray):
    """Of a chunk and its answers: a row for each text and each of its perturbations."""

    def run(key: tuple[pa.Scalar, ...], chunk: pa.Table, answers: pa.Table) -> pa.Table:
        p = _Chunk(chunk, 0)
        p.asked(buckets, heavy, unknown)
        answers = answers.sort_by("bucket")
        found, after = np.append(_flat(answers.column("rank")), 1), np.ones(len(p.words), np.int64)
        after[p.run_ctx] = _flat(answers.column("seen")) + 1
        if p.common.any():
            number = np.searchsorted(heavy.ctx, p.words[p.common])
            after[p.common] = heavy.rank[np.searchsorted(heavy.key, number.astype(np.int64) << 40)]
        rank = found[np.maximum(p.place, -1)]  # of unknown contexts 1
        rank = np.log(np.where(p.place == -1, after[p.ctx], np.where(p.place == -2, 1, rank)).astype(np.float64))
        inner = len(p.ctx) - len(p.met)
        each = np.zeros(len(p.last))
        each[~p.last] = rank[:inner]
        upto = np.concatenate(([0], np.cumsum(each, dtype=np.longdouble)))  # long, so that short texts' parts lose nothing
        part = (upto[p.upto - 1] - upto[p.begin]).astype(np.float64)
        n = np.maximum(np.bincount(p.var, p.upto - p.begin, p.variants) - 1, 0)
        total = np.bincount(p.var, part, p.variants) + np.bincount(p.met, rank[inner:], p.variants)
        own = np.bincount(np.repeat(np.arange(len(p.sizes)), p.sizes), each[: len(p.at)], len(p.sizes))
        ids, variants = chunk.column("ids").combine_chunks()[0].values, p.variants // max(1, len(p.sizes))
        row = np.concatenate((np.arange(len(ids)), np.repeat(np.arange(len(ids)), variants)))
        variant = np.concatenate((np.zeros(len(ids), np.int32), np.tile(np.arange(1, variants + 1, dtype=np.int32), len(ids))))
        n, total = (np.concatenate(x).astype(np.float64) for x in ((np.maximum(p.sizes - 1, 0), n), (own, total)))
        return pa.table({"row_id": ids.take(pa.array(row)), "variant": variant, "n": n, "log_ranks": total})

    return run


class PerturbedChunks(Chunks):
    """The texts of df (row_id, text), which are counted, and n perturbations of each."""

    def __init__(self, df: DataFrame, n: int, fill: Callable[[list[str]], list[str]], seed: int = 0, span: int = perturb.SPAN, **options) -> None:
        self.kind = dict(df.dtypes)["row_id"]
        kinds = f"chunk long, ids array<{self.kind}>, words array<string>, " + ", ".join(f"{x} array<int>" for x in ARRAYS)
        read = perturb.seeded(df, "row_id", "text", n, seed).mapInArrow(_read(n, fill, span, options), kinds)
        self.chunks = stored(read.withColumn("words", F.transform("words", lambda x: F.xxhash64(x))), "perturbed", wide=True)
        words = self.chunks.mapInArrow(_words, "w long, n long, known boolean").groupBy("w").agg(F.sum("n").alias("n"), F.max("known").alias("known"))
        words = stored(words, "vocabulary")
        size, places = words.where("known").agg(F.count("*"), F.sum("n")).first()
        self.sums, self.buckets = Sums(1.0, 1.0, size), max(1, -(-2 * (places or 0) // chunked.BUCKET))
        few = lambda x: np.sort(x.select("w").toPandas()["w"].to_numpy(np.int64))
        self.unknown = few(words.where("NOT known").limit(UNKNOWN))
        self.heavy = Heavy(few(words.where(F.col("n") >= max(chunked.BUCKET >> 3, (places or 0) // chunked.HEAVY))))
        if len(self.heavy.ctx):
            self._count_heavy()

    def _heavy_pairs(self) -> DataFrame:
        return self.chunks.mapInArrow(_asked(self.buckets, self.heavy, self.unknown, True), ASKED)

    def log_ranks(self) -> DataFrame:
        """(row_id, variant, n, log_ranks): the texts as variant 0, and their perturbations."""
        answers = self.chunks.mapInArrow(_asked(self.buckets, self.heavy, self.unknown), ASKED).groupBy("bucket").applyInArrow(_answers(self.heavy), ANSWER)
        kinds = f"row_id {self.kind}, variant int, n double, log_ranks double"
        found = self.chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_texts(self.buckets, self.heavy, self.unknown), kinds)
        return found.groupBy("row_id", "variant").agg(F.sum("n").alias("n"), F.sum("log_ranks").alias("log_ranks"))
