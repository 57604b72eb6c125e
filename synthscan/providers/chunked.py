"""Pair statistics of a bigram model by chunks of texts: no row stands for a place or a pair.

Texts are cut into tokens and tokens hashed to 64 bits by expressions. A map chunk of about CHUNK tokens numbers its distinct
words and asks for each of its distinct pairs once, in a row for each bucket of contexts: contexts, how many pairs each has,
second words, and how often. All that a context's statistics take meets in its bucket, so counts, ranks and the sums over the
vocabulary are made there, and the bucket sends each chunk its answers. A chunk with its answers is a group; it gives sums or
arrays a text. So a text's places are never shuffled, and a common pair costs one entry a chunk.

Contexts with so many places that they would fill a bucket (`heavy`: a share of 2^-12 of all places at least, so 4,096 at
most) are dealt by the whole pair instead. How many tokens follow each of them how often, a table with few rows a context, is
counted first and sent to all tasks. The number of buckets grows with the input.

Drawn tokens: each place's random number goes to its context's bucket with the chunk's pairs, and the count of the drawn token
comes back. Every bucket knows the heavy contexts, so a chunk's numbers for those go to one bucket that the chunk's own number chooses.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import stored

CHUNK, BUCKET, HEAVY = 1 << 20, 1 << 21, 1 << 12
LONGS, INTS, DOUBLES = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.float64())
ASKED = "chunk long, bucket int, ctx array<long>, size array<int>, tok array<long>, n array<int>"
ANSWER = "chunk long, bucket int, c array<int>, rank array<int>, m array<long>, mean_lp array<double>, var_lp array<double>, xent array<double>"
PLACES, DRAWN = ", places array<int>, draws array<long>", ", drawn array<int>, z array<double>"
SUMS = ("n", "ranks", "log_ranks", "logprob", "mean_lp", "var_lp", "performer", "tokens", "xent")


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _flat(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """values cut into lists of the given sizes."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, kind.value_type))


@dataclass
class Sums:
    """Of contexts: m, mean_lp, var_lp and xent, from their pairs' counts; at: the context of each count, same: how many pairs have it."""

    k: float
    q: float
    V: int

    def of(self, at: np.ndarray, c: np.ndarray, same: np.ndarray, contexts: int) -> tuple[np.ndarray, ...]:
        k, q, V = self.k, self.q, self.V
        total = lambda x: np.bincount(at, x, contexts)
        m, seen = total(c * same), total(same)
        p, r = (c + k) / (m + k * V)[at], np.log((c + q) / (m + q * V)[at])
        lp, rest = np.log(p), V - seen
        p0, r0 = k / (m + k * V), q / (m + q * V)
        mean = total(same * p * lp) + rest * p0 * np.log(p0)
        second = total(same * p * lp * lp) + rest * p0 * np.log(p0) ** 2
        return m.astype(np.int64), mean, np.maximum(second - mean * mean, 0.0), -(total(same * p * r) + rest * p0 * np.log(r0))


@dataclass
class Heavy:
    """Contexts that are dealt by pairs, in order; their sums; for (number of the context, count) the rank; and by_count: number of
    the context, count, and how many tokens have it."""

    ctx: np.ndarray
    sums: tuple[np.ndarray, ...] = ()
    key: np.ndarray | None = None
    rank: np.ndarray | None = None
    by_count: tuple[np.ndarray, ...] = ()

    def among(self, ctx: np.ndarray) -> np.ndarray:
        if not len(self.ctx):
            return np.zeros(len(ctx), bool)
        return self.ctx[np.minimum(np.searchsorted(self.ctx, ctx), len(self.ctx) - 1)] == ctx


@dataclass
class Draws:
    """A token for each place, drawn after it from the observer and scored by the performer, both at a temperature."""

    k: float
    q: float
    V: int
    temperature: float = 1.0
    seed: int = 0

    def numbers(self) -> Column:
        """Of a chunk: a whole number below 2^53 for each token, which hangs on row, place and seed alone."""
        none = F.array().cast("array<int>")
        of = lambda x: F.transform(F.when(x["sizes"] > 0, F.sequence(F.lit(0), x["sizes"] - 1)).otherwise(none), lambda i: F.pmod(F.xxhash64(x["ids"].cast("string"), i, F.lit(self.seed)), F.lit(1 << 53)))
        return F.flatten(F.transform(F.arrays_zip("ids", "sizes"), of))

    def drawn(self, at: np.ndarray, c: np.ndarray, same: np.ndarray, contexts: int, of: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count of each drawn token, 0 for those not seen; and of contexts the performer's sum over the vocabulary. of: the draws'
        contexts; at, c and same as in Sums."""
        order = np.lexsort((-c, at))
        at, c, same = at[order], c[order], same[order]
        power, total = 1.0 / self.temperature, lambda x: np.bincount(at, x, contexts)
        weight, rest = same * (c + self.k) ** power, self.V - total(same)
        known = total(weight)
        place = numbers / float(1 << 53) * (known + rest * self.k**power)[of]
        hit = np.flatnonzero(place < known[of])
        first, upto, of = np.searchsorted(at, np.arange(contexts + 1)), np.concatenate(([0.0], np.cumsum(weight))), of[hit]
        step = np.searchsorted(upto[1:], upto[first[of]] + place[hit], side="right")
        out = np.zeros(len(place), np.int64)
        out[hit] = c[np.clip(step, first[of], first[of + 1] - 1)]
        return out, total(same * (c + self.q) ** power) + rest * self.q**power

    def xent(self, z: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.log(z) - np.log(c + self.q) / self.temperature


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, ids, sizes, words, at): the texts' ids and numbers of tokens, the distinct words and each token's place among them."""
    from pyspark import TaskContext

    number, waiting, size = TaskContext.get().partitionId() << 32, [], 0

    def chunk(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        ids, t = (table.column(x).combine_chunks() for x in ("row_id", "t"))
        sizes = np.nan_to_num(t.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int32)
        words, at = np.unique(t.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        columns = [pa.array([number]), one(ids), one(pa.array(sizes)), one(pa.array(words, pa.int64())), one(pa.array(at.astype(np.int32)))]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "ids", "sizes", "words", "at"])

    for batch in batches:
        ends = np.cumsum(np.nan_to_num(batch.column("t").value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + CHUNK - size, side="right")))
            end = min(end, batch.num_rows)
            waiting.append(batch.slice(begin, end - begin))
            size += int(ends[end - 1] - done)
            begin = end
            if size >= CHUNK or begin < batch.num_rows:
                yield chunk(waiting)
                number, waiting, size = number + 1, [], 0
    if waiting:
        yield chunk(waiting)


def _last(sizes: np.ndarray) -> np.ndarray:
    """Whether a token is its text's last."""
    out = np.zeros(int(sizes.sum()), bool)
    out[np.cumsum(sizes)[sizes > 0] - 1] = True
    return out


def _values(batch: pa.RecordBatch | pa.Table, i: int, *names: str) -> list[np.ndarray]:
    return [batch.column(x)[i].values.to_numpy(zero_copy_only=False) for x in names]


def _words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, n): a chunk's words, and how often each comes before another."""
    for batch in batches:
        for i in range(batch.num_rows):
            sizes, words, at = _values(batch, i, "sizes", "words", "at")
            n = np.bincount(at[~_last(sizes)], minlength=len(words))
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n.astype(np.int64))], ["w", "n"])


class Pairs:
    """A chunk's distinct pairs in the order of buckets, contexts and second words, and the runs of equal contexts in them. With a
    number of the chunk also the places' order by runs, for draws; heavy contexts have a run without pairs for theirs."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, at: np.ndarray, buckets: int, heavy: Heavy, number: int | None = None) -> None:
        self.last = _last(sizes)
        before = np.flatnonzero(~self.last)
        key, which, n = np.unique(at[before].astype(np.int64) << 32 | at[before + 1], return_inverse=True, return_counts=True)
        ctx, tok = key >> 32, key & 0xFFFFFFFF
        own = (_mix(words) % np.uint64(buckets)).astype(np.int32)
        bucket, common = own[ctx], heavy.among(words)[ctx]
        bucket[common] = (_mix(words[ctx[common]].view(np.uint64) + _mix(words[tok[common]])) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.place = self.place[which]  # of each place that has a pair, its pair's number
        bucket, ctx, self.tok, self.n = bucket[order], ctx[order], tok[order], n[order].astype(np.int32)
        begin = np.flatnonzero(np.concatenate(([True], (ctx[1:] != ctx[:-1]) | (bucket[1:] != bucket[:-1]))))[: len(ctx)]
        size = np.diff(np.append(begin, len(ctx)))
        alone = np.setdiff1d(np.arange(len(words)), ctx[begin])  # words that only end texts are asked for without pairs
        draw = np.flatnonzero(heavy.among(words)) if number is not None else alone[:0]
        home = (_mix(np.array([number or 0], np.int64)) % np.uint64(buckets)).astype(np.int32)
        run_bucket = np.concatenate((bucket[begin], own[alone], np.repeat(home, len(draw))))
        order = np.argsort(run_bucket, kind="stable")
        run_ctx = np.concatenate((ctx[begin], alone, draw))
        self.bucket, self.ctx, self.size = run_bucket[order], run_ctx[order], np.concatenate((size, np.zeros(len(alone) + len(draw), np.int64)))[order]
        if number is not None:
            run = np.empty(len(words), np.int64)
            to = np.empty(len(order), np.int64)
            to[order] = np.arange(len(order))
            run[run_ctx] = to  # of a heavy word the last one, for draws
            self.by_run, self.places = np.argsort(run[at], kind="stable"), np.bincount(run[at], minlength=len(order))


def _asked(buckets: int, heavy: Heavy, only: bool = False, other: bool = False, draws: Draws | None = None):
    """A row for each bucket of a chunk; only: no other contexts than heavy ones; other: pairs that are asked for but not counted, of
    chunks that get negative numbers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sizes, words, at = _values(batch, i, "sizes", "words", "at")
                p = Pairs(sizes, words, at, buckets, heavy, batch.column("chunk")[i].as_py() if draws else None)
                bucket, ctx, size, tok, n = p.bucket, p.ctx, p.size, p.tok, p.n
                if only:
                    on = heavy.among(words)[ctx] & (size > 0)
                    each = np.repeat(on, size)
                    bucket, ctx, size, tok, n = bucket[on], ctx[on], size[on], tok[each], n[each]
                numbers, first = np.unique(bucket, return_index=True)
                runs = np.diff(np.append(first, len(bucket)))
                pairs = np.add.reduceat(size, first) if len(first) else size
                chunk = np.full(len(numbers), batch.column("chunk")[i].as_py(), np.int64)
                chunk, n = (-1 - chunk, 0 * n) if other else (chunk, n)
                columns = [pa.array(chunk), pa.array(numbers.astype(np.int32)), _lists(words[ctx], runs, LONGS), _lists(size, runs, INTS), _lists(words[tok], pairs, LONGS), _lists(n, pairs, INTS)]
                names = ["chunk", "bucket", "ctx", "size", "tok", "n"]
                if draws:
                    each = np.add.reduceat(p.places, first) if len(first) else p.places
                    columns += [_lists(p.places, runs, INTS), _lists(_values(batch, i, "draws")[0][p.by_run], each, LONGS)]
                    names += ["places", "draws"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _counted(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """Of a bucket: its contexts, each run's; its pairs' contexts and counts, each entry's pair."""
    ctx, of_run = np.unique(_flat(rows.column("ctx")), return_inverse=True)
    tok = np.unique(_flat(rows.column("tok")), return_inverse=True)[1]
    key, which = np.unique(np.repeat(of_run, _flat(rows.column("size"))).astype(np.int64) << 32 | tok, return_inverse=True)
    c = np.bincount(which, _flat(rows.column("n")), len(key)).astype(np.int64)
    return ctx, of_run, key >> 32, c, which


def _by_count(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """(ctx, c, same): how many of a bucket's tokens come c times after a context."""
    ctx, _, at, c, _ = _counted(rows)
    order = np.lexsort((c, at))
    at, c = at[order], c[order]
    begin = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (c[1:] != c[:-1]))))[: len(at)]
    return pa.table({"ctx": ctx[at[begin]], "c": c[begin], "same": np.diff(np.append(begin, len(at)))})


def _ranks(at: np.ndarray, c: np.ndarray) -> np.ndarray:
    """1 plus the number of pairs of the same context with a higher count."""
    order = np.lexsort((-c, at))
    x, y = at[order], c[order]
    new = np.concatenate(([True], x[1:] != x[:-1]))[: len(x)]
    other = new | np.concatenate(([True], y[1:] != y[:-1]))[: len(x)]
    place = np.arange(len(x))
    out = np.empty(len(x), np.int64)
    out[order] = np.maximum.accumulate(np.where(other, place, 0)) - np.maximum.accumulate(np.where(new, place, 0)) + 1
    return out


def _drawn(draws: Draws, heavy: Heavy, rows: pa.Table, ctx: np.ndarray, of_run: np.ndarray, at: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Draws.drawn of a bucket, whose pairs have the given contexts and counts."""
    same, common = np.ones(len(at), np.int64), heavy.among(ctx)
    if common.any():  # the bucket has a part of their pairs
        number, mine = np.flatnonzero(common), ~common[at]
        table = heavy.by_count
        on = np.isin(table[0], np.searchsorted(heavy.ctx, ctx[number])) & (table[2] > 0)
        more = np.searchsorted(ctx, heavy.ctx[table[0][on]]), table[1][on], table[2][on]
        at, c, same = (np.concatenate((x[mine], y)) for x, y in zip((at, c, same), more, strict=True))
    return draws.drawn(at, c, same, len(ctx), np.repeat(of_run, _flat(rows.column("places"))), _flat(rows.column("draws")))


def _answers(sums: Sums, heavy: Heavy, other: bool = False, draws: Draws | None = None):
    """Of a bucket, a row for each chunk; other: for those with negative numbers alone."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        ctx, of_run, at, c, which = _counted(rows)
        known = c > 0  # pairs that only other texts have come after all that are seen
        rank, found = _ranks(at, c), list(sums.of(at[known], c[known], np.ones(int(known.sum()), np.int64), len(ctx)))
        common = heavy.among(ctx)
        if common.any():
            number = np.searchsorted(heavy.ctx, ctx)
            on = np.flatnonzero(common[at])
            rank[on] = heavy.rank[np.searchsorted(heavy.key, number[at[on]] << 40 | c[on])]
            for x, y in zip(found, heavy.sums, strict=True):
                x[common] = y[number[common]]
        if other:
            mine = rows.column("chunk").to_numpy() < 0
            sizes = [rows.column(x).combine_chunks().value_lengths().to_numpy() for x in ("ctx", "tok")]
            of_run, which = of_run[np.repeat(mine, sizes[0])], which[np.repeat(mine, sizes[1])]
            rows = rows.filter(pa.array(mine))
        runs, pairs = (rows.column(x).combine_chunks().value_lengths().to_numpy() for x in ("ctx", "tok"))
        more = {}
        if draws:
            drawn, z = _drawn(draws, heavy, rows, ctx, of_run, at, c)
            more = {"drawn": _lists(drawn, rows.column("draws").combine_chunks().value_lengths().to_numpy(), INTS), "z": _lists(z[of_run], runs, DOUBLES)}
        return pa.table({
            "chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "c": _lists(c[which], pairs, INTS), "rank": _lists(rank[which], pairs, INTS), "m": _lists(found[0][of_run], runs, LONGS),
            **{x: _lists(y[of_run], runs, DOUBLES) for x, y in zip(("mean_lp", "var_lp", "xent"), found[1:], strict=True)}, **more,
        })

    return run


def _texts(sums: Sums, buckets: int, heavy: Heavy, arrays: tuple[str, ...], draws: Draws | None = None):
    """Of a chunk and its answers: a row for each text, with SUMS or arrays; xent is that of drawn tokens, if there are draws."""

    def run(key: tuple[pa.Scalar, ...], chunk: pa.Table, answers: pa.Table) -> pa.Table:
        sizes, words, at = _values(chunk, 0, "sizes", "words", "at")
        answers = answers.sort_by("bucket")
        p = Pairs(sizes, words, at, buckets, heavy, key[0].as_py() if draws else None)
        c, rank = (_flat(answers.column(x))[p.place].astype(np.float64) for x in ("c", "rank"))
        m, mean, var, xent = (np.empty(len(words)) for _ in range(4))
        for x, name in ((m, "m"), (mean, "mean_lp"), (var, "var_lp"), (xent, "xent")):
            x[p.ctx] = _flat(answers.column(name))
        if draws:
            z, drawn = np.empty(len(words)), np.empty(len(at))
            z[p.ctx], drawn[p.by_run] = _flat(answers.column("z")), _flat(answers.column("drawn"))
            each_xent = np.where(m[at] == 0, np.log(max(1, sums.V)), draws.xent(z[at], drawn))
        else:
            xent[m == 0] = np.log(max(1, sums.V))  # words that nothing ever follows
            each_xent = xent[at]
        ctx = at[~p.last]
        logprob, performer = (np.log((c + k) / (m[ctx] + k * sums.V)) for k in (sums.k, sums.q))
        ids, n = chunk.column("ids").combine_chunks()[0].values, sizes - (sizes > 0)
        if arrays:
            each = {"logprob": lambda: logprob, "rank": lambda: rank, "mean_lp": lambda: mean[ctx], "var_lp": lambda: var[ctx], "performer": lambda: performer, "xent": lambda: each_xent}
            return pa.table({"row_id": ids, **{x: _lists(each[x](), sizes if x == "xent" else n, DOUBLES) for x in arrays}})
        of = np.repeat(np.arange(len(sizes)), n)
        total = lambda x: np.bincount(of, x, len(sizes))
        found = (n.astype(np.float64), total(rank), total(np.log(rank)), total(logprob), total(mean[ctx]), total(var[ctx]), total(performer), sizes.astype(np.float64), np.bincount(np.repeat(np.arange(len(sizes)), sizes), each_xent, len(sizes)))
        return pa.table({"row_id": ids, **dict(zip(SUMS, found, strict=True))})

    return run


class Chunks:
    """The texts of rows (row_id, t: array of tokens), counted and scored by the same model."""

    @staticmethod
    def _cut(rows: DataFrame) -> DataFrame:
        hashed = rows.select("row_id", F.transform("t", lambda x: F.xxhash64(x)).alias("t"))
        return stored(hashed.mapInArrow(_chunks, f"chunk long, ids array<{dict(rows.dtypes)['row_id']}>, sizes array<int>, words array<long>, at array<int>"), "chunks", wide=True)

    def __init__(self, rows: DataFrame, observer: float, performer: float) -> None:
        self.kind = dict(rows.dtypes)["row_id"]
        self.chunks = self._cut(rows)
        words = stored(self.chunks.mapInArrow(_words, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "vocabulary")
        size, places = words.agg(F.count("*"), F.sum("n")).first()
        self.sums, self.buckets = Sums(observer, performer, size), max(1, -(-(places or 0) // BUCKET))
        common = words.where(F.col("n") >= max(BUCKET >> 3, (places or 0) // HEAVY)).select("w").toPandas()["w"].to_numpy(np.int64)
        self.heavy = Heavy(np.sort(common))
        if len(common):
            self._count_heavy()

    def _heavy_pairs(self) -> DataFrame:
        return self.chunks.mapInArrow(_asked(self.buckets, self.heavy, True), ASKED)

    def _count_heavy(self) -> None:
        found = self._heavy_pairs().groupBy("bucket").applyInArrow(_by_count, "ctx long, c long, same long").groupBy("ctx", "c").agg(F.sum("same").alias("same")).toPandas()
        at, c, same = np.searchsorted(self.heavy.ctx, found["ctx"].to_numpy(np.int64)), found["c"].to_numpy(np.int64), found["same"].to_numpy(np.int64)
        every = np.arange(len(self.heavy.ctx))
        at, c, same = (np.concatenate(x) for x in ((at, every), (c, 0 * every), (same, 0 * every)))  # and the rank of pairs not seen
        order = np.lexsort((-c, at))
        at, c, same = at[order], c[order], same[order]
        by_count = at, c, same
        upto = np.cumsum(same) - same
        rank = 1 + upto - upto[np.searchsorted(at, at)]
        key = at.astype(np.int64) << 40 | c
        order = np.argsort(key)
        self.heavy = Heavy(self.heavy.ctx, self.sums.of(at, c, same, len(every)), key[order], rank[order], by_count)

    def texts(self, *arrays: str, drawn: tuple[float, int] | None = None) -> DataFrame:
        """row_id and SUMS for each text, or some arrays of its places: logprob, rank, mean_lp, var_lp and performer of pairs, xent of tokens.
        drawn: temperature and seed; xent is then that of one drawn token for each place."""
        draws = Draws(self.sums.k, self.sums.q, self.sums.V, *drawn) if drawn else None
        chunks = self.chunks.withColumn("draws", draws.numbers()) if draws else self.chunks
        asked = chunks.mapInArrow(_asked(self.buckets, self.heavy, draws=draws), ASKED + (PLACES if draws else ""))
        answers = asked.groupBy("bucket").applyInArrow(_answers(self.sums, self.heavy, draws=draws), ANSWER + (DRAWN if draws else ""))
        kinds = ", ".join(f"{x} {'array<double>' if arrays else 'double'}" for x in arrays or SUMS)
        return self.chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_texts(self.sums, self.buckets, self.heavy, arrays, draws), f"row_id {self.kind}, {kinds}")

    def variants(self, rows: DataFrame) -> DataFrame:
        """row_id, variant and SUMS for each of other texts (row_id, variant, t), under the model of the counted ones."""
        chunks, buckets = self._cut(rows.select(F.struct("row_id", "variant").alias("row_id"), "t")), 4 * self.buckets
        asked = self.chunks.mapInArrow(_asked(buckets, self.heavy), ASKED).unionByName(chunks.mapInArrow(_asked(buckets, self.heavy, other=True), ASKED))
        answers = asked.groupBy("bucket").applyInArrow(_answers(self.sums, self.heavy, True), ANSWER).withColumn("chunk", -1 - F.col("chunk"))
        kinds = f"row_id struct<row_id: {self.kind}, variant: int>, " + ", ".join(f"{x} double" for x in SUMS)
        found = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_texts(self.sums, buckets, self.heavy, ()), kinds)
        return found.select("row_id.*", *SUMS)
