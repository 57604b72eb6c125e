"""Alignment of two tokenizers on the same texts: common cuts, links of overlapping tokens, and corpus-wide counts of links.

Both tokenizers encode space + text. Byte offsets where tokens of both end cut a text into groups; a token of one and one
of the other are linked where their byte ranges overlap. A pair's count is the number of documents that hold it linked.

Units: neither tokenizer has a token across a space that follows a character other than white space, so a text is the
sequence of its units, which end before such spaces, and each unit ends in a common cut. A map chunk encodes and aligns
each of its distinct units once, many of them joined as one text of bounded length: cumulative byte lengths give ends, intersect1d the common cuts,
searchsorted the groups' labels, and a repeat-based expansion the links. Documents are then sums over their units.

At scale: a chunk asks for the counts of its distinct pairs, in a row for each bucket of first ids. Counts are summed in two
stages, first by bucket and salt, so that common pairs of a large corpus are spread, and then by bucket, where all pairs of
a first id meet, so its highest count is known. The answers go back to the chunks, an array for each bucket, and each chunk with
its answers is a group of its own. No row stands for a link, tokens are computed once, and no table of pairs is broadcast.
Chunks are kept in the shared folder, in row groups ended by size, so a task holds few of them, however large its files.

Defined cases: texts that are null or empty, or whose tokens' joined bytes are not space + text under either tokenizer
(as with U+2581), have no tokens: zeros and an empty groups_sha256. Each row is a document of its own, also with a null or
repeated id; an empty table gives an empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import by_size, parts, stored, text_bytes, tidy
from .tokens import encoder

PIECES, SPACE = "piece_bpe_32k.model", "▁"
CHUNK_BYTES, BUCKETS, SALT_BYTES = 4 << 20, 64, 1 << 30
JOINED, LINKS = 1 << 17, 1 << 18  # characters of units aligned together, links of whole documents told apart together
CHUNK = (
    "chunk long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, "
    "doc_first array<int>, doc_unit array<int>, doc_n array<int>, unit_first array<int>, unit_pair array<int>, "
    "asked array<struct<bucket:int,pairs:array<long>,n:array<int>>>"
)
_CUT = re.compile(r"(?<=\S) ")
SHIFT = np.int64(32)


class Tokenizers:
    """Ids and their bytes: first the byte-level vocabulary, then the one of pieces."""

    def __init__(self, vocabulary: str | None, pieces: str | None) -> None:
        import public_tokenizers
        import sentencepiece

        self.first = encoder(vocabulary)
        self.second = sentencepiece.SentencePieceProcessor(model_file=pieces or public_tokenizers.path(PIECES))
        self.first_bytes = [self.first.fast.decode_single_token_bytes(i) for i in range(self.first.fast.n_vocab)]
        names = [self.second.id_to_piece(i) for i in range(self.second.vocab_size())]
        self.second_bytes = [bytes([int(x[3:5], 16)]) if self.second.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]
        self.sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (self.first_bytes, self.second_bytes)]
        if any(SPACE in x.lstrip(SPACE) for x in names):
            raise ValueError("a piece has a space after another character, so texts can't be cut at spaces")
        self.blank = self.second.piece_to_id(SPACE)
        digits = [[b"%d%s" % (i, end) for i in range(max(map(len, (self.first_bytes, self.second_bytes))))] for end in (b",", b"|", b";")]
        self.digits = sum(digits, [])

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of space + text by both; None if the joined bytes of either are anything else."""
        a = self.first.encode_plain(" " + text)
        b = self.second.encode(text) if text else [self.blank]
        want = b" " + text.encode()
        same = b"".join(map(self.first_bytes.__getitem__, a)) == want == b"".join(map(self.second_bytes.__getitem__, b))
        return (a, b) if same else None


@cache
def tokenizers(vocabulary: str | None = None, pieces: str | None = None) -> Tokenizers:
    """One for each Python worker."""
    return Tokenizers(vocabulary, pieces)


def units(text: str) -> list[str]:
    """The text's units without the space each begins with; the first one's is the space before the text."""
    return _CUT.split(text)


class Aligned:
    """Units and their alignment: ends, groups and links of their tokens, as arrays over all units in a row."""

    def __init__(self, t: Tokenizers, names: list[str]) -> None:
        self.bad = np.zeros(len(names), bool)
        plain = [i for i, x in enumerate(names) if x and not x[-1].isspace()]  # a unit may follow these
        found = t.encode(" ".join(map(names.__getitem__, plain))) if plain else ([], [])
        alone = sorted(set(range(len(names))) - set(plain)) if found else range(len(names))
        order, a, b = (list(plain), list(found[0]), list(found[1])) if found else ([], [], [])
        for i in alone:
            own = t.encode(names[i])
            if own is None:
                self.bad[i] = True
                continue
            order.append(i)
            a += own[0]
            b += own[1]
        order = np.array(order, np.int64)
        self.a, self.b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(t.sizes[0][self.a]), np.cumsum(t.sizes[1][self.b])
        sizes = np.array([1 + len(names[i].encode()) for i in order], np.int64)
        unit_ends = np.cumsum(sizes)
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        label_a, label_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        unit_of = np.searchsorted(unit_ends, common)
        n = len(names)
        count = lambda x: np.bincount(order[x], minlength=n) if len(order) else np.zeros(n, np.int64)
        self.n_a, self.n_b, self.n_groups = count(unit_of[label_a]), count(unit_of[label_b]), count(unit_of)
        low = np.searchsorted(ends_b, np.concatenate(([0], ends_a[:-1]))[: len(ends_a)], side="right")
        each = np.searchsorted(ends_b, ends_a) - low + 1
        left = np.repeat(np.arange(len(self.a)), each)
        right = np.repeat(low - np.concatenate(([0], np.cumsum(each)[:-1]))[: len(each)], each) + np.arange(int(each.sum()))
        pairs = (self.a[left] << SHIFT) | self.b[right]
        unit = order[unit_of[label_a[left]]] if len(left) else left
        self.n_links = np.bincount(unit, minlength=n)
        self.first = np.concatenate(([0], np.cumsum(self.n_links)))
        self.pairs = pairs[np.argsort(unit, kind="stable")]
        self.texts = self._texts(t, n, order, unit_of, common, label_a, label_b)

    @classmethod
    def few_at_a_time(cls, t: Tokenizers, names: list[str]) -> Aligned:
        """The same of runs of JOINED characters (or a longer unit): aligning takes memory of some hundred times their size."""
        ends = np.cumsum(np.fromiter((len(x) + 1 for x in names), np.int64, len(names)))
        each, begin = [], 0
        while begin < len(names) or not each:
            done = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + JOINED, side="right")))
            each.append(cls(t, names[begin:end]))
            begin = end
        out = cls.__new__(cls)
        for x in ("bad", "n_a", "n_b", "n_groups", "n_links", "pairs"):
            setattr(out, x, np.concatenate([getattr(y, x) for y in each]))
        out.first = np.concatenate(([0], np.cumsum(out.n_links)))
        out.texts = list(chain.from_iterable(y.texts for y in each))
        return out

    def _texts(self, t: Tokenizers, n: int, order: np.ndarray, unit_of: np.ndarray, common: np.ndarray, label_a: np.ndarray, label_b: np.ndarray) -> list[bytes]:
        """Of each unit its groups as `a1,a2|b1;a3|b2,b3`."""
        out = [b""] * n
        if not len(common):
            return out
        upto_a, upto_b = np.searchsorted(label_a, np.arange(len(common) + 1)), np.searchsorted(label_b, np.arange(len(common) + 1))
        at_a, at_b = np.arange(len(label_a)) + upto_b[label_a], np.arange(len(label_b)) + upto_a[label_b + 1]
        size = len(t.digits) // 3
        last_a, last_b = np.zeros(len(label_a), bool), np.zeros(len(label_b), bool)
        last_a[upto_a[1:] - 1] = last_b[upto_b[1:] - 1] = True
        items = np.empty(len(label_a) + len(label_b), np.int64)
        items[at_a], items[at_b] = self.a + size * last_a, self.b + 2 * size * last_b
        words = list(map(t.digits.__getitem__, items.tolist()))
        blob = b"".join(words)
        lengths = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))))
        ends = lengths[at_b[upto_b[np.searchsorted(unit_of, np.arange(len(order)), side="right")] - 1] + 1].tolist()
        begin = 0
        for i, end in zip(order.tolist(), ends, strict=True):
            out[i] = blob[begin : end - 1]
            begin = end
        return out


class _Index(dict):
    """Numbers keys in the order of their first lookup."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


def _spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[i], begins[i] + 1, ... of sizes[i] each, in a row."""
    return np.repeat(begins - np.concatenate(([0], np.cumsum(sizes)[:-1]))[: len(sizes)], sizes) + np.arange(int(sizes.sum()))


def bucket_of(first: np.ndarray) -> np.ndarray:
    return (kernel.mix(first.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int32)


def _documents(doc: np.ndarray, unit: np.ndarray, found: Aligned, which: np.ndarray, pairs: int) -> np.ndarray:
    """In how many documents each pair is; a few documents at a time."""
    docs, links, begin = np.zeros(pairs, np.int64), found.n_links[unit], 0
    upto = np.cumsum(links)
    while begin < len(doc):
        end = int(np.searchsorted(upto, upto[begin] - links[begin] + LINKS, side="right"))
        if end < len(doc):
            end = max(int(np.searchsorted(doc, doc[end])), int(np.searchsorted(doc, doc[begin], side="right")))
        some = slice(begin, end)
        held = kernel.distinct(np.repeat(doc[some], links[some]) * pairs + which[_spread(found.first[:-1][unit[some]], links[some])])
        docs += np.bincount(held % pairs, minlength=pairs)
        begin = end
    return docs


def _chunk(t: Tokenizers, number: int, ids: list, texts: list[str | None]) -> pa.RecordBatch:
    index, of = _Index(), []
    for text in texts:
        of.append(np.array(list(map(index.__getitem__, units(text))) if text and SPACE not in text else [], np.int64))
    found = Aligned.few_at_a_time(t, list(index))
    of = [np.zeros(0, np.int64) if found.bad[x].any() else x for x in of]
    sha = [hashlib.sha256(b";".join(map(found.texts.__getitem__, x.tolist()))).hexdigest() if len(x) else "" for x in of]
    many = max(1, len(index))
    places, n = np.unique(np.concatenate([i * many + x for i, x in enumerate(of)]), return_counts=True)
    doc, unit = places // many, places % many
    total = lambda each: np.bincount(doc, each[unit] * n, len(of)).astype(np.int64).tolist()  # noqa: E731  below 2^53
    pairs, which = np.unique(found.pairs, return_inverse=True)
    bucket = bucket_of(pairs >> SHIFT)
    order = np.argsort(bucket, kind="stable")
    pairs, bucket = pairs[order], bucket[order]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    which = rank[which]
    docs = _documents(doc, unit, found, which, len(pairs))
    begin = np.searchsorted(bucket, np.arange(BUCKETS + 1))
    # every bucket is asked, so that answers stay aligned; those without pairs are left out of the rows and of the answers
    asked = [{"bucket": k, "pairs": pairs[x:y], "n": docs[x:y].astype(np.int32)} for k, (x, y) in enumerate(zip(begin, begin[1:], strict=False)) if x < y]
    row = {
        "chunk": number, "ids": ids, "n_a": total(found.n_a), "n_b": total(found.n_b), "n_groups": total(found.n_groups), "n_links": total(found.n_links), "sha": sha,
        "doc_first": np.searchsorted(doc, np.arange(len(of) + 1)).astype(np.int32), "doc_unit": unit.astype(np.int32), "doc_n": n.astype(np.int32),
        "unit_first": found.first.astype(np.int32), "unit_pair": which.astype(np.int32), "asked": asked,
    }
    return pa.RecordBatch.from_pylist([row], _SCHEMA)


_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_SCHEMA = pa.schema([
    ("chunk", pa.int64()), ("ids", _LONGS), *((x, _LONGS) for x in ("n_a", "n_b", "n_groups", "n_links")), ("sha", pa.list_(pa.string())),
    *((x, _INTS) for x in ("doc_first", "doc_unit", "doc_n", "unit_first", "unit_pair")), ("asked", pa.list_(pa.struct([("bucket", pa.int32()), ("pairs", _LONGS), ("n", _INTS)]))),
])


def _chunks(vocabulary: str | None, pieces: str | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t, number = tokenizers(vocabulary, pieces), TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in by_size(batches, "text", CHUNK_BYTES):
            ids += batch.column("id").to_pylist()
            texts += batch.column("text").to_pylist()
            size += batch.column("text").nbytes
            if size >= CHUNK_BYTES:
                yield _chunk(t, number, ids, texts)
                number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield _chunk(t, number, ids, texts)

    return run


def _numpy(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)


def _summed(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, which = np.unique(pairs, return_inverse=True)
    total = np.zeros(len(unique), np.int64)
    np.add.at(total, which, n)
    return unique, total


def _partial(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Counts of a bucket's and salt's pairs."""
    pairs, n = _summed(_numpy(rows.column("pairs")), _numpy(rows.column("n")))
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "pairs": pa.array([pairs], _LONGS), "n": pa.array([n], _LONGS)})


def _final(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Counts of a bucket's pairs, and whether a pair's is its first id's highest."""
    pairs, n = _summed(_numpy(rows.column("pairs")), _numpy(rows.column("n")))
    first = pairs >> SHIFT
    begin = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
    top = np.repeat(np.maximum.reduceat(n, begin), np.diff(np.append(begin, len(n))))
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "pairs": pa.array([pairs], _LONGS), "n": pa.array([n], _LONGS), "best": pa.array([n == top], pa.list_(pa.bool_()))})


def _answered(key: tuple[pa.Scalar, ...], asked: pa.Table, known: pa.Table) -> pa.Table:
    """Counts and verdicts of each row's pairs, in their order."""
    pairs, n, best = (_numpy(known.column(x)) for x in ("pairs", "n", "best"))
    lists = asked.column("pairs").combine_chunks()
    at = np.searchsorted(pairs, lists.flatten().to_numpy())
    offsets = pa.array(lists.offsets.to_numpy() - lists.offsets[0].as_py(), pa.int32())
    found = pa.ListArray.from_arrays(offsets, pa.array(n[at])), pa.ListArray.from_arrays(offsets, pa.array(best[at].astype(bool)))
    return pa.table({"chunk": asked.column("chunk"), "bucket": asked.column("bucket"), "n": found[0], "best": found[1]})


OUT = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(key: tuple[pa.Scalar, ...], chunk: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of one chunk; its buckets' answers in order are those of its pairs."""
    row = {x: chunk.column(x).combine_chunks()[0].values for x in chunk.column_names if x not in ("chunk", "asked")}
    answers = answers.sort_by("bucket")
    n, best = (_numpy(answers.column(x)) for x in ("n", "best"))
    unit_first, unit_pair, doc_first, unit, times = (row[x].to_numpy() for x in ("unit_first", "unit_pair", "doc_first", "doc_unit", "doc_n"))
    sums = []
    for each in (best.astype(np.int64), n.astype(np.int64)):
        by_unit = np.diff(np.concatenate(([0], np.cumsum(each[unit_pair])))[unit_first])
        by_place = np.concatenate(([0], np.cumsum(by_unit[unit] * times)))
        sums.append(pa.array(np.diff(by_place[doc_first]), pa.int64()))
    names = ["n_a", "n_b", "n_groups", "n_links"]
    return pa.table([row["ids"], *(row[x] for x in names), *sums, row["sha"]], names=["id", *names, "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pieces: str | None = None) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. vocabulary and pieces: the
    files of the byte-level vocabulary and of the pieces; by default the public tokenizers'."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    salts = parts(text_bytes(texts), SALT_BYTES)
    chunks = stored(texts.mapInArrow(tidy(_chunks(vocabulary, pieces)), CHUNK), "chunks", wide=True)
    asked = chunks.select("chunk", F.explode("asked").alias("a")).select("chunk", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int").alias("salt"), "a.bucket", "a.pairs", "a.n")
    partial = asked.drop("chunk").groupBy("bucket", "salt").applyInArrow(_partial, "bucket int, pairs array<long>, n array<long>")
    totals = stored(partial.groupBy("bucket").applyInArrow(_final, "bucket int, pairs array<long>, n array<long>, best array<boolean>"), "totals", wide=True)
    known = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    answers = asked.drop("n").groupBy("bucket", "salt").cogroup(known.groupBy("bucket", "salt")).applyInArrow(_answered, "chunk long, bucket int, n array<long>, best array<boolean>")
    # a chunk with its answers is a group, so no batch holds more than one
    out = chunks.drop("asked").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scored, OUT)
    return out.withColumnRenamed("id", id_col)
