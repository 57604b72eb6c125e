"""n-gram overlap of a text's remainder with regenerated continuations (the BScore of divergent n-gram analysis).

  BScore = 1/K  sum over n in n_min..n_max, k  of  n ln n |G_n(y_k) and G_n(y_0)| / (|y_k| |G_n(y_0)|)

with G_n the distinct n-grams and |y_k| the tokens of continuation k. Two equal formulations: Catalyst expressions, and
an Arrow function that is several times faster for many continuations.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .porter import stem

N_MIN, N_MAX = 1, 25


def tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def without(words: Column, stopwords: Iterable[str]) -> Column:
    """words that are not stop words, repeats kept."""
    listed = F.array(*(F.lit(x) for x in sorted(stopwords)))
    return F.filter(words, lambda x: ~F.array_contains(listed, x))


def _stems(words: Iterable[str] | None) -> list[str] | None:
    return None if words is None else [stem(w) if len(w) > 3 else w for w in words]


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed(words: pd.Series) -> pd.Series:
    """Stems of the words longer than three characters; each distinct word is stemmed once a worker."""
    return words.map(_stems)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def stemmed_each(texts: pd.Series) -> pd.Series:
    """The same for an array of texts' words."""
    return texts.map(lambda x: None if x is None else [_stems(y) for y in x])


def ngrams(words: Column, n: int | Column) -> Column:
    """Distinct n-grams, joined by spaces."""
    n = F.lit(n) if isinstance(n, int) else n
    starts = F.when((n > 0) & (F.size(words) >= n), F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.concat_ws(" ", F.slice(words, i, n))))


def bscore(rest: Column, continuations: Column, n_min: int = N_MIN, n_max: int = N_MAX) -> Column:
    """BScore of token arrays: rest, and an array of continuations. 0 if rest is empty or there are none."""
    lengths = F.filter(F.sequence(F.lit(max(2, n_min)), F.lit(max(2, n_min, n_max))), lambda n: (n <= n_max) & (n <= F.size(rest)))

    def one(total: Column, n: Column) -> Column:
        grams = ngrams(rest, n)

        def share(acc: Column, y: Column) -> Column:
            overlap = F.size(F.array_intersect(ngrams(y, n), grams)).cast("double")
            return acc + F.when(F.size(y) > 0, n * F.log(n.cast("double")) * overlap / (F.size(y) * F.size(grams))).otherwise(0.0)

        return total + F.aggregate(continuations, F.lit(0.0), share)

    k = F.size(continuations)
    return F.when((k > 0) & (F.size(rest) > 0), F.aggregate(lengths, F.lit(0.0), one) / k).otherwise(0.0)


def bscore_of(rest: list[str], continuations: list[list[str]], n_min: int = N_MIN, n_max: int = N_MAX) -> float:
    """The same for Python lists."""
    if not rest or not continuations:
        return 0.0
    total = 0.0
    for n in range(max(2, n_min), min(n_max, len(rest)) + 1):
        own = set(zip(*(rest[i:] for i in range(n))))
        weight = n * math.log(n) / len(own)
        for y in continuations:
            if len(y) >= n:
                total += weight * len(own.intersection(zip(*(y[i:] for i in range(n))))) / len(y)
    return total / len(continuations)


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def bscore_by_hash(rest: list[str], continuations: list[list[str]], n_min: int = N_MIN, n_max: int = N_MAX) -> float:
    """The same with n-grams told by 64-bit hashes, all continuations at a time."""
    number: dict[str, int] = {}
    ids = lambda words: np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64)
    return bscore_of_ids(ids(rest), ids(chain.from_iterable(continuations)), np.array([len(y) for y in continuations], np.int64), n_min, n_max)


def bscore_of_ids(rest: np.ndarray, others: np.ndarray, lengths: np.ndarray, n_min: int = N_MIN, n_max: int = N_MAX) -> float:
    """The same for numbers of words; others: those of all continuations in a row, of the given lengths."""
    if not len(rest) or not len(lengths):
        return 0.0
    own, other = _scrambled(rest + np.uint64(1)), _scrambled(others + np.uint64(1))
    of = np.repeat(np.arange(len(lengths)), lengths)
    room = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(other))  # words from here to the continuation's end
    x, y, total = own.copy(), other.copy(), 0.0
    begin = np.arange(len(other))  # of the n-grams y: a longer one can be shared only where a shorter one is
    for n in range(1, min(n_max, len(rest)) + 1):
        if n > 1:  # one word more
            x = _scrambled(x[:-1] * _FACTOR + own[n - 1 :])
            on = room[begin] >= n
            begin = begin[on]
            y = _scrambled(y[on] * _FACTOR + other[begin + n - 1])
        grams = np.unique(x, return_index=True)[0]  # sorts; without the index numpy hashes
        at = np.searchsorted(grams, y)
        hit = grams[np.minimum(at, len(grams) - 1)] == y
        begin, y, at = begin[hit], y[hit], at[hit]
        if not len(begin):
            break  # longer ones would hold shared ones of this length
        if n < max(2, n_min):
            continue
        shared = np.bincount(np.unique(of[begin] * len(grams) + at, return_index=True)[0] // len(grams), minlength=len(lengths))
        total += n * math.log(n) / len(grams) * float((shared / np.maximum(lengths, 1)).sum())
    return total / len(lengths)


def bscore_fast(n_min: int = N_MIN, n_max: int = N_MAX):
    """A function of (rest, continuations) columns that computes BScore on Arrow batches."""

    @F.pandas_udf(T.DoubleType())
    def score(rest: pd.Series, continuations: pd.Series) -> pd.Series:
        return pd.Series([bscore_by_hash(list(a), [list(y) for y in b], n_min, n_max) for a, b in zip(rest, continuations, strict=True)], dtype="float64")

    return score


class Numbers(dict):
    """Numbers of words as bytes, or of their stems, in the order of their first lookup; -1 for stop words. It begins anew at MOST."""

    MOST = 1 << 20

    def __init__(self, stopwords: Iterable[str] = (), stems: bool = False) -> None:
        super().__init__()
        self.stop, self.stems, self.own = frozenset(stopwords), stems, {}

    def __missing__(self, key: bytes) -> int:
        word = key.decode()
        if word in self.stop:
            number = -1
        else:
            base = stem(word) if self.stems and len(word) > 3 else word
            number = self.own.setdefault(base, len(self.own))
        self[key] = number
        return number

    def of(self, text: str | None) -> np.ndarray:
        words = text.lower().encode(errors="replace").translate(_SPACED).split() if text else []
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return ids[ids >= 0].astype(np.uint64) if self.stop else ids.astype(np.uint64)

    def bounded(self) -> None:
        """Called between texts."""
        if len(self) > self.MOST:
            self.clear()
            self.own.clear()


#: Other bytes than a-z and 0-9, as all of a character beyond ASCII are, become spaces.
_SPACED = bytes(x if chr(x) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for x in range(256))
_SLICE = 64


def bscore_of_texts(n_min: int = N_MIN, n_max: int = N_MAX, stopwords: Iterable[str] = (), stems: bool = False):
    """A function of (rest, continuations) columns, texts as they are, that cuts them into words, leaves out stop words, takes stems
    if wanted, and computes BScore. Texts are read a few rows at a time, and only numbers of words are kept."""
    stopwords = sorted(stopwords)

    @F.arrow_udf(T.DoubleType())
    def score(rest: pa.Array, continuations: pa.Array) -> pa.Array:
        numbers, out = Numbers(stopwords, stems), []
        for begin in range(0, len(rest), _SLICE):
            for a, ys in zip(rest.slice(begin, _SLICE).to_pylist(), continuations.slice(begin, _SLICE).to_pylist(), strict=True):
                numbers.bounded()
                own = numbers.of(a)
                others = [numbers.of(y) for y in ys or ()] if len(own) else []
                flat = np.concatenate(others) if others else np.zeros(0, np.uint64)
                out.append(bscore_of_ids(own, flat, np.array([len(y) for y in others], np.int64), n_min, n_max))
        return pa.array(out, pa.float64())

    return score
