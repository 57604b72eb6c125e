"""Array kernels over words: tokenise and hash many texts at once, without a Python step per word.

A word is a maximal run of bytes other than space and 0x09..0x0D; UTF-8 keeps those bytes for these characters
alone, so byte words and character words agree. Hashes are 64 bits wide, the same in every process; those of different
seeds are independent, and two of them tell spans apart by 128 bits.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache

import numpy as np

U = np.uint64
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
_HEAD = np.array([(1 << 8 * i) - 1 for i in range(9)], U)
#: Blocks that are hashed at once, which bounds the memory of very long spans.
SLICE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """Words of several texts: word w is data[starts[w]:ends[w]], text t has words first[t]..first[t+1]."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, seed: int = 0) -> np.ndarray:
        return spans(self.data, self.starts, self.ends, seed)


def spans(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of each span of bytes: its blocks of 8, each scrambled under its own number, summed and scrambled again.

    The scramble is not linear, so unlike a polynomial's its sums have no words built to agree.
    """
    blocks = np.ndarray((len(data),), "<u8", data + bytes(8), strides=(1,))
    sizes = (ends - starts).astype(np.int64)
    n = np.maximum(1, (sizes + 7) >> 3)
    begin = np.concatenate(([0], np.cumsum(n)))
    salt = mix(np.arange(1, int(n.max(initial=1)) + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(2 * seed + 1))
    out = np.zeros(len(starts), U)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(begin, begin[low] + SLICE, side="right")) - 1)
        if high == low + 1 and n[low] > SLICE:  # one long span, block by block
            for first in range(0, int(n[low]), SLICE):
                number = np.arange(first, min(first + SLICE, int(n[low])))
                left = np.clip(sizes[low] - 8 * number, 0, 8)
                out[low:high] += mix((blocks[np.minimum(starts[low] + 8 * number, len(data) - 1)] & _HEAD[left]) ^ salt[number]).sum(dtype=U)
        else:
            own = n[low:high]
            number = np.arange(begin[high] - begin[low]) - np.repeat(begin[low:high] - begin[low], own)
            left = np.clip(np.repeat(sizes[low:high], own) - 8 * number, 0, 8)
            at = np.minimum(np.repeat(starts[low:high], own) + 8 * number, len(data) - 1)
            out[low:high] = np.add.reduceat(mix((blocks[at] & _HEAD[left]) ^ salt[number]), begin[low:high] - begin[low])
        low = high
    return mix(out + sizes.astype(U) * U(0xD6E8FEB86659FD93))


def words(texts: list[bytes], lower: bool = False) -> Words:
    data = b"\n".join(texts) + b"\n"
    if lower:
        data = data.lower()  # of bytes: A-Z only
    edge = np.diff(_SEPARATOR[np.frombuffer(data, np.uint8)].view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    ends = ends[len(ends) - len(starts):] if len(starts) else starts
    begin = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))
    return Words(data, starts, ends, np.searchsorted(starts, begin))


def distinct(x: np.ndarray) -> np.ndarray:
    """The values in order, each once. By sorting: numpy's own way for whole numbers is a hash table that regular values fill unevenly."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of x are in a sorted array."""
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


@cache
def _factors(n: int, seed: int) -> list[int]:
    rng = np.random.default_rng(1000 * seed + n)
    return [int(x) | 1 for x in rng.integers(0, 1 << 63, n)]


def windows(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of the n words from each word on, for the len(h) - n + 1 starts, texts not minded."""
    if len(h) < n:
        return np.zeros(0, U)
    out, last = np.zeros(len(h) - n + 1, U), len(h) - n + 1
    for i, factor in enumerate(_factors(n, seed)):
        out += h[i : i + last] * U(factor)
    return mix(out)


def inside(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the total - n + 1 window starts stay within one text."""
    size = max(0, total - n + 1)
    ends = np.repeat(first[1:], np.diff(first))[:size]
    return np.arange(size) + n <= ends


def covered(marks: np.ndarray, n: int, total: int) -> np.ndarray:
    """Words that lie in a marked window of n words; marks: a bool for each window start."""
    steps = np.zeros(total + 1, np.int32)
    at = np.flatnonzero(marks)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + n, -1)
    return np.cumsum(steps[:total]) > 0


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
