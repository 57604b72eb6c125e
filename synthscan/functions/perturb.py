"""Span masking and filling, for perturbation detectors.

Masking draws span starts at random from a generator seeded by row, variant and attempt, so reruns and retried tasks
agree. Filling is a model's work: a function from masked texts to raw outputs, `<extra_id_0> fill <extra_id_1> ...`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = "<extra_id_{}>"
_MASK = re.compile(r"<extra_id_\d+>")
#: Where a word begins like a mask, and where one is a mask; what is looked for first is written first, so that it is found fast.
_BEGINS = re.compile(r"<extra_id_(?<!\S<extra_id_)")
_WHOLE = re.compile(r"<extra_id_(?<![^ ]<extra_id_)\d+>(?![^ ])")
SPAN, BUFFER, SHARE, ATTEMPTS = 2, 1, 0.3, 5
SLICE = 4 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(seeds: np.ndarray, attempt: int, begin: int, size: int) -> np.ndarray:
    """Numbers begin .. begin + size of each seed's row for an attempt (splitmix64): a few operations for all of a text's variants."""
    state = _mix(seeds.view(np.uint64) + np.array([attempt + 1], np.uint64) * np.uint64(0xD1342543DE82EF95))
    return _mix(state[:, None] + np.arange(begin + 1, begin + size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _wanted(words: int, span: int, buffer: int, share: float, ceil: bool) -> tuple[int, int, int]:
    """How many spans are wanted, in how many places they may begin, and how many places are tried at first."""
    wanted = share * words / (span + 2 * buffer)
    wanted = math.ceil(wanted) if ceil else int(wanted)
    return wanted, max(1, words - span), wanted + wanted // 2 + 4


def _placed(starts: list[int], more: Callable[[int], np.ndarray], wanted: int, room: int, reach: int) -> list[int]:
    """Those of the starts that lie `reach` from all before, and more of what is left if they are too few."""
    taken, near, out = bytearray(room + 2 * reach), b"\1" * (2 * reach - 1), []

    def tried(starts: list[int]) -> None:
        for start in starts:
            if len(out) == wanted:
                return
            if not taken[start + reach]:
                taken[start + 1 : start + 2 * reach] = near
                out.append(start)

    tried(starts)
    if len(out) < wanted:
        left = np.flatnonzero(np.frombuffer(bytes(taken), np.uint8)[reach : reach + room] == 0)
        tried(left[np.argsort(more(len(left)), kind="stable")].tolist())
    return sorted(out)


def spans(words: int, rng: np.random.Generator, span: int = SPAN, buffer: int = BUFFER, share: float = SHARE, ceil: bool = False) -> list[int]:
    """Where spans to be masked begin, in order. One after another is put at random where those before it leave room, `buffer`
    words apart, as long as there is room; the work is in proportion to the words."""
    wanted, room, size = _wanted(words, span, buffer, share, ceil)
    return _placed(rng.integers(0, room, size=size).tolist(), lambda n: rng.integers(0, 1 << 62, size=n), wanted, room, span + buffer) if wanted > 0 else []


def spans_of(words: int, seeds: np.ndarray, attempt: int, span: int = SPAN, buffer: int = BUFFER, share: float = SHARE, ceil: bool = False) -> list[list[int]]:
    """The same for each of some seeds."""
    wanted, room, size = _wanted(words, span, buffer, share, ceil)
    if wanted <= 0:
        return [[] for _ in seeds]
    first = (drawn(seeds, attempt, 0, size) % np.uint64(room)).tolist()
    return [_placed(x, lambda n, i=i: drawn(seeds[i : i + 1], attempt, size, n)[0], wanted, room, span + buffer) for i, x in enumerate(first)]


def offsets(text: str) -> list[int]:
    """Where words begin, and where one after the last would; words are split at single spaces."""
    return [x + i for i, x in enumerate(accumulate(map(len, text.split(" ")), initial=0))]


def with_masks(text: str, at: list[int], starts: list[int], span: int) -> str:
    """text with numbered masks instead of the spans; at: its offsets."""
    parts, done, last = [], 0, len(at) - 1
    for i, start in enumerate(starts):
        parts += text[done : at[start]], f"<extra_id_{i}>"
        done = at[min(start + span, last)] - 1
    parts.append(text[done:])
    return "".join(parts)


def masked(text: str, rng: np.random.Generator, span: int = SPAN, buffer: int = BUFFER, share: float = SHARE, ceil: bool = False) -> str:
    """Spans of words of the whole text replaced by numbered masks, kept `buffer` words apart."""
    at = offsets(text)
    return with_masks(text, at, spans(len(at) - 1, rng, span, buffer, share, ceil), span)


def n_masks(text: str) -> int:
    return len(_BEGINS.findall(text))


def mask_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x.startswith("<extra_id_")))


def fills(raw: str) -> list[str]:
    """The pieces between the first and the last mask of a model's output."""
    bare = raw.replace("<pad>", "").replace("</s>", "").strip()
    return [x.strip() for x in _MASK.split(bare)[1:-1]]


def filled(text: str, pieces: list[str]) -> str:
    """The masked text with its masks replaced; empty if there are too few pieces."""
    n = n_masks(text)
    if len(pieces) < n:
        return ""
    named = {MASK.format(i): piece for i, piece in enumerate(pieces[:n])}
    return _WHOLE.sub(lambda x: named.pop(x.group(), x.group()), text)


def repeat_fill(texts: list[str]) -> list[str]:
    """A filler without a model, for tests and trials: each mask becomes the words that stand for its number."""
    return ["".join([f"<extra_id_{i}> word{i} " for i in range(n)]) + MASK.format(n) for n in map(n_masks, texts)]


def tries(texts: list[str | None], seeds: list[np.ndarray], fill: Callable[[list[str]], list[str]], span: int = SPAN, **options) -> list[list[tuple[list[int], str, list[str]] | None]]:
    """Of each text, for each of its seeds but the first: where spans began, the masked text and its masks' pieces; none if filling failed
    every time. Failed ones are masked and filled anew, up to four times, as a part of the texts given."""
    out: list[list] = [[None] * (len(x) - 1) for x in seeds]
    left = [(i, np.arange(len(x))) for i, x in enumerate(out) if texts[i] is not None and x]
    at = [[] if x is None else offsets(x) for x in texts]
    own = [n_masks(x or "") for x in texts]  # words of a text itself that begin like masks
    for attempt in range(ATTEMPTS):
        if not left:
            break
        starts = [spans_of(len(at[i]) - 1, seeds[i][v + 1], attempt, span, **options) for i, v in left]
        given = [with_masks(texts[i], at[i], x, span) for (i, _), xs in zip(left, starts, strict=True) for x in xs]
        raw, k, again = fill(given), 0, []
        for (i, vs), xs in zip(left, starts, strict=True):
            failed = []
            for v, x in zip(vs.tolist(), xs, strict=True):
                one, pieces = given[k], fills(raw[k])
                k += 1
                if len(pieces) < (n_masks(one) if own[i] else len(x)) or not one or (one == "<extra_id_0>" and not pieces[0]):
                    failed.append(v)
                else:
                    out[i][v] = x, one, pieces
            if failed:
                again.append((i, np.array(failed)))
        left = again
    return out


def seeded(df: DataFrame, row_id: str, text: str, n: int, seed: int = 0) -> DataFrame:
    """df's row_id and text with _seeds, a number for each of the variants 0..n."""
    seeds = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda v: F.xxhash64(F.col(row_id).cast("string"), v, F.lit(seed)))
    return df.select(row_id, text, seeds.alias("_seeds"))


def slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begins and ends of runs of rows with about SLICE characters, whatever the batch."""
    upto, begin = np.cumsum(sizes), 0
    while begin < len(upto):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + SLICE, side="right")))
        yield begin, end
        begin = end


def perturbed(df: DataFrame, row_id: str, text: str, n: int, fill: Callable[[list[str]], list[str]] = repeat_fill, seed: int = 0, **options) -> DataFrame:
    """(row_id, variant, text): variant 0 is the text itself, 1..n its perturbations ('' if filling failed every time).

    Texts are masked and filled as a whole. Failed fills are masked and filled anew, up to four times, as part of their batch, of
    about SLICE characters.
    """
    rows = seeded(df, row_id, text, n, seed)

    def some(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for own, found in zip(batch[text], tries(list(batch[text]), list(batch["_seeds"]), fill, **options), strict=True):
            out.append(own)
            out += ["" if x is None else filled(*x[1:]) for x in found]
        return pd.DataFrame({row_id: batch[row_id].repeat(n + 1), "variant": np.tile(np.arange(n + 1, dtype=np.int32), len(batch)), text: out})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin, end in slices(np.array([(n + 1) * len(x or "") for x in batch[text]], np.int64)):
                yield some(batch.iloc[begin:end])

    kinds = dict(df.dtypes)
    return rows.mapInPandas(run, f"`{row_id}` {kinds[row_id]}, variant int, `{text}` string")
