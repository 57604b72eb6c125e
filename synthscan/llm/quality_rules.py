"""Quality rules: text statistics, a fixed base, and a decision list learned from labelled documents.

The list is grown by sequential covering, as in IREP and RIPPER. Labelled rows are dealt into a growing and a pruning
part. A rule starts empty and takes the threshold condition with the best FOIL gain until it covers no good document
of the growing part; then its last conditions go while that doesn't lower (p - n) / (p + n) on the pruning part. What a
rule covers is taken out and the next one is grown, until a rule's precision on the pruning part falls below
`precision` or it covers fewer than `support` rejected documents of either part. The rules are emitted as one ordered
Spark conditional expression over the statistics, so applying them is a projection.

Fitting takes at most `max_rows` labels (the smallest id hashes; the documented bound), which are broadcast to their
documents; the statistics, and the rules' application, cover all documents. Rows that share a labelled id count
each, within the bound.

Defined cases: null and wordless texts have zero statistics and fail the base; no labels, or labels of one kind only,
give an empty list that rejects nothing; label rows with nulls are ignored; an id labelled twice counts twice; rows that
share an id are judged each by its own text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .common import by_size, byte_texts, stored, tidy

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
CHUNK_BYTES, WINDOW = 1 << 20, 8


def _bytes(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters.encode())] = True
    return table


_SYMBOLS, _UPPER, _MARKS = _bytes("#*$%&|<>"), _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("!?")


def _sums(marks: np.ndarray, begin: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
    return total[begin[1:]] - total[begin[:-1]]


def _equal(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items have an equal one in the same text, and which have one before them."""
    keys = kernel.mix(keys + owner.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    return any_, later


def statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The statistics of each text."""
    words = kernel.words(texts)
    raw = np.frombuffer(words.data, np.uint8)
    begin = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))
    in_words = np.zeros(len(raw) + 1, np.int8)
    in_words[words.starts] = 1
    in_words[words.ends] -= 1
    inside = np.cumsum(in_words[:-1], dtype=np.int8).astype(bool)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = np.concatenate(([0], np.cumsum(inside)))
    full = count[ends] > count[starts]
    of = np.searchsorted(begin, starts, side="right") - 1
    _, later = _equal(kernel.spans(words.data, starts[full], ends[full]), of[full])
    h = words.hashes()
    ok = kernel.inside(words.first, WINDOW, len(h))
    at = np.flatnonzero(ok)
    twice, _ = _equal(kernel.windows(h, WINDOW)[at], words.text_of[at])
    marks = np.zeros(len(ok), bool)
    marks[at] = twice
    n = len(texts)
    return {
        "n_words": np.diff(words.first),
        "word_chars": _sums(inside & (raw & 0xC0 != 0x80), begin),
        "n_symbols": _sums(_SYMBOLS[raw], begin),
        "n_dup_lines": np.bincount(of[full][later], minlength=n),
        "n_repeat_words": _sums(kernel.covered(marks, WINDOW, len(h)), words.first),
        "n_lines": np.bincount(of[full], minlength=n),
        "n_upper": _sums(_UPPER[raw], begin),
        "n_marks": _sums(_MARKS[raw], begin),
    }


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and its statistics; a column of docs that has a statistic's name is replaced."""
    kept = docs.drop(*STATISTICS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, text_col, CHUNK_BYTES):
            found = statistics(byte_texts(batch.column(text_col)))
            columns = [*batch.columns, *(pa.array(found[x], pa.int64()) for x in STATISTICS)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *STATISTICS])

    return kept.mapInArrow(tidy(run), T.StructType([*kept.schema.fields, *(T.StructField(x, T.LongType()) for x in STATISTICS)]))


#: What rules may test: name -> (statistic, statistic it is divided by).
FEATURES = {
    "words": ("n_words", None),
    "chars_a_word": ("word_chars", "n_words"),
    "symbols_a_word": ("n_symbols", "n_words"),
    "dup_lines_a_line": ("n_dup_lines", "n_lines"),
    "repeat_words_a_word": ("n_repeat_words", "n_words"),
    "upper_a_char": ("n_upper", "word_chars"),
    "marks_a_word": ("n_marks", "n_words"),
}


def feature(name: str) -> Column:
    top, bottom = FEATURES[name]
    return F.col(top).cast("double") if bottom is None else F.coalesce(F.try_divide(F.col(top).cast("double"), F.col(bottom)), F.lit(0.0))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass
class DecisionList:
    """Ordered rules, each a conjunction of (feature, '<=' or '>', threshold); the first that holds rejects."""

    rules: list[list[tuple[str, str, float]]] = field(default_factory=list)

    def rule(self) -> Column:
        """The number of the first rule that holds, from 1; 0 if none does."""
        out = F
        for i, rule in enumerate(self.rules, 1):
            holds = F.lit(True)
            for name, sign, threshold in rule:
                holds &= feature(name) <= threshold if sign == "<=" else feature(name) > threshold
            out = out.when(holds, i)
        return F.lit(0) if out is F else out.otherwise(0)

    def __str__(self) -> str:
        return "\n".join(" and ".join(f"{n} {s} {t:.6g}" for n, s, t in rule) for rule in self.rules)


def _holds(x: np.ndarray, condition: tuple[int, str, float]) -> np.ndarray:
    i, sign, threshold = condition
    return x[:, i] <= threshold if sign == "<=" else x[:, i] > threshold


def _best(x: np.ndarray, bad: np.ndarray, bins: int) -> tuple[float, tuple[int, str, float]] | None:
    """The condition with the best FOIL gain on these rows."""
    p0, best = bad.mean(), None
    for i in range(x.shape[1]):
        order = np.argsort(x[:, i], kind="stable")
        values, hit = x[order, i], np.cumsum(bad[order])
        cuts = np.flatnonzero(values[1:] > values[:-1])
        if len(cuts) > bins:
            cuts = cuts[np.linspace(0, len(cuts) - 1, bins).astype(int)]
        for sign in ("<=", ">"):
            n = cuts + 1 if sign == "<=" else len(values) - cuts - 1
            p = hit[cuts] if sign == "<=" else hit[-1] - hit[cuts]
            gain = p * (np.log2(np.maximum(p, 1e-9) / n) - np.log2(p0))
            if len(gain) and (best is None or gain.max() > best[0]):
                k = int(np.argmax(gain))
                best = float(gain[k]), (i, sign, float((values[cuts[k]] + values[cuts[k] + 1]) / 2))
    return best


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], precision: float = 0.95, support: int = 3, bins: int = 4096, most_rules: int = 24) -> DecisionList:
    """A decision list for the rejected rows (bad) of x; rows are dealt to growing and pruning two to one, in turn."""
    out, grow = DecisionList(), np.arange(len(x)) % 3 != 2
    left = np.ones(len(x), bool)
    while len(out.rules) < most_rules:
        g, q = left & grow, left & ~grow
        if bad[g].sum() < support or bad[g].all():
            break
        rule, rows = [], np.flatnonzero(g)
        while not bad[rows].all() and len(rule) < x.shape[1]:
            best = _best(x[rows], bad[rows], bins)
            if best is None or best[0] <= 1e-9:
                break
            rule.append(best[1])
            rows = rows[_holds(x[rows], best[1])]

        def worth(conditions: list, part: np.ndarray) -> tuple[float, int, int]:
            on = part.copy()
            for c in conditions:
                on &= _holds(x, c)
            p, n = int(bad[on].sum()), int((~bad[on]).sum())
            return ((p - n) / (p + n) if p + n else -1.0), p, n

        while len(rule) > 1 and worth(rule[:-1], q)[0] >= worth(rule, q)[0]:
            rule.pop()
        (_, p, n), (_, gp, gn) = worth(rule, q), worth(rule, g)
        if not rule or p + n == 0 or p < support or gp < support or p < precision * (p + n) or gp < precision * (gp + gn):
            break
        out.rules.append([(names[i], sign, threshold) for i, sign, threshold in rule])
        covered = left.copy()
        for c in rule:
            covered &= _holds(x, c)
        left &= ~covered
    return out


def chosen(labels: DataFrame, id_col: str, label_col: str, max_rows: int) -> DataFrame:
    """(id, bad) of max_rows usable labels at most, those with the smallest id hashes; label 0 is bad, to be rejected."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) == 0).alias("bad"))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    if (n := known.count()) > max_rows:  # so that tasks send the driver little more than is kept
        known = known.where(place < F.lit(int(1.1 * max_rows / n * (1 << 40))))
    return stored(known.orderBy(place, "id", "bad").limit(max_rows), "labels")


def fit(stats: DataFrame, known: DataFrame, max_rows: int = 20_000) -> DecisionList:
    """Learn from stats (id and statistics) of the ids that are known (id, bad), as few as `chosen` gives."""
    rows = stats.where(~base_failed()).select("id", *(feature(x).alias(x) for x in FEATURES)).join(F.broadcast(known), "id")
    seen = rows.orderBy(F.xxhash64("id"), "id", "bad", *FEATURES).limit(max_rows).select("bad", *FEATURES).toPandas()
    bad = seen["bad"].to_numpy(bool)
    return learn(seen[list(FEATURES)].to_numpy(float), bad, list(FEATURES)) if bad.any() and not bad.all() else DecisionList()


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000) -> DecisionList:
    """Learn from documents and labels; only the texts of chosen labels are looked at, and none is shuffled."""
    known = chosen(labels, id_col, label_col, max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).join(F.broadcast(known.select("id").distinct()), "id", "left_semi")
    return fit(with_statistics(texts, "_text").drop("_text"), known, max_rows)


def judged(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """stats with base_failed, rule (the first that rejects, else 0) and kept."""
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", rules.rule())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000) -> DataFrame:
    """Id, statistics, base_failed, rule and kept of every document."""
    stats = stored(with_statistics(docs.select(F.col(id_col), F.col(text_col).alias("_text")), "_text").drop("_text"), "statistics")
    return judged(stats, fit(stats.withColumnRenamed(id_col, "id"), chosen(labels, id_col, "quality", max_rows), max_rows))
