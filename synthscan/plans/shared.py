"""One run of a model for all detectors that need its output.

Detectors are grouped by the kind of output they need and the models it comes from. A group's models see each text once;
every detector of it is an expression over the same packed rows, or an aggregate of one pass over the same token scores.

- tokens: rank, log-rank, lrr, fast-detect-gpt (where it has no model of its own) and npr. With npr the run is over the
  perturbed texts, whose variant 0 is the text itself, and one narrow aggregation by row follows; without it, nothing is
  shuffled.
- cross: binoculars; with draws or other options it is a group of its own.
- Without a provider all detectors share one counted model, whose tables are made once.
- Any other detector is a group of its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..detectors.registry import Detector
from ..detectors.zero_shot import PerturbationRatio
from ..operators import statistics as S
from ..plans.tables import stored
from ..providers.base import Provider
from ..providers.ngram import NGramModel

TOKENS, CROSS = "tokens", "cross"


@dataclass
class Group:
    """Detectors by name, and what their common output comes from."""

    kind: str
    provider: Provider | None
    detectors: dict[str, Detector] = field(default_factory=dict)


def grouped(detectors: dict[str, Detector], df: DataFrame) -> list[Group]:
    """The fewest groups, in the order of their first detectors."""
    groups: dict[tuple, Group] = {}
    counted = None
    for name, detector in detectors.items():
        kind, provider = detector.needs, detector.options.get("provider")
        if kind and provider is None:
            counted = counted or NGramModel(df)
        own = (provider.of(name) if provider else counted) if kind else None
        if own is None:
            key: tuple = (name,)
        elif kind == CROSS and any(detector.options.get(x) for x in ("sample", "median")):
            key = (kind, own.key(kind), name)
        else:
            key = (kind, own.key(kind))
        groups.setdefault(key, Group(kind or "own", own)).detectors[name] = detector
    return list(groups.values())


def scores(df: DataFrame, group: Group) -> DataFrame:
    """(row_id, a column for each detector) of a group; rows without a score may be missing or null."""
    names, provider = list(group.detectors), group.provider
    if group.kind == TOKENS:
        found = _tokens(df, group)
    elif len(names) == 1:
        detector = group.detectors[names[0]]
        if provider is not None and "provider" not in detector.options:
            detector.options["counted"] = provider
        found = detector.score(df).withColumnRenamed("score", names[0])
    else:
        raise ValueError(f"{names} share nothing")
    return found.select("row_id", *(F.col(f"`{x}`").cast("double").alias(x) for x in names))


def _tokens(df: DataFrame, group: Group) -> DataFrame:
    provider, names = group.provider, list(group.detectors)
    npr = next((d for d in group.detectors.values() if isinstance(d, PerturbationRatio)), None)
    plain = [x for x in names if not isinstance(group.detectors[x], PerturbationRatio)]
    texts = stored(npr.variants(df), "perturbed") if npr else df.select("row_id", F.lit(0).alias("variant"), "text")
    if provider.packs:
        packed = provider.packed_scores(texts)
        if not npr:
            return packed.select("row_id", *(S.packed(x).alias(x) for x in plain))
        each = packed.select("row_id", "variant", *(S.packed(x).alias(x) for x in plain), S.packed("log-rank").alias("_lr"))
        own = [F.max(F.when(F.col("variant") == 0, F.col(f"`{x}`"))).alias(x) for x in plain]
        return each.groupBy("row_id").agg(*own, S.npr_of_log_ranks("_lr").alias("npr"))
    if not npr:
        # a model that is counted on the texts themselves is asked for none
        return provider.zero_shot() if isinstance(provider, NGramModel) else S.zero_shot(provider.token_scores(texts))
    sums = stored(S.sums(npr.token_scores(provider, texts)), "sums")
    found = S.from_sums(sums.where("variant = 0")).select("row_id", *(F.col(f"`{x}`") for x in plain)) if plain else None
    ratio = S.npr_of_sums(sums)
    return ratio if found is None else ratio.join(found, "row_id", "left")
