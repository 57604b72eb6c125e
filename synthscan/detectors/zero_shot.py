"""Detectors from token scores. Scores are given as computed; only binoculars is negated.

Option `provider`: where token scores come from; by default an n-gram model of the scored texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.perturb import perturbed
from ..operators import statistics as S
from ..plans.tables import spread, stored
from ..providers.base import Provider, mask_filler
from ..providers.ngram import NGramModel
from ..providers.perturbed import PerturbedChunks
from .registry import Detector, register


class _ZeroShot(Detector):
    needs = "tokens"

    def own(self, df: DataFrame, texts: DataFrame) -> tuple[Provider, DataFrame | None]:
        """The provider and the texts to ask it for; a model that is counted on the texts themselves is asked for none."""
        given = self.options.get("provider")
        return (given.of(self.name), texts) if given else (self.options.get("counted") or NGramModel(df), None)

    def score(self, df: DataFrame) -> DataFrame:
        provider, texts = self.own(df, df.select("row_id", F.lit(0).alias("variant"), "text"))
        if provider.packs:
            return provider.packed_scores(texts).select("row_id", S.packed(self.name).alias("score"))
        found = provider.zero_shot() if texts is None else S.zero_shot(provider.token_scores(texts))
        return df.select("row_id").join(found.select("row_id", F.col(f"`{self.name}`").alias("score")), "row_id", "left")


@register("rank")
class Rank(_ZeroShot):
    """Mean rank of the tokens."""


@register("log-rank")
class LogRank(_ZeroShot):
    """Mean logarithm of the ranks."""


@register("lrr")
class LogRankRatio(_ZeroShot):
    """Mean log-likelihood by mean log-rank."""


@register("fast-detect-gpt")
class SamplingDiscrepancy(_ZeroShot):
    """Log-likelihood against what sampling gives."""


@register("binoculars")
class Binoculars(_ZeroShot):
    """Perplexity by cross-perplexity of two models, negated.

    Options: median (medians of the positions instead of means); sample, temperature and seed (cross-entropy from one
    token drawn for each place instead of the whole vocabulary; for providers that can).
    """

    needs = "cross"

    def score(self, df: DataFrame) -> DataFrame:
        provider, texts = self.own(df, df.select("row_id", "text"))
        drawn = (self.options.get("temperature", 1.0), self.options.get("seed", 0)) if self.options.get("sample") else ()
        if provider.packs:
            return provider.packed_cross_scores(texts, *drawn).select("row_id", S.packed("binoculars", self.options.get("median", False)).alias("score"))
        median = self.options.get("median", False)
        if texts is None:
            found = provider.binoculars(median, drawn or None)
        else:
            performer, cross = provider.cross_scores(texts)
            if drawn:
                cross = provider.sampled_cross_scores(texts, *drawn)
            found = S.perplexity_ratio(performer, cross, median=median)
        return df.select("row_id").join(found.withColumnRenamed("binoculars", "score"), "row_id", "left")


@register("npr")
class PerturbationRatio(_ZeroShot):
    """Log-rank of perturbed texts by that of the text.

    Options: fill (masked texts to raw fills; by default a neural model's, which needs its library), n_perturbations, seed,
    span, buffer, share, ceil, fill_model, fill_backend, and fill_options: top_p, most, batch_size and gpus of the filling model.
    """

    def _own(self) -> dict:
        return {k: self.options[k] for k in ("seed", "span", "buffer", "share", "ceil") if k in self.options}

    def filler(self) -> Callable[[list[str]], list[str]]:
        fill = self.options.get("fill")
        return mask_filler(self.options.get("fill_model"), self.options.get("fill_backend", "hf"), **self.options.get("fill_options", {})) if fill is None else fill

    def variants(self, df: DataFrame) -> DataFrame:
        """(row_id, variant, text): the texts as variant 0 and their perturbations; to be used once, or stored."""
        return perturbed(spread(df), "row_id", "text", self.options.get("n_perturbations", 10), self.filler(), **self._own())

    def token_scores(self, provider: Provider, texts: DataFrame) -> DataFrame:
        if isinstance(provider, NGramModel):
            return provider.variant_scores(texts, self.options.get("n_perturbations", 10))
        return provider.token_scores(texts)

    def score(self, df: DataFrame) -> DataFrame:
        provider = self.options.get("provider") or self.options.get("counted")
        if provider is None:  # a model of the texts themselves
            found = S.npr_of_sums(PerturbedChunks(spread(df), self.options.get("n_perturbations", 10), self.filler(), **self._own()).log_ranks())
            return df.select("row_id").join(found.withColumnRenamed("npr", "score"), "row_id", "left")
        texts = self.variants(df)
        if provider.packs:
            each = provider.packed_scores(stored(texts, "perturbed")).select("row_id", "variant", S.packed("log-rank").alias("lr"))
            return each.groupBy("row_id").agg(S.npr_of_log_ranks("lr").alias("score"))
        if isinstance(provider, NGramModel):
            found = S.npr_of_sums(provider.variant_sums(texts))
        else:
            found = S.perturbation_ratio(provider.token_scores(stored(texts, "perturbed")))
        return df.select("row_id").join(found.withColumnRenamed("npr", "score"), "row_id", "left")


def all_zero_shot(df: DataFrame, provider: Provider | None = None) -> DataFrame:
    """(row_id, rank, log-rank, lrr, fast-detect-gpt) from one pass over the token scores."""
    if provider is None:
        return NGramModel(df).zero_shot()
    return S.zero_shot(provider.token_scores(df.select("row_id", F.lit(0).alias("variant"), "text")))
