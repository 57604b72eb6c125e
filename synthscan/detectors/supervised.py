"""Detectors from a classifier's logits. Option `provider` gives them: logits(texts, model) -> (row_id, logits)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mage import normalised
from ..operators.statistics import class_logit, class_probability
from .registry import Detector, register


class _Supervised(Detector):
    model: str
    max_tokens = 512

    def preprocessed(self, text: Column) -> Column:
        return text

    def value(self, logits: Column) -> Column:
        return class_logit(logits)

    def score(self, df: DataFrame) -> DataFrame:
        provider = self.options.get("provider")
        if provider is None:
            raise ValueError(f"{self.name} needs a provider of classifier logits")
        texts = df.select("row_id", self.preprocessed(F.col("text")).alias("text"))
        found = provider.logits(texts, self.options.get("model", self.model), self.options.get("max_tokens", self.max_tokens))
        if provider.packs:
            return found.select("row_id", self.value(F.col("logits")).alias("score"))
        return df.select("row_id").join(found.select("row_id", self.value(F.col("logits")).alias("score")), "row_id", "left")


@register("radar")
class Radar(_Supervised):
    """Probability of class 0."""

    model = "TrustSafeAI/RADAR-Vicuna-7B"

    def value(self, logits: Column) -> Column:
        return class_probability(logits)


@register("remodetect")
class ReModetect(_Supervised):
    """Logit of class 0."""

    model = "hyunseoki/ReMoDetect-deberta"


@register("mage")
class Mage(_Supervised):
    """Logit of class 0, of normalised texts; its model takes long ones."""

    model = "yaful/MAGE"
    max_tokens = 4096

    def preprocessed(self, text: Column) -> Column:
        return normalised(text)
