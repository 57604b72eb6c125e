"""What detectors ask of models, and the identifiers of generating back ends.

A provider gives whole tables, so a model that all detectors share is run once. Methods it doesn't have raise
NotImplementedError. Generated texts go through the caches of sources.cache.
"""

from __future__ import annotations

from abc import ABC
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Public model identifiers that back ends use by default.
REGENERATORS = {"hf": "Qwen/Qwen2.5-7B-Instruct", "vllm": "Qwen/Qwen2.5-7B-Instruct", "openai": "gpt-3.5-turbo-instruct"}
REVISERS = {"hf": "Qwen/Qwen2.5-7B-Instruct", "vllm": "Qwen/Qwen2.5-7B-Instruct", "openai": "gpt-4o-mini"}
CLASSIFIERS = ("TrustSafeAI/RADAR-Vicuna-7B", "hyunseoki/ReMoDetect-deberta", "yaful/MAGE")
MASK_MODEL = "t5-base"
REVISION_PROMPT = "Revise the following text: "


class Provider(ABC):
    """Texts come as (row_id, variant, text).

    A provider that packs gives a row for each text, with arrays, from one run of its models: packed_scores, (row_id, variant
    and arrays logprob, rank, mean_lp, var_lp); packed_cross_scores, (row_id and arrays logprob, xent), of drawn tokens if a
    temperature is given; packed_sequence_scores, (row_id and array logprob). Arrays are null where nothing can be scored.
    """

    packs = False

    def of(self, detector: str) -> Provider:
        """The provider for a detector, where detectors have models of their own."""
        return self

    def key(self, kind: str) -> tuple:
        """What a kind of output, tokens or cross, comes from; detectors with equal keys share a run."""
        return (id(self),)

    def packed_scores(self, texts: DataFrame) -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} packs no token scores")

    def packed_cross_scores(self, texts: DataFrame, temperature: float | None = None, seed: int = 0) -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} packs no cross scores")

    def packed_sequence_scores(self, pairs: DataFrame) -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} packs no sequence scores")

    def token_scores(self, texts: DataFrame) -> DataFrame:
        """(row_id, variant, n, logprob, rank, mean_lp, var_lp)"""
        raise NotImplementedError(f"{type(self).__name__} has no token scores")

    def cross_scores(self, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(row_id, n, logprob) of the performer, and (row_id, n, xent) of observer and performer."""
        raise NotImplementedError(f"{type(self).__name__} has no cross scores")

    def sampled_cross_scores(self, texts: DataFrame, temperature: float = 1.0, seed: int = 0) -> DataFrame:
        """(row_id, n, xent) from one target token drawn at each position."""
        raise NotImplementedError(f"{type(self).__name__} draws no tokens")

    def sequence_scores(self, pairs: DataFrame) -> DataFrame:
        """(row_id, logprob) for each target token; pairs are (row_id, source, target)."""
        raise NotImplementedError(f"{type(self).__name__} has no sequence scores")

    def logits(self, texts: DataFrame, model: str, most: int | None = None) -> DataFrame:
        """(row_id, logits), of the first `most` tokens if that is given"""
        raise NotImplementedError(f"{type(self).__name__} has no classifier")


def model_id(backend: str, model: str | None, defaults: dict[str, str], what: str) -> str:
    """The identifier of a back end's model, without loading it; it names the cache's folder."""
    if model:
        return model
    if backend not in defaults:
        raise ValueError(f"Unknown {what} backend: {backend!r}. Expected {', '.join(map(repr, defaults))}.")
    return defaults[backend]


def generated(df: DataFrame, key: str, prompt: str, generate: Callable[[list[str]], list], column: str, kind: str, tasks: int | None = None) -> DataFrame:
    """(hash, column) from a generating function over batches of prompts; the function loads its model on first use. tasks: how
    many run at once at most, over the whole cluster."""
    df = df.repartition(tasks) if tasks else df

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            for batch in batches:
                yield pd.DataFrame({"hash": batch[key], column: generate(batch[prompt].tolist())})
        finally:
            close = getattr(generate, "close", None)
            if close:
                close()

    return df.select(key, prompt).mapInPandas(run, f"hash string, {column} {kind}")


def _lazy(module: str, name: str, backend: str, package: str) -> type:
    import importlib

    try:
        return getattr(importlib.import_module(f".{module}", __package__), name)
    except ImportError as error:
        raise ImportError(f"The {backend!r} backend needs the {package!r} package.") from error


def regenerator(backend: str, model: str | None = None, **options):
    """A function from prefixes to lists of continuations: options k, max_new_tokens, temperature and the back end's own."""
    name = model_id(backend, model, REGENERATORS, "regenerator")
    return _lazy("generate", "Regenerator", backend, {"hf": "transformers"}.get(backend, backend))(backend, name, **options)


def reviser(backend: str, model: str | None = None, **options):
    """A function from texts to revised texts."""
    name = model_id(backend, model, REVISERS, "reviser")
    return _lazy("generate", "Reviser", backend, {"hf": "transformers"}.get(backend, backend))(backend, name, **options)


def mask_filler(model: str | None = None, backend: str = "hf", **options) -> Callable[[list[str]], list[str]]:
    """A function from masked texts to a sequence model's fills. Its library has to be there."""
    import importlib.util

    if importlib.util.find_spec({"hf": "transformers", "onnx": "onnxruntime"}[backend]) is None:
        raise ImportError("Filling masks needs a sequence model, and so the 'transformers' package; or give a function as the option fill.")
    from .neural import MaskFiller

    return MaskFiller(model, backend, **options)


def provider(kind: str, spark: SparkSession, path: str | None = None, **options) -> Provider | None:
    """The provider of a kind: ngram (none; detectors count their own), hf, onnx (path: a folder with folders scorer, observer,
    performer, similarity and one for each classifier) or tables (path: a folder with tables of precomputed output). options:
    a neural provider's own."""
    if kind == "ngram":
        return None
    if kind == "hf":
        from .neural import NeuralProvider

        return NeuralProvider("hf", **options)
    if path is None:
        raise ValueError(f"provider {kind!r} needs a path")
    if kind == "onnx":
        from .neural import NeuralProvider

        names = {x: f"{path}/{x}" for x in ("scorer", "observer", "performer", "similarity")}
        return NeuralProvider("onnx", classifiers={name: f"{path}/{name.rpartition('/')[2]}" for name in CLASSIFIERS}, **names, **options)
    if kind == "tables":
        from .table import TableProvider

        return TableProvider.read(spark, path)
    raise ValueError(f"Unknown provider: {kind!r}. Expected 'ngram', 'hf', 'onnx' or 'tables'.")
