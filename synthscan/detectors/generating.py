"""Detectors that generate text and compare. Generated texts are cached by key, and each key is generated once."""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import overlap as O
from ..functions import text as X
from ..functions.stopwords import english
from ..operators.statistics import packed, sequence_score
from ..plans.tables import removed, shared_dir, spread, stored
from ..providers import base
from ..providers.ngram import OBSERVER
from ..providers.sequences import own_sequence_scores
from ..sources import cache
from ..sources.sinks import cache_root
from .registry import Detector, register

log = logging.getLogger(__name__)


def _sliced(df: DataFrame, store: cache.Cache, key: str, prompt: str, least: int, commit: int) -> tuple[DataFrame, int, str]:
    """The missing keys with their prompts in slices of about `commit` keys each, their number, and the folder they are in. Slices
    follow the cache's folders and are folders of their own, so each is read by itself and adds to its own folders only: neither reads
    nor files grow with slices times rows. Keys are counted first, without prompts, so these are moved once: equal keys meet in their
    slice's files, of which there are enough for all cores."""
    spark = df.sparkSession
    n = store.misses(df.select(key), key, least).count()
    slices, folders = max(1, -(-n // commit)), 16**cache.DIGITS
    folder = F.conv(cache.folder(F.col(key)), 16, 10).cast("int")
    each = -(-slices // folders)  # slices of one folder, where there are more slices than folders
    number = F.floor(folder * F.lit(min(slices, folders)) / folders).cast("int") * each + F.pmod(F.xxhash64(key), F.lit(each)).cast("int")
    path = f"{shared_dir(spark)}/slices-{uuid.uuid4().hex}"
    part = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(spark.sparkContext.defaultParallelism))
    rows = store.absent(df.select(key, prompt), key, least).withColumn("slice", number).withColumn("part", part)
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "slice", "part").dropDuplicates(["slice", "part", key]).drop("part")
    rows.write.partitionBy("slice").parquet(path)
    return spark.read.schema(rows.schema).parquet(path), n, path


def _filled(df: DataFrame, store: cache.Cache, key: str, prompt: str, generate, kind: str, least: int = 0, commit: int = 10_000, requests: int = 256) -> DataFrame:
    """df with the cache's values, after missing ones were generated and added.

    Keys are generated in slices of about `commit`, each added to the cache when it is done, so a run that is stopped asks
    again for no more than the slice it was in. requests: how many may be under way at once over all tasks, for generators
    that limit their own (`in_flight`).
    """
    missing, n, path = _sliced(df, store, key, prompt, least, commit)
    own = getattr(generate, "in_flight", None)
    tasks = max(1, requests // own) if own and getattr(generate, "backend", None) == "openai" else None
    numbers = sorted(r[0] for r in missing.select("slice").distinct().collect()) if n else []
    for done, i in enumerate(numbers, 1):
        part = missing.where(F.col("slice") == i).select(key, prompt)
        few = 2 * part._jdf.queryExecution().toRdd().getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism
        store.appended(base.generated(spread(part) if few and not tasks else part, key, prompt, generate, store.value, kind, tasks))
        log.info("%s: slice %d of %d, %d keys generated in all", store.path, done, len(numbers), n)
    removed(df.sparkSession, path)
    return store.looked_up(df, key, least)


@register("dna-gpt")
class DivergentNGrams(Detector):
    """BScore of the text's second part against continuations of its first.

    Options: generate (prefixes to lists of continuations) or backend and model; k, ratio, prompt (a column), stopwords,
    n_min, n_max, cache_dir, commit, requests, and those of the back end.
    """

    def score(self, df: DataFrame) -> DataFrame:
        o = self.options
        k, ratio, prompt = o.get("k", 20), o.get("ratio", 0.5), o.get("prompt")
        backend, model = o.get("backend", "hf"), o.get("model")
        name = model or ("custom" if o.get("generate") else base.model_id(backend, None, base.REGENERATORS, "regenerator"))
        generate = o.get("generate") or base.regenerator(backend, model, k=k, **o.get("backend_options", {}))
        cut = df.select("row_id", X.truncated(F.col("text"), ratio).alias("x"), (F.col(prompt) if prompt and prompt in df.columns else F.lit(None)).alias("p"))
        cut = cut.select("row_id", X.with_prompt(F.col("p"), F.col("x.prefix")).alias("prefix"), F.col("x.remainder").alias("rest"))
        cut = stored(spread(cut).withColumn("hash", X.continuation_key(F.col("prefix"), ratio, k)), "cut")
        store = cache.continuations(df.sparkSession, o.get("cache_dir") or cache_root(df.sparkSession), name)
        rows = _filled(cut, store, "hash", "prefix", generate, "array<string>", k, **{x: o[x] for x in ("commit", "requests") if x in o})
        stop = o.get("stopwords") or english()
        return rows.select("row_id", O.bscore_of_texts(o.get("n_min", O.N_MIN), o.get("n_max", O.N_MAX), stop, True)("rest", "continuations").alias("score"))


@register("revise-detect")
class ReviseDetect(Detector):
    """Mean log-probability of the text given its revision.

    Options: generate (texts to revisions) or backend and model; provider of sequence scores; cache_dir, commit, requests.
    """

    def score(self, df: DataFrame) -> DataFrame:
        o = self.options
        backend, model = o.get("backend", "hf"), o.get("model")
        name = model or ("custom" if o.get("generate") else base.model_id(backend, None, base.REVISERS, "reviser"))
        generate = o.get("generate") or base.reviser(backend, model, **o.get("backend_options", {}))
        keyed = df.select("row_id", "text", X.revision_key(F.col("text")).alias("hash"))
        store = cache.revisions(df.sparkSession, o.get("cache_dir") or cache_root(df.sparkSession), name)
        rows = _filled(keyed, store, "hash", "text", generate, "string", **{x: o[x] for x in ("commit", "requests") if x in o})
        pairs = rows.select("row_id", X.or_original(F.col("revised"), F.col("text")).alias("source"), F.col("text").alias("target"))
        provider = o.get("provider") or o.get("counted")
        if provider and provider.packs:
            return provider.packed_sequence_scores(pairs).select("row_id", packed("revise-detect").alias("score"))
        found = sequence_score(provider.sequence_scores(pairs)) if provider else own_sequence_scores(pairs, OBSERVER)  # of a model of the texts themselves
        return df.select("row_id").join(found.withColumnRenamed("revise-detect", "score"), "row_id", "left")
