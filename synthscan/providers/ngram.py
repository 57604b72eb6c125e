"""Built-in bigram models over lower-cased word tokens: every statistic in closed form, as DataFrame code.

Two models share their counts c and vocabulary of size V and differ in smoothing: p(t | v) = (c(v t) + k) / (c(v) + k V),
k = `observer` or `performer`. Sums over the vocabulary are sums over the tokens seen after v plus a term for the others,
so nothing of size V times anything is built. Scores of the neural models that detectors are known with are not
reproduced; the formulas are. Models are counted on whole texts and score whole texts; max_tokens and cross_tokens, where
given, cut what is scored, as neural scorers do.

A token's rank is 1 plus the number of tokens more probable after v; ties share the best rank.

The counted texts themselves are scored by chunks (`chunked`), without a row for a place. What follows is about the tables
of the model, and about other texts and cut ones, which are scored by joins.

At scale: texts are cut into tokens once, and tokens, counts and the model's table written to the shared folder. All that
ranks and the context's sums need is how many tokens there are of each count after a context, a table with few rows for
any context, however common: no window or group ever holds a context's tokens. The model is one table keyed by the pair,
with the context's sums in it. Heavy pairs, those with a share of 2^-12 of all places or more and so 4,096 at most, are found
first and sent to all tasks: their places are scored where the texts are, by a hash join without a shuffle, and only those
of other pairs are sent to the model's partitions. So no key of the shuffled join has more than a small share of the rows.
Texts other than the counted ones take a second join for the pairs that the model has not seen; there heavy contexts, of
the same share, are found in the same way. Perturbed texts share most of their pairs with the text they come from: their
places are summed by (row, pair) first, with a count for each variant, so a pair is looked up once for all variants.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.overlap import tokens
from ..operators import statistics as S
from ..plans.tables import spread, stored
from .base import Provider
from .chunked import SUMS as TEXT_SUMS
from .chunked import Chunks

OBSERVER, PERFORMER, CELLS, HEAVY = 0.1, 0.5, 64, 1 << 12
SUMS = ("m", "mean_lp", "var_lp")


def tokenised(texts: DataFrame, most: int | None = None) -> DataFrame:
    """(row_id, variant, t): the tokens, or the first `most` of them."""
    variant = F.col("variant") if "variant" in texts.columns else F.lit(0)
    t = tokens(F.col("text"))
    return texts.select("row_id", variant.alias("variant"), (t if most is None else F.slice(t, 1, most)).alias("t"))


def cut(rows: DataFrame, most: int | None) -> DataFrame:
    return rows if most is None else rows.withColumn("t", F.slice("t", 1, most))


def pairs(rows: DataFrame) -> DataFrame:
    """(row_id, variant, ctx, tok): the token pairs of each row, one row for each place."""
    both = F.arrays_zip(F.slice("t", F.lit(1), F.size("t") - 1).alias("ctx"), F.slice("t", F.lit(2), F.size("t") - 1).alias("tok"))
    return rows.where(F.size("t") > 1).select("row_id", "variant", F.inline(both))


class NGramModel(Provider):
    """Counted on the texts of a DataFrame (row_id, text)."""

    def __init__(self, corpus: DataFrame, observer: float = OBSERVER, performer: float = PERFORMER, max_tokens: int | None = None, cross_tokens: int | None = None) -> None:
        self.k, self.q, self.max_tokens, self.cross_tokens = float(observer), float(performer), max_tokens, cross_tokens
        self._corpus = corpus.select("row_id", "text")

    @cached_property
    def corpus(self) -> DataFrame:
        """The counted texts' tokens, cut once."""
        return stored(tokenised(spread(self._corpus)), "tokens")

    @cached_property
    def chunks(self) -> Chunks:
        return Chunks(tokenised(spread(self._corpus)), self.k, self.q)

    def _text_sums(self, drawn: tuple[float, int] | None = None) -> DataFrame:
        return self.chunks.texts(drawn=drawn).groupBy("row_id").agg(*(F.sum(x).alias(x) for x in TEXT_SUMS))

    @cached_property
    def text_sums(self) -> DataFrame:
        """What all statistics of the counted texts take, a row for each row_id."""
        return stored(self._text_sums(), "sums")

    def zero_shot(self) -> DataFrame:
        """(row_id, rank, log-rank, lrr, fast-detect-gpt) of the counted texts."""
        return S.from_sums(self.text_sums) if self.max_tokens is None else S.zero_shot(self.token_scores(None))

    def binoculars(self, median: bool = False, drawn: tuple[float, int] | None = None) -> DataFrame:
        """(row_id, binoculars) of the counted texts. drawn: temperature and seed of one drawn token for each context place."""
        if self.cross_tokens is not None:
            performer, cross = self.cross_scores(None)
            return S.perplexity_ratio(performer, self.sampled_cross_scores(None, *drawn) if drawn else cross, median=median)
        if median:
            return self.chunks.texts("performer", "xent", drawn=drawn).withColumnRenamed("performer", "logprob").select("row_id", S.packed("binoculars", True).alias("binoculars"))
        ratio = F.try_divide(F.try_divide("performer", "n"), F.try_divide("xent", "tokens"))
        return (self._text_sums(drawn) if drawn else self.text_sums).select("row_id", ratio.alias("binoculars"))

    @cached_property
    def words(self) -> DataFrame:
        """(tok, c): how often each token occurs."""
        return stored(self.corpus.select(F.explode("t").alias("tok")).groupBy("tok").agg(F.count("*").alias("c")), "words")

    @cached_property
    def size(self) -> int:
        """V, the number of distinct tokens."""
        return self.words.count()

    @cached_property
    def bigrams(self) -> DataFrame:
        """(ctx, tok, c), counted once."""
        return stored(pairs(self.corpus).groupBy("ctx", "tok").agg(F.count("*").alias("c")), "bigrams")

    @cached_property
    def by_count(self) -> DataFrame:
        """(ctx, c, same): how many tokens come c times after a context."""
        return stored(self.bigrams.groupBy("ctx", "c").agg(F.count("*").alias("same")), "by_count")

    @cached_property
    def contexts(self) -> DataFrame:
        """(ctx, m, seen, mean_lp, var_lp, xent): counts, and the sums over the vocabulary."""
        k, q, V = F.lit(self.k), F.lit(self.q), F.lit(self.size)
        total = self.by_count.groupBy("ctx").agg(F.sum(F.col("c") * F.col("same")).alias("m"))
        c, m, n = F.col("c"), F.col("m"), F.col("same")
        p, r = (c + k) / (m + k * V), (c + q) / (m + q * V)
        sums = self.by_count.join(total, "ctx").groupBy("ctx", "m").agg(
            F.sum("same").alias("seen"), F.sum(n * p * F.ln(p)).alias("s1"), F.sum(n * p * F.ln(p) * F.ln(p)).alias("s2"), F.sum(n * p * F.ln(r)).alias("sx"),
        )
        rest, p0, r0 = V - F.col("seen"), k / (m + k * V), q / (m + q * V)
        sums = sums.withColumn("mean_lp", F.col("s1") + rest * p0 * F.ln(p0)).withColumn("e2", F.col("s2") + rest * p0 * F.ln(p0) * F.ln(p0))
        sums = sums.select("ctx", "m", "seen", "mean_lp", F.greatest(F.col("e2") - F.col("mean_lp") * F.col("mean_lp"), F.lit(0.0)).alias("var_lp"), (-(F.col("sx") + rest * p0 * F.ln(r0))).alias("xent"))
        return stored(sums, "contexts")

    @property
    def _ranks(self) -> DataFrame:
        """by_count with the rank of a count's tokens."""
        above = Window.partitionBy("ctx").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)
        return self.by_count.withColumn("rank", 1 + F.coalesce(F.sum("same").over(above), F.lit(0)))

    def ranks(self) -> DataFrame:
        """(ctx, tok, c, rank), without the sums of contexts."""
        return self.bigrams.join(self._ranks.drop("same"), ["ctx", "c"]).select("ctx", "tok", "c", "rank")

    @cached_property
    def model(self) -> DataFrame:
        """(ctx, tok, c, rank) with the sums of contexts."""
        ranks = self._ranks.join(self.contexts.select("ctx", *SUMS), "ctx")
        return stored(self.bigrams.join(ranks.drop("same"), ["ctx", "c"]).select("ctx", "tok", "c", "rank", *SUMS), "model")

    @cached_property
    def heavy(self) -> DataFrame:
        """Rows of the model for its most common pairs, HEAVY at most."""
        places = self.by_count.agg(F.sum(F.col("c") * F.col("same"))).first()[0] or 0
        return stored(self.model.where(F.col("c") >= max(2, -(-places // HEAVY))), "heavy")

    @cached_property
    def heavy_contexts(self) -> DataFrame:
        """Rows of contexts for the most common ones, HEAVY at most."""
        places = self.by_count.agg(F.sum(F.col("c") * F.col("same"))).first()[0] or 0
        return stored(self.contexts.where(F.col("m") >= max(2, -(-places // HEAVY))), "heavy_contexts")

    @staticmethod
    def _split(rows: DataFrame, small: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        """rows joined, where they are, with a bounded part of a table; and the rows whose keys it hasn't."""
        return rows.join(F.broadcast(small), keys), rows.join(F.broadcast(small.select(keys)), keys, "left_anti")

    def _looked_up(self, places: DataFrame) -> DataFrame:
        """Places (ctx, tok, ...) of any texts with c, rank and the context's sums. Pairs that the model hasn't seen get c 0 and
        the rank after the seen ones."""
        near, away = self._split(places, self.heavy, ["ctx", "tok"])
        far = stored(away.join(self.model, ["ctx", "tok"], "left"), "far")
        near_contexts, away = self._split(far.where("c IS NULL").drop("c", "rank", *SUMS), self.heavy_contexts.drop("xent"), ["ctx"])
        other = near_contexts.unionByName(away.join(self.contexts.drop("xent"), "ctx", "left").select(near_contexts.columns))
        uniform = F.lit(-math.log(self.size)) if self.size else F.lit(None).cast("double")
        values = {"c": F.lit(0).cast("long"), "rank": F.coalesce(F.col("seen") + 1, F.lit(1)).cast("long"), "m": F.coalesce("m", F.lit(0)), "mean_lp": F.coalesce("mean_lp", uniform), "var_lp": F.coalesce("var_lp", F.lit(0.0))}
        seen = far.where("c IS NOT NULL").select(near.columns)
        return near.unionByName(seen).unionByName(other.withColumns(values).select(near.columns))

    def _scored(self, rows: DataFrame | None, most: int | None) -> DataFrame:
        """Pairs with c, rank and the context's sums, of the counted texts if rows is None."""
        if rows is None:
            near, away = self._split(pairs(cut(self.corpus, most)), self.heavy, ["ctx", "tok"])
            found = near.unionByName(away.join(self.model, ["ctx", "tok"]).select(near.columns))
        else:
            found = self._looked_up(stored(pairs(cut(rows, most)), "pairs"))
        return found.select("row_id", "variant", F.lit(1).alias("n"), "c", F.col("rank").cast("long").alias("rank"), *SUMS)

    def variant_counts(self, texts: DataFrame, variants: int) -> DataFrame:
        """(row_id, ns, c, rank, ...): pairs of texts whose variants 0 .. variants share most of theirs, and how often each has them."""
        counts = [F.count(F.when(F.col("variant") == i, 1)) for i in range(variants + 1)]
        by_pair = pairs(cut(tokenised(spread(texts)), self.max_tokens)).groupBy("row_id", "ctx", "tok").agg(F.array(*counts).alias("ns"))
        return self._looked_up(stored(by_pair, "pairs"))

    def variant_scores(self, texts: DataFrame, variants: int) -> DataFrame:
        """Token scores of such texts."""
        each = self.variant_counts(texts, variants).select("row_id", F.posexplode("ns").alias("variant", "n"), "c", "rank", *SUMS).where("n > 0")
        return each.select("row_id", "variant", "n", self._logprob(self.k).alias("logprob"), F.col("rank").cast("long").alias("rank"), "mean_lp", "var_lp")

    def variant_sums(self, texts: DataFrame) -> DataFrame:
        """What all statistics take, a row for each variant of such texts."""
        return self.chunks.variants(cut(tokenised(texts), self.max_tokens).withColumn("variant", F.col("variant").cast("int"))).groupBy("row_id", "variant").agg(*(F.sum(x).alias(x) for x in TEXT_SUMS))

    def _logprob(self, k: float) -> Column:
        return F.ln(F.try_divide(F.col("c") + k, F.col("m") + k * self.size))

    def token_scores(self, texts: DataFrame | None) -> DataFrame:
        scored = self._scored(None if texts is None else tokenised(texts), self.max_tokens)
        return scored.select("row_id", "variant", "n", self._logprob(self.k).alias("logprob"), "rank", "mean_lp", "var_lp")

    def cross_scores(self, texts: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        rows = None if texts is None else stored(tokenised(texts).where("variant = 0"), "tokens")
        performer = self._scored(rows, self.cross_tokens).select("row_id", "n", self._logprob(self.q).alias("logprob"))
        each = cut(self.corpus if rows is None else rows, self.cross_tokens).select("row_id", F.explode("t").alias("ctx")).groupBy("row_id", "ctx").agg(F.count("*").alias("n"))
        known = each.join(self.contexts.select("ctx", "xent"), "ctx", "left")
        return performer, known.select("row_id", "n", F.coalesce("xent", F.lit(math.log(max(1, self.size)))).alias("xent"))

    def tempered(self, temperature: float) -> DataFrame:
        """(ctx, seen, known, total, z): what drawing from the observer and scoring by the performer take at a temperature:
        the weight of the seen tokens and of all under the one, the sum over the vocabulary of the other."""
        k, q, V, power = F.lit(self.k), F.lit(self.q), F.lit(self.size), F.lit(1.0 / temperature)
        sums = self.by_count.groupBy("ctx").agg(F.sum("same").alias("seen"), F.sum(F.col("same") * F.pow(F.col("c") + k, power)).alias("known"), F.sum(F.col("same") * F.pow(F.col("c") + q, power)).alias("z"))
        rest = V - F.col("seen")
        return sums.select("ctx", "seen", "known", (F.col("known") + rest * F.pow(k, power)).alias("total"), (F.col("z") + rest * F.pow(q, power)).alias("z"))

    def sampled_cross_scores(self, texts: DataFrame | None, temperature: float = 1.0, seed: int = 0) -> DataFrame:
        """(row_id, n, xent) from one target token for each context place, drawn from the observer; both models at a temperature.

        A draw falls on one of the tokens of a count, or on any not seen. It hangs on row, place and seed alone, so reruns
        agree. It is found among by_count's running sums, dealt by equal cells of the distribution, so that a common
        context's draws are spread.
        """
        k, q, V, power = F.lit(self.k), F.lit(self.q), F.lit(self.size), F.lit(1.0 / temperature)
        rows = cut(self.corpus if texts is None else tokenised(texts).where("variant = 0"), self.cross_tokens)
        sums = stored(self.tempered(temperature), "tempered")
        weight = F.col("same") * F.pow(F.col("c") + k, power)
        upto = Window.partitionBy("ctx").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)
        steps = self.by_count.withColumn("high", F.sum(weight).over(upto)).withColumn("low", F.col("high") - weight).join(sums.select("ctx", "total"), "ctx")
        cell = lambda x: F.floor(x / F.col("total") * CELLS)
        steps = steps.select(F.col("ctx").alias("_ctx"), "low", "high", "c", F.explode(F.sequence(cell(F.col("low")), F.least(cell(F.col("high")), F.lit(CELLS - 1)))).alias("_cell"))
        u = F.pmod(F.xxhash64(F.col("row_id").cast("string"), "place", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
        places = rows.select("row_id", F.posexplode("t").alias("place", "ctx")).join(sums, "ctx", "left").withColumn("at", u * F.col("total"))
        xent = lambda c: F.ln("z") - power * F.ln(c + q)
        none = places.where("at IS NULL OR at >= known").select("row_id", F.coalesce(xent(F.lit(0)), F.ln(V)).alias("xent"))
        drawn = places.where("at < known").withColumn("cell", cell(F.col("at")))
        drawn = drawn.join(steps, (F.col("ctx") == F.col("_ctx")) & (F.col("cell") == F.col("_cell")) & (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))
        return drawn.select("row_id", xent(F.col("c")).alias("xent")).union(none).select("row_id", F.lit(1).alias("n"), "xent")

    def sequence_scores(self, pairs_: DataFrame) -> DataFrame:
        """Target tokens by the corpus's own token frequencies, (c + observer) / (words + observer V), mixed half and half
        with those of the row's source."""
        target = tokenised(pairs_.select("row_id", F.col("target").alias("text")))
        source = tokenised(pairs_.select("row_id", F.col("source").alias("text")))
        each = source.select("row_id", F.size("t").alias("size"), F.explode("t").alias("tok")).groupBy("row_id", "tok", "size").agg(F.count("*").alias("own"))
        asked = target.select("row_id", F.explode("t").alias("tok")).groupBy("row_id", "tok").agg(F.count("*").alias("n"))
        total = (self.words.agg(F.sum("c")).first()[0] or 0) + self.k * max(1, self.size)
        joined = asked.join(each, ["row_id", "tok"], "left").join(self.words, "tok", "left")
        p = 0.5 * (F.coalesce("c", F.lit(0)) + self.k) / F.lit(float(total)) + 0.5 * F.coalesce(F.col("own") / F.col("size"), F.lit(0.0))
        return joined.select("row_id", "n", F.ln(p).alias("logprob"))
