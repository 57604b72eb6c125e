"""Detector statistics: aggregates over per-token model output.

token scores  (row_id, variant, n, logprob, rank, mean_lp, var_lp): n positions that share these values
cross scores  (row_id, n, xent)
sequence scores (row_id, logprob), and n where a row stands for several target tokens
logits        an array column

Each is a groupBy on the row with partial aggregation. Packed scores, a row for each text with arrays of the same names, are
aggregated in the row: see `packed`. Undefined values are null, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _mean(value: Column, n: str = "n") -> Column:
    return F.try_divide(F.sum(value * F.col(n)), F.sum(n))


def mean_rank() -> Column:
    return _mean(F.col("rank"))


def mean_log_rank() -> Column:
    return _mean(F.ln("rank"))


def mean_logprob() -> Column:
    return _mean(F.col("logprob"))


def log_rank_ratio() -> Column:
    """Mean log-likelihood by mean log-rank."""
    return F.try_divide(mean_logprob(), mean_log_rank())


def sampling_discrepancy() -> Column:
    """How far the log-likelihood lies above what sampling from the model gives, in standard deviations."""
    total = lambda c: F.sum(F.col(c) * F.col("n"))
    return F.try_divide(total("logprob") - total("mean_lp"), F.sqrt(F.greatest(total("var_lp"), F.lit(0.0))))


def zero_shot(scores: DataFrame, by: str = "row_id") -> DataFrame:
    """rank, log-rank, lrr and fast-detect-gpt of the unperturbed texts, in one aggregation."""
    return scores.where("variant = 0").groupBy(by).agg(
        mean_rank().alias("rank"), mean_log_rank().alias("log-rank"), log_rank_ratio().alias("lrr"), sampling_discrepancy().alias("fast-detect-gpt")
    )


def perplexity_ratio(performer: DataFrame, cross: DataFrame, by: str = "row_id", median: bool = False) -> DataFrame:
    """binoculars: minus log-perplexity under the performer by cross-entropy of observer and performer.

    With `median` the medians of the positions are taken instead of the means.
    """
    def middle(df: DataFrame, value: Column, name: str) -> DataFrame:
        if not median:
            return df.groupBy(by).agg(_mean(value).alias(name))
        each = df.withColumn("_v", value).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        return each.groupBy(by).agg(F.median("_v").alias(name))

    perplexity = middle(performer, -F.col("logprob"), "_p")
    return perplexity.join(middle(cross, F.col("xent"), "_x"), by).select(by, (-F.try_divide("_p", "_x")).alias("binoculars"))


def npr_of_log_ranks(name: str) -> Column:
    """Of the variants' mean log-ranks: the mean of the perturbations that have one, by that of the text."""
    lr, variant = F.col(name), F.col("variant")
    return F.try_divide(F.avg(F.when(variant > 0, lr)), F.max(F.when(variant == 0, lr)))


def perturbation_ratio(scores: DataFrame, by: str = "row_id") -> DataFrame:
    """npr: mean log-rank of the perturbations that have one, by the log-rank of the text."""
    each = scores.groupBy(by, "variant").agg(mean_log_rank().alias("lr"))
    return each.groupBy(by).agg(npr_of_log_ranks("lr").alias("npr"))


def sums(scores: DataFrame, by: str = "row_id") -> DataFrame:
    """What all statistics of token scores take, a row for each variant of a text."""
    n = F.col("n")
    each = {"ranks": F.col("rank") * n, "log_ranks": F.ln("rank") * n, **{x: F.col(x) * n for x in ("logprob", "mean_lp", "var_lp")}}
    return scores.groupBy(by, "variant").agg(F.sum(n).alias("n"), *(F.sum(x).alias(name) for name, x in each.items()))


def from_sums(df: DataFrame, by: str = "row_id") -> DataFrame:
    """rank, log-rank, lrr and fast-detect-gpt of sums."""
    part = lambda x: F.try_divide(F.col(x), F.col("n"))
    deviation = F.sqrt(F.greatest(F.col("var_lp"), F.lit(0.0)))
    return df.select(
        by, part("ranks").alias("rank"), part("log_ranks").alias("log-rank"), F.try_divide(part("logprob"), part("log_ranks")).alias("lrr"),
        F.try_divide(F.col("logprob") - F.col("mean_lp"), deviation).alias("fast-detect-gpt"),
    )


def npr_of_counts(df: DataFrame, variants: int, by: str = "row_id") -> DataFrame:
    """npr of (row, ns, rank): pairs with how often each of the variants 0 .. variants has them. One aggregation by row."""
    at = lambda i: F.col("ns")[i]
    totals = [F.try_divide(F.sum(at(i) * F.ln("rank")), F.sum(at(i))) for i in range(variants + 1)]
    others = F.filter("_lrs", lambda x: x.isNotNull())
    mean = F.try_divide(total(others), F.size(others))
    rows = df.groupBy(by).agg(totals[0].alias("_own"), F.array(*totals[1:]).cast("array<double>").alias("_lrs"))
    return rows.select(by, F.try_divide(mean, "_own").alias("npr"))


def npr_of_sums(df: DataFrame, by: str = "row_id") -> DataFrame:
    """npr of sums, a row for each variant."""
    return df.withColumn("_lr", F.try_divide("log_ranks", "n")).groupBy(by).agg(npr_of_log_ranks("_lr").alias("npr"))


def sequence_score(scores: DataFrame, by: str = "row_id") -> DataFrame:
    """revise-detect: mean log-probability of the target's tokens given the source. A row counts n times, if there is n."""
    n = F.col("n") if "n" in scores.columns else F.lit(1)
    return scores.groupBy(by).agg((F.sum(F.col("logprob") * n) / F.greatest(F.sum(F.when(F.col("logprob").isNotNull(), n).otherwise(0)), F.lit(1))).alias("revise-detect"))


def class_probability(logits: Column, index: int = 0) -> Column:
    """Softmax at an index, safe for large logits; null for a null or short array."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.exp(F.get(logits, F.lit(index)) - top) / total


def class_logit(logits: Column, index: int = 0) -> Column:
    return F.get(logits, F.lit(index)).cast("double")


def total(values: Column) -> Column:
    """Sum of an array's values."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def middle(values: Column) -> Column:
    """Median of an array's values; null for an empty one."""
    ordered, n = F.array_sort(values), F.size(values)
    return (F.get(ordered, F.floor((n + 1) / 2).cast("int") - 1) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def packed(name: str, median: bool = False) -> Column:
    """A detector's statistic of packed scores, without an aggregation over rows."""
    rank, logprob = F.col("rank"), F.col("logprob")
    n = F.size(logprob)
    log_rank = F.try_divide(total(F.transform(rank, lambda x: F.ln(x))), n)
    if name == "rank":
        return F.try_divide(total(F.transform(rank, lambda x: x.cast("double"))), n)
    if name == "log-rank":
        return log_rank
    if name == "lrr":
        return F.try_divide(F.try_divide(total(logprob), n), log_rank)
    if name == "fast-detect-gpt":
        return F.try_divide(total(logprob) - total(F.col("mean_lp")), F.sqrt(F.greatest(total(F.col("var_lp")), F.lit(0.0))))
    if name == "binoculars":
        mean = middle if median else lambda x: F.try_divide(total(x), F.size(x))
        return F.try_divide(mean(logprob), mean(F.col("xent")))
    if name == "revise-detect":
        return F.try_divide(total(logprob), F.greatest(n, F.lit(1)))
    raise KeyError(name)
