"""ROC metrics of detectors: AUC, partial AUC, true-positive rate at small false-positive rates, averages over datasets.

Scores are counted by distinct value first, so ties are exact and the rest works on counts. Running counts along the
descending scores are formed in two steps: range partitions, then within them; a detector's scores are never sorted in
one task. All metrics are aggregates over the running counts.

Interior points of the curve that lie on a line with their neighbours, by equal steps, are left out before the rate at a
false-positive rate is read, as common libraries do: it is the mean of the two points around the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import stored

RATES = (0.001, 0.01, 0.1)
BY = ("dataset", "detector")


def is_machine(label: Column, machine_label: int = 1) -> Column:
    """1 where the label equals machine_label; anything else, null too, is human."""
    return F.when(label.cast("double").eqNullSafe(F.lit(float(machine_label))), 1).otherwise(0)


def long_scores(df: DataFrame, detectors: list[str], label: Column, dataset: Column | None = None) -> DataFrame:
    """(dataset, detector, label, score), without missing scores; scores rounded to ten decimals, infinite ones missing."""
    wide = df.select((F.lit("") if dataset is None else dataset).alias("dataset"), label.alias("label"), *(F.col(f"`{d}`").cast("double").alias(d) for d in detectors))
    rows = wide.unpivot(["dataset", "label"], [f"`{d}`" for d in detectors], "detector", "score")
    return rows.where("score IS NOT NULL AND NOT isnan(score) AND abs(score) < double('infinity')").withColumn("score", F.round("score", 10))


def running_counts(scores: DataFrame) -> DataFrame:
    """For each distinct score: p and n (machine and human rows with it), tp and fp (those with it or above), next ones, and all of them."""
    counted = scores.groupBy(*BY, "score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    ranged = counted.repartitionByRange(*BY, F.desc("score")).withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "ranged")
    parts = ranged.groupBy(*BY, "part").agg(F.sum("p").alias("pp"), F.sum("n").alias("pn"), F.max_by(F.struct("p", "n"), "score").alias("lead"))
    order = Window.partitionBy(*BY).orderBy("part")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*BY)
    parts = parts.select(*BY, "part", F.coalesce(F.sum("pp").over(past), F.lit(0)).alias("base_p"), F.coalesce(F.sum("pn").over(past), F.lit(0)).alias("base_n"), F.lead("lead").over(order).alias("lead"), F.sum("pp").over(everything).alias("pos"), F.sum("pn").over(everything).alias("neg"))
    inner = Window.partitionBy(*BY, "part").orderBy(F.desc("score"))
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(parts, [*BY, "part"])
    after = F.coalesce(F.lead(F.struct("p", "n")).over(inner), F.col("lead"))
    return joined.select(*BY, "score", "p", "n", (F.col("base_p") + F.sum("p").over(upto)).alias("tp"), (F.col("base_n") + F.sum("n").over(upto)).alias("fp"), after.alias("after"), "pos", "neg").where("pos > 0 AND neg > 0")


def _is_corner() -> Column:
    """Whether the curve's point is kept: an end, or a change of step after it; the first point is an end."""
    first = (F.col("tp") == F.col("p")) & (F.col("fp") == F.col("n"))
    return first | F.col("after").isNull() | (F.col("after")["p"] != F.col("p")) | (F.col("after")["n"] != F.col("n"))


def roc_points(scores: DataFrame) -> DataFrame:
    """(dataset, detector, fpr, tpr) of the curve, its start at 0, 0 included."""
    points = running_counts(scores).where(_is_corner()).select(*BY, (F.col("fp") / F.col("neg")).alias("fpr"), (F.col("tp") / F.col("pos")).alias("tpr"))
    start = points.select(*BY).distinct().select(*BY, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.union(start)


def metrics(scores: DataFrame, rates: tuple[float, ...] = RATES) -> DataFrame:
    """One row for each dataset and detector with both classes: roc_auc, auroc_at_* (standardised), tpr_at_* (percent)."""
    c = running_counts(scores)
    f, t = F.col("fp") / F.col("neg"), F.col("tp") / F.col("pos")
    f0, t0 = (F.col("fp") - F.col("n")) / F.col("neg"), (F.col("tp") - F.col("p")) / F.col("pos")
    out = [F.sum((f - f0) * (t + t0) / 2).alias("roc_auc")]
    for rate in rates:
        m = F.lit(rate)
        cut = t0 + (t - t0) * F.try_divide(m - f0, f - f0)
        area = F.sum(F.when((f0 >= m) | (F.col("n") == 0), 0.0).when(f <= m, (f - f0) * (t + t0) / 2).otherwise((m - f0) * (t0 + cut) / 2))
        out.append((0.5 * (1 + (area - m * m / 2) / (m - m * m / 2))).alias(f"auroc_at_{rate:g}"))
    for rate in rates:
        corner = _is_corner()
        at = F.min(F.when(corner & (f >= rate), F.struct(F.col("fp"), F.col("tp"), t.alias("t"))))["t"]
        before = F.coalesce(F.max(F.when(corner & (f < rate), F.struct(F.col("fp"), F.col("tp"), t.alias("t"))))["t"], F.lit(0.0))
        out.append((100 * (at + before) / 2).alias(f"tpr_at_{rate:g}"))
    return c.groupBy(*BY).agg(*out)


def macro_average(rows: DataFrame) -> DataFrame:
    """The mean of each metric over the datasets that have it, by detector."""
    names = [c for c in rows.columns if c not in BY]
    return rows.groupBy("detector").agg(*(F.avg(f"`{c}`").alias(c) for c in names))


def displayed(rows: DataFrame, rates: tuple[float, ...] = RATES) -> list[dict]:
    """Formatted rows for the console; as many as there are detectors and datasets."""
    out = []
    for r in rows.orderBy(*(c for c in BY if c in rows.columns)).collect():
        line = {"Dataset": r["dataset"]} if "dataset" in rows.columns and r["dataset"] else {}
        line |= {"Detector": r["detector"].upper(), "ROC AUC": f"{r['roc_auc']:.4f}"}
        line |= {f"AUROC({x * 100})": f"{r[f'auroc_at_{x:g}']:.4f}" for x in rates}
        line |= {f"TPR(FPR={x * 100}%)": f"{r[f'tpr_at_{x:g}']:5.1f}%" for x in rates}
        out.append(line)
    return out
