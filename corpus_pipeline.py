"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, source mixing and packing of `documents`.

Each stage is a function of (spark, docs, sf_dir). All but the last return the columns of documents; n_chars, where a
stage changes the text, is that of the new text. Rows with null ids pass the filtering stages unless a rule rejects them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synthscan.llm import line_dedup, minhash_dedup, mixing, packing, quality_rules
from synthscan.llm.common import discard, documents, scratch, stored


#: Columns that stages use by name. All others are set aside under plain names while an operator works.
USED = ("doc_id", "text", "source", "n_chars")


def _whole(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage from a function of documents whose other columns have names that no operator uses, whatever they are called:
    names that differ from an operator's in case alone, with dots, spaces or quotes come out as they went in."""

    @wraps(operator)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in USED else f"__other_{i}" for i, c in enumerate(docs.columns)]
        out = operator(docs.toDF(*names), spark, sf_dir)
        return out.select(*names).toDF(*docs.columns)

    return stage


def _measured(df: DataFrame) -> DataFrame:
    """n_chars, where there is one, of the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else df


@_whole
def quality(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that fail the base or a learned rule go."""
    rules = quality_rules.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.judged(quality_rules.with_statistics(docs), rules).where("kept")


@_whole
def lines(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines, of 3 lines or of 50 words together, go from the texts."""
    return _measured(line_dedup.line_dedup(docs, short=True))


@_whole
def near_duplicates(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; links are at 0.8, missed with p = 3e-6 there."""
    gone = minhash_dedup.near_duplicates(docs, least=80, bands=24).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


@_whole
def mix(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are repeated or cut to their targets, in the order of the schedule; a document may come twice, or in part."""
    return _measured(mixing.mixed(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row for each piece."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-duplicates", near_duplicates), ("source mixing", mix), ("packing", pack)]

#: SQL can express neither the learned rules nor the tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. What a stage leaves in the shared folder goes when the next stage's documents are written."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            kept = stored(stage(spark, docs, sf_dir), name, outlives=True)
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
