"""Intermediate tables in a folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where the session names none, one is made in local mode; on a cluster,
    where executors could not see it, that is an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="synthscan-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


#: Operators behind which a table's partitions aren't those of its files.
SHUFFLES = re.compile(r"\b(Join|Aggregate|Sort|Repartition\w*|Window|Distinct|Deduplicate|GlobalLimit|Union|Generate|Sample)\b")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores at least. Files that Spark can't split, of one row group, are read by few
    tasks, and whatever is done with each row stays in them; larger tables have partitions enough and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if SHUFFLES.search(plan.optimizedPlan().toString()) or df.isStreaming:
        return df
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df


#: For tables of few rows of megabytes each: row groups are ended by size from the first row on, not from the hundredth.
WIDE = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def stored(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """df written as Parquet under spark.checkpoint.dir and read back. wide: its rows are large, so a task holds few of them."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**WIDE if wide else {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate files that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
