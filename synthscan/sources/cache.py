"""Generated texts by key: Parquet tables, one folder for each model, appended to and never rewritten in place.

Rows lie in folders by the first two digits of their keys' hash, so looking up few keys reads few files. A folder `gen-n` holds
a generation; `compact` writes the next one with the last entry of each key. The highest complete generation counts.
"""

from __future__ import annotations

import re
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import exists

#: Digits of the hash that name a folder; 256 folders.
DIGITS = 2


class Cache:
    """key -> value for one model; value is a string, or an array of strings for continuations."""

    def __init__(self, spark: SparkSession, root: str, model: str, value: str = "revised", kind: str = "string") -> None:
        self.spark, self.value, self.kind = spark, value, kind
        self.path = f"{root}/{re.sub('[^A-Za-z0-9._-]+', '_', model)}"

    def _generation(self) -> int:
        """The number of the highest complete generation; 0 is the first one, complete or not."""
        if not exists(self.spark, self.path):
            return 0
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        names = [x.getPath().getName() for x in root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root)]
        done = [int(x[4:]) for x in names if x.startswith("gen-") and exists(self.spark, f"{self.path}/{x}/_SUCCESS")]
        return max(done, default=0)

    def table(self, of: DataFrame | None = None, key: str = "hash") -> DataFrame:
        """The last entry of each key; with `of`, a table of keys, only those in the folders that its keys lie in."""
        path, schema = f"{self.path}/gen-{self._generation()}", f"hash string, {self.value} {self.kind}, seq long, folder string"
        if not exists(self.spark, path):  # known to be empty when it is planned: joins with it move nothing
            return self.spark.range(1).where("false").selectExpr("CAST(NULL AS string) AS hash", f"CAST(NULL AS {self.kind}) AS {self.value}")
        rows = self.spark.read.schema(schema).parquet(path)
        if of is not None:
            asked = [r[0] for r in of.select(folder(F.col(key))).distinct().limit(16**DIGITS + 1).collect()]  # a row a folder
            if len(asked) < 16**DIGITS:
                rows = rows.where(F.col("folder").isin([x for x in asked if x is not None]))
        return rows.groupBy("hash").agg(F.max_by(self.value, "seq").alias(self.value))

    def compact(self) -> None:
        """The next generation, with the last entry of each key. Not to be run beside writers, whose rows it might miss."""
        now = self._generation()
        rows = self.table().withColumn("seq", F.lit(time.time_ns())).withColumn("folder", folder(F.col("hash")))
        rows.repartition("folder").write.mode("overwrite").partitionBy("folder").parquet(f"{self.path}/gen-{now + 1}")

    def size(self) -> int:
        """How many keys it has."""
        return self.table().count()

    def statistics(self, df: DataFrame, key: str, least: int = 0) -> DataFrame:
        """(n_keys, n_hits, n_misses, n_cached): distinct keys of df that have a value and those that don't, and all that are kept."""
        asked = self.looked_up(df.select(key).distinct(), key, least).agg(F.count("*").alias("keys"), F.count(self.value).alias("hits"), F.lit(0).cast("long").alias("cached"))
        kept = self.table().agg(F.lit(0).cast("long"), F.lit(0).cast("long"), F.count("*"))
        return asked.union(kept).agg(F.sum("keys").alias("n_keys"), F.sum("hits").alias("n_hits"), F.sum(F.col("keys") - F.col("hits")).alias("n_misses"), F.sum("cached").alias("n_cached"))

    def _hits(self, df: DataFrame | None, key: str, least: int) -> DataFrame:
        hits = self.table(df, key)
        return hits.where(F.size(self.value) >= least).withColumn(self.value, F.slice(self.value, 1, least)) if least else hits

    def looked_up(self, df: DataFrame, key: str, least: int = 0, few: bool = False) -> DataFrame:
        """df with the value of its key, null where there is none (or, for arrays, fewer than `least`). few: df's keys are looked
        at first, and only their folders are read."""
        hits = self._hits(df if few else None, key, least)
        return df.join(hits.withColumnRenamed("hash", "_hash"), F.col(key) == F.col("_hash"), "left").drop("_hash")

    def misses(self, df: DataFrame, key: str, least: int = 0, few: bool = False) -> DataFrame:
        """One row for each key of df that is missing."""
        return self.absent(df, key, least, few).dropDuplicates([key])

    def absent(self, df: DataFrame, key: str, least: int = 0, few: bool = False) -> DataFrame:
        """The rows of df whose keys are missing."""
        hits = self._hits(df if few else None, key, least)
        return df.join(hits.select(F.col("hash").alias("_hit")), F.col(key) == F.col("_hit"), "left_anti")

    def added(self, new: DataFrame, least: int = 0) -> None:
        """Append (hash, value) rows: absent keys, and with `least` those that have too few; the first of equal keys."""
        rows = self.misses(new.select("hash", self.value).withColumnRenamed("hash", "_key"), "_key", least)
        self.appended(rows.withColumnRenamed("_key", "hash"))

    def appended(self, new: DataFrame) -> None:
        """Append (hash, value) rows as they are, in one commit; the last entry of a key counts."""
        rows = new.select("hash", self.value, F.lit(time.time_ns()).alias("seq"), folder(F.col("hash")).alias("folder"))
        rows.write.mode("append").partitionBy("folder").parquet(f"{self.path}/gen-{self._generation()}")


def folder(key: Column) -> Column:
    return F.substring(F.sha2(key, 256), 1, DIGITS)


def continuations(spark: SparkSession, root: str, model: str) -> Cache:
    return Cache(spark, f"{root}/continuations", model, "continuations", "array<string>")


def revisions(spark: SparkSession, root: str, model: str) -> Cache:
    return Cache(spark, f"{root}/revisions", model)
