"""Datasets as DataFrames: CSV, JSON lines, JSON arrays, Parquet, ORC, and hub datasets from a mirror or where their library is installed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import nonblank
from ..plans.tables import SHUFFLES, stored

# Cells that data frames by convention read as missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def looks_like_jsonl(spark: SparkSession, path: str) -> bool:
    """Whether the first line begins with a brace; any trouble reading means no."""
    try:
        first = spark.read.text(path).first()
    except Exception:  # unreadable, whatever the reason
        return False
    return bool(first) and first[0].strip().startswith("{")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"')
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")) for c in texts})


def read_json(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    return spark.read.option("mode", "FAILFAST").option("multiLine", not lines).json(path)


def read_hub(spark: SparkSession, name: str, split: str | None, columns: str | None = None) -> DataFrame:
    """A hub dataset's shards, read in tasks; columns: a schema of those wanted."""
    from .hub import HubDataSource, available, mirror

    if not available():
        raise ImportError("Reading a hub dataset needs the 'huggingface_hub' package, or a mirror named by SYNTHSCAN_HUB.")
    spark.dataSource.register(HubDataSource)
    reader = spark.read.format("hub").option("dataset", name).option("split", split or "test").option("root", mirror())
    return (reader.schema(columns) if columns else reader).load()


def load(spark: SparkSession, source: str, text_field: str = "text", label_field: str = "label", split: str | None = None) -> DataFrame:
    """A dataset with at least text_field.

    By suffix: .csv, .parquet, .orc, .jsonl, .json; any other existing path is JSON, of lines if it looks so; what is no
    path is a hub dataset. label_field is accepted for symmetry with evaluation; loading doesn't need it.
    """
    suffix = source.rpartition("/")[2].rpartition(".")[2] if "." in source.rpartition("/")[2] else ""
    if suffix == "csv":
        df = read_csv(spark, source)
    elif suffix in ("parquet", "orc"):
        df = spark.read.format(suffix).load(source)
    elif suffix in ("jsonl", "json") or exists(spark, source):
        df = read_json(spark, source, suffix == "jsonl" or looks_like_jsonl(spark, source))
    else:
        df = read_hub(spark, source, split)
    if text_field not in df.columns:
        raise ValueError(f"Column {text_field!r} not found in dataset. Available columns: {df.columns}")
    return df


def load_all(spark: SparkSession, sources: list[str], **options) -> DataFrame:
    """Several datasets under one another, with their names in `dataset`."""
    parts = [load(spark, x, **options).withColumn("dataset", F.lit(x)) for x in sources]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_row_id(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Numbers from 0 in the order of the rows' partitions, without gaps; rows are neither gathered nor sent to Python.

    Partitions are counted first; their counts, one for each partition, are all that reaches the driver. That takes the
    same partitions again when rows are numbered, as files have; what shuffles is written to the shared folder before.
    """
    if row_id in df.columns:
        return df
    names, shuffled = df.columns, SHUFFLES.search(df._jdf.queryExecution().optimizedPlan().toString())
    df = df.withColumn("_number", F.monotonically_increasing_id())
    df = (stored(df, "numbered") if shuffled else df).withColumn("_part", F.shiftrightunsigned("_number", 33))
    counts = df.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()
    total, bases = 0, []
    for r in counts:
        bases.append((r["_part"], total))
        total += r["n"]
    bases = df.sparkSession.createDataFrame(bases, "_part long, _base long")
    numbered = df.join(F.broadcast(bases), "_part")
    return numbered.select(*(F.col(f"`{x}`") for x in names), (F.col("_base") + F.col("_number").bitwiseAND((1 << 33) - 1)).alias(row_id))


def head(df: DataFrame, row_id: str, n: int = 100) -> DataFrame:
    """The first n rows, for trial runs."""
    return df.orderBy(row_id).limit(n)


def scorable(df: DataFrame, text_field: str = "text") -> DataFrame:
    """Rows whose text is a string that isn't blank."""
    if not isinstance(df.schema[text_field].dataType, T.StringType):
        return df.limit(0)
    return df.where(nonblank(F.col(text_field)))
