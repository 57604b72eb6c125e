"""Where scores go: immutable versions of narrow Parquet tables named by a manifest, and an exported JSON-lines file.

A run writes the scores of detectors that were computed together as one new version, (row_id, text_hash, a column for each),
and then a new manifest, which says in which version each detector's scores are. Manifests are numbered and never
overwritten: whoever reads the last one sees whole versions only, tables that are being read stay as they are, and of two
writers at once the second one takes the next number with the first one's detectors in it. `expire` deletes versions that
no recent manifest names. All detectors' scores are joined to a dataset at once.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .readers import exists

ENVIRONMENT = "SYNTHSCAN_OUTPUT_DIR"


def output_dir(flag: str | None = None) -> str:
    """The flag, else the environment's folder, else ~/.synthscan."""
    return (flag or os.environ.get(ENVIRONMENT) or os.path.expanduser("~/.synthscan")).rstrip("/")


def shared(spark: SparkSession, path: str) -> str:
    """The path, if executors can write to it too: on a cluster it needs a file system's scheme other than file."""
    scheme = path.partition("://")[0] if "://" in path else spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").partition(":")[0]
    if scheme == "file" and not spark.sparkContext.master.startswith("local"):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root or not path.startswith(root):
            raise ValueError(f"{path} is a folder of one machine; name one that all executors share")
    return path


def cache_root(spark: SparkSession) -> str:
    """Where generated texts are kept by default."""
    return shared(spark, f"{output_dir()}/cache")


def dataset_key(spark: SparkSession, source: str) -> str:
    """The file's stem, or for what is no path its name with slashes as underscores."""
    if exists(spark, source):
        name = source.rstrip("/").rpartition("/")[2]
        return name.rpartition(".")[0] or name
    return source.replace("/", "_")


def name_key(name: Column) -> Column:
    """The key of a dataset that is no path, as an expression over its name."""
    return F.translate(name, "/", "_")


def scores_path(out: str, key: str | Column, debug: bool = False) -> str | Column:
    """Where a dataset's scores go; an expression, if the key is one."""
    after = "_scores.debug" if debug else "_scores"
    return F.concat(F.lit(f"{out}/"), key, F.lit(after)) if isinstance(key, Column) else f"{out}/{key}{after}"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _listed(spark: SparkSession, path: str) -> list[str]:
    fs, where = _files(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def _read_manifest(spark: SparkSession, path: str, name: str) -> dict[str, str]:
    fs, where = _files(spark, f"{path}/manifests/{name}")
    stream = fs.open(where)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def _manifests(spark: SparkSession, path: str) -> list[str]:
    return [x for x in _listed(spark, f"{path}/manifests") if x.endswith(".json")]


def manifest(spark: SparkSession, path: str) -> dict[str, str]:
    """Detector -> version of its scores, as the last manifest under the path has it."""
    names = _manifests(spark, path)
    return _read_manifest(spark, path, names[-1]) if names else {}


def _publish(spark: SparkSession, path: str, change: dict[str, str]) -> None:
    """A manifest with the change. Its file is written under another name and renamed, which fails where one is there."""
    for _ in range(100):
        names = _manifests(spark, path)
        now = (_read_manifest(spark, path, names[-1]) if names else {}) | change
        number = int(names[-1].partition(".")[0]) + 1 if names else 0
        fs, draft = _files(spark, f"{path}/manifests/.{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(now).encode()))
        stream.close()
        _, target = _files(spark, f"{path}/manifests/{number:012d}.json")
        if not fs.exists(target) and fs.rename(draft, target):
            return
        fs.delete(draft, False)
    raise RuntimeError(f"no manifest could be written under {path}")


def write_scores(scores: DataFrame, path: str, *detectors: str) -> None:
    """scores: (row_id, text_hash, a column for each detector, or `score` for a single one). NaN becomes null."""
    spark = scores.sparkSession
    single = len(detectors) == 1 and detectors[0] not in scores.columns
    columns = {x: F.col("score" if single else f"`{x}`") for x in detectors}
    clean = [F.when(~F.isnan(c), c).cast("double").alias(x) for x, c in columns.items()]
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    scores.select("row_id", "text_hash", *clean).write.parquet(f"{path}/versions/{version}")
    _publish(spark, path, dict.fromkeys(detectors, version))


def scored_detectors(spark: SparkSession, path: str) -> list[str]:
    """Detectors with scores under the path."""
    return sorted(manifest(spark, path))


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete manifests but the last `keep`, and versions that none of those names; the versions' names."""
    names = _manifests(spark, path)
    named = {v for x in names[-keep:] for v in _read_manifest(spark, path, x).values()}
    newest = max(named, default="")
    gone = [x for x in _listed(spark, f"{path}/versions") if x not in named and x < newest]  # later ones may be about to be named
    for name in [f"manifests/{x}" for x in names[:-keep]] + [f"versions/{x}" for x in gone]:
        fs, where = _files(spark, f"{path}/{name}")
        fs.delete(where, True)
    return gone


def read_scores(spark: SparkSession, path: str, detectors: list[str]) -> DataFrame:
    """(row_id, text_hash, a column for each detector): each version is read once, and one aggregation pivots them all."""
    versions: dict[str, list[str]] = {}
    for name, version in manifest(spark, path).items():
        if name in detectors:
            versions.setdefault(version, []).append(name)
    if not versions:
        raise ValueError(f"no scores of {detectors} under {path}")
    empty = F.lit(None).cast("double")
    parts = [spark.read.parquet(f"{path}/versions/{v}").select("row_id", "text_hash", *((F.col(f"`{x}`") if x in own else empty).alias(x) for x in detectors)) for v, own in versions.items()]
    if len(parts) == 1:
        return parts[0]
    return reduce(lambda a, b: a.union(b), parts).groupBy("row_id", "text_hash").agg(*(F.max(f"`{x}`").alias(x) for x in detectors))


def attach(df: DataFrame, spark: SparkSession, path: str, detectors: list[str], row_id: str, text_field: str) -> DataFrame:
    """df with a score column for each detector, joined once on row and text; rows whose text has changed get null."""
    if not detectors:
        return df
    scores = read_scores(spark, path, detectors).withColumnsRenamed({"row_id": "_row", "text_hash": "_hash"})
    return df.join(scores, (F.col(row_id) == F.col("_row")) & (F.sha2(F.col(text_field), 256) == F.col("_hash")), "left").drop("_row", "_hash")


def export_jsonl(df: DataFrame, path: str) -> None:
    """The widened table as JSON lines, nulls written; ten decimals, as data frames write by default."""
    doubles = {f.name: F.round(F.col(f"`{f.name}`"), 10) for f in df.schema.fields if f.dataType.typeName() == "double"}
    df.withColumns(doubles).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    spark = df.sparkSession
    spark.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.schema")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """An exported table, with the schema it was written with."""
    found = spark.read.text(f"{path}.schema", wholetext=True).first() if exists(spark, f"{path}.schema") else None
    return (spark.read.schema(T.StructType.fromJson(json.loads(found[0]))) if found else spark.read).json(path)


def markdown(rows: list[dict]) -> str:
    """A small table for the console."""
    if not rows:
        return ""
    names = list(rows[0])
    cells = [names, *([str(r[n]) for n in names] for r in rows)]
    widths = [max(len(c[i]) for c in cells) for i in range(len(names))]
    line = lambda c: "| " + " | ".join(x.ljust(w) for x, w in zip(c, widths, strict=True)) + " |"
    return "\n".join([line(cells[0]), "|" + "|".join("-" * (w + 2) for w in widths) + "|", *map(line, cells[1:])])
