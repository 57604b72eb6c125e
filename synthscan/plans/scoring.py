"""Scoring runs: only what is missing is computed, together where detectors share a model, and written as soon as it is there."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..detectors import get_detector, list_detectors
from ..sources import readers, sinks
from . import shared

log = logging.getLogger(__name__)


def scored(spark: SparkSession, df: DataFrame, path: str, detectors: list[str] | None = None, force: bool = False, options: dict[str, dict] | None = None, text_field: str = "text") -> DataFrame:
    """df with a score column for each detector. df needs row_id; scores are kept under path.

    A detector that fails is logged and left out. A detector's name that df has as a column already is an error.
    """
    names = detectors or list_detectors()
    for name in names:
        get_detector(name)
        if name in df.columns:
            raise ValueError(f"the input has a column named like the detector {name!r}")
    done = sinks.scored_detectors(spark, path)
    rows = df.withColumn("text", F.col(f"`{text_field}`")) if text_field != "text" else df
    wanted = [x for x in names if force or x not in done]
    for name in sorted({*names} - {*wanted}):
        log.info("%s is there already", name)
    detectors = {name: get_detector(name)(**(options or {}).get(name, {})) for name in wanted}
    groups = shared.grouped(detectors, rows)
    while groups:
        group = groups.pop(0)
        try:
            hashes = rows.select("row_id", F.sha2("text", 256).alias("text_hash"))
            sinks.write_scores(hashes.join(shared.scores(rows, group), "row_id", "left"), path, *group.detectors)
            done = sorted({*done, *group.detectors})
        except Exception:
            log.exception("Detectors failed: %s", ", ".join(group.detectors))
            if len(group.detectors) > 1:  # one may be to blame; the others get their scores without it
                groups = [shared.Group(group.kind, group.provider, {k: v}) for k, v in group.detectors.items()] + groups
    for detector in detectors.values():
        detector.teardown()
    return sinks.attach(df, spark, path, [x for x in done if x not in df.columns], "row_id", text_field)


def score_dataset(spark: SparkSession, source: str, out: str | None = None, debug: bool = False, text_field: str = "text", split: str | None = None, row_id: str | None = None, **run) -> DataFrame:
    """Load, number, filter, score and export one dataset; the widened table."""
    df = readers.load(spark, source, text_field, split=split)
    df = df.withColumn("row_id", F.col(row_id).cast("long")) if row_id else readers.with_row_id(df)
    if debug:
        df = readers.head(df, "row_id")
    path = sinks.shared(spark, sinks.scores_path(sinks.output_dir(out), sinks.dataset_key(spark, source), debug))
    result = scored(spark, readers.scorable(df, text_field), path, text_field=text_field, **run)
    sinks.export_jsonl(result, f"{path}/export")
    return result
