"""Scoring of growing inputs: each micro-batch is scored and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..detectors import get_detector
from ..sources.readers import scorable


def score_stream(texts: DataFrame, path: str, checkpoint: str, detector: str, **options) -> StreamingQuery:
    """Score a stream of (row_id, text) with a detector and append (row_id, text_hash, score, batch) to path.

    A batch is written under its number and replaced if it is run again, so results are exactly once. Give a provider
    that doesn't depend on the batch; by default models are counted on each batch alone.
    """
    def one(batch: DataFrame, number: int) -> None:
        rows = scorable(batch)
        found = get_detector(detector)(**options).score(rows)
        out = rows.select("row_id", F.sha2("text", 256).alias("text_hash")).join(found, "row_id", "left")
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return texts.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
