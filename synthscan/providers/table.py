"""Precomputed model output as tables keyed by row_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import exists
from .base import CLASSIFIERS, Provider


class TableProvider(Provider):
    """Serves the tables it is given, for the rows asked for."""

    def __init__(self, token_scores: DataFrame | None = None, performer: DataFrame | None = None, cross: DataFrame | None = None, sequence: DataFrame | None = None, logits: dict[str, DataFrame] | None = None) -> None:
        self.tables = {"token_scores": token_scores, "performer": performer, "cross": cross, "sequence": sequence}
        self.by_model = logits or {}

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> TableProvider:
        """From Parquet tables under a folder: token_scores, performer, cross, sequence, and logits/<model> (its name's last part)."""
        table = lambda name: spark.read.parquet(f"{path}/{name}") if exists(spark, f"{path}/{name}") else None
        logits = {name: table(f"logits/{name.rpartition('/')[2]}") for name in CLASSIFIERS}
        return cls(*(table(x) for x in ("token_scores", "performer", "cross", "sequence")), {k: v for k, v in logits.items() if v is not None})

    def _of(self, table: DataFrame | None, rows: DataFrame, what: str) -> DataFrame:
        if table is None:
            raise NotImplementedError(f"no table of {what} was given")
        return table.join(rows.select("row_id").distinct(), "row_id", "left_semi")

    def token_scores(self, texts: DataFrame) -> DataFrame:
        return self._of(self.tables["token_scores"], texts, "token scores")

    def cross_scores(self, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        return self._of(self.tables["performer"], texts, "performer scores"), self._of(self.tables["cross"], texts, "cross scores")

    def sequence_scores(self, pairs: DataFrame) -> DataFrame:
        return self._of(self.tables["sequence"], pairs, "sequence scores")

    def logits(self, texts: DataFrame, model: str, most: int | None = None) -> DataFrame:
        return self._of(self.by_model.get(model), texts, f"logits of {model}")
