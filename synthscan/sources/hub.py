"""Hub datasets as a Spark data source: an input partition for each Parquet shard, read in tasks, in Arrow batches.

    spark.dataSource.register(HubDataSource)
    spark.read.format("hub").option("dataset", "org/name").option("split", "test").load()

A dataset is a folder of shards, `<root>/<org>/<name>/.../<split>-00000-of-00002.parquet`, or of one file `<split>.parquet`.
Option `root` (readers.load takes it from the driver's SYNTHSCAN_HUB) names a mirror by any path that pyarrow opens and all
executors see; without it, shards are read from the hub itself, which needs the huggingface_hub package. With a schema given to the
reader only its columns are read. Nothing but shards' names and schemas reaches the driver.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

ENVIRONMENT = "SYNTHSCAN_HUB"


def mirror() -> str:
    """The mirror that the environment names, or nothing."""
    return os.environ.get(ENVIRONMENT, "")


def available() -> bool:
    """Whether there is a mirror, or the package that reads the hub itself."""
    import importlib.util

    return bool(mirror()) or importlib.util.find_spec("huggingface_hub") is not None


def opened(root: str | None) -> tuple[fs.FileSystem, str]:
    if root:
        return fs.FileSystem.from_uri(root if "://" in root else os.path.abspath(root))
    from huggingface_hub import HfFileSystem

    return fs.PyFileSystem(fs.FSSpecHandler(HfFileSystem())), "datasets"


def shards(root: str | None, dataset: str, split: str) -> list[str]:
    """The split's files in the order of their names."""
    files, path = opened(root)
    found = files.get_file_info(fs.FileSelector(f"{path}/{dataset}", recursive=True, allow_not_found=True))
    named = re.compile(rf"{re.escape(split)}(-\d+-of-\d+)?([-.][0-9a-f]+)?\.parquet")
    return sorted(x.path for x in found if x.is_file and named.fullmatch(x.base_name))


class HubDataSource(DataSource):
    """Options: dataset; split (test by default); root."""

    @classmethod
    def name(cls) -> str:
        return "hub"

    def _asked(self) -> tuple[str | None, str, str]:
        if "dataset" not in self.options:
            raise ValueError("the option 'dataset' is needed")
        return self.options.get("root") or None, self.options["dataset"], self.options.get("split", "test")

    def _shards(self) -> list[str]:
        found = shards(*self._asked())
        if not found:
            raise FileNotFoundError(f"no Parquet shards of {self._asked()[1]}, split {self._asked()[2]}")
        return found

    def schema(self) -> StructType:
        import pyarrow.parquet as pq

        files, found = opened(self._asked()[0])[0], []
        for path in self._shards():
            with files.open_input_file(path) as file:
                found.append(pq.read_schema(file).remove_metadata())
        return from_arrow_schema(pa.unify_schemas(found, promote_options="permissive"))  # a shard's column may be all null

    def reader(self, schema: StructType) -> DataSourceReader:
        return HubReader(self._asked()[0], self._shards(), schema)


class HubReader(DataSourceReader):
    def __init__(self, root: str | None, paths: list[str], schema: StructType) -> None:
        self.root, self.paths, self.schema = root, paths, to_arrow_schema(schema)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(x) for x in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        with opened(self.root)[0].open_input_file(partition.value) as file:
            for batch in pq.ParquetFile(file).iter_batches(columns=self.schema.names):
                yield from pa.Table.from_batches([batch]).select(self.schema.names).cast(self.schema).to_batches()
