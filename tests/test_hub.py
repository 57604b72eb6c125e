"""Hub datasets from a mirror in a folder."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from synthscan.sources import load
from synthscan.sources.readers import read_hub


@pytest.fixture
def mirror(tmp_path, monkeypatch):
    folder = tmp_path / "org" / "set" / "data"
    folder.mkdir(parents=True)
    for i in range(3):
        pq.write_table(pa.table({"text": [f"t{i}{j}" for j in range(i)] + [None], "label": [1] * i + [0], "extra": [[1.5]] * (i + 1)}), folder / f"test-0000{i}-of-00003.parquet")
    pq.write_table(pa.table({"text": ["train"]}), folder / "train.parquet")
    monkeypatch.setenv("SYNTHSCAN_HUB", str(tmp_path))


def test_a_partition_for_each_shard(spark, mirror):
    df = load(spark, "org/set")
    assert df.columns == ["text", "label", "extra"] and df.rdd.getNumPartitions() == 3
    assert sorted(map(str, df.select("text", "label").collect())) == sorted(f"Row(text={t!r}, label={n})" for t, n in [(None, 0)] * 3 + [("t10", 1), ("t20", 1), ("t21", 1)])
    assert [r.text for r in load(spark, "org/set", split="train").collect()] == ["train"]


def test_columns_wanted_alone_are_read(spark, mirror):
    assert sorted(read_hub(spark, "org/set", None, "label long").collect()) == [(0,), (0,), (0,), (1,), (1,), (1,)]


def test_nothing_there(spark, mirror):
    with pytest.raises(Exception, match="no Parquet shards"):
        load(spark, "org/none").count()
    with pytest.raises(ValueError, match="body"):
        load(spark, "org/set", "body")
