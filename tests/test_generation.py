"""Generation that can be stopped and goes on, its limits, and the cache's folders."""

import sys
import types

import pytest
from pyspark.sql import functions as F

from synthscan.detectors import get_detector
from synthscan.providers.generate import Regenerator
from synthscan.sources import cache


def test_a_stopped_run_asks_only_for_what_is_not_done(spark, tmp_path):
    df = spark.createDataFrame([(i, f"a{i} b c d{i}") for i in range(40)], "row_id long, text string")
    log = str(tmp_path / "log")

    class Failing:
        def __init__(self, most):
            self.most = most

        def __call__(self, texts):
            with open(log, "a+") as file:
                file.seek(0)
                if len(file.read().split("\n")) - 1 + len(texts) > self.most:
                    raise RuntimeError("stopped")
                file.write("".join(f"{t}\n" for t in texts))
            return [["c x"] for _ in texts]

    options = {"k": 1, "cache_dir": str(tmp_path / "cache"), "stopwords": (), "model": "m", "commit": 10}
    with pytest.raises(Exception, match="stopped"):
        get_detector("dna-gpt")(generate=Failing(25), **options).score(df.coalesce(1)).collect()
    done = open(log).read().split("\n")[:-1]
    kept = cache.continuations(spark, str(tmp_path / "cache"), "m").table().count()
    assert 0 < kept <= len(done) < 40
    assert get_detector("dna-gpt")(generate=Failing(10**6), **options).score(df).count() == 40
    asked = open(log).read().split("\n")[:-1]
    assert len(asked) == len(done) + 40 - kept and set(asked) == {f"a{i} b" for i in range(40)}


def test_lookups_read_the_folders_of_their_keys(spark, tmp_path):
    store = cache.revisions(spark, str(tmp_path), "m")
    store.added(spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.concat(F.lit("v"), "id").alias("revised")))
    asked = spark.createDataFrame([(7,), (8,), (9000,)], "id long").select("id", F.sha2(F.col("id").cast("string"), 256).alias("key"))
    found = store.looked_up(asked, "key", few=True)
    assert {r.id: r.revised for r in found.collect()} == {7: "v7", 8: "v8", 9000: None}
    files = {f for f in store.table(asked, "key").inputFiles()}
    plan = store.table(asked, "key")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in plan and files
    assert [r.id for r in store.misses(asked, "key", few=True).collect()] == [9000]


def test_compaction_keeps_the_last_entries(spark, tmp_path):
    store = cache.revisions(spark, str(tmp_path), "m")
    for i in range(3):
        store.appended(spark.createDataFrame([("k", f"v{i}"), (f"own{i}", "x")], "hash string, revised string"))
    before = sorted(map(tuple, store.table().collect()))
    assert before == [("k", "v2"), ("own0", "x"), ("own1", "x"), ("own2", "x")]
    store.compact()
    assert store._generation() == 1 and sorted(map(tuple, store.table().collect())) == before
    assert spark.read.parquet(f"{store.path}/gen-1").count() == 4
    store.added(spark.createDataFrame([("new", "y"), ("k", "no")], "hash string, revised string"))
    assert sorted(map(tuple, store.table().collect())) == sorted([*before, ("new", "y")])


def fake_client(monkeypatch, failures, error):
    """A client whose every request fails so many times; it notes how many are under way at once."""
    state = {"now": 0, "most": 0, "asked": 0}

    class Client:
        def __init__(self):
            self.left = {}
            self.completions = self

        async def create(self, model, prompt, n, max_tokens, temperature):
            import asyncio

            state["asked"] += 1
            state["now"] += 1
            state["most"] = max(state["most"], state["now"])
            await asyncio.sleep(0.001)
            state["now"] -= 1
            self.left[prompt] = self.left.get(prompt, failures) - 1
            if self.left[prompt] >= 0:
                raise error
            return types.SimpleNamespace(choices=[types.SimpleNamespace(text=f" {prompt}{i} ") for i in range(n)])

    monkeypatch.setitem(sys.modules, "openai", types.SimpleNamespace(AsyncOpenAI=Client))
    monkeypatch.setenv("OPENAI_API_KEY", "x")
    return state


def test_requests_are_limited_and_tried_again(monkeypatch):
    state = fake_client(monkeypatch, 2, TimeoutError("busy"))
    make = lambda **o: Regenerator("openai", "m", k=2, in_flight=3, pause=0.001, **o)
    assert make()([f"p{i}" for i in range(20)]) == [[f"p{i}0", f"p{i}1"] for i in range(20)]
    assert state["most"] == 3 and state["asked"] == 60
    with pytest.raises(TimeoutError):
        make(attempts=2)(["q"])
    refused = ValueError("no")
    refused.status_code = 401
    state = fake_client(monkeypatch, 1, refused)
    with pytest.raises(ValueError):
        make()(["p"])
    assert state["asked"] == 1


def test_a_chat_models_message_is_the_bare_prefix():
    assert Regenerator("hf", "m").chat("Once upon") == "Once upon"
