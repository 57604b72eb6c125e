"""One run of a model for all its detectors: the planner, packed scores, batches, devices, and the store of their scores."""

import math
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from synthscan.detectors import get_detector
from synthscan.functions import perturb
from synthscan.operators import statistics as S
from synthscan.plans import scoring, shared
from synthscan.providers import neural
from synthscan.providers.base import provider
from synthscan.sources import sinks
from tests.test_plain import SIZE, exported, softmax  # noqa: F401

TOKENS = ("rank", "log-rank", "lrr", "fast-detect-gpt")


def known_fill(masked):
    """Fills that the exported models' vocabulary has."""
    return ["".join(f"<extra_id_{i}> w{i % 7} " for i in range(perturb.n_masks(t) + 1)) for t in masked]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(2)
    rows = [" ".join(f"w{rng.randrange(SIZE - 1)}" for _ in range(rng.choice((0, 1, 2, 3, 17, 30, 90)))) for _ in range(60)] + [None]
    return spark.createDataFrame(list(enumerate(rows)), "row_id long, text string").repartition(3).cache()


def test_a_text_is_seen_once_for_all_its_detectors(spark, exported, texts):  # noqa: F811
    models = provider("onnx", spark, str(exported[0]))
    seen = spark.sparkContext.accumulator(0)
    runs = spark.sparkContext.accumulator(0)

    class Counting(neural.NeuralProvider):
        def packed_scores(self, df):
            runs.add(1)

            def run(batches):
                for b in batches:
                    seen.add(b.num_rows)
                    yield b

            return super().packed_scores(df.mapInArrow(run, df.schema))

    counting = Counting(**{k: v for k, v in vars(models).items()})
    options = {name: {"provider": counting} for name in (*TOKENS, "binoculars", "npr")}
    options["npr"] |= {"fill": known_fill, "n_perturbations": 3, "seed": 5}
    detectors = {name: get_detector(name)(**o) for name, o in options.items()}
    groups = shared.grouped(detectors, texts)
    assert [sorted(g.detectors) for g in groups] == [sorted((*TOKENS, "npr")), ["binoculars"]]
    together = {r.row_id: r for r in shared.scores(texts, groups[0]).collect()}
    assert runs.value == 1 and seen.value == 4 * texts.count()
    for name in (*TOKENS, "npr"):
        alone = {r.row_id: r.score for r in detectors[name].score(texts).collect()}
        assert {i: r[name] for i, r in together.items()} == {i: (None if x is None else pytest.approx(x, rel=1e-12)) for i, x in alone.items()}


def test_detectors_with_models_of_their_own(spark, texts):
    models = neural.NeuralProvider()
    names = {name: get_detector(name)(provider=models) for name in (*TOKENS, "binoculars", "radar")}
    assert [sorted(g.detectors) for g in shared.grouped(names, texts)] == [["log-rank", "lrr", "rank"], ["fast-detect-gpt"], ["binoculars"], ["radar"]]
    plain = {name: get_detector(name)() for name in (*TOKENS, "binoculars", "npr", "mage")}
    groups = shared.grouped(plain, texts)
    assert [sorted(g.detectors) for g in groups] == [sorted((*TOKENS, "npr")), ["binoculars"], ["mage"]]
    assert groups[0].provider is groups[1].provider  # one counted model


@pytest.mark.parametrize("with_npr", [False, True])
def test_counted_model_together_and_alone(spark, texts, with_npr):
    npr = {"npr": get_detector("npr")(fill=perturb.repeat_fill, n_perturbations=2, seed=3)} if with_npr else {}
    detectors = {name: get_detector(name)() for name in TOKENS} | {"binoculars": get_detector("binoculars")()} | npr
    for group in shared.grouped(detectors, texts):
        got = {r.row_id: r for r in shared.scores(texts, group).collect()}
        for name, detector in group.detectors.items():
            for r in detector.score(texts).collect():
                found = got[r.row_id][name] if r.row_id in got else None
                assert found == (None if r.score is None else pytest.approx(r.score, rel=1e-9)), (name, r)


def test_packed_equals_long(spark, exported, texts):  # noqa: F811
    models = provider("onnx", spark, str(exported[0]))
    packed = {r.row_id: r for r in models.packed_scores(texts).select("row_id", *(S.packed(x).alias(x) for x in TOKENS)).collect()}
    long = {r.row_id: r for r in S.zero_shot(models.token_scores(texts.withColumn("variant", F.lit(0)))).collect()}
    assert len(packed) == texts.count() and {i for i, r in packed.items() if r["rank"] is not None} == set(long)
    for i, r in long.items():
        assert [packed[i][x] for x in TOKENS] == [None if r[x] is None else pytest.approx(r[x], rel=1e-9) for x in TOKENS]
    for median in (False, True):
        own = {r.row_id: r.x for r in models.packed_cross_scores(texts).select("row_id", S.packed("binoculars", median).alias("x")).collect()}
        want = {r.row_id: r.binoculars for r in S.perplexity_ratio(*models.cross_scores(texts), median=median).collect()}
        assert {i: x for i, x in own.items() if x is not None} == {i: pytest.approx(x, rel=1e-9) for i, x in want.items()}


def test_neural_detectors_shuffle_nothing(spark, exported, texts, tmp_path):  # noqa: F811
    models = provider("onnx", spark, str(exported[0]))
    texts.repartition(2).write.parquet(f"{tmp_path}/texts")
    df = spark.read.parquet(f"{tmp_path}/texts")
    for name in (*TOKENS, "binoculars", "radar", "mage", "remodetect"):
        plan = get_detector(name)(provider=models).score(df)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_batched_equals_single(spark, exported, texts):  # noqa: F811
    folder = str(exported[0])
    for cells in (neural.CELLS, 2000):
        old, neural.CELLS = neural.CELLS, cells
        try:
            found = {}
            for size in (1, 3, 64):
                m = neural.NeuralProvider("onnx", **{x: f"{folder}/{x}" for x in ("scorer", "observer", "performer", "similarity")}, classifiers={"c": f"{folder}/MAGE"}, batch_size=size)
                pairs = texts.selectExpr("row_id", "text AS source", "reverse(split(text, ' ')) AS t").selectExpr("row_id", "source", "array_join(t, ' ') AS target")
                tables = (m.packed_scores(texts), m.packed_cross_scores(texts), m.packed_sequence_scores(pairs), m.logits(texts, "c"))
                found[size] = [{r.row_id: r.asDict() for r in t.collect()} for t in tables]
            for size in (3, 64):
                for k, (a, b) in enumerate(zip(found[1], found[size])):
                    near = 1e-9 if k < 2 else 1e-5  # graphs that sum do so in single precision
                    assert a.keys() == b.keys()
                    for i in a:
                        for name, x in a[i].items():
                            assert (x is None) == (b[i][name] is None)
                            assert x is None or np.allclose(x, b[i][name], rtol=near, atol=near)
        finally:
            neural.CELLS = old


class Plain(neural.Model):
    """A model in numpy: logits of a place are a table's row times the mask; records what it is run on."""

    def __init__(self, kind, masks):
        self.kind, self.masks, self.width, self.ran = kind, masks, 7, []
        self.table = np.random.default_rng(1).standard_normal((50, 7))

    def forward(self, ids, mask, decoder):
        self.ran.append((ids.shape, int(mask.sum())))
        out = self.table[ids] * (mask[..., None] if self.masks else 1)
        return out.sum(axis=1) if self.kind == neural.CLASSIFIER else out


@pytest.mark.parametrize("masks", [True, False])
@pytest.mark.parametrize("kind", [neural.CAUSAL, neural.CLASSIFIER])
def test_batches_of_like_length(monkeypatch, kind, masks):
    rng = np.random.default_rng(3)
    rows = [(rng.integers(0, 50, n),) for n in rng.integers(1, 40, 100)]
    m = Plain(kind, masks)
    monkeypatch.setattr(neural, "CELLS", 40 * 7 * 8)
    batches = list(m.batches(rows, 16))
    assert sorted(i for b in batches for i in b) == list(range(100)) and max(map(len, batches)) <= 16
    lengths = [[len(rows[i][0]) for i in b] for b in batches]
    assert [x for b in lengths for x in b] == sorted(x for b in lengths for x in b)
    assert all(len(b) * max(b) * (1 if kind == neural.CLASSIFIER else 7) <= 40 * 7 * 8 for b in lengths)
    if kind == neural.CLASSIFIER and not masks:
        assert all(len(set(b)) == 1 for b in lengths)
    for b in batches:
        for i, got in zip(b, m.logits([rows[i][0] for i in b])):
            alone = m.logits([rows[i][0]])[0]
            assert got.shape == alone.shape and np.allclose(got, alone, rtol=1e-12, atol=1e-12)


def test_statistics_in_slices(monkeypatch):
    rng = np.random.default_rng(4)
    logits, ids = rng.standard_normal((30, 11)), rng.integers(0, 11, 30)
    want = neural.token_statistics(logits, ids), neural.cross_entropy(logits, logits[::-1])
    monkeypatch.setattr(neural, "SLICE", 33)
    got = neural.token_statistics(logits, ids), neural.cross_entropy(logits, logits[::-1])
    assert all(np.allclose(want[0][x], got[0][x]) for x in want[0]) and np.allclose(want[1], got[1])


def test_tasks_take_the_gpus_that_they_are_given(monkeypatch):
    from pyspark import TaskContext

    class Fake:
        def __init__(self, addresses):
            self.addresses = addresses

        def resources(self):
            return {"gpu": self} if self.addresses else {}

    for addresses, n, want in ((["3"], 1, ["cuda:3", "cuda:3"]), (["2", "5"], 2, ["cuda:2", "cuda:5"]), ([], 1, [None, None]), (["1"], 0, [None, None])):
        monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls, a=addresses: Fake(a)))
        assert neural.devices(n) == want
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: None))
    assert neural.devices(1) == [None, None]


def test_fills_are_drawn_from_a_nucleus():
    rng = np.random.default_rng(6)
    lp = neural.log_softmax(3 * rng.standard_normal((200, 20)))
    for top_p in (0.0, 0.3, 0.9, 1.0):
        p = np.exp(neural.nucleus(lp, top_p))
        for full, own in zip(np.exp(lp), p):
            order = np.argsort(-full)
            n = 1 if top_p == 0 else 20 if top_p >= 1 else int(np.searchsorted(np.cumsum(full[order]), top_p)) + 1
            assert set(np.flatnonzero(own)) == set(order[:n])


class Chain(neural.Model):
    """Each token's successor is drawn from its row of a table; token 9 is mask 0, 10 mask 1, and so on."""

    kind, masks, width = neural.SEQUENCE, True, 12

    def __init__(self, table):
        self.table, self.widest = table, 0

    def encode(self, text, most):
        return np.array([9 + int(x[10:-1]) if x.startswith("<extra_id_") else 1 for x in text.split()], np.int64)

    def decode(self, ids):
        return " ".join(f"<extra_id_{i - 9}>" if i >= 9 else f"t{i}" for i in ids)

    def forward(self, ids, mask, decoder):
        self.widest = max(self.widest, len(ids))
        return self.table[decoder]


def test_fills_stop_at_the_mask_after_the_last(monkeypatch):
    rng = np.random.default_rng(2)
    table = rng.standard_normal((12, 12))
    m = Chain(table)
    monkeypatch.setattr(neural, "model", lambda *a: m)
    texts = [f"a <extra_id_0> b{i}" + (" <extra_id_1>" if i % 2 else "") for i in range(40)]
    out = neural.MaskFiller("x", "onnx", most=60, batch_size=16)(texts)
    assert m.widest == 16
    for text, fill in zip(texts, out):
        last = f"<extra_id_{perturb.n_masks(text)}>"
        assert fill.split().count(last) <= 1 and (last not in fill.split() or fill.split()[-1] == last) and len(fill.split()) <= 60
    assert sum(f.split()[-1].startswith("<extra") for f in out) > 10
    assert out == [neural.MaskFiller("x", "onnx", most=60, batch_size=1)([t])[0] for t in texts]
    many = neural.MaskFiller("x", "onnx", most=1, batch_size=500, seed=3)([f"a{i}" for i in range(4000)])
    p = softmax(table[0])
    seen = np.array([sum(x == m.decode([i]) for x in many) for i in range(12)]) / 4000
    assert np.abs(seen - p).max() < 0.03
    top = neural.MaskFiller("x", "onnx", most=1, batch_size=500, top_p=0.5)([f"a{i}" for i in range(1000)])
    kept = np.flatnonzero(np.isfinite(neural.nucleus(np.log(p), 0.5)))
    assert {*top} == {m.decode([i]) for i in kept}


# --- the store of scores


def test_versions_of_scores(spark, tmp_path):
    path = str(tmp_path / "s")
    assert sinks.scored_detectors(spark, path) == []
    df = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "row_id long, text string")
    hashes = df.select("row_id", F.sha2("text", 256).alias("text_hash"))
    sinks.write_scores(hashes.selectExpr("*", "row_id * 1.0D AS rank", "double('nan') AS `log-rank`"), path, "rank", "log-rank")
    sinks.write_scores(hashes.withColumn("score", F.lit(0.5)), path, "lrr")
    reading = sinks.attach(df, spark, path, ["log-rank", "lrr", "rank"], "row_id", "text")
    before = sorted(map(tuple, reading.collect()))
    assert before == [(i, f"t{i}", None, 0.5, float(i)) for i in range(20)] or before == sorted((i, f"t{i}", None, 0.5, float(i)) for i in range(20))
    sinks.write_scores(hashes.withColumn("score", F.lit(9.0)), path, "rank")  # a forced rewrite
    assert sorted(map(tuple, reading.collect())) == before
    assert {r["rank"] for r in sinks.attach(df, spark, path, ["rank"], "row_id", "text").collect()} == {9.0}
    changed = df.withColumn("text", F.when(F.col("row_id") == 3, "new").otherwise(F.col("text")))
    assert [r.row_id for r in sinks.attach(changed, spark, path, ["lrr"], "row_id", "text").where("lrr IS NULL").collect()] == [3]
    sinks.write_scores(hashes.withColumn("score", F.lit(8.0)), path, "rank")
    assert len(sinks.expire(spark, path, 1)) == 1 and sinks.scored_detectors(spark, path) == ["log-rank", "lrr", "rank"]
    assert {r["rank"] for r in sinks.attach(df, spark, path, ["rank"], "row_id", "text").collect()} == {8.0}


def test_a_write_that_fails_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    hashes = spark.createDataFrame([(1, "h")], "row_id long, text_hash string")
    sinks.write_scores(hashes.withColumn("score", F.lit(1.0)), path, "rank")
    with pytest.raises(Exception):
        sinks.write_scores(hashes.withColumn("score", F.raise_error(F.lit("no")).cast("double")), path, "rank")
    shutil.rmtree(f"{path}/absent", ignore_errors=True)
    assert [r["rank"] for r in sinks.read_scores(spark, path, ["rank"]).collect()] == [1.0]


def test_eleven_detectors_one_join(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "row_id long, text string")
    hashes = df.select("row_id", F.sha2("text", 256).alias("text_hash"))
    names = [f"d{i}" for i in range(11)]
    for i, name in enumerate(names):
        sinks.write_scores(hashes.withColumn("score", F.lit(float(i))), path, name)
    out = sinks.attach(df, spark, path, names, "row_id", "text")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert {tuple(r)[2:] for r in out.collect()} == {tuple(map(float, range(11)))}


def test_runs_share_models_and_survive_a_failure(spark, exported, texts, tmp_path):  # noqa: F811
    models = provider("onnx", spark, str(exported[0]))
    options = {name: {"provider": models} for name in (*TOKENS, "binoculars", "npr", "radar")}
    out = scoring.scored(spark, texts.where("text IS NOT NULL"), str(tmp_path / "s"), list(options), options=options)  # npr has no filler here
    assert set(out.columns) == {"row_id", "text", *TOKENS, "binoculars", "radar"}
    some = {r.row_id: r for r in out.collect()}
    alone = {r.row_id: r.score for r in get_detector("lrr")(provider=models).score(texts).collect()}
    assert all(r["lrr"] == (None if alone[i] is None or math.isnan(alone[i]) else pytest.approx(alone[i])) for i, r in some.items())
