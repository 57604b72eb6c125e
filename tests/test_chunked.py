"""Scores of the counted texts by chunks, against the tables' joins."""

import random

import pytest
from pyspark.sql import functions as F

from synthscan.operators import statistics as S
from synthscan.providers import NGramModel, chunked


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(6000)]
    rows = [(i, " ".join(words[40 * i : 40 * i + 5 + i % 60])) for i in range(140)]
    rows += [(200, ""), (201, "..."), (202, "alone"), (203, "once last1"), (204, "w1 w1 w1 w1"), (205, "İx K k w1"), (206, "the same"), (206, "the same again")]
    return spark.createDataFrame(rows, "row_id long, text string").repartition(3)


@pytest.mark.parametrize("bucket", [chunked.BUCKET, 64])
def test_chunks_give_what_joins_give(spark, texts, monkeypatch, bucket):
    monkeypatch.setattr(chunked, "BUCKET", bucket)  # the smaller one deals common contexts by pairs, over many buckets
    model = NGramModel(texts)
    assert bool(len(model.chunks.heavy.ctx)) == (bucket == 64) and (model.chunks.buckets > 1) == (bucket == 64)
    rows = lambda df: {r.row_id: tuple(-99.0 if x is None else x for x in r[1:]) for r in df.collect()}
    got, want = rows(model.zero_shot()), rows(S.zero_shot(model.token_scores(None)))
    assert set(want) <= set(got) and all(got[i] == (-99.0,) * 4 for i in set(got) - set(want))
    for i, x in want.items():
        assert got[i] == pytest.approx(x, rel=1e-9, abs=1e-9)
    performer, cross = model.cross_scores(None)
    for median in (False, True):
        found = model.binoculars(median).where("row_id <> 206")
        got, want = rows(found), rows(S.perplexity_ratio(performer, cross, median=median))
        assert set(want) - {206} <= set(got)
        for i, x in got.items():
            assert x == (pytest.approx(want[i], rel=1e-9) if i in want else (-99.0,))


def test_no_row_stands_for_a_place(spark, texts):
    """Exchanges of the scores have a row for each chunk and bucket, or for each text."""
    plan = NGramModel(texts).chunks.texts()._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortMergeJoin" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_medians_of_empty_arrays(spark):
    df = spark.createDataFrame([(1, []), (2, [3.0]), (3, [4.0, 1.0]), (4, None)], "i int, x array<double>")
    assert [r[0] for r in df.orderBy("i").select(S.middle(F.col("x"))).collect()] == [None, 3.0, 2.5, None]


@pytest.mark.parametrize("bucket", [chunked.BUCKET, 64])
def test_other_texts_by_chunks(spark, texts, monkeypatch, bucket):
    """Perturbed texts are asked for by chunks and not counted; pairs and contexts that nothing has seen rank after all others."""
    monkeypatch.setattr(chunked, "BUCKET", bucket)
    model = NGramModel(texts.where("row_id < 200"))
    more = texts.where("row_id < 30 OR row_id = 204").withColumn("variant", F.lit(0)).unionByName(texts.where("row_id < 30").select("row_id", F.concat(F.lit("new w1 new new "), "text", F.lit(" w2 w1 w3")).alias("text"), F.lit(1).alias("variant")))
    rows = lambda df: {(r.row_id, r.variant): (r.n, r.ranks, r.log_ranks) for r in df.where("n > 0").collect()}
    got, want = rows(model.variant_sums(more)), rows(S.sums(model.token_scores(more)))
    assert set(got) == set(want) and len(got) > 55
    for i, x in want.items():
        assert got[i] == pytest.approx(x, rel=1e-9)


def test_perturbation_holds_a_few_texts_at_a_time(spark):
    """Fills get slices of a batch by size, with the same results."""
    from synthscan.functions import perturb

    calls = spark.sparkContext.accumulator(0)

    def fill(masked):
        calls.add(1)
        return perturb.repeat_fill(masked)

    df = spark.range(0, 400, 1, 1).select(F.col("id").alias("row_id"), F.repeat(F.lit("some words here "), 500).alias("text"))
    assert perturb.perturbed(df, "row_id", "text", 2, fill).count() == 1200 and calls.value >= 2


@pytest.mark.parametrize("bucket", [chunked.BUCKET, 64])
def test_drawn_tokens_by_chunks(spark, texts, monkeypatch, bucket):
    """The same draws as by joins; no row stands for a place, and heavy contexts' draws are known to every bucket."""
    monkeypatch.setattr(chunked, "BUCKET", bucket)
    model = NGramModel(texts)
    rows = lambda df: {r.row_id: tuple(-99.0 if x is None else x for x in r[1:]) for r in df.collect()}
    performer, _ = model.cross_scores(None)
    cross = model.sampled_cross_scores(None, 0.8, 3)
    for median in (False, True):
        found = model.binoculars(median, (0.8, 3)).where("row_id <> 206")
        got, want = rows(found), rows(S.perplexity_ratio(performer, cross, median=median))
        assert set(want) - {206} <= set(got) and len(got) > 140
        for i, x in got.items():
            assert x == (pytest.approx(want[i], rel=1e-9) if i in want else (-99.0,))
    plan = model.binoculars(drawn=(0.8, 3))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def some_fill(masked):
    """Pieces of none to three words, known and unknown, and sometimes too few."""
    from synthscan.functions import perturb

    pieces = ["", "w1 w2", "new", "NEW-er w3 w1", "the", "...", "w4"]
    out = []
    for t in masked:
        n = perturb.n_masks(t)
        out.append("".join(f"<extra_id_{i}> {pieces[(i + len(t)) % 7]} " for i in range(n)) + (f"<extra_id_{n}>" if len(t) % 5 else ""))
    return out


@pytest.mark.parametrize("bucket, unknown", [(chunked.BUCKET, 1 << 20), (64, 1)])
def test_npr_without_perturbed_texts(spark, texts, monkeypatch, bucket, unknown):
    """Log-ranks of whole texts' perturbations are those of the perturbed texts; these themselves are never written."""
    from synthscan.detectors import get_detector
    from synthscan.functions import perturb
    from synthscan.providers import perturbed

    long = " ".join(f"w{i * i % 97}, - {i}" for i in range(900))
    odd = [(900, long), (901, None), (902, ""), (903, "W1"), (904, "a <extra_id_0> w1 <extra_id_1> " + "w2 w1 - w3 " * 30), (905, "İs k KW w1 " * 20), (906, "-- " * 60), (907, "w1  w2\nw3\tw1 " * 40)]
    df = texts.unionByName(spark.createDataFrame(odd, "row_id long, text string"))
    monkeypatch.setattr(chunked, "BUCKET", bucket)
    monkeypatch.setattr(perturbed, "UNKNOWN", unknown)
    for fill, options in ((some_fill, {"buffer": 0, "share": 0.5}), (perturb.repeat_fill, {"ceil": True, "span": 3})):
        chunks = perturbed.PerturbedChunks(df, 4, fill, seed=2, **options)
        got = {(r.row_id, r.variant): (r.n, r.log_ranks) for r in chunks.log_ranks().where("n > 0").collect()}
        each = perturb.perturbed(df, "row_id", "text", 4, fill, seed=2, **options)
        want = {(r.row_id, r.variant): (r.n, r.log_ranks) for r in NGramModel(df.coalesce(1)).variant_sums(each.coalesce(1)).where("n > 0").collect()}
        assert set(got) == set(want) and {(900, 4), (904, 0), (905, 0), (907, 0)} <= set(got) and got[900, 4][0] > 1100
        for i, x in want.items():
            assert got[i] == pytest.approx(x, rel=1e-9, abs=1e-9)
        assert bucket > 64 or len(chunks.heavy.ctx)
    assert perturbed.PerturbedChunks(df.where("row_id = 902"), 2, some_fill).log_ranks().where("n = 0 AND log_ranks = 0").count() == 3
    detector = get_detector("npr")(fill=perturb.repeat_fill, seed=1, n_perturbations=2)
    monkeypatch.setattr(type(detector), "variants", None)
    assert detector.score(df).where("score IS NOT NULL").count() > 140


@pytest.mark.parametrize("bucket, chunk", [(chunked.BUCKET, chunked.CHUNK), (16, 1000)])
def test_revised_texts_by_chunks(spark, texts, tmp_path, monkeypatch, bucket, chunk):
    """The same scores as by joins, without a row for a word; slices of prompts are gone when all are generated."""
    from pathlib import Path

    from synthscan.detectors import get_detector
    from synthscan.plans.tables import shared_dir

    def revise(prompts):
        return [" ".join(p.split()[::2]) + " new w1" if len(p) % 7 else "" for p in prompts]

    monkeypatch.setattr(chunked, "BUCKET", bucket)
    monkeypatch.setattr(chunked, "CHUNK", chunk)
    df = texts.unionByName(spark.createDataFrame([(900, ""), (901, "..."), (902, "W1 w1, İs K"), (903, "W1 w1, İs K")], "row_id long, text string")).where("row_id <> 206")  # joins mix rows of one id
    score = lambda name, **options: get_detector("revise-detect")(generate=revise, commit=40, cache_dir=f"{tmp_path}/{name}", **options).score(df)
    before = set(Path(shared_dir(spark).removeprefix("file:")).iterdir())
    found = score("a")
    more = {x.name.split("-")[0] for x in set(Path(shared_dir(spark).removeprefix("file:")).iterdir()) - before if not x.name.endswith(".crc")}
    assert more == {"sequences", "counts"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    got, want = ({r.row_id: r.score for r in x.collect()} for x in (found, score("b", counted=NGramModel(df))))
    assert set(got) == set(want) and sum(x is not None for x in got.values()) > 140 and got[901] is None and got[902] == got[903]
    for i, x in want.items():
        assert got[i] == (pytest.approx(x, rel=1e-9) if x is not None else None), i
