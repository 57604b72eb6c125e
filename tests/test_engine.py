import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from synthscan.detectors import get_detector, list_detectors
from synthscan.operators import evaluate as E
from synthscan.operators import statistics as S
from synthscan.providers import NGramModel, TableProvider, regenerator, reviser
from synthscan.sources import cache, load, readers, sinks

NAMES = "binoculars dna-gpt fast-detect-gpt log-rank lrr mage npr radar rank remodetect revise-detect".split()


def curve(y, s):
    """ROC points the way common libraries give them."""
    y, s = np.array(y), np.array(s)
    order = np.argsort(-s, kind="stable")
    y, s = y[order], s[order]
    at = np.append(np.flatnonzero(np.diff(s)), len(s) - 1)
    tp = np.cumsum(y)[at]
    fp = 1 + at - tp
    if len(tp) > 2:
        keep = np.concatenate(([True], (np.diff(fp, 2) != 0) | (np.diff(tp, 2) != 0), [True]))
        tp, fp = tp[keep], fp[keep]
    return np.append(0, fp) / fp[-1], np.append(0, tp) / tp[-1]


def partial(f, t, m):
    stop = np.searchsorted(f, m, "right")
    if stop == len(f):
        area = np.trapezoid(t, f)
    else:
        area = np.trapezoid(np.append(t[:stop], np.interp(m, f[stop - 1 : stop + 1], t[stop - 1 : stop + 1])), np.append(f[:stop], m))
    return 0.5 * (1 + (area - m * m / 2) / (m - m * m / 2))


def rate(f, t, m):
    i = int(np.argmax(f >= m))
    return 100 * (t[i] if i == 0 else (t[i - 1] + t[i]) / 2)


def test_metrics_equal_plain_ones(spark):
    rng, rows, want = random.Random(1), [], {}
    for d in range(12):
        n, ties = rng.randrange(20, 300), rng.choice([3, 8, 1000])
        y = [1, 0] + [rng.randrange(2) for _ in range(n)]
        s = [rng.randrange(ties) / 7 + 0.3 * v for v in y]
        rows += [(f"d{d}", "x", v, x) for v, x in zip(y, s)]
        f, t = curve(y, np.round(s, 10))
        want[f"d{d}"] = [np.trapezoid(t, f), *(partial(f, t, m) for m in E.RATES), *(rate(f, t, m) for m in E.RATES)]
    rows += [("human only", "x", 0, 0.5)]
    df = spark.createDataFrame(rows, "dataset string, detector string, label int, score double").repartition(5)
    got = {r.dataset: list(r)[2:] for r in E.metrics(df).collect()}
    assert set(got) == set(want)
    for d in want:
        assert got[d] == pytest.approx(want[d], abs=1e-9)
    macro = E.macro_average(E.metrics(df)).first()
    assert list(macro)[1:] == pytest.approx(np.mean(list(want.values()), axis=0).tolist())
    points = [(r.fpr, r.tpr) for r in E.roc_points(df.where("dataset = 'd0'")).collect()]
    f, t = curve([r[2] for r in rows if r[0] == "d0"], np.round([r[3] for r in rows if r[0] == "d0"], 10))
    assert np.allclose(sorted(points), sorted(zip(f, t)))


def test_labels_and_missing_scores(spark):
    df = spark.createDataFrame([(1, 0.1), (0, float("nan")), (None, float("inf")), (1, None), (2, 0.2)], "label int, `log-rank` double")
    rows = E.long_scores(df, ["log-rank"], E.is_machine(F.col("label"))).collect()
    assert sorted((r.label, r.score) for r in rows) == [(0, 0.2), (1, 0.1)]


def test_statistics_and_undefined_values(spark):
    rows = [(1, 0, 1, -1.0, 1, -2.0, 0.5), (1, 0, 2, -3.0, 4, -2.0, 0.5), (2, 0, 1, -1.0, 1, -1.0, 0.0)]
    scores = spark.createDataFrame(rows, "row_id long, variant int, n long, logprob double, rank long, mean_lp double, var_lp double")
    got = {r.row_id: r for r in S.zero_shot(scores).collect()}
    assert got[1]["rank"] == 3 and got[1]["log-rank"] == pytest.approx(2 / 3 * np.log(4)) and got[1]["lrr"] == pytest.approx((-7 / 3) / (2 / 3 * np.log(4)))
    assert got[1]["fast-detect-gpt"] == pytest.approx(-1 / np.sqrt(1.5)) and got[2]["lrr"] is None and got[2]["fast-detect-gpt"] is None
    logits = spark.createDataFrame([([1000.0, 0.0],), (None,), ([],)], "x array<double>").select(S.class_probability(F.col("x")).alias("p"), S.class_logit(F.col("x")).alias("l")).collect()
    assert [tuple(r) for r in logits] == [(1.0, 1000.0), (None, None), (None, None)]


def test_model_against_dense_sums(spark):
    texts = ["the cat sat on the mat the cat", "a dog sat on the log", "one", "the end of the end"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    model = NGramModel(df)
    vocabulary = sorted({w for t in texts for w in t.split()})
    at = {w: i for i, w in enumerate(vocabulary)}
    counts = np.zeros((len(at), len(at)))
    for t in texts:
        for a, b in zip(t.split(), t.split()[1:]):
            counts[at[a], at[b]] += 1
    p, q = ((counts + k) / (counts + k).sum(axis=1, keepdims=True) for k in (0.1, 0.5))
    own = {r.row_id: r for r in S.zero_shot(model.token_scores(df.withColumn("variant", F.lit(0)))).collect()}
    pr, cr = model.cross_scores(df)
    ratio = {r.row_id: r.binoculars for r in S.perplexity_ratio(pr, cr).collect()}
    for i, t in enumerate(texts):
        w = [at[x] for x in t.split()]
        if len(w) < 2:
            assert i not in own
            continue
        ctx, tok = w[:-1], w[1:]
        rank = [1 + (counts[a] > counts[a, b]).sum() for a, b in zip(ctx, tok)]
        mean = [(p[a] * np.log(p[a])).sum() for a in ctx]
        var = [(p[a] * np.log(p[a]) ** 2).sum() - m * m for a, m in zip(ctx, mean)]
        lp = np.log([p[a, b] for a, b in zip(ctx, tok)])
        assert own[i]["rank"] == pytest.approx(np.mean(rank)) and own[i]["log-rank"] == pytest.approx(np.mean(np.log(rank)))
        assert own[i]["fast-detect-gpt"] == pytest.approx((lp.sum() - sum(mean)) / np.sqrt(sum(var)))
        cross = np.mean([-(p[a] * np.log(q[a])).sum() for a in w])
        assert ratio[i] == pytest.approx(np.mean(np.log([q[a, b] for a, b in zip(ctx, tok)])) / cross)


def test_unseen_pairs(spark):
    corpus = spark.createDataFrame([(1, "a b a c")], "row_id long, text string")
    got = NGramModel(corpus).token_scores(spark.createDataFrame([(9, 0, "a a"), (9, 1, "zz b")], "row_id long, variant int, text string"))
    rows = {r.variant: r for r in got.collect()}
    assert rows[0]["rank"] == 3 and rows[0].logprob == pytest.approx(np.log(0.1 / 2.3)) and rows[1].logprob == pytest.approx(np.log(1 / 3))


def test_registry():
    assert list_detectors() == NAMES
    with pytest.raises(KeyError, match="log-rank"):
        get_detector("none")
    for make in (regenerator, reviser):
        with pytest.raises(ValueError):
            make("none")
    assert regenerator("hf").id == reviser("vllm").id == "Qwen/Qwen2.5-7B-Instruct"


def test_table_providers(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "row_id long, text string")
    logits = spark.createDataFrame([(1, [0.0, 0.0]), (3, [1.0, 1.0])], "row_id long, logits array<double>")
    for name, want in (("radar", 0.5), ("remodetect", 0.0), ("mage", 0.0)):
        cls = get_detector(name)
        assert {r.row_id: r.score for r in cls(provider=TableProvider(logits={cls.model: logits})).score(df).collect()} == {1: want, 2: None}
    with pytest.raises(ValueError):
        get_detector("radar")().score(df)


def test_caches(spark, tmp_path):
    store = cache.continuations(spark, str(tmp_path), "org/model 1")
    assert store.path.endswith("org_model_1") and store.table().count() == 0
    store.added(spark.createDataFrame([("k", ["a", "b"]), ("k", ["a", "b"]), ("l", ["c"])], "hash string, continuations array<string>"))
    asked = spark.createDataFrame([("k",), ("l",), ("m",), ("m",)], "key string")
    assert {r.key for r in store.misses(asked, "key", 2).collect()} == {"l", "m"}
    assert {r.key: r.continuations for r in store.looked_up(asked, "key", 1).collect()} == {"k": ["a"], "l": ["c"], "m": None}
    store.added(spark.createDataFrame([("l", ["c", "d"]), ("k", ["new", "new"])], "hash string, continuations array<string>"), 2)
    assert {r.hash: r.continuations for r in store.table().collect()} == {"k": ["a", "b"], "l": ["c", "d"]}


def test_generated_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "e f g h")], "row_id long, text string")

    class Counting:
        def __call__(self, texts):
            with open(f"{tmp_path}/log", "a") as file:
                file.write("".join(f"{t}\n" for t in texts))
            return [["c d", "x"] for _ in texts]

    for _ in range(2):
        scores = get_detector("dna-gpt")(generate=Counting(), k=2, cache_dir=str(tmp_path / "cache"), stopwords=()).score(df).collect()
    assert sorted(open(f"{tmp_path}/log").read().split("\n")) == ["", "a b", "e f"]
    assert {r.row_id: round(r.score, 6) for r in scores} == {1: round(2 * np.log(2) / 2 / 2, 6), 2: round(2 * np.log(2) / 2 / 2, 6), 3: 0.0}


def test_readers(spark, tmp_path):
    rows = [{"text": 'he said ""x""\nnew line', "label": 1}, {"text": "b", "label": 0}]
    (tmp_path / "a.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (tmp_path / "b.json").write_text(json.dumps(rows))
    (tmp_path / "c.csv").write_text('text,label\n"he said ""x""\nnew line",1\nNA,0\n')
    (tmp_path / "d").write_text("".join(json.dumps(r) + "\n" for r in rows))
    assert {r.text for r in load(spark, f"{tmp_path}/a.jsonl").collect()} == {r["text"] for r in rows} == {r.text for r in load(spark, f"{tmp_path}/b.json").collect()}
    assert load(spark, f"{tmp_path}/d").count() == 2
    assert sorted((r.text or "", r.label) for r in load(spark, f"{tmp_path}/c.csv").collect()) == [("", 0), ('he said "x"\nnew line', 1)]
    with pytest.raises(ValueError, match="label"):
        load(spark, f"{tmp_path}/a.jsonl", text_field="body")
    with pytest.raises(ImportError):
        load(spark, "org/dataset")
    numbered = readers.with_row_id(spark.range(10).repartition(3))
    assert sorted(r.row_id for r in numbered.collect()) == list(range(10))
    assert sinks.dataset_key(spark, f"{tmp_path}/a.jsonl") == "a" and sinks.dataset_key(spark, "org/dataset") == "org_dataset"


def test_runs_resume_and_evaluate(spark, tmp_path, capsys):
    from synthscan.plans import cli, scoring

    rng = random.Random(0)
    rows = [{"text": " ".join(rng.choice("a b c d e f g".split()) for _ in range(30)) if i % 5 else " ", "label": i % 2} for i in range(60)]
    path = tmp_path / "data.jsonl"
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    out = str(tmp_path / "out")
    first = scoring.score_dataset(spark, str(path), out, detectors=["rank", "radar"])  # radar has no provider here: logged, left out
    assert "rank" in first.columns and "radar" not in first.columns and first.count() == 48
    second = scoring.score_dataset(spark, str(path), out, detectors=["rank", "lrr"])
    assert {"rank", "lrr"} <= set(second.columns) and second.where("rank IS NULL").count() == 0
    with pytest.raises(KeyError):
        scoring.score_dataset(spark, str(path), out, detectors=["none"])
    shown = cli.evaluated(spark, cli.parser().parse_args([str(path), "--evaluate", "--output-dir", out]))
    assert [r["Detector"] for r in shown] == ["LRR", "RANK"] and set(shown[0]) >= {"AUROC(0.1)", "TPR(FPR=10.0%)"}
    assert "ROC AUC" in capsys.readouterr().out
    assert cli.evaluated(spark, cli.parser().parse_args(["absent", "--output-dir", out])) == []


def test_column_named_like_a_detector(spark, tmp_path):
    from synthscan.plans.scoring import scored

    with pytest.raises(ValueError, match="rank"):
        scored(spark, spark.createDataFrame([(1, "x", 0.5)], "row_id long, text string, rank double"), str(tmp_path), ["rank"])


def test_stream(spark, tmp_path):
    from synthscan.streaming import score_stream

    spark.createDataFrame([(1, "a b a b"), (2, " ")], "row_id long, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("row_id long, text string").parquet(f"{tmp_path}/in")
    score_stream(stream, f"{tmp_path}/out", f"{tmp_path}/check", "rank").awaitTermination()
    assert [(r.row_id, r.score) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(1, 1.0)]
