import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from synthscan.functions import mage, overlap, perturb, porter
from synthscan.functions import text as X


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_blank_texts(spark):
    assert column(spark, [None, "", " ", "\t\n", "\xa0", "\x1c", "x", " x "], X.nonblank) == [False] * 6 + [True] * 2
    every = [chr(i) for i in range(1, 0x3100) if not 0xD800 <= i < 0xE000]
    assert column(spark, every, X.nonblank) == [not c.isspace() for c in every]


@pytest.mark.parametrize("ratio", [0.0, 0.29, 0.5, 1.0])
def test_truncate(spark, ratio):
    def plain(t):
        w = t.split()
        if len(w) < 2:
            return t, ""
        cut = min(max(1, int(ratio * len(w))), len(w) - 1)
        return " ".join(w[:cut]), " ".join(w[cut:])

    texts = ["", "one", " one ", "a b", "a  b\nc", " ".join(map(str, range(100)))]
    assert [tuple(r) for r in column(spark, texts, lambda c: X.truncated(c, ratio))] == [plain(t) for t in texts]


def test_keys_and_prompts(spark):
    import hashlib

    key = hashlib.sha256(b"prefix\x000.5\x0020").hexdigest()
    assert column(spark, ["prefix"], lambda c: X.continuation_key(c, 0.5, 20)) == [key]
    assert column(spark, [None, "", "p"], lambda c: X.with_prompt(c, F.lit("t"))) == ["t", "t", "p\nt"]
    assert column(spark, [None, " \n", " r "], lambda c: X.or_original(c, F.lit("t"))) == ["t", "t", "r"]
    assert column(spark, ["Qwen/Q 2.5-7B"], X.shard_name) == ["Qwen_Q_2.5-7B"]
    assert column(spark, [10, 700, 4090], lambda c: X.token_budget(c, 1024, 4096), "int") == [20, 1024, 6]


def test_stems():
    known = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "hopping": "hop", "filing": "file", "relational": "relat", "conditional": "condit", "digitizer": "digit", "triplicate": "triplic", "hopeful": "hope", "goodness": "good", "revival": "reviv", "adoption": "adopt", "rate": "rate", "controll": "control", "happy": "happi", "skies": "sky", "dying": "die", "generalization": "gener", "electricity": "electr"}
    assert {w: porter.stem(w) for w in known} == known


def test_overlap_agrees(spark):
    assert overlap.bscore_of(list("abc"), [list("abc")]) == pytest.approx((2 * math.log(2) + 3 * math.log(3)) / 3)
    assert overlap.bscore_of([], [["a"]]) == overlap.bscore_of(["a", "b"], []) == 0.0
    rng = random.Random(0)
    rows = [(i, [rng.choice("abcd") for _ in range(rng.randrange(12))], [[rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(rng.randrange(4))]) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, r array<string>, ys array<array<string>>")
    for r, (_, a, ys) in zip(df.select("i", overlap.bscore(F.col("r"), F.col("ys"), 1, 6).alias("a"), overlap.bscore_fast(1, 6)("r", "ys").alias("b")).orderBy("i").collect(), rows, strict=True):
        assert r.a == pytest.approx(overlap.bscore_of(a, ys, 1, 6), abs=1e-12) and r.b == pytest.approx(r.a, abs=1e-12)


def test_tokens_and_stop_words(spark):
    words = column(spark, ["The cats, running; x9 the"], lambda c: overlap.stemmed(overlap.without(overlap.tokens(c), ["the"])))
    assert words == [["cat", "run", "x9"]] or words == [["cats", "run", "x9"]]  # four letters are stemmed


def test_masks():
    rng = np.random.default_rng(0)
    assert perturb.n_masks(perturb.masked("w " * 12 + "w", rng)) == 0 and perturb.n_masks(perturb.masked("w " * 13 + "w", rng)) == 1
    text = " ".join(f"w{i}" for i in range(100))
    one = perturb.masked(text, np.random.default_rng(5))
    assert one == perturb.masked(text, np.random.default_rng(5)) and perturb.n_masks(one) == 7
    assert perturb.filled(one, perturb.fills(perturb.repeat_fill([one])[0])).count("word") == 7
    assert perturb.filled(one, ["few"]) == ""
    assert perturb.fills("<pad><extra_id_0> a <extra_id_1> b<extra_id_2></s>") == ["a", "b"]


def test_perturbed_is_reproducible(spark):
    df = spark.createDataFrame([(1, "a b c d " * 10), (2, "short"), (3, None)], "row_id long, text string")
    run = lambda: sorted(map(tuple, perturb.perturbed(df, "row_id", "text", 2, seed=3).where("text IS NOT NULL").collect()))
    assert run() == run()
    assert [x[2] for x in run() if x[0] == 2] == ["short"] * 3


def test_mage(spark):
    assert column(spark, ["ab\nrest", "abcd\nrest", "a\n\n\nb\\nc"], mage.without_line_breaks) == ["rest", "abcd rest", "b c"]
    assert column(spark, ["a<s>b</s><|endoftext|>"], mage.without_special_tokens) == ["ab"]
    assert column(spark, ["“Hi” , he said — no …"], mage.punctuation) == ['"Hi" , he said - no ...']
    assert column(spark, ["Say \"a\", b ( c ) !"], mage.detokenised) == ['Say "a", b (c)!']
    assert column(spark, ["see http://x.org/a?b=1 or mail me@x.org"], mage.normalised) == ["see or mail"]
    assert column(spark, ["x [[y]] z~"], mage.allowed) == ["x y z"]
    assert len(mage.moses_rules()) == 45


def test_patterns_are_tried_where_they_can_match(spark):
    """Every rule that isn't literal waits for what its matches hold, and gives what the bare rules give."""
    import random

    rng = random.Random(7)
    parts = [" ", "  ", "(", ")", '"', '".', '",', " %", "7", "x", "‘", "’", " ", "<", ".", ",", "\n", "\t", "é", "``", "''", "a@b.c", "www.", "http://", "WWW.x", "555-123-4567", "~", "[", "{}", "\x00", "#", "\x7f"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(1500)] + ["".join(map(chr, range(300)))]
    df = spark.createDataFrame([(x,) for x in texts], "text string").repartition(2).cache()
    text, same = F.col("text"), []
    for lang in ("en", "de", "cs"):
        bare = text
        for pattern, new in mage.moses_rules(lang):
            bare = F.regexp_replace(bare, pattern, new)
        same.append(mage.punctuation(text, lang).eqNullSafe(mage.strip(bare)))
    bare = F.regexp_replace(mage.ascii_only(text), r"[\r\n]+", " ")
    for pattern in (mage.LINK, mage.ADDRESS, mage.PHONE):
        bare = F.regexp_replace(bare, pattern, "")
    same.append(mage.cleaned(text).eqNullSafe(mage.strip(F.regexp_replace(bare, r"[ \t]+", " "))))
    bare = F.regexp_replace(F.regexp_replace(text, f"{mage.FORBIDDEN}+", ""), mage.RUNS, "")
    same.append(mage.allowed(text).eqNullSafe(mage.strip(F.regexp_replace(bare, f"[{mage.SPACE}]+", " "))))
    assert [df.where(~x).count() for x in same] == [0] * 5
    plan = df.select(mage.punctuation(text))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN Contains(") == sum(x in mage.NEEDS for x, _ in mage.moses_rules()) == 9


def test_longer_ngrams_are_looked_up_where_shorter_ones_are_shared(monkeypatch):
    rest, other = [f"a{i}" for i in range(300)], [f"b{i}" for i in range(900)]
    other[100:110] = rest[20:30]
    looked, search = [], np.searchsorted
    monkeypatch.setattr(overlap.np, "searchsorted", lambda a, v, *x, **y: looked.append(np.size(v)) or search(a, v, *x, **y))
    assert overlap.bscore_by_hash(rest, [other]) == pytest.approx(overlap.bscore_of(rest, [other]), rel=1e-12)
    assert looked[0] == 900 and looked[1:] == [10, 9, 8, 7, 6, 5, 4, 3, 2, 1][: len(looked) - 1] and len(looked) > 9


def test_whole_texts_are_masked():
    """Masks lie all over a long text, as many as its words ask for, apart from each other; long texts take time in proportion."""
    words = [f"w{i}" for i in range(100_000)]
    out = perturb.masked(" ".join(words), np.random.default_rng(3)).split(" ")
    at = [i for i, x in enumerate(out) if x.startswith("<extra_id_")]
    assert [out[i] for i in at] == [f"<extra_id_{i}>" for i in range(7500)] and len(out) == 100_000 - 7500
    assert min(b - a for a, b in zip(at, at[1:])) >= 2 and at[0] < 1000 and at[-1] > len(out) - 1000
    assert [x for x in out if x[0] == "w"] == [x for x, keep in zip(words, _kept(out)) if keep]
    assert perturb.filled(" ".join(out), ["some"] * 7500).split(" ").count("some") == 7500
    dense = perturb.spans(1000, np.random.default_rng(3), share=9.0)  # as many as there is room for
    assert 3 * 200 < 3 * len(dense) and min(b - a for a, b in zip(dense, dense[1:])) >= 3 and max(b - a for a, b in zip(dense, dense[1:])) < 6


def _kept(out):
    for x in out:
        yield from (True,) if x[0] == "w" else (False, False)
