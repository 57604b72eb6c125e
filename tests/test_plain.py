"""Queries without SQL, through the registry, against plain Python versions written from what they promise."""

import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from synthscan.functions import mage, perturb
from synthscan.functions.porter import stem
from synthscan.functions.stopwords import english
from synthscan.providers import neural
from synthscan.queries import _rotations

SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
TEXTS = [
    "One ( two ) three :four ;five 50 % off , \"quoted\", and ''twice'' `back`.", "« Bonjour » dit-il ! 5 000 nº 7 20 ºC 3 cm ?", "„Gut“, sagte er – „ja“ — nein… l‘ami l’ami ‘x’",
    "ab\n\nrest of it\nmore", "a <pad> b <s>c</s> <unk> <|endoftext|> d", "see https://example.com/x?y=1, mail a.b+c@d-e.fr or call +1 (555) 010-1234 now", "Straße Ærø Łódź Привет κόσμε café naïve", "cafÃ© â€œxâ€\x9d",
    "( a ) ) . [[b]] {c} --d-- it 's n't i am . .. ? !", "x\r\ny\tz", "", "word", "price: 5 € and 3 £ © 2020",
]


@pytest.fixture(scope="module")
def rows(spark, sf, tmp_path_factory):
    """A folder with a small documents table, and its texts."""
    folder = tmp_path_factory.mktemp("plain")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").limit(60).collect()
    found = [(r.doc_id, r.text, r.lang) for r in docs] + [(10**6 + i, t, ["en", "de", "fr", "es"][i % 4]) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(found, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    return str(folder), found


def plain_rules(text, lang="en", penn=True):
    for pattern, new in mage.moses_rules(lang, penn):
        text = re.sub(pattern.replace("\\p{Nd}", r"\d").replace("\\x{", "\\u{"), lambda m, new=new: re.sub(r"\$(\d)", lambda d: m[int(d[1])], new), text) if "x{" not in pattern else re.sub(f'(\\.+)"([{re.escape(SPACES)}]*[^<])', r'"\1\2', text)
    return text.strip(SPACES)


def test_punctuation_by_language(spark, rows):
    folder, found = rows
    got = {r.doc_id: r.text for r in entry.queries()["mage_punctuation_by_language"](spark, folder).collect()}
    for d, t, lang in found:
        assert got[d] == plain_rules(t, lang if lang in ("de", "es", "fr") else "en", penn=lang not in ("de", "es", "fr")), t


def plainly_clean(text):
    text = re.sub(r"(?:\\n)+", r"\\n", text.replace("\n", "\\n"))
    text = re.sub(r"^[^\n]{0,3}\\n", "", text).replace("\\n", " ")
    text = plain_rules(re.sub(r"<pad>|<s>|</s>|<unk>|<\|endoftext\|>", "", text))
    for old, new in mage.DETOKENISED:
        text = text.replace(old, new)
    text = text.strip(SPACES)
    if not text.isascii():
        if re.search("[ÃÂâ][\u0080-¿€‚-™Œ-ƒˆ˜]", text):
            for encoding in ("cp1252", "latin-1"):
                try:
                    text = text.encode(encoding).decode("utf-8")
                    break
                except UnicodeError:
                    pass
        out = []
        for c in text:
            known = mage.LETTERS.get(c) or (mage.LETTERS[c.lower()].capitalize() if c.lower() in mage.LETTERS and c != c.lower() else None)
            out.append(known if known is not None else "" if c in mage.LETTERS else c)
        text = unicodedata.normalize("NFKD", "".join(out)).encode("ascii", "ignore").decode()
    text = re.sub(r"[\r\n]+", " ", text)
    text = re.sub(r"(?i)\b(?:https?://|ftp://|www\.)[^\x20\x09-\x0d<>\"]+", "", text)
    text = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "", text)
    text = re.sub(r"(?<![A-Za-z0-9])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![A-Za-z0-9])", "", text)
    text = re.sub(r"[ \t]+", " ", text).strip(SPACES)
    text = re.sub(r"""[^ A-Za-z0-9.?!,:;\-\[\]{}()'"]""", "", text)
    text = re.sub(r"""[-\[\]{}()'"]{2,}""", "", text)
    return re.sub(f"[{re.escape(SPACES)}]+", " ", text).strip(SPACES)


def test_mage_full(spark, rows):
    folder, found = rows
    got = {r.doc_id: r.text for r in entry.queries()["mage_full"](spark, folder).collect()}
    for d, t, _ in found:
        assert got[d] == plainly_clean(t), t


def truncated(text):
    w = text.split()
    at = max(1, min(int(0.5 * len(w)), len(w) - 1))
    return (text, "") if len(w) < 2 else (" ".join(w[:at]), " ".join(w[at:]))


def bscore(rest, others):
    total = 0.0
    for y in others:
        for n in range(2, 26):
            a, b = ({tuple(x[i : i + n]) for i in range(len(x) - n + 1)} for x in (rest, y))
            if a and y:
                total += n * math.log(n) * len(a & b) / (len(y) * len(a))
    return total / len(others)


def test_dna_gpt_stemmed(spark, rows):
    folder, found = rows
    stop = english()
    words = lambda t: [stem(x) if len(x) > 3 else x for x in re.findall("[a-z0-9]+", t.lower()) if x not in stop]
    got = {r.row_id: r.score for r in entry.queries()["dna_gpt_stemmed"](spark, folder).collect()}
    for d, t, _ in found:
        if t.strip():
            prefix, rest = truncated(t)
            want = bscore(words(rest), [words(y) for y in _rotations([prefix])[0]]) if words(rest) else 0.0
            assert got[d] == pytest.approx(want, abs=1e-7)


def bigrams(texts):
    """Counts of pairs, of contexts, and the rank of a pair."""
    pair = Counter()
    for t in texts:
        w = re.findall("[a-z0-9]+", t.lower())
        pair.update(zip(w, w[1:]))
    after = defaultdict(list)
    for (v, _), c in pair.items():
        after[v].append(c)
    return pair, after


def log_rank(text, pair, after):
    w = re.findall("[a-z0-9]+", text.lower())
    each = [math.log(1 + sum(c > pair[v, x] for c in after[v])) if v in after else 0.0 for v, x in zip(w, w[1:])]
    return sum(each) / len(each) if each else None


def test_perturbations_and_npr(spark, rows):
    folder, found = rows
    texts = {d: t for d, t, _ in found if t.strip()}
    some = defaultdict(dict)
    for r in entry.queries()["perturbations"](spark, folder).collect():
        some[r.row_id][r.variant] = r.text
    for d, t in texts.items():
        assert some[d][0] == t and set(some[d]) == {0, 1, 2}
        w = t.split(" ")[:1024]
        n = int(0.3 * len(w) / 4)
        for v in (1, 2):
            out = some[d][v].split(" ")
            fills = [x for x in out if re.fullmatch(r"word\d+", x)]
            assert len(fills) == n and len(out) == len(w) - n  # two words became one, n times
            at = 0
            for x in out:  # what is left stands in its order
                if x in fills and x != (w[at] if at < len(w) else None):
                    at += 2
                else:
                    assert x == w[at]
                    at += 1
    from pyspark.sql import functions as F

    full = defaultdict(dict)
    df = spark.createDataFrame(list(texts.items()), "row_id long, text string")
    for r in perturb.perturbed(df, "row_id", "text", 10, perturb.repeat_fill, seed=1).collect():
        full[r.row_id][r.variant] = r.text
    pair, after = bigrams(texts.values())
    for r in entry.queries()["detector_npr"](spark, folder).collect():
        own = log_rank(texts[r.row_id], pair, after)
        others = [x for x in (log_rank(full[r.row_id][v], pair, after) for v in range(1, 11)) if x is not None]
        assert r.score == (pytest.approx(sum(others) / len(others) / own, abs=1e-5) if own and others else None)


def test_sampled_cross_entropy_is_near_the_whole(spark, sf, rows):
    """Means of many draws are near the sum over the vocabulary, and a hot temperature's draws are rarer words."""
    from synthscan.providers import NGramModel

    df = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id AS row_id", "text")
    model = NGramModel(df)
    mean = lambda t: t.selectExpr("sum(xent * n) / sum(n) AS m").first().m
    whole = mean(model.cross_scores(None)[1])
    assert mean(model.sampled_cross_scores(None)) == pytest.approx(whole, rel=0.02)
    assert mean(model.sampled_cross_scores(None, temperature=0.5)) < whole
    got = entry.queries()["binoculars_sampled"](spark, rows[0])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, got.collect()), key=str)


# --- exported models: tiny graphs with random weights, written by hand


def field(number, kind, payload):
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    return varint(number << 3 | kind) + (varint(payload) if kind == 0 else varint(len(payload)) + payload)


def graph(path, size, inputs, nodes, weights):
    """An ONNX file: nodes are (operator, inputs, outputs), the last output is `logits`; inputs are rows of ids."""
    text = lambda n, s: field(n, 2, s.encode())

    def value(name, kind, dims):
        shape = b"".join(field(1, 2, text(2, x) if isinstance(x, str) else field(1, 0, x)) for x in dims)
        return text(1, name) + field(2, 2, field(1, 2, field(1, 0, kind) + field(2, 2, shape)))

    body = b"".join(field(1, 2, b"".join(text(1, x) for x in i) + b"".join(text(2, x) for x in o) + text(3, f"n{k}") + text(4, op)) for k, (op, i, o) in enumerate(nodes)) + text(2, "g")
    for name, x in weights.items():
        body += field(5, 2, b"".join(field(1, 0, n) for n in x.shape) + field(2, 0, 7 if x.dtype == np.int64 else 1) + text(8, name) + field(9, 2, x.tobytes()))
    body += b"".join(field(11, 2, value(x, 7, ("b", x))) for x in inputs) + field(12, 2, value("logits", 1, ()))
    path.mkdir(parents=True)
    (path / "model.onnx").write_bytes(field(1, 0, 8) + field(7, 2, body) + field(8, 2, text(1, "") + field(2, 0, 17)))
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({f"w{i}": i for i in range(size)} | {"?": size - 1}, unk_token="?"))
    t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    t.save(str(path / "tokenizer.json"))


SIZE = 30


@pytest.fixture(scope="module")
def exported(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("exported"), np.random.default_rng(0)
    tables = {}
    for name in ("scorer", "observer", "performer"):
        tables[name] = (2 * rng.standard_normal((SIZE, SIZE))).astype(np.float32)
        graph(folder / name, SIZE, ["input_ids"], [("Gather", ["table", "input_ids"], ["logits"])], {"table": tables[name]})
    tables["similarity"] = rng.standard_normal((2, SIZE, SIZE)).astype(np.float32)
    nodes = [("Gather", ["a", "input_ids"], ["x"]), ("ReduceMean", ["x"], ["mean"]), ("Gather", ["b", "decoder_input_ids"], ["y"]), ("Add", ["y", "mean"], ["logits"])]
    graph(folder / "similarity", SIZE, ["input_ids", "decoder_input_ids"], nodes, {"a": tables["similarity"][0], "b": tables["similarity"][1]})
    tables["MAGE"] = rng.standard_normal((SIZE, 2)).astype(np.float32)
    for name in ("MAGE", "RADAR-Vicuna-7B", "ReMoDetect-deberta"):
        nodes = [("Gather", ["table", "input_ids"], ["x"]), ("ReduceSum", ["x", "axis"], ["logits"])]
        graph(folder / name, SIZE, ["input_ids"], nodes, {"table": tables["MAGE"], "axis": np.array([1], np.int64)})
    return folder, tables


def softmax(x):
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def test_exported_models_give_token_scores(spark, exported, monkeypatch):
    from synthscan.detectors import get_detector
    from synthscan.providers.base import provider

    folder, tables = exported
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(SIZE - 1)}" for _ in range(n)) for n in (1, 2, 9, 40)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    models = provider("onnx", spark, str(folder))
    score = lambda name, **o: {r.row_id: r.score for r in get_detector(name)(provider=models, **o).score(df).collect()}
    found = {name: score(name) for name in ("rank", "log-rank", "lrr", "fast-detect-gpt", "binoculars")}
    middle = score("binoculars", median=True)
    for i, text in enumerate(texts):
        ids = [int(x[1:]) for x in (text or "").split()]
        if len(ids) < 2:
            assert all(x[i] is None for x in found.values())
            continue
        p, own = softmax(tables["scorer"][ids[:-1]].astype(float)), np.array(ids[1:])
        at = p[np.arange(len(own)), own]
        ranks = (p > at[:, None]).sum(1) + 1
        assert found["rank"][i] == pytest.approx(ranks.mean()) and found["log-rank"][i] == pytest.approx(np.log(ranks).mean())
        assert found["lrr"][i] == (pytest.approx(np.log(at).mean() / np.log(ranks).mean()) if np.log(ranks).sum() else None)
        mean = (p * np.log(p)).sum(1)
        var = (p * np.log(p) ** 2).sum(1) - mean**2
        assert found["fast-detect-gpt"][i] == pytest.approx((np.log(at).sum() - mean.sum()) / np.sqrt(var.sum()))
        o, q = (softmax(tables[x][ids].astype(float)) for x in ("observer", "performer"))
        loss, cross = -np.log(q[np.arange(len(own)), own]), -(o * np.log(q)).sum(1)
        assert found["binoculars"][i] == pytest.approx(-loss.mean() / cross.mean()) and middle[i] == pytest.approx(-np.median(loss) / np.median(cross))


def test_exported_models_give_sequence_scores_and_logits(spark, exported):
    from synthscan.detectors import get_detector
    from synthscan.providers.base import provider

    folder, tables = exported
    models = provider("onnx", spark, str(folder))
    pairs = [(0, "w1 w2 w3", "w4 w5"), (1, "w7", "w7 w8 w9"), (2, "w7", "")]
    got = defaultdict(list)
    for r in models.sequence_scores(spark.createDataFrame(pairs, "row_id long, source string, target string")).collect():
        got[r.row_id].append(r.logprob)
    for i, source, target in pairs[:2]:
        s, t = ([int(x[1:]) for x in y.split()] for y in (source, target))
        p = softmax(tables["similarity"][1][[t[-1], *t[:-1]]].astype(float) + tables["similarity"][0][s].mean())
        assert sorted(got[i]) == pytest.approx(sorted(np.log(p[np.arange(len(t)), t])), rel=1e-4)
    assert 2 not in got
    df = spark.createDataFrame([(0, "w3 w4"), (1, "w9")], "row_id long, text string")
    for name, value in (("radar", lambda x: softmax(x)[0]), ("remodetect", lambda x: x[0])):
        found = {r.row_id: r.score for r in get_detector(name)(provider=models).score(df).collect()}
        assert {i: pytest.approx(value(tables["MAGE"][ids].astype(float).sum(0)), rel=1e-5) for i, ids in ((0, [3, 4]), (1, [9]))} == found


def test_exported_model_fills_masks(exported):
    fill = neural.MaskFiller(str(exported[0] / "similarity"), "onnx", most=12)
    assert fill(["w1 w2"]) == fill(["w1 w2"]) and 1 <= len(fill(["w1 w2"])[0].split()) <= 12


def test_npr_wants_a_filler(spark):
    from synthscan.detectors import get_detector

    with pytest.raises(ImportError):
        get_detector("npr")().score(spark.createDataFrame([(1, "a b")], "row_id long, text string"))


def test_providers_by_name(spark, tmp_path):
    from synthscan.providers.base import provider

    assert provider("ngram", spark) is None
    assert neural.NeuralProvider().of("rank").scorer == "gpt2-xl" and neural.NeuralProvider().of("fast-detect-gpt").scorer == "EleutherAI/gpt-neo-2.7B"
    for kind in ("onnx", "tables", "other"):
        with pytest.raises(ValueError):
            provider(kind, spark)
    spark.createDataFrame([(1, [0.5, 1.5]), (2, [1.0, 0.0])], "row_id long, logits array<double>").write.parquet(f"{tmp_path}/logits/MAGE")
    spark.createDataFrame([(1, 0, 1, -0.5, 3, -1.0, 0.1)], "row_id long, variant int, n long, logprob double, rank long, mean_lp double, var_lp double").write.parquet(f"{tmp_path}/token_scores")
    texts = spark.createDataFrame([(1, "x")], "row_id long, text string")
    tables = provider("tables", spark, str(tmp_path))
    assert [r.logits for r in tables.logits(texts, "yaful/MAGE").collect()] == [[0.5, 1.5]] and tables.token_scores(texts).count() == 1
    with pytest.raises(NotImplementedError):
        tables.sequence_scores(texts)


def test_row_numbers_of_shuffled_and_filtered_tables(spark):
    from synthscan.sources.readers import with_row_id

    for df in (spark.range(1000, numPartitions=7).where("id % 3 = 0"), spark.range(1000).repartition(5), spark.range(90).groupBy("id").count(), spark.range(0)):
        n = df.count()
        assert sorted(r.row_id for r in with_row_id(df).select("row_id").collect()) == list(range(n))


def test_row_numbers_keep_an_order(spark):
    from synthscan.sources.readers import with_row_id

    df = with_row_id(spark.range(1000, numPartitions=9).selectExpr("(id * 7919) % 1000 AS x").orderBy("x"))
    assert all(r.x == r.row_id for r in df.collect())
