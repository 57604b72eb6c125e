"""Each operator against a brute-force version, on the smallest tables and on hand-made awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from synthscan.llm import ann, kernel, licenses, line_dedup, lm_score, minhash_dedup, mixing, packing, pii, quality_rules, substring_dedup, tokens
from synthscan.llm.components import components

PASSAGE = " ".join(f"passage{i}" for i in range(60))
#: null and empty texts, white space only, one word, exact copies, near copies, shared passages, a long text, odd characters
TEXTS = [
    None, "", " \t\n ", "word", "one two three four", PASSAGE, PASSAGE, PASSAGE.upper(), PASSAGE + " tail", f"head {PASSAGE} and {PASSAGE}",
    "a\nb\nc\nd", "x\na\nb\nc\n\ny", "same " * 50, "été 中文 \U0001f600 " * 12, " ".join(str(i % 977) for i in range(30_000)),
    "mail bob@example.com, call +1 (555) 010-9999 or 4111 1111 1111 1111 from 10.0.0.1.", "1" * 5000 + " " + "a" * 5000 + "@", "<|endoftext|> is text\r\n",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", ["a", "b", None][i % 3], 1, "x", "y") for i, t in enumerate(TEXTS)]
    rows += [(5, PASSAGE, "en", "a", 1, "x", "y"), (None, PASSAGE, "en", "a", 1, "x", "y"), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, places string, body string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def words(text):
    return (text or "").encode().split()


# --- 1: substring dedup


def repeats(rows, n=20):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, (math.inf, 0)), (d, i))
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] != (d, i):
                gone.update(range(i, i + n))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out)


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_substring_dedup(request, table):
    df = request.getfixturevalue(table)
    got = substring_dedup.substring_dedup(df).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == repeats([x for x in pairs(df) if x[0] is not None])
    assert [r.n_removed for r in got if r.doc_id is None] == [0] * (2 if table == "odd" else 0)


def test_substring_dedup_in_small_chunks_and_buckets(docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 1 << 16)
    assert sorted(map(tuple, substring_dedup.substring_dedup(docs).collect())) == repeats(pairs(docs))


def test_cover_is_checked(docs):
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(docs, cover=(0, 1, 2))


def test_kernel_words():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \t\n\x0b\x1c é") for _ in range(rng.randrange(40))).encode() for _ in range(300)]
    w = kernel.words(texts)
    assert [[w.data[a:b] for a, b in zip(w.starts[i:j], w.ends[i:j])] for i, j in zip(w.first, w.first[1:])] == [t.split() for t in texts]
    by_hash = defaultdict(set)
    for a, b, h in zip(w.starts, w.ends, w.hashes()):
        by_hash[h].add(w.data[a:b])
    assert all(len(x) == 1 for x in by_hash.values()) and len(by_hash) == len({x for t in texts for x in t.split()})


# --- 2: quality rules


def stats(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    twice = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice)


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_statistics(request, table):
    df = request.getfixturevalue(table)
    out = quality_rules.with_statistics(df)
    assert {"doc_id", "text", "lang"} <= set(out.columns)
    for r in out.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == stats(r.text)


def test_rules_find_planted_thresholds():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    bad = (x[:, 1] > 0.9) | (x[:, 2] < 0.05) & (x[:, 3] > 0.4)
    rules = quality_rules.learn(x, bad, list("abcd"))
    hit = np.zeros(len(x), bool)
    for rule in rules.rules:
        on = np.ones(len(x), bool)
        for name, sign, t in rule:
            on &= x[:, "abcd".index(name)] <= t if sign == "<=" else x[:, "abcd".index(name)] > t
        hit |= on
    assert hit[bad].mean() > 0.95 and hit[~bad].mean() < 0.01


def test_quality_on_labels(spark, docs):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = quality_rules.quality(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").collect()
    held = [r for r in out if not r.base_failed]
    assert sum(not r.kept for r in held if r.quality == 1) == 0
    assert sum(not r.kept for r in held if r.quality == 0) > 0.9 * sum(r.quality == 0 for r in held)


def test_quality_without_labels(spark, odd, empty):
    none = spark.createDataFrame([(1, None), (None, 0)], "doc_id long, quality int")
    assert all(r.kept == (not r.base_failed) for r in quality_rules.quality(odd, none).collect())
    assert quality_rules.quality(empty, none).count() == 0


# --- 3: nearest neighbours


def test_hilbert_curve_visits_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8, dtype=np.uint64)] * 3), -1).reshape(-1, 3)
    key = ann.hilbert(grid, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)].astype(int), axis=0)).sum(axis=1) == 1).all()


def test_nearest(spark):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((9, 12))
    rows = [(i, (centers[i % 9] + 0.1 * rng.standard_normal(12)).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # equal vectors
    bad = [(2000, None), (2001, []), (2002, [0.0] * 12), (2003, [None] * 12), (2004, [float("nan")] * 12), (2005, [float("inf")] * 12), (2006, [1.0]), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 10 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    v, ids = np.array([x[1] for x in rows]), np.array([x[0] for x in rows])
    for q in ids[ids % 10 == 0]:
        s = ann.cosine(v[ids == q][0], v)
        s[ids == q] = -9
        order = np.lexsort((ids, -s))[:5]
        assert sorted(got.pop(q)) == [(i + 1, ids[j], s[j]) for i, j in enumerate(order)]
    assert not got
    assert ann.nearest(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert ann.nearest(df.where("vec_id < 3"), F.lit(True)).count() == 6  # fewer candidates than k


def test_nearest_windows_recall_on_clusters(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, (np.eye(16)[i % 16] + 0.02 * rng.standard_normal(16)).tolist()) for i in range(800)], "vec_id long, embedding array<double>")
    want = {(r.query_id, r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect()}
    got = {(r.query_id, r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, complete=False).collect()}
    assert len(got & want) >= 0.9 * len(want)


# --- 4: near-duplicates


def groups(rows, least=85):
    sets = {}
    for d, t in rows:
        w = words(t.lower() if t and t.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= least * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_near_duplicates(request, table):
    df = request.getfixturevalue(table)
    want = groups([x for x in pairs(df) if x[0] is not None])
    got = minhash_dedup.near_duplicates(df).collect()
    assert len(got) == df.count()
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def mutated(n, seed):
    rng = random.Random(seed)
    base = [f"w{rng.random()}" for _ in range(150)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(150)] = f"m{rng.random()}"
        out.append((i, " ".join(w)))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("tile", [400_000, 3_000])
def test_large_group_of_near_copies(spark, monkeypatch, tile):
    monkeypatch.setattr(minhash_dedup, "TILE_SHINGLES", tile)
    rows = mutated(150, 5)
    want = groups(rows)
    assert 1 < len({c for _, c in want.values()}) < 150
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_linked_sets_equal_all_pairs():
    rng = np.random.default_rng(9)
    for _ in range(60):
        base = rng.choice(10_000, 60, replace=False)
        sets = []
        for _ in range(rng.integers(2, 25)):
            keep = base[rng.random(60) > rng.choice([0.02, 0.1, 0.3])]
            sets.append(np.unique(np.concatenate((keep, rng.choice(10_000, rng.integers(0, 9))))).astype(np.uint64))
        m = len(sets)
        root = list(range(m))
        for i in range(m):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = root[i], root[j]
                    root = [min(a, b) if x in (a, b) else x for x in root]
        assert minhash_dedup.linked(sets, 85).tolist() == root


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    assert {(r.node, r.component) for r in components(links).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}
    assert components(links.limit(0)).count() == 0


# --- 5: personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


TRICKY = [
    "a@b.c@d.e x@y.zA_q@r.st a.b@c..d e@f.g.h-i.j", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 1.2.3.4", "4111-1111 1111-1111 4111  1111", "12 4111111111111111 34 x4111111111111111",
    "+1 (555) 010-9999+1 555 010 9999) +12 +1 2", "é\U0001f600 a@b.co \U0001f600+44 20 7946 0958", "4111111111111111" * 3, "a" * 3000 + "@" + "b" * 3000, "1-" * 4000 + "1", "@@a@b.c..d@e.f",
]


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_base_spans(request, spark, table):
    df = request.getfixturevalue(table).select("doc_id", "text")
    if table == "odd":
        df = df.union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string"))
    got = pii.personal_data(df).collect()
    assert sorted((r.doc_id or -1, r.base_spans) for r in got) == sorted((d or -1, base_spans(t)) for d, t in pairs(df))
    assert all(r.n_email == r.base_spans.count("email") and set(r.base_spans.split(",")) <= set(r.spans.split(",")) for r in got)


def test_contexts_find_unseen_identifiers(spark):
    rows = [f"please phone me: +1 555 010 {1000 + i} today" for i in range(12)] + ["please phone me: 555-010-7777 today", "the order number 555-010-8888 shipped"]
    got = pii.personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    found = {r.doc_id: [rows[r.doc_id][x.start : x.end] for x in r.found] for r in got}
    assert found.pop(12) == ["555-010-7777"] and not any(found.values())


def test_no_rows_no_spans(empty):
    assert pii.personal_data(empty).count() == 0


# --- 6: packing


def check_packed(rows, texts, length=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append(r)
    for sequence in by_sequence.values():
        at = 0
        for r in sorted(sequence, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length and at & (at - 1) == 0  # full or a power of two: no padding
    encoder = tokens.Encoder()
    for (doc, _), pieces in by_doc.items():
        found = [np.append(encoder.encode(t or ""), 1).astype("<u4") for d, t in texts if d == doc]
        ids = [x for x in found if len(x) == pieces[0].doc_tokens]
        assert sum(r.length for r in pieces) == sum(map(len, ids))
        if len(ids) == 1:
            at = 0
            for r in sorted(pieces, key=lambda r: r.start):
                assert r.start == at and r.ids_crc32 == zlib.crc32(ids[0][at : at + r.length].tobytes())
                at += r.length
    assert sum(r.length for r in rows) == sum(len(encoder.encode(t or "")) + 1 for _, t in texts)


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_packing(request, table):
    df = request.getfixturevalue(table).repartition(3)
    check_packed(packing.pack(df).collect(), pairs(df))


def test_packing_returns_ids_and_takes_empty_tables(docs, empty):
    row = packing.pack(docs.limit(5), with_ids=True).first()
    assert zlib.crc32(row.ids) == row.ids_crc32 and len(row.ids) == 4 * row.length
    assert packing.pack(empty).count() == 0


def test_ids_are_the_vocabularys():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    for text in filter(None, TEXTS):
        assert tokens.encoder().encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_packer_keeps_open_windows_bounded():
    rng, full = np.random.default_rng(0), []
    packer = packing.Packer(64, 4, full.append)
    for i in range(500):
        packer.put(packing.Piece(i, 0, np.arange(rng.integers(1, 150), dtype=np.uint32), 0))
        assert len(packer.open) <= 4
    left = packer.finish()
    assert all(sum(len(x.ids) for x in w) == 64 for w in full) and sum(len(x.ids) for x in left) < 64


# --- 7: language-model scoring


def test_scores_prefer_the_target(spark):
    rng = random.Random(2)
    text = lambda names: " ".join(rng.choice(names) for _ in range(200))
    a, b = [f"a{i}" for i in range(50)], [f"b{i}" for i in range(50)]
    rows = [(i, text(a if i % 2 else b)) for i in range(60)]
    target = spark.createDataFrame([(text(a),) for _ in range(20)], "text string")
    scores = {r.doc_id: r.score for r in lm_score.cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string"), target).collect()}
    assert max(scores[i] for i in range(1, 60, 2)) < min(scores[i] for i in range(0, 60, 2))


def test_scoring_odd_rows(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(lm_score, "BUCKET_BYTES", 1 << 14)
    got = lm_score.cross_entropy_difference(odd, odd.limit(0)).collect()
    assert len(got) == odd.count()
    assert all((r.score is None) == (r.doc_id is None or r.n_words == 0) for r in got)
    assert lm_score.cross_entropy_difference(empty, odd).count() == 0


# --- 8: mixing


def test_mix_reaches_targets(docs):
    sizes = mixing.sized(docs, "doc_id", "text", "source")
    rows = mixing.mix(sizes).collect()
    total = sum(r.size for r in rows)
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(r.passes)
    sources = {r.source: r for r in rows}
    assert sum(x.target for x in sources.values()) == pytest.approx(1.5 * total)
    weights = dict(zip(sorted(sources), [5, 2, 1] * len(sources)))
    loose = {s: r.target / weights[s] for s, r in sources.items() if r.target < 2 * r.source_size}
    assert max(loose.values()) == pytest.approx(min(loose.values()))
    assert all(r.target / weights[s] <= max(loose.values()) + 1e-6 for s, r in sources.items())
    block = 1.5 * total / mixing.n_slots(total)
    assert all(abs(taken[s] - r.target) <= block + 2 for s, r in sources.items())


def test_mix_odd_rows(odd, empty):
    sizes = mixing.sized(odd, "doc_id", "text", "source")
    rows = mixing.mix(sizes).collect()
    assert Counter((r.id, r.size) for r in rows) == Counter((d, len(words(t))) for d, t in pairs(odd))
    assert mixing.mix(mixing.sized(empty, "doc_id", "text", "source")).count() == 0
    assert mixing.mix(mixing.sized(odd.where("doc_id < 3"), "doc_id", "text", "source")).agg(F.sum("taken")).first()[0] == 0
    again = mixing.mix(sizes).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_schedule_is_spread(spark, docs):
    sizes = mixing.sized(docs, "doc_id", "text", "source")
    sources = mixing.targets(sizes)
    slots = {r.slot: r.number for r in mixing.schedule(sources, 1024).collect()}
    assert sorted(slots) == list(range(1024))
    share = {r.number: r.target / r.total for r in sources.collect()}
    for n in (64, 256, 1000):
        seen = Counter(slots[i] for i in range(n))
        assert all(abs(seen[s] - n * p) <= 6 for s, p in share.items())


def test_mixed_texts(docs):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    plan = {r.id: r for r in mixing.mix(mixing.sized(docs, "doc_id", "text", "source")).collect()}
    taken, text = Counter(), dict(pairs(docs))
    for d, t in pairs(out):
        taken[d] += len(words(t))
        assert t == text[d] or words(t) == words(text[d])[: len(words(t))]
    assert all(taken[d] == r.taken for d, r in plan.items())


# --- 9: line dedup


def kept_lines(rows, run=3, long=50):
    first = {}

    def units(t):
        lines = (t or "").split("\n")
        at = [i for i, x in enumerate(lines) if words(x)]
        for a in range(len(at)):
            if a + run <= len(at):
                yield a, run, tuple(lines[i] for i in at[a : a + run])
            if len(words(lines[at[a]])) >= long:
                yield a, 1, lines[at[a]]

    for d, t in rows:
        for a, _, k in units(t):
            first[k] = min(first.get(k, (math.inf, 0)), (d, a))
    out = []
    for d, t in rows:
        gone = {j for a, n, k in units(t) if first[k] != (d, a) for j in range(a, a + n)}
        kept, number, n = [], -1, 0
        for line in (t or "").split("\n"):
            if words(line):
                number, n = number + 1, n + 1
            if number not in gone:
                kept.append(line)
        out.append((d, n, len(gone), None if t is None else "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_line_dedup(request, table):
    df = request.getfixturevalue(table)
    for own in (df, df.select("doc_id", "text")):
        got = line_dedup.line_dedup(own)
        assert got.columns[: len(own.columns)] == own.columns
        rows = [(r.doc_id, r.n_lines, r.n_removed, r.text) for r in got.collect() if r.doc_id is not None]
        assert sorted(rows, key=str) == kept_lines([x for x in pairs(df) if x[0] is not None])
        assert got.count() == df.count()


def test_minima_are_guaranteed():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 9, 400).astype(np.uint64)
    chosen = line_dedup.minima(h, np.array([0, 150, 152, 400]), 3)
    for a in [*range(148), *range(152, 398)]:
        stretch = h[a : a + 3]
        assert chosen[a + max(i for i in range(3) if stretch[i] == stretch.min())]


# --- 10: licences


def test_license_rules(spark, docs, odd, empty):
    lines = {"Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}
    for r in licenses.licenses(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        for name, line in lines.items():
            assert r.licenses.count(name) == r.text.split("\n").count(line)
    assert licenses.licenses(odd).count() == odd.count() and licenses.licenses(empty).count() == 0


def test_license_sentences_over_lines_and_rules_in_order():
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including the rights to use.\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."
    assert licenses.matched(licenses.identifiers(f"x\n{mit}\nend")) == (["MIT"], [])
    assert licenses.matched(["MitNotice", "ApacheUse", "ApacheComply", "GplSee"]) == (["Apache-2.0"], ["MitNotice", "GplSee"])
    assert licenses.identifiers("We are not licensed under the MIT License at all.") == []


# --- words that a polynomial hash modulo 2^64 can't tell apart


def test_words_of_one_polynomial_value(spark):
    bits = [0]
    while len(bits) < 1024:
        bits += [1 - x for x in bits]
    one, other = ("".join("ab"[x ^ y] for x in bits) for y in (0, 1))
    w = kernel.words([one.encode(), other.encode(), one.encode()])
    for seed in (0, 1):
        h = w.hashes(seed)
        assert h[0] != h[1] and h[0] == h[2]
    body = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"{body} {one}"), (2, f"{body} {other}")], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.substring_dedup(docs.withColumn("text", F.expr("replace(text, 'w7 ', '')"))).orderBy("doc_id").collect()] == [0, 0]
    assert [r.n_removed for r in substring_dedup.substring_dedup(docs).orderBy("doc_id").collect()] == [0, 20]
    short = docs.withColumn("text", F.expr("substring_index(text, ' ', -4)"))
    assert [r.component_id for r in minhash_dedup.near_duplicates(short).orderBy("doc_id").collect()] == [1, 2]
    lines = spark.createDataFrame([(i, "\n".join((f"x{i}", body, "same", f"{body} {t}"))) for i, t in enumerate((one, other))], "doc_id long, text string")
    got = line_dedup.line_dedup(lines, short=True)
    assert [r.n_removed for r in got.orderBy("doc_id").collect()] == [0, 0]


def test_spans_in_slices(monkeypatch):
    rng = random.Random(3)
    data = bytes(rng.choices(b"ab", k=5000))
    starts = np.array([rng.randrange(5000) for _ in range(200)] + [0, 0, 5000])
    ends = np.array([min(5000, a + rng.choice((0, 1, 7, 8, 9, 40))) for a in starts[:200]] + [5000, 4999, 5000])
    want = {seed: kernel.spans(data, starts, ends, seed) for seed in (0, 1)}
    by = defaultdict(set)
    for a, b, h in zip(starts, ends, want[0]):
        by[data[a:b]].add(h)
    assert all(len(x) == 1 for x in by.values()) and len(set().union(*by.values())) == len(by)
    monkeypatch.setattr(kernel, "SLICE", 4)
    assert all((kernel.spans(data, starts, ends, seed) == want[seed]).all() for seed in (0, 1)) and (want[0] != want[1]).all()
