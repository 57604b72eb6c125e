"""What operators and stages find beyond the limits they once had."""

import hashlib
import math
import random
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as P
from synthscan.llm import ann, licenses, line_dedup, lm_score, minhash_dedup, mixing, pii, quality_rules, substring_dedup, tokens
from tests.llm.test_operators import base_spans, check_packed, empty, groups, odd, pairs, repeats, stats, words  # noqa: F401


# --- pipeline: near-duplicates from 0.8 on


def test_near_duplicates_stage_links_from_80(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    copies = []
    for i, size in enumerate((44, 45, 50, 54, 55, 60)):  # one word of the middle changed: (size - 5) / (size + 5) of the shingles
        words = [f"w{i}x{j}" for j in range(size + 4)]
        copies += [(10**6 + 2 * i, " ".join(words)), (10**6 + 2 * i + 1, " ".join([*words[: size // 2], "other", *words[size // 2 + 1 :]]))]
    df = docs.union(spark.createDataFrame(copies, "doc_id long, text string"))
    kept = sorted(x for x, _ in pairs(P.near_duplicates(spark, df, sf)))
    assert kept == sorted(x for x, (_, c) in groups(pairs(df), 80).items() if x == c)
    assert [x - 10**6 for x in kept if x >= 10**6] == [0, 1, 2, 4, 6, 8, 10]


def test_stages_after_near_duplicates(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for i, (name, stage) in enumerate(P.STAGES[:4]):
        before = pairs(docs)
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if name == "line dedup":
            assert sorted(pairs(docs)) == [(d, t) for d, _, t in without_repeats(before)]
        if name == "near-duplicates":
            assert sorted(x for x, _ in pairs(docs)) == sorted(x for x, (_, c) in groups(before, 80).items() if x == c)
    words = lambda rows: sum(len((t or "").split()) for _, t in rows)
    assert abs(words(pairs(docs)) - 1.5 * words(before)) < 100
    packed = P.pack(spark, docs, sf).collect()
    assert sum(r.length for r in packed) == sum(len(tokens.encoder().encode(t or "")) + 1 for _, t in pairs(docs))


# --- 7: language-model scoring by words, not by classes of words


def losses(rows, wanted, prior=10):
    """(words, target loss, background loss) of each document, from dictionaries of words."""
    bigrams = lambda t: list(zip([None, *words((t or "").encode().lower().decode())], words((t or "").encode().lower().decode())))
    models = []
    for texts in (wanted, [t for _, t in rows]):
        pair, first, word = Counter(), Counter(), Counter()
        for t in texts:
            for v, w in bigrams(t):
                pair[v, w] += 1
                first[v] += 1
                word[w] += 1
        models.append((pair, first, word))
    size = len({w for m in models for w in m[2]})
    loss = lambda t, m: -sum(math.log((m[0][v, w] + prior * (m[2][w] + 1) / (sum(m[2].values()) + size)) / (m[1][v] + prior)) for v, w in bigrams(t))
    return {d: (len(words(t)), loss(t, models[0]), loss(t, models[1])) for d, t in rows}


def test_op7_scores_by_words(spark, sf, tmp_path, monkeypatch):
    rows, target = pairs(spark.read.parquet(f"{sf}/documents.parquet")), [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(d, t) for d, t in rows if len(words(t)) < 400]
    want = losses(rows, target)
    df, wanted = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    wanted.write.parquet(f"{tmp_path}/benchmark.parquet")
    for size in (lm_score.BUCKET_BYTES, 1 << 15):
        monkeypatch.setattr(lm_score, "BUCKET_BYTES", size)
        got = entry.queries()["op7_lm_score"](spark, str(tmp_path)).collect()
        assert len(got) == len(want)
        for r in got:
            assert (r.n_words, pytest.approx(r.target_loss or 0, rel=1e-9), pytest.approx(r.background_loss or 0, rel=1e-9)) == want[r.doc_id]


def test_scoring_by_words_of_heavy_and_odd_rows(spark, odd, empty, monkeypatch):  # noqa: F811
    monkeypatch.setattr(lm_score, "BUCKET_BYTES", 1 << 14)
    rows = [(i, "a b " * (40 + i) + f"c{i} a") for i in range(30)]
    target = ["a b a", "", "b b"]
    want = losses(rows, target)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    for r in lm_score.cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string"), wanted).collect():
        assert (r.n_words, pytest.approx(r.target_loss, rel=1e-9), pytest.approx(r.background_loss, rel=1e-9)) == want[r.doc_id]
    got = lm_score.cross_entropy_difference(odd, odd.limit(0)).collect()
    assert len(got) == odd.count()
    assert all((r.score is None) == (r.doc_id is None or r.n_words == 0) for r in got)
    assert lm_score.cross_entropy_difference(empty, odd).count() == 0


# --- 9: line dedup of every run that has 50 words, however few lines


def without_repeats(rows, run=3, long=50):
    """(id, removed, text): a line goes if it is in a run of `run` lines, or of fewer with `long` words, that starts earlier too."""
    first, runs = {}, []
    for d, t in rows:
        lines = [x for x in t.split("\n") if words(x)]
        for a in range(len(lines)):
            for n in range(1, run + 1):
                k = tuple(lines[a : a + n])
                if len(k) == n and (n == run or sum(len(words(x)) for x in k) >= long):
                    first[k] = min(first.get(k, (d, a)), (d, a))
                    runs.append((d, a, k))
    gone = {(d, j) for d, a, k in runs if first[k] != (d, a) for j in range(a, a + len(k))}
    out = []
    for d, t in rows:
        kept, number, n = [], -1, 0
        for x in t.split("\n"):
            number += bool(words(x))
            n += bool(words(x)) and (d, number) in gone
            if (d, number) not in gone:
                kept.append(x)
        out.append((d, n, "\n".join(kept)))
    return sorted(out)


def test_line_dedup_of_short_runs(spark):
    line = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    cases = [(43, 49), (49, 49), (25, 25), (25, 24), (1, 49), (60, 5), (5, 60), (49,), (50,)]
    rows = []
    for i, sizes in enumerate(cases):
        shared = "\n\n".join(line(f"c{i}l{j}x", n) for j, n in enumerate(sizes))
        rows += [(10 * i + j, f"{line(f'before{i}.{j}.', 4)}\n{shared}\n{line(f'after{i}.{j}.', 4)}") for j in range(3)]
    rows.append((1000, f"{line('u', 30)}\n{line('v', 30)}\nbetween\n{line('u', 30)}\n{line('v', 30)}"))
    got = sorted((r.doc_id, r.n_removed, r.text) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), short=True).collect())
    assert got == without_repeats(rows)
    assert [n for d, n, _ in got if d % 10 == 1] == [2, 2, 2, 0, 2, 2, 2, 0, 1] and got[-1][1] == 2


@pytest.mark.parametrize("seed", range(2))
def test_line_dedup_of_random_lines(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(f"p{i}w{j}" for j in range(rng.choice((3, 20, 28, 40, 55)))) for i in range(40)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.7 else rng.choice(("", f"own {i}")) for _ in range(rng.randrange(1, 9)))) for i in range(150)]
    got = sorted((r.doc_id, r.n_removed, r.text) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), short=True).collect())
    assert got == without_repeats(rows)


def test_op9_takes_short_runs(spark, tmp_path):
    pair = "\n".join(" ".join(f"l{i}w{j}" for j in range(n)) for i, n in enumerate((43, 49)))
    spark.createDataFrame([(1, f"{pair}\none"), (2, f"two\n{pair}")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: (r.n_lines, r.n_removed) for r in entry.queries()["op9_line_dedup"](spark, str(tmp_path)).collect()} == {1: (3, 0), 2: (3, 2)}


# --- 5: patterns told by what was found


def test_bootstrapping_goes_on_from_what_it_finds(spark):
    phone = lambda n: f"555-010-{7000 + n}"
    rows = [f"please phone me: +1 555 010 {1000 + i} today" for i in range(200)] + [f"please phone me: {phone(i)} today" for i in range(10)]
    rows += [f"do ring us: {phone(i)} now" for i in range(11)]  # 10 of 11 known after a round, and no seed
    for step in range(4):  # each tells one more, from 10 known of 11 when the last step's is known
        rows += [f"or step {"abcd"[step]}: {phone(i)} now" for i in [*range(9), 10 + step, 11 + step]]
    rows += [f"my order id: {phone(100 + i)} shipped" for i in range(9)] + [f"see page: {phone(200)}", f"but page: {phone(14)}"]
    got = pii.personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    found = {r.doc_id: [rows[r.doc_id][x.start : x.end] for x in r.found] for r in got}
    known = {phone(i) for i in range(15)}
    for i, text in enumerate(rows):
        assert found[i] == [x for x in known if x in text]


# --- queries through the registry, against brute force


def query(spark, tmp_path, name, **tables):
    for table, df in tables.items():
        df.write.parquet(f"{tmp_path}/{table}.parquet")
    return entry.queries()[name](spark, str(tmp_path)).collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture()
def small(spark, sf, odd):  # noqa: F811
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    return docs.union(odd.where("doc_id IS NOT NULL").select((F.col("doc_id") + 10**7).alias("doc_id"), "text", "source")).dropDuplicates(["doc_id"])


def test_op1_and_op4_and_op9(spark, small, tmp_path):
    small.write.parquet(f"{tmp_path}/documents.parquet")
    rows = pairs(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    got = entry.queries()["op1_substring_dedup"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == [(d, n, gone, sha(t)) for d, n, gone, t in repeats(rows)]
    got = entry.queries()["op9_line_dedup"](spark, str(tmp_path)).collect()
    texts = without_repeats([(d, t or "") for d, t in rows])
    assert sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in got) == [(d, n, sha(t)) for d, n, t in texts]
    got = entry.queries()["op4_minhash_dedup"](spark, str(tmp_path)).collect()
    want = groups(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {d: (n, c, d == c) for d, (n, c) in want.items()}


def test_op5(spark, small, tmp_path):
    got = query(spark, tmp_path, "op5_pii", documents=small)
    texts = dict(pairs(small))
    assert len(got) == len(texts)
    for r in got:
        spans = base_spans(texts[r.doc_id])
        assert r.base_sha256 == sha(spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [spans.count(f"{k}:") for k in ("email", "ip", "card", "phone")]
        assert set(filter(None, spans.split(","))) <= set(r.spans.split(","))


def test_op6_and_op8(spark, small, tmp_path):
    got = query(spark, tmp_path, "op6_packing", documents=small)
    check_packed(got, pairs(small))
    got = entry.queries()["op8_source_mixing"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.size) for r in got) == sorted((d, len(words(t))) for d, t in pairs(small))
    assert all(0 <= r.taken <= 2 * r.size for r in got)


def test_op8_equals_sql(spark, small, tmp_path):
    for i, df in enumerate((small, small.where("source IS NULL OR source = 'a'"), small.limit(1), small.limit(0))):
        df.write.parquet(f"{tmp_path}/{i}/documents.parquet")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{i}/documents.parquet/*.parquet'")
        want = con.sql(entry.oracle_sql()["op8_source_mixing"])
        got = entry.queries()["op8_source_mixing"](spark, f"{tmp_path}/{i}")
        at = [got.columns.index(x) for x in want.columns]
        assert sorted(tuple(r[j] for j in at) for r in got.collect()) == sorted(want.fetchall())


def test_op8_of_few_words(spark, tmp_path):
    """Totals that don't divide: nothing is taken more than twice."""
    for n in range(1, 9):
        rows = [(i, "w " * (1 + i * n % 5), "abcd"[i % n % 4]) for i in range(n + 3)]
        spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/{n}/documents.parquet")
        got = entry.queries()["op8_source_mixing"](spark, f"{tmp_path}/{n}").collect()
        assert len(got) == n + 3 and all(r.taken <= 2 * r.size for r in got)


def test_op3_reaches_recall_by_curves_alone(spark, sf, tmp_path):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = vectors.select("vec_id", "embedding").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = set()
    for q in ids[ids % 50 == 0]:
        s = ann.cosine(v[ids == q][0], v)
        s[ids == q] = -9
        want |= {(int(q), int(ids[j])) for j in np.lexsort((ids, -s))[:5]}
    block = 64  # windows far narrower than the table
    got = {(r.query_id, r.vec_id) for r in ann.nearest(vectors, F.col("vec_id") % 50 == 0, block=block, complete=False).collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert {(r.query_id, r.vec_id) for r in query(spark, tmp_path, "op3_nearest", embeddings=vectors)} == want


def test_op3_takes_extreme_and_equal_vectors(spark, tmp_path):
    one = [1e200, 2e200, 3e200]
    rows = [(50, one), (100, [x * 1e-300 for x in one]), (1, [5e-320, 0.0, 0.0]), *((1000 + i, [1.0, 2.0, 3.0]) for i in range(300)), (3, [3.0, -1.0, 0.5])]
    got = query(spark, tmp_path, "op3_nearest", embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    near = {50, 100, *range(1000, 1006)}  # all in one direction, to rounding
    for q in (50, 100, 1250):
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [x[0] for x in own] == [1, 2, 3, 4, 5] and {x[1] for x in own} <= near - {q}
        assert all(x[2] == pytest.approx(1) for x in own)
        assert own == [(i + 1, v, s) for i, (s, v) in enumerate(sorted(((s, v) for _, v, s in own), key=lambda x: (-x[0], x[1])))]


# --- 1, 9: what a chunk sends


def test_one_repeated_hash_sends_its_bucket_one_entry():
    n = 100_000
    sent = list(substring_dedup._payloads([(np.full(n, 7, np.uint64), np.zeros(n, np.uint64), np.arange(n), np.zeros(n, np.int32))], 2))
    rows = [r for b in sent for r in b.to_pylist()]
    hashed = [r for r in rows if r["hashes"] is not None]
    assert len(hashed) == 1 and len(hashed[0]["hashes"]) == 8
    assert all(r["bucket"] >= 4 for r in rows if r["hashes"] is None)


# --- 4: many near copies in many tiles, some of them far from any centre


@pytest.mark.parametrize("seed", range(2))
def test_groups_of_several_tiles(spark, monkeypatch, seed):
    monkeypatch.setattr(minhash_dedup, "TILE_SHINGLES", 1500)
    rng = random.Random(seed)
    rows, chain = [], [f"c{j}" for j in range(120)]
    for i in range(60):  # each a word on from the one before: a chain whose ends have little in common
        chain = [*chain[2:], f"x{seed}.{i}.0", f"x{seed}.{i}.1"]
        rows.append((1000 + i, " ".join(chain)))
    for family in range(3):
        base = [f"f{family}w{j}" for j in range(120)]
        for i in range(40):
            w = list(base)
            for _ in range(rng.randrange(9)):
                w[rng.randrange(120)] = f"m{rng.random()}"
            rows.append((100 * family + i, " ".join(w)))
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == groups(rows)


# --- 5: long texts of many identifiers


def test_pii_takes_many_identifiers_in_one_text(spark):
    text = " ".join(f"please call {f'555-010-{i:05d}' if i % 20 == 0 else f'+1 555 010 {i:05d}'} at 10.0.{i % 250}.{i % 199}" for i in range(20_000))
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pii.personal_data(spark.createDataFrame([(1, "a 1")], "doc_id long, text string")).collect()
    began = time.perf_counter()
    r = pii.personal_data(one).collect()[0]
    assert time.perf_counter() - began < 60
    assert r.base_spans == base_spans(text) and r.n_found == 1000


def test_contexts_are_whole_and_of_both_sides(spark):
    long = "x" * 300
    rows = [f"{long} {long} +1 555 010 {1000 + i} and so" for i in range(12)] + [f"{long} {long} 555-010-7777 but not"]
    rows += [f"a{i} b{i} +1 555 020 {1000 + i} rang twice" for i in range(12)] + ["c d 555-020-7777 rang twice", "e f 555-030-7777 rang once"]
    rows += [f"a{i} at 10.0.0.1 +1 555 040 {1000 + i} then b{i}" for i in range(12)] + ["x at 10.0.0.1 555-040-7777 but"]  # over other matches
    got = {r.doc_id: [rows[r.doc_id][x.start : x.end] for x in r.found] for r in pii.personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got[12] == ["555-010-7777"] and got[25] == ["555-020-7777"] and got[26] == [] and got[39] == ["555-040-7777"]


def test_secrets_are_seeds(spark):
    rng = random.Random(0)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [f'the token = "{key(40)}" end{i} x{i}' for i in range(12)] + ['the token = "Zx81-kk_PQ47aaBBcc" end', 'the name = "Zx81-kk_PQ47aaBBcd" end']
    got = {r.doc_id: (r.base_spans, [rows[r.doc_id][x.start : x.end] for x in r.found]) for r in pii.personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert all(got[i][1] == [rows[i].split('"')[1]] for i in range(13)) and got[13] == ("", [])


# --- 6: what one of the libraries cannot take


def _slow_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY)).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 2_000_000, "a" + "\n\t " * 300_000 + "b", "x" * 1_000_000, "-=" * 500_000])
def test_encoder_takes_long_runs(text):
    ids = tokens.encoder().encode(text)
    cut = text[:50_000]
    assert tokens.encoder().encode(cut).tolist() == _slow_ids(cut)
    assert len(ids) >= len(tokens.encoder().encode(cut))


# --- 8: the schedule's order


def test_drawn_words_are_what_mix_takes(spark, small):
    sizes = mixing.sized(small, "doc_id", "text", "source")
    drawn = mixing.drawn(sizes).collect()
    taken = Counter()
    for r in drawn:
        taken[r.id] += r.words
    plan = mixing.mix(sizes).collect()
    assert all(taken[r.id] == r.taken for r in plan)
    first = {}
    for r in drawn:
        first[r.id] = min(first.get(r.id, r.slot), r.slot)
    assert all(min(x for x in r.slots if x is not None) == first[r.id] for r in plan if r.taken)
    slots = Counter(r.slot for r in drawn)
    total = sum(r.size for r in plan)
    assert set(slots) <= set(range(mixing.n_slots(total)))


def test_mixed_rows_come_in_the_schedules_order(spark, small):
    sizes = mixing.sized(small, "doc_id", "text", "source")
    order = sorted((slot, r.id, n) for r in mixing.mix(sizes).collect() for slot, n in zip(r.slots, r.passes) if slot is not None and n)
    got = [(r.doc_id, len(words(r.text))) for r in mixing.mixed(small).collect()]
    assert Counter(got) == Counter((d, n) for _, d, n in order)
    place = {}
    for slot, d, _ in order:
        place.setdefault(d, []).append(slot)
    slots = [place[d].pop(0) for d, _ in got]
    assert slots == sorted(slots)


def test_running_sums_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", 4)
    rng = random.Random(3)
    rows = [(i % 2, i, rng.randrange(100)) for i in range(700)]
    df = spark.createDataFrame(rows, "g int, i long, n long")
    total, want = Counter(), {}
    for g, i, n in rows:
        want[i] = total[g]
        total[g] += n
    assert {r.i: r.before for r in mixing.running(df, "g", F.expr("i div 3"), 234, ["i"], F.col("n")).collect()} == want


# --- 10: statements wrapped, marked and mixed at random


STATEMENTS = {
    "ApacheBasis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "ApacheUse": "Licensed under the Apache License, Version 2.0",
    "MitNotice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "GplHope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "Mpl2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CcByNc": "This work is licensed under CC BY-NC 4.0.",
    "Agpl3Use": "This file is licensed under the terms of the GNU Affero General Public License, version 3.",
    "BsdNames": "Neither the name of The Very Long Company of Somewhere nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def test_statements_however_wrapped(spark, tmp_path):
    rng = random.Random(8)
    rows, want = [], {}
    for i in range(300):
        lines, found = [], []
        for _ in range(rng.randrange(6)):
            if rng.random() < 0.3:
                lines.append("Some words of no licence at all.")
                continue
            name = rng.choice(list(STATEMENTS))
            w = STATEMENTS[name].split()
            if rng.random() < 0.2:  # another word in it
                w.insert(rng.randrange(5, len(w)), "zebra")
                found += [name] if name == "BsdNames" and "zebra" in w[5 : w.index("nor")] else []
            else:
                found.append(name)
            mark, width = rng.choice(("", "# ", "// ", " * ", "\t")), rng.choice((1, 3, 7, 100))
            w = [rng.choice((str, str.upper, str.lower))(x) for x in w]
            lines += [mark + " ".join(w[j : j + width]) for j in range(0, len(w), width)]
            lines.append("then other words")
        rows.append((i, "\n".join(lines)))
        want[i] = found
    got = query(spark, tmp_path, "op10_license_rules", documents=spark.createDataFrame(rows, "doc_id long, text string"))
    for r in got:
        assert r.sentences == ",".join(want[r.doc_id]), rows[r.doc_id]
        licences, left = plainly_matched(want[r.doc_id])
        assert (r.licenses, r.unmatched, r.n_sentences) == (",".join(licences), ",".join(left), len(want[r.doc_id]))


def plainly_matched(found):
    """By the rules, one after another: the first place each time, until none is left."""
    left, out = list(enumerate(found)), []
    for name, rule in licenses.RULES:
        i = 0
        while i + len(rule) <= len(found):
            if [x for k, x in left if i <= k < i + len(rule)] == rule:
                out.append((i, name))
                left = [(k, x) for k, x in left if not i <= k < i + len(rule)]
            i += 1
    return [name for _, name in sorted(out)], [x for _, x in left]


def test_statements_of_whole_licences():
    text = 'ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\nWITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF\nMERCHANTABILITY AND FITNESS.\n'
    assert licenses.matched(licenses.identifiers(text)) == (["ISC"], [])
    assert licenses.matched(licenses.identifiers("// SPDX-License-Identifier: (GPL-2.0-only OR MIT)\nint x;")) == (["(GPL-2.0-only OR MIT)"], [])
    assert licenses.identifiers("copyright x\n" * 50_000) == []


# --- 2: the verdict


def test_op2_by_an_independent_reading_of_its_rules(spark, tmp_path):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = query(spark, tmp_path, "op2_quality_rules", documents=docs, labels=labels)
    rules = quality_rules.fitted(docs, labels)
    texts = dict(pairs(docs))
    for r in got:
        n, chars, symbols, dup, repeat = stats(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n)
        t = texts[r.doc_id] or ""
        lines = [x for x in t.split("\n") if words(x)]
        value = {
            "words": n, "chars_a_word": chars / n if n else 0, "symbols_a_word": symbols / n if n else 0, "dup_lines_a_line": dup / len(lines) if lines else 0,
            "repeat_words_a_word": repeat / n if n else 0, "upper_a_char": sum("A" <= c <= "Z" for c in t) / chars if chars else 0, "marks_a_word": sum(c in "!?" for c in t) / n if n else 0,
        }
        first = next((i for i, rule in enumerate(rules.rules, 1) if all(value[x] <= y if sign == "<=" else value[x] > y for x, sign, y in rule)), 0)
        assert (r.rule, r.kept) == (first, not r.base_failed and first == 0)


def test_rules_of_several_conditions_in_order(spark):
    rng = np.random.default_rng(1)
    words_, share = rng.integers(20, 400, 4000), rng.random(4000) / 2
    bad = (share > 0.3) & (words_ < 150) | (words_ > 380)
    labels = spark.createDataFrame([(i, int(not b)) for i, b in enumerate(bad.tolist()[:3000])], "doc_id long, quality int")
    rows = [(i, int(n), int(4 * n), int(round(s * n)), 0, 0, 1, 0, 0) for i, (n, s) in enumerate(zip(words_, share))]
    stats_ = spark.createDataFrame(rows, "id long, " + ", ".join(f"{x} long" for x in quality_rules.STATISTICS))
    rules = quality_rules.fit(stats_, quality_rules.chosen(labels, "doc_id", "quality", 20_000))
    assert len(rules.rules) >= 2 and max(map(len, rules.rules)) >= 2
    out = quality_rules.judged(stats_, rules).select("id", "kept").collect()
    wrong = sum(r.kept == bool(bad[r.id]) for r in out)
    assert wrong < 0.03 * len(out)
