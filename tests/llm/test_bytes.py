"""Byte dedup and its index against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest

import __spark_entry__ as entry
from synthscan.llm import byte_dedup
from synthscan.llm.run_index import MARK, RunIndex, classes
from tests.llm.test_operators import docs, empty, odd, pairs  # noqa: F401


def joined(segments):
    text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    sizes = np.array([len(s) for s in segments])
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    return text, begins, begins + sizes


def random_segments(seed):
    rng = random.Random(seed)
    alphabet = rng.choice((b"a", b"ab", b"\0a", bytes(range(256))))
    own = [bytes(rng.choices(alphabet, k=rng.randrange(1, 40))) for _ in range(rng.randrange(1, 30))]
    own += [rng.choice(own)[rng.randrange(3) :] or b"x" for _ in range(rng.randrange(10))]
    return own + [b"".join(rng.choices(own, k=3)) for _ in range(5)]


@pytest.mark.parametrize("seed", range(30))
def test_index_by_sorting_suffixes(seed):
    segments = random_segments(seed)
    text, begins, ends = joined(segments)
    index = RunIndex.built(text, begins, ends)
    suffixes = sorted((segments[i][j:], i, j) for i in range(len(segments)) for j in range(len(segments[i]) + 1))
    preceding = [MARK if j == 0 else segments[i][j - 1] for _, i, j in suffixes]
    assert np.repeat(index.heads, index.lengths).tolist() == preceding
    assert len(index.at) == len(index.heads) == sum(k == 0 or x == MARK or x != preceding[k - 1] for k, x in enumerate(preceding))
    before, shared = index.matches()
    place = [int(begins[i]) + j for _, i, j in suffixes]
    for k in range(len(place)):
        own = 0
        while k and own < min(len(suffixes[k][0]), len(suffixes[k - 1][0])) and suffixes[k][0][own] == suffixes[k - 1][0][own]:
            own += 1
        assert shared[place[k]] == own and (not k or before[place[k]] == place[k - 1])
    for window in (1, 3, 9):
        first, several = {}, {}
        for i, s in enumerate(segments):
            for j in range(len(s) - window + 1):
                first.setdefault(s[j : j + window], begins[i] + j)
                several.setdefault(s[j : j + window], []).append(begins[i] + j)
        want = sorted((p, first[k]) for k, ps in several.items() if len(ps) > 1 for p in ps)
        assert list(zip(*(x.tolist() for x in classes(index, window)))) == want


def test_index_is_small_for_copies():
    rng = random.Random(4)
    one = bytes(rng.choices(b"abcdefgh", k=2000))
    text, begins, ends = joined([one] * 50)
    assert len(RunIndex.built(text, begins, ends).at) < 2 * len(one) + 50


def without(rows, n=100):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            k = b[i : i + n]
            first[k] = min(first.get(k, (math.inf, 0)), (d, i))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if first[b[i : i + n]] != (d, i):
                gone[i : i + n] = b"\1" * n
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(b)))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def hashed(df):
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in df.collect()]
    return sorted(got, key=str)


def planted(seed, n=60):
    """Texts with shared passages, near copies, overlapping repeats and runs of one character."""
    rng = random.Random(seed)
    prose = lambda k: "".join(rng.choices("abcde é\n", k=k))
    shared = [prose(rng.choice((95, 100, 101, 150, 400))) for _ in range(6)]
    rows = []
    for i in range(n):
        t = "".join(rng.choice((prose(rng.randrange(80)), rng.choice(shared), "x" * rng.choice((30, 99, 100, 150, 260)), "ab" * rng.randrange(120))) for _ in range(rng.randrange(6)))
        rows.append((i, t))
        if rng.random() < 0.3:
            j = rng.randrange(max(1, len(t)))
            rows.append((1000 + i, t[:j] + "Q" + t[j + 1 :]))
    return rows


@pytest.mark.parametrize("seed,hot,chunk,group", [(0, 1000, 1 << 20, 1 << 19), (1, 3, 2000, 1500), (2, 2, 1 << 20, 100), (3, 5, 500, 48 << 10)])
def test_byte_dedup(spark, monkeypatch, seed, hot, chunk, group):
    for name, value in (("HOT_LEAST", hot), ("CHUNK_BYTES", chunk), ("SEND_BYTES", 4 * chunk), ("GROUP_BYTES", group)):
        monkeypatch.setattr(byte_dedup, name, value)
    rows = planted(seed)
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, keys int, `a.b` string").repartition(4)
    assert hashed(byte_dedup.byte_dedup(df)) == sorted(without(rows), key=str)


def test_many_buckets(spark, monkeypatch):
    monkeypatch.setattr("synthscan.llm.substring_dedup.BUCKET_BYTES", 1 << 11)
    monkeypatch.setattr(byte_dedup, "HOT_LEAST", 4)
    rows = planted(9)
    assert hashed(byte_dedup.byte_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted(without(rows), key=str)


def test_op12(spark, odd, empty, tmp_path):  # noqa: F811
    assert byte_dedup.byte_dedup(empty).count() == 0
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["op12_byte_dedup"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == without([x for x in pairs(odd) if x[0] is not None])
    assert [r.n_removed for r in got if r.doc_id is None] == [0, 0]


def test_op12_on_documents(spark, docs, sf):  # noqa: F811
    got = entry.queries()["op12_byte_dedup"](spark, sf)
    assert sorted(map(tuple, got.collect())) == without(pairs(docs))
    assert got.where("n_removed > 0").count() > 10
