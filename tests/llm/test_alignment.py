"""Alignment of two tokenizers against loops over tokens and pairs."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from synthscan.llm import token_align
from synthscan.llm.token_align import tokenizers, units
from tests.llm.test_operators import docs, empty, odd, pairs  # noqa: F401

HARD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "\ta\n b \n", "x ▁ y", "<s> hi </s> <0x41> <|endoftext|>", "\x00 a\x00b", "éé ﬁ ﻿x", "a\r\n\r\n  b　 c d  e",
    "don't they'll I'VE", "12345 6 78,9", "日本語のテキスト、です。", "\U0001f600\U0001f468‍\U0001f469 ok", "x" * 3000, "\x1c a \x1c\x1d b", "=== ---- ____ ....", "trailing   ", "\n\n\n", " \n ", "a \t b", "a\x85 b\x0b c",
]


def plain(rows):
    """Rows as the contract states them, from whole texts and sets."""
    t, done, held = tokenizers(), [], Counter()
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(t.first.vocabulary)
    whole.encode_special_tokens = True
    for d, text in rows:
        a, b = (whole.encode(" " + text, add_special_tokens=False).ids, t.second.encode(text)) if text else ([], [])
        x, y = ([table[i] for i in ids] for table, ids in ((t.first_bytes, a), (t.second_bytes, b)))
        if not text or not b"".join(x) == b"".join(y) == (" " + text).encode():
            done.append((d, None))
            continue
        ends = lambda z: np.cumsum([len(p) for p in z]).tolist()
        ea, eb = ends(x), ends(y)
        links, j = [], 0
        for i, end in enumerate(ea):
            begin = ea[i - 1] if i else 0
            while eb[j] <= begin:
                j += 1
            k = j
            while k < len(eb) and (eb[k - 1] if k else 0) < end:
                links.append((a[i], b[k]))
                k += 1
        cuts, groups = sorted(set(ea) & set(eb)), []
        na = nb = 0
        for cut in cuts:
            ma, mb = ea.index(cut, na) + 1, eb.index(cut, nb) + 1
            groups.append((cut, f"{','.join(map(str, a[na:ma]))}|{','.join(map(str, b[nb:mb]))}"))
            na, nb = ma, mb
        held.update(set(links))
        done.append((d, (len(a), len(b), len(groups), links, hashlib.sha256(";".join(g for _, g in groups).encode()).hexdigest())))
    top = {}
    for (i, _), n in held.items():
        top[i] = max(top.get(i, 0), n)
    return sorted(
        ((d, 0, 0, 0, 0, 0, 0, "") if f is None else (d, f[0], f[1], f[2], len(f[3]), sum(held[p] == top[p[0]] for p in f[3]), sum(held[p] for p in f[3]), f[4]) for d, f in done), key=str
    )


def random_texts(n, seed):
    rng = random.Random(seed)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", ".", ",", "'s", "é", "日", "7", "42", "_", " ", "\r\n", "Ｚ", "-", "\U0001f600", "ing", "\x1f", " "]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_units_are_independent():
    t = tokenizers()
    for text in HARD + random_texts(2000, 5):
        a = [i for u in units(text) for i in t.first.fast.encode_ordinary(" " + u)]
        b = [i for u in units(text) for i in (t.second.encode(u) if u else [t.blank])]
        assert a == t.first.fast.encode_ordinary(" " + text), repr(text)
        assert not text or b == t.second.encode(text), repr(text)


@pytest.mark.parametrize("size", [4 << 20, 300])
def test_alignment_of_hard_texts(spark, monkeypatch, size):
    monkeypatch.setattr(token_align, "CHUNK_BYTES", size)
    monkeypatch.setattr(token_align, "SALT_BYTES", 1000)
    rows = list(enumerate(HARD + random_texts(150, 1) + [None] + HARD[:8])) + [(0, "again the same id"), (None, "no id here")]
    df = spark.createDataFrame([(d, x, 1, 2, "z") for d, x in rows], "doc_id long, text string, n_a int, bucket int, `a.b` string").repartition(3)
    got = token_align.align(df)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_op13(spark, odd, empty, tmp_path):  # noqa: F811
    assert token_align.align(empty).count() == 0
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["op13_token_alignment"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == plain(pairs(odd))


def test_op13_on_documents(spark, docs, sf):  # noqa: F811
    got = entry.queries()["op13_token_alignment"](spark, sf)
    assert sorted(map(tuple, got.collect()), key=str) == plain(pairs(docs))


def test_long_white_space(spark):
    rows = [(1, "a" + " " * 120_000 + "b"), (2, "\n" * 120_000)]
    got = token_align.align(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_tables_of_wide_rows_end_row_groups_by_size(spark):
    """Few rows of megabytes each must not be held by a task until there are a hundred of them."""
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from synthscan.llm.common import stored

    rows = spark.range(0, 12, 1, 1).select("id", F.transform(F.sequence(F.lit(1), F.lit(400_000)), lambda i: F.xxhash64("id", i)).alias("x"))
    table = stored(rows, "wide", wide=True)
    groups = [pq.ParquetFile(f.removeprefix("file://").removeprefix("file:")).metadata for f in table.inputFiles()]
    assert sum(g.num_rows for g in groups) == 12 and max(g.row_group(i).num_rows for g in groups for i in range(g.num_row_groups)) <= 7


def test_units_are_joined_and_told_apart_a_few_at_a_time(monkeypatch):
    """What a worker holds besides its chunk is bounded by JOINED and LINKS; results are the same."""
    texts = [" ".join(f"w{i * j % 977}x" for j in range(1, 400)) for i in range(1, 60)] + ["", None, "a" * 5000, " ", "\n  x"]
    t, calls, held = tokenizers(), [], []
    monkeypatch.setattr(token_align, "JOINED", 1 << 30)
    monkeypatch.setattr(token_align, "LINKS", 1 << 30)
    want = token_align._chunk(t, 1, list(range(len(texts))), texts)
    encode, distinct = token_align.Tokenizers.encode, token_align.kernel.distinct
    monkeypatch.setattr(token_align, "JOINED", 1000)
    monkeypatch.setattr(token_align, "LINKS", 2000)
    monkeypatch.setattr(token_align.Tokenizers, "encode", lambda self, text: calls.append(len(text)) or encode(self, text))
    monkeypatch.setattr(token_align.kernel, "distinct", lambda x: held.append(len(x)) or distinct(x))
    assert token_align._chunk(t, 1, list(range(len(texts))), texts).equals(want)
    assert sorted(calls)[-2] < 1000 and max(calls) == 5000 and len(held) > 3 and max(held) < 4000
