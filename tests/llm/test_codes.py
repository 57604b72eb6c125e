"""Product codes of vectors against a plain version, and against SQL."""

import hashlib
import math
import random

import duckdb
import pytest

import __spark_entry__ as entry
from synthscan.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error int, n int, `a.b` int"


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """(id, code, error, label_error, digest) by loops over Python integers."""
    kept = sorted(((i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0], r[1]))
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for _, v, _ in kept]
    books = [[x[p] for x in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, book: min((far(x, c), i) for i, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for x in cut:
                own.setdefault(nearest(x[p], books[p])[1], []).append(x[p])
            books[p] = [[sum(c) // len(own[i]) for c in zip(*own[i])] if i in own else old for i, old in enumerate(books[p])]
    found = [[nearest(x[p], books[p]) for p in range(parts)] for x in cut]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    total = {}
    for (_, _, label), e in zip(kept, errors):
        total[label] = total.get(label, 0) + e
    return sorted((i, "".join(f"{c:02x}" for _, c in f), e, total[label], digest) for (i, _, label), f, e in zip(kept, found, errors))


def coded(df, **options):
    got = vector_codes.compress(df, **options)
    return sorted(map(tuple, got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=lambda r: (r[0] is None, r))


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 2, 3) for i, v, label in rows], SCHEMA)


def rows_of(n, dims, seed, spread=1.0):
    rng = random.Random(seed)
    return [(3 * i, [rng.choice((rng.gauss(0, spread), 0.0, -0.5)) for _ in range(dims)], rng.choice((1, 1, 1, 2, None))) for i in range(n)]


@pytest.mark.parametrize("n,dims,block", [(700, 8, 50), (100, 4, 2048), (1, 8, 2048)])
def test_codes_equal_loops(spark, monkeypatch, n, dims, block):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    rows = rows_of(n, dims, n)
    rows += [(10**6 + i, [rows[0][1][0]] * dims if i % 2 else rows[0][1], 3) for i in range(n // 2)]  # equal vectors and ties
    rows += [(-9, None, 1), (-8, [], 1), (-7, [None] * dims, 1), (-6, [math.nan] * dims, 1), (-5, [-math.inf] + [1.0] * (dims - 1), None)]
    assert coded(table(spark, rows).repartition(5)) == plain(rows)


def test_few_entries_and_unused_ones(spark):
    rows = [(i, [float(i // 40)] * 4 + [0.0] * 4, 1) for i in range(120)]
    assert coded(table(spark, rows), entries=5, rounds=2) == plain(rows, entries=5, rounds=2)


@pytest.mark.parametrize("spread", [1e6, 1e14])
def test_large_components(spark, spread):
    rows = [(i, [x * spread for x in v], 1) for i, v, _ in rows_of(40, 4, 7)]
    want = plain(rows, entries=6)
    most = vector_codes.LONG
    assert coded(table(spark, rows), entries=6) == [(i, c, min(e, most), min(t, most) if spread < 1e10 else most, d) for i, c, e, t, d in want]


def test_odd_tables(spark):
    assert coded(table(spark, []).limit(0)) == []
    assert coded(table(spark, [(1, None, 1), (2, [math.nan] * 4, 1)])) == []
    assert coded(table(spark, [(1, [1.0, 2.0, 3.0], 1)])) == []  # no multiple of the parts
    got = coded(table(spark, [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1), (None, [2.0] * 4, 1), (3, [5.0] * 4, 2)]).coalesce(1))
    assert [r[:1] for r in sorted(got, key=str)] == [(1,), (3,), (None,)]


def test_op11_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.sql(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({entry.oracle_sql()['op11_vector_codes']})").fetchall()
    got = [tuple(r) for r in entry.queries()["op11_vector_codes"](spark, sf).collect()]
    assert sorted(got) == sorted(want) and len(got) > 100
