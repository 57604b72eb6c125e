"""The pipeline, stage by stage, against plain versions of what each stage promises."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from synthscan.llm import quality_rules
from tests.llm.test_operators import check_packed, empty, groups, odd, pairs  # noqa: F401
from tests.llm.test_whole import without_repeats


def test_stages(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, d)
        out.write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        before, after = pairs(docs), pairs(out) if "text" in out.columns else None
        if name != "packing":
            assert out.columns == columns
        if name == "quality rules":
            rules = quality_rules.fitted(docs, spark.read.parquet(f"{d}/labels.parquet"))
            assert {x for x, _ in after} == {r.doc_id for r in quality_rules.judged(quality_rules.with_statistics(docs), rules).where("kept").collect()}
            failed = {r.doc_id for r in quality_rules.with_statistics(docs).where(quality_rules.base_failed()).collect()}
            bad = {r.doc_id for r in spark.read.parquet(f"{d}/labels.parquet").where("quality = 1").collect()}
            gone = {x for x, _ in before} - {x for x, _ in after}
            assert failed <= gone and not (gone - failed) & bad
        elif name == "line dedup":
            assert sorted(after) == [(d, t) for d, _, t in without_repeats(before)]
            assert all(r.n_chars == len(r.text) for r in out.collect())
        elif name == "near-duplicates":
            assert sorted(x for x, _ in after) == sorted(x for x, (_, c) in groups(before, 80).items() if x == c)
        elif name == "source mixing":
            words = lambda rows: sum(len((t or "").split()) for _, t in rows)
            assert abs(words(after) - 1.5 * words(before)) < 100 and max(Counter(x for x, _ in after).values()) <= 2
        else:
            check_copies = [(i, t) for i, t in before]
            assert sum(r.length for r in out.collect()) == sum(len(_ids(t)) + 1 for _, t in check_copies)
        docs = out


def _ids(text):
    from synthscan.llm.tokens import encoder

    return encoder().encode(text or "")


def test_run(spark):
    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.columns[0] == "doc_id" and out.count() > 100


def test_packing_check_itself(spark):
    from synthscan.llm import packing

    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    check_packed(packing.pack(df).collect(), pairs(df))


@pytest.mark.parametrize("table", ["odd", "empty"])
@pytest.mark.parametrize("number", range(5))
def test_stages_on_odd_rows(request, spark, table, number):
    docs = request.getfixturevalue(table)
    for name in ("n_lines", "kept", "rule", "_id", "_n", "u", "id", "n_chars"):  # names that operators use themselves
        docs = docs.withColumn(name, F.lit(77).cast("long"))
    out = P.STAGES[number][1](spark, docs, "/root/testdata/sf0.001")
    rows = out.collect()
    if number < 4:
        assert out.columns == docs.columns
        assert all(r.n_lines == r.kept == r._id == 77 for r in rows)
    assert (len(rows) == 0) == (table == "empty")


@pytest.mark.parametrize("number", range(5))
def test_columns_of_any_name(spark, odd, number):  # noqa: F811
    names = ["N_Words", "Kept", "n_REMOVED", "a.b", "with space", "back`tick", "__other_0", "Rule", "Base_Failed", "IDS", "Body.Text"]
    docs = odd.drop("n_words", "body")
    docs = docs.select("*", *(F.lit(f"own {i}").alias(x) for i, x in enumerate(names)))
    out = P.STAGES[number][1](spark, docs, "/root/testdata/sf0.001")
    rows = out.collect()
    assert rows
    if number < 4:
        assert out.columns == docs.columns
        at = out.columns.index("N_Words")
        assert all(list(r)[at : at + len(names)] == [f"own {i}" for i in range(len(names))] for r in rows)
