"""The registered queries against their SQL, the pipeline stage by stage, and the plans of the native operators."""

import sys
from pathlib import Path

import pytest
from check_catalog import connect, difference

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))

import corpus_pipeline  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from scorekit.llm.catalog import QUERIES, SQL, load  # noqa: E402

NATIVE = ["op1_url_trust", "op3_secret_scan", "op5_exact_dedup", "op9_decontaminate"]


def test_all_are_registered():
    names = queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)} and "pipeline" in names
    assert set(SQL) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, sf_dir):
    assert difference(QUERIES[name](spark, sf_dir).toPandas(), connect(sf_dir).sql(SQL[name]).df()) is None


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_hold_no_python(name, spark, sf_dir):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_stages(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").cache()
    texts = {r.doc_id: r.text for r in docs.collect()}
    size = docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        rows = out.collect()
        assert 0.5 * size < len(rows) <= size and all(texts[r.doc_id] == r.text for r in rows)
        docs, size = spark.createDataFrame(rows, docs.schema), len(rows)
    mixed = corpus_pipeline.mixing(spark, docs, sf_dir)
    assert mixed.columns == docs.columns and mixed.count() > 0
    ids = corpus_pipeline.token_ids(spark, mixed, sf_dir)
    assert ids.count() == mixed.count()


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).orderBy("start").collect()
    assert out[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:]))


def test_one_of_equal_rows_stays(spark, sf_dir):
    docs = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (1, "A b c d e f"), (None, "x y"), (4, None), (4, None)], "doc_id bigint, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()
    assert sorted(map(str, kept)) == sorted(map(str, docs.where("doc_id = 1 OR doc_id = 4 OR doc_id IS NULL").collect()))


def test_equal_rows_without_words_stay_beside_a_repeated_row_that_is_kept(spark, sf_dir):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (3, "A b c d e f"), (None, None), (None, None), (4, " "), (4, " ")], "doc_id bigint, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()
    assert sorted(map(str, kept)) == sorted(["Row(doc_id=1, text='a b c d e f')"] + ["Row(doc_id=None, text=None)"] * 2 + ["Row(doc_id=4, text=' ')"] * 2)
