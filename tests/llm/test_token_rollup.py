"""Signed batches against a plain ledger, and batches that come twice."""

from scorekit.llm.token_rollup import TokenRollup
from scorekit.staging import new_path

SCHEMA = "op string, doc_id bigint, source string, lang string, tokenizer string, tokens bigint, docs int"


def totals(rollup):
    return sorted(map(tuple, rollup.totals().collect()), key=str)


def batch(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)


def test_batches(spark):
    rollup = TokenRollup(spark, new_path(spark, "rollup"))
    assert totals(rollup) == []
    first = batch(spark, [
        ("insert", 1, "a", "en", "t1", 10), ("insert", 2, "a", "en", "t1", 5), ("insert", 2, "a", "en", "t2", 7), ("insert", 3, None, None, "t1", None),
        ("insert", None, "a", "en", "t1", 100), ("insert", 4, "b", "de", "t1", 1), ("insert", 4, "b", "de", "t1", 1), ("delete", 1, None, None, "t1", None)])
    assert rollup.commit("one", first)
    want = [("a", "en", "t1", 3, 115), ("a", "en", "t2", 1, 7), ("b", "de", "t1", 2, 2), (None, None, "t1", 1, 0)]
    assert totals(rollup) == sorted(want, key=str)  # a delete finds nothing before its batch
    assert not rollup.commit("one", first) and totals(rollup) == sorted(want, key=str)

    second = batch(spark, [
        ("delete", 1, "other", "xx", "t1", None), ("revise", 2, None, None, "t1", 6), ("revise", 2, None, None, "t1", 4), ("revise", 4, None, None, "t1", 10),
        ("delete", 3, None, None, "t1", None), ("revise", 3, None, None, "t1", 9), ("delete", 99, None, None, "t1", None), ("delete", None, None, None, "t1", None),
        ("insert", 1, "c", "fr", "t1", 8), ("ignored", 5, "a", "en", "t1", 5)])
    assert rollup.commit("two", second)
    want = [("a", "en", "t1", 2, 106), ("a", "en", "t2", 1, 7), ("b", "de", "t1", 2, 20), ("c", "fr", "t1", 1, 8)]
    assert totals(rollup) == sorted(want, key=str)
    assert rollup.commit("three", batch(spark, [])) and totals(rollup) == sorted(want, key=str)
    assert rollup.commit("four", batch(spark, [("delete", 4, None, None, "t1", None), ("delete", 4, None, None, "t1", None)]))
    assert totals(rollup) == sorted([w for w in want if w[0] != "b"], key=str)
    assert rollup.committed() == ["four", "one", "three", "two"]
    assert totals(TokenRollup(spark, rollup.path)) == totals(rollup)


def test_a_name_is_taken_once(spark):
    """Two writers that both saw the batch as missing: the second one's rename is refused."""
    path = new_path(spark, "rollup")
    rollup = TokenRollup(spark, path)
    one = batch(spark, [("insert", 1, "a", "en", "t", 1)])
    assert rollup.commit("b", one)
    late = TokenRollup(spark, path)
    late.committed = lambda: []
    assert not late.commit("b", one)
    assert totals(rollup) == [("a", "en", "t", 1, 1)]
