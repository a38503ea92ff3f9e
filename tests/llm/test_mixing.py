"""Budgets and cuts against plain Python, and the mixed texts themselves."""

import hashlib

import pytest
from pyspark.sql import functions as F

from scorekit.llm.mixing import mix, plan_mix, running_totals, targets


def budgets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        over = {s for s in rest if left * w[s] / sum(w[r] for r in rest) > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in full else left * w[s] / sum(w[r] for r in rest) for s in names}
        full |= over


ROWS = [(i, "w " * (i % 7) + "x", ("hot", "b", "\U0001f600", "c", None, "hot", "hot", "z", "ﬀ")[i % 9]) for i in range(300)]
ROWS += [(900, None, "empty"), (901, " ", "empty"), (902, "one", "tiny"), (None, "a b c", "b"), (None, None, None), (5, ROWS[5][1], ROWS[5][2])]


def test_plan(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id bigint, text string, source string, size string, taken int")
    got = plan_mix(df.repartition(7)).collect()
    sizes = {}
    for _, t, s in ROWS:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = budgets(sizes)
    assert len(got) == len(ROWS)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken == r.epochs * r.size + r.part and 0 <= r.taken <= 3 * r.size
    for s in sizes:
        rows = sorted((r for r in got if r.source == s), key=lambda r: (hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest(), r.doc_id is not None, r.doc_id or 0, r.row))
        assert sum(r.taken for r in rows) == int(want[s] + 1e-9)
        cut = [r.part == r.size for r in rows if r.size]
        assert cut == sorted(cut, reverse=True)  # whole documents first, in hash order
    again = plan_mix(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixed_texts(spark):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS[:-1])], "doc_id bigint, text string, source string, _size bigint")
    plan = {(r.doc_id, r.source, r.size): r for r in plan_mix(df).collect()}
    out = mix(df).collect()
    assert out and mix(df).columns == df.columns
    words = {}
    for r in out:
        words.setdefault((r.doc_id, r.source), []).append(len(r.text.split()))
        assert next(t for d, t, s in ROWS if d == r.doc_id and s == r.source).startswith(r.text)
    for (d, s, n), r in plan.items():
        assert sorted(words.get((d, s), [])) == sorted([n] * r.epochs * bool(n) + [r.part] * bool(r.part))


@pytest.mark.parametrize("sizes", [{"a": 1, "b": 1000, "c": 1}, {"a": 0, "b": 0}, {"a": 10}, {None: 5, "x": 500, "y": 1, "z": 2}])
def test_limits_are_shared_on(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in targets(df).collect()}
    want = budgets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_running_totals_over_many_ranges(spark):
    df = spark.range(2000).selectExpr("id", "id % 3 AS g", "id % 11 AS v")
    rows = running_totals(df, ["g"], [F.col("id").asc()], "v", "before").collect()
    for r in rows:
        assert r.before == sum(k % 11 for k in range(r.g, r.id, 3))


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert plan_mix(none).count() == 0 and mix(none).count() == 0
