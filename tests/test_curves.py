"""Curves of several models at once, and curves of a bounded number of points."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from scorekit.operators import binned
from scorekit.operators import evaluate as E
from scorekit.operators.binned import binned_counts

SCHEMA = "model string, score double, label double"
KEYS = ["threshold", "pos", "neg", "tp", "fp", "p", "n"]


def brute(rows):
    """Counts at every distinct score of every model."""
    groups, out = defaultdict(list), {}
    for m, s, y in rows:
        groups[m].append((s, y > 0.5))
    for m, pairs in groups.items():
        p, tp, fp = sum(y for _, y in pairs), 0, 0
        for t in sorted({s for s, _ in pairs}, reverse=True):
            pos, neg = sum(y for s, y in pairs if s == t), sum(not y for s, y in pairs if s == t)
            tp, fp = tp + pos, fp + neg
            out[m, t] = (pos, neg, tp, fp, p, len(pairs) - p)
    return out


def brute_binned(rows, bins):
    """The same at the scores of evenly spaced ranks."""
    full, out = brute(rows), {}
    groups = defaultdict(list)
    for m, s, _ in rows:
        groups[m].append(s)
    for m, scores in groups.items():
        ranked = sorted(scores, reverse=True)
        tp = fp = 0
        for t in sorted({ranked[-(-j * len(ranked) // bins) - 1] for j in range(1, bins + 1)}, reverse=True):
            _, _, a, b, p, n = full[m, t]
            out[m, t] = (a - tp, b - fp, a, b, p, n)
            tp, fp = a, b
    return out


def counted(df):
    return {(r["model"], r["threshold"]): tuple(r[k] for k in KEYS[1:]) for r in df.collect()}


def sample(seed, n=600):
    rng = random.Random(seed)
    rows = [("a", rng.random(), rng.random() < 0.3) for _ in range(n)] + [("b", round(rng.gauss(0, 3), 1), rng.random() < 0.6) for _ in range(n)]
    rows += [(None, rng.choice([0.1, 0.2]), False) for _ in range(9)] + [("one", 0.5, True)]
    return [(m, float(s), float(y)) for m, s, y in rows]


def test_groups_equal_brute_force_on_any_partitioning(spark):
    rows = sample(1)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    for part in (df, df.repartition(9), df.coalesce(1)):
        assert counted(E.threshold_counts(part, by=("model",))) == want


def test_each_group_has_the_curves_it_has_alone(spark):
    rows = sample(2, 150)
    df = spark.createDataFrame(rows, SCHEMA)
    counts = E.threshold_counts(df, by=("model",))
    together = {f.__name__: [r for r in f(counts).collect()] for f in (E.pr_curve, E.roc_curve, E.auc_pr, E.auc_roc, E.precision_by_threshold, E.recall_by_threshold, E.f_measure_by_threshold, E.thresholds)}
    for m in ("a", "b", "one", None):
        alone = E.threshold_counts(df.where(F.col("model").eqNullSafe(F.lit(m))))
        for name, rows_of in together.items():
            ours = sorted(tuple(r)[1:] for r in rows_of if r["model"] == m)
            theirs = sorted(tuple(r) for r in getattr(E, name)(alone).collect())
            assert len(ours) == len(theirs)
            assert all(math.isclose(x, y, abs_tol=1e-12) for a, b in zip(ours, theirs) for x, y in zip(a, b, strict=True))


def test_models_are_judged_from_one_scan(spark, tmp_path):
    rows = [(float(i % 7) / 7, float(i % 5) / 5, float(i % 2)) for i in range(60)]
    spark.createDataFrame(rows, "rf double, gbt double, label double").write.parquet(str(tmp_path / "judged"))
    df = spark.read.parquet(str(tmp_path / "judged"))
    both = E.stacked(df, {"x": "rf", "y": "gbt"})
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Union" not in plan and "Join" not in plan
    got = {(r["model"], r["metric"]): r["value"] for r in E.evaluate_models(df, {"x": "rf", "y": "gbt"}).collect()}
    for m, c in (("x", "rf"), ("y", "gbt")):
        for r in E.evaluation_report(df, c).collect():
            assert math.isclose(got[m, r["metric"]], r["value"], abs_tol=1e-12)
    assert len(got) == 8


def test_a_group_of_most_rows_is_spread_over_ranges(spark):
    """Ranges cut through a group: no task holds all thresholds of the model that has nine rows of ten."""
    df = spark.range(20_000).select(
        F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("model"), (F.col("id") * 7919 % 20_000 / 20_000).alias("score"), (F.col("id") % 3 == 0).cast("double").alias("label"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16KB")
    try:
        counts = E.threshold_counts(df, by=("model",))
        assert counted(counts) == brute([(r.model, r.score, r.label) for r in df.collect()])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


ODD = {
    "ties": [0.5] * 300 + [0.25] * 10 + [0.75],
    "one value": [2.0] * 40,
    "near": [1.0 + i * 2.0**-52 for i in range(200)],
    "wide": [10.0**k for k in range(-300, 300, 3)] + [-(10.0**k) for k in range(-300, 300, 3)],
    "ends": [-1.7e308, 1.7e308, 0.0, -0.0, 5e-324, -5e-324] + [math.inf] * 3 + [-math.inf] * 3 + list(range(50)),
    "skewed": [1e300] + [i / 1000 for i in range(500)],
}


@pytest.mark.parametrize("bins", [1, 7, 100, 5000])
def test_binned_equals_brute_force(spark, bins):
    rows = sample(3, 200) + [(m, float(s), float(i % 3 == 0)) for m, scores in ODD.items() for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute_binned(rows, bins)
    assert counted(binned_counts(df, bins, by=("model",))) == want
    assert counted(binned_counts(df.repartition(7), bins, by=("model",))) == want


def test_few_cells_take_more_rounds(spark, monkeypatch):
    monkeypatch.setattr(binned, "CELLS", 1)
    rows = sample(4, 100)
    assert counted(binned_counts(spark.createDataFrame(rows, SCHEMA), 9, by=("model",))) == brute_binned(rows, 9)


@pytest.mark.parametrize("error", [0.001, 0.01, 0.1])
def test_rank_error_is_bounded_and_counts_are_exact(spark, error):
    n, bins = 30_000, 50
    df = spark.range(n).select(F.lit("m").alias("model"), F.pow((F.col("id") * 7919 % n) / n, F.lit(8.0)).alias("score"), (F.col("id") % 4 == 0).cast("double").alias("label"))
    rows = [(r.model, r.score, r.label) for r in df.collect()]
    got, full = counted(binned_counts(df, bins, by=("model",), error=error)), brute_counts_fast(rows)
    ranked = sorted((s for _, s, _ in rows), reverse=True)
    at = {s: i + 1 for i, s in enumerate(ranked)}
    for j in range(1, bins + 1):
        wanted = -(-j * n // bins)
        assert min(abs(at[t] - wanted) for _, t in got) < max(1, error * n)
    for key, (_, _, tp, fp, p, neg) in got.items():
        assert (tp, fp, p, neg) == full[key]


def brute_counts_fast(rows):
    ordered, tp, fp, out = sorted(rows, key=lambda r: -r[1]), 0, 0, {}
    p = sum(y > 0.5 for *_, y in rows)
    for m, s, y in ordered:
        tp, fp = tp + (y > 0.5), fp + (y <= 0.5)
        out[m, s] = (tp, fp, p, len(rows) - p)
    return out


def test_binned_curve_feeds_the_curves(spark):
    rows = sample(5, 400)
    df = spark.createDataFrame([r for r in rows if r[0] == "a"], SCHEMA)
    exact, few = E.threshold_counts(df), binned_counts(df, 40)
    assert few.columns == exact.columns and few.count() == 40
    gap = E.auc_roc(exact).first()[0] - E.auc_roc(few).first()[0]
    assert abs(gap) < 0.02
    # With a bin for every row nothing is binned away.
    assert sorted(map(tuple, binned_counts(df, df.count()).collect())) == sorted(map(tuple, exact.collect()))


def test_binned_edges(spark):
    assert binned_counts(spark.createDataFrame([], SCHEMA), 5).collect() == []
    assert binned_counts(spark.createDataFrame([], SCHEMA), 5, by=("model",)).columns == ["model", *KEYS]
    df = spark.createDataFrame([("a", 0.5, 1.0), ("a", None, 1.0)], SCHEMA)
    with pytest.raises(Exception, match="is null or NaN"):
        binned_counts(df, 5)
    for bins, error in ((0, 0.0), (5, 1.0), (5, -0.1)):
        with pytest.raises(ValueError):
            binned_counts(df, bins, error=error)
