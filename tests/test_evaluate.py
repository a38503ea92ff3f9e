import math
import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from scorekit.operators import evaluate as E


def frame(spark, rows):
    return spark.createDataFrame([(float(s), float(y)) for s, y in rows], "score double, label double")


def one(df):
    return df.collect()[0][0]


def brute(rows):
    """Cumulative counts per distinct score, from the highest down."""
    p = sum(y > 0.5 for _, y in rows)
    out = []
    for t in sorted({s for s, _ in rows}, reverse=True):
        tp = sum(s >= t and y > 0.5 for s, y in rows)
        fp = sum(s >= t and y <= 0.5 for s, y in rows)
        out.append((t, tp, fp, p, len(rows) - p))
    return out


def counts_of(df, **kw):
    c = E.threshold_counts(df, **kw)
    return sorted(((r["threshold"], r["tp"], r["fp"], r["p"], r["n"]) for r in c.collect()), reverse=True)


GOLDEN = [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.1, 1)]


def test_golden_vector(spark):
    df = frame(spark, GOLDEN)
    c = E.threshold_counts(df)
    assert counts_of(df) == [(0.9, 1, 0, 3, 2), (0.8, 2, 1, 3, 2), (0.3, 2, 2, 3, 2), (0.1, 3, 2, 3, 2)]
    assert math.isclose(one(E.auc_roc(c)), 0.583333, abs_tol=1e-6)
    assert math.isclose(one(E.auc_pr(c)), 0.794444, abs_tol=1e-6)
    assert math.isclose(one(E.mse(df)), 0.318)
    assert {r["threshold"] for r in E.thresholds(c).collect()} == {0.9, 0.8, 0.3, 0.1}
    precision = {r["threshold"]: r["precision"] for r in E.precision_by_threshold(c).collect()}
    recall = {r["threshold"]: r["recall"] for r in E.recall_by_threshold(c).collect()}
    assert precision == {0.9: 1.0, 0.8: 2 / 3, 0.3: 0.5, 0.1: 0.6}
    assert recall == {0.9: 1 / 3, 0.8: 2 / 3, 0.3: 2 / 3, 0.1: 1.0}
    for beta in (1.0, 0.5):
        for r in E.f_measure_by_threshold(c, beta).collect():
            p, q, b2 = precision[r["threshold"]], recall[r["threshold"]], beta * beta
            assert math.isclose(r["f_measure"], (1 + b2) * p * q / (b2 * p + q))


def test_curve_ends(spark):
    c = E.threshold_counts(frame(spark, [(0.9, 0), (0.9, 1), (0.1, 1)]))
    assert math.isclose(one(E.auc_pr(c)), 0.541667, abs_tol=1e-6)
    assert sorted(tuple(r) for r in E.pr_curve(c).collect()) == [(0.0, 0.5), (0.5, 0.5), (1.0, 2 / 3)]
    assert sorted(tuple(r) for r in E.roc_curve(c).collect()) == [(0.0, 0.0), (1.0, 0.5), (1.0, 1.0), (1.0, 1.0)]


@pytest.mark.parametrize("label, area", [(0, 0.0), (1, 1.0)])
def test_one_class(spark, label, area):
    c = E.threshold_counts(frame(spark, [(0.9, label), (0.2, label), (0.2, label)]))
    assert one(E.auc_roc(c)) == area and one(E.auc_pr(c)) == area
    assert {r["recall"] for r in E.recall_by_threshold(c).collect()} <= ({0.0} if label == 0 else {1 / 3, 1.0})


def test_no_rows(spark):
    df = frame(spark, [])
    assert E.threshold_counts(df).count() == 0
    assert one(E.mse(df)) is None


def test_random_scores_match_brute_force_and_the_library(spark):
    rng = random.Random(7)
    rows = [(round(rng.random(), 2), rng.random() < 0.3) for _ in range(400)]
    df = frame(spark, rows)
    expected = brute(rows)
    assert counts_of(df) == expected
    assert counts_of(df.repartition(13, "label")) == expected
    c = E.threshold_counts(df)
    for metric, ours in (("areaUnderROC", E.auc_roc(c)), ("areaUnderPR", E.auc_pr(c))):
        judge = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName=metric, numBins=0)
        assert math.isclose(one(ours), judge.evaluate(df), abs_tol=1e-9)


def test_many_distinct_scores_over_many_ranges(spark):
    """Totals carry over range borders: each row has its own score, and one score is shared by a third of all rows."""
    n = 20000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise((F.col("id") * 7919 % n) / n).alias("score"),
        (F.col("id") % 5 == 0).cast("double").alias("label"),
    )
    old = spark.conf.get("spark.sql.shuffle.partitions")
    # Small target size, so that adaptive execution keeps several ranges.
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16KB")
    try:
        staged = counts_of(df)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    assert staged == brute([(r.score, r.label > 0.5) for r in df.collect()]) and len(staged) > 13000
    assert staged[-1][1] + staged[-1][2] == n


def test_prediction_error(spark):
    df = frame(spark, [(1.0, 1), (0.7, 1), (0.2, 0), (0.0, 0)])
    assert one(E.prediction_error(df)) == 0.5
    assert one(E.prediction_error(df, cutoff=0.5)) == 0.0


def test_report(spark):
    got = {r["metric"]: r["value"] for r in E.evaluation_report(frame(spark, GOLDEN)).collect()}
    assert set(got) == {"mse", "test_error", "auc_pr", "auc_roc"}
    assert math.isclose(got["auc_roc"], 0.583333, abs_tol=1e-6)


@pytest.mark.parametrize("row", [(None, 1.0), (0.5, None), (float("nan"), 1.0), (0.5, float("nan"))])
def test_rows_that_cannot_be_judged_raise(spark, row):
    df = spark.createDataFrame([(0.2, 0.0), (0.8, 1.0), row], "score double, label double")
    for judged in (E.mse, E.prediction_error, E.threshold_counts, lambda d: E.auc_roc(E.threshold_counts(d)), E.evaluation_report):
        with pytest.raises(Exception, match="is null or NaN"):
            judged(df).collect()


def test_curve_reads_its_counts_once(spark):
    plan = E.pr_curve(E.threshold_counts(frame(spark, GOLDEN)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 0
