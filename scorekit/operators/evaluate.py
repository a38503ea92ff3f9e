"""Evaluation of predictions: errors, and the threshold, precision-recall and ROC curves as DataFrames.

Inputs hold ``score`` and ``label``; a label above 0.5 is positive. Curves are exact: every distinct score is a
threshold and none is binned away. Rows are first summed per distinct score, so a score that many rows share is
reduced before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import materialize


def checked(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """The columns ``by``, and ``score, label`` as doubles. A null or NaN in either raises, as it would otherwise drop out of
    a count unseen."""
    def sound(name: str, alias: str) -> Column:
        c = F.col(name).cast("double")
        return F.when(c.isNull() | F.isnan(c), F.raise_error(F.lit(f"{alias} is null or NaN"))).otherwise(c).alias(alias)

    return df.select(*by, sound(score, "score"), sound(label, "label"))


def stacked(df: DataFrame, scores: dict[str, str], label: str = "label", keep: Sequence[str] = ()) -> DataFrame:
    """``model, score, label`` and kept columns: one row per row of ``df`` and model, from one scan. ``scores`` names the
    column that holds each model's score."""
    pairs = [F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("score")) for m, c in scores.items()]
    return df.select(*keep, F.col(label).cast("double").alias("label"), F.inline(F.array(*pairs))).select(*keep, "model", "score", "label")


def _mse() -> Column:
    gap = F.col("label") - F.col("score")
    return F.avg(gap * gap)


def _error(cutoff: float | None) -> Column:
    predicted = F.col("score") if cutoff is None else (F.col("score") > cutoff).cast("double")
    return F.avg((F.col("label") != predicted).cast("double"))


def mse(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    return checked(df, score, label, by).groupBy(*by).agg(_mse().alias("mse"))


def prediction_error(
    df: DataFrame, score: str = "score", label: str = "label", cutoff: float | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """Share of rows whose prediction differs from the label.

    The comparison is exact, hence close to 1 for regressors; with ``cutoff`` the score is first turned into 0 or 1.
    """
    return checked(df, score, label, by).groupBy(*by).agg(_error(cutoff).alias("test_error"))


def scores_and_labels(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    return df.select(F.col(score).cast("double").alias("score"), F.col(label).cast("double").alias("label"))


_COUNTS = ("threshold", "pos", "neg", "tp", "fp", "p", "n")


def threshold_counts(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """``threshold, pos, neg, tp, fp, p, n``: per distinct score, its own and the cumulative counts at or above it.

    With columns ``by``, such as the model that scored, each of their values has counts of its own, led by those columns.
    A running total over all thresholds in one window would run in one task, as would one per group where a group holds
    most rows. Instead the distinct scores of all groups are range partitioned together and written once, with their
    range number, so that both uses see the same ranges. The totals of a range are a single row for each group in it, and
    the running total over those rows comes back as an offset.
    """
    pairs = checked(df, score, label, by).select(*by, F.col("score").alias("threshold"), (F.col("label") > 0.5).alias("_hit"))
    per_score = pairs.groupBy(*by, "threshold").agg(
        F.count(F.when(F.col("_hit"), 1)).alias("pos"), F.count(F.when(~F.col("_hit"), 1)).alias("neg")
    )
    ranged = per_score.repartitionByRange(*by, F.desc("threshold")).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "thresholds")
    # From here to the join one row per range, and one more per further group in a range.
    totals = ranged.groupBy(*by, "_range").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(*by)
    offsets = totals.select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col("_range").alias("_of"),
        F.coalesce(F.sum("_pos").over(before), F.lit(0)).alias("_tp0"),
        F.coalesce(F.sum("_neg").over(before), F.lit(0)).alias("_fp0"),
        F.sum("_pos").over(everything).alias("p"),
        F.sum("_neg").over(everything).alias("n"),
    )
    inside = W.partitionBy(*by, "_range").orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = ranged.select(
        *by, "_range", "threshold", "pos", "neg",
        F.sum("pos").over(inside).alias("_tp"), F.sum("neg").over(inside).alias("_fp"),
    )
    same = reduce(and_, [F.col("_range") == F.col("_of"), *[F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]])
    # Without groups there are as many offsets as shuffle partitions; with groups the planner judges their size.
    return local.join(offsets if by else F.broadcast(offsets), same).select(
        *by, "threshold", "pos", "neg",
        (F.col("_tp") + F.col("_tp0")).alias("tp"), (F.col("_fp") + F.col("_fp0")).alias("fp"), "p", "n",
    )


def _by(counts: DataFrame) -> list[str]:
    """The columns in front of the counts, whose values have a curve each."""
    return [c for c in counts.columns if c not in _COUNTS]


def _share(part: Column, whole: Column) -> Column:
    """``part / whole``, with 0 for an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _precision() -> Column:
    return _share(F.col("tp"), F.col("tp") + F.col("fp"))


def _recall() -> Column:
    return _share(F.col("tp"), F.col("p"))


def precision_by_threshold(counts: DataFrame) -> DataFrame:
    return counts.select(*_by(counts), "threshold", _precision().alias("precision"))


def recall_by_threshold(counts: DataFrame) -> DataFrame:
    return counts.select(*_by(counts), "threshold", _recall().alias("recall"))


def f_measure_by_threshold(counts: DataFrame, beta: float = 1.0) -> DataFrame:
    """(1+b^2)PR / (b^2 P + R) per threshold, 0 where both are 0."""
    b2 = beta * beta
    p, r = _precision(), _recall()
    return counts.select(*_by(counts), "threshold", _share((1.0 + b2) * p * r, b2 * p + r).alias("f_measure"))


def thresholds(counts: DataFrame) -> DataFrame:
    return counts.select(*_by(counts), "threshold")


# A group's highest threshold is the row whose cumulative counts are its own, its lowest the one that has counted all.
def _highest() -> Column:
    return F.col("tp") + F.col("fp") == F.col("pos") + F.col("neg")


def _lowest() -> Column:
    return F.col("tp") + F.col("fp") == F.col("p") + F.col("n")


def pr_curve(counts: DataFrame) -> DataFrame:
    """``recall, precision`` per threshold, led by (0, precision of the highest threshold)."""
    point = F.struct(_recall().alias("recall"), _precision().alias("precision"))
    start = F.struct(F.lit(0.0).alias("recall"), _precision().alias("precision"))
    # The highest threshold yields two points.
    return counts.select(*_by(counts), F.inline(F.when(_highest(), F.array(start, point)).otherwise(F.array(point))))


def roc_curve(counts: DataFrame) -> DataFrame:
    """``fpr, tpr`` per threshold, between (0, 0) and (1, 1). Without groups and rows these two points are left."""
    fpr = _share(F.col("fp"), F.col("n"))
    if by := _by(counts):
        corner = lambda v: F.struct(F.lit(v).alias("fpr"), F.lit(v).alias("tpr"))
        none = F.array().cast("array<struct<fpr:double,tpr:double>>")
        first, last = F.when(_highest(), F.array(corner(0.0))).otherwise(none), F.when(_lowest(), F.array(corner(1.0))).otherwise(none)
        return counts.select(*by, F.inline(F.concat(first, F.array(F.struct(fpr.alias("fpr"), _recall().alias("tpr"))), last)))
    points = counts.select(fpr.alias("fpr"), _recall().alias("tpr"))
    ends = counts.sparkSession.range(2).select(F.col("id").cast("double").alias("fpr"), F.col("id").cast("double").alias("tpr"))
    return points.unionByName(ends)


def _area_roc() -> Column:
    tpr, fpr = _recall(), _share(F.col("fp"), F.col("n"))
    tpr0 = _share(F.col("tp") - F.col("pos"), F.col("p"))
    area = F.sum(_share(F.col("neg"), F.col("n")) * (tpr + tpr0) / 2)
    return area + (1 - F.max(fpr)) * (1 + F.max(tpr)) / 2


def _area_pr() -> Column:
    tp0 = F.col("tp") - F.col("pos")
    seen0 = tp0 + F.col("fp") - F.col("neg")
    before = F.when(seen0 == 0, _precision()).otherwise(_share(tp0, seen0))
    return F.sum(_share(F.col("pos"), F.col("p")) * (_precision() + before) / 2)


def auc_roc(counts: DataFrame) -> DataFrame:
    """Area under the ROC curve. A step's start follows from the row's own counts, so no row looks at another."""
    return counts.groupBy(*_by(counts)).agg(_area_roc().alias("auc_roc"))


def auc_pr(counts: DataFrame) -> DataFrame:
    """Area under the precision-recall curve, from (0, precision of the highest threshold)."""
    return counts.groupBy(*_by(counts)).agg(_area_pr().alias("auc_pr"))


def evaluation_report(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """``metric, value``, led by the columns ``by``: mean squared error, share of unequal predictions, and both areas.

    Scores and labels are written once, so what predicts them runs once; errors take one aggregate, areas another.
    """
    pairs = materialize(checked(df, score, label, by), "judged")
    errors = pairs.groupBy(*by).agg(_mse().alias("mse"), _error(None).alias("test_error"))
    areas = threshold_counts(pairs, by=by).groupBy(*by).agg(_area_pr().alias("auc_pr"), _area_roc().alias("auc_roc"))

    def rows(one: DataFrame) -> DataFrame:
        metrics = [c for c in one.columns if c not in by]
        return one.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in metrics])))

    return rows(errors).unionByName(rows(areas))


def evaluate_models(df: DataFrame, scores: dict[str, str], label: str = "label") -> DataFrame:
    """``model, metric, value``: the :func:`evaluation_report` of every model whose score is a column of ``df``, from one scan
    and as many jobs as a single model takes."""
    return evaluation_report(stacked(df, scores, label), by=("model",))
