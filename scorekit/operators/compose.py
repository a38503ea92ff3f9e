"""Scores from predictions, and frames put side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import materialize
from .features import GROUPS

# A score is prediction * 500 + 350.
SCORE_SPAN = 500
SCORE_BASE = 350


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rescale_score(prediction: Column | str, clamp: bool = False) -> Column:
    """Prediction to score. Boosted trees can leave [0, 1]; ``clamp`` keeps the score within 350 to 850."""
    score = _col(prediction) * SCORE_SPAN + SCORE_BASE
    if not clamp:
        return score
    kept = F.when(score > SCORE_BASE + SCORE_SPAN, F.lit(float(SCORE_BASE + SCORE_SPAN)))
    return kept.when(score < SCORE_BASE, F.lit(float(SCORE_BASE))).otherwise(score)


def unscale_score(score: Column | str) -> Column:
    """Score back to prediction."""
    return (_col(score) - SCORE_BASE) / SCORE_SPAN


def blend_scores(rf: Column | str, gbt: Column | str, rf_share: float = 0.6, gbt_share: float = 0.4) -> Column:
    return _col(rf) * rf_share + _col(gbt) * gbt_share


def weighted_total(weights: dict[str, float] | None = None) -> Column:
    """The weighted sum of the group scores; by default the five groups with their weights."""
    weights = weights or {g.score_column: g.weight for g in GROUPS.values()}
    total = None
    for column, weight in weights.items():
        part = F.col(column) * weight
        total = part if total is None else total + part
    return total


def _placed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows written once with their partition and place, and the rows per partition.

    Columns get internal names, since a frame to be put beside another may repeat names. As placement is stored with
    the rows, a lost executor cannot deal them out anew.
    """
    named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    placed = materialize(
        named.select(F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_seq"), "*"),
        "positions",
    )
    return placed, placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))


def _positions(placed: DataFrame, sizes: DataFrame) -> DataFrame:
    # One row per partition, whatever the data size: small enough for one window and for a broadcast.
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    # ``_seq`` is the partition number shifted left by 33 bits plus the place within the partition.
    place = F.col("_seq") - F.shiftleft(F.col("_part").cast("bigint"), 33)
    numbered = placed.join(F.broadcast(offsets), "_part").withColumn("_position", F.col("_offset") + place)
    return numbered.drop("_part", "_seq", "_offset")


def row_positions(df: DataFrame, position: str = "position") -> DataFrame:
    """``df`` behind a gapless 0-based row position: partition order, then order within the partition."""
    numbered = _positions(*_placed(df))
    columns = [F.col(f"c{i}").alias(name) for i, name in enumerate(df.columns)]
    return numbered.select(F.col("_position").alias(position), *columns)


def positional_concat(*frames: DataFrame, ordered: bool = True) -> DataFrame:
    """Row *i* of each frame side by side, all columns of all frames; names may repeat.

    Raises when the row counts differ. Needed only for frames that share no key; scores of one frame stay in it. With
    ``ordered`` the result is sorted by row, so that it can itself be paired by position; without, no sort is planned.
    """
    sides = [_placed(f) for f in frames]
    counts = [sizes.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0] for _, sizes in sides]
    if len(set(counts)) > 1:
        raise ValueError(f"cannot pair frames of {counts} rows")
    joined, names = None, []
    for frame, (placed, sizes) in zip(frames, sides, strict=True):
        inner = [f"c{i}" for i in range(len(frame.columns))]
        outer = [f"c{len(names) + i}" for i in range(len(frame.columns))]
        side = _positions(placed, sizes).select("_position", *[F.col(i).alias(o) for i, o in zip(inner, outer, strict=True)])
        joined = side if joined is None else joined.join(side, "_position")
        names += frame.columns
    return (joined.orderBy("_position") if ordered else joined).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
