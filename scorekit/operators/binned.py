"""Threshold curves with a bounded number of points, from exact quantiles that are found without sorting the scores.

The cut points are the scores at evenly spaced ranks. They are located by counting: all scores between the least and the
greatest fall into cells of equal width, the counts of the cells tell which of them hold a wanted rank, and only the
scores of those cells are counted again, in finer cells. Counts of cells add up, so the summary is the same however rows
are partitioned, and a handful of rounds over ever fewer rows makes it exact. Where equal widths leave most rows together, as
scores of very different size do, the next round counts by powers of two instead. Nothing is sorted, no score is collected
but the cut points, and a score that a third of all rows share is one cell with one value.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import drop_path, materialize, new_path
from .evaluate import _COUNTS, checked

CELLS = 100_000  # cells that are counted in one round at most, over all groups; at least 16 for each open cell


@dataclass
class _Open:
    """A cell of one group that holds wanted ranks: its least and greatest score, what lies above, and the ranks."""

    group: tuple
    low: float
    high: float
    above: tuple[int, int]  # rows and positive rows with greater scores
    ranks: list[int]  # counted from the greatest score, from 1
    size: int = 0  # its rows
    by_power: bool = False  # whether it is to be split by powers of two

    def wide(self) -> bool:
        """Whether its scores differ in sign, or by more than a factor of four."""
        return self.low <= 0 <= self.high or max(abs(self.low), abs(self.high)) > 4 * min(abs(self.low), abs(self.high))


def _power() -> Column:
    """The power of two below a score's size, in the order of the scores: negative ones below zero, zero itself 0."""
    size = F.floor(F.least(F.log2(F.abs(F.col("score"))), F.lit(1100.0))).cast("int") + 1100
    return F.when(F.col("score") == 0, 0).when(F.col("score") < 0, -size).otherwise(size)


def _digit(cells: int) -> Column:
    """Which of ``cells`` parts of [low, high] a score is in, from below, or its :func:`_power` where the cell asks for that.
    The ends take the outer parts, whatever rounding does, so that a cell with two different scores always comes apart.
    Halves keep the width finite."""
    width = F.col("high") / 2 - F.col("low") / 2
    share = F.try_divide(F.col("score") / 2 - F.col("low") / 2, width)  # null or NaN where the width is none or without end
    inner = F.least(F.lit(cells - 1), F.floor(F.coalesce(F.nanvl(share, F.lit(0.5)), F.lit(0.5)) * cells).cast("int"))
    part = F.when(F.col("score") == F.col("high"), cells - 1).when(F.col("score") == F.col("low"), 0).otherwise(inner)
    return F.when(F.col("by_power"), _power()).otherwise(part)


def _cells(rows: DataFrame, by: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    hit = F.when(F.col("label") > 0.5, 1)
    return rows.groupBy(*by, *extra).agg(F.count("*").alias("rows"), F.count(hit).alias("hits"), F.min("score").alias("least"), F.max("score").alias("most"))


def binned_counts(
    df: DataFrame, bins: int, score: str = "score", label: str = "label", by: Sequence[str] = (), error: float = 0.0,
) -> DataFrame:
    """The counts of :func:`threshold_counts` at no more than ``bins`` thresholds, for each value of the columns ``by``.

    With n rows the thresholds are the scores at the descending ranks ceil(n / bins), ceil(2n / bins) and so on, n being the last,
    each score once; a bin holds the rows from its threshold up to the next higher one, so rows of equal score are never
    parted. ``error`` allows a threshold to be a score whose rank misses the wanted one by less than that share of n, which
    saves rounds; 0 makes all of them exact. The counts are exact for the thresholds that are returned in either case.
    As many rows as there are groups times bins come to the driver, and at most :data:`CELLS` counts in each round.
    """
    if bins < 1 or not 0 <= error < 1:
        raise ValueError("bins must be at least 1 and error a share below 1")
    spark, by = df.sparkSession, list(by)
    rows = materialize(checked(df, score, label, by), "judged")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    whole = _cells(rows, by).collect()
    totals = {tuple(r[c] for c in by): (r["rows"], r["hits"]) for r in whole}
    cuts: dict[tuple, dict[float, tuple[int, int]]] = defaultdict(dict)  # group -> threshold -> rows, hits at or above it
    pending: list[_Open] = []

    def settle(cell: _Open, size: int, hits: int) -> None:
        """Take the cell's least score for its ranks if no other is nearer than allowed, or leave it open."""
        if cell.low == cell.high or size <= error * totals[cell.group][0]:
            cuts[cell.group][cell.low] = (cell.above[0] + size, cell.above[1] + hits)
        else:
            pending.append(cell)

    for r in whole:
        if r["rows"]:
            ranks = sorted({-(-j * r["rows"] // bins) for j in range(1, bins + 1)})
            settle(_Open(tuple(r[c] for c in by), r["least"], r["most"], (0, 0), ranks, r["rows"]), r["rows"], r["hits"])

    place = ", ".join([*[f"`_by_{c}` {kinds[c]}" for c in by], "_cell bigint", "low double", "high double", "by_power boolean", "_next bigint"])
    left = rows.withColumn("_cell", F.lit(0).cast("long"))
    done = None
    numbered = [(cell, 0) for cell in pending]
    while numbered:
        open_cells = spark.createDataFrame([(*c.group, k, c.low, c.high, c.by_power, i) for i, (c, k) in enumerate(numbered)], place)
        same = F.col("left._cell") == F.col("open._cell")
        for c in by:
            same = same & F.col(f"left.{c}").eqNullSafe(F.col(f"open._by_{c}"))
        n_cells = max(16, CELLS // len(numbered))
        # No more open cells than groups times bins, which the driver holds already.
        inside = left.alias("left").join(F.broadcast(open_cells).alias("open"), same).select(*[f"left.{c}" for c in by], "score", "label", "_next", "low", "high", "by_power")
        inside = inside.withColumn("_digit", _digit(n_cells))
        found: dict[int, list] = defaultdict(list)
        for r in _cells(inside, ["_next", "_digit"]).collect():
            found[r["_next"]].append(r)
        pending, following = [], []
        for i, (cell, _) in enumerate(numbered):
            above, ranks = cell.above, list(cell.ranks)
            for r in sorted(found[i], key=lambda r: -r["_digit"]):
                own = [k for k in ranks if above[0] < k <= above[0] + r["rows"]]
                if own:
                    before = len(pending)
                    part = _Open(cell.group, r["least"], r["most"], above, own, r["rows"])
                    part.by_power = not cell.by_power and 2 * part.size > cell.size and part.wide()
                    settle(part, r["rows"], r["hits"])
                    if len(pending) > before:
                        following.append((i, r["_digit"], len(following)))
                above = (above[0] + r["rows"], above[1] + r["hits"])
        numbered = [(cell, k) for k, cell in enumerate(pending)]
        if numbered:
            kept = F.broadcast(spark.createDataFrame(following, "_next bigint, _digit int, _cell bigint"))
            left, done = _stage(inside.join(kept, ["_next", "_digit"]).select(*by, "score", "label", "_cell"), done)
    if done is not None:
        drop_path(spark, done)

    out = []
    for group, at in cuts.items():
        n, hits, seen = totals[group][0], totals[group][1], (0, 0)
        for threshold, (all_rows, all_hits) in sorted(at.items(), reverse=True):
            pos = all_hits - seen[1]
            out.append((*group, threshold, pos, all_rows - seen[0] - pos, all_hits, all_rows - all_hits, hits, n - hits))
            seen = (all_rows, all_hits)
    return spark.createDataFrame(out, ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "threshold double", *[f"{c} bigint" for c in _COUNTS[1:]]]))


def _stage(rows: DataFrame, done: str | None) -> tuple[DataFrame, str]:
    """What is left for the next round, written, and where; the last round's table is removed."""
    path = new_path(rows.sparkSession, "open")
    rows.write.parquet(path)
    if done is not None:
        drop_path(rows.sparkSession, done)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), path
