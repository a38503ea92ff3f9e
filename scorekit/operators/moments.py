"""Means and deviations that do not depend on the order in which rows are added up.

A double is a whole number times a power of two. Values are grouped by their power; within one, the whole numbers and
their squares add up as integers, in parts that are small enough for a long. Such sums are exact, so partitions, retries
and engines of any size give the same ones, and one pass over the rows is enough. The few sums per column are put
together as fractions, and only the result is rounded.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Whole numbers have up to 55 bits: 27 below, 28 above. Their products are cut once more at 28 bits, which leaves room for
# the sums of 2^35 values of one column and power; more of them raise an overflow.
LOW, PART = 27, 28
LEAST_POWER = -1074  # of the smallest double


@dataclass(frozen=True)
class Moments:
    """One column: values that are not null, their mean, sample deviation, least and greatest. Without values, and for
    the deviation of one value, there is none. A NaN or an infinity makes mean and deviation what arithmetic makes them."""

    count: int
    mean: float | None
    std: float | None
    least: float | None
    greatest: float | None


def _scaled(value: Column, power: Column) -> Column:
    """``value / 2^power * 2^53`` as a whole number, in two steps where the factor is beyond a double."""
    first = F.least(53 - power, F.lit(1000))
    return (value * F.pow(F.lit(2.0), first) * F.pow(F.lit(2.0), 53 - power - first)).cast("bigint")


def _sums(pairs: DataFrame) -> DataFrame:
    """``column, power`` and the exact sums of ``pairs`` (column, value); power is null for what is no finite number."""
    finite = (F.abs(F.col("value")) < float("inf")) & ~F.isnan("value")
    near = F.floor(F.log2(F.abs(F.col("value")))).cast("int")  # may be one off, for which a bit is spare
    power = F.when(F.col("value") == 0, LEAST_POWER).when(finite, F.greatest(near, F.lit(LEAST_POWER)))
    units = pairs.where("value IS NOT NULL").withColumn("power", power).withColumn("m", F.when(F.col("power").isNotNull(), _scaled(F.col("value"), F.col("power"))))
    parts = units.select("column", "power", "value", F.shiftright("m", LOW).alias("h"), F.col("m").bitwiseAND((1 << LOW) - 1).alias("l"))
    products = {"hh": F.col("h") * F.col("h"), "hl": F.col("h") * F.col("l"), "ll": F.col("l") * F.col("l")}
    cut = {}
    for name, p in products.items():
        cut |= {f"{name}1": F.shiftright(p, PART), f"{name}0": p.bitwiseAND((1 << PART) - 1)}
    return parts.groupBy("column", "power").agg(
        F.count("*").alias("n"), F.sum("h").alias("h"), F.sum("l").alias("l"), *[F.sum(c).alias(k) for k, c in cut.items()],
        F.min("value").alias("least"), F.max("value").alias("greatest"), F.sum(F.when(F.col("power").isNull(), F.col("value"))).alias("odd"))


def _rounded(value: Fraction) -> float:
    try:
        return float(value)
    except OverflowError:
        return math.inf if value > 0 else -math.inf


def _root(value: Fraction) -> float:
    """The square root, also of what a double cannot hold."""
    if value <= 0:
        return 0.0
    shift = (value.numerator.bit_length() - value.denominator.bit_length()) // 2
    return math.ldexp(math.sqrt(value / Fraction(4) ** shift), shift)


def exact_moments(pairs: DataFrame) -> dict[int, Moments]:
    """The :class:`Moments` of each ``column`` of ``pairs`` (column int, value double) that has values. One pass; as many rows
    come to the driver as there are columns and powers of two among their values, 2,100 for a column at most."""
    found = defaultdict(list)
    for r in _sums(pairs).collect():
        found[r["column"]].append(r)
    out = {}
    for column, rows in found.items():
        n = sum(r["n"] for r in rows)
        total = squares = Fraction(0)
        for r in rows:
            if r["power"] is None:
                continue
            unit = Fraction(2) ** (r["power"] - 53)
            total += ((r["h"] << LOW) + r["l"]) * unit
            whole = {k: (r[f"{k}1"] << PART) + r[f"{k}0"] for k in ("hh", "hl", "ll")}
            squares += ((whole["hh"] << 2 * LOW) + (whole["hl"] << LOW + 1) + whole["ll"]) * unit * unit
        odd = [r["odd"] for r in rows if r["power"] is None]
        order = lambda v: (math.isnan(v), v)  # noqa: E731 - NaN is the greatest, as everywhere in Spark
        ends = min((r["least"] for r in rows), key=order), max((r["greatest"] for r in rows), key=order)
        if odd:
            out[column] = Moments(n, odd[0], math.nan if n > 1 else None, *ends)
        else:
            out[column] = Moments(n, _rounded(total / n), _root((squares - total * total / n) / (n - 1)) if n > 1 else None, *ends)
    return out
