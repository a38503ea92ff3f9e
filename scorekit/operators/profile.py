"""Counts, summaries, first rows and schema listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import _NUMERIC
from ..staging import literal_rows
from .moments import Moments, exact_moments


def group_count(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"))


def describe_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, count, mean, stddev, min, max`` as numbers, one row per column.

    One scan however wide the frame is: each row is turned into (column, value) pairs, which are combined per column
    before the shuffle. Sums are exact (:mod:`.moments`), so the result does not depend on how rows are partitioned. A column
    without values has a count of 0 and nulls. The scan runs when this is called.
    """
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]
    if not columns:
        raise ValueError("no numeric columns")
    return moments_table(df.sparkSession, columns, exact_moments(column_values(df, columns)))


def column_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, value``: each cell of the columns with its column's number."""
    cells = [F.struct(F.lit(i).alias("column"), F.col(_quoted(n)).cast("double").alias("value")) for i, n in enumerate(columns)]
    return df.select(F.inline(F.array(*cells)))


def moments_table(spark: SparkSession, columns: list[str], found: dict[int, Moments]) -> DataFrame:
    """``column, count, mean, stddev, min, max``, one row per column."""
    empty = Moments(0, None, None, None, None)
    rows = [(n, *(getattr(found.get(i, empty), k) for k in ("count", "mean", "std", "least", "greatest"))) for i, n in enumerate(columns)]
    return spark.createDataFrame(rows, "column string, count bigint, mean double, stddev double, min double, max double")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rows(wide: DataFrame, n: int) -> DataFrame:
    """One row per struct column ``_0`` to ``_<n-1>`` of a single-row frame."""
    return wide.select(F.inline(F.array(*[f"_{i}" for i in range(n)])))


def head_rows(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first ``n`` rows; with an order, a distributed top-n."""
    return (df.orderBy(*order) if order else df).limit(n)


def schema_listing(df: DataFrame) -> DataFrame:
    """``position, name, type`` of each column; metadata only."""
    rows = [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)]
    return literal_rows(df.sparkSession, ["position", "name", "type"], rows)


def schema_profile(df: DataFrame) -> DataFrame:
    """The schema listing with the number of non-null values of each column, counted in one pass."""
    counts = [
        F.expr(
            f"named_struct('position', {i}, 'name', {_literal(name)}, 'type', {_literal(kind)}, "
            f"'non_null', count({_quoted(name)}))"
        ).alias(f"_{i}")
        for i, (name, kind) in enumerate(df.dtypes)
    ]
    return _rows(df.agg(*counts), len(counts))
