"""Column expressions: safe ratios, casts, fills, recodes, arrays and maps. All stay inside Catalyst."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- numbers -------------------------------------------------------------------------------------------------

def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """``numerator / denominator``, null where the denominator is zero or either side is null."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


def ratio_default_one(denominator: Column | str, numerator: Column | str) -> Column:
    """Floating-point ratio: x/0 keeps its signed infinity, while 0/0, NaN and null become 1.0."""
    n, d = _col(numerator).cast("double"), _col(denominator).cast("double")
    by_zero = (
        F.when(n > 0, F.lit(float("inf"))).when(n < 0, F.lit(float("-inf")))
    )
    quotient = F.when(F.isnan(n) | F.isnan(d), None).when(d == 0, by_zero).otherwise(F.try_divide(n, d))
    return fill_value(quotient, 1.0)


def fill_value(c: Column | str, value: float) -> Column:
    """Null and NaN become ``value``; infinities stay."""
    c = _col(c).cast("double")
    return F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(float(value)))


def fill_numeric(df: DataFrame, value: float, subset: Iterable[str] | None = None) -> DataFrame:
    """Fill null and NaN in every numeric column (or in those of ``subset``); other columns are left alone."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]
    if subset is not None:
        wanted = set(subset)
        names = [n for n in names if n in wanted]
    return df.na.fill(value, names) if names else df


def to_double(c: Column | str) -> Column:
    """Text to double, null where the text is not a number."""
    return _col(c).try_cast("double")


def int_div_and_sum(left: Column | str, right: Column | str) -> tuple[Column, Column]:
    """Whole-number quotient (null on a zero divisor) and sum."""
    a, b = _col(left), _col(right)
    # A zero divisor turns into null before the division, so ANSI mode has nothing to raise.
    quotient = F.call_function("div", a, F.nullif(b, F.lit(0)))
    return quotient, a + b


# --- recodes and scalars -------------------------------------------------------------------------------------

def recode_clamp_zero(c: Column | str) -> Column:
    """Above 3 becomes 3, zero becomes 1, anything else stays; null stays null."""
    x = _col(c)
    return F.when(x > 3, F.lit(3)).when(x == 0, F.lit(1)).otherwise(x)


def recode_cap(c: Column | str) -> Column:
    """Above 3 becomes 3; null stays null (``least`` would turn it into 3)."""
    x = _col(c)
    return F.when(x > 3, F.lit(3)).otherwise(x)


def factorial(c: Column | str) -> Column:
    """n! as ``decimal(38,0)``, 1 for n <= 1. Exact through 33!; a larger n raises rather than giving null."""
    n = _col(c)
    table = F.array(*[F.lit(str(math.factorial(i))).cast("decimal(38,0)") for i in range(34)])
    too_large = F.raise_error(F.lit("factorial above 33 exceeds decimal(38,0)")).cast("decimal(38,0)")
    return F.when(n > 33, too_large).otherwise(F.get(table, F.when(n < 0, 0).otherwise(n).cast("int")))


def split_fields(line: Column | str, delimiter: str = ",", drop_trailing_empty: bool = False) -> Column:
    """Fields of a delimited line; optionally without the empty fields at its end."""
    literal = "\\Q" + delimiter + "\\E"
    text = _col(line)
    if drop_trailing_empty:
        text = F.regexp_replace(text, f"({literal})+$", "")
    return F.split(text, literal)


# --- arrays --------------------------------------------------------------------------------------------------

def array_affine(arr: Column | str) -> Column:
    """x*2+1 for each element."""
    return F.transform(_col(arr), lambda x: x * 2 + 1)


def array_square(arr: Column | str) -> Column:
    """x squared for each element, as ``decimal(38,0)`` so that large integers do not overflow."""
    def square(x: Column) -> Column:
        wide = x.cast("decimal(19,0)")
        return (wide * wide).cast("decimal(38,0)")

    return F.transform(_col(arr), square)


def array_add(arr: Column | str, amount: int | None = None) -> Column:
    """x+amount for each element, or x+x*x when no amount is given."""
    if amount is None:
        return F.transform(_col(arr), lambda x: x + x * x)
    return F.transform(_col(arr), lambda x: x + amount)


# --- maps ----------------------------------------------------------------------------------------------------

def row_to_map(*names: str) -> Column:
    """Chosen columns of a row as a string map, column name to value."""
    pairs: list[Column] = []
    for name in names:
        pairs += [F.lit(name), F.col(name).cast("string")]
    return F.create_map(*pairs)


def map_keys_rows(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row per key of the map in ``column``."""
    return df.select(*keep, F.explode(F.map_keys(column)).alias("key"))


def map_entries_rows(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row per entry of the map in ``column``."""
    return df.select(*keep, F.explode(column).alias("key", "value"))


def map_lookup(m: Column | str, key: Column | str | int, strict: bool = False) -> Column:
    """The value at ``key`` (a literal, or a column expression); a miss is null, or an error when ``strict``."""
    m = _col(m)
    k = key if isinstance(key, Column) else F.lit(key)
    value = F.try_element_at(m, k)
    if not strict:
        return value
    missing = F.raise_error(F.concat(F.lit("key not found: "), k.cast("string")))
    # A null map or a key that is absent raises; a key that is present with a null value does not.
    return F.when(F.coalesce(F.map_contains_key(m, k), F.lit(False)), value).otherwise(missing)


# --- rows as text --------------------------------------------------------------------------------------------

def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("null"))


def row_to_text(name: str, age: str) -> dict[str, Column]:
    """A row as labelled text in four spellings; null is spelt ``null``."""
    return {
        "by_index": F.concat(F.lit("name:"), _text(name), F.lit(" age:"), _text(age)),
        "by_name": F.concat(F.lit("name:"), _text(name), F.lit(" age:"), _text(age)),
        "whole_row": F.concat(F.lit("name:["), _text(name), F.lit(","), _text(age), F.lit("]")),
        "name_only": F.concat(F.lit("name:"), _text(name)),
    }
