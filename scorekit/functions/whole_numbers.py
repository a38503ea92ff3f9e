"""Whole numbers of any length, as columns.

A number is an array of limbs, the lowest first, and no zero on top; 0 is an empty array. Limbs have nine decimal digits
where a number is multiplied by a small one, and six where two long ones are, so that sums of products fit a long with
carries to spare. Signs are kept outside.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALL_DIGITS, LONG_DIGITS = 9, 6


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def _carried(limbs: Column, digits: int) -> Column:
    """Limbs of any size brought below their base, each passing on to the next what it has too much."""
    base = F.lit(10**digits).cast("bigint")
    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("out"))

    def add(acc: Column, limb: Column) -> Column:
        total = acc["carry"] + limb
        return F.struct(F.call_function("div", total, base).alias("carry"), F.concat(acc["out"], F.array(total % base)).alias("out"))

    def rest(acc: Column) -> Column:
        # What is left has at most 19 digits.
        tops = [F.call_function("div", acc["carry"], F.lit(10 ** (digits * i)).cast("bigint")) % base for i in range(-(-19 // digits)) if digits * i < 19]
        return _trimmed(F.concat(acc["out"], F.array(*tops)))

    return F.aggregate(limbs, start, add, rest)


def _trimmed(limbs: Column) -> Column:
    """Limbs without the zeros on top."""
    top = F.aggregate(F.transform(limbs, lambda x, i: F.when(x != 0, i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    return _let(top, lambda n: F.slice(limbs, F.lit(1), n))


def limbs_of(text: Column | str, digits: int = LONG_DIGITS) -> Column:
    """The limbs of a run of decimal digits."""
    t = _col(text)
    count = F.ceil(F.length(t) / F.lit(digits)).cast("int")
    # From the right, the last piece may be short.
    piece = lambda i: F.substring(t, F.greatest(F.length(t) - (i + 1) * digits, F.lit(0)) + 1, F.least(F.lit(digits), F.length(t) - i * digits))
    return F.when(F.length(t) == 0, F.array().cast("array<bigint>")).otherwise(
        _trimmed(F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: piece(i).cast("bigint"))))


def digits_of(limbs: Column, digits: int = LONG_DIGITS) -> Column:
    """The decimal digits of limbs."""
    shown = F.transform(F.reverse(limbs), lambda x, i: F.when(i == 0, x.cast("string")).otherwise(F.lpad(x.cast("string"), digits, "0")))
    return F.when(F.size(limbs) == 0, "0").otherwise(F.array_join(shown, ""))


# The largest factorial that a long holds.
LONG_FACTORIAL = 20
# Limbs times a factor, and what is carried on top, must stay in a long: so many factors up to a bound make one below 9 * 10^9.
_GROUPS = [(45, 6), (97, 5), (308, 4), (2080, 3), (94868, 2)]


def _times(limbs: Column, k: Column) -> Column:
    """Limbs of nine digits times a factor below 9 * 10^9, without zeros on top as neither side is 0."""
    base = F.lit(10**SMALL_DIGITS).cast("bigint")
    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("out"))

    def add(acc: Column, limb: Column) -> Column:
        return _let(acc["carry"] + limb * k, lambda total: F.struct(
            F.call_function("div", total, base).alias("carry"), F.concat(acc["out"], F.array(total % base)).alias("out")))

    def rest(acc: Column) -> Column:
        over = F.when(acc["carry"] >= base, F.array(acc["carry"] % base, F.call_function("div", acc["carry"], base))).otherwise(F.array(acc["carry"]))
        return F.when(acc["carry"] == 0, acc["out"]).otherwise(F.concat(acc["out"], over))

    return F.aggregate(limbs, start, add, rest)


def factorial_digits(c: Column | str) -> Column:
    """n! in decimal digits, however many there are; 1 for n <= 1, null for null. Up to 20! the product is a long, cut into
    limbs; then as many factors as a long has room for are multiplied in at once, limb by limb. n is below 9 * 10^9, which no
    one waits for."""
    n = _col(c).cast("bigint")
    base, none = F.lit(10**SMALL_DIGITS).cast("bigint"), F.array().cast("array<bigint>")
    head = F.factorial(F.least(F.greatest(n, F.lit(0)), F.lit(LONG_FACTORIAL)).cast("int"))

    def pieces(p: Column) -> Column:
        high = F.call_function("div", p, base)
        return F.when(p < base, F.array(p)).when(high < base, F.array(p % base, high)).otherwise(
            F.array(p % base, high % base, F.call_function("div", high, base)))

    together = F.lit(1)
    for bound, many in reversed(_GROUPS):
        together = F.when(n <= bound, many).otherwise(together)
    most = max(many for _, many in _GROUPS)

    def factor(low: Column) -> Column:
        """The product of the factors from ``low`` up to the next group or n."""
        out = low
        for i in range(1, most):
            out = out * F.when((together > i) & (low + i <= n), low + i).otherwise(F.lit(1).cast("bigint"))
        return out

    first = F.lit(LONG_FACTORIAL + 1).cast("bigint")
    lows = F.when(n >= first, F.sequence(first, F.greatest(n, first), together.cast("bigint"))).otherwise(none)
    product = F.aggregate(F.transform(lows, factor), _let(head, pieces), _times)
    return F.when(n.isNotNull(), _let(product, lambda limbs: digits_of(limbs, SMALL_DIGITS)))


def square_digits(c: Column | str) -> Column:
    """The square of a whole number in decimal digits, both as text of any length. A sign is allowed; what is no whole
    number raises, null stays null."""
    text = _col(c).cast("string")
    plain = F.regexp_extract(text, r"^[+-]?([0-9]+)$", 1)
    wrong = F.raise_error(F.concat(F.lit("no whole number: "), F.substring(text, 1, 60))).cast("string")

    def squared(a: Column) -> Column:
        # Place p of the product sums all a[i] * a[p - i]: at most 10^12 each, and 9 million of them fit a long.
        def place(p: Column) -> Column:
            low = F.greatest(p - F.size(a) + 1, F.lit(0))
            return F.aggregate(F.sequence(low, p - low), F.lit(0).cast("bigint"), lambda total, i: total + F.get(a, i) * F.get(a, p - i))

        return _carried(F.transform(F.sequence(F.lit(0), F.greatest(2 * F.size(a) - 2, F.lit(0))), place), LONG_DIGITS)

    digits = _let(limbs_of(plain), lambda a: F.when(F.size(a) == 0, "0").otherwise(digits_of(squared(a))))
    return F.when(text.isNull(), F.lit(None).cast("string")).when(plain == "", wrong).otherwise(digits)
