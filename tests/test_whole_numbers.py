import math
import random
import time

import pytest
from pyspark.sql import functions as F

from scorekit.functions.whole_numbers import digits_of, factorial_digits, limbs_of, square_digits


def one(df):
    return [r[0] for r in df.collect()]


def test_factorials_of_any_size(spark):
    ns = [None, -3, 0, 1, 2, 3, 12, 13, 20, 21, 25, 26, 33, 34, 50, 100, 253, 1000]
    got = one(spark.createDataFrame([(i, n) for i, n in enumerate(ns)], "i int, n int").orderBy("i").select(factorial_digits("n")))
    assert got == [None if n is None else str(math.factorial(max(n, 0))) for n in ns]


def test_squares_of_any_size(spark):
    rng = random.Random(5)
    texts = ["0", "-0", "7", "+12", "-999999", "1000000", "000123", "9" * 30, "-" + "9" * 61, "1" + "0" * 40, str(2**63), "9" * 600]
    texts += [str(rng.randrange(10 ** rng.randrange(1, 90))) for _ in range(60)] + [None]
    got = one(spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(square_digits("t")))
    assert got == [None if t is None else str(int(t) ** 2) for t in texts]


@pytest.mark.parametrize("text", ["", "1.5", "x", "1 2", "--1", "1e3"])
def test_what_is_no_whole_number_raises(spark, text):
    with pytest.raises(Exception, match="no whole number"):
        spark.createDataFrame([(text,)], "t string").select(square_digits("t")).collect()


def test_limbs_there_and_back(spark):
    texts = ["0", "00", "1", "999999", "1000000", "123456789012", "7" * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    assert one(df.select(digits_of(limbs_of("t")))) == [str(int(t)) for t in texts]
    assert one(df.limit(1).select(limbs_of("t"))) == [[]]


def test_the_work_stays_in_the_engine(spark):
    plan = spark.range(1).select(factorial_digits("id"), square_digits("id"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_factorials_where_groups_of_factors_change(spark):
    ns = [-(2**63), 18, 19, 20, 21, 22, 26, 27, 32, 44, 45, 46, 47, 96, 97, 98, 307, 308, 309, 2080, 2081]
    got = one(spark.createDataFrame(list(enumerate(ns)), "i int, n bigint").orderBy("i").select(factorial_digits("n")))
    assert got == [_factorial_text(n) for n in ns]


def test_many_factors_are_multiplied_in_at_once(spark):
    """33! costs a few multiplications of limbs, not 32."""
    def seconds(n: int) -> float:
        rows = spark.range(40_000).repartition(4).select(factorial_digits(F.lit(n) + F.col("id") * 0).alias("digits"))
        took = []
        for _ in range(3):
            start = time.monotonic()
            rows.write.format("noop").mode("overwrite").save()
            took.append(time.monotonic() - start)
        return min(took)

    assert seconds(33) < 15 * max(seconds(2), 0.05)


def _factorial_text(n: int) -> str:
    """n! without Python's limit on the length of digits."""
    value, parts = math.factorial(max(n, 0)), []
    while value >= 10**1000:
        value, low = divmod(value, 10**1000)
        parts.append(str(low).zfill(1000))
    return "".join([str(value), *reversed(parts)])
