import math
import random
import statistics
from fractions import Fraction
from functools import reduce
from operator import add

import pytest
from pyspark.sql import functions as F

from scorekit.operators.features import assemble
from scorekit.operators.moments import Moments, exact_moments
from scorekit.operators.profile import describe_numeric
from scorekit.operators.scaling import fit_scaler

RNG = random.Random(8)
COLUMNS = {
    "unit": [RNG.random() for _ in range(500)],
    "cancels": [1e16, 1.0, -1e16] * 100 + [0.5],
    "offset": [1e9 + RNG.random() for _ in range(300)],
    "powers": [math.ldexp(RNG.choice([1.0, 1 - 2**-53, 1 + 2**-52]) * RNG.choice([-1, 1]), k) for k in range(-60, 60)],
    "huge": [1.7e308, 1.6e308, -1.5e308, 3.0],
    "small": [5e-300 * RNG.random() for _ in range(60)] + [0.0, -0.0],
    "whole": [float(RNG.randrange(-(2**53), 2**53)) for _ in range(200)],
    "constant": [0.1] * 77,
    "one": [3.5],
}


def exact(values):
    xs = [Fraction(v) for v in values]
    mean = sum(xs) / len(xs)
    return mean, sum((x - mean) ** 2 for x in xs) / (len(xs) - 1) if len(xs) > 1 else None


def pairs(spark, columns=COLUMNS):
    rows = [(i, v) for i, vs in enumerate(columns.values()) for v in vs]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "column int, value double")


def test_equal_to_fractions(spark):
    got = exact_moments(pairs(spark))
    for i, (name, values) in enumerate(COLUMNS.items()):
        mean, var = exact(values)
        m = got[i]
        assert (m.count, m.least, m.greatest) == (len(values), min(values), max(values)), name
        assert m.mean == float(mean), name
        if var is None:
            assert m.std is None
        else:
            root = statistics._float_sqrt_of_frac(var.numerator, var.denominator) if var else 0.0
            assert math.isclose(m.std, root, rel_tol=4e-16), name


@pytest.mark.parametrize("n", [1, 7, 40])
def test_partitions_do_not_matter(spark, n):
    assert exact_moments(pairs(spark).repartition(n)) == exact_moments(pairs(spark).coalesce(1))


def test_a_sum_of_doubles_would_differ(spark):
    """The column whose ends cancel: in plain doubles its mean depends on the order."""
    m = exact_moments(pairs(spark, {"c": COLUMNS["cancels"]}))[0]
    assert m.mean == 100.5 / 301 and reduce(add, COLUMNS["cancels"]) != 100.5


def test_nulls_and_what_is_no_number(spark):
    rows = [(0, None), (1, 1.0), (1, None), (2, float("nan")), (2, 1.0), (3, float("inf")), (3, 2.0), (4, float("inf")), (4, float("-inf"))]
    got = exact_moments(spark.createDataFrame(rows, "column int, value double"))
    assert 0 not in got and got[1] == Moments(1, 1.0, None, 1.0, 1.0)
    assert math.isnan(got[2].mean) and got[2].least == 1.0 and math.isnan(got[2].greatest)
    assert got[3].mean == math.inf and math.isnan(got[3].std) and math.isnan(got[4].mean)
    assert exact_moments(spark.createDataFrame([], "column int, value double")) == {}


def test_profile_and_scaler_are_the_same_on_any_partitioning(spark, users):
    names = ["pro_customervalue", "ord_success_max_order_amount", "uid_age"]
    frames = [users.repartition(n).sortWithinPartitions(F.rand(n)) for n in (1, 7)]
    a, b = (sorted(map(tuple, describe_numeric(f, names).collect())) for f in frames)
    assert a == b and len(a) == 3
    filled = [assemble(f.fillna(0.0).select(*[F.col(n).cast("double").alias(n) for n in names]), names) for f in frames]
    x, y = (fit_scaler(f) for f in filled)
    assert list(x.mean) == list(y.mean) and list(x.std) == list(y.std)


def test_scaler_survives_saving(spark, tmp_path):
    from pyspark.ml.feature import StandardScalerModel

    df = assemble(spark.createDataFrame([(1.0, 2.0), (4.0, 2.0)], "a double, b double"), ["a", "b"])
    model = fit_scaler(df, output_col="out")
    model.save(str(tmp_path / "scaler"))
    back = StandardScalerModel.load(str(tmp_path / "scaler"))
    assert back.transform(df).collect() == model.transform(df).collect() and back.getWithMean() and back.getWithStd()
    with pytest.raises(ValueError, match="no rows"):
        fit_scaler(df.limit(0))
