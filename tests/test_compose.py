import pytest
from pyspark.sql import functions as F

from scorekit.operators import compose


def test_rescale_and_back(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (-0.05,), (1.2,), (None,)], "p double")
    rows = df.select(compose.rescale_score("p").alias("s"), compose.rescale_score("p", clamp=True).alias("c"))
    assert [tuple(r) for r in rows.collect()] == [(350, 350), (850, 850), (325, 350), (950, 850), (None, None)]
    back = rows.select(compose.unscale_score("s").alias("p")).collect()
    assert [r["p"] for r in back][:2] == [0.0, 1.0]


def test_blend_and_total(spark):
    df = spark.createDataFrame(
        [(400.0, 500.0, 600.0, 700.0, 800.0)],
        "score_people double, score_consuming double, score_fanacial double, score_interaction double, score_relation double")
    out = df.select(compose.weighted_total().alias("t"), compose.blend_scores("score_people", "score_consuming").alias("b")).collect()[0]
    assert abs(out["t"] - (120 + 125 + 120 + 105 + 80)) < 1e-9 and abs(out["b"] - 440) < 1e-9


def _pairs(spark, left, right):
    out = compose.positional_concat(left, right)
    return sorted(tuple(r) for r in out.collect())


def test_concat_pairs_by_position_across_partitionings(spark):
    n = 5000
    left = spark.range(n).repartitionByRange(7, "id").sortWithinPartitions("id").select("id")
    right = spark.range(n).select((F.col("id") * 2).alias("twice")).repartitionByRange(3, "twice").sortWithinPartitions("twice")
    assert _pairs(spark, left, right) == [(i, 2 * i) for i in range(n)]


def test_concat_with_empty_partitions(spark):
    left = spark.range(0, 600, 1, 12).filter(F.col("id") % 600 >= 300)
    right = spark.range(0, 300, 1, 5).select(F.col("id").alias("other"))
    assert _pairs(spark, left, right) == [(300 + i, i) for i in range(300)]


def test_concat_allows_repeated_names(spark):
    a = spark.range(3).select(F.col("id").alias("x"))
    twice = compose.positional_concat(a, a)
    assert twice.columns == ["x", "x"]
    thrice = compose.positional_concat(twice, a)
    assert thrice.columns == ["x", "x", "x"] and sorted(tuple(r) for r in thrice.collect()) == [(0, 0, 0), (1, 1, 1), (2, 2, 2)]


def test_concat_keeps_row_order_when_folded(spark):
    n = 3000
    frames = [spark.range(0, n, 1, p).select((F.col("id") + k * n).alias(f"x{k}")) for k, p in enumerate((4, 9, 1))]
    folded = compose.positional_concat(compose.positional_concat(frames[0], frames[1]), frames[2])
    expected = [(i, n + i, 2 * n + i) for i in range(n)]
    assert [tuple(r) for r in folded.collect()] == expected
    assert [tuple(r) for r in compose.positional_concat(*frames).collect()] == expected


def test_concat_refuses_unequal_counts(spark):
    with pytest.raises(ValueError, match=r"cannot pair frames of \[3, 4\] rows"):
        compose.positional_concat(spark.range(3), spark.range(4))


def test_row_positions_are_gapless(spark):
    df = spark.range(0, 100, 1, 9).filter(F.col("id") % 7 != 0)
    out = compose.row_positions(df).orderBy("position").collect()
    assert [r["position"] for r in out] == list(range(len(out)))
    assert [r["id"] for r in out] == sorted(r["id"] for r in out)
