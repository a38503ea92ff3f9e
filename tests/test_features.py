import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from scorekit.operators.features import GROUPS, assemble, assemble_labeled, assemble_vector, group_features, raw_columns
from scorekit.operators.models import train_group, TreeParams
from scorekit.operators.scaling import fit_scaler, min_max_scale, unpack
from scorekit.operators.moments import _sums
from scorekit.operators.profile import column_values, describe_numeric, schema_listing, schema_profile, head_rows, group_count


def group_rows(spark, spec, rows, label=1):
    """Rows of the group's raw columns: zeros but for the given values."""
    names = raw_columns(spec)
    data = [tuple(r.get(n, 0.0) for n in names) + (r.get("uid_flag", label), i) for i, r in enumerate(rows)]
    schema = ", ".join(f"{n} double" for n in names) + ", uid_flag int, uid_uid int"
    return spark.createDataFrame(data, schema)


def test_group_shapes():
    assert {n: len(g.features) for n, g in GROUPS.items()} == {
        "people": 20, "consuming": 29, "financial": 21, "interaction": 8, "relation": 4}
    assert math.isclose(sum(g.weight for g in GROUPS.values()), 1.0)
    assert len({f for g in GROUPS.values() for f in g.features}) == 68
    assert len({f for g in GROUPS.values() for f in g.derived}) == 14


def test_consuming_fill_differs_by_phase(spark):
    spec = GROUPS["consuming"]
    nan = float("nan")
    df = group_rows(spark, spec, [
        {"ord_success_order_amount": 10.0, "ord_success_order_count": 4.0},
        {"ord_success_order_amount": None, "ord_success_order_count": 0.0},
        {"ord_success_order_amount": 10.0, "ord_success_order_count": 0.0},
        {"ord_success_order_amount": 10.0, "ord_success_order_count": None},
        {"pro_advanced_date": nan, "ord_success_order_amount": nan, "ord_success_order_count": 2.0},
        {"pro_advanced_date": float("inf"), "ord_success_order_amount": 1.0, "ord_success_order_count": 1.0},
    ])
    train = [(r["ord_success_order_price"], r["pro_advanced_date"]) for r in group_features(df, spec, True).collect()]
    score = [(r["ord_success_order_price"], r["pro_advanced_date"]) for r in group_features(df, spec, False).collect()]
    assert train == [(2.5, 0.0), (-1.0, 0.0), (-1.0, 0.0), (-1.0, 0.0), (-1.0, -1.0), (1.0, math.inf)]
    assert score == [(2.5, 0.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0), (1.0, math.inf)]


def test_balance_counts_the_wallet_twice(spark):
    spec = GROUPS["financial"]
    df = group_rows(spark, spec, [
        {"cap_tmoney_balance": 1.0, "cap_wallet_balance": 10.0}, {"cap_tmoney_balance": 1.0, "cap_wallet_balance": None},
        {"bil_paysord_count": 3.0, "bil_payord_count": 4.0}])
    rows = group_features(df, spec, True).collect()
    assert [r["cap_balance"] for r in rows] == [21.0, 0.0, 0.0]
    assert rows[2]["bil_pays_ratio"] == 0.75


def test_null_label_raises(spark):
    df = group_rows(spark, GROUPS["consuming"], [{"uid_flag": None}])
    with pytest.raises(Exception, match="null label"):
        group_features(df, GROUPS["consuming"], True).collect()


def test_gaps_raise_where_the_group_does_not_fill(spark):
    df = group_rows(spark, GROUPS["relation"], [{}, {"com_idno_count": None}])
    features = group_features(df, GROUPS["relation"], False)
    with pytest.raises(Exception):
        assemble_vector(features).collect()


def test_text_numbers_and_int_labels_assemble(spark):
    df = spark.createDataFrame([("1.5", 2, 1), ("2", 3, 0)], "a string, b int, y int")
    out = assemble_labeled(df, "y").select("label", vector_to_array("features").alias("v")).collect()
    assert [(r["label"], r["v"]) for r in out] == [(1.0, [1.5, 2.0]), (0.0, [2.0, 3.0])]
    bad = spark.createDataFrame([("x", 1)], "a string, y int")
    with pytest.raises(Exception):
        assemble_labeled(bad, "y").collect()


def test_scaler_uses_sample_deviation_and_zeroes_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, c double")
    assembled = assemble(df, ["x", "c"])
    model = fit_scaler(assembled)
    assert list(model.mean) == [2.0, 5.0] and list(model.std) == [1.0, 0.0]
    rows = [tuple(r) for r in unpack(model.transform(assembled), "scaled", ["x", "c"]).collect()]
    assert rows == [(-1.0, 0.0), (0.0, 0.0), (1.0, 0.0)]


def test_min_max(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (5.0, 5.0)], "x double, c double")
    _, out = min_max_scale(df, ["x", "c"])
    assert [tuple(r) for r in unpack(out, "scaled", ["x", "c"]).collect()] == [(0.0, 0.5), (0.25, 0.5), (1.0, 0.5)]


def test_profiles(spark, sf_dir):
    df = spark.createDataFrame([(1, "a", 2.0), (3, None, None)], "i int, s string, `odd ``name'` double")
    out = {r["column"]: r for r in describe_numeric(df).collect()}
    assert set(out) == {"i", "odd `name'"}
    assert (out["i"]["count"], out["i"]["mean"], out["i"]["min"], out["i"]["max"]) == (2, 2.0, 1.0, 3.0)
    assert math.isclose(out["i"]["stddev"], math.sqrt(2))
    assert out["odd `name'"]["count"] == 1 and out["odd `name'"]["stddev"] is None
    many = spark.range(3).selectExpr(*[f"id + {k} AS c{k}" for k in range(30)])
    wide = {r["column"]: r["mean"] for r in describe_numeric(many).collect()}
    assert wide == {f"c{k}": k + 1.0 for k in range(30)}
    assert [r["count"] for r in describe_numeric(many.limit(0)).collect()] == [0] * 30
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    read = _sums(column_values(orders, ["o_orderkey", "o_custkey", "o_totalprice"]))._jdf.queryExecution().executedPlan().toString()
    assert read.count("FileScan") == 1
    with pytest.raises(ValueError):
        describe_numeric(df.select("s"))
    assert [tuple(r) for r in schema_listing(df).collect()][1] == (1, "s", "string")
    assert [r["non_null"] for r in schema_profile(df).orderBy("position").collect()] == [2, 1, 1]
    assert head_rows(df, 1, F.desc("i")).collect()[0]["i"] == 3
    assert {(r["s"], r["count"]) for r in group_count(df, "s").collect()} == {("a", 1), (None, 1)}


def test_training_needs_no_label_fill(spark):
    """A group with a missing label cannot be trained by accident."""
    df = group_rows(spark, GROUPS["relation"], [{"com_idno_count": 1.0}, {"uid_flag": None}])
    with pytest.raises(Exception, match="null label"):
        train_group(df, GROUPS["relation"], TreeParams(rf_trees=1, rf_depth=1))
