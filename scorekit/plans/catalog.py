"""The query catalogue: each operator over the driver tables, with SQL that must give the same rows.

Model queries have no SQL form. Everything around the models is checked on a stand-in prediction, a ratio of two
columns of the user table, that both engines compute alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import whole_numbers as W
from ..operators import compose, evaluate, profile
from ..operators.binned import binned_counts
from ..operators.bundle import model_tables
from ..operators.features import GROUPS, GroupSpec, assemble, assemble_labeled, assemble_vector, group_features, raw_columns
from ..operators.models import (
    GroupModel, TreeParams, hash_bucket, hash_split, load_models, random_split, save_models, score_groups, train_group,
)
from ..operators.scaling import fit_scaler, min_max_scale, scaler_summary, unpack
from ..operators.tree_table import walk_groups, walk_scores
from ..sources import readers, sinks
from ..sources.contracts import SCORING_COLUMNS, SCORING_LABEL, TRAINING_COLUMNS, TRAINING_LABEL, USER_KEY, string_schema
from ..sources.user_table import bucketed_tables, load, scoring_table, training_table, user_table
from ..staging import literal_rows, materialize, new_path
from .credit_score import committed_scores, credit_score, keyed, score_file, train, train_and_evaluate, write_audit
from .user_table_sql import USERS_CTE

Query = Callable[[SparkSession, str], DataFrame]

@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query. SQL that reads ``users`` gets the user table's definition in front of it."""
    def add(run: Query) -> Query:
        text = sql
        if text is not None and "users" in text:
            text = f"WITH {USERS_CTE}{text}"
        CATALOG[name] = Entry(run, text)
        return run

    return add


def _group_users(spark: SparkSession, sf_dir: str, spec: GroupSpec) -> DataFrame:
    """The columns of the user table that a group reads, with key and labels."""
    return user_table(spark, sf_dir, [USER_KEY, TRAINING_LABEL, SCORING_LABEL, *raw_columns(spec)])


# --- sources and sinks ---------------------------------------------------------------------------------------

@query("csv_scan_inferred", """
SELECT o_orderkey::INT AS o_orderkey, o_custkey::INT AS o_custkey, o_orderstatus, o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d') AS o_orderday, o_orderpriority FROM orders""")
def csv_scan_inferred(spark, sf_dir):
    path = new_path(spark, "orders-csv")
    sinks.write_csv(load(spark, sf_dir, "orders"), path)
    df = readers.read_inferred(spark, path)
    return df.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderday"), "o_orderpriority",
    )


def _fits_sql(column: str, kind: str, bits: tuple[str, ...]) -> str:
    counts = ", ".join(f"{f'count({column})' if t in bits else '0::BIGINT'} AS n_{t}" for t in readers.TYPES)
    return f"SELECT '{column}' AS \"column\", '{kind}' AS type, count({column}) AS \"count\", {counts} FROM orders"


@query("inferred_types", " UNION ALL ".join(_fits_sql(c, k, b) for c, k, b in [
    ("o_orderkey", "int", ("int", "bigint", "double")), ("o_custkey", "int", ("int", "bigint", "double")), ("o_orderstatus", "string", ()),
    ("o_totalprice", "double", ("double",)), ("o_orderdate", "timestamp", ("timestamp",)), ("o_orderpriority", "string", ())]))
def inferred_types(spark, sf_dir):
    """Which types the fields of a written CSV fit, and what is inferred from it."""
    path = new_path(spark, "orders-csv")
    sinks.write_csv(load(spark, sf_dir, "orders"), path)
    return readers.inferred_types(spark.read.csv(path, header=True))


# Orders with two kinds of bad rows: a field too many where the key is a multiple of 50, a word for a price where it is one
# of 7.
@query("csv_quarantine", """
SELECT o_orderkey % 7 = 0 OR o_orderkey % 50 = 0 AS rejected, CASE WHEN o_orderkey % 50 = 0 THEN 'not 3 fields' WHEN o_orderkey % 7 = 0 THEN 'price is no double: much' END AS reason,
       count(*) AS n_rows, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY ALL""")
def csv_quarantine(spark, sf_dir):
    """Good rows and rejected ones, from one pass over a file that holds both."""
    orders = load(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderkey") % 7 == 0, "much").otherwise(F.col("o_totalprice").cast("string"))
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), price, "o_orderstatus", F.when(F.col("o_orderkey") % 50 == 0, "more"))
    path = new_path(spark, "mixed-csv")
    sinks.write_lines(orders.select(line), path)
    out = readers.read_quarantined(spark, path, T.StructType.fromDDL("key bigint, price double, status string"), header=False)
    good = out.good.select(F.lit(False).alias("rejected"), F.lit(None).cast("string").alias("reason"), "key")
    bad = out.rejected.select(F.lit(True).alias("rejected"), "reason", F.get(F.split("line", ","), F.lit(0)).cast("bigint").alias("key"))
    return good.unionByName(bad).groupBy("rejected", "reason").agg(F.count("*").alias("n_rows"), F.sum("key").alias("keys"))


@query("csv_scan_string", """
SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus,
       o_totalprice::VARCHAR AS o_totalprice, o_orderpriority FROM orders""")
def csv_scan_string(spark, sf_dir):
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    path = new_path(spark, "orders-csv")
    sinks.write_csv(load(spark, sf_dir, "orders").select(*names), path)
    return readers.read_typed(spark, path, string_schema(names))


def _contract_sql(names: list[str], known: set[str]) -> str:
    return ", ".join(f"{n}::DOUBLE AS {n}" if n in known else f"NULL::DOUBLE AS {n}" for n in names)


# Contract columns that the tables supply: whatever the groups read, the labels, and one more.
_KNOWN = {*raw_columns(*GROUPS.values()), TRAINING_LABEL, SCORING_LABEL, "ord_cancel_trn_order_count"}


@query("csv_scan_training", f"SELECT {_contract_sql(TRAINING_COLUMNS, _KNOWN)} FROM users")
def csv_scan_training(spark, sf_dir):
    path = new_path(spark, "training-csv")
    sinks.write_csv(training_table(user_table(spark, sf_dir)), path)
    text = readers.read_training_text(spark, path)
    return text.select(*[C.to_double(n).alias(n) for n in text.columns])


@query("csv_scan_double", f"SELECT {_contract_sql(SCORING_COLUMNS, _KNOWN)} FROM users")
def csv_scan_double(spark, sf_dir):
    path = new_path(spark, "scoring-csv")
    sinks.write_csv(scoring_table(user_table(spark, sf_dir)), path)
    return readers.read_scoring(spark, path)


@query("csv_scan_keyed", f"""
SELECT uid_uid::DOUBLE AS "ID", uid_uid::VARCHAR AS uid_uid, {_contract_sql(SCORING_COLUMNS, _KNOWN)} FROM users""")
def csv_scan_keyed(spark, sf_dir):
    path = new_path(spark, "scoring-csv")
    sinks.write_csv(scoring_table(user_table(spark, sf_dir), keyed=True), path)
    return readers.read_scoring_keyed(spark, path)


@query("text_records", "SELECT c_name AS name, (18 + c_custkey % 50)::INT AS age FROM customer")
def text_records(spark, sf_dir):
    path = new_path(spark, "people-text")
    age = (18 + F.col("c_custkey") % 50).cast("string")
    sinks.write_lines(load(spark, sf_dir, "customer").select(F.concat("c_name", F.lit(", "), age)), path)
    return readers.text_records(spark, path)


@query("drop_lines_containing", """
SELECT concat(o_orderkey, ',', o_orderstatus, ',', o_orderpriority) AS value FROM orders
WHERE NOT contains(concat(o_orderkey, ',', o_orderstatus, ',', o_orderpriority), 'URGENT')""")
def drop_lines_containing(spark, sf_dir):
    path = new_path(spark, "orders-text")
    orders = load(spark, sf_dir, "orders")
    sinks.write_lines(orders.select(F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")), path)
    return readers.drop_lines_containing(spark.read.text(path), "URGENT")


@query("rows_to_frame", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer")
def rows_to_frame(spark, sf_dir):
    schema = T.StructType.fromDDL("id bigint, name string, balance double")
    customers = load(spark, sf_dir, "customer")
    rows = customers.select(F.array(F.col("c_custkey").cast("string"), "c_name", F.col("c_acctbal").cast("string")).alias("cells"))
    return readers.bind_fields(rows, "cells", schema)


@query("rename_positional", "SELECT o_orderkey AS order_id, o_custkey AS user_id, o_totalprice AS price FROM orders")
def rename_positional(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return readers.rename_positional(orders, "order_id", "user_id", "price")


# --- projections, filters, casts -----------------------------------------------------------------------------

_EXPLORE = ["uid_age", "voi_comment_count", "uid_dealorders", "ord_cancel_trn_order_count", "pro_phone_type",
            "ord_success_trn_order_count"]


@query("select_columns", f"SELECT {', '.join(_EXPLORE)} FROM users")
def select_columns(spark, sf_dir):
    return user_table(spark, sf_dir, _EXPLORE)


_BUCKETED = ["com_passenger_count", "com_idno_count", "ord_success_order_count", "bil_payord_count"]


@query("user_table_bucketed", f"SELECT uid_uid, {', '.join(_BUCKETED)} FROM users")
def user_table_bucketed(spark, sf_dir):
    """Columns that need lines and their orders, from tables bucketed by order key."""
    return user_table(spark, sf_dir, [USER_KEY, *_BUCKETED], bucketed_tables(spark, sf_dir, 8))


@query("drop_column", """
SELECT com_passenger_count::DOUBLE AS com_passenger_count, com_idno_count::DOUBLE AS com_idno_count,
       com_mobile_count::DOUBLE AS com_mobile_count,
       ord_success_order_cmobile_count::DOUBLE AS ord_success_order_cmobile_count FROM users""")
def drop_column(spark, sf_dir):
    return group_features(_group_users(spark, sf_dir, GROUPS["relation"]), GROUPS["relation"], True).drop(TRAINING_LABEL)


@query("cast_double", """
SELECT o_orderkey, try_cast(o_totalprice::VARCHAR AS DOUBLE) AS price, try_cast(o_orderpriority[1] AS DOUBLE) AS rank,
       try_cast(o_orderstatus AS DOUBLE) AS status FROM orders""")
def cast_double(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(
        "o_orderkey",
        C.to_double(F.col("o_totalprice").cast("string")).alias("price"),
        C.to_double(F.substring("o_orderpriority", 1, 1)).alias("rank"),
        C.to_double("o_orderstatus").alias("status"),
    )


_GAPPY = ["ord_success_flt_order_amount", "ord_success_htl_order_refund_ratio", "cap_wallet_balance"]


@query("fill_numeric", f"SELECT uid_uid, {', '.join(f'coalesce({c}, -1) AS {c}' for c in _GAPPY)} FROM users")
def fill_numeric(spark, sf_dir):
    return C.fill_numeric(user_table(spark, sf_dir, [USER_KEY, *_GAPPY]), -1.0)


@query("ratio_default_one", """
SELECT uid_uid, coalesce(ord_success_flt_order_amount / nullif(ord_success_flt_order_count, 0), 1) AS flt_price,
  CASE WHEN ord_success_flt_order_count <> 0 THEN bil_payord_count::DOUBLE / ord_success_flt_order_count
       WHEN bil_payord_count > 0 THEN 'inf'::DOUBLE ELSE 1 END AS orders_per_flt
FROM users""")
def ratio_default_one(spark, sf_dir):
    users = user_table(
        spark, sf_dir,
        [USER_KEY, "ord_success_flt_order_count", "ord_success_flt_order_amount", "bil_payord_count"],
    )
    return users.select(
        USER_KEY,
        C.ratio_default_one("ord_success_flt_order_count", "ord_success_flt_order_amount").alias("flt_price"),
        C.ratio_default_one("ord_success_flt_order_count", "bil_payord_count").alias("orders_per_flt"),
    )


@query("int_div_and_sum", """
SELECT uid_uid, uid_age // uid_age AS age2, uid_age + uid_age AS age3,
       uid_age // nullif(uid_grade, 0) AS per_grade, uid_age + uid_grade AS with_grade FROM users""")
def int_div_and_sum(spark, sf_dir):
    age2, age3 = C.int_div_and_sum("uid_age", "uid_age")
    per_grade, with_grade = C.int_div_and_sum("uid_age", "uid_grade")
    return user_table(spark, sf_dir, [USER_KEY, "uid_age", "uid_grade"]).select(
        USER_KEY, age2.alias("age2"), age3.alias("age3"), per_grade.alias("per_grade"), with_grade.alias("with_grade")
    )


def _people(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), (18 + F.col("c_custkey") % 50).cast("int").alias("age")
    )


@query("row_to_text", """
SELECT concat('name:', c_name, ' age:', 18 + c_custkey % 50) AS by_index,
       concat('name:', c_name, ' age:', 18 + c_custkey % 50) AS by_name,
       concat('name:[', c_name, ',', 18 + c_custkey % 50, ']') AS whole_row,
       concat('name:', c_name) AS name_only FROM customer""")
def row_to_text(spark, sf_dir):
    return _people(spark, sf_dir).select(*[c.alias(n) for n, c in C.row_to_text("name", "age").items()])


@query("row_to_map", """
SELECT c_name AS name, 'name' AS key, c_name AS value FROM customer
UNION ALL SELECT c_name, 'age', (18 + c_custkey % 50)::VARCHAR FROM customer""")
def row_to_map(spark, sf_dir):
    rows = _people(spark, sf_dir).select("name", C.row_to_map("name", "age").alias("values"))
    return C.map_entries_rows(rows, "values", "name")


# --- aggregation and profiling -------------------------------------------------------------------------------

@query("group_count", 'SELECT uid_age, count(*) AS "count" FROM users GROUP BY uid_age')
def group_count(spark, sf_dir):
    return profile.group_count(user_table(spark, sf_dir, ["uid_age"]), "uid_age")


@query("count_rows", 'SELECT count(*) AS "count" FROM lineitem')
def count_rows(spark, sf_dir):
    return profile.count_rows(load(spark, sf_dir, "lineitem"))


def _describe_sql(spec: GroupSpec) -> str:
    # Built per column from the group's training features.
    parts = [
        f"SELECT '{f}' AS \"column\", count({f}) AS \"count\", round(avg({f}), 6) AS mean, "
        f"round(stddev_samp({f}), 6) AS stddev, round(min({f}), 6) AS min, round(max({f}), 6) AS max FROM features"
        for f in spec.features
    ]
    return f", features AS MATERIALIZED ({_features_sql(spec, True)}) " + " UNION ALL ".join(parts)


# The derived features and fills in SQL, on their own terms: nullif for the zero count, coalesce for the fill.
_DERIVED_SQL = {
    "cap_balance": "cap_tmoney_balance + cap_wallet_balance + cap_wallet_balance",
    "bil_pays_ratio": "bil_paysord_count::DOUBLE / nullif(bil_payord_count, 0)",
    "bil_pays_credit_ratio": "bil_paysord_credit_count::DOUBLE / nullif(bil_payord_credit_count, 0)",
    "bil_pays_debit_ratio": "bil_paysord_debit_count::DOUBLE / nullif(bil_payord_debit_count, 0)",
}


def _features_sql(spec: GroupSpec, training: bool, key: bool = True) -> str:
    fill = {("consuming", True): "-1", ("consuming", False): "0", ("financial", True): "0", ("financial", False): "0"}
    out = []
    for f in spec.features:
        if f in _DERIVED_SQL:
            e = _DERIVED_SQL[f]
        elif f.endswith("_order_price"):
            stem = f.removesuffix("_price")
            e = f"{stem}_amount / nullif({stem}_count, 0)"
        else:
            e = f
        gap = fill.get((spec.name, training))
        out.append(f"({e})::DOUBLE AS {f}" if gap is None else f"coalesce(({e})::DOUBLE, {gap}) AS {f}")
    head = ["uid_uid"] if key else []
    if training:
        head.append("uid_flag::DOUBLE AS uid_flag")
    return f"SELECT {', '.join(head + out)} FROM users"


@query("describe_numeric", _describe_sql(GROUPS["consuming"]))
def describe_numeric(spark, sf_dir):
    features = group_features(_group_users(spark, sf_dir, GROUPS["consuming"]), GROUPS["consuming"], True).drop(TRAINING_LABEL)
    out = profile.describe_numeric(features)
    return out.select(
        "column", "count", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"),
        F.round("min", 6).alias("min"), F.round("max", 6).alias("max"),
    )


@query("head_rows", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5""")
def head_rows(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return profile.head_rows(orders, 5, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("schema_listing", " UNION ALL ".join(
    f"SELECT {i}::INT AS position, '{n}' AS name, '{t}' AS type, count({n}) AS non_null FROM orders"
    for i, (n, t) in enumerate([
        ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
        ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")])))
def schema_listing(spark, sf_dir):
    return profile.schema_profile(load(spark, sf_dir, "orders"))


# --- feature engineering -------------------------------------------------------------------------------------

def _register_features(name: str, group: str, training: bool) -> None:
    @query(name, _features_sql(GROUPS[group], training))
    def run(spark, sf_dir):
        return group_features(_group_users(spark, sf_dir, GROUPS[group]), GROUPS[group], training, keep=(USER_KEY,))


_register_features("features_consuming_train", "consuming", True)
_register_features("features_consuming_score", "consuming", False)
_register_features("features_financial", "financial", True)
_register_features("features_people", "people", True)
_register_features("features_relation", "relation", True)
_register_features("features_interaction", "interaction", True)


@query("assemble_labeled", "SELECT uid_flag::DOUBLE AS label, " + ", ".join(
    f"{f}::DOUBLE AS {f}" for f in GROUPS["relation"].features) + " FROM users")
def assemble_labeled_query(spark, sf_dir):
    spec = GROUPS["relation"]
    points = assemble_labeled(group_features(_group_users(spark, sf_dir, spec), spec, True), TRAINING_LABEL)
    return unpack(points, "features", list(spec.features), "label")


@query("assemble_vector", _features_sql(GROUPS["interaction"], False, key=False))
def assemble_vector_query(spark, sf_dir):
    spec = GROUPS["interaction"]
    return unpack(assemble_vector(group_features(_group_users(spark, sf_dir, spec), spec, False)), "features", list(spec.features))


def _scaler_sql(spec: GroupSpec) -> str:
    return f", features AS MATERIALIZED ({_features_sql(spec, True)}) " + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round(avg({f}), 6) AS mean, round(stddev_samp({f}), 6) AS std FROM features" for f in spec.features)


@query("scaler_fit", _scaler_sql(GROUPS["consuming"]))
def scaler_fit(spark, sf_dir):
    spec = GROUPS["consuming"]
    features = assemble(group_features(_group_users(spark, sf_dir, spec), spec, True), list(spec.features))
    out = scaler_summary(fit_scaler(features), features, list(spec.features))
    return out.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("scaler_transform", f", features AS MATERIALIZED ({_features_sql(GROUPS['financial'], False)}) SELECT uid_uid, " + ", ".join(
    f"round(coalesce(({f} - avg({f}) OVER ()) / nullif(stddev_samp({f}) OVER (), 0), 0), 6) AS {f}"
    for f in GROUPS["financial"].features) + " FROM features")
def scaler_transform(spark, sf_dir):
    spec = GROUPS["financial"]
    names = list(spec.features)
    features = assemble(group_features(_group_users(spark, sf_dir, spec), spec, False, keep=(USER_KEY,)), names)
    features = materialize(features.select(USER_KEY, "features"), "vectors")
    out = unpack(fit_scaler(features).transform(features), "scaled", names, USER_KEY)
    return out.select(USER_KEY, *[F.round(n, 6).alias(n) for n in names])


@query("minmax_transform", f", features AS MATERIALIZED ({_features_sql(GROUPS['interaction'], False)}) SELECT uid_uid, " + ", ".join(
    f"round(coalesce(({f} - min({f}) OVER ()) / nullif(max({f}) OVER () - min({f}) OVER (), 0), 0.5), 6) AS {f}"
    for f in GROUPS["interaction"].features) + " FROM features")
def minmax_transform(spark, sf_dir):
    names = list(GROUPS["interaction"].features)
    features = materialize(group_features(_group_users(spark, sf_dir, GROUPS["interaction"]), GROUPS["interaction"], False, keep=(USER_KEY,)), "features")
    _, scaled = min_max_scale(features, names)
    out = unpack(scaled, "scaled", names, USER_KEY)
    return out.select(USER_KEY, *[F.round(n, 6).alias(n) for n in names])


# --- models --------------------------------------------------------------------------------------------------

def _group_table(spark: SparkSession, sf_dir: str, spec: GroupSpec) -> DataFrame:
    """The group's columns of the user table, with key and labels, written once for the passes of a fit."""
    return materialize(_group_users(spark, sf_dir, spec), "group")


def _train(users: DataFrame, spec: GroupSpec, **kw) -> GroupModel:
    return train_group(users, spec, TreeParams(), fit_on=hash_bucket(USER_KEY) < 75, **kw)


@query("random_split")
def random_split_query(spark, sf_dir):
    train, test = random_split(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias(USER_KEY)))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("hash_split", """
SELECT c_custkey AS uid_uid, CASE WHEN (('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::BIGINT) % 100 < 75
  THEN 'train' ELSE 'test' END AS part FROM customer""")
def hash_split_query(spark, sf_dir):
    keys = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias(USER_KEY))
    return keys.withColumn("part", F.when(hash_bucket(USER_KEY) < 75, "train").otherwise("test"))


@query("rf_predict")
def rf_predict(spark, sf_dir):
    spec = GROUPS["interaction"]
    users = _group_table(spark, sf_dir, spec)
    return _train(users, spec).predict(users).select(USER_KEY, F.col("rf_interaction").alias("prediction"))


@query("gbt_predict")
def gbt_predict(spark, sf_dir):
    spec = GROUPS["relation"]
    users = _group_table(spark, sf_dir, spec)
    model = _train(users, spec, forest=False, boosted=True)
    return model.predict(users).select(USER_KEY, F.col("gbt_relation").alias("prediction"))


@query("holdout_predictions")
def holdout_predictions(spark, sf_dir):
    spec = GROUPS["consuming"]
    users = _group_table(spark, sf_dir, spec)
    _, test = hash_split(users, USER_KEY)
    out = _train(users, spec).predict(test, training=True)
    return out.select(USER_KEY, F.col(TRAINING_LABEL).cast("double").alias("label"), F.col("rf_consuming").alias("prediction"))


@query("batch_predict")
def batch_predict(spark, sf_dir):
    spec = GROUPS["people"]
    users = _group_table(spark, sf_dir, spec)
    return _train(users, spec).predict(users).select(USER_KEY, "rf_people", "gbt_people")


@query("train_submodel")
def train_submodel(spark, sf_dir):
    """What training a group yields: each feature's mean, deviation and weight in the forest."""
    spec = GROUPS["financial"]
    model = _train(_group_table(spark, sf_dir, spec), spec)
    weights = model.forest.featureImportances.toArray()
    rows = [
        (f, float(m), float(s), float(w))
        for f, m, s, w in zip(spec.features, model.scaler.mean, model.scaler.std, weights, strict=True)
    ]
    return literal_rows(spark, ["feature", "mean", "std", "importance"], rows)


@query("train_evaluate")
def train_evaluate(spark, sf_dir):
    """Both models of a group on its held-out users."""
    spec = GROUPS["interaction"]
    return train_and_evaluate(_group_table(spark, sf_dir, spec), spec)[1]


@query("model_roundtrip")
def model_roundtrip(spark, sf_dir):
    """Predictions before saving and after loading, side by side on the same row."""
    spec = GROUPS["relation"]
    users = _group_table(spark, sf_dir, spec)
    model = _train(users, spec)
    base = new_path(spark, "model")
    model.save(base)
    before = model.predict(users).select(USER_KEY, *raw_columns(spec), F.col("rf_relation").alias("before"))
    return GroupModel.load(spec, base).predict(before).select(USER_KEY, "before", F.col("rf_relation").alias("after"))


def _register_score(spec: GroupSpec) -> None:
    @query(spec.score_column)
    def run(spark, sf_dir):
        users = _group_table(spark, sf_dir, spec)
        return score_groups(users, {spec.name: _train(users, spec)}, (USER_KEY,), total=False)


for _s in GROUPS.values():
    _register_score(_s)


# What SQL can say about these queries, as entries of their own: keys, labels, means and equalities.

@query("random_split_union", "SELECT c_custkey AS uid_uid, 1::BIGINT AS parts FROM customer")
def random_split_union(spark, sf_dir):
    """Every row is in exactly one part."""
    return random_split_query(spark, sf_dir).groupBy(USER_KEY).agg(F.count("part").alias("parts"))


@query("holdout_labels", """ SELECT uid_uid, uid_flag::DOUBLE AS label, TRUE AS bounded FROM users
WHERE (('0x' || substr(md5(uid_uid::VARCHAR), 1, 8))::BIGINT) % 100 >= 75""")
def holdout_labels(spark, sf_dir):
    """Whom the held-out predictions judge, with their labels; a forest stays within the labels it has seen."""
    return holdout_predictions(spark, sf_dir).select(USER_KEY, "label", F.col("prediction").between(0.0, 1.0).alias("bounded"))


@query("train_submodel_moments", _scaler_sql(GROUPS["financial"]))
def train_submodel_moments(spark, sf_dir):
    """The mean and deviation of each feature in a trained group."""
    return train_submodel(spark, sf_dir).select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("model_roundtrip_equal", " SELECT uid_uid, TRUE AS same FROM users")
def model_roundtrip_equal(spark, sf_dir):
    return model_roundtrip(spark, sf_dir).select(USER_KEY, (F.col("before") == F.col("after")).alias("same"))


# The same models as tables, walked by an evaluator of its own: both must say the same of every user.

def _walk_equal(users: DataFrame, spec: GroupSpec, model: GroupModel, column: str) -> DataFrame:
    base = new_path(users.sparkSession, "model")
    model.save(base)
    judged = GroupModel.load(spec, base).predict(users).select(USER_KEY, *raw_columns(spec), F.col(column).alias("_theirs"))
    walked = walk_groups(judged, model_tables(users.sparkSession, base), [spec])
    return walked.select(USER_KEY, (F.abs(F.col(column) - F.col("_theirs")) < 1e-9).alias("same"))


@query("rf_walk_equal", " SELECT uid_uid, TRUE AS same FROM users")
def rf_walk_equal(spark, sf_dir):
    """A forest's predictions, from MLlib and from its table of nodes."""
    spec = GROUPS["interaction"]
    users = _group_table(spark, sf_dir, spec)
    return _walk_equal(users, spec, _train(users, spec), "rf_interaction")


@query("gbt_walk_equal", " SELECT uid_uid, TRUE AS same FROM users")
def gbt_walk_equal(spark, sf_dir):
    """Boosted trees' predictions, from MLlib and from their table of nodes."""
    spec = GROUPS["relation"]
    users = _group_table(spark, sf_dir, spec)
    return _walk_equal(users, spec, _train(users, spec, forest=False, boosted=True), "gbt_relation")


@query("scores_walk_equal", " SELECT uid_uid, TRUE AS people, TRUE AS consuming, TRUE AS financial, TRUE AS interaction, TRUE AS relation FROM users")
def scores_walk_equal(spark, sf_dir):
    """The five scores of every user, from stored models and from their tables alone."""
    specs = list(GROUPS.values())
    users = materialize(user_table(spark, sf_dir).select(*dict.fromkeys([USER_KEY, TRAINING_LABEL, *raw_columns(*specs)])), "users")
    base = new_path(spark, "models")
    save_models(train(users, TreeParams(), 5), base)
    theirs = score_groups(users, load_models(spark, base), (USER_KEY, *raw_columns(*specs)))
    theirs = theirs.withColumnsRenamed({s.score_column: f"_{s.name}" for s in specs})
    ours = walk_scores(theirs, model_tables(spark, base), (USER_KEY, *[f"_{s.name}" for s in specs]))
    return ours.select(USER_KEY, *[(F.abs(F.col(s.score_column) - F.col(f"_{s.name}")) < 1e-9).alias(s.name) for s in specs])


def _profile_sql(spec: GroupSpec) -> str:
    label = "SELECT 'uid_flag' AS \"column\", count(*) AS \"count\", round(avg(uid_flag), 6) AS mean, round(stddev_samp(uid_flag), 6) AS stddev, min(uid_flag)::DOUBLE AS min, max(uid_flag)::DOUBLE AS max FROM users"
    return _describe_sql(spec) + " UNION ALL " + label


@query("train_submodel_profile", _profile_sql(GROUPS["financial"]))
def train_submodel_profile(spark, sf_dir):
    """The profile that comes with a trained group: its label and features over the rows that it was fitted on."""
    spec = GROUPS["financial"]
    out = _train(_group_table(spark, sf_dir, spec), spec).profile_table(spark)
    return _rounded(out, "mean", "stddev", "min", "max")


@query("score_stored_batch", " SELECT 'monday' AS batch, uid_uid::VARCHAR AS uid_uid, score::DOUBLE AS score, TRUE AS total_of_parts, TRUE AS forests_bounded FROM users")
def score_stored_batch(spark, sf_dir):
    """The whole chain: a training file, models stored from it, a separate scoring file scored with what was stored, and its
    scores committed as a batch, which is run twice."""
    users = materialize(user_table(spark, sf_dir), "users")
    paths = {k: new_path(spark, k) for k in ("training-csv", "scoring-csv", "models", "scores")}
    sinks.write_csv(training_table(users), paths["training-csv"])
    sinks.write_csv(scoring_table(users, keyed=True), paths["scoring-csv"])
    table = materialize(keyed(readers.read_inferred(spark, paths["training-csv"])), "training")
    save_models(train(table, TreeParams(), 5), paths["models"])
    for _ in range(2):
        score_file(spark, paths["scoring-csv"], paths["models"], paths["scores"], "monday")
    out = committed_scores(spark, paths["scores"])
    gap = F.abs(F.col("score_all") - compose.weighted_total())
    forests = [F.col(s.score_column).between(350.0, 850.0) for s in GROUPS.values() if not s.gbt_share]
    return out.select("batch", USER_KEY, SCORING_LABEL, (gap < 1e-9).alias("total_of_parts"), reduce(and_, forests).alias("forests_bounded"))


# --- evaluation on a stand-in prediction ---------------------------------------------------------------------

def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_table(spark, sf_dir, [USER_KEY, "pro_customervalue", TRAINING_LABEL]).select(
        USER_KEY, (F.col("pro_customervalue") / 500000.0).alias("score"), F.col(TRAINING_LABEL).cast("double").alias("label")
    )


_PREDICTIONS_SQL = """, predictions AS (
  SELECT uid_uid, pro_customervalue / 500000::DOUBLE AS score, uid_flag::DOUBLE AS label FROM users)"""

_CURVE_SQL = _PREDICTIONS_SQL + """, steps AS (
  SELECT score AS threshold, count(*) FILTER (WHERE label > 0.5) AS pos, count(*) FILTER (WHERE label <= 0.5) AS neg
  FROM predictions GROUP BY score),
curve AS (
  SELECT threshold, tp, fp, p, n, tp::DOUBLE / (tp + fp) AS pr,
    CASE WHEN p = 0 THEN 0 ELSE tp::DOUBLE / p END AS re, CASE WHEN n = 0 THEN 0 ELSE fp::DOUBLE / n END AS fpr
  FROM (SELECT threshold, sum(pos) OVER down AS tp, sum(neg) OVER down AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
        FROM steps WINDOW down AS (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))
"""


@query("mse", _PREDICTIONS_SQL + " SELECT round(avg((label - score) * (label - score)), 6) AS mse FROM predictions")
def mse(spark, sf_dir):
    return evaluate.mse(_predictions(spark, sf_dir)).select(F.round("mse", 6).alias("mse"))


@query("test_error", _PREDICTIONS_SQL + """
SELECT 'exact' AS comparison, round(avg((label <> score)::INT), 6) AS test_error FROM predictions
UNION ALL SELECT 'cutoff', round(avg((label <> (score > 0.5)::INT)::INT), 6) FROM predictions""")
def test_error(spark, sf_dir):
    rows = _predictions(spark, sf_dir)
    parts = [
        evaluate.prediction_error(rows, cutoff=c).select(F.lit(n).alias("comparison"), F.round("test_error", 6).alias("test_error"))
        for n, c in (("exact", None), ("cutoff", 0.5))
    ]
    return parts[0].unionByName(parts[1])


@query("scores_and_labels", _PREDICTIONS_SQL + " SELECT score, label FROM predictions")
def scores_and_labels(spark, sf_dir):
    return evaluate.scores_and_labels(_predictions(spark, sf_dir))


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.threshold_counts(_predictions(spark, sf_dir))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("precision_by_threshold", _CURVE_SQL + "SELECT threshold, pr AS precision FROM curve")
def precision_by_threshold(spark, sf_dir):
    return evaluate.precision_by_threshold(_curve(spark, sf_dir))


@query("recall_by_threshold", _CURVE_SQL + "SELECT threshold, re AS recall FROM curve")
def recall_by_threshold(spark, sf_dir):
    return evaluate.recall_by_threshold(_curve(spark, sf_dir))


def _f_sql(b2: str) -> str:
    return _CURVE_SQL + f"""SELECT threshold, CASE WHEN pr + re = 0 THEN 0
      ELSE (1 + {b2}::DOUBLE) * pr * re / ({b2}::DOUBLE * pr + re) END AS f_measure FROM curve"""


@query("f1_by_threshold", _f_sql("1"))
def f1_by_threshold(spark, sf_dir):
    return evaluate.f_measure_by_threshold(_curve(spark, sf_dir), 1.0)


@query("f05_by_threshold", _f_sql("0.25"))
def f05_by_threshold(spark, sf_dir):
    return evaluate.f_measure_by_threshold(_curve(spark, sf_dir), 0.5)


@query("thresholds", _CURVE_SQL + "SELECT threshold FROM curve")
def thresholds(spark, sf_dir):
    return evaluate.thresholds(_curve(spark, sf_dir))


@query("pr_curve", _CURVE_SQL + """SELECT re AS recall, pr AS precision FROM curve
UNION ALL SELECT 0, pr FROM curve WHERE threshold = (SELECT max(threshold) FROM curve)""")
def pr_curve(spark, sf_dir):
    return evaluate.pr_curve(_curve(spark, sf_dir))


@query("roc_curve", _CURVE_SQL + """SELECT fpr, re AS tpr FROM curve
UNION ALL SELECT 0, 0 UNION ALL SELECT 1, 1""")
def roc_curve(spark, sf_dir):
    return evaluate.roc_curve(_curve(spark, sf_dir))


@query("auc_pr", _CURVE_SQL + """SELECT round(sum((re - re0) * (pr + pr0) / 2), 6) AS auc_pr FROM (
  SELECT re, pr, coalesce(lag(re) OVER w, 0) AS re0, coalesce(lag(pr) OVER w, pr) AS pr0
  FROM curve WINDOW w AS (ORDER BY threshold DESC))""")
def auc_pr(spark, sf_dir):
    return _rounded(evaluate.auc_pr(_curve(spark, sf_dir)), "auc_pr")


@query("auc_roc", _CURVE_SQL + """SELECT round(sum((fpr - fpr0) * (re + re0) / 2), 6) AS auc_roc FROM (
  SELECT fpr, re, lag(fpr) OVER w AS fpr0, lag(re) OVER w AS re0
  FROM (SELECT fpr, re FROM curve UNION ALL SELECT 0, 0 UNION ALL SELECT 1, 1) WINDOW w AS (ORDER BY fpr, re))""")
def auc_roc(spark, sf_dir):
    return _rounded(evaluate.auc_roc(_curve(spark, sf_dir)), "auc_roc")


# --- ten models at once, and curves of few points ---------------------------------------------------------------

# Stand-ins for the two models of each group: predictions from the table, and their mirror images.
_TEN = {f"{kind}_{g}": sign for g in GROUPS for kind, sign in (("rf", "plain"), ("gbt", "mirrored"))}
_TEN_INPUTS = {"people": "pro_customervalue", "consuming": "ord_success_max_order_amount", "financial": "pro_htl_consuming_capacity",
               "interaction": "uid_age", "relation": "bil_paysord_count"}


def _ten_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user with the label and ten scores."""
    scores = [(F.col(_TEN_INPUTS[m.split("_")[1]]) / (500000.0 if how == "plain" else -500000.0)).alias(m) for m, how in _TEN.items()]
    return user_table(spark, sf_dir, [USER_KEY, TRAINING_LABEL, *_TEN_INPUTS.values()]).select(USER_KEY, F.col(TRAINING_LABEL).alias("label"), *scores)


_TEN_SQL = ", judged AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS model, {_TEN_INPUTS[m.split('_')[1]]} / {500000 if how == 'plain' else -500000}::DOUBLE AS score, uid_flag::DOUBLE AS label FROM users"
    for m, how in _TEN.items()) + """), steps AS (
  SELECT model, score AS threshold, count(*) FILTER (WHERE label > 0.5) AS pos, count(*) FILTER (WHERE label <= 0.5) AS neg
  FROM judged GROUP BY model, score),
curve AS (
  SELECT model, threshold, pos, neg, tp, fp, p, n, tp::DOUBLE / (tp + fp) AS pr, CASE WHEN p = 0 THEN 0 ELSE tp::DOUBLE / p END AS re,
    CASE WHEN n = 0 THEN 0 ELSE fp::DOUBLE / n END AS fpr
  FROM (SELECT model, threshold, pos, neg, (sum(pos) OVER down)::BIGINT AS tp, (sum(neg) OVER down)::BIGINT AS fp,
               (sum(pos) OVER (PARTITION BY model))::BIGINT AS p, (sum(neg) OVER (PARTITION BY model))::BIGINT AS n
        FROM steps WINDOW down AS (PARTITION BY model ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))
"""


def _ten_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.threshold_counts(evaluate.stacked(_ten_models(spark, sf_dir), {m: m for m in _TEN}), by=("model",))


@query("model_curves", _TEN_SQL + """SELECT model, threshold, pos, neg, tp, fp, p, n, pr AS precision, re AS recall,
  CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS f1, CASE WHEN pr + re = 0 THEN 0 ELSE 1.25::DOUBLE * pr * re / (0.25::DOUBLE * pr + re) END AS f05
FROM curve""")
def model_curves(spark, sf_dir):
    """Counts, precision, recall and both F measures of ten models at every threshold of each."""
    counts = materialize(_ten_counts(spark, sf_dir), "counts")
    out = counts
    for part, name in ((evaluate.precision_by_threshold(counts), None), (evaluate.recall_by_threshold(counts), None),
                       (evaluate.f_measure_by_threshold(counts, 1.0), "f1"), (evaluate.f_measure_by_threshold(counts, 0.5), "f05")):
        out = out.join(part if name is None else part.withColumnRenamed("f_measure", name), ["model", "threshold"])
    return out


@query("model_roc_pr", _TEN_SQL + """SELECT model, 'roc' AS curve, fpr AS x, re AS y FROM curve
UNION ALL SELECT model, 'roc', v, v FROM (SELECT DISTINCT model FROM curve), (VALUES (0::DOUBLE), (1::DOUBLE)) ends(v)
UNION ALL SELECT model, 'pr', re, pr FROM curve UNION ALL SELECT model, 'pr', 0, pr FROM curve WHERE tp + fp = pos + neg""")
def model_roc_pr(spark, sf_dir):
    """The ROC and precision-recall curves of ten models."""
    counts = materialize(_ten_counts(spark, sf_dir), "counts")
    roc = evaluate.roc_curve(counts).select("model", F.lit("roc").alias("curve"), F.col("fpr").alias("x"), F.col("tpr").alias("y"))
    return roc.unionByName(evaluate.pr_curve(counts).select("model", F.lit("pr").alias("curve"), F.col("recall").alias("x"), F.col("precision").alias("y")))


@query("model_reports", _TEN_SQL + """, areas AS (
  SELECT model, sum((fpr - fpr0) * (re + re0) / 2) + (1 - max(fpr)) * (1 + max(re)) / 2 AS auc_roc, sum((re - re0) * (pr + pr0) / 2) AS auc_pr
  FROM (SELECT *, coalesce(lag(fpr) OVER w, 0) AS fpr0, coalesce(lag(re) OVER w, 0) AS re0, coalesce(lag(pr) OVER w, pr) AS pr0
        FROM curve WINDOW w AS (PARTITION BY model ORDER BY threshold DESC)) GROUP BY model)
SELECT model, 'auc_roc' AS metric, round(auc_roc, 6) AS value FROM areas UNION ALL SELECT model, 'auc_pr', round(auc_pr, 6) FROM areas
UNION ALL SELECT model, 'mse', round(avg((label - score) * (label - score)), 6) FROM judged GROUP BY model
UNION ALL SELECT model, 'test_error', round(avg((label <> score)::INT), 6) FROM judged GROUP BY model""")
def model_reports(spark, sf_dir):
    """Errors and areas of ten models from one scan of their scores."""
    return _rounded(evaluate.evaluate_models(_ten_models(spark, sf_dir), {m: m for m in _TEN}), "value")


BINS = 100


def _binned_sql(source: str, key: str) -> str:
    part, lead = (f"PARTITION BY {key} ", f"{key}, ") if key else ("", "")
    on = f" AND r.{key} = c.{key}" if key else ""
    return f""", ranks AS (SELECT {lead}score, label, row_number() OVER ({part}ORDER BY score DESC) AS i, count(*) OVER ({part}) AS m FROM {source}),
cuts AS (SELECT DISTINCT {lead}score AS threshold FROM ranks
         WHERE i IN (SELECT (j * m + {BINS - 1}) // {BINS} FROM (SELECT unnest(range(1, {BINS + 1})) AS j))),
sums AS (SELECT {', '.join(f'c.{x}' for x in ([key] if key else []) + ['threshold'])}, count(*) FILTER (WHERE label > 0.5 AND score >= threshold) AS tp, count(*) FILTER (WHERE label <= 0.5 AND score >= threshold) AS fp,
                count(*) FILTER (WHERE label > 0.5) AS p, count(*) FILTER (WHERE label <= 0.5) AS n
         FROM cuts c JOIN ranks r ON TRUE{on} GROUP BY ALL)
SELECT {lead}threshold, tp - lag(tp, 1, 0) OVER w AS pos, fp - lag(fp, 1, 0) OVER w AS neg, tp, fp, p, n
FROM sums WINDOW w AS ({part}ORDER BY threshold DESC)"""


@query("binned_curve", _PREDICTIONS_SQL + _binned_sql("predictions", ""))
def binned_curve(spark, sf_dir):
    """The threshold curve at a hundred exact quantiles of the score."""
    return binned_counts(_predictions(spark, sf_dir), BINS)


@query("model_binned_curves", _TEN_SQL + _binned_sql("judged", "model"))
def model_binned_curves(spark, sf_dir):
    """Ten models' threshold curves of a hundred points each, from one scan."""
    return binned_counts(evaluate.stacked(_ten_models(spark, sf_dir), {m: m for m in _TEN}), BINS, by=("model",))


# --- score construction and composition ----------------------------------------------------------------------

# Stand-in predictions of the five groups, written once for each engine.
_STAND_INS = {
    "score_people": "pro_customervalue / 500000.0D",
    "score_consuming": "bil_paysord_count / greatest(bil_payord_count, 1)",
    "score_fanacial": "ord_success_max_order_amount / 500000.0D",
    "score_interaction": "pro_htl_consuming_capacity / 500000.0D",
    "score_relation": "(uid_age - 18) / 49.0D",
}
_STAND_INS_SQL = """, stand_ins AS (
  SELECT uid_uid, score, pro_customervalue / 500000::DOUBLE * 500 + 350 AS score_people,
    bil_paysord_count::DOUBLE / greatest(bil_payord_count, 1) * 500 + 350 AS score_consuming,
    ord_success_max_order_amount / 500000::DOUBLE * 500 + 350 AS score_fanacial,
    pro_htl_consuming_capacity / 500000::DOUBLE * 500 + 350 AS score_interaction,
    (uid_age - 18)::DOUBLE / 49 * 500 + 350 AS score_relation FROM users)"""
_TOTAL_SQL = """(score_people * 0.3::DOUBLE + score_consuming * 0.25::DOUBLE + score_fanacial * 0.2::DOUBLE
  + score_interaction * 0.15::DOUBLE + score_relation * 0.1::DOUBLE)"""


def _stand_in_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = [compose.rescale_score(F.expr(e)).alias(n) for n, e in _STAND_INS.items()]
    inputs = ["pro_customervalue", "bil_paysord_count", "bil_payord_count", "ord_success_max_order_amount",
              "pro_htl_consuming_capacity", "uid_age"]
    return user_table(spark, sf_dir, [USER_KEY, SCORING_LABEL, *inputs]).select(USER_KEY, SCORING_LABEL, *scores)


@query("rescale_score", _PREDICTIONS_SQL + """
SELECT uid_uid, score * 500 + 350 AS score,
  greatest(350, least(850, (score * 3 - 0.5::DOUBLE) * 500 + 350)) AS clamped FROM predictions""")
def rescale_score(spark, sf_dir):
    rows = _predictions(spark, sf_dir)
    return rows.select(
        USER_KEY,
        compose.rescale_score("score").alias("score"),
        compose.rescale_score(F.col("score") * 3 - 0.5, clamp=True).alias("clamped"),
    )


@query("unscale_score", _STAND_INS_SQL + " SELECT uid_uid, (score_people - 350) / 500 AS prediction FROM stand_ins")
def unscale_score(spark, sf_dir):
    return _stand_in_scores(spark, sf_dir).select(USER_KEY, compose.unscale_score("score_people").alias("prediction"))


@query("blend_scores", _STAND_INS_SQL + """
SELECT uid_uid, score_people * 0.6::DOUBLE + score_fanacial * 0.4::DOUBLE AS blended FROM stand_ins""")
def blend_scores(spark, sf_dir):
    rows = _stand_in_scores(spark, sf_dir)
    return rows.select(USER_KEY, compose.blend_scores("score_people", "score_fanacial").alias("blended"))


@query("weighted_total", _STAND_INS_SQL + f" SELECT uid_uid, {_TOTAL_SQL} AS score_all FROM stand_ins")
def weighted_total(spark, sf_dir):
    return _stand_in_scores(spark, sf_dir).select(USER_KEY, compose.weighted_total().alias("score_all"))


@query("csv_sink_roundtrip", _STAND_INS_SQL + f" SELECT {_TOTAL_SQL} AS score_all, score::DOUBLE AS score FROM stand_ins")
def csv_sink_roundtrip(spark, sf_dir):
    path = new_path(spark, "scores-csv")
    write_audit(_stand_in_scores(spark, sf_dir).withColumn("score_all", compose.weighted_total()), path)
    schema = T.StructType.fromDDL("score_all double, score double")
    return readers.read_typed(spark, path, schema)


@query("positional_concat", """
SELECT a.o_orderkey AS first_key, a.o_totalprice AS first_price, b.o_orderkey AS other_key, b.o_orderpriority AS other_priority
FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders) a
JOIN (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders) b USING (i)""")
def positional_concat(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    by_key = orders.orderBy("o_orderkey").select(F.col("o_orderkey").alias("first_key"), F.col("o_totalprice").alias("first_price"))
    by_price = orders.orderBy(F.desc("o_totalprice"), "o_orderkey").select(
        F.col("o_orderkey").alias("other_key"), F.col("o_orderpriority").alias("other_priority"))
    return compose.positional_concat(by_key, by_price, ordered=False)


@query("score_with_label")
def score_with_label(spark, sf_dir):
    """The total beside the known label, carried on the same row."""
    return credit_score(user_table(spark, sf_dir), TreeParams(), 5, (USER_KEY, SCORING_LABEL)).select(USER_KEY, "score_all", SCORING_LABEL)


@query("credit_score")
def credit_score_query(spark, sf_dir):
    return credit_score(user_table(spark, sf_dir), TreeParams(), 5)


@query("score_with_label_parts", " SELECT uid_uid, score::DOUBLE AS score, TRUE AS total_of_parts, TRUE AS forests_bounded FROM users")
def score_with_label_parts(spark, sf_dir):
    """Every user with the known label; the total is that of the five scores, and those of forests stay within 350 to 850."""
    out = credit_score(user_table(spark, sf_dir), TreeParams(), 5, (USER_KEY, SCORING_LABEL))
    gap = F.abs(F.col("score_all") - compose.weighted_total())
    forests = [F.col(s.score_column).between(350.0, 850.0) for s in GROUPS.values() if not s.gbt_share]
    return out.select(USER_KEY, F.col(SCORING_LABEL).cast("double").alias("score"), (gap < 1e-9).alias("total_of_parts"), reduce(and_, forests).alias("forests_bounded"))


# --- arrays, maps and scalars --------------------------------------------------------------------------------

def _ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's number, quantity and supplier as an array of integers."""
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.array(F.col("l_linenumber").cast("bigint"), F.col("l_quantity").cast("bigint"), F.col("l_suppkey")).alias("xs"),
    )


def _elements(df: DataFrame, **arrays) -> DataFrame:
    out = df.select("l_orderkey", "l_linenumber", *[a.alias(n) for n, a in arrays.items()])
    return out.select("l_orderkey", "l_linenumber", *[F.col(n)[i].alias(f"{n}{i}") for n in arrays for i in range(3)])


def _elements_sql(**forms: str) -> str:
    items = ("l_linenumber::BIGINT", "l_quantity::BIGINT", "l_suppkey")
    cells = [f"{form.replace('x', f'({item})')} AS {n}{i}" for n, form in forms.items() for i, item in enumerate(items)]
    return f"SELECT l_orderkey, l_linenumber, {', '.join(cells)} FROM lineitem"


@query("array_affine", _elements_sql(y="x * 2 + 1"))
def array_affine(spark, sf_dir):
    return _elements(_ints(spark, sf_dir), y=C.array_affine("xs"))


@query("array_square", _elements_sql(y="(x * x)::VARCHAR"))
def array_square(spark, sf_dir):
    return _elements(_ints(spark, sf_dir), y=F.transform(C.array_square("xs"), lambda v: v.cast("string")))


@query("array_add", _elements_sql(y="x + 2", z="x + x * x"))
def array_add(spark, sf_dir):
    return _elements(_ints(spark, sf_dir), y=C.array_add("xs", 2), z=C.array_add("xs"))


@query("recode_clamp_zero", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber - 1 > 3 THEN 3 WHEN l_linenumber - 1 = 0 THEN 1
  ELSE l_linenumber - 1 END::INT AS recoded FROM lineitem""")
def recode_clamp_zero(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", C.recode_clamp_zero(F.col("l_linenumber") - 1).alias("recoded"))


@query("recode_cap", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 3 THEN 3 ELSE l_linenumber END AS capped FROM lineitem")
def recode_cap(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.recode_cap("l_linenumber").alias("capped"))


def _order_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    return orders.select("o_orderkey", "o_orderstatus", C.row_to_map("o_orderstatus", "o_orderpriority").alias("tags"))


@query("map_keys_rows", """
SELECT o_orderkey, 'o_orderstatus' AS key FROM orders UNION ALL SELECT o_orderkey, 'o_orderpriority' FROM orders""")
def map_keys_rows(spark, sf_dir):
    return C.map_keys_rows(_order_maps(spark, sf_dir), "tags", "o_orderkey")


@query("map_entries_rows", """
SELECT o_orderkey, 'o_orderstatus' AS key, o_orderstatus AS value FROM orders
UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders""")
def map_entries_rows(spark, sf_dir):
    return C.map_entries_rows(_order_maps(spark, sf_dir), "tags", "o_orderkey")


@query("map_lookup", """
SELECT o_orderkey, o_orderpriority AS found, NULL::VARCHAR AS missed,
  CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'cancel' END AS by_value FROM orders""")
def map_lookup(spark, sf_dir):
    names = F.create_map(F.lit("F"), F.lit("success"), F.lit("O"), F.lit("cancel"))
    return _order_maps(spark, sf_dir).select(
        "o_orderkey",
        C.map_lookup("tags", "o_orderpriority", strict=True).alias("found"),
        C.map_lookup("tags", "absent").alias("missed"),
        C.map_lookup(names, F.col("o_orderstatus")).alias("by_value"),
    )


@query("factorial_column", "SELECT l_orderkey, l_linenumber, factorial(l_linenumber)::VARCHAR AS factorial FROM lineitem")
def factorial_column(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", C.factorial("l_linenumber").cast("string").alias("factorial"))


@query("factorial_digits", "SELECT l_orderkey, l_linenumber, factorial((l_quantity::INT % 34))::VARCHAR AS digits FROM lineitem")
def factorial_digits(spark, sf_dir):
    """Factorials by limbs, up to the largest that the other engine has a type for."""
    lines = load(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", W.factorial_digits(F.col("l_quantity").cast("int") % 34).alias("digits"))


@query("square_digits", """SELECT o_orderkey, ((o_orderkey::HUGEINT * 1000000007 * 97 - o_custkey) * (o_orderkey::HUGEINT * 1000000007 * 97 - o_custkey))::VARCHAR AS digits
FROM orders""")
def square_digits(spark, sf_dir):
    """Squares of numbers that are longer than their product's type would allow."""
    number = F.col("o_orderkey").cast("decimal(20,0)") * F.lit(97_000_000_679).cast("decimal(12,0)") - F.col("o_custkey")
    return load(spark, sf_dir, "orders").select("o_orderkey", W.square_digits(number.cast("string")).alias("digits"))


@query("split_fields", """
SELECT o_orderkey, string_split(o_orderpriority, '-')[1] AS rank, string_split(o_orderpriority, '-')[2] AS name,
       len(string_split(o_orderpriority, '-'))::INT AS fields FROM orders""")
def split_fields(spark, sf_dir):
    parts = C.split_fields("o_orderpriority", "-")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", F.get(parts, F.lit(0)).alias("rank"), F.get(parts, F.lit(1)).alias("name"), F.size(parts).alias("fields"))
