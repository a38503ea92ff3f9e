"""Each registered query against its SQL on the same tables."""

import pytest
from check_catalog import connect, difference

from __spark_entry__ import entry, oracle_sql, queries
from scorekit.plans.catalog import CATALOG

SQL = {name: sql for name, sql in oracle_sql().items() if name in CATALOG}
ROWS_ONLY = {
    "random_split", "rf_predict", "gbt_predict", "holdout_predictions", "batch_predict", "train_submodel", "model_roundtrip",
    "train_evaluate", "score_people", "score_consuming", "score_fanacial", "score_interaction", "score_relation", "score_with_label",
    "credit_score",
}


@pytest.fixture(scope="session")
def duck(sf_dir):
    return connect(sf_dir)


def test_only_models_lack_sql():
    assert set(CATALOG) - set(SQL) == ROWS_ONLY


TYPES = {"boolean": "BOOLEAN", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, duck, sf_dir):
    ours, theirs = queries()[name](spark, sf_dir), duck.sql(SQL[name])
    types = dict(zip(theirs.columns, map(str, theirs.types), strict=True))
    assert {c: TYPES[t] for c, t in ours.dtypes} == types
    assert difference(ours.toPandas(), theirs.df()) is None


def test_random_split_keeps_every_row(spark, sf_dir):
    out = queries()["random_split"](spark, sf_dir).toPandas()
    assert sorted(out["uid_uid"]) == list(range(150))
    assert set(out["part"]) == {"train", "test"}


def test_roundtrip_predictions_are_equal(spark, sf_dir):
    out = queries()["model_roundtrip"](spark, sf_dir).toPandas()
    assert len(out) == 150 and (out["before"] == out["after"]).all()


def test_entry_scores_every_user(spark):
    out = entry(spark).toPandas()
    assert sorted(out["uid_uid"]) == list(range(150))
    scores = ["score_people", "score_consuming", "score_fanacial", "score_interaction", "score_relation"]
    assert list(out.columns) == ["uid_uid", *scores, "score_all"]
    forests = out[scores[1:]]
    # A forest averages labels, so its scores stay in range; boosting may leave it.
    assert forests.min().min() >= 350 and forests.max().max() <= 850
    total = out[scores] @ [0.3, 0.25, 0.2, 0.15, 0.1]
    assert (abs(total - out["score_all"]) < 1e-9).all()
