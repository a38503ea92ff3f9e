import threading

import pytest
from pyspark.sql import functions as F

from scorekit.operators import evaluate
from scorekit.operators.features import GROUPS, raw_columns
from scorekit.operators.models import (
    GroupModel, TreeParams, hash_bucket, hash_split, load_models, random_split, save_models, score_groups, train_group,
    train_groups,
)
from scorekit.plans.credit_score import credit_score, keyed, train, train_and_evaluate, write_audit
from scorekit.sources import readers, sinks
from scorekit.sources.user_table import scoring_table, training_table
from scorekit.staging import materialize

SMALL = TreeParams(rf_trees=5, rf_depth=4, gbt_rounds=3, gbt_depth=3)


@pytest.fixture(scope="module")
def models(users):
    return train(users, SMALL, parallelism=5)


def test_defaults_are_the_full_sizes(spark):
    p = TreeParams()
    assert (p.rf_trees, p.rf_depth, p.bins, p.gbt_rounds, p.gbt_depth) == (30, 10, 32, 50, 10)
    rf, gbt = p.forest(GROUPS["people"]), p.boosted(GROUPS["people"])
    assert rf.getFeatureSubsetStrategy() == "auto" and rf.getImpurity() == "variance" and rf.getMaxBins() == 32
    assert gbt.getLossType() == "squared" and gbt.getStepSize() == 0.1


def test_scoring_is_one_narrow_stage(users, models):
    scored = score_groups(users, models, ("uid_uid", "score"))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("FileScan") == 1
    assert "Python" not in plan
    assert "ord_total_order_count" not in plan


def test_every_user_is_scored_once(users, models):
    scored = score_groups(users, models, ("uid_uid",))
    ids = [r["uid_uid"] for r in scored.select("uid_uid").collect()]
    assert sorted(ids) == sorted(r["uid_uid"] for r in users.select("uid_uid").collect())
    assert scored.filter(F.col("score_all").isNull()).count() == 0


def test_only_people_blend(users, models):
    assert models["people"].boosted is not None
    assert all(m.boosted is None for n, m in models.items() if n != "people")
    scored = models["people"].predict(users).select("rf_people", "gbt_people", "uid_uid")
    both = scored.join(score_groups(users, models, ("uid_uid",)), "uid_uid")
    gap = F.abs((F.col("rf_people") * 500 + 350) * 0.6 + (F.col("gbt_people") * 500 + 350) * 0.4 - F.col("score_people"))
    assert both.agg(F.max(gap)).collect()[0][0] < 1e-9


def test_saved_models_score_the_same(spark, users, models, tmp_path):
    assert save_models(models, str(tmp_path)) == 1
    assert sorted(p.name for p in (tmp_path / "v000001").iterdir() if not p.name.startswith(".")) == sorted(
        [f"{n}_{s}" for n in GROUPS for s in ("PREP", "RF")] + ["people_GBT", "manifest", "nodes", "scaling"])
    loaded = load_models(spark, str(tmp_path))
    a, b = (score_groups(users, m, ("uid_uid",)) for m in (models, loaded))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert save_models(loaded, str(tmp_path)) == 2


def test_same_seed_same_predictions(users):
    spec = GROUPS["relation"]
    a, b = (train_group(users, spec, SMALL).predict(users).select("uid_uid", "rf_relation") for _ in range(2))
    assert a.exceptAll(b).count() == 0


def test_parallel_and_serial_training_agree(users, models):
    serial = train(users, SMALL, parallelism=1)
    a, b = (score_groups(users, m, ("uid_uid",)) for m in (models, serial))
    assert a.exceptAll(b).count() == 0


def test_planted_signal_is_found(spark):
    spec = GROUPS["relation"]
    rows = spark.range(600).select(
        F.col("id").alias("uid_uid"),
        *[((F.col("id") * k) % 97).cast("double").alias(n) for k, n in zip((3, 5, 7, 11), raw_columns(spec), strict=True)],
    ).withColumn("uid_flag", (F.col("com_idno_count") > 48).cast("int"))
    fit, held = hash_split(rows, "uid_uid")
    model = train_group(fit, spec, SMALL, boosted=True)
    judged = model.predict(held, training=True).withColumn("label", F.col("uid_flag").cast("double"))
    for column in ("rf_relation", "gbt_relation"):
        area = evaluate.auc_roc(evaluate.threshold_counts(judged, column)).collect()[0][0]
        assert area > 0.9
    low, high = judged.agg(F.min("rf_relation"), F.max("rf_relation")).collect()[0]
    assert 0.0 <= low <= high <= 1.0


def test_splits(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    a, b = hash_split(df, "k")
    assert a.count() + b.count() == 2000 and a.join(b, "k").count() == 0
    assert 0.7 < a.count() / 2000 < 0.8
    again, _ = hash_split(df.repartition(7), "k")
    assert a.exceptAll(again).count() == 0
    c, d = random_split(df)
    assert c.count() + d.count() == 2000
    buckets = [r[0] for r in df.select(hash_bucket("k")).collect()]
    assert min(buckets) >= 0 and max(buckets) <= 99


def test_checkpointed_node_cache_gives_the_same_forest(users):
    spec = GROUPS["relation"]
    plain = train_group(users, spec, SMALL).predict(users).select("uid_uid", "rf_relation")
    cached = TreeParams(rf_trees=5, rf_depth=4, cache_node_ids=True, checkpoint_every=2)
    assert train_group(users, spec, cached).predict(users).select("uid_uid", "rf_relation").exceptAll(plain).count() == 0


def test_training_of_chosen_groups(users):
    out = train_groups(users, [GROUPS["interaction"]], SMALL)
    assert list(out) == ["interaction"] and isinstance(out["interaction"], GroupModel)


def test_audit_file(spark, users, tmp_path):
    scores = credit_score(users, SMALL, 5, ("uid_uid", "score"))
    path = str(tmp_path / "audit")
    write_audit(scores, path)
    back = readers.read_inferred(spark, path)
    assert back.columns == ["score_all", "score"] and back.count() == users.count()
    with pytest.raises(Exception):
        write_audit(scores, path)


def test_report_judges_only_held_out_rows(spark, users, tmp_path):
    spec = GROUPS["relation"]
    model, report = train_and_evaluate(users, spec, SMALL, save_to=str(tmp_path / "relation"))
    got = {(r["model"], r["metric"]): r["value"] for r in report.collect()}
    assert set(got) == {(m, k) for m in ("rf", "gbt") for k in ("mse", "test_error", "auc_pr", "auc_roc")}
    _, held = hash_split(users, "uid_uid")
    rows = model.predict(held, training=True).select("rf_relation", "uid_flag").collect()
    assert abs(sum((r[0] - r[1]) ** 2 for r in rows) / len(rows) - got["rf", "mse"]) < 1e-9
    assert set(model.parts()) == set(GroupModel.load(spec, str(tmp_path / "relation")).parts()) == {"PREP", "RF", "GBT"}


def test_scaler_sees_all_rows_and_trees_only_theirs(users):
    spec = GROUPS["relation"]
    half = train_group(users, spec, SMALL, fit_on=F.col("uid_uid") % 2 == 0)
    whole = train_group(users, spec, SMALL)
    assert list(half.scaler.mean) == list(whole.scaler.mean)
    only = train_group(users.filter("uid_uid % 2 = 0"), spec, SMALL)
    assert list(only.scaler.mean) != list(whole.scaler.mean)


def test_contract_files_end_to_end(spark, users, tmp_path):
    """Training file without a key, scoring file with one: train, save, load, score, audit."""
    sinks.write_csv(training_table(users), str(tmp_path / "train"))
    sinks.write_csv(scoring_table(users, keyed=True), str(tmp_path / "score"))
    raw = readers.read_inferred(spark, str(tmp_path / "train"))
    assert "uid_uid" not in raw.columns and keyed(users) is users
    table = materialize(keyed(raw), "train")
    save_models(train(table, SMALL, parallelism=5), str(tmp_path / "models"))
    batch = readers.read_scoring_keyed(spark, str(tmp_path / "score"))
    scores = score_groups(batch, load_models(spark, str(tmp_path / "models")), ("uid_uid", "score"))
    write_audit(scores, str(tmp_path / "audit"))
    audit = readers.read_inferred(spark, str(tmp_path / "audit"))
    assert audit.columns == ["score_all", "score"] and audit.count() == users.count()
    assert audit.filter("score_all < 300 OR score_all > 900 OR score_all IS NULL").count() == 0
    # Users with a positive label score higher on the whole: the tables carry a signal.
    means = {r["score"]: r["m"] for r in audit.groupBy("score").agg(F.avg("score_all").alias("m")).collect()}
    assert means[1.0] > means[0.0]


def test_any_group_keeps_its_boosted_trees(spark, users, tmp_path):
    spec = GROUPS["relation"]
    both = train_group(users, spec, SMALL, boosted=True)
    both.save(str(tmp_path / "relation"))
    loaded = GroupModel.load(spec, str(tmp_path / "relation"))
    a, b = (m.predict(users).select("uid_uid", "rf_relation", "gbt_relation") for m in (both, loaded))
    assert a.exceptAll(b).count() == 0
    assert GroupModel.load(spec, str(tmp_path / "relation"), boosted=False).boosted is None
    train_group(users, spec, SMALL).save(str(tmp_path / "relation"))
    assert GroupModel.load(spec, str(tmp_path / "relation")).boosted is None


def test_many_groups_can_all_have_boosted_trees(users):
    specs = [GROUPS["relation"], GROUPS["interaction"]]
    assert all(m.boosted is not None for m in train_groups(users, specs, SMALL, boosted=True).values())


def test_total_needs_all_groups(users, models):
    some = {n: models[n] for n in ("relation", "people")}
    with pytest.raises(ValueError, match="missing"):
        score_groups(users, some, ("uid_uid",))
    weighted = score_groups(users, some, ("uid_uid",), weights={"score_relation": 0.5, "score_people": 0.5})
    row = weighted.first()
    assert abs(row["score_all"] - (row["score_relation"] + row["score_people"]) / 2) < 1e-9


def test_forest_does_not_depend_on_files(users):
    spec = GROUPS["interaction"]
    a, b = (train_group(materialize(users.repartition(n).sortWithinPartitions(F.rand(n)), "layout"), spec, SMALL) for n in (1, 7))
    one, other = (m.predict(users).select("uid_uid", "rf_interaction") for m in (a, b))
    assert one.exceptAll(other).count() == 0


def test_row_numbers_stay_with_their_rows(spark):
    df = keyed(spark.range(100).select((F.col("id") * 7).alias("v")).repartition(5))
    assert [r["uid_uid"] for r in df.orderBy("v").collect()] == [r["uid_uid"] for r in df.orderBy("v").collect()]
    assert df.select("uid_uid").distinct().count() == 100


def test_forest_and_boosted_trees_are_fitted_side_by_side(users, monkeypatch):
    """Each of the two fits starts only when the other has started, too."""
    both = threading.Barrier(2, timeout=60)

    def meeting(make):
        def made(self, spec):
            estimator = make(self, spec)
            fit = estimator.fit
            estimator.fit = lambda df: (both.wait(), fit(df))[1]
            return estimator
        return made

    spec = GROUPS["relation"]
    alone = train_group(users, spec, SMALL), train_group(users, spec, SMALL, forest=False, boosted=True)
    assert alone[0].boosted is None and alone[1].forest is None
    monkeypatch.setattr(TreeParams, "forest", meeting(TreeParams.forest))
    monkeypatch.setattr(TreeParams, "boosted", meeting(TreeParams.boosted))
    model = train_group(users, spec, SMALL, boosted=True)
    assert model.forest.toDebugString.split("\n", 1)[1] == alone[0].forest.toDebugString.split("\n", 1)[1]
    assert model.boosted.toDebugString.split("\n", 1)[1] == alone[1].boosted.toDebugString.split("\n", 1)[1]
