"""Stored models: versions that are whole or not there, their tables, and batches scored from them."""

import shutil

import pytest
from pyspark.sql import functions as F

from scorekit.operators import bundle, evaluate, models
from scorekit.operators.bundle import model_tables, versions
from scorekit.operators.features import GROUPS, raw_columns
from scorekit.operators.models import GroupModel, TreeParams, load_models, save_models, score_groups, train_group
from scorekit.operators.profile import describe_numeric
from scorekit.operators.tree_table import walk, walk_groups, walk_scores
from scorekit.plans.credit_score import commit_scores, committed_scores, judge_models, score_file, train
from scorekit.sources import sinks
from scorekit.sources.user_table import scoring_table
from scorekit.staging import publish

SMALL = TreeParams(rf_trees=4, rf_depth=4, gbt_rounds=3, gbt_depth=3)
SPEC = GROUPS["relation"]


@pytest.fixture(scope="module")
def fitted(users):
    return train(users, SMALL, 5, boosted=True)


@pytest.fixture(scope="module")
def stored(spark, fitted, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("models") / "all")
    save_models(fitted, base)
    return base


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def scores(users, found):
    return score_groups(users, found, ("uid_uid",))


class Killed(BaseException):
    """Stands for a process that ends."""


@pytest.mark.parametrize("at", ["parts", "tables", "publish"])
def test_a_save_that_dies_leaves_the_last_version_whole(spark, users, fitted, tmp_path, monkeypatch, at):
    base, specs = str(tmp_path / "m"), [SPEC, GROUPS["interaction"]]
    some = {s.name: fitted[s.name] for s in specs}
    assert save_models(some, base) == 1

    def latest():
        return score_groups(users, load_models(spark, base, specs), ("uid_uid",), total=False)

    before = latest()

    def dies(*args, **kw):
        raise Killed

    # A process that is killed cleans nothing up.
    monkeypatch.setattr(bundle, "drop_path", lambda *a: None)
    if at == "parts":
        real, calls = bundle.node_rows, []
        monkeypatch.setattr(bundle, "node_rows", lambda *a: dies() if len(calls) == 2 else (calls.append(1), real(*a))[1])
    else:
        monkeypatch.setattr(bundle, {"tables": "_digests", "publish": "publish"}[at], dies)
    with pytest.raises(Killed):
        save_models(some, base)
    monkeypatch.undo()
    assert versions(spark, base) == [1] and any((tmp_path / "m" / "_trials").iterdir())
    assert same(latest(), before)
    assert save_models(some, base) == 2


def test_a_failed_save_cleans_up(spark, fitted, tmp_path, monkeypatch):
    monkeypatch.setattr(bundle, "_digests", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        save_models({"relation": fitted["relation"]}, str(tmp_path / "m"))
    assert versions(spark, str(tmp_path / "m")) == [] and not any((tmp_path / "m" / "_trials").iterdir())
    with pytest.raises(FileNotFoundError):
        load_models(spark, str(tmp_path / "m"))


def test_versions_stay(spark, users, fitted, tmp_path):
    base = str(tmp_path / "m")
    other = train_group(users, SPEC, SMALL)
    assert [fitted["relation"].save(base), other.save(base)] == [1, 2]
    first, second = (load_models(spark, base, [SPEC], v)["relation"] for v in (1, 2))
    assert first.boosted is not None and second.boosted is None
    assert load_models(spark, base, [SPEC])["relation"].boosted is None
    assert same(first.predict(users).select("uid_uid", "rf_relation"), fitted["relation"].predict(users).select("uid_uid", "rf_relation"))
    with pytest.raises(FileNotFoundError):
        load_models(spark, base, [SPEC], 3)
    with pytest.raises(ValueError, match="no group"):
        load_models(spark, base)


def test_a_name_is_published_once(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).mkdir()
        (tmp_path / name / name).touch()
    assert publish(spark, str(tmp_path / "a"), str(tmp_path / "out" / "v000001"))
    assert not publish(spark, str(tmp_path / "b"), str(tmp_path / "out" / "v000001"))
    assert [p.name for p in (tmp_path / "out" / "v000001").iterdir()] == ["a"] and (tmp_path / "b").exists()


def test_a_writer_that_loses_the_name_takes_the_next(spark, fitted, tmp_path, monkeypatch):
    base = str(tmp_path / "m")
    one = {"relation": fitted["relation"]}
    save_models(one, base)
    real, seen = bundle.versions, []
    # The second writer looked before the first one published.
    monkeypatch.setattr(bundle, "versions", lambda *a: real(*a) if seen else (seen.append(1), [])[1])
    assert save_models(one, base) == 2 and real(spark, base) == [1, 2]


@pytest.mark.parametrize("how", ["changed", "missing", "added"])
def test_damage_is_found(spark, fitted, tmp_path, how):
    base = tmp_path / "m"
    save_models({"relation": fitted["relation"]}, str(base))
    data = next((base / "v000001" / "relation_RF" / "data").glob("part-*"))
    if how == "changed":
        raw = bytearray(data.read_bytes())
        raw[len(raw) // 2] ^= 1
        data.write_bytes(bytes(raw))
        next(data.parent.glob(".part-*.crc")).unlink()
    elif how == "missing":
        data.unlink()
    else:
        shutil.copy(data, data.with_name("part-more.parquet"))
    with pytest.raises(ValueError, match="damaged: relation_RF/data"):
        load_models(spark, str(base), [SPEC])


def test_other_features_are_refused(spark, fitted, tmp_path):
    from dataclasses import replace

    save_models({"relation": fitted["relation"]}, str(tmp_path))
    with pytest.raises(ValueError, match="other features"):
        load_models(spark, str(tmp_path), [replace(SPEC, features=SPEC.features[::-1])])
    with pytest.raises(ValueError, match="other features"):
        walk_groups(spark.range(1), model_tables(spark, str(tmp_path)), [replace(SPEC, features=SPEC.features[::-1])])


def test_tables_say_what_the_models_say(spark, users, stored):
    found = load_models(spark, stored)
    tables = model_tables(spark, stored)
    for training in (False, True):
        theirs = users
        for m in found.values():
            theirs = m.predict(theirs, training).withColumnsRenamed({f"{k}_{m.spec.name}": f"_{k}_{m.spec.name}" for k in ("rf", "gbt")})
        ours = walk_groups(theirs, tables, training=training)
        gaps = [F.max(F.abs(F.col(f"{k}_{g}") - F.col(f"_{k}_{g}"))) for k in ("rf", "gbt") for g in GROUPS]
        assert max(ours.agg(*gaps).first()) < 1e-9
    a = walk_scores(users, tables, ("uid_uid",)).join(scores(users, found).withColumnsRenamed({s.score_column: f"_{s.name}" for s in GROUPS.values()}), "uid_uid")
    assert a.agg(*[F.max(F.abs(F.col(s.score_column) - F.col(f"_{s.name}"))).alias(s.name) for s in GROUPS.values()]).first()["people"] < 1e-9


def test_walking_is_one_narrow_stage(spark, users, stored):
    plan = walk_scores(users, model_tables(spark, stored), ("uid_uid",))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("FileScan") == 1 and "Python" not in plan


NODES = "tree int, weight double, node int, feature int, cut double, left int, right int, value double"


def test_walk_by_hand(spark):
    """A tree of two levels, and one that is a single leaf; ties go left."""
    nodes = spark.createDataFrame([
        (0, 0.5, 0, 1, 2.0, 1, 4, 9.0), (0, 0.5, 1, 0, -1.0, 2, 3, 9.0), (0, 0.5, 2, -1, None, -1, -1, 1.0), (0, 0.5, 3, -1, None, -1, -1, 2.0),
        (0, 0.5, 4, -1, None, -1, -1, 3.0), (1, 2.0, 0, -1, None, -1, -1, 10.0)], NODES)
    rows = spark.createDataFrame([(-1.0, 2.0), (0.0, 2.0), (0.0, 2.1)], "a double, b double")
    got = [r[0] for r in rows.select(walk(nodes, F.array("a", "b"))).collect()]
    assert got == [20.5, 21.0, 21.5]
    with pytest.raises(ValueError, match="0 nodes"):
        walk(nodes.limit(0), F.array("a"))


def test_the_profile_comes_with_the_model(spark, users, stored):
    model = load_models(spark, stored)["people"]
    want = describe_numeric(users.select(F.col("uid_flag").cast("double"), *[F.col(c).cast("double") for c in GROUPS["people"].features]))
    assert same(model.profile_table(spark), want)


def test_training_reads_its_table_once(spark, users, tmp_path, monkeypatch):
    """The table is gone as soon as the features are written; scaler, profile and both models still come out the same."""
    whole = train_group(users, SPEC, SMALL, boosted=True)
    columns = ["uid_uid", "uid_flag", *raw_columns(SPEC)]
    users.select(*columns).write.parquet(str(tmp_path / "users"))
    real, written = models.materialize, []

    def then_gone(df, name="stage"):
        out = real(df, name)
        written.append(name)
        shutil.rmtree(tmp_path / "users")
        return out

    monkeypatch.setattr(models, "materialize", then_gone)
    once = train_group(spark.read.parquet(str(tmp_path / "users")), SPEC, SMALL, boosted=True)
    assert written == ["features"] and once.profile == whole.profile
    pick = ("uid_uid", "rf_relation", "gbt_relation")
    assert same(once.predict(users).select(*pick), whole.predict(users).select(*pick))


def test_gaps_raise_in_any_row(users):
    gappy = users.withColumn("com_idno_count", F.when(F.col("uid_uid") != 5, F.col("com_idno_count")))
    with pytest.raises(ValueError, match="com_idno_count has null"):
        train_group(gappy, SPEC, SMALL, fit_on=F.col("uid_uid") != 5)


def test_all_models_are_judged_together(users, fitted):
    got = {(r["model"], r["metric"]): r["value"] for r in judge_models(users, fitted).collect()}
    assert len(got) == 10 * 4
    held = users.where(models.hash_bucket("uid_uid") >= 75)
    judged = fitted["relation"].predict(held, training=True)
    for r in evaluate.evaluation_report(judged, "gbt_relation", "uid_flag").collect():
        assert abs(got["gbt_relation", r["metric"]] - r["value"]) < 1e-9


def test_batches_are_committed_once(spark, users, stored, tmp_path):
    sinks.write_csv(scoring_table(users, keyed=True), str(tmp_path / "score"))
    base, args = str(tmp_path / "out"), (spark, str(tmp_path / "score"), stored, str(tmp_path / "out"))
    with pytest.raises(FileNotFoundError):
        committed_scores(spark, base)
    assert score_file(*args, "monday") and not score_file(*args, "monday") and score_file(*args, "tuesday")
    out = committed_scores(spark, base)
    assert {(r["batch"], r["count"]) for r in out.groupBy("batch").count().collect()} == {("monday", users.count()), ("tuesday", users.count())}
    want = scores(users.withColumn("uid_uid", F.col("uid_uid").cast("string")), load_models(spark, stored))
    monday = out.where("batch = 'monday'").select(*want.columns)
    assert monday.join(want.select("uid_uid", F.col("score_all").alias("_all")), "uid_uid").where("abs(score_all - _all) > 1e-9").count() == 0


def test_a_batch_that_fails_can_be_repeated(spark, tmp_path):
    bad = spark.range(3).select(F.when(F.col("id") < 2, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("bigint")).alias("v"))
    base = str(tmp_path / "out")
    with pytest.raises(Exception, match="lost"):
        commit_scores(bad, base, "b")
    with pytest.raises(FileNotFoundError):
        committed_scores(spark, base)
    assert commit_scores(spark.range(3), base, "b") and committed_scores(spark, base).count() == 3


def test_one_group_loads_alone(spark, users, fitted, tmp_path):
    fitted["people"].save(str(tmp_path))
    back = GroupModel.load(GROUPS["people"], str(tmp_path), boosted=False)
    assert back.boosted is None and same(back.predict(users).select("uid_uid", "rf_people"), fitted["people"].predict(users).select("uid_uid", "rf_people"))
