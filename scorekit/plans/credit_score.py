"""End to end: train the five groups, score users, combine, and write scores beside the known label."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import evaluate_models
from ..operators.features import GROUPS, GroupSpec, raw_columns
from ..operators.models import GroupModel, TreeParams, hash_bucket, load_models, score_groups, train_group, train_groups
from ..sources.contracts import SCORING_LABEL, TRAINING_LABEL, USER_KEY
from ..sources.readers import read_scoring_keyed
from ..sources.sinks import write_csv
from ..staging import drop_path, folder_names, materialize, publish


def keyed(df: DataFrame) -> DataFrame:
    """``df`` with a user key: its own, or a row number for files without one, written so that it stays with its row."""
    return df if USER_KEY in df.columns else materialize(df.withColumn(USER_KEY, F.monotonically_increasing_id()), "keyed")


def train(
    users: DataFrame, params: TreeParams = TreeParams(), parallelism: int = 1, train_percent: int = 75,
    specs: list[GroupSpec] | None = None, boosted: bool | None = None,
) -> dict[str, GroupModel]:
    """Models for the groups from a written user table: scalers on all users, trees on the training part."""
    fit_on = hash_bucket(USER_KEY) < train_percent
    return train_groups(users, specs or list(GROUPS.values()), params, TRAINING_LABEL, parallelism, fit_on, boosted)


def train_and_evaluate(
    users: DataFrame, spec: GroupSpec, params: TreeParams = TreeParams(), train_percent: int = 75, boosted: bool = True,
    save_to: str | None = None,
) -> tuple[GroupModel, DataFrame]:
    """One group's models, saved if a path is given, and how they judge the held-out users.

    The report has ``model, metric, value``: mean squared error, share of unequal predictions, and both areas.
    """
    bucket = hash_bucket(USER_KEY)
    model = train_group(users, spec, params, TRAINING_LABEL, boosted=boosted, fit_on=bucket < train_percent)
    if save_to is not None:
        model.save(save_to)
    judged = model.predict(users.filter(bucket >= train_percent), training=True)
    kinds = ("rf", "gbt") if model.boosted is not None else ("rf",)
    return model, evaluate_models(judged, {kind: f"{kind}_{spec.name}" for kind in kinds}, TRAINING_LABEL)


def judge_models(users: DataFrame, models: dict[str, GroupModel], train_percent: int = 75) -> DataFrame:
    """``model, metric, value`` of every model of all groups on the held-out users: one scan predicts all of them, and one
    pass judges them. Models are named ``rf_<group>`` and ``gbt_<group>``."""
    judged = users.filter(hash_bucket(USER_KEY) >= train_percent)
    names = []
    for m in models.values():
        judged = m.predict(judged, training=True)
        names += [f"{kind}_{m.spec.name}" for kind, part in (("rf", m.forest), ("gbt", m.boosted)) if part is not None]
    return evaluate_models(judged, {n: n for n in names}, TRAINING_LABEL)


def commit_scores(scores: DataFrame, base: str, batch: str) -> bool:
    """Write a batch's scores below ``base`` once: False, with nothing changed, if a batch of that name is in already, so
    that a run may be repeated after any failure. Readers see all of a batch or nothing."""
    spark, base = scores.sparkSession, base.rstrip("/")
    if batch in folder_names(spark, f"{base}/batches"):
        return False
    trial = f"{base}/_trials/{uuid.uuid4().hex}"
    scores.write.parquet(trial)
    if publish(spark, trial, f"{base}/batches/{batch}"):
        return True
    drop_path(spark, trial)
    return False


def committed_scores(spark: SparkSession, base: str) -> DataFrame:
    """The scores of all committed batches, with the batch's name."""
    base = base.rstrip("/")
    names = folder_names(spark, f"{base}/batches")
    if not names:
        raise FileNotFoundError(f"no batch under {base}")
    parts = [spark.read.parquet(f"{base}/batches/{n}").withColumn("batch", F.lit(n)) for n in names]
    return reduce(DataFrame.unionByName, parts)


def score_file(
    spark: SparkSession, path: str, models: str, base: str, batch: str, keep: tuple[str, ...] = (USER_KEY, SCORING_LABEL),
    version: int | None = None,
) -> bool:
    """Score a keyed scoring file with stored models and commit the result as a batch. False if it is committed already."""
    if batch in folder_names(spark, f"{base.rstrip('/')}/batches"):
        return False
    rows = read_scoring_keyed(spark, path)
    return commit_scores(score_groups(rows, load_models(spark, models, version=version), keep), base, batch)


def credit_score(
    users: DataFrame, params: TreeParams = TreeParams(), parallelism: int = 1, keep: tuple[str, ...] = (USER_KEY,)
) -> DataFrame:
    """Kept columns, five group scores and ``score_all`` for every user. The table is built once and written."""
    specs = list(GROUPS.values())
    needed = dict.fromkeys([*keep, USER_KEY, TRAINING_LABEL, *raw_columns(*specs)])
    users = materialize(users.select(*needed), "users")
    return score_groups(users, train(users, params, parallelism), keep)


def write_audit(scores: DataFrame, path: str, label: str = SCORING_LABEL) -> None:
    """``score_all`` and the known label as CSV with a header; fails if the path exists."""
    write_csv(scores.select("score_all", label), path)
