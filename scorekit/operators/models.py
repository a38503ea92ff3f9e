"""Splits, tree models per feature group, and scoring. Fits are MLlib's; scoring is one narrow projection."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (
    GBTRegressionModel,
    GBTRegressor,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.contracts import TRAINING_LABEL, USER_KEY
from ..staging import materialize, shared_root
from .compose import blend_scores, rescale_score, weighted_total
from .features import GROUPS, GroupSpec, feature_columns, group_features
from .moments import Moments, exact_moments
from .profile import column_values, moments_table
from .scaling import scaler_of


@dataclass(frozen=True)
class TreeParams:
    """Model sizes. The defaults are those of the scoring model; smaller ones suit trials.

    ``cache_node_ids`` spares executors from walking every tree again at each level, and checkpoints as it goes: for
    deep trees over many rows. A forest's samples depend on how rows are dealt out, so training rows always go to
    ``partitions`` partitions by their key, whatever the files, executors and cores at hand; raise it with the table.
    """

    rf_trees: int = 30
    rf_depth: int = 10
    gbt_rounds: int = 50
    gbt_depth: int = 10
    bins: int = 32
    seed: int = 42
    cache_node_ids: bool = False
    checkpoint_every: int = 10
    partitions: int = 8

    def forest(self, spec: GroupSpec) -> RandomForestRegressor:
        return RandomForestRegressor(
            featuresCol=scaled_column(spec), labelCol="label", predictionCol=f"rf_{spec.name}",
            numTrees=self.rf_trees, maxDepth=self.rf_depth, maxBins=self.bins,
            impurity="variance", featureSubsetStrategy="auto", seed=self.seed,
            cacheNodeIds=self.cache_node_ids, checkpointInterval=self.checkpoint_every,
        )

    def boosted(self, spec: GroupSpec) -> GBTRegressor:
        return GBTRegressor(
            featuresCol=scaled_column(spec), labelCol="label", predictionCol=f"gbt_{spec.name}",
            maxIter=self.gbt_rounds, maxDepth=self.gbt_depth, maxBins=self.bins,
            lossType="squared", stepSize=0.1, seed=self.seed,
            cacheNodeIds=self.cache_node_ids, checkpointInterval=self.checkpoint_every,
        )


# Working columns carry the group's name, so that several groups can share one frame.
def input_columns(spec: GroupSpec) -> list[str]:
    return [f"_{spec.name}_{f}" for f in spec.features]


def vector_column(spec: GroupSpec) -> str:
    return f"_vector_{spec.name}"


def scaled_column(spec: GroupSpec) -> str:
    return f"_scaled_{spec.name}"


# --- splits --------------------------------------------------------------------------------------------------

def random_split(df: DataFrame, train_share: float = 0.75, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Random training and test parts. Which row goes where depends on partitioning; see ``hash_bucket``."""
    train, test = df.randomSplit([train_share, 1.0 - train_share], seed)
    return train, test


def hash_bucket(key: Column | str) -> Column:
    """0 to 99 from the key's digest: the same on any partitioning, cluster or engine."""
    k = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(k.cast("string")), 1, 8), 16, 10).cast("bigint") % 100


def hash_split(df: DataFrame, key: str, train_percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """Training and test parts by key digest."""
    bucket = hash_bucket(key)
    return df.filter(bucket < train_percent), df.filter(bucket >= train_percent)


# --- group models --------------------------------------------------------------------------------------------

@dataclass
class GroupModel:
    """A fitted feature group: vector preparation (assembler and scaler), its tree models, and the profile of the label (0)
    and the features (from 1) that they were fitted on."""

    spec: GroupSpec
    prepare: PipelineModel
    forest: RandomForestRegressionModel | None = None
    boosted: GBTRegressionModel | None = None
    profile: dict[int, Moments] = field(default_factory=dict)

    @property
    def scaler(self):
        return self.prepare.stages[-1]

    def profile_table(self, spark: SparkSession) -> DataFrame:
        """``column, count, mean, stddev, min, max`` of the label and of each feature, over all rows that the scaler saw."""
        return moments_table(spark, [TRAINING_LABEL, *self.spec.features], self.profile)

    def parts(self) -> dict[str, PipelineModel | RandomForestRegressionModel | GBTRegressionModel]:
        """The fitted parts by the name under which they are saved."""
        found = {"PREP": self.prepare, "RF": self.forest, "GBT": self.boosted}
        return {name: part for name, part in found.items() if part is not None}

    def save(self, base: str) -> int:
        """Add this model to the versions under ``base``; returns its version."""
        return save_models({self.spec.name: self}, base)

    @classmethod
    def load(cls, spec: GroupSpec, base: str, boosted: bool = True) -> GroupModel:
        """Load the latest version that was saved; ``boosted=False`` leaves boosted trees aside."""
        model = load_models(SparkSession.active(), base, [spec])[spec.name]
        return model if boosted else replace(model, boosted=None)

    def inputs(self, training: bool = False) -> dict[str, Column]:
        """The feature columns to add before :meth:`apply`, filled as in scoring, or as in training."""
        return dict(zip(input_columns(self.spec), feature_columns(self.spec, training), strict=True))

    def apply(self, df: DataFrame) -> DataFrame:
        """Predictions from the feature columns; working columns are left in."""
        out = self.prepare.transform(df)
        for model in (self.forest, self.boosted):
            if model is not None:
                out = model.transform(out)
        return out

    def predict(self, df: DataFrame, training: bool = False) -> DataFrame:
        """``df`` with ``rf_<group>`` and, if fitted, ``gbt_<group>``. No shuffle and no join.

        ``training`` fills gaps as in training, to judge held-out rows of the training table.
        """
        out = self.apply(df.withColumns(self.inputs(training)))
        return out.drop(*input_columns(self.spec), vector_column(self.spec), scaled_column(self.spec))


def training_vectors(
    df: DataFrame, spec: GroupSpec, label: str = TRAINING_LABEL, fit_on: Column | None = None, partitions: int = TreeParams.partitions,
) -> tuple[PipelineModel, DataFrame, dict[int, Moments]]:
    """Fit the group's preparation on all rows; with it, the label and scaled vector of the rows to train on, and the profile.

    The table is read once: its features are written, and profile, scaler and vectors come from what was written. Vectors
    are dealt out by a hash of the user key, sorted within partitions, so that every fit sees the same rows in the same
    places. Without a key the features take its part. A feature with a gap, which its group has no fill for, raises.
    """
    inputs, vector, scaled = input_columns(spec), vector_column(spec), scaled_column(spec)
    key = ["_key"] if USER_KEY in df.columns else ["label", *inputs]
    marked = df.withColumn("_fit", F.lit(True) if fit_on is None else fit_on).withColumn("_key", F.col(USER_KEY) if USER_KEY in df.columns else F.lit(0))
    named = group_features(marked, spec, True, label, keep=("_fit", "_key")).toDF("_fit", "_key", "label", *inputs)
    named = materialize(named, "features")
    profile = exact_moments(column_values(named, ["label", *inputs]))
    rows = profile[0].count if profile else 0
    for i, name in enumerate(spec.features, 1):
        if rows and (i not in profile or profile[i].count < rows or profile[i].mean != profile[i].mean):
            raise ValueError(f"{name} has null or NaN values, and the group {spec.name} no fill for them")
    scaler = scaler_of(df.sparkSession, {i - 1: m for i, m in profile.items() if i}, vector, scaled)
    assembler = VectorAssembler(inputCols=inputs, outputCol=vector, handleInvalid="error")
    fitted = scaler.transform(assembler.transform(named.filter("_fit"))).select(*dict.fromkeys(["label", *key]), scaled)
    return PipelineModel([assembler, scaler]), fitted.repartition(partitions, *key).sortWithinPartitions(*key).select("label", scaled), profile


def train_group(
    df: DataFrame, spec: GroupSpec, params: TreeParams = TreeParams(), label: str = TRAINING_LABEL,
    forest: bool = True, boosted: bool | None = None, fit_on: Column | None = None,
) -> GroupModel:
    """Fit one group: features, scaler, forest, and boosted trees where the group blends them (or on request).

    The scaler sees all rows; ``fit_on`` chooses those that the trees learn from, so that the rest can judge them.
    The table is read once, and MLlib keeps its binned rows itself. Forest and boosted trees are fitted side by side, as rounds of
    boosting leave cores idle. The profile of what was learnt from comes with the model.
    """
    shared_root(df.sparkSession)  # so that boosting rounds can checkpoint
    prepare, scaled, profile = training_vectors(df, spec, label, fit_on, params.partitions)
    want_boosted = spec.gbt_share > 0 if boosted is None else boosted
    wanted = [params.boosted(spec) if want_boosted else None, params.forest(spec) if forest else None]

    @inheritable_thread_target(df.sparkSession)
    def fit(estimator: RandomForestRegressor | GBTRegressor | None) -> RandomForestRegressionModel | GBTRegressionModel | None:
        return None if estimator is None else estimator.fit(scaled)

    with ThreadPool(len(wanted)) as pool:
        trees, grown = pool.map(fit, wanted, chunksize=1)
    return GroupModel(spec, prepare, grown, trees, profile)


def train_groups(
    df: DataFrame, specs: Iterable[GroupSpec] = GROUPS.values(), params: TreeParams = TreeParams(),
    label: str = TRAINING_LABEL, parallelism: int = 1, fit_on: Column | None = None, boosted: bool | None = None,
) -> dict[str, GroupModel]:
    """Fit the groups, up to ``parallelism`` at a time. Each fit is its own series of Spark jobs. Boosted trees are
    fitted where a group blends them, or for all groups or none if ``boosted`` says so."""
    specs = list(specs)

    @inheritable_thread_target(df.sparkSession)
    def fit(spec: GroupSpec) -> GroupModel:
        return train_group(df, spec, params, label, boosted=boosted, fit_on=fit_on)

    with ThreadPool(max(1, min(parallelism, len(specs)))) as pool:
        return {m.spec.name: m for m in pool.map(fit, specs, chunksize=1)}


def save_models(models: dict[str, GroupModel], base: str) -> int:
    """Publish the models as the next version under ``base`` and return its number."""
    from .bundle import write_models  # which needs this module

    return write_models(models, base)


def load_models(
    spark: SparkSession, base: str, specs: Iterable[GroupSpec] = GROUPS.values(), version: int | None = None,
) -> dict[str, GroupModel]:
    """The models of one version under ``base``, the latest if none is named, after their files are checked."""
    from .bundle import read_models

    return read_models(spark, base, specs, version)


# --- scoring -------------------------------------------------------------------------------------------------

def group_score(spec: GroupSpec, clamp: bool = False) -> Column:
    """The group's score from its predictions: the forest's, or the blend of both models' scores."""
    rf = rescale_score(f"rf_{spec.name}", clamp)
    if not spec.gbt_share:
        return rf.alias(spec.score_column)
    gbt = rescale_score(f"gbt_{spec.name}", clamp)
    return blend_scores(rf, gbt, spec.rf_share, spec.gbt_share).alias(spec.score_column)


def score_groups(
    df: DataFrame, models: dict[str, GroupModel], keep: Iterable[str], total: bool = True, clamp: bool = False,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Kept columns, each group's score and, if asked, the weighted total ``score_all``.

    The total needs the models of all groups, unless ``weights`` names those to add up by their score columns.
    All scores are columns of one frame over one scan, so nothing is shuffled, joined or paired by position.
    """
    if total and weights is None and set(models) != set(GROUPS):
        raise ValueError(f"score_all needs all groups; missing: {sorted(set(GROUPS) - set(models))}")
    out = df.withColumns({name: c for m in models.values() for name, c in m.inputs().items()})
    for model in models.values():
        out = model.apply(out)
    scores = out.select(*keep, *[group_score(m.spec, clamp) for m in models.values()])
    if not total:
        return scores
    weights = weights or {m.spec.score_column: m.spec.weight for m in models.values()}
    return scores.withColumn("score_all", weighted_total(weights))
