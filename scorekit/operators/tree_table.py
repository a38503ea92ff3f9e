"""Tree models as tables, and an evaluator of them.

``nodes`` has one row per node: ``group, model, tree, weight, node, feature, cut, left, right, value``. Node 0 is a tree's root; a row
goes left if its feature is at most ``cut``; a leaf has feature -1. A prediction is the sum of weight times leaf value over
the trees, forest and boosting alike. ``scaling`` has ``group, slot, feature, mean, std``, the slots being what ``feature`` counts.
The evaluator knows nothing of MLlib: it walks arrays of nodes inside one projection.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import GROUPS, GroupSpec, feature_columns
from .models import GroupModel, group_score

# Nodes of one model that are put into a query. 30 trees of depth 10 have 61,410 at most, 50 have 102,350.
MOST_NODES = 1_000_000

_TREES = "array<struct<weight:double,nodes:array<struct<feature:int,cut:double,left:int,right:int,value:double>>>>"


def node_rows(spark: SparkSession, path: str, group: str, model: str) -> DataFrame:
    """The nodes of a forest (``RF``) or of boosted trees (``GBT``) that MLlib saved under ``path``."""
    data, trees = spark.read.load(f"{path}/data"), spark.read.load(f"{path}/treesMetadata").toDF("treeID", "metadata", "weight")
    share = F.lit(1.0) if model == "GBT" else F.lit(1.0 / trees.count())  # a forest's prediction is a mean
    n, split = F.col("nodeData"), F.col("nodeData.split")
    return data.join(trees, "treeID").select(
        F.lit(group).alias("group"), F.lit(model).alias("model"), F.col("treeID").alias("tree"), (F.col("weight") * share).alias("weight"),
        n["id"].alias("node"), split["featureIndex"].alias("feature"), F.get(split["leftCategoriesOrThreshold"], F.lit(0)).alias("cut"),
        n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["prediction"].alias("value"))


def scaling_rows(spark: SparkSession, model: GroupModel) -> DataFrame:
    """Mean and deviation of each slot of a group's vector."""
    rows = [(model.spec.name, i, f, float(m), float(s)) for i, (f, m, s) in enumerate(zip(model.spec.features, model.scaler.mean, model.scaler.std, strict=True))]
    return spark.createDataFrame(rows, "group string, slot int, feature string, mean double, std double")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def walk(nodes: DataFrame, features: Column) -> Column:
    """The prediction of one model, given as its ``nodes``, for an array of scaled features. The nodes become a constant of
    the query, which is as large as the model; more than :data:`MOST_NODES` raise."""
    n = nodes.count()
    if not 0 < n <= MOST_NODES:
        raise ValueError(f"a model of {n} nodes; from 1 to {MOST_NODES} can be walked")
    trees: dict[int, tuple[float, list]] = {}
    for r in nodes.orderBy("tree", "node").collect():
        trees.setdefault(r["tree"], (r["weight"], []))[1].append({k: r[k] for k in ("feature", "cut", "left", "right", "value")})
    table = F.from_json(F.lit(json.dumps([{"weight": w, "nodes": ns} for w, ns in trees.values()])), _TREES)  # folded once
    steps = F.sequence(F.lit(1), F.lit(max(1, *(_depth(ns) for _, ns in trees.values()))))

    def down(x: Column, tree: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            onward = F.when(F.get(x, at["feature"]) <= at["cut"], at["left"]).otherwise(at["right"])
            return F.when(at["feature"] < 0, at).otherwise(F.get(tree["nodes"], onward))

        return F.aggregate(steps, F.get(tree["nodes"], F.lit(0)), step)["value"]

    return _let(features, lambda x: F.aggregate(table, F.lit(0.0), lambda total, tree: total + tree["weight"] * down(x, tree)))


def _depth(nodes: list[dict]) -> int:
    """Steps from the root to the farthest leaf; children come after their parent."""
    depth = [0] * len(nodes)
    for i, n in enumerate(nodes):
        if n["feature"] >= 0:
            depth[n["left"]] = depth[n["right"]] = depth[i] + 1
    return max(depth)


def scaled_features(spec: GroupSpec, scaling: DataFrame, training: bool = False) -> Column:
    """The group's features, filled as in scoring or in training, less their mean and in deviations; 0 for constants."""
    rows = {r["slot"]: r for r in scaling.where(F.col("group") == spec.name).collect()}  # one row per feature
    if [rows[i]["feature"] for i in sorted(rows)] != list(spec.features):
        raise ValueError(f"the tables were fitted on other features of {spec.name}")
    scale = [(r["mean"], 1.0 / r["std"] if r["std"] else 0.0) for r in (rows[i] for i in sorted(rows))]
    return F.array(*[(c - F.lit(m)) * F.lit(s) for c, (m, s) in zip(feature_columns(spec, training), scale, strict=True)])


def walk_groups(
    df: DataFrame, tables: tuple[DataFrame, DataFrame], specs: Iterable[GroupSpec] = GROUPS.values(), training: bool = False,
) -> DataFrame:
    """``df`` with ``rf_<group>`` and ``gbt_<group>`` for the models that the tables hold. One projection over one scan."""
    nodes, scaling = tables
    held = {(r["group"], r["model"]) for r in nodes.select("group", "model").distinct().collect()}
    found = {}
    for spec in specs:
        for model in ("RF", "GBT"):
            if (spec.name, model) in held:
                own = nodes.where((F.col("group") == spec.name) & (F.col("model") == model))
                found[f"{model.lower()}_{spec.name}"] = walk(own, scaled_features(spec, scaling, training))
    return df.withColumns(found)


def walk_scores(df: DataFrame, tables: tuple[DataFrame, DataFrame], keep: Iterable[str], specs: Iterable[GroupSpec] = GROUPS.values()) -> DataFrame:
    """Kept columns and each group's score, from the tables alone."""
    specs = list(specs)
    return walk_groups(df, tables, specs).select(*keep, *[group_score(s) for s in specs])
