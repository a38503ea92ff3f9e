"""Models on disk: versions that are published whole, with a manifest, and their trees as plain tables beside them.

``<base>/v000001`` and so on hold ``<group>_PREP``, ``<group>_RF`` and, where fitted, ``<group>_GBT`` as MLlib saves them, ``nodes``
and ``scaling`` with the same models as rows (:mod:`.tree_table`), and ``manifest``: what the version holds, and length and
digest of each file. A version is written under another name and renamed when it is complete; no version is ever
overwritten. So a save that dies half-way, or two at a time, leave every version that can be seen whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import drop_path, folder_names, publish
from .features import GROUPS, GroupSpec
from .models import GroupModel
from .moments import Moments
from .tree_table import node_rows, scaling_rows

_KINDS = {"PREP": PipelineModel, "RF": RandomForestRegressionModel, "GBT": GBTRegressionModel}


def versions(spark: SparkSession, base: str) -> list[int]:
    """The published versions, in order."""
    return sorted(int(n[1:]) for n in folder_names(spark, base) if n.startswith("v") and n[1:].isdigit())


def version_path(spark: SparkSession, base: str, version: int | None = None) -> str:
    """The folder of a version, the latest if none is named."""
    known = versions(spark, base)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no model version {version if version is not None else ''} under {base}")
    return f"{base}/v{known[-1] if version is None else version:06d}"


def _digests(spark: SparkSession, folder: str) -> dict[str, list]:
    """Length and SHA-256 of each file below a folder, computed where the files are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    rows = files.select("path", "length", F.sha2("content", 256).alias("digest")).collect()  # a few files for each model
    name = folder.rstrip("/").rsplit("/", 1)[1]
    return {r["path"].split(f"/{name}/", 1)[1]: [r["length"], r["digest"]] for r in rows if f"/{name}/manifest/" not in r["path"]}


def write_models(models: dict[str, GroupModel], base: str) -> int:
    """Write the models as the next version under ``base`` and return its number. A save that fails publishes nothing."""
    spark, base = SparkSession.active(), base.rstrip("/")
    trial = f"{base}/_trials/{uuid.uuid4().hex}"
    try:
        groups, nodes, scaling = {}, None, None
        for name, model in models.items():
            for part, fitted in model.parts().items():
                fitted.write().save(f"{trial}/{name}_{part}")
                if part != "PREP":
                    rows = node_rows(spark, f"{trial}/{name}_{part}", name, part)
                    nodes = rows if nodes is None else nodes.unionByName(rows)
            rows = scaling_rows(spark, model)
            scaling = rows if scaling is None else scaling.unionByName(rows)
            groups[name] = {
                "features": list(model.spec.features), "parts": list(model.parts()),
                "profile": {i: [m.count, m.mean, m.std, m.least, m.greatest] for i, m in model.profile.items()}}
        for table, rows in (("nodes", nodes), ("scaling", scaling)):
            if rows is not None:
                rows.coalesce(1).write.parquet(f"{trial}/{table}")  # as many rows as the models have nodes
        manifest = json.dumps({"groups": groups, "files": _digests(spark, trial)})
        spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{trial}/manifest")
        number = (versions(spark, base) or [0])[-1] + 1
        while not publish(spark, trial, f"{base}/v{number:06d}"):
            number += 1
        return number
    except BaseException:
        drop_path(spark, trial)
        raise


def read_manifest(spark: SparkSession, folder: str, check: bool = True) -> dict:
    """What a version holds. Unless told otherwise, every file is held against its length and digest."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()["value"])
    if check and (found := _digests(spark, folder)) != manifest["files"]:
        wrong = sorted(k for k in {*found, *manifest["files"]} if found.get(k) != manifest["files"].get(k))
        raise ValueError(f"{folder} is damaged: {', '.join(wrong[:5])}")
    return manifest


def read_models(
    spark: SparkSession, base: str, specs: Iterable[GroupSpec] = GROUPS.values(), version: int | None = None,
) -> dict[str, GroupModel]:
    """The models of one version, the latest if none is named. Groups must have the features they were fitted with."""
    folder = version_path(spark, base.rstrip("/"), version)
    held = read_manifest(spark, folder)["groups"]
    out = {}
    for spec in specs:
        if spec.name not in held:
            raise ValueError(f"{folder} has no group {spec.name}")
        if held[spec.name]["features"] != list(spec.features):
            raise ValueError(f"{folder} was fitted on other features of {spec.name}")
        parts = {p: _KINDS[p].load(f"{folder}/{spec.name}_{p}") for p in held[spec.name]["parts"]}
        profile = {int(i): Moments(*m) for i, m in held[spec.name]["profile"].items()}
        out[spec.name] = GroupModel(spec, parts["PREP"], parts.get("RF"), parts.get("GBT"), profile)
    return out


def model_tables(spark: SparkSession, base: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes and the scaling of one version, for :mod:`.tree_table`."""
    folder = version_path(spark, base.rstrip("/"), version)
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/scaling")
