"""Standardisation and min-max scaling of vector columns."""

from __future__ import annotations

import uuid

from pyspark.ml.common import _py2java
from pyspark.ml.feature import MinMaxScaler, MinMaxScalerModel, StandardScalerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import literal_rows
from .features import assemble
from .moments import Moments, exact_moments


def fit_scaler(df: DataFrame, input_col: str = "features", output_col: str = "scaled") -> StandardScalerModel:
    """Mean and sample standard deviation per feature, in one distributed aggregate with exact sums (:mod:`.moments`), so that
    neither depends on partitions. The model is MLlib's, whose own estimator adds up doubles."""
    slots = df.select(F.posexplode(vector_to_array(F.col(input_col))).alias("column", "value"))
    return scaler_of(df.sparkSession, exact_moments(slots), input_col, output_col)


def scaler_of(spark: SparkSession, moments: dict[int, Moments], input_col: str, output_col: str) -> StandardScalerModel:
    """A scaler with these means and deviations of slots 0, 1, 2 and so on."""
    if not moments:
        raise ValueError("no rows to fit a scaler on")
    slots = [moments[i] for i in range(len(moments))]
    mean, std = Vectors.dense([m.mean for m in slots]), Vectors.dense([m.std or 0.0 for m in slots])
    context = spark.sparkContext
    java = context._jvm.org.apache.spark.ml.feature.StandardScalerModel(
        f"StandardScaler_{uuid.uuid4().hex[:12]}", _py2java(context, std), _py2java(context, mean))
    model = StandardScalerModel(java)
    return model._set(withMean=True, withStd=True, inputCol=input_col, outputCol=output_col)


def scaler_summary(model: StandardScalerModel, source: DataFrame, features: list[str]) -> DataFrame:
    """``feature, mean, std``: one row per vector slot."""
    rows = [(n, float(m), float(s)) for n, m, s in zip(features, model.mean, model.std, strict=True)]
    return literal_rows(source.sparkSession, ["feature", "mean", "std"], rows)


def min_max_scale(df: DataFrame, features: list[str], output_col: str = "scaled") -> tuple[MinMaxScalerModel, DataFrame]:
    """Fit on ``df`` and scale each feature to [0, 1]; a constant feature becomes 0.5. Returns model and frame."""
    assembled = assemble(df, features, "_minmax_in")
    model = MinMaxScaler(inputCol="_minmax_in", outputCol=output_col).fit(assembled)
    return model, model.transform(assembled).drop("_minmax_in")


def unpack(df: DataFrame, vector: str, names: list[str], *keep: str) -> DataFrame:
    """Vector slots as double columns."""
    values = vector_to_array(F.col(vector))
    return df.select(*keep, values.alias("_v")).select(*keep, *[F.col("_v")[i].alias(n) for i, n in enumerate(names)])
