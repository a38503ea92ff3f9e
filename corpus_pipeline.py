"""A training corpus from raw documents: junk out, one of each group of near copies kept, benchmark leaks out, sources
mixed to their weights, and the result written as token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorekit.llm.catalog import encoded
from scorekit.llm.common import load, row_key, small_side
from scorekit.llm.jaccard_join import jaccard_groups
from scorekit.llm.mixing import mix
from scorekit.llm.weak_quality import score_quality
from scorekit.llm.winnow import decontaminate
from scorekit.staging import materialize


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ids and keys are in ``dropped``, with all its columns. Few rows are dropped as a rule,
    so texts stay where they are; if there are many, both sides are shuffled."""
    dropped = materialize(dropped.select(F.col("row").alias("_dropped"), F.col("doc_id").alias("_dropped_id")).distinct(), "dropped")
    key = row_key(docs["doc_id"], docs["text"])
    same = (key == dropped["_dropped"]) & docs["doc_id"].eqNullSafe(dropped["_dropped_id"])
    return docs.join(small_side(dropped, dropped.count(), 48), same, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer does not reject."""
    return _without(docs, score_quality(docs).where("NOT keep"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id. Texts without words are in no group and stay."""
    grouped = materialize(jaccard_groups(docs).select("doc_id", "row", "group"), "grouped")
    first = grouped.where("group IS NOT NULL").groupBy("group").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("n"))
    many = materialize(first.where("n > 1").select("group", F.col("first.row").alias("kept"), F.col("first.doc_id").alias("kept_id")), "groups")
    members = grouped.join(many, "group")
    out = _without(docs, members.where("row <> kept OR NOT doc_id <=> kept_id"))
    # Rows alike in id and text have one key; only where such rows exist are texts compared to leave one of them.
    twice = members.where("row = kept AND doc_id <=> kept_id").groupBy("row").agg(F.count("*").alias("n")).where("n > 1")
    if twice.isEmpty():
        return out
    twice = materialize(twice.select(F.col("row").alias("_twice")), "twice")
    key, side = row_key(out["doc_id"], out["text"]), small_side(twice, twice.count(), 32)
    once = out.join(side, key == twice["_twice"], "left_semi").dropDuplicates(["doc_id", "text"])
    return out.join(side, key == twice["_twice"], "left_anti").unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return _without(docs, decontaminate(docs, load(spark, sf_dir, "benchmark")).where("contaminated"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share of the mix takes them, the last one of a source cut where it ends."""
    return mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix: where its ids start in the files, how many they are, and their checksum."""
    return encoded(spark, docs)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing),
    ("token ids", token_ids),
]

# Neither the fitted scorer nor the tokenizer can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again by the next."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
