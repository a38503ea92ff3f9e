"""Exact duplicates by content-defined chunk recipes.

A text is cut where its content says so, each distinct chunk gets an identifier that stands for exactly one content, and
texts are equal when their ordered lists of identifiers are. Whole texts never move: the recipes do, at a few per cent
of the text's size, and the content of those chunks that occur more than once, combined on the reading side first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import materialize
from .common import let, small_side

SPACES = r"[\x20\x09-\x0D]+"
# At least 512 characters up to a word that ends in two letters of the given halves of the alphabet, or 4096 without one.
CHUNK = r"(?s)(?:.{512,4095}?[a-m][n-z] |.{1,4096})"


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), 0)


def fingerprint(chunk: Column, bits: int) -> Column:
    return F.shiftright(F.xxhash64(chunk), 64 - bits) if bits < 64 else F.xxhash64(chunk)


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """Groups of texts that are identical once every run of ASCII white space counts as one space.

    Returns one row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``. A null text counts as empty; empty
    texts form a group like any other. ``keep_id`` is the smallest id of the group, null only if all ids are. Of rows with
    equal text and equal id exactly one is kept. An empty table gives an empty result. ``bits`` narrows the fingerprint,
    so that tests meet chunks that share one.
    """
    normal = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")
    docs = docs.select(F.col(doc_id).alias("doc_id"), normal.alias("text"))

    def marks(cs: Column) -> Column:
        return F.transform(cs, lambda c: F.struct(fingerprint(c, bits).alias("h"), F.length(c).alias("n"), F.lit(0).alias("v")))

    recipes = materialize(
        docs.select("doc_id", F.sha2("text", 256).alias("text_sha256"), let(chunks(F.col("text")), marks).alias("recipe")), "recipes"
    )
    versions = _versions(docs, recipes, bits)
    if versions is not None:
        recipes = _verified(docs, versions, bits)

    same = Window.partitionBy("doc_id", "recipe").orderBy(F.lit(1))
    rows = recipes.withColumn("copy", F.row_number().over(same))
    groups = recipes.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = materialize(groups.where("group_size > 1"), "groups")  # written, so that the join can split a large group's rows
    out = rows.join(groups, "recipe", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (F.col("copy") == 1)).alias("kept"), "text_sha256",
    )


def _versions(docs: DataFrame, recipes: DataFrame, bits: int) -> DataFrame | None:
    """The chunks whose fingerprint and length belong to more than one content, numbered; None if there are none.

    A fingerprint that occurs once cannot be ambiguous, so only the content of repeated ones is compared.
    """
    marks = recipes.select(F.explode("recipe").alias("m")).select("m.h", "m.n")
    repeated = materialize(marks.groupBy("h", "n").count().where("count > 1").select("h", "n"), "repeated")
    side = small_side(repeated, repeated.count(), 64)
    contents = (
        docs.select(F.explode(chunks(F.col("text"))).alias("chunk"))
        .select(fingerprint(F.col("chunk"), bits).alias("h"), F.length("chunk").alias("n"), "chunk")
        .join(side, ["h", "n"], "left_semi").groupBy("h", "n", "chunk").agg(F.count("*").alias("uses"))
    )
    contents = contents.select("h", "n", "chunk")
    unclear = materialize(contents.groupBy("h", "n").count().where("count > 1").select("h", "n"), "unclear")
    if unclear.isEmpty():
        return None
    numbered = F.row_number().over(Window.partitionBy("h", "n").orderBy("chunk"))
    return materialize(contents.join(unclear, ["h", "n"], "left_semi").withColumn("v", numbered), "versions")


def _verified(docs: DataFrame, versions: DataFrame, bits: int) -> DataFrame:
    """Recipes in which ambiguous fingerprints carry the number of their content."""
    docs = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    pieces = docs.select("row", F.posexplode(chunks(F.col("text"))).alias("at", "chunk")).select(
        "row", "at", fingerprint(F.col("chunk"), bits).alias("h"), F.length("chunk").alias("n"), "chunk")
    entry = F.struct("at", "h", "n", F.coalesce("v", F.lit(0)).alias("v"))
    lists = pieces.join(versions, ["h", "n", "chunk"], "left").groupBy("row").agg(F.array_sort(F.collect_list(entry)).alias("es"))
    recipe = F.transform("es", lambda e: F.struct(e["h"].alias("h"), e["n"].alias("n"), e["v"].alias("v")))
    empty = F.array().cast("array<struct<h:bigint,n:int,v:int>>")
    thin = docs.select("row", "doc_id", F.sha2("text", 256).alias("text_sha256"))
    return materialize(
        thin.join(lists, "row", "left").select("doc_id", "text_sha256", F.coalesce(recipe, empty).alias("recipe")), "verified"
    )
