"""Mixing sources to target weights.

Documents get hash-random keys and are range partitioned by source and key. Totals per range give each range its offset,
so running totals of words need no task that sees a whole source, and each source is cut exactly where its budget ends.
A budget beyond the source's size takes whole passes over it first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import materialize
from .common import SPACED_WORD, row_key, small_side

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def running_totals(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: str, into: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each one, within equal ``by`` and in ``order``.

    Rows are range partitioned and written with the number of their range; only one row per range and group is summed
    across ranges. ``by`` may hold nulls, which form a group and come last.
    """
    keys = [F.col(c).asc_nulls_last() for c in by]
    ranged = materialize(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*by, "_range").agg(F.sum(value).alias("_sum"), F.count("*").alias("_rows"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(sums.select(
        *[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset")), "offsets")
    same = ranged["_range"] == offsets["_of"]
    for c in by:
        same = same & ranged[c].eqNullSafe(offsets[f"_by_{c}"])
    here = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("_inside", F.coalesce(F.sum(value).over(here), F.lit(0)))
    joined = inside.join(small_side(offsets, offsets.count(), 64), same, "left")
    return joined.select(*df.columns, (F.col("_offset") + F.col("_inside")).alias(into))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Budgets of sources: ``sizes`` (source, source_size) with a target each.

    Sources in code-point order, null last, weigh ``weights`` in turn. They share the size of all by weight; what exceeds
    ``max_epochs`` times a source's size is shared among the others, until no source exceeds its limit.
    """
    ranked = running_totals(sizes.withColumn("_one", F.lit(1)), [], [F.col("source").asc_nulls_last()], "_one", "_rank")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights)).cast("int"))
    table = materialize(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_epochs).alias("most")), "sources")
    total = table.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level, full = (total["size"] / total["weight"] if total["weight"] else 0.0), -1
    while True:
        capped = F.col("most") < F.col("weight") * F.lit(float(level))
        used = table.agg(F.sum(F.when(capped, F.col("most"))).alias("size"), F.sum(F.when(capped, F.col("weight"))).alias("weight"), F.count(F.when(capped, 1)).alias("n")).first()
        if used["n"] == full or not total["weight"] or used["weight"] == total["weight"]:
            break
        full = used["n"]
        level = (total["size"] - (used["size"] or 0)) / (total["weight"] - (used["weight"] or 0))
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.lit(float(level)))
    return table.select("source", "source_size", target.alias("target"))


def plan_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How much of each document the mix takes.

    A document's size is its number of words, 0 for a null text. Returns one row per input row: ``doc_id, row, source,
    size, source_size, target, epochs, part, taken``; the mix holds ``epochs`` whole copies of the document and one of
    its first ``part`` words, ``taken`` words in all. Words taken from a source add up to its target, rounded down. The
    order within a source is that of a hash of the id, then of id and text, so reruns agree. Rows without an id or a
    source take part like others; rows alike in id and text may be told apart only by where the cut falls.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("row"), F.col(source).alias("source"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(SPACED_WORD)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias("_key"))
    placed = materialize(running_totals(rows, ["source"], [F.col("_key"), F.col("doc_id"), F.col("row")], "size", "_before"), "placed")
    budgets = materialize(targets(placed.groupBy("source").agg(F.sum("size").alias("source_size"))), "budgets")
    side = small_side(budgets.withColumnRenamed("source", "_of"), budgets.count(), 96)
    quota = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0).cast("long"))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), quota - F.col("epochs") * F.col("source_size") - F.col("_before")))
    out = placed.join(side, F.col("source").eqNullSafe(F.col("_of")), "left").withColumn("epochs", whole).withColumn("part", part)
    return out.select("doc_id", "row", "source", "size", "source_size", "target", "epochs", "part", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed documents: the input's columns, each row as often as :func:`plan_mix` takes it, the last copy cut after
    the words that still fit. Rows of no words are not taken. Rows alike in id and text are taken alike."""
    plan = plan_mix(docs, doc_id, text, source).where("taken > 0").groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(
        F.max("size").alias("_size"), F.max("epochs").alias("_epochs"), F.max("part").alias("_part"))
    plan = materialize(plan, "plan")
    # The row travels as one struct, so that its columns may have any names.
    keyed = docs.select(F.struct("*").alias("_doc"), F.col(doc_id).alias("_doc_id"), F.col(text).alias("_text"), row_key(F.col(doc_id), F.col(text)).alias("_doc_row"))
    joined = keyed.join(small_side(plan, plan.count(), 64), (F.col("_doc_row") == F.col("_row")) & F.col("_doc_id").eqNullSafe(F.col("_id")))
    copies = F.concat(F.array_repeat(F.col("_size"), F.col("_epochs").cast("int")), F.when(F.col("_part") > 0, F.array("_part")).otherwise(F.array().cast("array<bigint>")))
    head = F.array_join(F.slice(F.regexp_extract_all("_text", F.lit(r"[\x20\x09-\x0D]*" + SPACED_WORD), 0), 1, F.col("_words").cast("int")), "")
    cut = F.when(F.col("_words") < F.col("_size"), head).otherwise(F.col("_text"))
    taken = joined.withColumn("_words", F.explode(copies)).select("_doc", cut.alias("_text"))
    return taken.select(*[F.col("_text").alias(c) if c == text else F.col("_doc")[c].alias(c) for c in docs.columns])
