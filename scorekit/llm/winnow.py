"""Benchmark decontamination by winnowing.

Of the k-gram hashes in each sliding stretch of words the smallest is kept. A span of ``span`` words holds exactly one
stretch of k-grams, so its kept hash is kept in every text that holds the span: joining kept hashes finds every shared
span, and each hit is then extended to the span's words and compared with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import materialize
from .common import PLAIN_WORD, ascii_lower, let, row_key, small_side

GRAM = 5


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(PLAIN_WORD), 0)


def stretch_minima(ws: Column, span: int) -> Column:
    """For each start of ``span`` words, the smallest hash of the k-grams inside; empty if there are fewer words."""
    k = min(GRAM, span)
    width = span - k + 1
    empty = F.array().cast("array<bigint>")

    def minima(hs: Column) -> Column:
        if width == 1:
            return hs
        starts = F.sequence(F.lit(0), F.size(hs) - width)
        return F.transform(starts, lambda j: F.least(*[F.get(hs, j + o) for o in range(width)]))

    grams = F.transform(F.sequence(F.lit(0), F.size(ws) - k), lambda i: F.xxhash64(*[F.get(ws, i + o) for o in range(k)]))
    return F.when(F.size(ws) >= span, let(grams, minima)).otherwise(empty)


def decontaminate(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", span: int = 10,
) -> DataFrame:
    """How much of each document repeats benchmark items word for word.

    A window is any ``span`` consecutive words of an item, or a whole item of fewer; words are lower-cased (A-Z). Returns
    one row per input row: ``doc_id, row, n_words, n_hit, n_items, item_ids, contaminated``, where ``n_hit`` counts the words
    inside occurrences of windows and ``item_ids`` lists, as sorted strings, the items whose windows occur. A null text
    has no words; ``row`` is the :func:`row_key`; an item without words has no window; an item without an id marks words but is not listed. Rows that
    share an id are judged each by its own text. Empty tables on either side give no hits.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    windows, members, spans = _windows(items, item_id, item_text, span)

    def kept(ws: Column) -> Column:
        def of_span(s: int) -> Column:
            return F.transform(F.array_distinct(stretch_minima(ws, s)), lambda h: F.struct(F.lit(s).alias("s"), h.alias("h")))

        parts = [of_span(s) for s in spans]
        none = F.array().cast("array<struct<s:int,h:bigint>>")
        return F.struct(F.size(ws).alias("n_words"), (F.concat(*parts) if parts else none).alias("marks"))

    keyed = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row"), "text")
    read = keyed.select("doc_id", "row", let(words(F.col("text")), kept).alias("k"))
    marked = materialize(read.select("doc_id", "row", "k.n_words", "k.marks"), "marks")

    hashes = windows.select("s", "h").distinct()
    held = windows.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.array_join("ws", ""))).alias("bytes"), F.sum("s").alias("words")).first()
    n_windows, window_bytes = held["n"], 64 * held["n"] + (held["bytes"] or 0) + 32 * (held["words"] or 0)
    # A hash alone may be shared by rows of different ids; ids and hash together tell rows apart, null ids included.
    key = F.struct("doc_id", "row").alias("key")
    pairs = marked.select(key, F.explode("marks").alias("m")).select("key", "m.s", "m.h")
    hit_rows = pairs.join(small_side(hashes, n_windows, 64), ["s", "h"], "left_semi").distinct()
    found = materialize(hit_rows.groupBy("key").agg(F.collect_set(F.struct("s", "h")).alias("found")), "found")
    n_found = found.agg(F.count("*").alias("n"), F.sum(F.size("found")).alias("m")).first()

    # The words around each hit, for the documents that have one.
    def sites(ws: Column, hits: Column) -> Column:
        def of_span(s: int) -> Column:
            at = F.transform(stretch_minima(ws, s), lambda h, j: F.struct(F.lit(s).alias("s"), h.alias("h"), j.alias("at")))
            near = F.filter(at, lambda x: F.array_contains(hits, F.struct(x["s"].alias("s"), x["h"].alias("h"))))
            return F.transform(near, lambda x: F.struct(
                x["s"].alias("s"), x["h"].alias("h"), x["at"].alias("at"), F.slice(ws, x["at"] + 1, F.lit(s)).alias("ws")))

        parts = [of_span(s) for s in spans]
        return F.concat(*parts) if parts else F.array().cast("array<struct<s:int,h:bigint,at:int,ws:array<string>>>")

    candidates = keyed.select(key, "text").join(small_side(found, (n_found["n"] or 0) * 4 + (n_found["m"] or 0), 32), "key")
    opened = candidates.select("key", let(words(F.col("text")), lambda ws: sites(ws, F.col("found"))).alias("xs")) \
        .select("key", F.explode("xs").alias("x")).select("key", "x.*")
    hits = materialize(opened.join(small_side(windows, 1, window_bytes), ["s", "h", "ws"]).select("key", "s", "at", "window"), "hits")

    spots = hits.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("at", "s"))).alias("spots"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))

    def cover(acc: Column, x: Column) -> Column:
        end = F.greatest(acc["end"], x["at"] + x["s"])
        return F.struct(end.alias("end"), (acc["total"] + end - F.greatest(acc["end"], x["at"])).alias("total"))

    covered = spots.select("key", F.aggregate("spots", start, cover)["total"].cast("long").alias("n_hit"))
    named = hits.select("key", "window").distinct().join(small_side(members, members.count(), 64), "window") \
        .select("key", "item_id").distinct().groupBy("key").agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("item_ids"))
    found_rows = covered.join(named, "key", "left")

    zero = F.lit(0).cast("long")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return marked.select("doc_id", "row", "n_words", key).join(found_rows, "key", "left").select(
        "doc_id", "row", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", zero).alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
    )


def _windows(items: DataFrame, item_id: str, item_text: str, span: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """Distinct windows (span, hash, words, number), the items each belongs to, and the span lengths that occur."""
    texts = items.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("ws")).where(F.size("ws") > 0)
    length = F.least(F.size("ws"), F.lit(span))
    cut = texts.select("item_id", length.alias("s"), F.explode(F.transform(
        F.sequence(F.lit(0), F.size("ws") - length), lambda i: F.slice("ws", i + 1, length))).alias("ws"))
    cut = materialize(cut.distinct(), "windows")
    spans = sorted(r["s"] for r in cut.select("s").distinct().collect())  # at most ``span`` numbers
    smallest = F.lit(None).cast("bigint")
    for s in spans:
        smallest = F.when(F.col("s") == s, F.get(stretch_minima(F.col("ws"), s), F.lit(0))).otherwise(smallest)
    ws = cut.select("s", "ws").distinct().select("s", "ws", smallest.alias("h"))
    named = materialize(ws.withColumn("window", F.monotonically_increasing_id()), "windows")
    members = materialize(cut.where("item_id is not null").join(named.select("s", "ws", "window"), ["s", "ws"]).select("window", "item_id").distinct(), "members")
    return named, members, spans
