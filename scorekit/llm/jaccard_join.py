"""Links between documents whose sets of word n-grams have a Jaccard similarity of 0.8 or more, by T-occurrence search.

A document can only have a partner with which it shares one of its first tokens in a fixed order of all tokens. That
order puts tokens of many documents last, so that common passages cause no candidates. Candidates meet in shards: a
shard holds inverted lists over the whole sets of its documents, and a query merges the short ones of its lists, probes
the long ones, and keeps the documents that occur in enough of them.

Documents with equal sets are one class throughout, and links inside a component that is already known are not sought
again: a group of thousands of near copies costs one link each, and no two different texts that are linked end up apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import drop_path, materialize, new_path
from .common import SPACED_WORD, ascii_lower, let, row_key, small_side
from .graph import components

GRAM = 5
COMMON = 16  # documents from which a token counts as common
COMMON_MOST = 1 << 20  # common tokens at most; more of them raise the number of documents that makes one
SHARD = 2_000_000  # tokens of the sets in a shard
ROWS = 1000  # sets that a worker turns into heads at once


def token_set(text: Column) -> Column:
    """Distinct hashes of the word n-grams, ascending; all words as one if they are fewer, none without words."""
    def grams(ws: Column) -> Column:
        several = F.transform(F.sequence(F.lit(0), F.size(ws) - GRAM), lambda i: F.xxhash64(*[F.get(ws, i + o) for o in range(GRAM)]))
        return F.when(F.size(ws) >= GRAM, F.sort_array(F.array_distinct(several))).when(F.size(ws) > 0, F.array(F.xxhash64(ws))).otherwise(
            F.array().cast("array<bigint>"))

    return let(F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(SPACED_WORD), 0), grams)


def needed(n: Column) -> Column:
    """Tokens that a set of ``n`` shares at least with a partner."""
    return F.ceil(n * 4 / F.lit(5.0)).cast("int")


class Shard:
    """Inverted lists over sets of tokens."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        tokens = np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64)
        owners = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, self.owners = tokens[order], owners[order]
        self.tokens, self.starts = np.unique(tokens, return_index=True)
        self.ends = np.append(self.starts[1:], len(tokens))

    def search(self, query: np.ndarray) -> np.ndarray:
        """Numbers of the sets with a Jaccard similarity to ``query`` of 0.8 or more."""
        least = -(-4 * len(query) // 5)
        if not len(query) or not len(self.tokens):
            return np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        if len(at) < least:
            return np.zeros(0, dtype=np.int64)
        starts, ends = self.starts[at], self.ends[at]
        order = np.argsort(ends - starts, kind="stable")
        starts, ends = starts[order], ends[order]
        longest = int(ends[-1] - starts[-1])
        skip = min(int(least / (0.01 * math.log2(longest + 1) + 1)), least - 1)
        keep = len(starts) - skip
        # Sorting the short lists' entries merges them; an entry of k lists comes k times.
        found, times = np.unique(np.concatenate([self.owners[a:b] for a, b in zip(starts[:keep], ends[:keep], strict=True)]), return_counts=True)
        for k in range(keep, len(starts)):
            enough = times >= least - (len(starts) - k)
            found, times = found[enough], times[enough]
            if not len(found):
                return found
            own = self.owners[starts[k]:ends[k]]
            place = np.minimum(np.searchsorted(own, found), len(own) - 1)
            times = times + (own[place] == found)
        return found[(times >= least) & (5 * times >= 4 * (len(query) + self.sizes[found] - times))]


def search_shards(members: DataFrame) -> DataFrame:
    """Links (a, b) found by the queries of each shard among its indexed documents.

    ``members`` has ``shard, part, indexed, node, comp, tokens``; a query is not looked up within its own component, and one
    link to each other component is enough. A shard's queries are spread over parts, each of which has the whole index.
    """
    def search(rows: pd.DataFrame) -> pd.DataFrame:
        index = rows[rows["indexed"]].drop_duplicates("node")
        shard = Shard(index["tokens"].tolist())
        nodes, comps = index["node"].to_numpy(), index["comp"].to_numpy()
        links = []
        asked = rows[~rows["indexed"]].drop_duplicates("node")
        for node, comp, tokens in zip(asked["node"], asked["comp"], asked["tokens"], strict=True):
            hits = shard.search(np.asarray(tokens))
            hits = hits[comps[hits] != comp]
            _, first = np.unique(comps[hits], return_index=True)
            links += [(node, b) for b in nodes[hits[first]]]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return members.groupBy("shard", "part").applyInPandas(search, "a bigint, b bigint")


def jaccard_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of documents connected by links of similarity 0.8 or more between their sets of five-word shingles.

    Returns one row per input row: ``doc_id, row, n_shingles, component_id, group``. ``component_id`` is the smallest id
    of the group, null if all its ids are; ``group`` names the group also then, and is null for texts without words;
    ``row`` is the :func:`row_key`. Words are split at ASCII white space and lower-cased (A-Z). A text of fewer than five words has
    the whole sequence as its one shingle; a null or wordless one has none and is linked with nothing. Repeated rows and
    rows that share an id are documents of their own. Shingles are compared by 64-bit hashes, as are whole sets.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # Twice as many leading tokens as needed, for documents some of whose first ones are common.
    sets = rows.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row"), token_set(F.col("text")).alias("ts"))
    n = F.size("ts")
    lead = (n - needed(n) + 1).alias("lead")
    base = sets.select("doc_id", "row", F.xxhash64("ts").alias("key"), n.alias("n"), F.monotonically_increasing_id().alias("node"), lead, F.slice("ts", 1, (lead * 2).cast("int")).alias("first"))
    path = new_path(docs.sparkSession, "sets")
    base.write.parquet(path)
    wide = docs.sparkSession.read.schema(base.schema).parquet(path)
    base = materialize(wide.drop("lead", "first"), "rows")

    # A class is named by one of its rows.
    keyed = base.where("n > 0").groupBy("key").agg(F.min("node").alias("node"), F.count("*").alias("rows"), F.min("doc_id").alias("least_id"))
    keyed = materialize(keyed, "classes")
    copied = keyed.where("rows > 1").select("key", F.col("node").alias("named"))
    others = base.where("n > 0").select("key", "node").join(copied, "key").where("node <> named").select("node")
    others = materialize(others, "copies")
    side = small_side(others, others.count(), 32)
    classes = wide.where("n > 0").join(side, "node", "left_anti").select("node", "row", "n", "lead", "first")
    nodes = _heads(rows, classes, _common_tokens(classes))
    drop_path(docs.sparkSession, path)
    links = _links(rows, nodes)

    roots = components(links)
    named = keyed.join(roots, "node", "left").select("key", "least_id", F.coalesce("root", "node").alias("root"))
    named = materialize(named, "named")
    tops = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    owner = materialize(named.join(tops, "root").select("key", "component_id", F.col("root").alias("group")), "groups")
    out = base.select("doc_id", "row", "key", "n").join(owner, "key", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "row", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"), "group")


def _common_tokens(classes: DataFrame) -> DataFrame:
    """Tokens in the leading parts of more than :data:`COMMON` documents, with their number.

    Documents that have one among their first tokens are looked at twice as deep, as that is where others take its place.
    """
    def counted(tokens: DataFrame) -> DataFrame:
        return tokens.groupBy("t").agg(F.count("*").alias("n")).where(f"n > {COMMON}")

    near = materialize(counted(classes.select(F.explode(F.slice("first", 1, F.col("lead"))).alias("t"))), "near")
    hit = classes.select("node", F.explode(F.slice("first", 1, F.col("lead"))).alias("t")).join(small_side(near, near.count(), 48), "t", "left_semi").select("node").distinct()
    hit = materialize(hit, "hit")
    deep = counted(classes.join(small_side(hit, hit.count(), 32), "node", "left_semi").select(F.explode("first").alias("t")))
    both = materialize(near.unionByName(deep).groupBy("t").agg(F.max("n").alias("n")), "common")
    sizes = sorted(((r["b"], r["k"]) for r in both.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count("*").alias("k")).collect()), reverse=True)
    total, floor = 0, 0
    for b, k in sizes:  # one row per power of two
        total += k
        if total > COMMON_MOST:
            floor = 2 ** (b + 1)
            break
    return both.where(F.col("n") >= floor)


_HEADS = "node bigint, row bigint, n int, lead int, head array<bigint>, last bigint, short boolean"


def _heads(rows: DataFrame, classes: DataFrame, common: DataFrame) -> DataFrame:
    """``node, row, n, lead, head, last``: the ``lead`` first tokens of each class in the order that puts common tokens
    last, and the last one of them, or the largest number if that is common."""
    table = classes.sparkSession.sparkContext.broadcast(np.sort(np.array([r["t"] for r in common.select("t").collect()], dtype=np.int64)))  # COMMON_MOST at most

    def flagged(tokens: np.ndarray) -> np.ndarray:
        known = table.value
        if not len(known):
            return np.zeros(len(tokens), dtype=bool)
        return known[np.minimum(np.searchsorted(known, tokens), len(known) - 1)] == tokens

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The first tokens where the leading part shows them; else none, and ``short`` is set."""
        for whole in batches:
            for a in range(0, len(whole), ROWS):
                yield picked_of(whole.iloc[a:a + ROWS])

    def picked_of(batch: pd.DataFrame) -> pd.DataFrame:
        heads, last, short = [], [], []
        for size, lead, first in zip(batch["n"], batch["lead"], batch["first"], strict=True):
            often = flagged(first)
            rare = first[~often][:lead]
            last.append(int(rare[-1]) if len(rare) == lead else np.iinfo(np.int64).max)
            if len(rare) < lead and len(first) == size:
                rare = np.concatenate([rare, first[often][: lead - len(rare)]])
            short.append(len(rare) < lead)
            heads.append(rare if len(rare) == lead else rare[:0])
        return batch[["node", "row", "n", "lead"]].assign(head=heads, last=last, short=short)

    picked = materialize(classes.mapInPandas(pick, _HEADS), "picked")
    short = materialize(picked.where("short").select("node", "row", "n", "lead"), "short")
    # Documents made up mostly of common tokens show their order only as a whole.
    whole = rows.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), "text").join(small_side(short, short.count(), 48), "row").select(
        "node", "row", "n", "lead", token_set(F.col("text")).alias("first"))
    again = materialize(whole.mapInPandas(pick, _HEADS).dropDuplicates(["node"]), "again")
    return picked.where("NOT short").unionByName(again).drop("short")


def _links(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links that connect whatever is connected."""
    classes = nodes.select("node", "row", "n")
    heads = nodes.select("node", F.posexplode("head").alias("pos", "t"))
    stats = heads.groupBy("t").agg(F.count("*").alias("k"), F.min("node").alias("hub")).where(f"k > {COMMON}")
    stats = materialize(stats, "frequent")
    k = stats.count()
    near = comps = None
    if k:
        # Members of frequent tokens are compared with one of them first, which gathers groups of near copies.
        frequent = materialize(heads.join(small_side(stats, k, 64), "t").select("t", "node", "hub", "k"), "members")
        pairs = frequent.where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("shared")).join(classes, "node")
        pairs = materialize(pairs.where(F.col("shared") * 25 >= F.col("n")).select("node", F.col("hub").alias("target")), "pairs")
        placed = _place(classes, None)
        asked = pairs.join(placed.select(F.col("node").alias("target"), "shard"), "target").select("node", "shard").distinct()
        near = materialize(_search(rows, placed, asked, pairs.select(F.col("target").alias("node")).distinct()), "near")
        comps = components(near)

    # Documents that share a passage have its most frequent token in common, and so the shards that they are in.
    homes = frequent.groupBy("node").agg(F.max_by("t", F.struct("k", "t")).alias("home")) if k else None
    placed = _place(classes, comps, homes)
    pairs = _pairs(heads, nodes, stats, k)
    own, far = placed.select("node", "comp"), placed.select(F.col("node").alias("target"), F.col("comp").alias("other"), "shard")
    pairs = materialize(pairs.join(own, "node").join(far, "target").where("comp <> other"), "pairs")
    asked, index = pairs.select("node", "shard"), pairs.select(F.col("target").alias("node"))
    if k:
        some_asked, some_index = _across(frequent, placed)
        asked, index = asked.unionByName(some_asked), index.unionByName(some_index)
    more = materialize(_search(rows, placed, asked.distinct(), index.distinct()), "far")
    return more if near is None else near.unionByName(more)


def _pairs(heads: DataFrame, nodes: DataFrame, stats: DataFrame, k: int) -> DataFrame:
    """Pairs (node, target) that share tokens of their heads, frequent ones aside, and may be similar enough.

    Tokens shared up to the nearer end of both heads are all in the heads, so those and the rest of the set with that
    end bound the overlap. Frequent tokens are not looked at here and count as shared as far as both sets have any.
    """
    rare = heads.join(small_side(stats.select("t"), k, 48), "t", "left_anti") if k else heads
    a, b = rare.select("t", "node", "pos"), rare.select("t", F.col("node").alias("target"), F.col("pos").alias("far_pos"))
    met = a.join(b, "t").where("node < target").groupBy("node", "target").agg(
        F.count("*").alias("shared"), F.max("pos").alias("x"), F.max("far_pos").alias("y"))
    facts = nodes.select("node", "n", "lead", "last")
    if k:
        often = heads.join(small_side(stats.select("t"), k, 48), "t", "left_semi").groupBy("node").agg(F.count("*").alias("often"))
        facts = facts.join(often, "node", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    else:
        facts = facts.withColumn("often", F.lit(0))
    facts = materialize(facts, "facts")
    there = facts.select(*[F.col(c).alias(d) for c, d in zip(facts.columns, ("target", "m", "far_lead", "far_last", "far_often"), strict=True)])
    met = materialize(met, "met").join(facts, "node").join(there, "target")
    behind = F.least(F.col("n") - F.col("x") - 1, F.col("m") - F.col("y") - 1)
    here = F.when(F.col("last") < F.col("far_last"), F.col("n") - F.col("lead")).when(F.col("last") > F.col("far_last"), F.col("m") - F.col("far_lead"))
    most = F.col("shared") + F.least("often", "far_often") + F.least(behind, here)  # least() passes over null
    enough = 9 * most >= 4 * (F.col("n") + F.col("m"))
    return met.where((5 * F.least("n", "m") >= 4 * F.greatest("n", "m")) & enough).select("node", "target")


def _band(n: Column) -> Column:
    """Sets of similarity 0.8 are in the same band of sizes or in neighbouring ones, as neither is 1.26 times the other."""
    return F.floor(F.log(n) / math.log(1.26)).cast("int")


def _place(classes: DataFrame, comps: DataFrame | None, homes: DataFrame | None = None) -> DataFrame:
    """``node, row, n, band, comp, shard``: documents of one home, or else of one component, stay together in a shard. Those
    that are too many are parted by bands of size, and by a hash where a band is too large as well."""
    nodes = classes.select("node", "row", "n", _band(F.col("n")).alias("band"))
    if comps is None:
        nodes = nodes.withColumn("comp", F.col("node"))
    else:
        nodes = nodes.join(comps.withColumnRenamed("root", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    nodes = nodes.withColumn("key", F.col("comp")) if homes is None else nodes.join(homes, "node", "left").withColumn("key", F.coalesce("home", "comp"))
    nodes = materialize(nodes, "nodes")
    total = nodes.agg(F.sum("n").alias("n")).first()["n"] or 0
    large = materialize(nodes.groupBy("key").agg(F.sum("n").alias("size")).where(f"size > {SHARD}").select("key"), "large")
    some = nodes.join(small_side(large, large.count(), 32), "key").groupBy("key", "band").agg(F.ceil(F.sum("n") / F.lit(float(SHARD))).alias("pieces"))
    some = materialize(some, "bands")
    parts = nodes.join(small_side(some, some.count(), 48), ["key", "band"], "left")
    piece = F.when(F.col("pieces").isNotNull(), F.xxhash64("band", F.pmod(F.xxhash64("node"), "pieces"))).otherwise(F.lit(0).cast("long"))
    shard = F.pmod(F.xxhash64(F.col("key"), piece), F.lit(max(1, -(-total // SHARD))))
    return materialize(parts.select("node", "row", "n", "band", "comp", shard.alias("shard")), "placed")


def _across(frequent: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries (node, shard) and documents to index for tokens that hold several components: all members are indexed,
    and all but those of the largest component look into each shard that holds members of others, of sizes that match."""
    frequent = materialize(frequent.select("t", "node").join(placed.select("node", "comp", "band", "shard"), "node"), "members")
    held = frequent.groupBy("t", "comp").agg(F.count("*").alias("k"))
    mixed = held.groupBy("t").agg(F.count("*").alias("kinds"), F.max_by("comp", F.struct("k", "comp")).alias("largest")).where("kinds > 1").select("t", "largest")
    mixed = materialize(mixed, "mixed")
    side = small_side(mixed, mixed.count(), 48)
    homes = frequent.join(side, "t").groupBy("t", "band", "shard").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    small = frequent.join(side, "t").where("comp <> largest").select("t", "node", "comp", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    asked = small.join(homes, ["t", "band"]).where("low <> high OR low <> comp").select("node", "shard").distinct()
    return asked, frequent.join(side, "t", "left_semi").select("node").distinct()


def _search(rows: DataFrame, placed: DataFrame, asked: DataFrame, index: DataFrame) -> DataFrame:
    """Links that the queries ``asked`` (node, shard) have among the documents of ``index`` (node) in those shards."""
    asked = materialize(asked.join(placed.select("node", "n"), "node"), "asked")
    parts = F.ceil(F.sum("n") / F.lit(2.0 * SHARD)).cast("int").alias("parts")
    load = materialize(asked.groupBy("shard").agg(parts), "load")
    side = small_side(load, load.count(), 48)
    query = asked.join(side, "shard").select("node", "shard", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("indexed"))
    held = index.join(placed, "node").join(side, "shard").select(
        "node", "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("indexed"))
    visits = query.unionByName(held).groupBy("node").agg(F.collect_list(F.struct("shard", "part", "indexed")).alias("visits"))
    visits = materialize(visits.join(placed.select("node", "row", "comp"), "node"), "visits")
    read = rows.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), "text").join(small_side(visits, visits.count(), 160), "row")
    sets = read.select("node", "comp", "visits", token_set(F.col("text")).alias("tokens"))
    return search_shards(sets.select(F.explode("visits").alias("v"), "node", "comp", "tokens").select("v.*", "node", "comp", "tokens"))
