"""The best documents for each of many queries, term at a time with a limit on accumulators.

Documents are searched in blocks. For a query, a block's inverted lists are read from the rarest term on, each adding to
the accumulators of its documents. Once the terms still to come can no longer lift a new document to the k-th best
partial score, no accumulator is created any more; those that exist are updated exactly, and dropped when out of reach.
Scores are whole numbers, so the order of terms does not change them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import materialize
from .common import BROADCAST_BYTES, PLAIN_WORD, ascii_lower
from .word_payloads import plain

SLOPE = 90  # per cent of a document's length that its size counts with
ENTRY = 100  # bytes that a term takes beside its own in a worker's memory


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Block:
    """Inverted lists of some documents: of each term, the documents in order and what it adds to their scores."""

    def __init__(self, owners: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_docs: int) -> None:
        order = np.argsort(terms, kind="stable")
        self.owners, self.impacts, self.n_docs = owners[order], impacts[order], n_docs
        self.terms, starts = np.unique(terms[order], return_index=True)
        self.starts, self.ends = starts, np.append(starts[1:], len(terms))
        self.most = np.maximum.reduceat(self.impacts, starts) if len(terms) else np.zeros(0, dtype=np.int64)

    def search(self, query: np.ndarray, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that may be among the best ``k`` for ``query``, terms from the rarest on, with their scores above
        zero, and how many accumulators it took. ``floor`` is a score that ``k`` documents elsewhere are known to reach.

        Documents with as much as the k-th score are all returned, as ties are broken by whoever knows the ids.
        """
        at = np.searchsorted(self.terms, query)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == query)] if len(self.terms) else at[:0]
        left = np.append(np.cumsum(self.most[at][::-1])[::-1], 0)
        sums, created = np.zeros(self.n_docs, dtype=np.int64), None
        for i, t in enumerate(at):
            docs, adds = self.owners[self.starts[t]:self.ends[t]], self.impacts[self.starts[t]:self.ends[t]]
            if created is None and left[i] < floor:
                created = open_docs = np.flatnonzero(sums)
            if created is None:
                sums[docs] += adds
                if sums.max(initial=0) > left[i + 1]:
                    floor = max(floor, _kth(sums[sums > 0], k))
                continue
            place = np.minimum(np.searchsorted(docs, open_docs), len(docs) - 1)
            hit = docs[place] == open_docs
            sums[open_docs[hit]] += adds[place[hit]]
            floor = max(floor, _kth(sums[open_docs], k))
            open_docs = open_docs[sums[open_docs] + left[i + 1] >= floor]
        found = np.flatnonzero(sums) if created is None else open_docs
        n_created = len(found) if created is None else len(created)
        found = found[sums[found] >= max(floor, _kth(sums[found], k), 1)]
        return found, sums[found], n_created


def _kth(values: np.ndarray, k: int) -> int:
    """The k-th largest value, 0 if there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0


def postings(docs: DataFrame, vocabulary) -> DataFrame:
    """``doc_id, n, terms, tfs`` of each document with words: how many it has, and which terms of the vocabulary how often."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(vocabulary.value)}
        known = number.keys()
        for batch in batches:
            rows, sizes, ends, terms, tfs = [], [], [0], [], []
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                counts = Counter(plain(text.as_py()).split()) if text.is_valid else None
                if not counts:
                    continue
                hits = sorted((number[w], counts[w]) for w in known & counts.keys())
                terms += [t for t, _ in hits]
                tfs += [n for _, n in hits]
                rows.append(i)
                sizes.append(counts.total())
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int32())), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(read, f"doc_id {kind}, n bigint, terms array<int>, tfs array<int>")


def _best(posted: DataFrame, queries, weights, n_docs: int, n_words: int, k: int) -> DataFrame:
    """``query, doc_id, score`` of the best ``k`` of each task, and of whatever ties with them."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, w = queries.value, weights.value
        best: dict[int, list[tuple[int, bool, object]]] = {}
        kind = None
        for batch in batches:
            ids, kind = batch.column("doc_id"), batch.column("doc_id").type
            m = 100 - SLOPE + SLOPE * batch.column("n").to_numpy() * n_docs // n_words
            lists = batch.column("terms")
            owners = np.repeat(np.arange(len(batch)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            terms, tfs = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
            block = Block(owners, terms, w[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[owners])), len(batch))
            for q, query in asked.items():
                kept = best.get(q, [])
                found, scores, _ = block.search(query, k, -kept[-1][0] if len(kept) == k else 0)
                if len(found):
                    new = ids.take(pa.array(found)).to_pylist()
                    # Best first: higher scores, then smaller ids, null ones last.
                    best[q] = sorted([*kept, *((-s, d is None, d) for s, d in zip(scores.tolist(), new, strict=True))], key=_order)[:k]
        if kind is not None:
            rows = [(q, d, -s) for q, kept in best.items() for s, _, d in kept]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), kind, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["query", "doc_id", "score"])

    kind = posted.schema["doc_id"].dataType.simpleString()
    return posted.mapInArrow(search, f"query bigint, doc_id {kind}, score bigint")


def _order(entry: tuple) -> tuple:
    score, unknown, doc_id = entry
    return (score, unknown, 0 if unknown else doc_id)


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", bytes_at_once: int = BROADCAST_BYTES,
) -> DataFrame:
    """The ``k`` best documents of each item: ``item_id, rank, doc_id, score``, scores above 0 only.

    Terms are runs of ASCII letters (lower-cased), digits and anything beyond ASCII. With N documents that have terms, L
    terms in all of them and n in one, a term of df documents that comes tf times in this one adds
    ``w * (10^9 tf div (1000 tf + 8 m))``, where ``w = floor(1000 ln((2N+2)/(2df+1)))`` and ``m = 10 + (90 n N) div L``; a term that an
    item repeats counts once. Equal scores are ranked by smaller id, null ids last. Rows that share an id are documents, or
    items, of their own, so rows of a repeated item repeat its ranks. Null and wordless texts are neither found nor find
    anything; empty tables give no rows. Items are sent to the executors; where their terms take more than
    ``bytes_at_once`` in memory, they are searched in several rounds, each with a part of the items.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    spark = docs.sparkSession
    words = F.array_distinct(F.regexp_extract_all(ascii_lower(F.coalesce(F.col(item_text), F.lit(""))), F.lit(PLAIN_WORD), 0))
    asked = items.select(F.col(item_id).alias("item_id"), words.alias("words")).where(F.size("words") > 0)
    asked = materialize(asked.withColumn("query", F.monotonically_increasing_id()), "queries")
    size = asked.select(F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.octet_length(w) + ENTRY).alias("size")).agg(F.sum("size")).first()[0]
    if not size:
        return _ranked(spark.createDataFrame([], f"query bigint, doc_id {rows.schema['doc_id'].dataType.simpleString()}, score bigint"), asked, k)
    rounds = -(-size // bytes_at_once)
    found = None
    for r in range(rounds):
        part = {q["query"]: q["words"] for q in asked.where(F.pmod(F.xxhash64("query"), F.lit(rounds)) == r).select("query", "words").collect()}
        if not part:
            continue
        vocabulary = sorted({w for ws in part.values() for w in ws})
        number = {w: i for i, w in enumerate(vocabulary)}
        posted = materialize(postings(rows, spark.sparkContext.broadcast([w.encode() for w in vocabulary])), "postings")
        total = posted.agg(F.count("*").alias("n"), F.sum("n").alias("words")).first()
        df = np.zeros(len(vocabulary), dtype=np.int64)
        for x in posted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # one row per term
            df[x["t"]] = x["df"]
        weights = np.array([weight(total["n"], int(x)) for x in df], dtype=np.int64)
        queries = {}
        for q, ws in part.items():
            terms = np.array([number[w] for w in ws], dtype=np.int64)
            queries[q] = terms[np.lexsort((terms, df[terms]))]
        share = spark.sparkContext.broadcast
        hits = _best(posted, share(queries), share(weights), total["n"], total["words"] or 1, k)
        found = hits if found is None else found.unionByName(hits)
    return _ranked(found, asked, k)


def _ranked(found: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
