"""Importance resampling: documents drawn by how much more their words and word pairs belong to a target text.

Features fall into buckets by their CRC. Counts per bucket, over all documents and over all target texts, give each
bucket a gain; a document weighs the mean gain of its features, and random noise of the Gumbel kind turns the highest
sums of weight and noise into a draw without replacement.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import materialize
from .mixing import running_totals
from .word_payloads import Dictionary, plain

DICTIONARY = 100_000  # words of the automaton at most, the most frequent ones; other words are looked at as they come
LONGEST = 40  # bytes of a word of the automaton
HELD = 200_000  # different words that a task counts before it passes the counts on


def frequent_words(texts: DataFrame) -> list[bytes]:
    """The most frequent words of ``text``, counted over all texts: at most :data:`DICTIONARY` of up to :data:`LONGEST` bytes.

    Words are taken by steps of frequency, an eighth of a power of two each, as long as a step fits as a whole; so only
    the words that are taken come to the driver, and one row per step. Words that come once are left out.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            kept = {w: n for w, n in seen.items() if len(w) <= LONGEST}
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.binary()), pa.array(kept.values(), pa.int64())], ["w", "n"])

        for batch in batches:
            for t in batch.column(0).cast(pa.binary()):
                if t.is_valid:
                    seen.update(plain(t.as_py()).split())
                    if len(seen) >= HELD:
                        yield out()
        yield out()

    counted = texts.mapInArrow(count, "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n")).where("n > 1")
    counted = materialize(counted.select("w", F.floor(F.log2("n") * 8).cast("int").alias("step")), "words")
    least = total = 0
    for step, words in sorted(map(tuple, counted.groupBy("step").agg(F.count("*")).collect()), reverse=True):
        total += words
        if total > DICTIONARY:
            least = step + 1
            break
    return sorted(bytes(r["w"]) for r in counted.where(F.col("step") >= least).select("w").collect())


def _dictionary(words) -> Dictionary:
    """The automaton of a broadcast list of words, built once by each worker process."""
    kept = sys.modules.setdefault("scorekit_worker_memory", ModuleType("scorekit_worker_memory")).__dict__
    if kept.get("words") is not words:
        kept["words"], kept["dictionary"] = words, Dictionary(words)
    return kept["dictionary"]


def bucket_counts(texts: DataFrame, words, buckets: int) -> np.ndarray:
    """How many features of all ``text`` fall into each bucket. A task sends one row per bucket at most."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, total = _dictionary(words.value), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, crc, _, pairs in dictionary.features(batch.column(0).cast(pa.binary()).to_pylist()):
                total += np.bincount(crc % buckets, minlength=buckets) + np.bincount(pairs % buckets, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in texts.mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log-ratio of a bucket's share of the target to its share of the corpus, one feature added to each
    bucket on either side."""
    s, t = corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def weighted(docs: DataFrame, words, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each row."""
    table, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = _dictionary(words.value)
        for batch in batches:
            size = batch.num_rows
            n_words, n_pairs, total = (np.zeros(size, dtype=np.int64) for _ in range(3))
            for text, crc, text2, pairs in dictionary.features(batch.column(1).cast(pa.binary()).to_pylist()):
                for of, c, n in ((text, crc, n_words), (text2, pairs, n_pairs)):
                    n += np.bincount(of, minlength=size)
                    total += np.rint(np.bincount(of, weights=table.value[c % buckets], minlength=size)).astype(np.int64)
            features = n_words + n_pairs
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x) for x in (n_words, features, total // np.maximum(features, 1))]], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(weigh, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise that depends on seed and id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share)))


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
    percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7,
) -> DataFrame:
    """Documents drawn towards the distribution of ``target``, one row per input row.

    Returns ``doc_id, n_words, n_features, weight, score, rank``. Words are runs of ASCII letters (lower-cased), digits and
    anything beyond ASCII; features are words and pairs of neighbours. ``percent`` percent, rounded down, of the documents
    with ``least_words`` words are drawn: those of the highest scores, of equal scores the smaller id, null ids last;
    ``rank`` numbers them and is null for others. A null or wordless text has no features and weighs 0. Rows that share
    an id draw the same noise and rank on their own; rows alike in all else may swap ranks. With an empty target all gains rest on
    the corpus alone; an empty table of documents gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    goals = target.select(F.col(target_text).cast("string").alias("text"))
    # At most DICTIONARY words of LONGEST bytes.
    words = docs.sparkSession.sparkContext.broadcast(frequent_words(rows.select("text").unionByName(goals)))
    gain = gains(bucket_counts(rows.select("text"), words, buckets), bucket_counts(goals, words, buckets))
    weights = weighted(rows, words, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = materialize(weights.withColumn("_row", F.monotonically_increasing_id()), "scored")
    fit = scored.where(F.col("n_words") >= least_words).withColumn("_one", F.lit(1).cast("long"))
    drawn = fit.count() * percent // 100
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("_row")]
    ranked = running_totals(fit, [], order, "_one", "_before")
    place = F.when(F.col("_before") < drawn, F.col("_before") + 1).cast("long").alias("rank")
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    rest = scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, place).unionByName(rest)
