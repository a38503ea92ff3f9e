"""Toxic passages as maximal scoring segments.

Words score their log-odds of toxic against clean text, under Dirichlet priors; all other words score slightly below
zero. One linear scan finds every maximal segment, and extreme-value statistics of clean text tell how surprising the
best one is in a text of that length. A logistic curve turns that into a probability.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import materialize
from .common import BROADCAST_BYTES, PLAIN_WORD, ascii_lower, small_side

# Rows whose crc32 of the id, written as text, leaves this remainder by five are never learnt from.
HELD_OUT = 0
BEGINNINGS = (4, 5, 6, 7, 8)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == HELD_OUT


def maximal_segments(hits: list[tuple[int, float]], neutral: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence that scores ``neutral`` (below zero) everywhere but
    at ``hits``, ascending positions with positive scores. Linear in the number of hits: each candidate remembers the
    last one before it that starts from a lower running total."""
    out: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total after, last lower one
    total, at = 0.0, 0
    for i, s in hits:
        total += (i - at) * neutral
        start, end, low, high = i, i + 1, total, total + s
        total, at = high, i + 1
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= low:
                j = out[j][4]
            if j < 0 or out[j][3] >= high:
                break
            start, low = out[j][0], out[j][2]
            del out[j:]
            j = len(out) - 1
        out.append((start, end, low, high, j))
    return [(a, b, high - low) for a, b, low, high, _ in out]


def features(words: Column) -> Column:
    """Distinct words and, with a star behind, their beginnings of 4 to 8 letters, which compounds have in common."""
    def each(w: Column) -> Column:
        parts = [F.when(F.length(w) > k, F.concat(F.substring(w, 1, k), F.lit("*"))) for k in BEGINNINGS]
        return F.array(w, *parts)

    return F.array_distinct(F.array_compact(F.flatten(F.transform(F.array_distinct(words), each))))


def best_score(word: str, scores: dict[str, float]) -> float:
    """The highest score of a word's features, 0 without any."""
    return max(scores.get(word, 0.0), *(scores.get(word[:k] + "*", 0.0) for k in BEGINNINGS if len(word) > k), 0.0)


def plain_words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(PLAIN_WORD), 0)


def best_scores(words: DataFrame, scores: DataFrame, small: bool) -> DataFrame:
    """The highest score of the features of each row's word ``w``, for the words that have one, with the other columns."""
    others = words.columns
    parts = words.withColumn("f", F.explode(features(F.array("w"))))
    table = scores.withColumnRenamed("w", "f")
    return parts.join(F.broadcast(table) if small else table, "f").groupBy(*others).agg(F.max("s").alias("s"))


def train_words(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, neutral: float, least: int = 3, evidence: float = 3.0) -> dict:
    """Scores of words and beginnings of words from the labelled rows that are not held out.

    Counts are of different texts that hold a word, so neither a word repeated all over one text nor a text copied many
    times weighs more than once. The log-odds of a word are those of its posterior in toxic and clean texts, with a
    Dirichlet prior of half a text plus the word's share of all. They count if ``least`` texts hold the word, and if these
    are toxic more often than all texts by ``evidence`` standard errors, taken from the likelihood ratio, so that a word
    no clean text holds needs a few texts and no more of them where there are more words. Returns ``scores``, a
    written table (w, s) of whatever size, ``n``, its rows, and ``profile``, how often each score, rounded to 1/64, comes up among
    the words of clean texts; ``scores`` is None without labels of both kinds.
    """
    learnt = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(~held_out(F.col("doc_id")))
    thin = learnt.select("doc_id", F.xxhash64("text").alias("h")).join(labels, "doc_id")
    one_each = materialize(thin.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")), "learnt")
    sums = one_each.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    nt, nc = sums["t"] or 0, sums["n"] - (sums["t"] or 0)
    if not nt or not nc:
        return {"scores": None, "n": 0, "profile": []}
    known = learnt.withColumn("h", F.xxhash64("text")).join(small_side(one_each, sums["n"], 48), ["doc_id", "h"])
    words = known.select("toxic", F.explode(features(plain_words(F.col("text")))).alias("w"))
    counts = materialize(words.groupBy("w").agg(
        F.sum("toxic").cast("double").alias("t"), F.sum(1 - F.col("toxic")).cast("double").alias("c")), "words")
    share = nt / (nt + nc)
    prior = F.lit(0.5) + (F.col("t") + F.col("c")) / (nt + nc)
    odds = lambda k, n: F.log((F.col(k) + prior) / (n + 1.5 - F.col(k)))
    part = lambda k, p: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / ((F.col("t") + F.col("c")) * p))).otherwise(0.0)
    scores = materialize(counts.where(f"t + c >= {least} AND t > (t + c) * {share}").select(
        "w", (odds("t", nt) - odds("c", nc)).alias("s"), (2 * (part("t", share) + part("c", 1 - share))).alias("ratio")).where(
            f"ratio >= {evidence * evidence} AND s > 0").select("w", "s"), "scores")
    n = scores.count()
    clean = counts.where(~F.endswith("w", F.lit("*")) & (F.col("c") > 0)).select("w", "c")
    hits = best_scores(clean, scores, fits(n)).groupBy((F.round(F.col("s") * 64) / 64).alias("s")).agg(F.sum("c").alias("c")).orderBy("s").collect()
    rest = (clean.agg(F.sum("c").alias("c")).first()["c"] or 0.0) - sum(r["c"] for r in hits)
    return {"scores": scores, "n": n, "profile": [(neutral, rest + 0.5), *((r["s"], r["c"]) for r in hits)]}


def fits(rows: int) -> bool:
    """Whether so many words with their scores may be sent to every executor."""
    return rows * 48 <= BROADCAST_BYTES


def decay(profile: list[tuple[float, float]]) -> float:
    """The positive root of E[exp(x * score)] = 1 over words of clean text, given as scores and how often each comes up:
    scores above s arise there as exp(-root * s)."""
    total = sum(n for _, n in profile)

    def excess(x: float) -> float:
        return sum(n / total * math.exp(min(700.0, x * s)) for s, n in profile) - 1

    low, high = 1e-6, 1.0
    if not profile or excess(low) >= 0:
        return 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


SEGMENTS = "doc_id bigint, n_words bigint, best double, segments array<struct<start:int,end:int,score:double>>"


def as_segments(doc_id: pd.Series, n: list[int], hits: Iterator[list[tuple[int, float]]], neutral: float) -> pd.DataFrame:
    found = [maximal_segments(h, neutral) for h in hits]
    return pd.DataFrame({
        "doc_id": doc_id, "n_words": n, "best": [max((s for _, _, s in f), default=0.0) for f in found],
        "segments": [[{"start": a, "end": b, "score": s} for a, b, s in f] for f in found]})


def find_segments(docs: DataFrame, model: dict, neutral: float, doc_id: str, text: str) -> DataFrame:
    """``doc_id, n_words, best, segments`` per row; positions count words, ends are exclusive. A table of scores that
    :func:`fits` is sent to the executors, a larger one is joined to the words."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if not fits(model["n"]):
        return join_segments(rows, model["scores"], neutral)
    scores = {r["w"]: r["s"] for r in model["scores"].collect()} if model["n"] else {}
    table = docs.sparkSession.sparkContext.broadcast(scores)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word, lookup = re.compile(PLAIN_WORD), table.value
        shortest = BEGINNINGS[0]
        starts = {w[:shortest] for w in lookup}
        for batch in batches:
            n, hits = [], []
            for t in batch["text"]:
                ws = word.findall(t.encode().lower().decode()) if t else []
                hits.append([(i, s) for i, w in enumerate(ws) if w[:shortest] in starts and (s := best_score(w, lookup)) > 0])
                n.append(len(ws))
            yield as_segments(batch["doc_id"], n, hits, neutral)

    return rows.mapInPandas(scan, SEGMENTS)


def join_segments(rows: DataFrame, scores: DataFrame, neutral: float) -> DataFrame:
    """:func:`find_segments` by joins alone: scores to the different words of all texts, these to the places of the
    words, and the places of each different text to its rows."""
    read = rows.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"), plain_words(F.col("text")).alias("ws"))
    vocabulary = read.select(F.explode(F.array_distinct("ws")).alias("w")).distinct()
    best = materialize(best_scores(vocabulary, scores, False), "best")
    places = read.select("h", F.posexplode("ws").alias("at", "w")).join(best, "w")
    hits = places.groupBy("h").agg(F.sort_array(F.collect_set(F.struct("at", "s"))).alias("hits"))
    found = read.select("doc_id", "h", F.size("ws").cast("long").alias("n_words")).join(hits, "h", "left")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits = [[(x["at"], x["s"]) for x in h] if h is not None else [] for h in batch["hits"]]
            yield as_segments(batch["doc_id"], batch["n_words"], hits, neutral)

    return found.select("doc_id", "n_words", "hits").mapInPandas(scan, SEGMENTS)


def fit_curve(bins: list[tuple[float, int, int]], rounds: int = 50, ridge: float = 1e-3) -> tuple[float, float]:
    """Logistic regression of (value, toxic rows, clean rows), by Newton's method."""
    a, b = 0.0, 0.0
    for _ in range(rounds):
        ga, gb, haa, hab, hbb = -ridge * a, -ridge * b, ridge, 0.0, ridge
        for x, t, c in bins:
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, a + b * x))))
            e, v = t - (t + c) * p, (t + c) * p * (1 - p)
            ga, gb, haa, hab, hbb = ga + e, gb + e * x, haa + v, hab + v * x, hbb + v * x * x
        det = haa * hbb - hab * hab
        da, db = (ga * hbb - gb * hab) / det, (gb * haa - ga * hab) / det
        step = min(1.0, 4 / max(abs(da), abs(db), 1e-12))
        a, b = a + step * da, b + step * db
        if max(abs(da), abs(db)) < 1e-9:
            break
    return a, b


def score_toxicity(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", density: float = 0.1,
) -> DataFrame:
    """Toxicity of every text, learnt from ``labels`` (``doc_id``, 0/1 ``toxic``) of rows that are not held out.

    ``density`` is the share of scored words expected inside a toxic passage; it sets what other words score. Returns one
    row per input row: ``doc_id, held_out, score, predicted, passages``, the last with the (start, end, score, p) of each
    segment that clean text of that length would hold with a chance p below 0.05. A null or empty text has no segment and
    gets the score of texts without one; rows without a label are scored alike; of several labels of an id the largest
    counts, and null ones are ignored. Without labels of both kinds all texts get the same score.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    neutral = math.log(1 - density)
    model = train_words(docs, known, doc_id, text, neutral)
    rate = decay(model["profile"])
    found = materialize(find_segments(docs, model, neutral, doc_id, text), "segments")

    # Scale of the extreme-value law by maximum likelihood over clean texts, then the curve over all texts learnt from.
    size = F.greatest("n_words", F.lit(1)).cast("double")
    train = found.where(~held_out(F.col("doc_id"))).join(known, "doc_id").select("toxic", size.alias("n"), "best")
    train = materialize(train, "calibration")
    clean = train.where("toxic = 0").agg(F.count("*").alias("k"), F.sum(F.col("n") * F.exp(-F.lit(rate) * F.col("best"))).alias("e")).first()
    scale = math.log(max(clean["k"] or 0, 1) / (clean["e"] or 1.0)) if clean["k"] else 0.0

    def surprise(n: Column) -> Column:
        return F.lit(rate) * F.col("best") - F.log(n) - F.lit(scale)

    step = F.round(F.greatest(F.lit(-30.0), F.least(F.lit(60.0), surprise(F.col("n")))) * 4) / 4  # at most 361 values
    bins = train.groupBy(step.alias("x")).agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).orderBy("x").collect()
    a, b = fit_curve([(r["x"], r["t"], r["c"]) for r in bins])

    bounded = F.greatest(F.lit(-30.0), F.least(F.lit(60.0), surprise(size)))
    score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * bounded)))
    chance = F.transform("segments", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"),
        (1 - F.exp(-F.exp(-(F.lit(rate) * s["score"] - F.log(size) - F.lit(scale))))).alias("p")))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"),
        F.filter(chance, lambda s: s["p"] < 0.05).alias("passages"))
