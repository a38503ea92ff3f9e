"""Document quality without labels: overlapping heuristics vote, expectation-maximisation finds out how far to trust each
of them, and the labels that follow train a hashed linear scorer, which judges every document.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import materialize
from .common import row_key

GOOD, JUNK, NONE = 1, 0, 2
ECHO = r"(?<!\S)(\S++)(?=\s++\1(?!\S))"  # a word that comes again at once
REPEATED = "\u0001"
ENDS = ".,!?;:"
PLAIN = [shape + end for shape in ("a", "Aa", "A", "9") for end in ("", *ENDS)]  # shapes of letters with one sign at most


def measures(text: Column, words: Column) -> dict[str, Column]:
    """What the heuristics look at, in a text and the shapes of its words."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    among = lambda keep: F.size(F.filter(words, keep))
    lines = F.split(text, "\n")
    return {
        "n": F.size(words), "chars": F.length(text), "letters": F.length(F.regexp_replace(text, r"\P{L}++", "")),
        "symbols": count(r"[^\p{L}\p{N}\s]"), "capitals": count(r"\p{Lu}"), "echoes": among(lambda w: w == REPEATED),
        "ends": among(lambda w: F.substring(w, -1, 1).isin(list(ENDS))), "lower": among(lambda w: F.substring(w, 1, 1) == "a"),
        "plain": among(lambda w: w.isin(PLAIN)), "lines": F.size(lines), "lines_apart": F.size(F.array_distinct(lines)),
    }


def votes() -> dict[str, Column]:
    """What each heuristic makes of the measures: good, junk, or nothing."""
    def vote(junk: str, good: str, applies: str) -> Column:
        return F.expr(f"CASE WHEN NOT ({applies}) THEN {NONE} WHEN {junk} THEN {JUNK} WHEN {good} THEN {GOOD} ELSE {NONE} END")

    return {
        "v_symbols": vote("symbols >= 0.075 * chars", "symbols <= 0.05 * chars", "n >= 20"),
        "v_capitals": vote("capitals >= 0.3 * letters", "capitals <= 0.06 * letters", "n >= 20"),
        "v_echoes": vote("echoes >= 0.1 * n", "echoes <= 0.02 * n", "n >= 2"),
        "v_sentences": vote("ends <= 0.05 * n OR ends >= 0.4 * n", "ends BETWEEN 0.08 * n AND 0.25 * n", "n >= 20"),
        "v_case": vote("lower <= 0.6 * n", "lower >= 0.8 * n", "n >= 20"),
        "v_words": vote("plain <= 0.5 * n", "plain >= 0.95 * n", "n >= 5"),
        "v_lines": vote("lines_apart <= 0.5 * lines", "lines_apart >= 0.9 * lines", "lines >= 4"),
    }


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 100) -> tuple[float, list[list[list[float]]]]:
    """Share of good documents, and for each labeller its chances to vote junk or good on junk and on good ones.

    Expectation-maximisation over the counts of vote patterns, from the majority of votes. Labellers are taken as
    independent given the class, and silence, which mostly means that a text is short, says nothing about it.
    """
    posterior = {}
    for v in patterns:
        good, junk = v.count(GOOD), v.count(JUNK)
        posterior[v] = (good + 0.9) / (good + junk + 1.0)
    share, chances = 0.5, []
    for _ in range(rounds):
        total = sum(patterns.values())
        mass = [sum(n * (1 - posterior[v]) for v, n in patterns.items()), sum(n * posterior[v] for v, n in patterns.items())]
        share = (mass[1] + 1) / (total + 2)
        width = len(next(iter(patterns), ()))
        chances = [[[0.0] * 3 for _ in range(2)] for _ in range(width)]
        for k in range(width):
            for c in range(2):
                seen = [1.0, 1.0]
                for v, n in patterns.items():
                    if v[k] != NONE:
                        seen[v[k]] += n * (posterior[v] if c else 1 - posterior[v])
                chances[k][c] = [seen[0] / sum(seen), seen[1] / sum(seen), 1.0]  # no vote, no evidence
        moved = {v: judge(v, share, chances) for v in patterns}
        change = max((abs(moved[v] - posterior[v]) for v in patterns), default=0.0)
        posterior = moved
        if change < 1e-9:
            break
    return share, chances


def judge(v: tuple[int, ...], share: float, chances: list[list[list[float]]]) -> float:
    """The chance that a document with these votes is good."""
    odds = math.log(share / (1 - share)) + sum(math.log(chances[k][1][x] / chances[k][0][x]) for k, x in enumerate(v))
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, odds))))


def shapes(text: Column) -> Column:
    """Words as shapes: runs of small letters, of capitals and of digits as one sign each, a repeated word as an echo."""
    out = F.regexp_replace(text, ECHO, REPEATED)
    for pattern, sign in ((r"\p{Ll}++", "a"), (r"\p{N}++", "0"), (r"\p{Lu}{2,}+", "9"), (r"\p{Lu}", "A")):
        out = F.regexp_replace(out, pattern, sign)
    return F.filter(F.split(out, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def sample_texts(rows: DataFrame, texts: int) -> DataFrame:
    """One row of each text of about ``texts`` texts, told apart and picked by their hash ``h``; of all if there are no more."""
    total = rows.select(F.count_distinct("h")).first()[0]
    picked = rows if total <= texts else rows.where(F.pmod("h", F.lit(1_000_003)) < int(1_000_003 * texts / total))
    return picked.dropDuplicates(["h"])


def score_quality(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_docs: int = 20_000, features: int = 1 << 12, cut: float = 0.5,
) -> DataFrame:
    """The quality of every document: ``doc_id, row, weak, score, keep``, one row per input row, ``row``
    being its :func:`row_key`.

    ``weak`` is the chance that it is good by its votes, weighed as expectation-maximisation over all documents has it;
    ``score`` that of the linear scorer over hashed word shapes, which is trained on about ``sample_docs`` different
    texts, one row of each, with their weak labels as weights, picked by a hash of the text; ``keep`` is ``score >= cut``. A null text counts as empty,
    gets no votes but the prior's, and is scored like any other; equal texts score alike. An empty table gives an empty
    result, and if all weak labels agree they are the scores.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cast = votes()
    names = list(cast)
    hashing, scale = HashingTF(numFeatures=features, inputCol="shapes", outputCol="counts"), Normalizer(p=1.0, inputCol="counts", outputCol="features")
    # Shapes and measures are columns of their own below what reads them, so that each is taken once.
    read = rows.withColumn("shapes", shapes(F.col("text")))
    read = read.select("doc_id", "row", F.xxhash64("text").alias("h"), "shapes", *[c.alias(k) for k, c in measures(F.col("text"), F.col("shapes")).items()])
    read = read.select("doc_id", "row", "h", "shapes", *[c.alias(k) for k, c in cast.items()])
    # The only pass over texts: what follows reads a few hundred bytes per document.
    voted = materialize(scale.transform(hashing.transform(read)).drop("shapes", "counts"), "votes")
    counts = {tuple(r[k] for k in names): r["n"] for r in voted.groupBy(*names).agg(F.count("*").alias("n")).collect()}  # 3^7 at most
    share, chances = estimate(counts)

    def weak() -> Column:
        odds = F.lit(math.log(share / (1 - share)))
        for k, name in enumerate(names):
            good, junk = chances[k][1], chances[k][0]
            odds = odds + F.get(F.array(*[F.lit(math.log(g / j)) for g, j in zip(good, junk, strict=True)]), F.col(name))
        return 1 / (1 + F.exp(-odds))

    if not counts:
        return voted.select("doc_id", "row", F.lit(0.5).alias("weak"), F.lit(0.5).alias("score"), F.lit(True).alias("keep"))
    known = voted.select("doc_id", "row", "h", "features", weak().alias("weak"))
    picked = sample_texts(known, sample_docs)
    sides = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("weak").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("weak")).alias("weight"))))
    train = materialize(picked.select("features", sides.alias("s")).select("features", "s.*").where("weight > 1e-6"), "labelled")
    if train.select("label").distinct().count() < 2:
        return known.select("doc_id", "row", "weak", F.col("weak").alias("score"), (F.col("weak") >= cut).alias("keep"))
    model = LogisticRegression(weightCol="weight", regParam=1e-5, maxIter=60).fit(train)
    score = F.get(vector_to_array("probability"), F.lit(1))
    return model.transform(known).select("doc_id", "row", "weak", score.alias("score")).withColumn("keep", F.col("score") >= cut)
