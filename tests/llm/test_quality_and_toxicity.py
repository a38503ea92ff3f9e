"""Estimates on planted data, held-out accuracy on the given labels, and segments against a search of all of them."""

import itertools
import random
import zlib

from scorekit.llm import toxic_segments
from scorekit.llm.catalog import load
from scorekit.llm.toxic_segments import best_score, fit_curve, held_out, maximal_segments, score_toxicity, train_words
from scorekit.llm.weak_quality import GOOD, JUNK, NONE, estimate, judge, sample_texts, score_quality


def every_maximal(scores):
    """By definition: the best segment, shortest first of equals, then the same left and right of it."""
    best = max(((sum(scores[a:b]), -(b - a), -a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    _, _, _, a, b = best
    return every_maximal(scores[:a]) + [(a, b)] + [(x + b, y + b) for x, y in every_maximal(scores[b:])]


def test_segments():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(0, 25)
        hits = [(i, rng.choice([0.7, 1.3, 2.9]) + rng.random() * 0.01) for i in range(n) if rng.random() < 0.4]
        neutral = -0.37
        scores = [dict(hits).get(i, neutral) for i in range(n)]
        got = maximal_segments(hits, neutral)
        assert [(a, b) for a, b, _ in got] == every_maximal(scores)
        assert all(abs(s - sum(scores[a:b])) < 1e-9 for a, b, s in got)


def test_beginnings_score():
    scores = {"word": 2.0, "comp*": 1.0, "compou*": 3.0, "xyz": 1.5}
    assert [best_score(w, scores) for w in ("word", "words", "comp", "compo", "compound", "xyz", "xyzw", "")] == [2.0, 0.0, 0.0, 1.0, 3.0, 1.5, 0.0, 0.0]


def test_curve():
    a, b = fit_curve([(-2.0, 0, 90), (0.0, 50, 50), (2.0, 90, 0)])
    assert abs(a) < 0.1 and b > 1


def test_estimate_finds_who_to_trust():
    rng = random.Random(6)
    right = [0.95, 0.9, 0.8, 0.55]
    counts = {}
    for _ in range(20_000):
        good = rng.random() < 0.8
        v = tuple(NONE if rng.random() < 0.2 else (GOOD if (rng.random() < p) == good else JUNK) for p in right)
        counts[v] = counts.get(v, 0) + 1
    share, chances = estimate(counts)
    assert abs(share - 0.8) < 0.03
    for k, p in enumerate(right):
        given = chances[k][1]
        assert abs(given[GOOD] / (given[GOOD] + given[JUNK]) - p) < 0.05
    assert judge((GOOD, GOOD, NONE, JUNK), share, chances) > 0.9 > 0.1 > judge((JUNK, JUNK, NONE, GOOD), share, chances)
    assert all(0 < judge(v, *estimate({})) < 1 for v in [()])


def test_quality_agrees_with_labels_it_never_saw(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    rows = score_quality(load(spark, sf, "documents")).join(load(spark, sf, "labels"), "doc_id").select("keep", "quality").collect()
    good, junk = [r.keep for r in rows if r.quality == 1], [r.keep for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and 1 - sum(junk) / len(junk) > 0.9


def test_toxicity_on_held_out_rows(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = load(spark, sf, "documents"), load(spark, sf, "labels")
    rows = score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    hit = [r for r in rows if r.predicted == 1]
    assert sum(r.toxic for r in hit) / len(hit) > 0.9
    assert sum(r.toxic for r in hit) / sum(r.toxic for r in rows) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a text without an id"), (4, "w " * 50_000), (5, "!!! ???"), (5, "Other text of it."), (6, "same"), (6, "same")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, score int, h string")
    out = score_quality(docs).collect()
    assert len(out) == len(rows) and all(r.score is not None and r.keep is not None for r in out)
    labels = spark.createDataFrame([(1, 1, None), (2, 0, 1), (4, 1, 1), (4, 1, 0), (5, 1, 0), (None, 1, 1), (77, 0, 1)], "doc_id bigint, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        scored = score_toxicity(docs, known).collect()
        assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    assert score_quality(docs.limit(0)).count() == 0 and score_toxicity(docs.limit(0), labels).count() == 0


def test_labels_of_held_out_rows_change_nothing(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = load(spark, sf, "documents"), load(spark, sf, "labels")
    flipped = labels.withColumn("toxic", (held_out(labels.doc_id) != (labels.toxic == 1)).cast("int"))
    a, b = (sorted((r.doc_id, r.score) for r in score_toxicity(docs, x).collect()) for x in (labels, flipped))
    assert a == b
    assert len(set(itertools.chain(a))) == len(a)


def learnable(n):
    """Ids that are not held out."""
    return [i for i in range(3 * n) if zlib.crc32(str(i).encode()) % 5 != toxic_segments.HELD_OUT][:n]


def labelled(spark, texts):
    """Documents and labels of (text, toxic) pairs."""
    rows = [(i, t, y) for i, (t, y) in zip(learnable(len(texts)), texts, strict=True)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic")


def test_a_larger_vocabulary_loses_no_toxic_word(spark):
    def scores(filler):
        texts = [(f"{'vile ' * (i < 12)} x{i} {filler}", int(i < 50)) for i in range(400)]
        return {r.w: r.s for r in train_words(*labelled(spark, texts), "doc_id", "text", -0.1)["scores"].collect()}

    few, many = scores("word"), scores(" ".join(f"w{i}" for i in range(20_000)))
    assert few["vile"] == many["vile"] > 2 and "word" not in few and "w7" not in many


def test_words_beyond_any_number_are_scored(spark):
    words = ["".join(x) for x in itertools.islice(itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=4), 52_000)]
    texts = [(f"{' '.join(words)} t{i}", 1) for i in range(6)] + [(f"c{i} other", 0) for i in range(18)]
    assert train_words(*labelled(spark, texts), "doc_id", "text", -0.1)["n"] == len(words)


def test_joined_scores_give_the_same_rows(spark, sf_dir, monkeypatch):
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    docs = docs.unionByName(docs.limit(20)).unionByName(docs.limit(1).selectExpr("NULL AS doc_id", "NULL AS text", "lang", "source", "n_chars"))
    sent = sorted(map(str, score_toxicity(docs, labels).collect()))
    monkeypatch.setattr(toxic_segments, "BROADCAST_BYTES", 0)
    assert sorted(map(str, score_toxicity(docs, labels).collect())) == sent
    assert any("start=" in r for r in sent)


def test_copies_do_not_fill_the_sample(spark):
    rows = spark.range(6000).selectExpr("xxhash64(IF(id < 4000, id DIV 2000, id)) AS h")
    for n in (300, 10_000):
        got = [r.h for r in sample_texts(rows, n).collect()]
        assert len(got) == len(set(got)) and (len(got) == 2002 if n > 2002 else 200 < len(got) < 400)
