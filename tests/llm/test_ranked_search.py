import math
import re
from collections import Counter

import numpy as np
import pytest

from scorekit.llm.common import PLAIN_WORD
from scorekit.llm.ranked_search import Block, search

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def terms_of(text):
    return re.findall(PLAIN_WORD, (text or "").encode().lower().decode())


def brute(docs, items, k=10):
    """Rows (item_id, rank, doc_id, score) by the definition, every document scored for every item."""
    held = [(i, Counter(ws), len(ws)) for i, ws in ((i, terms_of(t)) for i, t in docs) if ws]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in held:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(terms_of(text)) if c[t]}
            scored.append((sum(w[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in w), i))
        best = sorted((x for x in scored if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(best)]
    return out


def ours(spark, docs, items, **kw):
    rows = search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), **kw).collect()
    return [(r.item_id, r["rank"], r.doc_id, r.score) for r in rows]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def text(rng, most):
    """Words of a long-tailed vocabulary."""
    return " ".join(f"w{int(x)}" for x in rng.zipf(1.3, size=int(rng.integers(0, most))) if x < 500)


@pytest.mark.parametrize("batch", [10_000, 7])
def test_equals_brute_force(spark, batch):
    rng = np.random.default_rng(11)
    docs, items = [(i, text(rng, 60)) for i in range(150)], [(i, text(rng, 40)) for i in range(25)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert sorted(ours(spark, docs, items)) == sorted(brute(docs, items))
        assert sorted(ours(spark, docs, items, k=3)) == sorted(brute(docs, items, 3))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_more_items_than_may_be_sent_at_once(spark):
    rng = np.random.default_rng(12)
    docs, items = [(i, text(rng, 30)) for i in range(40)], [(i, text(rng, 20)) for i in range(12)]
    assert sorted(ours(spark, docs, items, bytes_at_once=4000)) == sorted(brute(docs, items))


def test_ties_repeats_and_odd_rows(spark):
    docs = [(7, "Rare one"), (3, "rare ONE"), (3, "rare one"), (None, "rare one"), (5, "rare one"), (8, None), (9, " .,"), (2, "été naïve " * 30_000), (1, "other " * 9)]
    items = [(1, "rare rare"), (1, "rare"), (None, "ÉTÉ été naïve"), (4, None), (5, "--"), (6, "absent")]
    assert sorted(ours(spark, docs, items, k=4), key=key) == sorted(brute(docs, items, 4), key=key)
    assert [r[2] for r in sorted(ours(spark, docs, [(1, "rare")], k=5))] == [3, 3, 5, 7, None]


def test_a_term_of_all_documents_weighs_little_but_counts(spark):
    docs = [(i, "all" + " x" * i) for i in range(5)]
    assert sorted(ours(spark, docs, [(1, "all")])) == sorted(brute(docs, [(1, "all")]))


def test_empty_tables_and_other_columns(spark):
    docs, items = [(1, "a b")], [(2, "b")]
    assert ours(spark, [], items) == [] and ours(spark, docs, []) == []
    named = spark.createDataFrame([(1, "a b", 5, 6)], "rank bigint, terms string, score int, n int")
    asked = spark.createDataFrame([("x", "b", 7)], "query string, words string, doc_id int")
    out = search(named, asked, doc_id="rank", text="terms", item_id="query", item_text="words").collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in out] == [("x", 1, 1)]


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("b", "w"), ("a", "w"), (None, "w"), ("c", "v")], "doc_id string, text string")
    out = search(docs, spark.createDataFrame([(1, "w")], ITEMS)).orderBy("rank").collect()
    assert [r.doc_id for r in out] == ["a", "b", None]


def block(rng, n_docs, n_terms):
    owners, terms = (x.ravel() for x in np.meshgrid(np.arange(n_docs), np.arange(n_terms), indexing="ij"))
    held = rng.random(len(owners)) < 1.0 / (1 + terms)
    impacts = rng.integers(1, 10 * (1 + terms[held]) ** 2)
    return Block(owners[held], terms[held], impacts, n_docs), owners[held], terms[held], impacts


def test_accumulators_are_limited_and_results_whole():
    """Common terms add little, so most of their documents never get an accumulator."""
    rng, shares = np.random.default_rng(13), []
    for _ in range(30):
        b, owners, terms, impacts = block(rng, 400, 30)
        query = np.arange(29, -1, -1)  # the rarest first
        full = np.bincount(owners, weights=impacts, minlength=400).astype(int)
        floor = np.sort(full)[-5]
        docs, scores, created = b.search(query, 5)
        assert {(d, s) for d, s in zip(docs, scores)} == {(d, s) for d, s in enumerate(full) if s >= max(floor, 1)}
        shares.append(created / np.count_nonzero(full))
    assert max(shares) < 1 and sum(shares) / len(shares) < 0.6


def test_a_known_floor_keeps_ties():
    rng = np.random.default_rng(14)
    b, owners, _, impacts = block(rng, 200, 20)
    full = np.bincount(owners, weights=impacts, minlength=200).astype(int)
    top = int(np.sort(full)[-1])
    docs, scores, created = b.search(np.arange(19, -1, -1), 10, floor=top)
    assert set(scores) == {top} and set(docs) == set(np.flatnonzero(full == top)) and created < 200
    assert len(b.search(np.arange(19, -1, -1), 10, floor=top + 1)[0]) == 0
