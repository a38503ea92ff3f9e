"""Benchmark overlap against a search of every window in every document."""

import random
import re

from scorekit.llm.winnow import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").encode().lower().decode())


def expected(docs, items, span=10):
    out = []
    for d, t in docs:
        ws = words(t)
        hit, named = set(), set()
        for i, x in items:
            iw = words(x)
            s = min(len(iw), span)
            if not s:
                continue
            windows = {tuple(iw[k:k + s]) for k in range(len(iw) - s + 1)}
            for k in range(len(ws) - s + 1):
                if tuple(ws[k:k + s]) in windows:
                    hit |= set(range(k, k + s))
                    named |= {str(i)} if i is not None else set()
        out.append((d, len(ws), len(hit), len(named), tuple(sorted(named)), bool(hit)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r.item_ids), r.contaminated) for r in df.collect()), key=str)


def test_planted_passages(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(12)] + ["Été", "x1"]

    def some(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    long_items = [some(n) for n in (10, 11, 25, 40)]
    items = [(i, " ".join(ws)) for i, ws in enumerate(long_items)]
    items += [(10, "Short one"), (11, "seven words in all are right here"), (12, " ".join(long_items[0])), (13, None), (14, "..."), (None, " ".join(some(12))), (2, "again an id"), (15, "w1"), (16, "w0 w0 w0 w0 w0 w0 w0 w0 w0 w0 w0 w0")]
    docs = [(k, ", ".join(some(rng.randrange(0, 300)))) for k in range(40)]
    for k, ws in enumerate(long_items * 3):
        cut = ws[k % 2:][:rng.randrange(8, 30)]
        docs.append((100 + k, " ".join(some(20) + cut + some(5)).upper()))
    docs += [(200, None), (201, ""), (202, "seven words in all are RIGHT-here"), (202, "another text of the same id"), (None, "short One?"), (203, "w0 " * 5000), (203, "w0 " * 5000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id bigint, text string, n_words int, window string")
    bench = spark.createDataFrame([(*r, "y") for r in items], "item_id bigint, text string, doc_id string")
    assert got(decontaminate(df, bench)) == expected(docs, items)
    # Without the one-word item, which marks nearly everything, fingerprints of long windows decide.
    fewer = [r for r in items if r[0] not in (15, 10, 2)]
    assert got(decontaminate(df, spark.createDataFrame(fewer, "item_id bigint, text string"))) == expected(docs, fewer)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert decontaminate(none, items).count() == 0
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    assert got(decontaminate(docs, items.limit(0))) == [(1, 3, 0, 0, (), False)]
