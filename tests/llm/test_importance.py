import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scorekit.llm import importance, word_payloads
from scorekit.llm.common import PLAIN_WORD
from scorekit.llm.importance import frequent_words, resample
from scorekit.llm.word_payloads import Dictionary, joined_crc, shifted

SCHEMA = "doc_id bigint, text string"


def words_of(text):
    return re.findall(PLAIN_WORD, (text or "").encode().lower().decode())


def buckets_of(text):
    ws = words_of(text)
    return [zlib.crc32(f.encode()) % 10_000 for f in [*ws, *[f"{a} {b}" for a, b in zip(ws, ws[1:])]]]


def brute(docs, items, percent=25, least=20):
    """Rows (doc_id, n_features, weight, score, rank) by the definition, features one by one."""
    s, t = (Counter(b for x in side for b in buckets_of(x)) for side in ([x for _, x in docs], items))
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + 10_000) / ((s[b] + 1) * (nt + 10_000)))) for b in range(10_000)]
    rows = []
    for i, text in docs:
        bs = buckets_of(text)
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r, (_, x) in zip(rows, docs, strict=True) if len(words_of(x)) >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(fit[:percent * len(fit) // 100])}
    return [(*r, rank.get(id(r))) for r in rows]


def ours(spark, docs, items, **kw):
    out = resample(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(x,) for x in items], "text string"), **kw)
    return [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()]


def same(a, b):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted(a, key=key) == sorted(b, key=key)


WORDS = ["un", "Deux", "trois", "été", "x" * 70, "naïve", "42", "fin", "ß", "日本語のテキスト"]


def sample(n, rng):
    return [(i, " ,.\n-_@"[i % 7].join(rng.choice(WORDS, size=int(rng.integers(0, 60))))) for i in range(n)]


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    docs, items = sample(120, rng), [x for _, x in sample(9, rng)]
    assert same(ours(spark, docs, items), brute(docs, items))


def test_words_beyond_the_dictionary_and_small_pieces(spark, monkeypatch):
    """A dictionary of three words, scanned in pieces shorter than a text, gives the same rows."""
    rng = np.random.default_rng(4)
    docs, items = sample(60, rng), [x for _, x in sample(5, rng)]
    monkeypatch.setattr(importance, "DICTIONARY", 3)
    monkeypatch.setattr(importance, "HELD", 4)
    monkeypatch.setattr(word_payloads, "PIECE", 16)
    assert same(ours(spark, docs, items), brute(docs, items))


def test_odd_rows(spark):
    long = "lorem ipsum dolor " * 40_000
    docs = [(1, None), (2, ""), (3, " .,;\t\n"), (None, "a b c " * 9), (None, "a b c " * 9), (4, "a b c " * 9), (4, "a b c " * 9), (5, long), (6, "x" * 300_000)]
    out = ours(spark, docs, ["a b", None, ""], percent=100)
    assert same([r[:4] for r in out], [r[:4] for r in brute(docs, ["a b", None, ""])])
    assert sorted(r[4] for r in out if r[4]) == [1, 2, 3, 4, 5] and {r[0]: r[4] for r in out}[6] is None


def test_empty_tables_and_other_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    goals = spark.createDataFrame([("a b",)], "text string")
    assert resample(none, goals).collect() == []
    docs = [(i, f"w{i} " * 25) for i in range(8)]
    assert same(ours(spark, docs, []), brute(docs, []))
    clash = spark.createDataFrame([(i, t, 9, 9, 9) for i, t in docs], SCHEMA + ", rank int, score int, n int")
    odd = clash.withColumnRenamed("doc_id", "weight").withColumnRenamed("text", "w")
    out = resample(odd, goals, doc_id="weight", text="w").collect()
    assert same([(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out], brute(docs, ["a b"]))


def test_ties_go_to_the_smaller_id(spark, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(importance, "noise", lambda doc_id, seed: F.lit(0).cast("long"))
    docs = [(i, "same words here " * 10) for i in (9, 3, 7, 1)] + [(None, "same words here " * 10)]
    ranks = {r[0]: r[4] for r in ours(spark, docs, ["a"], percent=60)}
    assert ranks == {1: 1, 3: 2, 7: 3, 9: None, None: None}


def test_frequent_words_are_counted_over_all_texts(spark, monkeypatch):
    texts = spark.createDataFrame([("b a a b",), ("A d a a c c d",), (None,), ("b " + "y " * 3 + "z" * 41 + " " + "z" * 41,)], "text string").repartition(3)
    for most, words in ((9, b"abcdy"), (4, b"aby"), (3, b"aby"), (2, b"a"), (0, b"")):
        monkeypatch.setattr(importance, "DICTIONARY", most)
        assert frequent_words(texts) == [bytes([w]) for w in words]


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=200), st.binary(min_size=1, max_size=200))
def test_joined_crc(a, b):
    crc = [np.array([zlib.crc32(x)], dtype=np.uint32) for x in (a, b)]
    assert joined_crc(*crc, np.array([len(b)]))[0] == zlib.crc32(a + b" " + b)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 100_000, 3_000_001])
def test_shifted(n):
    whole = zlib.crc32(b"begin" + bytes(n))
    assert shifted(np.array([zlib.crc32(b"begin")], dtype=np.uint32), np.array([n]))[0] ^ zlib.crc32(bytes(n)) == whole


def test_dictionary_hits_only_whole_words():
    starts, lengths, crc = Dictionary([b"ab", b"b", b"abc"]).payloads(b" ab  abcd b abc ")
    assert starts.tolist() == [1, 5, 10, 12] and lengths.tolist() == [2, 4, 1, 3]
    assert crc.tolist() == [zlib.crc32(w) for w in (b"ab", b"abcd", b"b", b"abc")]
