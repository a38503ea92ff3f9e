import math
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from scorekit.llm import disclosure
from scorekit.llm.common import PLAIN_WORD
from scorekit.llm.disclosure import personal_data, placed_words, sanitise, sanitised

SCHEMA = "doc_id bigint, text string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def brute_base(text):
    """The patterns as given, one after the other."""
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                    "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]
            if fits():
                out.append((kind, m.start(), m.end()))
    return out


PIECES = ["a@b.c", "x.y%z@m-1.example.com", "@", "..", "1.2.3.4", "256.1.1.1", "007.1.2.3", "1.2..3.4.5.6", "4111 1111 1111 1111", "4111-1111-1111-1112",
          "+1 (555) 010-7777", "+", "+4", "+12 34", " ", "é", "\n", "0", "99999999999999999999", "-", "(", "a.b", "5.6.7.8.9"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
@example("a@b.c%d@e.f")
@example("a@b@c.d")
@example("+1 2 3 4 5 6 7 8 9 (")
def test_base_equals_the_plain_patterns(text):
    assert [x[:3] for x in personal_data(text)] == brute_base(text)


@pytest.mark.parametrize("text", ["7" * 300_000, "a" * 300_000 + "@", "300." * 100_000, "+1" + " " * 300_000, "@" * 100_000, "a@" + "b" * 300_000, "1-" * 100_000])
def test_long_runs_take_linear_time(text):
    assert personal_data(text) == []


def brute_terms(docs):
    """Revealing words and what stands for them, by the definitions, in memory."""
    texts = sorted({t or "" for _, t in docs})
    near = defaultdict(dict)  # entity -> text -> words
    for t in texts:
        found = brute_base(t)
        words = [(m.group(), m.start(), m.end()) for m in re.finditer(PLAIN_WORD, t.encode().lower().decode())]
        words = [w for w in words if not any(w[1] < e and s < w[2] for _, s, e in found)]
        for k, s, e in found:
            value = t[s:e].lower() if k == "email" else t[s:e] if k == "ip" else re.sub("[^0-9]", "", t[s:e])
            before, after = [w for w, a, _ in words if a < s][-10:], [w for w, a, _ in words if a >= s][:10]
            near[f"{k}:{value}"].setdefault(t, set()).update(before + after)
    stems = lambda ws: {w[:3] + "*" for w in ws if len(w) >= 5}
    held = Counter()
    for t in texts:
        ws = set(re.findall(PLAIN_WORD, t.encode().lower().decode()))
        held.update(ws | stems(ws))
    told = set()
    for by_text in near.values():
        if len(by_text) < 3:
            continue
        different = {frozenset(ws) for ws in by_text.values()}
        c = Counter(w for ws in different for w in ws)
        if len(different) * sum(c.values()) < 2 * sum(x * x for x in c.values()):
            continue
        often = {w for w, n in c.items() if n >= 3}
        for term in often | stems(often):
            both = sum(term in ws | stems(ws) for ws in by_text.values())
            n, p, z2 = held[term], both / held[term], 1.64 ** 2
            low = (p + z2 / (2 * n) - 1.64 * math.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
            bits = math.log2(len(texts) / len(by_text))
            if bits > 0 and 1 + math.log2(low) / bits >= 0.9:
                told.add(term)
    return {w: (w[:3] + "*" if len(w) >= 5 and w[:3] + "*" not in told else None) for w in told if not w.endswith("*")}


def brute(docs):
    shown = brute_terms(docs)
    out = []
    for i, text in docs:
        t = text or ""
        base = brute_base(t)
        terms = [("term", m.start(), m.end()) for m in re.finditer(PLAIN_WORD, t.encode().lower().decode())
                 if m.group() in shown and not any(m.start() < e and s < m.end() for _, s, e in base)]
        out.append((i, base + terms))
    return out


def corpus(seed=5):
    """Names and nicknames beside an address in texts that differ, among many texts without; common words everywhere."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("bcdfgklmnprst", k=2)) + "".join(rng.choices("aeiou", k=2)) + rng.choice(["", "na", "tor"]) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else rng.choice(words) for _ in range(n))
    docs = [prose(40) for _ in range(900)]
    docs += [f"{prose(15)} Zorblatt writes from ann@mail.example.org, qux {prose(15)}" for _ in range(12)]
    docs += [f"{prose(5)} zorblatt alone" for _ in range(1)] + [f"{prose(9)} zorbing {prose(4)}" for _ in range(60)]
    passage = f"{prose(12)} call Wexford now +1 (555) 010-7788 {prose(12)}"
    docs += [f"{prose(30)} {passage} {prose(30)}" for _ in range(8)] + [passage] * 20
    return list(enumerate(docs))


def ours(spark, docs, **kw):
    out = sanitise(spark.createDataFrame(docs, SCHEMA).repartition(3), **kw).collect()
    return [(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in out]


def test_equals_brute_force(spark):
    docs = corpus()
    assert sorted(ours(spark, docs)) == sorted(brute(docs))
    told = brute_terms(docs)
    assert told["zorblatt"] == "zor*" and "qux" in told and told["qux"] is None
    assert not {"the", "of", "and", "wexford", "call"} & set(told)  # a repeated passage is one context


def test_many_terms_are_joined(spark, monkeypatch):
    docs = corpus(6)
    monkeypatch.setattr(disclosure, "BROADCAST_BYTES", 0)
    out = sanitise(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted((r.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in out) == sorted(brute(docs))
    assert any("zor* * * [EMAIL], * " in r.text for r in out)


def test_texts_are_sanitised(spark):
    docs = corpus()
    out = {r.doc_id: r for r in sanitise(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert len(out) == len(docs)
    for i, t in docs:
        if not out[i].spans:
            assert out[i].text == t
        else:
            assert "@" not in out[i].text and "555" not in out[i].text
    assert "zor* * * [EMAIL], * " in out[900].text


def test_overlapping_spans():
    assert sanitised("ab 1.2.3.4 cd", [("ip", 3, 10, "[IP]"), ("card", 5, 12, "[CARD]"), ("term", 12, 13, "*")]) == "ab [IP]*"
    assert placed_words("aa bb cc", [(4, 5)]) == [("aa", 0, 2), ("cc", 6, 8)]


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (None, "é mail a@b.co"), (None, "é mail a@b.co"), (3, "x " * 200_000 + "1.2.3.4"), (3, "no"), (4, "+1 (555) 010-7777 " * 2000)]
    out = ours(spark, docs)
    assert sorted(map(str, out)) == sorted(str((i, brute_base(t or ""))) for i, t in docs)
    assert [r.text for r in sanitise(spark.createDataFrame([(1, None), (2, "")], SCHEMA)).orderBy("doc_id").collect()] == [None, ""]
    assert sanitise(spark.createDataFrame([], SCHEMA)).collect() == []
    clash = spark.createDataFrame([("t", "a@b.co", 1, 2)], "spans string, term string, h int, text int")
    assert sanitise(clash, doc_id="spans", text="term").first().text == "[EMAIL]"


def test_query_lists_spans_in_order(spark, sf_dir):
    from scorekit.llm.catalog import QUERIES, load
    texts = {r.doc_id: r.text for r in load(spark, sf_dir, "documents").collect()}
    for r in QUERIES["op12_pii_disclosure"](spark, sf_dir).collect():
        base = brute_base(texts[r.doc_id] or "")
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(base)
        assert r.spans.startswith(",".join(f"{k}:{s}:{e}" for k, s, e in base))
