"""Secrets in text: fixed patterns, and strings that look random to a pair of character Markov models.

One model learns how characters follow each other in known secrets, the other in ordinary words and identifiers. A long
string is reported when the first explains it better by a clear margin per character.
"""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import materialize
from .common import let, small_side

# The kinds and what each looks for. For ``assign`` the group is the secret itself.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
}
MIN_ASSIGNED = 12
DROP = 12.0
LEAST = MIN_ASSIGNED // 2 + 1  # characters of a stretch before it is widened
DIFFERENT = 5  # of twelve random digits, three in a thousand have fewer
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{MIN_ASSIGNED},}}"
WORDLIKE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{3,19}+(?![A-Za-z0-9+/_=-])"

# A labelled sample of what identifiers are made of: words that are common in programs. How they are put together is
# a rule, see :func:`identifier_samples`.
NAME_WORDS = """
account action active address after agent alert allow amount any apply area array async audio author back balance base
batch before begin block body border bottom bounds branch break buffer build button byte cache call cell center change
channel char check child class clear click client clone close code color column command comment commit common compare
config connect console const content context control copy count create current cursor data date debug default delay
delete detail device dialog disable display document domain download draft driver edit element email empty enable
encode end engine entity entry equal error event example exception exit export extra factory failure feature fetch
field file filter final first flag float flush folder font form format frame from function get global grid group
handle hash header height
""".split()
NAME_SHARE = 0.35  # of the ordinary model; the rest are the words of the texts

_SPANS = "array<struct<s:int,e:int,m:string>>"


def find(text: Column, pattern: str) -> Column:
    """Matches from the left, none overlapping: start and end in code points, and the matched string."""
    empty = F.array().cast(_SPANS)

    def place(ms: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(ms))
        steps = F.zip_with(gaps, ms, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))
        zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))

        def add(acc: Column, x: Column) -> Column:
            s = acc["at"] + x["g"]
            e = s + F.length(x["m"])
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

        return F.aggregate(steps, zero, add)["out"]

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), 0), place)).otherwise(empty)


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each fixed pattern."""
    long_enough = lambda x: F.length(F.regexp_extract(x["m"], PATTERNS["assign"], 1)) >= MIN_ASSIGNED
    found = {k: find(text, p) for k, p in PATTERNS.items()}
    return found | {"assign": F.filter(found["assign"], long_enough)}


def varied(m: Column) -> Column:
    """Whether a string has :data:`DIFFERENT` characters; runs of one or a few of them are filling, not keys."""
    return F.size(F.array_distinct(F.split(m, ""))) >= DIFFERENT


def blanked(text: Column, spans: Column) -> Column:
    """``text`` with spaces in place of all ``spans``, which may overlap; no other character moves."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        s, e = F.greatest(x["s"], acc["at"]), F.greatest(x["e"], acc["at"])
        piece = F.concat(F.substring(text, acc["at"] + 1, s - acc["at"]), F.repeat(F.lit(" "), e - s))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))

    def joined(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(F.sort_array(spans), zero, add, joined))


def stretches(gains: Column) -> Column:
    """Stretches (s, e) of ``LEAST`` or more characters whose gains, one per pair of neighbours, add up to more
    than nothing: each starts where the running total leaves zero and ends at its peak, and the next one starts where the
    total is back at zero or ``DROP`` below the peak."""
    empty = F.array().cast("array<struct<s:int,e:int>>")
    zero = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("peak"), F.lit(0).alias("s"), F.lit(0).alias("e"), empty.alias("out"))

    def closed(acc: Column) -> Column:
        long_enough = acc["e"] - acc["s"] >= LEAST
        return F.when(long_enough, F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e"))))).otherwise(acc["out"])

    def add(acc: Column, gain: Column) -> Column:
        i, total = acc["i"] + 1, acc["sum"] + gain
        ends = (total <= 0) | (acc["peak"] - total >= DROP)
        return F.struct(
            i.alias("i"), F.when(ends, 0.0).otherwise(total).alias("sum"), F.when(ends, 0.0).otherwise(F.greatest(acc["peak"], total)).alias("peak"),
            F.when(ends, i).otherwise(acc["s"]).alias("s"), F.when(ends, i).when(total > acc["peak"], i + 1).otherwise(acc["e"]).alias("e"),
            F.when(ends, closed(acc)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(gains, zero, add, closed)


def identifier_samples(words: list[str] = NAME_WORDS) -> list[str]:
    """Ordinary identifiers and paths: each word with others behind it, joined in the ways that programs join them."""
    out = []
    for i, a in enumerate(words):
        b, c, d = (words[(i * k + j) % len(words)] for k, j in ((3, 1), (5, 2), (7, 4)))
        out += [a + b.title() + c.title(), a.title() + b.title() + d.title(), f"{a}_{b}_{d}", f"{a}_{c}_{i % 30}", f"{a.upper()}_{c.upper()}_{b.upper()}",
                f"{a}-{b}-{c}", f"{a}/{b}/{c}/{d.title()}{b.title()}", f"{c}{i % 20}/{a}_{b}", f"is{a.title()}{d.title()}", a[:3].upper() + b.title() + c.title()]
    return out


def to_edges(m: Column, y: Column) -> Column:
    """A stretch of a run, or the whole part between ``/ = _ -`` that it lies in if it covers more than half of that: keys do
    not begin or end inside a part."""
    before = F.length(F.regexp_extract(F.substring(m, F.lit(1), y["s"]), "[A-Za-z0-9+]*$", 0))
    after = F.length(F.regexp_extract(F.substring(m, y["e"] + 1, F.length(m)), "^[A-Za-z0-9+]*", 0))
    most = y["e"] - y["s"] > before + after
    return F.when(most, F.struct((y["s"] - before).alias("s"), (y["e"] + after).alias("e"))).otherwise(y)


def train(docs: DataFrame, text: str = "text", sample_docs: int | None = None, identifiers: list[str] | None = None) -> list[float]:
    """Log-likelihood ratios, random against ordinary, of each character of the alphabet after each other one.

    Samples are labelled by the fixed patterns: what they match is random, other words of up to 19 characters are
    ordinary; longer ones are judged, but not learnt from. They come from
    all documents, of equal texts from one; where ``sample_docs`` is set, from about so many different texts. Half of the
    random model's weight is uniform, since secrets may use characters that the samples do not. The ordinary model is a
    mixture: the words of the texts, and ``identifiers``, samples known to be ordinary (:func:`identifier_samples` if none
    are given), as texts hardly show how names change case or join words.
    """
    names = Counter(a + b for name in (identifier_samples() if identifiers is None else identifiers) for a, b in zip(name, name[1:]))
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    hashes = materialize(texts.groupBy("h").agg(F.count("*").alias("n")), "hashes")
    copied = hashes.where("n > 1").select("h")
    copies = copied.count()
    if copies:
        side = small_side(copied, copies, 16)
        texts = texts.join(side, "h", "left_anti").unionByName(texts.join(side, "h", "left_semi").dropDuplicates(["h"]))
    if sample_docs is not None and (n := hashes.count()) > sample_docs:
        texts = texts.where(F.pmod("h", F.lit(1_000_003)) < int(1_000_003 * sample_docs / n))
    spans = base_spans(F.col("text"))
    values = F.concat(
        F.transform(spans["assign"], lambda x: F.regexp_extract(x["m"], PATTERNS["assign"], 1)),
        *[F.transform(spans[k], lambda x: x["m"]) for k in ("access", "hex")])
    rest = F.col("text")
    for p in PATTERNS.values():
        rest = F.regexp_replace(rest, p, " ")
    both = F.array(F.struct(F.lit(True).alias("random"), values.alias("ws")),
                   F.struct(F.lit(False).alias("random"), F.regexp_extract_all(rest, F.lit(WORDLIKE), 0).alias("ws")))
    words = texts.select(F.explode(both).alias("b")).select("b.random", F.explode("b.ws").alias("w"))

    def pairs(cs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(cs) - 2), lambda i: F.concat(F.get(cs, i), F.get(cs, i + 1)))

    counted = words.groupBy("random", "w").agg(F.count("*").alias("n")).where("length(w) > 1").select(
        "random", "n", F.explode(let(F.split("w", ""), pairs)).alias("pair")).groupBy("random", "pair").agg(F.sum("n").alias("n"))
    counts = {(r["random"], r["pair"]): r["n"] for r in counted.collect()}  # at most two per pair of the alphabet

    # Where the ordinary model has seen little after a character, it falls back on how common the next one is anywhere.
    size, ratios = len(ALPHABET), []
    ends = {b: sum(counts.get((False, a + b), 0) for a in ALPHABET) for b in ALPHABET}
    total = sum(ends.values())
    name_ends = {b: sum(names[a + b] for a in ALPHABET) for b in ALPHABET}
    name_total = sum(name_ends.values())
    share = NAME_SHARE if name_total else 0.0

    def backed(n: int, seen: int, end: int, all_ends: int) -> float:
        return (n + 5 * (end + 0.1) / (all_ends + 0.1 * size)) / (seen + 5)

    for a in ALPHABET:
        named = [names[a + b] for b in ALPHABET]
        seen = {k: [counts.get((k, a + b), 0) for b in ALPHABET] for k in (True, False)}
        for b, r, o, m in zip(ALPHABET, seen[True], seen[False], named, strict=True):
            random = 0.5 * (r + 1) / (sum(seen[True]) + size) + 0.5 / size
            ordinary = (1 - share) * backed(o, sum(seen[False]), ends[b], total) + share * backed(m, sum(named), name_ends[b], name_total)
            ratios.append(round(math.log(random / ordinary), 4))
    return ratios


def scan_secrets(
    docs: DataFrame, ratios: list[float], doc_id: str = "doc_id", text: str = "text", margin: float = 1.0,
) -> DataFrame:
    """All secrets of every text: ``doc_id, spans``, one row per input row, ``spans`` an array of (start, kind, end) in
    order; kind is ``assign``, ``access``, ``hex``, or ``markov`` for what only the models find.

    The models judge runs of 12 or more characters in what the spans of patterns leave of the text. They report a run
    with a log-likelihood ratio of at least ``margin`` per character, and of other runs each stretch that has as much
    (see :func:`stretches`), if they are :func:`varied`. A null text is empty and has no spans.
    """
    size = len(ALPHABET)
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")  # folded into one constant of fixed size
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kinds = list(PATTERNS)
    found = rows.select("doc_id", "text", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])

    def judged(x: Column) -> Column:
        codes = F.transform(F.split(x["m"], ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
        gains = let(codes, lambda cs: F.transform(F.sequence(F.lit(1), F.size(cs) - 1), lambda i: F.get(table, F.get(cs, i - 1) * size + F.get(cs, i)) - margin))
        whole = F.array(F.struct(F.lit(0).alias("s"), F.length(x["m"]).alias("e")))
        parts = let(gains, lambda g: F.when(F.aggregate(g, F.lit(0.0), lambda acc, v: acc + v) >= 0, whole).otherwise(F.transform(stretches(g), lambda y: to_edges(x["m"], y))))
        kept = F.filter(parts, lambda y: (y["e"] - y["s"] >= MIN_ASSIGNED) & varied(F.substring(x["m"], y["s"] + 1, y["e"] - y["s"])))
        return F.transform(kept, lambda y: F.struct((x["s"] + y["s"]).alias("s"), (x["s"] + y["e"]).alias("e")))

    found = found.withColumn("rest", blanked(F.col("text"), F.concat(*kinds)))
    found = found.select("doc_id", *kinds, F.flatten(F.transform(find(F.col("rest"), CANDIDATE), judged)).alias("markov"))

    def named(k: str, rank: int) -> Column:
        return F.transform(k, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), F.lit(k).alias("kind"), x["e"].alias("e")))

    spans = F.sort_array(F.concat(*[named(k, i) for i, k in enumerate([*kinds, "markov"])]))
    return found.select("doc_id", F.transform(spans, lambda x: F.struct(x["s"].alias("start"), x["kind"].alias("kind"), x["e"].alias("end"))).alias("spans"))
