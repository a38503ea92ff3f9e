"""Personal data in text, and the words that give it away.

Fixed patterns find the protected entities: addresses, numbers, cards. Whether a word reveals an entity is a matter of
information: how much of the bits that it takes to name the entity among all texts is known from the word's presence,
as estimated from the texts in which the word stands near the entity. Words that reveal more than a threshold are
replaced by their first letters where these reveal less, and removed otherwise.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import materialize
from .common import BROADCAST_BYTES, PLAIN_WORD, small_side

# The kinds of personal data, in the order in which spans are listed, before the words that reveal them.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"

# The groups that may follow a run are optional, so that each run is read once: a run without them is no match.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
_IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(PLAIN_WORD)

WINDOW = 10  # words on either side of an entity that stand near it
CONTEXTS = 3  # different contexts that a word must share with an entity
UNLIKE = 2.0  # contexts that an entity must be worth, copies of one context being worth one
SHARE = 0.9  # of an entity's information, from which a word reveals it
SURE = 1.64  # deviations by which the estimate is lowered for chance
STEM, SHORT = 3, 5  # letters left of a generalised word; shorter words are removed
ENTRY = 100  # bytes that a word takes beside its own in a worker's memory

SPAN = "struct<kind:string,start:int,end:int>"


def _octet(part: str) -> bool:
    significant = part.lstrip("0")
    return len(significant) <= 3 and int(significant or "0") <= 255


def _luhn(digits: str) -> bool:
    twice = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def personal_data(text: str) -> list[tuple[str, int, int, str]]:
    """Kind, start, end and normal form of each entity, by kind as in :data:`KINDS`, then start; positions are code points.
    Matches of a kind come from the left and do not overlap; one that fails its check is dropped as a whole."""
    out = []
    if "@" in text:
        out += [("email", m.start(), m.end(), m.group().lower()) for m in _EMAIL.finditer(text) if m.group(1)]
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end(), m.group()) for m in _IP.finditer(text) if m.group(1) and all(map(_octet, m.group().split(".")))]
        for kind, pattern, least, most in (("card", _CARD, 13, 19), ("phone", _PHONE, 9, 15)):
            for m in pattern.finditer(text):
                digits = _digits(m.group())
                if least <= len(digits) <= most and (kind == "phone" or _luhn(digits)):
                    out.append((kind, m.start(), m.end(), digits))
    return out


def stem(word: str) -> str | None:
    return word[:STEM] + "*" if len(word) >= SHORT else None


def placed_words(text: str, taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Lower-cased words with their places, but for those that touch one of the ``taken`` stretches."""
    lower = text.encode().lower().decode()
    words = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(lower)]
    if not taken:
        return words
    free, last, k, ordered = [], -1, 0, sorted(taken)
    for w in words:
        while k < len(ordered) and ordered[k][0] < w[2]:
            last = max(last, ordered[k][1])
            k += 1
        if last <= w[1]:
            free.append(w)
    return free


def nearby(text: str) -> list[tuple[str, list[str]]]:
    """Each entity of a text with all the words near it, in order."""
    found = personal_data(text)
    if not found:
        return []
    words = placed_words(text, [(s, e) for _, s, e, _ in found])
    starts = [s for _, s, _ in words]
    near: dict[str, set[str]] = {}
    for kind, s, _, value in found:
        at = bisect_left(starts, s)
        near.setdefault(f"{kind}:{value}", set()).update(w for w, _, _ in words[max(0, at - WINDOW):at + WINDOW])
    return [(e, sorted(ws)) for e, ws in near.items()]


def with_stems(words: Iterable[str]) -> set[str]:
    found = set(words)
    return found | {s for w in found if (s := stem(w))}


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[str]:
    return (t or "" for t in batch.column(column).to_pylist())


def contexts(rows: DataFrame) -> DataFrame:
    """``h, entity, words``: each entity of each different text, with the words near it."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(h, e, ws) for h, t in zip(batch.column("h").to_pylist(), _texts(batch, "text"), strict=True) for e, ws in nearby(t)]
            columns = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.string(), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays(columns, ["h", "entity", "words"])

    return rows.select("h", "text").mapInArrow(read, "h bigint, entity string, words array<string>").dropDuplicates(["h", "entity"])


def candidates(found: DataFrame) -> DataFrame:
    """``entity, term, both, texts``: the words, and their stems as ``abc*``, that stand near an entity in several contexts,
    in how many texts they do, and how many texts the entity is in.

    A passage that is repeated, word by word or nearly so, says no more about an entity than one copy of it. So contexts
    of the same words count once, and the entity must have contexts that differ: with c_w of n contexts holding the word w,
    they are worth n * sum(c_w) / sum(c_w^2), which is 1 for n equal ones and n for such as share no word.
    """
    texts = found.groupBy("entity").agg(F.count("*").alias("texts")).where(f"texts >= {CONTEXTS}")
    some = materialize(found.join(texts, "entity"), "contexts")
    different = some.select("entity", "words").distinct()
    n = different.groupBy("entity").agg(F.count("*").alias("n"))
    shared = materialize(different.select("entity", F.explode("words").alias("w")).groupBy("entity", "w").agg(F.count("*").alias("c")), "shared")
    worth = shared.groupBy("entity").agg((F.sum("c") / F.sum(F.col("c") * F.col("c"))).alias("r")).join(n, "entity")
    unlike = materialize(worth.where(F.col("r") * F.col("n") >= UNLIKE).select("entity"), "unlike")
    stems = F.array_distinct(F.transform(F.filter("words", lambda w: F.length(w) >= SHORT), lambda w: F.concat(F.substring(w, 1, STEM), F.lit("*"))))
    open_to = some.join(unlike, "entity", "left_semi")
    terms = open_to.select("entity", "texts", "h", "words", F.explode(F.concat("words", stems)).alias("term"))
    held = terms.groupBy("entity", "term").agg(F.count("*").alias("both"), F.first("texts").alias("texts"))
    # Of words, contexts are counted; a stem is only asked for where its words are.
    often = shared.where(F.col("c") >= CONTEXTS).join(unlike, "entity", "left_semi").select("entity", F.col("w").alias("term"))
    asked = often.unionByName(often.where(F.length("term") >= SHORT).select("entity", F.concat(F.substring("term", 1, STEM), F.lit("*")).alias("term"))).distinct()
    return materialize(held.join(asked, ["entity", "term"], "left_semi"), "candidates")


def holding(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``h, term``, once for each different text and each of ``terms`` that it holds. Terms that take little room are sent
    to the executors; more of them are joined with the words of all texts."""
    few = _few(terms)
    known = rows.sparkSession.sparkContext.broadcast(few) if few is not None else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, ts = [], []
            for h, text in zip(batch.column("h").to_pylist(), _texts(batch, "text"), strict=True):
                held = with_stems(_WORD.findall(text.encode().lower().decode()))
                held = sorted(held & known.value.keys() if known is not None else held)
                hs += [h] * len(held)
                ts += held
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(ts, pa.string())], ["h", "term"])

    pairs = rows.select("h", "text").mapInArrow(read, "h bigint, term string")
    return (pairs if few is not None else pairs.join(terms.select("term"), "term", "left_semi").select("h", "term")).distinct()


def _few(terms: DataFrame) -> dict[str, str | None] | None:
    """``term, shown`` in the driver's memory, if they take no more than :data:`BROADCAST_BYTES`."""
    size = terms.agg(F.sum(F.octet_length("term") + ENTRY)).first()[0] or 0
    if size > BROADCAST_BYTES:
        return None
    shown = F.col("shown") if "shown" in terms.columns else F.lit(None).cast("string")
    return {r["term"]: r["shown"] for r in terms.select("term", shown.alias("shown")).collect()}


def disclosure(both: Column, term_texts: Column, entity_texts: Column, texts: Column) -> Column:
    """The share of an entity's information that a term's presence gives: PMI(entity; term) / IC(entity), with the share
    of the term's texts that have the entity near it taken at the lower end of its (Wilson) interval."""
    p, z2 = both / term_texts, SURE * SURE
    low = (p + z2 / (2 * term_texts) - SURE * F.sqrt(p * (1 - p) / term_texts + z2 / (4 * term_texts * term_texts))) / (1 + z2 / term_texts)
    bits = F.log2(texts / entity_texts)
    return F.when(bits > 0, 1 + F.log2(low) / bits).otherwise(F.lit(0.0))


def revealing_terms(rows: DataFrame, share: float = SHARE) -> DataFrame:
    """``term, shown``: the words that reveal an entity, and what stands for each: its stem, or null if that reveals one too.
    ``rows`` has ``h``, a hash of the text, and ``text``; of equal texts one counts."""
    asked = candidates(materialize(contexts(rows), "near"))
    terms = asked.select("term").distinct()
    if asked.isEmpty():
        return rows.sparkSession.createDataFrame([], "term string, shown string")
    held = holding(rows, materialize(terms, "terms")).groupBy("term").agg(F.count("*").alias("n"))
    texts = rows.select("h").distinct().count()
    judged = asked.join(held, "term").where(disclosure(F.col("both"), F.col("n"), F.col("texts"), F.lit(float(texts))) >= share)
    told = materialize(judged.select("term").distinct(), "told")
    stems = told.where(F.endswith("term", F.lit("*"))).select(F.col("term").alias("stem"))
    words = told.where(~F.endswith("term", F.lit("*"))).withColumn("stem", F.when(F.length("term") >= SHORT, F.concat(F.substring("term", 1, STEM), F.lit("*"))))
    safe = words.join(stems.withColumn("told", F.lit(True)), "stem", "left")
    return materialize(safe.select("term", F.when(F.col("told").isNull(), F.col("stem")).alias("shown")), "revealing")


def sanitised(text: str, spans: list[tuple[str, int, int, str]]) -> str:
    """``text`` with each span replaced by what it is to show; of spans that overlap the first is shown for all."""
    out, at, end = [], 0, 0
    for _, s, e, shown in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= end:
            out += [text[at:s], shown]
        at = end = max(end, e)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = SHARE, with_text: bool = True) -> DataFrame:
    """All spans of personal data and of words that reveal it, and the text without them.

    Returns one row per input row: ``doc_id, spans`` and, unless left out, ``text``. ``spans`` is an array of (kind, start,
    end), by kind (``email, ip, card, phone``, then ``term``) and start; positions are code points, ends are exclusive. In
    the text, personal data is replaced by its kind in brackets, and a revealing word by its first letters and ``*``, or by
    ``*`` alone. A word that touches personal data is part of it. A null text is empty, and stays null. Equal texts count
    once in all statistics, rows that share an id are judged each by its own text, an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    terms = revealing_terms(rows, share)
    few = _few(terms)
    known = docs.sparkSession.sparkContext.broadcast(few) if few is not None else None
    if few is None:
        held = holding(rows, terms).join(terms, "term").groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("term", "shown"))).alias("held"))
        held = materialize(held, "held")
        size = held.agg(F.sum(F.size("held")).alias("n")).first()["n"] or 0
        rows = rows.join(small_side(held, size, 64), "h", "left")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            maps = [dict(m or ()) for m in batch.column("held").to_pylist()] if known is None else None
            all_spans, texts = [], []
            for i, t in enumerate(_texts(batch, "text")):
                spans = [(k, s, e, f"[{k.upper()}]") for k, s, e, _ in personal_data(t)]
                shown = known.value if known is not None else maps[i]
                if shown:
                    free = placed_words(t, [(s, e) for _, s, e, _ in spans])
                    spans += [(TERM, s, e, shown[w] or "*") for w, s, e in free if w in shown]
                all_spans.append([{"kind": k, "start": s, "end": e} for k, s, e, _ in spans])
                if with_text:
                    texts.append(sanitised(t, spans) if spans else t)
            columns = {"doc_id": batch.column("doc_id"), "spans": pa.array(all_spans, span)}
            if with_text:
                whole = batch.column("text").is_valid().to_pylist()
                columns["text"] = pa.array([t if there else None for t, there in zip(texts, whole, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return rows.drop("h").mapInArrow(read, f"doc_id {kind}, spans array<{SPAN}>" + (", text string" if with_text else ""))
