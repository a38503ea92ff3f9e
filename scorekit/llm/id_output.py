"""Texts as token ids in compressed files, written in document order, and read back."""

from __future__ import annotations

import os
import re
import sys
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, compress, islice
from types import ModuleType

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import materialize
from . import id_coder
from .common import small_side
from .mixing import running_totals

SEGMENT = 2 << 20  # ids after which a range starts a new segment, so that readers hold no more at once
REMEMBERED = 2_000_000  # pieces of text whose ids a worker keeps, some 130 MB
FILE_SCHEMA = "range int, segment int, is_doc boolean, place bigint, doc_id bigint, n bigint, crc bigint, coded binary"


# Kinds of bytes: white space, small letters (capitals are lowered before), marks, digits, and the rest: what is beyond ASCII, and
# the apostrophe, of which only the tokenizer knows where they belong.
_SPACE, _LETTER, _MARK, _DIGIT, _OTHER = range(5)
_KIND = bytes(_SPACE if c in b" \t\n\v\f\r" else _OTHER if c > 127 or c == 39 else _DIGIT if 48 <= c <= 57
              else _LETTER if 97 <= c | 32 <= 122 else _MARK for c in range(256))
_KINDS = 5
# Letters up to U+023F, all of which are composed and have small forms that are single letters.
_LATIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc8][\x80-\xbf])+").fullmatch
_SHORT = 15  # bytes of a piece that is told by two numbers
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_GROUP = 1 << 18  # bytes of the texts that are taken apart at once


def _borders(within_words: bool) -> bytes:
    """For two kinds that follow each other, whether a piece begins at the second one (1) and ends at the first one (2)."""
    out = bytearray(256)
    for a in range(_KINDS):
        for b in range(_KINDS):
            apart = within_words and (a != b or a == _DIGIT) and _OTHER not in (a, b)
            out[a * _KINDS + b] = (b != _SPACE and (apart or a == _SPACE)) + 2 * (a != _SPACE and (apart or b == _SPACE))
    return bytes(out)


def pieces(raw: bytes, within_words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of lowered text begin and end: its words, and within words runs of letters, runs of marks and single digits,
    except next to an apostrophe or anything beyond ASCII."""
    kind = np.frombuffer(b"".join((b"\0", raw.translate(_KIND), b"\0")), dtype=np.uint8)
    border = np.frombuffer((kind[:-1] * np.uint8(_KINDS) + kind[1:]).tobytes().translate(_borders(within_words)), dtype=np.uint8)
    return np.flatnonzero((border & 1).view(bool)), np.flatnonzero((border >> 1).view(bool))


class WordIds:
    """Ids of texts by a tokenizer that lower-cases and never looks across white space: each word is encoded once and
    remembered. If the tokenizer takes letters, digits and marks apart (``by_pieces``), so do we, and words share pieces.

    Pieces of up to 15 bytes stand in one of two slots of a table, by their bytes and length as two numbers; longer ones, and
    words of texts with special tokens, in a dictionary. Both lead to a run of ``pool``, where it begins and its length.
    """

    def __init__(self, encode_words: Callable[[list[bytes]], tuple[list[bytes], np.ndarray, np.ndarray]]) -> None:
        self.encode_words = encode_words
        self.by_pieces = getattr(encode_words, "by_pieces", False)
        self.clear()

    def clear(self) -> None:
        self.long: dict[bytes, int] = {}
        self.slots = np.zeros((2 * REMEMBERED, 3), dtype=np.uint64)
        self.pool, self.used, self.n = np.zeros(1 << 16, dtype="<u4"), 0, 0

    def learn(self, words: list[bytes]) -> dict[bytes, int]:
        """The runs of words, now in the pool."""
        words, ids, n = self.encode_words(words)
        end = self.used + len(ids)
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(end, dtype="<u4")])
        self.pool[self.used:end] = ids
        runs = self.used + np.cumsum(n) - n << 32 | n
        self.used, self.n = end, self.n + len(words)
        return dict(zip(words, runs.tolist(), strict=True))

    def places(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = (one * np.uint64(0x9E3779B97F4A7C15) ^ two * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93)
        room = np.uint64(len(self.slots))
        return tuple(((mixed >> np.uint64(s) & np.uint64(0xFFFFFFFF)) * room >> np.uint64(32)).view(np.int64) for s in (32, 4))

    def runs(self, raw: bytes, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The run of each piece."""
        sizes = ends - begins
        loads = np.ndarray(len(raw) + 8, dtype="<u8", buffer=raw + bytes(16), strides=(1,))
        one = loads[begins] & _MASKS.take(np.minimum(sizes, 8))
        two = loads[np.minimum(begins + 8, len(raw))] & _MASKS.take(np.clip(sizes - 8, 0, 7)) | sizes.view(np.uint64) << np.uint64(56)
        first, second = self.places(one, two)
        short = sizes <= _SHORT
        there = self.slots.take(first, axis=0)
        found = there[:, 2].copy()
        missing = np.flatnonzero((there[:, 0] != one) | (there[:, 1] != two) | ~short)
        if len(missing):
            there = self.slots.take(second[missing], axis=0)
            own = (there[:, 0] == one[missing]) & (there[:, 1] == two[missing]) & short[missing]
            found[missing[own]] = there[own, 2]
            missing = missing[~own]
        if len(missing):
            words = [raw[a:b] for a, b in zip(begins[missing].tolist(), ends[missing].tolist())]
            known = {w: self.long[w] for w in words if w in self.long} if self.long else {}
            new = self.learn(list(set(words).difference(known)))
            known.update(new)
            found[missing] = list(map(known.__getitem__, words))
            self.long.update((w, known[w]) for w in compress(words, (~short[missing]).tolist()))
            self.remember(*(a[missing[short[missing]]] for a in (one, two, found, first, second)))
        return found.view(np.int64)

    def remember(self, one: np.ndarray, two: np.ndarray, runs: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        """Put pieces in their first slots if these are free, else in the second ones, whatever is there."""
        rows = np.stack([one, two, runs], axis=1)
        free = self.slots[first, 1] == 0
        self.slots[first[free]] = rows[free]
        left = (self.slots[first, :2] != rows[:, :2]).any(axis=1)
        self.slots[second[left]] = rows[left]

    def ids(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs, and how many there are up to each."""
        n = runs & 0xFFFFFFFF
        upto = np.cumsum(n)
        return self.pool.take(np.repeat((runs >> 32) - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)), upto

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        raws = [t.encode() for t in texts]
        out: list[np.ndarray] = []
        while len(out) < len(raws):
            if self.n > REMEMBERED or self.used > 16 * REMEMBERED:
                self.clear()
            if b"<|" in raws[len(out)]:  # special tokens are told by their case
                words = raws[len(out)].split()
                self.long.update(self.learn(list(set(words).difference(self.long))))
                out.append(self.ids(np.array([self.long[w] for w in words], dtype=np.int64))[0])
                continue
            group: list[bytes] = []
            size = 0
            for raw in islice(raws, len(out), None):
                if b"<|" in raw or group and size + len(raw) > _GROUP:
                    break
                group.append(raw)
                size += len(raw)
            raw = b" ".join(group).lower()
            begins, ends = pieces(raw, self.by_pieces)
            ids, upto = self.ids(self.runs(raw, begins, ends))
            bounds = np.searchsorted(begins, np.cumsum([len(g) + 1 for g in group]))
            upto = np.concatenate([[0], upto])[[0, *bounds]].tolist()
            out += [ids[a:b] for a, b in zip(upto, upto[1:])]
        return out


def word_ids(path: str) -> WordIds:
    """The words and ids that this Python worker already knows, whichever task it learnt them in."""
    kept = sys.modules.setdefault("scorekit_worker_memory", ModuleType("scorekit_worker_memory")).__dict__
    if path not in kept:
        kept[path] = WordIds(word_tokenizer(path))
    return kept[path]


def word_tokenizer(path: str) -> Callable[[list[bytes]], tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Words to ids, without special tokens, by a vocabulary file of the tokenizers library. Gives the words in an order of its
    own, their ids, joined, and how many each has."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    mark = getattr(tokenizer.model, "end_of_word_suffix", None)
    is_end = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
    is_end[[i for t, i in tokenizer.get_vocab().items() if mark and t.endswith(mark)]] = True

    def by_places(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # One call for all of them costs half as much as one for each; positions tell whose ids are whose.
        texts = [w.decode() for w in words]
        out = tokenizer.encode(" ".join(texts), add_special_tokens=False)
        begins = np.cumsum([0, *[len(w) + 1 for w in texts[:-1]]])
        owners = np.searchsorted(begins, np.array([a for a, _ in out.offsets], dtype=np.int64), side="right") - 1
        return np.array(out.ids, dtype="<u4"), np.bincount(owners, minlength=len(words))

    # Latin letters need neither what the tokenizer does to a text before nor its pattern, only to be lowered and cut at spaces.
    letters_only = Tokenizer.from_file(path)
    letters_only.normalizer = None
    letters_only.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def by_last_ids(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # A word of letters alone has one last id, and it bears the mark: no positions are needed.
        some = [b" ".join(words[a:a + 200]).decode().lower() for a in range(0, len(words), 200)]
        outs = letters_only.encode_batch_fast(some, add_special_tokens=False)
        ids = np.array(list(chain.from_iterable(out.ids for out in outs)), dtype="<u4")
        ends = np.flatnonzero(is_end.take(ids)) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(words) else by_places(words)

    def encode(words: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        latin = [encode.by_pieces and _LATIN(w) is not None for w in words]
        letters, others = list(compress(words, latin)), list(compress(words, (not x for x in latin)))
        parts = [how(some) for how, some in ((by_last_ids, letters), (by_places, others)) if some]
        ids, n = zip(*parts) if parts else ([np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int64)])
        return letters + others, np.concatenate(ids), np.concatenate(n)

    # Whether the tokenizer takes a text apart as pieces() does is seen from a text with all pairs of marks and all Latin letters.
    signs = [chr(c) for c in range(33, 127) if c != 39 and (not chr(c).isalnum() or chr(c) in "az09")]
    probe = " ".join(f"{a}{b} \u00e9{b}{a}" for a in signs for b in signs if a + b != "<|" != b + a)
    letters = [chr(c) for c in range(0xC0, 0x240) if chr(c).lower().isalpha()]
    probe = f"{probe} {' '.join(letters)} {''.join(letters)}".encode().lower()
    whole = tokenizer.encode(probe.decode(), add_special_tokens=False).ids
    encode.by_pieces = True
    cuts = [probe[a:b] for a, b in zip(*pieces(probe, True))]
    words, ids, n = encode(list(set(cuts)))
    alone = dict(zip(words, np.split(ids, np.cumsum(n)[:-1]), strict=True))
    encode.by_pieces = whole == np.concatenate([alone[w] for w in cuts]).tolist()
    return encode


def write_ids(
    docs: DataFrame, path: str, vocabulary: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
) -> None:
    """Encode all texts and write them to ``path``, a folder of Parquet files.

    Documents are range partitioned by id (nulls first, ties by a hash of the text), so ranges follow each other in
    order. Each range is a run of segments; a segment has a row for its start table, rows for its blocks of coded ids,
    in order, and one for each document with its place in the segment and number of ids. Every document ends with ``end_id``. The vocabulary must be
    one that splits texts at white space and drops it. A null text is empty and has just the end id.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, end = word_ids(vocabulary), np.array([end_id], dtype="<u4")
        held: list[np.ndarray] = []
        index: list[tuple[int | None, int]] = []
        where = segment = size = 0

        def flush() -> pd.DataFrame:
            at = np.cumsum([0, *[n for _, n in index[:-1]]]) if index else []
            table, blocks = id_coder.encode(np.concatenate(held))
            parts = [(where, segment, True, int(p), d, n, None, None) for p, (d, n) in zip(at, index, strict=True)]
            parts += [(where, segment, False, i, None, n, crc, coded) for i, (n, crc, coded) in enumerate([(0, None, table), *blocks])]
            held.clear()
            index.clear()
            out = pd.DataFrame(parts, columns=["range", "segment", "is_doc", "place", "doc_id", "n", "crc", "coded"])
            return out.astype({"doc_id": "Int64", "crc": "Int64"})

        for batch in batches:
            where = int(batch["range"].iloc[0]) if len(batch) else where
            ids_of = batch["doc_id"].astype("Int64")
            for a in range(0, len(batch), 100):
                for d, ids in zip(ids_of.iloc[a:a + 100], words(batch["text"].iloc[a:a + 100].tolist()), strict=True):
                    held += (ids, end)
                    index.append((None if d is pd.NA else int(d), len(ids) + 1))
                    size += len(ids) + 1
                if size >= SEGMENT:
                    yield flush()
                    segment, size = segment + 1, 0
        if index:
            yield flush()

    ranged.mapInPandas(run, FILE_SCHEMA).write.parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of a folder that :func:`write_ids` wrote: ``doc_id, start, n_tokens, ids_crc32`` and, on request, ``ids``.

    ``start`` counts the ids of all documents before it. Every block is decoded and held against its checksum.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    sizes = files.where("is_doc").groupBy("range", "segment").agg(F.sum("n").alias("ids"))
    starts = materialize(running_totals(sizes, [], [F.col("range"), F.col("segment")], "ids", "before").drop("ids"), "starts")
    fields = "doc_id bigint, range int, segment int, place bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")

    def read(rows: pd.DataFrame) -> pd.DataFrame:
        blocks = rows[~rows["is_doc"]].sort_values("place")
        (_, _, table), *coded = zip(blocks["n"], blocks["crc"], blocks["coded"], strict=True)
        ids = id_coder.decode(table, coded)
        own = rows[rows["is_doc"]]
        parts = [ids[p:p + n] for p, n in zip(own["place"], own["n"], strict=True)]
        out = own[["doc_id", "range", "segment", "place"]].assign(n_tokens=own["n"], ids_crc32=[zlib.crc32(x) for x in parts])
        return out.assign(ids=[x.astype(int).tolist() for x in parts]) if with_ids else out

    docs = files.groupBy("range", "segment").applyInPandas(read, fields)
    joined = docs.join(small_side(starts, starts.count(), 48), ["range", "segment"], "left")
    return joined.select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
