"""What lets the ids of a large collection be written and read at little cost, held against plain ways."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scorekit.llm import id_coder, id_output
from scorekit.llm.id_output import WordIds, word_tokenizer

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SIGNS = ["a", "Z", "it", "S", "T", "'", "''", "5", "07", ".", ",", "-", "&&&", "<", "|", "_", "\x1c", "\x00", "é", "ß", "İ", "Ǆ", "ñ", "é", "́",
         "̇", "Ω", "ς", "漢", "½", "²", " ", " ", "\x85", " ", "\t\n", "<|endoftext|>", "averylongword" * 3, "\U0001f600", "ﬁ", "ŉ", "K"]


@pytest.fixture(scope="module")
def encode_words():
    return word_tokenizer(VOCABULARY)


def texts(n, seed):
    random = np.random.default_rng(seed)
    return ["".join(random.choice(SIGNS, size=random.integers(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("within_words", [True, False])
def test_pieces_give_the_ids_of_the_whole_text(encode_words, within_words):
    words, tokenizer, some = WordIds(encode_words), Tokenizer.from_file(VOCABULARY), texts(3000, 1)
    assert words.by_pieces
    words.by_pieces = within_words
    for _ in range(2):  # unknown words, then known ones
        for text, ids in zip(some, words(some), strict=True):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_are_right_however_few_are_remembered(encode_words, monkeypatch):
    monkeypatch.setattr(id_output, "REMEMBERED", 20)
    monkeypatch.setattr(id_output, "_GROUP", 300)
    words, tokenizer, some = WordIds(encode_words), Tokenizer.from_file(VOCABULARY), texts(300, 2)
    assert [x.tolist() for x in words(some)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in some]


def test_words_share_their_pieces():
    asked = []

    def encode(words):
        asked.extend(words)
        return words, np.array([len(w) for w in words], dtype="<u4"), np.ones(len(words), dtype=np.int64)

    encode.by_pieces = True
    assert [x.tolist() for x in WordIds(encode)(["Word, word; word&&& (word) 10", "señor. SEÑOR!"])] == [
        [4, 1, 4, 1, 4, 3, 1, 4, 1, 1, 1], [6, 1, 6, 1]]
    assert len(asked) == len(set(asked))
    assert {a.decode() for a in asked} == {"word", ",", ";", "&&&", "(", ")", "1", "0", "señor", ".", "seÑor", "!"}


def plain_start(ids):
    """Pairs and the primer's places by counting in dictionaries."""
    pairs, threes = {}, {}
    for k in range(len(ids) - 1):
        pairs[tuple(ids[k:k + 2])] = pairs.get(tuple(ids[k:k + 2]), 0) + 1
    for k in range(len(ids) - 2):
        threes.setdefault(tuple(ids[k:k + 3]), []).append(k)
    held = set()
    for three, places in threes.items():
        if len(places) >= id_coder.COMMON and 2 * len(places) > pairs[three[:2]]:
            held.update(range(places[0], places[0] + 3))
    return pairs, [ids[k] for k in sorted(held)]


def test_start_tables_count_what_is_there():
    ids = (np.random.default_rng(4).zipf(1.3, 20_000) % 300).tolist() + [7, 8, 9, 10] * 50
    start, parts = id_coder.Start.with_parts(np.array(ids))
    pairs, primer = plain_start(ids)
    assert start.primer.tolist() == primer
    counts = dict(zip(zip((start.pairs >> 16).tolist(), (start.pairs & 0xFFFF).tolist()), (start.pair_counts[0].astype(int) << start.pair_counts[1]).tolist()))
    assert len(counts) > 10 and all(n <= pairs[p] < n + n // 8 + 1 for p, n in counts.items())
    assert parts[1:].tolist() == start.part_of(np.array(ids[:-1]), np.array(ids[1:])).tolist()
    assert (start.parts.take(parts) >> np.uint64(43)).tolist() == ids


def test_ranks_of_numbers_too_large_to_sort_with_their_places():
    keys = np.random.default_rng(1).integers(0, 5, 1000)
    for some in (keys, keys << 59):
        ranked, places = id_coder._ranked(some)
        assert places.tolist() == np.argsort(some, kind="stable").tolist() and ranked.tolist() == np.sort(some).tolist()


def test_carries_run_through_full_words():
    """Parts that lie at the very end of a range bring the coder's low end close to its upper one for many words."""
    writer = id_coder._Writer(2, 400)
    random, n = np.random.default_rng(6), 300
    steps = [(np.array([4095 - 1, 0]), np.array([1, 1]), (random.integers(0, 2, 2) + (1 << 17) - 2) * np.array([1, 0])) for _ in range(n)]
    steps[-1] = (np.array([4095, 4095]), np.array([1, 1]), np.array([(1 << 17) - 1] * 2))
    as_numbers = [tuple(a.astype(np.uint64) for a in s) for s in steps]
    bits, one = np.full(2, 17, dtype=np.uint64), np.ones(2, dtype=np.uint64)
    for begin, size, part in as_numbers:
        writer.put(begin, size, bits, part, one)
    reader = id_coder._Reader(writer.finish())
    for begin, size, part in as_numbers:
        assert reader.beyond(begin).all() and not reader.beyond(begin + size).any()
        assert reader.part(begin, size, bits).tolist() == part.tolist()
        reader.take(part, one)
