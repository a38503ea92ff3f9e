"""CRCs of the words of byte texts, and of neighbouring words, found by an Aho-Corasick automaton.

The automaton holds words between delimiters. Each carries its CRC and its length, so a scan yields these without
looking at a word's bytes again, and the CRC of two neighbours follows from both payloads alone. Words that the
dictionary lacks are gaps between the automaton's hits, and get their payload from their bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np

PIECE = 1 << 20  # bytes scanned at once
DIRECT = 64  # shifts of fewer bytes have a table each

_UPPER = range(ord("A"), ord("Z") + 1)
_KEPT = {*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)}
# Bytes of words as they are, capitals lower-cased, any other byte a space. Bytes beyond ASCII belong to words.
_PLAIN = bytes(b if b in _KEPT else b + 32 if b in _UPPER else 32 for b in range(256))


def plain(text: bytes) -> bytes:
    """UTF-8 with A-Z in lower case and spaces for all delimiters, each byte in its place."""
    return text.translate(_PLAIN)


def _after_one_byte(crc: np.ndarray) -> np.ndarray:
    """What a CRC becomes as a part of that of a string one byte longer."""
    return (crc >> np.uint32(8)) ^ _STEP[crc & np.uint32(255)]


def _steps() -> np.ndarray:
    """The standard reflected CRC-32 of each byte, bit by bit."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1).astype(np.uint32)
    return crc


def _apply(tables: np.ndarray, at: np.ndarray | int, crc: np.ndarray) -> np.ndarray:
    """The linear map ``tables[at]``, one table per byte of the CRC."""
    out = tables[at, 0, crc & 255]
    for k in (1, 2, 3):
        out = out ^ tables[at, k, (crc >> np.uint32(8 * k)) & 255]
    return out


_STEP = _steps()
_SHIFTS = np.zeros((DIRECT, 4, 256), dtype=np.uint32)  # by 0, 1, 2 ... bytes
_SHIFTS[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32)[:, None])
for _n in range(1, DIRECT):
    _SHIFTS[_n] = _after_one_byte(_SHIFTS[_n - 1])
_DOUBLES = [_after_one_byte(_SHIFTS[0])]  # by 1, 2, 4 ... bytes
for _n in range(31):
    _DOUBLES.append(_apply(_DOUBLES[-1][None], 0, _DOUBLES[-1]))


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part that a string with this CRC has in the CRC of the string followed by ``n`` more bytes."""
    out = _apply(_SHIFTS, np.minimum(n, DIRECT - 1), crc)
    far = np.flatnonzero(n >= DIRECT)
    if len(far):
        left, part, k = n[far].copy(), crc[far], 0
        while left.any():
            odd = (left & 1).astype(bool)
            part = np.where(odd, _apply(_DOUBLES[k][None], 0, part), part)
            left, k = left >> 1, k + 1
        out[far] = part
    return out


def joined_crc(first: np.ndarray, second: np.ndarray, second_length: np.ndarray) -> np.ndarray:
    """CRCs of ``first + " " + second`` from those of both words and the second one's length."""
    space = np.full(len(first), zlib.crc32(b" "), dtype=np.uint32)
    return shifted(first, second_length + 1) ^ shifted(space, second_length) ^ second


class Dictionary:
    """An automaton over words, each between delimiters, with their payloads."""

    def __init__(self, words: list[bytes]) -> None:
        self.crc = np.array([zlib.crc32(w) for w in words], dtype=np.uint32)
        self.length = np.array([len(w) for w in words], dtype=np.int64)
        self.automaton = None
        if words:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, w in enumerate(words):
                self.automaton.add_word(f" {w.decode('latin-1')} ", i)
            self.automaton.make_automaton()

    def payloads(self, piece: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and CRC of each word of ``piece``, :func:`plain` bytes with a delimiter at both ends."""
        filled = np.frombuffer(piece, dtype=np.uint8) != 32
        starts = np.flatnonzero(filled[1:] & ~filled[:-1]) + 1
        lengths = np.flatnonzero(filled[:-1] & ~filled[1:]) + 1 - starts
        crc = np.zeros(len(starts), dtype=np.uint32)
        hit = np.zeros(len(piece), dtype=bool)
        if self.automaton is not None:
            found = np.fromiter(chain.from_iterable(self.automaton.iter(piece.decode("latin-1"))), dtype=np.int64)
            which = found[1::2]
            hit[found[::2] - self.length[which]] = True
            known = hit[starts]
            crc[known] = self.crc[which]
        else:
            known = hit[starts]
        new = np.flatnonzero(~known)
        crc[new] = [zlib.crc32(piece[a:a + n]) for a, n in zip(starts[new].tolist(), lengths[new].tolist(), strict=True)]
        return starts, lengths, crc

    def features(self, texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of the words of all texts, in pieces: the number of the text and the CRC of each word, and the same of each
        pair of neighbours. Null texts have none."""
        first = 0
        while first < len(texts):
            held, size = [], 0
            while first + len(held) < len(texts) and size < PIECE:
                held.append(plain(t) if (t := texts[first + len(held)]) else b"")
                size += len(held[-1])
            yield from self._joined(held, first)
            first += len(held)

    def _joined(self, plains: list[bytes], first: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """:meth:`features` of texts numbered from ``first``, as one string that is scanned a piece at a time."""
        begins = np.cumsum([1, *[len(t) + 1 for t in plains[:-1]]])
        whole = b" " + b" ".join(plains) + b" "
        owner, last, at = -1, np.zeros(1, dtype=np.uint32), 0
        while at < len(whole) - 1:
            end = whole.find(b" ", min(at + PIECE, len(whole) - 1))
            starts, lengths, crc = self.payloads(whole[at:end + 1])
            if len(starts):
                texts_of = np.searchsorted(begins, starts + at, side="right") - 1 + first
                # The word before the piece is the first one's neighbour if the text goes on.
                before, before_of = np.concatenate([last, crc[:-1]]), np.concatenate([[owner], texts_of[:-1]])
                near = before_of == texts_of
                yield texts_of, crc, texts_of[near], joined_crc(before[near], crc[near], lengths[near])
                owner, last = texts_of[-1], crc[-1:]
            at = end
