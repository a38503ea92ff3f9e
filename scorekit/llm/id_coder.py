"""Token ids as compressed files: an adaptive, context-mixing range coder over independent, checksummed blocks.

Each id is predicted by the two before it (order 2: one id, learnt in the block or taken from the start table), by the one
before it (order 1: frequencies of the ids that follow it) and by its own frequency (order 0). How sure order 2 is, and how
much of its context order 1 covers, pick two rows of adaptive counts; their sum is the mixed probability of which order
gives the id. Blocks have a fixed length and reset to the start table of their segment: the frequencies, the commonest
runs of three ids and the rows that the mix starts from, written once, with a checksum. With it any block can be read
alone, and many are coded side by side as lanes of numpy arrays. A block learns from its ids a span at a time, so that all
that needs no id of the same span is done for whole spans at once.
"""

from __future__ import annotations

import zlib

import numpy as np

LENGTH = 2048  # ids of a block; the last one of a segment may hold fewer
LANES = 2048  # blocks coded side by side
SPAN = 32  # ids after which a block learns from them
TRIAL = 256  # ids of each block from which the starting rows of the mix are learnt
PERIOD = 512  # ids after which the mixing counts are halved
PRIMER_LENGTH = 256  # ids of a block of the primer, shorter so that it has lanes as well
BITS = 9  # of the number of order-2 contexts that a block learns
START_BITS = 17  # of the number of order-2 contexts in a start table
COMMON = 6  # times that a run of three ids occurs at least, to be in the start table
WORTH = 16  # bits that order 1 must save on a pair of ids, to be in the start table
CONTEXTS, FOLLOWERS = 4096, 1024  # ids with order-1 frequencies, and ids that one of them has; the rest is left to order 0
SHARE_BITS, PAIR_BITS = 17, 11  # of the sum of order-0 frequencies, and of those of one order-1 context
ROW_BITS = 11  # of the sum of one row of the mix
STATES = 8  # order 2: no prediction, as the table says, learnt here, and up to five successes; order 1: share covered
_LEARNT, _SURE, _TOP = 2, 4, STATES - 1
_STEP, _ROW = 8, 512  # what one id adds to a count, and the sum of a row at the start, at most
_SHIFTS = np.array([0, PAIR_BITS, SHARE_BITS], dtype=np.uint64)
_MIX = np.uint64(ROW_BITS + 1)  # of two rows together
_FIELD, _FIELD2, _FIELD_MASK = np.uint64(16), np.uint64(32), np.uint64(0xFFFF)  # four bounds in one number
_PART, _PART_ID, _PART_MASK = np.uint64(20), np.uint64(43), np.uint64((1 << 20) - 1)  # begin, size and id in one number
_SURELY = np.uint64(1 << 20)  # begin 0, size 1: what is left to say of an id that order 2 has given
_CHECKED = 19  # bits of an entry of order 2; above them stands what tells contexts apart, or that it was learnt here
_ENTRY, _HERE = (1 << _CHECKED) - 1, 2 << _CHECKED
_CHECK = 0xFFF << _CHECKED
# The coder keeps 63 bits, of which 32 are written at once; the bit above them is a carry.
_WORD, _KEPT, _TOP_BIT = np.uint64(32), np.uint64(31), np.uint64(1)
_LOW, _REST, _FULL = np.uint64(1 << 31), np.uint64((1 << 31) - 1), np.uint64((1 << 63) - 1)


def _mixed(before2: np.ndarray, before1: np.ndarray) -> np.ndarray:
    """Well spread numbers for the order-2 contexts."""
    return (before2 * 2654435761 + before1) * -7046029254386353131 >> 30


def _pick(which: np.ndarray, these: np.ndarray, those: np.ndarray) -> np.ndarray:
    """``np.where`` by arithmetic, which does not slow down where the choice is hard to foresee."""
    return those + (these - those) * which


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers, none below zero, and the places that they come from, in order."""
    bits = len(keys).bit_length()
    if len(keys) and int(keys.max()).bit_length() + bits > 63:
        places = np.argsort(keys, kind="stable")
        return keys[places], places
    keys = keys << bits  # the places are sorted along, which is faster
    keys |= np.arange(len(keys))
    keys.sort()
    places = keys & ((1 << bits) - 1)
    keys >>= bits
    return keys, places


def _leading(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts to four leading bits: those, and by how much they are shifted."""
    shifts = np.maximum(np.frexp(counts.astype(np.float64))[1] - 4, 0).astype(np.uint8)
    return (counts >> shifts).astype(np.uint8), shifts


def _runs(ranked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of a sorted array begin, and how long they are."""
    begins = np.flatnonzero(ranked[1:] != ranked[:-1]) + 1
    begins = np.concatenate([begins[:0] if not len(ranked) else [0], begins])
    return begins, np.diff(begins, append=len(ranked))


class Start:
    """What every block of a segment starts from. It is made from the segment's ids and kept as bytes with a checksum.

    ``known`` are the ids that occur, with their counts. ``pairs`` (id before << 16 | id) are those that order 1 gives, with
    counts; ``cover`` says for every known id how much of what follows it they are. ``primer`` holds the first places of all
    runs of three ids that occur often and mostly end alike, joined; order 2 predicts what follows a context there.
    """

    def __init__(self, known, counts, pairs, pair_counts, cover, primer, rows) -> None:
        self.known, self.counts, self.pairs, self.pair_counts, self.cover, self.rows = known, counts, pairs, pair_counts, cover, rows
        self.share = self._shares(counts[0].astype(np.int64) << counts[1], np.zeros(len(known), dtype=np.int64), SHARE_BITS)
        # Order 1: contexts are numbered as they come.
        begins, followers = _runs(pairs >> 16)
        self.before, group = pairs[begins] >> 16, np.repeat(np.arange(len(begins)), followers)
        self.pair_share = size = self._shares(pair_counts[0].astype(np.int64) << pair_counts[1], group, PAIR_BITS)
        # Where the part of an id begins, its size and the id, in one number: for each id by order 0, then for each pair.
        self.parts = np.zeros((1 << 16) + len(pairs), dtype=np.int64)
        self.parts[known] = np.cumsum(self.share) - self.share | self.share << 20 | known << 43
        self.parts[1 << 16:] = (np.cumsum(size) - size - (group << PAIR_BITS)) | size << 20 | (pairs & 0xFFFF) << 43
        self.parts = self.parts.view(np.uint64)
        self.state = np.zeros(1 << 16, dtype=np.int64)
        self.state[known] = cover
        self.prime(primer)

    def prime(self, primer: np.ndarray) -> None:
        self.primer, self.table = primer, np.zeros(1 << START_BITS, dtype=np.int64)
        if len(primer) > 2:
            mixed = _mixed(primer[:-2], primer[1:-1])
            # An id with twelve bits of its context, which tell contexts of one place apart.
            self.table[mixed & ((1 << START_BITS) - 1)] = (mixed << _CHECKED - START_BITS & _CHECK) | primer[2:] << 3 | 1

    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """For a reader: the part that each slot of order 0, and then of each order-1 context, belongs to; and where the slots of
        the context of an id begin."""
        numbers = np.concatenate([self.known, np.arange(1 << 16, len(self.parts))]).astype(np.int32)
        part_at = np.repeat(numbers, np.concatenate([self.share, self.pair_share]))
        begin = np.full(1 << 16, 1 << SHARE_BITS)
        begin[self.before] += np.arange(len(self.before)) << PAIR_BITS
        return part_at, begin

    @staticmethod
    def _shares(counts: np.ndarray, group: np.ndarray, bits: int) -> np.ndarray:
        """Counts made to add up to a power of two within each group (numbered from 0, in order), none of them zero."""
        if not len(counts):
            return counts
        begins, n = _runs(group)
        size = counts * ((1 << bits) - n)[group] // np.add.reduceat(counts, begins)[group] + 1
        # The rest goes to the first of the largest.
        largest = np.flatnonzero(size == np.maximum.reduceat(size, begins)[group])
        first = largest[_runs(group[largest])[0]]
        size[first] += (1 << bits) - np.add.reduceat(size, begins)
        return size

    def look(self, mixed: np.ndarray) -> np.ndarray:
        """What order 2 predicts, with confidence 1; more than :data:`_ENTRY`, with the bits of an entry zero, if nothing."""
        return np.minimum(self.table.take(mixed & ((1 << START_BITS) - 1)) ^ (mixed << _CHECKED - START_BITS & _CHECK), _ENTRY + 1)

    def part_of(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The places in ``parts`` of ids that follow others."""
        if not len(self.pairs):
            return ids
        wanted = before << 16 | ids
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs.take(at) == wanted, at + (1 << 16), ids)

    @classmethod
    def of(cls, ids: np.ndarray) -> Start:
        return cls.with_parts(ids)[0]

    @classmethod
    def with_parts(cls, ids: np.ndarray) -> tuple[Start, np.ndarray]:
        """The start table, and the places in its ``parts`` of the ids, the first of a block taken as if it followed the last."""
        x = ids.astype(np.int64)
        often = np.bincount(x, minlength=1 << 16)
        known = np.flatnonzero(often)
        ranked, places = _ranked(x[:-1] << 16 | x[1:])
        begins, n_all = _runs(ranked)
        every = ranked[begins]
        run_at = np.empty(len(ranked), dtype=np.int32)
        run_at[places] = np.repeat(np.arange(len(n_all), dtype=np.int32), n_all)
        saved = n_all * np.log2(n_all * (len(x) / often[every >> 16]) / often[every & 0xFFFF])
        kept = np.flatnonzero(saved > WORTH)
        pairs, n_pairs, saved = every[kept], n_all[kept], saved[kept]
        starts, sizes = _runs(pairs >> 16)
        if len(starts) > CONTEXTS:
            best = np.zeros(len(starts), dtype=bool)
            best[np.argsort(-np.add.reduceat(saved, starts), kind="stable")[:CONTEXTS]] = True
            best = np.repeat(best, sizes)
            kept, pairs, n_pairs = kept[best], pairs[best], n_pairs[best]
            starts, sizes = _runs(pairs >> 16)
        if len(sizes) and sizes.max() > FOLLOWERS:
            order = np.lexsort((-n_pairs, pairs >> 16))
            order = np.sort(order[np.arange(len(order)) - np.repeat(starts, sizes) < FOLLOWERS])
            kept, pairs, n_pairs = kept[order], pairs[order], n_pairs[order]
        covered = np.bincount(pairs >> 16, weights=n_pairs, minlength=1 << 16).astype(np.int64)[known]
        cover = np.where(covered > 0, 1 + covered * (_TOP - 1) // often[known], 0).astype(np.uint8)
        part_of = every & 0xFFFF
        part_of[kept] = np.arange(len(kept)) + (1 << 16)
        parts = np.concatenate([x[:1], part_of.take(run_at)])
        # Runs of three that occur often consist of pairs that do.
        frequent = (n_all >= COMMON).take(run_at)
        frequent = np.flatnonzero(frequent[1:] & frequent[:-1])
        ranked, places = _ranked(run_at[frequent].astype(np.int64) << 16 | x[frequent + 2])
        begins, n3 = _runs(ranked)
        begins, n3 = begins[n3 >= COMMON], n3[n3 >= COMMON]
        wanted = frequent[places[begins[2 * n3 > n_all[ranked[begins] >> 16]]]]
        held = np.zeros(len(x), dtype=bool)
        for k in range(3):
            held[wanted + k] = True
        rows = np.repeat(np.array([[6], [6], [20]]), 2 * STATES, axis=1)
        start = cls(known, _leading(often[known]), pairs, _leading(n_pairs), cover, x[held], rows)
        # The rows of the mix, from a trial of the first ids of all blocks.
        whole = len(x) // LENGTH
        if whole:
            first = [a[: whole * LENGTH].reshape(whole, LENGTH)[:LANES, :TRIAL] for a in (x, parts)]
            seen = _encode(start, *first, dry=True).sum(axis=1, dtype=np.int64)
            start.rows = np.maximum(seen * _ROW // seen.sum(axis=0), 1)
        return start, parts

    def to_bytes(self) -> bytes:
        """Lengths, then the arrays, the primer coded without order 2, then a checksum of all of it."""
        coded, primer = b"", self.primer
        if len(primer):
            self.prime(primer[:0])
            coded = b"".join(len(b).to_bytes(4, "little") + b for _, _, b in _blocks(self, primer, None, PRIMER_LENGTH))
            self.prime(primer)
        followers = np.zeros(1 << 16, dtype=np.int64)
        followers[self.before] = _runs(self.pairs >> 16)[1]
        places = np.searchsorted(self.known, self.pairs & 0xFFFF)  # shorter gaps than those of ids
        gaps = np.diff(places, prepend=0) % (1 << 16)
        arrays = [zlib.compress(b"".join(part)) for part in (
            (np.diff(self.known, prepend=0).astype("<u2").tobytes(), *(c.tobytes() for c in self.counts), self.cover.tobytes(),
             self.rows.astype("<u2").tobytes(), followers[self.known].astype("<u2").tobytes()),
            ((gaps & 0xFF).astype(np.uint8).tobytes(),), ((gaps >> 8).astype(np.uint8).tobytes(),),
            (self.pair_counts[0].tobytes(),), (self.pair_counts[1].tobytes(),))]
        out = np.array([len(self.known), len(primer), *map(len, arrays)], dtype="<u4").tobytes() + b"".join(arrays) + coded
        return out + zlib.crc32(out).to_bytes(4, "little")

    @classmethod
    def from_bytes(cls, data: bytes) -> Start:
        if len(data) < 32 or zlib.crc32(data[:-4]) != int.from_bytes(data[-4:], "little"):
            raise ValueError("a start table is damaged")
        n, n_primer, *sizes = np.frombuffer(data, dtype="<u4", count=7).tolist()
        ends = np.cumsum([28, *sizes]).tolist()
        main, low, high, lead, shift = (zlib.decompress(data[a:b]) for a, b in zip(ends, ends[1:]))
        known = np.cumsum(np.frombuffer(main, dtype="<u2", count=n), dtype=np.int64)
        leading, shifts, cover = np.frombuffer(main, dtype=np.uint8, count=3 * n, offset=2 * n).reshape(3, n)
        rows = np.frombuffer(main, dtype="<u2", count=6 * STATES, offset=5 * n).astype(np.int64).reshape(3, 2 * STATES)
        followers = np.frombuffer(main, dtype="<u2", offset=5 * n + 12 * STATES).astype(np.int64)
        gaps = np.frombuffer(low, dtype=np.uint8).astype(np.int64) | np.frombuffer(high, dtype=np.uint8).astype(np.int64) << 8
        pairs = np.repeat(known, followers) << 16 | known[np.cumsum(gaps) % (1 << 16)]
        start = cls(known, (leading, shifts), pairs, (np.frombuffer(lead, dtype=np.uint8), np.frombuffer(shift, dtype=np.uint8)),
                    cover, np.zeros(0, dtype=np.int64), rows)
        at, end, blocks = ends[-1], len(data) - 4, []
        while at < end:
            size = int.from_bytes(data[at:at + 4], "little")
            blocks.append(data[at + 4:at + 4 + size])
            at += 4 + size
        if blocks:
            slots = start.slots()
            start.prime(np.concatenate([_decode(start, slots, blocks[a:a + LANES], PRIMER_LENGTH).reshape(-1)
                                        for a in range(0, len(blocks), LANES)])[:n_primer].astype(np.int64))
        return start


class _Model:
    """What encoder and decoder both know after the same spans, in all lanes.

    ``table`` holds what a block has learnt for order 2, an id and its confidence; where there is nothing yet, the start
    table counts. ``counts`` are those of what came true, three for each of the states of order 2 and of order 1. ``rows`` are
    their shares, of equal sums: four bounds in one number, between which lie order 2, order 1 and order 0.
    """

    def __init__(self, start: Start, lanes: int) -> None:
        self.table = np.zeros(lanes << BITS, dtype=np.int32)
        self.bases = np.arange(lanes, dtype=np.int64) << BITS
        self.counts = np.tile(start.rows.astype(np.uint32), lanes)
        self.set2 = np.arange(lanes, dtype=np.int64) * (2 * STATES)
        self.set1 = self.set2 + STATES
        self.share()

    def share(self) -> None:
        two, one, none = self.counts
        one = two + one
        total = one + none
        two, upto = two * ((1 << ROW_BITS) - 3) // total + 1, one * ((1 << ROW_BITS) - 3) // total + 2
        self.rows = two.astype(np.uint64) << _FIELD | upto.astype(np.uint64) << _FIELD2 | np.uint64(1 << ROW_BITS + 48)

    def look(self, mixed: np.ndarray, started: np.ndarray, covered: np.ndarray, out=(None,) * 4) -> tuple[np.ndarray, ...]:
        """For one step (lanes) or a span (steps, lanes): where the contexts are, the entries there, both rows, and their sum."""
        at = np.add(mixed & ((1 << BITS) - 1), self.bases, out=out[0])
        entry = np.bitwise_and(np.maximum(self.table.take(at), started), _ENTRY, out=out[1])
        row2, row1 = np.add(entry & _TOP, self.set2, out=out[2]), np.add(covered, self.set1, out=out[3])
        return at, entry, row2, row1, self.rows.take(row2) + self.rows.take(row1)

    def learn(self, t: int, ids: np.ndarray, how: np.ndarray, at: np.ndarray, entry: np.ndarray, row2: np.ndarray, row1: np.ndarray) -> None:
        """From a span of steps that ends at ``t``. Of two that have their context in one place the later one stays."""
        sure, new = entry & _TOP, ids << 3 | _LEARNT
        new = _pick(how == 0, entry + (sure < _TOP), _pick(sure > _SURE, entry - 2, new))
        self.table[at.reshape(-1)] = (new | _HERE).astype(np.int32).reshape(-1)
        how = how * self.counts.shape[1]
        seen = np.bincount((how + row2).reshape(-1), minlength=self.counts.size)
        seen += np.bincount((how + row1).reshape(-1), minlength=self.counts.size)
        self.counts += (seen * _STEP).reshape(self.counts.shape).astype(np.uint32)
        if t % PERIOD == 0:
            self.counts = self.counts >> 1 | 1
        self.share()


class _Writer:
    def __init__(self, lanes: int, room: int) -> None:
        self.low, self.range = np.zeros(lanes, dtype=np.uint64), np.full(lanes, _FULL)
        self.out, self.room = np.zeros(lanes * room, dtype=np.uint64), room
        self.next = np.arange(lanes, dtype=np.int64) * room

    def put(self, begin: np.ndarray, size: np.ndarray, bits: np.ndarray, begin2: np.ndarray, size2: np.ndarray) -> None:
        """Which order gives the id, and its part there, of a whole of so many bits. Both together need at most 29 bits."""
        share = self.range >> _MIX
        self.low += share * begin
        share *= size
        share >>= bits
        self.low += share * begin2
        self.range = share * size2
        small = np.flatnonzero(self.range < _LOW)
        low, at = self.low.take(small), self.next.take(small)
        self.out[at] = low >> _KEPT
        self.next[small] = at + 1
        self.low[small] = (low & _REST) << _WORD
        self.range[small] <<= _WORD

    def finish(self) -> list[bytes]:
        for _ in range(2):
            self.out[self.next] = self.low >> _KEPT
            self.low = (self.low & _REST) << _WORD
            self.next += 1
        n = self.next - np.arange(len(self.next)) * self.room
        words = self.out.reshape(len(n), self.room)[:, : n.max(initial=0)]
        while (carry := words >> _WORD).any():
            words = words & np.uint64(0xFFFFFFFF)
            words[:, :-1] += carry[:, 1:]
        return [row[:k].tobytes() for row, k in zip(words.astype("<u4"), n, strict=True)]


class _Reader:
    def __init__(self, blocks: list[bytes]) -> None:
        lanes = len(blocks)
        words = [np.frombuffer(b[: len(b) // 4 * 4], dtype="<u4") for b in blocks]
        width = max(map(len, words)) + 3
        grid = np.zeros((lanes, width), dtype=np.uint64)
        for row, w in zip(grid, words, strict=True):
            row[: len(w)] = w
        # What is left, of the range, to the place that the words name, of which one bit always waits.
        self.range = np.full(lanes, _FULL)
        self.left = grid[:, 0] << _KEPT | grid[:, 1] >> _TOP_BIT
        grid[:, :-1] = (grid[:, :-1] << _KEPT & _LOW) | grid[:, 1:] >> _TOP_BIT
        self.words, self.next = grid.reshape(-1), np.arange(lanes) * width + 1
        self.share = self.range >> _MIX

    def beyond(self, bound: np.ndarray) -> np.ndarray:
        """Whether the next number, of which order gives the id, is not below ``bound``."""
        return self.left >= self.share * bound

    def part(self, begin: np.ndarray, size: np.ndarray, bits: np.ndarray) -> np.ndarray:
        self.left -= self.share * begin
        self.share *= size
        self.share >>= bits
        return self.left // self.share

    def take(self, begin: np.ndarray, size: np.ndarray) -> None:
        self.left -= self.share * begin
        self.range = self.share * size
        small = self.range < _LOW
        bits = small.astype(np.uint64) << np.uint64(5)
        self.range <<= bits
        self.left <<= bits
        self.left |= self.words.take(self.next, mode="clip") * small  # damaged words may end early
        self.next += small
        self.share = self.range >> _MIX


def _encode(start: Start, ids: np.ndarray, parts: np.ndarray | None, dry: bool = False) -> list[bytes] | np.ndarray:
    """One stream per row of ``ids``; of a dry run, the counts of the mix it ends with. ``parts`` are the places of the ids in
    the start table's ``parts``, if known; the first id of a row is looked up."""
    lanes, length = ids.shape
    model, writer = _Model(start, lanes), _Writer(lanes, length + 4)
    before = np.zeros((2, lanes), dtype=np.int64)
    for t in range(0, length, SPAN):
        steps = np.concatenate([before, ids[:, t:t + SPAN].T])
        before2, before1, now, before = steps[:-2], steps[1:-1], steps[2:], steps[-2:]
        if parts is None:
            own = start.part_of(before1, now)
        else:
            own = parts[:, t:t + SPAN].T
            if not t:
                own = np.concatenate([start.part_of(before1[:1], now[:1]), own[1:]])
        mixed = _mixed(before2, before1)
        at, entry, row2, row1, both = model.look(mixed, start.look(mixed), start.state.take(before1))
        how = (entry >> 3 != now) * (1 + (own < 1 << 16))
        if not dry:
            both >>= how.astype(np.uint64) << np.uint64(4)
            begin = both & _FIELD_MASK
            size = (both >> _FIELD & _FIELD_MASK) - begin
            part = _pick(how == 0, _SURELY, start.parts.take(own))
            part, part_size, bits = part & _PART_MASK, part >> _PART & _PART_MASK, _SHIFTS.take(how)
            for k in range(len(now)):
                writer.put(begin[k], size[k], bits[k], part[k], part_size[k])
        model.learn(t + len(now), now, how, at, entry, row2, row1)
    return model.counts.reshape(3, lanes, -1) if dry else writer.finish()


def _decode(start: Start, slots: tuple[np.ndarray, np.ndarray], blocks: list[bytes], length: int = LENGTH) -> np.ndarray:
    lanes = len(blocks)
    model, reader, (part_at, slot) = _Model(start, lanes), _Reader(blocks), slots
    out = np.empty((length, lanes), dtype=np.int64)
    seen, how = np.empty((4, SPAN, lanes), dtype=np.int64), np.empty((SPAN, lanes), dtype=np.int64)
    before2 = before1 = np.zeros(lanes, dtype=np.int64)
    for t in range(length):
        k = t % SPAN
        mixed = _mixed(before2, before1)
        _, entry, _, _, both = model.look(mixed, start.look(mixed), start.state.take(before1), seen[:, k])
        other, plain = reader.beyond(both >> _FIELD & _FIELD_MASK), reader.beyond(both >> _FIELD2 & _FIELD_MASK)
        how[k] = other.view(np.int8) + plain.view(np.int8)
        both >>= how[k].view(np.uint64) << np.uint64(4)
        begin = both & _FIELD_MASK
        got = reader.part(begin, (both >> _FIELD & _FIELD_MASK) - begin, _SHIFTS.take(how[k], mode="clip"))
        part = start.parts.take(part_at.take(slot.take(before1) * ~plain + got.view(np.int64), mode="clip"))
        part = _pick(other, part, entry.view(np.uint64) << np.uint64(40) | _SURELY)
        reader.take(part & _PART_MASK, part >> _PART & _PART_MASK)
        before2, before1 = before1, (part >> _PART_ID).view(np.int64)
        out[t] = before1
        if k == SPAN - 1:
            model.learn(t + 1, out[t + 1 - SPAN:t + 1], how, *seen)
    return np.ascontiguousarray(out.astype("<u4").T)


def _blocks(start: Start, ids: np.ndarray, parts: np.ndarray | None, length: int = LENGTH) -> list[tuple[int, int, bytes]]:
    out = []
    # The last block is filled up with the commonest id, which is coded like others and dropped by the reader.
    common = start.known[np.argmax(start.share)] if len(ids) else 0
    for a in range(0, len(ids), length * LANES):
        part = ids[a:a + length * LANES].astype(np.int64)
        grid = np.full((-(-len(part) // length), length), common)
        grid.reshape(-1)[: len(part)] = part
        places = parts
        if parts is not None:
            places = grid.copy()
            places.reshape(-1)[: len(part)] = parts[a:a + length * LANES]
            if len(part) % length:  # places hold what follows the ids, and the filling follows others
                tail = len(part) % length
                places[-1, tail:] = start.part_of(np.append(grid[-1, tail - 1], grid[-1, tail:-1]), grid[-1, tail:])
        for k, coded in enumerate(_encode(start, grid, places)):
            own = part[k * length:(k + 1) * length]
            out.append((len(own), zlib.crc32(own.astype("<u4").tobytes()), coded))
    return out


def encode(ids: np.ndarray) -> tuple[bytes, list[tuple[int, int, bytes]]]:
    """The start table of a run of ids below 65536, and its blocks: number of ids, their crc32 as little-endian unsigned
    32-bit integers, and the coded bytes. No ids, no blocks."""
    start, parts = Start.with_parts(ids)
    return start.to_bytes(), _blocks(start, ids, parts)


def decode(table: bytes, blocks: list[tuple[int, int, bytes]]) -> np.ndarray:
    """The ids of any blocks of the run that ``table`` belongs to, in the order given. A block whose ids do not have its
    checksum raises ValueError, as does a table that does not."""
    out = [np.zeros(0, dtype="<u4")]
    start = Start.from_bytes(table)
    slots = start.slots() if blocks else None
    for a in range(0, len(blocks), LANES):
        some = blocks[a:a + LANES]
        for i, (ids, (n, crc, _)) in enumerate(zip(_decode(start, slots, [b for _, _, b in some]), some, strict=True), a):
            ids = ids[:n]
            if zlib.crc32(ids) != crc:
                raise ValueError(f"block {i} is damaged")
            out.append(ids)
    return np.concatenate(out)
