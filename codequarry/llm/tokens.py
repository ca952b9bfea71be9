"""Token ids of whole texts, equal to the tokenizers library's, through a cache of their parts.

The tokenizer drops white space before it cuts text into pieces, so a text's
ids are those of its parts between ASCII white space, one after another.  A
part made of simple letters and then ASCII punctuation is two parts, the first
in lower case, which the tokenizer makes it anyway.  Ids of parts of up to 16
bytes that were seen before come from a bounded table whose keys are those
bytes themselves; all others come from the library.
"""

import sys
import types

import numpy as np

from codequarry.llm.textkit import SPACE_WORDS, Eights, Words, blocks, lowered, mix, pieces

#: Parts a worker keeps at most (about 60 bytes each).  A part is kept when it is met a second time.
CACHE_PARTS = 450_000
_SLOTS = 1 << 20
#: Parts that the library is given at once.
AT_ONCE = 2000
#: Longest parts that are kept.
SHORT = 16
#: Bytes: 0 an ASCII letter, 1 punctuation that no contraction begins with, 2 the first byte of U+00C0 to U+00FF, 3 a second byte, 4 any other
_KIND = np.full(256, 4, dtype=np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 0
_KIND[[x for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in "'<|>"]] = 1
_KIND[0xC3] = 2
_KIND[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = 3


class Encoder:
    def __init__(self, path):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.mark = "<|endoftext|>"
        self.mark_id = self.library.token_to_id(self.mark)
        # a slot's part: its first eight bytes, its next eight, its size (0: none)
        self.one, self.two, self.long = np.zeros(_SLOTS, dtype=np.uint64), np.zeros(_SLOTS, dtype=np.uint64), np.zeros(_SLOTS, dtype=np.uint8)
        self.place = np.zeros(_SLOTS, dtype=np.int32)
        self.met = np.zeros(_SLOTS, dtype=bool)
        self.n, self.used = 0, 0
        self.start = np.zeros(1 << 16, dtype=np.int32)
        self.size = np.zeros(1 << 16, dtype=np.int32)
        self.pool = np.zeros(1 << 18, dtype=np.uint16 if self.library.get_vocab_size() < 1 << 16 else np.uint32)

    def _slot(self, one, two):
        return (mix(one ^ mix(two)) & np.uint64(_SLOTS - 1)).astype(np.int64)

    def _find(self, one, two, size):
        """Places of parts in the table, -1 for those it hasn't."""
        out = np.full(len(one), -1, dtype=np.int32)
        todo, slot = np.flatnonzero(size <= SHORT), self._slot(one, two)
        slot = slot[todo]
        while len(todo):
            same = (self.one[slot] == one[todo]) & (self.two[slot] == two[todo]) & (self.long[slot] == size[todo])
            out[todo[same]] = self.place[slot[same]]
            go = ~same & (self.long[slot] != 0)
            todo, slot = todo[go], (slot[go] + 1) & (_SLOTS - 1)
        return out

    def _insert(self, one, two, long, ids, sizes):
        """New parts with their ids one after another and how many ids each has."""
        n, used = self.n + len(one), self.used + len(ids)
        while n > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while used > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.start[self.n : n] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n : n] = sizes
        self.pool[self.used : used] = ids
        todo, slot = np.arange(len(one)), self._slot(one, two)
        while len(todo):
            free = self.long[slot] == 0
            # of parts that want one free slot the last has it
            self.place[slot[free]] = self.n + todo[free]
            won = free & (self.place[slot] == self.n + todo)
            mine, at = todo[won], slot[won]
            self.one[at], self.two[at], self.long[at] = one[mine], two[mine], long[mine]
            todo, slot = todo[~won], slot[~won]
            slot = np.where(self.long[slot] != 0, slot + 1, slot) & (_SLOTS - 1)
        self.n, self.used = n, used

    def _encode(self, parts):
        """The library's ids of parts, one after another, and how many each has."""
        ids, sizes = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.int64)]
        lo = 0
        while lo < len(parts):
            hi = lo
            while hi < len(parts) and hi < lo + AT_ONCE and b"<" not in parts[hi] and b">" not in parts[hi]:
                hi += 1
            if hi == lo:  # the part may hold the mark
                got = np.array(self.library.encode(parts[lo].decode(), add_special_tokens=False).ids, dtype=np.uint32)
                ids.append(got), sizes.append(np.array([len(got)]))
                hi += 1
            else:
                got = np.array(self.library.encode(self.mark.join([x.decode() for x in parts[lo:hi]]), add_special_tokens=False).ids, dtype=np.uint32)
                cut = np.flatnonzero(got == self.mark_id)
                ids.append(np.delete(got, cut)), sizes.append(np.diff(np.concatenate([[-1], cut, [len(got)]])) - 1)
            lo = hi
        return np.concatenate(ids), np.concatenate(sizes)

    def _parts(self, data, offsets):
        """Starts and ends of the parts of a block, its bytes in lower case, which parts are as they were, and the parts before each document."""
        w = Words(data, offsets, SPACE_WORDS)
        kind = _KIND[data]
        follows = np.zeros(len(data), dtype=bool)
        follows[1:] = kind[:-1] == 2
        odd = (kind == 4) | (follows != (kind == 3))
        if len(kind) and kind[-1] == 2:
            odd[-1] = True
        tail = kind == 1
        turn = np.zeros(len(data), dtype=bool)
        turn[1:] = tail[1:] & ~tail[:-1]
        back = np.zeros(len(data), dtype=bool)
        back[1:] = tail[:-1] & ~tail[1:]
        back[w.starts] = False
        turn[w.starts] = False
        wrong = np.append(0, np.cumsum((odd | back) & SPACE_WORDS[data], dtype=np.int32))
        simple = (wrong[w.ends] == wrong[w.starts]) & ~tail[w.starts]
        turns = np.append(0, np.cumsum(turn, dtype=np.int32))
        cut = simple & (turns[w.ends] > turns[w.starts])
        at = np.flatnonzero(turn)[turns[w.starts[cut]]]
        place = np.arange(len(w.starts)) + np.cumsum(cut) - cut  # of each word's first part
        n = len(w.starts) + len(at)
        starts, ends = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        starts[place], ends[place] = w.starts, w.ends
        starts[place[cut] + 1], ends[place[cut] + 1], ends[place[cut]] = at, w.ends[cut], at
        low = lowered(data)
        other = place[~simple]
        upper = np.append(0, np.cumsum(low != data, dtype=np.int32))
        other = other[upper[ends[other]] > upper[starts[other]]]
        first = np.append(place, n)[w.first]
        raw = np.zeros(n, dtype=bool)
        raw[other] = True
        return starts, ends, low, raw, first

    def block(self, data, offsets):
        """ids of all documents of a block (see textkit.blocks) and the number of ids of each."""
        starts, ends, low, raw, first = self._parts(data, offsets)
        long = ends - starts
        eights = Eights(low)
        one, two = eights.at(starts, long), eights.at(np.minimum(starts + 8, len(low)), np.maximum(long - 8, 0))
        eights, some = Eights(data), np.flatnonzero(raw)
        one[some] = eights.at(starts[some], long[some])
        two[some] = eights.at(np.minimum(starts[some] + 8, len(data)), np.maximum(long[some] - 8, 0))
        index = self._find(one, two, long).astype(np.int64)
        missing = np.flatnonzero(index < 0)
        start, size, pool = self.start, self.size, self.pool
        if len(missing):
            both, number, which, where = (low.tobytes(), data.tobytes()), {}, [], []
            for k, r, a, b in zip(missing.tolist(), raw[missing].tolist(), starts[missing].tolist(), ends[missing].tolist(), strict=True):
                i = number.setdefault(both[r][a:b], len(number))
                if i == len(where):
                    where.append(k)
                which.append(i)
            ids, sizes = self._encode(list(number))
            begin, where = np.cumsum(sizes) - sizes, np.array(where)
            short = long[where] <= SHORT
            spot = self._slot(one[where], two[where])
            keep = short & self.met[spot] if self.n < CACHE_PARTS else np.zeros(len(where), dtype=bool)
            self.met[spot[short]] = True
            start = np.concatenate([self.start[: self.n], self.used + begin])
            size = np.concatenate([self.size[: self.n], sizes])
            pool = np.concatenate([self.pool[: self.used], ids])
            index[missing] = self.n + np.array(which)
            if keep.any():
                self._insert(one[where[keep]], two[where[keep]], long[where[keep]], ids[np.repeat(keep, sizes)], sizes[keep])
        counts = size[index].astype(np.int64)
        stop = np.cumsum(counts)
        out = pool[np.repeat(start[index] - (stop - counts), counts) + np.arange(int(stop[-1]) if len(stop) else 0)].astype(np.uint32)
        return out, np.diff(np.append(0, stop)[first])

    def rows(self, data, offsets):
        """As block(), a very long text piece by piece."""
        cuts = pieces(data) if len(offsets) == 2 else [len(data)]
        if len(cuts) == 1:
            return self.block(data, offsets)
        runs = [self.block(data[a:b], np.array([0, b - a]))[0] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        return np.concatenate(runs), np.array([sum(map(len, runs))])


def encoder(path):
    """This Python worker's encoder, kept for its later tasks."""
    kept = sys.modules.setdefault("_codequarry_encoders", types.ModuleType("_codequarry_encoders"))
    if path not in kept.__dict__:
        kept.__dict__[path] = Encoder(path)
    return kept.__dict__[path]


def encoded(column, path):
    """(first row, ids, number of ids of each row) for runs of rows of a string column; null counts as empty."""
    e = encoder(path)
    for lo, data, off in blocks(column):
        yield lo, *e.rows(data, off)
