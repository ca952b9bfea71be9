"""Vectorised word handling on Arrow string buffers.

All functions work on whole batches of documents at once: words are found with
a byte table and hashed eight bytes at a time, n-grams are hashed by doubling
(two halves make the hash of a window twice as long), so that no Python code
runs for a single word.  Every step of a hash goes through a bijection that is
not linear, and operators draw its key anew for each run, so texts can't be
written that collide.
"""

import hashlib
import secrets

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
#: Longer words are hashed one by one.
LONG_WORD = 512
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def mix(x):
    """splitmix64's finaliser: a bijection of 64-bit words."""
    x = np.array(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _stream(seed, n):
    with np.errstate(over="ignore"):
        return mix(_U(seed) + np.arange(1, n + 1, dtype=np.uint64) * _ODD)


def draw():
    """A key for the hashes of one run."""
    return secrets.randbits(64)


def table(separators):
    """256 booleans: True for bytes that belong to words."""
    t = np.ones(256, dtype=bool)
    t[list(separators)] = False
    return t


#: `[^\x20\x09-\x0D]+`
SPACE_WORDS = table([0x20, *range(0x09, 0x0E)])
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, for text whose A-Z are lower-cased
ALNUM_WORDS = table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def lowered(data):
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[data]


class Eights:
    """The eight bytes from any place of a block on, as a number."""

    def __init__(self, data):
        self.data = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
        self.view = np.ndarray((len(data) + 1,), "<u8", self.data, strides=(1,))

    def at(self, starts, sizes):
        """The first of `sizes` bytes from `starts` on, eight at most; the others count as 0."""
        return self.view[starts] & _MASK[np.minimum(sizes, 8)]


def hash_ranges(data, starts, ends, key=0):
    """64-bit hashes of data[start:end]; ranges of one size up to eight bytes never collide."""
    eights, size = Eights(data), ends - starts
    with np.errstate(over="ignore"):
        h = mix(_U(key) + size.astype(np.uint64) * _ODD)
    h = mix(h ^ eights.at(starts, size))
    live, done = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(live):
        h[live] = mix(h[live] ^ eights.at(starts[live] + done, size[live] - done))
        done += 8
        live = live[size[live] > done]
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        word = hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, key=key.to_bytes(8, "little")).digest()
        h[k] = int.from_bytes(word, "little")
    return h


def blocks(column, limit=None):
    """(first row, bytes, offsets) of runs of rows of about `limit` bytes; null counts as empty."""
    limit = limit or BLOCK_BYTES
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if chunk.null_count:
            chunk = pc.fill_null(chunk, "" if pa.types.is_string(chunk.type) or pa.types.is_large_string(chunk.type) else b"")
        if not len(chunk):
            continue
        wide = pa.types.is_large_string(chunk.type) or pa.types.is_large_binary(chunk.type)
        _, off, raw = chunk.buffers()
        off = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
        lo = 0
        while lo < len(chunk):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
            hi = min(hi, len(chunk))
            yield lo, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lo = hi


def pieces(data, limit=None):
    """Ends of pieces of one text of about `limit` bytes, each before a white space character; longer where there is none."""
    limit = limit or BLOCK_BYTES
    at, ends = 0, []
    while len(data) - at > limit:
        cut = None
        for lo in range(at + limit, len(data), limit):
            space = np.flatnonzero(~SPACE_WORDS[data[lo : lo + limit]])
            if len(space):
                cut = lo + int(space[0])
                break
        if cut is None:
            break
        ends.append(cut)
        at = cut
    return [*ends, len(data)]


class Words:
    """Words of a block: starts, ends, document of each, first word of each document."""

    def __init__(self, data, offsets, words, lower=False):
        self.data = lowered(data) if lower else data
        self.offsets = offsets
        n, docs = len(data), len(offsets) - 1
        inside = words[self.data]
        turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        rise = inside[turn]
        # a document's edge parts two words that touch
        edge = np.unique(offsets[(offsets > 0) & (offsets < n)])
        edge = edge[inside[edge] & inside[edge - 1]]
        first, last = [0] * (n > 0 and bool(inside[0])), [n] * (n > 0 and bool(inside[-1]))
        self.starts = np.concatenate([np.array(first, dtype=np.int64), turn[rise], edge])
        self.ends = np.concatenate([turn[~rise], np.array(last, dtype=np.int64), edge])
        if len(edge):
            self.starts.sort()
            self.ends.sort()
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(docs), self.counts)

    def hashes(self, key=0):
        return hash_ranges(self.data, self.starts, self.ends, key)


class Kit:
    """Hashes of words, windows and sets under one key."""

    def __init__(self, key=0):
        self.key = key

    def hashes(self, words):
        return words.hashes(self.key)

    def ranges(self, h, lo, hi):
        """Hash of h[lo:hi] for each pair of lo and hi; none is empty."""
        size = hi - lo
        least, most = (int(size.min()), int(size.max())) if len(size) else (1, 0)
        out, level, k = np.zeros(len(lo), dtype=np.uint64), h, 0
        with np.errstate(over="ignore"):
            while 1 << k <= most:
                if least < 2 << k:
                    some = slice(None) if 1 << k <= least and most < 2 << k else np.flatnonzero(size >> k == 1)
                    a, b = lo[some], hi[some]
                    out[some] = mix(mix(level[a] * _ODD + level[b - (1 << k)]) + size[some].astype(np.uint64))
                if 2 << k <= most:
                    level = mix(level[: len(level) - (1 << k)] * _U(0xD1342543DE82EF95) + level[1 << k :])
                k += 1
        return out

    def windows(self, words, h, size):
        """Starts (word indexes) of the windows of `size` words inside one document, and their hashes."""
        n = len(h)
        if n < size:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(words.doc[: n - size + 1] == words.doc[size - 1 :])
        return at, self.ranges(h, at, at + size)

    def shingle_sets(self, data, offsets, size=5):
        """Sorted distinct shingle hashes of each document: (hashes, offsets).

        A document of fewer words than `size` has its whole sequence as its one
        shingle, a document without words has none.
        """
        w = Words(data, offsets, SPACE_WORDS, lower=True)
        h = self.hashes(w)
        at, g = self.windows(w, h, size)
        doc = w.doc[at]
        short = np.flatnonzero((w.counts > 0) & (w.counts < size))
        if len(short):
            g = np.concatenate([g, self.ranges(h, w.first[short], w.first[short + 1])])
            doc = np.concatenate([doc, short])
            order = np.argsort(doc, kind="stable")
            g, doc = g[order], doc[order]
        ends = np.searchsorted(doc, np.arange(len(offsets))).tolist()
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            g[a:b].sort()
        new = np.ones(len(g), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
        g, doc = g[new], doc[new]
        return g, np.searchsorted(doc, np.arange(len(offsets)))


class Recent:
    """Which hashes were not met lately: a table of fixed size, so old ones may be new again."""

    def __init__(self, bits=17):
        self.kept = np.zeros((1 << bits, 2), dtype=np.uint64)

    def new(self, a, b=None):
        """Places of the values (or pairs of them) that are neither repeated among these nor remembered, rising."""
        both = np.stack([a, a if b is None else b], axis=1)
        order = np.lexsort((both[:, 1], both[:, 0]))
        first = np.ones(len(order), dtype=bool)
        first[1:] = (both[order[1:]] != both[order[:-1]]).any(axis=1)
        at = np.sort(order[first])
        slot = (mix(both[at, 0] ^ both[at, 1] * _ODD) & _U(len(self.kept) - 1)).astype(np.int64)
        met = (self.kept[slot] == both[at]).all(axis=1)
        self.kept[slot] = both[at]
        return at[~met]


def signed(x):
    """Unsigned 64-bit hashes as the longs that Spark has."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
