"""Words of documents that also stand in a benchmark.

Method: a prefix-filtered set join for full containment.  An item's windows of
`size` consecutive words (a shorter item is one window) must be contained whole,
so one shingle of each window is a sufficient prefix: its rarest one, by counts
over all documents, ties by hash.  A document's shingles are joined with these
prefix tokens; each hit gives the only place where the window could stand.
Bounds on length and place (the window must lie inside the document) drop hits,
and what remains is compared word by word (by 64-bit hashes under a key drawn
for each run).

The benchmark is a query set.  Its windows are taken in blocks of BLOCK_WINDOWS,
so that what is broadcast has a fixed size; every block reads all documents,
and one block is what benchmarks need.
"""


import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from codequarry.llm.textkit import ALNUM_WORDS, Kit, Words, blocks, draw, mix
from codequarry.llm.workspace import extended

SHINGLE = 3
BLOCK_WINDOWS = 500_000


def windows(items, size, key):
    """{length: (windows by word hashes, item number of each)} of (number, text) pairs, equal windows of an item once."""
    kit, out = Kit(key), {}
    for number, text in items:
        raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
        w = Words(raw, np.array([0, len(raw)]), ALNUM_WORDS, lower=True)
        h = kit.hashes(w)
        n = min(size, len(h))
        if n:
            rows = np.unique(np.lib.stride_tricks.sliding_window_view(h, n), axis=0)
            of = out.setdefault(n, ([], []))
            of[0].append(rows)
            of[1].append(np.full(len(rows), number))
    return {n: (np.concatenate(a), np.concatenate(b)) for n, (a, b) in out.items()}


def shingles(h, doc, size):
    """Hash of `size` words from each place on; places where they would leave the document get 0."""
    out = np.zeros(len(h), dtype=np.uint64)
    n = len(h) - size + 1
    if n > 0:
        with np.errstate(over="ignore"):
            total = np.full(n, np.uint64(size))
            for k in range(size):
                total = mix(total + h[k : k + n] * np.uint64(2 * k + 3))
        out[:n] = np.where(doc[:n] == doc[size - 1 :], total | np.uint64(1), 0)
    return out


def _shingle_rows(rows):
    """Shingles of each window: a matrix, a column for each place in the window."""
    n = min(SHINGLE, rows.shape[1])
    flat = shingles(rows.ravel(), np.repeat(np.arange(len(rows)), rows.shape[1]), n)
    return flat.reshape(rows.shape)[:, : rows.shape[1] - n + 1]


def counts(docs, known, key):
    """How often each of the sorted hashes `known` starts in docs (text), by shingle length (sum over all documents)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(known)

    def count(batches):
        kit = Kit(key)
        total = {n: np.zeros(len(x), dtype=np.int64) for n, x in sent.value.items()}
        for batch in batches:
            for _, data, off in blocks(batch.column(0)):
                w = Words(data, off, ALNUM_WORDS, lower=True)
                h = kit.hashes(w)
                for n, x in sent.value.items():
                    s = shingles(h, w.doc, n)
                    at = np.minimum(np.searchsorted(x, s), len(x) - 1)
                    total[n] += np.bincount(at[x[at] == s], minlength=len(x))
        for n, t in total.items():
            some = np.flatnonzero(t)
            yield pa.record_batch([pa.array(np.full(len(some), n, dtype=np.int32)), pa.array(some.astype(np.int32)), pa.array(t[some])], ["size", "k", "n"])

    out = {n: np.zeros(len(x), dtype=np.int64) for n, x in known.items()}
    for r in docs.select("text").mapInArrow(count, "size int, k int, n long").groupBy("size", "k").agg(F.sum("n").alias("n")).collect():
        out[r["size"]][r["k"]] = r["n"]
    return out


def prefixes(docs, some, key):
    """[(length, shingle length, sorted tokens, window of each token, offset in it, windows, items)] for each window length."""
    pools, made = {}, {}
    for n, (rows, _) in some.items():
        made[n] = _shingle_rows(rows)
        pools.setdefault(min(SHINGLE, n), []).append(made[n].ravel())
    known = {n: np.unique(np.concatenate(x)) for n, x in pools.items()}
    seen = counts(docs, known, key)
    out = []
    for n, (rows, numbers) in some.items():
        size = min(SHINGLE, n)
        often = seen[size][np.searchsorted(known[size], made[n])]
        rank = np.lexsort((made[n].ravel(), often.ravel())).argsort().reshape(often.shape)
        offset = rank.argmin(axis=1)
        token = made[n][np.arange(len(rows)), offset]
        order = np.argsort(token, kind="stable")
        # a window whose rarest shingle never occurs can't occur
        order = order[often[order, offset[order]] > 0]
        out.append((n, size, token[order], rows[order], offset[order], numbers[order]))
    return out


def _hits(w, h, prefix):
    """Hit words (booleans) and the pairs (document, item number) of a block."""
    cover = np.zeros(len(h) + 1, dtype=np.int64)
    pairs = [np.zeros((0, 2), dtype=np.int64)]
    made = {}
    for n, size, token, rows, offset, numbers in prefix:
        if not len(token):
            continue
        s = made.setdefault(size, None)
        if s is None:
            s = made[size] = shingles(h, w.doc, size)
        lo, hi = np.searchsorted(token, s), np.searchsorted(token, s, side="right")
        at = np.flatnonzero(hi > lo)
        # a few at a time: a frequent token can stand for many windows
        step = max(1, 2_000_000 // max(1, int((hi - lo)[at].max(initial=1))))
        for i in range(0, len(at), step):
            places = at[i : i + step]
            many = (hi - lo)[places]
            place = np.repeat(places, many)
            k = np.repeat(lo[places] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            start = place - offset[k]
            first, last = w.first[w.doc[place]], w.first[w.doc[place] + 1]
            fits = (start >= first) & (start + n <= last)
            start, k = start[fits], k[fits]
            for j in range(n):
                same = h[start + j] == rows[k, j]
                start, k = start[same], k[same]
            if len(start):
                np.add.at(cover, start, 1)
                np.add.at(cover, start + n, -1)
                pairs.append(np.unique(np.stack([w.doc[start], numbers[k]], axis=1), axis=0))
    return np.cumsum(cover[:-1]) > 0, np.unique(np.concatenate(pairs), axis=0)




def marked(docs, benchmark, size=13):
    """docs with n_words, n_hit, n_items, items (ids as text, sorted) and contaminated.

    A word is hit inside any occurrence of a window of the benchmark
    (item_id, text).  contaminated: n_hit > 0 and 20 * n_hit >= n_words.  Null
    or empty texts have no words; null or empty items no windows; items with
    null ids hit words but are not named.  Equal rows are judged alike, equal
    item ids named once; existing columns of these names are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "n_hit", "n_items", "items", "contaminated", "hit_words")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    parts, some, names, key = [], [], [], draw()

    def block(some, names):
        prefix = prefixes(docs, windows(enumerate(some), size, key), key)
        return spark.sparkContext.broadcast((prefix, names))

    n = 0
    for r in items.toLocalIterator():
        some.append(r["text"])
        names.append(r["item_id"])
        n += len(r["text"] or "") // 2 + 1  # words at most
        if n >= BLOCK_WINDOWS:
            parts.append(block(some, names))
            some, names, n = [], [], 0
    if some or not parts:
        parts.append(block(some, names))
    place = docs.columns.index("text")

    def judge(batches):
        kit = Kit(key)
        for batch in batches:
            for lo, data, off in blocks(batch.column(place)):
                w = Words(data, off, ALNUM_WORDS, lower=True)
                h = kit.hashes(w)
                hit, found = np.zeros(len(h), dtype=bool), [set() for _ in range(len(off) - 1)]
                for part in parts:
                    prefix, names = part.value
                    own, pairs = _hits(w, h, prefix)
                    hit |= own
                    for d, k in pairs.tolist():
                        if names[k] is not None:
                            found[d].add(names[k])
                total = np.append(0, np.cumsum(hit))
                n_hit = total[w.first[1:]] - total[w.first[:-1]]
                rows = batch.slice(lo, len(off) - 1)
                named = [sorted(x) for x in found]
                yield pa.record_batch([*rows.columns, pa.array(w.counts.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array([len(x) for x in named], pa.int64()), pa.array(named, pa.list_(pa.string()))], [*rows.schema.names, "n_words", "n_hit", "n_items", "items"])

    out = extended(docs, judge, "n_words long, n_hit long, n_items long, items array<string>")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digest(docs, benchmark, size=13):
    out = marked(docs.select("doc_id", "text"), benchmark, size)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
