"""Removal of word windows that occur more than once in the corpus.

Method: suffix automata of reference shards.  The corpus is its own reference,
so it is first dealt into shards in which equal windows must meet:

1. Every window of ``length`` words has a minimiser, its smallest hash of
   ``ANCHOR`` consecutive words (leftmost on ties).  Equal windows have equal
   minimisers, so the minimiser's hash is the shard key of the window, and runs
   of neighbouring windows with one minimiser travel together.
2. A run whose content occurs twice is repeated as a whole.  Keys with one
   content need no more work.
3. For keys with several contents the distinct contents are the reference
   shard: its suffix automaton counts in how many places each substring ends,
   and streaming each content through it gives matching statistics, the longest
   suffix at each word that occurs elsewhere too.  A window is repeated where
   this reaches ``length``.  A key with more than ``SHARD_WORDS`` words of
   content is split by the hashes of its single windows, which keeps equal
   windows together.
4. Spans go back to the texts, are merged, and their words are removed.

Hashes of words have 64 bits under a key drawn for each run; contents are
compared word for word by these.
Texts are identified by two 64-bit hashes, so that null or repeated doc_ids
change nothing: each row is a document of its own.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from codequarry.llm.textkit import SPACE_WORDS, Kit, Recent, Words, blocks, draw, signed
from codequarry.llm.workspace import Table, bitmap, in_bitmap

ANCHOR = 8
SHARD_WORDS = 200_000
BITS = 26


def runs_of(words, h, kit, length):
    """Runs of windows with one minimiser: (key, first window, number of windows, content hash)."""
    none = np.zeros(0, dtype=np.int64)
    reach = length - ANCHOR + 1
    at, grams = kit.windows(words, h, min(ANCHOR, length))
    if len(at) < reach:
        return none.view(np.uint64), none, none, none.view(np.uint64)
    n = len(at) - reach + 1
    inside = np.flatnonzero(words.doc[at[:n]] == words.doc[at[reach - 1 :]])
    arg = np.lib.stride_tricks.sliding_window_view(grams, reach).argmin(axis=1)[inside] + inside
    first = at[inside]
    new = np.ones(len(inside), dtype=bool)
    new[1:] = (arg[1:] != arg[:-1]) | (first[1:] != first[:-1] + 1)
    s = np.flatnonzero(new)
    count = np.diff(np.append(s, len(inside)))
    start = first[s]
    return grams[arg[s]], start, count, kit.ranges(h, start, start + count + length - 1)


def matching(contents, length):
    """For each content, which of its windows of `length` words occur in another place of any content.

    One generalised suffix automaton of all contents; contents are lists of
    words, no two of them equal.
    """
    next_, link, size, hits = [{}], [-1], [0], [0]
    for words in contents:
        last = 0
        for c in words:
            to = next_[last].get(c)
            if to is not None and size[to] == size[last] + 1:
                last = to
                hits[last] += 1
                continue
            if to is not None:
                copy = len(next_)
                next_.append(dict(next_[to])), size.append(size[last] + 1), link.append(link[to]), hits.append(0)
                link[to] = copy
                p = last
                while p >= 0 and next_[p].get(c) == to:
                    next_[p][c] = copy
                    p = link[p]
                last = copy
                hits[last] += 1
                continue
            new = len(next_)
            next_.append({}), size.append(size[last] + 1), link.append(0), hits.append(1)
            p = last
            while p >= 0 and c not in next_[p]:
                next_[p][c] = new
                p = link[p]
            if p >= 0:
                q = next_[p][c]
                if size[q] == size[p] + 1:
                    link[new] = q
                else:
                    copy = len(next_)
                    next_.append(dict(next_[q])), size.append(size[p] + 1), link.append(link[q]), hits.append(0)
                    while p >= 0 and next_[p].get(c) == q:
                        next_[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
    for state in sorted(range(1, len(size)), key=size.__getitem__, reverse=True):
        hits[link[state]] += hits[state]
    hits[0] = 2
    out = []
    for words in contents:
        state, run, found = 0, 0, []
        for i, c in enumerate(words):
            state = next_[state][c]
            run += 1
            while hits[state] < 2:
                state = link[state]
                run = size[state]
            if run >= length:
                found.append(i - length + 1)
        out.append(found)
    return out


def ranges(found):
    """Rising integers as (first, count) runs."""
    out = []
    for x in found:
        if out and out[-1][0] + out[-1][1] == x:
            out[-1][1] += 1
        else:
            out.append([x, 1])
    return out


_SPANS = "array<struct<o:int,n:int>>"


def repeated_spans(docs, length):
    """(k1, k2, spans): the repeated windows of each text that has any, as (first word, number of windows)."""
    spark = docs.sparkSession
    texts, hash_key = docs.select("text", "k1", "k2"), draw()

    def keys(batches):
        kit = Kit(hash_key)
        for batch in batches:
            for _, data, off in blocks(batch.column(0)):
                w = Words(data, off, SPACE_WORDS)
                key, *_ = runs_of(w, kit.hashes(w), kit, length)
                yield pa.record_batch([signed(key)], ["h"])

    repeated = texts.select("text").mapInArrow(keys, "h long").groupBy("h").count().filter("count > 1")
    maybe = spark.sparkContext.broadcast(bitmap(repeated, "h", BITS))

    def places(batches):
        kit = Kit(hash_key)
        for batch in batches:
            k1, k2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for lo, data, off in blocks(batch.column(0)):
                w = Words(data, off, SPACE_WORDS)
                key, start, n, fp = runs_of(w, kit.hashes(w), kit, length)
                x = np.flatnonzero(in_bitmap(maybe.value, key))
                doc = w.doc[start[x]]
                yield pa.record_batch([signed(key[x]), signed(fp[x]), pa.array(k1[doc + lo]), pa.array(k2[doc + lo]), pa.array((start[x] - w.first[doc]).astype(np.int32)), pa.array(n[x].astype(np.int32))], ["h", "fp", "k1", "k2", "start", "n"])

    runs = Table(texts.mapInArrow(places, "h long, fp long, k1 long, k2 long, start int, n int"))
    counted = runs.df.groupBy("h", "fp").agg(F.count("*").alias("times"))
    kinds = counted.groupBy("h").agg(F.count("*").alias("kinds"), F.sum("times").alias("all")).filter("all > 1")
    known = Table(counted.join(kinds.drop("all"), "h"))
    contested = known.df.filter("kinds > 1")
    wanted = spark.sparkContext.broadcast(bitmap(contested, "h", BITS))

    def contents(batches):
        kit, seen = Kit(hash_key), Recent()
        for batch in batches:
            for _, data, off in blocks(batch.column(0)):
                w = Words(data, off, SPACE_WORDS)
                h = kit.hashes(w)
                key, start, n, fp = runs_of(w, h, kit, length)
                x = np.flatnonzero(in_bitmap(wanted.value, key))
                x = x[seen.new(key[x], fp[x])]  # copies that this task has met give nothing new
                sizes = n[x] + length - 1
                at = np.repeat(start[x] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), signed(h[at]))
                yield pa.record_batch([signed(key[x]), signed(fp[x]), lists], ["h", "fp", "words"])

    # one row for each content; the semi-join drops what only the bitmap let through
    found = texts.select("text").mapInArrow(contents, "h long, fp long, words array<long>")
    found = found.groupBy("h", "fp").agg(F.first("words").alias("words"))
    shards = Table(found.join(contested.select("h", "fp"), ["h", "fp"], "left_semi").withColumn("base", F.lit(0)))
    weight = shards.df.groupBy("h").agg(F.sum(F.size("words")).alias("weight"))
    large = weight.filter(F.col("weight") > SHARD_WORDS).select("h", "weight")
    total = shards.df.agg(F.sum(F.size("words"))).first()[0] or 0
    n_shards = int(total // SHARD_WORDS) + 1
    sized = shards.df.join(large, "h", "left")
    whole = sized.filter("weight is null").withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(n_shards)))
    split = (
        sized.filter("weight is not null")
        .withColumn("base", F.explode(F.sequence(F.lit(0), F.size("words") - length)))
        .withColumn("words", F.slice("words", F.col("base") + 1, length))
        .withColumn("shard", -1 - F.pmod(F.xxhash64("h", "words"), 1 + F.floor(F.col("weight") * 20 / SHARD_WORDS)) * 1000003 - F.pmod(F.xxhash64("h"), F.lit(1000003)))
    )

    def matched(table):
        h, fp, base = (table.column(c).to_numpy() for c in ("h", "fp", "base"))
        words = table.column("words").to_pylist()
        groups = {}
        for i, x in enumerate(h.tolist()):
            groups.setdefault(x, []).append(i)
        rows, spans = [], []
        for members in groups.values():
            distinct, place = {}, []
            for i in members:  # single windows can be equal, whole contents can't
                t = tuple(words[i])
                place.append(distinct.setdefault(t, [len(distinct), 0]))
                place[-1][1] += 1
            if len(members) < 2:
                continue
            hits = matching(list(distinct), length)
            for i, (k, times) in zip(members, place, strict=True):
                r = [[0, len(words[i]) - length + 1]] if times > 1 else ranges(hits[k])
                if r:
                    rows.append(i)
                    spans.append([{"o": int(base[i]) + a, "n": b} for a, b in r])
        return pa.table({"h": pa.array(h[rows]), "fp": pa.array(fp[rows]), "spans": pa.array(spans, pa.list_(pa.struct([("o", pa.int32()), ("n", pa.int32())])))})

    columns = ["h", "fp", "base", "words", "shard"]
    spans = whole.select(columns).unionByName(split.select(columns)).groupBy("shard").applyInArrow(lambda t: matched(t), f"h long, fp long, spans {_SPANS}")
    spans = spans.select("h", "fp", F.explode("spans").alias("s")).groupBy("h", "fp").agg(F.collect_list("s").alias("spans"))
    verdicts = Table(known.df.join(spans, ["h", "fp"], "left").filter("times > 1 or spans is not null"))
    hit = runs.df.join(verdicts.df, ["h", "fp"])  # of two tables: Spark can split a frequent run's places
    everything = F.array(F.struct(F.lit(0).alias("o"), F.col("n").alias("n")))
    hit = hit.select("k1", "k2", "start", F.explode(F.when(F.col("times") > 1, everything).otherwise(F.col("spans"))).alias("s"))
    hit = hit.select("k1", "k2", (F.col("start") + F.col("s.o")).alias("o"), F.col("s.n").alias("n")).distinct()
    out = Table(hit.groupBy("k1", "k2").agg(F.collect_list(F.struct("o", "n")).alias("spans")))
    for t in (runs, known, shards, verdicts):
        t.drop()
    return out.df


def _result(batches, length, names):
    """Rows of documents with their spans to rows with counts and what is kept."""
    for batch in batches:
        text = batch.column(names.index("text"))
        spans = batch.column(names.index("spans")) if "spans" in names else None
        for lo, data, off in blocks(text):
            w = Words(data, off, SPACE_WORDS)
            docs, n = len(off) - 1, len(w.starts)
            cover = np.zeros(n + 1, dtype=np.int64)
            if spans is not None:
                part = spans.slice(lo, docs)
                if part.null_count < docs:
                    flat = part.flatten()
                    doc = pa.compute.list_parent_indices(part).to_numpy()
                    a = flat.field("o").to_numpy() + w.first[doc]
                    np.add.at(cover, a, 1)
                    np.add.at(cover, a + flat.field("n").to_numpy() + length - 1, -1)
            gone = np.cumsum(cover[:-1]) > 0
            removed = np.add.reduceat(np.append(gone, False), np.minimum(w.first[:-1], n)) if n else np.zeros(docs, dtype=np.int64)
            removed = np.where(w.counts > 0, removed, 0)
            # what is kept, with a space for the byte after each kept word
            mark = np.zeros(len(data) + 2, dtype=np.int32)
            keep = np.flatnonzero(~gone)
            tail = np.minimum(w.ends[keep] + 1, off[w.doc[keep] + 1])
            np.add.at(mark, w.starts[keep], 1)
            np.add.at(mark, tail, -1)
            inside = np.cumsum(mark[: len(data)]) > 0
            bytes_ = data.copy()
            bytes_[w.ends[w.ends < len(data)]] = np.where(np.isin(w.ends[w.ends < len(data)], off), bytes_[w.ends[w.ends < len(data)]], 32)
            at = np.append(0, np.cumsum(inside))[off]
            left = bytes_[inside].tobytes()
            kept = [left[i:j].rstrip(b" ") for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield lo, docs, w.counts, removed, kept


def remove_repeats(docs, length=35):
    """Every row of `docs` (doc_id, text) with n_words, n_removed, kept_text and kept_sha256.

    A word is removed if a window of `length` consecutive words of its document
    covers it whose word sequence starts at any other place of the corpus, in
    the same document or another.  Windows are judged on the input.  Kept words
    are joined by one space.  Null text has no words; documents of fewer than
    `length` words are never changed; copies are each removed, since each occurs
    elsewhere; repeated rows are documents of their own; columns other than
    doc_id and text are ignored, an empty table gives an empty table.
    """
    return _removed(docs, length, ["kept_text", "kept_sha256"])


def _removed(docs, length, wanted):
    if length < ANCHOR:
        raise ValueError(f"windows have {ANCHOR} words at least")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(7), "text")})
    spans = repeated_spans(docs, length)
    touched = spark.sparkContext.broadcast(bitmap(spans, "k1", BITS))
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = {"kept_text": "string", "kept_sha256": "string"}
    schema = f"doc_id {kind}, n_words long, n_removed long, " + ", ".join(f"{c} {columns[c]}" for c in wanted)

    def rows(batches, names):
        batches = (b for b in batches if b.num_rows)
        for batch in batches:
            ids = batch.column(0)
            for lo, n, counts, removed, kept in _result([batch], length, names):
                made = {"kept_text": lambda kept=kept: pa.array([x.decode() for x in kept], pa.string()), "kept_sha256": lambda kept=kept: pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())}
                yield pa.record_batch([ids.slice(lo, n), pa.array(counts.astype(np.int64)), pa.array(removed.astype(np.int64)), *(made[c]() for c in wanted)], ["doc_id", "n_words", "n_removed", *wanted])

    def part(want):
        def select(batches):
            for b in batches:
                yield b.filter(pa.array(in_bitmap(touched.value, b.column(2).to_numpy().view(np.uint64)) == want))

        return select

    plain, hit = part(False), part(True)
    clean = docs.mapInArrow(lambda b: rows(plain(b), ["doc_id", "text"]), schema)
    dirty = docs.mapInArrow(hit, docs.schema).join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return clean.unionByName(dirty.mapInArrow(lambda b: rows(b, ["doc_id", "text", "spans"]), schema))


def digest(docs, length=35):
    """As remove_repeats, without the texts."""
    return _removed(docs, length, ["kept_sha256"])
