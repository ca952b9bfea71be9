"""Packing of documents into sequences of a fixed number of tokens.

Method: the linear grouping scheme.  Only the number of pieces of each length
matters for a plan, so it is made on the driver from a histogram of at most
`capacity` rows, whatever the input:

1. Large lengths in falling order are dealt into GROUPS groups of equal
   cardinality, and each is rounded up to the largest of its group.
2. For these few sizes the best mix of configurations (what one sequence
   holds) comes from the configuration linear programme, solved by column
   generation; whole parts of its solution are used.
3. Actual pieces take the places of rounded sizes, in falling order.
4. What is left of the large ones and then the small ones, in falling order,
   go by best fit to the sequence with the least room that still holds them.

The plan is a table of runs (length, first rank, sequences, pieces in each),
to which the pieces are joined by their rank among the pieces of their length.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from codequarry.llm.token_codes import crcs, with_end
from codequarry.llm.tokens import encoded
from codequarry.llm.workspace import Table

GROUPS = 400
#: Lengths up to this part of the capacity are small.
SMALL = 0.4


def configurations(sizes, demand, capacity):
    """[(number of sequences, count of each size in one)]: whole parts of an optimal fractional solution."""
    k = len(sizes)
    if not k:
        return []
    # sums of products and no matrix products: the driver need not start a pool of BLAS threads for these sizes
    alone = (capacity // sizes).astype(float)
    columns, inverse = np.diag(alone), np.diag(1 / alone)
    demand = np.array(demand, dtype=float)
    level = demand / alone
    most, room = capacity // int(sizes.min()), np.arange(capacity + 1)
    fits, rest = room >= sizes[:, None], np.maximum(room - sizes[:, None], 0)
    for _ in range(4 * k):
        price = inverse.sum(axis=0)
        # the configuration of greatest price: a knapsack with `most` items at most, one layer for each
        best, taken = np.zeros(capacity + 1), []
        for _ in range(most):
            value = np.where(fits, best[rest] + price[:, None], 0.0)
            taken.append(value.argmax(axis=0))
            best = value[taken[-1], room]
        # The price of the demand over that of the best bounds the optimum from below (Farley)
        if best[capacity] <= 1 + 1e-7 or level.sum() * best[capacity] <= (price * demand).sum() * (1 + 1e-4):
            break
        new, c = np.zeros(k), capacity
        for layer in reversed(taken):
            j = layer[c]
            if not fits[j, c] or price[j] <= 0:
                break
            new[j] += 1
            c -= sizes[j]
        move = (inverse * new).sum(axis=1)
        ratio = np.where(move > 1e-9, level / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        level = level - ratio[out] * move
        level[out] = ratio[out]
        columns[:, out] = new
        row = inverse[out] / move[out]
        inverse -= move[:, None] * row
        inverse[out] = row
    whole = np.floor(np.maximum(level, 0) + 1e-6).astype(int)
    return [(int(m), columns[:, j].round().astype(int)) for j, m in enumerate(whole) if m > 0]


def plan(histogram, capacity):
    """Rows (length, first_rank, n, each, first_sequence, offset) and the number of sequences.

    The pieces of `length` with ranks from first_rank to first_rank + n - 1 go,
    `each` to a sequence, to those from first_sequence on, one after another
    from `offset`.
    """
    left = {int(s): int(n) for s, n in histogram.items() if n > 0}
    rank = dict.fromkeys(left, 0)
    rows, total = [], 0
    room = [[] for _ in range(capacity + 1)]  # room -> [(first sequence, number)]

    def put(length, n, each, sequence, offset):
        rows.append((length, rank[length], n, each, sequence, offset))
        rank[length] += n
        left[length] -= n

    large = sorted((s for s in left if capacity * SMALL < s < capacity), reverse=True)
    count = sum(left[s] for s in large)
    groups = []  # [largest length, [[length, number], ...]]
    if count:
        edges, seen, g = [round(count * i / GROUPS) for i in range(1, GROUPS + 1)], 0, 0
        for s in large:
            n = left[s]
            while n:
                while g < GROUPS - 1 and seen >= edges[g]:
                    g += 1
                take = n if g == GROUPS - 1 else min(n, edges[g] - seen)
                if not groups or groups[-1][0] != s and groups[-1][2] != g:
                    groups.append([s, [], g])
                groups[-1][1].append([s, take])
                groups[-1][2] = g
                n, seen = n - take, seen + take
        # a length that fills several groups is one size
        merged = []
        for s, runs, _ in groups:
            if merged and merged[-1][0] == s:
                merged[-1][1] += runs
            else:
                merged.append([s, runs])
        groups = merged
    sizes = np.array([s for s, _ in groups], dtype=int)
    demand = [sum(n for _, n in runs) for _, runs in groups]
    for m, each in configurations(sizes, demand, capacity):
        # whole sequences only as far as there are pieces for them
        m = min([m, *(sum(n for _, n in groups[j][1]) // c for j, c in enumerate(each) if c)])
        if not m:
            continue
        spans = [(total, m, 0)]  # sequences, filled so far
        for j, c in enumerate(each):
            for _ in range(c):
                after = []
                for first, n, filled in spans:
                    while n:
                        run = groups[j][1][0]
                        take = min(n, run[1])
                        put(run[0], take, 1, first, filled)
                        after.append((first, take, filled + run[0]))
                        first, n, run[1] = first + take, n - take, run[1] - take
                        if not run[1]:
                            groups[j][1].pop(0)
                spans = after
        for first, n, filled in spans:
            room[capacity - filled].append((first, n))
        total += m
    for s in sorted(left, reverse=True):
        least = s
        while left[s]:
            while least <= capacity and not room[least]:
                least += 1
            if least > capacity:
                each = capacity // s
                need = -(-left[s] // each)
                room[capacity].append((total, need))
                total, least = total + need, capacity
            first, n = room[least].pop()
            each = least // s
            full = min(n, left[s] // each)
            if full:
                put(s, full * each, each, first, capacity - least)
                room[least - each * s].append((first, full))
                first, n = first + full, n - full
            if n and 0 < left[s] < each:
                some = left[s]
                put(s, some, some, first, capacity - least)
                room[least - some * s].append((first, 1))
                first, n = first + 1, n - 1
            if n:
                room[least].append((first, n))
    return rows, total


def pieces(docs, tokenizer, end_id, capacity, with_ids=False):
    """(doc_id, piece, start, length, ids_crc32[, ids], part, rank): rank counts the pieces of one length in one part."""

    def cut(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for lo, ids, sizes in encoded(batch.column(1), tokenizer):
                ids, sizes = with_end(ids, sizes, end_id)
                number = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), number)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                start = piece * capacity
                length = np.minimum(capacity, sizes[doc] - start)
                order = np.argsort(length, kind="stable")
                same = length[order]
                rank = np.empty(len(doc), dtype=np.int64)
                rank[order] = np.arange(len(doc)) - np.searchsorted(same, same) + seen[same]
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [batch.column(0).slice(lo, len(sizes)).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crcs(ids, length), pa.int64()), pa.array(np.full(len(doc), part, dtype=np.int32)), pa.array(rank)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.record_batch(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<int>" * with_ids)


def packed(docs, tokenizer, end_id=0, capacity=2048, with_ids=False):
    """Every piece of docs (doc_id, text) with its sequence_id and its offset there.

    Null text counts as empty, so it is a piece with the end id alone.  Only
    documents of more than `capacity` ids are cut.  Repeated rows and null
    doc_ids are documents of their own; other columns are ignored; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    table = Table(pieces(docs, tokenizer, end_id, capacity, with_ids)).df
    counts = table.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, _ = plan(histogram, capacity)
    runs = spark.createDataFrame(rows, "length long, first_rank long, n long, each long, first_sequence long, at long")
    # the plan's size depends on the capacity alone
    ranked = table.join(before, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    found = ranked.alias("p").join(F.broadcast(runs.alias("r")), F.expr("p.length = r.length and p.rank >= r.first_rank and p.rank < r.first_rank + r.n"))
    index = F.col("rank") - F.col("first_rank")
    return found.select("doc_id", "piece", "start", F.col("p.length").alias("length"), "ids_crc32", (F.col("first_sequence") + F.floor(index / F.col("each"))).alias("sequence_id"), (F.col("at") + index % F.col("each") * F.col("p.length")).alias("offset"), *["ids"] * with_ids)
