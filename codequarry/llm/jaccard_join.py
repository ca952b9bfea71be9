"""Documents whose sets of word shingles are alike, and the groups they form.

Method: an exact join in the metric space of the Jaccard distance.

1. Documents with equal sets are one class; a class has a 128-bit signature.
2. Two classes can only reach the threshold if they share tokens of their
   prefixes: of the `n - ceil(t * n) + e(n)` rarest shingles of a set of n at
   least the lesser of their two e.  Rarity is the number of occurrences, over
   all documents, of the shingle's bucket (a histogram of fixed size), which
   keeps frequent passages out of prefixes.  Documents too few of whose tokens
   occur again have no partner.
3. Each shared token is a region with a pivot, the class of the smallest
   signature that has the token; regions with one pivot are one region.  All
   members are compared with the pivot only, so a group of n near copies costs n
   comparisons: first each class with the least of its pivots.  Links make
   members one component.  Only documents that share enough tokens with other
   components go on, in the regions of these tokens.
4. There members of different components are joined recursively with new pivots; distances to pivots d(x, p) give windows: members whose
   distances differ by more than 1 - t can't be linked (triangle inequality).
   Members of one component are not compared any more, as they are connected.
5. A region of more than BLOCK_SHINGLES is dealt into blocks, to each of which
   its pivot goes.  What its pivot leaves open (members that aren't linked to
   it, and those linked ones that lie in reach of them, the boundary) is joined
   again, block by block.
6. Links become groups by alternating stars.

Every comparison counts the intersection of whole sets.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from codequarry.llm.graph import components
from codequarry.llm.textkit import Kit, Recent, blocks, draw, mix, signed
from codequarry.llm.workspace import Table, bitmap, fresh, in_bitmap, quoted

HISTOGRAM = 1 << 14
BITS = 27
#: Percent of a set by which prefixes are longer than they must be.  Partners then share more than one token of them.
EXTRA = 10
BLOCK_SHINGLES = 1_000_000
BATCH_SHINGLES = 1_000_000
_FAR = 1 << 62


def _sums(values, offsets):
    with np.errstate(over="ignore"):
        total = np.append(np.uint64(0), np.cumsum(values, dtype=np.uint64))
        return total[offsets[1:]] - total[offsets[:-1]]


def signatures(g, offsets):
    """Two 64-bit hashes of each set."""
    n = np.diff(offsets).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mix(_sums(mix(g ^ np.uint64(0x5851F42D4C957F2D)), offsets) + n), mix(_sums(mix(g ^ np.uint64(0x14057B7EF767814F)), offsets) - n)


def place(g):
    return (g >> np.uint64(50)).astype(np.int64)


def extra(n):
    """Tokens of a prefix beyond the necessary ones."""
    return np.maximum(1, n * EXTRA // 100)


def prefix_rows(g, offsets, often, percent):
    """(shingle, document) of the prefixes of sets, and how many tokens each document must share to have a partner."""
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((g, often[place(g)], doc))
    rank = np.arange(len(g)) - np.repeat(offsets[:-1], n)
    need = -(-percent * n // 100)
    keep = rank < (n - need + extra(n))[doc]
    return g[order][keep], doc[keep], extra(need)


def linked(inter, n, m, percent):
    return 100 * inter >= percent * (n + m - inter)


def resolve(sets, label, known, percent):
    """Links between members of different labels, so that all that should be connected is: [(i, j)].

    known: distances to a pivot, not a number where there is none.  label is
    changed.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    offsets = np.append(0, np.cumsum(size))
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    flags = np.zeros(int(ids.max()) + 1, dtype=bool)
    reach, found = 1 - percent / 100 + 1e-9, []
    distances = [] if known is None else [known]
    active = np.ones(m, dtype=bool)
    for x in range(m):
        active[x] = False
        if not active.any():
            break
        can = active & (label != label[x]) & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x]))
        for d in distances[-8:]:
            can &= ~(np.abs(d - d[x]) > reach)
        y = np.flatnonzero(can)
        if not len(y):
            if (label[active] == label[x]).all():
                break
            continue
        flags[ids[offsets[x] : offsets[x + 1]]] = True
        at = np.repeat(offsets[y] - (np.cumsum(size[y]) - size[y]), size[y]) + np.arange(size[y].sum())
        inter = np.add.reduceat(flags[ids[at]].astype(np.int64), np.cumsum(size[y]) - size[y])
        flags[ids[offsets[x] : offsets[x + 1]]] = False
        d = np.full(m, np.nan)
        d[y], d[x] = 1 - inter / (size[y] + size[x] - inter), 0
        distances.append(d)
        for j in y[linked(inter, size[y], size[x], percent)].tolist():
            if label[j] != label[x]:
                found.append((x, j))
                label[label == label[j]] = label[x]
    return found


def _sets(texts, key):
    kit, out = Kit(key), []
    for _, data, off in blocks(texts):
        g, offsets = kit.shingle_sets(data, off)
        out += [g[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return out


def _regions(table, percent, key):
    """Rows (p, salt, salts, a, rep, text, label, d, part) of regions or blocks of them to links and, of blocks, distances to the pivot.

    part: -2 to compare with the pivot alone, -1 for a region, else a pair of
    blocks of what a pivot has left open.
    """
    codes = table.column("text").combine_chunks()
    codes = codes if isinstance(codes, pa.DictionaryArray) else codes.dictionary_encode()
    codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
    sets, which = _sets(codes.dictionary, key), codes.indices.to_numpy()
    p, salt, salts, a, rep, label, part = (table.column(c).to_numpy() for c in ("p", "salt", "salts", "a", "rep", "label", "part"))
    d = table.column("d").to_numpy(zero_copy_only=False).astype(float)
    order = np.lexsort((rep, a != p, part, salt, p))
    cut = np.flatnonzero(np.append(True, np.any(np.stack([x[order][1:] != x[order][:-1] for x in (p, salt, part)]), axis=0)))
    u, v, open_ = [], [], ([], [], [], [])
    for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
        rows = order[lo:hi]
        own = [sets[k] for k in which[rows].tolist()]
        if part[rows[0]] >= 0:
            found = resolve(own, np.unique(label[rows], return_inverse=True)[1], d[rows], percent)
        elif part[rows[0]] == -1 and salts[rows[0]] == 1:
            found = resolve(own, np.unique(label[rows], return_inverse=True)[1], None, percent)
        else:
            found, pivot = [], own[0]  # the pivot's row comes first
            for k in range(1, len(rows)):
                if a[rows[k]] == p[rows[k]]:
                    continue
                inter = int((pivot[np.minimum(np.searchsorted(pivot, own[k]), len(pivot) - 1)] == own[k]).sum())
                near = linked(inter, len(pivot), len(own[k]), percent)
                if near:
                    found.append((0, k))
                if part[rows[0]] == -1:
                    for to, x in zip(open_, (p[rows[k]], a[rows[k]], 1 - inter / (len(pivot) + len(own[k]) - inter), label[rows[0 if near else k]]), strict=True):
                        to.append(x)
        u += [int(rep[rows[i]]) for i, _ in found]
        v += [int(rep[rows[j]]) for _, j in found]
    n, m = len(u), len(open_[0])
    none = [None] * n
    return pa.table({"u": pa.array(u + [None] * m, pa.int64()), "v": pa.array(v + [None] * m, pa.int64()), "p": pa.array(none + open_[0], pa.int64()), "a": pa.array(none + open_[1], pa.int64()), "d": pa.array(none + open_[2], pa.float64()), "label": pa.array(none + open_[3], pa.int64())})


_OUT = "u long, v long, p long, a long, d double, label long"


def _joined(rows, contents, percent, key):
    """Links and open distances of rows (p, salt, salts, a, label, d, part), whose texts are in contents (a, rep, n, text)."""
    total = rows.join(contents.select("a", "n"), "a").agg(F.sum("n")).first()[0] or 0
    batches = int(total // BATCH_SHINGLES) + 1
    rows = rows.join(contents, "a").withColumn("batch", F.pmod(F.xxhash64("p", "salt", "part"), F.lit(batches)))
    return rows.groupBy("batch").applyInArrow(lambda t: _regions(t, percent, key), _OUT)


def _dealt(members, sizes, part):
    """Rows for _joined from members (p, a, label), the pivots among them: large regions in blocks, to each of which the pivot goes."""
    weights = members.join(sizes, "a").groupBy("p").agg((F.floor(F.sum("n") / BLOCK_SHINGLES) + 1).alias("salts"))
    salt = F.when(F.col("a") == F.col("p"), F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("a"), F.col("salts"))))
    return members.join(weights, "p").withColumn("salt", F.explode(salt)).withColumns({"d": F.lit(None).cast("double"), "part": F.lit(part).cast("long")})


def groups(docs, percent=75):
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text).

    Sets are the distinct shingles of five words of the lower-cased (A-Z) text;
    a text of fewer words is one shingle.  Two documents link when their
    Jaccard similarity is `percent` / 100 or more; component_id is the smallest
    doc_id that links reach.  Texts without words and null texts have no
    shingles and link with nothing, not even with each other: their
    component_id is their own doc_id.  Rows with a null doc_id take part, but
    name no component: theirs is null if no other row is in it.  Repeated rows
    link like copies; other columns are ignored; an empty table stays empty.
    """
    spark = docs.sparkSession
    docs, key = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), draw()

    def sign(batches):
        kit, often = Kit(key), np.zeros(HISTOGRAM, dtype=np.int64)
        names = ["doc_id", "n", "a", "b", "place"]
        for batch in batches:
            for lo, data, off in blocks(batch.column(1)):
                g, offsets = kit.shingle_sets(data, off)
                often += np.bincount(place(g), minlength=HISTOGRAM)
                a, b = signatures(g, offsets)
                n = len(off) - 1
                yield pa.record_batch([batch.column(0).slice(lo, n), pa.array(np.diff(offsets)), signed(a), signed(b), pa.nulls(n, pa.int32())], names)
        some = np.flatnonzero(often)
        none = pa.nulls(len(some), pa.int64())
        yield pa.record_batch([none, pa.array(often[some]), none, none, pa.array(some.astype(np.int32))], names)

    signed_ = Table(docs.mapInArrow(sign, "doc_id long, n long, a long, b long, place int"))
    rows = signed_.df.filter("place is null")
    often = np.zeros(HISTOGRAM, dtype=np.int64)
    for r in signed_.df.filter("place is not null").groupBy("place").agg(F.sum("n").alias("n")).collect():
        often[r["place"]] = r["n"]
    often = spark.sparkContext.broadcast(often)
    unnamed = F.col("a").bitwiseAND(F.lit(_FAR - 1)) + F.lit(_FAR)
    classes = rows.filter("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")).withColumn("rep", F.coalesce("rep", unnamed))

    def prefixes(shared=None):
        def emit(batches):
            kit, seen = Kit(key), Recent()
            for batch in batches:
                for _, data, off in blocks(batch.column(0)):
                    g, offsets = kit.shingle_sets(data, off)
                    a, _ = signatures(g, offsets)
                    h, doc, least = prefix_rows(g, offsets, often.value, percent)
                    # copies that this task has met give nothing new
                    new = np.zeros(len(a), dtype=bool)
                    new[seen.new(a)] = True
                    if shared is None:
                        yield pa.record_batch([signed(h[new[doc]])], ["h"])
                        continue
                    some = in_bitmap(shared.value, h)
                    many = np.bincount(doc[some], minlength=len(new))
                    new &= (many >= least) & (many > 0)
                    keep = some & new[doc]
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many[new])).astype(np.int32)), signed(h[keep]))
                    yield pa.record_batch([signed(a[new]), pa.array(least[new].astype(np.int64)), lists], ["a", "least", "tokens"])

        return docs.select("text").mapInArrow(emit, "h long" if shared is None else "a long, least long, tokens array<long>")

    shared = bitmap(prefixes().groupBy("h").count().filter("count > 1"), "h", BITS)
    candidates = Table(prefixes(spark.sparkContext.broadcast(shared)).groupBy("a").agg(F.first("least").alias("least"), F.first("tokens").alias("tokens")))
    tokens = candidates.df.select(F.explode("tokens").alias("h"), "a")
    pivots = tokens.groupBy("h").agg(F.min("a").alias("p"), F.max("a").alias("q")).filter("p < q").select("h", "p")
    nearest = Table(tokens.join(pivots, "h").groupBy("a").agg(F.min("p").alias("p")).select("p", "a"))
    ids = nearest.df.select("a")
    wanted = spark.sparkContext.broadcast(bitmap(ids, "a", BITS))

    def texts(batches):
        kit, seen = Kit(key), Recent()
        for batch in batches:
            for lo, data, off in blocks(batch.column(0)):
                g, offsets = kit.shingle_sets(data, off)
                a, b = signatures(g, offsets)
                x = np.flatnonzero(in_bitmap(wanted.value, a) & (np.diff(offsets) > 0))
                x = x[seen.new(a[x], b[x])]
                yield pa.record_batch([signed(a[x]), signed(b[x]), pc.take(batch.column(0).slice(lo, len(off) - 1), pa.array(x))], ["a", "b", "text"])

    found = docs.select("text").mapInArrow(texts, "a long, b long, text string").groupBy("a", "b").agg(F.first("text").alias("text"))
    contents = Table(found.join(classes, ["a", "b"]).select("a", "rep", "n", "text"))
    sizes = contents.df.groupBy("a").agg(F.max("n").alias("n"))
    own = F.col("p").alias("a")
    # first each candidate with the least of its pivots: near copies become components
    once = nearest.df.filter("p < a")
    once = once.union(once.select("p", own).distinct()).withColumn("label", F.lit(0).cast("long"))
    first = Table(_joined(_dealt(once, sizes, -2), contents.df, percent, key).select("u", "v"))
    known = components(first.df)
    # then those that share enough tokens with other components, in the regions of these tokens
    labels = contents.df.select("a", "rep").join(known.withColumnRenamed("node", "rep"), "rep", "left").groupBy("a").agg(F.min(F.coalesce("component", "rep")).alias("label"))
    labelled = candidates.df.join(labels, "a").select(F.explode("tokens").alias("h"), "a", "least", "label")
    mixed = labelled.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("h")
    across = Table(labelled.join(mixed, "h"))
    enough = across.df.groupBy("a").agg(F.count("*").alias("n"), F.first("least").alias("least")).filter("n >= least").select("a")
    left = across.df.join(enough, "a", "left_semi").select("h", "a", "label")
    pivots = left.groupBy("h").agg(F.min(F.struct("a", "label")).alias("p"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y")
    members = left.join(pivots.select("h", "p"), "h").select(F.col("p.a").alias("p"), "a", "label", F.col("p.label").alias("own")).distinct()
    everyone = Table(members.select("p", "a", "label").union(members.select("p", own, F.col("own").alias("label"))).distinct())
    second = Table(_joined(_dealt(everyone.df, sizes, -1), contents.df, percent, key))
    open_ = second.df.filter("p is not null").select("p", "a", "d", "label")
    pivots = everyone.df.filter("a = p").select("p", F.col("label").alias("own"))
    far = open_.join(pivots, "p").filter("label <> own").groupBy("p").agg(F.min("d").alias("least"))
    left = open_.join(far, "p").filter(F.col("d") >= F.col("least") - (1 - percent / 100) - 1e-9)
    weight = left.join(sizes, "a").groupBy("p").agg((F.floor(F.sum("n") / BLOCK_SHINGLES) + 1).alias("k"))
    left = left.join(weight, "p").withColumn("block", F.pmod(F.xxhash64("a"), F.col("k")))
    # each pair of blocks meets once: part = smaller * k + larger
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))
    left = left.withColumn("other", other).withColumn("part", F.least("block", "other") * F.col("k") + F.greatest("block", "other"))
    again = left.select("p", F.lit(0).cast("long").alias("salt"), F.lit(1).cast("long").alias("salts"), "a", "label", "d", "part")
    more = _joined(again, contents.df, percent, key).select("u", "v")
    links = first.df.unionByName(second.df.filter("u is not null").select("u", "v"))
    grouped = components(links.unionByName(more))
    for t in (candidates, nearest, contents, first, across, everyone, second):
        t.drop()
    named = classes.join(grouped.withColumnRenamed("node", "rep"), "rep", "left").select("a", "b", F.coalesce("component", "rep").alias("component_id"))
    named = named.withColumn("component_id", F.when(F.col("component_id") < _FAR, F.col("component_id")))
    out = rows.join(named, ["a", "b"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def distinct_documents(docs, percent=75):
    """The rows of docs that stay when one document of each group does: that of the smallest doc_id.

    Rows without shingles stay, as do rows that no doc_id names; of repeated
    rows with one doc_id and text one stays.  Rows of one doc_id with different
    texts are different documents.  Columns are those of docs.
    """
    key = fresh(docs, "key")
    # a hash of the text stands for the row: doc_id may not tell texts apart
    keyed = docs.withColumn(key, F.xxhash64("text").bitwiseAND(F.lit(_FAR - 1)))
    found = groups(keyed.select(F.col(key).alias("doc_id"), "text"), percent).filter("n_shingles > 0")
    found = found.groupBy(F.col("doc_id").alias(key)).agg(F.min("component_id").alias("component_id"))
    named = keyed.filter("doc_id is not null")
    wordless = ~F.coalesce(F.col("text").rlike("[^ \\t-\\r]"), F.lit(False))
    order = F.struct(F.col("doc_id").cast("long").alias("least"), "doc_id", key)
    least = named.filter(~wordless).groupBy(key).agg(F.min(order).alias("row"))
    least = least.join(found, key).groupBy("component_id").agg(F.min("row").alias("row")).select("row.doc_id", f"row.{key}")
    stay = least.union(named.filter(wordless).select("doc_id", key).distinct())
    one = named.dropDuplicates(["doc_id", key]).join(stay, ["doc_id", key], "left_semi")
    return one.unionByName(keyed.filter("doc_id is null")).select(quoted(docs.columns))
