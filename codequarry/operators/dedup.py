"""Near-duplicate detection by shared n-grams of tokens."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from codequarry.functions.lines import let
from codequarry.functions.text import tokenize
from codequarry.operators.state import cut


def fingerprint(c, n=4):
    """Distinct n-grams of tokens, joined by |; the distinct tokens of a text that has fewer than n."""
    def made(t):
        starts = F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1)))
        return F.array_distinct(F.when(F.size(t) < n, t).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), "|"))))

    return let(tokenize(c), made)


def hashed_print(c, n=4):
    """As fingerprint, each n-gram as a 64-bit hash."""
    def made(t):
        starts = F.sequence(F.lit(0), F.greatest(F.size(t) - n, F.lit(0)))
        return F.array_sort(F.array_distinct(F.when(F.size(t) < n, F.transform(t, lambda x: F.xxhash64(x))).otherwise(F.transform(starts, lambda i: F.xxhash64(*(F.get(t, i + k) for k in range(n)))))))

    return let(tokenize(c), made)


def fingerprints(df, key, text, n=4):
    return df.select(F.col(key).alias("id"), fingerprint(F.coalesce(F.col(text), F.lit("")), n).alias("grams")).withColumn("size", F.size("grams"))


def classes(df, key, text, n=4):
    """(id, print): each row's class of equal prints, and (print, grams, size), one row a class.  Rows without tokens are in none."""
    rows = df.select(F.col(key).alias("id"), hashed_print(F.coalesce(F.col(text), F.lit("")), n).alias("grams")).filter(F.size("grams") > 0)
    rows = cut(rows.withColumn("print", F.concat(F.hex(F.xxhash64("grams")), F.hex(F.xxhash64(F.lit(1), "grams")))))
    return rows.select("id", "print"), rows.groupBy("print").agg(F.first("grams").alias("grams")).withColumn("size", F.size("grams"))


#: Buckets of the histogram by which grams count as rare: a table of fixed size.
BUCKETS = 1 << 15


#: Sets of one leader that are compared in one place, and rows of a table that is sent to all tasks.
BLOCK = 64
BROADCAST_ROWS = 300_000


def _rarest(often, percent):
    """The rarest grams of a row, as many as two sets over the threshold must share one of."""
    ranked = F.array_sort(F.transform("grams", lambda g: F.struct(F.get(often, F.pmod(g, F.lit(BUCKETS)).cast("int")).alias("often"), g.alias("g"))))
    need = F.ceil(F.lit(percent) * F.col("size") / 100).cast("int")
    return F.transform(F.slice(ranked, F.lit(1), F.col("size") - need + 1), lambda x: x["g"])


def prefixes(prints, often, percent):
    """(print, size, gram): the rarest grams of each print."""
    return prints.select("print", "size", F.explode(_rarest(often, percent)).alias("gram"))


def similar_classes(left, right=None, percent=80):
    """(a, b, similarity) of prints of one table, a < b, or of two, with a Jaccard similarity of percent / 100 or more.

    Candidates share a rare gram and have sizes in reach; each is then compared
    as a whole.  Equal prints of one table are one class, so a group of copies
    costs one comparison.
    """
    both = left if right is None else left.unionByName(right)
    counts = both.select(F.explode("grams").alias("gram")).groupBy(F.pmod("gram", F.lit(BUCKETS)).alias("k")).agg(F.count("*").alias("n"))
    table = {r["k"]: r["n"] for r in counts.collect()}  # BUCKETS rows at most
    often = F.split(F.lit(",".join(str(table.get(k, 0)) for k in range(BUCKETS))), ",").cast("array<long>")
    a, b = prefixes(left, often, percent).alias("a"), prefixes(left if right is None else right, often, percent).alias("b")
    on = (F.col("a.gram") == F.col("b.gram")) & (100 * F.least("a.size", "b.size") >= percent * F.greatest("a.size", "b.size"))
    on = on & (F.col("a.print") < F.col("b.print")) if right is None else on
    candidates = a.join(b, on).select(F.col("a.print").alias("a"), F.col("b.print").alias("b")).distinct()
    x = left.select(F.col("print").alias("a"), F.col("grams").alias("ga"))
    y = (left if right is None else right).select(F.col("print").alias("b"), F.col("grams").alias("gb"))
    whole = candidates.join(x, "a").join(y, "b").withColumn("both", F.size(F.array_intersect("ga", "gb")))
    union = F.size("ga") + F.size("gb") - F.col("both")
    return whole.filter(100 * F.col("both") >= percent * union).select("a", "b", (F.col("both") / union).alias("similarity"))


def near_classes(df, key, text, n=4, percent=80):
    """(id, c) of all rows with tokens, (c, first id, copies) and (a, b, similarity) of similar classes.

    Grams are made from the text whenever they are needed and never kept for all
    rows, as they take several times the room of the text.  Kept are the prints,
    the prefixes, and the whole sets of what has a candidate.
    """
    # out of a generator, as a filter that is pushed below a plain column would make the grams once more
    made = F.explode(F.array(hashed_print(F.coalesce(F.col(text), F.lit("")), n))).alias("grams")
    texts = df.select(F.col(key).alias("id"), made).filter(F.size("grams") > 0)
    name = F.unhex(F.concat(F.lpad(F.hex(F.xxhash64("grams")), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), "grams")), 16, "0")))
    texts = texts.withColumn("print", name).withColumn("size", F.size("grams"))
    schema = StructType([texts.schema["id"], texts.schema["print"], StructField("counts", ArrayType(LongType()))])
    schema["id"].nullable = schema["print"].nullable = True

    def counted(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            grams = b.column("grams").flatten().to_numpy(zero_copy_only=False)
            total += np.bincount(np.mod(grams, BUCKETS), minlength=BUCKETS)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("print"), pa.nulls(b.num_rows, pa.list_(pa.int64()))], ["id", "print", "counts"])
        last = [pa.nulls(1, b.column("id").type), pa.nulls(1, b.column("print").type)] if total.any() else None
        if last:
            yield pa.RecordBatch.from_arrays([*last, pa.array([total.tolist()], pa.list_(pa.int64()))], ["id", "print", "counts"])

    known = cut(texts.select("id", "print", "grams").mapInArrow(counted, schema))
    every = known.filter("counts is not null").select(F.posexplode("counts").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n"))
    table = {r["k"]: r["n"] for r in every.collect()}  # BUCKETS rows at most
    often = F.split(F.lit(",".join(str(table.get(k, 0)) for k in range(BUCKETS))), ",").cast("array<long>")
    rare = texts.select("id", "print", "size", _rarest(often, percent).alias("grams"))
    one = rare.groupBy("print").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("grams").alias("grams"))
    classes = cut(one.withColumn("c", F.monotonically_increasing_id()))
    rows = known.filter("counts is null").join(classes.select("print", "c"), "print").select("id", "c")

    # of two sets the smaller one needs the shorter prefix, and common grams leave room for the overlap by their places
    each = classes.select("c", "size", F.posexplode("grams").alias("i", "gram"))
    shorter = each.filter(F.col("i") <= F.col("size") - F.ceil(F.lit(2 * percent) * F.col("size") / (100 + percent)))
    a, b = shorter.alias("a"), each.alias("b")
    on = (F.col("a.gram") == F.col("b.gram")) & ((F.col("a.size") < F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.c") < F.col("b.c"))))
    on = on & (100 * F.col("a.size") >= percent * F.col("b.size"))
    most = F.least("a.i", "b.i") + F.least(F.col("a.size") - F.col("a.i"), F.col("b.size") - F.col("b.i"))
    on = on & ((100 + percent) * most >= percent * (F.col("a.size") + F.col("b.size")))
    candidates = cut(a.join(b, on).select(F.col("a.c").alias("a"), F.col("b.c").alias("b")).distinct())

    # pairs are compared where the blocks of their leaders' followers meet, so a set goes to few places
    both = candidates.unionByName(candidates.select(F.col("b").alias("a"), F.col("a").alias("b")))
    led = cut(both.groupBy(F.col("a").alias("c")).agg(F.least(F.min("a"), F.min("b")).alias("lead")))
    parts = led.groupBy("lead").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    placed = led.join(parts, "lead").select("c", F.struct("lead", F.pmod(F.xxhash64("c"), F.col("parts")).alias("block")).alias("at"))
    pairs = candidates.join(placed.withColumnsRenamed({"c": "a", "at": "x"}), "a").join(placed.withColumnsRenamed({"c": "b", "at": "y"}), "b")
    pairs = cut(pairs.select(F.xxhash64(F.array_sort(F.array("x", "y"))).alias("g"), "a", "b"))
    members = pairs.select("g", F.col("a").alias("c")).union(pairs.select("g", "b")).groupBy("c").agg(F.collect_set("g").alias("gs"))
    members = cut(members.join(classes.select("c", F.col("print").alias("p"), F.col("first").alias("f")), "c"))
    members = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    plain = df.select(F.col(key).alias("id"), F.col(text).alias("_text"))
    whole = plain.join(members, F.col("id").eqNullSafe(F.col("f"))).select("c", "gs", "p", F.explode(F.array(hashed_print(F.coalesce(F.col("_text"), F.lit("")), n))).alias("grams"))
    whole = whole.withColumn("print", name).filter("print = p").select(F.explode("gs").alias("g"), F.struct("c", "grams").alias("d"))
    kept, asked = whole.schema["d"].dataType, F.struct("a", "b")
    work = whole.withColumn("ask", F.lit(None).cast("struct<a:bigint,b:bigint>")).unionByName(pairs.select("g", F.lit(None).cast(kept).alias("d"), asked.alias("ask")))
    work = work.groupBy("g").agg(F.collect_list("d").alias("d"), F.collect_list("ask").alias("ask"))

    def compared(d):
        def of(c):
            return F.filter(d, lambda x: x["c"] == c)[0]["grams"]

        return F.transform("ask", lambda p: let(F.struct(of(p["a"]).alias("x"), of(p["b"]).alias("y")), lambda v: F.struct(
            p["a"].alias("a"), p["b"].alias("b"), (F.size(v["x"]) + F.size(v["y"])).alias("total"), F.size(F.array_intersect(v["x"], v["y"])).alias("both"))))

    found = work.select(F.explode(compared(F.col("d"))).alias("v")).select("v.*").withColumn("together", F.col("total") - F.col("both"))
    similar = found.filter(100 * F.col("both") >= percent * F.col("together")).select("a", "b", (F.col("both") / F.col("together")).alias("similarity"))
    return rows, classes.select("c", "first", "copies"), similar


def near_dup_pairs(df, key, text, n=4, percent=80):
    """(a, b, similarity) of all rows, a < b: pairs of classes, and what copies make of them."""
    rows, classes, pairs = near_classes(df, key, text, n, percent)
    same = classes.filter("copies > 1").select(F.col("c").alias("x"), F.col("c").alias("y"), F.lit(1.0).alias("similarity"))
    left, right = rows.select(F.col("id").alias("a"), F.col("c").alias("x")), rows.select(F.col("id").alias("b"), F.col("c").alias("y"))
    every = pairs.withColumnsRenamed({"a": "x", "b": "y"}).unionByName(same).join(left, "x").join(right, "y").filter((F.col("x") != F.col("y")) | (F.col("a") < F.col("b")))
    return every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def greedy_accept(ids, pairs):
    """(id, accepted): in order of id, each that is similar to no accepted one before it.

    pairs: (a, b), a < b.  Rounds: what has an accepted neighbour before it is
    rejected, what has no undecided one before it is accepted.  Ids without
    pairs are accepted at once.
    """
    edges = cut(pairs.select("a", "b").distinct())
    state = cut(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("accepted", F.lit(None).cast("boolean")))
    left = None
    while undecided := state.filter("accepted is null").count():
        if undecided == left:
            raise ValueError("pairs that lead in a circle: ids must be unique and a before b")
        left = undecided
        before = edges.join(state.withColumnsRenamed({"id": "a", "accepted": "first"}), "a")
        seen = before.groupBy("b").agg(F.bool_or(F.coalesce("first", F.lit(False))).alias("hit"), F.bool_or(F.col("first").isNull()).alias("open"))
        new = state.join(seen.withColumnRenamed("b", "id"), "id", "left")
        state = cut(new.select("id", F.when(F.col("accepted").isNotNull(), F.col("accepted")).when(F.col("hit"), False).when(~F.coalesce("open", F.lit(False)), True).alias("accepted")))
    return ids.select("id").join(state, "id", "left").select("id", F.coalesce("accepted", F.lit(True)).alias("accepted"))


def accepted(df, key, text, n=4, percent=80):
    """Greedy near-duplicate removal over a table: only the first of a class of equal prints can be accepted."""
    rows, known, pairs = near_classes(df, key, text, n, percent)
    first = known.select("c", "first")
    pairs = pairs.join(first.withColumnsRenamed({"c": "a", "first": "x"}), "a").join(first.withColumnsRenamed({"c": "b", "first": "y"}), "b")
    decided = greedy_accept(first.select(F.col("first").alias("id")), pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    out = df.select(F.col(key).alias("id")).join(rows.join(first, "c").select("id", "first"), "id", "left")
    stays = decided.withColumnsRenamed({"id": "first", "accepted": "_yes"})
    return out.join(stays, "first", "left").select("id", (F.col("first").isNull() | ((F.col("id") == F.col("first")) & F.col("_yes"))).alias("accepted"))


def known_prints(*tables):
    """Distinct prints (print, grams, size) of several tables of prints."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.dropDuplicates(["print"])


def similar_to_corpus(df, key, text, corpus, corpus_key, corpus_text, n=4, percent=80):
    """Ids of df that are similar to a row of the corpus, which counts as accepted."""
    rows, new = classes(df, key, text, n)
    new, old = cut(new), cut(classes(corpus, corpus_key, corpus_text, n)[1])
    hit = similar_classes(new, old, percent).select(F.col("a").alias("print")).distinct()
    return rows.join(hit, "print", "left_semi").select("id").distinct()
