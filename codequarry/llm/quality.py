"""Quality rules and importance scores of documents.

Method: hashed n-grams (words and pairs of words, in `BUCKETS` buckets), their
multinomials over trusted documents and over the whole corpus, and the mean of
log(trusted / corpus) over a document's n-grams; one fixed threshold for every
document.  All of it in DataFrame functions: arrays stay inside their row, and
only counts of buckets are shuffled.
"""

import math

from pyspark.sql import functions as F

from codequarry.llm.workspace import fresh

SPACE = r"[\x20\x09-\x0D]+"
BUCKETS = 1 << 14
#: Trusted documents that the target is made of at most, by the hash of their id.
TRUSTED = 20_000
THRESHOLD = -0.1


def let(value, body):
    """`body` of a value that is computed once for a row."""
    return F.transform(F.array(value), body)[0]


def words(text):
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda x: x != "")


def base(docs, **more):
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; null text has none of anything.

    more: further columns, each a function of the words.
    """
    text = F.coalesce("text", F.lit(""))
    worded = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def covered(w):
        """Words in three-word windows found twice: sorted by hash, equal windows are neighbours."""
        some = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
        grams = F.sort_array(F.transform(some, lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i"))))

        def positions(g):
            def twice(x, k):
                return ((k > 0) & (F.get(g, k - 1)["h"] == x["h"])) | F.coalesce(F.get(g, k + 1)["h"] == x["h"], F.lit(False))

            return F.sort_array(F.transform(F.filter(g, twice), lambda x: x["i"]))

        hashes = F.transform(some, lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
        none = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last"))
        return F.when(none, 0).otherwise(F.aggregate(let(grams, positions), start, step, lambda a: a["n"]))

    both = fresh(docs, "_both")
    out = docs.withColumns({
        both: let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), covered(w).cast("long").alias("r"), *(f(w).alias(c) for c, f in more.items()))),
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    })
    out = out.withColumns({"n_words": F.col(both)["n"], "n_repeat_words": F.col(both)["r"], **{c: F.col(both)[c] for c in more}}).drop(both)
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def grams(w):
    """Buckets of the words and the pairs of words."""
    bucket = lambda *x: F.pmod(F.xxhash64(*x), F.lit(BUCKETS)).cast("int")
    pairs = F.when(F.size(w) >= 2, F.sequence(F.lit(0), F.size(w) - 2)).otherwise(F.array().cast("array<int>"))
    return F.concat(F.transform(w, lambda x: bucket(x)), F.transform(pairs, lambda i: bucket(w[i], w[i + 1])))


def log_ratios(docs, trusted):
    """log(trusted / corpus) of each bucket, a list of BUCKETS numbers.  trusted: doc_id of some documents."""
    ids = trusted.select(F.col("doc_id").alias("_id")).filter("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(TRUSTED).withColumn("_yes", F.lit(1))
    flagged = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"), "left")
    counts = flagged.select("_yes", F.explode(let(words(F.col("text")), grams)).alias("b")).groupBy("b").agg(F.count("*").alias("n"), F.count("_yes").alias("t"))
    rows = {r["b"]: (r["n"], r["t"]) for r in counts.collect()}  # BUCKETS rows at most
    n, t = (sum(x[i] for x in rows.values()) + BUCKETS for i in (0, 1))
    return [math.log((y + 1) / t) - math.log((x + 1) / n) for x, y in (rows.get(b, (0, 0)) for b in range(BUCKETS))]


def judged(docs, trusted, threshold=THRESHOLD):
    """docs with the counts of base(), score (mean log ratio of its n-grams, 0 without any) and kept.

    kept: not base_failed, and score >= threshold.  Null ids can be judged but
    not trusted; without trusted documents all scores follow the corpus alone.
    Repeated rows are judged alike; existing columns of these names are replaced;
    an empty or null text fails the base, an empty table stays empty.  Arrays of
    a text's words and their hashes stand in memory, some 100 bytes a word.
    """
    table = F.split(F.lit(",".join(map(repr, log_ratios(docs, trusted)))), ",").cast("array<double>")
    score = lambda w: let(grams(w), lambda g: F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(table, b)) / F.greatest(F.size(g), F.lit(1)))
    out = base(docs, score=score)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
