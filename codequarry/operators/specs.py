"""Generator specifications: cells of axes, samples of pools, whitelists, quotas."""

from pyspark.sql import Window
from pyspark.sql import functions as F


def cells(*axes):
    """The product of small axis tables; as an equi-join on a constant it is what is asked for."""
    out = axes[0]
    for a in axes[1:]:
        out = out.crossJoin(a)
    return out


def dependent(subtypes, languages, on):
    """Each subtype with its own languages."""
    return subtypes.join(languages, on)


def sampled(cells_, pool, keys, value, size=2, seed="0"):
    """`size` values of a pool for each cell, by md5 of the cell, the value and the seed."""
    mark = F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.col(value).cast("string"), F.lit(seed)).cast("binary"))
    ranked = cells_.crossJoin(pool).withColumn("_m", mark)
    return ranked.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_m", value))).filter(F.col("_r") <= size).drop("_m", "_r")


def shuffled(df, keys, seed="0"):
    """df in an order that depends on the keys and the seed alone."""
    return df.orderBy(F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.lit(seed)).cast("binary")), *keys)


def resumed(df, keys, kept, seed="0"):
    """(position, ...): the shuffled order, begun at place kept % n, as a run that has kept so many rows goes on."""
    order = Window.orderBy(F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.lit(seed)).cast("binary")), *keys)
    n = F.count("*").over(Window.partitionBy())
    return df.withColumn("position", F.pmod(F.row_number().over(order) - 1 - F.pmod(F.lit(kept).cast("long"), n), n).cast("long"))


def up_to(df, order, target):
    """The first `target` rows, where a run stops."""
    return df.orderBy(*order).limit(target)


#: Most rows of a whitelist that is broadcast.
WHITELIST_ROWS = 10_000


def allowed(df, whitelist, subtype="subtype", lang="lang"):
    """Rows but those whose subtype holds a key (key, langs) that doesn't list their language.

    A whitelist of more than WHITELIST_ROWS meets the substrings of the distinct
    subtypes that are no longer than its longest key, by an equi-join.  Nulls
    hold no key and break no list.
    """
    if whitelist.limit(WHITELIST_ROWS + 1).count() <= WHITELIST_ROWS:
        w = F.broadcast(whitelist)
        return df.join(w, F.contains(F.col(subtype), w["key"]) & ~F.array_contains(w["langs"], F.col(lang)), "left_anti")
    longest = whitelist.agg(F.max(F.length("key"))).first()[0] or 0
    pairs = df.select(F.col(subtype).alias("_s"), F.col(lang).alias("_l")).distinct()
    n = F.length("_s")
    substrings = F.transform(F.sequence(F.lit(0), F.least(n, F.lit(longest))), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring("_s", i, k)))
    parts = pairs.select("_s").distinct().select("_s", F.explode(F.array_distinct(F.flatten(substrings))).alias("key"))
    broken = parts.join(whitelist.select("key", "langs"), "key").join(pairs, "_s").filter(~F.array_contains("langs", F.col("_l"))).select("_s", "_l").distinct()
    return df.join(broken, (F.col(subtype) == F.col("_s")) & (F.col(lang) == F.col("_l")), "left_anti")


def batch_quota(df, key, order, quota):
    """The first `quota` rows of each key: the batch form of soft balancing, not the same rows as the sequential one."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_r") <= quota).drop("_r")


def soft_balanced(df, group, key, order, factor=1.4, warm_up=50):
    """Soft balancing: in order, a row is skipped while its key has more than factor times the mean of kept rows by key.

    Sequential by definition, so one group is one task; rows after `warm_up`
    kept ones can be skipped.
    """
    import pandas as pd

    schema = df.schema

    def run(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        counts, keep = dict.fromkeys(pdf[key].unique(), 0), []
        kept = 0
        for k in pdf[key]:
            skip = kept > warm_up and counts[k] > kept / len(counts) * factor
            keep.append(not skip)
            if not skip:
                counts[k] += 1
                kept += 1
        return pdf[pd.Series(keep, index=pdf.index)]

    return df.groupBy(group).applyInPandas(run, schema)
