"""Aggregates over labels, predictions, findings and accepted samples."""

from pyspark.sql import Window
from pyspark.sql import functions as F


def safe(n, d):
    return F.when(d == 0, 0.0).otherwise(n / d)


def distribution(df, label):
    """Rows and percent of each label."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def distribution_over(df, label, domain):
    """Rows of each label of a domain (label), with a bar of one # for 50."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    out = domain.join(counts, "label", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out.withColumn("bar", F.repeat(F.lit("#"), F.floor(F.col("n") / 50).cast("int")))


def class_weights(df, label):
    """total / (classes * rows of the class)."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return counts.select("label", F.round(F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")), 6).alias("weight"))


def confusion(df, truth, predicted, domain):
    """One row for each true label, a column for each predicted one."""
    wide = df.groupBy(F.col(truth).alias("label")).pivot(predicted, domain).count().fillna(0)
    return wide.select("label", *(F.col(str(d)).alias(f"pred_{d}") for d in domain))


def per_class(df, truth, predicted, domain):
    """Support, precision, recall and F1 of each class; 0 where a denominator is."""
    aggs = []
    for d in domain:
        t, p = F.col(truth) == F.lit(d), F.col(predicted) == F.lit(d)
        aggs.append(F.struct(F.lit(d).alias("label"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn")))
    rows = df.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    rows = rows.withColumns({"support": F.col("tp") + F.col("fn"), "precision": safe(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe(F.col("tp"), F.col("tp") + F.col("fn"))})
    return rows.withColumn("f1", safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def summary(df, truth, predicted, domain):
    """Accuracy, macro and support-weighted F1."""
    rows = per_class(df, truth, predicted, domain)
    return rows.agg(F.sum("tp").alias("hit"), F.sum("support").alias("n"), F.avg("f1").alias("macro_f1"), safe(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1")).select(F.round(safe(F.col("hit"), F.col("n")), 4).alias("accuracy"), F.round("macro_f1", 4).alias("macro_f1"), F.round("weighted_f1", 4).alias("weighted_f1"))


def group_recall(df, group, truth, predicted, positive=1):
    """tp, fn, fp, tn and recall of each group."""
    t, p = F.col(truth) == F.lit(positive), F.col(predicted) == F.lit(positive)
    rows = df.groupBy(group).agg(F.count_if(t & p).alias("tp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"))
    return rows.withColumn("recall", F.round(safe(F.col("tp"), F.col("tp") + F.col("fn")), 6))


def severity(confidence):
    return F.when(confidence >= 0.85, "High").when(confidence >= 0.70, "Medium").otherwise("Low")


def axis_counts(df, axes):
    """(axis, value, n) of several columns in one pass."""
    sets = df.groupingSets([[F.col(a)] for a in axes], *axes).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    # the bit of the one column that is not rolled up is 0
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, a in enumerate(axes):
        own = F.col("g") == ((1 << len(axes)) - 1 - (1 << (len(axes) - 1 - k)))
        name, value = F.when(own, F.lit(a)).otherwise(name), F.when(own, F.col(a).cast("string")).otherwise(value)
    return sets.select(name.alias("axis"), value.alias("value"), "n")


def total_items(df, *lists):
    """How many elements the lists of all rows have; null counts as empty."""
    return df.agg(*(F.coalesce(F.sum(F.size(F.coalesce(c, F.array()))), F.lit(0)).cast("long").alias(c) for c in lists))


def report_summary(results, success="RepairSuccess", model="ModelUsed", by=()):
    """Findings, repaired ones and the distinct models of these, sorted."""
    models = F.sort_array(F.collect_set(F.when(F.col(success), F.col(model))))
    return results.groupBy(*by).agg(F.count("*").alias("findings"), F.count_if(F.col(success)).alias("repaired"), models.alias("models"))


def scan_summary(chunks, vulnerable="is_vulnerable", by=()):
    """Chunks and vulnerable ones."""
    return chunks.groupBy(*by).agg(F.count("*").alias("total_chunks"), F.count_if(F.col(vulnerable)).alias("vulnerable_chunks"))


def span(c):
    """struct(low, high) of a list of lines."""
    return F.struct(F.array_min(c).alias("low"), F.array_max(c).alias("high"))


def least_key(c):
    """The key of a map's smallest value, the smaller key on ties."""
    return F.array_min(F.transform(F.map_entries(c), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))["k"]


def funnel(df, reason, error=None):
    """Kept and skipped rows, the whole percent skipped, and errors (a boolean column), which are neither."""
    failed = F.lit(False) if error is None else F.coalesce(F.col(error), F.lit(False))
    rows = df.agg(F.count_if(F.col(reason).isNull() & ~failed).alias("kept"), F.count_if(F.col(reason).isNotNull() & ~failed).alias("skipped"), *([F.count_if(failed).alias("errors")] if error else []))
    total = F.col("kept") + F.col("skipped")
    return rows.withColumn("skip_percent", F.when(total == 0, 0).otherwise(F.floor(100 * F.col("skipped") / total)).cast("long"))


def tail_average(df, group, order, value, size=10):
    """The whole mean of the last `size` values up to each row, divided by `size` always."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(1 - size, 0)
    return df.withColumn("tail", F.floor(F.sum(value).over(w) / size).cast("long"))


def top_counts(df, column, k):
    """The k most frequent values, smaller values first on ties."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(k)


def duplicate_statements(df, key, text, longer=20, more=2):
    """The first line of each text that stands in it more than `more` times and has more than `longer` characters."""
    from codequarry.functions.lines import split_lines
    from codequarry.functions.text import strip

    rows = df.select(key, F.posexplode(F.transform(split_lines(F.col(text)), strip)).alias("pos", "line"))
    often = rows.filter(F.length("line") > longer).groupBy(key, "line").agg(F.count("*").alias("n"), F.min("pos").alias("first")).filter(F.col("n") > more)
    return often.groupBy(key).agg(F.min_by("line", "first").alias("line"), F.min_by("n", "first").alias("n"))
