"""Two-stage scan of source files behind a pluggable scorer.

A scorer is a function DataFrame -> DataFrame that adds vuln_score (double) and
family_scores (map of family to double) to rows with a column text.  Models run
in an iterator pandas UDF (model_scorer), stored scores come from a join; the
engine has no model of its own.
"""

from pyspark.sql import functions as F

from codequarry.functions.lines import split_lines, windows
from codequarry.operators import rules
from codequarry.operators.intervals import merged

# Thresholds of the scan
BINARY, FAMILY, RESCUE, TOLERANCE = 0.60, 0.50, 0.08, 5


def softmax(logits):
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def argmax(values):
    """Place of the largest value, the first on ties, from 0."""
    return F.array_position(values, F.array_max(values)) - 1


def scores_map(logits, families=rules.FAMILIES):
    return F.map_from_arrays(F.array(*map(F.lit, families)), softmax(logits))


def label_ids(families=rules.FAMILIES):
    """Map of label to id, from 0."""
    return F.create_map(*(F.lit(x) for p in zip(families, range(len(families)), strict=True) for x in p))


def id_labels(families=rules.FAMILIES):
    return F.create_map(*(F.lit(x) for p in zip(range(len(families)), families, strict=True) for x in p))


def model_scorer(load):
    """A scorer from load() -> (list of texts -> list of (vuln_score, family_scores)); load runs once in each task."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def score(batches):
        model = load()
        for texts in batches:
            rows = model(list(texts))
            yield pd.DataFrame({"vuln_score": [r[0] for r in rows], "family_scores": [r[1] for r in rows]})

    import collections.abc

    score.__annotations__ = {"batches": collections.abc.Iterator[pd.Series], "return": collections.abc.Iterator[pd.DataFrame]}
    udf = pandas_udf(score, "vuln_score double, family_scores map<string,double>")
    return lambda df: df.withColumn("_s", udf("text")).withColumns({"vuln_score": F.col("_s.vuln_score"), "family_scores": F.col("_s.family_scores")}).drop("_s")


def keyword_scorer(family_words):
    """A deterministic scorer for tests and for rules without a model: the share of a family's words that stand in the text."""

    def apply(df):
        low = F.lower("text")
        share = {f: sum((F.contains(low, F.lit(w.lower())).cast("double") for w in words), F.lit(0.0)) / len(words) for f, words in family_words.items()}
        scores = F.create_map(*(x for f, s in share.items() for x in (F.lit(f), s)))
        best = F.array_max(F.map_values(scores))
        return df.withColumn("family_scores", scores).withColumn("vuln_score", F.least(F.lit(1.0), best * 2))

    return apply


def labelled(df):
    """family_label and family_confidence from family_scores: the largest, the first name on ties."""
    best = F.array_max(F.transform(F.map_entries("family_scores"), lambda e: F.struct(e["value"].alias("v"), (-F.array_position(F.map_keys("family_scores"), e["key"])).alias("p"))))
    at = (-best["p"]).cast("int")
    return df.withColumns({"family_label": F.element_at(F.map_keys("family_scores"), at), "family_confidence": best["v"]})


def rescued(df):
    """Sink windows whose hinted family reaches the rescue floor; label and confidence become the hint's."""
    score = F.coalesce(F.try_element_at("family_scores", "hint_family"), F.lit(0.0))
    kept = df.filter((F.col("hint_family") != "") & (score >= RESCUE))
    return kept.withColumns({"family_label": F.col("hint_family"), "family_confidence": score, "detection_source": F.lit("sink_rescue")})


def above_floor(df):
    return df.filter((F.col("detection_source") == "sink_rescue") | (F.col("family_confidence") >= FAMILY))


def scan(files, key, text, scorer, narrow=None, broad=None, sinks=None):
    """Findings (key, label, start_line, end_line, confidence, vuln_lines) of source files."""
    chunks = files.select(key, F.explode(windows(F.col(text))).alias("w")).select(key, "w.*")
    sliding = labelled(scorer(chunks).filter(F.col("vuln_score") >= BINARY)).withColumn("detection_source", F.lit("sliding"))
    around = rescued(scorer(rules.sink_windows(files, key, text, sinks=sinks)))
    both = above_floor(sliding.unionByName(around, allowMissingColumns=True))
    kept = both.filter(rules.confirmed(F.col("family_label"), F.col("text"), broad))
    spans = kept.select(key, "family_label", F.col("start_line").alias("start"), F.col("end_line").alias("end"), F.col("family_confidence").alias("confidence"), F.struct("start_line", "end_line", "detection_source").alias("seq"))
    whole = merged(spans, [key, "family_label"], TOLERANCE)
    lines = files.select(key, split_lines(F.col(text)).alias("_lines"))
    rebuilt = whole.join(lines, key).withColumn("text", F.array_join(F.slice("_lines", F.col("start"), F.col("end") - F.col("start") + 1), "\n"))
    return rebuilt.select(key, F.col("family_label").alias("label"), F.col("start").alias("start_line"), F.col("end").alias("end_line"), F.bround("confidence", 4).alias("confidence"), rules.localized(F.col("family_label"), F.col("text"), F.col("start"), F.col("end"), narrow, broad).alias("vuln_lines"))


def report(findings, files, key):
    """One row a file: Status and the list of its findings, by line."""
    items = findings.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start_line", "end_line", "label", "confidence", "vuln_lines"))).alias("Findings"))
    out = files.select(key).join(items, key, "left")
    return out.withColumns({"Status": F.when(F.col("Findings").isNull(), "Safe").otherwise("Vulnerable"), "Findings": F.coalesce("Findings", F.array())})


def ranges(start, end, vuln_lines):
    """array<struct(start, end)>: one for each line in range, else the whole range."""
    inside = F.filter(vuln_lines, lambda n: n.between(start, end))
    own = F.transform(inside, lambda n: F.struct(n.alias("start"), n.alias("end")))
    return F.when(F.size(inside) > 0, own).otherwise(F.array(F.struct(start.alias("start"), end.alias("end"))))


def is_hit(line, spans):
    return F.exists(spans, lambda r: line.between(r["start"], r["end"]))
