"""Documents to packed sequences: language ID, line dedup, near duplicates, decontamination, packing.

Every stage takes any documents (doc_id, text, lang, source and others): null
and empty texts, repeated rows, null ids and empty tables have the result that
its docstring names, and all but the last return the columns that they got,
whatever their names.
"""

from pyspark.sql import functions as F

from codequarry.llm import decontam, jaccard_join, language, line_dedup, packing
from codequarry.llm.queries import MIN_PAGES, RATIO, documents, tokenizer
from codequarry.llm.workspace import Table, quoted, small_batches


def carried(docs, step, *named):
    """step over the text (and the named columns) of docs; all other columns go along in one, so that no name can clash."""
    rest = F.struct(*quoted(c for c in docs.columns if c != "text"))
    out = step(docs.select("text", rest.alias("rest_of_row"), *named))
    return out.select(*(F.col("text") if c == "text" else F.col("rest_of_row").getField(c).alias(c) for c in docs.columns))


def known_language(spark, docs, sf_dir):
    """Documents of a learnt language; others go, as do junk and texts that are null, empty or without a letter.

    Repeated rows are judged alike; where no row has both a text and a lang
    nothing is learnt and all go.
    """
    model = language.prototypes(docs)
    return carried(docs, lambda d: language.identified(d, model).filter("familiar"))


def own_lines(spark, docs, sf_dir):
    """All documents, without their site's boilerplate lines: null texts stay null, a text of such lines alone is empty.

    Null sources are one site; repeated rows are pages of their own.
    """
    return carried(docs, lambda d: line_dedup.drop_boilerplate(d, "source", RATIO, MIN_PAGES), "source")


def one_of_each_group(spark, docs, sf_dir):
    """One document of each group of near duplicates, that of the smallest doc_id; of repeated rows one.

    Texts without words stay, as do rows without a doc_id.
    """
    return jaccard_join.distinct_documents(docs)


def without_benchmark(spark, docs, sf_dir):
    """Documents that aren't contaminated; null and empty texts never are, repeated rows are judged alike."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return carried(docs, lambda d: decontam.marked(d, benchmark).filter("not contaminated"))


def sequences(spark, docs, sf_dir):
    """Every piece of every document in its sequence: null and empty texts are their end id alone, repeated rows pieces of their own."""
    return packing.packed(docs, tokenizer(), end_id=0, capacity=2048)


def bounded(stage):
    """The stage under small Arrow batches."""

    def run_(spark, docs, sf_dir):
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_


STAGES = [
    ("language", bounded(known_language)),
    ("lines", bounded(own_lines)),
    ("near_duplicates", bounded(one_of_each_group)),
    ("decontamination", bounded(without_benchmark)),
    ("packing", bounded(sequences)),
]

#: SQL can't express profiles, the similarity join at this size or packing; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = Table(stage(spark, docs, sf_dir)).df
    return STAGES[-1][1](spark, docs, sf_dir)
