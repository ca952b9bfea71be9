"""The queries of this subpackage, op1_ to op10_, and their SQL where there is any."""

from pyspark.sql import functions as F

from codequarry.llm import decontam, jaccard_join, language, line_dedup, packing, quality, secrets, sharding, span_dedup, token_codes
from codequarry.llm.workspace import folder, small_batches

LENGTH = 35
RATIO, MIN_PAGES = 0.1, 5
TARGET_BYTES, ARRIVALS = 128 << 20, 3


def tokenizer(name="word_bpe_49k.json"):
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark, sf_dir):
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_codes(spark, sf_dir):
    store = folder(spark)
    token_codes.write(documents(spark, sf_dir), store, tokenizer(), end_id=1)
    return token_codes.read(spark, store)


def op2_span_dedup(spark, sf_dir):
    return span_dedup.digest(documents(spark, sf_dir), LENGTH)


def op3_line_dedup(spark, sf_dir):
    return line_dedup.drop_boilerplate(documents(spark, sf_dir), "source", RATIO, MIN_PAGES).select("doc_id", "n_lines", "n_removed", "text")


def op4_decontamination(spark, sf_dir):
    return decontam.digest(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_jaccard_join(spark, sf_dir):
    return jaccard_join.groups(documents(spark, sf_dir))


def op6_secret_scan(spark, sf_dir):
    return secrets.scanned(documents(spark, sf_dir))


def op7_sharding(spark, sf_dir):
    docs = documents(spark, sf_dir)
    table = sharding.ShardTable(spark, folder(spark), docs.schema, TARGET_BYTES)
    for arrival in range(ARRIVALS):
        table.append(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == arrival))
        table.compact()
        table.vacuum()
    return table.read()


def op8_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", language.held_out(F.col("doc_id")))
    model = language.prototypes(docs.filter("not held_out"))
    return language.identified(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def op10_quality_rules(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    trusted = labels.filter("quality = 1 and toxic = 0")
    out = quality.judged(documents(spark, sf_dir).select("doc_id", "text"), trusted)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op9_best_fit_packing(spark, sf_dir):
    return packing.packed(documents(spark, sf_dir), tokenizer(), end_id=0, capacity=2048)


def queries():
    return {f.__name__: f for f in (op1_token_codes, op2_span_dedup, op3_line_dedup, op4_decontamination, op5_jaccard_join, op6_secret_scan, op7_sharding, op8_language_id, op9_best_fit_packing, op10_quality_rules)}


def oracle_sql():
    return {"op3_line_dedup": line_dedup.ORACLE.format(ratio=RATIO, min_pages=MIN_PAGES), "op7_sharding": "SELECT doc_id, text, lang, source, n_chars FROM documents"}
