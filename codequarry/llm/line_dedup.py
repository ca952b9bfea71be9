"""Removal of lines that are boilerplate of their site.

Method: site-relative frequency, in DataFrame functions alone.  A line's share
is the number of a site's pages that hold it over the number of the site's
pages; lines above `ratio` go from the pages of that site.

A site has at most (mean lines of a page) / ratio such lines, so each site's
list is short however large the site is.  Counts are summed before the shuffle
and keyed by site and line, which spreads a large site over all tasks.  Lists
are broadcast where all of them together are few, else joined with the pages
under a salt that spreads a large site.
"""

from pyspark.sql import functions as F

from codequarry.llm.workspace import Table, fresh, quoted

#: Most listed lines (8 bytes each) that are broadcast.
BROADCAST_LINES = 500_000
SALTS = 64
WORD = r"[^\x20\x09-\x0D]"


def boilerplate(docs, site, ratio, min_pages):
    """(site, lines): hashes of the lines in more than `ratio` of a site's pages and in `min_pages` pages at least."""
    pages = docs.select(F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), "text")
    totals = pages.groupBy("site").agg(F.count("*").alias("pages"))
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)), lambda x: F.xxhash64(x)))
    counts = pages.select("site", F.explode(lines).alias("line")).groupBy("site", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    frequent = counts.join(totals, "site").filter(F.col("n") > ratio * F.col("pages"))
    return frequent.groupBy("site").agg(F.collect_set("line").alias("lines"))


def salt(docs):
    """A number below SALTS of each row, by all columns that can be hashed (no maps): copies of a text under other ids spread.

    It hangs on the row alone, so a task that runs again deals its rows alike.
    """
    some = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.pmod(F.xxhash64(*quoted(some)), F.lit(SALTS)).cast("int")


def drop_boilerplate(docs, site="source", ratio=0.1, min_pages=5):
    """All rows and columns of docs; text loses its site's boilerplate lines, n_lines and n_removed are new.

    Lines end at \\n and are compared whole; lines without a word are never
    boilerplate.  Null sites are one site, as is the empty one.  Null text stays
    null with 0 lines and counts as a page; repeated rows are pages of their
    own.  Existing columns n_lines and n_removed are replaced.  An empty table
    gives an empty table.
    """
    listed = Table(boilerplate(docs, site, ratio, min_pages)).df
    n = listed.agg(F.sum(F.size("lines"))).first()[0] or 0
    docs = docs.drop("n_lines", "n_removed")
    site_, listed_, salt_, kept_ = (fresh(docs, n) for n in ("_site", "_listed", "_salt", "_kept"))
    docs = docs.withColumn(site_, F.coalesce(F.col(site).cast("string"), F.lit("")))
    listed = listed.select(F.col("site").alias(site_), F.col("lines").alias(listed_))
    if n <= BROADCAST_LINES:
        both = docs.join(F.broadcast(listed), site_, "left")
    else:
        salted = listed.withColumn(salt_, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = docs.withColumn(salt_, salt(docs)).join(salted, [site_, salt_], "left").drop(salt_)
    lines = F.split("text", "\n")
    none = F.col("text").isNull()
    kept = F.when(F.col(listed_).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(listed_, F.xxhash64(x))))
    both = both.withColumns({kept_: kept, "n_lines": F.when(none, 0).otherwise(F.size(lines)).cast("long")})
    removed = F.when(none, 0).otherwise(F.col("n_lines") - F.size(kept_)).cast("long")
    text = F.when(F.col(listed_).isNull(), F.col("text")).otherwise(F.array_join(kept_, "\n"))
    return both.withColumns({"n_removed": removed, "text": text}).drop(site_, listed_, kept_)


ORACLE = """
WITH lines AS (SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
pages AS (SELECT coalesce(source, '') AS site, count(*) AS pages FROM documents GROUP BY 1),
counts AS (SELECT site, line, count(DISTINCT doc_id) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1, 2),
bad AS (SELECT site, line FROM counts JOIN pages USING (site) WHERE n >= {min_pages} AND n > {ratio} * pages),
marked AS (SELECT l.doc_id, l.line, l.i, b.line IS NOT NULL AS gone FROM lines l LEFT JOIN bad b ON l.site = b.site AND l.line = b.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
FROM marked GROUP BY doc_id
"""
