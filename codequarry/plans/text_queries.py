"""Queries over texts and their lines."""

from pyspark.sql import functions as F

from codequarry.functions import lines as L
from codequarry.functions import text as T
from codequarry.operators import dedup, metrics
from codequarry.plans.registry import literal, query, table

TOKEN = literal(T.TOKEN)
SPACE = T.SPACE
#: documents with their lines, without an empty last one
LINES = "(SELECT doc_id, CASE WHEN s[-1] = '' THEN s[1:len(s) - 1] ELSE s END AS ln FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"


def strip_sql(x):
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(f"SELECT doc_id, len(regexp_extract_all(text, {TOKEN})) AS n_tokens, len(list_distinct(regexp_extract_all(text, {TOKEN}))) AS n_distinct FROM documents")
def tokenize_counts(spark, sf_dir):
    t = T.tokenize(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(
    f"""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(text, {TOKEN})) AS a FROM documents)
SELECT x.doc_id, CASE WHEN len(x.a) = 0 AND len(y.a) = 0 THEN 1.0 ELSE round(len(list_intersect(x.a, y.a)) * 1.0 / len(list_distinct(list_concat(x.a, y.a))), 6) END AS similarity
FROM t x JOIN t y ON y.doc_id = x.doc_id + 1"""
)
def token_jaccard_pairs(spark, sf_dir):
    t = docs(spark, sf_dir).select("doc_id", F.array_distinct(T.tokenize(F.col("text"))).alias("a"))
    y = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return t.join(y, "doc_id").select("doc_id", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("SELECT doc_id, greatest(1, (2 * length(text)) // 7) AS tokens FROM documents")
def wp_tokens(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.wp_tokens(F.col("text")).alias("tokens"))


def _nested(expression, steps):
    for pattern, new in steps:
        expression = f"regexp_replace({expression}, {literal(pattern)}, {literal(new)}, 'g')"
    return expression


@query(f"SELECT doc_id, md5({_nested('text', [(p, '') for p in T.COMMENTS])}) AS digest FROM documents")
def strip_comments(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.strip_comments(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT doc_id, (" + " OR ".join(f"contains(text, {literal(w)})" for w in T.FUNCTION_KEYWORDS) + ") AS has FROM documents")
def has_keyword(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.has_function(F.col("text")).alias("has"))


@query("SELECT doc_id, left(regexp_replace(text, '[^A-Za-z0-9_-]', '_', 'g'), 36) AS slug FROM documents")
def slugify(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.slug(F.col("text")).alias("slug"))


@query(f"SELECT doc_id, md5({strip_sql(f'''regexp_replace(text, '{SPACE}+', ' ', 'g')''')}) AS digest FROM documents")
def normalize_ws(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.normalize_space(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT page_id, CASE WHEN contains(url, '.') THEN lower(regexp_extract(url, '([^.]*)$', 1)) ELSE '' END AS ext, regexp_replace(url, '\\.[^.]*$', '') AS stem FROM pages")
def file_ext(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.extension(F.col("url")).alias("ext"), T.without_extension(F.col("url")).alias("stem"))


def _language_sql(rules, last, source):
    def test(p):
        return f"regexp_matches(c, {literal(p)})" if p else " AND ".join(f"regexp_matches(c, {literal(x)})" for x in T.JSON_RULES)

    return "CASE " + " ".join(f"WHEN {test(p)} THEN '{n}'" for n, p in rules) + f" ELSE '{last}' END"


_BOTH = "(SELECT 'd' || doc_id AS id, {} AS c FROM documents UNION ALL SELECT 'p' || page_id, {} FROM pages)"


def _both(spark, sf_dir):
    a = docs(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), F.col("text").alias("c"))
    return a.unionByName(table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id")).alias("id"), F.col("html").alias("c")))


@query(f"SELECT id, {_language_sql(T.LANGUAGE_RULES_1, 'code', 'c')} AS lang FROM {_BOTH.format('text', 'html')}")
def detect_lang_v1(spark, sf_dir):
    return _both(spark, sf_dir).select("id", T.language_1(F.col("c")).alias("lang"))


@query(f"SELECT id, {_language_sql(T.LANGUAGE_RULES_2, 'js', 'c')} AS lang FROM {_BOTH.format(strip_sql('text'), strip_sql('html'))}")
def detect_lang_v2(spark, sf_dir):
    return _both(spark, sf_dir).select("id", T.language_2(F.col("c")).alias("lang"))


@query(
    f"""SELECT id, (len(string_split(c, chr(10))) > 2 OR regexp_matches(c, '[{{}}\\[\\];]') OR regexp_matches(c, '(?m)^\\s*(def|function|class|import|#include)')) AND length({strip_sql('c')}) > 10 AS likely
FROM {_BOTH.format('text', 'html')}"""
)
def likely_code(spark, sf_dir):
    return _both(spark, sf_dir).select("id", T.likely_code(F.col("c")).alias("likely"))


_RTL = r"\x{590}-\x{8FF}\x{FB1D}-\x{FDFD}\x{FE70}-\x{FEFC}"


@query(f"SELECT doc_id, CASE WHEN f = '' THEN 'auto' WHEN regexp_matches(f, '[A-Za-z]') THEN 'ltr' ELSE 'rtl' END AS dir FROM (SELECT doc_id, regexp_extract(text, '([A-Za-z{_RTL}])', 1) AS f FROM documents)")
def lead_dir(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.leading_direction(F.col("text")).alias("dir"))


@query(
    f"""WITH n AS (SELECT doc_id, ln, CASE WHEN len(ln) = 0 THEN 0 WHEN len(ln) <= 24 THEN 1 ELSE CAST(ceil((len(ln) - 24) / 12.0) AS BIGINT) + 1 END AS k FROM {LINES}),
w AS (SELECT doc_id, ln, unnest(range(k)) AS i FROM n)
SELECT doc_id, i * 12 + 1 AS start_line, least(i * 12 + 24, len(ln)) AS end_line, md5(array_to_string(ln[i * 12 + 1:i * 12 + 24], chr(10))) AS digest FROM w"""
)
def chunk_lines_24_12(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.explode(L.windows(F.col("text"), 24, 12)).alias("w"))
    return rows.select("doc_id", F.col("w.start_line").cast("long").alias("start_line"), F.col("w.end_line").cast("long").alias("end_line"), F.md5(F.col("w.text").cast("binary")).alias("digest"))


@query(f"SELECT doc_id, md5(array_to_string(list_transform(range(1, len(ln) + 1), lambda i: lpad(CAST(i AS VARCHAR), CAST(length(CAST(len(ln) AS VARCHAR)) AS INTEGER), ' ') || ' | ' || ln[i]), chr(10))) AS digest FROM {LINES}")
def number_lines(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(L.numbered(F.col("text")).cast("binary")).alias("digest"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
s AS (SELECT *, sum(greatest(1, (2 * length(x)) // 7)) OVER (PARTITION BY doc_id ORDER BY i) AS total, count(*) OVER (PARTITION BY doc_id) AS n FROM l),
k AS (SELECT doc_id, max(n) AS n, count(*) FILTER (total <= 200) AS kept, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (total <= 200), '') AS t FROM s GROUP BY doc_id),
b AS (SELECT *, (length(t) - length(replace(t, '{', ''))) - (length(t) - length(replace(t, '}', ''))) AS open FROM k)
SELECT doc_id, kept, md5(t || CASE WHEN kept < n AND open > 0 THEN chr(10) || repeat('}' || chr(10), open) ELSE '' END) AS digest FROM b"""
)
def truncate_budget(spark, sf_dir):
    out = docs(spark, sf_dir).select("doc_id", "text", L.truncated(F.col("text"), 200).alias("t"))
    # the number of lines kept, told from the text: an empty one is none or one empty line
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("sum"))
    kept = F.aggregate(L.lines(F.col("text")), start, lambda a, x: F.struct((a["n"] + (a["sum"] + T.wp_tokens(x) <= 200).cast("int")).alias("n"), (a["sum"] + T.wp_tokens(x)).alias("sum")), lambda a: a["n"])
    return out.select("doc_id", kept.cast("long").alias("kept"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query(
    """WITH p AS (SELECT a.doc_id, length(a.text) AS v, length(b.text) AS s FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, greatest(240, 1900 * v // greatest(v + s, 1)) AS vuln, greatest(240, 1900 * s // greatest(v + s, 1)) AS safe FROM p"""
)
def pair_budget_split(spark, sf_dir):
    a = docs(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("v"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("v").alias("s"))
    return a.join(b, "doc_id").select("doc_id", L.pair_budget(F.col("v"), F.col("s"), 1900, 240).alias("x")).select("doc_id", "x.vuln", "x.safe")


_GRAMS = f"(SELECT doc_id, CASE WHEN len(t) < 4 THEN list_distinct(t) ELSE list_distinct(list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], '|'))) END AS g FROM (SELECT doc_id, regexp_extract_all(text, {TOKEN}) AS t FROM documents))"


@query(f"SELECT doc_id, len(g) AS n, md5(array_to_string(list_sort(g), chr(10))) AS digest FROM {_GRAMS}")
def line_ngrams(spark, sf_dir):
    g = dedup.fingerprints(docs(spark, sf_dir), "doc_id", "text")
    return g.select(F.col("id").alias("doc_id"), F.col("size").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("grams"), "\n").cast("binary")).alias("digest"))


@query(
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents),
n AS (SELECT doc_id, s, coalesce(list_min(list_transform(list_filter(s, lambda x: regexp_matches(x, '\\S')), lambda x: length(x) - length(regexp_replace(x, '^\\s+', '')))), 0) AS k FROM l)
SELECT doc_id, k AS indent, md5(regexp_replace(replace(array_to_string(list_transform(s, lambda x: CASE WHEN length(x) >= k THEN substring(x, CAST(k + 1 AS BIGINT)) ELSE x END), chr(10)), chr(9), '  '), '\\s+$', '')) AS digest FROM n"""
)
def min_indent_dedent(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", L.least_indent(F.col("text")).cast("long").alias("indent"), F.md5(L.dedented(F.col("text")).cast("binary")).alias("digest"))


@query(
    """WITH l AS (SELECT page_id, unnest(ln) AS t, generate_subscripts(ln, 1) AS i FROM (SELECT page_id, CASE WHEN s[-1] = '' THEN s[1:len(s) - 1] ELSE s END AS ln FROM (SELECT page_id, string_split(html, chr(10)) AS s FROM pages))),
k AS (SELECT *, len(list_filter(regexp_extract_all(t, '(?i)<script[^>]*>'), lambda x: NOT regexp_matches(x, '(?i)\\bsrc\\s*='))) > 0 AS o, regexp_matches(t, '(?i)</script\\s*>') AS c FROM l),
v AS (SELECT *, CASE WHEN o AND NOT c THEN 1 WHEN c AND NOT o THEN 0 END AS s FROM k),
g AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER w, 0) AS base, count(s) OVER w AS sets FROM v WINDOW w AS (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, (base + coalesce(sum(CASE WHEN o AND c THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, sets ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) % 2 AS inside FROM g)
SELECT page_id, i AS line, t AS text FROM p WHERE inside = 1 AND NOT c"""
)
def extract_script_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(L.script_lines(F.col("html"))).alias("x"))
    return rows.select("page_id", F.col("x.line").cast("long").alias("line"), "x.text")


def _entities_sql(c):
    for name, char in T.ENTITIES:
        c = f"replace({c}, {literal(name)}, {literal(char)})"
    return c


@query(f"SELECT page_id, md5({_entities_sql('html')}) AS digest FROM pages")
def html_entity_decode(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.decode_entities(F.col("html")).cast("binary")).alias("digest"))


_PAIRS = f"""g AS (SELECT doc_id, unnest(g) AS gram, len(g) AS n FROM {_GRAMS}),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS hits, any_value(a.n) AS n, any_value(b.n) AS m FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
near AS (SELECT a, b, hits, n + m - hits AS together FROM pairs WHERE 100 * hits >= 80 * (n + m - hits))"""


@query(f"WITH {_PAIRS} SELECT a, b, round(hits * 1.0 / together, 6) AS similarity FROM near")
def near_dup_pairs(spark, sf_dir):
    return dedup.near_dup_pairs(docs(spark, sf_dir), "doc_id", "text").select("a", "b", F.round("similarity", 6).alias("similarity"))


def _rounds(n):
    """Rounds of the greedy accept: 1 accepted, 0 rejected, null open."""
    out = ["s0 AS (SELECT doc_id AS id, CASE WHEN NOT EXISTS (SELECT 1 FROM near WHERE near.b = documents.doc_id) THEN 1 END AS s FROM documents)"]
    for k in range(1, n + 1):
        out.append(f"s{k} AS (SELECT x.id, coalesce(any_value(x.s), CASE WHEN max(y.s) = 1 THEN 0 WHEN count(*) FILTER (e.a IS NOT NULL AND y.s IS NULL) = 0 THEN 1 END) AS s FROM s{k - 1} x LEFT JOIN near e ON e.b = x.id LEFT JOIN s{k - 1} y ON y.id = e.a GROUP BY x.id)")
    return ", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in out)


@query(f"WITH {_PAIRS.replace('near AS (', 'near AS MATERIALIZED (')}, {_rounds(8)} SELECT id AS doc_id, s = 1 AS accepted FROM s8")
def near_dup_greedy(spark, sf_dir):
    return dedup.accepted(docs(spark, sf_dir), "doc_id", "text").withColumnRenamed("id", "doc_id")


@query(
    f"""WITH d AS (SELECT doc_id, unnest(g) AS gram, len(g) AS n FROM {_GRAMS}),
i AS (SELECT doc_id, unnest(g) AS gram, len(g) AS n FROM {_GRAMS.replace('FROM documents', 'FROM (SELECT item_id AS doc_id, text FROM benchmark)')})
SELECT DISTINCT doc_id FROM (SELECT d.doc_id, i.doc_id AS item, count(*) AS hits, any_value(d.n) + any_value(i.n) AS total FROM d JOIN i ON d.gram = i.gram GROUP BY 1, 2) WHERE 100 * hits >= 20 * (total - hits)"""
)
def near_dup_vs_benchmark(spark, sf_dir):
    return dedup.similar_to_corpus(docs(spark, sf_dir), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text", percent=20).withColumnRenamed("id", "doc_id")


@query(
    f"""WITH l AS (SELECT doc_id, unnest(ln) AS x, generate_subscripts(ln, 1) AS i FROM {LINES}),
c AS (SELECT doc_id, {strip_sql('x')} AS line, count(*) AS n, min(i) AS first FROM l GROUP BY 1, 2 HAVING count(*) > 2 AND length({strip_sql('any_value(x)')}) > 20)
SELECT doc_id, arg_min(line, first) AS line, arg_min(n, first) AS n FROM c GROUP BY doc_id"""
)
def duplicate_statement(spark, sf_dir):
    return metrics.duplicate_statements(docs(spark, sf_dir), "doc_id", "text")


_A = "(SELECT a.doc_id, list_distinct(list_filter(list_transform(string_split(a.text, chr(10)), lambda x: " + strip_sql("x") + "), lambda x: x <> '')) AS v, list_distinct(list_filter(list_transform(string_split(b.text, chr(10)), lambda x: " + strip_sql("x") + "), lambda x: x <> '')) AS s FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"


def _pairs(spark, sf_dir):
    a = docs(spark, sf_dir).select("doc_id", F.col("text").alias("vuln"))
    return a.join(a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("vuln").alias("safe")), "doc_id")


@query(f"SELECT doc_id, len(list_filter(v, lambda x: NOT list_contains(s, x))) = 0 AND len(list_filter(s, lambda x: NOT list_contains(v, x))) = 0 AS same FROM {_A}")
def zero_change_pairs(spark, sf_dir):
    a, b = L.stripped_set(F.col("vuln")), L.stripped_set(F.col("safe"))
    return _pairs(spark, sf_dir).select("doc_id", ((F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)).alias("same"))


@query(f"SELECT doc_id, len(list_filter(s, lambda x: NOT list_contains(v, x))) AS n FROM {_A}")
def new_lines_diff(spark, sf_dir):
    return _pairs(spark, sf_dir).select("doc_id", F.size(F.array_except(L.stripped_set(F.col("safe")), L.stripped_set(F.col("vuln")))).cast("long").alias("n"))
