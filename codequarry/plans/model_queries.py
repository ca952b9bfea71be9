"""Queries over single operators: look-ups, summaries, budgets, files, dates, replies.

Stand-ins: customer, orders and lineitem for users, sessions and findings;
documents for source files; events for messages.
"""

from pyspark.sql import functions as F

from codequarry.functions import dates
from codequarry.functions import lines as L
from codequarry.functions import text as T
from codequarry.operators import chat, dedup, detect, gates, intervals, metrics, relational, repair, rules, specs
from codequarry.operators.state import folder
from codequarry.plans.registry import literal, query, table, values
from codequarry.plans.text_queries import LINES, TOKEN, strip_sql
from codequarry.sources import io


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


# ---- look-ups and changes ----------------------------------------------------------


@query("SELECT (SELECT c_name FROM customer WHERE c_custkey = 7) AS found, (SELECT c_name FROM customer WHERE c_custkey = -1) AS missing")
def point_lookup(spark, sf_dir):
    one = lambda k, name: relational.first_or_null(table(spark, sf_dir, "customer"), F.col("c_custkey") == k, "c_custkey").select(F.col("c_name").alias(name))
    return one(7, "found").crossJoin(one(-1, "missing"))  # one row each


@query("SELECT event_id, coalesce(json_extract_string(props, '$.K'), json_extract_string(props, '$.k'), '0') AS k, coalesce(json_extract_string(props, '$.Confidence'), json_extract_string(props, '$.confidence'), '0') AS confidence FROM events")
def key_fallback(spark, sf_dir):
    props = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", T.either_case(props, "k", 0).alias("k"), T.either_case(props, "Confidence", 0).alias("confidence"))


@query("SELECT c_custkey, concat(coalesce(c_name, ''), ' ', coalesce(nullif(c_mktsegment, 'BUILDING'), '')) AS full_name FROM customer")
def full_name(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.full_name(F.col("c_name"), F.nullif("c_mktsegment", F.lit("BUILDING"))).alias("full_name"))


@query("SELECT o_orderkey, coalesce(c_name, 'Untitled_Chat') AS c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def chat_name_lookup(spark, sf_dir):
    names = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return relational.named(table(spark, sf_dir, "orders"), names, "o_custkey", "c_name").select("o_orderkey", "c_name")


@query("SELECT l_orderkey, min_by(l_suppkey, (l_linenumber, l_suppkey)) AS l_suppkey FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey")
def first_match(spark, sf_dir):
    return relational.first_match(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_returnflag") == "R", "l_suppkey", F.struct("l_linenumber", "l_suppkey"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def latest_session(spark, sf_dir):
    return relational.newest(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place FROM orders WHERE o_custkey = 7")
def sessions_by_date(spark, sf_dir):
    from pyspark.sql import Window

    own = table(spark, sf_dir, "orders").filter("o_custkey = 7")
    return own.select("o_orderkey", F.row_number().over(Window.orderBy("o_orderdate", "o_orderkey")).cast("long").alias("place"))


@query("SELECT count(*) FILTER (c_nationkey = 3) AS affected FROM customer")
def rows_affected(spark, sf_dir):
    return relational.affected(table(spark, sf_dir, "customer"), F.col("c_nationkey") == 3)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def compensating_delete(spark, sf_dir):
    failed = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return relational.compensated(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), failed, "o_orderkey")


def _sessions(spark, sf_dir):
    """One row an order that has any lines, with the list of its findings; null for those of odd keys."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("Findings"))
    return items.withColumn("Findings", F.when(F.col("l_orderkey") % 2 == 0, F.col("Findings")))


@query('SELECT CAST(count(*) FILTER (l_orderkey % 2 = 0) AS BIGINT) AS "Findings" FROM lineitem')
def findings_total(spark, sf_dir):
    return metrics.total_items(_sessions(spark, sf_dir), "Findings")


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_orderkey % 2 = 0")
def findings_flat(spark, sf_dir):
    return relational.findings(_sessions(spark, sf_dir))


@query("SELECT l_orderkey, count(*) AS findings, count(*) FILTER (l_returnflag <> 'R') AS repaired, coalesce(string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) FILTER (l_returnflag <> 'R'), '') AS models FROM lineitem GROUP BY l_orderkey")
def report_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("ok", F.col("l_returnflag") != "R")
    return metrics.report_summary(rows, "ok", "l_linestatus", ["l_orderkey"]).withColumn("models", F.array_join("models", ","))


@query("SELECT count(*) AS total_chunks, count(*) FILTER (n_chars > 2000) AS vulnerable_chunks FROM documents")
def scan_summary(spark, sf_dir):
    return metrics.scan_summary(docs(spark, sf_dir).withColumn("is_vulnerable", F.col("n_chars") > 2000))


@query("SELECT count(*) FILTER (ok AND NOT bad) AS kept, count(*) FILTER (NOT ok AND NOT bad) AS skipped, CAST(floor(100 * count(*) FILTER (NOT ok AND NOT bad) / count(*) FILTER (NOT bad)) AS BIGINT) AS skip_percent, count(*) FILTER (bad) AS errors FROM (SELECT n_chars > 500 AS ok, doc_id % 11 = 0 AS bad FROM documents)")
def accept_funnel(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.when(F.col("n_chars") <= 500, "too short").alias("reason"), (F.col("doc_id") % 11 == 0).alias("bad"))
    return metrics.funnel(rows, "reason", "bad")


@query("SELECT l_orderkey, min(l_linenumber) AS low, max(l_linenumber) AS high FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY l_orderkey")
def region_span(spark, sf_dir):
    lists = _sessions(spark, sf_dir).filter("Findings is not null").select("l_orderkey", metrics.span(F.col("Findings.l_linenumber")).alias("x"))
    return lists.select("l_orderkey", "x.low", "x.high")


@query("SELECT user_id, arg_min(event_type, (n, event_type)) AS least FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def least_key(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return maps.select("user_id", metrics.least_key(F.col("m")).alias("least"))


# ---- intervals and orders ------------------------------------------------------------

_SPANS = "(SELECT user_id AS file, event_type AS family, event_id * 7 % 100 AS s, event_id * 7 % 100 + event_id % 13 AS e, event_id * 31 % 10 AS confidence, event_id AS seq FROM events)"


def _detections(spark, sf_dir):
    c = F.col
    start = c("event_id") * 7 % 100
    return table(spark, sf_dir, "events").select(c("user_id").alias("file"), c("event_type").alias("family"), start.alias("start"), (start + c("event_id") % 13).alias("end"), (c("event_id") * 31 % 10).alias("confidence"), c("event_id").alias("seq"))


@query(
    f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY file, family ORDER BY confidence DESC, seq) AS r FROM {_SPANS}),
g AS (SELECT file, family, r, [{{'s': s, 'e': e, 'seq': seq}}] AS kept FROM d WHERE r = 1
UNION ALL SELECT g.file, g.family, d.r, CASE WHEN len(list_filter(kept, lambda k: least(k.e, d.e) > greatest(k.s, d.s))) > 0 THEN kept ELSE list_append(kept, {{'s': s, 'e': e, 'seq': seq}}) END FROM g JOIN d ON d.file = g.file AND d.family = g.family AND d.r = g.r + 1),
w AS (SELECT arg_max(kept, r) AS kept FROM g GROUP BY file, family)
SELECT unnest(list_transform(kept, lambda k: k.seq)) AS seq FROM w"""
)
def same_family_overlap(spark, sf_dir):
    return intervals.strongest(_detections(spark, sf_dir), ["file", "family"]).select("seq")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_quantity AS INTEGER) DESC, l_linenumber) AS place FROM lineitem")
def patch_order(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy(F.desc(F.col("l_quantity").cast("int")), "l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(order).cast("long").alias("place"))


@query("SELECT doc_id FROM documents WHERE n_chars > 500 ORDER BY doc_id LIMIT 100")
def target_limit(spark, sf_dir):
    return specs.up_to(docs(spark, sf_dir).filter("n_chars > 500").select("doc_id"), ["doc_id"], 100)


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY md5(concat_ws('|', doc_id, '7')), doc_id) - 1 - 37 % count(*) OVER () + count(*) OVER ()) % count(*) OVER () AS BIGINT) AS position FROM documents")
def resume_order(spark, sf_dir):
    return specs.resumed(docs(spark, sf_dir).select("doc_id"), ["doc_id"], 37, "7")


_EVENTS = "(SELECT event_id, user_id, event_type FROM events WHERE user_id % 5 = 0)"


@query(
    f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM {_EVENTS}),
n AS (SELECT user_id, count(DISTINCT event_type) AS kinds FROM {_EVENTS} GROUP BY user_id),
g AS (SELECT user_id, r, [event_type] AS kept, [event_id] AS ids FROM d WHERE r = 1
UNION ALL SELECT g.user_id, d.r, CASE WHEN len(kept) > 10 AND len(list_filter(kept, lambda x: x = d.event_type)) > len(kept) / kinds * 1.4 THEN kept ELSE list_append(kept, d.event_type) END,
CASE WHEN len(kept) > 10 AND len(list_filter(kept, lambda x: x = d.event_type)) > len(kept) / kinds * 1.4 THEN ids ELSE list_append(ids, d.event_id) END FROM g JOIN d ON d.user_id = g.user_id AND d.r = g.r + 1 JOIN n ON n.user_id = g.user_id)
SELECT user_id, unnest(arg_max(ids, r)) AS event_id FROM g GROUP BY user_id"""
)
def soft_balance(spark, sf_dir):
    """Users of every fifth id are the generators' runs: one sequence each."""
    rows = table(spark, sf_dir, "events").filter("user_id % 5 = 0").select("event_id", "user_id", "event_type")
    return specs.soft_balanced(rows, "user_id", "event_type", "event_id", 1.4, 10).select("user_id", "event_id")


@query("SELECT p_partkey, l FROM (SELECT p_partkey, p_size % 2 AS k FROM part) JOIN (VALUES (0, 'py'), (0, 'js'), (1, 'java')) AS v(k, l) USING (k)")
def spec_dependent(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 2).alias("k"))
    return specs.dependent(parts, spark.createDataFrame([(0, "py"), (0, "js"), (1, "java")], "k int, l string"), "k").select("p_partkey", "l")


# ---- texts -----------------------------------------------------------------------------

_FORBIDDEN = ("Licensed under", "password", "secret", " the ")


@query("SELECT doc_id, CASE " + " ".join(f"WHEN contains(text, {literal(w)}) THEN {literal(w)}" for w in _FORBIDDEN) + " END AS first FROM documents")
def forbidden_first(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.first_contained(F.col("text"), _FORBIDDEN).alias("first"))


@query("SELECT event_id, CASE WHEN json_type(props, '$.k') = 'ARRAY' THEN len(CAST(json_extract(props, '$.k') AS INTEGER[])) END AS n FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{\"k\": [1, 2]}' ELSE props END AS props FROM events)")
def json_array_guard(spark, sf_dir):
    props = F.when(F.col("event_id") % 2 == 0, F.lit('{"k": [1, 2]}')).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.size(T.json_list(props, "k")).cast("long").alias("n")).withColumn("n", F.when(F.col("n") >= 0, F.col("n")))


@query("SELECT doc_id, coalesce(([10, 20, 30])[CASE WHEN doc_id % 7 > 0 THEN doc_id % 7 END], doc_id % 7) AS line FROM documents")
def line_map(spark, sf_dir):
    line = (F.col("doc_id") % 7).cast("int")
    return docs(spark, sf_dir).select("doc_id", L.mapped(line, F.array(F.lit(10), F.lit(20), F.lit(30))).cast("long").alias("line"))


@query("SELECT doc_id, left(text, 60) AS key, left(source, 5) AS short FROM documents")
def lineage_key(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.key_part(F.col("text")).alias("key"), T.key_part(F.col("source"), 5).alias("short"))


_REPLY = "concat(CASE WHEN doc_id % 5 = 0 THEN '' ELSE '**VULN:**' || chr(10) END, left(text, 30), chr(10), 'SAFE:', chr(10), '```py', chr(10), 'x', doc_id, chr(10), '```')"


@query(f"SELECT doc_id, {strip_sql('left(text, 30)')} AS vuln, concat('x', doc_id) AS safe FROM documents WHERE doc_id % 5 <> 0 AND NOT contains(left(text, 30), '`')")
def reply_blocks(spark, sf_dir):
    c = F.col
    reply = F.concat(F.when(c("doc_id") % 5 == 0, "").otherwise("**VULN:**\n"), F.left(c("text"), F.lit(30)), F.lit("\nSAFE:\n```py\nx"), c("doc_id"), F.lit("\n```"))
    rows = docs(spark, sf_dir).filter(~F.contains(F.left(c("text"), F.lit(30)), F.lit("`"))).select("doc_id", T.parse_blocks(reply).alias("b"))
    return rows.filter("b is not null").select("doc_id", "b.vuln", "b.safe")


@query("SELECT doc_id, CASE WHEN trim(p) = '' THEN '' ELSE replace(regexp_replace(p, '[<>:\"/\\\\|?*\\x00-\\x1f]', '', 'g'), ' ', '_') END AS safe FROM (SELECT doc_id, left(text, 40) AS p FROM documents)")
def path_names(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.path_safe(F.left("text", F.lit(40))).alias("safe"))


@query("SELECT o_orderkey, concat(o_custkey, '_', replace(c_name, '#', '#'), '_', c_mktsegment, '/', replace(o_orderpriority, ' ', '_'), '/Origin/', o_orderkey, '_a_b.py') AS path FROM orders JOIN customer ON c_custkey = o_custkey")
def storage_paths(spark, sf_dir):
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return both.select("o_orderkey", T.storage_path(F.col("o_custkey"), F.col("c_name"), F.col("c_mktsegment"), F.col("o_orderpriority"), F.col("o_orderkey"), F.lit("a b.py")).alias("path"))


_ALIASES = " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in T.LANGUAGE_ALIASES.items())
_NAMES = ("JS", "py", "Csharp", "c#", "TypeScript", "unheard of", "sh", "")


@query(f"SELECT doc_id, CASE lower(n) {_ALIASES} ELSE lower(n) END AS name FROM (SELECT doc_id, ([{', '.join(map(literal, _NAMES))}])[doc_id % {len(_NAMES)} + 1] AS n FROM documents)")
def language_names(spark, sf_dir):
    raw = F.get(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % len(_NAMES)).cast("int"))
    return docs(spark, sf_dir).select("doc_id", T.language_name(raw).alias("name"))


@query("SELECT doc_id, md5(replace(text, 'the', '***')) AS digest FROM documents")
def redacted(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.redact(F.col("text"), "the").cast("binary")).alias("digest"))


@query("SELECT doc_id, concat('Fix ', coalesce(lang, ''), ' in ', source, ': {other}') AS prompt FROM documents")
def prompts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", L.prompt("Fix {lang} in {source}: {other}", lang=F.col("lang"), source=F.col("source")).alias("prompt"))


@query("SELECT l_orderkey, l_linenumber, replace(lower(CASE l_linenumber % 2 WHEN 0 THEN 'SQL Injection' ELSE 'XSS' END), ' ', '_') AS family FROM lineitem")
def family_keys(spark, sf_dir):
    name = F.when(F.col("l_linenumber") % 2 == 0, "SQL Injection").otherwise("XSS")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.family_key(name).alias("family"))


@query(
    f"""SELECT doc_id, CASE WHEN length(text) <= 1200 THEN 'whole' ELSE 'part' END AS kind, length(CASE WHEN length(text) <= 1200
THEN array_to_string(list_transform(range(1, len(ln) + 1), lambda i: concat(lpad(CAST(i AS VARCHAR), CAST(length(CAST(len(ln) AS VARCHAR)) AS INTEGER), ' '), ' | ', ln[i])), chr(10))
ELSE array_to_string(list_transform(range(1, least(len(ln), 4) + 1), lambda i: concat(lpad(CAST(i AS VARCHAR), CAST(length(CAST(len(ln) AS VARCHAR)) AS INTEGER), ' '), ' | ', ln[i])), chr(10)) END) AS n
FROM {LINES} JOIN documents USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|\\n)\\s*(import|from|using|#include|const|let|var)'))"""
)
def repair_context(spark, sf_dir):
    rows = docs(spark, sf_dir).filter(~F.col("text").rlike(r"(^|\n)\s*(import|from|using|#include|const|let|var)"))
    shown = L.context(F.col("text"), F.lit(2), F.lit(2), 1200, 2)
    return rows.select("doc_id", F.when(F.length("text") <= 1200, "whole").otherwise("part").alias("kind"), F.length(shown).cast("long").alias("n"))


def _depth_sql(opens, closes):
    # a walk that can't fall below 0 is the running sum less its least value so far
    return f"""WITH l AS (SELECT page_id, unnest(ln) AS x, generate_subscripts(ln, 1) AS i FROM (SELECT page_id, CASE WHEN s[-1] = '' THEN s[1:len(s) - 1] ELSE s END AS ln FROM (SELECT page_id, string_split(html, chr(10)) AS s FROM pages))),
c AS (SELECT page_id, i, unnest(m) AS ch, generate_subscripts(m, 1) AS k FROM (SELECT page_id, i, regexp_extract_all(x, '[{opens}{closes}]') AS m FROM l)),
r AS (SELECT *, sum(CASE WHEN ch = '{opens}' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY i, k) AS run FROM c),
d AS (SELECT page_id, i, k, run - least(0, min(run) OVER (PARTITION BY page_id ORDER BY i, k)) AS depth FROM r),
e AS (SELECT page_id, i, arg_max(depth, k) AS depth FROM d GROUP BY page_id, i)
SELECT l.page_id, l.i AS line, CAST(coalesce((SELECT arg_max(e.depth, e.i) FROM e WHERE e.page_id = l.page_id AND e.i < l.i), 0) AS BIGINT) AS depth FROM l"""


def _depth(name, opens, closes):
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(L.depths(F.col("html"), opens, closes)).alias("i", "d"))
        return rows.select("page_id", (F.col("i") + 1).cast("long").alias("line"), F.col("d").cast("long").alias("depth"))

    run.__name__ = name
    query(_depth_sql(opens, closes))(run)


_depth("brace_depth", "{", "}")
_depth("paren_depth", "(", ")")


def _cut_sql(c, budget):
    """A text's lines that fit a budget of tokens, those before being summed; no text of documents holds braces left open."""
    lines = f"string_split({c}, chr(10))"
    cost = f"list_transform({lines}, lambda y: greatest(1, 2 * length(y) // 7))"
    fits = f"len(list_filter(range(1, len({lines}) + 1), lambda i: list_sum(({cost})[1:i]) <= {budget}))"
    return f"array_to_string(({lines})[1:{fits}], chr(10))"


@query(
    f"""WITH p AS (SELECT a.doc_id, a.text AS v, b.text AS s FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE NOT contains(a.text || b.text, '{{')),
q AS (SELECT *, greatest(240, floor(1900 * length(v) / greatest(length(v) + length(s), 1)))::BIGINT AS own FROM p),
r AS (SELECT doc_id, CASE WHEN length(v) + length(s) > 1900 AND length(v) > own THEN {_cut_sql('v', 'greatest(60, own // 4)')} ELSE v END AS v, CASE WHEN length(v) + length(s) > 1900 AND length(s) > 1900 - own THEN {_cut_sql('s', 'greatest(70, floor((1900 - own) / 4))')} ELSE s END AS s FROM q),
t AS (SELECT *, greatest(1, 2 * length(v) // 7) AS a, greatest(1, 2 * length(s) // 7) AS b FROM r),
u AS (SELECT *, greatest(65, floor(300 * a / greatest(a + b, 1)))::BIGINT AS own FROM t)
SELECT doc_id, length(CASE WHEN a + b > 300 AND a > own THEN {_cut_sql('v', 'own')} ELSE v END) AS vuln, length(CASE WHEN a + b > 300 AND b > 300 - own THEN {_cut_sql('s', '300 - own')} ELSE s END) AS safe FROM u"""
)
def pair_fitted(spark, sf_dir):
    a = docs(spark, sf_dir).select("doc_id", F.col("text").alias("v"))
    b = docs(spark, sf_dir).select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("s"))
    both = a.join(b, "doc_id").filter(~F.contains(F.concat("v", "s"), F.lit("{")))
    return both.select("doc_id", L.fitted(F.col("v"), F.col("s"), 1900, 300).alias("x")).select("doc_id", F.length("x.vuln").cast("long").alias("vuln"), F.length("x.safe").cast("long").alias("safe"))


@query(f"SELECT count(*) AS n FROM (SELECT DISTINCT CASE WHEN len(t) < 4 THEN list_sort(list_distinct(t)) ELSE list_sort(list_distinct(list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], '|')))) END AS g FROM (SELECT regexp_extract_all(text, {TOKEN}) AS t FROM conversations UNION ALL SELECT regexp_extract_all(text, {TOKEN}) FROM benchmark)) WHERE len(g) > 0")
def known_prints(spark, sf_dir):
    old, new = (dedup.classes(table(spark, sf_dir, t), k, "text")[1] for t, k in (("conversations", "conv_id"), ("benchmark", "item_id")))
    return dedup.known_prints(old, new).agg(F.count("*").alias("n"))


# ---- scans, replies, repairs -------------------------------------------------------------


@query(
    """SELECT l_orderkey, l_linenumber, array_to_string(CASE WHEN len(inside) > 0 THEN list_transform(inside, lambda n: concat(n, '-', n)) ELSE [concat(s, '-', e)] END, ',') AS spans, CASE WHEN len(inside) > 0 THEN list_contains(inside, 5) ELSE 5 BETWEEN s AND e END AS hit
FROM (SELECT l_orderkey, l_linenumber, s, e, list_filter([s - 1, s + 2, e + 3], lambda n: n BETWEEN s AND e) AS inside FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity % 8 AS INTEGER) AS s, CAST(l_quantity % 8 + l_linenumber % 4 AS INTEGER) AS e FROM lineitem))"""
)
def finding_ranges(spark, sf_dir):
    s, n = (F.col("l_quantity") % 8).cast("int"), F.col("l_linenumber") % 4
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", s.alias("s"), (s + n).cast("int").alias("e"))
    rows = rows.withColumn("r", detect.ranges(F.col("s"), F.col("e"), F.array(F.col("s") - 1, F.col("s") + 2, F.col("e") + 3)))
    shown = F.array_join(F.transform("r", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    return rows.select("l_orderkey", "l_linenumber", shown.alias("spans"), detect.is_hit(F.lit(5), F.col("r")).alias("hit"))


@query(f"SELECT vec_id, label, CASE label {' '.join(f'WHEN {i} THEN {literal(f)}' for i, f in enumerate(rules.FAMILIES))} END AS family, CASE WHEN label < {len(rules.FAMILIES)} THEN label END AS back FROM embeddings")
def label_maps(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("family", F.try_element_at(detect.id_labels(), F.col("label")))
    return rows.select("vec_id", "label", "family", F.try_element_at(detect.label_ids(), F.col("family")).alias("back"))


def _length_model():
    return lambda texts: [((len(t) % 100) / 100, {"XSS": (len(t) % 10) / 10, "CSRF": 0.5}) for t in texts]


@query("SELECT doc_id, (length(text) % 100) / 100 AS vuln_score, CASE WHEN (length(text) % 10) / 10 >= 0.5 THEN 'XSS' ELSE 'CSRF' END AS family_label, greatest((length(text) % 10) / 10, 0.5) AS family_confidence FROM documents")
def model_scores(spark, sf_dir):
    scored = detect.labelled(detect.model_scorer(_length_model)(docs(spark, sf_dir).select("doc_id", "text")))
    return scored.select("doc_id", "vuln_score", "family_label", "family_confidence")


@query("SELECT g AS id, 64 AS n, 1 AS first, 64 * 7 + 1 AS last FROM range(1, 6) t(g)")
def sink_cap(spark, sf_dir):
    """Texts of 80 sinks, seven lines apart; the second is in the first one's bucket: 64 windows stay, the first in order."""
    line = F.concat(F.lit("eval(x)"), F.repeat(F.lit("\n"), 7))
    files = spark.range(1, 6).select("id", F.repeat(line, 80).alias("text"))
    return rules.sink_windows(files, "id", "text").groupBy("id").agg(F.count("*").alias("n"), F.min("sink_line").cast("long").alias("first"), F.max("sink_line").cast("long").alias("last"))


_DETAILS = ("Unsupported file type: exe", "the file is empty", "Failed to read file", "Message cannot be empty", "other")


@query(
    f"""SELECT event_id, CASE WHEN d IS NULL THEN NULL WHEN contains(d, 'Failed to read file') THEN 422 ELSE 400 END AS status,
CASE WHEN d IS NULL THEN NULL WHEN contains(d, 'Unsupported file type') THEN 'Unsupported file type.' WHEN contains(d, 'empty') THEN 'Uploaded file is empty.' WHEN contains(d, 'Failed to read file') THEN 'File could not be decoded as UTF-8.' ELSE 'AI agent rejected the request.' END AS message
FROM (SELECT event_id, ([{', '.join(map(literal, _DETAILS))}])[event_id % 6 + 1] AS d FROM events)"""
)
def error_routes(spark, sf_dir):
    detail = F.get(F.array(*map(F.lit, _DETAILS)), (F.col("event_id") % 6).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", T.error_route(detail).alias("r")).select("event_id", "r.status", "r.message")


_REPLIES = (
    ('{"status": "repaired", "replacement_code": "x", "imports": [], "explanation": "e"}', "ok"),
    ("not json", "not an object"),
    ("[1]", "not an object"),
    ('{"status": "repaired", "replacement_code": "x", "imports": []}', "missing fields"),
    ('{"status": "repaired", "replacement_code": "x", "imports": [], "explanation": "e", "more": 1}', "extra fields"),
    ('{"status": "done", "replacement_code": "x", "imports": [], "explanation": "e"}', "bad status"),
    ('{"status": "repaired", "replacement_code": "x", "imports": "os", "explanation": "e"}', "bad imports"),
    ('{"status": "repaired", "replacement_code": " ", "imports": [], "explanation": "e"}', "no code"),
    ('{"status": "needs_context", "replacement_code": "x", "imports": [], "explanation": "e"}', "code without repair"),
    ('{"status": "needs_context", "replacement_code": "", "imports": [], "explanation": "e"}', "ok"),
)


@query(f"SELECT event_id, ([{', '.join(literal(r) for _, r in _REPLIES)}])[event_id % {len(_REPLIES)} + 1] AS reason FROM events")
def reply_checks(spark, sf_dir):
    raw = F.get(F.array(*(F.lit(r) for r, _ in _REPLIES)), (F.col("event_id") % len(_REPLIES)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(gates.reply_gate(raw), F.lit("ok")).alias("reason"))


@query(
    """WITH r AS (SELECT l_orderkey AS o, l_returnflag AS phase, l_linenumber AS attempt, CASE WHEN l_quantity > 45 THEN 'needs_context' ELSE 'repaired' END AS status, CASE WHEN l_discount > 0.05 THEN 'bad' END AS reason FROM lineitem),
a AS (SELECT *, min(attempt) FILTER (status = 'needs_context') OVER (PARTITION BY o, phase) AS asked FROM r),
g AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY phase, attempt) AS k FROM a WHERE (asked IS NULL OR attempt <= asked) AND reason IS NULL AND status <> 'needs_context')
SELECT o, phase, attempt FROM g WHERE k = 1"""
)
def reply_cascade(spark, sf_dir):
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("o"), c("l_returnflag").alias("phase"), c("l_linenumber").alias("attempt"), F.when(c("l_quantity") > 45, "needs_context").otherwise("repaired").alias("status"), F.when(c("l_discount") > 0.05, "bad").alias("reason"))
    return chat.cascade(rows, ["o"], "reason").select("o", "phase", "attempt")


@query("SELECT doc_id, contains(trim(regexp_replace(text, '\\s+', ' ', 'g')), trim(regexp_replace(substring(text, 5, 30), '\\s+', ' ', 'g'))) AS intact FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, false FROM documents WHERE doc_id % 3 = 0")
def repair_intact(spark, sf_dir):
    code = F.when(F.col("doc_id") % 3 == 0, "no text of documents holds this").otherwise(F.regexp_replace(F.substring("text", 5, 30), " ", "\n  "))
    return docs(spark, sf_dir).select("doc_id", repair.intact(F.col("text"), code).alias("intact"))


_PY = "import os\n\ndef f(a):\n    return os.system(a)\n\ndef g(b):\n    return eval(b)"


@query(
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS applied, CASE doc_id % 4 "
    + f"WHEN 0 THEN {literal(_PY.replace('import os', 'import os' + chr(10) + 'import ast').replace('os.system(a)', 'a').replace('eval(b)', 'ast.literal_eval(b)'))} "
    + f"WHEN 1 THEN {literal(_PY.replace('os.system(a)', 'a'))} WHEN 2 THEN {literal(_PY.replace('os.system(a)', 'a').replace('eval(b)', 'ast.literal_eval(b)'))} ELSE {literal(_PY)} END AS repaired FROM documents"
)
def validated_fold(spark, sf_dir):
    """Of two patches: both fit; one breaks the syntax; the import of one breaks it, so it goes and its patch doesn't count; both break it."""
    files = docs(spark, sf_dir).select("doc_id", F.lit(_PY).alias("code"))
    kind = F.col("doc_id") % 4
    first = F.struct(F.lit(4).alias("start"), F.lit(4).alias("end"), F.when(kind == 3, "return (").otherwise("    return a").alias("code"), F.array().cast("array<string>").alias("imports"))
    broken, good = F.array(F.lit("import (")), F.array(F.lit("import ast"))
    second = F.struct(F.lit(7).alias("start"), F.lit(7).alias("end"), F.when(kind.isin(1, 3), "return (").otherwise("    return ast.literal_eval(b)").alias("code"), F.when(kind == 2, broken).otherwise(good).alias("imports"))
    patches = files.select("doc_id", F.explode(F.array(first, second)).alias("p")).select("doc_id", "p.*")
    out = repair.patched_files(files, patches, "doc_id", "code", "py", repair.parses)
    return out.select("doc_id", F.col("applied").cast("long").alias("applied"), "repaired")


# ---- dates -------------------------------------------------------------------------------


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS shown, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS expires FROM events")
def dates_shown(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", dates.shown(F.col("ts")).alias("shown"), F.date_format(dates.expiry(F.col("ts")), "yyyy-MM-dd HH:mm:ss").alias("expires"))


@query("SELECT user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000, 2) AS seconds FROM events GROUP BY user_id")
def elapsed_seconds(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(dates.elapsed(F.min("ts"), F.max("ts")).alias("seconds"))


@query("SELECT count(*) AS n FROM events WHERE ts < now()::TIMESTAMP")
def before_now(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(F.col("ts") < dates.now()).agg(F.count("*").alias("n"))


# ---- files -------------------------------------------------------------------------------


def _pairs(spark, sf_dir):
    c = F.col
    return docs(spark, sf_dir).select(c("text").alias("vuln_code"), F.when(c("doc_id") % 2 == 0, "Path_Traversal").otherwise("XSS").alias("state"), c("source").alias("safe_code"), F.lit("Safe").alias("safe_code_label"))


@query("SELECT md5(text) AS vuln, CASE WHEN doc_id % 2 = 0 THEN 'Path_Traversal' ELSE 'XSS' END AS state, source AS safe_code FROM documents")
def jsonl_round_trip(spark, sf_dir):
    """Pairs written without their internal columns and read back strictly."""
    at = folder(spark)
    io.write_jsonl(io.export(_pairs(spark, sf_dir).withColumn("_lang", F.lit("py"))), at)
    return io.read_jsonl(spark, at).select(F.md5(F.col("vuln_code").cast("binary")).alias("vuln"), "state", "safe_code")


@query("SELECT doc_id AS id, CAST(doc_id % 9 AS VARCHAR) AS _sub_key FROM documents WHERE doc_id % 10 <> 0")
def checkpoint_resume(spark, sf_dir):
    """A checkpoint of which every tenth line is broken, and one that isn't there."""
    at = folder(spark)
    line = F.when(F.col("doc_id") % 10 == 0, '{"vuln_code": "x').otherwise(F.to_json(F.struct(F.col("doc_id").cast("string").alias("vuln_code"), (F.col("doc_id") % 9).cast("string").alias("_sub_key"))))
    docs(spark, sf_dir).select(line.alias("value")).write.text(at)
    both = io.read_checkpoint(spark, at).unionByName(io.read_checkpoint(spark, at + "-missing"))
    return both.select(F.col("vuln_code").cast("long").alias("id"), "_sub_key")


@query("SELECT CASE WHEN page_id % 3 = 0 THEN 'a' ELSE 'page' END || page_id || '.html' AS filename, CASE WHEN page_id % 4 = 0 THEN md5(chr(65533) || html) ELSE md5(html) END AS digest FROM pages WHERE page_id % 5 <> 0 AND page_id % 7 <> 0")
def uploads(spark, sf_dir):
    """Pages as uploaded files: some of an unknown kind, some blank, some with a broken byte."""
    c = F.col
    ending = F.when(c("page_id") % 5 == 0, ".exe").otherwise(".HTML".lower())
    name = F.concat(F.lit("/in/"), F.when(c("page_id") % 3 == 0, "a").otherwise("page"), c("page_id"), ending)
    raw = F.when(c("page_id") % 7 == 0, F.lit(" \n").cast("binary")).when(c("page_id") % 4 == 0, F.concat(F.unhex(F.lit("FF")), c("html").cast("binary"))).otherwise(c("html").cast("binary"))
    return io.uploads(table(spark, sf_dir, "pages").select(name.alias("path"), raw.alias("content"))).select("filename", F.md5(c("content").cast("binary")).alias("digest"))


@query("SELECT 1 AS found, 1 AS missing")
def file_bytes(spark, sf_dir):
    at = folder(spark)
    spark.range(1).select(F.lit("kept").alias("value")).coalesce(1).write.text(at)
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(at).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    paths = there.unionByName(spark.createDataFrame([("/not/there",)], "path string"))
    rows = io.file_contents(paths, "path", spark, at)
    return rows.agg(F.count_if(F.col("content") == F.lit("kept\n").cast("binary")).cast("int").alias("found"), F.count_if(F.col("content").isNull()).cast("int").alias("missing"))


@query("SELECT concat(event_type, '.jsonl') AS filename, count(*) FILTER (event_id % 50 <> 0) AS n, count(*) FILTER (event_id % 50 = 0) AS errors FROM events GROUP BY 1")
def file_errors(spark, sf_dir):
    """Files of one event a line, every fiftieth of which is cut."""
    line = F.when(F.col("event_id") % 50 == 0, F.lit('{"k": 1')).otherwise(F.col("props"))
    files = table(spark, sf_dir, "events").groupBy(F.concat("event_type", F.lit(".jsonl")).alias("filename")).agg(F.array_join(F.collect_list(line), "\n").alias("content"))
    from pyspark.sql import types as S

    rows, errors = io.ingested(files, S.StructType([S.StructField("k", S.IntegerType())]))
    good, bad = rows.groupBy("filename").agg(F.count("*").alias("n")), errors.groupBy("filename").agg(F.count("*").alias("errors"))
    return files.select("filename").join(good, "filename", "left").join(bad, "filename", "left").fillna(0, ["n", "errors"])


@query("SELECT text AS code, label, doc_id AS pair_id, CASE WHEN doc_id % 2 = 0 THEN 'Path Traversal' ELSE 'XSS' END AS family FROM (SELECT doc_id, md5(text) AS text, 'Vulnerable' AS label FROM documents UNION ALL SELECT doc_id, md5(source), 'Safe' FROM documents)")
def training_rows(spark, sf_dir):
    keyed = docs(spark, sf_dir).select(F.col("doc_id").alias("pair_id"), F.md5(F.col("text").cast("binary")).alias("vuln_code"), F.when(F.col("doc_id") % 2 == 0, "Path_Traversal").otherwise("XSS").alias("state"), F.md5(F.col("source").cast("binary")).alias("safe_code"))
    return io.training_rows(keyed)


@query("SELECT count(*) AS n, round(avg(n_chars), 4) AS mean FROM documents")
def metrics_file(spark, sf_dir):
    at = folder(spark)
    io.write_metrics(docs(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean")), at)
    return spark.read.schema("n long, mean double").json(at)


@query("SELECT (SELECT count(*) FROM orders) AS sessions, (SELECT count(*) FROM lineitem) AS results")
def ingest_graph(spark, sf_dir):
    """Two committed ingests, and a third whose commit never came."""
    at, orders, lines = folder(spark), table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    for k in (0, 1):
        io.write_graph(at, sessions=orders.filter(F.col("o_orderkey") % 2 == k), results=lines.filter(F.col("l_orderkey") % 2 == k))
    orders.limit(5).write.parquet(f"{at}/sessions/ingest=lost")
    counts = [io.read_graph(spark, at, name).agg(F.count("*").alias(name)) for name in ("sessions", "results")]
    return counts[0].crossJoin(counts[1])  # one row each


@query("SELECT l_orderkey, concat('Report', chr(10), string_agg(printf('XSS (%d%%) lines %d-%d [%d, %d]', CAST(round(100 * l_discount) AS INTEGER), l_linenumber, l_linenumber + 3, l_linenumber, l_linenumber + 1), chr(10) ORDER BY l_linenumber, l_discount)) AS report FROM lineitem GROUP BY l_orderkey")
def report_lines(spark, sf_dir):
    c = F.col
    item = F.struct(c("l_linenumber").alias("start_line"), (c("l_linenumber") + 3).alias("end_line"), F.lit("XSS").alias("label"), c("l_discount").alias("confidence"), F.array(c("l_linenumber"), c("l_linenumber") + 1).alias("vuln_lines"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("f"))
    return rows.select("l_orderkey", relational.report_text(F.lit("Report"), F.col("f")).alias("report"))


_ENV = {"GEN_TARGET": "900", "GEN_CHARS_PER_TOKEN": "3.25", "GEN_UNKNOWN": "x", "KEY": "a, b,", "KEY_2": "c", "KEY_3": "a"}


@query("SELECT 900 AS target, 509 AS token_budget, 3.25::DOUBLE AS chars_per_token, 'a,b,c' AS keys")
def settings_read(spark, sf_dir):
    s = io.Settings.from_environment(_ENV)
    return spark.createDataFrame([(s.target, s.token_budget, s.chars_per_token, ",".join(io.keys_of(_ENV, "KEY")))], "target int, token_budget int, chars_per_token double, keys string")


_KEPT = values([("XSS", 3), ("CSRF", 3), ("Safe", 1)], "VulnName", "Severity")


@query(f'SELECT "VulnName", CASE "Severity" WHEN 3 THEN \'High\' ELSE \'Low\' END AS name FROM {_KEPT}')
def severity_names(spark, sf_dir):
    return relational.vuln_types(spark).filter(F.col("VulnName").isin("XSS", "CSRF", "Safe")).select("VulnName", relational.severity_name(F.col("Severity")).alias("name"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey = 7 AND o_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = 7)")
def owned_chat(spark, sf_dir):
    chats = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("Id"), F.col("o_custkey").alias("UserId"))
    owner = chats.filter("Id = 7").select("UserId")
    both = relational.owned(chats.join(F.broadcast(owner.withColumnRenamed("UserId", "owner")), F.col("owner") == F.col("UserId")), 7, F.col("owner"))
    return both.select(F.col("Id").alias("o_orderkey"))
