"""Queries over labels, findings, sessions, conversations and intervals.

Stand-ins: customer, orders and lineitem for users, chats and sessions with
findings; events for sends; embeddings for logits.
"""

from pyspark.sql import functions as F

from codequarry.functions import text as T
from codequarry.operators import chat, detect, intervals, metrics, relational, specs
from codequarry.operators.state import folder
from codequarry.plans import registry
from codequarry.plans.registry import literal, query, table, values
from codequarry.plans.text_queries import strip_sql
from codequarry.streaming import streams


def labels(spark, sf_dir):
    """doc_id, truth (quality), predicted (long texts), lang."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "lang", F.col("quality").alias("truth"), (F.col("n_chars") > 1500).cast("int").alias("predicted"))


_LABELS = "(SELECT l.doc_id, d.lang, l.quality AS truth, CAST(d.n_chars > 1500 AS INTEGER) AS predicted FROM labels l JOIN documents d USING (doc_id))"


@query("SELECT lang AS label, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM documents GROUP BY lang")
def label_dist(spark, sf_dir):
    return metrics.distribution(table(spark, sf_dir, "documents"), "lang")


_DOMAIN = [("de",), ("en",), ("es",), ("fr",), ("it",)]


@query(f"SELECT t.label, count(d.doc_id) AS n, repeat('#', CAST(count(d.doc_id) // 50 AS INTEGER)) AS bar FROM {values(_DOMAIN, 'label')} LEFT JOIN documents d ON d.lang = t.label GROUP BY t.label")
def label_dist_domain(spark, sf_dir):
    return metrics.distribution_over(table(spark, sf_dir, "documents"), "lang", spark.createDataFrame(_DOMAIN, "label string"))


@query("SELECT lang AS label, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM documents GROUP BY lang")
def class_weights(spark, sf_dir):
    return metrics.class_weights(table(spark, sf_dir, "documents"), "lang")


@query(f"SELECT truth AS label, count(*) FILTER (predicted = 0) AS pred_0, count(*) FILTER (predicted = 1) AS pred_1 FROM {_LABELS} GROUP BY truth")
def confusion(spark, sf_dir):
    return metrics.confusion(labels(spark, sf_dir), "truth", "predicted", [0, 1])


_PRF = f"""c AS (SELECT t.label, count(*) FILTER (truth = t.label AND predicted = t.label) AS tp, count(*) FILTER (truth <> t.label AND predicted = t.label) AS fp, count(*) FILTER (truth = t.label AND predicted <> t.label) AS fn FROM {_LABELS}, {values([(0,), (1,)], 'label')} GROUP BY t.label),
m AS (SELECT *, tp + fn AS support, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM c)"""


@query(f"WITH {_PRF} SELECT label, support, round(p, 6) AS prec, round(r, 6) AS recall, round(f1, 6) AS f1 FROM m")
def prf_per_class(spark, sf_dir):
    rows = metrics.per_class(labels(spark, sf_dir), "truth", "predicted", [0, 1])
    return rows.select("label", "support", F.round("precision", 6).alias("prec"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"))


@query(f"WITH {_PRF} SELECT round(sum(tp) / sum(support), 4) AS accuracy, round(avg(f1), 4) AS macro_f1, round(sum(f1 * support) / sum(support), 4) AS weighted_f1 FROM m")
def macro_weighted_f1(spark, sf_dir):
    return metrics.summary(labels(spark, sf_dir), "truth", "predicted", [0, 1])


@query(
    f"""SELECT lang, count(*) FILTER (truth = 1 AND predicted = 1) AS tp, count(*) FILTER (truth = 1 AND predicted <> 1) AS fn, count(*) FILTER (truth <> 1 AND predicted = 1) AS fp, count(*) FILTER (truth <> 1 AND predicted <> 1) AS tn,
round(CASE WHEN count(*) FILTER (truth = 1) = 0 THEN 0 ELSE count(*) FILTER (truth = 1 AND predicted = 1) / count(*) FILTER (truth = 1) END, 6) AS recall FROM {_LABELS} GROUP BY lang"""
)
def per_group_recall(spark, sf_dir):
    return metrics.group_recall(labels(spark, sf_dir), "lang", "truth", "predicted")


@query("SELECT CASE WHEN l_discount >= 0.085 THEN 'High' WHEN l_discount >= 0.07 THEN 'Medium' ELSE 'Low' END AS severity, count(*) AS n FROM lineitem GROUP BY 1")
def severity_hist(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_discount") >= 0.085, "High").when(F.col("l_discount") >= 0.07, "Medium").otherwise("Low").alias("severity"))
    return rows.groupBy("severity").agg(F.count("*").alias("n"))


@query("SELECT label, v, CASE WHEN v >= 0.85 THEN 'High' WHEN v >= 0.70 THEN 'Medium' ELSE 'Low' END AS severity FROM (SELECT label, round(list_max(embedding[1:8]), 6) AS v FROM embeddings)")
def severity_by_confidence(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.round(F.array_max(F.slice("embedding", 1, 8)), 6).alias("v"))
    return rows.withColumn("severity", metrics.severity(F.col("v")))


@query(f"SELECT count(*) FILTER (truth = 1) AS kept, count(*) FILTER (truth <> 1) AS skipped, 100 * count(*) FILTER (truth <> 1) // count(*) AS skip_percent FROM {_LABELS}")
def validate_funnel(spark, sf_dir):
    return metrics.funnel(labels(spark, sf_dir).withColumn("reason", F.when(F.col("truth") != 1, "low")), "reason")


@query("SELECT doc_id, CAST(floor(sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) / 10) AS BIGINT) AS tail FROM documents")
def tail_avg10(spark, sf_dir):
    return metrics.tail_average(table(spark, sf_dir, "documents"), "lang", "doc_id", "n_chars").select("doc_id", "tail")


@query("SELECT 'lang' AS axis, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def axis_counts(spark, sf_dir):
    return metrics.axis_counts(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 8")
def topk_counts(spark, sf_dir):
    return metrics.top_counts(table(spark, sf_dir, "part"), "p_brand", 8)


# ---- relational ---------------------------------------------------------------


@query("SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS pos FROM orders WHERE o_custkey = 7")
def chats_by_user_desc(spark, sf_dir):
    from pyspark.sql import Window

    mine = table(spark, sf_dir, "orders").filter("o_custkey = 7").select("o_orderkey", "o_orderdate")
    return mine.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("o_orderdate"), "o_orderkey")).cast("long"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def chat_exists_semi(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


_TYPES = values([(i + 1, n, s) for i, (n, s) in enumerate(relational.VULN_TYPES)], "id", "name", "severity")
_SEVERITY = "CASE t.severity WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'High' ELSE 'Critical' END"


def _sessions(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("Id"), (F.col("o_orderstatus") == "F").alias("Status"), F.col("o_orderdate").alias("CreatedAt"), F.concat(F.lit("file"), F.col("o_orderkey")).alias("FileName"))


def _results(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter("l_discount >= 0.05")
    return rows.select(F.col("l_linenumber").alias("Id"), F.col("l_orderkey").alias("ScanId"), (F.pmod("l_partkey", F.lit(9)) + 1).cast("int").alias("VulnTypeId"), F.col("l_quantity").cast("long").alias("StartLine"))


@query(
    f"""WITH r AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || t.name || ':' || {_SEVERITY} || ':' || CAST(l_quantity AS BIGINT), ',' ORDER BY l_linenumber, t.name, l_quantity) AS f FROM lineitem JOIN {_TYPES} ON t.id = l_partkey % 9 + 1 WHERE l_discount >= 0.05 GROUP BY 1)
SELECT o_orderkey AS "Id", CASE WHEN o_orderstatus = 'F' THEN 'Vulnerable' ELSE 'Safe' END AS "Status", c.c_name AS "Report", coalesce(r.f, '') AS "Findings"
FROM orders LEFT JOIN r ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c_custkey = o_orderkey"""
)
def session_tree_left_join(spark, sf_dir):
    reports = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("ScanId"), F.col("c_name").alias("Report"))
    types = relational.vuln_types(spark)
    tree = relational.session_tree(_sessions(spark, sf_dir), reports, _results(spark, sf_dir), types)
    text = F.array_join(F.transform("Findings", lambda x: F.concat_ws(":", x["Id"].cast("string"), x["VulnName"], x["SeverityName"], x["StartLine"].cast("string"))), ",")
    return tree.select("Id", "Status", "Report", F.coalesce(text, F.lit("")).alias("Findings"))


@query("SELECT n.n_name AS label, count(*) AS n FROM supplier JOIN nation n ON n_nationkey = s_nationkey WHERE n.n_regionkey IN (1, 2) GROUP BY 1")
def dim_lookup_inner(spark, sf_dir):
    types = table(spark, sf_dir, "nation").filter("n_regionkey in (1, 2)").select(F.col("n_nationkey").alias("Id"), F.col("n_name").alias("VulnName"))
    found = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("label")), "s_nationkey")
    kept = relational.ingest(found, types)
    return kept.join(types, kept["VulnTypeId"] == types["Id"]).groupBy(F.col("VulnName").alias("label")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey NOT IN (1, 2)")
def dim_lookup_rejected(spark, sf_dir):
    types = table(spark, sf_dir, "nation").filter("n_regionkey in (1, 2)").select(F.col("n_name").alias("VulnName"))
    found = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("label")), "s_nationkey")
    return relational.rejected(found, types).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 AND c_nationkey = 5 THEN 'renamed' ELSE c_name END AS c_name FROM customer")
def update_rename(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return relational.updated(c, (F.col("c_custkey") % 10 == 3) & (F.col("c_nationkey") == 5), c_name="renamed").select("c_custkey", "c_name")


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 = 0 AND c_acctbal > 0 THEN 'new' END, c_mktsegment) AS c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE c_nationkey END AS c_nationkey FROM customer")
def coalesce_update(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    delta = table(spark, sf_dir, "customer").filter("c_custkey % 4 = 0").select("c_custkey", F.when(F.col("c_acctbal") > 0, "new").alias("c_mktsegment"), F.lit(1).alias("c_nationkey"))
    return relational.coalesced_update(c, delta, "c_custkey")


@query(
    """SELECT 'orders' AS t, count(*) AS n FROM orders WHERE o_custkey % 50 <> 1
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 50 = 1)"""
)
def cascade_delete_anti(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").filter("c_custkey % 50 = 1").select(F.col("c_custkey").alias("id"))
    o, li = relational.cascade_delete(gone, (table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey"), (table(spark, sf_dir, "lineitem"), "l_linenumber", "l_orderkey"))
    return o.agg(F.count("*").alias("n")).select(F.lit("orders").alias("t"), "n").unionByName(li.agg(F.count("*").alias("n")).select(F.lit("lineitem").alias("t"), "n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey + 1000000, c_name FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 = 0")
def unique_email_anti(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    old = c.filter("c_custkey % 2 = 0")
    new = c.filter("c_custkey % 3 = 0").withColumn("c_custkey", F.col("c_custkey") + 1000000)
    return relational.insert_unique(old, new, "c_name")


@query(
    """SELECT o_orderkey AS "Id", 0 AS idx, 'user' AS role, 'file' || o_orderkey AS text FROM orders UNION ALL
SELECT o_orderkey, 1, 'bot', CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END FROM orders"""
)
def timeline_union(spark, sf_dir):
    rows = _sessions(spark, sf_dir).withColumn("Status", F.col("Status").cast("string"))
    return relational.timeline(rows).select("Id", "idx", "role", "text")


# ---- intervals: lineitem's lines as [partkey % 97, + quantity] ------------------


def spans(spark, sf_dir):
    start = (F.col("l_partkey") % 97).cast("long")
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem")
    return rows.select((F.col("l_orderkey") % 2000).alias("file"), F.col("l_returnflag").alias("family"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), F.col("l_discount").alias("confidence"), seq.alias("seq"))


_SPANS = """s AS (SELECT l_orderkey % 2000 AS file, l_returnflag AS family, l_partkey % 97 AS start, l_partkey % 97 + CAST(l_quantity AS BIGINT) AS stop, l_discount AS confidence, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)"""


@query(
    f"""WITH {_SPANS}, a AS (SELECT *, max(stop) OVER (PARTITION BY file, family ORDER BY start, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY file, family ORDER BY start, seq) AS island FROM a)
SELECT file, family, min(start) AS start, max(stop) AS "end", max(confidence) AS confidence, arg_min(seq, (start, seq)) AS seq FROM b GROUP BY file, family, island"""
)
def merge_intervals(spark, sf_dir):
    return intervals.merged(spans(spark, sf_dir), ["file", "family"], 5).select("file", "family", "start", "end", "confidence", "seq")


@query(f"WITH {_SPANS} SELECT a.file, a.family, a.seq AS a, b.seq AS b FROM s a JOIN s b ON a.file = b.file AND a.family = b.family AND a.seq < b.seq AND least(a.stop, b.stop) - greatest(a.start, b.start) > 0")
def overlap_pairs(spark, sf_dir):
    return intervals.overlapping(spans(spark, sf_dir), ["file", "family"])


@query(
    f"""WITH {_SPANS}, p AS (SELECT seq AS id, file, start + 2 AS lo, start + 4 AS hi FROM s WHERE family = 'A')
SELECT p.file, p.id, p.lo, p.hi, arg_min(r.start, (r.stop - r.start, r.start)) AS start, arg_min(r.stop, (r.stop - r.start, r.start)) AS "end" FROM p JOIN s r ON r.file = p.file AND r.family <> 'A' AND r.start <= p.lo AND r.stop >= p.hi GROUP BY 1, 2, 3, 4"""
)
def enclosing_interval(spark, sf_dir):
    s = spans(spark, sf_dir)
    points = s.filter("family = 'A'").select(F.col("seq").alias("id"), "file", (F.col("start") + 2).alias("lo"), (F.col("start") + 4).alias("hi"))
    return intervals.smallest_enclosing(points, s.filter("family <> 'A'"), ["file"])


@query(
    f"""WITH {_SPANS}, p AS (SELECT file, start, stop, seq, seq AS pos, family = 'R' AS success FROM s)
SELECT file, seq FROM p a WHERE EXISTS (SELECT 1 FROM p b WHERE b.success AND a.file = b.file AND b.pos > a.pos AND greatest(a.start, b.start) <= least(a.stop, b.stop))"""
)
def superseded_regions(spark, sf_dir):
    s = spans(spark, sf_dir).withColumns({"pos": F.col("seq"), "success": F.col("family") == "R"})
    return intervals.superseded(s, ["file"]).select("file", "seq")


_L = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"


@query(
    f"""WITH l AS {_L}, a AS (SELECT doc_id, i, t FROM l WHERE i % 4 = 0)
SELECT a.doc_id, a.i AS id, a.i + 3 AS old, min(l.i) AS "new" FROM a JOIN l ON l.doc_id = a.doc_id AND l.t = a.t AND abs(a.i + 3 - l.i) <= 15 GROUP BY 1, 2, 3 HAVING count(*) = 1"""
)
def relocate_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text"))
    lines = rows.select("doc_id", (F.col("p") + 1).cast("long").alias("line"), "text")
    anchors = lines.filter("line % 4 = 0").select("doc_id", F.col("line").alias("id"), (F.col("line") + 3).alias("line"), "text")
    return intervals.relocated(anchors, lines, ["doc_id"])


# ---- scores ---------------------------------------------------------------------


_NAMES = "[" + ", ".join(literal(f) for f in detect.rules.FAMILIES) + "]"
_SOFT = f"""e AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
p AS (SELECT vec_id, list_transform(v, lambda x: exp(x - list_max(v))) AS w FROM e),
q AS (SELECT vec_id, list_transform(w, lambda x: x / list_sum(w)) AS p FROM p),
f AS (SELECT vec_id, p, {_NAMES}[list_position(p, list_max(p))] AS label, list_max(p) AS confidence FROM q)"""


def _scored(spark, sf_dir):
    v = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", detect.scores_map(v).alias("family_scores")).drop("label")


@query(f"WITH {_SOFT} SELECT vec_id, label, round(confidence, 6) AS confidence FROM f")
def softmax_argmax(spark, sf_dir):
    out = detect.labelled(_scored(spark, sf_dir))
    return out.select("vec_id", F.col("family_label").alias("label"), F.round("family_confidence", 6).alias("confidence"))


@query(f"WITH {_SOFT} SELECT vec_id, label FROM f WHERE vec_id % 7 = 0 OR confidence >= 0.5")
def cascade_filter(spark, sf_dir):
    out = detect.labelled(_scored(spark, sf_dir)).withColumn("detection_source", F.when(F.col("vec_id") % 7 == 0, "sink_rescue").otherwise("sliding"))
    return detect.above_floor(out).select("vec_id", F.col("family_label").alias("label"))


@query(f"WITH {_SOFT} SELECT vec_id, 'XSS' AS label, round(p[8], 6) AS confidence FROM f WHERE vec_id % 3 = 0 AND p[8] >= 0.08")
def rescue_floor(spark, sf_dir):
    hint = F.when(F.col("vec_id") % 3 == 0, "XSS").when(F.col("vec_id") % 3 == 1, "").otherwise("none")
    out = detect.rescued(_scored(spark, sf_dir).withColumn("hint_family", hint))
    return out.select("vec_id", F.col("family_label").alias("label"), F.round("family_confidence", 6).alias("confidence"))


# ---- specifications -----------------------------------------------------------


@query("SELECT n_name, r_name, b.p_brand FROM nation, region, (SELECT DISTINCT p_brand FROM part) b")
def spec_cross(spark, sf_dir):
    return specs.cells(table(spark, sf_dir, "nation").select("n_name"), table(spark, sf_dir, "region").select("r_name"), table(spark, sf_dir, "part").select("p_brand").distinct())


@query(
    """SELECT n_name, r_name, p_brand FROM (SELECT n_name, r_name, p_brand, row_number() OVER (PARTITION BY n_name, r_name ORDER BY md5(n_name || '|' || r_name || '|' || p_brand || '|0'), p_brand) AS k
FROM nation, region, (SELECT DISTINCT p_brand FROM part) b) WHERE k <= 2"""
)
def spec_sample2(spark, sf_dir):
    c = specs.cells(table(spark, sf_dir, "nation").select("n_name"), table(spark, sf_dir, "region").select("r_name"))
    return specs.sampled(c, table(spark, sf_dir, "part").select("p_brand").distinct(), ["n_name", "r_name"], "p_brand")


@query("SELECT p_type AS subtype, p_brand AS lang FROM part WHERE NOT (contains(p_type, 'BRASS') AND p_brand NOT IN ('Brand#11', 'Brand#23')) AND NOT (contains(p_type, 'TIN') AND p_brand NOT IN ('Brand#55'))")
def spec_whitelist_anti(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("subtype"), F.col("p_brand").alias("lang"))
    white = spark.createDataFrame([("BRASS", ["Brand#11", "Brand#23"]), ("TIN", ["Brand#55"])], "key string, langs array<string>")
    return specs.allowed(p, white)


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k <= 40")
def batch_quota(spark, sf_dir):
    return specs.batch_quota(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 40)


@query("SELECT doc_id, md5(doc_id || '|0') AS mark FROM documents")
def shuffle_order(spark, sf_dir):
    return specs.shuffled(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"]).withColumn("mark", F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit("0")).cast("binary")))


# ---- conversations --------------------------------------------------------------


def _history_sql(n):
    return f"SELECT conv_id, turn, role, text FROM (SELECT conv_id, turn, role, {strip_sql('text')} AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role IN ('user', 'assistant') AND {strip_sql('text')} <> '') WHERE k <= {n}"


@query(_history_sql(20))
def history_last20(spark, sf_dir):
    return chat.history(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "text")


@query(_history_sql(3))
def history_last3(spark, sf_dir):
    return chat.history(table(spark, sf_dir, "conversations"), most=3).select("conv_id", "turn", "role", "text")


_TITLE_TEXT = "regexp_replace(coalesce(nullif({topic}, ''), nullif({first}, ''), 'Untitled_Chat'), '{space}+', ' ', 'g')"
_TITLE = strip_sql(_TITLE_TEXT.format(topic=strip_sql(f"regexp_extract(text, {literal(T.TOPIC)}, 1)"), first=strip_sql("regexp_replace(regexp_extract(text, '^[^.\\n]*', 0), '(?i)^(analysis|scan|result|neural engine)[:\\s]*', '')"), space=T.SPACE))


@query(f"SELECT conv_id, turn, CASE WHEN length(t) > 48 THEN {strip_sql('left(t, 48)')} || '…' ELSE t END AS title FROM (SELECT conv_id, turn, {_TITLE} AS t FROM conversations)")
def title_derive(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.chat_title(F.lit(None).cast("string"), F.col("text"), F.lit(None).cast("string")).alias("title"))


# ---- JSON ------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_int(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT event_id, len(list_filter(['k', 'status'], lambda x: NOT list_contains(json_keys(props), x))) AS missing, len(list_filter(json_keys(props), lambda x: NOT list_contains(['k', 'status'], x))) AS extra FROM events")
def json_keys_diff(spark, sf_dir):
    keys, known = F.json_object_keys("props"), F.array(F.lit("k"), F.lit("status"))
    return table(spark, sf_dir, "events").select("event_id", F.size(F.array_except(known, keys)).cast("long").alias("missing"), F.size(F.array_except(keys, known)).cast("long").alias("extra"))


@query("SELECT event_type, CASE WHEN event_type = 'click' THEN 200 WHEN event_type = 'view' THEN 200 WHEN event_type IS NULL THEN 400 ELSE 502 END AS code, count(*) AS n FROM events GROUP BY 1, 2")
def json_route(spark, sf_dir):
    code = F.when(F.col("event_type").isin("click", "view"), 200).when(F.col("event_type").isNull(), 400).otherwise(502)
    return table(spark, sf_dir, "events").groupBy("event_type", code.alias("code")).agg(F.count("*").alias("n"))


# ---- streams: the batch form, and the stream itself over the same rows -------------


def _sends(df):
    return df.select("user_id", "event_id", (F.col("value") >= 20).alias("ok"))


@query(
    """WITH s AS (SELECT user_id, event_id, value >= 20 AS ok, max(CASE WHEN value >= 20 THEN event_id END) OVER (PARTITION BY user_id) AS last FROM events)
SELECT user_id, event_id, CASE WHEN ok THEN 'sent' ELSE 'queued' END AS outcome FROM s UNION ALL SELECT user_id, event_id, 'flushed' FROM s WHERE NOT ok AND last > event_id"""
)
def retry_batch(spark, sf_dir):
    return streams.retry_batch(_sends(table(spark, sf_dir, "events")))


@query(registry.SQL["retry_batch"])
def stream_retry(spark, sf_dir):
    """The same by the stateful stream, one key's events in the order of a batch."""
    at = folder(spark)
    return streams.run_to_files(streams.retry_queue(_sends(streams.table_stream(spark, sf_dir, "events"))), f"{at}/out", f"{at}/checkpoint")


@query(f"SELECT doc_id FROM ({registry.SQL['near_dup_greedy']}) WHERE accepted")
def stream_dedup(spark, sf_dir):
    """Near-duplicate acceptance in micro-batches of files; a table of one file is one batch."""
    at = folder(spark)
    stream = streams.table_stream(spark, sf_dir, "documents").select("doc_id", "text")
    streams.accept_batches(stream, f"{at}/out", f"{at}/checkpoint", "doc_id", "text")
    return spark.read.parquet(f"{at}/out").select("doc_id")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def running_counts(spark, sf_dir):
    return streams.running_counts(table(spark, sf_dir, "events"), "event_type")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def latest_request(spark, sf_dir):
    return streams.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")
