"""Queries over the code corpus: confirmation, localization, gates, scans, patches, streams."""

from pyspark.sql import functions as F

from codequarry.functions import lines as L
from codequarry.operators import detect, gates, repair, rules
from codequarry.plans.corpus import PAIRS, SNIPPETS, WORD_RULES, snippets
from codequarry.plans.registry import literal, query, table, values

_S = values(SNIPPETS, "id", "family", "context", "code")


def _any(c, words):
    return "(" + " OR ".join(f"contains(lower({c}), {literal(w.lower())})" for w in words) + ")"


def _match(c, *patterns, flags=""):
    return "(" + " OR ".join(f"regexp_matches({c}, {literal(flags + p)})" for p in patterns) + ")"


# RE2 has no lookahead: (?!class) at the end is a character outside of it, or the end
_DYNAMIC = (r"""innerHTML\s*=\s*(?:[^'"`\s<]|\z)""", r"""outerHTML\s*=\s*(?:[^'"`\s<]|\z)""", r"""document\.write\s*\(\s*(?:[^'"`\s]|\z)|document\.write\s*\(\s""")
_SINKS = {"XSS": (r"""\b(?:innerHTML|outerHTML)\s*=(?:[^'"`]|\z)""", r"""\bdocument\.write\s*\((?:[^'"`]|\z)""", rules.SINKS["XSS"][2]), "Insecure Deserialization": rules.SINKS["Insecure Deserialization"]}


def _confirm_sql(family):
    hit = _any("code", rules.CONFIRMATION[family])
    if family == "XSS":
        hit += " AND " + _match("code", *_DYNAMIC)
    if family == "Insecure Cryptography":
        hit += " AND " + _match("lower(code)", rules.BROKEN_CRYPTO, *rules.NEAR_SECRET)
    return f"WHEN family = {literal(family)} THEN {hit}"


@query(f"SELECT id, CASE {' '.join(map(_confirm_sql, rules.CONFIRMATION))} ELSE true END AS kept FROM {_S}")
def keyword_confirm(spark, sf_dir):
    return snippets(spark).select("id", rules.confirmed(F.col("family"), F.col("code")).alias("kept"))


_FAMILY = "CASE doc_id % 3 WHEN 0 THEN 'XSS' WHEN 1 THEN 'SQL Injection' ELSE 'CSRF' END"


@query(f"SELECT doc_id, CASE {' '.join(f'WHEN {_FAMILY} = {literal(f)} THEN {_any("text", w)}' for f, w in WORD_RULES.items())} END AS kept FROM documents")
def keyword_confirm_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    family = F.when(F.col("doc_id") % 3 == 0, "XSS").when(F.col("doc_id") % 3 == 1, "SQL Injection").otherwise("CSRF")
    return d.select("doc_id", rules.confirmed(family, F.col("text"), WORD_RULES).alias("kept"))


def _hits_sql(words_by_family):
    return "CASE " + " ".join(f"WHEN family = {literal(f)} THEN list_filter(range(1, len(ln) + 1), lambda i: {_any('ln[i]', w)})" for f, w in words_by_family.items()) + " ELSE [] END"


@query(
    f"""WITH s AS (SELECT id, family, CASE WHEN p[-1] = '' THEN p[1:len(p) - 1] ELSE p END AS ln FROM (SELECT id, family, string_split(code, chr(10)) AS p FROM {_S})),
h AS (SELECT id, {_hits_sql(rules.LOCALIZATION)} AS a, {_hits_sql(rules.CONFIRMATION)} AS b FROM s)
SELECT id, array_to_string(CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b ELSE [1] END, ',') AS vuln_lines FROM h"""
)
def localize_lines(spark, sf_dir):
    end = F.size(L.split_lines(F.col("code")))
    return snippets(spark).select("id", F.array_join(rules.localized(F.col("family"), F.col("code"), F.lit(1), end).cast("array<string>"), ",").alias("vuln_lines"))


@query(
    f"""WITH l AS (SELECT id, unnest(p) AS x, generate_subscripts(p, 1) AS i, len(p) AS n FROM (SELECT id, CASE WHEN q[-1] = '' THEN q[1:len(q) - 1] ELSE q END AS p FROM (SELECT id, string_split(code, chr(10)) AS q FROM {_S}))),
c AS (SELECT *, regexp_replace(x, '//[^\\n]*$', '') AS y FROM l),
h AS ({" UNION ALL ".join(f"SELECT id, {literal(f)} AS hint_family, i, n FROM c WHERE {_match('y', *p, flags='(?i)')}" for f, p in _SINKS.items())}),
r AS (SELECT *, row_number() OVER (PARTITION BY id, hint_family, greatest(1, i // 7) ORDER BY i) AS k FROM h)
SELECT id, hint_family, i AS sink_line, greatest(1, i - 7) AS start_line, least(n, i + 7) AS end_line FROM r WHERE k = 1"""
)
def sink_windows(spark, sf_dir):
    rows = rules.sink_windows(snippets(spark), "id", "code")
    return rows.select("id", "hint_family", *(F.col(c).cast("long").alias(c) for c in ("sink_line", "start_line", "end_line")))


def _gate(name, column, sql):
    def run(spark, sf_dir):
        return snippets(spark).select("id", F.coalesce(column(), F.lit("ok")).alias("reason"))

    run.__name__ = name
    query(sql)(run)


def _case(*rules_):
    return "CASE " + " ".join(f"WHEN {c} THEN {literal(r)}" for c, r in rules_) + " ELSE 'ok' END"


def _select(expression):
    return f"SELECT id, {expression} AS reason FROM {_S}"


_XSS_SINK = (r"""\.innerHTML\s*=(?:[^'"`]|\z)""", r"""document\.write\s*\((?:[^'"`]|\z)""")
_SANITIZER = literal(gates.SANITIZER)
_gate("xss_gate", lambda: gates.xss_gate(F.col("code"), F.col("context")), _select(_case((f"{_match('code', *_XSS_SINK)} AND NOT regexp_matches(code, {_SANITIZER})", "unsafe sink"), (f"{_match('code', *_XSS_SINK)} AND NOT contains(context, regexp_extract(code, {_SANITIZER}, 1))", "unknown sanitizer"))))
_gate("cmd_gate", lambda: gates.command_gate(F.col("code")), _select(_case((_match("code", r"shell\s*=\s*True"), "shell"), (_match("code", r"os\.system\s*\(|popen\s*\("), "shell call"))))
_gate("deser_gate", lambda: gates.deserialization_gate(F.col("code")), _select(_case((_match("code", r"\beval\s*\(|\bpickle\.loads\s*\("), "unsafe call"), (_match("code", r"yaml\.load\s*\(") + " AND NOT contains(code, 'Loader=') AND NOT contains(code, 'safe_load')", "unsafe yaml"))))
_gate("xml_gate", lambda: gates.xml_gate(F.col("code")), _select(_case(("NOT " + _match("code", gates.XML_SAFE), "entities not disabled"))))
_CALLS = f"regexp_extract_all(code, {literal(gates.SQL_CALL)}, 1)"
_gate("sql_gate", lambda: gates.sql_gate(F.col("code")), _select(_case((f"{_match('code', gates.SQL_WORD)} AND {_match('code', *gates.SQL_JOINED)}", "concatenated"), (f"{_match('code', gates.SQL_BOUND)} AND len({_CALLS}) > 0 AND len(list_filter({_CALLS}, lambda x: contains(x, ','))) = 0", "unbound placeholder"))))
_VAR = f"regexp_extract(code, {literal(gates.PATH_VARIABLE)}, 1)"
_USED = f"regexp_extract_all(code, {literal(gates.PATH_SINK)}, 1)"
_gate(
    "path_gate",
    lambda: gates.path_gate(F.lit("fs.readFile(name)"), F.col("code")),
    _select(_case(("NOT " + _match("code", gates.PATH_RESOLVE), "no resolve"), ("NOT " + _match("code", gates.PATH_INSIDE), "no containment"), (_match("code", gates.PATH_PREFIX) + " AND NOT contains(code, 'path.relative(') AND NOT contains(code, 'os.path.commonpath')", "naive prefix"), (f"{_VAR} <> '' AND {_VAR} <> 'name' AND list_contains({_USED}, 'name')", "old variable used"))),
)
_QUALIFIED, _BARE = _match("code", gates.CRYPTO_QUALIFIED), f"regexp_extract(code, {literal(gates.CRYPTO_BARE)}, 1)"
_IMPORTED = _match("context", gates.CRYPTO_IMPORT)
_NAMED = f"list_contains(list_transform(string_split(regexp_extract(context, '\\{{([^}}]*)\\}}', 1), ','), lambda x: trim(x)), {_BARE})"
_gate(
    "crypto_gate",
    lambda: gates.crypto_gate(F.col("code"), F.lit(""), F.col("context")),
    _select(_case((_match("code", gates.WEAK_RANDOM), "Math.random"), (_match("code", gates.WEAK_CRYPTO), "weak primitive"), (f"NOT {_QUALIFIED} AND {_BARE} = '' AND NOT {_match('code', gates.CRYPTO_OTHER)}", "no secure source"), (f"{_QUALIFIED} AND NOT {_IMPORTED}", "no crypto import"), (f"NOT {_QUALIFIED} AND {_BARE} <> '' AND NOT ({_IMPORTED} AND {_NAMED})", "no named import"))),
)
_CONTROLLED = f"regexp_extract_all(code, {literal(gates.REQUEST_VARIABLE)}, 1)"
_A, _B = (f"regexp_extract_all(code, {literal(gates.COMPARISON)}, {k})" for k in (1, 3))


def _request(x):
    return f"(regexp_matches({x}, '^\\s*req\\.(headers|body|query|params|cookies)\\b') OR list_contains(controlled, regexp_extract({x}, '^([A-Za-z_]\\w*)', 1)))"


_FIELD = f"regexp_extract(code, {literal(gates.CSRF_SESSION)}, 1)"
_FIXED = f"regexp_extract(code, {literal(gates.ORIGIN_FIXED)}, 1)"
_TRUSTED = f"((regexp_matches(code, {literal(gates.MIDDLEWARE)}) AND contains(context, regexp_extract(code, {literal(gates.MIDDLEWARE)}, 1))) OR ({_FIELD} <> '' AND contains(context, {_FIELD})) OR ({_match('code', gates.ALLOWED)} AND {_match('context', gates.ALLOWED)}) OR ({_match('code', gates.TOKEN_STORE)} AND {_match('context', gates.TOKEN_STORE)}))"
_gate(
    "csrf_gate",
    lambda: gates.csrf_gate(F.col("code"), F.col("context")),
    f"""WITH s AS (SELECT *, {_CONTROLLED} AS controlled, {_A} AS a, {_B} AS b FROM {_S}),
p AS (SELECT *, list_filter(range(1, len(a) + 1), lambda i: contains(lower(a[i]), 'csrf') OR contains(lower(b[i]), 'csrf')) AS c FROM s),
r AS (SELECT *, list_filter(list_transform(c, lambda i: CASE WHEN {_request('a[i]')} AND {_request('b[i]')} THEN 'request against request' WHEN trim(a[i]) = trim(b[i]) THEN 'compared with itself' END), lambda x: x IS NOT NULL) AS f FROM p)
SELECT id, CASE WHEN {_match('code', gates.CSRF_PRESENT)} AND NOT {_match('code', gates.CSRF_COMPARED)} THEN 'presence only' WHEN len(f) > 0 THEN f[1]
WHEN {_FIELD} <> '' AND NOT contains(context, {_FIELD}) THEN 'unknown session field' WHEN {_match('code', gates.CSRF_FORWARDED)} THEN 'forwarded'
WHEN {_match('code', gates.ORIGIN_PRESENT)} AND NOT {_match('code', gates.ALLOWED)} THEN 'origin presence only'
WHEN {_FIXED} <> '' AND NOT contains(context, regexp_extract({_FIXED}, 'https?://[^''" ]+')) THEN 'unknown origin'
WHEN NOT {_TRUSTED} THEN 'no trusted mechanism' ELSE 'ok' END AS reason FROM r""",
)
_gate(
    "general_gate",
    lambda: gates.general_gate(F.lit("x"), F.col("code")),
    _select(_case(("trim(code) = 'x'", "identical"), (_match("code", gates.PLACEHOLDER), "placeholder"), ("len(list_filter(string_split(code, chr(10)), lambda x: length(x) > 20 AND len(list_filter(string_split(code, chr(10)), lambda y: y = x)) > 2)) > 0", "duplicated statement"))),
)
_gate("markdown_valid", lambda: gates.markdown_gate(F.concat(F.col("code"), F.when(F.col("id") % 2 == 0, "```").otherwise(""))), _select(_case(("trim(code, ' ' || chr(10)) = '' AND id % 2 = 1", "empty"), ("id % 2 = 0", "unclosed fence"))))


# ---- validation of pairs: neighbouring documents, with words of their language -------

_WORDS = (" the ", " of ", " de ", " la ", " der ", " die ", " le ", " un ")
_LIMITS = gates.Limits((100, 6000), (120, 6500), 9000, 2600, 8, (0.02, 0.97), True, (" the ", " de "), 1, True, 2)
_FORBIDDEN, _INDICATORS, _MITIGATION = ("Licensed under", "password"), (".",), ("token = ",)


def _has(c, words):
    return "(" + " OR ".join(f"contains({c}, {literal(w)})" for w in words) + ")"


def _stripped(c):
    from codequarry.plans.text_queries import strip_sql

    return f"list_distinct(list_filter(list_transform(string_split({c}, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> ''))"


def _validate_sql(source, key, limits, forbidden, words):
    from codequarry.functions.text import COMMENTS, FUNCTION_KEYWORDS
    from codequarry.plans.text_queries import TOKEN, _nested

    functions, fix = words.get("function_words") or FUNCTION_KEYWORDS, (*(words.get("mitigation") or ()), *words.get("broad", ()))
    starts = " OR ".join(f"starts_with(x, {literal(p)})" for p in limits.plain)
    sinks = lambda c: f"list_sort(list_filter({c}, lambda x: {_has('x', limits.sink_words)}))"
    cases = [
        ("v = '' OR s = ''", "empty block"), (f"NOT {_has('v', functions)}", "vuln: no function"), (f"NOT {_has('s', functions)}", "safe: no function"),
        (f"length(v) < {limits.vuln[0]}", "vuln too short"), (f"length(v) > {limits.vuln[1]}", "vuln too long"), (f"length(s) < {limits.safe[0]}", "safe too short"), (f"length(s) > {limits.safe[1]}", "safe too long"),
        (f"length(v) + length(s) > {limits.combined}", "combined too long"),
    ]
    if limits.tokens:
        cases.append((f"greatest(1, 2 * length(v) // 7) + greatest(1, 2 * length(s) // 7) + 3 > {limits.tokens}", "token overflow"))
    cases += [(f"len(vt) < {limits.identifiers}", "vuln too few identifiers"), (f"len(st) < {limits.identifiers}", "safe too few identifiers"), (f"j < {limits.similarity[0]}", "pair too dissimilar"), (f"j >= {limits.similarity[1]}", "pair too similar")]
    if limits.equal_lines:
        cases.append(("len(list_filter(vl, lambda x: NOT list_contains(sl, x))) = 0 AND len(list_filter(sl, lambda x: NOT list_contains(vl, x))) = 0", "line-identical"))
    if limits.sink_words:
        cases.append((f"len({sinks('vl')}) >= {limits.least_sinks} AND {sinks('vl')} = {sinks('sl')}", "sink lines unchanged"))
    if limits.new_lines:
        cases.append(("len(new) < 1", "no meaningful new lines"))
    if forbidden:
        bare = _nested("s", [(p, "") for p in COMMENTS])
        cases += [(f"contains({bare}, {literal(w)})", f"forbidden pattern: {w}") for w in forbidden]
    last = []
    if words.get("indicators"):
        last.append((f"NOT {_has('v', words['indicators'])}", "no indicator"))
    if words.get("unsafe"):
        stays = " OR ".join(f"(contains(v, {literal(w)}) AND contains(s, {literal(w)}))" for w in words["unsafe"])
        last.append((f"({stays}) AND NOT {_has('s', fix)} AND len(new) < 2", "unsafe call stays"))
    if words.get("mitigation") is not None:
        last.append((f"NOT ({_has('s', fix)}" + (f" OR len(new) >= {limits.tier3})" if limits.tier3 else ")"), "no mitigation"))
    cases += reversed(last) if limits.indicator_last else last
    return f"""WITH t AS (SELECT *, regexp_extract_all(v, {TOKEN}) AS vt, regexp_extract_all(s, {TOKEN}) AS st, {_stripped('v')} AS vl, {_stripped('s')} AS sl FROM {source}),
u AS (SELECT *, CASE WHEN len(vt) = 0 AND len(st) = 0 THEN 1.0 ELSE len(list_intersect(vt, st)) * 1.0 / greatest(len(list_distinct(list_concat(vt, st))), 1) END AS j, list_filter(sl, lambda x: NOT list_contains(vl, x) AND length(x) > {limits.longer} AND NOT ({starts})) AS new FROM t)
SELECT {key}, {_case(*cases)} AS reason FROM u"""


_NEIGHBOURS = "(SELECT a.doc_id, a.text AS v, b.text AS s FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"


@query(_validate_sql(_NEIGHBOURS, "doc_id", _LIMITS, _FORBIDDEN, {"indicators": _INDICATORS, "mitigation": _MITIGATION, "function_words": _WORDS}))
def validate_reason(spark, sf_dir):
    from codequarry.plans.text_queries import _pairs

    reason = gates.validate(F.col("vuln"), F.col("safe"), _LIMITS, _FORBIDDEN, _INDICATORS, _MITIGATION, (), _WORDS)
    return _pairs(spark, sf_dir).select("doc_id", F.coalesce(reason, F.lit("ok")).alias("reason"))


_PAIR_ROWS = values(PAIRS, "id", "v", "s")


@query(" UNION ALL ".join(f"SELECT {literal(f)} AS family, * FROM ({_validate_sql(_PAIR_ROWS, 'id', limits, ('eval(',), gates.FAMILY_WORDS[f])})" for f, limits in gates.FAMILY_LIMITS.items()))
def validate_families(spark, sf_dir):
    """Pairs of the corpus under the limits and words of every family."""
    pairs = spark.createDataFrame(PAIRS, "id int, v string, s string")
    reasons = F.array(*(F.struct(F.lit(f).alias("family"), F.coalesce(gates.validate_family(F.col("v"), F.col("s"), f, ("eval(",)), F.lit("ok")).alias("reason")) for f in gates.FAMILY_LIMITS))
    return pairs.select("id", F.explode(reasons).alias("x")).select("x.family", "id", "x.reason")


# ---- end to end ----------------------------------------------------------------------


@query()
def scan_report(spark, sf_dir):
    files = snippets(spark).select("id", "code")
    found = detect.scan(files, "id", "code", detect.keyword_scorer(rules.CONFIRMATION))
    out = detect.report(found, files, "id")
    return out.select("id", "Status", F.size("Findings").cast("long").alias("n"), F.to_json("Findings").alias("findings"))


@query()
def scan_documents(spark, sf_dir):
    """The same scan over documents, with rules of ordinary words."""
    files = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = detect.scan(files, "doc_id", "text", detect.keyword_scorer(WORD_RULES), WORD_RULES, WORD_RULES, {"CSRF": ("password",)})
    return found.withColumn("vuln_lines", F.array_join(F.col("vuln_lines").cast("array<string>"), ","))


@query()
def patch_fold(spark, sf_dir):
    files = snippets(spark).select("id", "code")
    patches = files.select("id", F.lit(1).alias("start"), F.lit(1).alias("end"), F.lit("fixed();").alias("code"), F.array(F.lit("import os")).alias("imports")).filter("id % 2 = 0")
    return repair.patched_files(files, patches, "id", "code")


@query()
def enclosing_region(spark, sf_dir):
    files = snippets(spark).select("id", "code", F.lit("a.js").alias("name"))
    return repair.regions(files, files.select("id", F.lit(1).alias("low"), F.lit(2).alias("high")), "id", "code", "name")


@query()
def lex_tokens(spark, sf_dir):
    return repair.tokens(snippets(spark), "id", "code")


@query(f"SELECT id, array_to_string(list_filter(['import os', 'import pickle', 'const x'], lambda x: NOT contains(code, x)), ',') AS imports FROM {_S}")
def import_dedup(spark, sf_dir):
    imports = F.array(*map(F.lit, ("import os", " import pickle", "import os ", "const x", "")))
    return snippets(spark).select("id", F.array_join(L.new_imports(imports, F.col("code")), ",").alias("imports"))
