"""Ordered gates: the first that fails names the reason, null is accepted."""

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from codequarry.functions.lines import let, split_lines, stripped_set
from codequarry.functions.text import contains_any, first_contained, has_function, jaccard, strip, strip_comments, tokenize, wp_tokens
from codequarry.operators import gate_words as words


@dataclass(frozen=True)
class Limits:
    """What validate() asks of a pair."""

    vuln: tuple = (70, 1200)
    safe: tuple = (90, 1300)
    combined: int = 1900
    tokens: int | None = 512
    identifiers: int = 8
    similarity: tuple = (0.12, 0.97)
    equal_lines: bool = True
    sink_words: tuple = ()
    least_sinks: int = 1
    new_lines: bool = False
    tier3: int | None = None
    indicator_last: bool = False
    longer: int = 8
    plain: tuple = ("#", "//", "import ", "from ", "using ", "require ", "package ")  # beginnings of lines that add nothing


# Words of SQL lines
SQL_WORDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "WHERE", "FROM", "execute(", "query(", "Query(", "Execute(", "cursor.execute")

# Limits of each family's gate
FAMILY_LIMITS = {
    "crypto": Limits((80, 1500), (100, 1400), 2100, None, 10, (0.10, 0.98), False),
    "deser": Limits((80, 800), (100, 900), 1400, 440, 8, (0.12, 0.995), tier3=1),
    "path": Limits((70, 1200), (90, 1300), 1900, 512, 8, (0.12, 0.97), indicator_last=True),
    "sqli": Limits((80, 1200), (100, 1300), 1900, 512, 8, (0.15, 0.995), True, SQL_WORDS, 1, True, 2),
    "xml": Limits((70, 1200), (90, 1300), 1900, 512, 8, (0.12, 0.97), tier3=2, indicator_last=True, longer=10, plain=("#", "//", "import ", "from ", "using ")),
    "xss": Limits((120, 1200), (130, 1300), 1900, 512, 10, (0.12, 0.995), True, words.XSS_RENDER, 2, False, 1),
}


def meaningful_new_lines(vuln_lines, safe_lines, limits):
    """Lines of safe that vuln hasn't, longer than the limit, neither comment nor import."""
    plain = lambda x: reduce(or_, (x.startswith(p) for p in limits.plain))
    return F.filter(F.array_except(safe_lines, vuln_lines), lambda x: (F.length(x) > limits.longer) & ~plain(x))


def validate(vuln, safe, limits, forbidden=(), indicators=None, mitigation=None, broad=(), function_words=None, unsafe=()):
    """Reason for which a pair of texts is rejected, or null.

    forbidden: words that the fixed text must not hold outside comments;
    indicators: one must stand in the vulnerable text; mitigation and broad: one
    of either must stand in the fixed text, unless tier3 new lines do instead;
    unsafe: calls of the vulnerable text that stay need one of those or two new
    lines.
    """
    # what several rules look at is computed once for a row
    parts = F.struct(tokenize(vuln).alias("vt"), tokenize(safe).alias("st"), stripped_set(vuln).alias("vl"), stripped_set(safe).alias("sl"))
    return let(parts, lambda x: let(meaningful_new_lines(x["vl"], x["sl"], limits), lambda new: _reason(vuln, safe, x, new, limits, forbidden, indicators, mitigation, broad, function_words, unsafe)))


def _reason(vuln, safe, x, new, limits, forbidden, indicators, mitigation, broad, function_words, unsafe):
    has = has_function if function_words is None else lambda c: contains_any(c, function_words)
    v, s = F.length(vuln), F.length(safe)
    vt, st = x["vt"], x["st"]
    similar = jaccard(vt, st)
    rules = [
        ((F.coalesce(vuln, F.lit("")) == "") | (F.coalesce(safe, F.lit("")) == ""), "empty block"),
        (~has(vuln), "vuln: no function"),
        (~has(safe), "safe: no function"),
        (v < limits.vuln[0], "vuln too short"),
        (v > limits.vuln[1], "vuln too long"),
        (s < limits.safe[0], "safe too short"),
        (s > limits.safe[1], "safe too long"),
        (v + s > limits.combined, "combined too long"),
    ]
    if limits.tokens:
        rules.append((wp_tokens(vuln) + wp_tokens(safe) + 3 > limits.tokens, "token overflow"))
    rules += [
        (F.size(vt) < limits.identifiers, "vuln too few identifiers"),
        (F.size(st) < limits.identifiers, "safe too few identifiers"),
        (similar < limits.similarity[0], "pair too dissimilar"),
        (similar >= limits.similarity[1], "pair too similar"),
    ]
    if limits.equal_lines:
        rules.append(((F.size(F.array_except(x["vl"], x["sl"])) == 0) & (F.size(F.array_except(x["sl"], x["vl"])) == 0), "line-identical"))
    if limits.sink_words:
        sinks = lambda c: F.array_sort(F.filter(c, lambda y: contains_any(y, limits.sink_words)))
        rules.append(((F.size(sinks(x["vl"])) >= limits.least_sinks) & (sinks(x["vl"]) == sinks(x["sl"])), "sink lines unchanged"))
    if limits.new_lines:
        rules.append((F.size(new) < 1, "no meaningful new lines"))
    if forbidden:
        first = first_contained(strip_comments(safe), forbidden)
        rules.append((first.isNotNull(), F.concat(F.lit("forbidden pattern: "), first)))
    last, after = [], []
    if unsafe:
        stays = reduce(or_, (F.contains(vuln, F.lit(w)) & F.contains(safe, F.lit(w)) for w in unsafe))
        after = [(stays & ~contains_any(safe, (*mitigation, *broad)) & (F.size(new) < 2), "unsafe call stays")]
    if indicators:
        last.append((~contains_any(vuln, indicators), "no indicator"))
    if mitigation is not None:
        ok = contains_any(safe, (*mitigation, *broad))
        ok = ok | (F.size(new) >= limits.tier3) if limits.tier3 else ok
        last.append((~ok, "no mitigation"))
    rules += reversed(last) if limits.indicator_last else [*last[:1], *after, *last[1:]] if indicators else [*after, *last]
    return F.coalesce(*(F.when(c, r if not isinstance(r, str) else F.lit(r)) for c, r in rules), F.lit(None).cast("string"))


#: Words of each family's gate, as arguments of validate()
FAMILY_WORDS = {
    "crypto": {"function_words": words.CRYPTO_FUNCTIONS},
    "deser": {"indicators": words.DESER_INDICATORS, "mitigation": words.DESER_MITIGATION, "broad": words.DESER_BROAD, "function_words": words.DESER_FUNCTIONS, "unsafe": words.DESER_UNSAFE},
    "path": {"indicators": words.PATH_INDICATORS, "mitigation": words.PATH_MITIGATION, "function_words": words.PATH_FUNCTIONS},
    "sqli": {"indicators": words.SQL_INDICATORS, "mitigation": words.SQL_MITIGATION, "broad": words.SQL_BROAD, "function_words": words.SQL_FUNCTIONS},
    "xml": {"indicators": words.XML_INDICATORS, "mitigation": words.XML_MITIGATION, "broad": words.XML_BROAD, "function_words": words.XML_FUNCTIONS},
    "xss": {"indicators": (*words.XSS_INPUT, *words.XSS_OUTPUT), "mitigation": words.XSS_MITIGATION, "broad": words.XSS_BROAD, "function_words": words.XSS_FUNCTIONS},
}


def validate_family(vuln, safe, family, forbidden=(), **more):
    """validate() with a family's limits and words; `more` replaces its words (the expected ones of a subtype)."""
    return validate(vuln, safe, FAMILY_LIMITS[family], forbidden, **{**FAMILY_WORDS[family], **more})


# ---- gates of repairs: a message, or null -----------------------------------

# Patterns of the repair gates
PLACEHOLDER = r"(?im)\bTODO\b|\bFIXME\b|<insert|<your[\s_-]*code|\.\.\.\s*$"
SQL_WORD = r"(?i)\b(SELECT|INSERT|UPDATE|DELETE)\b"
SQL_JOINED = (
    r"""(?i)["'][^\n]{0,200}\b(SELECT|INSERT|UPDATE|DELETE)\b[^\n]{0,200}["']\s*\+""",
    r"""(?i)\+\s*["'][^\n]{0,200}\b(SELECT|INSERT|UPDATE|DELETE)\b""",
    r"""(?i)f["'][^\n]{0,200}\{[^}]+\}[^\n]{0,200}\b(SELECT|INSERT|UPDATE|DELETE)\b""",
    r"""%\s*\([^\n]*?\)\s*%\s*["']|["']\s*%\s*\w+\s*\z""",
)
SQL_BOUND = r"(\?|%s|:[a-zA-Z_]\w*)"
SQL_CALL = r"(?:\.execute|executeQuery|\.query)\s*\(([^)]*)\)"
PATH_RESOLVE = r"path\.resolve|path\.normalize|os\.path\.(abspath|realpath|normpath)|Paths\.get\([^)]*\)\.normalize|realpath\("
PATH_INSIDE = r"path\.relative\s*\(|os\.path\.commonpath|\.startsWith\s*\("
PATH_PREFIX = r"\.startsWith\s*\(\s*[A-Za-z_][\w.]*\s*\)"
PATH_VARIABLE = r"(?:const|let|var)\s+(\w+)\s*=\s*path\.resolve"
PATH_SINK = r"(?:existsSync|readFile|readFileSync|createReadStream|download|sendFile)\s*\(\s*(\w+)"
WEAK_RANDOM = r"Math\.random\s*\("
WEAK_CRYPTO = r"(?i)\bmd5\s*\(|\bsha1\s*\(|\bMD5\b|\bSHA-?1\b|\bDES\b|\bRC4\b|\bECB\b"
CRYPTO_QUALIFIED = r"\bcrypto\.(randomBytes|randomUUID)\s*\("
CRYPTO_BARE = r"(?:\A|[^.\w])(randomBytes|randomUUID)\s*\("
CRYPTO_OTHER = r"\bsecrets\.\w+\s*\(|\bos\.urandom\s*\(|\bSecureRandom\b"
CRYPTO_IMPORT = r"""require\(\s*['"]crypto['"]\s*\)|from\s+['"]crypto['"]"""
REQUEST_VARIABLE = r"(?:const|let|var)\s+(\w+)\s*=\s*req\.(?:headers|body|query|params|cookies)\b"
COMPARISON = r"""([A-Za-z_][\w.\[\]'"]*(?:\([^)]*\))?)\s*(===|!==|==|!=)\s*([A-Za-z_][\w.\[\]'"]*(?:\([^)]*\))?)"""
CSRF_PRESENT = r"if\s*\(\s*!\s*\w*[Cc]srf\w*\s*\)"
CSRF_COMPARED = r"===|!==|==|!=|compareSync|timingSafeEqual|\.equals\("
CSRF_SESSION = r"(req\.session\.\w*[Cc]srf\w*)"
CSRF_FORWARDED = r"(payment|gateway|upstream)\w*[^\n]{0,80}[Cc]srf|[Cc]srf\w*[^\n]{0,80}(payment|gateway|upstream)"
ORIGIN_PRESENT = r"""(?i)if\s*\(\s*!\s*req\.(headers\.origin|headers\.referer|get\(['"]origin['"]\))"""
ORIGIN_FIXED = r"""(?i)((?:origin|referer)\s*(?:===|==)\s*['"]https?://[^'"]+['"])"""
ALLOWED = r"(?i)ALLOWED_ORIGINS|TRUSTED_ORIGINS|allowlist|allowedOrigins"
MIDDLEWARE = r"(\bcsurf\b|csrfProtection|CsrfProtect|verifyCsrfToken|validateCsrfToken|doubleCsrf)"
TOKEN_STORE = r"\btokenStore\b|csrfTokens\.verify|csrfTokens\.create|\btokenCache\b"
XSS_SINK = r"""\.innerHTML\s*=\s*(?!['"`])|document\.write\s*\(\s*(?!['"`])"""
SANITIZER = r"(DOMPurify|sanitizeHtml|sanitize-html|escapeHtml|encodeHTML)\s*\("
XML_SAFE = r"(?i)DtdProcessing\.Prohibit|XmlResolver\s*=\s*null|resolve_entities\s*=\s*False|disableExternal|defusedxml|FEATURE_SECURE_PROCESSING|setFeature\([^)]*external-general-entities[^)]*false"


def _first(*rules):
    return F.coalesce(*(F.when(c, F.lit(r)) for c, r in rules), F.lit(None).cast("string"))


def _group(c, pattern, k=1):
    """The group of the first match, null without one."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, k))


def general_gate(region, code):
    lines = F.filter(F.transform(split_lines(code), strip), lambda x: F.length(x) > 20)
    often = F.exists(F.array_distinct(lines), lambda x: F.size(F.filter(lines, lambda y: y == x)) > 2)
    return _first((strip(code) == strip(region), "identical"), (code.rlike(PLACEHOLDER), "placeholder"), (often, "duplicated statement"))


def sql_gate(code):
    joined = code.rlike(SQL_WORD) & reduce(or_, (code.rlike(p) for p in SQL_JOINED))
    calls = F.regexp_extract_all(code, F.lit(SQL_CALL), F.lit(1))
    return _first((joined, "concatenated"), (code.rlike(SQL_BOUND) & (F.size(calls) > 0) & F.forall(calls, lambda x: ~F.contains(x, F.lit(","))), "unbound placeholder"))


def path_gate(region, code):
    variable = _group(code, PATH_VARIABLE)
    sinks = lambda c: F.regexp_extract_all(c, F.lit(PATH_SINK), F.lit(1))
    still = F.exists(sinks(region), lambda v: (v != variable) & F.array_contains(sinks(code), v))
    naive = code.rlike(PATH_PREFIX) & ~F.contains(code, F.lit("path.relative(")) & ~F.contains(code, F.lit("os.path.commonpath"))
    return _first((~code.rlike(PATH_RESOLVE), "no resolve"), (~code.rlike(PATH_INSIDE), "no containment"), (naive, "naive prefix"), (variable.isNotNull() & still, "old variable used"))


def imports_name(text, name):
    """Whether a line of text destructures `name` from the crypto module."""
    lines = F.filter(split_lines(text), lambda x: x.rlike(CRYPTO_IMPORT))
    return F.exists(lines, lambda x: F.array_contains(F.transform(F.split(F.regexp_extract(x, r"\{([^}]*)\}", 1), ","), strip), name))


def crypto_gate(code, imports, context):
    qualified, bare = code.rlike(CRYPTO_QUALIFIED), _group(code, CRYPTO_BARE)
    imported = imports.rlike(CRYPTO_IMPORT) | context.rlike(CRYPTO_IMPORT)
    named = imports_name(imports, bare) | imports_name(context, bare)
    return _first(
        (code.rlike(WEAK_RANDOM), "Math.random"),
        (code.rlike(WEAK_CRYPTO), "weak primitive"),
        (~qualified & bare.isNull() & ~code.rlike(CRYPTO_OTHER), "no secure source"),
        (qualified & ~imported, "no crypto import"),
        (~qualified & bare.isNotNull() & ~named, "no named import"),
    )


def csrf_gate(code, context):
    controlled = F.regexp_extract_all(code, F.lit(REQUEST_VARIABLE), F.lit(1))
    pairs = F.arrays_zip(F.regexp_extract_all(code, F.lit(COMPARISON), F.lit(1)).alias("a"), F.regexp_extract_all(code, F.lit(COMPARISON), F.lit(3)).alias("b"))
    pairs = F.filter(pairs, lambda p: F.contains(F.lower(p["a"]), F.lit("csrf")) | F.contains(F.lower(p["b"]), F.lit("csrf")))
    request = lambda x: x.rlike(r"\A\s*req\.(headers|body|query|params|cookies)\b") | F.array_contains(controlled, F.regexp_extract(x, r"\A([A-Za-z_]\w*)", 1))
    reason = F.filter(F.transform(pairs, lambda p: F.when(request(p["a"]) & request(p["b"]), F.lit("request against request")).when(strip(p["a"]) == strip(p["b"]), F.lit("compared with itself"))), lambda r: r.isNotNull())
    field, fixed, middleware = _group(code, CSRF_SESSION), _group(code, ORIGIN_FIXED), _group(code, MIDDLEWARE)
    seen = F.coalesce(F.contains(context, field), F.lit(False))
    literals = F.regexp_extract_all(F.coalesce(fixed, F.lit("")), F.lit(r"""(https?://[^'" ]+)"""), F.lit(1))
    unseen = (F.size(literals) > 0) & ~F.exists(literals, lambda x: F.contains(context, x))
    trusted = F.coalesce(F.contains(context, middleware), F.lit(False)) | seen | (code.rlike(ALLOWED) & context.rlike(ALLOWED)) | (code.rlike(TOKEN_STORE) & context.rlike(TOKEN_STORE))
    return F.coalesce(
        F.when(code.rlike(CSRF_PRESENT) & ~code.rlike(CSRF_COMPARED), F.lit("presence only")),
        F.get(reason, F.lit(0)),
        _first((field.isNotNull() & ~seen, "unknown session field"), (code.rlike(CSRF_FORWARDED), "forwarded"), (code.rlike(ORIGIN_PRESENT) & ~code.rlike(ALLOWED), "origin presence only"), (unseen, "unknown origin"), (~trusted, "no trusted mechanism")),
    )


def xss_gate(code, context):
    sanitizer = _group(code, SANITIZER)
    sink = code.rlike(XSS_SINK)
    return _first((sink & sanitizer.isNull(), "unsafe sink"), (sink & ~F.contains(context, sanitizer), "unknown sanitizer"))


def command_gate(code):
    return _first((code.rlike(r"shell\s*=\s*True"), "shell"), (code.rlike(r"os\.system\s*\(|popen\s*\("), "shell call"))


def deserialization_gate(code):
    yaml = code.rlike(r"yaml\.load\s*\(") & ~F.contains(code, F.lit("Loader=")) & ~F.contains(code, F.lit("safe_load"))
    return _first((code.rlike(r"\beval\s*\(|\bpickle\.loads\s*\("), "unsafe call"), (yaml, "unsafe yaml"))


def xml_gate(code):
    return _first((~code.rlike(XML_SAFE), "entities not disabled"))


def repair_gate(label, region, code, imports, context):
    """The general gate, then that of the finding's family."""
    own = {
        "SQL Injection": sql_gate(code),
        "Path Traversal": path_gate(region, code),
        "Insecure Cryptography": crypto_gate(code, imports, context),
        "CSRF": csrf_gate(code, context),
        "XSS": xss_gate(code, context),
        "OS Command Injection": command_gate(code),
        "Insecure Deserialization": deserialization_gate(code),
        "XML Injection": xml_gate(code),
    }
    return F.coalesce(general_gate(region, code), *(F.when(label == k, v) for k, v in own.items()))


FIELDS = ("status", "replacement_code", "imports", "explanation")


def reply_gate(raw):
    """What is wrong with a model's JSON reply, or null."""
    keys = F.json_object_keys(raw)
    known = F.array(*map(F.lit, FIELDS))
    field = lambda k: F.get_json_object(raw, f"$.{k}")
    status, code = field("status"), F.coalesce(field("replacement_code"), F.lit(""))
    lists = F.try_variant_get(F.try_parse_json(raw), "$.imports", "array<string>").isNotNull()
    return _first(
        (F.coalesce(keys.isNull(), F.lit(True)), "not an object"),
        (F.size(F.array_except(known, keys)) > 0, "missing fields"),
        (F.size(F.array_except(keys, known)) > 0, "extra fields"),
        (F.coalesce(~status.isin("repaired", "needs_context"), F.lit(True)), "bad status"),
        (~lists, "bad imports"),
        ((status == "repaired") & (strip(code) == ""), "no code"),
        ((status == "needs_context") & (strip(code) != ""), "code without repair"),
    )


def markdown_gate(c):
    """What is wrong with a chat reply, or null."""
    fences = F.size(F.split(c, "```")) - 1
    outer = strip(c).rlike(r"(?s)\A```[^\n`]*\n.*\n?```\z") & (fences == 2)
    return _first((F.coalesce(strip(c), F.lit("")) == "", "empty"), (fences % 2 == 1, "unclosed fence"), (outer, "one outer fence"))
