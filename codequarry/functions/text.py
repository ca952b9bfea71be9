"""Text expressions: Column in, Column out, no Python at run time.

Character classes are spelled out where engines differ: `\\w` and `\\s` are
ASCII in Java, so words are [\\p{L}\\p{N}_] and white space is SPACE.
"""

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
TOKEN = r"([a-zA-Z_][\p{L}\p{N}_]*|[0-9]+)"

# Comment forms, in the order in which they are removed
COMMENTS = (r"#[^\n]*", r"//[^\n]*", r"(?s)/\*.*?\*/", r'(?s)""".*?"""', r"(?s)'''.*?'''")

# Keywords of definitions and routes
FUNCTION_KEYWORDS = (
    "def ", "func ", "fn ", "function ", "async function",
    "public ", "private ", "protected ", "internal ", "override ",
    "static ", "void ", "async ",
    "const ", "let ", "var ", "module.exports", "exports.",
    "<?php", "fun ", "object ", "class ", "interface ", "sub ",
    "router.", "app.get(", "app.post(", "app.put(", "app.delete(",
    "http.HandleFunc(", "http.Handle(", "Route::", "@app.route", "@router.",
    "@GetMapping", "@PostMapping", "@RequestMapping", "@Controller",
    " do\n", " do |", "post '", "get '", "put '", "delete '",
    'post "', 'get "',
)

# Entities in the order in which they are decoded
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&#x2F;", "/"))

# Names of languages
LANGUAGE_ALIASES = {
    "javascript": "js", "node": "js", "typescript": "ts", "python": "py", "py3": "py",
    "c++": "cpp", "cplusplus": "cpp", "c#": "cs", "csharp": "cs", "shell": "bash", "sh": "bash", "zsh": "bash",
    "yml": "yaml", "md": "markdown",
}

# First match decides; the second list is for trimmed code
LANGUAGE_RULES_1 = (
    ("html", r"(?i)\A\s*<(!DOCTYPE|html|div|span|script|style)"),
    ("py", r"(?m)^\s*(import|from|def|class|if __name__)\s+"),
    ("cpp", r"(?m)^\s*(#include|int\s+main|using\s+namespace|std::)"),
    ("php", r"(?i)\A\s*(<\?php|namespace|public\s+function)"),
    ("js", r"(?m)^\s*(const|let|var|function|import|export|interface|type)\s+|=>"),
)
LANGUAGE_RULES_2 = (
    ("html", r"\A\s*<[!?]?[a-zA-Z]|</[a-zA-Z]+>"),
    ("json", None),
    ("sql", r"(?i)\A\s*(SELECT|INSERT|UPDATE|DELETE|CREATE)\s"),
    ("cpp", r"#include|std::|\bnamespace\s+\w+"),
    ("java", r"\bpublic\s+class\b|\bSystem\.out\b"),
    ("py", r"(?m)\bdef\s+\w+\s*\(|^\s*import\s+\w+$|:$|elif\s|self\."),
    ("go", r"\bfunc\s+\w+\s*\(|fmt\.|package\s+main"),
    ("rs", r"\bfn\s+\w+\s*\(|let\s+mut\s|impl\s+\w+"),
    ("ts", r"interface\s+\w+|:\s*(string|number|boolean|void)\b"),
    ("js", r"=>|const\s+\w+\s*=|require\("),
)
JSON_RULES = (r"\A\s*\{", r'"[^"]+"\s*:')


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def tokenize(c: Column) -> Column:
    """Identifiers and numbers."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(1))


def strip_comments(c: Column) -> Column:
    for pattern in COMMENTS:
        c = F.regexp_replace(c, pattern, "")
    return c


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; 1 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def wp_tokens(c: Column) -> Column:
    """Estimated word pieces: a character is 2/7 of one, a text at least one."""
    return F.greatest(F.lit(1).cast("long"), F.floor(2 * F.length(c).cast("long") / 7))


def contains_any(c: Column, words, ignore_case: bool = False) -> Column:
    """Whether any of the literal words stands in c."""
    c = F.lower(c) if ignore_case else c
    return reduce(or_, (F.contains(c, F.lit(w.lower() if ignore_case else w)) for w in words), F.lit(False))


def first_contained(c: Column, words) -> Column:
    """The first of the words that stands in c, or null."""
    return F.coalesce(*(F.when(F.contains(c, F.lit(w)), F.lit(w)) for w in words), F.lit(None).cast("string"))


def has_function(c: Column, more=()) -> Column:
    return contains_any(c, (*FUNCTION_KEYWORDS, *more))


def parse_blocks(c: Column) -> Column:
    """struct(vuln, safe) of a reply with VULN: and SAFE: blocks; both null if one is missing."""
    plain = F.regexp_replace(F.regexp_replace(c, r"\*\*(VULN|SAFE):?\*\*:?", "$1:"), r"```[a-zA-Z0-9_+#-]*\n?", "")
    vuln = F.regexp_extract(plain, r"(?is)VULN:\s*\n(.*?)\nSAFE:", 1)
    safe = F.regexp_extract(plain, r"(?is)SAFE:\s*\n(.*)", 1)
    found = plain.rlike(r"(?is)VULN:\s*\n.*?\nSAFE:") & plain.rlike(r"(?is)SAFE:\s*\n")
    return F.when(found, F.struct(strip(vuln).alias("vuln"), strip(safe).alias("safe")))


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; empty without a dot."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*\z", "")


def normalize_space(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"{SPACE}+", " "))


def code_part(line: Column) -> Column:
    """A line without its // tail."""
    return F.regexp_replace(line, r"//[^\n]*\z", "")


def path_safe(c: Column) -> Column:
    """A name without characters that paths don't allow, spaces as underscores; blank is empty."""
    return F.when(strip(c) == "", "").otherwise(F.translate(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', ""), " ", "_"))


def storage_path(user: Column, first: Column, last: Column, chat: Column, scan: Column, file: Column) -> Column:
    return F.concat_ws("/", F.concat_ws("_", user.cast("string"), path_safe(first), path_safe(last)), path_safe(chat), F.lit("Origin"), F.concat_ws("_", scan.cast("string"), path_safe(file)))


def decode_entities(c: Column) -> Column:
    """Named entities one after another, then decimal ones."""
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    parts = F.split(c, r"&#(?=[0-9]{1,7};)")
    # every part but the first begins with a number and a semicolon
    number = lambda p: F.regexp_extract(p, r"\A([0-9]+);", 1)
    rest = lambda p: F.regexp_replace(p, r"\A[0-9]+;", "")
    tail = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(code_point(number(p).cast("int")), rest(p)))
    return F.concat(parts[0], F.array_join(tail, ""))


def code_point(n: Column) -> Column:
    """The character of a UTF-16 code unit, through its big-endian bytes."""
    return F.decode(F.unhex(F.lpad(F.hex(F.pmod(n, F.lit(65536))), 4, "0")), "UTF-16BE")


def language_1(c: Column) -> Column:
    return F.coalesce(*(F.when(c.rlike(p), F.lit(name)) for name, p in LANGUAGE_RULES_1), F.lit("code"))


def language_2(c: Column) -> Column:
    c = strip(c)
    test = lambda name, p: c.rlike(JSON_RULES[0]) & c.rlike(JSON_RULES[1]) if p is None else c.rlike(p)
    return F.coalesce(*(F.when(test(name, p), F.lit(name)) for name, p in LANGUAGE_RULES_2), F.lit("js"))


def likely_code(c: Column) -> Column:
    many = (F.size(F.split(c, "\n")) > 2) | c.rlike(r"[{}\[\];]") | c.rlike(r"(?m)^\s*(def|function|class|import|#include)")
    return many & (F.length(strip(c)) > 10)


def language_name(c: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in LANGUAGE_ALIASES.items() for x in pair))
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.coalesce(F.try_element_at(names, low), low)


def leading_direction(c: Column) -> Column:
    """rtl or ltr by the first character of either kind, else auto."""
    first = F.regexp_extract(c, r"([A-Za-z\x{590}-\x{8FF}\x{FB1D}-\x{FDFD}\x{FE70}-\x{FEFC}])", 1)
    return F.when(F.coalesce(first, F.lit("")) == "", "auto").when(first.rlike("[A-Za-z]"), "ltr").otherwise("rtl")


TOPIC = r"(?i)(?:vulnerability|issue|bug|security|error|problem|detect)[:\s]+([^\n.]{5,60})"
PREAMBLE = r"(?i)\A(analysis|scan|result|neural engine)[:\s]*"


def chat_title(finding: Column, reply: Column, fallback: Column) -> Column:
    """The finding's name, a topic in the reply, its first sentence or the fallback; 48 characters at most."""
    reply = F.coalesce(reply, F.lit(""))
    empty = lambda x: F.nullif(x, F.lit(""))
    topic = strip(F.regexp_extract(reply, TOPIC, 1))
    sentence = strip(F.regexp_replace(F.split(reply, r"[.\n]")[0], PREAMBLE, ""))
    clean = normalize_space(F.coalesce(empty(finding), empty(topic), empty(sentence), empty(fallback), F.lit("Untitled_Chat")))
    return F.when(F.length(clean) > 48, F.concat(strip(F.left(clean, F.lit(48))), F.lit("…"))).otherwise(clean)


def slug(c: Column, size: int = 36) -> Column:
    return F.left(F.regexp_replace(c, "[^A-Za-z0-9_-]", "_"), F.lit(size))


def redact(c: Column, secret: str) -> Column:
    return F.replace(c, F.lit(secret), F.lit("***")) if secret else c


def either_case(c: Column, name: str, default) -> Column:
    """The member of a JSON object called Name or name, else the default, as text."""
    field = lambda k: F.get_json_object(c, f"$.{k}")
    return F.coalesce(field(name[:1].upper() + name[1:]), field(name[:1].lower() + name[1:]), F.lit(str(default)))


def json_list(c: Column, name: str, kind: str = "int") -> Column:
    """A member of a JSON object if it is a list of that kind, else null."""
    return F.try_variant_get(F.try_parse_json(c), f"$.{name}", f"array<{kind}>")


def full_name(first: Column, last: Column) -> Column:
    """Both with a space between; null counts as empty."""
    return F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit("")))


def key_part(c: Column, size: int = 60) -> Column:
    """What lineage keys and titles keep of a text: its first characters."""
    return F.left(c, F.lit(size))


# What an error's detail holds, the status and the message it becomes
ERROR_ROUTES = (
    ("Unsupported file type", 400, "Unsupported file type."),
    ("empty", 400, "Uploaded file is empty."),
    ("Failed to read file", 422, "File could not be decoded as UTF-8."),
    ("Message cannot be empty", 400, "Chat message cannot be empty."),
)
REJECTED = (400, "AI agent rejected the request.")


def error_route(detail: Column) -> Column:
    """struct(status, message) of an error's detail, by the first route that fits; null without a detail."""
    made = lambda status, message: F.struct(F.lit(status).alias("status"), F.lit(message).alias("message"))
    out = F.coalesce(*(F.when(F.contains(detail, F.lit(w)), made(s, m)) for w, s, m in ERROR_ROUTES), made(*REJECTED))
    return F.when(detail.isNotNull(), out)


def family_key(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))
