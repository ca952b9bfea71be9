"""Detection rules: confirmation, localization and sinks, by family."""

from functools import reduce
from operator import or_

from pyspark.sql import Window
from pyspark.sql import functions as F

from codequarry.functions.lines import let, split_lines
from codequarry.functions.text import code_part, contains_any

# Families in the order of their ids
FAMILIES = ("CSRF", "Insecure Cryptography", "Insecure Deserialization", "OS Command Injection", "Path Traversal", "SQL Injection", "XML Injection", "XSS")

# Keywords that confirm a family, in any case
CONFIRMATION = {
    "XSS": ("innerHTML", "outerHTML", "document.write", "insertAdjacentHTML", ".html(", "dangerouslySetInnerHTML"),
    "Insecure Deserialization": ("eval(", "new Function(", "pickle.loads", "ObjectInputStream", "yaml.load", "unserialize(", "readObject("),
    "SQL Injection": ("SELECT ", "INSERT ", "UPDATE ", "DELETE ", "DROP ", "UNION ", "executeQuery", "execute(", "cursor.execute", "query(", "prepareStatement", "createQuery", "nativeQuery"),
    "OS Command Injection": ("exec(", "system(", "popen(", "subprocess", "Runtime.exec", "ProcessBuilder", "child_process", "spawn(", "shell=True", "os.system"),
    "Path Traversal": ("../", "..\\", "os.path", "open(", "readFile(", "getResourceAsStream", "new File(", "path.join", "include("),
    "CSRF": ("fetch(", "XMLHttpRequest", "$.ajax", "axios", "<form", 'method="post"', ".post(", ".submit("),
    "XML Injection": ("xml", "xpath", "XMLParser", "DocumentBuilder", "SAXParser", "etree", "minidom", "lxml", "parseXML", "loadXML", "xmlDoc"),
    "Insecure Cryptography": ("md5(", "sha1(", "des-cbc", "des-ecb", "des-ede", "RC4", "ECB", "base64", "rot13", "createHash", "createCipher", "crypto.", "math.random("),
}
# Route handlers, where a CSRF finding is anchored
ROUTES = ("router.post(", "router.put(", "router.patch(", "router.delete(", "app.post(", "app.put(", "app.patch(", "app.delete(")
LOCALIZATION = {**CONFIRMATION, "CSRF": ROUTES}

# Patterns of the extra conditions (the last two over lower-cased text)
DYNAMIC_XSS = (r"""innerHTML\s*=\s*(?!['"`\s<])""", r"""outerHTML\s*=\s*(?!['"`\s<])""", r"""document\.write\s*\(\s*(?!['"`])""")
BROKEN_CRYPTO = r"\bmd5\s*\(|\bsha1\s*\(|\brc4\b|\becb\b|\bdes(?:-cbc|-ecb|-ede(?:3)?)?\b|\bcreatehash\s*\(|\bcreatecipher(?:iv)?\s*\(|\bcrypto\."
SECRET = "(token|key|secret|password|nonce|salt|seed)"
NEAR_SECRET = (rf"{SECRET}[^\n]{{0,40}}random|random[^\n]{{0,40}}{SECRET}", rf"{SECRET}[^\n]{{0,50}}(base64|rot13|atob|btoa)|(base64|rot13|atob|btoa)[^\n]{{0,50}}{SECRET}")

# Sinks, in any case
SINKS = {
    "XSS": (r"""\b(?:innerHTML|outerHTML)\s*=\s*(?!['"`])""", r"""\bdocument\.write\s*\(\s*(?!['"`])""", r"\binsertAdjacentHTML\s*\("),
    "Insecure Deserialization": (r"\beval\s*\(", r"\bnew\s+Function\s*\(", r"\bpickle\.loads\s*\(", r"\byaml\.load\s*\(", r"\bunserialize\s*\(", r"\bObjectInputStream\b", r"\breadObject\s*\("),
}


def any_match(c, patterns, flags=""):
    return reduce(or_, (c.rlike(flags + p) for p in patterns))


def confirmed(label, text, rules=None):
    """Whether rules confirm a detection of a family; families without rules are."""
    rules = CONFIRMATION if rules is None else rules
    low = F.lower(text)
    out = F.lit(True)
    for family, words in rules.items():
        hit = contains_any(text, words, ignore_case=True)
        if family == "XSS" and rules is CONFIRMATION:
            hit &= any_match(text, DYNAMIC_XSS)
        if family == "Insecure Cryptography" and rules is CONFIRMATION:
            hit &= low.rlike(BROKEN_CRYPTO) | any_match(low, NEAR_SECRET)
        out = F.when(label == family, hit).otherwise(out)
    return out


def _hits(label, lines, start, end, rules):
    """Line numbers (start is the first line's) that hold a rule of the family, `end` at most."""
    numbered = F.transform(lines, lambda x, i: F.struct((start + i).alias("n"), x.alias("x")))
    out = F.array().cast("array<int>")
    for family, words in rules.items():
        own = F.transform(F.filter(numbered, lambda r: (r["n"] <= end) & contains_any(r["x"], words, ignore_case=True)), lambda r: r["n"].cast("int"))  # noqa: B023
        out = F.when(label == family, own).otherwise(out)
    return out


def localized(label, text, start, end, narrow=None, broad=None):
    """Lines of a finding: by the narrow rules, else the broad ones, else its first line."""
    narrow, broad = narrow or LOCALIZATION, broad or CONFIRMATION

    def made(x):
        a, b = _hits(label, x, start, end, narrow), _hits(label, x, start, end, broad)
        return F.when(F.size(a) > 0, a).when(F.size(b) > 0, b).otherwise(F.array(start.cast("int")))

    return let(split_lines(text), made)


def sink_windows(df, key, text, radius=7, most=64, sinks=None):
    """Windows of `radius` lines around the first sink of each family and bucket of lines; `most` for a text, in line order."""
    # hits are found inside the row: only they, not all lines, go on
    def found(x):
        def families(line, i):
            part = code_part(line)
            own = F.array(*(F.when(any_match(part, p, "(?i)"), F.lit(f)) for f, p in (sinks or SINKS).items()))
            return F.transform(F.filter(own, lambda f: f.isNotNull()), lambda f: F.struct((i + 1).alias("line"), f.alias("hint_family")))

        return F.flatten(F.transform(x, families))

    rows = df.select(key, split_lines(F.col(text)).alias("_all"))
    hits = rows.select(key, F.explode(found(F.col("_all"))).alias("h")).select(key, "h.*")
    bucket = F.greatest(F.lit(1), F.floor(F.col("line") / radius))
    first = hits.withColumn("_b", bucket).withColumn("_r", F.row_number().over(Window.partitionBy(key, "hint_family", "_b").orderBy("line"))).filter("_r = 1")
    kept = first.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("line", "hint_family"))).filter(F.col("_r") <= most)
    near = kept.groupBy(key).agg(F.collect_list(F.struct("hint_family", "line")).alias("_h"))
    lo, hi = F.greatest(F.lit(1), F.col("h.line") - radius), F.least(F.size("_all"), F.col("h.line") + radius)
    out = rows.join(near, key).select(key, "_all", F.explode("_h").alias("h"))
    return out.select(key, "h.hint_family", F.col("h.line").alias("sink_line"), lo.alias("start_line"), hi.alias("end_line"), F.array_join(F.slice("_all", lo, hi - lo + 1), "\n").alias("text"))
