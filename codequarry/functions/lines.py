"""Expressions over the lines of a text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.functions.text import strip, wp_tokens

#: Separators of str.splitlines besides \n
BREAKS = r"\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once for a row."""
    return F.transform(F.array(value), body)[0]


def lines(c: Column) -> Column:
    """At every \\n; a text ends with a line of its own."""
    return F.split(c, "\n", -1)


def split_lines(c: Column) -> Column:
    """At any line break, without an empty last line."""
    parts = F.split(F.regexp_replace(c, BREAKS, "\n"), "\n", -1)
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def windows(c: Column, size: int = 24, stride: int = 12) -> Column:
    """array<struct(text, start_line, end_line)>: windows of lines, the last one ends with the text."""

    def made(x):
        n = F.size(x)
        count = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / stride).cast("int") + 1)
        starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.struct(F.array_join(F.slice(x, k * stride + 1, size), "\n").alias("text"), (k * stride + 1).alias("start_line"), F.least(k * stride + size, n).alias("end_line")))

    return let(split_lines(c), made)


def numbered(c: Column, first: int = 1) -> Column:
    """Lines with their right-aligned numbers."""
    def made(x):
        width = F.length((F.size(x) + first - 1).cast("string"))
        return F.array_join(F.transform(x, lambda s, i: F.concat(F.lpad((i + first).cast("string"), width, " "), F.lit(" | "), s)), "\n")

    return let(split_lines(c), made)


def truncated(c: Column, budget) -> Column:
    """The leading lines whose estimated tokens fit the budget, with closing braces for those left open by a cut."""
    budget = F.lit(budget) if not isinstance(budget, Column) else budget

    def made(x):
        start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(True).alias("on"))

        def step(a, line):
            total = a["sum"] + wp_tokens(line)
            on = a["on"] & (total <= budget)
            return F.struct((a["n"] + on.cast("int")).alias("n"), F.when(on, total).otherwise(a["sum"]).alias("sum"), on.alias("on"))

        kept = F.aggregate(x, start, step, lambda a: a["n"])
        return F.struct(F.array_join(F.slice(x, 1, kept), "\n").alias("text"), (kept < F.size(x)).alias("cut"))

    return let(let(lines(c), made), lambda r: F.concat(r["text"], F.when(r["cut"] & (open_braces(r["text"]) > 0), F.concat(F.lit("\n"), F.repeat(F.lit("}\n"), open_braces(r["text"])))).otherwise("")))


def open_braces(c: Column) -> Column:
    return F.length(F.replace(c, F.lit("}"), F.lit(""))) - F.length(F.replace(c, F.lit("{"), F.lit("")))


def pair_budget(vuln: Column, safe: Column, budget: int, floor: int) -> Column:
    """struct(vuln, safe): budgets in the ratio of the two sizes, each at least the floor."""
    total = F.greatest(vuln + safe, F.lit(1))
    return F.struct(*(F.greatest(F.lit(floor).cast("long"), F.floor(budget * x / total)).alias(name) for name, x in (("vuln", vuln), ("safe", safe))))


def fitted(vuln: Column, safe: Column, chars: int, tokens: int, floors=(240, 60, 70, 65)) -> Column:
    """struct(vuln, safe): a pair cut to its budgets, first of characters, then of tokens.

    floors: least characters of the first text, least tokens of the two texts
    under the budget of characters, least tokens of the first under that of
    tokens.  What the first text's share leaves is the second's.
    """
    long = lambda x: F.length(x).cast("long")

    def share(budget, a, b, floor):
        return F.greatest(F.lit(floor).cast("long"), F.floor(budget * a / F.greatest(a + b, F.lit(1))))

    def both(v, s):
        return F.struct(v.alias("vuln"), s.alias("safe"))

    def by_chars(x):
        v, s = x["vuln"], x["safe"]
        own = share(chars, long(v), long(s), floors[0])
        short = both(
            F.when(long(v) > own, truncated(v, F.greatest(F.lit(floors[1]).cast("long"), F.floor(own / 4)))).otherwise(v),
            F.when(long(s) > chars - own, truncated(s, F.greatest(F.lit(floors[2]).cast("long"), F.floor((chars - own) / 4)))).otherwise(s),
        )
        return F.when(long(v) + long(s) > chars, short).otherwise(x)

    def by_tokens(x):
        v, s = x["vuln"], x["safe"]
        a, b = wp_tokens(v), wp_tokens(s)
        own = share(tokens, a, b, floors[3])
        short = both(F.when(a > own, truncated(v, own)).otherwise(v), F.when(b > tokens - own, truncated(s, tokens - own)).otherwise(s))
        return F.when(a + b > tokens, short).otherwise(x)

    return let(let(both(vuln, safe), by_chars), by_tokens)


def depths(c: Column, opens: str = "{", closes: str = "}") -> Column:
    """Depth of nesting before each line; a closing character at depth 0 does nothing."""
    def step(a, line):
        marks = F.regexp_extract_all(line, F.lit(r"([\%s\%s])" % (opens, closes)), F.lit(1))
        after = F.aggregate(marks, a["now"], lambda d, m: F.greatest(F.lit(0), d + F.when(m == opens, 1).otherwise(-1)))
        return F.struct(after.alias("now"), F.concat(a["out"], F.array(a["now"])).alias("out"))

    start = F.struct(F.lit(0).alias("now"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(split_lines(c), start, step, lambda a: a["out"])


def stripped_set(c: Column) -> Column:
    """Distinct non-blank stripped lines."""
    return F.array_distinct(F.filter(F.transform(lines(c), strip), lambda x: x != ""))


def least_indent(c: Column) -> Column:
    solid = F.filter(lines(c), lambda x: strip(x) != "")
    return F.coalesce(F.array_min(F.transform(solid, lambda x: F.length(x) - F.length(F.regexp_replace(x, r"\A\s+", "")))), F.lit(0))


def dedented(c: Column) -> Column:
    """Without the common indent; tabs are two spaces, white space at the end goes."""
    cut = lambda n: F.transform(lines(c), lambda x: F.when(F.length(x) >= n, F.substring(x, n + 1, F.length(x))).otherwise(x))
    return F.regexp_replace(F.replace(F.array_join(let(least_indent(c), cut), "\n"), F.lit("\t"), F.lit("  ")), r"\s+\z", "")


OPEN_SCRIPT = r"(?i)<script(?![^>]*\bsrc\s*=)[^>]*>"
CLOSE_SCRIPT = r"(?i)</script\s*>"


def script_lines(c: Column) -> Column:
    """array<struct(line, text)>: the lines inside script elements; lines with their tags are left out.

    A line that opens and closes while outside opens only.
    """

    def step(a, x):
        opens, closes = x["text"].rlike(OPEN_SCRIPT), x["text"].rlike(CLOSE_SCRIPT)
        inside = a["inside"]
        emit = inside & ~closes
        now = F.when(inside, ~closes).otherwise(opens)
        return F.struct(now.alias("inside"), F.when(emit, F.concat(a["out"], F.array(x))).otherwise(a["out"]).alias("out"))

    x = F.transform(split_lines(c), lambda s, i: F.struct((i + 1).alias("line"), s.alias("text")))
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<struct<line:int,text:string>>").alias("out"))
    return F.aggregate(x, start, step, lambda a: a["out"])


def mapped(line: Column, line_map: Column) -> Column:
    """The line that a map (array, 1-based) gives, or the line itself outside of it."""
    return F.coalesce(F.when(line > 0, F.get(line_map, line - 1)), line)


def patched(c: Column, start: Column, end: Column, replacement: Column) -> Column:
    """Lines start to end (1-based, inclusive) replaced."""
    return let(split_lines(c), lambda x: F.array_join(F.concat(F.slice(x, F.lit(1), F.greatest(start - 1, F.lit(0))), split_lines(replacement), F.slice(x, end + 1, F.greatest(F.size(x) - end, F.lit(0)))), "\n"))


def new_imports(imports: Column, source: Column) -> Column:
    """Distinct trimmed imports, in order, that the source hasn't."""
    return F.filter(F.array_distinct(F.filter(F.transform(imports, strip), lambda x: x != "")), lambda x: ~F.contains(source, x))


IMPORT = r"\A\s*(import\b|from\s+\S+\s+import\b|(const|let|var)\s+.*=\s*require\(|#include\b|using\s+[\w.]+;)"


def context(c: Column, start: Column, end: Column, limit: int = 12000, pad: int = 25) -> Column:
    """What a repair is shown: the whole numbered text up to `limit` characters, else its imports and the region with `pad` lines on both sides."""

    def part(x):
        lo, hi = F.greatest(F.lit(1), start - pad), F.least(F.size(x), end + pad)
        width = F.length(F.size(x).cast("string"))
        near = F.transform(F.slice(x, lo, F.greatest(hi - lo + 1, F.lit(0))), lambda s, i: F.concat(F.lpad((i + lo).cast("string"), width, " "), F.lit(" | "), s))
        imports = F.array_join(F.filter(x, lambda s: s.rlike(IMPORT)), "\n")
        pieces = F.filter(F.array(imports, F.array_join(near, "\n")), lambda p: strip(p) != "")
        return F.array_join(pieces, "\n\n")

    return F.when(F.length(c) <= limit, numbered(c)).otherwise(let(split_lines(c), part))


def prompt(template: str, **values: Column) -> Column:
    """A template with its {names} replaced by columns; null is empty."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out
