"""Regions, imports and patches of source files.

Scanners over characters and the fold of patches over a file's lines depend on
every step before; they run in Python by file, through Arrow.
"""

import re

import pandas as pd
from pyspark.sql import functions as F

MAX_REGION, PAD, RELOCATE, BACK = 160, 15, 15, 40
# Import lines by extension, and how far and over how many blank lines they are looked for
_SCRIPT = r"import\s|export\s+.*from\s|(?:const|let|var)\s+.+=\s*require\(|require\("
IMPORT_LINES = {
    "py": r"import\s|from\s+\S+\s+import\s", "js": _SCRIPT, "jsx": _SCRIPT, "ts": _SCRIPT, "tsx": _SCRIPT, "java": r"package\s|import\s", "cs": r"using\s",
    "php": r"require|require_once|include|include_once|use\s", "rb": r"require", "go": r"package\s|import\s",
}
SCANNED, BLANKS = 80, 2
_COMMENT = ("#", "//", "/*", "*")
_HEAD = re.compile(r"\s*([@#*/]|//|async\b|export\b|public\b|private\b|protected\b|static\b)")


# a regular expression literal, and what stands before one
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_BEFORE_REGEX = re.compile(r"(?:\A|[(,=:\[!&|?{};+\-*%~^<>]|\b(?:return|typeof|case|in|of|delete|void|throw))\s*\Z")


def blank_code(text):
    """The text with comments, strings and regular expressions as spaces, so that columns and lines stay.

    The code inside ${ } of a template stays code.
    """
    out, i, n, quote = list(text), 0, len(text), ""
    open_ = []  # braces open inside each ${ }
    blank = lambda a, b: out.__setitem__(slice(a, b), [c if c == "\n" else " " for c in text[a:b]])
    while i < n:
        c, two = text[i], text[i : i + 2]
        if quote:
            if c == "\\":
                blank(i, i + 2)
                i += 2
                continue
            if quote == "`" and two == "${":
                blank(i, i + 2)
                open_.append(0)
                quote, i = "", i + 2
                continue
            if c == quote or c == "\n" and quote != "`":
                quote = ""
            blank(i, i + 1)
            i += 1
        elif two in ("//", "/*"):
            end = text.find("\n" if two == "//" else "*/", i + 2)
            end = n if end < 0 else end if two == "//" else end + 2
            blank(i, end)
            i = end
        elif c == "/" and (m := _REGEX.match(text, i)) and _BEFORE_REGEX.search("".join(out[max(0, i - 40) : i])):
            blank(i, m.end())
            i = m.end()
        elif open_ and c == "}" and not open_[-1]:
            open_.pop()
            blank(i, i + 1)
            quote, i = "`", i + 1
        else:
            if open_ and c in "{}":
                open_[-1] += 1 if c == "{" else -1
            if c in "'\"`":
                blank(i, i + 1)
                quote = c
            i += 1
    return "".join(out)


def brace_blocks(text):
    """(first, last) lines of the blocks in braces."""
    stack, out, line = [], [], 1
    for c in blank_code(text):
        if c == "\n":
            line += 1
        elif c == "{":
            stack.append(line)
        elif c == "}" and stack:
            out.append((stack.pop(), line))
    return out


def python_blocks(text):
    """(first, last) lines of functions, decorators included; none if it doesn't parse."""
    import ast

    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    return [(min([x.lineno, *(d.lineno for d in x.decorator_list)]), x.end_lineno) for x in ast.walk(tree) if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef)]


def region(text, low, high, python=False):
    """(start, end, strategy): the smallest function or block around lines low to high, else a padded window."""
    lines = text.splitlines()
    found = [b for b in (python_blocks(text) if python else brace_blocks(text)) if b[0] <= low and b[1] >= high]
    if found:
        start, end = min(found, key=lambda b: (b[1] - b[0], b[0]))
        if not python:
            for _ in range(BACK):
                if start > 1 and (_HEAD.match(lines[start - 2]) or lines[start - 2].rstrip().endswith("(")):
                    start -= 1
                else:
                    break
        if end - start + 1 <= MAX_REGION:
            return start, end, "function" if python else "block"
    n = max(1, len(lines))
    return max(1, low - PAD), min(n, high + PAD), "window"


def import_place(lines, extension="js"):
    """The number of lines after which an import goes: behind a shebang, a docstring, use strict and the imports at the top."""
    i = 0
    if lines and lines[0].startswith("#!"):
        i = 1
    for quote in ('"""', "'''"):
        if i < len(lines) and lines[i].strip().startswith(quote):
            k = i
            if lines[i].strip().count(quote) < 2:
                k = next((j for j in range(i + 1, len(lines)) if quote in lines[j]), i)
            i = k + 1
            break
    if i < len(lines) and lines[i].strip().strip(";") in ("'use strict'", '"use strict"'):
        i += 1
    return max(i, import_end(lines, extension) or 0)


def import_end(lines, extension="js"):
    """The number of the last import line, or None: comments don't end the imports, other code and three blank lines do."""
    pattern, last, blank = IMPORT_LINES.get(extension), None, 0
    if not pattern:
        return None
    for k, line in enumerate(lines[:SCANNED]):
        if re.match(r"\s*(?:" + pattern + ")", line):
            last, blank = k + 1, 0
        elif not line.strip():
            blank += 1
            if last and blank > BLANKS:
                break
        elif last and not line.strip().startswith(_COMMENT):
            break
    return last


def add_imports(text, imports, extension="js"):
    """The text with the distinct imports that it hasn't."""
    new = [x for x in dict.fromkeys(i.strip() for i in imports) if x and x not in text]
    if not new:
        return text
    lines = text.splitlines()
    at = import_place(lines, extension)
    return "\n".join(lines[:at] + new + lines[at:])


def parses(text):
    """Whether a text is a Python program."""
    import ast

    try:
        ast.parse(text)
    except (SyntaxError, ValueError):
        return False
    return True


def fold(text, patches, extension="js", valid=None):
    """Patches [(start, end, code, imports)] on a file, from the bottom up: (text, applied).

    A patch whose first line has moved is looked for within RELOCATE lines and
    applied only if it is there exactly once.  With a check `valid` of whole
    texts a patch is committed only if the text passes with it.  Imports come
    last; if the text fails with them, it goes without them and the patches
    that need some don't count; if it fails even so, the original stays.
    """
    original = text.splitlines()
    lines, done, imports = list(original), [], []
    valid = valid if valid is not None and valid(text) else None  # a text that fails before tells nothing of patches
    for start, end, code, more in sorted(patches, key=lambda p: -p[0]):
        if not 1 <= start <= end <= len(original):
            done.append(False)
            continue
        anchor = original[start - 1]
        at = start
        if not (start <= len(lines) and lines[start - 1] == anchor):
            near = [k for k in range(max(1, start - RELOCATE), min(len(lines), start + RELOCATE) + 1) if lines[k - 1] == anchor]
            if len(near) != 1:
                done.append(False)
                continue
            at = near[0]
        new = [*lines[: at - 1], *code.splitlines(), *lines[at + end - start :]]
        if valid and not valid("\n".join(new)):
            done.append(False)
            continue
        lines = new
        imports += list(more)
        done.append("needs" if list(more) else True)
    return final(text, "\n".join(lines), imports, done, extension, valid)


def final(original, plain, imports, done, extension="js", valid=None):
    """(text, applied) of a folded text: with its imports, else without them, else the original."""
    whole = add_imports(plain, imports, extension)
    if valid is None or valid(whole):
        return whole, sum(map(bool, done))
    if valid(plain):
        return plain, sum(d is True for d in done)
    return original, 0


def patched_files(files, patches, key, text, extension="js", valid=None):
    """files with repaired text and the number of applied patches.  patches: key, start, end, code, imports; extension and valid as in fold()."""

    def run(_, left, right):
        if not len(left):
            return pd.DataFrame({key: [], "repaired": [], "applied": []})
        rows = [(int(r.start), int(r.end), r.code, list(r.imports)) for r in right.itertuples()]
        out = [fold(t, rows, extension, valid) for t in left[text]]
        return pd.DataFrame({key: left[key], "repaired": [o[0] for o in out], "applied": [o[1] for o in out]})

    kind = files.schema[key].dataType.simpleString()
    return files.groupBy(key).cogroup(patches.groupBy(key)).applyInPandas(run, f"{key} {kind}, repaired string, applied long")


def regions(files, findings, key, text, name):
    """findings (key, low, high) with start, end and strategy of their editable region."""
    def run(batches):
        for pdf in batches:
            found = [region(t, int(a), int(b), n.endswith(".py")) for t, a, b, n in zip(pdf[text], pdf["low"], pdf["high"], pdf[name], strict=True)]
            out = pdf[[key, "low", "high"]].copy()
            out["start"], out["end"], out["strategy"] = ([f[k] for f in found] for k in range(3))
            yield out

    kind = files.schema[key].dataType.simpleString()
    return files.join(findings, key).mapInPandas(run, f"{key} {kind}, low int, high int, start int, end int, strategy string")


def intact(file, code):
    """Whether a file holds a replacement, white space aside."""
    from codequarry.functions.text import normalize_space

    return F.contains(normalize_space(file), normalize_space(code))


# ---- lexer -------------------------------------------------------------------

KEYWORDS = frozenset("and as async await break case catch class const continue def default do elif else enum except export extends final finally for from func function if import in interface is let new not null or package pass private protected public raise return static struct switch this throw try type var void while with yield true false None True False".split())
BUILTINS = frozenset("print len range str int float list dict set open console document window Math JSON Object Array String Number require module".split())
_LEX = re.compile(r"""(?P<comment>//.*|\#.*|/\*.*?(?:\*/|$))|(?P<string>"(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?|`(?:\\.|[^`\\])*`?)|(?P<number>\b\d[\w.]*)|(?P<word>[A-Za-z_$][\w$]*)|(?P<operator>[^\w\s]+?)|(?P<plain>\s+)""")


def lex(line):
    """[(type, value)] of a line: comment, string, number, keyword, builtin, func, operator, plain."""
    out = []
    for m in _LEX.finditer(line):
        kind, value = m.lastgroup, m[0]
        if kind == "word":
            kind = "keyword" if value in KEYWORDS else "builtin" if value in BUILTINS else "func" if line[m.end() :].lstrip().startswith("(") else "plain"
        out.append((kind, value))
    return out


def tokens(df, key, text):
    """(key, line, pos, type, value) of every token."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = [(k, i + 1, j, a, b) for k, t in zip(pdf[key], pdf[text], strict=True) for i, s in enumerate((t or "").split("\n")) for j, (a, b) in enumerate(lex(s))]
            yield pd.DataFrame(rows, columns=[key, "line", "pos", "type", "value"])

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, line int, pos int, type string, value string")
