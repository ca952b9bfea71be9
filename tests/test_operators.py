"""Operators that have no SQL, and boundary cases, against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from codequarry.functions import lines as L
from codequarry.functions import text as T
from codequarry.operators import chat, dedup, detect, gates, intervals, repair, specs
from codequarry.sources import io
from codequarry.streaming import streams


def column(spark, rows, expression, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("c"))).collect()]


def test_windows_have_the_closed_form(spark):
    texts = ["\n".join(f"l{i}" for i in range(n)) for n in (1, 24, 25, 36, 37, 60)]
    for text, got in zip(texts, column(spark, texts, lambda c: L.windows(c)), strict=True):
        n, want, start = len(text.split("\n")), [], 0
        while True:
            want.append((start + 1, min(start + 24, n)))
            if start + 24 >= n:
                break
            start += 12
        assert [(w["start_line"], w["end_line"]) for w in got] == want
    assert column(spark, [""], lambda c: L.windows(c)) == [[]]


def test_text_functions(spark):
    assert column(spark, ["&amp;lt;b&#65;&#66;c", "x", ""], T.decode_entities) == ["<bABc", "x", ""]
    reply = "**VULN:**\n```python\na = 1\n```\n**SAFE:**\n```\nb = 2\n```"
    assert column(spark, [reply], T.parse_blocks)[0].asDict() == {"vuln": "a = 1", "safe": "b = 2"}
    assert column(spark, ["SAFE:\nx"], T.parse_blocks) == [None]
    assert column(spark, ["א a", "1 a א", "12"], T.leading_direction) == ["rtl", "ltr", "auto"]
    assert column(spark, ["", "abcdefg", "x" * 8], T.wp_tokens) == [1, 2, 2]
    assert column(spark, ["a\r\nb\x0cc\n", ""], L.split_lines) == [["a", "b", "c"], []]
    assert column(spark, ["C++", "python", None, "Go"], T.language_name) == ["cpp", "py", "", "go"]
    assert column(spark, ["a\nb\nc"], lambda c: L.patched(c, F.lit(2), F.lit(2), F.lit("x\ny"))) == ["a\nx\ny\nc"]


def test_truncation_closes_braces(spark):
    got = column(spark, ["f() {\n" + "x" * 70 + "\n}"], lambda c: L.truncated(c, 5))
    assert got == ["f() {\n}\n"]


def greedy(sets, percent):
    kept = []
    for i, s in enumerate(sets):
        if not any(s and sets[k] and 100 * len(s & sets[k]) >= percent * len(s | sets[k]) for k in kept):
            kept.append(i)
    return kept


def test_greedy_accept_is_the_loop(spark):
    rnd = random.Random(3)
    texts = []
    for _ in range(60):
        if texts and rnd.random() < 0.6:
            words = rnd.choice(texts).split()
            for _ in range(rnd.randint(0, 3)):
                words[rnd.randrange(len(words))] = rnd.choice("abcdefgh")
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(1, 30))))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = [set(r["grams"]) for r in dedup.fingerprints(df, "id", "text").orderBy("id").collect()]
    got = {r["id"] for r in dedup.accepted(df, "id", "text", percent=60).filter("accepted").collect()}
    assert got == set(greedy(sets, 60))


def test_merge_and_overlap(spark):
    rows = [(1, 1, 5, 0.5, 0), (1, 10, 12, 0.9, 1), (1, 18, 20, 0.1, 2), (1, 2, 3, 0.7, 3)]
    df = spark.createDataFrame(rows, "f int, start int, end int, confidence double, seq int")
    got = sorted(tuple(r) for r in intervals.merged(df, ["f"], 5).select("start", "end", "confidence", "seq").collect())
    assert got == [(1, 12, 0.9, 0), (18, 20, 0.1, 2)]


def test_overlapping_keeps_every_pair(spark):
    rnd = random.Random(5)
    rows = [(rnd.randrange(3), rnd.choice("AB"), s := rnd.randrange(20), s + rnd.randrange(-1, 9), i // 2) for i in range(400)]
    rows += [(0, "A", 3, 9, 1000 + i) for i in range(150)]
    odd = [(None, "A", 0, 99, 2000), (0, None, 0, 99, 2001), (0, "A", 0, 99, None)]
    df = spark.createDataFrame(rows + odd, "f int, g string, start int, end int, seq int")
    got = sorted(tuple(r) for r in intervals.overlapping(df, ["f", "g"]).collect())
    expected = [(*x[:2], x[4], y[4]) for x in rows for y in rows if x[:2] == y[:2] and x[4] < y[4] and min(x[3], y[3]) > max(x[2], y[2])]
    assert got == sorted(expected)


@pytest.mark.parametrize(
    "raw, reason",
    [
        ("nope", "not an object"),
        ('{"status": "repaired"}', "missing fields"),
        ('{"status": "repaired", "replacement_code": "x", "imports": [], "explanation": "", "z": 1}', "extra fields"),
        ('{"status": "odd", "replacement_code": "x", "imports": [], "explanation": ""}', "bad status"),
        ('{"status": "repaired", "replacement_code": " ", "imports": [], "explanation": ""}', "no code"),
        ('{"status": "needs_context", "replacement_code": "x", "imports": [], "explanation": ""}', "code without repair"),
        ('{"status": "repaired", "replacement_code": "x", "imports": ["a"], "explanation": ""}', None),
    ],
)
def test_reply_gate(spark, raw, reason):
    assert column(spark, [raw], gates.reply_gate) == [reason]


def test_cascade_takes_the_first_accepted(spark):
    rows = [(1, 1, 1, "needs_context", None), (1, 1, 2, "repaired", None), (1, 2, 1, "repaired", "bad"), (1, 2, 2, "repaired", None)]
    df = spark.createDataFrame(rows, "f int, phase int, attempt int, status string, reason string")
    assert [(r["phase"], r["attempt"]) for r in chat.cascade(df, ["f"], "reason").collect()] == [(2, 2)]


def test_repair_fold_and_regions():
    text = "import os\n\ndef f(x):\n    return eval(x)\n\ndef g():\n    return 1\n"
    assert repair.region(text, 4, 4, python=True) == (3, 4, "function")
    fixed, applied = repair.fold(text, [(4, 4, "    return int(x)", ["import ast"]), (7, 7, "    return 2", [])])
    assert applied == 2
    assert fixed.splitlines()[:2] == ["import os", "import ast"]
    assert "return int(x)" in fixed and "return 2" in fixed
    js = "function a() {\n  const s = '}';\n  b();\n}\n"
    assert repair.region(js, 3, 3)[:2] == (1, 4)
    assert repair.lex("const a = f(1); // x")[0] == ("keyword", "const")
    assert "".join(v for _, v in repair.lex("a + 'b' # c")) == "a + 'b' # c"


def test_soft_balance(spark):
    rows = [(0, i, "a" if i % 10 else "b") for i in range(300)]
    df = spark.createDataFrame(rows, "g int, i int, k string")
    got = specs.soft_balanced(df, "g", "k", "i").groupBy("k").count().collect()
    counts = {r["k"]: r["count"] for r in got}
    assert counts["b"] == 30 and counts["a"] < 270


def test_model_scorer(spark):
    score = detect.model_scorer(lambda: lambda texts: [(len(t) / 10, {"XSS": 0.5}) for t in texts])
    df = spark.createDataFrame([("abcde",)], "text string")
    assert score(df).first()["vuln_score"] == 0.5


def test_sources(spark, tmp_path):
    pair = {"vuln_code": "a", "state": "XSS", "safe_code": "b", "safe_code_label": "Safe"}
    path = tmp_path / "x.jsonl"
    path.write_text(json.dumps(pair) + "\n\n" + json.dumps(pair) + "\n")
    assert io.read_jsonl(spark, str(path)).count() == 2
    path.write_text(json.dumps(pair) + "\n{bad\n")
    with pytest.raises(Exception):  # noqa: B017
        io.read_jsonl(spark, str(path)).collect()
    assert io.read_checkpoint(spark, str(path)).filter("vuln_code is not null").count() == 1
    assert io.read_checkpoint(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "up").mkdir()
    (tmp_path / "up/a.py").write_bytes(b"x = '\xff'")
    (tmp_path / "up/b.py").write_text("  \n")
    (tmp_path / "up/c.exe").write_text("x")
    rows = io.read_uploads(spark, str(tmp_path / "up")).collect()
    assert [(r["filename"], r["content"]) for r in rows] == [("a.py", "x = '�'")]
    assert io.keys_of({"K": "a, b", "K_2": "c"}, "K") == ["a", "b", "c"]
    df = spark.createDataFrame([("a", "b")], "x string, _y string")
    assert io.export(df).columns == ["x"]


def test_retry_stream_equals_batch(spark, tmp_path):
    rows = [(u, 10 * k + u, (k * 7 + u) % 3 == 0) for u in range(3) for k in range(12)]
    spark.createDataFrame(rows, "user_id long, event_id long, ok boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, event_id long, ok boolean").parquet(str(tmp_path / "in"))
    got = streams.run_available(streams.retry_queue(stream), "sends", str(tmp_path / "cp")).collect()
    want = streams.retry_batch(spark.read.parquet(str(tmp_path / "in"))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_accept_batches(spark, tmp_path):
    words = "one two three four five six seven eight"
    for k in range(2):
        spark.createDataFrame([(10 * k + i, f"{words} {i}" if i else words) for i in range(2)], "id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.accept_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "id", "text")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_context_and_prompt(spark):
    text = "import os\n" + "\n".join(f"line {i}" for i in range(2, 101))
    whole, part = column(spark, ["a\nb", text], lambda c: L.context(c, F.lit(50), F.lit(51), limit=100, pad=1))
    assert whole == "1 | a\n2 | b"
    assert part == "import os\n\n 49 | line 49\n 50 | line 50\n 51 | line 51\n 52 | line 52"
    assert column(spark, ["x", None], lambda c: L.prompt("fix {code} now", code=c)) == ["fix x now", "fix  now"]


@pytest.mark.parametrize("limit", [0, 10])
def test_whitelist_of_any_size(spark, monkeypatch, limit):
    monkeypatch.setattr(specs, "WHITELIST_ROWS", limit)
    rows = [("sql blind", "py"), ("sql blind", "js"), ("sql blind", "js"), ("xss", "js"), ("", "py"), (None, "py"), ("blind", None), ("sqsql", "go")]
    white = spark.createDataFrame([("sql", ["py"]), ("blind", ["py", "js"]), ("xss", None), ("no", ["c"])], "key string, langs array<string>")
    got = specs.allowed(spark.createDataFrame(rows, "subtype string, lang string"), white).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [rows[0], rows[3], rows[4], rows[5], rows[6]]))


def test_retry_stream_in_any_order_and_many_frames(spark, tmp_path):
    rows = [(u, 10 * k + u, (k * 7 + u) % 5 == 0) for u in range(3) for k in range(60)]
    rows += [(0, 100, False), (None, 7, False), (None, 9, True), (1, 1, None), (2, None, False)]
    random.Random(1).shuffle(rows)
    kind = "user_id long, event_id long, ok boolean"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        got = streams.run_available(streams.retry_queue(spark.readStream.schema(kind).parquet(str(tmp_path / "in"))), "sends_many", str(tmp_path / "cp")).collect()
    finally:
        spark.conf.set(name, before)
    last = {u: max(e for x, e, k in rows if x == u and k) for u in (0, 1, 2, None)}
    want = [(u, e, "sent" if k else "queued") for u, e, k in rows]
    want += [(u, e, "flushed") for u, e, k in rows if k is False and e is not None and e < last[u]]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_smallest_enclosing_makes_no_pairs(spark):
    rnd = random.Random(5)
    points = [(k, i, lo, lo + rnd.randint(-1, 6)) for k in (1, 2, 3, None) for i in range(60) for lo in [rnd.randint(0, 40)]] + [(1, 99, None, 3)]
    regions = [(k, lo, lo + rnd.randint(0, 20)) for k in (1, 2, None) for lo in (rnd.randint(0, 40) for _ in range(80))] + [(1, 0, None)]
    got = intervals.smallest_enclosing(spark.createDataFrame(points, "f int, id int, lo int, hi int"), spark.createDataFrame(regions, "f int, start int, end int"), ["f"])
    want = []
    for f, i, lo, hi in points:
        held = [(e - s, s, e) for k, s, e in regions if f is not None and k == f and None not in (e, lo) and s <= lo and e >= hi]
        want += [(f, i, lo, hi, *min(held)[1:])] if held else []
    assert sorted(map(tuple, got.collect())) == sorted(want)
    same = spark.range(3000).selectExpr("1 as f", "id", "2L as lo", "3L as hi")
    many = intervals.smallest_enclosing(same, same.selectExpr("f", "lo as start", "hi as end"), ["f"])
    assert many.count() == 3000
    assert "lo#" not in "".join(x for x in many._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x and "<=" in x)


@pytest.mark.parametrize("block, rows", [(64, 1000), (2, 0)])
def test_near_pairs_keep_no_grams_of_all_rows(spark, monkeypatch, block, rows):
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(40, 80))) for _ in range(80)]
    for k in range(8):
        words = texts[0].split()
        words[rnd.randrange(len(words))] = "x1"
        texts += [" ".join(words)] * (1 + k % 2)
    data = [*enumerate([*texts, "one two", "two one", "", None]), (len(texts), texts[0])]
    df = spark.createDataFrame(data, "id long, text string")
    monkeypatch.setattr(dedup, "BLOCK", block, raising=False)
    monkeypatch.setattr(dedup, "BROADCAST_ROWS", rows, raising=False)
    kept, real = [], dedup.cut

    def cut(x):
        out = real(x)
        kept.extend(out.agg(F.sum(F.size("grams"))).first()[0] or 0 for c in out.columns if c == "grams")
        return out

    monkeypatch.setattr(dedup, "cut", cut)
    got = sorted((r["a"], r["b"], round(r["similarity"], 9)) for r in dedup.near_dup_pairs(df, "id", "text", percent=70).collect())
    sets = [(r["id"], set(r["grams"])) for r in dedup.fingerprints(df, "id", "text").collect()]
    want = [(i, j, round(len(x & y) / len(x | y), 9)) for i, x in sets for j, y in sets if i < j and x and y and 100 * len(x & y) >= 70 * len(x | y)]
    assert got == sorted(want) and len(want) > 40
    assert sum(kept) < sum(len(x) for _, x in sets)
