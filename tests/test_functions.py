"""The expression language (columns against the Python evaluator), text functions, rules and control flow."""

import pytest
from pyspark.sql import functions as F

from quern.functions import px
from quern.functions import text as tx
from quern.operators import procedures as pr
from quern.operators import rules
from quern.plans.procedure import Dataflow, Interpreter, ProcedureError
from quern.sources import store

ROWS = [
    {"s": "Hello World", "n": 7, "f": 2.5, "b": True, "e": "", "d": "12", "l": ["a", "b", "7"], "o": {"k": "x", "m": 3}, "u": "straße"},
    {"s": "snake_caseName x", "n": 0, "f": -1.5, "b": False, "e": "null", "d": "x", "l": [], "o": {"k": "y", "m": 50}, "u": "ÀB"},
    {"s": "", "n": -20, "f": 100.0, "b": True, "e": "undefined", "d": "-3", "l": ["q"], "o": {"k": "z", "m": 10}, "u": "a"},
]
KIND = "s string, n long, f double, b boolean, e string, d string, l array<string>, o struct<k: string, m: long>, u string"
EXPRESSIONS = [
    "len(s)", "len(u)", "len(l)", "len(nothing)", "is_empty(e)", "is_empty(l)", "not_empty(s)", "is_empty(b)", "contains(s, \"o\")", "contains(l, 7)", "starts_with(s, \"He\")", "ends_with(s, \"x\")",
    "uppercase(s)", "cap(s)", "rev(s)", "default(e, \"z\")", "default(n, 5)", "type_of(s)", "type_of(n)", "type_of(b)", "type_of(l)", "type_of(o)", "type_of(nothing)", "one_of(n, 7, 8)", "none_of(s, \"a\", \"\")",
    "if_else(b, s, e)", "coalesce(e, s, \"end\")", "min(n, f, 3)", "max(n, f, s)", "abs(f)", "clamp(n, -5, 5)", "s | snake", "s | kebab", "s | camel", "e | default(\"q\")", "u | truncate(3)", "s | replace(\"o\", \"0\")",
    "s | split(\" \")", "u | pad_left(8, \"*\")", "s | pad_right(4)", "u | repeat(2)", "s | slice(1, 4)", "s | slice(3)", "s | lower | rev | len", "n + f * 2", "(n + f) * 2", "n - 1 - 1", "f / n", "n % 4", "-n + 1", "d + 1", "s + \"!\"",
    "n > 3 && b", "n > 3 || !b", "d == 12", "d == \"12\"", "s == \"\"", "n != 7", "nothing == null", "e == null", "s contains \"World\"", "\"a\" in l", "s matches \"^[A-Z].*d$\"", "s starts_with \"sn\"", "n >= f", "b ? \"y\" : n > 0 ? \"p\" : \"m\"",
    "o.k", "o.m + 1", "l[0]", "l[9]", "match n { 7 => \"seven\", -30..0 => \"neg\", 0 | 1 => \"small\", _ => \"other\" }", "match o { {k: \"x\", m: $v} => v, {m: 40..=50} => \"big\", _ => \"none\" }",
    "match l { (\"a\", _, $z) => z, (_) => \"one\", _ => \"many\" }", "match s { $t if len(t) > 12 => \"long\", \"\" => \"empty\", _ => \"short\" }",
]


@pytest.fixture(scope="module")
def tables(spark):
    typed = spark.createDataFrame(ROWS, KIND).withColumn("i", F.monotonically_increasing_id()).coalesce(1)
    variant = store.nodes_from_json(spark, [(str(i), r) for i, r in enumerate(ROWS)]).coalesce(1)
    return typed, variant


def test_columns_agree_with_python(tables):
    typed, variant = tables
    cols = [px.to_column(px.parse(e), px.Scope(typed)).string.alias(f"c{i}") for i, e in enumerate(EXPRESSIONS)]
    got = typed.orderBy("i").select(*cols).collect()
    for row, data in zip(got, ROWS):
        for i, e in enumerate(EXPRESSIONS):
            want = px.as_text(px.evaluate(e, data))
            assert row[f"c{i}"] == want, (e, data)


def test_variant_columns_agree_with_python(tables):
    _, variant = tables
    some = [e for e in EXPRESSIONS if "match l" not in e and not e.startswith(("type_of(l", "l["))]
    cols = [px.to_column(px.parse(e), px.Scope(variant, "data")).string.alias(f"c{i}") for i, e in enumerate(some)]
    for row, data in zip(variant.orderBy("id").select(*cols).collect(), ROWS):
        for i, e in enumerate(some):
            want = px.as_text(px.evaluate(e, data))
            assert row[f"c{i}"] == want, (e, data)


def test_interpolation_and_errors(tables):
    typed, _ = tables
    got = [r[0] for r in typed.orderBy("i").select(px.interpolate(typed, "${s | upper}-${n + 1}-${nope}-${(}")).collect()]
    assert got[0] == "HELLO WORLD-8-${nope}-${(}"
    for bad in ("", "1 +", "f(", "match x { }}", "s | nothing", "\"open"):
        with pytest.raises(px.PxError):
            px.to_column(px.parse(bad), px.Scope(typed))


def test_interpreter():
    seen = []
    it = Interpreter({"add": lambda p: p["a"] + p["b"], "fail": lambda p: 1 / 0, "flaky": lambda p: seen.append(1) or (1 / 0 if len(seen) < 3 else "ok")}, sleep=lambda s: None)
    out = it.run([
        {"kind": "define", "name": "xs", "value": []}, {"kind": "define", "name": "t", "expr": "n * 2"},
        {"kind": "loop", "over": "items", "as": "x", "steps": [{"kind": "when", "condition": "x > 1", "steps": [{"kind": "append", "to": "xs", "value": "$x"}]}]},
        {"kind": "call", "name": "add", "params": {"a": "$t", "b": 1}, "output": "sum"},
        {"kind": "emit", "event": "done", "data": {"m": "sum is ${sum}"}},
        {"kind": "match", "subject": "sum", "arms": [{"pattern": "1..5", "steps": [{"kind": "abort"}]}, {"pattern": "$k", "guard": "k > 6", "steps": [{"kind": "define", "name": "hit", "expr": "k"}]}]},
        {"kind": "try", "steps": [{"kind": "call", "name": "fail"}], "catch": [{"kind": "define", "name": "caught", "expr": "error"}]},
        {"kind": "try", "retry": 3, "delay": 1, "backoff": "exponential", "steps": [{"kind": "call", "name": "flaky", "output": "flaky"}]},
        {"kind": "parallel", "branches": {"a": [{"kind": "return", "expr": "sum"}], "b": [{"kind": "call", "name": "fail"}]}, "fail": "complete", "output": "both"},
        {"kind": "return", "expr": "xs"}, {"kind": "abort"},
    ], {"items": [1, 2, 3], "n": 3})
    assert out.value == [2, 3] and out.variables["sum"] == 7 and out.variables["hit"] == 7 and "division" in out.variables["caught"]
    assert out.variables["flaky"] == "ok" and out.variables["both"]["a"] == 7 and "error" in out.variables["both"]["b"]
    assert out.events == [{"event": "done", "data": {"m": "sum is 7"}}]
    with pytest.raises(ProcedureError):
        it.run([{"kind": "parallel", "branches": {"b": [{"kind": "call", "name": "fail"}]}}])
    it.procedures = {"inc": [{"kind": "return", "expr": "input + 1"}], "rec": [{"kind": "call", "name": "rec"}]}
    assert it.pipe(["inc", "inc"], 1) == 3
    with pytest.raises(ProcedureError):
        it.run([{"kind": "call", "name": "rec"}])


def test_dataflow():
    d = Dataflow()
    d.register("sum", ["a", "b"], "c", lambda x, y: x + y)
    d.register("big", ["c"], "out", lambda x: x if x > 3 else None)
    for x in (1, 2, 3):
        d.push("a", x)
    d.push("b", 1)
    d.push("b", 5)
    assert d.run() == 4 and [x.value for x in d.queues["out"]] == [7] and d.queues["out"][0].lineage == ("sum", "big")
    d.register("loop", ["out"], "out", lambda x: x)
    assert d.run() <= 30


def test_keywords_and_measures(spark):
    text = "The quick-quick fox's den, the DEN; don't! a1b _x_ éa \n über über"
    assert tx.keyword_list(text) == ["den", "über", "a1b", "don't", "fox's", "quick-quick", "éa"]
    row = spark.createDataFrame([(text,), ("",)], "t string").select(tx.keywords(F.col("t")).alias("k"), tx.word_count(F.col("t")).alias("w"), tx.sentence_count(F.col("t")).alias("s")).collect()
    assert row[0].k[:2] == ["den", "über"] and row[0].w == 12 and row[0].s == 1 and row[1].s == 0 and row[1].k == []


LOG = "\n".join(f'2024-01-0{k} 10:15:0{k}.123Z INFO [req-1a2{k}] GET /x took {k}5ms from 10.0.0.{k}:80 id=3f2b11ee-8f3d-0242-ac13-000{k}0242ac13 n={k}' for k in range(1, 7))


def test_log_templates():
    assert tx.mask_line("2024-01-02T03:04:05+01:00 x=1 y=\"a b\" z= 5 12 3.5 0xFF beef dead1 500msg 7s 1.2.3.4") == '<TS> x=<KV> y=<KV> z= <INT> <INT> 3.5 <HEX> <HEX> <HEX> 500msg <DUR> <IP>'
    assert tx.mask_line("550e8400-e29b-41d4-a716-446655440000 ok") == "<UUID> ok"
    out = tx.compress_log(LOG)
    assert out.count("\n") == 0 and out.startswith(LOG.split("\n")[0]) and "[x6 ~ " in out
    assert tx.compress_log("same\nsame\nother") == "same  [x2]\nother"
    assert tx.compress_one(tx.compress_one(LOG, "log"), "log") == tx.compress_one(LOG, "log")


CODE = "use std::io;\n" + "\n".join(f"pub fn f{k}(x: i32) -> i32 {{\n    let y = x + {k};\n    y * 2;\n}}" for k in range(8))


def test_content_types_and_compression(spark):
    prose = " ".join(f"This is sentence number {k} of the text." for k in range(20))
    error = "Error: it failed\nCaused by: nothing\n  at f (a.js:1)\n  at g (b.js:2)\n" + "x" * 200
    texts = [("  {\"a\": 1}", "json"), ("[1, 2]", "json"), ("[INFO] a\n[INFO] b\n[WARN] c", "log"), (LOG, "log"), (CODE, "code"), ("def f(): pass", "code"), (error, "error"), (prose, "prose"), ("", "prose")]
    df = spark.createDataFrame(texts, "t string, want string")
    rows = df.select("t", "want", tx.content_type(F.col("t")).alias("kind"), tx.compress(F.col("t")).alias("c")).collect()
    for r in rows:
        assert r.kind == r.want, r.t
        assert len(r.c.encode()) <= len(r.t.encode())
    by = {r.want: r.c for r in rows if len(r.t) > 200}
    assert by["code"].startswith("// [headroom: rust body elided — 8 signature(s) kept]") and "[… 14 sentences elided …]" in by["prose"]


def test_rules(spark):
    rows = [("a", "", None, 0.1, 1, "main"), ("b", "write_x", None, 0.6, 4, "main"), ("c", "write_x", "team", 0.95, 1, "group"), ("d", "read", "", 0.2, 2, "main")]
    df = spark.createDataFrame(rows, "id string, action_type string, resource_owner string, risk_score double, privilege_level int, session_type string")
    df = df.select("id", "action_type", "session_type", F.struct("resource_owner", "risk_score", "privilege_level").alias("metadata"))
    got = {(r.id, r.constraint_id) for r in rules.evaluate(df, rules.SEED_RULES).collect()}
    assert got == {("a", "C-0001"), ("b", "C-0002"), ("b", "C-0003"), ("b", "C-0005"), ("c", "C-0004"), ("c", "C-0005")}
    blocked = {r.id: (r.blocked, r.warnings) for r in rules.on_action(df, rules.SEED_RULES).collect()}
    assert blocked["d"] == (False, []) and blocked["c"] == (True, ["C-0005"])
    one = rules.compile_nl("risk_score <= 0.5 and privilege_level < 3", "N")
    assert {r.id for r in rules.evaluate(df, [one]).collect()} == {"b", "c"} and one.severity == "warning"
    assert rules.compile_nl("Block all writes", "N").description.startswith(rules.UNPARSED)
    assert rules.compile_nl("write actions must have resource_owner", "N").severity == "error"
    session = rules.Constraint("S", rules.SessionIs("group"), rules.FieldEq("resource_owner", "nobody"))
    assert [r.id for r in rules.evaluate(df, [session]).collect()] == ["c"]


def test_uuid5(spark):
    import pandas as pd

    names = ["sft:a:b", "", "dpo:ä:1:2"]
    got = [r.u for r in spark.createDataFrame([(n,) for n in names], "n string").select(pr.uuid5(pr.PAIR_NAMESPACE, F.col("n")).alias("u")).collect()]
    assert got == pr.uuid5_python(pd.Series(names)).tolist()


def plain_content_type(text):
    """The rules line by line."""
    import re

    body = re.sub(r"\r?\n\Z", "", text)
    lines = re.split(r"\r?\n", body) if text else []
    left = re.sub(r"^\s+", "", text, flags=re.A)
    if left[:1] in ("{", "[") and not re.search(r"^\[(ERROR|WARN|INFO|DEBUG|TRACE)\]|^\[\d{4}-\d{2}-\d{2}", left):
        return "json"
    head = [l.strip(" ") for l in lines[:10]]
    if len(head) >= 3 and sum(bool(re.search(tx._LOG_LINE, l) or re.search(tx._STAMPED, l)) for l in head) >= 2:
        return "log"
    words = re.compile(r"^(fn |pub fn |pub\(crate\) fn |def |function |async fn |class |impl |struct |enum |trait |const |let |use |import |from |#\[)")
    if len(lines) <= 2:
        code = bool(re.search(tx._SHORT_CODE, text.strip(" ")))
    else:
        structure = sum(("{" in l or "}" in l) + l.startswith(("    ", "\t")) + l.rstrip(" ").endswith(";") for l in lines) / (3 * len(lines))
        code = structure > 0.15 and sum(bool(words.search(l.strip(" "))) for l in lines) / len(lines) > 0.05
    if code:
        return "code"
    signs = ["panicked at" in text, "Traceback" in text, "stack trace" in text, "thread '" in text and "panicked" in text, "Caused by:" in text]
    signs += [any(re.search(r"^(Error:|error:|error\[)", l.strip(" ")) for l in lines), any(l.strip(" ").startswith("Exception:") for l in lines)]
    signs.append(sum(l.strip(" ").startswith("at ") and ("(" in l or "::" in l) for l in lines) >= 2)
    return "error" if sum(signs) >= 2 else "prose"


def test_content_types_against_plain_lines(spark):
    import random

    rng = random.Random(4)
    parts = ["\n", "\r\n", "\r", "    ", "\t", "{", "}", ";", "; ", "def f", "let ", "let x", "use  ", "fn a()", "#[x", " at f(", " at g::h", "Error: no", "Exception:", "Caused by:", "Traceback", "2024-01-02 10:00:00 x", " INFO ", "[ERROR] a", "word", " ", "[2024-01-01", "[1]"]
    texts = ["", "\n", "\r\n", "a\n\n"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.k for r in df.select("i", tx.content_type(F.col("t")).alias("k")).collect()}
    wrong = [(t, got[i], plain_content_type(t)) for i, t in enumerate(texts) if got[i] != plain_content_type(t)]
    assert not wrong, wrong[:3]
    assert len({got[i] for i in got}) == 5


@pytest.mark.parametrize(
    "text, lang, kept",
    [
        ("fn main() {\n    let x = 1;\n}\npub struct A {\n}", "rust", ["fn main() {", "pub struct A {"]),
        ("import os\ndef f(x):\n    return x\nclass B:\n    pass\nasync def g():\n    pass", "python", ["def f(x):", "class B:", "async def g():"]),
        ("function a() {}\nconst f = (x) => {\n};\nvar y = 2;", "javascript", ["function a() {}", "const f = (x) => {"]),
        ("public class A {\n  int size() {\n  }\n  // no(t);\n}", "java", ["int size() {"]),
        ("#include <x>\nint main() {\n  std::cout;\n}", "cpp", ["int main() {"]),
        ("package main\nfunc f() {\n}\nx := g(1)", "go", ["func f() {", "x := g(1)"]),
        ("SELECT a, count(*) FROM t\nWHERE b", "sql", ["SELECT a, count(*) FROM t"]),
        ("plain (words) here\nno brackets", "unknown", ["plain (words) here"]),
    ],
)
def test_languages_and_signatures(text, lang, kept):
    assert tx.language(text) == lang and tx.signatures(text, lang) == kept
    assert tx.compress_code(text).splitlines()[1:] == kept
