"""Compiled records, scenarios, lint and guidance."""

import pytest
from pyspark.sql import functions as F

from quern.operators import guidance
from quern.plans import records

RECORDS = [
    {"key": "px:fact/point", "data": {"type": "fact", "name": "point", "fields": [{"name": "x", "type": "int"}, {"name": "t", "type": "string"}]}},
    {"key": "px:constraint/cap", "data": {"type": "constraint", "name": "cap", "when": 'kind == "pay"', "require": "amount <= 100", "severity": "error", "message": "${amount} is too much", "phases": ["before"]}},
    {"key": "px:constraint/warn", "data": {"type": "constraint", "name": "warn", "require": "amount < 50", "severity": "warning"}},
    {"key": "px:rule/big", "data": {"type": "rule", "name": "big", "priority": 80, "conditions": ["amount > 60"], "actions": [{"kind": "notify"}, {"kind": "stop", "condition": "amount > 90"}]}},
    {"key": "px:rule/any", "data": {"type": "rule", "name": "any", "conditions": [], "actions": [{"kind": "log"}]}},
    {"key": "px:procedure/double", "data": {"type": "procedure", "name": "double", "params": ["n"], "trigger": {"kind": "tick"}, "steps": [{"kind": "return", "expr": "n * 2"}]}},
    {"key": "px:scenario/ok", "data": {"type": "scenario", "name": "ok", "given": {"a": 1}, "variables": {"amount": 70}, "steps": [
        {"kind": "call", "name": "double", "params": {"n": "$amount"}, "output": "two"}, {"kind": "call", "name": "put", "params": {"key": "k", "value": "$two"}}, {"kind": "emit", "event": "done", "data": {"n": 1}}],
        "expect": [{"check": "has_entry", "params": {"key": "a"}}, {"check": "store_value", "params": {"key": "k", "value": 140}}, {"check": "event_emitted", "params": {"event": "done", "n": 1}},
                   {"check": "constraint_violated", "params": {"name": "warn"}}, {"check": "constraint_violated", "params": {"name": "cap"}}, {"check": "var_equals", "params": {"var": "two", "value": 140}}, {"check": "is_healthy"}]}},
]


@pytest.fixture(scope="module")
def program():
    return records.Program.load(RECORDS)


def test_tables(spark, program):
    df = spark.createDataFrame([("a", "pay", 120.0), ("b", "pay", 70.0), ("c", "see", 20.0)], "id string, kind string, amount double")
    got = {(r.id, r.constraint, r.message) for r in program.violations(df).collect()}
    assert got == {("a", "cap", "120 is too much"), ("a", "warn", None), ("b", "warn", None)}
    assert {r.constraint for r in program.violations(df, phase="after").collect()} == {"warn"}
    fired = [(r.id, r.rule, r.action) for r in program.fire(df).where("id != 'c'").collect()]
    assert fired == [("a", "big", "notify"), ("a", "big", "stop"), ("a", "any", "log"), ("b", "big", "notify"), ("b", "any", "log")]
    facts = program.facts(spark.createDataFrame([("3", 5), ("x", 6)], "x string, t int"), "point").collect()
    assert [tuple(r) for r in facts] == [(3, "5"), (None, "6")]
    assert records.Program().violations(df).count() == 0 and program.triggered("tick") == ["double"]


def test_scenario(program):
    out = list(records.run_scenario(program, "ok").values())
    assert out == [True, True, True, True, False, True, True]


def test_bad_records():
    with pytest.raises(ValueError):
        records.Program.load([{"data": {"type": "nothing", "name": "x"}}])
    with pytest.raises(ValueError):
        records.Program.load([{"key": "px:fact/y", "data": {"type": "fact", "name": "x"}}])


def test_lint():
    proc = lambda name, steps, **kw: {"data": {"type": "procedure", "name": name, "steps": steps, **kw}}
    call = lambda n, out=None, **p: {"kind": "call", "name": n, "params": p} | ({"output": out} if out else {})
    p = records.Program.load([
        proc("empty", []),
        proc("arms", [{"kind": "match", "subject": "x", "arms": [{"pattern": "1", "steps": []}, {"pattern": "1", "steps": []}]}, {"kind": "match", "subject": "x", "arms": [{"pattern": "_", "steps": []}, {"pattern": "2", "steps": []}]}]),
        proc("vars", [call("f", "a"), call("f", "a"), {"kind": "loop", "over": "xs", "as": "x", "steps": [call("f")]}], params=["p", "xs"]),
        proc("flow", [{"kind": "try", "steps": [call("nobody")], "catch": []}, call("g", x=1), {"kind": "return", "expr": "y"}, call("f")]),
        proc("fine", [call("f", "a"), {"kind": "return", "expr": "a"}]),
    ])
    found = {(f.procedure, f.code) for f in records.lint(p, {"f": 0, "g": 2})}
    assert found == {
        ("empty", "PX-L001"), ("arms", "PX-L002"), ("arms", "PX-L003"), ("arms", "PX-L004"), ("vars", "PX-L005"), ("vars", "PX-L006"), ("vars", "PX-L008"), ("vars", "PX-L010"),
        ("flow", "PX-L007"), ("flow", "PX-L009"), ("flow", "PX-L011"), ("flow", "PX-L012"),
    }


def test_guidance(spark):
    e = spark.createDataFrame([("a", "x", 2, 0.5), ("b", "x", 1, 0.1), ("c", "x", 1, 0.9), ("d", "y", 0, 1.0)], "id string, category string, priority int, confidence double")
    assert [r.id for r in guidance.by_category(e, "x").collect()] == ["c", "b", "a"]
    assert guidance.upsert(e, e.where("id = 'a'").withColumn("priority", F.lit(9))).where("priority = 9").count() == 1 and guidance.remove(e, ["a", "d"]).count() == 2
    assert [r.id for r in guidance.spans(e, ["d", "zz", "a"]).collect()] == ["d", "a"]
    log = spark.range(48).withColumnRenamed("id", "seq")
    kept = guidance.push(log, spark.range(48, 55).withColumnRenamed("id", "seq"))
    assert kept.count() == 50 and [r.seq for r in guidance.recent(kept, 2).collect()] == [54, 53]
