"""Rule files: declarations of every kind, errors, and runs of what they declare."""

import pytest

from quern.plans import records, rulefile

FILE = """
import shared::kinds as kinds
# a comment
fact order:
  state: enum(open, paid)
  total: float

rule large_order:
  priority: 10
  when:
    - order.total > 100
    - order.state == "paid"
  then:
    - action: note key: "large" value: 1

constraint paid_in_full:
  scope: shop
  phase: before, after
  weight: 0.5
  when: total > 10
  require: state == "paid"
  severity: warning
  message: "Pay ${total} first"

entity customer:
  prefix: "cu"
  fields:
    id: string
    tags: list[string]

config limits:
  most: 3
  inner:
    on: true

contract greets:
  given: "a name"
  threshold: 0.9
  examples:
    - input: { name: "Ann", n: [1, 2.5] }
      expect: { ok: true }

trigger nightly:
  on: on_event("day.ended")
  run: close_day

function weigh(text: string, base: float) -> float:
  mode: hybrid
  \"\"\"Weighs a text.\"\"\"

procedure close_day:
  trigger: manual
  params: [$day]
  given: "The day is over"
  count_of {day: $day, kind: "order"} -> $n
  when $n > 2:
    note {key: "busy", value: $n} -> $noted
  end
  return $n * 2

procedure sort_mail(subject: string from "mail", sender: string from "senders") -> sorted into "done":
  given: "Sorts"
  {
    let urgent = subject == "now" || subject == "p1";
    let level = if urgent { "high" } else { "low" };
    emit({kind: "sorted", level: level, sender: sender});
    return {level: level};
  }

scenario days_close:
  given: "orders exist"
  setup:
    put {key: "k", value: 5} -> $ok
  run: close_day
  expect:
    - has_entry {key: "k"}
    - NOT event_emitted {kind: "sorted"}
"""


@pytest.fixture(scope="module")
def program():
    return records.Program.load(rulefile.read(FILE))


def test_declarations(program):
    assert {k: sorted(v) for k, v in program.records.items()} == {
        "import": ["kinds"], "fact": ["order"], "rule": ["large_order"], "constraint": ["paid_in_full"], "contract": ["greets"], "trigger": ["nightly"],
        "function": ["weigh"], "procedure": ["close_day", "sort_mail"], "scenario": ["days_close"],
    }
    assert program.of("fact")["order"]["fields"] == [{"name": "state", "type": "enum(open, paid)"}, {"name": "total", "type": "float"}]
    assert program.of("rule")["large_order"]["actions"] == [{"kind": "note", "key": "large", "value": 1}]
    c = program.of("constraint")["paid_in_full"]
    assert (c["phases"], c["severity"], c["weight"], c["scope"]) == (["before", "after"], "warning", 0.5, "shop")
    assert program.of("contract")["greets"]["examples"] == [{"input": {"name": "Ann", "n": [1, 2.5]}, "expect": {"ok": True}}]
    assert program.of("trigger")["nightly"]["on"] == "day.ended"
    assert program.of("function")["weigh"] == {"type": "function", "name": "weigh", "mode": "hybrid", "params": [{"name": "text", "type": "string"}, {"name": "base", "type": "float"}], "return_type": "float", "docstring": "Weighs a text."}
    assert program.of("procedure")["sort_mail"]["output"] == {"name": "sorted", "into": "done"}


def test_constraints_over_a_table(spark, program):
    df = spark.createDataFrame([(5.0, "open"), (50.0, "open"), (60.0, "paid")], "total double, state string")
    assert [(r.total, r.message) for r in program.violations(df).collect()] == [(50.0, "Pay 50 first")]


def test_procedures_run(program):
    notes = []
    actions = {"count_of": lambda p: 7 if p == {"day": "mon", "kind": "order"} else 0, "note": notes.append}
    i = program.interpreter(actions)
    assert i.run(program.of("procedure")["close_day"]["steps"], {"day": "mon"}).value == 14
    assert notes == [{"key": "busy", "value": 7}]
    out = i.run(program.of("procedure")["sort_mail"]["steps"], {"subject": "p1", "sender": "x"})
    assert out.value == {"level": "high"} and out.events == [{"event": "sorted", "data": {"level": "high", "sender": "x"}}]
    assert i.run(program.of("procedure")["sort_mail"]["steps"], {"subject": "later", "sender": "x"}).value == {"level": "low"}
    held = records.run_scenario(program, "days_close", {"count_of": lambda p: 1, "note": notes.append})
    assert list(held.values()) == [True, True]


@pytest.mark.parametrize(
    "text",
    [
        "constraint broken\n  when: a > 1\n  severity: error", "procedure p(message string):\n  return message", "constraint c:\n  when: a == 1\n  severity: fatal",
        "entity e:\n  prefix: \"x\"\n  fields:\n    - id: string\n    - n: int", "rule r:\n  when:\n    - (a", "trigger t:\n  on: never\n  run: x", "nonsense", "procedure p:\n  {\n    let a = 1;",
        "procedure p:\n  end", "function f(a) -> int:\n  mode: deterministic", "constraint c:\n  unknown: 1",
    ],
)
def test_errors(text):
    with pytest.raises(rulefile.RuleError):
        rulefile.read(text)
