"""Compiled rule records: constraints and rules over tables, procedures, scenarios, and a linter.

A record is ``{"key": "px:<type>/<name>", "data": {"type": ..., "name": ..., ...}}``. Conditions are texts of the
expression language; they compile to columns, so a set of rules is one pass over a table.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import px
from quern.plans.procedure import Interpreter, Outcome

PRIORITY = 50
TYPES = {"import", "fact", "rule", "constraint", "contract", "function", "trigger", "procedure", "scenario"}


@dataclass
class Program:
    """Records by type and name."""

    records: dict[str, dict[str, dict]] = field(default_factory=dict)

    @classmethod
    def load(cls, records: list[dict] | str) -> "Program":
        out = cls()
        for r in json.loads(records) if isinstance(records, str) else records:
            data = r.get("data", r)
            kind, name = data.get("type"), data.get("name") or data.get("alias") or data.get("path")
            if kind not in TYPES or not name:
                raise ValueError(f"not a record: {r!r}")
            if r.get("key", f"px:{kind}/{name}") != f"px:{kind}/{name}":
                raise ValueError(f"{r['key']} does not name {kind} {name}")
            out.records.setdefault(kind, {})[name] = data
        return out

    def of(self, kind: str) -> dict[str, dict]:
        return self.records.get(kind, {})

    # ------------------------------------------------------------ tables

    def violations(self, df: DataFrame, root: str | None = None, phase: str | None = None) -> DataFrame:
        """A row for each row of ``df`` and constraint with ``when`` but not ``require``: adds constraint, severity, message."""
        hits = []
        for name, c in sorted(self.of("constraint").items()):
            if phase is not None and c.get("phases") and phase not in c["phases"]:
                continue
            when = px.condition(df, c["when"], root) if c.get("when") else F.lit(True)
            require = px.condition(df, c["require"], root) if c.get("require") else F.lit(True)
            message = px.interpolate(df, c["message"], root) if c.get("message") else F.lit(None).cast("string")
            row = F.struct(F.lit(name).alias("constraint"), F.lit(c.get("severity", "error")).alias("severity"), message.alias("message"))
            hits.append(F.when(when & ~require, row))
        if not hits:
            return df.withColumn("_v", F.lit(None).cast("struct<constraint: string, severity: string, message: string>")).select(*df.columns, "_v.*").limit(0)
        return df.withColumn("_v", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull()))).select(*df.columns, "_v.*")

    def fire(self, df: DataFrame, root: str | None = None) -> DataFrame:
        """Rules whose conditions all hold, with their actions: adds rule, priority and action; highest priority first per row."""
        hits = []
        for name, r in sorted(self.of("rule").items(), key=lambda x: (-x[1].get("priority", PRIORITY), x[0])):
            holds: Column = F.lit(True)
            for text in r.get("conditions", []):
                holds = holds & px.condition(df, text, root)
            for action in r.get("actions", []):
                does = holds & px.condition(df, action["condition"], root) if "condition" in action else holds
                hits.append(F.when(does, F.struct(F.lit(name).alias("rule"), F.lit(int(r.get("priority", PRIORITY))).alias("priority"), F.lit(action["kind"]).alias("action"))))
        if not hits:
            return df.withColumn("_r", F.lit(None).cast("struct<rule: string, priority: int, action: string>")).select(*df.columns, "_r.*").limit(0)
        return df.withColumn("_r", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull()))).select(*df.columns, "_r.*")

    def facts(self, df: DataFrame, name: str) -> DataFrame:
        """Rows as a declared fact: its fields, cast to their types."""
        kinds = {"int": "bigint", "float": "double", "bool": "boolean", "string": "string"}
        return df.select(*[F.col(f["name"]).try_cast(kinds.get(f["type"], "string")).alias(f["name"]) for f in self.of("fact")[name]["fields"]])

    # ------------------------------------------------------------ procedures

    def interpreter(self, actions: dict | None = None, **options: Any) -> Interpreter:
        return Interpreter(dict(actions or {}), {n: p["steps"] for n, p in self.of("procedure").items()}, **options)

    def triggered(self, event: str) -> list[str]:
        """Procedures that an event starts, by name."""
        return sorted(n for n, p in self.of("procedure").items() if (p.get("trigger") or {}).get("kind") == event)


# ---------------------------------------------------------------------------- scenarios


@dataclass
class State:
    outcome: Outcome
    store: dict[str, Any] = field(default_factory=dict)
    violated: set[str] = field(default_factory=set)


def _emitted(s: State, p: dict) -> bool:
    rest = {k: v for k, v in p.items() if k != "event"}
    return any(e.get("event") == p["event"] and all(e.get(k, (e.get("data") or {}).get(k) if isinstance(e.get("data"), dict) else None) == v for k, v in rest.items()) for e in s.outcome.events)


CHECKS = {
    "has_entry": lambda s, p: p["key"] in s.store,
    "event_emitted": _emitted,
    "constraint_violated": lambda s, p: p["name"] in s.violated,
    "var_equals": lambda s, p: p["var"] in s.outcome.variables and s.outcome.variables[p["var"]] == p["value"],
    "store_value": lambda s, p: p["key"] in s.store and s.store[p["key"]] == p["value"],
    "is_healthy": lambda s, p: True,
}


def run_scenario(program: Program, name: str, actions: dict | None = None, checks: dict | None = None) -> dict[str, bool]:
    """Runs a scenario's steps and holds its expectations: name of each check -> whether it held."""
    scenario = program.of("scenario")[name]
    store: dict[str, Any] = dict(scenario.get("given", {}))
    own = {"put": lambda p: store.__setitem__(p["key"], p["value"]), "get": lambda p: store.get(p["key"])} | (actions or {})
    outcome = program.interpreter(own).run(scenario.get("steps", []), dict(scenario.get("variables", {})))
    violated = set()
    for n, c in program.of("constraint").items():
        env = {**store, **outcome.variables}
        when = not c.get("when") or px.truthy(px.evaluate(c["when"], env))
        if when and c.get("require") and not px.truthy(px.evaluate(c["require"], env)):
            violated.add(n)
    state, table, out = State(outcome, store, violated), CHECKS | (checks or {}), {}
    for i, e in enumerate(scenario.get("expect", [])):
        if e["check"] not in table:
            raise ValueError(f"unknown check {e['check']!r}")
        out[f"{i}:{e['check']}"] = bool(table[e["check"]](state, e.get("params", {}))) != e.get("not", False)
    return out


# ---------------------------------------------------------------------------- lint


@dataclass(frozen=True)
class Finding:
    code: str
    procedure: str
    message: str


def _names(e: Any) -> set[str]:
    """Variables that a parsed expression reads."""
    if isinstance(e, tuple):
        if e and e[0] == "path":
            return {e[1][0]}
        return set().union(*map(_names, e)) if e else set()
    return set()


def _reads(value: Any) -> set[str]:
    """Variables that a step's texts read, as ``$name``, ``${...}`` or an expression."""
    if isinstance(value, dict):
        return set().union(set(), *(_reads(v) for v in value.values()))
    if isinstance(value, list):
        return set().union(set(), *map(_reads, value))
    if not isinstance(value, str):
        return set()
    out: set[str] = set()
    for text in [value[1:]] if value.startswith("$") and not value.startswith("${") else px._HOLE.findall(value):
        try:
            out |= _names(px.parse(text))
        except px.PxError:
            continue
    return out


def _expr_reads(text: str | None) -> set[str]:
    try:
        return _names(px.parse(text)) if text else set()
    except px.PxError:
        return set()


def lint(program: Program, actions: dict[str, int | None] | None = None) -> list[Finding]:
    """Findings L001 to L012 of all procedures. ``actions``: known actions and how many parameters each takes."""
    known = {**{n: len(p.get("params", [])) or None for n, p in program.of("procedure").items()}, **(actions or {})}
    out: list[Finding] = []
    for name, p in sorted(program.of("procedure").items()):
        add = lambda code, text, name=name: out.append(Finding(code, name, text))
        if not p.get("steps"):
            add("PX-L001", "the body is empty")
        written: dict[str, int] = {}
        read: set[str] = set()

        def walk(steps: list[dict], loops: frozenset = frozenset()) -> None:
            ended = False
            for s in steps:
                if ended:
                    add("PX-L009", f"{s['kind']} is never reached")
                    ended = False
                kind = s["kind"]
                read.update(_expr_reads(s.get("condition")) | _expr_reads(s.get("expr")) | _expr_reads(s.get("over")) | _expr_reads(s.get("subject")))
                read.update(_reads({k: s[k] for k in ("params", "value", "data", "message", "times") if k in s}))
                if kind == "append":
                    read.add(s["to"])
                if kind == "call":
                    if s["name"] not in known:
                        add("PX-L011", f"{s['name']} is not defined")
                    elif known[s["name"]] is not None and known[s["name"]] != len(s.get("params", {})):
                        add("PX-L012", f"{s['name']} takes {known[s['name']]} parameters")
                target = s.get("output") if kind != "define" else s["name"]
                if target:
                    if target in written and kind == "call" and target not in read:
                        add("PX-L008", f"{target} is overwritten before it is read")
                    written[target] = written.get(target, 0) + 1
                if kind == "match":
                    _lint_match(s, add)
                    for arm in s["arms"]:
                        read.update(_expr_reads(arm.get("condition")) | _expr_reads(arm.get("guard")))
                        walk(arm["steps"], loops)
                if kind == "loop":
                    item = s.get("as", "item")
                    before = set(read)
                    walk(s["steps"], loops | {item})
                    if item not in read - (before - {item}) and item not in read:
                        add("PX-L006", f"{item} is not used")
                elif "steps" in s:
                    walk(s["steps"], loops)
                if kind == "try":
                    if "catch" in s and not s["catch"]:
                        add("PX-L007", "the catch is empty")
                    walk(s.get("catch", []), loops)
                for branch in s.get("branches", {}).values():
                    walk(branch, loops)
                ended = kind in ("return", "abort")

        walk(p.get("steps", []))
        for target in sorted(set(written) - read):
            add("PX-L005", f"{target} is not used")
        for param in p.get("params", []):
            if param not in read:
                add("PX-L010", f"parameter {param} is not used")
    return out


def _lint_match(s: dict, add) -> None:
    arms = s["arms"]
    conditions = [a.get("pattern", a.get("condition")) for a in arms]
    catch_all = [i for i, (a, c) in enumerate(zip(arms, conditions)) if c in ("_", "true") and "guard" not in a]
    if not catch_all:
        add("PX-L002", "not every case is matched")
    elif catch_all[0] < len(arms) - 1:
        add("PX-L003", f"arms after the {catch_all[0] + 1}. are never reached")
    plain = [c for a, c in zip(arms, conditions) if "guard" not in a]
    for c in sorted({c for c in plain if plain.count(c) > 1}):
        add("PX-L004", f"the arm {c} stands twice")
